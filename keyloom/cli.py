"""Command line: ``build KEYS MODEL``, ``index MODEL KEYS OUT``, ``sum MODEL KEYS``, ``describe MODEL``; keys are text lines."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import recsplit as R
from .sources import keys as K


def main(args: list[str], spark: SparkSession | None = None) -> object:
    spark = spark or SparkSession.builder.getOrCreate()
    match args:
        case ["build", source, target]:
            model = R.build(K.text_lines(spark, source).distinct(), "key", R.SIMPLE)
            model.save(target)
            out = model.n
        case ["index", path, source, target]:
            R.lookup(R.Model.load(spark, path), K.text_lines(spark, source), "key").write.csv(target)
            out = target
        case ["sum", path, source]:
            out = R.lookup(R.Model.load(spark, path), K.text_lines(spark, source), "key").agg(F.sum("idx")).first()[0]
        case ["describe", path]:
            out = R.Model.load(spark, path).space().first().asDict()
        case _:
            raise SystemExit(__doc__)
    print(out)
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
