import pytest

from keyloom import cli
from keyloom.operators import recsplit as R


def test_cli(spark, tmp_path):
    keys, model, out = (str(tmp_path / x) for x in ("keys.txt", "model", "out"))
    (tmp_path / "keys.txt").write_text("".join(f"{i}\n" for i in range(500)) + "7\n")
    assert cli.main(["build", keys, model], spark) == 500
    (tmp_path / "some.txt").write_text("".join(f"{i}\n" for i in range(500)))
    assert cli.main(["sum", model, str(tmp_path / "some.txt")], spark) == 499 * 500 // 2
    cli.main(["index", model, str(tmp_path / "some.txt"), out], spark)
    assert spark.read.csv(out).count() == 500
    assert cli.main(["describe", model], spark)["n"] == 500
    with pytest.raises(SystemExit):
        cli.main([], spark)


def test_forms(spark):
    keys = spark.range(700).selectExpr("'k' || id as k")
    for kind in ("string", "text"):
        model = R.build(keys, "k", R.Options(kind), partitions=3)
        assert R.check(R.lookup(model, keys, "k")).first().distinct_idx == 700
        back = R.expanded(R.compressed(model), model.options)
        assert sorted((r.bucket, r.nodes) for r in back.collect()) == sorted((r.bucket, r.nodes) for r in model.table.collect())
        assert R.description(model).count() == 7
