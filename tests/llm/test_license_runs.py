import re

import duckdb
import pandas as pd

from keyloom.llm import license

SCHEMA = "doc_id long, text string"

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD = """Copyright (c) 2020, Some Holder

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
OTHER = " ".join(f"word{i}" for i in range(80)) + "."
TEXTS = [GPL + "\n" + OTHER, BSD, f"Some words stand before it. Released under the MIT License. {OTHER}", OTHER, "Released under the MIT License.\n" * 400 + OTHER, "a b c d.\n" * 3000 + "License license."]


def by_force(text, least=0.8):
    """The best coefficient of each licence over all runs of neighbouring sentences."""
    pairs = lambda x: {f"{a} {b}" for w in [re.sub(r"[\W_]+", " ", x.lower()).split()] for a, b in zip(w, w[1:])}
    parts, best = re.split(r"\n|(?<=[.!?])\s+", text), {}
    for i in range(len(parts)):
        for j in range(i + 1, len(parts) + 1):
            own = pairs(" ".join(parts[i:j]))
            for name, template in license.TEMPLATES:
                grams = pairs(template)
                dice = 2 * len(own & grams) / (len(own) + len(grams))
                if dice >= least:
                    best[name] = max(dice, best.get(name, 0))
    return {k: round(v, 6) for k, v in best.items()}


def test_runs_of_sentences(spark):
    found = {(r.doc_id, r.license): r for r in license.scan(spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)).collect()}
    for i in range(4):
        assert {name: r.dice for (n, name), r in found.items() if n == i} == by_force(TEXTS[i])
    assert set(found) == {(0, "GPL-3.0"), (1, "BSD-3-Clause"), (2, "MIT"), (4, "MIT")}
    assert found[(2, "MIT")].units == 1 and found[(4, "MIT")].dice == 1.0


def test_overlapping_runs_are_one_place(spark):
    mit = [x for n, x in license.TEMPLATES if n == "MIT" and len(x) > 200][0]
    by_words = mit.replace(" ", "\n")
    texts = [OTHER + "\n" + by_words + "\n" + OTHER, f"{OTHER} {mit} {OTHER}\nReleased under the MIT License.", mit]
    found = {r.doc_id: r for r in license.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert [(found[i].units, found[i].dice) for i in range(3)] == [(1, 1.0), (2, 1.0), (1, 1.0)]


def test_sql_counts_the_same(spark):
    mit = [x for n, x in license.TEMPLATES if n == "MIT" and len(x) > 200][0]
    words = mit.split(" ")
    texts = [
        *TEXTS[:4], mit, mit.replace(" ", "\n"), f"{OTHER} {mit} {OTHER}\nReleased under the MIT License.",
        f"{' '.join(words[:50])}. {' '.join(words[50:])}\n\n{OTHER}\n\n{' '.join(words[:40])}! {' '.join(words[40:])} More.",
        "Released under the MIT License.\n" * 40 + OTHER, "One. Licensed under the Apache License, Version 2.0. Two. Licensed under the Apache License, Version 2.0, too. Three.",
        "It is licensed under\vthe CC BY-NC 4.0. \x0b Licensed under CC BY-NC 4.0.", None, "", "license", OTHER,
    ]
    rows = [(i % 11, x) for i, x in enumerate(texts)] + [(3, mit), (None, GPL), (None, GPL)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    expected = sorted(duckdb.sql(license.scan_sql()).fetchall(), key=str)
    found = sorted((tuple(r[x] for x in ("doc_id", "license", "units", "dice")) for r in license.scan(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert found == expected and len(found) > 8
