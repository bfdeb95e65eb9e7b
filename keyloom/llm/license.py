"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams. DataFrame functions only."""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording of public licence notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def size_bounds(size: int, least: float) -> tuple[int, int]:
    """Numbers of bigrams that a text may have to reach a Dice coefficient of ``least`` with ``size`` others, all of the fewer shared."""
    return math.ceil(size * least / (2 - least) - 1e-9), math.floor(size * (2 - least) / least + 1e-9)


def normalised(text: Column) -> Column:
    """Lower-case letters and digits, words parted by a blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring words of a normalised text."""
    def pairs(words):
        joined = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.when(F.size(words) > 1, joined).otherwise(F.array().cast("array<string>")))

    return _once(F.split(text, " "), pairs)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it occurs in it: a lambda's variable isn't put in place of its name."""
    return F.element_at(F.transform(F.array(value), use), 1)


def anchors(templates, least: float) -> list[str]:
    """Words and word pairs of which every text with a match holds one.

    A match shares at least ``size * least / (2 - least)`` bigrams of its template. So anchors that together stand in
    more bigrams of it than may be missing can't all be missing. Long words come first, as few other texts hold them.
    """
    out: set[str] = set()
    for _, text in templates:
        words = re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ")
        pairs = {f"{a} {b}" for a, b in zip(words, words[1:])}
        open_, allowed = set(pairs), len(pairs) - size_bounds(len(pairs), least)[0]
        held = lambda anchor: {p for p in open_ if anchor in p.split(" ") or anchor == p}  # noqa: E731, B023
        items = sorted({w for w in words if len(w) >= 8}, key=lambda w: (-len(w), w)) + sorted(pairs, key=lambda p: (-len(p), p))
        for anchor in items:
            if len(pairs) - len(open_) > allowed:
                break
            if found := held(anchor):
                out.add(anchor)
                open_ -= found
    return sorted(out)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def template_table(spark, templates, least: float) -> DataFrame:
    """template, license, grams and size, a row for each number of bigrams that a matching text may have: a few thousand rows at most."""
    values = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(templates))
    table = spark.sql(f"select * from values {values} as t(template, license, text)").withColumn("grams", bigrams(normalised(F.col("text"))))
    n = F.size("grams")
    low, high = F.ceil(n * F.lit(least / (2 - least)) - 1e-9), F.floor(n * F.lit((2 - least) / least) + 1e-9)
    return table.where(n > 0).select("template", "license", "grams", F.explode(F.sequence(F.greatest(low.cast("int"), F.lit(1)), high.cast("int"))).alias("size"))


def _sets(templates, least: float) -> list[tuple[str, set[str], int, int]]:
    """Name, bigrams and size bounds of each template that has bigrams."""
    words = [(name, re.sub(r"[\W_]+", " ", x.lower()).strip().split(" ")) for name, x in templates]
    sets = [(name, {f"{a} {b}" for a, b in zip(w, w[1:])}) for name, w in words]
    return [(name, pairs, *size_bounds(len(pairs), least)) for name, pairs in sets if pairs]


def _listed(pairs) -> Column:
    return F.split(F.lit("\n".join(sorted(pairs))), "\n")


def _wordings(sets) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("id"), F.lit(name).alias("license"), _listed(pairs).alias("grams"), F.lit(len(pairs)).alias("n"), F.lit(low).alias("low")) for i, (name, pairs, low, _) in enumerate(sets)))


def runs(text: Column, templates, least: float) -> Column:
    """license, own and dice of the runs of neighbouring sentences (so of lines and paragraphs too) that match a template.

    A fold over the sentences keeps the most recent distinct bigrams, each with the last sentence it starts in: those of
    a run's start or later are the run's set. More of them than a template's bounds let match are never needed, so the
    work is linear in the text, however often its parts repeat. A run that ends in a sentence without a bigram of a
    template is passed over: without that sentence it matches better. Of the matches that overlap, the shortest one that
    ends first has its set in ``own``, the others have null: they are the same notice.
    """
    sets = _sets(templates, least)
    wordings = _wordings(sets)
    known, keep = _listed(set().union(*(x[1] for x in sets))), max(x[3] for x in sets) + 1
    state_type = "struct<at: int, last: string, recent: array<struct<gram: string, at: int, of: array<int>>>, ends: array<int>, found: array<struct<license: string, own: array<string>, dice: double>>>"

    def match(w, recent):
        """The shortest run up to here that matches the wording, and the best coefficient of all of them."""
        def of_hits(hits):
            share = lambda s: F.lit(2.0) * F.size(F.filter(hits, lambda h: h["at"] >= s)) / (F.size(F.filter(recent, lambda x: x["at"] >= s)) + w["n"])
            starts = F.transform(F.array_distinct(F.transform(hits, lambda h: h["at"])), lambda s: F.struct(s.alias("s"), share(s).alias("dice")))
            good = F.filter(starts, lambda x: x["dice"] >= least)
            best = lambda good: F.when(F.size(good) > 0, F.struct(w["license"].alias("license"), F.array_max(F.transform(good, lambda x: x["s"])).alias("s"), F.array_max(F.transform(good, lambda x: x["dice"])).alias("dice")))
            return F.when(F.size(hits) >= w["low"], _once(good, best))

        return _once(F.filter(recent, lambda x: F.array_contains(x["of"], w["id"])), of_hits)

    def step(state, sentence):
        words, at = F.split(sentence, " "), state["at"] + 1
        edge = F.when(state["last"] != "", F.array(F.concat(state["last"], F.lit(" "), F.element_at(words, 1)))).otherwise(F.array().cast("array<string>"))

        def with_grams(g):
            """g: the sentence's own bigrams, the one that leads into it, and those of both that a template holds."""
            of = lambda x: F.when(F.array_contains(g["hits"], x), F.transform(F.filter(wordings, lambda w: F.array_contains(w["grams"], x)), lambda w: w["id"])).otherwise(F.array().cast("array<int>"))
            entry = lambda x, n: F.struct(x.alias("gram"), n.alias("at"), of(x).alias("of"))
            older = F.filter(state["recent"], lambda x: ~F.array_contains(g["inner"], x["gram"]) & ~F.array_contains(g["edge"], x["gram"]))
            recent = F.slice(F.concat(F.transform(g["inner"], lambda x: entry(x, at)), F.transform(g["edge"], lambda x: entry(x, at - 1)), older), 1, keep)

            def with_recent(recent):
                matches = F.when(F.size(g["hits"]) > 0, F.transform(wordings, lambda w: match(w, recent)))
                return _once(matches, lambda matches: following(recent, matches))

            return _once(recent, with_recent)

        def following(recent, matches):
            own = lambda s: F.array_sort(F.transform(F.filter(recent, lambda x: x["at"] >= s), lambda x: x["gram"]))
            row = lambda m, end: F.when(m.isNotNull(), F.struct(m["license"].alias("license"), F.when(m["s"] > end, own(m["s"])).alias("own"), m["dice"].alias("dice")))
            rows = F.filter(F.zip_with(matches, state["ends"], row), lambda r: r.isNotNull() & ~F.array_contains(state["found"], r))
            any_ = F.coalesce(F.exists(matches, lambda m: m.isNotNull()), F.lit(False))
            ends = F.when(any_, F.zip_with(matches, state["ends"], lambda m, end: F.when(m["s"] > end, at).otherwise(end))).otherwise(state["ends"])
            found = F.when(any_, F.concat(state["found"], rows)).otherwise(state["found"])
            return F.struct(at.alias("at"), F.element_at(words, -1).alias("last"), recent.alias("recent"), ends.alias("ends"), found.alias("found")).cast(state_type)

        grams = _once(bigrams(sentence), lambda own: F.struct(F.slice(own, 1, keep).alias("inner"), F.array_except(edge, own).alias("edge"), F.array_intersect(F.concat(own, edge), known).alias("hits")))
        return _once(grams, with_grams)

    sentences = F.filter(F.transform(F.split(text, r"\n|(?<=[.!?])\s+"), normalised), lambda x: x != "")
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), F.array().alias("recent"), F.array_repeat(F.lit(-1), len(sets)).alias("ends"), F.array().alias("found")).cast(state_type)
    return F.aggregate(sentences, first, step, lambda state: state["found"])


def scan(docs: DataFrame, templates=TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, license, units and dice: how many lines, paragraphs, whole texts or runs match a licence, and the best coefficient.

    A text is scanned as its lines, its paragraphs and itself, each distinct one once, and in runs of neighbouring
    sentences. Of the runs that overlap one counts, and none that holds a matching unit or lies in one. The size of a unit's bigram set
    selects its candidate templates, so most units meet none; the templates are fixed, which bounds the broadcast.
    Before all that, texts without any of the templates' anchors are passed over, as they can't match.
    Null and empty texts and units of fewer than two words match nothing; rows of one doc_id (or none) are counted
    together; only documents with a match are returned, so no rows give none. A text that matches several licences has a row
    for each, equally good wordings of one count once. Texts of any length are scanned whole, in work linear in
    it; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col("text")
    parts = anchors(templates, least)
    may_match = _once(normalised(text), lambda t: functools.reduce(lambda a, b: a | b, (F.contains(t, F.lit(x)) for x in parts), F.lit(False)))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n\s*\n"), F.array(text)))
    units = F.transform(units, lambda u: _once(bigrams(normalised(u)), lambda own: F.struct(F.size(own).alias("size"), F.lit(None).cast("string").alias("run_license"), own.alias("own"), F.lit(None).cast("double").alias("run_dice"))))
    wordings = _wordings(_sets(templates, least))

    def in_unit(units, r):
        matches = lambda u: F.exists(wordings, lambda w: (w["license"] == r["license"]) & (F.lit(2.0) * F.size(F.array_intersect(u["own"], w["grams"])) / (u["size"] + w["n"]) >= least))
        return F.exists(units, lambda u: (u["size"] > 0) & (F.size(F.array_intersect(u["own"], r["own"])) == F.least(u["size"], F.size(r["own"]))) & matches(u))

    def with_runs(units):
        row = lambda r: F.struct(F.lit(None).cast("int").alias("size"), r["license"].alias("run_license"), F.when(r["own"].isNotNull() & ~in_unit(units, r), r["own"]).alias("own"), r["dice"].alias("run_dice"))
        return F.concat(units, F.transform(runs(text, templates, least), row))

    rows = docs.where("text is not null").where(may_match).select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(_once(units, with_runs)))
    found = rows.join(F.broadcast(template_table(spark, templates, least)), "size", "left")
    dice = F.coalesce("run_dice", F.lit(2.0) * F.size(F.array_intersect("own", "grams")) / (F.col("size") + F.size("grams")))
    found = found.select("doc_id", F.coalesce("run_license", "license").alias("license"), "own", dice.alias("dice")).where(F.col("dice") >= least)
    # a unit that matches several wordings of a licence counts once
    found = found.groupBy("doc_id", "license", F.array_sort("own").alias("own")).agg(F.max("dice").alias("dice"))
    return found.groupBy("doc_id", "license").agg(F.count("own").alias("units"), F.round(F.max("dice"), 6).alias("dice"))


def scan_sql(templates=TEMPLATES, least: float = 0.8) -> str:
    """The same in DuckDB's SQL, by comparing every unit with every template, and every run with the templates of which its text holds enough bigrams."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(templates))
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    normal = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    words = lambda x: f"string_split({normal(x)}, ' ')"
    dice = lambda own: f"2.0 * len(list_intersect({own}, grams)) / (len({own}) + len(grams))"
    return f"""
        with recursive templates as (select template, license, {grams} as grams from (select template, license, {words("text")} as w from (values {values}) t(template, license, text))),
        texts as (select row_number() over () as r, doc_id, text from documents where text is not null),
        units as (select distinct r, doc_id, unit from texts, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n\\s*\\n'), [text])) u(unit)),
        sets as (select r, doc_id, {grams} as own from (select r, doc_id, {words("unit")} as w from units)),
        found as (select distinct r, doc_id, license, list_sort(own) as own, max({dice("own")}) as dice
            from sets, templates where len(own) > 0 and 2 * least(len(own), len(grams)) >= {least} * (len(own) + len(grams)) - 1e-9
            group by r, doc_id, license, list_sort(own), own having max({dice("own")}) >= {least}),
        -- a sentence ends at a line's end or at a blank after a stop
        sentences as (select r, doc_id, [string_split(x, ' ') for x in [{normal("s")} for s in
            string_split(regexp_replace(text, '([.!?])[ \\t\\n\\v\\f\\r]+', '\\1' || chr(10), 'g'), chr(10))] if x <> ''] as parts from texts),
        places as (select r, doc_id, flatten(parts) as w, flatten(list_transform(parts, lambda x, i: list_transform(x, lambda y: i))) as place from sentences),
        pairs as (select r, doc_id, place, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] as all_grams from places),
        -- a run's set is part of the text's, so texts that share too few bigrams have no run that matches
        hits as (select *, [i for i in range(1, len(all_grams) + 1) if list_contains(grams, all_grams[i])] as hit
            from pairs, templates where len(list_intersect(list_distinct(all_grams), grams)) >= len(grams) * {least} / (2 - {least}) - 1e-9 and len(grams) > 0),
        -- runs start and end in sentences with one of the template's bigrams: others only lower the coefficient
        starts as (select *, unnest(list_distinct([place[i] for i in hit])) as first from hits),
        spans as (select *, unnest(list_distinct([place[i + 1] for i in hit])) as last from starts),
        runs as (select r, doc_id, template, license, grams, first, last,
            list_distinct(all_grams[list_position(place, first):len(list_filter(place, lambda x: x <= last)) - 1]) as own from spans where first <= last),
        matches as (select *, {dice("own")} as dice from runs where {dice("own")} >= {least}),
        shortest as (select r, template, last, max(first) as first from matches group by all),
        -- of runs that overlap, the shortest of those that end first
        taken(r, template, first, last) as (select r, template, arg_min(first, last), min(last) from shortest group by r, template
            union all select t.r, t.template, arg_min(s.first, s.last), min(s.last) from taken t join shortest s on t.r = s.r and t.template = s.template and s.first > t.last group by t.r, t.template),
        counted as (select m.r, doc_id, license, list_sort(own) as own, dice from taken join matches m using (r, template, first, last)),
        rows_ as (select doc_id, license, own, dice from found union all select doc_id, license, null, dice from matches
            union all select doc_id, license, own, dice from counted c where not exists (select 1 from found f where f.r = c.r and f.license = c.license
                and len(list_intersect(f.own, c.own)) = least(len(f.own), len(c.own))))
        select doc_id, license, count(distinct own) as units, round(max(dice), 6) as dice from rows_ group by all"""
