"""License scans by diagonal voting.  DataFrame functions only.

Every rolling pair of words is hashed and joined to the word pairs of the templates, a fixed table
of a few thousand rows.  The join's keys are tested inside each text first, an exact semi-join: a
pair that no template has joins with nothing and need not become a row (as rows, all pairs cost
several times the CPU).  A meeting at word p of the text and word t of a template, compared as
words once their hashes agree, votes for the diagonal p - t.  Neighbouring diagonals, as insertions
and deletions give, are merged.  A merged span is verified by an alignment in which template and
text both go forward: each template position counts once, so repeated or scrambled parts don't add
up, and the share of positions on it must be large enough.

The three base phrases are templates that must be met whole on one diagonal, and so are the names
of licences: each name of the list with its versions, and SPDX ids, where a name that is an
everyday word or an institution counts only beside "license" or the like.  Of names that lie within
one another the longest counts.  A name of one word is a pair with nothing.  Word pairs of two very
common words are no seeds, except in phrases.

Nulls: a null text is empty; a null id stays null.  Equal rows get equal results.  An empty table
gives an empty result.  Columns besides the id and the text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices and license texts by the label that they give.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by-notice": """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of
        this license, visit http://creativecommons.org/licenses/by/4.0/.""",
    "apache-2.0-text": """"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by
        Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright
        owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and all other entities that
        control, are controlled by, or are under common control with that entity.""",
    "gpl-text": """The licenses for most software and other practical works are designed to take away your freedom to share and
        change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all
        versions of a program--to make sure it remains free software for all its users.""",
    "gpl-2.0-text": """The licenses for most software are designed to take away your freedom to share and change it. By contrast,
        the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the
        software is free for all its users.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely.""",
}
#: By label, the names of licences that stand for themselves, and their versions.
NAMES = {
    "apache": ("apache license|apache licence|apache software license", "1.0 1.1 2.0 2"),
    "gpl": ("gpl|gnu gpl|gnu general public license|gnu general public licence|general public license", "1.0 1 2.0 2 3.0 3"),
    "lgpl": ("lgpl|gnu lgpl|lesser gpl|lesser general public license|gnu lesser general public license|gnu library general public license", "2.0 2 2.1 3.0 3"),
    "agpl": ("agpl|gnu agpl|affero gpl|affero general public license|gnu affero general public license", "1.0 3.0 3"),
    "gfdl": ("gfdl|gnu fdl|gnu free documentation license", "1.1 1.2 1.3"),
    "mpl": ("mozilla public license|mozilla public licence|mpl 1|mpl 2", "1.0 1.1 2.0 2"),
    "epl": ("eclipse public license|epl 1|epl 2", "1.0 2.0 2"),
    "cddl": ("cddl|common development and distribution license", "1.0 1.1"),
    "eupl": ("eupl|european union public licence|european union public license", "1.0 1.1 1.2"),
    "bsl": ("boost software license", "1.0"),
    "busl": ("business source license|busl 1", "1.1"),
    "artistic": ("artistic license", "1.0 2.0"),
    "ofl": ("open font license|sil ofl|ofl 1", "1.0 1.1"),
    "odbl": ("odbl|open database license", "1.0"),
    "afl": ("academic free license", "2.1 3.0"),
    "osl": ("open software license", "2.1 3.0"),
    "ms-pl": ("microsoft public license|ms pl", ""),
    "ms-rl": ("microsoft reciprocal license|ms rl", ""),
    "upl": ("universal permissive license", "1.0"),
    "cecill": ("cecill", "2.0 2.1"),
    "wtfpl": ("wtfpl|do what the fuck you want to public license", ""),
    "unlicense": ("unlicense", ""),
    "0bsd": ("0bsd|zero clause bsd|bsd zero clause", ""),
    "bsd-2-clause": ("bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd license|freebsd license", ""),
    "bsd-3-clause": ("bsd 3 clause|3 clause bsd|three clause bsd|new bsd license|modified bsd license|revised bsd license", ""),
    "bsd-4-clause": ("bsd 4 clause|4 clause bsd|four clause bsd|original bsd license", ""),
    "cc0": ("cc0|cc zero|creative commons zero|creative commons cc0", "1.0"),
    "public-domain": ("public domain dedication|released into the public domain|dedicated to the public domain|placed in the public domain", ""),
}
#: By label, names that count only beside one of ``BESIDE``.
SHORT_NAMES = {"mit": "mit|expat", "bsd": "bsd", "isc": "isc", "zlib": "zlib|libpng", "x11": "x11", "apache": "apache", "mpl": "mpl", "epl": "epl", "ofl": "ofl", "artistic": "artistic", "postgresql": "postgresql", "python": "python|psf", "ruby": "ruby", "php": "php", "ncsa": "ncsa", "openssl": "openssl", "vim": "vim", "zope": "zpl|zope"}
BESIDE = ("{} license", "{} licence", "{} licensed", "{} style license", "license {}", "licence {}", "licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "identifier {}", "terms of the {}")
#: The parts of the Creative Commons family, as ids and in words.
CC = {"by": "attribution", "nc": "noncommercial|non commercial", "sa": "sharealike|share alike", "nd": "noderivatives|noderivs|no derivatives|no derivs"}
CC_FAMILY = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")


def name_phrases() -> dict[str, str]:
    """``{words: label}`` of all names of licences, with their versions."""
    out: dict[str, str] = {}

    def add(name: str, label: str, versions: str) -> None:
        out.setdefault(name, label)
        for v in versions.split():
            words, to = v.replace(".", " "), f"{label}-{v if '.' in v else v + '.0'}"
            for form in (f"{name} {words}", f"{name} v {words}", f"{name} v{words}", f"{name} version {words}", f"{name}{words}", f"{name}v{words}"):
                out.setdefault(form, to)

    for label, (names, versions) in NAMES.items():
        for name in names.split("|"):
            add(name, label, versions)
    for label, names in SHORT_NAMES.items():
        for name in names.split("|"):
            versions = NAMES.get(label, ("", ""))[1]
            for form in BESIDE:
                if form.endswith("{}"):
                    add(form.format(name), label, versions)
                else:
                    out.setdefault(form.format(name), label)
            for v in versions.split() if label == "apache" else ():
                out.setdefault(f"{name} {v.replace('.', ' ')}", f"{label}-{v if '.' in v else v + '.0'}")
    for parts in CC_FAMILY:
        label, spelt = "cc-" + parts.replace(" ", "-"), [""]
        for p in parts.split():
            spelt = [f"{x} {w}".strip() for x in spelt for w in CC[p].split("|")]
        for name in (f"cc {parts}", f"creative commons {parts}", *(f"{c} {x}" for c in ("creative commons", "cc") for x in spelt)):
            add(name, label, "1.0 2.0 2.5 3.0 4.0")
    return out


#: Words too common for a pair of them to be a seed.
COMMON = set("a an and any are as at be by for from in is it not of on or that the this to with you".split())
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def template_pairs(spark: SparkSession) -> DataFrame:
    """``(template, label, exact, named, t, a, b, seeds, length, key)``: one row per seed pair of a template; exact ones are met whole."""
    rows = []
    named = name_phrases().items()
    for exact, name, source in ((True, False, PHRASES.items()), (True, True, named), (False, False, ((text, label) for label, text in TEMPLATES.items()))):
        for text, label in source:
            words = template_words(text)
            pairs = list(zip(words, words[1:])) or [(words[0], "")]
            common = (COMMON | {"under"} if len(words) > 2 else set()) if name else set() if exact else COMMON
            seeds = [(t, a, b) for t, (a, b) in enumerate(pairs) if not (a in common and b in common)]
            title = f"{label}: {text}" if name else f"{label}!" if exact else label
            rows += [(title, label, exact, name, t, a, b, len(seeds), len(words)) for t, a, b in seeds]
    made = spark.createDataFrame(rows, "template string, label string, exact boolean, named boolean, t int, a string, b string, seeds int, length int")
    return made.withColumn("key", F.when(F.col("b") == "", F.xxhash64("a")).otherwise(F.xxhash64(F.xxhash64("a"), F.xxhash64("b"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.6, drift: int = 3) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    ``least_share``: the share of a template's seeds that a span must meet in order; ``drift``: how
    many words apart neighbouring diagonals may lie to be merged.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))  # equal rows share it
    pairs = template_pairs(docs.sparkSession)
    keys = [r["key"] for r in pairs.filter("b <> ''").select("key").distinct().collect()]  # of the fixed templates
    single = [r["key"] for r in pairs.filter("b = ''").select("key").distinct().collect()]
    d = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "").alias("w"))
    d = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("key", F.zip_with(F.col("h"), F.slice("h", F.lit(2), F.greatest(F.size("h"), F.lit(1))), lambda x, y: F.xxhash64(x, y)))
    met = F.filter(F.transform("key", lambda k, i: F.when(k.isin(keys), i)), lambda i: i.isNotNull())
    alone = F.filter(F.transform("h", lambda h, i: F.when(h.isin(single), i)), lambda i: i.isNotNull())
    d = d.withColumn("met", met).withColumn("alone", alone)
    in_pairs = F.transform("met", lambda i: F.struct(i.alias("p"), F.get("w", i).alias("a"), F.get("w", i + 1).alias("b"), F.get("key", i).alias("key")))
    by_itself = F.transform("alone", lambda i: F.struct(i.alias("p"), F.get("w", i).alias("a"), F.lit("").alias("b"), F.get("h", i).alias("key")))
    d = written(d.select("id", "row", F.size("w").cast("long").alias("n_words"), F.concat(in_pairs, by_itself).alias("met")), "met")

    hits = d.filter(F.size("met") > 0).dropDuplicates(["row"]).select("row", F.explode("met").alias("m")).select("row", "m.*")
    votes = hits.join(F.broadcast(pairs), ["key", "a", "b"]).withColumn("diagonal", F.col("p") - F.col("t"))  # broadcast: the fixed templates
    title = ("row", "template", "label", "exact", "named", "seeds", "length")
    lines = votes.groupBy(*title, "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.sort_array(F.collect_list(F.struct("t", "p"))).alias("met"))  # at most one vote for each template position
    lines = lines.filter(~F.col("exact") | (F.col("votes") == F.col("seeds")))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > F.when(F.col("exact"), 0).otherwise(drift), F.lit(True))
    spans = lines.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*title, "span").agg(F.sum("votes").alias("votes"), F.flatten(F.collect_list("met")).alias("met"))
    spans = spans.filter(F.col("votes") >= least_share * F.col("seeds")).withColumn("in_order", _in_order(F.col("met")))
    spans = spans.withColumn("share", F.col("in_order.n") / F.col("seeds")).withColumn("start", F.col("in_order.start")).filter(F.col("share") >= least_share)
    within = Window.partitionBy("row", "named").orderBy("start", F.desc("length"), "template").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = spans.withColumn("covered", F.coalesce(F.max(end).over(within) >= end, F.lit(False))).filter(~F.col("named") | ~F.col("covered"))
    base = F.col("exact") & ~F.col("named")
    found = spans.groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    out = d.select("id", "row", "n_words").join(found, "row", "left").na.fill("", ["base_labels", "labels"]).na.fill(0, ["n_base", "score"])
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.col("score").cast("double").alias("score"))


def _in_order(met: Column) -> Column:
    """Of votes ``(t, p)``, how many lie on the longest alignment in which both increase, and where it starts in the text.

    Votes are taken by rising ``t``, and by falling ``p`` for the same ``t``; the state holds, for each
    length, the least last ``p`` of a chain of that length and where that chain starts.
    """
    falling = lambda x, y: F.when(x["t"] != y["t"], F.signum(x["t"] - y["t"]).cast("int")).otherwise(F.signum(y["p"] - x["p"]).cast("int"))
    none = F.array().cast("array<struct<p:int,start:int>>")

    def taken(ends: Column, x: Column) -> Column:
        k = F.size(F.filter(ends, lambda e: e["p"] < x["p"]))
        start = F.when(k == 0, x["p"] - x["t"]).otherwise(F.get(ends, k - 1)["start"])
        return F.concat(F.slice(ends, F.lit(1), k), F.array(F.struct(x["p"].cast("int").alias("p"), start.cast("int").alias("start"))), F.slice(ends, k + 2, F.greatest(F.size(ends) - k - 1, F.lit(0))))

    last = lambda ends: F.struct(F.size(ends).alias("n"), F.element_at(ends, -1)["start"].alias("start"))
    return F.aggregate(F.array_sort(met, falling), none, taken, last)
