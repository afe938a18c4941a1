"""Licence scans over a positional index of rare tokens, with DataFrame functions only.

The index holds, for each word of the licence templates (whole notices and short statements), the templates and positions
where it stands. A corpus pass counts in how many documents each licence word occurs. For each document and each template
whose mandatory key phrase stands in it, the ``LOOKED_UP`` of the template's words in the document with the highest IDF are looked
up, so notices do not take each other's lookups; IDF ranks words and weighs them, it removes none. A posting at position p of a
template, met at word i of the document, votes for the template starting at word i - p. As words that are put in or left out move
the starts that the rest votes for, starts are counted in bands: ``BAND`` neighbouring ones and the ``BAND`` after them, so that starts up to ``BAND``
apart share one. A band is weighed by the IDF of the distinct words that vote for it; where that reaches ``SHARE`` of what the template's own
``LOOKED_UP`` rarest words weigh, in the corpus or not, the template is accepted.

What is broadcast is the index: as many rows as the templates have words, whatever the corpus. IDF is counted in whole
millionths, so sums do not depend on their order.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOOKED_UP = 16
SHARE = 0.6
BAND = 8

#: Label, notice or statement, key phrase that must stand in the text.
TEMPLATES = (
    ("mit", "SPDX-License-Identifier: MIT", "spdx license identifier mit"),
    ("apache", "SPDX-License-Identifier: Apache-2.0", "spdx license identifier apache"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-or-later", "spdx license identifier gpl"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later", "spdx license identifier lgpl"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-or-later", "spdx license identifier agpl"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause", "spdx license identifier bsd"),
    ("isc", "SPDX-License-Identifier: ISC", "spdx license identifier isc"),
    ("mpl", "SPDX-License-Identifier: MPL-2.0", "spdx license identifier mpl"),
    ("unlicense", "SPDX-License-Identifier: Unlicense", "spdx license identifier unlicense"),
    ("zlib", "SPDX-License-Identifier: Zlib", "spdx license identifier zlib"),
    ("boost", "SPDX-License-Identifier: BSL-1.0", "spdx license identifier bsl"),
    ("cc-by", "SPDX-License-Identifier: CC-BY-4.0", "spdx license identifier cc by"),
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "permission is hereby granted free of charge",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
        "with or without fee is hereby granted",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0", "apache license"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache license",
    ),
    ("gpl", "Licensed under the GNU General Public License version", "general public license"),
    ("gpl", "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu general public license"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gnu general public license",
    ),
    ("lgpl", "GNU Lesser General Public License", "lesser general public license"),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
        "lesser general public license",
    ),
    ("agpl", "GNU Affero General Public License", "affero general public license"),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        "affero general public license",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution and use in source and binary forms"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "redistribution and use in source and binary forms",
    ),
    ("mpl", "subject to the terms of the Mozilla Public License", "mozilla public license"),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "mozilla public license",
    ),
    ("mpl", "Mozilla Public License", "mozilla public license"),
    ("cc-by", "Licensed under CC BY-NC 4.0", "cc by"),
    ("cc-by", "licensed under a Creative Commons Attribution license", "creative commons attribution"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered software"),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unencumbered software",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "in no event will the authors be held liable",
    ),
    (
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        "to any person or organization obtaining a copy",
    ),
)
#: Fixed values of the contract: last word, the words before it, label.
BASE = (("license", ("mit",), "mit"), ("license", ("apache",), "apache"), ("license", ("public", "general"), "gpl"))


def plain_words(text: str) -> list[str]:
    """The words of a template; all are ASCII."""
    return [x for x in re.split(SPLIT, text.lower()) if x]


def weight(documents: int, holders: int) -> int:
    """The IDF of a word in millionths: above 0 even if all documents hold it, largest if none does."""
    return round(1e6 * math.log((documents + 1) / (holders + 0.5)))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPLIT), "")


def _places(w: Column) -> Column:
    """(start, label) of every base phrase in the array of words ``w``."""

    def place(word: Column, i: Column) -> Column:
        found = F.lit(None).cast("struct<start:bigint,label:string>")
        for last, before, label in BASE:
            fits = reduce(lambda a, k: a & (F.get(w, i - k - 1) == before[k]), range(len(before)), word == last)
            found = F.coalesce(found, F.when(fits, F.struct((i - len(before)).cast("bigint").alias("start"), F.lit(label).alias("label"))))
        return found

    return F.filter(F.transform(w, place), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    Null texts count as empty: no words, no labels, score 0. Rows that share id and text get the same result, and copies of a row
    do not add up. The score is 1 where a base phrase stands, else the largest share of votes of an accepted template.
    """
    spark = docs.sparkSession
    templates = [plain_words(text) for _, text, _ in TEMPLATES]
    vocabulary = sorted({x for t in templates for x in t})
    licence_words = F.array(*map(F.lit, vocabulary))
    row = [F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_same")]
    own = docs.select("doc_id", *row, words(F.coalesce("text", F.lit(""))).alias("_w"))
    found = F.when(F.array_contains("_w", "license"), _places(F.col("_w")))
    base = stash(own.select("doc_id", "_id", "_same", F.size("_w").cast("long").alias("n_words"), found.alias("_found"), F.array_intersect("_w", licence_words).alias("_hits")))

    counts = dict(base.select(F.explode("_hits").alias("w")).groupBy("w").count().collect())  # a row for each licence word at most
    total = base.count()
    idf = {x: weight(total, counts.get(x, 0)) for x in vocabulary}
    ranked = [sorted(set(t), key=lambda x: (-idf[x], x)) for t in templates]
    most = [sum(idf[x] for x in r[:LOOKED_UP]) for r in ranked]
    index = spark.createDataFrame([(x, t, p, idf[x]) for t, text in enumerate(templates) for p, x in enumerate(text)], "_word string, _template int, _position int, _idf long")

    # For each template the words to look up, or null without its key phrase; array_intersect keeps the order of IDF.
    phrases = sorted({phrase for _, _, phrase in TEMPLATES})
    held = own.select("_id", "_same", "_w", F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias("_text")).filter(F.col("_text").rlike(f" (?:{'|'.join(phrases)}) "))
    held = held.withColumn("_own", F.array_intersect("_w", licence_words))
    best = [F.when(F.col("_text").contains(f" {phrase} "), F.slice(F.array_intersect(F.array(*map(F.lit, r)), F.col("_own")), 1, LOOKED_UP)) for r, (_, _, phrase) in zip(ranked, TEMPLATES, strict=True)]
    lists = F.filter(F.transform(F.array(*best), lambda x, t: F.struct(t.alias("t"), x.alias("x"))), lambda x: x["x"].isNotNull())
    # A text that has several key phrases is asked about several templates: only its licence words go along.
    spots = F.filter(F.transform("_w", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda p: F.array_contains(licence_words, p["w"]))
    asked = held.withColumn("_spots", spots).select("_id", "_same", "_spots", F.inline(lists).alias("_template", "_list"))
    places = F.filter("_spots", lambda p: F.array_contains("_list", p["w"]))
    start = F.col("_i") - F.col("_position")
    bands = F.array(F.floor(start / BAND), F.floor(start / BAND) - 1)
    votes = (
        asked.select("_id", "_same", "_template", F.inline(places).alias("_i", "_word"))
        .join(F.broadcast(index), ["_word", "_template"])
        .withColumn("_band", F.explode(bands))
        # Each word votes once for a band, however often it or a copy of the row says so.
        .groupBy("_id", "_same", "_template", "_band", "_word")
        .agg(F.first("_idf").alias("_idf"))
        .groupBy("_id", "_same", "_template", "_band")
        .agg(F.sum("_idf").alias("_votes"))
        .withColumn("_share", F.least(F.lit(1.0), F.col("_votes") / F.element_at(F.array(*map(F.lit, most)), F.col("_template") + 1)))
        .filter(F.col("_share") >= SHARE)
    )
    label = F.element_at(F.array(*[F.lit(x) for x, _, _ in TEMPLATES]), F.col("_template") + 1)
    accepted = votes.groupBy("_id", "_same").agg(F.collect_set(label).alias("_labels"), F.max("_share").alias("_score"))

    none = F.array().cast("array<string>")
    own_labels = F.array_distinct(F.transform("_found", lambda x: x["label"]))
    text = lambda a: F.array_join(F.sort_array(F.coalesce(a, none)), ",")
    n_base = F.when(F.col("_found").isNull(), 0).otherwise(F.size("_found")).cast("long")
    starts = F.transform("_found", lambda x: x["start"])
    return base.join(accepted, ["_id", "_same"], "left").select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        text(own_labels).alias("base_labels"),
        text(F.array_union(F.coalesce(own_labels, none), F.coalesce("_labels", none))).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
