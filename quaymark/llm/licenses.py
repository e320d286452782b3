"""License scan: phrases at word positions, and an exact containment join with license templates.

Words are the runs outside ASCII marks, blanks and controls, with A-Z in lower case. A block is a window of consecutive
words of the whole text, whatever lines it spans. A template of n words is looked for in windows of the least length of
``WINDOWS`` that is twice n or more, at every half window; so a passage of up to half a window lies whole in one. A block meets
a template if it holds at least ``THRESHOLD`` of the template's distinct words. Tokens are ordered by the number of documents that
hold them, rarest first, counted over all documents. A block can meet a template of size t only if it
shares one of the template's first ``t - a + 1`` tokens, ``a`` being the least overlap (prefix filter),
has ``a`` tokens of templates itself (length filter), and has enough tokens left after the first
match on either side (positional filter). The pairs that remain are counted exactly.

Texts are read once: what is kept of them are the places of template words. Only documents with a prefix token are cut into
blocks. Nothing else than template words, whose number the templates bound, is collected or broadcast. DataFrame functions only.

Nulls: a null text is empty and has no words; a null ``doc_id`` is kept. Repeated rows each get a row.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.sources.shared import stored

THRESHOLD = 0.9
WINDOWS = (16, 64, 256, 1024, 4096, 16384)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and texts of public licenses, as their publishers word them. Fixed values.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("reserved", "All rights reserved"),
)


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _template_words(templates) -> list[tuple[str, list[str], int]]:
    """Label, distinct words and window of each template."""
    import re

    parsed = [(label, re.findall("[a-z0-9]+", text.lower())) for label, text in templates]
    if any(2 * len(ws) > WINDOWS[-1] for _, ws in parsed):
        raise ValueError(f"a template has more than {WINDOWS[-1] // 2} words")
    return [(label, sorted(set(ws)), next(x for x in WINDOWS if x >= 2 * len(ws))) for label, ws in parsed]


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _key(docs: DataFrame) -> DataFrame:
    """Rows with the same key have the same id and text, so the same result."""
    return docs.withColumns({"key_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "key_text": F.xxhash64("text")})


def _scanned(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Word counts, the places and labels of the phrases, and the places of the words of ``vocabulary``."""
    licensed = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()).contains("license")
    places = {}
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        fits = " AND ".join(f"get(w, i + {k}) = '{part}'" for k, part in enumerate(parts))
        starts = F.expr(f"filter(sequence(0, size(w) - 1), i -> {fits})")
        places[label] = F.when(licensed & (F.size("w") > 0), starts).otherwise(F.array().cast("array<int>"))
    told = F.transform("w", lambda word, at: F.struct(at.alias("at"), word.alias("word")))
    counted = docs.withColumn("w", words(F.col("text"))).withColumn("tokens", F.filter(told, lambda t: t["word"].isin(vocabulary))).withColumns({f"at_{k}": v for k, v in places.items()})
    everywhere = F.concat(*[F.col(f"at_{k}") for k in places])
    labels = F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(k)) for k in sorted(places)]))
    return counted.select(
        "doc_id", "key_id", "key_text",
        F.size("w").cast("long").alias("n_words"),
        F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"),
        F.array_max(everywhere).cast("long").alias("last_word"),
        labels.alias("base"), "tokens",
    )


def document_frequencies(scanned: DataFrame) -> dict[str, int]:
    """For each word of the templates, the number of documents that hold it; no more rows than such words."""
    held = scanned.select(F.explode(F.array_distinct("tokens.word")).alias("word"))
    return {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}


def containments(scanned: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(key_id, key_text, label, containment)`` of every block and template that meet the threshold."""
    parsed = _template_words(templates)
    seen = document_frequencies(scanned)
    order = sorted({w for _, ws, _ in parsed for w in ws}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, prefix = [], set()
    for label, ws, window in parsed:
        ranks = sorted(rank[w] for w in ws)
        least = math.ceil(threshold * len(ranks) - 1e-9)
        for i in range(len(ranks) - least + 1):
            prefix.add(order[ranks[i]])
            index.append((ranks[i], window, i, least, label, ranks))
    spark = scanned.sparkSession
    prefixes = spark.createDataFrame(index, "token int, window int, i int, least int, label string, ranks array<int>")
    ranked = spark.createDataFrame(list(rank.items()), "word string, token int")

    held = scanned.where(F.exists("tokens", lambda t: t["word"].isin(sorted(prefix))))
    # a word stands in the window that begins in its half window, and in the one before
    windows = F.array(*[F.lit(x) for x in sorted({window for _, _, window in parsed})])
    placed = held.select("key_id", "key_text", "n_words", F.explode("tokens").alias("t")).select("key_id", "key_text", "n_words", "t.at", "t.word", F.explode(windows).alias("window"))
    half = F.col("window") / 2
    blocks = placed.withColumn("block", F.explode(F.array(F.floor(F.col("at") / half), F.floor(F.col("at") / half) - 1))).where((F.col("block") >= 0) & (F.col("block") * half <= F.greatest(F.lit(0), F.col("n_words") - half - 1)))
    # the template words bound the ranks, and a window the block
    sets = blocks.join(F.broadcast(ranked), "word").groupBy("key_id", "key_text", "window", "block").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    matched = (
        sets.select("key_id", "key_text", "window", "tokens", F.posexplode("tokens").alias("j", "token"))
        .join(F.broadcast(prefixes), ["token", "window"])
        .where(F.size("tokens") >= F.col("least"))
        .where(F.least(F.size("ranks") - F.col("i"), F.size("tokens") - F.col("j")) >= F.col("least"))
    )
    overlap = F.size(F.array_intersect("tokens", "ranks"))
    return matched.where(overlap >= F.col("least")).select("key_id", "key_text", "label", (overlap / F.size("ranks")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: base places, base labels, all labels and the best containment."""
    vocabulary = sorted({w for _, ws, _ in _template_words(templates) for w in ws})
    scanned = stored(_scanned(_key(docs.select("doc_id", "text")), vocabulary), "license-words")
    found = (
        containments(scanned, templates, threshold)
        .groupBy("key_id", "key_text")
        .agg(F.collect_set("label").alias("met"), F.max("containment").alias("best"))
    )
    both = scanned.drop("tokens").join(found, ["key_id", "key_text"], "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("met", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9 over all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    parsed = _template_words(TEMPLATES)
    values = ", ".join(
        f"('{label}', [{', '.join(repr(w) for w in ws)}], {math.ceil(THRESHOLD * len(ws) - 1e-9)}, {window})" for label, ws, window in parsed
    )
    cut = "list_filter(string_split_regex(translate({}, '" + UPPER + "', '" + UPPER.lower() + "'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    places = {
        label: f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {part!r}' for k, part in enumerate(phrase.split()))})"
        for phrase, label in PHRASES.items()
    }
    return f"""
WITH templates(label, ws, least, width) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT r, doc_id, w, {', '.join(f'{v} AS at_{k}' for k, v in places.items())}
         FROM (SELECT r, doc_id, {cut.format('text')} AS w FROM d)),
widths AS (SELECT DISTINCT width FROM templates),
blocks AS (SELECT r, width, list_distinct(w[s : s + width - 1]) AS b
           FROM (SELECT r, w, width, unnest(range(1, greatest(1, len(w) - width // 2) + 1, width // 2)) AS s FROM base, widths)),
met AS (SELECT r, label, len(list_intersect(b, ws)) AS shared, len(ws) AS size, least FROM blocks JOIN templates USING (width)),
hits AS (SELECT r, list(DISTINCT label) AS labels, max(shared / size) AS best FROM met WHERE shared >= least GROUP BY r),
named AS (SELECT base.*, list_concat(at_mit, at_apache, at_gpl) AS places,
                 list_filter([CASE WHEN len(at_apache) > 0 THEN 'apache' END, CASE WHEN len(at_gpl) > 0 THEN 'gpl' END,
                              CASE WHEN len(at_mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS b
          FROM base)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word,
       list_max(places)::BIGINT AS last_word, array_to_string(b, ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(b, coalesce(labels, [])))), ',') AS labels,
       greatest(coalesce(best, 0.0), CASE WHEN len(b) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM named LEFT JOIN hits USING (r)
"""


ORACLE = _oracle()
