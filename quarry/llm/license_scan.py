"""Licence scan: base phrases, and an exact set-similarity join of text blocks with notice templates.

A block is a paragraph, so a notice may be wrapped over any number of lines. Licenses whose notices differ in a word are told
apart by that word, which the block must have, or must not.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import stored

#: Phrases of the base scan and their labels.
PHRASES: dict[str, str] = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices to look for: label, text, words that a block must have, and words of other licenses that it must not have.
TEMPLATES: tuple[tuple[str, str, str, str], ...] = (
    ("gpl", "this work is licensed under the gnu general public license version", "gnu general", "lesser affero"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general", "lesser affero"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser", ""),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero", ""),
    ("apache", "licensed under the apache license version", "apache", ""),
    ("mit", "released under the mit license", "released mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted obtaining", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary", ""),
    ("bsd", "licensed under the bsd license", "bsd", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "granted fee", ""),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla", ""),
    ("cc-by", "licensed under a creative commons attribution international license", "creative commons attribution", "noncommercial sharealike noderivatives"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc", ""),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa", ""),
    ("cc0", "dedicated to the public domain under cc0", "cc0", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", ""),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without prior written permission", "reserved reproduced", ""),
)
THRESHOLD = 0.8
_NO_WORD = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z. ``lower`` turns two other letters into ASCII ones; texts with them take the slow way."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, upper, small)).otherwise(F.lower(text))


def _least(size: int, threshold: float) -> int:
    return max(1, ceil(threshold * size - 1e-9))


def _in(text: Column, vocabulary: Column) -> Column:
    return F.array_intersect(F.split(text, "[ \n]"), vocabulary)


def scanned(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per document: words, places of base phrases, and its blocks' template tokens; reads the text once."""
    vocab = F.array(*[F.lit(t) for t in vocabulary])
    rows = docs.select(
        "doc_id", F.regexp_replace(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), _NO_WORD, " ").alias("t")
    )
    rows = rows.select(
        "doc_id", "t", F.regexp_replace(F.concat(F.lit(" "), "t", F.lit(" ")), "[ \n]+", " ").alias("flat")
    )
    has = {p: F.col("flat").contains(f" {p} ") for p in PHRASES}
    some = [*has.values()][0]
    for x in [*has.values()][1:]:
        some = some | x
    rows = rows.withColumn("w", F.when(some, F.split(F.trim("flat"), " ")))

    def places(phrase: str) -> Column:
        parts = phrase.split(" ")

        def here(_: Column, i: Column) -> Column:
            met = F.get("w", i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                met = met & F.coalesce(F.get("w", i + k) == part, F.lit(False))
            return met

        starts = F.filter(F.transform("w", lambda w, i: i), lambda x: here(x, x))
        return F.when(has[phrase], starts).otherwise(F.array().cast("array<int>"))

    at = {p: places(p) for p in PHRASES}
    labels = F.array_compact(F.array(*[F.when(has[p], F.lit(label)) for p, label in PHRASES.items()]))
    # a block is a paragraph: a notice may be wrapped over any number of its lines, and what a line contains its paragraph does
    blocks = F.transform(F.split("t", r"\n[ \n]*\n"), lambda x: _in(x, vocab))
    found = F.array_sort(F.flatten(F.array(*at.values())))
    return rows.select(
        "doc_id",
        (F.length("flat") - F.length(F.replace("flat", F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"),
        found.alias("found"),
        F.array_sort(F.array_distinct(labels)).alias("base"),
        F.array_distinct(F.filter(blocks, lambda b: F.size(b) > 0)).alias("blocks"),
    )


def vocabulary_of(templates=TEMPLATES) -> list[str]:
    return sorted({t for _, *texts in templates for text in texts for t in text.split()})


def template_join(rows: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, label, containment`` for every block that meets a template; rows from ``scanned``."""
    spark = rows.sparkSession
    sets = [(i, label, sorted(set(text.split())), needs.split(), bars.split()) for i, (label, text, needs, bars) in enumerate(templates)]
    blocks = rows.select("doc_id", F.posexplode("blocks").alias("block", "all"))
    # the vocabulary's size is that of the templates in the code, whatever the corpus
    counts = dict(blocks.select(F.explode("all").alias("t")).groupBy("t").count().collect())
    order = sorted({t for _, _, s, _, _ in sets for t in s}, key=lambda t: (counts.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    index, least = [], min(_least(len(s), threshold) for _, _, s, _, _ in sets)
    for i, label, s, needs, bars in sets:
        need, ranked = _least(len(s), threshold), sorted(s, key=rank.get)
        for j, t in enumerate(ranked[: len(s) - need + 1]):
            index.append((t, i, label, j, len(s), need, ranked, needs, bars))
    schema = "tok string, template int, label string, j int, size int, need int, tokens array<string>, needs array<string>, bars array<string>"
    index_df = F.broadcast(spark.createDataFrame(index, schema))
    prefix_tokens = F.array(*[F.lit(t) for t in dict.fromkeys(x[0] for x in index)])
    by_rank = F.array_intersect(F.array(*[F.lit(t) for t in order]), F.col("all"))
    blocks = blocks.filter(F.size("all") >= least).select("doc_id", "block", "all", by_rank.alias("toks"))
    blocks = blocks.withColumn("prefix", F.slice("toks", 1, F.greatest(F.lit(0), F.size("toks") - least + 1)))
    blocks = blocks.filter(F.arrays_overlap("prefix", prefix_tokens))
    pairs = blocks.select("doc_id", "block", "all", "toks", F.posexplode("prefix").alias("i", "tok")).join(index_df, "tok")
    size = F.size("toks")
    pairs = pairs.filter(
        (size >= F.col("need"))
        & (F.col("i") <= size - F.col("need"))
        # as this is one of the common tokens, those before it are at most min(i, j) more
        & (
            F.least("i", "j") + 1 + F.least(size - F.col("i") - 1, F.col("size") - F.col("j") - 1) >= F.col("need")
        )
    )
    common = F.size(F.array_intersect("toks", "tokens"))
    apart = (F.size(F.array_except("needs", "all")) == 0) & (F.size(F.array_intersect("bars", "all")) == 0)
    met = pairs.filter((common >= F.col("need")) & apart)
    return met.select("doc_id", "label", (common / F.col("size")).alias("containment"))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: words, base phrases found, labels of both ways, and a score from 0 to 1.

    The score is 1 for a base phrase, else the largest containment of a met template, else 0.
    A block is a paragraph; a template is met by 0.8 of its words, if the block has those that tell the license from others, and
    none that tell others from it.
    Defined cases: a very long text without a blank line is one block; a null or empty text has no words, no labels and score 0; equal texts get equal rows; rows
    repeated with one id get the labels of all rows with that id; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = stored(scanned(docs, vocabulary_of(templates)), "license-blocks")
    met = template_join(rows, templates, threshold)
    met = met.groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = rows.drop("blocks").join(met, "doc_id", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("found").cast("long").alias("n_base"),
        F.get("found", F.lit(0)).cast("long").alias("first_word"),
        F.get("found", F.size("found") - 1).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size("found") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    def words(text: str) -> str:
        return f"list_filter(list_distinct(string_split('{text}', ' ')), lambda x: x <> '')"

    values = ", ".join(f"('{label}', {words(text)}, {words(needs)}, {words(bars)})" for label, text, needs, bars in TEMPLATES)
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM p WHERE "
        + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    return f"""
WITH d AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '[ \\n]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT doc_id, w, CAST(unnest(range(1, len(w) + 1)) AS BIGINT) AS i FROM w),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS base FROM places GROUP BY doc_id),
sets AS (SELECT doc_id, list_distinct(string_split_regex(unnest(string_split_regex(t, '\\n[ \\n]*\\n')), '[ \\n]')) AS s FROM d),
templates AS (SELECT * FROM (VALUES {values}) v(label, s, needs, bars)),
pairs AS (SELECT sets.doc_id, t.label, len(list_intersect(sets.s, t.s)) AS common, len(t.s) AS size FROM sets JOIN templates t ON list_has_all(sets.s, needs) AND NOT list_has_any(sets.s, bars)),
met AS (SELECT doc_id, list(DISTINCT label) AS more, max(common / size) AS best FROM pairs WHERE common >= ceil({THRESHOLD} * size - 1e-9) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN met USING (doc_id)
"""


SQL = _sql()
