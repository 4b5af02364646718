"""License notices: phrase places, and an exact set-similarity join against notice templates.

A text block is a window of `BLOCK` words, begun every `STEP` words, so that every passage of up to
`BLOCK - STEP` words lies whole in one block. A block matches a template when it holds at least
`threshold` of the template's distinct words. The join is exact: words are put in one global order,
rarest first, by the number of documents that hold them (counted over all documents); a match must
share one of a template's first |T| - need + 1 words (prefix filter), hold `need` template words
(length filter), and have enough words left after the shared one (positional filter); what remains is
counted. Templates are a parameter, so their table is bounded by that list, not by the data.

Null and empty texts have no words and no labels. Repeated rows each get their own result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagekit.llm.common import let, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK, STEP = 128, 64

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices by label, in words of the grammar above.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are "
           "permitted provided that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or "
           "neighboring rights to this work",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the "
                  "terms of the gnu general public license as published by the free software "
                  "foundation",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this "
                 "software and associated documentation files the software to deal in the software "
                 "without restriction",
    "mit-release": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.85


def need(size: int, threshold: float) -> int:
    return math.ceil(round(size * threshold, 9))


def words(text: Column) -> Column:
    """Words of a lower-cased text as an array; blanks at the ends give no empty words."""
    return F.filter(F.split(text, BREAK), lambda w: w != "")


def document_frequency(df: DataFrame, tokens: list[str]) -> dict[str, int]:
    """Documents that hold each of the given words; all documents count, the answer has one row a word."""
    held = df.select(F.explode(F.array_intersect("_words", F.lit(tokens))).alias("t"))
    return {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}


def template_prefixes(ordered: dict[str, list[str]], threshold: float) -> list[tuple]:
    return [(t, name, i, len(ts), need(len(ts), threshold))
            for name, ts in ordered.items()
            for i, t in enumerate(ts[: len(ts) - need(len(ts), threshold) + 1])]


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, str] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, word and phrase counts, labels, score, and matching blocks.

    `matches` lists (label, first word of the block, containment) of every block that meets a template.
    """
    templates = TEMPLATES if templates is None else templates
    lowered = df.select(
        F.col(id_col), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    texts = lowered.select(F.col(id_col), "_text", words(F.col("_text")).alias("_words"))
    sets = {name: list(dict.fromkeys(t.split())) for name, t in templates.items()}
    tokens = sorted({t for ts in sets.values() for t in ts})
    seen = document_frequency(texts.select("_words"), tokens)
    vocabulary = sorted(tokens, key=lambda t: (seen.get(t, 0), t))
    rank = {t: i for i, t in enumerate(vocabulary)}
    ordered = {name: sorted(ts, key=rank.get) for name, ts in sets.items()}
    prefixes = template_prefixes(ordered, threshold)
    values = ", ".join(f"('{t}', '{name}', {i}, {size}, {least})" for t, name, i, size, least in prefixes)
    table = df.sparkSession.sql(
        f"SELECT * FROM VALUES {values} AS v(_token, _label, _i, _size, _need)")
    smallest = min(p[4] for p in prefixes)

    def blocks(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - 1, F.lit(STEP))
        held = F.transform(starts, lambda s: F.struct(
            s.alias("start"),
            F.array_intersect(F.lit(vocabulary), F.slice(ws, s + 1, BLOCK)).alias("tokens")))
        return F.filter(held, lambda b: F.size(b["tokens"]) >= smallest)

    candidate = F.arrays_overlap("_words", F.lit(sorted({p[0] for p in prefixes})))
    rows = texts.select(
        F.col(id_col), F.monotonically_increasing_id().alias("_row"),
        F.size("_words").cast("long").alias("n_words"),
        phrase_places(F.col("_text"), F.col("_words")).alias("_places"),
        F.when(candidate, let(F.col("_words"), blocks)).alias("_blocks"))
    parts = (
        rows.select("*", F.explode_outer("_blocks").alias("_block")).drop("_blocks")
        .select("*", F.posexplode_outer("_block.tokens").alias("_j", "_token"))
        .join(table, "_token", "left")
        .withColumn("_bound", F.least("_i", "_j") + F.least(
            F.col("_size") - F.col("_i"), F.size("_block.tokens") - F.col("_j")))
        .withColumn("_label", F.when(F.col("_bound") >= F.col("_need"), F.col("_label"))))
    shared = F.lit(None).cast("int")
    for name, ts in ordered.items():
        shared = F.when(F.col("_label") == name,
                        F.size(F.array_intersect("_block.tokens", F.lit(ts)))).otherwise(shared)
    found = parts.withColumn("_shared", shared).withColumn(
        "_match", F.when(F.col("_shared") >= F.col("_need"), F.struct(
            F.col("_label").alias("label"), F.col("_block.start").alias("first_word"),
            (F.col("_shared") / F.col("_size")).alias("containment"))))
    return (
        found.groupBy("_row").agg(
            F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"),
            F.first("_places").alias("_places"), F.collect_set("_match").alias("matches"))
        .select(
            id_col, "n_words",
            F.size("_places").cast("long").alias("n_base"),
            F.array_min(F.transform("_places", lambda p: p["at"])).cast("long").alias("first_word"),
            F.array_max(F.transform("_places", lambda p: p["at"])).cast("long").alias("last_word"),
            joined(F.transform("_places", lambda p: p["label"])).alias("base_labels"),
            joined(F.concat(F.transform("_places", lambda p: p["label"]),
                            F.transform("matches", lambda m: m["label"]))).alias("labels"),
            F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(F.coalesce(
                F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
            .alias("score"),
            "matches"))


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def phrase_places(text: Column, ws: Column) -> Column:
    """(label, first word's number) of every place where a phrase's words stand consecutively."""
    none = F.array().cast("array<struct<label:string,at:int>>")

    def of_phrase(phrase: list[str], label: str) -> Column:
        def at(i: Column) -> Column:
            same = reduce(Column.__and__, [F.get(ws, i + k) == w for k, w in enumerate(phrase)])
            return F.when(same, F.struct(F.lit(label).alias("label"), i.alias("at")))

        starts = F.sequence(F.lit(0), F.size(ws) - len(phrase))
        there = reduce(Column.__and__, [text.contains(w) for w in phrase])
        return F.when(there & (F.size(ws) >= len(phrase)), F.filter(
            F.transform(starts, at), lambda m: m.isNotNull())).otherwise(none)

    return F.concat(*[of_phrase(p.split(), label) for p, label in PHRASES.items()])


def license_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scan_licenses(df, id_col, text_col).drop("matches")


def _sql() -> str:
    phrases = ", ".join(
        f"({p.split()!r}, '{label}')".replace('"', "'") for p, label in PHRASES.items())
    sets = {n: list(dict.fromkeys(t.split())) for n, t in TEMPLATES.items()}
    templates = ", ".join(f"({ts!r}, '{n}', {need(len(ts), THRESHOLD)})" for n, ts in sets.items())
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
phrases(p, label) AS (VALUES {phrases}),
templates(t, label, least) AS (VALUES {templates}),
pos AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM d),
base AS (
  SELECT r, i, label FROM pos JOIN phrases ON w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p),
b AS (
  SELECT r, count(*) AS n, min(i) AS f, max(i) AS l,
    list(DISTINCT label) AS labels FROM base GROUP BY r),
block AS (
  SELECT r, list_distinct(w[s + 1:s + {BLOCK}]) AS ws
  FROM (SELECT r, w, unnest(range(0, len(w), {STEP})) AS s FROM d)),
hit AS (
  SELECT r, label, len(list_intersect(ws, t)) / len(t) AS c
  FROM block, templates WHERE len(list_intersect(ws, t)) >= least),
m AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS c FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word,
  l::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(
    list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.c, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""


SQL = _sql()
