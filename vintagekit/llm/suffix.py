"""Repeated passages by sparse suffix arrays.

A passage is a run of at least `least` words (50) that stands twice or more in the corpus, in one
document or several. Suffixes are kept only at minimisers: of every `least - anchor + 1` neighbouring
runs of `anchor` words, the one that hashes lowest, so every passage holds one, whatever surrounds it.

1. The kept suffixes are sorted by their anchor over the whole cluster and neighbours are compared.
   Anchors without an equal neighbour are done with.
2. Around each repeated anchor the match is extended left and right: the suffixes that begin up to
   `least - anchor` words before it are sorted by their first `least` words and neighbours compared.
   Every `least`-word window of a repeated passage holds a repeated anchor, so this finds exactly the
   windows that stand twice, and their union is the passages at full length.

Both sorts deal rows out by ranges of (words, document, position), so that a passage shared by a third
of all documents is spread over many tasks; runs that cross two tasks are joined by a table of two
border rows a task. The first occurrence, by document id, text hash and position, is kept; later ones
are cut. Runs of words are compared by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.llm.common import let, words_of
from vintagekit.session import materialize

LEAST = 50
ANCHOR = 30
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` words, from one running sum."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    ones = np.ones(len(hashes), np.uint64)
    ones[1:] = BASE
    powers = np.multiply.accumulate(ones)
    ones[1:] = BASE_INVERSE
    inverse = np.multiply.accumulate(ones)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers)))
    x = (total[width:] - total[:-width]) * inverse[:n]
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def minimisers(runs: np.ndarray, window: int) -> np.ndarray:
    """Positions of the lowest of every `window` neighbouring runs."""
    if len(runs) < window:
        return np.zeros(0, np.int64)
    lowest = np.lib.stride_tricks.sliding_window_view(runs, window).argmin(axis=1)
    return np.unique(lowest + np.arange(len(lowest)))


def neighbours(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose key stands twice or more, with `later` false for the first of each key only.

    Rows are range-partitioned and sorted by (key, order), so equal keys are neighbours.
    """
    columns = [key, *order]
    dealt = rows.select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns)
    schema = T.StructType([*dealt.schema.fields, T.StructField("later", T.BooleanType()),
                           T.StructField("repeated", T.BooleanType()),
                           T.StructField("border", T.BooleanType()),
                           T.StructField("part", T.IntegerType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None  # the last row is judged with the next batch
        before: int | None = None  # the key before the held row

        def judged(batch: pa.RecordBatch, after: int | None, first: bool) -> pa.RecordBatch:
            keys = batch.column(0).to_numpy()
            same = np.zeros(len(keys) + 1, bool)
            same[1:-1] = keys[1:] == keys[:-1]
            same[0] = before is not None and before == keys[0]
            same[-1] = after is not None and after == keys[-1]
            border = np.zeros(len(keys), bool)
            border[0] |= first
            border[-1] |= after is None
            repeated = same[1:] | same[:-1]
            wanted = np.flatnonzero(repeated | border)
            flags = [same[:-1], repeated, border]
            picked = batch.take(pa.array(wanted))
            return pa.RecordBatch.from_arrays(
                [*picked.columns, *[pa.array(f[wanted]) for f in flags],
                 pa.array(np.full(len(wanted), part, np.int32))], names=schema.names)

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            body, held = batch.slice(0, batch.num_rows - 1), batch.slice(batch.num_rows - 1)
            if body.num_rows:
                yield judged(body, held.column(0)[0].as_py(), first)
                before, first = body.column(0)[-1].as_py(), False
        if held is not None:
            yield judged(held, None, first)

    found = materialize(dealt.mapInArrow(compare, schema), "neighbours")
    # Two border rows a task: a key at the borders of several tasks is one run.
    crossing = found.where("border").groupBy(key).agg(
        F.min("part").alias("_first"), F.max("part").alias("_last")).where("_first < _last")
    border = found.where("border").join(crossing, key, "left").withColumn(
        "later", F.col("later") | F.coalesce(F.col("part") > F.col("_first"), F.lit(False))) \
        .withColumn("repeated", F.col("repeated") | F.col("_first").isNotNull())
    return found.where("not border").select(*columns, "later").union(
        border.where("repeated").select(*columns, "later"))


def anchors(docs: DataFrame, least: int, anchor: int) -> DataFrame:
    schema = T.StructType([T.StructField("key", T.LongType()), docs.schema["_id"],
                           T.StructField("at", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, places = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                runs = run_hashes(word_hashes(words_of(text)), anchor)
                at = minimisers(runs, least - anchor + 1)
                keys.append(runs[at])
                places.append(at)
                rows.append(np.full(len(at), i))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)),
                 batch.column(0).take(pa.array(np.concatenate(rows).astype(np.int64))),
                 pa.array(np.concatenate(places).astype(np.int32))], names=schema.names)

    return docs.select("_id", "_text").mapInArrow(run, schema)


def extended(docs: DataFrame, least: int, anchor: int) -> DataFrame:
    """Hashes of the `least`-word windows that hold a repeated anchor of `_at`."""
    schema = T.StructType([T.StructField("key", T.LongType()), docs.schema["_id"],
                           T.StructField("hash", T.LongType()), T.StructField("at", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, places = [], [], []
            for i, (text, at) in enumerate(
                    zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                runs = run_hashes(word_hashes(words_of(text)), least)
                starts = np.unique(np.array(at)[:, None] - np.arange(least - anchor + 1))
                starts = starts[(starts >= 0) & (starts < len(runs))]
                keys.append(runs[starts])
                places.append(starts)
                rows.append(np.full(len(starts), i))
            take = pa.array(np.concatenate(rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(take),
                 batch.column(1).take(take), pa.array(np.concatenate(places).astype(np.int32))],
                names=schema.names)

    return docs.select("_id", "_hash", "_text", "_at").mapInArrow(run, schema)


def merged(starts: Column, least: int) -> Column:
    """Spans (first word, word after the last) of the union of windows at sorted starts."""
    firsts = F.filter(starts, lambda x, i: F.coalesce(x > F.get(starts, i - 1) + least, F.lit(True)))
    ends = F.filter(starts, lambda x, i: F.coalesce(F.get(starts, i + 1) > x + least, F.lit(True)))
    return F.zip_with(firsts, ends, lambda a, b: F.struct(
        a.cast("long").alias("start"), (b + least).cast("long").alias("end")))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """(id, hash, spans, later): passages of every document that has any, and those to be cut.

    `hash` is the text's xxhash64; rows with the same id and text are one document. Null and short
    texts have no passages. Words are compared with A-Z lower-cased.
    """
    docs = df.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
        F.xxhash64(text_col).alias("_hash"))
    # Anchors as their own file: the range sort reads it twice, to sample and to deal.
    kept = materialize(anchors(docs, least, anchor), "anchors")
    places = neighbours(kept, "key", ["_id", "at"]).groupBy("_id").agg(
        F.collect_set("at").alias("_at"))
    near = docs.alias("d").join(places.alias("p"), F.expr("d._id <=> p._id")).select(
        "d._id", "_hash", "_text", "_at").distinct()
    windows = neighbours(extended(near, least, anchor), "key", ["_id", "hash", "at"])
    by_doc = windows.groupBy("_id", "hash").agg(
        F.array_sort(F.collect_set("at")).alias("all"),
        F.array_sort(F.collect_set(F.when(F.col("later"), F.col("at")))).alias("later"))
    return by_doc.select(
        F.col("_id").alias(id_col), "hash", let(F.col("all"), lambda s: merged(s, least)).alias("spans"),
        let(F.col("later"), lambda s: merged(s, least)).alias("later"))


def passage_rows(passages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per passage of a document: id, first word, word after the last, words, words to cut."""
    one = passages.select(id_col, "later", F.explode("spans").alias("s"))
    cut = F.aggregate(
        F.filter("later", lambda x: (x["start"] >= F.col("s.start")) & (x["end"] <= F.col("s.end"))),
        F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return one.select(
        id_col, F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"),
        (F.col("s.end") - F.col("s.start")).alias("n_words"), cut.alias("cut_words"))


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_text(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans, and without the blanks after them."""
    raw = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at:starts[s["start"]]])
        at = starts[s["end"]]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass").rstrip(" \t\n\x0b\x0c\r") \
        if spans else text


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """The input with later occurrences of passages cut from its texts, all columns and rows kept.

    The added column `_cut` tells whether a text was changed.
    """
    passages = repeated_passages(df, id_col, text_col, least, anchor).select(
        F.col(id_col).alias("_pid"), F.col("hash").alias("_phash"), F.col("later").alias("_later")) \
        .where(F.size("_later") > 0)
    joined = df.withColumn("_thash", F.xxhash64(text_col)).join(
        passages, F.col(id_col).eqNullSafe(F.col("_pid")) & (F.col("_thash") == F.col("_phash")), "left")
    schema = T.StructType([*df.schema.fields, T.StructField("_cut", T.BooleanType())])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(batch.num_columns - 1).to_pylist()
            texts = [t if not c else cut_text(t, c)
                     for t, c in zip(batch.column(at).to_pylist(), cuts, strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([bool(c) for c in cuts])], names=schema.names)

    return joined.select(*df.columns, "_later").mapInArrow(run, schema)
