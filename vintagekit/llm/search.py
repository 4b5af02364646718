"""Ranked lexical search by Block-Max MaxScore over an index of shards.

Index: each task cuts its rows into shards of bounded bytes and rows, and writes one row per (shard,
term): postings in blocks of `BLOCK`, compressed, with each block's last document and highest impact.
An impact is a posting's score without the term's weight; it needs only the corpus totals, which are
counted first. Nothing is shuffled, and every row of the input is in one shard.

Search: queries come in blocks of about `QUERIES` items. Postings of a block's terms meet in one group
a shard. There each item's lists are ordered by their bound (weight times highest impact). Lists whose
bounds together cannot beat the item's k-th score are not essential: documents are taken from the
essential lists only, and a document is looked up in another list only while its score, that list's
block maximum and the bounds of the lists left can beat the k-th score, so other blocks stay
compressed. The shards' k best are merged by a ranked window, which Spark limits before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.session import materialize

# Letters, digits and all beyond ASCII make terms; A-Z is lowered, all else parts them.
LETTERS = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
SHARD_BYTES = 12 << 20
SHARD_ROWS = 1 << 15
BLOCK = 128
RANGE = 2048
QUERIES = 512
TOP = 50


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as seven bits a byte, the last byte of each below 128; and each number's bytes."""
    size = np.ones(len(values), np.uint8)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    first = np.cumsum(size, dtype=np.int64) - size
    out = np.empty(int(size.sum(dtype=np.int64)), np.uint8)
    for k in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > k)
        out[first[here] + k] = (values[here] >> 7 * k & 127) | ((size[here] > k + 1) * np.uint8(128))
    return out, size


def numbers(raw: np.ndarray) -> np.ndarray:
    """The numbers of `varints`."""
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def spread(n_terms: int, docs: int, terms: int) -> int:
    """A document's length against the mean, in fiftieths above 50."""
    return 50 + (50 * n_terms * docs) // terms


class Shard:
    """Rows gathered into one shard: term numbers of every row, until it is written."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.rows: list[np.ndarray] = []
        self.number: dict[bytes, int] = {}
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        number = self.number
        words = terms_of(text)
        self.ids.append(doc_id)
        self.rows.append(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
        self.bytes += len(text or "")

    @property
    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.ids) >= SHARD_ROWS

    def records(self, name: int, docs: int, terms: int) -> Iterator[pa.RecordBatch]:
        """The shard's rows: one of documents (no term), then one a term, of at most 64 Ki a batch."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        rows = [self.rows[i] for i in order]
        m = np.array([spread(len(r), docs, terms) if len(r) else 0 for r in rows], np.int64)
        ids = [self.ids[i] for i in order]
        known = np.array([i is not None for i in ids], np.uint8).tobytes()
        yield record([name], [None], [0], [np.array([i or 0 for i in ids], np.int64).tobytes()],
                     [m.tobytes()], [b""], [known])
        if not self.number:
            return
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        keys, tf = np.unique(np.concatenate(rows).astype(np.int64) << 16 | doc, return_counts=True)
        term, doc = keys >> 16, keys & 0xFFFF
        firsts = np.flatnonzero(np.diff(term, prepend=-1))
        within = np.arange(len(term)) - np.repeat(firsts, np.diff(np.append(firsts, len(term))))
        starts = np.flatnonzero(within % BLOCK == 0)
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = doc[starts]
        payload, size = varints(np.stack([gaps, tf], axis=1).ravel())
        at = np.concatenate(([0], np.cumsum(size.reshape(-1, 2).sum(axis=1, dtype=np.int64))))
        best = np.maximum.reduceat(impacts(tf, m[doc]), starts)
        last = doc[np.append(starts[1:], len(doc)) - 1]
        block_of = np.searchsorted(starts, np.append(firsts, len(doc)))  # blocks before each term
        name_of, df = list(self.number), np.diff(np.append(firsts, len(term)))
        begins = at[starts]
        for a in range(0, len(name_of), 1 << 16):
            z = min(a + (1 << 16), len(name_of))
            cuts = block_of[a:z + 1]
            bytes_of = at[np.append(firsts, len(doc))[a:z + 1]]
            yield record(
                [name] * (z - a), name_of[a:z], df[a:z].tolist(),
                pieces(last, cuts, np.uint16), pieces(best, cuts, np.uint32),
                pieces(begins - np.repeat(at[firsts], np.diff(block_of)), cuts, np.uint32),
                pieces(payload, bytes_of, np.uint8))


def pieces(values: np.ndarray, cuts: np.ndarray, dtype: type) -> list[bytes]:
    raw, wide = values.astype(dtype).tobytes(), np.dtype(dtype).itemsize
    ends = (cuts * wide).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


FIELDS = "shard long, term binary, df long, last binary, best binary, begins binary, payload binary"


def record(shard: list, term: list, df: list, *blobs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int64()), pa.array(term, pa.binary()), pa.array(df, pa.int64()),
         *[pa.array(b, pa.binary()) for b in blobs]],
        names=["shard", "term", "df", "last", "best", "begins", "payload"])


@dataclass
class Index:
    """The index table, and the totals: documents with a term, and all terms with repeats."""

    table: DataFrame
    docs: int
    terms: int


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of every row, written to the shared folder.

    Null and empty texts have no terms and are never found. Rows of one id are documents of their own;
    a null id is kept and ranks behind equal scores. Other columns are not read.
    """
    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(terms_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"docs": [sum(map(bool, n))], "terms": [sum(n)]})

    total = texts.select("_text").mapInArrow(count, "docs long, terms long").agg(
        F.sum("docs"), F.sum("terms")).first()
    docs, terms = total[0] or 0, total[1] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, shard = TaskContext.get().partitionId(), 0, Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard.add(doc_id, text)
                if shard.full:
                    yield from shard.records(task << 32 | made, docs, terms)
                    shard, made = Shard(), made + 1
        if shard.ids:
            yield from shard.records(task << 32 | made, docs, terms)

    return Index(materialize(texts.mapInArrow(run, FIELDS), "index"), docs, terms)


class Postings:
    """One term's list in one shard; decoded by blocks on demand."""

    def __init__(self, row: dict, m: np.ndarray) -> None:
        self.last = np.frombuffer(row["last"], np.uint16).astype(np.int64)
        self.best = np.frombuffer(row["best"], np.uint32).astype(np.int64)
        self.payload = np.frombuffer(row["payload"], np.uint8)
        self.begins = np.append(np.frombuffer(row["begins"], np.uint32).astype(np.int64), len(self.payload))
        self.df, self.m = row["df"], m
        self.top = int(self.best.max())
        self.ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def decoded(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks, in order."""
        if not len(blocks):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(blocks) == blocks[-1] - blocks[0] + 1:
            raw = self.payload[self.begins[blocks[0]]:self.begins[blocks[-1] + 1]]
        else:
            raw = np.concatenate([self.payload[a:b] for a, b in zip(
                self.begins[blocks].tolist(), self.begins[blocks + 1].tolist(), strict=True)])
        pairs = numbers(raw).reshape(-1, 2)
        run = np.cumsum(pairs[:, 0])
        first = np.arange(len(blocks)) * BLOCK
        sizes = np.minimum(BLOCK, len(pairs) - first)
        doc = run - np.repeat(run[first] - pairs[first, 0], sizes)
        return doc, impacts(pairs[:, 1], self.m[doc])

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the documents low to high - 1; kept, as other items of the block ask again."""
        if low not in self.ranges:
            a, b = np.searchsorted(self.last, [low, high - 1])
            doc, impact = self.decoded(np.arange(a, min(b + 1, len(self.last))))
            inside = (doc >= low) & (doc < high)
            self.ranges[low] = doc[inside], impact[inside]
        return self.ranges[low]


def best_of(lists: list[tuple[int, Postings]], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (document, score) of one item; equal scores by document."""
    lists = sorted((p for p in lists if p[0] > 0), key=lambda p: p[0] * p[1].top)
    bounds = np.concatenate(([0], np.cumsum([w * p.top for w, p in lists], dtype=np.int64)))
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for low in range(0, n, RANGE):
        high = min(low + RANGE, n)
        essential = int(np.searchsorted(bounds, least, side="right")) - 1  # the first essential list
        if essential >= len(lists):
            break
        sums = np.zeros(high - low, np.int64)
        for w, p in lists[essential:]:
            doc, impact = p.between(low, high)
            sums[doc - low] += w * impact
        at = np.flatnonzero(sums)
        for i in range(essential - 1, -1, -1):
            at = at[sums[at] + bounds[i + 1] > least]
            if not len(at):
                break
            w, p = lists[i]
            block = np.searchsorted(p.last, at + low)
            there = block < len(p.last)
            bound = np.where(there, p.best[np.minimum(block, len(p.last) - 1)], 0)
            alive = sums[at] + w * bound + bounds[i] > least
            at, block = at[alive], block[alive & there]
            if len(block):
                doc, impact = p.decoded(np.unique(block))
                place = np.minimum(np.searchsorted(doc, at + low), len(doc) - 1)
                sums[at] += np.where(doc[place] == at + low, w * impact[place], 0)
        at = at[sums[at] > least]
        if len(at):
            docs, scores = np.concatenate((docs, at + low)), np.concatenate((scores, sums[at]))
            keep = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[keep], scores[keep]
            least = int(scores[-1]) if len(scores) == k else 0
    return docs, scores


def search(index: Index, queries: DataFrame, id_col: str = "item_id", text_col: str = "text",
           k: int = TOP, found_col: str = "doc_id") -> DataFrame:
    """(id, rank, doc_id, score): the k best documents of each row of `queries`, scores above 0 only.

    Rows with null or empty texts find nothing; repeated rows are answered each. Equal scores rank by
    document id, null ids last. An empty index or no queries give no rows.
    """
    asked = materialize(queries.select(
        F.monotonically_increasing_id().alias("_q"), F.col(id_col).alias("_item"),
        F.col(text_col).alias("_text")), "queries")
    blocks = asked.count() // QUERIES + 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), pa.array([w for f in found for w in f], pa.binary())],
                names=["_q", "term"])

    pairs = asked.select("_q", "_text").mapInArrow(split, "_q long, term binary").withColumn(
        "_block", F.pmod(F.xxhash64("_q"), F.lit(blocks).cast("long")))
    wanted = materialize(pairs.groupBy("_block", "term").agg(F.collect_list("_q").alias("_qs")), "terms")
    lists = index.table.where("term is not null")
    found = lists.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("_df"))
    weight = F.floor(1000 * F.log(
        F.lit(2.0 * index.docs + 2) / (2 * F.col("_df") + 1).cast("double"))).cast("long")
    weighed = wanted.join(found.select("term", weight.alias("_w")), "term").where("_w > 0")
    rows = lists.join(weighed, "term")
    shards = index.table.where("term is null").select(
        F.col("shard").alias("_shard"), F.col("last").alias("_ids"), F.col("best").alias("_m"),
        F.col("payload").alias("_known"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        head = right.to_pylist()[0]
        ids, m = np.frombuffer(head["_ids"], np.int64), np.frombuffer(head["_m"], np.int64)
        known = np.frombuffer(head["_known"], np.uint8).view(bool)
        items: dict[int, list] = {}
        for row in left.to_pylist():
            postings = Postings(row, m)
            for q in row["_qs"]:
                items.setdefault(q, []).append((row["_w"], postings))
        for q, chosen in items.items():
            docs, scores = best_of(chosen, len(ids), k)
            out.append((q, docs, scores))
        docs = np.concatenate([np.zeros(0, np.int64), *[d for _, d, _ in out]])
        return pa.table({
            "_q": pa.array(np.repeat(np.array([q for q, _, _ in out], np.int64),
                                     np.array([len(d) for _, d, _ in out], np.int64))),
            "_doc": pa.array(ids[docs], pa.int64(), mask=~known[docs]),
            "_score": pa.array(np.concatenate([np.zeros(0, np.int64), *[s for _, _, s in out]]))})

    best = rows.groupBy("shard", "_block").cogroup(shards.groupBy("_shard", "_block")).applyInArrow(
        rank, T.StructType().add("_q", "long").add("_doc", "long").add("_score", "long"))
    order = Window.partitionBy("_q").orderBy(F.desc("_score"), F.col("_doc").asc_nulls_last())
    ranked = best.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    return ranked.join(asked.select("_q", "_item"), "_q").select(
        F.col("_item").alias(id_col), F.col("_rank").alias("rank"), F.col("_doc").alias(found_col),
        F.col("_score").alias("score"))


SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents
), total AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM doc WHERE len(w) > 0
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM doc) GROUP BY r, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE)
    / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term
), item AS (
  SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []))) AS term FROM benchmark
), scored AS (
  SELECT q, item_id, doc.r, doc_id, CAST(sum(weight.w * ((1000000000 * tf)
    // (1000 * tf + 20 * (50 + (50 * len(doc.w) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN doc ON doc.r = tf.r, total
  GROUP BY q, item_id, doc.r, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
