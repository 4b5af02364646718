"""Removal of repeated word windows, found by Rabin-Karp hashes of every window.

A window is a run of `WIDTH` words of one document. A word goes if a window over it also starts in a
document with a smaller id. Words count as they are written.

1. Rows are dealt at random into chunks of about `CHUNK_BYTES` of text. A chunk hashes every window
   (two polynomials over word hashes, 88 bits of which are compared), keeps each distinct hash once
   with the smallest id that has it, and sends sorted slices of them to the buckets of the hash space.
   So a passage in a third of all documents reaches its bucket once a chunk, not once a document.
2. A bucket counts each hash over all chunks, takes the smallest id, and answers every slice with one
   bit a hash: does a document of another chunk with a smaller id have it?
3. A chunk makes its windows again, reads its bits, merges the removed windows into maximal intervals
   of words and cuts them. Spark reuses the exchange that dealt the texts out, so they move once.

Chunks and buckets grow in number with the corpus, never in size, except by one single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 13
CHUNK_BYTES = 12 << 20
BUCKET_WINDOWS = 1 << 21
WORD_BYTES = 6.5
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
CACHE = 1 << 19


class WordHashes(dict):
    """128 bits a word, computed once for words met before; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_128_digest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        """Two 64-bit lanes a word."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64).reshape(-1, 2)


def polynomial(x: np.ndarray, base: np.uint64, width: int) -> np.ndarray:
    """The rolling hash of every run of `width` words, from runs of half the width."""
    if width == 1:
        return x
    half = width // 2
    part = polynomial(x, base, half)
    n = len(x) - 2 * half + 1
    run = part[:n] * base ** np.uint64(half) + part[half:half + n]
    return run if width % 2 == 0 else run[:-1] * base + x[width - 1:]


def window_keys(lanes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 24-bit key of every window; none where there are fewer words."""
    if len(lanes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    high = polynomial(lanes[:, 0], BASES[0], width)
    high = (high ^ (high >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    low = polynomial(lanes[:, 1], BASES[1], width)
    return high ^ (high >> np.uint64(32)), (low >> np.uint64(40)).astype(np.uint32)


class Chunk:
    """The windows of some rows: their keys, and the distinct keys in order with their smallest id.

    Windows of null ids take no part.
    """

    def __init__(self, ids: list[int | None], texts: list[str | None], width: int) -> None:
        cache = WordHashes()
        self.ids, self.width = ids, width
        self.words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        keys = [window_keys(cache.of(w), width) if i is not None and len(w) >= width
                else window_keys(np.zeros((0, 2), np.uint64), width)
                for i, w in zip(ids, self.words, strict=True)]
        self.counts = np.array([len(k[0]) for k in keys], np.int64)
        high = np.concatenate([np.zeros(0, np.uint64), *[k[0] for k in keys]])
        low = np.concatenate([np.zeros(0, np.uint32), *[k[1] for k in keys]])
        owner = np.repeat(np.array([0 if i is None else i for i in ids], np.int64), self.counts)
        order = np.lexsort((owner, low, high))
        high, low, sorted_owner = high[order], low[order], owner[order]
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        self.high, self.low, self.least = high[new], low[new], sorted_owner[new]
        self.owner = owner
        self.entry = np.empty(len(high), np.int64)  # which distinct key each window has
        self.entry[order] = np.cumsum(new) - 1

    def slices(self, bits: int) -> Iterator[tuple[int, slice]]:
        """The buckets (leading bits of the key) that the chunk has keys of."""
        if not len(self.high):
            return
        of = self.high >> np.uint64(64 - bits) if bits else np.zeros(len(self.high), np.uint64)
        at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(of)], strict=True):
            yield int(of[a]), slice(a, b)

    def removed(self, smaller: np.ndarray) -> np.ndarray:
        """Which windows go: the smallest id is not the window's own, here or by the bits."""
        return (self.owner > self.least[self.entry]) | smaller[self.entry]


def planes(values: np.ndarray, wide: int) -> bytes:
    """The low `wide` bytes of numbers, equal weights side by side, which compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T[:wide].tobytes()


def unplaned(raw: bytes, dtype: type, n: int) -> np.ndarray:
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    out[:, :len(raw) // max(n, 1)] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return out.view(dtype).ravel()


def pack(high: np.ndarray, low: np.ndarray, least: np.ndarray) -> bytes:
    """Sorted keys as differences; ids as numbers in their own short list."""
    known, number = np.unique(least, return_inverse=True)
    wide = 2 if len(known) <= 1 << 16 else 4
    head = np.array([len(high), len(known), wide], np.int64).tobytes()
    return zstandard.compress(head + planes(np.diff(high, prepend=np.uint64(0)), 8) + planes(low, 3)
                              + planes(known, 8) + planes(number.astype(np.uint32), wide), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n, known, wide = np.frombuffer(raw, np.int64, 3).tolist()
    cuts = np.cumsum([24, 8 * n, 3 * n, 8 * known, wide * n]).tolist()
    steps, low, ids, number = (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
    return (np.cumsum(unplaned(steps, np.uint64, n)), unplaned(low, np.uint32, n),
            unplaned(ids, np.int64, known)[unplaned(number, np.uint32, n)])


def answers(blobs: list[bytes]) -> list[bytes]:
    """For each slice one bit a key: another slice has it with a smaller id."""
    found = [unpack(b) for b in blobs]
    sizes = [len(f[0]) for f in found]
    high, low, least = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))
    smaller = np.empty(len(high), bool)
    smaller[order] = smallest[np.cumsum(new) - 1] < least[order]
    ends = np.cumsum(sizes).tolist()
    return [np.packbits(smaller[e - n:e]).tobytes() for e, n in zip(ends, sizes, strict=True)]


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals (first word, word after the last) of windows at sorted starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > width)
    firsts = starts[np.concatenate(([0], gap + 1))]
    lasts = starts[np.concatenate((gap, [len(starts) - 1]))] + width
    return list(zip(firsts.tolist(), lasts.tolist(), strict=True))


def dealt(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(_id, _text, _chunk) of all rows, and the bits of a bucket's number.

    Both numbers follow from the bytes of all texts. Rows are dealt by their place in the input, so
    that equal ids and equal texts spread.
    """
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = int(total // CHUNK_BYTES) + 1
    bits = max(0, int(total / WORD_BYTES / BUCKET_WINDOWS)).bit_length()
    place = F.xxhash64(F.monotonically_increasing_id())
    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"),
                     F.pmod(place, F.lit(chunks)).alias("_chunk")), bits


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     width: int = WIDTH) -> DataFrame:
    """(id, n_words, spans, kept): each row's removed intervals and the words left, joined by a space.

    Every input row gives one row. Null and empty texts have no words. Rows of one id are one
    document: they take no words from each other. A null id neither takes words nor loses any. Ties
    (equal windows) go by id alone. An empty table gives no rows; other columns are not looked at.
    """
    return _cut(df, id_col, text_col, width, False)


def window_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  width: int = WIDTH) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256): `repeated_windows` as counts and a digest of what is left."""
    return _cut(df, id_col, text_col, width, True)


def _cut(df: DataFrame, id_col: str, text_col: str, width: int, digest: bool) -> DataFrame:
    rows, bits = dealt(df, id_col, text_col)

    def chunk_of(table: pa.Table) -> Chunk:
        return Chunk(table.column("_id").to_pylist(), table.column("_text").to_pylist(), width)

    def ask(table: pa.Table) -> pa.Table:
        chunk, number = chunk_of(table), table.column("_chunk")[0].as_py()
        found = [(b, pack(chunk.high[s], chunk.low[s], chunk.least[s])) for b, s in chunk.slices(bits)]
        return pa.table({"_bucket": pa.array([b for b, _ in found], pa.int64()),
                         "_chunk": pa.array([number] * len(found), pa.int64()),
                         "_keys": pa.array([k for _, k in found], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        bits_of = answers(table.column("_keys").to_pylist())
        return pa.table({"_chunk": table.column("_chunk"), "_bucket": table.column("_bucket"),
                         "_bits": pa.array(bits_of, pa.binary())})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = chunk_of(left)
        reply = dict(zip(right.column("_bucket").to_pylist(), right.column("_bits").to_pylist(), strict=True))
        smaller = np.zeros(len(chunk.high), bool)
        for b, s in chunk.slices(bits):
            smaller[s] = np.unpackbits(np.frombuffer(reply[b], np.uint8), count=s.stop - s.start) \
                .view(bool)
        gone, at = chunk.removed(smaller), 0
        n_words, spans, kept = [], [], []
        for words, n in zip(chunk.words, chunk.counts.tolist(), strict=True):
            cuts = intervals(np.flatnonzero(gone[at:at + n]), width)
            at += n
            left_over, start = [], 0
            for a, b in cuts:
                left_over += words[start:a]
                start = b
            n_words.append(len(words))
            spans.append(cuts)
            kept.append(b" ".join(left_over + words[start:] if cuts else words))
        out = {id_col: pa.array(chunk.ids, pa.int64()), "n_words": pa.array(n_words, pa.int64())}
        if digest:
            out["n_removed"] = pa.array([sum(b - a for a, b in s) for s in spans], pa.int64())
            out["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
        else:
            out["spans"] = pa.array(
                [[{"start": a, "end": b} for a, b in s] for s in spans],
                pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            out["kept"] = pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())
        return pa.table(out)

    asked = rows.groupBy("_chunk").applyInArrow(ask, "_bucket long, _chunk long, _keys binary")
    replies = asked.groupBy("_bucket").applyInArrow(answer, "_chunk long, _bucket long, _bits binary")
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType())])
    schema = schema.add("n_removed", "long").add("kept_sha256", "string") if digest else \
        schema.add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))) \
        .add("kept", "string")
    return rows.groupBy("_chunk").cogroup(replies.groupBy("_chunk")).applyInArrow(cut, schema)


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words WHERE doc_id IS NOT NULL AND len(w) >= 13
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM starts
), least AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k
), gone AS (
  SELECT doc_id, list(s) AS found FROM windows JOIN least USING (k) WHERE m < doc_id GROUP BY doc_id
), covered AS (
  SELECT doc_id, list_distinct(flatten(list_transform(found, lambda x: range(x, x + 13)))) AS c FROM gone
), kept AS (
  SELECT words.doc_id, w, coalesce(c, []) AS c,
    CASE WHEN c IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(c, i)) END AS k
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed,
  sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""
