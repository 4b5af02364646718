"""Packing documents into sequences of a fixed length, in their order, by dynamic programming.

A partition's documents, each ended by an end token, are one stream of ids. Sequences are windows of
the stream; a window may end at a document's end, or at a sentence's end for a penalty, or, where
neither is near, at a plain token for a larger one. The cost of a window is its padding plus its end's
penalty, so best[j] = penalty[j] + length - pos[j] + min(best[i] + pos[i]) over the window's reach,
which a monotone queue answers in constant time; windows of a power of two carry no padding, only a
small charge for one more sequence, and are tried by their exact lengths. The stream is settled in stretches of `STRETCH` ids, whose last windows
are held back for the next stretch, so memory is bounded whatever a document's length. No rows are
shuffled and no partition waits for another.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

LENGTH = 1024
END_ID = 0
STRETCH = 1 << 18
SENTENCE, PLAIN, SHORT = 8, 48, 16
GAP = 192
# Fixed value: how byte-level encodings cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a text by the byte-level vocabulary of a tokenizer file.

    The file's tokens are ranks of a byte-pair encoding, which tiktoken runs over whole texts several
    times faster than the file's own library; special tokens in a text are recognised by either.
    """

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        byte_of = {c: b for b, c in byte_characters().items()}
        self.encoding = tiktoken.Encoding(
            path, pat_str=PATTERN,
            mergeable_ranks={bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()
                             if t not in special},
            special_tokens=special)
        pieces = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        self.ends = np.array([p.rstrip("Ċ\"')")[-1:] in (".", "!", "?") or p.endswith("Ċ")
                              for p in pieces])

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def candidates(ends: np.ndarray, is_end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, with penalties; no gap between them is above GAP ids."""
    penalty = np.full(len(is_end) + 1, -1, np.int64)
    penalty[1:][is_end] = SENTENCE
    penalty[ends] = 0
    penalty[0] = penalty[-1] = 0
    gap = min(GAP, length)
    pos = np.flatnonzero(penalty >= 0)
    wide = np.flatnonzero(np.diff(pos) > gap)
    for a in wide.tolist():
        penalty[pos[a] + gap:pos[a + 1]:gap] = PLAIN
    if len(wide):
        pos = np.flatnonzero(penalty >= 0)
    return pos, penalty[pos]


def windows(pos: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """The cut positions of the cheapest windows from pos[0] to pos[-1]."""
    n = len(pos)
    exact: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    size = 1
    while size < length:
        found = np.searchsorted(pos, pos - size)
        for j in np.flatnonzero((pos[found] == pos - size) & (pos >= pos[0] + size)).tolist():
            exact[j].append((int(found[j]), size))
        size *= 2
    where, cost = pos.tolist(), penalty.tolist()
    best, back = [0] * n, [0] * n
    value = [where[0]] + [0] * (n - 1)
    queue = deque([0])
    for j in range(1, n):
        reach = where[j] - length
        while where[queue[0]] < reach:
            queue.popleft()
        i = queue[0]
        least = value[i] + length - where[j]
        for k, _ in exact[j]:
            if best[k] + SHORT < least:
                least, i = best[k] + SHORT, k
        best[j], back[j] = least + cost[j], i
        value[j] = v = best[j] + where[j]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(where[j])
        j = back[j]
    return cuts[::-1]


class Stream:
    """Ids of a partition's documents in order, settled stretch by stretch."""

    def __init__(self, encoder_ends: np.ndarray, length: int, first_sequence: int) -> None:
        self.is_end, self.length, self.sequence = encoder_ends, length, first_sequence
        self.ids = np.zeros(0, np.uint32)
        # (id, start of the document in self.ids, tokens already out, all its tokens)
        self.docs: list[tuple] = []
        self.pending: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n, 0, len(ids)))
        self.pending.append(ids)
        self.n += len(ids)

    def settle(self, last: bool) -> Iterator[tuple]:
        """Pieces of every window but the last two, or of all of them at the end."""
        self.ids = np.concatenate([self.ids, *self.pending])
        self.pending = []
        if not len(self.ids):
            return
        ends = np.array([at + n - done for _, at, done, n in self.docs], np.int64)
        pos, penalty = candidates(ends, self.is_end[self.ids], self.length)
        cuts = windows(pos, penalty, self.length)
        if not last:
            cuts = cuts[:-2]
        start, d = 0, 0
        for cut in cuts:
            offset = 0
            while start < cut:
                doc_id, at, done, n = self.docs[d]
                stop = min(cut, at + n - done)
                part = self.ids[start:stop]
                yield (doc_id, done + start - at, stop - start, zlib.crc32(part.tobytes()), n,
                       self.sequence, offset)
                offset += stop - start
                start = stop
                if stop == at + n - done:
                    d += 1
            self.sequence += 1
        self.ids = self.ids[start:]
        self.n = len(self.ids)
        self.docs = [(i, max(at - start, 0), done + max(start - at, 0), n)
                     for i, at, done, n in self.docs[d:]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         length: int = LENGTH, stretch: int = STRETCH) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end token alone. Long texts are cut over many sequences. Repeated rows
    are packed each; null ids stay null. Sequence ids count up from (partition number << 32).
    """
    schema = T.StructType([df.schema[id_col], *[T.StructField(c, T.LongType()) for c in PIECE]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        stream = Stream(enc.ends, length, TaskContext.get().partitionId() << 32)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "")
                stream.add(doc_id.as_py(), np.append(ids, np.uint32(END_ID)))
                if stream.n >= stretch:
                    yield table(stream.settle(False), id_type)
        if id_type is not None:
            yield table(stream.settle(True), id_type)

    def table(pieces: Iterator[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*pieces, strict=True)) or [()] * (len(PIECE) + 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]],
            names=[id_col, *PIECE])

    return df.select(id_col, text_col).mapInArrow(run, schema)
