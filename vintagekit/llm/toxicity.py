"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of three rows: two tables are asked by the two halves of the word's
32-bit hash, so that two words are confused only when both halves collide, and one by the hash of its
first bytes, so that forms of one stem learn together. Filters of several
widths run over the words, each is pooled by its maximum over the text, and a logistic layer weighs
them. Fitted by back-propagation on a bounded sample of labelled rows; each language gets a threshold
from rows of the sample that the weights were not fitted on. Every text is scored whole: a filter over
an embedding is a sum of table rows, so scoring gathers and adds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.llm.common import bounded_sample, words_of
from vintagekit.session import materialize

BITS = 16
STEM_BITS = 17
STEM_BYTES = 4
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
FIT_ROWS = 12_000
STEPS = 700
BATCH_WORDS = 30_000
RATE = 0.08
EDGES = b".,;:!?\"'()[]{}<>|#*$%&-"


def hashed(text: str | None) -> np.ndarray:
    """Hashes of a text's words, the word's in the upper and its stem's in the lower 32 bits.

    Punctuation at their ends is left out; null and empty texts have none.
    """
    crc = zlib.crc32
    words = [w.strip(EDGES) for w in words_of(text)]
    whole = np.array([crc(w) for w in words], np.uint64)
    return whole << np.uint64(32) | np.array([crc(w[:STEM_BYTES]) for w in words], np.uint64)


def rows_of(hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Which row of each embedding table a word asks."""
    stem = hashes & np.uint64(0xFFFFFFFF)
    return {"low": (hashes >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64),
            "high": (hashes >> np.uint64(48)).astype(np.int64),
            "stem": (stem % np.uint64(1 << STEM_BITS)).astype(np.int64)}


def laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of several texts in one array, pads between them; which are words; text starts."""
    pad = max(WIDTHS)
    sizes = np.array([len(d) + pad for d in docs], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    hashes = np.zeros(int(sizes.sum()), np.uint64)
    real = np.zeros(len(hashes), bool)
    for at, d in zip(starts.tolist(), docs, strict=True):
        hashes[at:at + len(d)] = d
        real[at:at + len(d)] = True
    return hashes, real, starts


def kept_apart(z: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Windows that begin in a text's pads and would reach into the next text see nothing."""
    stops = np.append(starts[1:], len(z))
    for k in range(1, width):
        z[stops - k] = 0
    return z


@dataclass
class Model:
    embeddings: dict[str, np.ndarray]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def new(seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)

        def drawn(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        n = FILTERS * len(WIDTHS)
        return Model(
            {"low": drawn(1 << BITS, DIM, scale=0.1), "high": drawn(1 << BITS, DIM, scale=0.1),
             "stem": drawn(1 << STEM_BITS, DIM, scale=0.1)},
            {w: drawn(w, DIM, FILTERS, scale=0.4) for w in WIDTHS},
            np.zeros(n, np.float32), drawn(n, scale=0.3), -1.0)

    def embed(self, hashes: np.ndarray, real: np.ndarray) -> np.ndarray:
        e = sum(self.embeddings[name][at] for name, at in rows_of(hashes).items())
        e[~real] = 0
        return e

    def tables(self) -> dict[str, np.ndarray]:
        """Responses of all filters to every table row, side by side, for scoring."""
        every = np.hstack([f[k] for f in self.filters.values() for k in range(len(f))])
        return {name: table @ every for name, table in self.embeddings.items()}

    def scores(self, docs: list[np.ndarray], tables: dict) -> np.ndarray:
        hashes, real, starts = laid_out(docs)
        every = sum(tables[name][at] for name, at in rows_of(hashes).items())
        every[~real] = 0
        pooled, column = [], 0
        for w in WIDTHS:
            z = np.zeros((len(hashes), FILTERS), np.float32)
            for k in range(w):
                z[:len(z) - k] += every[k:, column:column + FILTERS]
                column += FILTERS
            pooled.append(np.maximum.reduceat(kept_apart(z, starts, w), starts, axis=0))
        h = np.maximum(np.hstack(pooled) + self.bias, 0)
        return 1 / (1 + np.exp(-(h.astype(np.float64) @ self.out + self.out_bias)))


class Fitter:
    """Adagrad steps over batches of whole texts; a maximum passes its gradient to one place only."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.seen = {n: np.full(t.shape, 1e-3, np.float32) for n, t in model.embeddings.items()} | {
                     "bias": np.full(model.bias.shape, 1e-2), "out": np.full(model.out.shape, 1e-2),
                     "out_bias": 1e-2} | {w: np.full(f.shape, 1e-2) for w, f in model.filters.items()}

    def moved(self, name: object, value: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.seen[name] = self.seen[name] + grad * grad
        return (value - RATE * grad / np.sqrt(self.seen[name])).astype(np.float32)

    def rows(self, name: str, table: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        rows, where = np.unique(at, return_inverse=True)
        total = np.zeros((len(rows), DIM), np.float32)
        np.add.at(total, where, grad)
        self.seen[name][rows] += total * total
        table[rows] -= RATE * total / np.sqrt(self.seen[name][rows])

    def step(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        m = self.m
        hashes, real, starts = laid_out(docs)
        e = m.embed(hashes, real)
        stops = np.append(starts[1:], len(hashes)).tolist()
        pooled, places = [], []
        for w in WIDTHS:
            z = np.zeros((len(hashes), FILTERS), np.float32)
            for k in range(w):
                z[:len(z) - k] += e[k:] @ m.filters[w][k]
            kept_apart(z, starts, w)
            at = np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(starts.tolist(), stops, strict=True)])
            places.append(at)
            pooled.append(np.take_along_axis(z, at, axis=0))
        raw = np.hstack(pooled) + m.bias
        h = np.maximum(raw, 0)
        p = 1 / (1 + np.exp(-(h @ m.out + m.out_bias)))
        d = ((p - labels) * weights / len(docs)).astype(np.float32)
        dh = d[:, None] * m.out * (raw > 0)
        rows, grads = [], []
        for i, w in enumerate(WIDTHS):
            g = dh[:, i * FILTERS:(i + 1) * FILTERS]
            df = np.zeros_like(m.filters[w])
            for k in range(w):
                spot = np.minimum(places[i] + k, len(hashes) - 1)
                df[k] = np.einsum("bfd,bf->df", e[spot], g)
                rows.append(spot.ravel())
                grads.append((g[:, :, None] * m.filters[w][k].T[None]).reshape(-1, DIM))
            m.filters[w] = self.moved(w, m.filters[w], df)
        at, grad = np.concatenate(rows), np.concatenate(grads)
        at, grad = at[real[at]], grad[real[at]]
        for name, of in rows_of(hashes[at]).items():
            self.rows(name, m.embeddings[name], of, grad)
        m.out, m.bias = self.moved("out", m.out, h.T @ d), self.moved("bias", m.bias, dh.sum(axis=0))
        m.out_bias = float(self.moved("out_bias", np.float32(m.out_bias), d.sum()))


def batches_of(docs: list[np.ndarray], order: np.ndarray) -> Iterator[list[int]]:
    part, size = [], 0
    for i in order.tolist():
        part.append(i)
        size += len(docs[i]) + max(WIDTHS)
        if size >= BATCH_WORDS or len(part) == 64:
            yield part
            part, size = [], 0
    if part:
        yield part


def train(docs: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Weights from texts and labels; without labelled texts, or with one label only, the prior."""
    model = Model.new(seed)
    rate = float(labels.mean()) if len(labels) else 0.5
    model.out_bias = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    if len(docs) and 0.0 < rate < 1.0:
        rng = np.random.default_rng(seed)
        fitter = Fitter(model)
        weights = np.where(labels == 1, min(4.0, 0.5 / rate), 1.0)
        steps = 0
        while steps < STEPS:  # whole passes over the sample, small ones more often
            for part in batches_of(docs, rng.permutation(len(docs))):
                fitter.step([docs[i] for i in part], labels[part], weights[part])
                steps += 1
    return model


def threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the fewest errors of a language, within 0.3 to 0.7, nearest to 0.5 among equals."""
    cuts = np.arange(30, 71, 2) / 100
    errors = [int(((scores >= c) != (labels == 1)).sum()) for c in cuts]
    return float(min(zip(errors, np.abs(cuts - 0.5), cuts, strict=True))[2])


def score_all(model: Model, docs: list[np.ndarray], tables: dict) -> np.ndarray:
    out = np.zeros(len(docs))
    part, size, at = [], 0, 0
    for i, d in enumerate(docs):
        part.append(d)
        size += len(d)
        if size >= 4 * BATCH_WORDS or i == len(docs) - 1:
            out[at:i + 1] = model.scores(part, tables)
            part, size, at = [], 0, i + 1
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    label_col: str = "toxic", rows: int = FIT_ROWS) -> DataFrame:
    """Documents of at most `rows` labels, picked among the labels, so that no text is moved for it.

    Repeated label rows count once; ids with both labels and null ids teach nothing. A column of the
    documents that is named as the label is left out.
    """
    one = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(
        F.min(label_col).alias(label_col), F.max(label_col).alias("_most")).where(
        F.col(label_col) == F.col("_most")).select(id_col, label_col)
    return docs.drop(label_col).join(materialize(bounded_sample(one, id_col, rows), "labels"), id_col)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", lang_col: str = "lang", rows: int | None = FIT_ROWS) -> Model:
    """A model from at most `rows` rows with a label (None: of all, for a sample already bounded).

    A fifth of them sets the thresholds only.
    """
    sample = labelled.where(F.col(label_col).isin(0, 1))
    if rows is not None:
        sample = bounded_sample(sample, id_col, rows)

    def hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary()), batch.column(2), batch.column(3)],
                names=["k", "h", "y", "lang"])

    found = sorted(sample.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col, F.col(label_col).cast("int"),
        F.col(lang_col).cast("string")).mapInArrow(
        hash_words, "k string, h binary, y int, lang string").collect(), key=lambda r: (r["k"], r["h"]))
    docs = [np.frombuffer(r["h"], np.uint64) for r in found]
    labels = np.array([r["y"] for r in found], np.int64)
    langs = np.array([r["lang"] or "" for r in found], object)
    held = np.array([zlib.crc32(r["k"].encode()) // 64 % 5 == 0 for r in found], bool)
    model = train([d for d, h in zip(docs, held, strict=True) if not h], labels[~held])
    if held.any():
        scores = score_all(model, [d for d, h in zip(docs, held, strict=True) if h], model.tables())
        for lang in sorted(set(langs[held])):
            of = langs[held] == lang
            model.thresholds[lang] = threshold(scores[of], labels[held][of])
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, score) of every row; null and empty texts get the score of no words."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [df.schema[c] for c in (id_col, *keep)]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for batch in batches:
            docs = [hashed(t) for t in batch.column(0).to_pylist()]
            scores = score_all(shared.value, docs, tables)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(scores, pa.float64())], names=schema.names)

    return df.select(text_col, *[F.col(c).alias(f"_{i}") for i, c in enumerate((id_col, *keep))]) \
        .mapInArrow(run, schema)


def flagged(scored: DataFrame, model: Model, lang_col: str = "lang") -> DataFrame:
    """Adds `toxic_flag`: the score reaches its language's threshold; unknown languages use 0.5."""
    cut = F.lit(0.5)
    for lang, c in model.thresholds.items():
        cut = F.when(F.coalesce(F.col(lang_col), F.lit("")) == lang, F.lit(c)).otherwise(cut)
    return scored.withColumn("toxic_flag", F.col("score") >= cut)
