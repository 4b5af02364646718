"""Language by word-first backoff.

Known words score by their smoothed log frequency in each language. A word that no language knows backs
off to its character n-grams, the longest known ones first: n = 5 down to 1 over the word with its ends
marked, stopping at the first length of which any n-gram is known. A text's language has the highest
mean score. Tables are fitted on a bounded sample of labelled rows, and their sizes are bounded by
parameters, so they may be broadcast; every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.llm.common import bounded_sample
from vintagekit.session import materialize

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
FIT_ROWS = 5_000
WORDS_KEPT = 40_000
GRAMS_KEPT = 20_000
LONGEST = 5
CACHE = 200_000


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies by language: words, then n-grams by length."""

    def __init__(self, langs: list[str], words: dict[str, list[int]],
                 tables: dict[int, dict[str, list[int]]]) -> None:
        self.langs = langs
        self.tables = {n: dict(zip(t, self.scored(t), strict=True)) for n, t in tables.items()}
        self.index = {w: i for i, w in enumerate(words)}
        self.fitted = len(words)
        self.matrix = np.zeros((len(words) + CACHE, len(langs)))
        self.matrix[:len(words)] = self.scored(words)

    def scored(self, counts: dict[str, list[int]]) -> np.ndarray:
        """Log frequencies by language, half a count added."""
        c = np.array(list(counts.values()), float).reshape(len(counts), len(self.langs)) + 0.5
        return np.log(c / (c.sum(axis=0) + 0.5))

    def backed_off(self, word: str) -> np.ndarray:
        """Mean score of the word's known n-grams of the longest length that has any."""
        for n in range(LONGEST, 0, -1):
            known = [self.tables[n][g] for g in grams(word, n) if g in self.tables[n]]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(self.langs))

    def rows(self, words: list[str]) -> list[int]:
        """Rows of the score matrix; unknown words get one, which a full cache gives up again."""
        unknown = {w for w in words if w not in self.index}
        if len(self.index) + len(unknown) > len(self.matrix):
            self.index = {w: i for w, i in self.index.items() if i < self.fitted}
            unknown = {w for w in words if w not in self.index}
            if self.fitted + len(unknown) > len(self.matrix):
                self.matrix = np.vstack((self.matrix, np.zeros((len(unknown), len(self.langs)))))
        for w in unknown:
            self.index[w] = at = len(self.index)
            self.matrix[at] = self.backed_off(w)
        return [self.index[w] for w in words]

    def text(self, text: str | None) -> tuple[str, float]:
        """(language, share of its probability): `und` and 0 for a text without letters."""
        words = LETTERS.findall((text or "").lower())
        if not words or not self.langs:
            return UNKNOWN, 0.0
        scores = self.matrix[self.rows(words)].mean(axis=0)
        best = int(scores.argmax())
        # The mean difference a word, sharpened by the root of the length: long texts are surer.
        weights = np.exp((scores - scores[best]) * math.sqrt(len(words)))
        return self.langs[best], float(weights[best] / weights.sum())


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows: int = FIT_ROWS, words_kept: int = WORDS_KEPT, grams_kept: int = GRAMS_KEPT) -> Model:
    """Tables from at most `rows` rows with text and language, counted by Spark.

    Each length keeps its most frequent entries, `words_kept` or `grams_kept` of them, ties by text.
    """
    sample = bounded_sample(
        labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()), id_col, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, lang in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                for w, c in Counter(LETTERS.findall(text.lower())).items():
                    counts[lang, 0, w] += c
        for (lang, _, w), c in list(counts.items()):
            for n in range(1, LONGEST + 1):
                for g in grams(w, n):
                    counts[lang, n, g] += c
        rows = list(counts.items())
        for at in range(0, len(rows), 50_000):
            part = rows[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in part], pa.string()),
                 pa.array([k[1] for k, _ in part], pa.int32()),
                 pa.array([k[2] for k, _ in part], pa.string()),
                 pa.array([c for _, c in part], pa.int64())], names=["lang", "n", "gram", "c"])

    counted = sample.select(text_col, lang_col).mapInArrow(
        count, "lang string, n int, gram string, c long").groupBy("n", "gram", "lang").agg(
        F.sum("c").alias("c"))
    entries = materialize(counted.groupBy("n", "gram").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by_lang"),
        F.sum("c").alias("total")), "grams")
    tables: dict[int, dict[str, dict[str, int]]] = {}
    for n in range(LONGEST + 1):
        kept = entries.where(F.col("n") == n).orderBy(F.desc("total"), "gram").limit(
            grams_kept if n else words_kept).collect()
        tables[n] = {r["gram"]: r["by_lang"] for r in kept}
    langs = sorted({lang for t in tables.values() for c in t.values() for lang in c})
    by = {n: {g: [c.get(x, 0) for x in langs] for g, c in t.items()} for n, t in tables.items()}
    return Model(langs, by.pop(0), by)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; null texts and texts without letters are `und` at 0."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema[id_col], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()),
                 pa.array([s for _, s in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
