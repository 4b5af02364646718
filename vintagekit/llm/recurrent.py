"""A gated recurrent language model in numpy, fitted and applied by Spark tasks.

Words are counted over all training texts. The most frequent ones are the network's outputs, the rest
share one output, and a word among the rest has its share of that output by its count plus one. The
output softmax is factored: first a class of words, then a word of the class. Biases start at the
counted frequencies. Each task fits the network on all words of its texts by back-propagation through
windows of `WINDOW` words with the state carried to the end of a text; a stream whose text has ended
takes the next one. The tasks' weights are averaged in groups, so no one holds more than `FAN_IN` of
them. That is repeated in rounds, each with its own share of the texts.

Scoring walks whole texts, many side by side, with the state carried to the end. Counts of the
`HEAD` most frequent words are broadcast, a bound whatever the corpus; the others are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.llm.common import words_of
from vintagekit.session import materialize

END = b""
HEAD = 100_000
CLASSES, CLASS_SIZE = 40, 40
DIM, HIDDEN = 12, 20
WINDOW = 32
STREAMS = 128
ROUNDS = 2
RATE = 0.25
FAN_IN = 32
FLUSH = 400_000
SIDE_BY_SIDE = 2048


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts of the one column given; every text adds one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield table(counts)
                    counts = Counter()
        yield table(counts)

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "c"])

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Counts:
    """Totals, and the counts of the most frequent words."""

    tokens: int
    distinct: int
    head: dict[bytes, int]

    @property
    def outputs(self) -> list[bytes]:
        """The network's own words: the end first, then the most frequent."""
        return [END, *[w for w in self.head if w != END][:CLASSES * CLASS_SIZE - 2]]

    @property
    def rest(self) -> tuple[int, int]:
        own = self.outputs
        return (self.tokens - sum(self.head.get(w, 0) for w in own),
                self.distinct - sum(w in self.head for w in own))


def totals(counts: DataFrame, head: int = HEAD) -> Counts:
    """Totals, and at most `head` of the most frequent words, with all ties or none at the cut.

    The cut comes from a histogram of the counts by their logarithm, then of the counts within the
    step at the cut, so that no more words reach the driver than are kept.
    """
    n = counts.agg(F.sum("c"), F.count("*")).first()
    step = F.floor(F.log2("c") * 64)
    cut = cut_of(counts.groupBy(step.cast("long").alias("s")).count().collect(), head)
    above, level = counts.where(step > cut[0]), counts.where(step == cut[0])
    room = head - cut[1]
    # Within one step counts differ by a hundredth, so few values of them are there.
    value = cut_of(level.groupBy(F.col("c").alias("s")).count().collect(), room)
    top = above.union(level.where(F.col("c") > value[0])).collect()
    ordered = sorted(((-r["c"], bytes(r["word"])) for r in top))
    return Counts(n[0] or 0, n[1], {w: -c for c, w in ordered})


def cut_of(steps: list, head: int) -> tuple[int, int]:
    """The highest step that does not fit whole into `head` rows, and the rows above it."""
    taken = 0
    for r in sorted(steps, key=lambda r: -r["s"]):
        if taken + r["count"] > head:
            return r["s"], taken
        taken += r["count"]
    return -1, taken


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Works in the given array."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def exponentials(x: np.ndarray) -> np.ndarray:
    """Row sums of the array's exponentials, which take its place; rows are moved if they are far from zero."""
    if x.size and max(x.max(), -x.min()) > 60:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def errors(x: np.ndarray, at: np.ndarray, scale: np.floating) -> np.ndarray:
    """Each row's softmax less one at its target, by `scale`; works in the given array."""
    total = exponentials(x)
    x *= (scale / total)[:, None]
    x[np.arange(len(x)), at] -= scale
    return x


def log_chosen(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One entry of each row's log softmax; works in the given array."""
    if x.size and max(x.max(), -x.min()) > 60:
        x -= x.max(axis=1, keepdims=True)
    chosen = x[np.arange(len(x)), at]
    return chosen - np.log(exponentials(x))


class Network:
    """Weights by name; outputs are numbered class by class, 0 the end, the last the shared one."""

    SHAPES = {
        "e": (CLASSES * CLASS_SIZE, DIM), "wx": (DIM, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN),
        "b": (3 * HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,),
        "wo": (CLASSES, HIDDEN, CLASS_SIZE), "bo": (CLASSES, CLASS_SIZE),
    }
    SHARED = CLASSES * CLASS_SIZE - 1

    def __init__(self, flat: np.ndarray) -> None:
        self.p, at = {}, 0
        for name, shape in self.SHAPES.items():
            n = math.prod(shape)
            self.p[name] = flat[at:at + n].astype(np.float32).reshape(shape)
            at += n

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.SHAPES]).astype(np.float32)

    @staticmethod
    def new(counts: Counts, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        size = sum(math.prod(s) for s in Network.SHAPES.values())
        net = Network(np.zeros(size))
        for name, scale in (("e", 0.3), ("wx", 0.3), ("u", 0.25)):
            net.p[name] = (rng.standard_normal(Network.SHAPES[name]) * scale).astype(np.float32)
        net.p["b"][:HIDDEN] = 1.0  # remember at first
        c = np.full(CLASSES * CLASS_SIZE, 0.1)
        own = counts.outputs
        c[:len(own)] += [counts.head.get(w, 0) for w in own]
        c[Network.SHARED] += counts.rest[0]
        by_class = c.reshape(CLASSES, CLASS_SIZE)
        net.p["bc"] = np.log(by_class.sum(axis=1) / c.sum()).astype(np.float32)
        net.p["bo"] = np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32)
        return net

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One word: gates z and r, candidate n, the recurrent part of n, and the new state."""
        return tuple(v.T for v in self.step_columns(x.T, h.T, self.p["u"].T))

    @staticmethod
    def step_columns(x: np.ndarray, h: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same with streams as columns, so that gates are whole blocks of memory; `back` is `u` turned."""
        g = back @ h
        part = g[2 * HIDDEN:]
        zr = g[:2 * HIDDEN]
        zr += x[:2 * HIDDEN]
        sigmoid(zr)
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        n = r * part
        n += x[2 * HIDDEN:]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return z, r, n, part, new

    def log_likelihood(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target given its state."""
        cls = (targets // CLASS_SIZE).astype(np.uint8)
        order = np.argsort(cls, kind="stable")  # words of a class side by side
        h, cls, word = h[order], cls[order], (targets % CLASS_SIZE)[order]
        logits = h @ self.p["wc"]
        logits += self.p["bc"]
        found = log_chosen(logits, cls)
        for c, of in by_class(cls):
            np.matmul(h[of], self.p["wo"][c], out=logits[of])
            logits[of] += self.p["bo"][c]
        found += log_chosen(logits, word)
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradients(self, given: np.ndarray, targets: np.ndarray, real: np.ndarray,
                  h0: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Back-propagation through one window (words x streams); the state after it.

        A stream that has ended stays so to the window's end: what follows has no target, so nothing
        comes back from it, and its state is not carried on.
        """
        p, (steps, streams) = self.p, given.shape
        inputs = with_ones(p["e"])[given]
        x = np.vstack((p["wx"], p["b"])).T @ inputs.transpose(0, 2, 1)
        hs = np.empty((steps + 1, HIDDEN, streams), x.dtype)
        hs[0] = h0.T
        z, r, n, part = np.empty((4, steps, HIDDEN, streams), x.dtype)
        back = np.ascontiguousarray(p["u"].T)
        for t in range(steps):
            z[t], r[t], n[t], part[t], hs[t + 1] = self.step_columns(x[t], hs[t], back)
        states = np.ascontiguousarray(hs[1:].transpose(0, 2, 1))
        at = np.nonzero(real)
        want = targets[at]
        order = np.argsort((want // CLASS_SIZE).astype(np.uint8), kind="stable")  # words of a class side by side
        at, want = (at[0][order], at[1][order]), want[order]
        flat, cls, word = with_ones(states[at]), want // CLASS_SIZE, want % CLASS_SIZE
        scale = x.dtype.type(1 / max(1, len(want)))
        d = errors(flat @ np.vstack((p["wc"], p["bc"])), cls, scale)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        both = flat.T @ d
        g["wc"], g["bc"] = both[:-1], both[-1]
        dflat = d @ p["wc"].T
        outputs = np.concatenate((p["wo"], p["bo"][:, None]), axis=1)
        for c, of in by_class(cls):
            np.matmul(flat[of], outputs[c], out=d[of])
        errors(d, word, scale)
        for c, of in by_class(cls):
            both = flat[of].T @ d[of]
            g["wo"][c], g["bo"][c] = both[:-1], both[-1]
            dflat[of] += d[of] @ p["wo"][c].T
        dh_out = np.zeros_like(states)
        dh_out[at] = dflat
        dh_out = np.ascontiguousarray(dh_out.transpose(0, 2, 1))
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (hs[:-1] - n) * z * (1 - z), part * r * (1 - r)
        dx, dg = np.empty((2, steps, 3 * HIDDEN, streams), x.dtype)
        dh = np.zeros_like(hs[0])
        for t in range(steps - 1, -1, -1):
            d = dh + dh_out[t]
            dn = d * to_n[t]
            dx[t, :HIDDEN] = d * to_z[t]
            dx[t, HIDDEN:2 * HIDDEN] = dn * to_r[t]
            dx[t, 2 * HIDDEN:] = dn
            dg[t] = dx[t]
            dg[t, 2 * HIDDEN:] *= r[t]
            dh = d * z[t] + p["u"] @ dg[t]
        g["u"] = (hs[:-1] @ dg.transpose(0, 2, 1)).sum(axis=0)
        # Gradients of the words' rows and of what makes inputs of them.
        both = (inputs.transpose(0, 2, 1) @ dx.transpose(0, 2, 1)).sum(axis=0)
        g["wx"], g["b"] = both[:-1], both[-1]
        by_place = np.ascontiguousarray((p["wx"] @ dx).transpose(0, 2, 1)).reshape(-1, DIM)
        order = np.argsort(given.astype(np.uint16), axis=None, kind="stable")
        words, first = np.unique(given.ravel()[order], return_index=True)
        g["e"][words] = np.add.reduceat(by_place[order], first, axis=0)
        return g, np.ascontiguousarray(hs[-1].T)

    def fit(self, texts: Iterator[np.ndarray], seen: dict[str, np.ndarray]) -> tuple[int, int]:
        """Adagrad over whole texts, window by window in STREAMS streams; how many texts and words.

        Texts begin with an end, which is only given. A stream refills when its text has ended.
        """
        live: list[tuple[np.ndarray, int]] = []
        h = np.zeros((0, HIDDEN), np.float32)
        n = words = 0
        while True:
            while len(live) < STREAMS and (text := next(texts, None)) is not None:
                live.append((text, 1))
                n += 1
            if not live:
                return n, words
            h = np.vstack((h, np.zeros((len(live) - len(h), HIDDEN), np.float32)))
            steps = min(WINDOW, max(len(s) - at for s, at in live))
            given, targets = np.zeros((2, steps, len(live)), np.int64)
            real = np.zeros((steps, len(live)), bool)
            for i, (s, at) in enumerate(live):
                k = min(steps, len(s) - at)
                given[:k, i], targets[:k, i], real[:k, i] = s[at - 1:at - 1 + k], s[at:at + k], True
                words += k
            g, h = self.gradients(given, targets, real, h)
            share = np.float32(real.sum() / (STREAMS * WINDOW))  # a word weighs the same in thin windows
            for name, grad in g.items():
                grad = np.clip(grad * share, -1, 1)
                seen[name] += grad * grad
                self.p[name] -= RATE * grad / np.sqrt(seen[name])
            going = [i for i, (s, at) in enumerate(live) if at + steps < len(s)]
            live = [(live[i][0], live[i][1] + steps) for i in going]
            h = h[going]

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of whole texts, side by side from the longest to the shortest."""
        out = np.zeros(len(texts))
        table = self.p["e"] @ self.p["wx"] + self.p["b"]
        back = np.ascontiguousarray(self.p["u"].T)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for first in range(0, len(order), SIDE_BY_SIDE):
            part = order[first:first + SIDE_BY_SIDE]
            sizes = np.array([len(texts[i]) for i in part])
            flat = np.concatenate([texts[i] for i in part])
            starts = np.cumsum(sizes) - sizes
            h = np.zeros((HIDDEN, len(part)), np.float32)
            total = np.zeros(len(part))
            for at in range(0, int(sizes[0]), WINDOW):
                states, wanted, whose = [], [], []
                for t in range(at, min(at + WINDOW, int(sizes[0]))):
                    live = int(np.searchsorted(-sizes, -t, side="left"))
                    places = starts[:live] + t
                    given = flat[places - 1] if t else np.zeros(live, np.int64)
                    h = self.step_columns(table[given].T, h[:, :live], back)[4]
                    states.append(h.T)
                    wanted.append(flat[places])
                    whose.append(np.arange(live))
                found = self.log_likelihood(np.concatenate(states), np.concatenate(wanted))
                total += np.bincount(np.concatenate(whose), found, len(part))
            out[part] = total / math.log(10)
        return out


def with_ones(x: np.ndarray) -> np.ndarray:
    """A column of ones added, which carries a bias."""
    return np.hstack((x, np.ones((len(x), 1), x.dtype)))


def by_class(cls: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Classes and their places; the classes come in order."""
    edge = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    return ((c, slice(edge[c], edge[c + 1])) for c in range(CLASSES) if edge[c] < edge[c + 1])


def fit(texts: DataFrame, key: Column, counts: Counts) -> Network:
    """Rounds of fitting in every task on its texts, and averaging by text count.

    `texts` holds one column; `key` picks a text's round.
    """
    context = texts.sparkSession.sparkContext
    number = context.broadcast({w: i for i, w in enumerate(counts.outputs)})
    column = texts.columns[0]
    schema = "task long, n long, weights binary"

    def task(weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, numbers = Network(np.frombuffer(weights.value, np.float32)), number.value
        seen = {k: np.full(v.shape, 1e-3, np.float32) for k, v in net.p.items()}
        n, _ = net.fit((
            np.array([numbers.get(w, Network.SHARED) for w in (END, *words_of(text), END)])
            for batch in batches for text in batch.column(0).to_pylist()), seen)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()]), pa.array([n]),
                 pa.array([net.flat().tobytes()], pa.binary())], names=["task", "n", "weights"])

    def mean(part: pa.Table) -> pa.Table:
        n = np.array(part["n"].to_pylist(), float)
        total = sum(np.frombuffer(w, np.float32) * k for w, k in zip(
            part["weights"].to_pylist(), n, strict=True)) / n.sum()
        return pa.table({"task": [part["task"][0].as_py() // FAN_IN], "n": [int(n.sum())],
                         "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    net = Network.new(counts)
    for turn in range(ROUNDS):
        weights = context.broadcast(net.flat().tobytes())
        fitted = materialize(
            texts.select(column, F.pmod(key, F.lit(1 << 30)).alias("_key"))
            .where(F.col("_key") % ROUNDS == turn)
            .mapInArrow(lambda batches, w=weights: task(w, batches), schema), "weights")
        while (n := fitted.count()) > 1:
            fitted = materialize(fitted.groupBy(
                F.floor(F.col("task") / (FAN_IN if n > FAN_IN else 1 << 40))).applyInArrow(
                mean, schema), "weights")
        row = fitted.first()
        if row is not None:
            net = Network(np.frombuffer(row["weights"], np.float32))
    return net


def score(df: DataFrame, counts: DataFrame, totals_: Counts, net: Network, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row; null texts are the end alone."""
    context = df.sparkSession.sparkContext
    shared = context.broadcast((totals_, net.flat().tobytes()))
    schema = T.StructType([
        df.schema[id_col], *[T.StructField(c, T.LongType()) for c in ("n_tokens", "known", "others")],
        *[T.StructField(c, T.DoubleType()) for c in ("base", "other_base", "net")],
        T.StructField("tail", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, weights = shared.value
        net = Network(np.frombuffer(weights, np.float32))
        numbers = {w: i for i, w in enumerate(found.outputs)}
        place = {w: i for i, w in enumerate(found.head)}
        # One lookup a word: its place among the head; the last place is for all others.
        log_count = np.array([math.log10(c + 1) for c in found.head.values()] + [0.0])
        output = np.array([numbers.get(w, Network.SHARED) for w in found.head] + [Network.SHARED])
        none = len(place)
        for batch in batches:
            rows, texts = [], []
            for text in batch.column(1).to_pylist():
                words = [*words_of(text), END]
                at = np.array([place.get(w, none) for w in words])
                out = output[at]
                if none in (at[-1],):  # an end that no training text had
                    out[-1] = 0
                logs = log_count[at]
                tail = np.flatnonzero(at == none).tolist()
                other = out == Network.SHARED
                rows.append((len(words), len(words) - len(tail), int(other.sum()), float(logs.sum()),
                             float(logs[other].sum()), [words[i] for i in tail]))
                texts.append(out)
            scores = net.score(texts)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]],
                 *[pa.array(c, pa.float64()) for c in columns[3:5]], pa.array(scores, pa.float64()),
                 pa.array(columns[5], pa.list_(pa.binary()))], names=schema.names)

    part = materialize(df.select(id_col, text_col).mapInArrow(run, schema).withColumn(
        "_row", F.monotonically_increasing_id()), "scores")
    tail = part.select("_row", F.explode("tail").alias("word")).join(counts, "word").groupBy("_row").agg(
        F.count("*").alias("_known"), F.sum(F.log10(F.col("c") + 1)).alias("_logs"))
    rest_tokens, rest_words = totals_.rest
    logs = F.coalesce("_logs", F.lit(0.0))
    return part.join(tail, "_row", "left").select(
        id_col, "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        (F.col("base") + logs - F.col("n_tokens") * math.log10(totals_.tokens + totals_.distinct + 1))
        .alias("base_score"),
        (F.col("net") + F.col("other_base") + logs
         - F.col("others") * math.log10(rest_tokens + rest_words + 1)).alias("score"))


def language_model_scores(df: DataFrame, train: Column, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """Scores of all rows by a model of the rows where `train` holds, with `train_tokens` added.

    Null and empty texts are one end. Null ids keep their rows. Without training rows, every word is
    unseen. Repeated rows are counted and scored each.
    """
    kept = df.where(train)
    counts = materialize(word_counts(kept.select(text_col)), "counts")
    found = totals(counts)
    net = fit(kept.select(text_col), F.xxhash64(text_col), found)
    return score(df, counts, found, net, id_col, text_col).withColumn(
        "train_tokens", F.lit(found.tokens).cast("long"))
