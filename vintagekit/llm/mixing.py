"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target of words: shares of the total by weight, stopped at `most` times the
source's size, the excess shared again by weight. A document is taken floor(target / size of source)
times, and once more with the remaining probability. Those draws are balanced: the cube method moves
the fractional probabilities of three documents at a time along the null space of the two constraints
(words, documents), until at most two are left. That runs in blocks of a source, so that a hot source
is many tasks; what the blocks leave (two documents each) is the next level's input. A source's last
block lands its two, and a dozen held back, where the words come nearest to the target.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.llm.quality import n_words
from vintagekit.session import materialize

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 4096
SHARED_ID = 16
HELD = 12
EPS = 1e-9


def flight(sizes: list[float], probs: list[float], draw: random.Random) -> list[float]:
    """Probabilities moved to 0 or 1 for all but two documents at most; both sums stay as they were."""
    p = list(probs)
    active: list[int] = []
    for unit in range(len(p)):
        if EPS < p[unit] < 1 - EPS:
            active.append(unit)
        while len(active) == 3:
            i, j, k = active
            u = (sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min(((1 - p[x]) / d if d > 0 else -p[x] / d) for x, d in zip(active, u, strict=True) if d)
            down = min((p[x] / d if d > 0 else -(1 - p[x]) / d)
                       for x, d in zip(active, u, strict=True) if d)
            step = up if draw.random() * (up + down) < down else -down
            for x, d in zip(active, u, strict=True):
                p[x] += step * d
                if p[x] <= EPS or p[x] >= 1 - EPS:
                    p[x] = float(p[x] > 0.5)
            active = [x for x in active if 0.0 < p[x] < 1.0]
    return p


def landing(sizes: list[float], probs: list[float]) -> list[float]:
    """The few documents left go where the words come nearest to what was asked for, with the number of
    documents at most one off; all their subsets are tried."""
    left = [i for i, x in enumerate(probs) if 0.0 < x < 1.0]
    out = list(probs)
    if not left:
        return out
    subsets = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    of = np.array([sizes[i] for i in left])
    p = np.array([probs[i] for i in left])
    words = np.abs(subsets @ of - p @ of)
    count = np.abs(subsets.sum(axis=1) - p.sum())
    best = np.lexsort((count, words, count > 1))[0]
    for i, taken in zip(left, subsets[best], strict=True):
        out[i] = float(taken)
    return out


def settle_block(sizes: list[float], probs: list[float], draw: random.Random,
                 last: bool) -> list[float]:
    """Flight; a source's last block holds some documents of every size back for the landing."""
    if not last:
        return flight(sizes, probs, draw)
    held = {int((i + 0.5) * len(probs) / HELD) for i in range(HELD)}
    flown = flight([s for i, s in enumerate(sizes) if i not in held],
                   [p for i, p in enumerate(probs) if i not in held], draw)
    rest = iter(flown)
    return landing(sizes, [p if i in held else next(rest) for i, p in enumerate(probs)])


def settler(seed: int, level: int, last: bool, block: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """The flight of one block, and the landing where the block is a source's last."""

    def settle(key: tuple, part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(
            part, [("size", "descending"), ("_id", "ascending"), ("_row", "ascending")]))
        sizes = [float(x) for x in part["size"].to_pylist()]
        draw = random.Random(f"{seed}|{level}|{key[0].as_py()}|{key[1].as_py()}")
        whole = last or part["n_docs"][0].as_py() <= block
        p = settle_block(sizes, part["_p"].to_pylist(), draw, whole)
        at = part.schema.get_field_index("_p")
        return part.set_column(at, "_p", pa.array(p, pa.float64()))

    return settle


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target): one row a source, so the unpartitioned windows are small.

    Ordered by size per weight, the stopped sources come first; a source is stopped when its share of
    what the ones before it leave is above `most` times its size.
    """
    stats = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = stats.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn)).withColumn(
        "_cap", (most * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = weighed.withColumn("_level", (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(after))
    stopped = F.col("_level") * F.col("weight") >= F.col("_cap")
    level = F.max(F.when(~stopped, F.col("_level"))).over(everything)
    return shared.withColumn("_stopped", stopped).withColumn("_final", level).select(
        "source", "source_size", "n_docs",
        F.when(F.col("_stopped"), F.col("_cap")).otherwise(F.col("_final") * F.col("weight"))
        .alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK,
        seed: int = 7) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every input row.

    Null texts have size 0; a null source is a source of its own and comes last. Repeated rows are rows
    of their own. An empty table gives an empty result. Draws depend on the seed, source and ids alone;
    rows of an id that more than `SHARED_ID` rows have, null among them, are dealt out by their place
    in the input, so that no block holds one id's rows whatever their number.
    """
    sized = materialize(df.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
        n_words(F.col(text_col)).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("_row")), "sizes")
    shared = sized.groupBy("_id").agg(F.count("*").alias("_n")).where(F.col("_n") > SHARED_ID)
    sized = sized.alias("s").join(shared.alias("h"), F.expr("s._id <=> h._id"), "left").select(
        "s._id", "source", "size", F.when(F.col("_n") > 0, F.col("_row")).otherwise(0).alias("_row"))
    targets = materialize(source_targets(sized, weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.alias("s").join(
        targets.alias("t"), F.expr("s.source <=> t.source")).select(
        "_id", "_row", "s.source", "size", "source_size", "target", "n_docs",
        F.floor(ratio).cast("long").alias("_whole"), (ratio - F.floor(ratio)).alias("_p"))
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    schema = T.StructType([*joined.schema.fields])
    todo, done, level, left = joined, None, 0, largest
    while True:
        last = left <= block

        blocks = F.ceil(F.col("n_docs") / block) if level == 0 else F.ceil(
            F.col("n_docs") * (3 / block) ** level / block)
        salt = F.lit(0).cast("long") if last else F.pmod(
            F.xxhash64(F.col("_id"), F.col("_row"), F.lit(level)), blocks.cast("long"))
        moved = materialize(
            todo.groupBy(F.col("source"), salt.alias("_salt")).applyInArrow(
                settler(seed, level, last, block), schema), "mix")
        if last:
            done = moved if done is None else done.union(moved)
            break
        settled = moved.where("_p = 0 or _p = 1")
        done = settled if done is None else done.union(settled)
        todo = moved.where("_p > 0 and _p < 1")
        left = todo.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        level += 1
    return done.select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target",
        (F.col("_whole") + F.col("_p").cast("long")).alias("copies"),
        ((F.col("_whole") + F.col("_p").cast("long")) * F.col("size")).alias("taken"))
