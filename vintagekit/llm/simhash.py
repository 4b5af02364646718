"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly in tiles.

Two fingerprints link at `radius` or fewer differing bits. The 64 bits are cut into radius + 2 blocks;
two linked fingerprints agree in two whole blocks at least, so every pair of blocks is one table, and
only fingerprints in one bucket of a table need comparing. Inside a bucket numpy compares tiles:
exclusive-or, bit counts, and no look at tile pairs whose population counts differ beyond the radius.
Only distinct fingerprints are compared, so exact copies cost nothing. A bucket above `split` rows is
cut into parts by hash and dealt out as pairs of parts, so no task meets more than two parts at once.
A tile yields a spanning set of its links (one edge a fingerprint at most), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.llm.common import words_of
from vintagekit.llm.components import connected
from vintagekit.session import materialize

SHINGLE = 4
SEED = 42
RADIUS = 4
SPLIT = 8192
TILE = 1024
SMALL = 48


def shingle_hashes(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of `width` words, repeats included; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(text[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist(), strict=True)],
        np.uint64)


def fingerprint(words: list[bytes]) -> int:
    """A bit is 1 if over half of the shingle hashes have it; no words give 0."""
    hashes = shingle_hashes(words)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, fp as the signed long of the same 64 bits; null texts have no words."""
    schema = T.StructType([df.schema[id_col], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(words_of(t)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def block_masks(radius: int) -> list[int]:
    """Masks of every pair of the radius + 2 blocks, as signed longs."""
    edges = np.linspace(0, 64, radius + 3).astype(int).tolist()
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(blocks, 2))]


class Links:
    """Union of positions by smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)


def tile_links(fps: np.ndarray, radius: int, links: Links, at: int) -> None:
    """Compare all of one bucket, tile by tile in order of population count."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    s = fps[order]
    ones = np.bitwise_count(s).astype(np.int16)
    for i in range(0, len(s), TILE):
        for j in range(i, len(s), TILE):
            if ones[j] - ones[min(i + TILE, len(s)) - 1] > radius:
                break
            near = np.bitwise_count(s[i:i + TILE, None] ^ s[None, j:j + TILE]) <= radius
            for x in np.flatnonzero(near.any(axis=1)).tolist():
                for y in np.flatnonzero(near[x]).tolist():
                    if order[i + x] != order[j + y]:
                        links.join(at + int(order[i + x]), at + int(order[j + y]))


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets in key order: small ones all at once by shifts, large ones by tiles."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    links = Links(len(keys))
    small = np.repeat(sizes <= SMALL, sizes)
    for shift in range(1, min(SMALL, int(sizes.max(initial=0)))):
        same = (keys[shift:] == keys[:-shift]) & small[shift:]
        if not same.any():
            break
        same &= np.bitwise_count(fps[shift:] ^ fps[:-shift]) <= radius
        for i in np.flatnonzero(same).tolist():
            links.join(i, i + shift)
    for at, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        tile_links(fps[at:at + n], radius, links, at)
    roots = np.array([links.find(i) for i in range(len(keys))], np.int64)
    moved = np.flatnonzero(roots != np.arange(len(keys)))
    return fps[moved], fps[roots[moved]]


def linked(fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Spanning edges (a, b) between distinct fingerprints `fp` at `radius` bits or fewer."""
    masks = block_masks(radius)
    keyed = fps.select("fp").distinct().select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
        for t, m in enumerate(masks)])).alias("_b")).select("fp", "_b.t", "_b.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / split).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = keyed.join(sizes, ["t", "k"]).withColumn("parts", parts).withColumn("mine", mine).select(
        "fp", "t", "k", F.explode(F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda o: F.least(F.col("mine"), o) * F.col("parts") + F.greatest(F.col("mine"), o)))
        .alias("pair"))
    tiles = dealt.select("fp", F.xxhash64("t", "k", "pair").alias("tile")) \
        .repartition("tile").sortWithinPartitions("tile", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(1).to_numpy()))
            held = np.concatenate((held, batch.column(0).to_numpy().view(np.uint64)))
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole:
                yield edges(keys[:whole], held[:whole])
                keys, held = keys[whole:], held[whole:]
        yield edges(keys, held)

    def edges(keys: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
        a, b = bucket_links(keys, held, radius)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id is the smallest id reachable.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows each come back.
    Null ids are never a component's smallest id; a component of null ids alone has a null one. An
    empty table gives an empty result.
    """
    prints = materialize(fingerprints(df, id_col, text_col), "simhash")
    roots = connected(linked(prints, radius, split))
    groups = prints.groupBy("fp").agg(F.min(id_col).alias("_least")).join(
        roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = groups.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = groups.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
