"""The prefix trie of conversations, by ROLLUP over positional turn-id columns.

A turn's id is a digest of its role and text with the number of its words behind it. A conversation is
cut into blocks of `BLOCK` turn-id columns; a block is keyed by its number and the node that ends the
block before it, so conversations of any length take the same single ROLLUP: its grouping_id tells the
depth, and every group is a node of the trie with its members counted and the smallest of them.

A node is named by its depth and an exclusive-or of hashes of (position, turn id), 128 bits, which
every row can tell for itself; its parent's name is the same without the last turn.

Each node is owned by its smallest member, and a conversation owns the tail of its own path. So a
subtree's sum is the sum, over the members of its top, of what they own, less what the owner of the
top owns above it: a second ROLLUP over the same blocks, with no walk over levels.

Turns are numbered after a range sort, and running values come from two levels of partial results, so
one conversation may hold any part of all rows. Lists of members that end at a node are hashed in
chunks of `CHUNK` ids; only SHA-256 itself, which is serial, runs over one node's chunks in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagekit.llm.common import WORD
from vintagekit.session import materialize

BLOCK = 8
FAMILY = 20
HEADS = 4
SPAN = 1024
CHUNK = 4096
NODE = ["depth", "_n1", "_n2"]


def turn_id(role: Column, text: Column) -> Column:
    """Sixteen bytes of a digest of role and text, and four of the text's number of words."""
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit(WORD))
    return F.unhex(F.concat(F.substring(F.sha2(content, 256), 1, 32), F.lpad(F.hex(words), 8, "0")))


def turn_words(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("long")


def lane(number: int, at: Column, turn: Column) -> Column:
    """One of two hashes of a turn at a position; nothing for no turn."""
    return F.when(turn.isNull(), F.lit(0).cast("long")).otherwise(
        F.xxhash64(F.lit(number), at.cast("long"), turn))


def numbered(turns: DataFrame) -> DataFrame:
    """(_conv, _turn id, _at): turns counted from 0 within their conversation, sorted over all tasks.

    A task numbers what it holds; conversations that cross tasks are joined by a table of one row a
    task and conversation.
    """
    order = ["_conv", "_turn", "_id", "_place"]
    dealt = turns.withColumn("_place", F.monotonically_increasing_id()) \
        .repartitionByRange(*order).sortWithinPartitions(*order).select("_conv", "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            sizes = np.diff(np.append(starts, len(conv)))
            local = np.arange(len(conv)) - np.repeat(starts, sizes)
            if last == conv[0]:
                local[:sizes[0]] += seen
            last, seen = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(local), pa.array(np.full(len(conv), part, np.int64))],
                names=["_conv", "_id", "_local", "_part"])

    local = materialize(dealt.mapInArrow(count, "_conv long, _id binary, _local long, _part long"), "turns")
    crossing = local.groupBy("_conv").agg(F.min("_part").alias("a"), F.max("_part").alias("z")) \
        .where("a < z").select("_conv")
    sizes = local.join(crossing, "_conv").groupBy("_conv", "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("_conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return local.join(offsets, ["_conv", "_part"], "left").select(
        "_conv", "_id", (F.col("_local") + F.coalesce("_before", F.lit(0))).alias("_at"))


def rebuilt(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str,
            family: int, heads: int) -> DataFrame:
    """(_conv, _at, _id) of all conversations as they are to be compared; no turn is one row without.

    The first h turns of a conversation are those of the first one of its family of `family` ids,
    h being the checksum of its id by `heads`; its own turns after its first h follow.
    """
    turns = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("_conv"), F.col(turn_col).alias("_turn"),
        turn_id(F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))).alias("_id"))
    own = materialize(numbered(turns), "numbered")
    convs = own.select("_conv").distinct().withColumn(
        "_h", F.crc32(F.col("_conv").cast("string")) % heads).withColumn(
        "_base", F.col("_conv") - F.col("_conv") % family)
    first = own.where((F.col("_conv") % family == 0) & (F.col("_at") < heads - 1)) \
        .groupBy(F.col("_conv").alias("_base")).agg(
        F.array_sort(F.collect_list(F.struct("_at", "_id"))).alias("_first"))
    plan = convs.join(first, "_base", "left").select(
        "_conv", "_h", F.slice(F.coalesce("_first", F.array().cast(first.schema["_first"].dataType)),
                               F.lit(1), F.col("_h").cast("int")).alias("_head"))
    plan = materialize(plan, "heads")
    tail = own.join(plan.select("_conv", "_h", F.size("_head").alias("_m")), "_conv") \
        .where(F.col("_at") >= F.col("_h")) \
        .select("_conv", (F.col("_at") - F.col("_h") + F.col("_m")).alias("_at"), "_id")
    head = plan.select("_conv", F.explode("_head").alias("_t")).select("_conv", "_t._at", "_t._id")
    none = plan.select("_conv", F.lit(0).cast("long").alias("_at"), F.lit(None).cast("binary").alias("_id"))
    return head.union(tail).union(none)


def before(df: DataFrame, key: str, at: str, columns: list[str], combine: str) -> DataFrame:
    """Adds `_b` columns: each column combined over the key's rows with a lower `at`.

    Rows combine within spans of `SPAN`, and spans among themselves, so no task meets a whole key.
    """
    span = F.floor(F.col(at) / SPAN).cast("long")
    fold = {c: F.expr(f"{combine}({c})") for c in columns}
    rows = df.withColumn("_span", span)
    over = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(key, "_span").agg(*[fold[c].alias(f"_s{c}") for c in columns]).select(
        key, "_span", *[F.expr(f"{combine}(_s{c})").over(over).alias(f"_s{c}") for c in columns])
    within = Window.partitionBy(key, "_span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.select("*", *[fold[c].over(within).alias(f"_w{c}") for c in columns])
    zero = F.lit(0).cast("long")
    both = {c: (F.coalesce(f"_s{c}", zero), F.coalesce(f"_w{c}", zero)) for c in columns}
    return inner.join(spans, [key, "_span"]).select(
        *df.columns, *[(a.bitwiseXOR(b) if combine == "bit_xor" else a + b).alias(f"_b{c}")
                       for c, (a, b) in both.items()])


def blocks_of(turns: DataFrame) -> DataFrame:
    """(_conv, _block, _k1, _k2, t1 ...): one row of turn-id columns a block, keyed by the node before it."""
    lanes = [F.bit_xor(lane(i, F.col("_at"), F.col("_id"))).alias(f"_x{i}") for i in (1, 2)]
    packed = turns.groupBy("_conv", F.floor(F.col("_at") / BLOCK).cast("long").alias("_block")).agg(
        *lanes, F.array_sort(F.collect_list(F.when(
            F.col("_id").isNotNull(), F.struct("_at", "_id")))).getField("_id").alias("_t"))
    keyed = before(packed, "_conv", "_block", ["_x1", "_x2"], "bit_xor")
    return keyed.select("_conv", "_block", F.col("_b_x1").alias("_k1"), F.col("_b_x2").alias("_k2"),
                        *[F.get("_t", F.lit(i)).alias(f"t{i + 1}") for i in range(BLOCK)])


def rolled(blocks: DataFrame, values: str) -> DataFrame:
    """Every node but those that only open a block: its name, its parent's, and aggregates of members."""
    names = [f"t{i + 1}" for i in range(BLOCK)]
    groups = blocks.sparkSession.sql(
        f"SELECT _block, _k1, _k2, {', '.join(names)}, grouping_id() AS _gid, {values} FROM {{rows}} "
        f"GROUP BY _block, _k1, _k2, ROLLUP({', '.join(names)})", rows=blocks)
    level = F.lit(BLOCK) - F.bit_count("_gid")
    last = F.get(F.array(*names), level - 1)
    wanted = groups.withColumn("_level", level).withColumn("_last", last).where(
        F.when(F.col("_level") == 0, F.col("_block") == 0).otherwise(F.col("_last").isNotNull()))
    first = F.col("_block") * BLOCK
    depth = first + F.col("_level")

    def name(number: int) -> Column:
        out = F.col(f"_k{number}")
        for i, t in enumerate(names):
            out = out.bitwiseXOR(lane(number, first + i, F.col(t)))
        return out

    return wanted.select(
        depth.alias("depth"), name(1).alias("_n1"), name(2).alias("_n2"),
        *[F.when(F.col("_level") > 0, name(i).bitwiseXOR(lane(i, depth - 1, F.col("_last")))).alias(f"_p{i}")
          for i in (1, 2)],
        F.when(F.col("_level") > 0, turn_words(F.col("_last"))).otherwise(0).alias("_words"),
        *[c for c in groups.columns if c not in ("_block", "_k1", "_k2", "_gid", *names)])


def ends_of(turns: DataFrame) -> DataFrame:
    """(node, ends_sha256) of every node where a conversation ends, by sorted chunks of ids."""
    order = [*NODE, "_conv"]
    ends = turns.groupBy("_conv").agg(
        F.count("_id").alias("depth"),
        *[F.bit_xor(lane(i, F.col("_at"), F.col("_id"))).alias(f"_n{i}") for i in (1, 2)]).select(*order)
    dealt = materialize(ends, "ends").repartitionByRange(*order).sortWithinPartitions(*order)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.stack([batch.column(i).to_numpy() for i in range(3)])
            new = np.ones(batch.num_rows, bool)
            new[1:] = (names[:, 1:] != names[:, :-1]).any(axis=0)
            firsts = np.flatnonzero(new)
            within = np.arange(len(new)) - np.repeat(firsts, np.diff(np.append(firsts, len(new))))
            at = np.flatnonzero(within % CHUNK == 0)
            ids = batch.column(3).to_pylist()
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(
                at.tolist(), [*at[1:].tolist(), len(ids)], strict=True)]
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(texts, pa.string())],
                                             names=[*order, "_ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, hashlib.sha256()
        for batch in batches:
            names = list(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True))
            done = []
            for name, ids in zip(names, batch.column(4).to_pylist(), strict=True):
                if name == node:
                    running.update(b",")
                else:
                    if node is not None:
                        done.append((*node, running.hexdigest()))
                    node, running = name, hashlib.sha256()
                running.update(ids.encode())
            if done:
                yield table(done)
        if node is not None:
            yield table([(*node, running.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
            names=[*NODE, "_sha"])

    key = "depth long, _n1 long, _n2 long"
    chunks = dealt.mapInArrow(chunk, f"{key}, _conv long, _ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(digest, f"{key}, _sha string")


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Turns go by number, null first, equal numbers by the digest of role and text; repeated rows are
    turns of their own. Null roles and texts are empty. Rows without a conversation id belong to none
    and make no node. Long texts count whole. No conversations give no rows; other columns are not read.
    """
    turns = materialize(rebuilt(df, conv_col, turn_col, role_col, text_col, family, heads), "rebuilt")
    blocks = materialize(blocks_of(turns), "blocks")
    found = materialize(rolled(blocks, "min(_conv) AS _owner, count(*) AS n_convs"), "found")
    kids = found.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("_p1").alias("_n1"), F.col("_p2").alias("_n2")).agg(
        F.count("*").alias("n_children"))
    own = (F.col("n_convs") - 1) * F.col("_words")
    nodes = materialize(found.join(kids, NODE, "left").select(
        *found.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), own.alias("_own")), "nodes")
    weights = nodes.groupBy(F.col("_owner").alias("_conv")).agg(
        F.sum("_own").alias("_o"), F.count_if(F.col("n_children") == 0).alias("_l"))
    zero = F.lit(0).cast("long")
    weighed = blocks.join(weights, "_conv", "left").select(
        *blocks.columns, F.coalesce("_o", zero).alias("_o"), F.coalesce("_l", zero).alias("_l"))
    # Below a node of one member nothing is shared, so only the others need their subtree's sums.
    sums = rolled(weighed, "sum(_o) AS _os, sum(_l) AS n_leaves, count(*) AS _n").where("_n > 1").select(
        *NODE, "_os", "n_leaves")
    above = before(nodes.where("n_convs > 1").select(*NODE, "_owner", "_own"), "_owner", "depth",
                   ["_own"], "sum").select(*NODE, "_b_own")
    wide = nodes.join(sums, NODE, "left").join(above, NODE, "left").join(ends_of(turns), NODE, "left")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("_n1").alias("_p1"),
                           F.col("_n2").alias("_p2"), F.col("_owner").alias("parent_conv_id"))
    return wide.join(parents, ["depth", "_p1", "_p2"], "left").select(
        F.col("_owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce(F.col("_os") - F.col("_b_own"), zero).alias("saved_tokens"),
        F.coalesce("_sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST,
    substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT conv_id, w, xor(list_reduce(list_prepend(4294967295,
      list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
        lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM own, crc_table
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.w, [])[1:a.h], a.w[a.h + 1:len(a.w)]) AS s
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
), member AS (
  SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt
), node AS (
  SELECT d, s[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = d), '') AS e,
    len(regexp_extract_all(coalesce(s[1:d][d].text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM member GROUP BY d, p, words
), below AS (
  SELECT x.d, x.conv_id, count(*) FILTER (WHERE y.d = x.d + 1) AS n_children,
    CAST(sum((y.n - 1) * y.words) AS BIGINT) AS saved_tokens
  FROM node x JOIN node y ON y.d >= x.d AND y.p[1:x.d] = x.p GROUP BY x.d, x.conv_id
), leaf AS (
  SELECT x.d, x.conv_id, count(*) AS n_leaves FROM node x JOIN node y ON y.d >= x.d AND y.p[1:x.d] = x.p
  JOIN below z ON z.d = y.d AND z.conv_id = y.conv_id WHERE z.n_children = 0 GROUP BY x.d, x.conv_id
)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n AS n_convs, b.n_children, l.n_leaves,
  b.saved_tokens, sha256(x.e) AS ends_sha256
FROM node x JOIN below b ON b.d = x.d AND b.conv_id = x.conv_id
JOIN leaf l ON l.d = x.d AND l.conv_id = x.conv_id
LEFT JOIN node u ON u.d = x.d - 1 AND x.p[1:u.d] = u.p
"""
