"""Table contracts. Each check returns the violating rows; `require` turns a row into an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.functions.keys import row_hash


class ContractError(ValueError):
    """A table broke its contract."""


def require(violations: DataFrame, message: str) -> None:
    """Fail closed: raise when the violations frame holds a row."""
    found = violations.take(3)
    if found:
        raise ContractError(f"{message}: {[r.asDict() for r in found]}")


def check_columns(df: DataFrame, expected: Sequence[str] | T.StructType) -> DataFrame:
    """Missing and extra columns, read from the schema alone."""
    names = expected.fieldNames() if isinstance(expected, T.StructType) else list(expected)
    rows = [("missing", c) for c in sorted(set(names) - set(df.columns))]
    rows += [("extra", c) for c in sorted(set(df.columns) - set(names))]
    return df.sparkSession.createDataFrame(rows, "rule string, column_name string")


def column_differences(df: DataFrame, expected: Sequence[str] | T.StructType) -> DataFrame:
    """Missing and extra columns with the rows that hold a value in them, which a rename would lose."""
    found = check_columns(df, expected)
    extra = [r["column_name"] for r in found.filter("rule = 'extra'").collect()]
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in extra])
    held = F.map_from_arrays(F.array(*[F.lit(c) for c in extra]).cast("array<string>"), F.array(
        *[F.col(f"`{c}`") for c in extra]).cast("array<bigint>"))
    return found.crossJoin(counts.select(F.col("_n").alias("row_count"), held.alias("_held"))).select(
        "rule", "column_name", F.coalesce(F.try_element_at("_held", "column_name"), F.lit(0).cast("bigint"))
        .alias("rows_with_value"), "row_count")


def column_profile(df: DataFrame, schema: T.StructType) -> DataFrame:
    """How a table's rows fill each column of a contract, in one pass.

    (column_name, kind, row_count, null_count, unconvertible_count, least, greatest): values that the
    contract's type cannot hold are counted, and the extremes are those of converted values, as text.
    A column that is not there is null in every row.
    """
    aggs, out = [F.count(F.lit(1)).alias("_n")], []
    for i, f in enumerate(schema.fields):
        raw = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType)
        value = raw.try_cast(f.dataType)
        aggs += [F.count_if(raw.isNull()).alias(f"_z{i}"),
                 F.count_if(raw.isNotNull() & value.isNull()).alias(f"_b{i}")]
        orderable = not isinstance(f.dataType, (T.ArrayType, T.MapType))
        for name, pick in (("_lo", F.min), ("_hi", F.max)):
            aggs.append((pick(value).cast("string") if orderable else F.max(
                F.lit(None).cast("string"))).alias(f"{name}{i}"))
        out.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("kind"),
            F.col("_n").alias("row_count"), F.col(f"_z{i}").alias("null_count"),
            F.col(f"_b{i}").alias("unconvertible_count"), F.col(f"_lo{i}").alias("least"),
            F.col(f"_hi{i}").alias("greatest")))
    return df.agg(*aggs).select(F.inline(F.array(*out)))


def count_rules(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Failing rows per rule in one pass. A rule is true for a good row; null counts as failing."""
    named = list(rules)
    aggs = [F.count_if(~F.coalesce(rules[n], F.lit(False))).alias(f"_r{i}")
            for i, n in enumerate(named)]
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("checked_rows"), *aggs)
    pairs = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"_r{i}").alias("failed_rows"))
        for i, n in enumerate(named)
    ])
    return totals.select(*by, "checked_rows", F.inline(pairs))


def check_rows(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    return count_rules(df, rules, by).filter(F.col("failed_rows") > 0)


def check_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return check_rows(df, {f"{c} not null": F.col(c).isNotNull() for c in cols})


def is_finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def is_sha256(c: str) -> Column:
    return F.col(c).rlike("^[0-9a-f]{64}$")


def observation_rules(unit: str | None = None) -> dict[str, Column]:
    """The rules every published observation must meet."""
    rules = {
        "value finite": is_finite("value"),
        "checksum form": is_sha256("checksum"),
        "vintage day is release day": F.to_date("release_date") == F.col("vintage_date"),
        "ingested after release": F.col("ingested_at") >= F.col("release_date"),
        "period before release": F.col("obs_period") < F.to_date("release_date"),
    }
    if unit is not None:
        rules["unit"] = F.col("unit") == unit
    return rules


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def check_coverage(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys expected but absent, and keys present but not expected."""
    have, want = df.select(*keys).distinct(), expected.select(*keys).distinct()
    missing = want.join(have, list(keys), "left_anti").withColumn("problem", F.lit("missing"))
    extra = have.join(want, list(keys), "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def check_group_shape(
    df: DataFrame,
    batch: Sequence[str],
    member: str,
    rows: int | None = None,
    rows_per_member: int | None = None,
    same: Sequence[str] = (),
) -> DataFrame:
    """Batches whose row count, rows per member or once-per-batch columns are off.

    Counts are taken per (batch, member) first, so one huge batch is spread over many tasks.
    """
    per_member = df.groupBy(*batch, member).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(f"_min_{c}") for c in same],
        *[F.max(c).alias(f"_max_{c}") for c in same],
    )
    per_batch = per_member.groupBy(*batch).agg(
        F.sum("n").alias("row_count"),
        F.count(F.lit(1)).alias("member_count"),
        F.min("n").alias("min_rows_per_member"),
        F.max("n").alias("max_rows_per_member"),
        *[(F.min(f"_min_{c}") != F.max(f"_max_{c}")).alias(f"{c}_differs") for c in same],
    )
    bad = F.lit(False)
    if rows is not None:
        bad = bad | (F.col("row_count") != rows)
    if rows_per_member is not None:
        bad = bad | (F.col("min_rows_per_member") != rows_per_member)
        bad = bad | (F.col("max_rows_per_member") != rows_per_member)
    for c in same:
        bad = bad | F.col(f"{c}_differs")
    return per_batch.filter(bad)


def check_same_periods(
    df: DataFrame,
    batch: Sequence[str],
    series: str,
    period: str,
    as_of: str | None = None,
    age_days: tuple[int, int] | None = None,
) -> DataFrame:
    """Batches whose series do not all hold the same periods, or whose latest period is too old.

    Equal sets means every (batch, period) is held by every series of the batch, so counting is
    enough and no set is collected.
    """
    pairs = df.groupBy(*batch, series, period).agg(
        *([F.max(as_of).alias("_as_of")] if as_of else [F.lit(None).alias("_as_of")])
    )
    per_period = pairs.groupBy(*batch, period).agg(
        F.count(F.lit(1)).alias("_held_by"), F.max("_as_of").alias("_as_of")
    )
    series_count = (
        pairs.groupBy(*batch, series).agg(F.lit(1).alias("_one"))
        .groupBy(*batch).agg(F.count(F.lit(1)).alias("series_count"))
    )
    per_batch = per_period.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("period_count"),
        F.min("_held_by").alias("_least_held"),
        F.max(period).alias("latest_period"),
        F.max("_as_of").alias("_as_of"),
    )
    joined = per_batch.join(series_count, list(batch))
    aligned = F.col("_least_held") == F.col("series_count")
    age = F.datediff(F.to_date("_as_of"), F.col("latest_period"))
    fresh = age.between(*age_days) if age_days else F.lit(True)
    return joined.select(
        *batch, "series_count", "period_count", "latest_period",
        aligned.alias("aligned"), fresh.alias("fresh"),
    ).filter(~(F.col("aligned") & F.col("fresh")))


def check_snapshot_honesty(
    df: DataFrame, release: str = "release_date", ingested: str = "ingested_at"
) -> DataFrame:
    """A revised snapshot has no invented history: it was released when it was taken."""
    return df.filter(~F.col(release).eqNullSafe(F.col(ingested)))


def new_batches(
    incoming: DataFrame, stored: DataFrame, identity: Sequence[str] = ("source_url", "checksum")
) -> DataFrame:
    return incoming.join(stored.select(*identity).distinct(), list(identity), "left_anti")


def batch_conflicts(
    incoming: DataFrame,
    stored: DataFrame,
    identity: Sequence[str] = ("source_url", "checksum"),
    cols: Sequence[str] | None = None,
) -> DataFrame:
    """Rows that differ, as multisets, between batches of the same identity on both sides."""
    names = list(cols or incoming.columns)
    shared = incoming.select(*identity).distinct().join(
        stored.select(*identity).distinct(), list(identity)
    )
    a = incoming.select(*names).join(shared, list(identity), "left_semi").select(*names)
    b = stored.select(*names).join(shared, list(identity), "left_semi").select(*names)
    net = (
        a.withColumn("_w", F.lit(1)).unionByName(b.withColumn("_w", F.lit(-1)))
        .groupBy(*names).agg(F.sum("_w").alias("surplus")).filter("surplus <> 0")
    )
    side = F.when(F.col("surplus") > 0, "incoming").otherwise("stored")
    return net.select(*names, side.alias("only_in"), F.abs("surplus").alias("row_count"))


def check_registry_match(
    df: DataFrame, registry: DataFrame, key: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Attributes that differ from the registry (null equals null), and unregistered keys."""
    named = registry.select(*key, *[F.col(c).alias(f"_want_{c}") for c in cols],
                            F.lit(True).alias("_known"))
    joined = df.select(*key, *cols).join(named, list(key), "left")
    problems = F.array(
        F.when(F.col("_known").isNull(), F.lit("unregistered")),
        *[F.when(F.col("_known") & ~F.col(c).eqNullSafe(F.col(f"_want_{c}")), F.lit(c))
          for c in cols],
    )
    return joined.select(*key, F.explode(F.array_compact(problems)).alias("problem"))


def check_component_sum(
    df: DataFrame, total: str, parts: Sequence[str], tolerance: float = 0.0
) -> DataFrame:
    residual = F.col(total)
    for p in parts:
        residual = residual - F.col(p)
    return df.withColumn("residual", residual).filter(
        F.col("residual").isNull() | (F.abs("residual") > tolerance)
    )


def range_summary(
    df: DataFrame, source: str, series: str, period: str, release: str
) -> DataFrame:
    """Rows, latest period and release range per source and per series, from one pass."""
    per_series = df.groupBy(source, series).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(period).alias("p"),
        F.min(release).alias("r0"),
        F.max(release).alias("r1"),
    )
    return per_series.rollup(source, series).agg(
        F.sum("n").alias("row_count"),
        F.max("p").alias("latest_period"),
        F.min("r0").alias("first_release"),
        F.max("r1").alias("last_release"),
    ).filter(F.col(source).isNotNull())


def append_only_superset(
    old: DataFrame, new: DataFrame, key: Sequence[str], cols: Sequence[str] | None = None
) -> DataFrame:
    """How each record moved from old to new: added is fine, deleted or changed is not."""
    names = sorted(cols or [c for c in old.columns if c not in key])
    a = old.select(*key, row_hash(names).alias("_old"))
    b = new.select(*key, row_hash(names).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "deleted")
        .when(F.col("_old") != F.col("_new"), "changed")
    )
    return a.join(b, list(key), "full_outer").select(*key, change.alias("change")).filter(
        F.col("change").isNotNull()
    )


def check_ledger_relations(
    predictions: DataFrame, grades: DataFrame, publications: DataFrame, key: str = "prediction_id"
) -> DataFrame:
    """Grades must be a subset of predictions; publications must equal them."""
    p, g, u = (d.select(key).distinct() for d in (predictions, grades, publications))

    def tag(d: DataFrame, problem: str) -> DataFrame:
        return d.withColumn("problem", F.lit(problem))

    return (
        tag(g.join(p, key, "left_anti"), "grade without prediction")
        .unionByName(tag(u.join(p, key, "left_anti"), "publication without prediction"))
        .unionByName(tag(p.join(u, key, "left_anti"), "prediction not published"))
    )


def snapshot_diff(
    current: DataFrame, pinned: DataFrame, key: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Members added, removed or changed since the pinned snapshot."""
    moved = append_only_superset(pinned, current, key, cols)
    return moved.withColumn(
        "change", F.when(F.col("change") == "deleted", "removed").otherwise(F.col("change"))
    )


def partition_check(
    universe: DataFrame, included: DataFrame, excluded: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Included and excluded must be disjoint and together make the universe."""
    keys = list(key)
    tagged = (
        universe.select(*keys).withColumn("_u", F.lit(1)).withColumn("_m", F.lit(0))
        .unionByName(included.select(*keys).withColumn("_u", F.lit(0)).withColumn("_m", F.lit(1)))
        .unionByName(excluded.select(*keys).withColumn("_u", F.lit(0)).withColumn("_m", F.lit(1)))
    )
    seen = tagged.groupBy(*keys).agg(F.sum("_u").alias("_u"), F.sum("_m").alias("_m"))
    problem = (
        F.when(F.col("_u") == 0, "outside universe")
        .when(F.col("_m") == 0, "unassigned")
        .when(F.col("_m") > 1, "assigned twice")
    )
    return seen.select(*keys, problem.alias("problem")).filter(F.col("problem").isNotNull())


def check_lag_order(df: DataFrame, key: Sequence[str], order: Sequence[str], col: str) -> DataFrame:
    """Rows whose `col` does not rise strictly within the key; keys here are short by contract."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("previous", F.lag(col).over(w)).filter(F.col(col) <= F.col("previous"))
