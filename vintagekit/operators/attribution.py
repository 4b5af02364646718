"""Uncertainty carried through two weight matrices from flows to companies.

Frames: flows(product, quarter, low, mid, high), matrix_a(product, category, tier, low, mid, high,
assumption_id), matrix_b(category, ticker, low, mid, high, assumption_id or null),
companies(ticker, company_name, revenue_millions, share_assumption_id),
assumptions(assumption_id, low, mid, high, tier, ...).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagekit.functions import keys as k
from vintagekit.operators import pit
from vintagekit.operators.quantiles import exact_quantile
from vintagekit.session import materialize

# Fixed values.
MIN_DRAWS = 10_000
DRAW_BLOCK = 1_000
TIERS = (1, 2, 3)
QUANTILES = (0.1, 0.5, 0.9)
CRITICAL_SHARE = 0.05
SUM_SLACK_A = 1e-12
SUM_SLACK_B = 1e-9
DRIFT_TOLERANCE = 1e-12
MIDPOINT_TOLERANCE = 5e-13
ANNUAL_DAYS = (300, 430)
PRIOR_GAP_DAYS = (330, 400)
DURATION_SLACK_DAYS = 14
TTM_RATIO = (0.25, 2.5)
FLOW_PREFIX = "flow:"


# ---- bundle checks --------------------------------------------------------------------------

def _prior_ok() -> Column:
    finite = [~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in ("low", "mid", "high")]
    ordered = (F.col("low") <= F.col("mid")) & (F.col("mid") <= F.col("high"))
    return F.coalesce(finite[0] & finite[1] & finite[2] & ordered, F.lit(False))


def check_bundle(
    assumptions: DataFrame, flows: DataFrame, matrix_a: DataFrame, matrix_b: DataFrame,
    companies: DataFrame,
) -> DataFrame:
    """Everything wrong with a set of inputs, as (rule, key)."""

    def bad(df: DataFrame, rule: str, key: Column | str, when: Column) -> DataFrame:
        key = F.col(key) if isinstance(key, str) else key
        return df.filter(~F.coalesce(when, F.lit(False))).select(
            F.lit(rule).alias("rule"), key.cast("string").alias("key"))

    def repeated(df: DataFrame, rule: str, *cols: str) -> DataFrame:
        return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            F.lit(rule).alias("rule"), F.concat_ws("/", *cols).alias("key"))

    def over_one(df: DataFrame, rule: str, col: str, bounds: Sequence[str], slack: float):
        sums = df.groupBy(col).agg(*[F.sum(b).alias(b) for b in bounds])
        worst = F.greatest(*bounds) if len(bounds) > 1 else F.col(bounds[0])
        return sums.filter(worst > 1 + slack).select(F.lit(rule).alias("rule"),
                                                     F.col(col).cast("string").alias("key"))

    def unknown(df: DataFrame, rule: str, col: str, known: DataFrame, known_col: str):
        k_ = known.select(F.col(known_col).alias(col)).distinct()
        return df.select(col).filter(F.col(col).isNotNull()).distinct().join(
            k_, col, "left_anti").select(F.lit(rule).alias("rule"),
                                         F.col(col).cast("string").alias("key"))

    def mismatched(df: DataFrame, rule: str, key: Column) -> DataFrame:
        reg = assumptions.select("assumption_id", *[F.col(c).alias(f"_{c}") for c in
                                                    ("low", "mid", "high")])
        j = df.join(reg, "assumption_id")
        same = (F.col("low") == F.col("_low")) & (F.col("mid") == F.col("_mid")) & (
            F.col("high") == F.col("_high"))
        return bad(j, rule, key, same)

    a_key, b_key = F.concat_ws("/", "product", "category"), F.concat_ws("/", "category", "ticker")
    parts = [
        bad(assumptions, "assumption prior", "assumption_id", _prior_ok()),
        bad(assumptions, "assumption tier", "assumption_id", F.col("tier").isin(*TIERS)),
        repeated(assumptions, "assumption repeated", "assumption_id"),
        bad(flows, "flow prior", "product", _prior_ok()),
        repeated(flows, "flow repeated", "product"),
        flows.agg(F.count_distinct("quarter").alias("n")).filter("n > 1").select(
            F.lit("several quarters").alias("rule"), F.col("n").cast("string").alias("key")),
        bad(matrix_a, "matrix A prior", a_key, _prior_ok() & (F.col("low") >= 0)),
        repeated(matrix_a, "matrix A repeated", "product", "category"),
        unknown(matrix_a, "matrix A without flow", "product", flows, "product"),
        unknown(matrix_a, "matrix A without assumption", "assumption_id", assumptions,
                "assumption_id"),
        over_one(matrix_a, "matrix A above one", "product", ("low", "mid", "high"), SUM_SLACK_A),
        mismatched(matrix_a, "matrix A differs from assumption", a_key),
        bad(matrix_b, "matrix B prior", b_key, _prior_ok() & (F.col("low") >= 0)),
        repeated(matrix_b, "matrix B repeated", "category", "ticker"),
        unknown(matrix_b, "matrix B without matrix A", "category", matrix_a, "category"),
        unknown(matrix_b, "matrix B without company", "ticker", companies, "ticker"),
        bad(matrix_b, "matrix B band without assumption", b_key,
            F.col("assumption_id").isNotNull() | (F.col("low") == F.col("high"))),
        unknown(matrix_b, "matrix B without assumption", "assumption_id", assumptions,
                "assumption_id"),
        over_one(matrix_b, "matrix B above one", "category", ("high",), SUM_SLACK_B),
        mismatched(matrix_b, "matrix B differs from assumption", b_key),
        repeated(companies, "company repeated", "ticker"),
        unknown(companies, "company not covered", "ticker", matrix_b, "ticker"),
        unknown(companies, "company without share", "share_assumption_id", assumptions,
                "assumption_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Fixed value: the longest excerpt, in words.
EXCERPT_WORDS = 15


def check_evidence(
    df: DataFrame, key: str, required: Sequence[str], pair: tuple[str, str] | None = None
) -> DataFrame:
    """Rows lacking evidence text, as (rule, key).

    `pair` names an address and its excerpt: both or neither, and the excerpt stays short.
    """
    def empty(c: str) -> Column:
        return F.coalesce(F.trim(c) == "", F.lit(True))

    found = [F.when(empty(c), F.lit(f"{c} missing")) for c in required]
    if pair is not None:
        url, text = pair
        found.append(F.when(empty(url) != empty(text), F.lit("address and excerpt go together")))
        words = F.size(F.split(F.trim(text), r"\s+"))
        found.append(F.when(~empty(text) & (words > EXCERPT_WORDS), F.lit("excerpt too long")))
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("rule"),
                     F.col(key).cast("string").alias("key"))


def resolve_sources(
    assumptions: DataFrame, sources: DataFrame, unavailable: Sequence[str] = (),
    fallbacks: DataFrame | None = None,
) -> DataFrame:
    """The source each assumption rests on, with its band widened when that is a fallback.

    `assumptions` adds primary_source_id, fallback_source_ids and band_multiplier; `sources` holds
    source_id, independent_group, terms_status, available. Fallbacks count in their given order,
    and only those of another group than the primary. None left is BLOCKED. Long lists come as
    `fallbacks` (assumption_id, position, source_id) in place of the array column.
    """
    usable = F.col("available") & (F.col("terms_status") == "PERMITTED")
    if unavailable:
        usable = usable & ~F.col("source_id").isin(list(unavailable))
    src = sources.select("source_id", "independent_group", usable.alias("_ok"))
    primary = assumptions.join(
        src.select(F.col("source_id").alias("primary_source_id"),
                   F.col("independent_group").alias("_group"), F.col("_ok").alias("_primary_ok")),
        "primary_source_id", "left")
    failing = primary.filter(~F.coalesce("_primary_ok", F.lit(False)))
    if fallbacks is None:
        ahead = failing.select("assumption_id", "_group", F.posexplode("fallback_source_ids")
                               .alias("_pos", "source_id"))
    else:
        ahead = failing.select("assumption_id", "_group").join(
            fallbacks.select("assumption_id", F.col("position").alias("_pos"), "source_id"),
            "assumption_id")
    fallback = ahead.join(src.filter("_ok"), "source_id").filter(
        F.col("independent_group") != F.col("_group")).groupBy("assumption_id").agg(
        F.min_by("source_id", "_pos").alias("_fallback"))
    rows = primary.join(fallback, "assumption_id", "left")
    m, mid = F.col("band_multiplier"), F.col("mid")
    low = F.greatest(F.lit(0.0), mid - (mid - F.col("low")) * m)
    high = F.least(F.lit(1.0), mid + (F.col("high") - mid) * m)
    ok, fell = F.coalesce("_primary_ok", F.lit(False)), F.col("_fallback").isNotNull()
    keep = [c for c in assumptions.columns if c not in ("low", "high")]
    return rows.select(
        *keep,
        F.when(~ok & fell, low).otherwise(F.col("low")).alias("low"),
        F.when(~ok & fell, high).otherwise(F.col("high")).alias("high"),
        F.when(ok, F.col("primary_source_id")).otherwise(F.col("_fallback"))
        .alias("active_source_id"),
        F.when(ok, "PRIMARY").when(fell, "FALLBACK").otherwise("BLOCKED").alias("source_status"),
    )


def source_violations(
    assumptions: DataFrame, sources: DataFrame, resolved: DataFrame,
    fallbacks: DataFrame | None = None,
) -> DataFrame:
    """Everything that forbids a run on these sources, as (rule, key).

    A source listed twice, one that is available without permission, a primary or fallback that is not
    registered, a fallback named twice, and assumptions that are left without a source. Takes the
    inputs and the output of `resolve_sources`.
    """
    if fallbacks is None:
        fallbacks = assumptions.select(
            "assumption_id", F.posexplode("fallback_source_ids").alias("position", "source_id"))
    known = sources.select("source_id").distinct()

    def found(df: DataFrame, rule: str, key: str) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))

    def repeated(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

    primary = assumptions.select("assumption_id", F.col("primary_source_id").alias("source_id"))
    banned = sources.filter(F.col("available") & ~F.coalesce(
        F.col("terms_status") == "PERMITTED", F.lit(False)))
    parts = [
        found(repeated(sources, "source_id"), "source listed twice", "source_id"),
        found(banned, "available without permission", "source_id"),
        found(primary.join(known, "source_id", "left_anti"), "primary not registered", "assumption_id"),
        found(fallbacks.join(known, "source_id", "left_anti"), "fallback not registered",
              "assumption_id").distinct(),
        found(repeated(fallbacks, "assumption_id", "source_id"), "fallback named twice",
              "assumption_id").distinct(),
        found(resolved.filter("source_status = 'BLOCKED'"), "BLOCKED", "assumption_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- draws and bands ------------------------------------------------------------------------

def all_priors(assumptions: DataFrame, flows: DataFrame) -> DataFrame:
    """Assumption and flow priors in one frame, flows under their own ids.

    Resolved assumptions carry a source status; one that is BLOCKED stops the run.
    """
    low = F.col("low")
    if "source_status" in assumptions.columns:
        stop = F.raise_error(F.concat(F.lit("BLOCKED: no source left for "), "assumption_id"))
        low = F.when(F.col("source_status") == "BLOCKED", stop.cast("double")).otherwise(low)
    a = assumptions.select("assumption_id", low.alias("low"), "mid", "high")
    f = flows.select(F.concat(F.lit(FLOW_PREFIX), "product").alias("assumption_id"), "low", "mid",
                     "high")
    return a.unionByName(f)


def draw_blocks(
    priors: DataFrame, n: int, seed: int, minimum: int = MIN_DRAWS, size: int = DRAW_BLOCK
) -> DataFrame:
    """n draws per prior as arrays of up to `size`: (assumption_id, block, values).

    Each number comes from a hash of seed, id and draw, so adding a prior changes no other draw and
    a lost task recomputes the same numbers, whatever the block size. low = high is constant.
    """
    if n < minimum or seed < 0:
        raise ValueError(f"need at least {minimum} draws and a non-negative seed")
    spread = int(priors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.sequence(F.lit(0), F.lit((n - 1) // size))
    rows = priors.withColumn("block", F.explode(blocks)).repartition(spread, "assumption_id", "block")
    first = F.col("block") * size + 1
    draws = F.sequence(first, F.least(first + size - 1, F.lit(n)))
    low, mid, high = F.col("low"), F.col("mid"), F.col("high")
    width = high - low

    def triangle(u: Column) -> Column:
        left = low + F.sqrt(u * width * (mid - low))
        right = high - F.sqrt((1 - u) * width * (high - mid))
        return F.when(low == high, mid).when(u * width < mid - low, left).otherwise(right)

    us = F.transform(draws, lambda d: k.uniform(F.lit(seed), "assumption_id", d))
    return rows.select("assumption_id", "block", F.transform(us, triangle).alias("values"))


def long_draws(blocks: DataFrame, size: int = DRAW_BLOCK) -> DataFrame:
    """The draws of blocks one a row: (assumption_id, draw, value)."""
    return blocks.select("assumption_id", "block", F.posexplode("values").alias("_pos", "value")).select(
        "assumption_id", (F.col("block") * size + F.col("_pos") + 1).alias("draw"), "value")


def triangular_draws(
    priors: DataFrame, n: int, seed: int, minimum: int = MIN_DRAWS
) -> DataFrame:
    """n draws per prior, one a row (assumption_id, draw, value)."""
    return long_draws(draw_blocks(priors, n, seed, minimum))


def _summed(arrays: Column) -> Column:
    """Element-wise sum of arrays of one length over a group; partial sums combine on the map side."""
    return vector_to_array(Summarizer.sum(array_to_vector(arrays)))


def _zeros(like: str) -> Column:
    return F.transform(like, lambda _: F.lit(0.0))


def _kept(when: Column, arrays: str) -> Column:
    return F.when(when, F.col(arrays)).otherwise(_zeros(arrays))


def contributions(
    flows: DataFrame, matrix_a: DataFrame, matrix_b: DataFrame, blocks: DataFrame
) -> DataFrame:
    """Amounts per (category, tier, ticker, block) of draws.

    The sum over products does not depend on the company, so it is taken first. Draws are shared, so
    the same assumption moves every company together. A constant weight stands only where no
    assumption is named; a named one without draws stops the run.
    """
    fd = flows.select("product", F.concat(F.lit(FLOW_PREFIX), "product").alias("assumption_id")
                      ).join(blocks, "assumption_id").select(
        "product", "block", F.col("values").alias("_f"))
    ad = matrix_a.select("product", "category", "tier", "assumption_id").join(
        blocks, "assumption_id").select("product", "category", "tier", "block",
                                        F.col("values").alias("_a"))
    per_category = ad.join(fd, ["product", "block"]).groupBy("category", "tier", "block").agg(
        _summed(F.zip_with("_a", "_f", lambda a, f: a * f)).alias("_amounts"))
    fixed = per_category.join(
        matrix_b.filter("assumption_id is null").select("category", "ticker", "mid"), "category"
    ).select("category", "tier", "ticker", "block",
             F.transform("_amounts", lambda x: x * F.col("mid")).alias("amounts"))
    undrawn = F.raise_error(F.concat(F.lit("no draws for assumption "), F.col("assumption_id")))
    moving = matrix_b.filter("assumption_id is not null").select(
        "category", "ticker", "assumption_id").join(blocks, "assumption_id", "left").select(
        "category", "ticker", F.coalesce("block", undrawn.cast("int")).alias("block"), "values")
    moved = per_category.join(moving, ["category", "block"]).select(
        "category", "tier", "ticker", "block",
        F.zip_with("_amounts", "values", lambda x, v: x * v).alias("amounts"))
    return fixed.unionByName(moved)


def company_ratios(
    contrib: DataFrame, companies: DataFrame, blocks: DataFrame, broad: Sequence[str] = ()
) -> DataFrame:
    """Numerators, broad-category numerators, denominators and percents per (ticker, block)."""
    num = contrib.groupBy("ticker", "block").agg(
        _summed(F.col("amounts")).alias("numerator"),
        _summed(_kept(F.col("category").isin(list(broad)), "amounts")).alias("broad_numerator"))
    den = companies.select("ticker", "revenue_millions",
                           F.col("share_assumption_id").alias("assumption_id")).join(
        blocks, "assumption_id").select(
        "ticker", "block", F.transform("values", lambda v: F.col("revenue_millions") / 4 * v)
        .alias("denominator"))
    rows = den.join(num, ["ticker", "block"], "left").withColumns({
        c: F.coalesce(c, _zeros("denominator")) for c in ("numerator", "broad_numerator")})
    return rows.withColumns({
        out: F.zip_with(c, "denominator", lambda n, d: n / d * 100)
        for out, c in (("ratio", "numerator"), ("broad_ratio", "broad_numerator"))})


def _all_draws(arrays: str) -> Column:
    """A group's draws, sorted: as many numbers as the caller asked to draw."""
    return F.sort_array(F.flatten(F.collect_list(arrays)))


def _quantile(ordered: str, q: float) -> Column:
    """Linear quantile of a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def company_bands(ratios: DataFrame, q: Sequence[float] = QUANTILES) -> DataFrame:
    """Linear quantiles of the ratio per company, with the midpoints of both parts."""
    parts = ("ratio", "numerator", "denominator")
    rows = ratios.groupBy("ticker").agg(*[_all_draws(c).alias(c) for c in parts])
    return rows.select(
        "ticker", *[_quantile("ratio", x).alias(name) for x, name in
                    zip(q, ("low", "mid", "high"), strict=True)],
        *[_quantile(c, 0.5).alias(f"{c}_mid") for c in parts[1:]])


def baseline_and_lift(
    ratios: DataFrame, matrix_b: DataFrame, broad: Sequence[str]
) -> DataFrame:
    """Midpoint from broad categories alone, and how far the full one lies above it."""
    mids = ratios.groupBy("ticker").agg(
        *[_all_draws(c).alias(c) for c in ("ratio", "broad_ratio")]).select(
        "ticker", _quantile("ratio", 0.5).alias("mid"),
        _quantile("broad_ratio", 0.5).alias("baseline_mid"))
    specific = matrix_b.groupBy("ticker").agg(
        F.bool_or(~F.col("category").isin(list(broad))).alias("_specific"))
    return mids.join(specific, "ticker", "left").select(
        "ticker", "mid", "baseline_mid",
        F.when(F.col("baseline_mid") > 0, F.col("mid") / F.col("baseline_mid")).alias("lift"),
        F.when(F.col("_specific"), "evidence-supported").otherwise("baseline-only")
        .alias("lift_status"))


def invalid_lift(lifts: DataFrame) -> DataFrame:
    return lifts.filter(F.col("lift").isNull() | F.isnan("lift") | (F.col("lift") < 1))


def result_violations(ratios: DataFrame, bands: DataFrame, lifts: DataFrame) -> DataFrame:
    """What no result may hold, as (rule, ticker): denominators that are not positive, quantiles out
    of order or not finite, lifts below one or absent."""
    bad_draw = F.exists("denominator", lambda d: ~F.coalesce((d > 0) & (d < float("inf")), F.lit(False)))
    low, mid, high = F.col("low"), F.col("mid"), F.col("high")
    finite = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in (low, mid, high)]
    ordered = (low <= mid) & (mid <= high) & finite[0] & finite[1] & finite[2]
    return ratios.filter(bad_draw).select(F.lit("denominator").alias("rule"), "ticker").distinct() \
        .unionByName(bands.filter(~F.coalesce(ordered, F.lit(False)))
                     .select(F.lit("quantiles").alias("rule"), "ticker")) \
        .unionByName(invalid_lift(lifts).select(F.lit("lift").alias("rule"), "ticker"))


def tier_shares(contrib: DataFrame, entity: Sequence[str] = ("ticker",)) -> DataFrame:
    """Share of each tier's median contribution; a tier absent from a draw counts as zero there."""
    per_draw = contrib.groupBy(*entity, "block").agg(*[
        _summed(_kept(F.col("tier") == t, "amounts")).alias(f"_t{t}") for t in TIERS])
    mids = per_draw.groupBy(*entity).agg(*[_all_draws(f"_t{t}").alias(f"_t{t}") for t in TIERS])
    mids = mids.select(*entity, *[_quantile(f"_t{t}", 0.5).alias(f"_m{t}") for t in TIERS])
    total = F.col("_m1") + F.col("_m2") + F.col("_m3")
    s1, s2 = F.col("_m1") / total, F.col("_m2") / total
    return mids.select(*entity, s1.alias("tier1_share"), s2.alias("tier2_share"),
                       (1 - s1 - s2).alias("tier3_share"))


def aggregate_band(ratios: DataFrame, q: Sequence[float] = QUANTILES) -> DataFrame:
    """Band of the summed numerators over the summed denominators: revenue-weighted."""
    per_draw = ratios.groupBy("block").agg(
        _summed(F.col("numerator")).alias("n"), _summed(F.col("denominator")).alias("d")).withColumn(
        "r", F.zip_with("n", "d", lambda n, d: n / d * 100))
    rows = per_draw.agg(*[_all_draws(c).alias(c) for c in ("r", "n", "d")])
    return rows.select(
        *[_quantile("r", x).alias(name) for x, name in zip(q, ("low", "mid", "high"), strict=True)],
        _quantile("n", 0.5).alias("numerator_mid"), _quantile("d", 0.5).alias("denominator_mid"))


def used_assumptions(
    matrix_a: DataFrame, matrix_b: DataFrame, companies: DataFrame
) -> DataFrame:
    """Which assumptions reach which company: by matrix A, matrix B or the consumer share."""
    via_a = matrix_b.select("category", "ticker").join(
        matrix_a.select("category", "assumption_id"), "category").select("ticker", "assumption_id")
    via_b = matrix_b.select("ticker", "assumption_id").filter("assumption_id is not null")
    share = companies.select("ticker", F.col("share_assumption_id").alias("assumption_id"))
    return via_a.unionByName(via_b).unionByName(share).distinct()


def _moments(blocks: DataFrame, key: str, arrays: str, name: str) -> DataFrame:
    """A block's draws as differences from their mean, with count, mean, squares and extremes."""
    mean = F.aggregate(arrays, F.lit(0.0), lambda s, v: s + v) / F.size(arrays)
    centred = blocks.select(key, "block", F.col(arrays).alias("_v"), mean.alias(f"_m{name}")).select(
        key, "block", f"_m{name}", F.array_min("_v").alias(f"_lo{name}"),
        F.array_max("_v").alias(f"_hi{name}"), F.size("_v").alias(f"_n{name}"),
        F.transform("_v", lambda v: v - F.col(f"_m{name}")).alias(f"_d{name}"))
    return centred.withColumn(
        f"_q{name}", F.aggregate(f"_d{name}", F.lit(0.0), lambda s, v: s + v * v))


def sensitivity_top_k(
    ratios: DataFrame, blocks: DataFrame, used: DataFrame, top: int = 5
) -> DataFrame:
    """Each company's strongest correlations of draws with its ratio.

    A block of draws gives its co-moments about its own means; blocks merge by the spread of their
    means. A constant on either side has no correlation and is left out.
    """
    x, y = _moments(blocks, "assumption_id", "values", "x"), _moments(ratios, "ticker", "ratio", "y")
    cross = F.aggregate(F.zip_with("_dx", "_dy", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    pairs = used.join(y, "ticker").join(x, ["assumption_id", "block"]).select(
        "ticker", "assumption_id", "block", F.col("_nx").alias("_n"), "_mx", "_my", "_qx", "_qy",
        cross.alias("_qxy"), "_lox", "_hix", "_loy", "_hiy")
    n, mx, my = F.col("_n"), F.col("_mx"), F.col("_my")

    def merged(inner: str, a: Column, b: Column) -> Column:
        return F.sum(inner) + F.sum(n * a * b) - F.sum(n * a) * F.sum(n * b) / F.sum(n)

    scored = pairs.groupBy("ticker", "assumption_id").agg(
        merged("_qxy", mx, my).alias("_xy"), merged("_qx", mx, mx).alias("_xx"),
        merged("_qy", my, my).alias("_yy"), F.min("_lox").alias("_lox"), F.max("_hix").alias("_hix"),
        F.min("_loy").alias("_loy"), F.max("_hiy").alias("_hiy"))
    scored = scored.filter("_lox < _hix and _loy < _hiy and _xx > 0 and _yy > 0").withColumn(
        "_c", F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))).filter(~F.isnan("_c"))
    w = Window.partitionBy("ticker").orderBy(F.desc("absolute_correlation"), "assumption_id")
    return scored.select(
        "ticker", "assumption_id", F.abs("_c").alias("absolute_correlation"),
        F.when(F.col("_c") >= 0, "increases").otherwise("decreases").alias("direction"),
    ).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def lift_headline(lifts: DataFrame) -> DataFrame:
    """The company with the greatest (lift, ticker), beside the exact median lift."""
    stored = materialize(lifts.select("ticker", "lift"), "lifts")
    return stored.agg(F.max(F.struct("lift", "ticker")).alias("_top")).select(
        F.col("_top.ticker").alias("ticker"), F.col("_top.lift").alias("lift"),
        F.lit(exact_quantile(stored, "lift", 0.5)).cast("double").alias("median_lift"))


def midpoint_amounts(flows: DataFrame, matrix_a: DataFrame, matrix_b: DataFrame) -> DataFrame:
    """Midpoint amount per (product, category, tier, ticker)."""
    a = matrix_a.select("product", "category", "tier", F.col("mid").alias("_a"))
    f = flows.select("product", F.col("mid").alias("_f"))
    b = matrix_b.select("category", "ticker", F.col("mid").alias("_b"))
    return a.join(f, "product").join(b, "category").select(
        "product", "category", "tier", "ticker",
        (F.col("_f") * F.col("_a") * F.col("_b")).alias("amount"))


def midpoint_estimate(
    flows: DataFrame, matrix_a: DataFrame, matrix_b: DataFrame, companies: DataFrame,
    assumptions: DataFrame,
) -> DataFrame:
    """The formula at midpoints, without draws."""
    num = midpoint_amounts(flows, matrix_a, matrix_b).groupBy("ticker").agg(
        F.sum("amount").alias("numerator"))
    share = assumptions.select(F.col("assumption_id").alias("share_assumption_id"),
                               F.col("mid").alias("_s"))
    den = companies.join(share, "share_assumption_id").select(
        "ticker", (F.col("revenue_millions") / 4 * F.col("_s")).alias("denominator"))
    return den.join(num, "ticker", "left").fillna(0.0, ["numerator"]).withColumn(
        "estimate", F.col("numerator") / F.col("denominator") * 100)


def recompute_gaps(estimates: DataFrame, bands: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Companies whose midpoint estimate and band middle are further apart than allowed."""
    return estimates.select("ticker", "estimate").join(
        bands.select("ticker", "mid"), "ticker", "full_outer").filter(
        F.col("mid").isNull() | F.col("estimate").isNull()
        | (F.abs(F.col("mid") - F.col("estimate")) > tolerance))


def criticality(
    flows: DataFrame, matrix_a: DataFrame, matrix_b: DataFrame, companies: DataFrame,
    assumptions: DataFrame, sources: DataFrame, cut: float = CRITICAL_SHARE,
) -> DataFrame:
    """Share of the midpoint numerator and denominator that rests on each assumption."""
    f = flows.select("product", F.col("mid").alias("_f"))
    a = matrix_a.select("product", "category", F.col("assumption_id").alias("_aid"),
                        F.col("mid").alias("_a"))
    b = matrix_b.select("category", F.col("assumption_id").alias("_bid"), F.col("mid").alias("_b"))
    amounts = a.join(f, "product").join(b, "category").select(
        F.array_compact(F.array("_aid", "_bid")).alias("_ids"),
        (F.col("_f") * F.col("_a") * F.col("_b")).alias("amount"))
    num = amounts.select(F.explode("_ids").alias("assumption_id"), "amount").groupBy(
        "assumption_id").agg(F.sum("amount").alias("_n"))
    share = assumptions.select(F.col("assumption_id").alias("share_assumption_id"),
                               F.col("mid").alias("_s"))
    values = companies.join(share, "share_assumption_id").select(
        F.col("share_assumption_id").alias("assumption_id"),
        (F.col("revenue_millions") / 4 * F.col("_s")).alias("_v"))
    den = values.groupBy("assumption_id").agg(F.sum("_v").alias("_d"))
    independent = independent_fallbacks(assumptions, sources)
    total_n = amounts.agg(F.sum("amount")).scalar()
    total_d = values.agg(F.sum("_v")).scalar()
    rows = assumptions.select("assumption_id").join(num, "assumption_id", "left").join(
        den, "assumption_id", "left").join(independent, "assumption_id", "left").fillna(
        0, ["_n", "_d", "independent_fallbacks"])
    rows = rows.withColumns({"numerator_share": F.col("_n") / total_n,
                             "denominator_share": F.col("_d") / total_d})
    rows = rows.withColumn("share", F.greatest("numerator_share", "denominator_share"))
    critical = F.col("share") >= cut
    return rows.select(
        "assumption_id", F.when(critical, "CRITICAL").otherwise("NONCRITICAL").alias("rating"),
        "share", "numerator_share", "denominator_share", "independent_fallbacks",
        (critical & (F.col("independent_fallbacks") == 0)).alias("warning"))


def independent_fallbacks(assumptions: DataFrame, sources: DataFrame) -> DataFrame:
    """Registered fallbacks of another group than the primary, counted per assumption."""
    src = sources.select("source_id", "independent_group")
    primary = src.select(F.col("source_id").alias("primary_source_id"),
                         F.col("independent_group").alias("_group"))
    asked = assumptions.select("assumption_id", "primary_source_id",
                               F.explode("fallback_source_ids").alias("source_id"))
    return asked.join(primary, "primary_source_id").join(src, "source_id").filter(
        F.col("independent_group") != F.col("_group")).groupBy("assumption_id").agg(
        F.count(F.lit(1)).alias("independent_fallbacks"))


def criticality_drift(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Stored ratings or shares that differ from computed ones, and ids on one side only."""
    s = stored.select("assumption_id", F.col("rating").alias("_r"), F.col("share").alias("_s"))
    j = computed.select("assumption_id", "rating", "share").join(s, "assumption_id", "full_outer")
    problem = (
        F.when(F.col("_r").isNull(), "not stored").when(F.col("rating").isNull(), "not computed")
        .when(F.col("_r") != F.col("rating"), "rating")
        .when(F.abs(F.col("_s") - F.col("share")) > DRIFT_TOLERANCE, "share"))
    return j.select("assumption_id", problem.alias("problem")).filter("problem is not null")


# ---- shares and weights ---------------------------------------------------------------------

def leave_one_out_share(
    df: DataFrame, key: str, amount: str, covered: str, group: Sequence[str] = ()
) -> DataFrame:
    """Covered share of the total per group, and its range when any one member is dropped.

    Only the member with the greatest or least effect matters, yet every member is tried: totals
    come from an aggregate and are joined back, so no group is held in one task.
    """
    members = df.groupBy(*group, key).agg(
        F.sum(amount).cast("double").alias("_m"), F.max(covered).alias("_c"))
    zero = F.lit(0.0)
    inside = F.when(F.col("_c"), F.col("_m")).otherwise(zero)
    totals = members.groupBy(*group).agg(F.sum("_m").alias("_t"), F.sum(inside).alias("_tc"))
    both = members.join(totals, list(group)) if group else members.withColumns({
        "_t": totals.select("_t").scalar(), "_tc": totals.select("_tc").scalar()})
    none = F.lit(0.0)
    dropped = (F.col("_tc") - inside) / F.nullif(F.col("_t") - F.col("_m"), none)
    return both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("member_count"),
        (F.max("_tc") / F.nullif(F.max("_t"), none)).alias("share"),
        F.min(dropped).alias("least_share"), F.max(dropped).alias("greatest_share"))


def regulated_shares(reports: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Each report's share and the combined share of reports in different units.

    `reports` holds report, auto, other, unit_multiplier as exact numbers.
    """
    unit = F.col("unit_multiplier")
    share = F.try_divide(F.col("auto").cast("double"), F.col("auto") + F.col("other"))
    return reports.groupBy(*group).agg(
        F.sum(F.col("auto") * unit).alias("auto_total"),
        F.sum((F.col("auto") + F.col("other")) * unit).alias("all_total"),
        F.min(share).alias("least_share"), F.max(share).alias("greatest_share"),
        F.bool_or((F.col("other") <= 0) | (F.col("auto") < 0)).alias("invalid"),
    ).withColumn("combined_share",
                 F.try_divide(F.col("auto_total").cast("double"), F.col("all_total")))


def reconcile_share(
    national: DataFrame, members: DataFrame, priors: DataFrame, group: Sequence[str],
    key: str = "member", amount: str = "amount", covered: str = "covered",
) -> DataFrame:
    """Registered (low, mid, high) against national share times covered share, per group."""
    loo = leave_one_out_share(members, key, amount, covered, group)
    j = priors.join(national, list(group)).join(loo, list(group))
    n = F.col("national_share")
    derived, lo, hi = n * F.col("share"), n * F.col("least_share"), n * F.col("greatest_share")
    return j.select(
        *group, derived.alias("derived_mid"), lo.alias("derived_low"), hi.alias("derived_high"),
        (F.abs(F.col("mid") - derived) <= MIDPOINT_TOLERANCE).alias("midpoint_ok"),
        ((F.col("low") <= F.col("mid")) & (F.col("mid") <= F.col("high"))).alias("ordered"),
        ((F.col("low") <= lo) & (F.col("high") >= hi)).alias("encloses"))


def normalized_weights(
    df: DataFrame, key: str, value: str, group: Sequence[str] = (), places: int = 12
) -> DataFrame:
    """Share of the group total, truncated; the last key takes the rest, so the sum is exactly 1.

    Amounts keep ten fraction digits and eighteen whole ones. Shares come from whole quotients and
    remainders, six digits at a time, as decimal division gives up digits. `places` is even. A group
    whose total is not positive has null weights; see `weight_violations`.
    """
    amount = F.col(value).cast("decimal(28,10)")
    rows = df.select(*group, key, amount.alias("_v"))
    totals = rows.groupBy(*group).agg(F.sum("_v").alias("_t"), F.max(key).alias("_last"))
    if group:
        rows = rows.join(totals, list(group))
    else:
        rows = rows.withColumns({"_t": totals.select("_t").scalar(),
                                 "_last": totals.select("_last").scalar()})
    step = F.lit(10 ** (places // 2)).cast(f"decimal({places // 2 + 1},0)")
    total = F.when(F.col("_t") > 0, F.col("_t").cast("decimal(28,10)"))
    scaled = (F.col("_v") * step).cast("decimal(38,10)")
    high = F.call_function("div", scaled, total)
    rest = (scaled - (total * high).cast("decimal(38,10)")).cast("decimal(28,10)")
    low = F.call_function("div", (rest * step).cast("decimal(38,10)"), total)
    units = (high.cast("decimal(10,0)") * step + low.cast("decimal(10,0)")).cast("decimal(18,0)")
    share = (units / F.lit(10 ** places).cast(f"decimal({places + 1},0)")).cast(f"decimal(20,{places})")
    rows = rows.withColumn("_w", F.when(F.col(key) != F.col("_last"), share))
    rest = rows.groupBy(*group).agg((1 - F.coalesce(F.sum("_w"), F.lit(0))).alias("_rest"))
    if group:
        rows = rows.join(rest, list(group))
    else:
        rows = rows.withColumn("_rest", rest.scalar())
    return rows.select(*group, key, F.when(
        F.col("_t") > 0, F.coalesce("_w", "_rest").cast("double")).alias("weight"))


def weight_violations(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Groups that cannot be normalized: no positive total, or a value that is null or negative."""
    amount = F.col(value).cast("decimal(28,10)")
    totals = df.groupBy(*group).agg(
        F.coalesce(F.sum(amount), F.lit(0)).alias("total"),
        F.count_if(amount.isNull() | (amount < 0)).alias("bad_values"))
    return totals.filter("total <= 0 or bad_values > 0")


def reweight_matrix_b(
    matrix_b: DataFrame, companies: DataFrame, assumptions: DataFrame,
    categories: Sequence[str], subset_category: str | None = None,
    subset: DataFrame | None = None,
) -> DataFrame:
    """Replace the listed categories by normalized consumer revenue; one more over a subset.

    The categories are a short parameter list, so they are exploded beside each company.
    """
    share = assumptions.select(F.col("assumption_id").alias("share_assumption_id"),
                               F.col("mid").alias("_s"))
    value = companies.join(share, "share_assumption_id").select(
        "ticker", (F.col("revenue_millions") * F.col("_s")).alias("_v"))

    def rows(weights: DataFrame, names: Sequence[str]) -> DataFrame:
        w = F.col("weight")
        return weights.select(
            F.explode(F.array(*[F.lit(n) for n in names])).alias("category"), "ticker",
            w.alias("low"), w.alias("mid"), w.alias("high"),
            F.lit(None).cast("string").alias("assumption_id"))

    replaced = list(categories) + ([subset_category] if subset_category else [])
    kept = matrix_b.filter(~F.col("category").isin(replaced)).select(
        "category", "ticker", "low", "mid", "high", "assumption_id")
    out = kept.unionByName(rows(normalized_weights(value, "ticker", "_v"), categories))
    if subset_category is not None:
        part = value.join(subset.select("ticker").distinct(), "ticker", "left_semi")
        out = out.unionByName(rows(normalized_weights(part, "ticker", "_v"), [subset_category]))
    return out


# ---- company facts --------------------------------------------------------------------------

def annual_fact(
    facts: DataFrame, t: date | datetime | str, quarter_end: date | str, entity: str = "ticker"
) -> DataFrame:
    """Latest full-year fact of a 10-K filed by `t` that ended by the quarter end."""
    days = F.datediff("end", "start")
    known = pit.as_of(facts, t, "filed").filter(
        (F.col("form") == "10-K") & (F.col("fp") == "FY")
        & (F.col("end") <= F.lit(quarter_end).cast("date")) & days.between(*ANNUAL_DAYS))
    return pit.latest_vintage(known, [entity], ["end", "filed", "start", "accession"])


def latest_filing(
    filings: DataFrame, form: str, t: date | datetime | str, after: DataFrame,
    until: date | str, entity: str = "ticker", after_col: str = "end",
) -> DataFrame:
    """Latest filing of the form known at `t`, for a period after the annual one, by the quarter."""
    known = pit.as_of(filings, t, "filed").filter(
        (F.col("form") == form) & (F.col("period") <= F.lit(until).cast("date")))
    since = after.select(entity, F.col(after_col).alias("_after"))
    picked = known.join(since, entity).filter(F.col("period") > F.col("_after")).drop("_after")
    return pit.latest_vintage(picked, [entity], ["period", "filed", "accession"])


def ytd_pair(facts: DataFrame, filings: DataFrame, entity: str = "ticker") -> DataFrame:
    """Current year-to-date fact of the filing and the same span one year earlier.

    Both come from the one filing, so the join is on its accession; dates only choose within it.
    """
    inside = facts.filter("form = '10-Q'").join(
        filings.select(entity, "accession", F.col("period").alias("_period")),
        [entity, "accession"])
    current = inside.filter(F.col("end") == F.col("_period")).groupBy(entity, "accession").agg(
        F.min_by(F.struct("start", "end", "value"), F.struct("start", "value")).alias("c"))
    span = F.datediff(F.col("c.end"), F.col("c.start"))
    prior = inside.select(entity, "accession", "start", "end", "value").join(
        current, [entity, "accession"]).filter(
        F.datediff(F.col("c.end"), F.col("end")).between(*PRIOR_GAP_DAYS)
        & (F.abs(F.datediff("end", "start") - span) <= DURATION_SLACK_DAYS)
    ).groupBy(entity, "accession").agg(
        F.max_by(F.struct("start", "end", "value"), F.struct("end", "start", "value")).alias("p"))
    return current.join(prior, [entity, "accession"], "left").select(
        entity, "accession", F.col("c.end").alias("period"),
        F.col("c.value").alias("current_ytd"), F.col("p.value").alias("prior_ytd"))


def ttm_revenue(annual: DataFrame, pairs: DataFrame, entity: str = "ticker") -> DataFrame:
    """Annual plus current minus prior year-to-date where a pair exists; implausible is flagged."""
    a = annual.select(entity, F.col("value").alias("annual"), F.col("end").alias("_end"),
                      F.col("accession").alias("annual_accession"),
                      F.col("filed").alias("annual_filed"))
    j = a.join(pairs.filter("prior_ytd is not null"), entity, "left")
    has = F.col("current_ytd").isNotNull()
    revenue = F.when(has, F.col("annual") + F.col("current_ytd") - F.col("prior_ytd")).otherwise(
        F.col("annual"))
    ok = (revenue > 0) & (revenue >= F.col("annual") * TTM_RATIO[0]) & (
        revenue <= F.col("annual") * TTM_RATIO[1])
    return j.select(
        entity, F.when(has, "UPDATED_TTM_FROM_10Q").otherwise("BASELINE_NO_NEW_10Q")
        .alias("status"),
        F.coalesce("period", "_end").alias("period"), revenue.alias("revenue"), "annual",
        "current_ytd", "prior_ytd", "annual_accession", "annual_filed",
        F.col("accession").alias("quarterly_accession"), F.coalesce(ok, F.lit(False))
        .alias("plausible"))


def refresh_record(
    flows: DataFrame, inputs: DataFrame, filings: DataFrame, method: str,
    entity: str = "ticker",
) -> DataFrame:
    """One immutable refresh row: identity from method, input hash and quarter only.

    `flows` is the output of `latest_complete_group`, `inputs` that of `ttm_revenue`.
    """
    text = ["status", "period", "annual_accession", "quarterly_accession",
            F.round("revenue", 6).cast("decimal(38,6)")]
    hashed = inputs.select(entity, "status", "annual_filed", "quarterly_accession",
                           k.row_hash([entity, *text]).alias("_h"))
    filed = filings.select(F.col(entity), F.col("accession").alias("quarterly_accession"),
                           F.col("filed").alias("_filed"))
    dated = hashed.join(filed, [entity, "quarterly_accession"], "left")
    companies = dated.agg(
        k.digest("_h").alias("_companies"), F.count(F.lit(1)).alias("company_count"),
        F.count_if(F.col("status") == "UPDATED_TTM_FROM_10Q").alias("updated_company_count"),
        F.max(F.coalesce("_filed", "annual_filed")).alias("_last_filed"))
    flow_hash = k.row_hash(["quarter", "series_id", "total"])
    out = flows.groupBy("quarter", "data_vintage").agg(k.digest(flow_hash).alias("_flows"))
    out = out.withColumns({c: companies.select(c).scalar() for c in companies.columns})
    source_hash = F.sha2(F.concat_ws("|", "_flows", "_companies"), 256)
    return out.withColumn("source_hash", source_hash).select(
        k.record_id([F.lit(method), "source_hash", "quarter"], "rfr_").alias("refresh_id"),
        F.col("quarter").alias("target_quarter"),
        F.greatest("data_vintage", "_last_filed").alias("effective_at"), "data_vintage",
        F.lit(method).alias("methodology_version"), "source_hash", "company_count",
        "updated_company_count")


# ---- published views ------------------------------------------------------------------------

def flow_rollup(
    amounts: DataFrame, lifts: DataFrame, named: int = 1, top: int = 2
) -> DataFrame:
    """Midpoint amounts with small ends merged: other categories per tier, other companies as one."""
    positive = amounts.filter("amount > 0")
    totals = positive.groupBy("category").agg(F.sum("amount").alias("_t"))
    leading = totals.orderBy(F.desc("_t"), "category").limit(named).select(
        "category", F.col("category").alias("_named"))
    best = lifts.orderBy(F.desc("lift"), "ticker").limit(top).select(
        "ticker", F.col("ticker").alias("_kept"))
    rows = positive.join(leading, "category", "left").join(best, "ticker", "left")
    return rows.groupBy(
        "product",
        F.coalesce("_named", F.concat(F.lit("other-tier-"), F.col("tier").cast("string")))
        .alias("category_group"),
        "tier", F.coalesce("_kept", F.lit("all-other")).alias("company_group"),
    ).agg(F.sum("amount").alias("amount"))


def methodology_comparison(original: DataFrame, prior: DataFrame, current: DataFrame) -> DataFrame:
    """Three versions side by side for the companies of the middle one, and the midpoint change."""

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select("ticker", *[F.col(c).alias(f"{name}_{c}") for c in ("low", "mid", "high")])

    return named(prior, "prior").join(named(original, "original"), "ticker", "left").join(
        named(current, "current"), "ticker", "left").withColumn(
        "delta_mid", F.col("current_mid") - F.col("prior_mid"))


PAYLOAD = ("companies array<struct<ticker string, low double, mid double, high double, "
           "status string>>")


def company_history(refreshes: DataFrame, current: DataFrame) -> DataFrame:
    """Each company's bands over the stored refreshes, then its current snapshot."""
    past = refreshes.select(
        "target_quarter", "effective_at",
        F.inline(F.from_json("payload_json", PAYLOAD)["companies"]),
    ).select("ticker", F.concat("target_quarter", F.lit(" refresh")).alias("label"),
             "effective_at", "low", "mid", "high", "status")
    now = current.select(
        "ticker", F.concat("quarter", F.lit(" methodology snapshot")).alias("label"),
        "effective_at", "low", "mid", "high", F.lit("VERSIONED_BASELINE").alias("status"))
    return past.unionByName(now)


def extremes(bands: DataFrame) -> DataFrame:
    """Lowest and highest company midpoint, ties by ticker."""
    pair = F.struct("mid", "ticker")
    return bands.agg(F.min(pair).alias("a"), F.max(pair).alias("b")).select(
        F.col("a.ticker").alias("lowest_ticker"), F.col("a.mid").alias("lowest_mid"),
        F.col("b.ticker").alias("highest_ticker"), F.col("b.mid").alias("highest_mid"))


def _with_meta(df: DataFrame, meta: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in meta.items()})


def company_feed(
    bands: DataFrame, lifts: DataFrame, shares: DataFrame, used: DataFrame,
    sensitivity: DataFrame, meta: dict[str, str],
) -> DataFrame:
    """One flat row per company: ids joined by a bar, sensitivity as JSON."""
    ids = used.groupBy("ticker").agg(
        F.array_join(F.sort_array(F.collect_set("assumption_id")), "|").alias("assumption_ids"))
    top = sensitivity.groupBy("ticker").agg(F.to_json(F.transform(
        F.sort_array(F.collect_list(F.struct(
            "place", F.struct("assumption_id", "absolute_correlation", "direction").alias("s")))),
        lambda x: x["s"])).alias("sensitivity"))
    rows = bands.join(lifts.drop("mid"), "ticker").join(shares, "ticker").join(
        ids, "ticker", "left").join(top, "ticker", "left")
    link = F.concat(F.lit("/companies/"), F.lower("ticker"), F.lit("/"))
    return _with_meta(rows.withColumn("permalink", link), meta)


def assumption_feed(assumptions: DataFrame, meta: dict[str, str]) -> DataFrame:
    renamed = {"low": "value_low", "mid": "value_mid", "high": "value_high"}
    keep = [F.col(c).alias(renamed.get(c, c)) for c in assumptions.columns
            if c != "fallback_source_ids"]
    return _with_meta(assumptions.select(*keep), meta)


def exclusion_feed(excluded: DataFrame, meta: dict[str, str]) -> DataFrame:
    return _with_meta(excluded, meta)
