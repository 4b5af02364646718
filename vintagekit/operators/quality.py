"""Freshness, audits, scans and reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagekit.functions import keys as k
from vintagekit.functions import text as tx
from vintagekit.operators import pit

# Statuses from best to worst.
STATUSES = ("GREEN", "OPTIONAL-DEGRADED", "BLOCKED", "STALE")
# Patterns of workstation details that must not be published.
PATH_RULES = {
    "windows-user-profile":
        r"(?i)(?<![A-Za-z0-9_])(?:[A-Z]:[\\/](?:Users|Documents and Settings)[\\/])[^\\/\s:]+",
    "unix-user-profile": r"(?<![A-Za-z0-9_])/(?:home|Users)/[A-Za-z0-9._-]+(?:/|\b)",
    "wsl-user-profile": r"(?i)(?<![A-Za-z0-9_])/mnt/[a-z]/Users/[A-Za-z0-9._-]+(?:/|\b)",
    "workstation-name": r"(?i)\b(?:DESKTOP-[A-Z0-9-]+|[A-Z0-9]+-PC)\b",
}
CREDENTIAL_PATTERN = r"(?i)[?&](?:UserID|key)="
AUDIT_KEYS = ("source_group", "source", "series_id", "obs_period", "unit", "source_url",
              "checksum")
AUDIT_TOLERANCE = 1e-12


def _interval(seconds: str | Column) -> Column:
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.make_dt_interval(secs=s.cast("decimal(18,6)"))


def calendar_state(
    policies: DataFrame, calendar: DataFrame, t: date | datetime | str
) -> DataFrame:
    """Latest due and next expected release per policy, and whether any row is blocked.

    A policy names release-name prefixes. Each name is spread over its own prefixes, so matching is
    an equi-join.
    """
    now = pit.boundary_literal(calendar, "expected_at", t)
    at = F.coalesce("actual_at", "expected_at")
    name = F.col("release_name")
    spread = calendar.select(
        at.alias("_at"), F.col("status").startswith("BLOCKED").alias("_blocked"), "release_name",
        F.explode(F.transform(F.sequence(F.lit(1), F.length(name)),
                              lambda n: F.substr(name, F.lit(1), n))).alias("_prefix"))
    wanted = policies.select("source_id", F.explode(F.array_distinct("calendar_prefixes"))
                             .alias("_prefix"))
    return wanted.join(spread, "_prefix").groupBy("source_id").agg(
        F.max(F.when(F.col("_at") <= now, F.col("_at"))).alias("latest_due_at"),
        F.min(F.when(F.col("_at") > now, F.col("_at"))).alias("next_expected_at"),
        F.bool_or("_blocked").alias("calendar_blocked"))


def _coverage(
    policies: DataFrame, seen: DataFrame, entity: str, on: Sequence[str], watermark: str,
    expected: DataFrame | None,
) -> DataFrame:
    """Expected entities, those seen, and the least of their latest watermarks, per policy."""
    latest = seen.groupBy(*on, entity).agg(F.max(watermark).alias("_latest"))
    if expected is None:
        expected = policies.select("source_id", *on, F.explode(F.array_distinct("entities"))
                                   .alias(entity))
    else:
        expected = policies.select("source_id", *on).join(
            expected.select("source_id", entity).distinct(), "source_id")
    return expected.join(latest, [*on, entity], "left").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("expected_count"), F.count("_latest").alias("observed_count"),
        F.min("_latest").alias("_watermark"))


def freshness(
    observations: DataFrame, calendar: DataFrame, policies: DataFrame,
    t: date | datetime | str, ingested: str = "ingested_at", series: str = "series_id",
    expected: DataFrame | None = None,
) -> DataFrame:
    """State of every source at `t`: coverage first, then a missed release, then age.

    `policies`: source_id, source, entities (the series expected), calendar_prefixes,
    max_age_seconds, grace_seconds, optional. Calendar times must be of the ingest column's type.
    Long lists come as `expected` (source_id, series) in place of the entities array.
    """
    now = pit.boundary_literal(observations, ingested, t)
    visible = pit.as_of(observations, t, ingested)
    state = calendar_state(policies, calendar, t)
    rows = policies.drop("entities", "calendar_prefixes").join(
        _coverage(policies, visible, series, ["source"], ingested, expected), "source_id").join(
        state, "source_id", "left")
    whole = F.col("observed_count") == F.col("expected_count")
    mark, due = F.col("_watermark"), F.col("latest_due_at")
    behind = whole & due.isNotNull() & (mark < due)
    waiting = behind & (now <= due + _interval("grace_seconds"))
    old = whole & ~F.coalesce(behind, F.lit(False)) & (mark + _interval("max_age_seconds") < now)
    blocked = F.coalesce("calendar_blocked", F.lit(False))
    reason = (
        F.when(F.col("observed_count") == 0, "NO_OBSERVATION")
        .when(~whole, "SERIES_COVERAGE_INCOMPLETE")
        .when(waiting, "AWAITING_RELEASE_WITHIN_SLA")
        .when(behind, "MISSED_RELEASE_SLA")
        .when(old & blocked, "CALENDAR_SLA_BLOCKED")
        .when(old, "MAX_AGE_EXCEEDED")
        .otherwise("CURRENT"))
    return _with_status(rows.withColumn("reason", reason)).select(
        "source_id", "status", "reason", "expected_count", "observed_count",
        F.when(whole, mark).alias("watermark"), "latest_due_at", "next_expected_at")


def _with_status(rows: DataFrame) -> DataFrame:
    fine = F.col("reason").isin("CURRENT", "AWAITING_RELEASE_WITHIN_SLA")
    stale = F.col("reason").isin("MISSED_RELEASE_SLA", "MAX_AGE_EXCEEDED")
    status = F.when(fine, "GREEN").when(F.col("optional"), "OPTIONAL-DEGRADED").when(
        stale, "STALE").otherwise("BLOCKED")
    return rows.withColumn("status", status)


def entity_freshness(
    df: DataFrame, policies: DataFrame, t: date | datetime | str, entity: str, watermark: str,
    ingested: str = "ingested_at", expected: DataFrame | None = None,
) -> DataFrame:
    """The same question for any table, without a calendar; a date watermark means its midnight.

    `policies`: source_id, entities, max_age_seconds, optional; or `expected` (source_id, entity).
    """
    now = pit.boundary_literal(df, ingested, t)
    visible = pit.as_of(df, t, ingested).withColumn(
        "_w", F.col(watermark).cast(df.schema[ingested].dataType))
    rows = policies.drop("entities").join(
        _coverage(policies, visible, entity, [], "_w", expected), "source_id")
    whole = F.col("observed_count") == F.col("expected_count")
    old = F.col("_watermark") + _interval("max_age_seconds") < now
    reason = (
        F.when(F.col("observed_count") == 0, "NO_OBSERVATION")
        .when(~whole, "ENTITY_COVERAGE_INCOMPLETE")
        .when(old, "MAX_AGE_EXCEEDED").otherwise("CURRENT"))
    return _with_status(rows.withColumn("reason", reason)).select(
        "source_id", "status", "reason", "expected_count", "observed_count",
        F.when(whole, F.col("_watermark")).alias("watermark"))


def overall_status(sources: DataFrame) -> DataFrame:
    """The worst status, with the count of sources."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return sources.agg(F.max_by("status", rank).alias("status"),
                       F.count(F.lit(1)).alias("source_count"))


def _one_each(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row per audit key; a repeated key stops the run, as a pair would not be one pair."""
    keys = list(AUDIT_KEYS)
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(value).alias(name))
    stop = F.raise_error(F.concat(F.lit("audit key is repeated: "), F.concat_ws("/", *keys)))
    checked = F.when(F.col("_n") > 1, stop.cast("double")).otherwise(F.col(name))
    return rows.select(*keys, checked.alias(name))


def repeated_audit_keys(df: DataFrame) -> DataFrame:
    """Audit keys with more than one row, which `spot_audit` refuses."""
    return df.groupBy(*AUDIT_KEYS).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def _audit_pairs(stored: DataFrame, live: DataFrame, value: str) -> DataFrame:
    return _one_each(stored, value, "stored_value").join(
        _one_each(live, value, "live_value"), list(AUDIT_KEYS))


def spot_audit(
    stored: DataFrame, live: DataFrame, seed: str, n: int, value: str = "value"
) -> DataFrame:
    """A seeded sample of rows on both sides: one of every group at least, then up to n.

    Order comes from a hash of seed and identity, so the sample is the same on every run, and the
    top-k needs no full sort.
    """
    if not seed or n < 1:
        raise ValueError("need a seed and a positive sample size")
    pairs = _audit_pairs(stored, live, value).withColumn(
        "_u", F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in AUDIT_KEYS])))
    rest = [c for c in pairs.columns if c != "source_group"]
    firsts = pairs.groupBy("source_group").agg(F.min_by(F.struct(*rest), "_u").alias("r")).select(
        "source_group", "r.*")
    marked = pairs.join(firsts.select("source_group", "_u", F.lit(0).alias("_rank")),
                        ["source_group", "_u"], "left").fillna(1, ["_rank"])
    best = marked.orderBy("_rank", "_u").limit(n).select(*firsts.columns)
    same = F.abs(F.col("stored_value") - F.col("live_value")) <= AUDIT_TOLERANCE
    return best.unionByName(firsts).distinct().select(
        *AUDIT_KEYS, "stored_value", "live_value",
        F.when(same, "PASS").otherwise("FAIL").alias("status"))


def audit_blocked_groups(
    stored: DataFrame, live: DataFrame, groups: Sequence[str]
) -> DataFrame:
    """Groups with no live identity, or with one that is not stored."""
    ident = ["source_group", "source_url", "checksum"]
    lv = live.select(*ident).distinct()
    unknown = lv.join(stored.select(*ident).distinct(), ident, "left_anti").select("source_group")
    want = live.sparkSession.createDataFrame([(g,) for g in groups], "source_group string")
    absent = want.join(lv.select("source_group").distinct(), "source_group", "left_anti")
    return unknown.distinct().join(want, "source_group", "left_semi").unionByName(absent).distinct()


def audit_receipt(sample: DataFrame, blocked: DataFrame, n: int) -> DataFrame:
    """One row that sums the audit up, with a hash of its evidence."""
    text = k.row_hash([*AUDIT_KEYS, "status"])
    rows = sample.agg(
        F.count(F.lit(1)).alias("audited_rows"), F.count_if(F.col("status") == "FAIL")
        .alias("failed_rows"), k.digest(text).alias("evidence_hash"))
    stopped = blocked.agg(F.count(F.lit(1))).scalar()
    out = rows.withColumn("blocked_groups", stopped)
    status = F.when((F.col("blocked_groups") > 0) | (F.col("audited_rows") < n), "BLOCKED").when(
        F.col("failed_rows") > 0, "FAIL").otherwise("PASS")
    return out.withColumn("status", status)


def scan_text(
    df: DataFrame, id_col: str, text_col: str, rules: Mapping[str, str] = PATH_RULES
) -> DataFrame:
    """(id, line number, rule) of every matching line of the whole text, never the text itself."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, r"\r\n|[\n\r]")).alias("_n", "_line"))
    hits = F.array_compact(F.array(*[
        F.when(F.col("_line").rlike(p), F.lit(name)) for name, p in rules.items()]))
    return lines.select(id_col, (F.col("_n") + 1).alias("line"), F.explode(hits).alias("rule"))


def credential_urls(df: DataFrame, url: str) -> DataFrame:
    return df.filter(F.col(url).rlike(CREDENTIAL_PATTERN))


def reconcile_multiset(
    current: DataFrame, lagged: DataFrame, events: DataFrame, aliases: DataFrame,
    t: date | str, name: str = "name", normalize=tx.normalize_issuer,
) -> DataFrame:
    """Names whose count differs once dated events and aliases bring the lagged list up to date.

    `events` hold effective, removed, added; `aliases` hold alias, name. Lists of any size are
    compared by one weighted aggregate.
    """
    due = events.filter(F.col("effective") <= F.lit(t).cast("date"))
    adjusted = (
        lagged.select(F.col(name).alias("_n"), F.lit(1).alias("_w"))
        .unionByName(due.select(F.col("removed").alias("_n"), F.lit(-1).alias("_w")))
        .unionByName(due.select(F.col("added").alias("_n"), F.lit(1).alias("_w")))
        .filter("_n is not null")
    )
    known = aliases.select(F.col("alias").alias("_n"), F.col("name").alias("_to"))
    want = current.select(F.col(name).alias("_n"), F.lit(-1).alias("_w"))
    # Copies of a raw name are summed first, so each distinct name is normalized once.
    raw = adjusted.join(known, "_n", "left").select(F.coalesce("_to", "_n").alias("_n"), "_w")
    sums = raw.unionByName(want).groupBy("_n").agg(F.sum("_w").alias("_w")).filter("_w <> 0")
    net = sums.select(normalize(F.col("_n")).alias("name"), "_w").groupBy("name").agg(
        F.sum("_w").alias("_net"))
    return net.filter("_net <> 0").select(
        "name", F.when(F.col("_net") > 0, "extra").otherwise("missing").alias("problem"),
        F.abs("_net").alias("row_count"))


def membership_violations(
    current: DataFrame, lagged: DataFrame, events: DataFrame, aliases: DataFrame,
    t: date | str, name: str = "name",
) -> DataFrame:
    """What makes a reconciliation void, as (rule, key).

    A due removal must be in the lagged list exactly once, and its name not be current any more; a due
    addition must be current. An alias is given once, is used by the lagged list and leads to a
    current name.
    """
    due = events.filter(F.col("effective") <= F.lit(t).cast("date"))
    held = lagged.groupBy(F.col(name).alias("key")).agg(F.count(F.lit(1)).alias("_n"))
    now = current.select(F.col(name).alias("key")).distinct()
    removed = due.filter("removed is not null").groupBy(F.col("removed").alias("key")).agg(
        F.count(F.lit(1)).alias("_times"))
    # A name that is removed twice would have to be there once for each removal.
    wrong = removed.join(held, "key", "left").filter("coalesce(_n, 0) <> 1 or _times <> 1")
    added = due.filter("added is not null").select(F.col("added").alias("key")).distinct()
    by_alias = aliases.groupBy(F.col("alias").alias("key")).agg(F.count(F.lit(1)).alias("_n"))
    target = aliases.select(F.col("name").alias("key")).distinct()
    parts = {
        "removal absent or ambiguous": wrong,
        "removal still current": removed.join(now, "key", "left_semi"),
        "addition not current": added.join(now, "key", "left_anti"),
        "alias repeated": by_alias.filter("_n > 1"),
        "alias not used": by_alias.join(held, "key", "left_anti"),
        "alias target not current": target.join(now, "key", "left_anti"),
    }
    rows = [df.select(F.lit(rule).alias("rule"), "key") for rule, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


# Fixed value: how long before a release a run still counts for it.
BEFORE_WINDOW_SECONDS = 4 * 86_400


def job_status(
    receipts: DataFrame, jobs: DataFrame, releases: DataFrame, t: date | datetime | str,
    live: bool = True,
) -> DataFrame:
    """Each job's last success, due and next run, and whether a run or a release was missed.

    `jobs`: job_id, cadence, hour, minute, grace_seconds, release_mode (none, before, after),
    release_sla_seconds. `releases`: job_id, release_at. `receipts`: job_id, succeeded_at.
    """
    now = pit.boundary_literal(receipts, "succeeded_at", t)
    today = F.to_date(now)
    kind = receipts.schema["succeeded_at"].dataType
    clock = _interval(F.col("hour") * 3600 + F.col("minute") * 60)

    def runs(first: int, last: int) -> Column:
        days = F.array(*[F.date_add(today, i) for i in range(first, last + 1)])
        ok = F.filter(days, lambda d: F.when(
            F.col("cadence") == "weekday", F.weekday(d) < 5).otherwise(F.weekday(d) == 0))
        return F.transform(ok, lambda d: d.cast(kind) + clock)

    hour_slot = F.date_trunc("hour", now).cast(kind) + _interval(F.col("minute") * 60)
    hourly = F.col("cadence") == "hourly"
    an_hour = _interval(F.lit(3600))
    due = F.when(hourly, F.when(hour_slot <= now, hour_slot).otherwise(hour_slot - an_hour)
                 ).otherwise(F.array_max(F.filter(runs(-8, 0), lambda x: x <= now)))
    following = F.when(hourly, F.when(hour_slot > now, hour_slot).otherwise(hour_slot + an_hour)
                       ).otherwise(F.array_min(F.filter(runs(0, 8), lambda x: x > now)))
    known = pit.as_of(receipts, t, "succeeded_at")
    last = known.groupBy("job_id").agg(F.max("succeeded_at").alias("last_success"))
    release = releases.filter(F.col("release_at") <= now).groupBy("job_id").agg(
        F.max("release_at").alias("release_at"))
    rows = jobs.withColumns({"latest_due": due, "next_run": following}).join(
        last, "job_id", "left").join(release, "job_id", "left")
    deadline = F.col("release_at") + _interval("release_sla_seconds")
    before = F.col("release_mode") == "before"
    start = F.when(before, F.col("release_at") - _interval(F.lit(BEFORE_WINDOW_SECONDS))).otherwise(
        F.col("release_at"))
    stop = F.when(before, F.col("release_at")).otherwise(deadline)
    rows = rows.withColumns({"_deadline": deadline, "_from": start, "_to": stop})
    on_time = known.join(rows.select("job_id", "_from", "_to"), "job_id").filter(
        F.col("succeeded_at").between(F.col("_from"), F.col("_to"))).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("_on_time"))
    rows = rows.join(on_time, "job_id", "left")
    is_live = F.lit(live)
    missed_run = is_live & F.col("latest_due").isNotNull() & (
        now > F.col("latest_due") + _interval("grace_seconds")) & (
        F.col("last_success").isNull() | (F.col("last_success") < F.col("latest_due")))
    check = (
        F.when(F.col("release_mode") == "none", "NOT_APPLICABLE")
        .when(F.col("release_at").isNull(), "DATE_UNANNOUNCED")
        .when(~is_live, "PREVIEW_NOT_EVALUATED")
        .when(now <= F.col("_deadline"), "WITHIN_SLA")
        .when(F.col("_on_time") > 0, "OBSERVED_ON_TIME")
        .otherwise("MISSED"))
    rows = rows.withColumns({"missed_run": missed_run, "release_check": check})
    status = F.when(F.col("missed_run") | (F.col("release_check") == "MISSED"), "STALE").when(
        ~is_live | F.col("last_success").isNull(), "UNKNOWN").otherwise("CURRENT")
    return rows.select("job_id", status.alias("status"), "last_success", "latest_due", "next_run",
                       "missed_run", "release_at", "release_check")


def publication_age(
    feeds: DataFrame, t: date | datetime | str, vintage: str, max_days: str | int
) -> DataFrame:
    """Age of each feed's data vintage in seconds against its limit in days."""
    now = pit.boundary_literal(feeds, vintage, t)
    limit = F.col(max_days) if isinstance(max_days, str) else F.lit(max_days)
    ok = now <= F.col(vintage) + _interval(limit * 86_400)
    age = F.timestamp_diff("SECOND", F.col(vintage), now)
    return feeds.withColumns({
        "age_seconds": F.greatest(age, F.lit(0)), "max_age_seconds": limit * 86_400,
        "status": F.when(ok, "GREEN").otherwise("STALE")})


def link_inventory(columns: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct https links of text and array-of-text columns; order by url when shown."""
    out = None
    for df, col in columns:
        kind = df.schema[col].dataType.typeName()
        url = F.explode(col) if kind == "array" else F.col(col)
        part = df.select(url.alias("url"))
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("url").startswith("https://")).distinct()


def latest_filing_check(
    filings: DataFrame, pinned: DataFrame, entity: str, form: str, position: str,
    identity: Sequence[str],
) -> DataFrame:
    """Entities whose first listed filing of the form is not the pinned one."""
    first = filings.filter(F.col("form") == form).groupBy(entity).agg(
        F.min_by(F.struct(*identity), position).alias("_f"))
    want = pinned.select(entity, F.struct(*identity).alias("_p"))
    return want.join(first, entity, "left").filter(~F.col("_f").eqNullSafe(F.col("_p"))).select(
        entity, *[F.col(f"_f.{c}").alias(f"found_{c}") for c in identity])


def pinned_fact_check(
    facts: DataFrame, pinned: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Pinned facts that do not match exactly one fact on the key columns."""
    counts = facts.groupBy(*key).agg(F.count(F.lit(1)).alias("match_count"))
    return pinned.join(counts, list(key), "left").fillna(0, ["match_count"]).filter(
        "match_count <> 1")
