"""The given tables and the published-data views derived from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagekit.functions import keys
from vintagekit.operators import pit
from vintagekit.session import materialize


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def to_places(c: Column, places: int) -> Column:
    """The double nearest to the product with the power of ten, rounded half away from zero.

    SQL's round of a double: a product on a tie in binary goes up, whatever its shortest digits say.
    """
    return F.round(c * 10.0**places) / 10.0**places


class Tables:
    """Readers for one folder; each view is built once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._stored: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table that several steps of the query read, written once.

        Without it each step would scan the big tables again to derive it.
        """
        if name not in self._stored:
            self._stored[name] = materialize(build(), name)
        return self._stored[name]

    def stored(self, view: str) -> DataFrame:
        return self.once(view, lambda: getattr(self, view))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def vintages(self) -> DataFrame:
        """Order priority as series, order month as period, ship month as release.

        The value is the order month's sales shipped so far, so each release revises it.
        """
        o = self.orders.select(
            F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("series_id"),
            F.last_day(F.to_date("o_orderdate")).alias("obs_period"),
        )
        lines = self.lineitem.select(
            F.col("l_orderkey").alias("k"), F.last_day(F.to_date("l_shipdate")).alias("release_date"),
            cents("l_extendedprice").alias("c"),
        )
        m = (
            lines.join(o, "k").filter("release_date > obs_period")
            .groupBy("series_id", "obs_period", "release_date").agg(F.sum("c").alias("c"))
        )
        return m.selectExpr(
            "series_id", "obs_period", "release_date",
            "sum(c) over (partition by series_id, obs_period order by release_date "
            "rows between unbounded preceding and current row) as value_cents",
        )

    @cached_property
    def observations(self) -> DataFrame:
        """`vintages` in the full shape of a published-observations table."""
        text = [F.col("series_id"), F.col("obs_period"), F.col("release_date"),
                F.col("value_cents")]
        return self.vintages.select(
            F.lit("SALES").alias("source"), "series_id", "obs_period", "value_cents",
            (F.col("value_cents") / 1e8).alias("value"), F.lit("million").alias("unit"),
            "release_date", F.col("release_date").alias("vintage_date"),
            F.date_add("release_date", 1).alias("ingested_at"),
            F.concat(F.lit("https://data.example/sales/"),
                     F.date_format("release_date", "yyyyMM"), F.lit("/"),
                     F.regexp_replace("series_id", "[^A-Z0-9]", "")).alias("source_url"),
            keys.row_hash(text).alias("checksum"),
        )

    @cached_property
    def first_prints(self) -> DataFrame:
        return pit.first_print(
            self.vintages, ["series_id", "obs_period"], ["release_date", "value_cents"]
        ).withColumn("value", F.col("value_cents") / 1e8)

    @cached_property
    def monthly(self) -> DataFrame:
        """Order value by priority and month; published 37 days after the month's end."""
        m = self.orders.groupBy(
            F.col("o_orderpriority").alias("series_id"),
            F.last_day(F.to_date("o_orderdate")).alias("obs_period"),
        ).agg(F.sum(cents("o_totalprice")).alias("value_cents"))
        return m.select(
            "*", (F.col("value_cents") / 1e8).alias("value"),
            F.date_add("obs_period", 37).alias("release_date"),
        )

    @cached_property
    def targets(self) -> DataFrame:
        """`monthly` as forecast targets, released ten days after the month's end."""
        return self.stored("monthly").select(
            "series_id", F.col("obs_period").alias("target_period"), "value", "value_cents",
            F.date_add("obs_period", 10).alias("release_at"),
        )

    @cached_property
    def weekly(self) -> DataFrame:
        """Order value by week ending Wednesday: filled orders after 9 days, all after 16."""
        d = F.to_date("o_orderdate")
        end = F.date_add(d, F.pmod(F.lit(2) - F.weekday(d), F.lit(7)).cast("int"))
        c = cents("o_totalprice")
        w = self.orders.groupBy(
            F.col("o_orderpriority").alias("series_id"), end.alias("obs_period")
        ).agg(
            F.sum(F.when(F.col("o_orderstatus") != "P", c).otherwise(0)).alias("first_cents"),
            F.sum(c).alias("all_cents"),
        )
        prints = F.array(
            F.struct(F.date_add("obs_period", 9).alias("release_date"),
                     F.col("first_cents").alias("value_cents")),
            F.struct(F.date_add("obs_period", 16).alias("release_date"),
                     F.col("all_cents").alias("value_cents")),
        )
        return w.select("series_id", "obs_period", F.inline(prints)).select(
            "*", (F.col("value_cents") / 1e8).alias("value"),
            keys.row_hash(["series_id", "obs_period", "release_date", "value_cents"])
            .alias("checksum"),
        )

    @cached_property
    def monthly_flow(self) -> DataFrame:
        """Line value by ship month, released 0 to 8 days after the month's end by month."""
        o = self.orders.select(F.col("o_orderkey").alias("k"),
                               F.col("o_orderpriority").alias("series_id"))
        lines = self.lineitem.select(
            F.col("l_orderkey").alias("k"), F.last_day(F.to_date("l_shipdate")).alias("obs_period"),
            cents("l_extendedprice").alias("c"),
        )
        m = lines.join(o, "k").groupBy("series_id", "obs_period").agg(
            F.sum("c").alias("value_cents"))
        return m.select(
            "*", (F.col("value_cents") / 1e8).alias("value"),
            F.date_add("obs_period", F.month("obs_period") % 5 * 2).alias("release_date"),
        )

    @cached_property
    def seen(self) -> DataFrame:
        """Events as arrivals: type is the source, user modulo ten the series."""
        return self.events.select(
            F.col("event_type").alias("source"),
            (F.col("user_id") % 10).alias("series_no"), "event_id", "user_id",
            F.col("ts").alias("ingested_at"), F.to_date("ts").alias("obs_date"), cents("value")
            .alias("value_cents"),
        )
