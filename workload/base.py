"""Query registry and the panels derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factorloom.operators.blocks import dealt, join_stats
from factorloom.operators.panel import Panel, PanelSpec
from factorloom.operators.targets import DateRange, Fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rows_of(spark: SparkSession, sf: str, name: str) -> int:
    """Row count from the Parquet footers: an upper bound for panels that only aggregate it."""
    return table(spark, sf, name).count()


# --- rounding, identical in both engines -----------------------------------------------------


def r6(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    rounded = F.round(c.cast("double"), digits)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def ln(c: Column) -> Column:
    """SQL's ln: minus infinity at 0 and NaN below it, where Spark's is null."""
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan")))


def q6(expr: str, name: str | None = None, digits: int = 6) -> str:
    rounded = f"round(CAST({expr} AS DOUBLE), {digits})"
    out = f"CASE WHEN {rounded} = 0 THEN CAST(0 AS DOUBLE) ELSE {rounded} END"
    return f"{out} AS {name}" if name else out


def rounded(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[r6(v, digits).alias(v) for v in values])


# --- supplier trade panels from lineitem -------------------------------------------------------

SUPPLIER = PanelSpec(
    identity=("exchange", "instrument_id"), time="trading_day", eligible="eligible"
)


def cents(name: str) -> Column:
    """Whole cents of a two-digit amount (a decimal rounding per row would cost more)."""
    return F.floor(F.col(name) * 100 + 0.5)


def trade(spark: SparkSession, sf: str, unit: str = "day") -> DataFrame:
    """Bars per supplier and day (or month): lines are combined before the supplier join.

    Money is summed in whole cents, so the result does not depend on the order of addition.
    """
    unit_price = F.col("l_extendedprice") / F.col("l_quantity")
    day = F.col("l_shipdate").cast("date")
    keyed = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("instrument_id"),
        (day if unit == "day" else F.trunc(day, unit)).alias("trading_day"),
        "l_extendedprice",
        "l_quantity",
    )
    keys = ["instrument_id", "trading_day"]
    # Groups are small, so many lines gain little from combining before the shuffle.
    bars = dealt(keyed, rows_of(spark, sf, "lineitem"), keys).groupBy(*keys).agg(
        F.max(unit_price).alias("high"),
        F.min(unit_price).alias("low"),
        F.sum("l_quantity").alias("volume"),
        (F.sum(cents("l_extendedprice")) / F.lit(100.0)).alias("amount"),
        F.count(F.lit(1)).alias("trades"),
    )
    places = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("instrument_id"),
            F.col("n_name").alias("product"),
            F.col("r_name").alias("exchange"),
        )
    )
    # Every line has a supplier; the footer count bounds the lookup's size.
    placed = join_stats(bars, places, ["instrument_id"], rows_of(spark, sf, "supplier"))
    priced = placed.withColumn("price", F.col("amount") / F.col("volume"))
    whole = F.col("volume").cast("long")
    return priced.withColumns(
        {
            "eligible": whole % 11 != 0,
            "x": F.when(whole % 13 != 0, F.ln("price") - 5.5),
            "y": F.sqrt("volume") / 2,
        }
    )


def trade_sql(unit: str = "day", name: str = "trade") -> str:
    return f"""{name} AS (
  SELECT r_name AS exchange, instrument_id, n_name AS product, trading_day,
         high, low, volume, amount, trades, amount / volume AS price,
         CAST(volume AS BIGINT) % 11 <> 0 AS eligible,
         CASE WHEN CAST(volume AS BIGINT) % 13 <> 0 THEN ln(amount / volume) - 5.5 END AS x,
         sqrt(volume) / 2 AS y
  FROM (
    SELECT l_suppkey AS instrument_id, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS trading_day,
           max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
           sum(l_quantity) AS volume,
           CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS amount,
           count(*) AS trades
    FROM lineitem
    GROUP BY ALL
  ) JOIN supplier ON s_suppkey = instrument_id
    JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
)"""


def trade_panel(spark: SparkSession, sf: str, unit: str = "day") -> Panel:
    return Panel(trade(spark, sf, unit), SUPPLIER, rows_of(spark, sf, "lineitem"))


KEY = ["instrument_id", "trading_day"]
HISTORY = "PARTITION BY exchange, instrument_id ORDER BY trading_day"

FOLD = Fold(
    "monthly",
    DateRange(date(1996, 1, 1), date(1998, 12, 31)),
    DateRange(date(1999, 1, 1), date(2000, 6, 30)),
    DateRange(date(2000, 7, 1), date(2001, 12, 31)),
)


# --- five-minute bars from events ----------------------------------------------------------------


def event_bars(spark: SparkSession, sf: str, minutes: int = 5) -> DataFrame:
    """End-labelled bars per event type; the contract of a type rolls every ten days."""
    micros = minutes * 60_000_000
    end = F.timestamp_micros(((F.unix_micros("ts") / micros).cast("long") + 1) * F.lit(micros).cast("long"))
    at = F.struct("ts", "event_id")
    bars = (
        table(spark, sf, "events")
        .select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
        .withColumns({"timestamp": end, "trading_day": F.col("ts").cast("date")})
        .groupBy(F.col("event_type").alias("product"), "trading_day", "timestamp")
        .agg(
            F.min_by("value", at).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", at).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
            (F.sum(cents("value")) / F.lit(100.0)).alias("amount"),
        )
    )
    roll = F.floor((F.dayofmonth("trading_day") - 1) / 10).cast("string")
    return bars.withColumns(
        {
            "exchange": F.lit("EV"),
            "instrument_id": F.concat_ws("_", F.col("product"), roll),
            "adj_vwap": F.col("amount") / F.col("volume"),
            "open_interest": F.col("close") + F.col("volume"),
        }
    )


def event_bars_sql(minutes: int = 5, name: str = "bars") -> str:
    micros = minutes * 60_000_000
    return f"""{name} AS (
  SELECT *, 'EV' AS exchange,
         product || '_' || CAST((day(trading_day) - 1) // 10 AS VARCHAR) AS instrument_id,
         amount / volume AS adj_vwap, close + volume AS open_interest
  FROM (
    SELECT event_type AS product, CAST(ts AS DATE) AS trading_day,
           make_timestamp((epoch_us(ts) // {micros} + 1) * {micros}) AS timestamp,
           first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
           last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS amount
    FROM events GROUP BY ALL
  )
)"""
