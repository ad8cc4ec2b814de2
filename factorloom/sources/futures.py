"""Futures preparation: latest records, session bars, far contracts and dominant mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.guards import is_finite
from ..operators.blocks import join_stats

BAR_FIELDS = ("open", "high", "low", "close", "volume", "amount", "open_interest")
CONTRACT_DAY = ("exchange", "instrument_id", "trading_day")


def keep_latest(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The newest record per key.

    Spark limits each map task to one row per key before the shuffle, so copies of a hot key do
    not meet in one task.
    """
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in newest])
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def session_bars(minutes: DataFrame, size: int = 5) -> DataFrame:
    """Bars of `size` consecutive whole minutes, restarting after every gap; partial tails are kept.

    One instrument-day holds at most 1440 unique minutes, which bounds each window.
    """
    day = ("exchange", "product", "instrument_id", "trading_day")
    # Minutes without a gap keep their distance to their row numbers.
    minute = F.floor(F.unix_micros("bar_time") / F.lit(60_000_000).cast("long"))
    run = F.col("__minute") - F.row_number().over(Window.partitionBy(*day).orderBy("bar_time"))
    first = F.min("__minute").over(Window.partitionBy(*day, "__run"))
    numbered = minutes.withColumn("__minute", minute).withColumn("__run", run)
    bucket = numbered.withColumn("__part", F.floor((F.col("__minute") - first) / size))
    usable = is_finite(F.col("adj_vwap")) & (F.col("volume") > 0)
    weight = F.sum(F.when(usable, F.col("volume")))

    def extreme(name: str, pick):
        every = F.bool_and(is_finite(F.col(name)))
        return F.when(every, pick(name)).alias(name)

    def flagged(kind: str):
        return F.count_if(F.col("vwap_flag") == kind).alias(f"vwap_{kind}_bars")

    return (
        bucket.groupBy(*day, "__run", "__part")
        .agg(
            F.max("bar_time").alias("timestamp"),
            F.min_by("adj_open", "bar_time").alias("adj_open"),
            extreme("adj_high", F.max),
            extreme("adj_low", F.min),
            F.max_by("adj_close", "bar_time").alias("adj_close"),
            F.when(weight != 0, F.sum(F.when(usable, F.col("adj_vwap") * F.col("volume"))) / weight).alias(
                "adj_vwap"
            ),
            F.sum("volume").cast("long").alias("volume"),
            F.sum("turnover").alias("amount"),
            F.max_by("open_interest", "bar_time").alias("open_interest"),
            F.max_by("adj_cum_factor", "bar_time").alias("adj_cum_factor"),
            F.count(F.lit(1)).alias("source_bars"),
            flagged("proxy"),
            flagged("clamped"),
            flagged("no_trade"),
        )
        .drop("__run", "__part")
    )


def export_bars(minutes: DataFrame, source: str, quality: str = "final", size: int = 5) -> DataFrame:
    """Session bars of the newest final dominant minutes of one source."""
    chosen = minutes.where(
        (F.col("source") == source) & (F.col("quality") == quality) & F.col("is_dominant")
    )
    latest = keep_latest(chosen, ("exchange", "instrument_id", "bar_time"), ("received_at", "ingest_seq"))
    return session_bars(latest, size)


def parse_lifetimes(instruments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listing dates read leniently: unparsable text becomes null."""
    return instruments.withColumns({c: F.col(c).cast("string").try_cast("date") for c in columns})


def far_contract_mapping(mapping: DataFrame, instruments: DataFrame) -> DataFrame:
    """For every anchor day the next two maturities listed on that day, and days to maturity.

    One equi-join on (exchange, product) with date conditions; the two legs are picked by a
    bounded rank and spread into columns by conditional aggregation.
    """
    lifetimes = parse_lifetimes(instruments, ("listed_date", "de_listed_date", "maturity_date"))
    own = lifetimes.select("instrument_id", "exchange", F.col("maturity_date").alias("__own"))
    anchors = mapping.join(own, "instrument_id", "left")
    others = lifetimes.select(
        "exchange",
        F.col("underlying_symbol").alias("product"),
        F.col("instrument_id").alias("__far"),
        F.col("maturity_date").alias("__maturity"),
        "listed_date",
        "de_listed_date",
    )
    day = F.col("trading_day")
    pairs = anchors.join(others, ["exchange", "product"]).where(
        (F.col("__maturity") > F.col("__own"))
        & (F.col("listed_date") <= day)
        & (F.col("de_listed_date") >= day)
    )
    order = Window.partitionBy(*CONTRACT_DAY).orderBy("__maturity", "__far")
    nearest = pairs.withColumn("__leg", F.row_number().over(order)).where("__leg <= 2")
    columns = []
    for leg in (1, 2):
        mine = F.col("__leg") == leg
        columns += [
            F.max(F.when(mine, F.col("__far"))).alias(f"instrument_id_p{leg}"),
            F.max(F.when(mine, F.col("exchange"))).alias(f"exchange_p{leg}"),
            F.max(F.when(mine, F.datediff("__maturity", "trading_day"))).alias(
                f"days_to_maturity_p{leg}"
            ),
        ]
    legs = nearest.groupBy(*CONTRACT_DAY).agg(*columns)
    return (
        join_stats(anchors, legs, CONTRACT_DAY)
        .withColumn("days_to_maturity", F.datediff("__own", "trading_day"))
        .drop("__own")
    )


def attach_far_bars(
    anchors: DataFrame, bars: DataFrame, mapping: DataFrame, fields: Sequence[str] = BAR_FIELDS
) -> DataFrame:
    """Exact-time left joins of the leg bars; a missing leg observation stays null."""
    extra = [c for c in mapping.columns if c not in {*CONTRACT_DAY, "product"}]
    clash = set(extra) & set(anchors.columns)
    if clash:
        raise ValueError(f"anchor panel already has {sorted(clash)}")
    result = anchors.join(mapping.select(*CONTRACT_DAY, *extra), list(CONTRACT_DAY), "left")
    for leg in (1, 2):
        names = {c: f"{c}_p{leg}" for c in ("exchange", "instrument_id", *fields)}
        side = bars.select("trading_day", "timestamp", *[F.col(a).alias(b) for a, b in names.items()])
        on = [f"exchange_p{leg}", f"instrument_id_p{leg}", "trading_day", "timestamp"]
        result = result.join(side, on, "left")
    return result


def normalize_bars(raw: DataFrame, mapping: DataFrame, instruments: DataFrame) -> DataFrame:
    """Provider names to panel names, restricted to mapped contract days, with instrument facts."""
    renamed = raw.withColumnsRenamed(
        {
            "order_book_id": "instrument_id",
            "datetime": "timestamp",
            "trading_date": "trading_day",
            "total_turnover": "amount",
        }
    ).withColumn("trading_day", F.col("trading_day").cast("date"))
    mapped = renamed.join(
        mapping.select("trading_day", "instrument_id", "product"), ["trading_day", "instrument_id"]
    )
    facts = instruments.select("instrument_id", "exchange", "contract_multiplier")
    return join_stats(mapped, facts, ["instrument_id"])


def delivery_contracts(df: DataFrame, column: str = "instrument_id") -> DataFrame:
    """Real delivery contracts: identifiers that end in a four-digit month."""
    return df.where(F.col(column).rlike(r"\d{4}$"))


def missing_mapped_days(mapping: DataFrame, bars: DataFrame) -> DataFrame:
    """Mapped contract days without a single bar."""
    keys = ["trading_day", "instrument_id"]
    return mapping.join(bars.select(*keys), keys, "left_anti")
