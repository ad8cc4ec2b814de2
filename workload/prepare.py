"""Sources and panel preparation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from factorloom.operators.asof import asof_join
from factorloom.sources import audit as audits, daily, equities, futures, market, scan

from .base import cents, event_bars, event_bars_sql, q6, query, r6, rounded, rows_of, table, trade, trade_sql

# --- line-level bars with flags and broken price ranges -------------------------------------------


def line_bars(spark, sf) -> DataFrame:
    """One bar per order line; some ranges are inconsistent and some flags unknown."""
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("exchange"),
        F.col("l_suppkey").alias("instrument_id"),
        F.col("l_orderkey").alias("timestamp"),
        F.col("l_shipdate").cast("date").alias("trading_day"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        price.alias("open"),
        (price * (F.col("l_tax") + 0.98)).alias("high"),
        (price * (1 - F.col("l_discount"))).alias("low"),
        F.when(F.col("l_quantity") != 7, price).alias("close"),
        F.when(F.col("l_quantity") != 9, F.col("l_quantity") > 10).alias("in_core"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linestatus") == "O").alias("is_st"),
        (F.col("l_discount") == 0).alias("is_suspended"),
    )


LINES = """b AS (SELECT l_returnflag AS exchange, l_suppkey AS instrument_id, l_orderkey AS timestamp,
  CAST(l_shipdate AS DATE) AS trading_day, l_linenumber AS line, l_partkey AS part, l_extendedprice AS open,
  l_extendedprice * (l_tax + CAST(0.98 AS DOUBLE)) AS high, l_extendedprice * (1 - l_discount) AS low,
  CASE WHEN l_quantity <> 7 THEN l_extendedprice END AS close,
  CASE WHEN l_quantity <> 9 THEN l_quantity > 10 END AS in_core,
  CASE WHEN l_linenumber <> 7 THEN l_linestatus = 'O' END AS is_st, l_discount = 0 AS is_suspended FROM lineitem),
v AS (SELECT *, coalesce(high >= greatest(open, close, low) AND low <= least(open, close, high)
  AND close IS NOT NULL, false) AS valid_bar FROM b)"""


@query(
    "scan_period",
    """SELECT l_suppkey, l_shipdate, l_quantity FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate <= TIMESTAMP '1997-06-30'""",
)
def scan_period(spark, sf):
    """Pruned read of a period: three columns and a pushed date range."""
    bars = scan.scan_panel(spark, sf, pattern="lineitem.parquet")
    dated = bars.withColumnRenamed("l_shipdate", "trading_day")
    rows = scan.read_period(
        dated, ["l_suppkey", "trading_day", "l_quantity"], date(1997, 6, 30), date(1997, 1, 1)
    )
    return rows.withColumnRenamed("trading_day", "l_shipdate")


@query(
    "eligibility",
    f"""WITH {LINES} SELECT instrument_id, timestamp, line, part, open,
  coalesce(in_core, false) AND NOT coalesce(is_st, true) AND NOT coalesce(is_suspended, true) AND valid_bar AS eligible
FROM v""",
)
def eligibility(spark, sf):
    flagged = line_bars(spark, sf).withColumn("valid_bar", market.valid_ohlc(market.OHLC))
    rule = market.eligibility(flagged.columns, "core") & F.col("valid_bar")
    return flagged.select("instrument_id", "timestamp", "line", "part", "open", rule.alias("eligible"))


@query(
    "ohlc_quarantine",
    f"""WITH {LINES} SELECT instrument_id, timestamp, line, part, valid_bar,
  {q6("CASE WHEN valid_bar THEN open END", "open")}, {q6("CASE WHEN valid_bar THEN high END", "high")},
  {q6("CASE WHEN valid_bar THEN low END", "low")}, {q6("CASE WHEN valid_bar THEN close END", "close")} FROM v""",
)
def ohlc_quarantine(spark, sf):
    marked = market.mark_quality(line_bars(spark, sf), list(market.OHLC))
    keys = ["instrument_id", "timestamp", "line", "part", "valid_bar"]
    return rounded(marked, keys, list(market.OHLC))


# --- continuity -----------------------------------------------------------------------------------


def hourly(spark, sf) -> DataFrame:
    """Hourly event bars with missing days for one product and some broken ranges."""
    bars = event_bars(spark, sf, 60)
    gap = (F.col("product") == "view") & (F.dayofmonth("trading_day") % 7 == 3)
    broken = (F.col("volume").cast("long") % 5 == 4) & (F.dayofmonth("trading_day") % 4 == 0)
    return bars.where(~gap).withColumns(
        {
            "high": F.when(broken, F.col("low") - 1).otherwise(F.col("high")),
            "is_suspended": F.col("volume") >= 6,
        }
    )


HOURLY = f"""{event_bars_sql(60, "raw")},
bars AS (SELECT * EXCLUDE (high), CASE WHEN CAST(volume AS BIGINT) % 5 = 4 AND day(trading_day) % 4 = 0 THEN low - 1 ELSE high END AS high,
  volume >= 6 AS is_suspended FROM raw WHERE NOT (product = 'view' AND day(trading_day) % 7 = 3)),
q AS (SELECT *, high >= greatest(open, close, low) AND low <= least(open, close, high) AS valid_bar FROM bars),
calendar AS (SELECT trading_day, row_number() OVER (ORDER BY trading_day) AS day_at
  FROM (SELECT DISTINCT trading_day FROM q)),
mapped AS (SELECT *, sum(moved) OVER (PARTITION BY product ORDER BY trading_day, instrument_id) AS dominant FROM (
  SELECT *, CASE WHEN instrument_id = lag(instrument_id) OVER (PARTITION BY product ORDER BY trading_day, instrument_id)
    THEN 0 ELSE 1 END AS moved FROM (SELECT DISTINCT product, instrument_id, trading_day FROM q))),
days AS (SELECT exchange, instrument_id, trading_day, sum(gap) OVER (PARTITION BY instrument_id ORDER BY trading_day) AS daily_segment
  FROM (SELECT *, CASE WHEN day_at - lag(day_at) OVER w = 1 AND dominant = lag(dominant) OVER w THEN 0 ELSE 1 END AS gap
    FROM (SELECT DISTINCT exchange, product, instrument_id, trading_day FROM q)
    JOIN calendar USING (trading_day) JOIN mapped USING (product, instrument_id, trading_day)
    WINDOW w AS (PARTITION BY instrument_id ORDER BY trading_day))),
pdays AS (SELECT exchange, product, trading_day, sum(gap) OVER (PARTITION BY product ORDER BY trading_day) AS product_daily
  FROM (SELECT *, CASE WHEN day_at - lag(day_at) OVER w = 1 THEN 0 ELSE 1 END AS gap
    FROM (SELECT DISTINCT exchange, product, trading_day FROM q) JOIN calendar USING (trading_day)
    WINDOW w AS (PARTITION BY product ORDER BY trading_day))),
ok AS (SELECT *, valid_bar AND NOT is_suspended AS target_eligible FROM q
  JOIN days USING (exchange, instrument_id, trading_day) JOIN pdays USING (exchange, product, trading_day)),
broken AS (SELECT *,
    CASE WHEN daily_segment = lag(daily_segment) OVER i AND target_eligible AND lag(target_eligible) OVER i THEN 0 ELSE 1 END AS own,
    CASE WHEN product_daily = lag(product_daily) OVER p AND target_eligible AND lag(target_eligible) OVER p THEN 0 ELSE 1 END AS prod
  FROM ok WINDOW i AS (PARTITION BY instrument_id ORDER BY timestamp), p AS (PARTITION BY product ORDER BY timestamp)),
panel AS (SELECT * EXCLUDE (own, prod), valid_bar AND NOT is_suspended AS eligible,
    CAST(sum(own) OVER (PARTITION BY instrument_id ORDER BY timestamp) AS BIGINT) AS segment_id,
    CAST(sum(prod) OVER (PARTITION BY product ORDER BY timestamp) AS BIGINT) AS product_segment_id FROM broken)"""


def hourly_panel(spark, sf) -> DataFrame:
    fields = ["open", "high", "low", "close", "volume", "amount", "open_interest", "adj_vwap"]
    return market.prepare_panel(
        hourly(spark, sf), fields, date(2100, 1, 1), frequency="5m", rows=rows_of(spark, sf, "events")
    )


@query(
    "segments",
    f"""WITH {HOURLY} SELECT product, instrument_id, timestamp, valid_bar, eligible, target_eligible, segment_id,
  product_segment_id, CAST(5 AS BIGINT) AS bar_interval_minutes FROM panel""",
)
def segments(spark, sf):
    panel = hourly_panel(spark, sf)
    return panel.select(
        "product",
        "instrument_id",
        "timestamp",
        "valid_bar",
        "eligible",
        "target_eligible",
        "segment_id",
        "product_segment_id",
        F.col("bar_interval_minutes").cast("long").alias("bar_interval_minutes"),
    )


FAR = {"click": "error", "error": "purchase", "purchase": "signup", "signup": "view", "view": "click"}


def hourly_with_leg(spark, sf) -> DataFrame:
    """The hourly panel with the next event type as its first far contract."""
    names = ("exchange", "instrument_id", "open", "high", "low", "close", "volume", "amount", "open_interest")
    far = F.create_map(*[F.lit(v) for pair in FAR.items() for v in pair])
    bars = hourly(spark, sf)
    side = bars.select(
        F.col("product").alias("__far"), "timestamp", *[F.col(n).alias(f"{n}_p1") for n in names]
    )
    joined = bars.withColumn("__far", far[F.col("product")]).join(side, ["__far", "timestamp"], "left")
    fields = ["open", "high", "low", "close", "volume", "amount", "open_interest", "adj_vwap", "close_p1"]
    return market.prepare_panel(joined, fields, date(2100, 1, 1), rows=rows_of(spark, sf, "events"))


_FAR_CASE = "CASE a.product " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAR.items()) + " END"
LEGS = f"""{HOURLY},
l0 AS (SELECT a.*, f.exchange AS exchange_p1, f.instrument_id AS instrument_id_p1, f.open AS open_p1, f.high AS high_p1,
    f.low AS low_p1, f.close AS raw_p1,
    a.valid_bar AND coalesce(f.high >= greatest(f.open, f.close, f.low) AND f.low <= least(f.open, f.close, f.high), false) AS valid_bar_p1
  FROM panel a LEFT JOIN q f ON f.timestamp = a.timestamp AND f.product = {_FAR_CASE}),
l1 AS (SELECT *,
    CASE WHEN instrument_id_p1 = lag(instrument_id_p1) OVER s AND valid_bar_p1 AND lag(valid_bar_p1) OVER s THEN 0 ELSE 1 END AS own,
    CASE WHEN product_segment_id = lag(product_segment_id) OVER p AND instrument_id_p1 = lag(instrument_id_p1) OVER p
      AND valid_bar_p1 AND lag(valid_bar_p1) OVER p THEN 0 ELSE 1 END AS prod
  FROM l0 WINDOW s AS (PARTITION BY instrument_id, segment_id ORDER BY timestamp), p AS (PARTITION BY product ORDER BY timestamp)),
legs AS (SELECT * EXCLUDE (own, prod), CASE WHEN valid_bar_p1 THEN raw_p1 END AS close_p1,
    CAST(sum(own) OVER (PARTITION BY instrument_id, segment_id ORDER BY timestamp) AS BIGINT) AS segment_id_p1,
    CAST(sum(prod) OVER (PARTITION BY product ORDER BY timestamp) AS BIGINT) AS product_segment_id_p1 FROM l1)"""


@query(
    "leg_segments",
    f"""WITH {LEGS} SELECT instrument_id, timestamp, valid_bar_p1, segment_id, segment_id_p1, product_segment_id_p1,
  {q6("close_p1", "close_p1")} FROM legs""",
)
def leg_segments(spark, sf):
    panel = hourly_with_leg(spark, sf)
    keys = ["instrument_id", "timestamp", "valid_bar_p1", "segment_id", "segment_id_p1", "product_segment_id_p1"]
    return rounded(panel, keys, ["close_p1"])


# --- keys, audit, parity ----------------------------------------------------------------------------


@query(
    "key_report",
    """SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS surplus_rows,
  CAST(sum(CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_key_rows
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
)
def key_report(spark, sf):
    return scan.key_report(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    return scan.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_BROKEN = "high < low OR high < open OR high < close OR low > open OR low > close"


@query(
    "audit",
    f"""WITH {LINES} SELECT count(*) AS rows, min(trading_day) AS first_day, max(trading_day) AS last_day,
  count(DISTINCT (exchange, instrument_id)) AS instruments,
  count(*) - count(DISTINCT (exchange, instrument_id, timestamp)) AS duplicate_rows,
  count(*) FILTER (WHERE exchange IS NULL OR instrument_id IS NULL OR timestamp IS NULL) AS null_keys,
  count(*) FILTER (WHERE {_BROKEN}) AS invalid_ohlc, count(*) FILTER (WHERE close IS NULL) AS missing_close,
  count(*) FILTER (WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS missing_ohlc,
  count(*) FILTER (WHERE in_core) AS rows_in_core,
  count(*) FILTER (WHERE is_st IS NULL OR is_suspended IS NULL) AS missing_trading_flags,
  false AS passed, count(*) = count(DISTINCT (exchange, instrument_id, timestamp)) AS research_ready FROM b""",
)
def audit(spark, sf):
    report = audits.audit(line_bars(spark, sf))
    return report.drop("column_count", "label_columns")


@query(
    "audit_rows_by_year",
    "SELECT CAST(year(l_shipdate) AS BIGINT) AS year, count(*) AS rows FROM lineitem GROUP BY 1",
)
def audit_rows_by_year(spark, sf):
    years = audits.rows_by_year(line_bars(spark, sf))
    return years.select(F.col("year").cast("long").alias("year"), "rows")


@query(
    "audit_anomalies",
    f"""WITH {LINES} SELECT timestamp, exchange, instrument_id, {q6("open", "open")} FROM b
WHERE {_BROKEN}""",
)
def audit_anomalies(spark, sf):
    return rounded(audits.anomalies(line_bars(spark, sf)), ["timestamp", "exchange", "instrument_id"], ["open"])


@query(
    "panel_parity",
    f"""WITH {trade_sql("month")},
j AS (SELECT price AS a, CASE WHEN trades % 97 = 0 THEN NULL ELSE price + CASE WHEN trades > 8 THEN 1e-3 ELSE 0 END END AS b,
  volume AS c, volume AS d FROM trade)
SELECT 'price' AS "column", count(a) AS finite_rows, count(a) = count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AND count(b) = count(a) AS null_mask_equal,
  false AS within_tolerance, {q6("max(abs(a - b))", "max_absolute_error")}, CAST(0 AS BIGINT) AS unmatched_keys FROM j
UNION ALL SELECT 'volume', count(c), true, true, CAST(0 AS DOUBLE), 0 FROM j""",
)
def panel_parity(spark, sf):
    left = trade(spark, sf, "month")
    shifted = F.col("price") + F.when(F.col("trades") > 8, 1e-3).otherwise(0.0)
    right = left.withColumn("price", F.when(F.col("trades") % 97 != 0, shifted))
    report = audits.parity(left, right, ["instrument_id", "trading_day"], ["price", "volume"])
    return report.withColumn("max_absolute_error", r6("max_absolute_error"))


# --- futures --------------------------------------------------------------------------------------


@query(
    "latest_records",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC) AS n FROM lineitem)
WHERE n = 1""",
)
def latest_records(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return futures.keep_latest(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"])


def minute_bars(spark, sf) -> DataFrame:
    """Minute observations of all events, one record per event so that minutes repeat."""
    micros = F.lit(60_000_000).cast("long")
    return table(spark, sf, "events").select(
        F.lit("EV").alias("exchange"),
        F.lit("all").alias("product"),
        F.lit("all_0").alias("instrument_id"),
        F.col("ts").cast("date").alias("trading_day"),
        F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / micros) * micros).alias("bar_time"),
        F.col("value").alias("adj_open"),
        F.when(F.col("user_id") % 9 != 0, F.col("value") + 1).alias("adj_high"),
        (F.col("value") - 1).alias("adj_low"),
        (F.col("value") + 0.5).alias("adj_close"),
        F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("adj_vwap"),
        (F.col("user_id") % 5).alias("volume"),
        F.col("value").alias("turnover"),
        F.col("user_id").cast("double").alias("open_interest"),
        F.lit(1.0).alias("adj_cum_factor"),
        F.when(F.col("user_id") % 3 == 0, "proxy").when(F.col("user_id") % 3 == 1, "clamped").otherwise("no_trade").alias("vwap_flag"),
        F.when(F.col("event_type") == "error", "other").otherwise("main").alias("source"),
        F.lit("final").alias("quality"),
        (F.col("user_id") % 10 != 3).alias("is_dominant"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.col("event_id").alias("ingest_seq"),
    )


@query(
    "session_bars",
    f"""WITH newest AS (SELECT epoch_us(ts) // 60000000 AS minute, arg_max({{'value': value, 'user': user_id, 'day': CAST(ts AS DATE)}}, (ts, event_id)) AS e
  FROM events WHERE event_type <> 'error' AND user_id % 10 <> 3 GROUP BY 1),
island AS (SELECT e.value AS v, e.user AS u, e.day AS trading_day, minute, minute - row_number() OVER (PARTITION BY e.day ORDER BY minute) AS run FROM newest),
placed AS (SELECT *, (minute - min(minute) OVER (PARTITION BY trading_day, run)) // 3 AS part, u % 5 AS q,
  CASE WHEN u % 7 <> 0 AND u % 5 > 0 THEN u % 5 END AS weight FROM island)
SELECT trading_day, make_timestamp(max(minute) * 60000000) AS timestamp, {q6("arg_min(v, minute)", "adj_open")},
  {q6("CASE WHEN min(u % 9) > 0 THEN max(v) + 1 END", "adj_high")}, {q6("min(v) - 1", "adj_low")}, {q6("arg_max(v, minute) + 0.5", "adj_close")},
  {q6("ln(sum(v * weight) / sum(weight))", "adj_vwap")}, CAST(sum(q) AS BIGINT) AS volume, {q6("sum(v)", "amount")},
  {q6("arg_max(u, minute)", "open_interest")}, count(*) AS source_bars, count_if(u % 3 = 0) AS vwap_proxy_bars,
  count_if(u % 3 = 1) AS vwap_clamped_bars, count_if(u % 3 = 2) AS vwap_no_trade_bars
FROM placed GROUP BY trading_day, run, part""",
)
def session_bars(spark, sf):
    bars = futures.export_bars(minute_bars(spark, sf), "main", size=3)
    values = ["adj_open", "adj_high", "adj_low", "adj_close", "amount", "open_interest"]
    counts = ["source_bars", "vwap_proxy_bars", "vwap_clamped_bars", "vwap_no_trade_bars"]
    return bars.select(
        "trading_day", "timestamp", *[r6(v).alias(v) for v in values], r6(F.ln("adj_vwap")).alias("adj_vwap"), "volume", *counts
    )


def contracts(spark, sf) -> DataFrame:
    """Instruments from parts: a brand lists many contracts with their own lifetimes."""
    listed = F.date_add(F.lit("1994-06-01").cast("date"), (F.col("p_partkey") * 7 % 1500).cast("int"))
    matures = F.date_add(listed, (F.lit(300) + F.col("p_size") * 10).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("instrument_id"),
        F.col("p_type").alias("exchange"),
        F.col("p_brand").alias("underlying_symbol"),
        listed.cast("string").alias("listed_date"),
        F.when(F.col("p_partkey") % 50 != 0, matures.cast("string")).otherwise("unknown").alias("de_listed_date"),
        matures.cast("string").alias("maturity_date"),
        F.col("p_size").alias("contract_multiplier"),
    )


def dominant_days(spark, sf) -> DataFrame:
    """Per brand and month the part with the largest shipped quantity."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_quantity")
    sold = lines.groupBy("l_partkey", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("trading_day")).agg(
        F.sum("l_quantity").alias("q")
    )
    brands = table(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        sold.join(brands, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("product"), "trading_day")
        .agg(F.max_by("l_partkey", F.struct("q", "l_partkey")).alias("instrument_id"))
    )


CONTRACTS = """c AS (SELECT p_partkey AS instrument_id, p_type AS exchange, p_brand AS product, listed,
    CASE WHEN p_partkey % 50 <> 0 THEN listed + CAST(300 + p_size * 10 AS INTEGER) END AS delisted,
    listed + CAST(300 + p_size * 10 AS INTEGER) AS matures, p_size AS contract_multiplier
  FROM (SELECT *, DATE '1994-06-01' + CAST(p_partkey * 7 % 1500 AS INTEGER) AS listed FROM part)),
mapping AS (SELECT p_brand AS product, trading_day, last(l_partkey ORDER BY q, l_partkey) AS instrument_id FROM (
    SELECT l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS trading_day, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
  JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
FAR_MAPPING = f"""{CONTRACTS},
a AS (SELECT m.*, c.exchange, c.matures FROM mapping m LEFT JOIN c ON c.instrument_id = m.instrument_id),
f AS (SELECT a.instrument_id, a.trading_day, a.product, c.instrument_id AS far, c.matures - a.trading_day AS days,
    row_number() OVER (PARTITION BY a.exchange, a.instrument_id, a.trading_day ORDER BY c.matures, c.instrument_id) AS leg
  FROM a JOIN c ON c.exchange = a.exchange AND c.product = a.product AND c.matures > a.matures
    AND c.listed <= a.trading_day AND c.delisted >= a.trading_day),
far AS (SELECT a.product, a.trading_day, a.instrument_id, a.exchange, CAST(a.matures - a.trading_day AS BIGINT) AS days_to_maturity,
    f1.far AS instrument_id_p1, CAST(f1.days AS BIGINT) AS days_to_maturity_p1, f2.far AS instrument_id_p2,
    CAST(f2.days AS BIGINT) AS days_to_maturity_p2
  FROM a LEFT JOIN f f1 ON f1.leg = 1 AND f1.instrument_id = a.instrument_id AND f1.trading_day = a.trading_day
  LEFT JOIN f f2 ON f2.leg = 2 AND f2.instrument_id = a.instrument_id AND f2.trading_day = a.trading_day)"""
_FAR_COLUMNS = ("days_to_maturity", "instrument_id_p1", "days_to_maturity_p1", "instrument_id_p2", "days_to_maturity_p2")


@query(
    "far_contracts",
    f"""WITH {FAR_MAPPING} SELECT product, trading_day, instrument_id, exchange,
  {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FAR_COLUMNS)} FROM far""",
)
def far_contracts(spark, sf):
    mapped = futures.far_contract_mapping(dominant_days(spark, sf), contracts(spark, sf))
    keys = ["product", "trading_day", "instrument_id", "exchange"]
    return mapped.select(*keys, *[F.col(c).cast("double").alias(c) for c in _FAR_COLUMNS])


def part_bars(spark, sf) -> DataFrame:
    """Monthly bars per part, the observations of the contracts."""
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    bars = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("instrument_id"), month.alias("trading_day")).agg(
        (F.sum(cents("l_extendedprice")) / F.lit(100.0) / F.sum("l_quantity")).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )
    types = table(spark, sf, "part").select(F.col("p_partkey").alias("instrument_id"), F.col("p_type").alias("exchange"))
    return bars.join(types, "instrument_id").withColumn("timestamp", F.col("trading_day").cast("timestamp"))


@query(
    "attach_far_bars",
    f"""WITH {FAR_MAPPING},
pb AS (SELECT l_partkey AS instrument_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS trading_day,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS close FROM lineitem GROUP BY 1, 2)
SELECT far.instrument_id, far.trading_day, {q6("ln(a.close)", "close")}, {q6("ln(b.close)", "close_p1")}, {q6("ln(c.close)", "close_p2")}
FROM far JOIN pb a ON a.instrument_id = far.instrument_id AND a.trading_day = far.trading_day
LEFT JOIN pb b ON b.instrument_id = far.instrument_id_p1 AND b.trading_day = far.trading_day
LEFT JOIN pb c ON c.instrument_id = far.instrument_id_p2 AND c.trading_day = far.trading_day""",
)
def attach_far_bars(spark, sf):
    mapped = futures.far_contract_mapping(dominant_days(spark, sf), contracts(spark, sf))
    bars = part_bars(spark, sf)
    anchors = bars.join(mapped.select("instrument_id", "trading_day", "exchange"), ["instrument_id", "trading_day", "exchange"])
    wide = futures.attach_far_bars(anchors, bars, mapped, ("close", "volume"))
    closes = ["close", "close_p1", "close_p2"]
    return rounded(wide.withColumns({c: F.ln(c) for c in closes}), ["instrument_id", "trading_day"], closes)


@query(
    "dominant_bars",
    f"""WITH {CONTRACTS}
SELECT l_orderkey, l_linenumber, l_partkey AS instrument_id, m.product, c.exchange, CAST(c.contract_multiplier AS BIGINT) AS contract_multiplier
FROM lineitem JOIN mapping m ON m.instrument_id = l_partkey AND m.trading_day = CAST(date_trunc('month', l_shipdate) AS DATE)
LEFT JOIN c ON c.instrument_id = l_partkey""",
)
def dominant_bars(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("order_book_id"),
        F.col("l_shipdate").alias("datetime"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("trading_date"),
        F.col("l_extendedprice").alias("total_turnover"),
    )
    bars = futures.normalize_bars(raw, dominant_days(spark, sf), contracts(spark, sf))
    return bars.select(
        "l_orderkey", "l_linenumber", "instrument_id", "product", "exchange", F.col("contract_multiplier").cast("long").alias("contract_multiplier")
    )


@query(
    "missing_mapped_days",
    """WITH m AS (SELECT DISTINCT o_custkey % 100 AS instrument_id, CAST(o_orderdate AS DATE) AS trading_day FROM orders)
SELECT m.* FROM m ANTI JOIN lineitem ON l_suppkey = instrument_id AND CAST(l_shipdate AS DATE) = trading_day""",
)
def missing_mapped_days(spark, sf):
    mapping = (
        table(spark, sf, "orders")
        .select(
            (F.col("o_custkey") % 100).alias("instrument_id"),
            F.col("o_orderdate").cast("date").alias("trading_day"),
        )
        .distinct()
    )
    bars = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("instrument_id"), F.col("l_shipdate").cast("date").alias("trading_day")
    )
    return futures.missing_mapped_days(mapping, bars).select("instrument_id", "trading_day")


# --- equities -------------------------------------------------------------------------------------


def memberships(spark, sf) -> DataFrame:
    """(day, instrument, universe): suppliers that shipped under each return flag in a month."""
    return (
        table(spark, sf, "lineitem")
        .select(
            F.trunc(F.col("l_shipdate").cast("date"), "month").alias("trading_day"),
            F.col("l_suppkey").alias("instrument_id"),
            F.col("l_returnflag").alias("universe"),
        )
        .distinct()
    )


@query(
    "membership_flags",
    """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trading_day, l_suppkey AS instrument_id,
  bool_or(l_returnflag = 'A') AS "in_A", bool_or(l_returnflag = 'N') AS "in_N", bool_or(l_returnflag = 'R') AS "in_R",
  true AS in_any FROM lineitem GROUP BY 1, 2""",
)
def membership_flags(spark, sf):
    return equities.membership_flags(memberships(spark, sf), ["A", "N", "R"], "any")


@query(
    "long_flags",
    """WITH w AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trading_day, bool_or(l_returnflag = 'A' AND l_quantity > 49) AS a,
  bool_or(l_returnflag = 'N' AND l_quantity > 49) AS n, bool_or(l_returnflag = 'R' AND l_quantity > 49) AS r FROM lineitem GROUP BY 1)
SELECT trading_day, 'A' AS instrument_id, a AS large FROM w UNION ALL SELECT trading_day, 'N', n FROM w UNION ALL SELECT trading_day, 'R', r FROM w""",
)
def long_flags(spark, sf):
    flag, large = F.col("l_returnflag"), F.col("l_quantity") > 49
    wide = table(spark, sf, "lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("trading_day")).agg(
        *[F.bool_or((flag == f) & large).alias(f) for f in ("A", "N", "R")]
    )
    return equities.long_flags(wide, "large")


@query(
    "publish_next_day",
    """WITH c AS (SELECT d, lead(d) OVER (ORDER BY d) AS next FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders))
SELECT o_orderkey, c.d AS source_day, c.next AS available_day FROM orders JOIN c ON CAST(o_orderdate AS DATE) = c.d WHERE c.next IS NOT NULL""",
)
def publish_next_day(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("source_day"))
    calendar = orders.select(F.col("source_day").alias("trading_day")).distinct()
    return equities.publish_next_day(orders, calendar)


def adjustments(spark, sf) -> DataFrame:
    """Cumulative factors per supplier, effective on days of large lines."""
    big = table(spark, sf, "lineitem").where("l_quantity = 50 and l_tax >= 0.06")
    return big.groupBy(F.col("l_suppkey").alias("instrument_id"), F.col("l_shipdate").cast("date").alias("ex_date")).agg(
        (F.max("l_discount") + 1).alias("adjfactor")
    )


@query(
    "adjusted_prices",
    f"""WITH {trade_sql()},
a AS (SELECT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) AS ex_date, max(l_discount) + 1 AS f FROM lineitem
  WHERE l_quantity = 50 AND l_tax >= 0.06 GROUP BY 1, 2)
SELECT t.instrument_id, t.trading_day, {q6("coalesce(a.f, 1)", "adjfactor")}, {q6("ln(t.low * coalesce(a.f, 1))", "log_low")},
  {q6("ln(t.high * coalesce(a.f, 1))", "log_high")}
FROM trade t ASOF LEFT JOIN a ON t.instrument_id = a.instrument_id AND t.trading_day >= a.ex_date""",
)
def adjusted_prices(spark, sf):
    bars = trade(spark, sf)
    priced = equities.adjust_prices(bars, adjustments(spark, sf), ("low", "high"), 2 * rows_of(spark, sf, "lineitem"))
    logged = priced.withColumns({"log_low": F.ln("adj_low"), "log_high": F.ln("adj_high")})
    return rounded(logged, ["instrument_id", "trading_day"], ["adjfactor", "log_low", "log_high"])


@query(
    "missing_member_reasons",
    f"""WITH {CONTRACTS}, f AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS trading_day, p_partkey AS instrument_id
    FROM orders JOIN part ON o_custkey = p_partkey),
b AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS trading_day, l_partkey AS instrument_id FROM lineitem),
m AS (SELECT f.* FROM f ANTI JOIN b USING (trading_day, instrument_id))
SELECT CASE WHEN trading_day < listed THEN 'before_listing' WHEN trading_day >= delisted THEN 'on_or_after_delisting'
  ELSE 'unresolved' END AS reason, count(*) AS member_days
FROM m LEFT JOIN c USING (instrument_id) GROUP BY 1""",
)
def missing_member_reasons(spark, sf):
    orders = table(spark, sf, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("trading_day"), "o_custkey")
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("instrument_id"))
    flags = orders.join(ids, F.col("o_custkey") == F.col("instrument_id")).select("trading_day", "instrument_id").distinct()
    missing = equities.missing_members(flags, part_bars(spark, sf))
    return equities.missing_summary(equities.classify_missing(missing, contracts(spark, sf)))


# --- daily reductions and as-of -------------------------------------------------------------------


@query(
    "daily_base",
    f"""WITH {HOURLY}, p AS (SELECT *, CASE WHEN valid_bar THEN adj_vwap END AS v, CASE WHEN valid_bar THEN volume END AS w,
  CASE WHEN valid_bar THEN amount END AS m, CASE WHEN valid_bar THEN open_interest END AS o FROM panel)
SELECT product, trading_day, {q6("ln(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END))", "price")},
  {q6("CASE WHEN count(w) = count(*) THEN sum(w) END", "volume")}, {q6("CASE WHEN count(m) = count(*) THEN sum(m) END", "amount")},
  {q6("arg_max_null(o, timestamp)", "oi")} FROM p GROUP BY 1, 2""",
)
def daily_base(spark, sf):
    reduced = daily.daily_base(hourly_panel(spark, sf))
    return reduced.select(
        "product", "trading_day", r6(F.ln("price")).alias("price"), *[r6(c).alias(c) for c in ("volume", "amount", "oi")]
    )


@query(
    "daily_curve",
    f"""WITH {LEGS}, p AS (SELECT *, CASE WHEN valid_bar AND close > 0 THEN close END AS c0,
  CASE WHEN valid_bar AND close > 0 THEN instrument_id END AS i0,
  CASE WHEN valid_bar_p1 AND close_p1 > 0 THEN close_p1 END AS c1, CASE WHEN valid_bar_p1 AND close_p1 > 0 THEN instrument_id_p1 END AS i1 FROM legs)
SELECT product, trading_day, {q6("arg_max_null(c0, timestamp)", "F0")}, arg_max_null(i0, timestamp) AS leg0,
  {q6("arg_max_null(c1, timestamp)", "F1")}, arg_max_null(i1, timestamp) AS leg1 FROM p GROUP BY 1, 2""",
)
def daily_curve(spark, sf):
    panel = hourly_with_leg(spark, sf)
    # The second far leg is the first one again, so that all three columns exist.
    wide = panel.withColumns({f"{n}_p2": F.col(f"{n}_p1") for n in ("valid_bar", "close", "instrument_id")})
    curve = daily.daily_curve(wide)
    return curve.select("product", "trading_day", r6("F0").alias("F0"), "leg0", r6("F1").alias("F1"), "leg1")


@query(
    "asof_events",
    f"""WITH p AS (SELECT user_id, ts, CASE WHEN value > 50 THEN NULL ELSE ln(value + 1) END AS v FROM events WHERE event_type = 'purchase'),
c AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase')
SELECT c.event_id, {q6("p.v", "v")} FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts""",
)
def asof_events(spark, sf):
    """Latest purchase of the same user; a purchase without a value replaces older ones."""
    events = table(spark, sf, "events")
    value = F.when(F.col("value") <= 50, F.ln(F.col("value") + 1))
    right = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), value.alias("v"))
    left = events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    joined = asof_join(left, right, ["user_id"], "ts", "at", ["v"], rows_of(spark, sf, "events"))
    return rounded(joined, ["event_id"], ["v"])
