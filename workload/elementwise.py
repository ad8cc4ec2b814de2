"""Element-wise operators, scalar date and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import feature as fx
from factorloom.sources.equities import close_time
from factorloom.sources.futures import delivery_contracts, parse_lifetimes

from .base import KEY, q6, query, r6, rounded, rows_of, table, trade_panel, trade_sql

X, Y = fx.field("x"), fx.field("y")
LIFT = fx.subtract(X, 2)  # around zero, both signs


def _run(spark, sf, features):
    return rounded(trade_panel(spark, sf).with_features(features), KEY, list(features))


def _sql(columns: dict[str, str]) -> str:
    chosen = ", ".join(q6(e, n) for n, e in columns.items())
    return f"""WITH {trade_sql()}, p AS (SELECT *, x - 2 AS d FROM trade)
SELECT instrument_id, trading_day, {chosen} FROM p"""


@query(
    "ew_arithmetic",
    _sql(
        {
            "add_": "x + y",
            "subtract_": "x - y",
            "multiply_": "x * y",
            "divide_": "CASE WHEN abs(d) > 1e-12 THEN y / d END",
            "minimum_": "CASE WHEN x IS NOT NULL THEN least(x, y) END",
            "maximum_": "CASE WHEN x IS NOT NULL THEN greatest(x, y) END",
        }
    ),
)
def ew_arithmetic(spark, sf):
    return _run(
        spark,
        sf,
        {
            "add_": X + Y,
            "subtract_": X - Y,
            "multiply_": X * Y,
            "divide_": Y / LIFT,
            "minimum_": fx.minimum(X, Y),
            "maximum_": fx.maximum(X, Y),
        },
    )


@query(
    "ew_unary",
    _sql(
        {
            "neg_": "-d",
            "abs_": "abs(d)",
            "sign_": "sign(d)",
            "log_": "CASE WHEN d > 0 THEN ln(d) END",
            "log1p_": "CASE WHEN d > -1 THEN ln(1 + d) END",
            "sqrt_": "CASE WHEN d >= 0 THEN sqrt(d) END",
            "exp_": "exp(d)",
            "exp_overflow": "CASE WHEN d IS NOT NULL THEN CASE WHEN d * 1000 < 709.782712893384 THEN 0 ELSE 1 END END",
        }
    ),
)
def ew_unary(spark, sf):
    return _run(
        spark,
        sf,
        {
            "neg_": -LIFT,
            "abs_": fx.absolute(LIFT),
            "sign_": fx.sign(LIFT),
            "log_": fx.log(LIFT),
            "log1p_": fx.log1p(LIFT),
            "sqrt_": fx.sqrt(LIFT),
            "exp_": fx.exp(LIFT),
            # Overflow is null: the marker is 1 exactly where a known input has no exponential.
            "exp_overflow": LIFT * 0 + fx.if_then_else(fx.is_finite(fx.exp(LIFT * 1000)), 0, 1),
        },
    )


@query(
    "ew_power_clip",
    _sql(
        {
            "square": "pow(d, 2)",
            "inverse": "CASE WHEN d <> 0 THEN pow(d, -1) END",
            "signed_root": "sign(d) * pow(abs(d), 0.5)",
            "clip_": "CASE WHEN d IS NOT NULL THEN least(greatest(d, -0.25), 0.25) END",
        }
    ),
)
def ew_power_clip(spark, sf):
    return _run(
        spark,
        sf,
        {
            "square": fx.power(LIFT, 2),
            "inverse": fx.power(LIFT, -1),
            "signed_root": fx.signed_power(LIFT, 0.5),
            "clip_": fx.clip(LIFT, -0.25, 0.25),
        },
    )


_YES = "CASE WHEN {0} IS NOT NULL THEN CASE WHEN {0} THEN 1 ELSE 0 END END"


def _as_number(condition):
    return fx.if_then_else(condition, 1, 0)


@query(
    "ew_compare",
    _sql(
        {
            n: _YES.format(f"(x {op} y / 2)")
            for n, op in {"lt_": "<", "le_": "<=", "gt_": ">", "ge_": ">=", "eq_": "=", "ne_": "<>"}.items()
        }
    ),
)
def ew_compare(spark, sf):
    half = Y / 2
    return _run(
        spark,
        sf,
        {
            f"{n}_": _as_number(getattr(fx, n)(X, half)) for n in ("lt", "le", "gt", "ge", "eq", "ne")
        },
    )


@query(
    "ew_logic",
    _sql(
        {
            "and_": _YES.format("(CASE WHEN x IS NOT NULL THEN x > 2 AND y > 3 END)"),
            "or_": _YES.format("(CASE WHEN x IS NOT NULL THEN x > 2 OR y > 3 END)"),
            "not_": _YES.format("(NOT (x > 2))"),
            "if_": "CASE WHEN x IS NOT NULL THEN CASE WHEN x > 2 THEN x ELSE y END END",
            "finite_": "CASE WHEN x IS NOT NULL THEN 1 ELSE 0 END",
            "fill_": "coalesce(x, y)",
        }
    ),
)
def ew_logic(spark, sf):
    high, large = X > 2, Y > 3
    return _run(
        spark,
        sf,
        {
            "and_": _as_number(fx.both(high, large)),
            "or_": _as_number(fx.either(high, large)),
            "not_": _as_number(fx.negate(high)),
            "if_": fx.if_then_else(high, X, Y),
            "finite_": _as_number(fx.is_finite(X)),
            "fill_": fx.fillna(X, Y),
        },
    )


@query(
    "ew_aliases",
    f"""WITH {trade_sql()}
SELECT instrument_id, trading_day, {q6("x - y", "sub_")}, {q6("x * y", "mul_")},
  {q6("CASE WHEN abs(y) > 1e-12 THEN x / y END", "div_")}, {q6("pow(x, 2)", "pow_")},
  {q6("CASE WHEN count(y) OVER w2 = 2 THEN lag(y) OVER o END", "lag_")},
  {q6("CASE WHEN count(y) OVER w2 = 2 THEN y / lag(y) OVER o - 1 END", "pct_")}
FROM trade WINDOW o AS (PARTITION BY exchange, instrument_id ORDER BY trading_day),
  w2 AS (PARTITION BY exchange, instrument_id ORDER BY trading_day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
)
def ew_aliases(spark, sf):
    return _run(
        spark,
        sf,
        {
            "sub_": fx.sub(X, Y),
            "mul_": fx.mul(X, Y),
            "div_": fx.div(X, Y),
            "pow_": fx.pow_(X, 2),
            "lag_": fx.lag(Y, 1),
            "pct_": fx.ts_pctchange(Y, 1),
        },
    )


@query(
    "scalar_dates",
    """SELECT o_orderkey, CAST(date_trunc('month', d) AS DATE) AS month_start,
  CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) AS previous_month,
  CAST(d - DATE '1995-01-01' AS BIGINT) AS days_since,
  CAST(year(d) AS BIGINT) AS year_, CAST(hour(CAST(d AS TIMESTAMP) + INTERVAL 15 HOUR) AS BIGINT) AS close_hour,
  TRY_CAST(o_orderpriority AS DATE) IS NULL AS unparsable,
  split_part(o_orderpriority || '.EX' || CAST(o_orderkey % 3 AS VARCHAR), '.', 2) AS exchange,
  epoch_us(make_timestamp(epoch_us(o_orderdate) + 60000000)) - epoch_us(o_orderdate) AS micros
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def scalar_dates(spark, sf):
    orders = table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    suffix = F.concat(F.col("o_orderpriority"), F.lit(".EX"), (F.col("o_orderkey") % 3).cast("string"))
    stamped = close_time(orders.withColumn("trading_day", F.col("d")).withColumn("instrument_id", suffix))
    parsed = parse_lifetimes(stamped.withColumn("text", F.col("o_orderpriority")), ("text",))
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    later = F.timestamp_micros(micros + 60_000_000)
    return parsed.select(
        "o_orderkey",
        F.trunc("d", "month").alias("month_start"),
        F.add_months(F.trunc("d", "month"), -1).alias("previous_month"),
        F.datediff("d", F.lit("1995-01-01").cast("date")).cast("long").alias("days_since"),
        F.year("d").cast("long").alias("year_"),
        F.hour("timestamp").cast("long").alias("close_hour"),
        F.col("text").isNull().alias("unparsable"),
        "exchange",
        (F.unix_micros(later) - micros).alias("micros"),
    )


@query(
    "delivery_contracts",
    """SELECT p_partkey, p_brand || CAST(p_partkey AS VARCHAR) AS instrument_id FROM part
WHERE regexp_matches(p_brand || CAST(p_partkey AS VARCHAR), '[0-9]{4}$')""",
)
def contracts(spark, sf):
    named = table(spark, sf, "part").select(
        "p_partkey", F.concat("p_brand", F.col("p_partkey").cast("string")).alias("instrument_id")
    )
    return delivery_contracts(named)


@query(
    "month_grid",
    """WITH span AS (SELECT l_suppkey, min(date_trunc('month', l_shipdate)) AS a, max(date_trunc('month', l_shipdate)) AS b
  FROM lineitem GROUP BY 1)
SELECT l_suppkey, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM span""",
)
def month_grid(spark, sf):
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    step = F.expr("interval 1 month")
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey")
        .agg(F.explode(F.sequence(F.min(month), F.max(month), step)).alias("month"))
    )
