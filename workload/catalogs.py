"""Ready-made catalogues: 22 trend / carry factors, 26 monthly characteristics and the grammar sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factorloom.operators.blocks import join_stats
from factorloom.operators.panel import Panel, PanelSpec
from factorloom.operators.scoring import CROSS_SECTIONAL, metric_names
from factorloom.plans import characteristics, cta, sweep

from .base import FOLD, cents, q6, query, r6, rounded, rows_of, table
from .scores import SCORED, TARGETS, _aggregate_sql, target_panel

DAYS_PER_BAR = 3


def region_days(spark, sf) -> DataFrame:
    """Three-day bars per region with curve legs and inventory-like columns.

    Lines are combined per supplier before the supplier join; all sums are whole numbers.
    """
    day = F.date_sub("__d", (F.datediff("__d", F.lit("1995-01-01").cast("date")) % DAYS_PER_BAR).cast("int"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    lines = (
        table(spark, sf, "lineitem")
        .select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
        .withColumn("__d", F.col("l_shipdate").cast("date"))
        .withColumn("trading_day", day)
    )
    sums = {"n": F.lit(1), "c": cents("l_extendedprice"), "q": F.col("l_quantity").cast("long")}
    aggregates = [F.max(unit).alias("high"), F.min(unit).alias("low")]
    aggregates += [F.sum(c).alias(k) for k, c in sums.items()]
    aggregates += [F.sum(cents("l_discount")).alias("disc"), F.sum(cents("l_tax")).alias("tax")]
    for flag in ("A", "N", "R"):
        mine = F.col("l_returnflag") == flag
        aggregates += [F.sum(F.when(mine, sums[k])).alias(f"{k}{flag}") for k in ("c", "q")]
    per_supplier = lines.groupBy("l_suppkey", "trading_day").agg(*aggregates)
    places = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("product"))
    )
    totals = ["n", "c", "q", "disc", "tax", "cA", "qA", "cN", "qN", "cR", "qR"]
    placed = join_stats(per_supplier, places, ["l_suppkey"], rows_of(spark, sf, "supplier"))
    days = placed.groupBy("product", "trading_day").agg(
        F.max("high").alias("high"), F.min("low").alias("low"), *[F.sum(t).alias(t) for t in totals]
    )

    def d(name: str):
        return F.col(name).cast("double")

    month_day = F.dayofmonth("trading_day")
    return days.select(
        F.lit("TR").alias("exchange"),
        "product",
        F.col("product").alias("instrument_id"),
        "trading_day",
        "high",
        "low",
        (d("c") / 100 / d("q")).alias("close"),
        d("q").alias("volume"),
        (d("c") / 100).alias("amount"),
        d("n").alias("open_interest"),
        (d("cA") / 100 / d("qA")).alias("close_p0"),
        (d("cN") / 100 / d("qN")).alias("close_p1"),
        (d("cR") / 100 / d("qR")).alias("close_p2"),
        (40 - month_day).cast("double").alias("days_to_maturity"),
        (100 - month_day / 2).cast("double").alias("days_to_maturity_p1"),
        (d("disc") / d("n") / 100 - 0.05).alias("roll_return"),
        F.sqrt(d("tax")).alias("basis"),
        F.sqrt(d("qA")).alias("broker_net"),
        (d("qA") / d("q")).alias("ls_ratio"),
        F.sqrt(d("n") / d("q")).alias("virtual_ratio"),
        d("qN").alias("inventory"),
        d("qR").alias("warehouse_receipt"),
        (d("tax") / d("n")).alias("spot_profit"),
        F.concat(F.lit("A"), F.year("trading_day"), F.quarter("trading_day")).alias("leg0"),
        F.concat(F.lit("N"), F.year("trading_day"), F.floor((F.month("trading_day") - 1) / 6)).alias("leg1"),
    )


def _flag_sums() -> str:
    parts = []
    for f in "ANR":
        parts.append(f"CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_returnflag = '{f}') AS DOUBLE) AS c{f}")
        parts.append(f"CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = '{f}') AS DOUBLE) AS q{f}")
    return ", ".join(parts)


REGION_DAYS = f"""rd0 AS (SELECT r_name AS product, CAST(l_shipdate AS DATE) - CAST((CAST(l_shipdate AS DATE) - DATE '1995-01-01') % {DAYS_PER_BAR} AS INTEGER) AS trading_day,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, CAST(count(*) AS DOUBLE) AS n,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS c, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS q,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS disc, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS tax, {_flag_sums()}
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2),
rd AS (SELECT 'TR' AS exchange, product, product AS instrument_id, trading_day, high, low, c / 100 / q AS close, q AS volume, c / 100 AS amount, n AS open_interest,
    cA / 100 / qA AS close_p0, cN / 100 / qN AS close_p1, cR / 100 / qR AS close_p2, CAST(40 - day(trading_day) AS DOUBLE) AS days_to_maturity,
    CAST(100 - day(trading_day) / 2 AS DOUBLE) AS days_to_maturity_p1, disc / n / 100 - CAST(0.05 AS DOUBLE) AS roll_return, sqrt(tax) AS basis, sqrt(qA) AS broker_net,
    qA / q AS ls_ratio, sqrt(n / q) AS virtual_ratio, qN AS inventory, qR AS warehouse_receipt, tax / n AS spot_profit,
    'A' || year(trading_day) || quarter(trading_day) AS leg0, 'N' || year(trading_day) || ((month(trading_day) - 1) // 6) AS leg1 FROM rd0)"""

_W = "PARTITION BY product ORDER BY trading_day ROWS BETWEEN {0} PRECEDING AND CURRENT ROW"


def _w(n: int) -> str:
    return "(" + _W.format(n - 1) + ")"


def _full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN {value} END"


def _lag(x: str, n: int) -> str:
    return _full(x, n + 1, f"lag({x}, {n}) OVER (PARTITION BY product ORDER BY trading_day)")


def _change(x: str, n: int) -> str:
    return f"({x} / ({_lag(x, n)}) - 1)"


def _zscore(x: str, n: int) -> str:
    return _full(x, n, f"CASE WHEN stddev_samp({x}) OVER {_w(n)} > 1e-12 THEN ({x} - avg({x}) OVER {_w(n)}) / stddev_samp({x}) OVER {_w(n)} END")


_CARRY = "(close / close_p1 - 1) * 365 / (days_to_maturity_p1 - days_to_maturity)"
_CTA_ONE = {
    "tsmom_252": _change("close", 252),
    "tsmom_252_21": f"({_lag('close', 21)}) / ({_lag('close', 252)}) - 1",
    "tsmom_63": _change("close", 63),
    "hh": _full("high", 55, f"max(high) OVER {_w(55)}"),
    "ll": _full("low", 55, f"min(low) OVER {_w(55)}"),
    "hv": _full("bar", 20, f"stddev_samp(bar) OVER {_w(20)}") + " * sqrt(252)",
    "ma20": _full("close", 20, f"avg(close) OVER {_w(20)}"),
    "ma100": _full("close", 100, f"avg(close) OVER {_w(100)}"),
    "carry_ann": _CARRY,
    "roll_return_63": _full("roll_return", 63, f"sum(roll_return) OVER {_w(63)}"),
    "basis_mom_20": f"basis - ({_lag('basis', 20)})",
    "ts_slope": "ln(close_p1 / close) / (days_to_maturity_p1 - days_to_maturity)",
    "ts_curvature": "close_p2 - 2 * close_p1 + close",
    "oi_price_confirm_20": f"sign(close - ({_lag('close', 20)})) * ln(open_interest / ({_lag('open_interest', 20)}))",
    "broker_net_chg_5": f"(broker_net - ({_lag('broker_net', 5)})) / open_interest",
    "ls_ratio_z": _zscore("ls_ratio", 60),
    "virtual_ratio_chg": f"virtual_ratio - ({_lag('virtual_ratio', 20)})",
    "inventory_mom_20": f"ln(inventory / ({_lag('inventory', 20)}))",
    "receipt_mom_20": f"ln(warehouse_receipt / ({_lag('warehouse_receipt', 20)}))",
    "spot_profit_z": _zscore("spot_profit", 60),
    "st_reversal_5": "-" + _change("close", 5),
}
_CTA_TWO = {
    "sma_xover_20_100": "(ma20 - ma100) / (hv * close)",
    "xsmom_252_21": "(tsmom_252_21 - avg(tsmom_252_21) OVER t) / stddev_samp(tsmom_252_21) OVER t",
    "xsmom_63": "(tsmom_63 - avg(tsmom_63) OVER t) / stddev_samp(tsmom_63) OVER t",
    "vol_scaled_carry": "carry_ann / hv",
    "lowvol": "-hv",
}
CTA_NAMES = [e.name for e in cta.cta_catalog()]


def _cta_expression(name: str) -> str:
    if name == "breakout_55":
        inner = "(close - (hh + ll) / 2) / ((hh - ll) / 2)"
        return f"CASE WHEN {inner} IS NOT NULL THEN least(1, greatest(-1, {inner})) END"
    return _CTA_TWO.get(name, name)


@query(
    "cta_catalog",
    f"""WITH {REGION_DAYS}, b AS (SELECT *, ln(close / ({_lag("close", 1)})) AS bar FROM rd),
one AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _CTA_ONE.items())} FROM b)
SELECT product, trading_day, {", ".join(q6(_cta_expression(n), n, 5 if n == "ts_curvature" else 6) for n in CTA_NAMES)}
FROM one WINDOW t AS (PARTITION BY trading_day)""",
)
def cta_catalog(spark, sf):
    """All 22 factors of the catalogue in one staged plan."""
    spec = PanelSpec(identity=("exchange", "instrument_id"), time="trading_day")
    panel = Panel(region_days(spark, sf), spec, rows_of(spark, sf, "lineitem"))
    features = cta.available(cta.cta_catalog(), panel.df.columns)
    wide = panel.with_features(features)
    return wide.select(
        "product", "trading_day", *[r6(n, 5 if n == "ts_curvature" else 6).alias(n) for n in CTA_NAMES]
    )


def base_and_curve(spark, sf) -> tuple[DataFrame, DataFrame]:
    days = region_days(spark, sf)
    key = ["exchange", "product", "trading_day"]
    base = days.select(*key, F.col("close").alias("price"), "volume", "amount", F.col("open_interest").alias("oi"))
    curve = days.select(
        *key,
        F.col("close_p0").alias("F0"),
        F.col("close_p1").alias("F1"),
        F.col("close_p2").alias("F2"),
        "leg0",
        "leg1",
    )
    return base, curve


def _mw(n: int) -> str:
    return f"(PARTITION BY product ORDER BY month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _mfull(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {_mw(n)} = {n} THEN {value} END"


def _mlag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY product ORDER BY month)"


def _mcompound(x: str, n: int) -> str:
    return _mfull(x, n, f"product(1 + {x}) OVER {_mw(n)} - 1")


_SEG = "(PARTITION BY product, segment ORDER BY trading_day ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"


def _residual(n: int) -> str:
    """Closed form of the residual deviation on three regressors over n months."""
    names = {"v": "R", "a": "market", "b": "by_basis", "c": "by_mom"}
    keys = list(names)
    cov = ", ".join(
        f"covar_pop({names[p]}, {names[q]}) OVER {_mw(n)} AS s{p}{q}" for i, p in enumerate(keys) for q in keys[i:]
    )
    known = " AND ".join(f"count({c}) OVER {_mw(n)} = {n}" for c in names.values())
    return f"{cov}, {known} AS known"


_DET = "(saa * (sbb * scc - sbc * sbc) - sab * (sab * scc - sbc * sac) + sac * (sab * sbc - sbb * sac))"
_EXPLAINED = f"""((sva * (sva * (sbb * scc - sbc * sbc) - sab * (svb * scc - sbc * svc) + sac * (svb * sbc - sbb * svc))
  + svb * (saa * (svb * scc - sbc * svc) - sva * (sab * scc - sbc * sac) + sac * (sab * svc - svb * sac))
  + svc * (saa * (sbb * svc - svb * sbc) - sab * (sab * svc - svb * sac) + sva * (sab * sbc - sbb * sac))) / {_DET})"""


def _spread(signal: str, out: str) -> str:
    return f"""{out}_k AS (SELECT *, row_number() OVER (PARTITION BY next_month ORDER BY {signal}, product) AS pos, count(*) OVER (PARTITION BY next_month) AS n
  FROM held WHERE {signal} IS NOT NULL),
{out}_s AS (SELECT k.next_month AS month, CASE WHEN any_value(floor(n * 0.25)) > 0
    AND count(m.R) FILTER (WHERE pos <= floor(n * 0.25)) >= ceil(any_value(floor(n * 0.25)) * 0.8)
    AND count(m.R) FILTER (WHERE pos > n - floor(n * 0.25)) >= ceil(any_value(floor(n * 0.25)) * 0.8)
    THEN avg(m.R) FILTER (WHERE pos > n - floor(n * 0.25)) - avg(m.R) FILTER (WHERE pos <= floor(n * 0.25)) END AS {out}
  FROM {out}_k k LEFT JOIN f m ON m.month = k.next_month AND m.product = k.product GROUP BY 1)"""


MONTHLY = f"""{REGION_DAYS},
cal AS (SELECT trading_day, row_number() OVER (ORDER BY trading_day) AS day_at FROM (SELECT DISTINCT trading_day FROM rd)),
d0 AS (SELECT rd.*, day_at, CASE WHEN day_at - lag(day_at) OVER o = 1 THEN 0 ELSE 1 END AS brk,
    CASE WHEN day_at - lag(day_at) OVER o = 1 AND leg0 = lag(leg0) OVER o THEN 0 ELSE 1 END AS brk0,
    CASE WHEN day_at - lag(day_at) OVER o = 1 AND leg1 = lag(leg1) OVER o THEN 0 ELSE 1 END AS brk1
  FROM rd JOIN cal USING (trading_day) WINDOW o AS (PARTITION BY product ORDER BY trading_day)),
d1 AS (SELECT *, sum(brk) OVER o AS segment, sum(brk0) OVER o AS segment0, sum(brk1) OVER o AS segment1 FROM d0 WINDOW o AS (PARTITION BY product ORDER BY trading_day)),
d2 AS (SELECT *, close / lag(close) OVER (PARTITION BY product, segment ORDER BY trading_day) - 1 AS r,
    close_p0 / lag(close_p0) OVER (PARTITION BY product, segment0 ORDER BY trading_day) - 1 AS r0,
    close_p1 / lag(close_p1) OVER (PARTITION BY product, segment1 ORDER BY trading_day) - 1 AS r1 FROM d1),
d3 AS (SELECT *, CASE WHEN count(r) OVER w = 250 THEN stddev_samp(r) OVER w END AS sd,
    CASE WHEN count(r) OVER w = 250 THEN skewness(r) OVER w * 248 / sqrt(250 * 249) END AS sk,
    CASE WHEN count(r) OVER w = 250 THEN kurtosis_pop(r) OVER w END AS ku,
    CASE WHEN amount > 0 AND abs(r) > 1e-12 THEN amount / abs(r) END AS liq FROM d2 WINDOW w AS {_SEG.format(249)}),
d4 AS (SELECT *, CASE WHEN count(sd) OVER w = 250 THEN stddev_samp(sd) OVER w END AS vv, CAST(date_trunc('month', trading_day) AS DATE) AS month
  FROM d3 WINDOW w AS {_SEG.format(249)}),
g AS (SELECT product, CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM d4 GROUP BY 1),
a AS (SELECT product, month, last(close ORDER BY trading_day) AS P, sum(volume) AS V, last(open_interest ORDER BY trading_day) AS OI,
    CASE WHEN count(r) = count(*) THEN product(1 + r) - 1 END AS R, CASE WHEN count(r) = count(*) THEN max(r) END AS r_max,
    CASE WHEN count(r) = count(*) THEN sum(r) END AS r_sum, CASE WHEN count(r) = count(*) THEN sum(r * r) END AS r_sq,
    CASE WHEN count(r) = count(*) THEN count(r) END AS r_n, CASE WHEN count(liq) >= 2 AND count(liq) >= ceil(count(*) * 0.8) THEN avg(liq) END AS liq,
    last(sd ORDER BY trading_day) AS sd, last(sk ORDER BY trading_day) AS sk, last(ku ORDER BY trading_day) AS ku, last(vv ORDER BY trading_day) AS vv,
    last(close_p0 ORDER BY trading_day) AS F0, last(close_p1 ORDER BY trading_day) AS F1, last(close_p2 ORDER BY trading_day) AS F2,
    CASE WHEN count(r0) >= 2 AND count(r0) >= ceil(count(*) * 0.8) THEN product(1 + r0) - 1 END AS C0,
    CASE WHEN count(r1) >= 2 AND count(r1) >= ceil(count(*) * 0.8) THEN product(1 + r1) - 1 END AS C1 FROM d4 GROUP BY 1, 2),
m AS (SELECT g.product, g.month, a.* EXCLUDE (product, month) FROM g LEFT JOIN a ON a.product = g.product AND a.month = g.month),
f0 AS (SELECT *, R AS mom1, {_mcompound("R", 12)} AS mom12, {_mcompound("R", 36)} AS val36, {_mcompound("R", 60)} AS val60, {_mlag("R", 11)} AS seasonality,
    OI - {_mlag("OI", 1)} AS "dOI", {_mfull("V", 12, f"avg(V) OVER {_mw(12)}")} AS v12, {_mfull("OI", 12, f"avg(OI) OVER {_mw(12)}")} AS oi12,
    {_mfull("P", 13, f"avg(P) OVER {_mw(13)}")} AS p13, {_mfull("r_n", 12, f"sum(r_n) OVER {_mw(12)}")} AS n12,
    {_mfull("r_sum", 12, f"sum(r_sum) OVER {_mw(12)}")} AS s12, {_mfull("r_sq", 12, f"sum(r_sq) OVER {_mw(12)}")} AS q12,
    F0 / F1 AS basis, (F0 / F1) / (F1 / F2) AS rbasis, {_mcompound("C0", 12)} - {_mcompound("C1", 12)} AS bmom FROM m),
f AS (SELECT *, V / {_mlag("v12", 1)} - 1 AS atv, OI / {_mlag("oi12", 1)} - 1 AS "dmaOI", P / {_mlag("p13", 42)} AS val,
    (q12 - s12 * s12 / n12) / (n12 - 1) / (s12 / n12) AS cv, 1 / liq AS iliq,
    {_mfull("basis", 12, f"avg(basis) OVER {_mw(12)}")} AS basis12, {_mfull("rbasis", 12, f"avg(rbasis) OVER {_mw(12)}")} AS rbasis12,
    {_mfull("bmom", 12, f"avg(bmom) OVER {_mw(12)}")} AS bmom12 FROM f0),
tm AS (SELECT month, lead(month) OVER (ORDER BY month) AS next_month FROM (SELECT DISTINCT month FROM f)),
held AS (SELECT tm.next_month, f.product, f.basis, f.mom12 FROM f JOIN tm USING (month) WHERE f.P IS NOT NULL AND f.R IS NOT NULL AND tm.next_month IS NOT NULL),
mk AS (SELECT h.next_month AS month, CASE WHEN count(*) >= 4 AND count(x.R) >= ceil(count(*) * 0.8) THEN avg(x.R) END AS market
  FROM held h LEFT JOIN f x ON x.month = h.next_month AND x.product = h.product GROUP BY 1),
{_spread("basis", "by_basis")}, {_spread("mom12", "by_mom")},
x AS (SELECT f.*, mk.market, by_basis_s.by_basis, by_mom_s.by_mom FROM f LEFT JOIN mk USING (month) LEFT JOIN by_basis_s USING (month) LEFT JOIN by_mom_s USING (month)),
y AS (SELECT *, {_mlag("basis12", 2)} AS l2basis12, {_mlag("bmom12", 2)} AS l2bmom12, {_mlag("rbasis", 2)} AS l2rbasis, {_residual(12)} FROM x)"""
_MONTHLY_SQL = {
    "iliq": "iliq * 1e9",
    "max": "r_max",
    "skew": "sk",
    "kurt": "ku",
    "var": "sd",
    "vov": "vv",
    "ivolaBGR": f"CASE WHEN known AND {_DET} > 1e-20 THEN sqrt(greatest(svv - {_EXPLAINED}, 0) * 12 / 11) END",
}


def _month_sql(name: str) -> str:
    return q6(_MONTHLY_SQL.get(name, f'"{name}"'), f'"{name}"')


@query(
    "monthly_characteristics",
    f"WITH {MONTHLY} SELECT product, month, {', '.join(_month_sql(n) for n in characteristics.NAMES)} FROM y",
)
def monthly_characteristics(spark, sf):
    base, curve = base_and_curve(spark, sf)
    months = characteristics.monthly_characteristics(base, curve, rows_of(spark, sf, "lineitem"))
    scaled = months.withColumn("iliq", F.col("iliq") * 1e9)
    return rounded(scaled, ["product", "month"], list(characteristics.NAMES))


# --- grammar sweep ----------------------------------------------------------------------------------

# All operators, windows and combinations of two fields without equal values, as round-off would
# break ties of averages differently in two engines.  The longest windows exceed every history.
SWEEP = sweep.grammar(("x", "high"), "1d")


def _genome_sql(name: str) -> str:
    """The SQL of one genome, read back from its parts."""
    op, rest = name.split("_", 1)
    fields, n = rest.rsplit("_", 1)[0].split("_"), int(rest.rsplit("_", 1)[1])
    base = fields[0]
    if len(fields) == 3:
        a, b = fields[0], fields[2]
        base = f"({a} {dict(add='+', sub='-', mul='*').get(fields[1])} {b})"
        if fields[1] == "div":
            base = f"(CASE WHEN abs({b}) > 1e-12 THEN {a} / {b} END)"
    order = "PARTITION BY exchange, instrument_id ORDER BY trading_day"
    w = f"({order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    longer = f"({order} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
    if op == "mean":
        return f"CASE WHEN count({base}) OVER {w} = {n} THEN avg({base}) OVER {w} END"
    if op in ("std", "zscore"):
        std = f"stddev_samp({base}) OVER {w}"
        value = std if op == "std" else f"CASE WHEN {std} > 1e-12 THEN ({base} - avg({base}) OVER {w}) / {std} END"
        return f"CASE WHEN count({base}) OVER {w} = {n} THEN {value} END"
    past = f"lag({base}, {n}) OVER ({order})"
    if op == "delta":
        return f"CASE WHEN count({base}) OVER {longer} = {n + 1} THEN {base} - {past} END"
    return f"CASE WHEN count({base}) OVER {longer} = {n + 1} AND abs({past}) > 1e-12 THEN {base} / {past} - 1 END"


def _sweep_sql() -> str:
    genomes = list(SWEEP)
    split = SCORED[SCORED.index("l AS (") : SCORED.index("long AS (")].replace("FROM f WHERE", "FROM sf WHERE")
    columns = ", ".join(f"{_genome_sql(n)} AS {n}" for n in genomes)
    long = " UNION ALL ".join(
        f"SELECT '{n}' AS factor, split, trading_day, product, instrument_id, {n} AS value, target FROM l" for n in genomes
    )
    clip = SCORED[SCORED.index("bounds AS (") :]
    metrics = metric_names(CROSS_SECTIONAL)
    evaluated = _aggregate_sql("trading_day", metrics)
    # Constant genomes have coverage but no metric.
    every = ", ".join(f"('{name}')" for name, _, _ in metrics)
    evaluated = evaluated.replace(
        "FROM wide JOIN dir USING (factor) JOIN cov",
        f"FROM (SELECT factor, m.metric FROM cov, (VALUES {every}) m(metric)) LEFT JOIN wide USING (factor, metric) LEFT JOIN dir USING (factor) "
        "JOIN (SELECT factor, min(value) = max(value) AS flat FROM v GROUP BY 1) USING (factor) JOIN cov",
    ).replace(
        "'success' AS status",
        """CASE WHEN flat THEN 'constant_factor' WHEN direction IS NULL THEN 'undefined_train_metric'
  WHEN primary_val IS NULL THEN 'undefined_val_metric' ELSE 'success' END AS status""",
    )
    return f"""WITH {TARGETS}, sf AS (SELECT *, {columns} FROM tg), {split} long AS ({long}), {clip}, {evaluated}"""


@query("grammar_sweep", f"SELECT factor, metric, train, val, coverage, CAST(direction AS DOUBLE) AS direction, status FROM ({_sweep_sql()})")
def grammar_sweep(spark, sf):
    """Every genome of the grammar, evaluated as columns of one panel."""
    result = sweep.sweep(target_panel(spark, sf), SWEEP, FOLD, CROSS_SECTIONAL)
    return result.select(
        "factor",
        "metric",
        *[r6(c).alias(c) for c in ("train", "val", "coverage")],
        F.col("direction").cast("double").alias("direction"),
        "status",
    )
