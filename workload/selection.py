"""Library construction: similarity, residual information, admission and trial logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factorloom.operators import library, scoring, targets, triallog
from factorloom.operators.blocks import frozen
from factorloom.operators.portfolio import following

from .base import FOLD, q6, query, r6, rows_of, table
from .scores import FACTORS, FUTURES, NAMES, PAIRS, SCORED, STOCKS, WEIGHTS, ranked_sql, scored_panel


def val_rows(spark, sf) -> tuple[DataFrame, int]:
    panel = scored_panel(spark, sf)
    rows = targets.split_rows(panel.df, FOLD.val)
    return rows.withColumn("row_id", F.xxhash64("exchange", "instrument_id", "trading_day")), panel.rows


def _pair_sql(pairs, source: str) -> str:
    union = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {a} AS value, {b} AS target FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in pairs
    )
    return f"""v AS ({union}), {ranked_sql("v", "a, b", "g")}"""


@query(
    "pairwise_spearman",
    f"""WITH {SCORED}, s AS (SELECT * FROM l WHERE split = 'val'), {_pair_sql(PAIRS, "s")}
SELECT a AS "left", b AS "right", n AS overlap, {q6("spearman", "spearman")} FROM g""",
)
def pairwise_spearman(spark, sf):
    rows, bound = val_rows(spark, sf)
    pairs = library.pairwise_spearman(rows, NAMES, rows=bound)
    return pairs.select("left", "right", "overlap", r6("spearman").alias("spearman"))


FULL = ["price", "volume", "high", "low"]
FULL_PAIRS = [(a, b) for i, a in enumerate(FULL) for b in FULL[i + 1 :]]


@query(
    "pairwise_spearman_shared",
    f"""WITH {SCORED}, s AS (SELECT * FROM l WHERE split = 'val'), {_pair_sql(FULL_PAIRS, "s")}
SELECT a AS "left", b AS "right", n AS overlap, {q6("spearman", "spearman")} FROM g""",
)
def pairwise_spearman_shared(spark, sf):
    """Columns without missing rows: every column is ranked once."""
    rows, bound = val_rows(spark, sf)
    pairs = library.pairwise_spearman(rows, FULL, rows=bound)
    return pairs.select("left", "right", "overlap", r6("spearman").alias("spearman"))


@query(
    "similarity_summary",
    f"""WITH {SCORED}, s AS (SELECT * FROM l WHERE split = 'val'), {_pair_sql(PAIRS + FULL_PAIRS, "s")}
SELECT count(*) AS pair_count, count(spearman) AS valid_pairs, {q6("avg(abs(spearman))", "mean_abs")},
  {q6("quantile_cont(abs(spearman), 0.5)", "median_abs")}, {q6("quantile_cont(abs(spearman), 0.9)", "p90_abs")},
  {q6("max(abs(spearman))", "max_abs")}, count(*) FILTER (WHERE abs(spearman) >= 0.7) AS pairs_at_threshold, min(n) AS min_overlap FROM g""",
)
def similarity_summary(spark, sf):
    rows, bound = val_rows(spark, sf)
    pairs = library.pairwise_spearman(rows, NAMES + FULL, pairs=PAIRS + FULL_PAIRS, rows=bound)
    summary = library.similarity_summary(pairs)
    values = ["mean_abs", "median_abs", "p90_abs", "max_abs"]
    counts = ["pair_count", "valid_pairs", "pairs_at_threshold", "min_overlap"]
    return summary.select(*[r6(v).alias(v) for v in values], *counts)


STANDARD = f"""{SCORED}, s AS (SELECT * FROM l WHERE split = 'val'),
z AS (SELECT *, {", ".join(f"coalesce(({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER (), 0) AS z{n[0:3]}" for n in NAMES)} FROM s)"""
_Z = {n: f"z{n[0:3]}" for n in NAMES}


@query(
    "library_correlations",
    f"WITH {STANDARD} "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS "left", '{b}' AS "right", {q6(f"avg({_Z[a]} * {_Z[b]})", "correlation")} FROM z""" for a in NAMES for b in NAMES
    ),
)
def library_correlations(spark, sf):
    rows, _ = val_rows(spark, sf)
    cells = library.library_correlations(rows, NAMES)
    return cells.select("left", "right", r6("correlation").alias("correlation"))


@query(
    "residual_ic",
    f"""WITH {STANDARD}, {WEIGHTS},
g2 AS (SELECT count(*) AS n, sum(zmom * zmom) + 1e-3 * count(*) AS aa, sum(zstr * zstr) + 1e-3 * count(*) AS bb, sum(zmom * zstr) AS ab,
    sum(zmom * zsiz) AS ac, sum(zstr * zsiz) AS bc FROM z),
beta AS (SELECT (ac * bb - bc * ab) / (aa * bb - ab * ab) AS b1, (bc * aa - ac * ab) / (aa * bb - ab * ab) AS b2 FROM g2),
res AS (SELECT product, target, zsiz, -(zsiz - b1 * zmom - b2 * zstr) AS r, size FROM z, beta),
share AS (SELECT greatest(0, 1 - sum(r * r) / sum(zsiz * zsiz)) AS library_r2 FROM res),
v AS (SELECT product, target, CASE WHEN size IS NOT NULL THEN r END AS value FROM res),
{ranked_sql("v", "product", "g")}
SELECT 'size' AS factor, {q6("any_value(library_r2)", "library_r2")},
  {q6("sum(pearson * weight) / sum(weight) * sqrt(1 - any_value(library_r2))", "residual_ic")}
FROM g JOIN pw ON pw.product = g.product AND pw.split = 'val', share""",
)
def residual_ic(spark, sf):
    """One candidate against a two-member library, scored by the weighted product metric."""
    rows, bound = val_rows(spark, sf)
    weights = scoring.product_weights(scored_panel(spark, sf).df, FOLD.val)
    result = library.residual_ic(rows, {"size": -1}, ["momentum", "stretch"], FUTURES, weights, bound)
    return result.select("factor", r6("library_r2").alias("library_r2"), r6("residual_ic").alias("residual_ic"))


@query("admission")
def admission(spark, sf):
    """Greedy library construction over the catalogue order, with residual information."""
    panel = scored_panel(spark, sf)
    twin = panel.df.withColumn("momentum_twin", F.col("momentum") * 2 + 1)
    names = [*NAMES, "momentum_twin"]
    metrics = scoring.evaluate_factors(twin, names, FOLD, STOCKS, rows=panel.rows)
    rows = targets.split_rows(twin, FOLD.val).withColumn(
        "row_id", F.xxhash64("exchange", "instrument_id", "trading_day")
    )
    rows = frozen(rows.select("row_id", "trading_day", "target", *names))
    pairs = library.pairwise_spearman(rows, names, rows=panel.rows)

    study = library.ResidualStudy(rows, names, STOCKS, rows=panel.rows)
    rules = library.AdmissionRules(min_corr_overlap=20, min_abs_val_ic=-1.0, min_residual_ic=0.0)
    return library.admission_frame(metrics, pairs, names, STOCKS, rules, study)


# Candidates in trial order: copies, an opposite, a near copy and a constant beside the known factors.
CANDIDATES = {
    "momentum": "momentum",
    "momentum_twin": "momentum * 2 + 1",
    "flat": "momentum - momentum + 1",
    "size": "size",
    "stretch": "stretch",
    "small": "0 - size",
    "late": "stretch + momentum / 50",
}
GREEDY = library.AdmissionRules(min_corr_overlap=20, min_abs_val_ic=-1.0)


def _candidate_sql() -> str:
    """Metrics and rank correlations of the candidates, then one step per trial."""
    names = list(CANDIDATES)
    split = SCORED[SCORED.index("l AS (") : SCORED.index("long AS (")].replace("FROM f WHERE", "FROM sf WHERE")
    columns = ", ".join(f"{sql} AS {n}" for n, sql in CANDIDATES.items() if n not in NAMES)
    long = " UNION ALL ".join(
        f"SELECT '{n}' AS factor, split, trading_day, product, instrument_id, {n} AS value, target FROM l" for n in names
    )
    first = scoring.metric_names(STOCKS)[0][1]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    steps = [
        f"""{SCORED[: SCORED.index("l AS (")]}sf AS (SELECT *, {columns} FROM f), {split} long AS ({long}), {SCORED[SCORED.index("bounds AS (") :]}""",
        "mv AS (SELECT * FROM clipped WHERE split <> 'test')",
        ranked_sql("mv", "factor, split, trading_day", "mg"),
        f"""me AS (SELECT factor, avg({first}) FILTER (WHERE split = 'train') AS train, avg({first}) FILTER (WHERE split = 'val') AS val_raw FROM mg GROUP BY 1),
co AS (SELECT factor, avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage FROM long WHERE split = 'val' GROUP BY 1),
fl AS (SELECT factor, min(value) = max(value) AS flat FROM mv GROUP BY 1),
ca AS (SELECT place, factor, coverage, train, CASE WHEN train < 0 THEN -val_raw ELSE val_raw END AS val,
    CASE WHEN flat THEN 'constant_factor' WHEN train IS NULL THEN 'undefined_train_metric' WHEN val_raw IS NULL THEN 'undefined_val_metric' ELSE 'success' END AS status
  FROM (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(names, 1))}) t(place, factor) LEFT JOIN me USING (factor) LEFT JOIN co USING (factor) LEFT JOIN fl USING (factor)),
s AS (SELECT * FROM l WHERE split = 'val')""",
        _pair_sql(pairs, "s"),
        """sp AS (SELECT a AS mine, b AS other, n, least(abs(spearman), 1) AS r FROM g UNION ALL SELECT b, a, n, least(abs(spearman), 1) FROM g),
m0 AS (SELECT 0 AS place, '' AS factor WHERE false)""",
    ]
    for k in range(1, len(names) + 1):
        steps.append(
            f"""x{k} AS (SELECT ca.*, count(m.factor) AS library, bool_or(m.factor IS NOT NULL AND coalesce(n, 0) < {GREEDY.min_corr_overlap}) AS few,
    bool_or(n >= {GREEDY.min_corr_overlap} AND r IS NULL) AS unknown, bool_or(n >= {GREEDY.min_corr_overlap} AND r >= {GREEDY.max_abs_corr}) AS alike,
    max(r) FILTER (WHERE n >= {GREEDY.min_corr_overlap}) AS largest, arg_max(m.factor, r) FILTER (WHERE n >= {GREEDY.min_corr_overlap}) AS nearest
  FROM ca LEFT JOIN m{k - 1} m ON true LEFT JOIN sp ON sp.mine = ca.factor AND sp.other = m.factor WHERE ca.place = {k} GROUP BY ALL),
y{k} AS (SELECT *, CASE WHEN status <> 'success' THEN status WHEN coverage < {GREEDY.min_coverage} THEN 'low_coverage'
    WHEN val IS NULL OR val < {GREEDY.min_abs_val_ic} THEN 'quality_threshold' END AS own FROM x{k}),
z{k} AS MATERIALIZED (SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN few THEN 'insufficient_corr_overlap' WHEN unknown THEN 'undefined_correlation'
    WHEN alike THEN 'behavior_duplicate' ELSE 'accepted' END AS reason FROM y{k}),
m{k} AS MATERIALIZED (SELECT * FROM m{k - 1} UNION ALL SELECT place, factor FROM z{k} WHERE reason = 'accepted')"""
        )
    every = " UNION ALL ".join(f"SELECT z.*, (SELECT count(*) FROM m{k}) AS size FROM z{k} z" for k in range(1, len(names) + 1))
    return f"""WITH {", ".join(steps)}
SELECT CAST(place AS INTEGER) AS trial, factor, reason = 'accepted' AS accepted, reason, {q6("CASE WHEN own IS NULL THEN largest END", "max_abs_corr")},
  CASE WHEN own IS NULL THEN nearest END AS nearest, own IS NOT NULL OR NOT (few OR coalesce(unknown, false)) AS complete, CAST(size AS INTEGER) AS library_size FROM ({every})"""


@query("admission_greedy", _candidate_sql())
def admission_greedy(spark, sf):
    """Greedy library construction by metrics and rank correlations, without residuals."""
    panel = scored_panel(spark, sf)
    extra = {n: F.expr(sql) for n, sql in CANDIDATES.items() if n not in NAMES}
    wide, names = panel.df.withColumns(extra), list(CANDIDATES)
    metrics = scoring.evaluate_factors(wide, names, FOLD, STOCKS, rows=panel.rows)
    rows = targets.split_rows(wide, FOLD.val).withColumn("row_id", F.xxhash64("exchange", "instrument_id", "trading_day"))
    pairs = library.pairwise_spearman(frozen(rows.select("row_id", *names)), names, rows=panel.rows)
    log = library.admission_frame(metrics, pairs, names, STOCKS, GREEDY)
    return log.select("trial", "factor", "accepted", "reason", r6("max_abs_corr").alias("max_abs_corr"), "nearest", "complete", "library_size")


# Factors without exact linear relations among each other.
DIMENSIONS = ["momentum", "stretch", "size", "price", "volume", "high"]


def _dimensions_sql(share: float = 0.9) -> str:
    """Subsets of two and three factors, whose correlation matrices have eigenvalues in closed form."""
    known = " AND ".join(f"{n} IS NOT NULL" for n in DIMENSIONS)
    ends = ", ".join(f"quantile_cont({n}, 0.01) AS lo_{n}, quantile_cont({n}, 0.99) AS hi_{n}" for n in DIMENSIONS)
    clip = ", ".join(f"least(greatest({n}, lo_{n}), hi_{n}) AS {n}" for n in DIMENSIONS)
    pair_rows = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, corr({a}, {b}) AS r FROM cl" for i, a in enumerate(DIMENSIONS) for j, b in enumerate(DIMENSIONS) if i < j
    )
    report = lambda size, source: (
        f"""SELECT {size} AS subset_size, count(*) AS subsets, {q6("avg(needed)", "effective_dimensions")}, {q6(f"avg(needed) / {size}", "effective_rate")}, false AS drawn FROM {source}"""
    )
    return f"""WITH {SCORED}, c AS (SELECT * FROM l WHERE split = 'val' AND {known}), e AS (SELECT {ends} FROM c),
cl AS (SELECT {clip} FROM c, e), r AS MATERIALIZED ({pair_rows}),
two AS (SELECT CASE WHEN (1 + abs(r)) / 2 >= {share} THEN 1 ELSE 2 END AS needed FROM r),
tr AS (SELECT x.r AS a, y.r AS b, z.r AS c FROM r x JOIN r y ON x.i = y.i AND x.j < y.j JOIN r z ON z.i = x.j AND z.j = y.j),
ph AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM tr),
ei AS (SELECT 1 + 2 * p * cos(acos(greatest(-1, least(1, a * b * c / (p * p * p)))) / 3) AS top,
    1 + 2 * p * cos(acos(greatest(-1, least(1, a * b * c / (p * p * p)))) / 3 + 2 * pi() / 3) AS low FROM ph),
three AS (SELECT CASE WHEN top / 3 >= {share} THEN 1 WHEN (3 - low) / 3 >= {share} THEN 2 ELSE 3 END AS needed FROM ei)
{report(2, "two")} UNION ALL {report(3, "three")}"""


@query("effective_dimensions_small", _dimensions_sql())
def effective_dimensions_small(spark, sf):
    """Components that subsets of two and of three factors need."""
    rows, bound = val_rows(spark, sf)
    reports = [library.effective_dimensions(rows, DIMENSIONS, size=k, rows=bound) for k in (2, 3)]
    both = reports[0].unionByName(reports[1])
    return both.select("subset_size", "subsets", *[r6(c).alias(c) for c in ("effective_dimensions", "effective_rate")], "drawn")


@query("effective_dimensions")
def effective_dimensions(spark, sf):
    rows, bound = val_rows(spark, sf)
    wide = rows.withColumns({"drift": F.col("momentum") - F.col("stretch") / 5, "range": F.col("high") - F.col("low")})
    factors = [*NAMES, "price", "volume", "drift", "range", "high", "low"]
    return library.effective_dimensions(wide, factors, size=7, rows=bound)


# --- trial logs -----------------------------------------------------------------------------------


def trials(spark, sf) -> DataFrame:
    """A trial log read off the orders: one run per priority, trials in order-key order."""
    amount = F.round(F.col("o_totalprice") * 100).cast("long")
    ok = F.col("o_orderkey") % 11 != 0
    val = ((F.floor(amount / 7) % 2001) - 1000) / 10000
    accepted = ok & (val > 0.08)
    reason = (
        F.when(accepted, "accepted")
        .when(~ok, F.when(F.col("o_orderkey") % 22 == 0, "budget_rejected").otherwise("compute_error"))
        .when(val > 0.05, "behavior_duplicate")
        .otherwise("quality_threshold")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run_id"),
        F.col("o_orderkey").alias("trial"),
        F.concat(F.lit("r"), (F.col("o_custkey") % 40).cast("string")).alias("region"),
        F.when(F.col("o_custkey") % 3 == 0, "intraday")
        .when(F.col("o_custkey") % 3 == 1, "1d_to_20d")
        .otherwise("over_20d")
        .alias("band"),
        F.when(ok, "success").otherwise("compute_error").alias("status"),
        (((amount % 2001) - 1000) / 10000).alias("train"),
        F.when(F.col("o_orderkey") % 17 != 0, val).alias("val"),
        ((F.col("o_custkey") % 100) / 100).alias("coverage"),
        accepted.alias("accepted"),
        reason.alias("reason"),
        F.when(ok, ((amount % 1000) - 700) / 10000).alias("residual_ic"),
    )


TRIALS = """t0 AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderkey % 11 <> 0 AS ok FROM orders),
t1 AS (SELECT *, CAST((c // 7) % 2001 - 1000 AS DOUBLE) / 10000 AS v FROM t0),
t AS (SELECT o_orderpriority AS run_id, o_orderkey AS trial, 'r' || CAST(o_custkey % 40 AS VARCHAR) AS region,
    CASE o_custkey % 3 WHEN 0 THEN 'intraday' WHEN 1 THEN '1d_to_20d' ELSE 'over_20d' END AS band,
    CASE WHEN ok THEN 'success' ELSE 'compute_error' END AS status, CAST(c % 2001 - 1000 AS DOUBLE) / 10000 AS train,
    CASE WHEN o_orderkey % 17 <> 0 THEN v END AS val, CAST(o_custkey % 100 AS DOUBLE) / 100 AS coverage, ok AND v > 0.08 AS accepted,
    CASE WHEN ok AND v > 0.08 THEN 'accepted' WHEN NOT ok THEN CASE WHEN o_orderkey % 22 = 0 THEN 'budget_rejected' ELSE 'compute_error' END
      WHEN v > 0.05 THEN 'behavior_duplicate' ELSE 'quality_threshold' END AS reason,
    CASE WHEN ok THEN CAST(c % 1000 - 700 AS DOUBLE) / 10000 END AS residual_ic FROM t1)"""


@query("trial_reasons", f"WITH {TRIALS} SELECT region, reason, count(*) AS trials FROM t GROUP BY 1, 2")
def trial_reasons(spark, sf):
    return triallog.reason_counts(trials(spark, sf), ["region"])


_Q = "status = 'success' AND val IS NOT NULL AND coverage >= 0.3"


@query(
    "region_evidence",
    f"""WITH {TRIALS} SELECT region, count(*) AS attempts, count(*) FILTER (WHERE status = 'success') AS successful, count(*) FILTER (WHERE {_Q}) AS qualified,
  count(*) FILTER (WHERE accepted) AS admitted,
  {", ".join(q6(f"quantile_cont({e}, {p}) FILTER (WHERE {_Q})", f"{n}_{q}", 8) for n, e in {"train": "abs(train)", "val": "val", "gap": "abs(train) - val"}.items() for q, p in {"q1": 0.25, "median": 0.5, "q3": 0.75}.items())},
  {q6(f"count(*) FILTER (WHERE {_Q} AND val > 0) / count(*) FILTER (WHERE {_Q})", "positive_ratio")},
  CASE WHEN count(*) FILTER (WHERE {_Q}) = 0 THEN 'insufficient samples'
    WHEN (bool_or({_Q} AND val > 0) AND bool_or({_Q} AND val < 0)) OR bool_or({_Q} AND val = 0) THEN 'mixed evidence'
    WHEN bool_or({_Q} AND val > 0) THEN 'preliminary support' ELSE 'weak validation this round' END AS evidence
FROM t GROUP BY 1""",
)
def region_evidence(spark, sf):
    evidence = triallog.region_evidence(trials(spark, sf), 0.3, rows_of(spark, sf, "orders"))
    values = [f"{n}_{q}" for n in ("train", "val", "gap") for q in ("q1", "median", "q3")]
    counts = ["attempts", "successful", "qualified", "admitted"]
    return evidence.select(
        "region", *counts, *[r6(v, 8).alias(v) for v in values], r6("positive_ratio").alias("positive_ratio"), "evidence"
    )


@query(
    "supporting_trials",
    f"""WITH {TRIALS} SELECT region, CAST(first(trial ORDER BY val DESC, trial) FILTER (WHERE val > 0) AS DOUBLE) AS supporting_trial,
  CAST(first(trial ORDER BY val, trial) FILTER (WHERE val < 0) AS DOUBLE) AS opposing_trial FROM t WHERE {_Q} GROUP BY 1""",
)
def supporting_trials(spark, sf):
    best = triallog.supporting_trials(trials(spark, sf), 0.3)
    return best.select(
        "region", *[F.col(c).cast("double").alias(c) for c in ("supporting_trial", "opposing_trial")]
    )


_CURVE = """c AS (SELECT run_id, trial, CAST(sum(CASE WHEN reason <> 'budget_rejected' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS attempt,
    CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER w AS BIGINT) AS members,
    sum(CASE WHEN accepted THEN coalesce(residual_ic, 0) ELSE 0 END) OVER w AS residual_sum
  FROM t WINDOW w AS (PARTITION BY run_id ORDER BY trial))"""


@query("discovery_curve", f"WITH {TRIALS}, {_CURVE} SELECT run_id, trial, attempt, members, {q6('residual_sum', 'residual_sum', 5)} FROM c")
def discovery_curve(spark, sf):
    curve = triallog.discovery_curve(trials(spark, sf), rows_of(spark, sf, "orders"))
    return curve.select("run_id", "trial", "attempt", "members", r6("residual_sum", 5).alias("residual_sum"))


@query(
    "curve_nodes",
    f"""WITH {TRIALS}, {_CURVE} SELECT run_id, attempt AS node, first(members ORDER BY trial) AS members,
  {q6("first(residual_sum ORDER BY trial)", "residual_sum", 5)} FROM c WHERE attempt > 0 AND attempt % 100 = 0 GROUP BY 1, 2""",
)
def curve_nodes(spark, sf):
    nodes = triallog.curve_nodes(trials(spark, sf), 100, rows_of(spark, sf, "orders"))
    return nodes.select("run_id", "node", "members", r6("residual_sum", 5).alias("residual_sum"))


@query(
    "compare_runs",
    f"""WITH {TRIALS} SELECT run_id, count(*) AS trial_records, count(*) FILTER (WHERE reason <> 'budget_rejected') AS attempts,
  count(*) FILTER (WHERE accepted) AS accepted, {q6("sum(residual_ic) FILTER (WHERE accepted)", "admitted_residual", 5)} FROM t GROUP BY 1""",
)
def compare_runs(spark, sf):
    runs = triallog.compare_runs(trials(spark, sf))
    return runs.withColumn("admitted_residual", r6("admitted_residual", 5))


def _band_sql(keys: str, name: str) -> str:
    return f"""{name} AS (SELECT {keys}, count(*) AS attempts, count(*) FILTER (WHERE accepted) AS admitted,
    sum(CASE WHEN accepted THEN coalesce(residual_ic, 0) ELSE 0 END) AS admitted_residual,
    CASE WHEN count(*) < 10 THEN 'probing' WHEN NOT bool_or(adds) THEN 'seabed'
      WHEN count(*) >= 20 AND NOT coalesce(bool_or(adds) FILTER (WHERE back <= 10), false) THEN 'saturated' ELSE 'land' END AS status
  FROM (SELECT *, accepted AND coalesce(residual_ic, 0) > 0 AS adds,
      row_number() OVER (PARTITION BY {keys} ORDER BY run_id DESC, trial DESC) AS back FROM t) GROUP BY {keys})"""


@query(
    "band_status",
    f"""WITH {TRIALS}, {_band_sql("region, band", "b")}
SELECT region, band, attempts, admitted, {q6("admitted_residual", "admitted_residual", 5)}, status FROM b""",
)
def band_status(spark, sf):
    bands = triallog.band_status(trials(spark, sf), ["region", "band"], 10, rows_of(spark, sf, "orders"))
    return bands.select(
        "region", "band", "attempts", "admitted", r6("admitted_residual", 5).alias("admitted_residual"), "status"
    )


@query(
    "region_status",
    f"""WITH {TRIALS}, {_band_sql("region, band", "b")}, {_band_sql("region", "r")},
s AS (SELECT region, CASE WHEN bool_or(status = 'land') THEN 'land' WHEN bool_and(status IN ('seabed', 'saturated')) THEN
    CASE WHEN bool_or(status = 'saturated') THEN 'saturated' ELSE 'seabed' END ELSE 'probing' END AS status FROM b GROUP BY 1)
SELECT region, attempts, admitted, {q6("admitted_residual", "admitted_residual", 5)}, {q6("admitted_residual / attempts", "residual_per_attempt")}, s.status
FROM r JOIN s USING (region)""",
)
def region_status(spark, sf):
    regions = triallog.region_status(trials(spark, sf), 10, rows_of(spark, sf, "orders"))
    return regions.select(
        "region",
        "attempts",
        "admitted",
        r6("admitted_residual", 5).alias("admitted_residual"),
        r6("residual_per_attempt").alias("residual_per_attempt"),
        "status",
    )


@query(
    "next_observed_day",
    """SELECT d AS o_day, lead(d) OVER (ORDER BY d) AS next_day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
QUALIFY lead(d) OVER (ORDER BY d) IS NOT NULL""",
)
def next_observed_day(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("o_day"))
    return following(days, "o_day", "next_day", rows_of(spark, sf, "orders"))
