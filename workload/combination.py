"""Preprocessing, linear and tree models, arms, paired metrics and the block bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factorloom.operators import bootstrap, combine, scoring, targets

from .base import FOLD, KEY, q6, query, r6, rounded
from .scores import FROZEN, FUTURES, NAMES, SCORED, WEIGHTS, frozen_members, ranked_sql, scored_panel

TWO = ["momentum", "stretch"]


def _train(spark, sf):
    panel = scored_panel(spark, sf)
    return targets.split_rows(panel.df, FOLD.train), panel


def _prep_sql(names, source: str = "l") -> str:
    """Bounds, moments and standardised values (z_*) of the training rows."""
    ends = ", ".join(f"quantile_cont({n}, 0.01) AS lo_{n}, quantile_cont({n}, 0.99) AS hi_{n}" for n in names)
    clip = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN least(greatest({n}, lo_{n}), hi_{n}) END AS c_{n}" for n in names)
    moments = ", ".join(f"avg(c_{n}) AS m_{n}, stddev_pop(c_{n}) AS s_{n}" for n in names)
    return f"""tr AS (SELECT * FROM {source} WHERE split = 'train'),
ends AS (SELECT {ends}, quantile_cont(target, 0.01) AS lo_t, quantile_cont(target, 0.99) AS hi_t FROM tr),
cl AS (SELECT tr.*, {clip}, least(greatest(target, lo_t), hi_t) AS yc FROM tr, ends),
mo AS (SELECT {moments} FROM cl),
zz AS (SELECT cl.*, {", ".join(f"coalesce((c_{n} - m_{n}) / s_{n}, 0) AS z_{n}" for n in names)} FROM cl, mo),
us AS (SELECT * FROM zz WHERE {" OR ".join(f"{n} IS NOT NULL" for n in names)})"""


@query(
    "preprocessing",
    f"""WITH {SCORED}, {_prep_sql(NAMES)} """
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", {q6(f"m_{n}", "mean")}, {q6(f"s_{n}", "scale")}, {q6(f"lo_{n}", "lower")}, {q6(f"hi_{n}", "upper")} FROM mo, ends"""
        for n in NAMES
    ),
)
def preprocessing(spark, sf):
    train, panel = _train(spark, sf)
    prep = combine.fit_preprocessing(train, NAMES, rows=panel.rows)
    rows = list(zip(prep.columns, prep.mean, prep.scale, prep.lower, prep.upper))
    fitted = spark.createDataFrame(rows, "column string, mean double, scale double, lower double, upper double")
    return rounded(fitted, ["column"], ["mean", "scale", "lower", "upper"])


@query(
    "standardised_rows",
    f"""WITH {SCORED}, {_prep_sql(TWO)} SELECT instrument_id, trading_day, {q6("z_momentum", "z_momentum")}, {q6("z_stretch", "z_stretch")},
  momentum IS NOT NULL OR stretch IS NOT NULL AS usable FROM zz""",
)
def standardised_rows(spark, sf):
    train, panel = _train(spark, sf)
    prep = combine.fit_preprocessing(train, TWO, rows=panel.rows)
    return rounded(combine.transform(train, prep), [*KEY, "usable"], prep.inputs)


@query(
    "product_demeaned",
    f"""WITH {SCORED}, {_prep_sql(TWO)} SELECT instrument_id, trading_day, {q6("z_momentum - avg(z_momentum) OVER (PARTITION BY product)", "z_momentum")},
  {q6("yc - avg(yc) OVER (PARTITION BY product)", "label")} FROM us""",
)
def product_demeaned(spark, sf):
    train, panel = _train(spark, sf)
    prep = combine.fit_preprocessing(train, TWO, rows=panel.rows)
    ends = combine.label_bounds(train, "target", (0.01, 0.99), panel.rows)
    rows = combine.training_rows(train, prep, "target", ends)
    centred, _ = combine.demeaned(rows, ["z_momentum", "__y"], "product")
    return rounded(centred.withColumnRenamed("__y", "label"), KEY, ["z_momentum", "label"])


def _normal_equations(by_product: bool) -> str:
    over = "OVER (PARTITION BY product)" if by_product else "OVER ()"
    return f"""ce AS (SELECT *, z_momentum - avg(z_momentum) {over} AS a, z_stretch - avg(z_stretch) {over} AS b, yc - avg(yc) {over} AS t FROM us),
ne AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * t) AS ay, sum(b * t) AS bt FROM ce),
co AS (SELECT (ay * bb - bt * ab) / (aa * bb - ab * ab) AS b1, (bt * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM ne)"""


SIGNED = ", ".join(f"{direction} * {name} AS {name}" for name, direction, _, _ in FROZEN if name in TWO)


@query(
    "linear_fit",
    f"""WITH {SCORED}, lx AS (SELECT * REPLACE ({SIGNED}) FROM l), {_prep_sql(TWO, "lx")}, {_normal_equations(False)}
SELECT {q6("b1", "momentum", 7)}, {q6("b2", "stretch", 7)}, {q6("(SELECT avg(yc) - b1 * avg(z_momentum) - b2 * avg(z_stretch) FROM us)", "intercept", 7)},
  CAST(2 AS BIGINT) AS rank, (SELECT count(*) FROM us) AS training_rows FROM co""",
)
def linear_fit(spark, sf):
    """Fit on the factors in the direction of the frozen library."""
    train, panel = _train(spark, sf)
    members = frozen_members(spark).where(F.col("factor").isin(TWO))
    train = combine.signed_panel(train, members)
    model = combine.fit_linear(train, TWO, rows=panel.rows)
    row = [(*model.coefficients, model.intercept, model.rank, model.training_rows)]
    fitted = spark.createDataFrame(row, "momentum double, stretch double, intercept double, rank long, training_rows long")
    return rounded(fitted, ["rank", "training_rows"], ["momentum", "stretch", "intercept"], 7)


@query(
    "linear_predictions",
    f"""WITH {SCORED}, {_prep_sql(TWO)}, {_normal_equations(True)},
off AS (SELECT product, avg(z_momentum) * b1 + avg(z_stretch) * b2 AS o FROM us, co GROUP BY product, b1, b2),
te AS (SELECT l.*, {", ".join(f"coalesce((CASE WHEN l.{n} IS NOT NULL THEN least(greatest(l.{n}, lo_{n}), hi_{n}) END - m_{n}) / s_{n}, 0) AS t_{n}" for n in TWO)}
  FROM l, ends, mo WHERE split = 'val')
SELECT instrument_id, trading_day, {q6("CASE WHEN momentum IS NOT NULL OR stretch IS NOT NULL THEN t_momentum * b1 + t_stretch * b2 - coalesce(o, 0) END", "prediction", 7)}
FROM te LEFT JOIN off USING (product), co""",
)
def linear_predictions(spark, sf):
    """Fit per-product centred on train, predict the validation rows."""
    train, panel = _train(spark, sf)
    model = combine.fit_linear(train, TWO, product="product", rows=panel.rows)
    val = targets.split_rows(panel.df, FOLD.val)
    return rounded(model.predict(val), KEY, ["prediction"], 7)


@query("tree_predictions")
def tree_predictions(spark, sf):
    train, panel = _train(spark, sf)
    settings = combine.TreeSettings(min_rows=50)
    model = combine.fit_trees(train, TWO, product="product", settings=settings, rows=panel.rows)
    val = targets.split_rows(panel.df, FOLD.val)
    return rounded(model.predict(val), KEY, ["prediction"])


# A few small trees, so that SQL can grow them step by step.
SMALL = combine.TreeSettings(rounds=3, learning_rate=0.3, leaves=4, min_rows=8, l2=1.0, bins=12)


def _boosted_sql() -> str:
    """Every split as one step: sums per leaf, column and bin, the best cut of all, new leaf numbers."""
    points = ", ".join(f"({i}::DOUBLE / {SMALL.bins})" for i in range(1, SMALL.bins))
    steps = [
        f"""te AS (SELECT l.*, {", ".join(f"coalesce((CASE WHEN l.{n} IS NOT NULL THEN least(greatest(l.{n}, lo_{n}), hi_{n}) END - m_{n}) / s_{n}, 0) AS z_{n}" for n in TWO)}
  FROM l, ends, mo WHERE split = 'val' AND ({" OR ".join(f"{n} IS NOT NULL" for n in TWO)})),
la AS (SELECT *, yc - avg(yc) OVER (PARTITION BY product) AS label FROM us),
st AS (SELECT (SELECT avg(label) FROM la) AS score, * FROM (
  SELECT true AS fitted, instrument_id, trading_day, {", ".join(f"z_{n} AS x{j}" for j, n in enumerate(TWO))}, label FROM la
  UNION ALL SELECT false, instrument_id, trading_day, {", ".join(f"z_{n}" for n in TWO)}, NULL FROM te))"""
    ]
    for j in range(len(TWO)):
        steps.append(f"c{j} AS (SELECT DISTINCT unnest(quantile_cont(x{j}, [{points}])) AS cut FROM st WHERE fitted)")
    source = "st"
    for r in range(SMALL.rounds):
        bins = ", ".join(f"(SELECT count(*) FROM c{j} WHERE cut < x{j}) AS b{j}" for j in range(len(TWO))) if r == 0 else ", ".join(f"b{j}" for j in range(len(TWO)))
        steps.append(f"t{r}_0 AS MATERIALIZED (SELECT fitted, instrument_id, trading_day, label, x0, x1, {bins}, score, 0 AS leaf FROM {source})")
        for k in range(1, SMALL.leaves):
            rows = f"t{r}_{k - 1}"
            long = " UNION ALL ".join(
                f"SELECT leaf, {j} AS col, b{j} AS bin, sum(score - label) AS g, count(*) AS n FROM {rows} WHERE fitted GROUP BY leaf, b{j}" for j in range(len(TWO))
            )
            last = " WHEN ".join(f"col = {j} THEN (SELECT count(*) FROM c{j})" for j in range(len(TWO)))
            steps.append(
                f"""h{r}_{k} AS (SELECT *, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY leaf, col) AS ga, sum(n) OVER (PARTITION BY leaf, col) AS na
  FROM ({long}) WINDOW w AS (PARTITION BY leaf, col ORDER BY bin)),
s{r}_{k} AS (SELECT leaf, col, bin, gl * gl / (nl + {SMALL.l2}) + (ga - gl) * (ga - gl) / (na - nl + {SMALL.l2}) - ga * ga / (na + {SMALL.l2}) AS gain FROM h{r}_{k}
  WHERE nl >= {SMALL.min_rows} AND na - nl >= {SMALL.min_rows} AND bin < CASE WHEN {last} END),
p{r}_{k} AS MATERIALIZED (SELECT * FROM s{r}_{k} WHERE gain > 0 ORDER BY gain DESC, leaf, col, bin LIMIT 1),
t{r}_{k} AS MATERIALIZED (SELECT t.* REPLACE (CASE WHEN t.leaf = p.leaf AND CASE p.col WHEN 0 THEN b0 ELSE b1 END > p.bin THEN {k} ELSE t.leaf END AS leaf)
  FROM {rows} t LEFT JOIN p{r}_{k} p ON true)"""
            )
        done = f"t{r}_{SMALL.leaves - 1}"
        steps.append(f"v{r} AS MATERIALIZED (SELECT leaf, -{SMALL.learning_rate} * sum(score - label) / (count(*) + {SMALL.l2}) AS v FROM {done} WHERE fitted GROUP BY leaf)")
        steps.append(f"e{r} AS MATERIALIZED (SELECT d.* REPLACE (d.score + v.v AS score) FROM {done} d JOIN v{r} v ON d.leaf = v.leaf)")
        source = f"e{r}"
    return f"""WITH {SCORED}, {_prep_sql(TWO)}, {", ".join(steps)}
SELECT instrument_id, trading_day, {q6("score", "prediction", 7)} FROM {source} WHERE NOT fitted"""


@query("boosted_rounds", _boosted_sql())
def boosted_rounds(spark, sf):
    """Validation predictions of a few small trees; rows without any factor have none."""
    train, panel = _train(spark, sf)
    model = combine.fit_trees(train, TWO, product="product", settings=SMALL, rows=panel.rows)
    val = model.predict(targets.split_rows(panel.df, FOLD.val)).where("prediction IS NOT NULL")
    return rounded(val, KEY, ["prediction"], 7)


@query(
    "evaluate_predictions",
    f"""WITH {SCORED}, {WEIGHTS}, v AS (SELECT product, target, momentum / 10 + coalesce(stretch, 0) / 100 AS value FROM l WHERE split = 'val'),
{ranked_sql("v", "product", "g")}, j AS (SELECT g.*, weight FROM g LEFT JOIN pw ON pw.product = g.product AND pw.split = 'val'),
c AS (SELECT count(*) AS eligible_rows, count(value) AS predicted_rows FROM v)
"""
    + " UNION ALL ".join(
        f"""SELECT 'blend' AS model, '{name}' AS metric, {q6(f"sum({kind} * weight) / sum(weight)" if weighted else f"avg({kind})", "value")},
  CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_groups, any_value(eligible_rows) AS eligible_rows, any_value(predicted_rows) AS predicted_rows,
  {q6("any_value(predicted_rows) / any_value(eligible_rows)", "coverage")} FROM j, c"""
        for name, kind, weighted in scoring.metric_names(FUTURES)
    ),
)
def evaluate_predictions(spark, sf):
    panel = scored_panel(spark, sf)
    val = targets.split_rows(panel.df, FOLD.val)
    blend = F.col("momentum") / 10 + F.coalesce("stretch", F.lit(0.0)) / 100
    weights = scoring.product_weights(panel.df, FOLD.val)
    report = combine.evaluate_predictions(val.withColumn("blend", blend), ["blend"], FUTURES, weights, panel.rows)
    return report.withColumns({"value": r6("value"), "coverage": r6("coverage")})


def paired_rows(spark, sf) -> tuple[DataFrame, DataFrame, int]:
    """Common rows with two competing predictions of the target on the test period."""
    panel = scored_panel(spark, sf)
    rows = targets.split_rows(panel.df, FOLD.test).where("momentum IS NOT NULL AND stretch IS NOT NULL")
    rows = rows.select(
        *KEY, "product", "target", (F.col("momentum") / 10).alias("baseline"), (F.col("stretch") / -50).alias("prediction")
    )
    return rows, scoring.product_weights(panel.df, FOLD.test), panel.rows


PAIRED = f"""{SCORED}, {WEIGHTS}, w AS (SELECT product, weight FROM pw WHERE split = 'test'),
pr AS (SELECT instrument_id, trading_day, year(trading_day) AS year, product, target, momentum / 10 AS baseline, stretch / -50 AS prediction
  FROM l WHERE split = 'test' AND momentum IS NOT NULL AND stretch IS NOT NULL)"""


def _paired_sql(by: str, source: str = "pr") -> str:
    def rank(c):
        return f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2"

    return f"""rk AS (SELECT *, {rank("target")} AS rt, {rank("baseline")} AS rb, {rank("prediction")} AS rp FROM {source}),
pp0 AS (SELECT {by}, count(*) AS n, avg((target - baseline) ** 2) AS baseline_mse, avg((target - prediction) ** 2) AS mse,
    corr(baseline, target) AS bp, corr(prediction, target) AS ppe, corr(rb, rt) AS bs, corr(rp, rt) AS ps,
    count(*) >= 5 AND min(target) < max(target) AND min(baseline) < max(baseline) AND min(prediction) < max(prediction) AS common
  FROM rk GROUP BY {by}),
pp AS (SELECT pp0.* REPLACE ({", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in ("bp", "ppe", "bs", "ps"))}), weight
  FROM pp0 JOIN w USING (product))"""


@query(
    "paired_products",
    f"""WITH {PAIRED}, {_paired_sql("product")} SELECT product, n, {q6("baseline_mse", "baseline_mse")}, {q6("mse", "mse")}, {q6("bp", "baseline_pearson")},
  {q6("ppe", "prediction_pearson")}, {q6("bs", "baseline_spearman")}, {q6("ps", "prediction_spearman")}, common FROM pp""",
)
def paired_products(spark, sf):
    rows, weights, bound = paired_rows(spark, sf)
    products = combine.paired_products(rows, weights, rows=bound)
    kinds = [f"{m}_{k}" for m in ("baseline", "prediction") for k in ("pearson", "spearman")]
    return rounded(products, ["product", "n", "common"], ["baseline_mse", "mse", *kinds])


def _summary_sql(by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    columns = [
        "CAST(sum(n) AS BIGINT) AS weighted_rows",
        "count(*) AS products",
        "CAST(sum(n) FILTER (WHERE common) AS BIGINT) AS ic_rows",
        "count(*) FILTER (WHERE common) AS ic_products",
        q6("sum(weight * baseline_mse) / sum(weight)", "baseline_mse"),
        q6("sum(weight * mse) / sum(weight)", "mse"),
        q6("1 - sum(weight * mse) / sum(weight * baseline_mse)", "relative_mse_reduction", 5),
    ]
    for kind, b, p in (("pearson", "bp", "ppe"), ("spearman", "bs", "ps")):
        for how in ("weighted", "equal"):
            value = {
                c: f"sum({c} * weight) FILTER (WHERE common) / sum(weight) FILTER (WHERE common)"
                if how == "weighted"
                else f"avg({c}) FILTER (WHERE common)"
                for c in (b, p)
            }
            columns += [
                q6(value[b], f"{how}_{kind}_baseline"),
                q6(value[p], f"{how}_{kind}_augmented"),
                q6(f"{value[p]} - {value[b]}", f"{how}_{kind}_delta"),
            ]
    return f"SELECT {by + ', ' if by else ''}{', '.join(columns)} FROM pp {group}"


def _rounded_summary(summary: DataFrame, keys: list[str]) -> DataFrame:
    counts = ["weighted_rows", "products", "ic_rows", "ic_products"]
    digits = {"relative_mse_reduction": 5}
    values = [c for c in summary.columns if c not in {*counts, *keys}]
    return summary.select(*keys, *counts, *[r6(v, digits.get(v, 6)).alias(v) for v in values])


@query("paired_summary", f"WITH {PAIRED}, {_paired_sql('product')} {_summary_sql()}")
def paired_summary(spark, sf):
    rows, weights, bound = paired_rows(spark, sf)
    return _rounded_summary(combine.paired_summary(combine.paired_products(rows, weights, rows=bound)), [])


@query("paired_summary_by_year", f"WITH {PAIRED}, {_paired_sql('year, product')} {_summary_sql('year')}")
def paired_summary_by_year(spark, sf):
    rows, weights, bound = paired_rows(spark, sf)
    rows = rows.withColumn("year", F.year("trading_day").cast("long"))
    products = combine.paired_products(rows, weights, ["year"], bound)
    return _rounded_summary(combine.paired_summary(products, ["year"]), ["year"])


@query(
    "common_products",
    f"""WITH {PAIRED}, {_paired_sql("year, product")}
SELECT product FROM pp WHERE common GROUP BY product HAVING count(*) = (SELECT count(DISTINCT year) FROM pp)""",
)
def common_products(spark, sf):
    rows, weights, bound = paired_rows(spark, sf)
    rows = rows.withColumn("year", F.year("trading_day"))
    return combine.common_products(combine.paired_products(rows, weights, ["year"], bound), "year")


@query(
    "transformed_target",
    f"""WITH {PAIRED}, e AS (SELECT quantile_cont(target, 0.01) AS lo, quantile_cont(target, 0.99) AS hi FROM l WHERE split = 'train'),
m AS (SELECT product, avg(least(greatest(target, lo), hi)) AS mean FROM l, e WHERE split = 'train' GROUP BY 1)
SELECT instrument_id, trading_day, {q6("least(greatest(target, lo), hi) - coalesce(mean, 0)", "target")} FROM pr LEFT JOIN m USING (product), e""",
)
def transformed_target(spark, sf):
    train, panel = _train(spark, sf)
    rows, _, bound = paired_rows(spark, sf)
    ends = combine.label_bounds(train, "target", (0.01, 0.99), bound)
    return rounded(combine.transformed_target(rows, train, ends), KEY, ["target"])


_ARM = f"""sc AS (WITH {_prep_sql(TWO)}, {_normal_equations(False)},
  off AS (SELECT avg(yc) - b1 * avg(z_momentum) - b2 * avg(z_stretch) AS c FROM us, co GROUP BY b1, b2)
  SELECT l.instrument_id, l.trading_day, c + b1 * (least(greatest(momentum, lo_momentum), hi_momentum) - m_momentum) / s_momentum
    + b2 * coalesce((CASE WHEN stretch IS NOT NULL THEN least(greatest(stretch, lo_stretch), hi_stretch) END - m_stretch) / s_stretch, 0) AS arm
  FROM l, ends, mo, co, off WHERE split = 'test')"""


@query(
    "arm_predictions",
    f"""WITH {SCORED}, known AS (SELECT * FROM l WHERE momentum IS NOT NULL), {_prep_sql(["momentum"])},
one AS (SELECT covar_pop(z_momentum, yc) / var_pop(z_momentum) AS b, avg(yc) AS my, avg(z_momentum) AS mz FROM us),
{_ARM.replace("FROM l", "FROM known AS l")}
SELECT sc.instrument_id, sc.trading_day,
  {q6("(least(greatest(momentum, lo_momentum), hi_momentum) - m_momentum) / s_momentum * b + my - b * mz", "baseline")},
  {q6("arm", "search_5")}, {q6("arm", "union_5")}
FROM l JOIN sc ON sc.instrument_id = l.instrument_id AND sc.trading_day = l.trading_day, ends, mo, one WHERE l.split = 'test'""",
)
def arm_predictions(spark, sf):
    """All arms fitted on the baseline's rows and scored; every arm's column is returned."""
    train, panel = _train(spark, sf)
    log = [("search", 3, "stretch", True, "accepted"), ("search", 9, "size", True, "accepted")]
    trials = spark.createDataFrame(log, "method string, attempt int, factor string, accepted boolean, reason string")
    arms = combine.assemble_arms(["momentum"], trials, [5, 10])
    anchor, models = combine.fit_arms(train, arms, rows=panel.rows)
    scored = combine.prediction_panel(targets.split_rows(panel.df, FOLD.test), anchor, models)
    return rounded(scored, KEY, ["baseline", "search_5", "union_5"], 6)


_WHOLE = f"""WITH {PAIRED}, {_paired_sql("product")}"""


@query(
    "bootstrap_whole_years",
    f"""{_WHOLE} SELECT CAST(400 AS BIGINT) AS block_days, CAST(8 AS BIGINT) AS repeats, CAST(8 AS BIGINT) AS replicates,
  {q6("sum((ppe - bp) * weight) FILTER (WHERE common) / sum(weight) FILTER (WHERE common)", "low")},
  {q6("sum((ppe - bp) * weight) FILTER (WHERE common) / sum(weight) FILTER (WHERE common)", "high")},
  {q6("1 - sum(weight * mse) / sum(weight * baseline_mse)", "reduction", 5)} FROM pp""",
)
def bootstrap_whole_years(spark, sf):
    """Blocks as long as a year draw every day once, so the interval is the point estimate."""
    rows, weights, _ = paired_rows(spark, sf)
    report = bootstrap.paired_block_bootstrap(rows, weights, days=400, repeats=8)
    return report.select(
        F.col("block_days").cast("long").alias("block_days"),
        F.col("repeats").cast("long").alias("repeats"),
        F.col("delta_weighted_pearson_replicates").alias("replicates"),
        r6("delta_weighted_pearson_low").alias("low"),
        r6("delta_weighted_pearson_high").alias("high"),
        r6("relative_mse_reduction_low", 5).alias("reduction"),
    )


@query(
    "bootstrap_ranks_whole_years",
    f"""{_WHOLE} SELECT CAST(8 AS BIGINT) AS replicates,
  {q6("sum((ps - bs) * weight) FILTER (WHERE common) / sum(weight) FILTER (WHERE common)", "low")},
  {q6("sum((ps - bs) * weight) FILTER (WHERE common) / sum(weight) FILTER (WHERE common)", "high")} FROM pp""",
)
def bootstrap_ranks_whole_years(spark, sf):
    rows, weights, _ = paired_rows(spark, sf)
    report = bootstrap.paired_block_bootstrap(rows, weights, days=400, repeats=8, correlation="spearman")
    return report.select(
        F.col("delta_weighted_spearman_replicates").alias("replicates"),
        r6("delta_weighted_spearman_low").alias("low"),
        r6("delta_weighted_spearman_high").alias("high"),
    )


BLOCK_DAYS, REPEATS, SEED = 20, 2000, 20261102


def _resample_sql() -> str:
    """The hashed rule in SQL: how often each day is drawn per replicate."""
    key = f"(j * 7919 + replicate * 104729 + y * 1299709 + {SEED})"
    return f"""dy AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY trading_day) - 1 AS d, count(*) OVER (PARTITION BY y) AS m
  FROM (SELECT DISTINCT trading_day, CAST(year(trading_day) AS BIGINT) AS y FROM pr)),
yr AS (SELECT DISTINCT y, m, least({BLOCK_DAYS}, m) AS len FROM dy),
bl AS (SELECT y, m, len, replicate, j, ({key} % {bootstrap.PRIME} * {bootstrap.FIRST} % {bootstrap.PRIME} * {bootstrap.SECOND} % {bootstrap.PRIME}) % (m - len + 1) AS s
  FROM yr, range({REPEATS}) r(replicate), range(0, 400) q(j) WHERE j * len < m),
tm AS (SELECT y, replicate, s + k AS d, count(*) AS times FROM bl, range({BLOCK_DAYS}) o(k) WHERE k < len AND j * len + k < m GROUP BY ALL),
dt AS (SELECT trading_day, replicate, times FROM tm JOIN dy USING (y, d))"""


_SUMS_SQL = """sm AS (SELECT product, trading_day, count(*) AS n, sum(target) AS y, sum(target * target) AS yy, sum(baseline) AS b, sum(baseline * baseline) AS bb,
  sum(baseline * target) AS bya, sum(prediction) AS p, sum(prediction * prediction) AS pp_, sum(prediction * target) AS py,
  sum((target - baseline) * (target - baseline)) AS be, sum((target - prediction) * (target - prediction)) AS pe FROM pr GROUP BY ALL),
rs AS (SELECT product, replicate, """ + ", ".join(
    f"sum({c} * times) AS {c}" for c in ("n", "y", "yy", "b", "bb", "bya", "p", "pp_", "py", "be", "pe")
) + """ FROM sm JOIN dt USING (trading_day) GROUP BY ALL),
vr AS (SELECT *, yy - y * y / n AS vy, bb - b * b / n AS vb, pp_ - p * p / n AS vp FROM rs JOIN w USING (product)),
dl AS (SELECT *, CASE WHEN n >= 5 AND vy > 1.8e-15 * yy AND vb > 1.8e-15 * bb AND vp > 1.8e-15 * pp_ THEN
  (py - p * y / n) / sqrt(vp * vy) - (bya - b * y / n) / sqrt(vb * vy) END AS delta FROM vr),
rp AS (SELECT replicate, sum(delta * weight) / sum(weight) FILTER (WHERE delta IS NOT NULL) AS delta,
  1 - sum(weight * pe / n) / sum(weight * be / n) AS reduction FROM dl GROUP BY 1)"""


def _ends_sql(kind: str, source: str) -> str:
    return f"""CAST({BLOCK_DAYS} AS BIGINT) AS block_days, CAST({REPEATS} AS BIGINT) AS repeats,
  (SELECT count(delta) FROM {source}) AS delta_weighted_{kind}_replicates,
  {q6(f"(SELECT quantile_cont(delta, 0.025) FROM {source})", f"delta_weighted_{kind}_low")},
  {q6(f"(SELECT quantile_cont(delta, 0.975) FROM {source})", f"delta_weighted_{kind}_high")},
  (SELECT count(reduction) FROM rp) AS relative_mse_reduction_replicates,
  {q6("(SELECT quantile_cont(reduction, 0.025) FROM rp)", "relative_mse_reduction_low", 5)},
  {q6("(SELECT quantile_cont(reduction, 0.975) FROM rp)", "relative_mse_reduction_high", 5)}"""


def _bootstrap(spark, sf, kind: str) -> DataFrame:
    rows, weights, _ = paired_rows(spark, sf)
    report = bootstrap.paired_block_bootstrap(
        rows, weights, BLOCK_DAYS, REPEATS, SEED, correlation=kind, rule="hashed"
    )
    ends = {c: r6(c, 5 if c.startswith("relative") else 6) for c in report.columns if c.endswith(("_low", "_high"))}
    return report.withColumns(ends | {c: F.col(c).cast("long") for c in ("block_days", "repeats")})


@query("bootstrap_pearson", f"WITH {PAIRED}, {_resample_sql()}, {_SUMS_SQL} SELECT {_ends_sql('pearson', 'rp')}")
def bootstrap_pearson(spark, sf):
    return _bootstrap(spark, sf, "pearson")


def _mid_rank(column: str) -> str:
    """Twice the average rank in a resample with multiplicities, shifted alike for all rows."""
    upto = "OVER (PARTITION BY product, replicate ORDER BY {c} RANGE UNBOUNDED PRECEDING)"
    same = "OVER (PARTITION BY product, replicate, {c})"
    return f"2 * sum(times) {upto} - sum(times) {same}".replace("{c}", column)


@query(
    "bootstrap_spearman",
    f"""WITH {PAIRED}, {_resample_sql()}, {_SUMS_SQL},
rk AS (SELECT product, replicate, times, {_mid_rank("target")} AS ry, {_mid_rank("baseline")} AS rb, {_mid_rank("prediction")} AS rq
  FROM pr JOIN dt USING (trading_day) WHERE product IN (SELECT product FROM w)),
mo2 AS (SELECT product, replicate, sum(times) AS n, sum(times * ry) AS y, sum(times * rb) AS b, sum(times * rq) AS p,
  sum(times * ry * ry) AS yy, sum(times * rb * rb) AS bb, sum(times * rq * rq) AS qq, sum(times * ry * rb) AS yb, sum(times * ry * rq) AS yq
  FROM rk GROUP BY ALL HAVING sum(times) >= 5),
va AS (SELECT *, yy - y * y / n AS vy, bb - b * b / n AS vb, qq - p * p / n AS vq FROM mo2),
sd AS (SELECT product, replicate, (yq - y * p / n) / sqrt(vy * vq) - (yb - y * b / n) / sqrt(vy * vb) AS delta FROM va WHERE vy > 0 AND vb > 0 AND vq > 0),
sr AS (SELECT replicate, sum(delta * weight) / sum(weight) AS delta FROM sd JOIN w USING (product) GROUP BY 1)
SELECT {_ends_sql('spearman', 'sr')}""",
)
def bootstrap_spearman(spark, sf):
    return _bootstrap(spark, sf, "spearman")
