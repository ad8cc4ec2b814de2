"""Statistics over logs of factor trials: evidence per region, runs and library growth.

A trial log has run_id, trial (order inside the run), region, accepted, reason, status, train, val,
coverage and residual_ic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.guards import is_finite
from .blocks import join_stats, oversized, running
from .radix import quantiles

OUTCOMES = ("probing", "seabed", "saturated", "land")


def reason_counts(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    return trials.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("trials"))


def region_evidence(
    trials: DataFrame, min_coverage: float = 0.0, rows: int | None = None
) -> DataFrame:
    """Per region: attempts, qualified evaluations, quartiles of train / val / gap and a label."""
    success = F.col("status") == "success"
    qualified = (
        success
        & is_finite(F.col("train"))
        & is_finite(F.col("val"))
        & is_finite(F.col("coverage"))
        & (F.col("coverage") >= min_coverage)
    )
    train, val = F.abs("train"), F.col("val")
    values = {"train": train, "val": val, "gap": train - val}
    marked = trials.select(
        "region",
        "accepted",
        success.alias("__success"),
        qualified.alias("__qualified"),
        *[F.when(qualified, c).alias(f"__{n}") for n, c in values.items()],
    )
    ok, signed = F.col("__qualified"), F.col("__val")
    positive, negative = F.count_if(ok & (signed > 0)), F.count_if(ok & (signed < 0))
    neutral, n = F.count_if(ok & (signed == 0)), F.count_if(ok)
    label = (
        F.when(n == 0, "insufficient samples")
        .when(((positive > 0) & (negative > 0)) | (neutral > 0), "mixed evidence")
        .when(positive > 0, "preliminary support")
        .otherwise("weak validation this round")
    )
    counts = marked.groupBy("region").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("__success").alias("successful"),
        n.alias("qualified"),
        F.count_if("accepted").alias("admitted"),
        F.try_divide(positive, n).alias("positive_ratio"),
        label.alias("evidence"),
    )
    ends = quantiles(marked, ["region"], [f"__{c}" for c in values], (0.25, 0.5, 0.75))
    spread = ends.select(
        "region",
        *[
            F.col(f"__{c}_q")[i].alias(f"{c}_{q}")
            for c in values
            for i, q in enumerate(("q1", "median", "q3"))
        ],
    )
    return join_stats(counts, spread, ["region"])


def supporting_trials(trials: DataFrame, min_coverage: float = 0.0) -> DataFrame:
    """Per region the best supporting and the strongest opposing qualified trial."""
    usable = trials.where(
        (F.col("status") == "success")
        & is_finite(F.col("train"))
        & is_finite(F.col("val"))
        & (F.col("coverage") >= min_coverage)
    )
    # Earliest trial wins ties, as in a stable sort.
    order = F.struct(F.abs("val"), -F.col("trial"))

    def best(rule: Column) -> Column:
        return F.max_by("trial", F.when(rule, order))

    return usable.groupBy("region").agg(
        best(F.col("val") > 0).alias("supporting_trial"),
        best(F.col("val") < 0).alias("opposing_trial"),
    )


def discovery_curve(trials: DataFrame, rows: int | None = None) -> DataFrame:
    """Per run and trial: budget attempts used and library members and residual so far."""
    spent = F.when(F.col("reason") != "budget_rejected", 1).otherwise(0).cast("long")
    kept = F.col("accepted").cast("long")
    gain = F.when(F.col("accepted"), F.coalesce("residual_ic", F.lit(0.0))).otherwise(0.0)
    split = oversized(trials, ["run_id"], rows)
    return running(
        trials,
        ["run_id"],
        ["trial"],
        sums={"attempt": spent, "members": kept, "residual_sum": gain},
        split=split,
    ).select("run_id", "trial", "attempt", "members", "residual_sum")


def curve_nodes(trials: DataFrame, every: int = 100, rows: int | None = None) -> DataFrame:
    """The discovery curve sampled after each `every` attempts."""
    curve = discovery_curve(trials, rows).where(
        (F.col("attempt") > 0) & (F.col("attempt") % every == 0)
    )
    return curve.groupBy("run_id", F.col("attempt").alias("node")).agg(
        F.min_by("members", "trial").alias("members"),
        F.min_by("residual_sum", "trial").alias("residual_sum"),
    )


def compare_runs(trials: DataFrame) -> DataFrame:
    """Per run: trial records, spent attempts, accepted members and the residual they added."""
    return trials.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("trial_records"),
        F.count_if(F.col("reason") != "budget_rejected").alias("attempts"),
        F.count_if(F.col("accepted")).alias("accepted"),
        F.coalesce(F.sum(F.when(F.col("accepted"), F.col("residual_ic"))), F.lit(0.0)).alias(
            "admitted_residual"
        ),
    )


def band_status(trials: DataFrame, keys: Sequence[str], probe: int, rows: int | None = None) -> DataFrame:
    """State of each region (or region and band) from its ordered attempts.

    `land` while the last `probe` attempts add residual information, `saturated` when they no
    longer do, `seabed` when none ever did, `probing` before `probe` attempts.
    """
    gain = F.coalesce("residual_ic", F.lit(0.0))
    adds = F.col("accepted") & (gain > 0)
    order = ["run_id", "trial"]
    if oversized(trials, keys, rows):
        numbered = running(trials, keys, order, {"__at": F.lit(1).cast("long")}, split=True)
        sizes = trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
        numbered = numbered.join(sizes, list(keys), "left")
    else:
        w = Window.partitionBy(*keys)
        numbered = trials.withColumns(
            {
                "__at": F.row_number().over(w.orderBy(*order)),
                "__size": F.count(F.lit(1)).over(w),
            }
        )
    recent = F.col("__at") > F.col("__size") - probe
    n = F.count(F.lit(1))
    status = (
        F.when(n < probe, "probing")
        .when(~F.bool_or(adds), "seabed")
        .when((n >= 2 * probe) & ~F.coalesce(F.bool_or(F.when(recent, adds)), F.lit(False)), "saturated")
        .otherwise("land")
    )
    admitted = F.sum(F.when(F.col("accepted"), gain).otherwise(0.0))
    return numbered.groupBy(*keys).agg(
        n.alias("attempts"),
        F.count_if(F.col("accepted")).alias("admitted"),
        admitted.alias("admitted_residual"),
        (admitted / n).alias("residual_per_attempt"),
        status.alias("status"),
    )


def region_status(trials: DataFrame, probe: int, rows: int | None = None) -> DataFrame:
    """Regions summarised over their tested bands: any land keeps the region open."""
    bands = band_status(trials, ["region", "band"], probe, rows)
    total = band_status(trials, ["region"], probe, rows).drop("status")
    is_land = F.col("status") == "land"
    closed = F.col("status").isin("seabed", "saturated")
    status = (
        F.when(F.bool_or(is_land), "land")
        .when(F.bool_and(closed), F.when(F.bool_or(F.col("status") == "saturated"), "saturated").otherwise("seabed"))
        .otherwise("probing")
    )
    return total.join(bands.groupBy("region").agg(status.alias("status")), "region")
