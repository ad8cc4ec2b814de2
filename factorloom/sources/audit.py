"""Integrity report of a bar dataset and parity between two keyed frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.guards import is_finite
from .market import quality_fields

KEYS = ("exchange", "instrument_id", "timestamp")


def _invalid(names: Sequence[str]) -> Column:
    o, h, low, c = (F.col(n) for n in names)
    return (h < low) | (h < o) | (h < c) | (low > o) | (low > c)


def _missing(names: Sequence[str]) -> Column:
    rule = F.lit(False)
    for n in names:
        rule = rule | ~is_finite(F.col(n))
    return rule


def audit(bars: DataFrame, fundamentals: Sequence[str] = ()) -> DataFrame:
    """One row of integrity counts.

    Rows are combined per observation key first (map side), then per instrument, so the distinct
    counts run on a small frame instead of expanding the whole table.
    """
    names = quality_fields(bars.columns)
    if not names:
        raise ValueError("the audit needs complete raw or adjusted OHLC columns")
    columns = set(bars.columns)
    null_key = F.lit(False)
    for k in (*KEYS, "trading_day"):
        null_key = null_key | F.col(k).isNull()
    counters = {
        "null_keys": null_key,
        "invalid_ohlc": _invalid(names),
        "missing_close": _missing(names[3:]),
        "missing_ohlc": _missing(names),
    }
    counters |= {f"rows_{c}": F.col(c).cast("boolean") for c in sorted(columns) if c.startswith("in_")}
    if "fundamentals_source_day" in columns:
        counters["availability_violations"] = F.col("fundamentals_source_day") >= F.col("trading_day")
        counters |= {f"finite_{c}": is_finite(F.col(c)) for c in fundamentals}
    flags = [c for c in ("is_st", "is_suspended") if c in columns]
    if flags:
        unknown = F.lit(False)
        for c in flags:
            unknown = unknown | F.col(c).isNull()
        counters["missing_trading_flags"] = unknown
    product = [F.max("product").alias("product")] if "product" in columns else []
    per_key = bars.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("trading_day").alias("first_day"),
        F.max("trading_day").alias("last_day"),
        *product,
        *[F.count_if(rule).alias(n) for n, rule in counters.items()],
    )
    sums = [F.sum(n).alias(n) for n in ("rows", *counters)]
    spans = [F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")]
    group = ["exchange", "instrument_id"] + (["product"] if product else [])
    per_instrument = per_key.groupBy(*group).agg(
        F.sum(F.col("rows") - 1).alias("duplicate_rows"), *sums, *spans
    )
    total = per_instrument.agg(
        *sums,
        *spans,
        F.sum("duplicate_rows").alias("duplicate_rows"),
        F.count_distinct(F.struct("exchange", "instrument_id")).alias("instruments"),
        *([F.count_distinct("product").alias("products")] if product else []),
    )
    label_columns = sum(c.startswith("label_") for c in columns)
    integrity = ["duplicate_rows", "null_keys"]
    integrity += [n for n in ("availability_violations", "missing_trading_flags") if n in counters]
    ready = F.lit(label_columns == 0)
    for n in integrity:
        if n != "missing_trading_flags":
            ready = ready & (F.col(n) == 0)
    passed = ready
    for n in ("invalid_ohlc", "missing_close", "missing_ohlc", *integrity):
        passed = passed & (F.col(n) == 0)
    shares = {f"coverage_{c}": F.col(f"finite_{c}") / F.col("rows") for c in fundamentals if f"finite_{c}" in counters}
    return total.withColumns(
        {
            "column_count": F.lit(len(columns)),
            "label_columns": F.lit(label_columns),
            "passed": passed,
            "research_ready": ready,
            **shares,
        }
    )


def rows_by_year(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.year("trading_day").alias("year")).agg(F.count(F.lit(1)).alias("rows"))


def anomalies(bars: DataFrame, samples: int | None = None) -> DataFrame:
    """All rows that violate the OHLC ordering; the first `samples` of them if a number is given."""
    names = quality_fields(bars.columns)
    broken = bars.where(_invalid(names)).select("timestamp", "exchange", "instrument_id", *names)
    if samples is None:
        return broken
    return broken.orderBy("timestamp", "exchange", "instrument_id").limit(samples)


def parity(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    rtol: float = 1e-8,
    atol: float = 1e-10,
) -> DataFrame:
    """Per column: finite rows, equal null masks, tolerance and largest error; one aggregate."""
    a = left.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in columns], F.lit(1).alias("__in_a"))
    b = right.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in columns], F.lit(1).alias("__in_b"))
    both = a.join(b, list(keys), "full")
    aggregates = [
        F.count_if(F.col("__in_a").isNull() | F.col("__in_b").isNull()).alias("__unmatched")
    ]
    for c in columns:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        fx, fy = is_finite(x), is_finite(y)
        error = F.when(fx & fy, F.abs(x - y))
        aggregates.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(fx).alias("finite_rows"),
                (F.count_if(fx != fy) == 0).alias("null_mask_equal"),
                (F.count_if((fx != fy) | (error > atol + rtol * F.abs(y))) == 0).alias(
                    "within_tolerance"
                ),
                F.max(error).alias("max_absolute_error"),
            ).alias(f"__s_{c}")
        )
    one = both.agg(*aggregates)
    rows = one.select(
        "__unmatched", F.explode(F.array(*[F.col(f"__s_{c}") for c in columns])).alias("r")
    )
    return rows.select("r.*", F.col("__unmatched").alias("unmatched_keys"))
