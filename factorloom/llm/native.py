"""Column expressions and prefix sums for the operators that use DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE

BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words of a text in order; empty for a null text or one without words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def prefix_sums(
    df: DataFrame, keys: list[str], group: Column, order: list[str], values: dict[str, Column]
) -> DataFrame:
    """Append the sum of each value over all earlier rows of the same keys, in two passes.

    Rows are in the order of `group`, then of `order`.  No window holds more than one group's rows or
    one key's group totals, so a key with a third of all rows is still spread over its groups.
    """
    staged = df.withColumns({"__g": group} | {f"__v_{n}": v for n, v in values.items()})
    totals = staged.groupBy(*keys, "__g").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "__g", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__c_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys, "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = staged.withColumns({f"__l_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in values})
    joined = local.join(carried, [*keys, "__g"])
    scratch = ["__g", *[f"__{k}_{n}" for n in values for k in "vlc"]]
    return joined.withColumns({n: F.col(f"__c_{n}") + F.col(f"__l_{n}") for n in values}).drop(*scratch)
