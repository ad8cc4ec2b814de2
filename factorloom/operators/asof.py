"""Backward as-of join: the latest publication at or before each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .blocks import oversized, running


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    published: str,
    values: Sequence[str],
    rows: int | None = None,
) -> DataFrame:
    """Left rows with `values` of the newest right row whose `published` <= `time`.

    Both sides are stacked and the last publication is carried forward, so there is one shuffle
    and no inequality join.  A publication is a struct: its null fields replace older values.
    """
    hit = F.struct(*[F.col(v).alias(v) for v in values])
    stacked_left = left.withColumn("__row", F.lit(1))
    stacked_right = right.select(
        *keys, F.col(published).alias(time), hit.alias("__hit"), F.lit(0).alias("__row")
    )
    both = stacked_left.unionByName(stacked_right, allowMissingColumns=True)
    split = oversized(both, keys, rows)
    carried = running(both, keys, [time, "__row"], lasts={"__last": F.col("__hit")}, split=split)
    kept = [c for c in left.columns if c not in values]
    return carried.where(F.col("__row") == 1).select(*kept, *[F.col(f"__last.{v}") for v in values])
