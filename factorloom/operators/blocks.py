"""Skew-safe building blocks: size checks, range blocks, running values and row halos.

A window over one key is a single task, so it may only be used while the key's rows fit a task.
Callers either prove that with a row bound (usually the row count in the Parquet footers) or let
`oversized` measure the largest group with a map-side combined count.  Oversized groups take the
split forms below, which work on range partitions of bounded size and carry small per-block
summaries across the block borders.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

LIMIT_CONF = "spark.factorloom.groupRows"
DEFAULT_LIMIT = 4_000_000
PART_CONF = "spark.factorloom.partRows"
DEFAULT_PART = 1_000_000
BROADCAST_CONF = "spark.factorloom.broadcastRows"
DEFAULT_BROADCAST = 1_000_000


# Calendar days in three centuries: what a date-keyed statistic can hold at most.
DAY_ROWS = 110_000


def group_limit(spark: SparkSession) -> int:
    """Rows of one key that a single task may sort."""
    return int(spark.conf.get(LIMIT_CONF, str(DEFAULT_LIMIT)))


def parts_of(spark: SparkSession, rows: int) -> int:
    """Partitions of a shuffle of so many rows, so that a task's memory does not follow the input."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // int(spark.conf.get(PART_CONF, str(DEFAULT_PART)))))


def dealt(df: DataFrame, rows: int, keys: Sequence[str]) -> DataFrame:
    """Rows shuffled by `keys` into `parts_of` tasks, where the session's number of them would be too few.

    An aggregation by the same keys then needs no shuffle of its own.  Small tables stay as they are, so
    that they combine before the shuffle.
    """
    parts, spark = parts_of(df.sparkSession, rows), df.sparkSession
    few = parts <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df if few else df.repartition(parts, *keys)


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_CONF, str(DEFAULT_BROADCAST)))


def footer_rows(df: DataFrame) -> int:
    """Row count of a plain Parquet scan; answered from file footers."""
    return df.count()


def oversized(
    df: DataFrame, keys: Sequence[str], bound: int | None = None, share: int = 1
) -> bool:
    """Whether some key holds more rows than a task should sort.

    `share` divides the limit for operations that keep several copies or heavier state per row.
    """
    limit = group_limit(df.sparkSession) // share
    if bound is not None and bound <= limit:
        return False
    if not keys:
        return df.count() > limit
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return (largest or 0) > limit


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's work folder, which all executors can read.

    It lies under `spark.checkpoint.dir`.  Only a local session without that setting gets a temporary
    folder, which is removed at exit; the session's settings stay as they are.
    """
    application = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is not None:
        return f"{base.rstrip('/')}/factorloom/{application}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="factorloom-")
        atexit.register(shutil.rmtree, _own_folders[application], ignore_errors=True)
    return _own_folders[application]


def remove_work(spark: SparkSession) -> None:
    """Delete the application's intermediate tables; frames that still read them fail afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(conf).delete(path, True)


def frozen(df: DataFrame) -> DataFrame:
    """Write the rows once and read them back.

    Cuts the lineage, so that block borders cannot move when a task is recomputed and a lost
    executor costs a re-read instead of the whole history.  Unlike an RDD checkpoint the rows are
    computed once, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition by (keys, order) and freeze the block number as `__part`.

    Range borders are sampled from the data, so a key with a third of all rows spreads over a
    third of the blocks.  Equal (keys, order) values always share a block.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return frozen(ranged.withColumn("__part", F.spark_partition_id()))


def join_stats(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], bound: int | None = None
) -> DataFrame:
    """Left join of per-key statistics.

    `bound` is a proven row bound of `stats` (one row per factor, per calendar day, ...).  Within
    the limit the statistics are broadcast and the big side is not shuffled; without a bound the
    measured size picks the join and adaptive execution splits skewed keys.
    """
    if bound is not None and bound <= broadcast_limit(df.sparkSession):
        stats = F.broadcast(stats)
    return df.join(stats, list(keys), "left")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    split: bool = False,
) -> DataFrame:
    """Append running sums and last non-null values along `order` (unique per key), inclusive."""
    sums, lasts = sums or {}, lasts or {}
    if not split:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        columns = {n: F.sum(c).over(w) for n, c in sums.items()}
        columns |= {n: F.last(c, ignorenulls=True).over(w) for n, c in lasts.items()}
        return df.withColumns(columns)
    staged = df.withColumns({f"__in_{n}": c for n, c in (sums | lasts).items()})
    blocks = range_blocks(staged, keys, order)
    position = F.struct(*order)
    totals = [F.sum(f"__in_{n}").alias(f"__c_{n}") for n in sums]
    totals += [
        F.max_by(f"__in_{n}", F.when(F.col(f"__in_{n}").isNotNull(), position)).alias(f"__c_{n}")
        for n in lasts
    ]
    # One row per (key, block): bounded by the number of keys plus the number of blocks.
    parts = blocks.groupBy(*keys, "__part").agg(*totals)
    earlier = (
        Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = parts.select(
        *keys,
        "__part",
        *[F.sum(f"__c_{n}").over(earlier).alias(f"__c_{n}") for n in sums],
        *[F.last(f"__c_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in lasts],
    )
    inside = (
        Window.partitionBy(*keys, "__part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = blocks.join(carry, [*keys, "__part"], "left")
    columns = {}
    for n in sums:
        local, before = F.sum(f"__in_{n}").over(inside), F.col(f"__c_{n}")
        columns[n] = F.when(
            local.isNotNull() | before.isNotNull(),
            F.coalesce(local, F.lit(0)) + F.coalesce(before, F.lit(0)),
        )
    for n in lasts:
        columns[n] = F.coalesce(
            F.last(f"__in_{n}", ignorenulls=True).over(inside), F.col(f"__c_{n}")
        )
    scratch = ["__part"] + [f"__{k}_{n}" for n in (*sums, *lasts) for k in ("in", "c")]
    return joined.withColumns(columns).drop(*scratch)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Zero-based row position inside each key, frozen for repeated use."""
    numbered = running(df, keys, order, sums={out: F.lit(1).cast("long")}, split=True)
    return frozen(numbered.withColumn(out, F.col(out) - 1))


def with_halo(df: DataFrame, position: str, size: int, back: int, ahead: int) -> DataFrame:
    """Copy rows near block borders into the neighbouring blocks that read them.

    Adds `__block` and `__home` (false on copies).  Exact for any reach: a row at position p is
    needed by every block that covers p - ahead .. p + back.
    """
    p = F.col(position)
    first = F.greatest(F.floor((p - ahead) / size), F.lit(0).cast("long"))
    last = F.floor((p + back) / size)
    home = F.floor(p / size)
    return df.withColumn("__block", F.explode(F.sequence(first, last))).withColumn(
        "__home", F.col("__block") == home
    )
