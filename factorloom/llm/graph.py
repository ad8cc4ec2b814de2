"""Connected components of a link table, without the driver holding links or members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import frozen


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its part) of the given links."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        # Hook the larger root on the smaller, then shorten the paths.
        x, y = root[left], root[right]
        open_links = x != y
        if not open_links.any():
            break
        np.minimum.at(root, np.maximum(x, y)[open_links], np.minimum(x, y)[open_links])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, limit = [], [], 2_000_000
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        if sum(map(len, a)) >= limit:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, limit = [x], [y], max(limit, 2 * len(x))
    if a:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link (a, b), both long; root is its component's smallest node.

    Partitions first shrink their links to star forests; large-star and small-star rounds then join
    the stars.  A round moves each link a fixed number of times and their number is logarithmic.  A
    node with many links is a hub of the joins only, whose skewed partitions Spark splits.
    """
    plain = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    stars = frozen(plain.filter("a <> b").mapInArrow(_contract, "a long, b long"))
    while True:
        # A star forest: every node points to one root and no root points on.
        rows, nodes = stars.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
        if rows == nodes and not stars.join(stars.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(least, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        large = frozen(large)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(lowest.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        stars = frozen(small.mapInArrow(_contract, "a long, b long").distinct())
