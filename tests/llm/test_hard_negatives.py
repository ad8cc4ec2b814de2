"""Hard negatives against comparison of all pairs."""

import os

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from factorloom.llm import ORACLE, QUERIES, hard_negatives

SCHEMA = "vec_id long, label int, vector array<int>, rank string, score double"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    known = {}
    for vec_id, label, vector, *_ in rows:
        if vec_id is None or label is None or vector is None or None in vector:
            continue
        known[vec_id] = min(known.get(vec_id, (label, vector)), (label, vector))

    def score(a, b):
        return sum(x * y for x, y in zip(known[a][1], known[b][1]))

    out = []
    for a in (i for i in known if anchors(i)):
        alike = sorted((-score(a, i), i) for i in known if i != a and known[i][0] == known[a][0])[:positives]
        other = sorted((-score(a, i), i) for i in known if known[i][0] != known[a][0])
        for minus, p in alike:
            inside = [(s, i) for s, i in other if low * -minus <= -100 * s <= high * -minus][:negatives]
            out += [(a, p, k + 1, i, -minus, -s) for k, (s, i) in enumerate(inside)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA)


@pytest.mark.parametrize("width", [1, 2, 6])
def test_equals_all_pairs(spark, width):
    rng = np.random.default_rng(width)
    # Few values, so many ties; half of the rows carry one label; equal vectors; negative scores.
    rows = [(int(i), int(rng.choice([0, 0, 0, 1, 2, 3])), rng.integers(-3, 8, width).tolist()) for i in rng.permutation(400)]
    rows += [(1000 + i, i % 2, [5] * width) for i in range(120)]
    got = found(hard_negatives.mine(table(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, block_rows=90, tile_rows=17))
    assert got == brute(rows, lambda i: i % 20 == 0)
    assert got == found(hard_negatives.mine(table(spark, rows), F.col("vec_id") % 20 == 0))


def test_other_windows_and_counts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, rng.integers(-9, 20, 4).tolist()) for i in range(150)]
    args = {"positives": 2, "negatives": 4, "low": 10, "high": 60}
    assert found(hard_negatives.mine(table(spark, rows), F.col("vec_id") < 30, **args)) == brute(rows, lambda i: i < 30, **args)


def test_rows_that_take_no_part(spark):
    rows = [
        (0, 1, [4, 4]), (1, 1, [4, 3]), (2, 2, [3, 3]), (3, 2, [2, 2, 9]), (4, 2, [5]), (5, 2, []),
        (6, None, [4, 4]), (7, 2, None), (8, 2, [3, None]), (None, 2, [3, 3]),
        # Repeated rows, and another row under a known id.
        (2, 2, [3, 3]), (2, 3, [9, 9]), (10, 9, [1, 1]),
    ]
    assert found(hard_negatives.mine(table(spark, rows), F.col("vec_id") == 0)) == brute(rows, lambda i: i == 0) != []
    assert found(hard_negatives.mine(table(spark, rows), F.col("vec_id") == 10)) == []
    assert found(hard_negatives.mine(table(spark, rows[:0] or rows).filter("false"), F.col("vec_id") == 0)) == []


def test_large_components_and_long_vectors(spark):
    limit = hard_negatives.LARGEST
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, (rng.integers(limit // 2, limit, 3000) * 1).tolist()) for i in range(12)]
    assert found(hard_negatives.mine(table(spark, rows), F.col("vec_id") < 4)) == brute(rows, lambda i: i < 4)


def test_quantised_and_usable(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001, 1e30]), (1, [nan]), (1, [-inf]), (1, [None]), (None, [1.0]), (1, None), (1, [])]
    df = spark.createDataFrame(rows, "label int, v array<float>")
    got = df.select(hard_negatives.usable(F.col("label"), F.col("v")).alias("u"), hard_negatives.quantised(F.col("v")).alias("q")).collect()
    assert [r.u for r in got] == [True, False, False, False, False, False, True]
    assert got[0].q == [128, -1, hard_negatives.LARGEST] and got[6].q == []


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not available")
@pytest.mark.parametrize("name", list(ORACLE))
def test_queries_match_sql(spark, name):
    ok, text = compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name])
    assert ok, text
