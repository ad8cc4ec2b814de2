"""Leaf-wise boosting against a direct numpy version."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import boosting
from factorloom.operators.boosting import TreeSettings, fit


def direct(x, y, settings, new):
    """Predictions for `new`, growing every tree on the rows themselves."""
    points = np.arange(1, settings.bins) / settings.bins
    cuts = [np.unique(np.quantile(c, points)) for c in x.T]
    score, out = np.full(len(y), y.mean()), np.full(len(new), y.mean())
    sizes = []
    for _ in range(settings.rounds):
        g = score - y
        leaf, other = np.zeros(len(y), int), np.zeros(len(new), int)
        count = 1
        while count < settings.leaves:
            best = (0.0, None)
            for k in range(count):
                own = leaf == k
                for j, ends in enumerate(cuts):
                    for at in ends:
                        low = own & (x[:, j] <= at)
                        high = own & ~(x[:, j] <= at)
                        if low.sum() < settings.min_rows or high.sum() < settings.min_rows:
                            continue
                        worth = lambda rows: g[rows].sum() ** 2 / (rows.sum() + settings.l2)
                        gain = worth(low) + worth(high) - worth(own)
                        if gain > best[0] + 1e-12:
                            best = (gain, (k, j, at))
            if best[1] is None:
                break
            k, j, at = best[1]
            leaf[(leaf == k) & (x[:, j] > at)] = count
            other[(other == k) & (new[:, j] > at)] = count
            count += 1
        sizes.append(count)
        for k in range(count):
            value = -settings.learning_rate * g[leaf == k].sum() / ((leaf == k).sum() + settings.l2)
            score[leaf == k] += value
            out[other == k] += value
    return out, sizes


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    n = 500
    x = rng.normal(size=(n, 3))
    x[:, 2] = rng.integers(0, 4, n)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) * x[:, 1] + 0.5 * x[:, 2] + rng.normal(size=n) / 5
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y)
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("settings", [TreeSettings(3, 0.3, 6, 12, 1.0, 10), TreeSettings(13, 0.1, 4, 30, 0.0, 255), TreeSettings(2, 0.5, 50, 40, 1.0, 16)])
def test_equals_the_direct_version(rows, settings):
    pdf, df = rows
    x = pdf[["a", "b", "c"]].to_numpy()
    want, sizes = direct(x, pdf["y"].to_numpy(), settings, x)
    model = fit(df.repartition(4), ["a", "b", "c"], "y", settings)
    assert [len(t.values) for t in model.trees] == sizes
    got = df.select(model.expression([F.col(c) for c in "abc"]).alias("p"), "y").toPandas()
    np.testing.assert_allclose(got["p"], want, atol=1e-8)
    assert ((got["p"] - pdf["y"]) ** 2).mean() < pdf["y"].var()


def test_trees_do_not_depend_on_partitions(rows):
    _, df = rows
    settings = TreeSettings(3, 0.2, 8, 10, 1.0, 32)
    models = [fit(df.repartition(k), ["a", "b", "c"], "y", settings) for k in (1, 7)]
    assert models[0].trees == models[1].trees


def test_blocks_of_several_batches(rows, monkeypatch):
    pdf, _ = rows
    monkeypatch.setattr(boosting, "BLOCK", 64)
    cuts = [np.unique(pdf[c]) for c in "ab"]
    import pyarrow as pa

    batches = pa.Table.from_pandas(pdf[["a", "b", "y"]]).to_batches(max_chunksize=150)
    blocks = [b for p in boosting._pack(cuts)(iter(batches)) for b in boosting._unpacked(p, 2)]
    assert sum(len(label) for _, label, _ in blocks) == len(pdf) and max(len(label) for _, label, _ in blocks) <= 64
    assert np.concatenate([label for _, label, _ in blocks]).tolist() == pdf["y"].tolist()


def test_rows_with_the_same_bins_are_stored_once(rows, spark, monkeypatch):
    """What a pass reads is bounded by the bins, not by the rows."""
    _, df = rows
    kept, written = [], boosting.frozen
    monkeypatch.setattr(boosting, "frozen", lambda d: kept.append(written(d)) or kept[-1])
    settings = TreeSettings(2, 0.3, 6, 12, 1.0, 4)
    few = df.crossJoin(spark.range(20)).repartition(5)
    model = fit(few, ["a", "c"], "y", settings)
    blocks = [d for d in kept if "bins" in d.columns][-1].collect()
    n = np.concatenate([np.frombuffer(b.n, np.int64) for b in blocks])
    assert len(n) <= 4 * 4 and n.sum() == 500 * 20
    x = few.select("a", "c", "y").toPandas()
    want, sizes = direct(x[["a", "c"]].to_numpy(), x["y"].to_numpy(), settings, x[["a", "c"]].to_numpy())
    assert [len(t.values) for t in model.trees] == sizes
    got = spark.createDataFrame(x).select(model.expression([F.col("a"), F.col("c")]).alias("p")).toPandas()["p"]
    np.testing.assert_allclose(got, want, atol=1e-8)


def test_constant_labels_and_no_rows(rows):
    _, df = rows
    flat = fit(df.withColumn("y", F.lit(2.5)), ["a"], "y", TreeSettings(2))
    assert flat.initial == 2.5 and all(len(t.values) == 1 and t.values[0] == 0 for t in flat.trees)
    with pytest.raises(ValueError):
        fit(df.limit(0), ["a"], "y")
