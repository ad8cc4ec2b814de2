"""Split forms against plain ones on keys that hold a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import blocks
from factorloom.operators.asof import asof_join
from factorloom.operators.blocks import oversized, positions, range_blocks, running, with_halo
from factorloom.operators.radix import quantiles
from factorloom.operators.ranks import attach_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(4)
    keys = np.where(rng.random(600) < 0.4, "hot", rng.choice([f"k{i}" for i in range(20)], 600))
    values = np.round(rng.normal(size=600), 1)
    pdf = pd.DataFrame({"k": keys, "at": np.arange(600), "v": values, "w": rng.integers(0, 3, 600)})
    pdf["maybe"] = pdf["v"].where(rng.random(600) < 0.5)
    return pdf


def load(spark, pdf):
    clean = pdf.astype({"maybe": object}).where(pdf.notna(), None)
    return spark.createDataFrame(clean, "k string, at long, v double, w long, maybe double")


def test_running_values_match(spark, skewed):
    df = load(spark, skewed)
    frames = []
    for split in (False, True):
        out = running(df, ["k"], ["at"], {"total": F.col("w")}, {"last": F.col("maybe")}, split=split)
        frames.append(out.select("k", "at", "total", "last").toPandas().sort_values(["k", "at"]).reset_index(drop=True))
    pd.testing.assert_frame_equal(*frames)
    expected = skewed.sort_values(["k", "at"]).groupby("k")["w"].cumsum()
    assert frames[0]["total"].tolist() == expected.tolist()


def test_blocks_spread_a_hot_key(spark, skewed):
    blocks = range_blocks(load(spark, skewed), ["k"], ["at"])
    spread = blocks.where("k = 'hot'").select("__part").distinct().count()
    assert spread > 1


@pytest.mark.parametrize("keys", [["k"], []])
def test_ranks_and_quantiles_match(spark, skewed, keys):
    df = load(spark, skewed)
    ranks = []
    for split in (False, True):
        out = attach_ranks(df, keys, "maybe", "r", count="n", split=split).toPandas().sort_values("at")
        ranks.append(out[["at", "r", "n"]].reset_index(drop=True))
    pd.testing.assert_frame_equal(*ranks, check_dtype=False)
    grouped = skewed.groupby(keys)["maybe"] if keys else skewed["maybe"]
    np.testing.assert_allclose(ranks[0]["r"].astype(float), grouped.rank(), equal_nan=True)
    for last in (1 << 16, 3):
        out = quantiles(df, keys, ["v", "maybe"], (0.01, 0.5, 0.9), last).toPandas()
        for _, row in out.iterrows():
            part = skewed[skewed["k"] == row["k"]] if keys else skewed
            for c in ("v", "maybe"):
                values = part[c].dropna()
                if len(values):
                    np.testing.assert_allclose(row[f"{c}_q"], np.quantile(values, (0.01, 0.5, 0.9)))


def test_halo_gives_every_block_its_reach(spark, skewed):
    df = positions(load(spark, skewed), ["k"], ["at"], "p")
    spread = with_halo(df, "p", size=10, back=23, ahead=2).toPandas()
    home = spread[spread["__home"]]
    assert len(home) == 600
    for (key, block), part in spread.groupby(["k", "__block"]):
        own = part[part["__home"]]["p"]
        if len(own):
            size = (skewed["k"] == key).sum()
            wanted = set(range(max(0, own.min() - 23), min(size, own.max() + 3)))
            assert wanted <= set(part["p"])


@pytest.mark.parametrize("group", [10_000, 40])
def test_asof_keeps_null_publications(spark, configured, skewed, group):
    configured(group=group)
    left = load(spark, skewed).select("k", "at", "w")
    published = skewed[skewed["at"] % 7 == 0][["k", "at", "maybe"]].rename(columns={"at": "t"})
    right = spark.createDataFrame(
        published.astype({"maybe": object}).where(published.notna(), None), "k string, t long, maybe double"
    )
    out = asof_join(left, right, ["k"], "at", "t", ["maybe"]).toPandas().sort_values("at").reset_index(drop=True)
    assert len(out) == 600
    for _, row in out.iterrows():
        past = published[(published["k"] == row["k"]) & (published["t"] <= row["at"])]
        want = past.sort_values("t")["maybe"].iloc[-1] if len(past) else np.nan
        assert row["maybe"] == pytest.approx(want, nan_ok=True)


def test_oversized_uses_the_bound_before_measuring(spark, configured, skewed):
    configured(group=100)
    df = load(spark, skewed)
    assert oversized(df, ["k"]) and not oversized(df, ["at"])
    assert not oversized(df, ["k"], bound=100)


def test_work_folder_can_be_removed(spark, monkeypatch, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir")
    assert blocks.shared_folder(spark) == f"{before}/factorloom/{spark.sparkContext.applicationId}"
    monkeypatch.setattr(blocks, "shared_folder", lambda session: str(tmp_path / "work"))
    df = blocks.frozen(spark.range(5))
    assert df.count() == 5 and (tmp_path / "work").exists()
    blocks.remove_work(spark)
    assert not (tmp_path / "work").exists() and spark.conf.get("spark.checkpoint.dir") == before
