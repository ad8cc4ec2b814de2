"""Scans, preparation and reductions on small hand-made inputs."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factorloom.functions import feature as fx
from factorloom.operators import coarse, monthly
from factorloom.operators.panel import Panel
from factorloom.sources import equities, futures, market, scan


def bars(spark, rows, extra=""):
    schema = "exchange string, instrument_id string, product string, timestamp timestamp, trading_day date, open double, high double, low double, close double"
    return spark.createDataFrame(rows, schema + extra)


def test_scan_unites_partitions_and_checks_columns(spark, tmp_path):
    one = spark.createDataFrame([(1, 1.0)], "row_id long, close double")
    two = spark.createDataFrame([(2, 2.0, True)], "row_id long, close double, in_core boolean")
    for name, df in (("year=2020/a.parq", one), ("year=2021/b.parq", two)):
        target = tmp_path / "bars" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        df.toPandas().to_parquet(target)
    (tmp_path / "bars" / "note.txt").write_text("ignored")
    panel = scan.scan_panel(spark, str(tmp_path / "bars"), "core")
    assert set(panel.columns) == {"row_id", "close", "in_core"} and panel.count() == 2
    with pytest.raises(ValueError, match="universe"):
        scan.scan_panel(spark, str(tmp_path / "bars"), "other")
    with pytest.raises(ValueError, match="label"):
        scan.check_columns(["label_1d"])


def test_feature_fields_come_from_the_schema(spark):
    schema = "row_id long, close double, adj_close double, adjfactor double, in_core boolean, is_st int, label_x double, target double, __tmp double, name string, segment_id long, instrument_id_p1 string, volume long"
    fields = scan.feature_fields(spark.createDataFrame([], schema).schema)
    assert fields == ["close", "adj_close", "volume"]
    with pytest.raises(ValueError):
        scan.check_features(["segment_id"], ["segment_id"])
    with pytest.raises(ValueError):
        scan.check_features(["missing"], ["close"])


def test_keys_row_ids_and_compaction(spark, tmp_path):
    rows = [("X", "A", datetime(2020, 1, 1 + i), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "exchange string, instrument_id string, timestamp timestamp, x double")
    assert scan.with_row_id(df).select("row_id").distinct().count() == 10
    scan.check_keys(df)
    with pytest.raises(ValueError, match="duplicate"):
        scan.check_keys(df.union(df.limit(1)))
    with pytest.raises(ValueError, match="null"):
        scan.check_keys(df.withColumn("instrument_id", F.when(F.col("x") > 1, "A")))
    scan.compact(df, str(tmp_path / "merged"))
    written = spark.read.parquet(str(tmp_path / "merged"))
    assert written.count() == 10
    with pytest.raises(ValueError):
        scan.compact(df.union(df.limit(1)), str(tmp_path / "other"))


def test_segments_break_on_gaps_rolls_and_invalid_bars(spark):
    days = [date(2020, 1, d) for d in (1, 2, 3, 4, 5)]
    rows = []
    for i, day in enumerate(days):
        if day == date(2020, 1, 3):
            continue  # A skips an observed market day
        high = 0.5 if i == 4 else 2.0
        rows.append(("X", "A", "P", datetime(day.year, day.month, day.day), day, 1.0, high, 0.5, 1.0))
    rows += [("X", "B", "Q", datetime(d.year, d.month, d.day), d, 1.0, 2.0, 0.5, 1.0) for d in days]
    panel = market.prepare_panel(bars(spark, rows), ["close"], date(2020, 12, 31))
    a = panel.where("instrument_id = 'A'").orderBy("timestamp").collect()
    assert [r["segment_id"] for r in a] == [1, 1, 2, 3]
    assert [r["valid_bar"] for r in a] == [True, True, True, False]
    assert a[-1]["close"] is None and not a[-1]["eligible"]
    assert {r["segment_id"] for r in panel.where("instrument_id = 'B'").collect()} == {1}


@pytest.mark.parametrize("group", [1000, 4])
def test_product_segments_survive_a_contract_roll(spark, configured, group):
    configured(group=group)
    rows = []
    for i in range(6):
        name = "A" if i < 3 else "B"
        rows.append(("X", name, "P", datetime(2020, 1, 1 + i), date(2020, 1, 1 + i), 1.0, 2.0, 0.5, 1.0))
    panel = market.prepare_panel(bars(spark, rows), ["close"], date(2020, 12, 31)).orderBy("timestamp").collect()
    assert [r["product_segment_id"] for r in panel] == [1] * 6
    assert [r["segment_id"] for r in panel] == [1] * 6  # each contract starts its own history


def minutes(spark):
    base = datetime(2020, 1, 2, 9, 1)
    rows = []
    for i in [0, 1, 2, 3, 4, 5, 6, 8, 9]:
        price = float(i + 1)
        rows.append((base + timedelta(minutes=i), price, price, 0, i, "src", "final", True))
    rows.append((base + timedelta(minutes=3), 99.0, 99.0, 5, 100, "src", "final", True))
    rows.append((base + timedelta(minutes=20), 1.0, 1.0, 0, 200, "src", "final", False))
    rows.append((base + timedelta(minutes=21), 1.0, 1.0, 0, 201, "src", "draft", True))
    df = spark.createDataFrame(
        rows, "bar_time timestamp, adj_open double, adj_close double, received int, ingest_seq int, source string, quality string, is_dominant boolean"
    )
    return df.withColumns(
        {
            "exchange": F.lit("X"),
            "product": F.lit("P"),
            "instrument_id": F.lit("P01"),
            "trading_day": F.lit(date(2020, 1, 2)),
            "adj_high": F.when(F.col("ingest_seq") != 1, F.col("adj_close")),
            "adj_low": F.col("adj_open"),
            "adj_vwap": F.when(F.col("ingest_seq") == 2, float("nan")).otherwise(F.col("adj_close")),
            "volume": F.lit(2).cast("long"),
            "turnover": F.lit(1.0),
            "open_interest": F.col("adj_close"),
            "adj_cum_factor": F.lit(1.0),
            "vwap_flag": F.lit("proxy"),
            "received_at": F.col("received"),
        }
    )


def test_session_bars_restart_after_gaps_and_use_the_newest_record(spark):
    out = futures.export_bars(minutes(spark), "src").orderBy("timestamp").collect()
    assert [r["source_bars"] for r in out] == [5, 2, 2]
    assert out[0]["adj_open"] == 1 and out[0]["adj_close"] == 5
    assert out[0]["adj_high"] is None  # one unknown high makes the bar's high unknown
    assert out[0]["adj_vwap"] == pytest.approx((1 + 2 + 99 + 5) / 4)
    assert out[0]["volume"] == 10 and out[0]["vwap_proxy_bars"] == 5


def test_far_contracts_are_listed_and_ordered_by_maturity(spark):
    instruments = spark.createDataFrame(
        [
            ("P01", "X", "P", "2019-01-01", "2020-01-31", "2020-01-31"),
            ("P02", "X", "P", "2019-01-01", "2020-02-28", "2020-02-28"),
            ("P03", "X", "P", "2020-01-03", "2020-03-31", "2020-03-31"),
            ("P04", "X", "P", "2019-01-01", "oops", "2020-04-30"),
        ],
        "instrument_id string, exchange string, underlying_symbol string, listed_date string, de_listed_date string, maturity_date string",
    )
    mapping = spark.createDataFrame(
        [(date(2020, 1, 2), "P01", "P"), (date(2020, 1, 3), "P01", "P")],
        "trading_day date, instrument_id string, product string",
    )
    out = futures.far_contract_mapping(mapping, instruments).orderBy("trading_day").collect()
    assert out[0]["instrument_id_p1"] == "P02" and out[0]["instrument_id_p2"] is None
    assert out[1]["instrument_id_p2"] == "P03" and out[1]["days_to_maturity_p1"] == 56


def test_equity_adjustment_and_publication(spark):
    prices = spark.createDataFrame(
        [("A", date(2020, 1, d), 1.0, 2.0, 0.5, 1.0) for d in (1, 2, 3)],
        "instrument_id string, trading_day date, open double, high double, low double, close double",
    )
    factors = spark.createDataFrame([("A", date(2020, 1, 2), 2.0)], "instrument_id string, ex_date date, adjfactor double")
    out = equities.adjust_prices(prices, factors).orderBy("trading_day").collect()
    assert [r["adj_close"] for r in out] == [1.0, 2.0, 2.0]
    seen = prices.select(F.col("trading_day").alias("source_day"), "close")
    shifted = equities.publish_next_day(seen, prices.select("trading_day")).orderBy("source_day").collect()
    assert [r["available_day"] for r in shifted] == [date(2020, 1, 2), date(2020, 1, 3)]


# --- coarse bars ---------------------------------------------------------------------------------


def five_minutes(spark, count=24, start=datetime(2020, 1, 3, 9, 5), day=lambda t: t.date()):
    rows = []
    for i in range(count):
        t = start + timedelta(minutes=5 * i)
        rows.append(("X", "A", t, day(t), 5, True, True, 1, float(i), float(i + 1), float(i - 1), float(i) + 0.5, 1.0))
    return spark.createDataFrame(
        rows,
        "exchange string, instrument_id string, timestamp timestamp, trading_day date, bar_interval_minutes int, eligible boolean, valid_bar boolean, segment_id long, open double, high double, low double, close double, volume double",
    )


def test_coarse_bars_are_published_only_when_complete(spark):
    df = five_minutes(spark)
    panel = Panel(df, market.panel_spec(df.columns))
    close = fx.field("close")
    features = {"c": coarse.at("15m", close), "gap": close - coarse.at("30m", fx.delay(close, 1))}
    rows = coarse.with_mixed_features(panel, features).orderBy("timestamp").collect()
    # Buckets end at 9:15, 9:30, ...; each value appears first on the row that completes it.
    assert [r["c"] for r in rows[:6]] == [None, None, 2.5, 2.5, 2.5, 5.5]
    assert rows[10]["gap"] is None and rows[11]["gap"] == pytest.approx(11.5 - 5.5)
    early = coarse.with_mixed_features(panel.with_df(df.where("timestamp <= '2020-01-03 10:00:00'")), features)
    assert [r["c"] for r in early.orderBy("timestamp").collect()] == [r["c"] for r in rows[:12]]


def test_invalid_bars_publish_null_over_older_values(spark):
    df = five_minutes(spark).withColumn("close", F.when(F.col("open") != 4, F.col("close")))
    panel = Panel(df, market.panel_spec(df.columns))
    rows = coarse.with_mixed_features(panel, {"c": coarse.at("15m", fx.field("close"))}).orderBy("timestamp").collect()
    assert rows[2]["c"] == 2.5 and rows[5]["c"] is None and rows[8]["c"] == 8.5


def test_daily_bars_wait_for_the_next_day(spark):
    # The night session of Friday belongs to Monday.
    def day(t):
        return date(2020, 1, 6) if t >= datetime(2020, 1, 3, 21) else date(2020, 1, 3)

    df = five_minutes(spark, 4).union(five_minutes(spark, 4, datetime(2020, 1, 3, 21, 5), day))
    spec = market.panel_spec(df.columns)
    out = coarse.coarse_bars(df, ["close", "volume"], "1d", spec).collect()
    assert len(out) == 1 and out[0]["timestamp"] == datetime(2020, 1, 3, 21, 5)
    assert out[0]["close"] == 3.5 and out[0]["volume"] == 4.0


def test_coarse_inputs_are_checked(spark):
    df = five_minutes(spark, 6)
    spec = market.panel_spec(df.columns)
    coarse.check_base(df, spec)
    moved = df.withColumn("trading_day", F.when(F.col("open") != 3, F.col("trading_day")).otherwise(F.lit(date(2020, 1, 1))))
    with pytest.raises(ValueError, match="backward"):
        coarse.check_base(moved, spec)
    hourly = df.withColumn("bar_interval_minutes", F.lit(60))
    with pytest.raises(ValueError, match="5-minute"):
        coarse.with_mixed_features(Panel(hourly, spec), {"c": coarse.at("30m", fx.field("close"))})


def test_bucket_ends_follow_the_session_zone(spark, configured):
    df = spark.createDataFrame([(datetime(2020, 1, 1, 0, 40),)], "t timestamp")
    end = df.select(F.unix_micros(coarse.bucket_end("t", 60)).alias("e")).first()["e"]
    configured(**{"spark.sql.session.timeZone": "Asia/Kolkata"})
    local = df.select(F.unix_micros(coarse.bucket_end("t", 60)).alias("e")).first()["e"]
    assert (end - local) % 3_600_000_000 == 1_800_000_000  # half-hour offset


def test_spans_and_bands():
    close = fx.field("close")
    assert coarse.feature_span_minutes(fx.change(close, 12), "5m") == 60
    assert coarse.feature_span_minutes(coarse.at("30m", fx.ts_mean(close, 4)), "5m") == 115
    assert coarse.scale_band(60) == "up_to_1h" and coarse.scale_band(61) == "1h_to_1d"
    assert coarse.scale_band(5000, coarse.LONG_SCALE_BANDS) == "over_20d"
    with pytest.raises(ValueError):
        coarse.at("7m", close)
    with pytest.raises(ValueError):
        coarse.at("30m", fx.field("unknown"))


def test_months_keep_gaps_and_coverage(spark):
    rows = [("X", "P", date(2020, 1, d), float(d), 0.1) for d in (1, 2, 3)]
    rows += [("X", "P", date(2020, 3, 1), None, 0.1), ("X", "P", date(2020, 3, 2), 5.0, None)]
    df = spark.createDataFrame(rows, "exchange string, product string, trading_day date, v double, r double")
    rules = [
        monthly.Reduction("last", "v", "last"),
        monthly.Reduction("sum", "v", "sum"),
        monthly.Reduction("half", "v", "mean", 0.5),
        monthly.Reduction("grow", "r", "compound", 0.5),
    ]
    out = monthly.calendar_months(df, rules).orderBy("month").collect()
    assert [r["month"] for r in out] == [date(2020, m, 1) for m in (1, 2, 3)]
    assert out[0]["sum"] == 6 and out[0]["grow"] == pytest.approx(1.1**3 - 1)
    assert out[1]["last"] is None and out[1]["half"] is None
    assert out[2]["last"] == 5 and out[2]["sum"] is None and out[2]["half"] == 5
    aligned = monthly.align_monthly(df, spark.createDataFrame(out), ["sum"]).orderBy("trading_day").collect()
    assert [r["sum"] for r in aligned] == [None] * 5  # February is empty, nothing is carried on
    with pytest.raises(ValueError):
        monthly.Reduction("x", "v", "median")


def test_compaction_and_bars_take_as_many_tasks_as_rows_need(spark, configured, tmp_path):
    from factorloom.sources import scan
    from oracle import compare, connect
    from workload import ORACLE, QUERIES
    from workload.base import trade

    folder = "/root/testdata/sf0.001"
    configured(**{"spark.factorloom.partRows": 300})
    assert trade(spark, folder).rdd.getNumPartitions() == 20
    path = str(tmp_path / "bars")
    scan.compact(spark.range(3000).repartition(3), path, ["id"])
    files = spark.read.parquet(path).select("_metadata.file_path").distinct().count()
    assert files == 10 and spark.read.parquet(path).count() == 3000
    ok, text = compare(QUERIES["compact_round_trip"](spark, folder), connect(folder), ORACLE["compact_round_trip"])
    assert ok, text
