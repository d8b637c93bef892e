"""Sources, tiers, dimensions, quality, scalars and ensembles on hand-made rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickwright.functions import scalar as sc
from tickwright.operators import confidence as conf
from tickwright.operators import dims, ensemble as ens, metrics, quality, query, tiers
from tickwright.sources import bars as bar_files
from tickwright.sources import reference_data as refs

BAR = "symbol string, date date, close double, volume double"


def day(i):
    return dt.date(2024, 1, i)


def test_bar_files_of_different_shape(spark, tmp_path):
    us = tmp_path / "past" / "us_stocks" / "individual_files"
    ind = tmp_path / "past" / "ind_stocks" / "individual_files"
    us.mkdir(parents=True)
    ind.mkdir(parents=True)
    (us / "AAA.csv").write_text("Date,Open,High,Low,Close,Volume,Adj Close,Currency\n2024-01-02,1,2,0.5,1.5,10,1.4,USD\n")
    (us / "BAD.csv").write_text("date,open,high,low,close\n2024-01-02,1,2,0.5,1.5\n")
    (ind / "TATA.csv").write_text(
        "volume,close,low,high,open,date,currency\n7,4,3,5,3.5,2024-05-15 00:00:00+05:30,INR\n,n/a,3,5,3.5,2024-05-16 00:00:00+05:30,INR\n"
    )
    rows = {(r["symbol"], r["date"]): r for r in bar_files.read_bars(spark, str(tmp_path)).collect()}
    assert set(rows) == {("AAA", day(2)), ("TATA", dt.date(2024, 5, 15)), ("TATA", dt.date(2024, 5, 16))}
    a, b = rows[("AAA", day(2))], rows[("TATA", dt.date(2024, 5, 15))]
    assert (a["category"], a["tier"], a["adjusted_close"], a["close"]) == ("us_stocks", "past", 1.4, 1.5)
    assert (b["open"], b["close"], b["volume"], b["adjusted_close"]) == (3.5, 4.0, 7.0, None)
    assert rows[("TATA", dt.date(2024, 5, 16))]["close"] is None


def test_instruments_keep_the_last_entry(spark, tmp_path):
    item = lambda x, k, s, i: {"exchange": x, "instrument_type": k, "trading_symbol": s, "isin": i}
    doc = {"data": {"1": item("NSE_EQ", "EQ", "abc", "INE1"), "2": item("NSE_EQ", "EQ", "ABC ", "INE2"), "3": item("BSE", "EQ", "x", "INE3"), "4": item("NSE_EQ", "EQ", "y", "")}}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    assert [tuple(r) for r in refs.read_instruments(spark, str(tmp_path)).collect()] == [("ABC", "INE2")]


def test_overlap_keeps_first_or_last(spark):
    past = spark.createDataFrame([("A", day(1), 1.0, 1.0), ("A", day(2), 2.0, 1.0)], BAR)
    latest = spark.createDataFrame([("A", day(2), 9.0, 1.0), ("A", day(3), None, 1.0)], BAR)
    last = {r["date"]: r["close"] for r in tiers.combine_keep_last(past, latest).collect()}
    first = {r["date"]: r["close"] for r in tiers.combine_keep_first(past, latest).collect()}
    assert last == {day(1): 1.0, day(2): 9.0}
    assert first == {day(1): 1.0, day(2): 2.0, day(3): None}


def test_dimension_symbols_ignore_case(spark):
    schema = "symbol string, company_name string, sector string, market_cap string, headquarters string, exchange string, currency string, isin string, category string"
    dim = spark.createDataFrame([("AAPL", "Apple", "Tech", "", "", "", "USD", "", "us_stocks")], schema)
    new = spark.createDataFrame([("aapl", None, "us_stocks"), ("tcs", None, "ind_stocks"), ("TCS", None, "ind_stocks")], "symbol string, company_name string, category string")
    rows = {r["symbol"]: r for r in dims.dim_insert_if_absent(dim, new).collect()}
    assert set(rows) == {"AAPL", "TCS"}
    assert rows["TCS"]["company_name"] == "TCS" and rows["TCS"]["currency"] == "INR" and rows["TCS"]["sector"] == "N/A"
    assert dims.dim_lookup(new.select("symbol"), dim.drop("category")).where("company_name = 'Apple'").count() == 1


def test_shrinking_dimension_is_refused(spark):
    df = spark.range(3).toDF("x")
    assert dims.dim_guard_no_shrink(df, df.limit(2)).first()["ok"] is False


@pytest.mark.parametrize("jump, ok", [(5.9, True), (7.0, False)])
def test_quality_move_limit(bars, jump, ok):
    closes = [10.0] * 260
    closes[100:] = [10.0 * jump] * 160
    assert quality.quality_report(bars({"A": closes})).first()["moves_ok"] is ok


def test_gap_is_only_a_warning(bars):
    df = bars({"A": [10.0 + i % 3 for i in range(300)]}).where(~F.col("date").between(dt.date(2020, 3, 1), dt.date(2020, 3, 8)))
    row = quality.quality_report(df).first()
    assert row["gap_warning"] and row["passed"]


def test_scalars(spark):
    row = spark.range(1).select(
        sc.bar_date(F.lit("2024-05-15 00:00:00+05:30")).alias("d"),
        sc.horizon_days(F.lit("1w")).alias("w"),
        sc.horizon_days(F.lit("2D")).alias("u"),
        sc.format_price_grouped(F.lit(12345678.5)).alias("lakh"),
        sc.format_price(F.lit(None).cast("double"), F.lit("INR")).alias("none"),
        sc.valid_date_string(F.lit("2023-02-30")).alias("bad"),
        sc.categorize_simple(F.lit("123")).alias("digits"),
        sc.clean_metadata(F.lit(" NaN ")).alias("meta"),
    ).first()
    assert row["d"] == dt.date(2024, 5, 15) and row["w"] == 7 and row["u"] == 1
    assert row["lakh"] == "₹1,23,45,678.50" and row["none"] == "₹0.00"
    assert row["bad"] is False and row["digits"] == "us_stocks" and row["meta"] == "N/A"
    with pytest.raises(Exception):
        spark.range(1).select(sc.horizon_days(F.lit("2D"), strict=True)).collect()


def test_search_is_literal_and_blank_is_empty(spark):
    dim = spark.createDataFrame([("A.B", "x", "us_stocks"), ("AXB", "y", "ind_stocks")], "symbol string, company_name string, category string")
    assert [r["symbol"] for r in query.search(dim, "a.b").collect()] == ["A.B"]
    assert query.search(dim, "a.b", regex=True).count() == 2
    assert query.search(dim, "  ").count() == 0
    assert {r["symbol"] for r in query.search_with_fallback(dim, "apple").collect()} == {"AAPL"}


def test_metric_vector(spark):
    df = spark.createDataFrame([(float(y), float(y + 5)) for y in (100, 110, 120, 130, 140)], "y double, p double")
    row = metrics.regression_metrics(df.withColumn("g", F.lit(1)), ["g"]).first()
    assert row["mae"] == 5.0 and row["rmse"] == 5.0


def test_inverse_rmse_vector(spark):
    df = spark.createDataFrame([("s", "a", 98.0, 0.1), ("s", "b", 102.0, 0.2)], "symbol string, model string, price double, rmse double")
    w = ens.inverse_rmse_weights(df, ["symbol"])
    got = {r["model"]: round(r["weight"], 9) for r in w.collect()}
    assert got == {"a": round(2 / 3, 9), "b": round(1 / 3, 9)}
    r = ens.price_range(w, ["symbol"]).first()
    assert r["range_low"] < 100.0 < r["range_high"]
    assert 0 <= ens.variance_confidence(w, ["symbol"]).first()["confidence"] <= 100


def test_single_model_and_zero_weights(spark):
    one = spark.createDataFrame([("s", "knn", 100.0, 0.5)], "symbol string, model string, price double, accuracy double")
    assert ens.ensemble_fixed(one, ["symbol"]).first()["ensemble_price"] == 100.0
    r = ens.confidence_interval(one, ["symbol"]).first()
    assert (round(r["confidence_low"], 9), round(r["confidence_high"], 9)) == (90.0, 110.0)
    assert one.groupBy("symbol").agg(conf.agreement().alias("a")).first()["a"] == 70.0


def test_horizon_scores(spark):
    df = spark.createDataFrame([(1,), (7,), (30,), (365,), (1825,)], "d int")
    got = [round(r[0], 9) for r in df.orderBy("d").select(conf.time_decay_score("d")).collect()]
    assert got == [100.0, 90.0, 80.0, 65.0, 45.0]


def test_bar_files_with_quotes_and_repeats(spark, tmp_path):
    from tickwright.sources.bars import read_bars

    folder = tmp_path / "past" / "us_stocks" / "individual_files"
    folder.mkdir(parents=True)
    (folder / "AAA.csv").write_text(
        'Date,Open,High,Low,Close,Volume,Note\n2020-01-01,1,2,0.5,1.5,"1,000","a, b"\n2020-01-02,1,2,0.5,1.5,10,"said ""hi"""\n2020-01-02,3,4,2.5,3.5,20,\n'
    )
    (folder / "BBB.csv").write_text('close,open,low,high,volume,date\n5,4,3,6,7,2020-01-01\n')
    (folder / "CCC.csv").write_text("date,price\n2020-01-01,5\n")
    got = sorted((r["symbol"], str(r["date"]), r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in read_bars(spark, str(tmp_path)).collect())
    assert got == [
        ("AAA", "2020-01-01", 1.0, 2.0, 0.5, 1.5, 1000.0),
        ("AAA", "2020-01-02", 3.0, 4.0, 2.5, 3.5, 20.0),
        ("BBB", "2020-01-01", 4.0, 6.0, 3.0, 5.0, 7.0),
    ]
    (folder / "DDD.csv").write_text('date,open,high,low,close,volume,note\n2020-01-01,1,2,3,4,5,"two\nlines"\n')
    with pytest.raises(ValueError):
        read_bars(spark, str(tmp_path))
    assert read_bars(spark, str(folder / "CCC.csv")).count() == 0


def test_predictions_replace_symbols_only(spark, tmp_path):
    from tickwright.sources import predictions as pred

    path = str(tmp_path / "predictions")

    def rows(*items):
        return spark.createDataFrame([(s, c, "1D", p) for s, c, p in items], "symbol bigint, category string, horizon string, predicted_price double")

    def held():
        return sorted((r["symbol"], r["category"], r["predicted_price"]) for r in pred.read_predictions(spark, path).collect())

    pred.write_predictions(rows((1, "us", 1.0), (2, "us", 2.0), (3, "in", 3.0)), path)
    pred.write_predictions(rows((1, "us", 9.0)), path)
    assert held() == [(1, "us", 9.0), (2, "us", 2.0), (3, "in", 3.0)]
    assert pred.read_predictions(spark, path, 2, "us").count() == 1
    pred.delete_stored_predictions(spark, path, rows((3, "in", 0.0), (77, "in", 0.0)))
    assert held() == [(1, "us", 9.0), (2, "us", 2.0)]


def test_prices_of_any_size_make_bars(spark):
    from tickwright.sources.tables import to_bars

    ticks = [(1, 10, 2, 400_000, 1.0), (1, 10, 9, 500_000, 1.0), (1, 11, 1, 99_999_999_999, 1.0), (1, 9, 12, 777, 1.0)]
    df = spark.createDataFrame(ticks, "symbol int, l_orderkey bigint, l_linenumber int, cents bigint, l_quantity double").selectExpr("*", "DATE '2020-01-01' AS date")
    bar = to_bars(df).first()
    assert (bar["open"], bar["high"], bar["low"], bar["close"], bar["volume"]) == (7.77, 999_999_999.99, 7.77, 999_999_999.99, 4.0)


def test_first_quote_of_a_day_stays(spark, tmp_path):
    """Three batches; the last repeats a key of the first, arrives a month late for another."""
    import time

    from tickwright.streaming import quotes as qs

    def file(name, *rows):
        data = [(i, dt.datetime(2020, m, d, h), u, "buy", p, None) for i, m, d, h, u, p in rows]
        spark.createDataFrame(data, qs.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)

    file("a", (1, 3, 1, 9, 7, 10.0), (2, 3, 1, 8, 7, 11.0))
    file("b", (3, 3, 1, 7, 7, 99.0), (4, 3, 2, 9, 7, 12.0))
    file("c", (5, 1, 2, 9, 8, 50.0), (6, 3, 2, 1, 7, 98.0))
    log = str(tmp_path / "log")
    qs.insert_once(qs.read_quote_stream(spark, str(tmp_path / "in"), files_per_batch=1), log, str(tmp_path / "checkpoint"))
    got = sorted((r["symbol"], str(r["day"]), r["price"]) for r in spark.read.parquet(log).collect())
    assert got == [(7, "2020-03-01", 11.0), (7, "2020-03-02", 12.0), (8, "2020-01-02", 50.0)]


def quote_files(spark, folder, *batches):
    """One file for each batch of (id, day of March 2020, hour, symbol, price), oldest first."""
    import time

    from tickwright.streaming import quotes as qs

    for rows in batches:
        data = [(i, dt.datetime(2020, 3, 1, h) + dt.timedelta(days=d - 1), u, "buy", p, None) for i, d, h, u, p in rows]
        spark.createDataFrame(data, qs.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return qs.read_quote_stream(spark, folder, files_per_batch=1)


def test_late_quotes_are_kept_and_counted(spark, tmp_path):
    from tickwright.streaming import quotes as qs

    first = [(1, 10, 9, 7, 10.0), (2, 10, 12, 7, 12.0), (3, 10, 10, 8, 5.0)]
    second = [(4, 8, 9, 7, 99.0), (5, 9, 13, 7, 11.0), (6, 10, 8, 7, 9.0), (7, 9, 12, 8, 4.0)]  # 4 is two days late, 7 just in time
    stream = quote_files(spark, str(tmp_path / "in"), first, second)
    log, late = str(tmp_path / "log"), str(tmp_path / "late")
    qs.split_bars(stream, log, late, str(tmp_path / "checkpoint"))
    bars = sorted((r["symbol"], str(r["date"]), r["open"], r["high"], r["low"], r["close"], r["ticks"]) for r in qs.bars_of(spark.read.parquet(log)).collect())
    assert bars == [(7, "2020-03-09", 11.0, 11.0, 11.0, 11.0, 1), (7, "2020-03-10", 9.0, 12.0, 9.0, 12.0, 3), (8, "2020-03-09", 4.0, 4.0, 4.0, 4.0, 1), (8, "2020-03-10", 5.0, 5.0, 5.0, 5.0, 1)]
    kept = spark.read.parquet(late)
    assert [(r["quote_id"], r["price"]) for r in kept.collect()] == [(4, 99.0)]
    assert [(r["symbol"], str(r["date"]), r["late_quotes"]) for r in qs.late_counts(kept).collect()] == [(7, "2020-03-08", 1)]


def test_timers_raise_the_stale_flag(spark, tmp_path):
    """Symbol 8 goes quiet; the quotes of 7 move event time beyond its time to live."""
    from tickwright.streaming import quotes as qs

    stream = quote_files(spark, str(tmp_path / "in"), [(1, 10, 9, 7, 1.0), (2, 10, 9, 8, 2.0)], [(3, 10, 11, 7, 3.0), (4, 10, 8, 7, 9.0)], [(5, 10, 14, 7, 4.0)])
    flagged = qs.stale_events(stream, 3600, "1 minute")
    qs.run_to_log(flagged, str(tmp_path / "log"), str(tmp_path / "checkpoint"))
    rows = [(r["symbol"], r["quote_id"], r["stale"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()]
    assert (8, 2, False) in rows and (8, 2, True) in rows and rows.count((8, 2, True)) == 1
    now = {r["symbol"]: (r["quote_id"], r["stale"]) for r in qs.current(spark, str(tmp_path / "log"), ["symbol"], flagged.schema).collect()}
    assert now == {7: (5, False), 8: (2, True)}


def test_arrivals_keep_their_partitions(spark, small, tmp_path):
    """Events of four files arrive as four files for each half, and give the same rows."""
    from pathlib import Path

    import __spark_entry__ as entry
    from tickwright.session import run_folder

    query = entry.queries()["stream_insert_once"]
    spark.read.parquet(f"{small}/events.parquet").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    folder = Path(run_folder(spark).removeprefix("file://"))
    before = set(folder.glob("arrivals-*"))
    got = sorted(query(spark, str(tmp_path)).collect())
    new = (set(folder.glob("arrivals-*")) - before).pop()
    assert [len(list((new / str(k)).glob("*.parquet"))) for k in (0, 1)] == [4, 4]
    assert got == sorted(query(spark, small).collect())
