"""The market table on disk: pruned reads, upserts of touched partitions only, bounded lookback."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from barlab.operators import market as M

COLUMNS = "timeframe string, date timestamp_ntz, stock_code string, open double, high double, low double, close double, volume double, amount double"
DAY = datetime.datetime(2024, 1, 1)


def bars(spark, symbols, days, timeframe="1d", close=10.0):
    rows = [(timeframe, DAY + datetime.timedelta(days=i), s, close, close, close, close, 1.0, 1.0) for s in symbols for i in days]
    return spark.createDataFrame(rows, COLUMNS)


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


SYMBOLS = [f"{600000 + i}.SH" for i in range(30)]


def test_reads_list_only_their_partitions(spark, tmp_path):
    folder = str(tmp_path / "m")
    M.write_market(bars(spark, SYMBOLS, range(5)).unionByName(bars(spark, SYMBOLS, range(9), "60m")), folder, shards=8)
    wanted = spark.createDataFrame([(SYMBOLS[0],), (SYMBOLS[1],)], "stock_code string")
    got = M.load(M.read_market(spark, folder), "60m", wanted, "2024-01-02", "2024-01-04", shards=8)
    assert got.count() == 6 and set(got.columns) == set(M.B.COLUMNS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    part = plan.split("PartitionFilters:")[1].split("]")[0]
    assert "timeframe" in part and "shard" in part and "PushedFilters: [" in plan and "date" in plan.split("PushedFilters:")[1].split("]")[0]


def test_upsert_rewrites_touched_partitions_and_repeats_do_nothing(spark, tmp_path):
    folder = str(tmp_path / "m")
    M.write_market(bars(spark, SYMBOLS, range(5)), folder, shards=8)
    before = files(folder)
    new = bars(spark, SYMBOLS[:1], range(3, 8), close=20.0)
    touched = M.upsert(spark, folder, new, shards=8)
    after = files(folder)
    assert len(touched) == 1 and {f for f in before if f in after and before[f] == after[f]} == {f for f in before if f"shard={touched[0][1]}/" not in f}
    rows = M.read_market(spark, folder)
    assert rows.count() == 30 * 5 + 3 and rows.where("close = 20").count() == 5 and rows.groupBy("stock_code", "date").count().where("count > 1").count() == 0
    assert M.upsert(spark, folder, new, shards=8) == [] and files(folder) == after
    assert M.upsert(spark, folder, new.limit(0), shards=8) == []
    assert M.upsert(spark, folder, bars(spark, ["000001.SZ"], range(2), "5m"), shards=8) and M.read_market(spark, folder).where("timeframe = '5m'").count() == 2


def test_refill_takes_failing_keys_only(spark, tmp_path):
    folder = str(tmp_path / "m")
    M.write_market(bars(spark, SYMBOLS[:4], range(5)), folder, shards=8)
    audit = spark.createDataFrame([(s, "1d", "missing_file" if s == SYMBOLS[2] else "ok", 1.0) for s in SYMBOLS[:4]], "stock_code string, timeframe string, status string, coverage_ratio double")
    staged = bars(spark, SYMBOLS[:4], range(7), close=30.0)
    plan = {r.stock_code: r.action for r in M.refill(spark, folder, staged, audit, 0.5, shards=8).collect()}
    rows = M.read_market(spark, folder)
    assert plan[SYMBOLS[2]] == "fetch" and {r.stock_code for r in rows.where("close = 30").select("stock_code").distinct().collect()} == {SYMBOLS[2]}
    M.refill(spark, folder, staged, audit, 0.5, "force", shards=8)
    assert M.read_market(spark, folder).where("close = 30").count() == 28


def test_lookback_bounds_daily_bars(spark, tmp_path):
    folder = str(tmp_path / "m")
    day = bars(spark, SYMBOLS[:2], range(40))
    M.write_market(day.withColumn("close", F.when(F.dayofmonth("date") == 20, 10.0).otherwise(F.col("close"))), folder, shards=8)
    wanted = spark.createDataFrame([(SYMBOLS[0],)], "stock_code string")
    data = M.load_backtest(M.read_market(spark, folder), ["1d"], wanted, "2024-01-21", "2024-01-25", daily_lookback_days=3, shards=8)
    assert data.daily.agg(F.min("date")).first()[0] == datetime.datetime(2024, 1, 18) and data.bars.count() == 5
    with pytest.raises(ValueError):
        M.load_backtest(M.read_market(spark, folder), ["1d"], wanted, "2024-01-21", "2024-01-25", daily_lookback_days=0, shards=8)
    with pytest.raises(ValueError):
        M.load_backtest(M.read_market(spark, folder), ["1d"], wanted, "2024-01-21", "2024-01-25", min_coverage=1.5, shards=8).bars.count()
