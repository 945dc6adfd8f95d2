"""What an upsert and a refill leave on disk: no second copy of the bars, no shuffle files; batches change nothing."""

import datetime
import glob
import time

import pytest
from pyspark.sql import functions as F

from barlab.operators import market as M
from barlab.operators import tables as T

COLUMNS = "timeframe string, date timestamp_ntz, stock_code string, open double, high double, low double, close double, volume double, amount double"
SYMBOLS = [f"{600000 + i}.SH" for i in range(20)]


def bars(spark, symbols, days, timeframe="1d", close=10.0):
    rows = [(timeframe, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), s, close, close, close, close, 1.0, 1.0) for s in symbols for i in days]
    return spark.createDataFrame(rows, COLUMNS)


def stored(spark):
    return set(glob.glob(f"{T.shared_folder(spark).removeprefix('file:')}/barlab-*"))


@pytest.mark.parametrize("mode", ["smart", "force"])
def test_a_refill_from_a_stored_table_stores_its_plan_only(spark, tmp_path, mode):
    folder = str(tmp_path / "m")
    M.write_market(bars(spark, SYMBOLS[:15], range(9)), folder, shards=4)
    staged = T.written(bars(spark, SYMBOLS, range(12), close=20.0))
    audit = T.written(spark.createDataFrame([(s, "1d", "ok" if i < 10 else "missing_file", 1.0) for i, s in enumerate(SYMBOLS)], "stock_code string, timeframe string, status string, coverage_ratio double"))
    before = stored(spark)
    M.refill(spark, folder, staged, audit, 0.5, mode, shards=4)
    assert len(stored(spark) - before) == 1
    got = {r.stock_code: (r.n, r.p) for r in M.read_market(spark, folder).groupBy("stock_code").agg(F.count("*").alias("n"), F.max("close").alias("p")).collect()}
    assert got == {s: (12, 20.0) if mode == "force" or i >= 10 else (9, 10.0) for i, s in enumerate(SYMBOLS)}


def test_batches_give_the_same_table_and_equal_counts_are_compared(spark, tmp_path):
    old = bars(spark, SYMBOLS, range(8)).unionByName(bars(spark, SYMBOLS[:10], range(5), "60m"))
    new = bars(spark, SYMBOLS[3:9], range(2, 8), close=11.0).unionByName(bars(spark, SYMBOLS[8:14], range(4), "60m")).unionByName(bars(spark, SYMBOLS[17:18], range(8)))
    tables = []
    for most in (10**9, 50, 1):
        folder = str(tmp_path / f"m{most}")
        M.write_market(old, folder, shards=4)
        touched = M.upsert(spark, folder, new, shards=4, most_rows=most)
        tables.append((sorted(touched), sorted(M.read_market(spark, folder).collect())))
        assert M.upsert(spark, folder, new, shards=4, most_rows=most) == []
    assert tables[0] == tables[1] == tables[2] and len(tables[0][1]) == 20 * 8 + 10 * 5 + 4 * 4
    assert sum(r.close == 11.0 for r in tables[0][1]) == 6 * 6


def test_batches_are_bounded():
    parts = {("1d", i): n for i, n in enumerate([5, 5, 5, 30, 2, 2])}
    assert [[p[1] for p in b] for b in M._batches(parts, 10)] == [[0, 1], [2], [3], [4, 5]] and M._batches({}, 10) == []


def test_written_leaves_no_shuffle_files(spark):
    files = lambda: {f for d in glob.glob("/tmp/blockmgr-*") for f in glob.glob(f"{d}/*/shuffle_*.data")}
    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    was = spark.conf.get(name)
    df = T.written(spark.range(20000).repartition(7, "id").groupBy((F.col("id") % 50).alias("k")).count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and df.count() == 50 and spark.conf.get(name) == was
