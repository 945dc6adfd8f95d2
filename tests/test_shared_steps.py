import re

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.operators import audit as A
from barlab.operators import detectors as D
from barlab.operators import ranks


def plan(spark, df):
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_counters_are_not_kept_for_each_date(spark):
    bars = spark.sql("SELECT '000001.SZ' AS stock_code, timestamp_ntz '2020-01-01' + make_dt_interval(cast(id % 3 AS int)) AS date, 1D AS open, 1D AS high, 1D AS low, 1D AS close, 0D AS volume, 1D AS amount FROM range(4)")
    a = A.audit_bars(bars.unionByName(bars.withColumn("stock_code", F.lit("")).limit(1)))
    assert not [line for line in plan(spark, a).splitlines() if re.search(r"Aggregate\(keys=\[[^\]]*date[^\]]*\], functions=\[[^\]]", line)]
    got = {r.stock_code: r for r in a.collect()}
    assert (got["000001.SZ"].row_count, got["000001.SZ"].duplicate_count, got["000001.SZ"].zero_volume_count, got["000001.SZ"].invalid_symbol_count) == (4, 1, 4, 0)
    assert (got[""].invalid_symbol_count, got[""].status) == (1, "quality_error")


def test_small_keys_are_numbered_without_ranges(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 3), ("a", 1), (None, 2), ("b", 5), (None, 1)], "k string, x int")
    ranged = {tuple(r) for r in ranks.ordinals(rows, ["k"], ["x"], block=1).collect()}
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda *_: pytest.fail("dealt by range"))
    assert {tuple(r) for r in ranks.ordinals(rows, ["k"], ["x"]).collect()} == ranged == {("a", 1, 0, 2), ("a", 3, 1, 2), (None, 1, 0, 2), (None, 2, 1, 2), ("b", 5, 0, 1)}


def test_both_ways_of_coverage_agree(spark):
    points = [("a", 1), ("a", 4), ("a", 7), ("a", 7), ("b", 3), ("c", 1), ("c", 2), ("c", 9), ("d", None)]
    actual = spark.createDataFrame(points, "stock_code string, n int").selectExpr("stock_code", "timestamp_ntz '2020-01-01' + make_dt_interval(n) AS at")
    days = A.calendar(spark.sql("SELECT timestamp_ntz '2020-01-01' + make_dt_interval(cast(id AS int)) AS at FROM range(1, 10)"))
    kept = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert kept(A.coverage(actual, days)) == kept(A.coverage(actual, days, block=1))
    assert kept(A.gap_episodes(actual, days)) == kept(A.gap_episodes(actual, days, block=1))
    a = A.coverage(actual, days).where("stock_code = 'a'").first()
    assert (a.expected_count, a.actual_count, a.max_gap, a.max_gap_start.day, a.max_gap_end.day, a.gap_count, a.first_missing.day, a.last_missing.day) == (9, 3, 2, 3, 4, 3, 3, 10)


def test_trend_detection_shares_windows_and_shuffles(spark):
    bars = spark.sql("SELECT concat(id % 2, '.SZ') AS stock_code, timestamp_ntz '2020-01-01' + make_dt_interval(cast(id AS int)) AS date, 1D + id % 5 AS open, 9D AS high, 1D AS low, 1D + id % 7 AS close, 1D AS volume, 1D AS amount, cast(id AS int) AS bar_index FROM range(60)")
    text = plan(spark, D.detect_trend(bars))
    assert "hashpartitioning(stock_code" in text and not re.search(r"hashpartitioning\(stock_code#\d+, _block", text)
    assert len(re.findall(r"regr_slope\(.*sum\(_st", text)) == 1  # one window has both the slope and the score; two had them before
