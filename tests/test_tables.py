"""Gates and run tables that raise or write."""

import uuid

import pytest
from pyspark.sql import functions as F

from barlab.operators import catalog as K
from barlab.operators import tables as T

BARS = "stock_code string, timeframe string, date timestamp_ntz, open double, high double, low double, close double, volume double, amount double"


def market(spark):
    from datetime import datetime

    day = lambda i: datetime(2024, 1, i)
    rows = [("000001.SZ", "1d", day(i), 10.0, 11.0, 9.0, 10.5, 5.0, 50.0) for i in range(1, 9)]
    rows += [("000002.SZ", "1d", day(i), 10.0, 9.0, 9.5, 10.5, 5.0, 50.0) for i in (1, 2)]
    return spark.createDataFrame(rows, BARS)


def test_gate_names_what_fails(spark):
    m = market(spark)
    with pytest.raises(ValueError, match="000002.SZ/1d=quality_error"):
        K.load_backtest_data(m, ["1d"], m.select("stock_code"))
    good = m.where("stock_code = '000001.SZ'")
    assert K.load_backtest_data(good, ["1d"], good.select("stock_code")).bars.count() == 8
    with pytest.raises(ValueError, match="must differ"):
        K.load_experiment(m, "1d", "1d", m.select("stock_code"))
    with pytest.raises(ValueError, match="lacks a code or name"):
        K.symbol_metadata([spark.createDataFrame([("a",)], "other string")])


def test_one_case_is_loaded_by_hash_or_name(spark):
    path = f"{T.shared_folder(spark)}/cases-{uuid.uuid4().hex}"
    cases = spark.createDataFrame([("a", "trend", 5, 2), ("b", "trend", 9, 2), ("c", "range", 5, 3)], "case_name string, detector string, range_lookback int, trend_lookback int")
    hashed = cases.withColumn("case_config_hash", T.case_config_hash(cases))
    by = {r.case_name: r.case_config_hash for r in hashed.collect()}
    assert by["a"] == by["b"] != by["c"]  # range_lookback is no part of a trend case
    T.write_cases(hashed, path)
    schema = "case_name string, case_config_hash string, trend_lookback int"
    assert T.load_case(spark, path, schema, by["c"]).first().case_name == "c"
    assert T.load_case(spark, path, schema, by["a"], "b").first().case_name == "b"
    for wanted in ((by["a"], ""), ("", "none")):
        with pytest.raises(ValueError, match="case"):
            T.load_case(spark, path, schema, *wanted)


def test_tables_are_written_with_an_index(spark):
    folder = f"{T.shared_folder(spark)}/run-{uuid.uuid4().hex}"
    index = T.save_tables({"trades": market(spark), "own": market(spark).limit(0)}, folder, partition_by="stock_code")
    assert {(r.table, r.category, r.rows) for r in index.collect()} == {("trades", "trades", 10), ("own", "other", 0)}
    assert spark.read.parquet(f"{folder}/trades").where(F.col("stock_code") == "000002.SZ").count() == 2
    assert [r.table for r in T.artifact_index(index, max_priority=2).collect()] == ["trades"]
