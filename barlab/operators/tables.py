"""Tables of a run in the shared folder: checkpoints, named result tables and their index, case configurations."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one if Spark runs in one JVM, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barlab-"))
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    return kept.get()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query that is planned here go when it ends; else they stay until the driver's JVM
    happens to collect its plan, and the shuffles of many steps lie on the disks together."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/barlab-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a result table is for, and how early to read it.
CATEGORIES = {
    "stats": ("summary", 1), "diagnostics": ("summary", 1), "trades": ("trades", 2), "order_decisions": ("decisions", 2), "filter_decisions": ("decisions", 3), "equity_curve": ("equity", 2), "drawdown_episodes": ("equity", 3),
    "period_returns": ("equity", 3), "monthly_returns": ("equity", 3), "data_inventory": ("data", 4), "data_coverage": ("data", 4), "data_gap_episodes": ("data", 4), "limit_filter_audit": ("data", 4),
    **{f"{n}_stats": ("breakdown", 3) for n in ("strategy", "detector", "setup", "side", "event_type", "exit_reason", "symbol", "signal_lifecycle")}, "trade_path_distribution": ("breakdown", 3),
    **{n: ("decisions", 3) for n in ("order_decision_stats", "setup_order_decision_stats", "strategy_filter_stats", "setup_filter_stats")},
}


def save_tables(tables: Mapping[str, DataFrame], folder: str, partition_by: str | None = None) -> DataFrame:
    """Writes each table as Parquet under its name, and an index of them; returns the index (table, category, priority, rows)."""
    index = None
    for name, df in tables.items():
        (df.write.mode("overwrite").partitionBy(partition_by) if partition_by else df.write.mode("overwrite")).parquet(f"{folder}/{name}")
        category, priority = CATEGORIES.get(name, ("other", 9))
        rows = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}").agg(F.lit(name).alias("table"), F.lit(category).alias("category"), F.lit(priority).alias("priority"), F.count("*").alias("rows"))
        index = rows if index is None else index.unionByName(rows)
    index.coalesce(1).write.mode("overwrite").parquet(f"{folder}/artifact_index")
    return index.sparkSession.read.parquet(f"{folder}/artifact_index")


def artifact_index(index: DataFrame, category: str = "", max_priority: int | None = None) -> DataFrame:
    """The tables of a run by category (if given) and priority."""
    kept = index if not category else index.where(F.col("category") == category)
    kept = kept if max_priority is None else kept.where(F.col("priority") <= max_priority)
    return kept.orderBy("priority", "table")


# Fields that name a run but don't shape it, and the fields that only one detector reads.
NAMING_FIELDS = ("name", "output_dir", "data_root")
DETECTOR_FIELDS = {"trend": ("trend_lookback", "trend_score"), "range": ("range_lookback", "range_score"), "channel": ("channel_lookback",), "reversal": ("reversal_lookback",)}


def case_config_hash(cases: DataFrame, detector: str = "detector") -> Column:
    """SHA-256 of a case's fields in order of name, less names and the fields of detectors that it doesn't use."""
    inactive = {f: d for d, fields in DETECTOR_FIELDS.items() for f in fields}
    fields = []
    for c in sorted(set(cases.columns) - set(NAMING_FIELDS) - {"case_config_hash", "case_name"}):
        value = F.to_json(F.struct(F.col(c).alias(c)))
        fields.append(F.when(F.col(detector) == inactive[c], value) if c in inactive and detector in cases.columns else value)
    return F.sha2(F.array_join(F.array_compact(F.array(*fields)), ","), 256)


def write_cases(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").json(path)


def load_case(spark: SparkSession, path: str, schema: str, case_config_hash: str = "", case_name: str = "") -> DataFrame:
    """The one case of that hash and/or name; raises unless it is exactly one."""
    rows = spark.read.schema(schema).json(path)
    rows = rows.where(F.col("case_config_hash") == case_config_hash) if case_config_hash else rows
    rows = rows.where(F.col("case_name") == case_name) if case_name else rows
    if (n := rows.limit(2).count()) != 1:
        raise ValueError(f"{'no' if not n else 'more than one'} case has hash {case_config_hash!r} and name {case_name!r}")
    return rows


def value_label(value: Column) -> Column:
    """A parameter's value as text; null and non-finite: ''."""
    text = value.cast("string")
    return F.when(value.isNull() | text.isin("NaN", "Infinity", "-Infinity"), "").otherwise(text)
