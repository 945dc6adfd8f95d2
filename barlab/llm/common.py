"""What the corpus operators share: table access, scratch tables and text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as the word pattern ``[^\x20\x09-\x0D]+`` has it. ``bytes.split()`` splits at the same six.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary one if Spark runs in one JVM (as in tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barlab-"))
            kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = kept.get()
    return f"{base}/barlab-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{scratch(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as Spark takes it whatever it holds, dots and back-quotes too."""
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def literal(one_row: DataFrame) -> Column:
    """The only value of a one-row table as a literal, by way of a small file: it is evaluated once, tasks
    get its compact bytes, and the optimizer doesn't compare its contents over and over. Spark wants such
    a column selected by itself before a higher-order function uses it."""
    return stored(one_row).scalar()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary(column: pa.Array) -> pa.Array:
    """A string column's UTF-8 bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("").cast(pa.large_binary())


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows."""
    a = binary(column)
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text, one row at least, to bound what a task holds."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = flat(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def conf_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch, set in the session: with long texts the default of 10,000 rows holds too much
    memory. Spark bounds a batch's bytes by itself (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def small_side(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A stored table of narrow rows, with a broadcast hint only if it is counted to have at most
    `most_rows` rows (some MB); beyond that the join shuffles both sides."""
    return F.broadcast(df) if df.count() <= most_rows else df


def hot_join(left: DataFrame, right: DataFrame, on: list[str], total: int, most: int = 10_000) -> DataFrame:
    """left joined with right, which has each key once and its number n of left's `total` rows; drops n.

    Keys with more than total / most rows are at most `most`, so these are broadcast and left's rows of them stay
    where they are; all others, none of which is large, shuffle."""
    hot = F.col("n") * most > total
    many, few = F.broadcast(right.where(hot).drop("n")), right.where(~hot).drop("n")
    return left.join(many, on).unionByName(left.join(F.broadcast(many.select(*on)), on, "left_anti").join(few, on))
