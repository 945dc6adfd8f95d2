"""Corpus pipeline over ``documents``: toxicity, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what it returns is
written as Parquet and read again. All but the last return the columns of docs. Toxic documents go
(score of 0.7 or more; labels are read only to fit the scorer), repeated lines go, one document of each
near-duplicate group (SimHash of five-word shingles, completed to similarity 0.8 or more) stays (the smallest doc_id), documents that hold a benchmark item go, and the last
stage gives the token digests of what is left. Null and empty texts pass through; rows without doc_id
are filtered like any other, but hold no benchmark item and lose no lines. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm import decontaminate, line_dedup, near_dedup, queries, toxicity
from barlab.llm.common import quoted, read, small_side, stored

TOXIC = 0.7
_SCORE = "barlab toxicity"


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sample = toxicity.labelled(docs, read(spark, sf_dir, "labels"), "toxic", queries.fold(3) != 1, most=6000)
    return toxicity.score(docs, toxicity.fit(sample), docs.columns, _SCORE).where(F.col(_SCORE) < TOXIC).drop(_SCORE)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(docs, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = stored(decontaminate.leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(small_side(held), "doc_id", "left_anti").select(*map(quoted, docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.encoded(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_repeated_lines),
    ("simhash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("byte-level bpe", tokenize),
]

#: The learned scorer of the first stage has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
