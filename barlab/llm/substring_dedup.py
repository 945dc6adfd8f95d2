"""Substring dedup over a log-structured index of window hashes.

A window is `WINDOW` consecutive words. Of every document the index holds the hashes of a few windows of
`ANCHOR` words, chosen by the words alone (the least hash in each stretch of WINDOW - ANCHOR + 1 of them), so
two equal windows always hold an equal anchor. Once a second document has an anchor, the index also holds the
128-bit digests of all windows around it. Both kinds are kept in sorted immutable runs, bucketed by hash: each
batch of documents is merge-joined with each run of the batches before as it lies, without a shuffle or sort of
the run; its candidate windows are verified by
their digests, and its entries become new runs. When there are more than a few, they are compacted into one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm.common import conf_batches, hot_join, partitions, scratch, small_batches, small_side, stored

WINDOW, ANCHOR = 50, 24


def _word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def _word_digests(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the words' 128-bit digests."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _rolled(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes of all runs of `width` word hashes, by doubling."""
    with np.errstate(over="ignore"):
        out, have, power = h * np.uint64(base) ^ h >> np.uint64(31), 1, np.uint64(base)
        parts = []
        left = width
        while left:
            if left & 1:
                parts.append((have, out, power))
            left >>= 1
            if left:
                out = out[:-have] * power + out[have:] if len(out) > have else out[:0]
                power, have = power * power, have * 2
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total, at = np.zeros(n, np.uint64), 0
        for size, values, power in parts:
            total = total * power + values[at : at + n]
            at += size
        total ^= total >> np.uint64(33)
        total *= np.uint64(0xFF51AFD7ED558CCD)
        return total ^ total >> np.uint64(29)


def windows(words: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every run of width words, from independent hashes of the words."""
    a, b = _word_digests(words)
    return _rolled(a, width, 0x9E3779B97F4A7C15), _rolled(b, width, 0xC2B2AE3D27D4EB4F)


def anchors(a: np.ndarray) -> np.ndarray:
    """Positions of the least of each stretch of WINDOW - ANCHOR + 1 anchor hashes (the last of ties)."""
    span = WINDOW - ANCHOR + 1
    if len(a) < span:
        return np.zeros(0, np.int64)
    out, step = [], 1 << 16
    for at in range(0, len(a) - span + 1, step):
        view = np.lib.stride_tricks.sliding_window_view(a[at : at + step + span - 1], span)
        out.append(at + np.arange(len(view)) + span - 1 - view[:, ::-1].argmin(1))
    return np.unique(np.concatenate(out))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


PROFILE = "doc_id long, n_words long, kept_sha256 string, whole binary, anchors array<long>"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, "text"):
        rows = []
        for t in b.column("text").to_pylist():
            words = words_of(t)
            joined, found = b" ".join(words), []
            if len(words) >= WINDOW:
                a = _rolled(_word_hashes(words), ANCHOR, 0x9E3779B97F4A7C15)
                found = np.unique(a[anchors(a)]).view(np.int64)
            rows.append((len(words), hashlib.sha256(joined).hexdigest(), xxhash.xxh3_128_digest(joined), found))
        n, sha, whole, found = zip(*rows)
        kinds = pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(x), k) for x, k in zip((n, sha, whole, found), kinds))], [c.split()[0] for c in PROFILE.split(", ")])


def profiles(docs: DataFrame) -> DataFrame:
    """One row per document: word count, digest of its words, identity of its word sequence, anchor hashes."""
    conf_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_profile, PROFILE)


WINDOWS = "doc_id long, at int, h1 long, h2 long"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both hashes of the windows that hold a shared anchor."""
    for b in small_batches(batches, "text", 1 << 20):
        for doc, text, shared in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("shared")):
            words = words_of(text)
            if len(words) < WINDOW:
                continue
            hit = np.isin(_rolled(_word_hashes(words), ANCHOR, 0x9E3779B97F4A7C15).view(np.int64), shared.values.to_numpy())
            near = np.zeros(len(words) - WINDOW + 2, np.int64)
            at = np.flatnonzero(hit)
            np.add.at(near, np.maximum(at - (WINDOW - ANCHOR), 0), 1)
            np.add.at(near, np.minimum(at, len(near) - 2) + 1, -1)
            start = np.flatnonzero(np.cumsum(near)[:-1] > 0)
            h1, h2 = windows(words)
            for s in range(0, len(start), 1 << 16):
                k = start[s : s + (1 << 16)]
                columns = [pa.array(np.full(len(k), doc)), pa.array(k.astype(np.int32)), pa.array(h1[k].view(np.int64)), pa.array(h2[k].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WINDOWS.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words removed and kept, from a document's text and its removed windows' starts."""
    for b in small_batches(batches, "text"):
        rows = []
        for text, starts in zip(b.column("text").to_pylist(), b.column("starts")):
            words, cover = words_of(text), 0
            cover = np.zeros(len(words) + 1, np.int64)
            s = starts.values.to_numpy()
            np.add.at(cover, s, 1)
            np.add.at(cover, s + WINDOW, -1)
            gone = np.cumsum(cover)[:-1] > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            rows.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        n, sha, text = zip(*rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(text)], ["doc_id", "n_removed", "cut_sha256", "kept"])


class Index:
    """Runs of anchors (hash, doc_id: the least document that has it, shared: whether another has it too) and of
    windows (h1, h2, doc_id: the least document) under one folder, as tables bucketed and sorted by hash.

    A run is never changed. What runs there are is in the folder's manifest, whose last version holds: a batch
    that fails before it is committed leaves the index as it was, and another session may go on from the folder."""

    KINDS = {"anchors": ("hash long, doc_id long, shared boolean", ["hash"]), "windows": ("h1 long, h2 long, doc_id long", ["h1", "h2"])}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 0, most_runs: int = 4) -> None:
        """buckets: of a new index (default: the shuffle partitions); an index that exists keeps its own."""
        self.spark, self.path, self.most_runs, self.version, self.runs = spark, path, most_runs, 0, []
        self.buckets = buckets or partitions(spark)
        try:
            log = spark.read.parquet(f"{path}/manifest")
        except AnalysisException:
            return
        last = log.where(F.col("version") == log.agg(F.max("version")).first()[0]).collect()
        self.version, self.buckets, self.runs = last[0].version, last[0].buckets, [(r.kind, r.run) for r in last if r.run]
        for kind, run in self.runs:
            schema, keys = self.KINDS[kind]
            by = ", ".join(keys)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {run} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{path}/{run}'")

    def beside(self, kind: str, rows: DataFrame) -> DataFrame:
        """rows, one for each hash, with `known`, the least document of the hash in any run (and for anchors `shared`), else null.

        The rows are dealt as the runs' buckets are, so that runs are neither shuffled nor sorted (see `in_order`)."""
        schema, keys = self.KINDS[kind]
        out = rows if partitions(self.spark) == self.buckets else rows.repartition(self.buckets, *keys)
        mine = [run for k, run in self.runs if k == kind]
        for i, run in enumerate(mine):
            out = out.join(self.spark.table(run).withColumnsRenamed({"doc_id": f"known{i}", "shared": f"shared{i}"}), keys, "left")
        held = lambda name, least, type_: least(F.array(*[F.col(f"{name}{i}") for i in range(len(mine))])) if mine else F.lit(None).cast(type_)
        more = [held("shared", F.array_max, "boolean").alias("shared")] if kind == "anchors" else []
        return out.select(*rows.columns, held("known", F.array_min, "long").alias("known"), *more)

    @contextmanager
    def in_order(self) -> Iterator[None]:
        """Plans made within read a bucket of one file, as every run's is, in the order it was written in."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def _least(self, kind: str, parts: list[DataFrame]) -> DataFrame:
        schema, keys = self.KINDS[kind]
        every = reduce(DataFrame.unionByName, parts)
        shared = [F.max("shared").alias("shared")] if kind == "anchors" else []
        return every.groupBy(*keys).agg(F.min("doc_id").alias("doc_id"), *shared)

    def _write(self, kind: str, entries: DataFrame) -> tuple[str, str]:
        run, keys = f"barlab_{kind}_{uuid.uuid4().hex}", self.KINDS[kind][1]
        dealt = entries.repartition(self.buckets, *keys)
        dealt.write.format("parquet").bucketBy(self.buckets, *keys).sortBy(*keys).option("path", f"{self.path}/{run}").saveAsTable(run)
        return kind, run

    def commit(self, **entries: DataFrame) -> None:
        """Adds a run of each kind; where there are then more than `most_runs` of a kind, they become one and go."""
        seen = {run for _, run in self.runs}
        for kind, rows in entries.items():
            own = [r for r in self.runs if r[0] == kind] + [self._write(kind, rows)]
            seen |= {run for _, run in own}
            if len(own) > self.most_runs:
                own = [self._write(kind, self._least(kind, [self.spark.table(run) for _, run in own]))]
            self.runs = [r for r in self.runs if r[0] != kind] + own
        self.version += 1
        rows = [(self.version, self.buckets, kind, run) for kind, run in self.runs] or [(self.version, self.buckets, "", "")]
        self.spark.createDataFrame(rows, "version int, buckets int, kind string, run string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        gone = seen - {run for _, run in self.runs}
        self._forget(gone)
        for run in gone:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _forget(self, runs: Iterable[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")

    def close(self) -> None:
        """Takes the runs' names out of the catalog; their files stay, and the folder can be opened again."""
        self._forget(run for _, run in self.runs)


def _some(docs: DataFrame, ids: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """The documents of a stored table of distinct doc_ids; those of at most `most_rows` are broadcast, so that other texts don't shuffle."""
    return docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= most_rows else docs.join(ids, "doc_id", "left_semi")


def _holding(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, text and shared anchors of the documents that have any; shared: doc_id, hash."""
    lists = stored(shared.groupBy("doc_id").agg(F.collect_list("hash").alias("shared")))
    return _some(docs, lists.select("doc_id")).join(lists, "doc_id").select("doc_id", "text", "shared")


def _removed(batch: DataFrame, anchors: DataFrame, texts: DataFrame, index: Index) -> DataFrame:
    """doc_id, at of the windows of a batch that a document with a smaller doc_id holds; adds the batch to the index.

    batch: doc_id, text; anchors: doc_id, hash of the batch; texts: doc_id, text of all documents up to now."""
    own = anchors.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), (F.min("doc_id") < F.max("doc_id")).alias("several"))
    with index.in_order():
        seen = stored(index.beside("anchors", own).withColumnsRenamed({"known": "old", "shared": "was_shared"}))
    again = small_side(stored(seen.where("several OR old IS NOT NULL").select("hash")))
    found = _holding(batch, anchors.join(again, "hash").select("doc_id", "hash")).mapInArrow(_candidates, WINDOWS)
    starts = stored(found)
    # Anchors that had one document till now: its windows around them weren't kept.
    every = starts.select("doc_id", "h1", "h2", F.lit(1).alias("mine"))
    if index.runs:
        late = _holding(texts, seen.where("old IS NOT NULL AND NOT was_shared").select(F.col("old").alias("doc_id"), "hash"))
        every = every.unionByName(late.mapInArrow(_candidates, WINDOWS).select("doc_id", "h1", "h2", F.lit(0).alias("mine")))
    both = every.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("mine").alias("n"))
    with index.in_order():
        owner = stored(index.beside("windows", both).select("h1", "h2", "last", "n", F.least("first", "known").alias("first")))
    index.commit(
        anchors=seen.select("hash", F.least("old", "doc_id").alias("doc_id"), (F.col("several") | F.col("old").isNotNull()).alias("shared")),
        windows=owner.select("h1", "h2", F.col("first").alias("doc_id")),
    )
    taken = owner.where("first < last AND n > 0").select("h1", "h2", "first", "n")
    return hot_join(starts, taken, ["h1", "h2"], starts.count()).where("doc_id > first").select("doc_id", "at")


def dedup(docs: DataFrame, batches: int = 1, text: bool = False, index: Index | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, with `text`) for every row of docs (doc_id, text).

    A word goes if a window that covers it also starts in a document with a smaller doc_id. Windows are
    judged on the input, whatever is removed. Null and empty texts have no words; white space in what is
    kept becomes one space. doc_id is a key: rows with null doc_ids are compared with none and keep all;
    repeated rows of one doc_id are one document. `batches` > 1 adds the documents in that many slices
    by doc_id; the result is the same. With an `index` that earlier calls filled, docs are compared with their
    documents too; doc_ids must then be above theirs, and `history` has the earlier documents (doc_id, text), of
    which those are read that had an anchor alone till now. Other columns are not looked at."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = docs if history is None else history.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(docs)
    own, index = index is None, index or Index(spark, scratch(spark))
    profile = stored(profiles(docs))
    whole = profile.where("doc_id IS NOT NULL AND n_words >= %d" % WINDOW)
    copies = whole.groupBy("whole").agg(F.min("doc_id").alias("first_doc"), F.min_by("anchors", "doc_id").alias("anchors"), F.count("*").alias("n"))
    copies = stored(copies)
    firsts = copies.select(F.col("first_doc").alias("doc_id"), F.explode("anchors").alias("hash"))
    # Slices by doc_id: the runs before hold the smaller ids, so each slice looks only backwards.
    edges = copies.approxQuantile("first_doc", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    gone = []
    for low, high in zip([None, *edges], [*edges, None]):
        inside = F.lit(True) if low is None else F.col("doc_id") > int(low)
        inside = inside if high is None else inside & (F.col("doc_id") <= int(high))
        gone.append(stored(_removed(docs.where(inside), firsts.where(inside), texts, index)))
    if own:
        index.close()
    starts = reduce(DataFrame.unionByName, gone).groupBy("doc_id").agg(F.collect_set("at").alias("starts"))
    starts = stored(starts)
    cut = _some(docs, starts.select("doc_id")).join(starts, "doc_id").select("doc_id", "text", "starts")
    cut = cut.mapInArrow(_cut, "doc_id long, n_removed long, cut_sha256 string, kept string").dropDuplicates(["doc_id"])
    again = copies.where("n > 1").select("whole", "first_doc")
    rows = profile.select("doc_id", "n_words", "kept_sha256", "whole").join(again, "whole", "left")
    rows = rows.join(cut if text else cut.drop("kept"), "doc_id", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(False))
    return rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if text else []),
    )
