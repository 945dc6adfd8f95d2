"""Near-duplicate documents by SimHash and the Jaccard similarity of word shingles.

A document is the set of hashes of its lower-cased `WORDS`-word shingles. SimHash fingerprints of these
shingles, linked through their anchors, propose copies, of which those of similarity 0.8 or more are tied.
What they don't tie is completed exactly: two sets of similarity 0.8 or more share an element among the first
fifth (and one) of each, in any order that holds for all sets, so a join on these prefixes finds every such
pair. Shingles that a fixed share of the documents shows to be common come last in the order, the commonest at
the end: that keeps the join's groups small at any size and has no bearing on the result. Candidate pairs are held against each other by bitmaps first, which
bound what they can share from above; only what passes is verified by the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm import simhash
from barlab.llm.common import conf_batches, small_batches, small_side, stored
from barlab.llm.components import components
from barlab.llm.substring_dedup import _rolled, _word_hashes

WORDS = 5
_SHARE, _COMMON, _MOST = 4, 3, 1 << 21  # one document in _SHARE shows which shingles _COMMON sets or more have, _MOST at most
_BITS = 1024  # buckets of a set's bitmap
_PROFILE = "doc_id long, t struct<a: long, b: long>, node long, n int, fp long, prefix array<long>, bits array<long>"
_T, _DOC, _SAME = "barlab near t", "barlab near doc", "barlab near same"


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer than WORDS words: one shingle of all; no words: none."""
    parts, words = [], []
    for words in simhash.word_lists((text or "").lower().encode(), WORDS - 1):
        parts.append(np.unique(_rolled(_word_hashes(words), WORDS, 0x9E3779B97F4A7C15)))
    found = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))
    if not len(found) and words:
        found = np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    return found.view(np.int64)


def _same_text() -> Column:
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), "text").alias("b"))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, "text", 2 << 20):
        yield pa.RecordBatch.from_arrays([b.column("node"), _lists([shingles(t) for t in b.column("text").to_pylist()])], ["node", "set"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's shingles with one of 64 bits that stands for the set."""
    for b in small_batches(batches, "text", 2 << 20):
        sets = [shingles(t) for t in b.column("text").to_pylist()]
        marks = [np.uint64(1) << np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()) % 64) for s in sets]
        mark = np.repeat(np.array(marks, np.uint64), [len(s) for s in sets]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(mark)], ["key", "mark"])


def _common(texts: DataFrame, most: int = _MOST) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sets have, sorted, and how many of 64 bits their sets take. A fixed share of the documents
    is looked at, so what counts as common doesn't rise with the table until `most` shingles are."""
    some = texts.where(F.pmod("t.b", F.lit(_SHARE)) == 0).select("text")
    each = some.mapInArrow(_marked, "key long, mark long").groupBy("key").agg(F.bit_count(F.bit_or("mark")).alias("level"))
    often = stored(each.where(F.col("level") >= _COMMON))
    wanted = F.lit(True)
    for row in often.groupBy("level").count().orderBy(F.desc("level")).collect():
        if row["count"] > most:
            part = F.pmod("key", F.lit(1 << 20)) < most * (1 << 20) // row["count"]
            wanted = (F.col("level") > row["level"]) | ((F.col("level") == row["level"]) & part)
            break
        most -= row["count"]
    got = often.where(wanted).toArrow()
    key, level = got["key"].to_numpy(), got["level"].to_numpy()
    order = np.argsort(key)
    return key[order], level[order].astype(np.uint8)


def _profile(common: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = common.value
        for b in small_batches(batches, "text", 2 << 20):
            rows = []
            for text in b.column("text").to_pylist():
                s = shingles(text)
                late = np.zeros(len(s), np.uint8)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    late = np.where(keys[at] == s, levels[at], late)
                prefix = s[np.argsort(late, kind="stable")][: len(s) - (4 * len(s) + 4) // 5 + 1] if len(s) else s
                digest = xxhash.xxh3_128_digest(s.tobytes())
                fp = np.uint64(simhash.fingerprint((text or "").encode(), WORDS)).view(np.int64)
                held = np.zeros(_BITS, bool)
                held[s & (_BITS - 1)] = True
                rows.append((int.from_bytes(digest[:8], "big", signed=True), len(s), fp, prefix, np.packbits(held).view(np.int64)))
            node, n, fp, prefix, bits = zip(*rows)
            columns = [b.column("doc_id"), b.column("t"), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), _lists(list(prefix)), _lists(list(bits))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "node", "n", "fp", "prefix", "bits"])

    return run


def _possible(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs that may be of similarity 0.8 or more: elements in a bucket that the other set leaves empty aren't shared."""
    mine, its = (first.select(F.col("node").alias(k), F.col("n").alias("n" + k), F.col("bits").alias("bits" + k)) for k in "ab")
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, k: s + k)
    most = F.least(F.col("na") - alone("bitsa", "bitsb"), F.col("nb") - alone("bitsb", "bitsa"))
    return stored(pairs.join(mine, "a").join(its, "b").where(most * 9 >= (F.col("na") + F.col("nb")) * 4).select("a", "b"))


def _verified(pairs: DataFrame, first: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more: 9 x shared >= 4 x both sizes. Sets are made for pairs that may be such only."""
    pairs = _possible(pairs, first)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = small_side(stored(first.join(ends, "node", "left_semi").select("node", "t")))
    sets = stored(texts.join(wanted, "t").dropDuplicates(["node"]).select("node", "text").mapInArrow(_sets, "node long, set array<long>"))
    mine, its = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    alike = F.size(F.array_intersect("x", "y")) * 9 >= (F.size("x") + F.size("y")) * 4
    return pairs.join(mine, "a").join(its, "b").where(alike).select("a", "b")


def _proposed(first: DataFrame) -> DataFrame:
    """(a, b) of sets with equal or linked fingerprints: each with the least set of its own, and these with each other."""
    least = stored(first.groupBy("fp").agg(F.min("node").alias("a"), F.count("*").alias("k")))
    own = first.join(least.where("k > 1"), "fp").where("a <> node").select("a", F.col("node").alias("b"))
    near = simhash.links(least.select("fp")).withColumnsRenamed({"a": "fa", "b": "fb"})
    ends = lambda fp, c: least.select(F.col("fp").alias(fp), F.col("a").alias(c))
    return own.union(near.join(ends("fa", "a"), "fa").join(ends("fb", "b"), "fb").select("a", "b"))


def links(first: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) pairs of similarity 0.8 or more, enough to connect each component; first: node, n, fp, prefix, bits, t, once per set.

    The pairs that fingerprints propose are verified first. Every member of a shared prefix shingle is held against its smallest set first; what that ties into one
    component isn't paired again, so a large group of near copies stays linear. The others are paired in full."""
    keys = first.select("node", "n", F.posexplode("prefix").alias("at", "key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    met = stored(keys.join(small_side(stored(shared)), "key"))
    proposed = stored(_proposed(first))
    least = met.groupBy("key").agg(F.min(F.struct("n", "node")).alias("m")).select("key", F.col("m.node").alias("a"), F.col("m.n").alias("m"))
    star = met.join(least, "key").where("a <> node AND 5L * m >= 4L * n").select("a", F.col("node").alias("b")).union(proposed).distinct()
    tied = stored(_verified(star, first, texts))
    group = stored(components(tied))
    now = met.join(group, "node", "left").select("key", "node", "n", "at", F.coalesce("component", "node").alias("c"))
    mixed = now.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    left = stored(now.join(mixed, "key"))
    a, b = (left.select("key", *(F.col(k).alias(k + s) for k in ("node", "n", "at", "c"))) for s in "ab")
    # What a pair can share: before this shingle as many as precede it in either, from it on as many as follow in either.
    most = F.least("ata", "atb") + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    near = (F.col("nodea") < F.col("nodeb")) & (F.col("ca") != F.col("cb")) & (most * 9 >= (F.col("na") + F.col("nb")) * 4)
    # All that a pair shares up to the last prefix shingle they share is in both prefixes, so it is counted.
    last = [F.max("ata").alias("ata"), F.max("atb").alias("atb"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.count("*").alias("k")]
    pairs = a.join(b, "key").where(near).groupBy(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).agg(*last)
    pairs = pairs.where("9 * (k + least(na - ata, nb - atb) - 1) >= 4 * (na + nb)").select("a", "b")
    return tied.union(_verified(pairs, first, texts))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group stays, that with the smallest doc_id; all columns of docs pass.

    Groups are the components of all pairs of similarity 0.8 or more. Texts without words are one group.
    Rows are told apart by doc_id and text: a null doc_id goes only where its group has another row, and
    of rows that repeat a doc_id those of other groups stay."""
    conf_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _same_text().alias("t"), "text")
    texts = rows.select("t", "text")
    common = docs.sparkSession.sparkContext.broadcast(_common(texts))
    profile = stored(rows.mapInArrow(_profile(common), _PROFILE))
    common.destroy()
    first = profile.groupBy("node").agg(F.min(F.struct("t", "n", "fp", "prefix", "bits")).alias("p")).select("node", "p.*")
    group = small_side(stored(components(links(stored(first), texts))))
    same = profile.select("doc_id", "t", "node").join(group, "node", "left").groupBy(F.coalesce("component", "node").alias("c"), "doc_id", "t").agg(F.count("*").alias("n"))
    best = same.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("m")).select(F.col("m.doc_id").alias(_DOC), F.col("m.t").alias(_SAME), F.lit(True).alias("stays"))
    once = stored(same.select("doc_id", "t", "n").join(best, F.col("doc_id").eqNullSafe(F.col(_DOC)) & (F.col("t") == F.col(_SAME)), "left").select("doc_id", "t", "n", "stays"))
    marked = docs.withColumn(_T, _same_text())
    gone = once.where("stays IS NULL OR n > 1").select(F.col("doc_id").alias(_DOC), F.col("t").alias(_SAME))
    again = once.where("stays AND n > 1").select(F.col("doc_id").alias(_DOC), F.col("t").alias(_SAME))
    row = F.col("doc_id").eqNullSafe(F.col(_DOC)) & (F.col(_T) == F.col(_SAME))
    single = marked.join(small_side(stored(gone)), row, "left_anti")
    repeated = marked.join(small_side(stored(again)), row, "left_semi").dropDuplicates(["doc_id", _T])
    return single.union(repeated).drop(_T)
