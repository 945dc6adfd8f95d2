"""Byte-level BPE: merges of distinct words folded by Spark's higher-order functions over a literal rank map.

A word starts as the array of its bytes' ids; the fold merges the leftmost pair of least rank, looked up by
the pair's ids. Every distinct word of a bounded dictionary of frequent words is folded once; the rest, each
once a document, are folded where they occur, so the result doesn't depend on the dictionary. Texts are cut
into words and joined with the dictionary's ids columnwise, without a shuffle; decoding joins the
pieces of the ids. Map lookups in Spark scan the map, so a literal map is an array of small maps.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm.common import conf_batches, flat, let, literal, small_batches, stored
from barlab.llm.words import MOST_BYTES, Dictionary, gather, span_hashes, word_starts

MANY = 2_000_000_000
LONG = 96  # bytes from which a word is cut where no token spans, and merged by rounds
_CHAR = 0x20000  # a token is the character of this code point plus its id while it is part of a long word
_SHIFT = 1 << 20
STRETCH = 1 << 16  # ids whose pieces are joined at a time
_PIECES = "barlab bpe pieces"


@dataclass(frozen=True)
class Vocabulary:
    """Tokens as byte strings by rank, one for each single byte among them, and the pattern that cuts texts."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    @cached_property
    def byte_ids(self) -> list[int]:
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing or max(self.ranks.values()) >= _SHIFT // 2:
            raise ValueError(f"the vocabulary lacks bytes {missing} or has ranks of {_SHIFT // 2} or more")
        return [self.ranks[bytes([b])] for b in range(256)]

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The rank that two neighbouring tokens make, by left id x _SHIFT + right id."""
        r = self.ranks
        return {r[t[:i]] * _SHIFT + r[t[i:]]: n for t, n in r.items() for i in range(1, len(t)) if t[:i] in r and t[i:] in r}

    def pieces(self, spark: SparkSession) -> Column:
        """Literal array: at each id its bytes in hex, null where there is no such id."""
        listed = [None] * (max(self.ranks.values(), default=-1) + 1)
        for t, r in self.ranks.items():
            listed[r] = t.hex()
        return literal(spark.createDataFrame([(listed,)], "pieces array<string>"))


@dataclass(frozen=True)
class RankMap:
    """What the fold looks up, one literal struct: `maps` of pair ranks by hash, `ids` of bytes, `spans` (whether a
    token holds two bytes side by side, by first x 256 + second) and `chars` of ids."""

    column: Column
    buckets: int = 1 << 17

    @classmethod
    def of(cls, vocabulary: Vocabulary, spark: SparkSession) -> RankMap:
        pairs = pd.DataFrame({"key": list(vocabulary.pairs), "rank": list(vocabulary.pairs.values())}, dtype="int64")
        entries = spark.createDataFrame(pairs, "key long, rank int").withColumn("b", F.pmod(F.floor(F.col("key") / _SHIFT) * 31 + F.col("key") % _SHIFT, F.lit(cls.buckets)).cast("int"))
        own = entries.groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("key", "rank"))).alias("m"))
        every = spark.range(cls.buckets).select(F.col("id").cast("int").alias("b")).join(own, "b", "left")
        maps = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "m")), lambda x, y: x["b"] - y["b"]), lambda x: x["m"]).alias("maps"))
        spans = np.zeros(1 << 16, bool)
        for t in vocabulary.ranks:
            a = np.frombuffer(t, np.uint8).astype(np.int64)
            spans[a[:-1] * 256 + a[1:]] = True
        chars = [chr(_CHAR + i) for i in range(max(vocabulary.ranks.values()) + 1)]
        rest = spark.createDataFrame([(vocabulary.byte_ids, spans.tolist(), chars)], "ids array<int>, spans array<boolean>, chars array<string>")
        return cls(literal(maps.crossJoin(rest).select(F.struct("maps", "ids", "spans", "chars").alias("ranks"))))

    def bound(self, name: str, body: Callable[[RankMap], Column]) -> Column:
        """body with the literal, selected before under that name, however often it looks ranks up."""
        return let(F.col(name), lambda c: body(RankMap(c, self.buckets)))

    def rank(self, left: Column, right: Column) -> Column:
        """The rank of two neighbouring ids merged, null if they don't merge."""
        return F.try_element_at(F.get(self.column["maps"], F.pmod(left * 31 + right, F.lit(self.buckets))), left.cast("long") * _SHIFT + right)


def _short(ids: Column, ranks: RankMap) -> Column:
    """Merges the leftmost pair of least rank, pair by pair. i holds the ids between two fences (-1), which
    merge with nothing; r the ranks of neighbours in i."""
    start = F.concat(F.array(F.lit(-1)), ids, F.array(F.lit(-1)))

    def merge(e: Column) -> Column:
        def at(p: Column) -> Column:
            put = p["r"]
            i = F.concat(F.slice(e["i"], F.lit(1), p["p"] - 1), F.array(put), F.slice(e["i"], p["p"] + 2, F.lit(MANY)))
            near = F.array(ranks.rank(F.get(e["i"], p["p"] - 2), put), ranks.rank(put, F.get(e["i"], p["p"] + 1)))
            return F.when(put.isNull(), e).otherwise(F.struct(i.alias("i"), F.concat(F.slice(e["r"], F.lit(1), p["p"] - 2), near, F.slice(e["r"], p["p"] + 2, F.lit(MANY))).alias("r")))

        least = F.array_min(e["r"])
        return let(F.struct(least.alias("r"), F.array_position(e["r"], least).cast("int").alias("p")), at)

    def fold(i: Column) -> Column:
        r = F.zip_with(F.slice(i, F.lit(1), F.size(i) - 1), F.slice(i, F.lit(2), F.size(i) - 1), ranks.rank)
        return F.aggregate(F.sequence(F.lit(2), F.size(ids)), F.struct(i.alias("i"), r.alias("r")), lambda e, _: merge(e), lambda e: F.slice(e["i"], F.lit(2), F.size(e["i"]) - 2))

    return F.when(F.size(ids) < 2, ids).otherwise(let(start, fold))


def _ids_of(chars: Column) -> Column:
    return F.transform(F.split(chars, ""), lambda c: F.ascii(c) - _CHAR)


def _rounds(chars: Column, ranks: RankMap) -> Column:
    """The same for the characters of a long stretch: each round replaces all pairs of the least rank, left to
    right. Merged tokens rank above the pair, so rounds give what single steps give; there are as many as
    distinct merges."""

    def least(t: Column) -> Column:
        each = F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda x, y: F.concat(x, y))
        pair = lambda c: F.struct(ranks.rank(F.ascii(c) - _CHAR, F.ascii(F.substring(c, 2, 1)) - _CHAR).alias("r"), c.alias("c"))
        return F.array_min(F.filter(F.transform(F.array_distinct(each), pair), lambda x: x["r"].isNotNull()))

    def step(s: Column) -> Column:
        def put(m: Column) -> Column:
            new = F.struct(F.replace(s["s"], m["c"], F.get(ranks.column["chars"], m["r"])).alias("s"), F.lit(False).alias("done"))
            return F.when(m["r"].isNotNull(), new).otherwise(F.struct(s["s"].alias("s"), F.lit(True).alias("done")))

        return F.when(s["done"], s).otherwise(let(least(F.split(s["s"], "")), put))

    return F.aggregate(F.sequence(F.lit(2), F.length(chars)), F.struct(chars.alias("s"), F.lit(False).alias("done")), lambda s, _: step(s), lambda s: _ids_of(s["s"]))


def _long(codes: Column, ranks: RankMap) -> Column:
    """A long word's bytes, cut between bytes that stand side by side in no token: no merge spans these."""
    after = F.concat(F.slice(codes, F.lit(2), F.size(codes)), F.array(F.lit(-1)))

    def char(a: Column, b: Column) -> Column:
        own = F.get(ranks.column["chars"], F.get(ranks.column["ids"], a))
        return F.when((b < 0) | F.get(ranks.column["spans"], a * 256 + b), own).otherwise(F.concat(own, F.lit(" ")))

    parts = F.split(F.array_join(F.zip_with(codes, after, char), ""), " ")
    each = lambda p: F.when(F.length(p) < LONG, _short(_ids_of(p), ranks)).otherwise(_rounds(p, ranks))
    return F.flatten(F.transform(parts, each))


def fold_word(word: Column, ranks: RankMap) -> Column:
    """Token ids of one word (not empty) by its folded merges."""

    def merged(codes: Column) -> Column:
        ids = F.transform(codes, lambda b: F.get(ranks.column["ids"], b))
        return F.when(F.size(codes) < LONG, let(ids, lambda i: _short(i, ranks))).otherwise(_long(codes, ranks))

    return let(F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.ascii(c)), merged)


def _ready(vocabulary: Vocabulary) -> tuple[pa.Array, pa.Array]:
    """The tokens themselves and their ids: as whole words they need no merges."""
    own = [(t, r) for t, r in vocabulary.ranks.items() if len(t) <= MOST_BYTES]
    ids = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1), pa.int32()), pa.array([r for _, r in own], pa.int32()))
    return pa.array([t for t, _ in own], pa.large_binary()), ids


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, most: int, ranks: RankMap | None = None) -> DataFrame:
    """key, value: ids of the corpus's most frequent words that are no tokens, at most `most` of them.

    Counts cover all documents. A threshold on the count, from a histogram of some hundred rows, decides."""
    spark = docs.sparkSession
    tokens, pattern = spark.sparkContext.broadcast(Dictionary([_ready(vocabulary)])), vocabulary.pattern

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 4 << 20):
            data, off = flat(b.column("text"))
            starts = word_starts(data, off, pattern)
            ends = np.append(starts[1:], len(data))[: len(starts)]
            short = ends - starts <= MOST_BYTES
            starts, ends = starts[short], ends[short]
            h1, h2 = span_hashes(data, starts, ends)
            _, at, n = np.unique(h1, return_index=True, return_counts=True)
            new = tokens.value.find(h1[at], h2[at]) < 0
            at, n = at[new], n[new]
            size = ends[at] - starts[at]
            keys = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(gather(data, starts[at], size))])
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64())], ["key", "n"])

    words = docs.select("text").mapInArrow(count, "key string, n long")
    words = stored(words.groupBy("key").agg(F.sum("n").alias("count")).where("count > 1"))
    tokens.destroy()
    level = F.floor(F.log2("count") * 8).cast("int")
    got, least = 0, MANY
    for row in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if (got := got + row["count"]) > most:
            break
        least = row["level"]
    ranks = ranks or RankMap.of(vocabulary, spark)
    chosen = words.where(level >= least).repartition(F.col("key")).withColumn("_ranks", ranks.column)
    return chosen.select("key", ranks.bound("_ranks", lambda r: fold_word(F.col("key"), r)).alias("value"))


def dictionary(docs: DataFrame, vocabulary: Vocabulary, most: int, ranks: RankMap | None = None) -> Dictionary:
    """The vocabulary's tokens and the frequent words, at most `most`, with their ids: some 40 bytes each. The words
    pass through the driver batch by batch and never as Python's objects."""
    got = frequent_words(docs, vocabulary, most, ranks).toArrow().to_batches()[::-1]

    def parts() -> Iterator[tuple[pa.Array, pa.Array]]:
        yield _ready(vocabulary)
        while got:
            yield got[-1].column("key"), got.pop().column("value")

    return Dictionary(parts())


def encode(docs: DataFrame, vocabulary: Vocabulary, *, keep: list[str], dictionary_words: int = 1 << 20) -> DataFrame:
    """The `keep` columns and ids (array<int>) of every row's whole text, without special tokens.

    Null and empty texts have no ids; rows may repeat; other columns are dropped. The texts aren't shuffled.
    The dictionary of at most `dictionary_words` words (some 40 MB) goes to every executor. Words of any length
    are folded; one of LONG bytes or more that tokens span throughout takes a pass for each distinct merge."""
    spark = docs.sparkSession
    conf_batches(spark)
    ranks = RankMap.of(vocabulary, spark)
    known, pattern, kinds = spark.sparkContext.broadcast(dictionary(docs, vocabulary, dictionary_words, ranks)), vocabulary.pattern, dict(docs.dtypes)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        sizes = np.diff(words.first)
        for b in small_batches(batches, "text", 1 << 20):
            data, off = flat(b.column("text"))
            starts = word_starts(data, off, pattern)
            ends = np.append(starts[1:], len(data))[: len(starts)]
            at = words.find(*span_hashes(data, starts, ends))
            at[ends - starts > MOST_BYTES] = -1
            hole = np.flatnonzero(at < 0)
            size = np.where(at < 0, 0, sizes[at])
            ids = gather(words.ids, words.first[at], size)
            ends_ids = np.append(0, np.cumsum(size))
            row = np.searchsorted(off[1:], starts[hole], "right")
            raw, rest, rest_n, which = data.tobytes(), [], np.zeros(b.num_rows, np.int64), np.empty(len(hole), np.int64)
            seen: dict[str, int] = {}
            last = -1
            for i, (r, s, e) in enumerate(zip(row.tolist(), starts[hole].tolist(), ends[hole].tolist())):
                if r != last:
                    seen, last = {}, r
                word = raw[s:e].decode()
                if (k := seen.get(word)) is None:
                    k = seen[word] = len(seen)
                    rest.append(word)
                    rest_n[r] += 1
                which[i] = k
            # A row's ids come in stretches, each but the last followed by a word of `rest`.
            first_word = np.searchsorted(starts, off)
            cut = np.sort(np.concatenate([ends_ids[hole], ends_ids[first_word[1:]]]), kind="stable")
            n_holes = np.bincount(row, minlength=b.num_rows)
            last_of = np.cumsum(n_holes + 1) - 1
            then = np.full(len(cut), -1, np.int64)
            inner = np.ones(len(cut), bool)
            inner[last_of] = False
            then[inner] = which
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, cut), pa.int32()), pa.array(ids, pa.int32()))
            parts = pa.StructArray.from_arrays([lists, pa.array(then, pa.int32())], ["ids", "then"])
            parts = pa.ListArray.from_arrays(pa.array(np.append(0, last_of + 1), pa.int32()), parts)
            more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rest_n)), pa.int32()), pa.array(rest, pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), parts, more], [*(f"_k{i}" for i in range(len(keep))), "_parts", "_rest"])

    schema = ", ".join([*(f"_k{i} {kinds[k]}" for i, k in enumerate(keep)), "_parts array<struct<ids: array<int>, then: int>>", "_rest array<string>"])
    found = docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(look_up, schema)
    folded = ranks.bound("_ranks", lambda r: F.transform("_rest", lambda w: fold_word(w, r)))
    nothing = F.array().cast("array<int>")
    join = lambda f: F.flatten(F.transform("_parts", lambda p: F.concat(p["ids"], F.coalesce(F.get(f, p["then"]), nothing))))
    ids = F.when(F.size("_rest") == 0, F.get("_parts", F.lit(0))["ids"]).otherwise(let(folded, join))
    return found.withColumn("_ranks", ranks.column).select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)), ids.alias("ids"))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds decoded (binary): the pieces of a row's ids, in hex, joined and read back, in runs of STRETCH and then these, so that
    nothing is copied once for each id. An id that the vocabulary doesn't have adds nothing, null ids give null;
    a column of that name is replaced."""
    ready = encoded.drop("decoded").withColumn(_PIECES, vocabulary.pieces(encoded.sparkSession))
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(STRETCH))

    def joined(pieces: Column) -> Column:
        run = lambda ids: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))
        runs = F.aggregate(F.transform(starts, lambda at: run(F.slice("ids", at, F.lit(STRETCH)))), F.lit(b""), lambda a, x: F.concat(a, x))
        return F.when(F.size("ids") > STRETCH, runs).otherwise(run(F.col("ids")))

    return ready.withColumn("decoded", let(F.col(_PIECES), joined)).drop(_PIECES)
