"""SimHash near-duplicates by anchor-point covering.

The 64 bits are three blocks (23, 23 and 18 bits, the last padded with zeros). The perfect binary [23,12] code
of covering radius 3 covers each block, so the product of the three codes gives every fingerprint a home anchor
within the radius in each block. A fingerprint is replicated to every anchor within covering radius plus
threshold: over the blocks, its distances go beyond the radius by 2 bits at most in all. Of two fingerprints at
2 or fewer differing bits each thus meets the other at that one's home, where they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import conf_batches, small_batches, small_side, stored
from barlab.llm.components import components

SEED, BITS, RADIUS = 42, 2, 3
_PIECE = 1 << 18


def word_lists(text: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of a text in pieces that repeat the last `overlap` words of the piece before."""
    at, carry = 0, []
    while at < len(text):
        to = min(len(text), at + _PIECE)
        while to < len(text) and text[to] not in b" \t\n\v\f\r":
            to += 1
        words = carry + text[at:to].split()
        yield words
        carry, at = words[len(words) - overlap :] if overlap and len(words) >= overlap else words, to


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64; no words: 0."""
    total, n, words = np.zeros(64, np.int64), 0, []
    for words in word_lists(text.lower(), shingle - 1):
        if len(words) < shingle:
            continue
        row = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begins = np.append(0, ends[:-1] + 1)
        h64 = xxhash.xxh64_intdigest
        h = np.array([h64(row[a:b], SEED) for a, b in zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], ">u8")
        for i in range(0, len(h), 65536):
            total += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row, over whole texts; null text: 0. No shuffle."""
    conf_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 2 << 20):
            fp = np.array([fingerprint((t or "").encode(), shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _code_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Of the cyclic code with generator x^11+x^9+x^7+x^6+x^5+x+1: the remainder of x^i, and for each remainder the errors
    that lead to codewords at distance 3 or less (one, as the code is perfect), at 4 and at 5; -1 where there are fewer."""
    g, unit = 0b101011100011, []
    for i in range(23):
        r = 1 << i
        for j in range(22, 10, -1):
            if r >> j & 1:
                r ^= g << (j - 11)
        unit.append(r)
    found: list[list[list[int]]] = [[[] for _ in range(2048)] for _ in range(BITS + 1)]
    for weight in range(RADIUS + BITS + 1):
        for places in combinations(range(23), weight):
            remainder = error = 0
            for i in places:
                remainder, error = remainder ^ unit[i], error | 1 << i
            found[max(0, weight - RADIUS)][remainder].append(error)
    tables = []
    for level in found:
        table = np.full((2048, max(map(len, level))), -1, np.int64)
        for r, errors in enumerate(level):
            table[r, : len(errors)] = errors
        tables.append(table)
    return np.array(unit, np.int64), tables


_UNIT, _ERRORS = _code_tables()


def _codewords(block: np.ndarray) -> list[np.ndarray]:
    """For each level of distance beyond the radius the codewords (named by their upper 12 bits) of 23-bit numbers, -1 for none."""
    s = np.zeros_like(block)
    for i in range(23):
        s ^= np.where(block >> i & 1, _UNIT[i], 0)
    return [np.where(t[s] < 0, -1, (block[:, None] ^ t[s]) >> 11) for t in _ERRORS]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """Anchors of all combinations of codewords of the three blocks, -1 where one is missing."""
    a, b, c = parts[0][:, :, None, None], parts[1][:, None, :, None], parts[2][:, None, None, :]
    return np.where((a < 0) | (b < 0) | (c < 0), -1, a << 24 | b << 12 | c).reshape(len(a), -1)


def _blocks(fp: np.ndarray) -> list[list[np.ndarray]]:
    u = fp.view(np.uint64)
    parts = (u & np.uint64(0x7FFFFF)), (u >> np.uint64(23) & np.uint64(0x7FFFFF)), u >> np.uint64(46)
    return [_codewords(x.astype(np.int64)) for x in parts]


def homes(fp: np.ndarray) -> np.ndarray:
    """The anchor within the covering radius in every block."""
    return _joined([b[0] for b in _blocks(fp)])[:, 0]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor) for all anchors within covering radius plus threshold of each fingerprint (139 at most)."""
    blocks = _blocks(fp)
    levels = [x for x in product(range(BITS + 1), repeat=3) if sum(x) <= BITS]
    table = np.concatenate([_joined([b[i] for b, i in zip(blocks, x)]) for x in levels], 1)
    return np.nonzero(table >= 0)[0], table[table >= 0]


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy()
        for i in range(0, len(fp), 4096):
            at, anchor = anchors(fp[i : i + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[i:][at])], ["anchor", "fp"])


def _to_homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(homes(b.column("fp").to_numpy())), b.column("fp")], ["anchor", "fp"])


def links(nodes: DataFrame, *, crowded: int = 256) -> DataFrame:
    """(a, b) links between distinct fingerprints at 2 or fewer differing bits, enough to connect each component.

    At each anchor those at home are compared with all that were replicated to it. Where over `crowded` are at
    home, which is a group of that many distinct fingerprints within a few bits, pairs would grow with its square:
    there all that met are grouped instead by every point within 1 bit, as any link of 2 bits has a point within
    1 bit of both; those of one point are all linked, and each is tied to the point's least member."""
    at_home = stored(nodes.select("fp").mapInArrow(_to_homes, "anchor long, fp long"))
    inhabited = small_side(stored(at_home.groupBy("anchor").agg(F.count("*").alias("home"))))
    met = stored(nodes.select("fp").mapInArrow(_to_anchors, "anchor long, fp long").join(inhabited, "anchor"))
    few = met.where(F.col("home") <= crowded).select("anchor", F.col("fp").alias("b"))
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)
    pairs = few.join(at_home.withColumnRenamed("fp", "a"), "anchor").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    by_point = met.where(F.col("home") > crowded).select("fp").distinct().select("fp", F.explode(points).alias("point"))
    least = by_point.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    tied = by_point.join(least, "point").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.union(tied).distinct()


def near_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row of docs.

    Null and empty texts have fingerprint zero and are linked like any other; equal texts and repeated
    rows share a component; null doc_ids never name one. Other columns are not looked at."""
    fps = stored(fingerprints(docs, shingle))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    reached = stored(components(links(nodes)))
    heads = nodes.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = heads.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = heads.join(named, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp")


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; all columns of docs pass."""
    kept = near_groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
