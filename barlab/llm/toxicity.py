"""Toxicity: a factorization machine over hashed terms.

A document's features are which terms it has. Those get a weight and a factor vector whose presence differs
between the classes of a bounded labelled sample beyond chance, alone or in a pair beyond what either does
alone; the rest weigh nothing, so long clean documents don't add up noise. The pairwise part learns terms that
count only together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import conf_batches, flat, quoted, small_batches
from barlab.llm.terms import hashed_terms

BITS = 22
_PIECE = 1 << 17  # of the sample's terms that are looked at together
_ROWS = 256  # of the sample, and terms of its pairs, that are counted together


@dataclass(frozen=True)
class Machine:
    terms: np.ndarray  # sorted buckets
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n rows from distinct (row, feature) pairs sorted by row."""
        z = np.full(n, self.bias)
        z += np.bincount(rows, self.linear[features], n)
        for v in self.factors.T:
            x = v[features]
            z += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, h = hashed_terms(data, offsets)
    return rows, (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _distinct(rows: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows * width + values)
    return both // width, both % width


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, "text"):
        rows, t = _distinct(*_buckets(*flat(b.column("text"))), 1 << BITS)
        off = np.searchsorted(rows, np.arange(b.num_rows + 1))
        terms = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(t, pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("label"), terms], ["label", "terms"])


def _places(values: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values are among the sorted `kept`, and at which places of these; piece by piece, as hits may be few."""
    where, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(values) if len(kept) else 0, _PIECE):
        part = values[i : i + _PIECE]
        at = np.minimum(np.searchsorted(kept, part), len(kept) - 1)
        hit = np.flatnonzero(kept[at] == part)
        where.append(hit + i)
        places.append(at[hit])
    return np.concatenate(where), np.concatenate(places)


def _paired(rows: np.ndarray, t: np.ndarray, y: np.ndarray, all_: np.ndarray, one: np.ndarray, least_df: int, least_z: float, most: int) -> np.ndarray:
    """Terms of pairs that more (or fewer) rows of class 1 have together than the higher (lower) rate of the two would give."""
    often = np.sort(np.argsort(-all_, kind="stable")[:most])
    often = often[all_[often] >= least_df]
    # Counts are whole numbers far below 2^24, so sums of float32 by rows are exact.
    both, both_one = np.zeros((2, len(often), len(often)), np.float32)
    ends = np.searchsorted(rows, np.arange(0, len(y) + _ROWS, _ROWS))
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        hit, at = _places(t[a:b], often)
        mine = y[i * _ROWS : (i + 1) * _ROWS] == 1
        x = np.zeros((len(mine), len(often)), np.float32)
        x[rows[a:b][hit] - i * _ROWS, at] = 1
        both += x.T @ x
        both_one += x[mine].T @ x[mine]
    rate = one[often] / all_[often]
    floor, odd = 1 / (len(y) + 1), np.zeros(len(often), bool)

    def beyond(k: np.ndarray, k_one: np.ndarray, p: np.ndarray, sign: int) -> np.ndarray:
        p = np.clip(p, floor, 1 - floor)
        return sign * (k_one - k * p) / np.sqrt(np.maximum(k * p * (1 - p), 1e-9)) >= least_z

    np.fill_diagonal(both, 0)
    for i in range(0, len(often), _ROWS):
        k, k_one, own = both[i : i + _ROWS], both_one[i : i + _ROWS], rate[i : i + _ROWS, None]
        found = beyond(k, k_one, np.maximum(own, rate), 1) | beyond(k, k_one, np.minimum(own, rate), -1)
        odd[i : i + _ROWS] = ((k >= max(1, 2 * least_df)) & found).any(1)
    return often[odd]


def fit(rows: DataFrame, *, least_df: int = 3, least_z: float = 4.5, least_pair_z: float = 6.0, pair_terms: int = 1024, k: int = 4, epochs: int = 300, seed: int = 7) -> Machine:
    """Fits on (text, label 0 or 1) rows, a bounded sample such as `labelled` gives: their distinct
    terms, a few KB a row, come to the driver. Pairs are screened among the `pair_terms` terms that most rows of
    the sample have. No rows: a machine that says 0.5."""
    conf_batches(rows.sparkSession)
    got = rows.select("text", "label").mapInArrow(_featurize, "label int, terms array<int>").toArrow()
    y = got["label"].to_numpy().astype(float)
    if not len(y):
        return Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, k)))
    lists = got["terms"].combine_chunks()
    del got
    # Whatever is as long as the sample's terms is of 4 bytes each and made piece by piece: all this is the driver's memory.
    rows, t = np.repeat(np.arange(len(y), dtype=np.int32), lists.value_lengths().to_numpy()), lists.flatten().to_numpy().copy()
    del lists
    # From here on a term is its place among the sample's terms, so that memory goes by these and not by all buckets.
    terms = np.unique(t).astype(np.int64)
    one, all_ = np.zeros((2, len(terms)), np.int64)
    for i in range(0, len(t), _PIECE):
        at = np.searchsorted(terms, t[i : i + _PIECE])
        t[i : i + _PIECE] = at
        np.add.at(all_, at, 1)
        np.add.at(one, at[y[rows[i : i + _PIECE]] == 1], 1)
    p, n = y.mean(), len(y)
    base = min(max(p, 1 / (n + 1)), n / (n + 1))
    spread = np.sqrt(np.maximum(all_ * base * (1 - base) * (1 - all_ / (n + 1)), 1e-9))
    z = np.where(all_ >= least_df, (one - all_ * base) / spread, 0)
    kept = np.flatnonzero(np.abs(z) >= least_z)
    kept = np.union1d(kept, _paired(rows, t, y, all_, one, least_df, least_pair_z, pair_terms))
    bias = float(np.log(base / (1 - base)))
    hit, f = _places(t, kept)
    r = rows[hit].astype(np.int64)
    del rows, t
    # Full-batch Adam on the regularised log loss; the sparse pairs (r, f) stand for the design matrix.
    rng = np.random.default_rng(seed)
    w, v, b0 = np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), k)), bias
    state = [np.zeros_like(x) for x in (w, v, np.zeros(1))], [np.zeros_like(x) for x in (w, v, np.zeros(1))]
    for step in range(1, epochs + 1):
        s = np.stack([np.bincount(r, v[f, j], n) for j in range(k)], 1)
        q = np.stack([np.bincount(r, v[f, j] ** 2, n) for j in range(k)], 1)
        out = 1 / (1 + np.exp(-np.clip(b0 + np.bincount(r, w[f], n) + 0.5 * (s * s - q).sum(1), -30, 30)))
        d = (out - y) / n
        gw = np.bincount(f, d[r], len(kept)) + 2e-5 * w
        gv = np.stack([np.bincount(f, d[r] * (s[r, j] - v[f, j]), len(kept)) for j in range(k)], 1) + 2e-4 * v
        for i, (x, g) in enumerate(((w, gw), (v, gv), (None, np.array([d.sum()])))):
            m, u = state[0][i], state[1][i]
            m += 0.1 * (g - m)
            u += 0.001 * (g * g - u)
            move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-9)
            if x is None:
                b0 -= float(move[0])
            else:
                x -= move
    return Machine(terms[kept], b0, w, v)


def _scorer(machine: Machine, keys: list[str], name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = np.full(1 << BITS, -1, np.int32)
        where[machine.terms] = np.arange(len(machine.terms))
        for b in small_batches(batches, "text"):
            rows, t = _buckets(*flat(b.column("text")))
            f = where[t]
            r, f = _distinct(rows[f >= 0], f[f >= 0].astype(np.int64), max(1, len(machine.terms)))
            p = machine.score(r, f, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [pa.array(p)], [*keys, name])

    return score


def score(docs: DataFrame, machine: Machine, keys: list[str], name: str = "toxicity") -> DataFrame:
    """The key columns and `name` (toxicity, 0 to 1) of every row, over whole texts; null and empty texts get the bias. No shuffle."""
    conf_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    # Within the map columns go by number: it takes no names with dots.
    rows = docs.select(*map(quoted, keys), F.col("text")).toDF(*(f"c{i}" for i in range(len(keys))), "text")
    taken = [f"c{i}" for i in range(len(keys))]
    return rows.mapInArrow(_scorer(machine, taken, "score"), ", ".join(f"{c} {kinds[k]}" for c, k in zip(taken, keys)) + ", score double").toDF(*keys, name)


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: Column, most: int) -> DataFrame:
    """doc_id, text and label of at most `most` labelled rows to learn from, chosen by hash of doc_id.

    The chosen ids are at most `most` rows, so they are broadcast and the texts aren't shuffled."""
    chosen = labels.where(learn & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
