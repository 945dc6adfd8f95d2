"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned embedding; learned filters run over all windows of `WIDTH` bytes. Chunks of
`CHUNK` windows (overlapping by WIDTH - 1 bytes) are max-pooled; a document has the maximum and the
mean of its chunks' pools, and a logistic unit makes one probability of them. As embedding and filter
are linear, inference adds one table row of responses for each tap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barlab.llm.common import conf_batches, flat, small_batches

WIDTH, CHUNK, FILTERS, EMBED = 4, 256, 16, 6
_PIECE = CHUNK * 512


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH, EMBED, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    bias: float

    def tables(self) -> np.ndarray:
        return np.ascontiguousarray(np.einsum("be,wef->wbf", self.embed, self.filters), np.float32)


def _windows(tables: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Filter responses of the windows that start at bytes 0 to n - 1; data has WIDTH - 1 bytes more."""
    index = data.astype(np.intp)
    out = tables[0].take(index[:n], axis=0)
    for j in range(1, WIDTH):
        out += tables[j].take(index[j : j + n], axis=0)
    return out


def _layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each document starts when each is followed by WIDTH - 1 zero bytes (an empty one has one zero byte more)."""
    length = np.maximum(np.diff(offsets), 1)
    ends = np.cumsum(length + WIDTH - 1)
    return ends - length - (WIDTH - 1), length


def pooled(tables: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, 2 * FILTERS): maximum and mean over each document's chunks; pieces bound the memory."""
    n, f = len(offsets) - 1, tables.shape[2]
    at, length = _layout(offsets)
    padded = np.zeros(int(length.sum()) + n * (WIDTH - 1), np.uint8)
    where = np.arange(len(data)) + np.repeat(at - offsets[:-1], np.diff(offsets))
    padded[where] = data
    count = -(-length // CHUNK)
    chunk_doc = np.repeat(np.arange(n), count)
    first = np.cumsum(count) - count
    chunk_at = np.repeat(at, count) + (np.arange(len(chunk_doc)) - np.repeat(first, count)) * CHUNK
    chunk_len = np.minimum(CHUNK, np.repeat(at + length, count) - chunk_at)
    top = np.empty((len(chunk_doc), f), np.float32)
    i = 0
    while i < len(chunk_at):
        j = max(i + 1, int(np.searchsorted(chunk_at, chunk_at[i] + _PIECE)))
        lo, hi = chunk_at[i], chunk_at[j - 1] + chunk_len[j - 1]
        got = _windows(tables, padded[lo : hi + WIDTH - 1], hi - lo)
        got = np.concatenate([got, np.full((1, f), -np.inf, np.float32)])
        edges = np.stack([chunk_at[i:j] - lo, chunk_at[i:j] + chunk_len[i:j] - lo], 1).ravel()
        top[i:j] = np.maximum.reduceat(got, edges, axis=0)[::2]  # what lies between two documents falls away
        i = j
    mean = np.add.reduceat(top, first, axis=0) / count[:, None]
    return np.concatenate([np.maximum.reduceat(top, first, axis=0), mean], 1)


def _activate(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return np.tanh(np.maximum(x + np.tile(shift, 2), 0))


def probability(net: Network, features: np.ndarray) -> np.ndarray:
    z = _activate(features, net.shift) @ net.weights + net.bias
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.step, self.kept = rate, 0, {}

    def __call__(self, name: str, x: np.ndarray, g: np.ndarray) -> None:
        m, v = self.kept.setdefault(name, (np.zeros_like(x), np.zeros_like(x)))
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)


def train(texts: list[bytes], y: np.ndarray, *, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 3) -> Network:
    """Adam on the log loss over whole texts. Backward passes touch the winning windows only."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.4, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
    net.bias = float(np.log(share / (1 - share)))
    bias, adam = np.array([net.bias]), _Adam(rate)
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            adam.step += 1
            n = len(part)
            tables = net.tables()
            rows, win_at, tops, tap = [], [], [], []
            for d, i in enumerate(part):
                raw = np.frombuffer(texts[i] + bytes(max(0, 1 - len(texts[i])) + WIDTH - 1), np.uint8)
                for lo in range(0, len(raw) - WIDTH + 1, _PIECE):
                    own = _windows(tables, raw[lo : lo + _PIECE + WIDTH - 1], min(_PIECE, len(raw) - WIDTH + 1 - lo))
                    for s in range(0, len(own), CHUNK):
                        w = own[s : s + CHUNK].argmax(0)
                        tops.append(own[s + w, np.arange(FILTERS)])
                        tap.append(raw[(lo + s + w)[:, None] + np.arange(WIDTH)])
                        rows.append(d)
            rows, top, tap = np.array(rows), np.array(tops, np.float64), np.array(tap)  # (chunks, F), (chunks, F, WIDTH)
            count = np.bincount(rows, minlength=n)
            first = np.cumsum(count) - count
            best = np.maximum.reduceat(top, first, axis=0)
            mean = np.add.reduceat(top, first, axis=0) / count[:, None]
            x = np.concatenate([best, mean], 1)
            a = _activate(x, net.shift)
            p = 1 / (1 + np.exp(-np.clip(a @ net.weights + bias[0], -30, 30)))
            d = (p - y[part]) / n
            dx = d[:, None] * net.weights * (1 - a * a) * (x + np.tile(net.shift, 2) > 0)
            g_shift = dx.sum(0).reshape(2, FILTERS).sum(0)
            wins = (top == best[rows]) & (np.cumsum(top == best[rows], 0) - np.repeat((np.cumsum(top == best[rows], 0) - (top == best[rows]))[first], count, axis=0) == 1)
            d_top = dx[rows, :FILTERS] * wins + dx[rows, FILTERS:] / count[rows][:, None]
            g_filters, g_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
            for j in range(WIDTH):
                e = net.embed[tap[:, :, j]]  # (chunks, F, E)
                g_filters[j] = np.einsum("cf,cfe->ef", d_top, e)
                np.add.at(g_embed, tap[:, :, j], d_top[:, :, None] * net.filters[j].T)
            g_w, g_b = a.T @ d + 1e-4 * net.weights, np.array([d.sum()])
            for name, v, g in (("e", net.embed, g_embed), ("f", net.filters, g_filters), ("s", net.shift, g_shift), ("w", net.weights, g_w), ("b", bias, g_b)):
                adam(name, v, g)
    net.bias = float(bias[0])
    return net


def fit(rows: DataFrame, **options) -> Network:
    """Trains on (text, label 0 or 1) rows, a bounded sample; their texts come to the driver. Null texts count as empty."""
    got = rows.selectExpr("coalesce(text, '') AS text", "label").toArrow()
    return train([t.encode() for t in got["text"].to_pylist()], got["label"].to_numpy().astype(float), **options)


def score(docs: DataFrame, net: Network, keys: list[str], name: str = "quality") -> DataFrame:
    """The key columns and `name` (quality, 0 to 1) of every row, over whole texts; a null text counts as empty. No shuffle."""
    conf_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for b in small_batches(batches, "text", 2 << 20):
            p = probability(net, pooled(tables, *flat(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [pa.array(p)], [*keys, name])

    rows = docs.select(*dict.fromkeys([*keys, "text"]))
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{name}` double")
