"""The corpus operators against plain Python: long words and runs, edit bounds, indexes over several calls, scores, recall."""

import base64
import glob
import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barlab.llm import ann, bpe, decontaminate, line_dedup, quality, queries, simhash, substring_dedup, toxicity, words as cut
from barlab.llm.common import scratch

DOCS = "doc_id long, text string"


def words(n, seed=0, letters="abcdefghij"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=5)) for _ in range(n))


def test_words_are_cut_as_the_pattern_cuts(monkeypatch):
    import regex

    find, r = regex.compile(cut.PATTERN).findall, random.Random(2)
    alphabet = list("ab s't'm're'll'd've 12'\n\t  .,!é中 　 \x1c🙀٣'lsrev")
    for piece in (1 << 19, 48):
        monkeypatch.setattr(cut, "PIECE", piece)
        for _ in range(400):
            texts = ["".join(r.choices(alphabet, k=r.randrange(40))) for _ in range(r.randrange(1, 6))]
            raw = [t.encode() for t in texts]
            off = np.append(0, np.cumsum([len(b) for b in raw])).astype(np.int64)
            data = np.frombuffer(b"".join(raw), np.uint8)
            starts = cut.word_starts(data, off)
            ends = np.append(starts[1:], len(data))[: len(starts)]
            assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == [w for t in texts for w in find(t)]


def test_bpe_of_very_long_words(spark):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    v, r = queries.vocabulary(), random.Random(4)
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    mixed = base64.b64encode(r.randbytes(150_000)).decode().replace("+", "A").replace("/", "B")
    rows = [(1, mixed), (2, "ab" * 3000), (3, "".join(r.choices("0123456789", k=1500))), (4, "中文字符测试" * 200), (5, "'s" * 300), (6, None), (7, " x" * 95 + "y" * 96)]
    for size in (0, 1000):
        got = bpe.decode(bpe.encode(spark.createDataFrame(rows, DOCS), v, keep=["doc_id"], dictionary_words=size), v).collect()
        for x in got:
            text = dict(rows)[x.doc_id] or ""
            assert list(x.ids) == enc.encode_ordinary(text) and bytes(x.decoded).decode() == text, x.doc_id


def test_bpe_of_one_unbroken_letter(spark):
    v = queries.vocabulary()
    x = bpe.decode(bpe.encode(spark.createDataFrame([(1, "a" * 100_000)], DOCS), v, keep=["doc_id"]), v).first()
    assert bytes(x.decoded) == b"a" * 100_000 and len(x.ids) < 100_000


def test_decontamination_survives_long_runs(spark):
    item = "if one crate holds 12 apples then how many apples do 12 such crates hold when none of them is lost"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "Alpha " * 100_000 + item), (2, ".".join(["1"] * 100_000) + " " + item.replace("12", "7")), (3, "Alpha " * 100_000), (4, "1" * 200_000 + "." * 200_000), (5, "Äx" * 100_000)]
    got = {r.doc_id: r["items"] for r in decontaminate.judge(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert got == {1: "1", 2: "1", 3: "", 4: "", 5: ""}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_equals_edit_distance(spark, edits):
    r, lines = random.Random(edits), []
    for g in range(14):
        base = words(r.choice([6, 10, 12, 15]), g, "abcd").split()
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(4)):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1])] = r.choice([[], ["new%d" % r.randrange(3)], ["new%d" % r.randrange(3)]])
            lines.append(" ".join(w) or "none")
    r.shuffle(lines)
    rows = [(i // 4, []) for i in range(0, len(lines), 4)]
    for i, line in enumerate(lines):
        rows[i // 4][1].append(line)
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in rows], DOCS)
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup(df, edits=edits).collect()}
    seen, want = [], {}
    for d, own in rows:
        kept = []
        for line in own:
            w = line.split()
            gone = any(w == s or (len(w) >= 10 and len(s) >= 10 and distance(w, s) <= edits) for s in seen)
            seen.append(w)
            if not gone:
                kept.append(line)
        want[d] = ("\n".join(kept), len(own) - len(kept))
    assert got == want and sum(n for _, n in want.values()) > 10


def test_substring_index_over_calls_and_compaction(spark):
    shared, r = [words(80, 90 + i).split() for i in range(3)], random.Random(6)
    texts = {}
    for d in range(1, 43):
        w = words(r.randrange(0, 150), d).split()
        at = r.randrange(len(w) + 1)
        texts[d] = w[:at] + (shared[d % 3][r.randrange(10) :] if d % 4 == 0 else []) + w[at:]
    texts[20] = texts[2] + texts[3]  # anchors that had one document until now
    rows = [(d, " ".join(w)) for d, w in texts.items()]
    path, got = scratch(spark), {}
    for call in range(6):
        index = substring_dedup.Index(spark, path, buckets=4, most_runs=2)
        part = [x for x in rows if (x[0] - 1) // 7 == call]
        past = [x for x in rows if (x[0] - 1) // 7 < call]
        history = spark.createDataFrame(past, DOCS) if past else None
        got |= {x.doc_id: x for x in substring_dedup.dedup(spark.createDataFrame(part, DOCS), batches=1 + call % 2, index=index, history=history).collect()}
        assert all(sum(k == kind for k, _ in index.runs) <= 2 for kind in index.KINDS)
    held = {run for _, run in index.runs}
    assert {Path(p).name for p in glob.glob(f"{path}/barlab_*")} == held  # what compaction replaced is gone
    assert held <= {t.name for t in spark.catalog.listTables()}
    index.close()
    assert not held & {t.name for t in spark.catalog.listTables()}
    first = {}
    for d, w in sorted(texts.items()):
        gone = set()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), d


def test_runs_are_merge_joined_as_they_lie(spark):
    index, want = substring_dedup.Index(spark, scratch(spark), buckets=8), {}
    for call in range(2):
        rows = [(h, h * 10 + call, False) for h in range(call, 400, call + 2)]
        want |= {h: min(d, want.get(h, d)) for h, d, _ in rows}
        index.commit(anchors=spark.createDataFrame(rows, substring_dedup.Index.KINDS["anchors"][0]))
    own = spark.range(500).withColumnRenamed("id", "hash").groupBy("hash").agg(F.count("*").alias("n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with index.in_order():
            out = index.beside("anchors", own)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert {r.hash: r.known for r in out.collect()} == {h: want.get(h) for h in range(500)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One exchange and one sort, those of the new rows; none between a run's scan and its join.
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1 and plan.count("+- Sort ") + plan.count(":- Sort ") == 1, plan
    index.close()


def test_toxicity_score_is_the_pair_sum_and_screens_neutral_terms(spark):
    r = random.Random(3)
    two = [" ".join([x, y, *r.choices(["ee", "ff", "gg"], k=2)]) for _ in range(300) for x, y in [r.choice([("aa", "bb"), ("aa", "dd"), ("cc", "bb"), ("cc", "dd")])]]
    label = [int(("aa" in t) == ("bb" in t)) for t in two]  # each term alone says nothing
    fit = toxicity.fit(spark.createDataFrame(list(zip(two, label)), "text string, label int"))
    got = {x.text: x.toxicity for x in toxicity.score(spark.createDataFrame([(t,) for t in {*two, "aa", "zz", ""}], "text string"), fit, ["text"]).collect()}
    for text, score in got.items():
        terms = {int(b) for b in toxicity._buckets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[1]}
        at = [i for i, t in enumerate(fit.terms) if int(t) in terms]
        z = fit.bias + sum(fit.linear[i] for i in at) + sum(float(fit.factors[i] @ fit.factors[j]) for n, i in enumerate(at) for j in at[:n])
        assert abs(score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
    assert sum((got[t] >= 0.5) == y for t, y in zip(two, label)) >= 0.95 * len(two)


def test_quality_is_the_naive_convolution(spark):
    rng = np.random.default_rng(1)
    net = quality.Network(rng.normal(0, 0.5, (256, quality.EMBED)), rng.normal(0, 0.4, (quality.WIDTH, quality.EMBED, quality.FILTERS)), rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 0.3, 2 * quality.FILTERS), 0.1)
    texts = ["", "a", "naïve text", words(200, 1), words(120, 2) + "é" * 700]
    got = {x.doc_id: x.quality for x in quality.score(spark.createDataFrame(list(enumerate(texts)), DOCS), net, ["doc_id"]).collect()}
    for d, text in enumerate(texts):
        raw = text.encode() or b"\0"
        padded = raw + bytes(quality.WIDTH - 1)
        own = [sum(net.embed[padded[i + j]] @ net.filters[j] for j in range(quality.WIDTH)) for i in range(len(raw))]
        tops = np.array([np.max(own[s : s + quality.CHUNK], axis=0) for s in range(0, len(own), quality.CHUNK)])
        x = np.concatenate([tops.max(0), tops.mean(0)])
        z = np.tanh(np.maximum(x + np.tile(net.shift, 2), 0)) @ net.weights + net.bias
        assert abs(got[d] - 1 / (1 + math.exp(-z))) < 1e-5


def test_fingerprints_by_hand():
    for text in ("", " \n", "One", "one TWO", "a b c", words(40, 1), words(40, 1).upper() + "\x0b x"):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        assert simhash.fingerprint(text.encode()) == want


def test_recall_over_several_shards_at_registered_settings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect() if r.embedding is not None}
    good = {k: v for k, v in rows.items() if len(v) and np.isfinite(v).all() and v.any()}
    ids, x = np.array(list(good)), np.stack(list(good.values()))
    got = ann.nearest(vectors, vectors.vec_id % 100 == 0, shard_rows=400).collect()
    hit = total = 0
    for q in (i for i in ids if i % 100 == 0):
        d = np.sqrt(((x - good[q]) ** 2).sum(1))
        want = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hit, total = hit + len(set(want) & {r.vec_id for r in got if r.query_id == q}), total + 10
    assert total and hit / total >= 0.9


def test_pipeline_keeps_columns_that_clash_and_rows_without_id(spark):
    import corpus_pipeline

    rows = [(1, words(40, 1)), (None, words(40, 2)), (2, words(40, 3) + "\n" + words(12, 9)), (3, words(40, 4) + "\n" + words(12, 9))]
    d = spark.createDataFrame(rows, DOCS).selectExpr("*", "7 AS n_items", "'i' AS items", "8 AS n_lines", "9 AS n_removed", "0.5D AS toxicity", "'t' AS _text", "'g' AS _gone", "1 AS label", "2 AS n_chars", "3 AS _t", "4 AS _d", "5 AS _u", "6 AS `a.b`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "/root/testdata/sf0.001")
        assert out.columns == d.columns
        assert {(r._t, r._d, r._u, r["a.b"]) for r in out.collect()} == {(3, 4, 5, 6)}
        d = spark.createDataFrame(out.collect(), out.schema)
    got = d.collect()
    assert {(r.n_items, r["items"], r.n_lines, r.n_removed, r.toxicity, r._text, r._gone, r.label) for r in got} == {(7, "i", 8, 9, 0.5, "t", "g", 1)}
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got) == sorted([(False, 1, words(40, 1)), (False, 2, rows[2][1]), (False, 3, words(40, 4)), (True, None, words(40, 2))], key=lambda x: (x[0], x[1] or 0))
