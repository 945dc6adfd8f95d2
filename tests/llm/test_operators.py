"""Edge cases of the corpus operators: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from barlab.llm import ann, bpe, chat_format, decontaminate, line_dedup, quality, queries, simhash, substring_dedup, toxicity, url_filter
from barlab.llm.components import components

DOCS = "doc_id long, text string"


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS count", "'x' AS fp", "2 AS label", "'y' AS component", "3 AS n_items") if extra else df


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n))


def test_url_rules_and_vocabulary(spark):
    rows = [
        (1, "http://A.Example.com/en/7x", "allow", "example.com/en/7"), (2, "https://x.com/en/1", "block", "com/en/"), (3, None, "allow", None), (4, "no scheme", "allow", None), (5, "", "allow", None),
        (6, "http://my-casino.io/", "block", None), (7, "http://casinos.io/", "allow", None), (8, "http://cheap.io/win", "block", None), (9, "http://cheap.io/cheap", "allow", None), (1, "http://A.Example.com/en/7x", "allow", "example.com/en/7"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").selectExpr("*", "'clash' AS host", "0 AS verdict", "1 AS _hits")
    got = url_filter.filter_urls(df, queries.URL_RULES).collect()
    assert sorted((r.page_id, r.verdict, r.rule) for r in got) == sorted(((r[0], r[2], r[3]) for r in rows), key=lambda r: (r[0], r[1], r[2]))
    assert {r.host for r in got if r.page_id == 1} == {"a.example.com"} and {r._hits for r in got} == {1}
    assert url_filter.filter_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_url_rules_of_the_contract(spark):
    rows = [
        ("http://net/de/1", "allow", "net/de/"), ("http://porn.net/de/", "allow", "net/de/"), ("http://a.example.net/de/81", "block", "example.net/de/8"), ("http://example.net/de/8", "block", "example.net/de/8"),
        ("http://example.net/de/7", "allow", "net/de/"), ("http://example.com/en/6", "block", "com/en/"), ("http://example.com/en/7", "allow", "example.com/en/7"), ("http://x.org/es/9", "block", "org/es/"), ("http://x.org/de/8", "allow", None),
    ]
    got = url_filter.filter_urls(spark.createDataFrame([r[:1] for r in rows], "url string"), queries.URL_RULES).collect()
    assert sorted((r.url, r.verdict, r.rule) for r in got) == sorted(rows, key=lambda r: r[0])


def test_chat_round_trip(spark):
    said = "a<|im_end|>\n<\\|x <"
    rows = [(1, 0, "user", said), (1, 1, "assistant", "|im_end|> ok\\"), (1, 1, "assistant", None), (2, None, None, ""), (None, 0, "a\nb%<", "x" * 3_000_000), (2, 5, "assistant", "é" * 10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'z' AS formatted")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_conversations(df)).collect()}
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == h(f"user\n{said}\nassistant\n\nassistant\n|im_end|> ok\\\n") and got[1].loss_sha256 == h("|im_end|> ok\\")
    assert got[2].n_turns == 2 and got[2].loss_chars == 10 and got[None].turns_sha256 == h("a\nb%<\n" + "x" * 3_000_000 + "\n")
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_toxicity_learns_pairs_and_words(spark):
    r = random.Random(1)
    rows = [(i, words(30, i) + (" idiot" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    fit = toxicity.fit(spark.createDataFrame(rows, DOCS + ", label int").drop("doc_id"))
    test = docs(spark, [(1, "You IDIOT!! " + words(20000, 9)), (2, words(50, 5)), (3, None), (4, ""), (1, "You IDIOT!! " + words(20000, 9))], True)
    got = [(x.doc_id, x.toxicity >= 0.7) for x in toxicity.score(test, fit, ["doc_id", "count"]).collect()]
    assert sorted(got) == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    none = toxicity.fit(spark.createDataFrame([], "text string, label int"))
    assert toxicity.score(test.limit(0), none, ["doc_id"]).count() == 0
    # a pair that only counts together
    two = [(" ".join(r.sample(["aa", "bb", "cc", "dd", "ee"], 3)),) for _ in range(800)]
    two = [(t, int("aa" in t and "bb" in t)) for (t,) in two]
    pair = toxicity.fit(spark.createDataFrame(two, "text string, label int"), least_z=2.0)
    both = {x.doc_id: x.toxicity for x in toxicity.score(docs(spark, [(1, "aa bb cc"), (2, "aa dd cc"), (3, "bb ee dd")]), pair, ["doc_id"]).collect()}
    assert both[1] > 0.7 and both[2] < 0.5 and both[3] < 0.5


def test_quality_covers_whole_texts(spark):
    rng = np.random.default_rng(0)
    texts = [words(40, i).encode() + (b" %%%##" if i % 2 else b"") for i in range(200)]
    net = quality.train(texts, np.array([1.0 - i % 2 for i in range(200)]), epochs=8)
    test = docs(spark, [(1, words(60, 999)), (2, words(60, 998) + " %%%##"), (3, None), (4, ""), (5, words(200_000, 3))], True)
    got = {r.doc_id: r.quality for r in quality.score(test, net, ["doc_id"]).collect()}
    assert got[1] > 0.7 > got[2] and got[3] == got[4] and all(0 <= v <= 1 for v in got.values())
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    whole = quality.pooled(net.tables(), data, np.array([0, 10, 10, 5000]))
    one = quality.pooled(net.tables(), data[10:], np.array([0, 4990]))
    assert np.allclose(whole[2], one[0])
    windows = quality._windows(net.tables(), np.append(data[10:], np.zeros(3, np.uint8)), 4990)
    assert np.allclose(one[0][: quality.FILTERS], windows.max(0), atol=1e-4)


def test_simhash_groups_equal_brute_force(spark):
    base = [words(60, i) for i in range(6)]
    rows = [(i, base[i % 6] + (" extra" if i % 4 == 0 else "")) for i in range(40)] + [(100, None), (101, ""), (102, " \t"), (103, "one"), (3, base[3])]
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_groups(docs(spark, rows, True)).collect()}
    fp = {d: simhash.fingerprint((t or "").encode()) for d, t in rows}
    label = {d: d for d in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if bin(fp[a] ^ fp[b]).count("1") <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert {d: c for d, (_, c) in got.items()} == label
    assert simhash.near_groups(docs(spark, rows).limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_first(docs(spark, rows, True)).collect()) == sorted(set(label.values()))


def test_simhash_anchors_cover_and_crowds_stay_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 63), 1 << 63, 200, dtype=np.int64)
    for _ in range(50):
        a, b = rng.integers(0, 64, 2)
        y = x ^ np.int64((1 << int(a)) - (1 << 64) if a == 63 else 1 << int(a)) ^ np.int64((1 << int(b)) - (1 << 64) if b == 63 else 1 << int(b))
        for u, v in zip(x[:20], y[:20]):
            mine, its = simhash.anchors(np.array([u]))[1], simhash.anchors(np.array([v]))[1]
            assert set(mine) & set(its)
    nodes = spark.createDataFrame([(int(v),) for v in range(40)], "fp long")
    few, many = (components(simhash.links(nodes, crowded=c)).groupBy("component").count().collect() for c in (256, 3))
    assert few == many


def test_bpe_decoding_takes_no_copy_for_each_id(spark):
    v = queries.vocabulary()
    many = list(range(0, 40_000)) * 4
    rows = [(1, many), (2, []), (3, None), (4, [5, 10_000_000, -1, None, 7])]
    by_id = {r: t for t, r in v.ranks.items()}
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), v).collect()}
    assert got == {1: b"".join(by_id[i] for i in many), 2: b"", 3: None, 4: by_id[5] + by_id[7]}
    plan = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), v)._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 1  # over runs of ids, none over the ids of a run


def test_bpe_equals_the_library(spark):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    v = queries.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rows = [(1, "Hello  world's  naïve 日本語 12345\n\n\t x"), (2, None), (3, ""), (4, "a" * 700), (5, "abcd" * 60 + "!?" * 90), (6, words(300)), (6, words(300)), (7, "\x00ǅ🙂" * 3)]
    got = bpe.decode(bpe.encode(docs(spark, rows, True), v, keep=["doc_id"], dictionary_words=50), v).collect()
    want = {d: enc.encode_ordinary(t or "") for d, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == want[r.doc_id] and bytes(r.decoded).decode() == (dict(rows)[r.doc_id] or "")
    assert bpe.encode(docs(spark, rows).limit(0), v, keep=["doc_id"]).count() == 0


def test_line_dedup(spark):
    line = words(12, 1)
    other = " ".join(w if i != 5 else "changed" for i, w in enumerate(line.split()))
    shorter = " ".join(line.split()[:-1])
    far = " ".join(w if i not in (2, 5) else "changed" for i, w in enumerate(line.split()))
    rows = [(1, f"{line}\n\nshort one"), (2, f"{other}\n{shorter}\nshort two"), (3, f"short  one\n{far}"), (4, None), (5, ""), (6, line), (6, line), (None, line)]
    got = {}
    for r in line_dedup.dedup(docs(spark, rows, True)).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[1] == [f"{line}\n\nshort one"] and got[2] == ["short two"] and got[4] == [None] and got[5] == [""] and got[6] == ["", ""] and got[None] == [line]
    assert got[3] == [""]  # `far` is one edit from `other`, which is earlier though removed
    assert line_dedup.dedup(docs(spark, rows).limit(0)).count() == 0


def test_substring_dedup_equals_brute_force(spark):
    shared, r = words(70, 7).split(), random.Random(3)
    texts = {i: words(r.randrange(0, 160), i).split() for i in range(1, 30)}
    for i in (4, 9, 15, 21):
        at = r.randrange(len(texts[i]) + 1)
        texts[i] = texts[i][:at] + shared[: 49 + i % 3 * 10] + texts[i][at:]
    texts[25] = texts[3] * 2
    rows = [(d, "  ".join(w)) for d, w in texts.items()] + [(40, None), (41, ""), (42, " ".join(texts[4]))]
    got = {x.doc_id: x for x in substring_dedup.dedup(docs(spark, rows, True), batches=3).collect()}
    first = {}
    for d, t in sorted(rows):
        w = (t or "").split()
        gone = set()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), d
    assert substring_dedup.dedup(docs(spark, rows).limit(0)).count() == 0


def test_decontamination_and_slots(spark):
    item = "what does a train that leaves at 10 km per hour from the old town of the river reach after 25 minutes of travel with Alice aboard"
    same = item.replace("10", "17").replace("25", "40").replace("Alice", "Bob Smith")
    twice = "if one crate holds 12 apples then how many apples do 12 such crates hold when none of them is lost"
    odd = twice.replace("12 apples", "30 apples").replace("12 such", "45 such")
    bench = spark.createDataFrame([(1, item), (2, twice), (3, "too short"), (4, None), (None, item)], "item_id long, text string")
    rows = [(1, words(50, 1) + " " + item), (2, words(9, 2) + "\n" + same + " " + words(30, 3)), (3, odd), (4, twice.replace("12", "30")), (5, words(80, 4)), (6, None), (7, ""), (1, words(50, 1) + " " + item)]
    got = {(r.doc_id, r.n_items, r["items"]) for r in decontaminate.judge(docs(spark, rows, True), bench).collect()}
    assert got == {(1, 1, "1"), (2, 1, "1"), (3, 0, ""), (4, 1, "2"), (5, 0, ""), (6, 0, ""), (7, 0, "")}
    assert decontaminate.judge(docs(spark, rows).limit(0), bench).count() == 0
    assert decontaminate.judge(docs(spark, rows), bench.limit(0)).where("n_items > 0").count() == 0


def test_ann_takes_no_unusable_vectors_and_breaks_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:80] = x[50]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0] * 7 + [None]), (1004, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS shard")
    got = ann.nearest(df, df.vec_id % 20 == 0, shard_rows=150).collect()
    hit = total = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10]
        mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        hit, total = hit + len(set(want) & {v for _, v in mine}), total + 10
        if 50 <= q < 80:
            assert [v for _, v in mine] == want.tolist()
    assert hit / total >= 0.9 and not {r.vec_id for r in got} & set(range(1000, 1005))
    assert ann.nearest(df.limit(0), df.vec_id % 20 == 0).count() == 0
    few = df.where("vec_id IN (0, 3)")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few, few.vec_id == 0).collect()] == [(0, 3)]


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    d = docs(spark, [(1, words(40, 1)), (2, words(40, 1)), (3, None), (4, "")]).selectExpr("*", "'en' AS lang", "'s' AS source", "3L AS n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "/root/testdata/sf0.001")
        assert out.columns == d.columns
        d = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(r.doc_id for r in d.collect()) == [1, 2]  # 2, 3 and 4 have no words left: one group
    assert corpus_pipeline.STAGES[-1][1](spark, d, "/root/testdata/sf0.001").count() == 2
