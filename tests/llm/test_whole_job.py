"""Cases in which an operator once did less than the whole job."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from barlab.llm import bpe, decontaminate, near_dedup, toxicity

DOCS = "doc_id long, text string"


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_labels(rows):
    """doc_id -> the least doc_id of its component under exact Jaccard >= 0.8."""
    sets, label = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}
    alike = lambda a, b: a == b or (a and b and len(a & b) * 5 >= len(a | b) * 4)
    pairs, changed = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])], True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_near_dedup_equals_jaccard_brute_force(spark):
    r, rows, passage = random.Random(5), [], words(30, 77)
    for g in range(12):
        base = words(r.choice([8, 40, 90, 300]), g).split()
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 12)):
                w[r.randrange(len(w))] = "x%d" % r.randrange(1000)
            rows.append((len(rows), " ".join(w)))
    rows += [(200 + i, passage + " " + words(r.choice([4, 6, 8, 60]), 500 + i)) for i in range(12)]
    rows += [(300, None), (301, ""), (302, "one Two"), (303, "One two"), (304, rows[0][1].upper())]
    label = near_labels(rows)
    assert 20 < len(set(label.values())) < len(rows) - 20
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n", "'x' AS node", "2 AS t", "3 AS c")
    got = near_dedup.keep_first(df)
    assert got.columns == df.columns and sorted(x.doc_id for x in got.collect()) == sorted(set(label.values()))
    assert near_dedup.keep_first(df.limit(0)).count() == 0


def test_near_dedup_judges_rows_not_ids(spark):
    a, b, c = words(40, 1), words(40, 2), words(40, 3)
    rows = [(None, a), (None, b), (1, b), (2, c), (2, words(40, 4)), (2, c), (None, a), (3, c + " more"), (None, None), (4, "")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n", "'x' AS stays")
    got = near_dedup.keep_first(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, a), (1, b), (2, c), (2, words(40, 4)), (4, "")], key=str)


def test_near_dedup_finds_common_shingles_at_any_size(spark):
    """Passages of 64 documents each come last in the order, however many documents there are besides; one set's copies don't count."""
    passage = lambda g: " ".join(f"p{g}x{i}" for i in range(5))
    held = [(f"{passage(g)} own{g} of{i}",) for g in range(50) for i in range(64)] + [("alone " + passage(99),)] * 64
    rows = spark.createDataFrame(held, "text string").union(spark.range(250_000).selectExpr("concat_ws(' ', 'a' || id, 'b' || id, 'c' || id, 'd' || id, 'e' || id)"))
    found = set(np.ravel(near_dedup._common(rows.select(near_dedup._same_text().alias("t"), "text"))[0]).tolist())
    assert sum(near_dedup.shingles(passage(g))[0] in found for g in range(50)) >= 48
    assert not found & set(near_dedup.shingles(held[-1][0]).tolist())
    assert len(near_dedup._common(rows.select(near_dedup._same_text().alias("t"), "text"), most=10)[0]) < 50


def test_decontamination_looks_at_every_copy(spark):
    item = "if one crate holds 12 apples then how many apples do 12 such crates hold when none of them is lost"
    odd = item.replace("12 apples", "30 apples").replace("12 such", "45 such")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, odd + " . " + item), (2, odd), (3, odd + " . " + words(20, 1) + " " + odd), (4, odd + " . " + odd + " . " + item.replace("12", "7")), (5, item + " . " + odd)]
    got = {r.doc_id: r["items"] for r in decontaminate.judge(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert got == {1: "1", 2: "", 3: "", 4: "1", 5: "1"}


def test_decontamination_by_any_case_and_context(spark):
    tom = "Tom has 5 apples. Tom buys 3 more apples at the market. Tom gives half of them to a friend. How many apples does Tom have left"
    bench = spark.createDataFrame([(1, tom), (2, "What is the capital of France"), (3, "Name two Noble gases"), (4, "why does Alice own the old mill")], "item_id long, text string")
    anna = tom.replace("Tom", "Anna").replace("5", "7").replace("3", "4")
    rows = [
        (1, "Some page. " + anna + "?"), (2, "Question: What is the capital of France?"), (3, "well, name two noble gases now"), (4, "WHY DOES ALICE OWN THE OLD MILL"),
        (5, "Berlin is the capital of Germany"), (6, "name the noble gases"), (7, anna.replace("Anna buys", "Bob buys")), (8, "about this: " + anna.replace(". ", " . ")), (9, words(30, 2)),
    ]
    got = {r.doc_id: r["items"] for r in decontaminate.judge(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert got == {1: "1", 2: "2", 3: "3", 4: "4", 5: "", 6: "", 7: "", 8: "1", 9: ""}


class Arrow:
    """Stands for a DataFrame that comes to the driver as this Arrow table."""

    def __init__(self, table):
        self.table, self.sparkSession = table, None

    select = mapInArrow = lambda self, *_: self

    def toArrow(self):  # noqa: N802
        return self.table


def peak(run):
    """Bytes that Python and numpy took at most while run ran."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_toxicity_fit_takes_little_of_the_driver(monkeypatch):
    """The largest sample, with as many terms as documents of some KB have."""
    monkeypatch.setattr(toxicity, "conf_batches", lambda _: None)
    rng = np.random.default_rng(3)
    y = (rng.random(6000) < 0.2).astype(np.int32)
    lists = [np.unique(np.append(rng.zipf(1.3, 700) % (1 << toxicity.BITS), [7777] * k)) for k in y]
    terms = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(t) for t in lists])), pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
    fitted = []
    assert peak(lambda: fitted.append(toxicity.fit(Arrow(pa.table({"label": pa.array(y), "terms": terms})), epochs=5))) < 60e6
    assert 7777 in fitted[0].terms


def test_bpe_dictionary_takes_little_of_the_driver(monkeypatch):
    """Some 100 bytes a word, in batches as Spark sends them; every word is found with its ids."""
    v = bpe.Vocabulary({bytes([b]): b for b in range(256)}, "")
    table = pa.table({"key": [f"word{i}é" for i in range(200_000)], "value": pa.array([[i, 1, 2] for i in range(200_000)], pa.list_(pa.int32()))})
    monkeypatch.setattr(bpe, "frequent_words", lambda *_: Arrow(pa.Table.from_batches(table.to_batches(1000))))
    made = []
    assert peak(lambda: made.append(bpe.dictionary(None, v, 1 << 20))) < 28e6
    raw = np.frombuffer("word70000éa".encode(), np.uint8)
    at = made[0].find(*bpe.span_hashes(raw, np.array([0, 11]), np.array([11, 12])))
    assert [made[0].ids[made[0].first[k] : made[0].first[k + 1]].tolist() for k in at] == [[70_000, 1, 2], [97]]


def test_bpe_makes_its_rank_map_once(spark, monkeypatch):
    v = bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"ab": 256}, r"\p{L}+|\P{L}+")
    made, of = [], bpe.RankMap.of.__func__
    monkeypatch.setattr(bpe.RankMap, "of", classmethod(lambda cls, *a: made.append(a) or of(cls, *a)))
    got = bpe.encode(spark.createDataFrame([(1, "abab cab"), (2, None), (2, "abab")], DOCS), v, keep=["doc_id"]).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == [(1, [256, 256, 32, 99, 256]), (2, []), (2, [256, 256])] and len(made) == 1
