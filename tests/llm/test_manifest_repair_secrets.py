"""Merkle manifest, conversation repair and secret scans against plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from barlab.llm import merkle, repair, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def alike(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def manifest(rows):
    ser = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: h(*(ser(v) for v in (r[0], r[3], r[2], r[4], t)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            a = i // 8 * 8
            out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
            i //= 8
        return out

    langs, trees, out = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())), {}, []
    for g in langs:
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[g] = own, tree([leaf(r, r[1]) for r in own])
    top = tree([trees[g][1][-1][0] for g in langs])
    for k, g in enumerate(langs):
        own, levels = trees[g]
        for i, r in enumerate(own):
            steps, text = path(levels, i) + path(top, k), r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            at = leaf(r, text)
            for a, b in steps:
                at = h(a, at, b)
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], h(*(a + b for a, b in steps)), at, at == top[-1][0]))
    return out


@pytest.mark.parametrize("case", ["odd", "one", "runs", "levels"])
def test_manifest_equals_plain_tree(spark, case):
    r = random.Random(8)
    rows = {
        "odd": [(None, None, None, None, None), (1, "A", "x", None, 1), (1, "A", "x", None, 1), (2, "", "", None, 2), (-5, "Zz", None, "é", 3)] + [(i, f"T{i} É", f"l{i % 70}", "s", i) for i in range(150)],
        "one": [(3, "Only", None, "s", 4)],
        "runs": [(i, "A" * i, f"n{n}", "s", i) for n in (1, 7, 8, 9, 64, 65) for i in range(n)],
        "levels": [(i, "aB"[i % 2] * r.randrange(5), "en", None, i) for i in r.sample(range(2000), 600)],
    }[case]
    alike(merkle.audit(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS place", "'x' AS part", "2 AS total", "'y' AS node")).collect(), manifest(rows))


def test_manifest_of_nothing_and_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    assert merkle.audit(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, f"Text {i}É" if i % 5 else None, [None, "", "en", "de"][i % 4], None if i % 7 == 0 else "s", i) for i in range(90)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    alike(db.execute(merkle.oracle()).fetchall(), manifest(rows))


def test_a_proof_needs_its_siblings_only(spark):
    rows = spark.createDataFrame([("g", i, h(str(i))) for i in range(100)], "part string, id long, node string")
    got = {r.id: r for r in merkle.prove(rows, ["id"], ["id"]).collect()}
    assert len({r.root for r in got.values()}) == 1 and [len(p.left + p.right) // 64 for p in got[99].path] == [3, 4, 1]


STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def repairs(rows):
    """Damage, faults and the cheapest edits by a search over rows and states, keeping the repaired turns."""
    convs, out = {}, []
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    for conv, turns in convs.items():
        left = []
        for c, t, role, text in turns:
            role, text = " " if role is None else role, " " if text is None else text
            hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            left += [(t, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
        left.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), h(f"{len(x[1].encode())}:{x[1]}{x[2]}")))
        at = [x[0] for x in left if x[0] is not None]
        gaps, seen, faults = (max(at) - min(at) + 1 - len(set(at)) if at else 0), set(), []
        for _, role, text in left:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))

        def better(table, q, way):
            if q not in table or way[:2] < table[q][:2]:
                table[q] = way

        def inserted(table):
            for _ in range(2):
                more = dict(table)
                for p, (cost, audit, turns) in table.items():
                    for s, role in (("u", "user"), ("a", "assistant")):
                        if s in STEPS[p]:
                            better(more, STEPS[p][s], (cost + 3, audit + "I", (*turns, role + ":")))
                table = more
            return table

        table = inserted({0: (0, "", ())})
        for (_, role, text), fault in zip(left, faults):
            more = {}
            for p, (cost, audit, turns) in table.items():
                better(more, p, (cost + 4, audit + "D", turns))
                if fault not in ("blank", "duplicate"):
                    extra = 3 * (fault == "truncated")
                    if role[:1] in STEPS[p]:
                        better(more, STEPS[p][role[:1]], (cost + extra, audit + "K", (*turns, f"{role}:{text}")))
                    for s, new in (("u", "user"), ("a", "assistant")):
                        if s in STEPS[p]:
                            better(more, STEPS[p][s], (cost + extra + 3, audit + "R", (*turns, f"{new}:{text}")))
            table = inserted(more)
        cost, audit, turns = min((table[q] for q in (0, 3) if q in table), key=lambda x: x[:2])
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, h("\n".join(turns))))
    return out


def test_repair_equals_search(spark, monkeypatch):
    monkeypatch.setattr(repair, "WIDTH", 8)  # several rounds for a long conversation
    r = random.Random(3)
    said, roles = ["Hi.", "ok", "Yes!", "", "  ", None, "no?  ", "a.", "é..", "b\x1c"], ["user", "assistant", "system", "assistant", "user", "tool", "", None]
    rows = [(r.choice([None, *range(40)]), r.choice([None, *range(12)]), r.choice(roles), r.choice(said)) for _ in range(500)]
    rows += [(77, i // 2, r.choice(roles), r.choice(said)) for i in range(700)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS place", "'x' AS c", "2 AS audit", "3 AS hit", "'y' AS said")
    alike(repair.judge(df).collect(), repairs(rows))


def test_repair_sql_equals_search():
    duckdb = pytest.importorskip("duckdb")
    r, db = random.Random(7), duckdb.connect()
    said, roles = ["Hi.", "ok", "Yes!", "", "  ", None, "a.", "é.."], ["user", "assistant", "system", "tool", "", None]
    rows = [(r.choice([None, *range(40)]), r.choice([None, *range(12)]), r.choice(roles), r.choice(said)) for _ in range(400)]
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    alike(db.execute(repair.oracle()).fetchall(), repairs(rows))


def test_repair_of_lost_conversations_and_of_long_texts(spark):
    lost = [(k, 0, "user", "Gone.") for k in range(400) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    rows = [*lost, (1000, 3, "user", "word " * 200_000 + "end."), (1000, 4, "assistant", "y" * 1_000_000 + "." + " " * 1_000_000)]
    got = repair.judge(spark.createDataFrame(rows, TURNS)).collect()
    assert lost and len(got) == len(lost) + 1
    alike(got, repairs(rows))
    assert repair.judge(spark.createDataFrame([], TURNS)).count() == 0


def test_secrets_base_spans(spark):
    r = random.Random(4)
    bits = ["password", "Passwd", "TOKEN", "api_key", "apikey", "secret", "\"", "'", " ", " : ", "=", ":", "abcdefgh", "x1", "AKIA", "ABCDEF012345", "0123456789abcdef", "é", "\n", "-", "+/", "ſecret", "K", ";"]
    rows = [(i, "".join(r.choices(bits, k=r.randrange(1, 60)))) for i in range(600)] + [(None, None), (1, ""), (1, ""), (9, "é" * 300_000 + " token = abcdefgh1")]
    fold = lambda c: c.lower() if c.isascii() else c
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def brute(text):
        low, found, at = "".join(map(fold, text)), [], 0
        while at < len(text):
            end = None
            for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
                if low.startswith(word, at):
                    j = at + len(word)
                    j += text[j : j + 1] in ("'", '"')
                    while text[j : j + 1] == " ":
                        j += 1
                    if text[j : j + 1] and text[j] in ":=":
                        j += 1
                        while text[j : j + 1] == " ":
                            j += 1
                        j += text[j : j + 1] in ("'", '"')
                        k = j
                        while k < len(text) and text[k] in value:
                            k += 1
                        if k > j:
                            end = k
                            if k - j >= 8:
                                found.append((at, 0, f"assign:{at}:{k}"))
                            break
            at = end or at + 1
        for n, name, start, letters, least in ((1, "access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), (2, "hex", "", "0123456789abcdef", 32)):
            at = 0
            while at < len(text):
                k = at + len(start) if text.startswith(start, at) else at
                while k < len(text) and text[k] in letters and (start == "" or k > at):
                    k += 1
                if k > at + len(start):
                    if k - at >= least:
                        found.append((at, n, f"{name}:{at}:{k}"))
                    at = k
                else:
                    at += 1
        return [x[2] for x in sorted(found)]

    got = secrets.report(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "'x' AS kind")).collect()
    want = []
    for d, t in rows:
        spans = brute(t or "")
        want.append((d, *(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")), h(",".join(spans))))
    alike([r[:5] for r in got], want)
    assert sum(r[1] for r in want) > 50 and sum(r[2] for r in want) > 20 and sum(r[3] for r in want) > 5
    assert all(set(s.split(":")[0] for s in r.spans.split(",") if s) <= set(secrets.KINDS) for r in got)
    assert secrets.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text, secret", [
    ('db_pass = "hunter2$$abc"', "hunter2$$abc"), ('x = "Zk9!s8dKq2"\npassword = x', "Zk9!s8dKq2"), ('A = "abc9Kd0q"\nB = A + "77zz"\nclientSecret = B', "abc9Kd0q"),
    ('{"private_key": "q8#Lm2!vv0Z"}', "q8#Lm2!vv0Z"), ("export DB_PWD=${RAW}\nRAW=p9Kx02mmQ1", "p9Kx02mmQ1"), ("<password>hunter22X</password>", "hunter22X"), ("Authorization: Bearer abcD1234efgh", "abcD1234efgh"),
    ('obj["api_key"] = decode("c2VjcmV0MTIz")', "c2VjcmV0MTIz"), ("login: bob\ndb:\n  pwd: 'T0p&Secr3t!'", "T0p&Secr3t!"),
])
def test_literals_that_reach_sensitive_names(text, secret):
    assert secret in [text[a:b] for kind, a, b, _, _ in secrets.scan(text) if kind == "named"]


@pytest.mark.parametrize("text", [
    "password_length: 12345678x", 'pass = os.environ["DB_PASSWORD"]', "The pass: somewhere in the hills", 'pwd = "changeme123"', 'x = "Zk9!s8dKq2"\nname = x', "key = value", 'auth = "${AUTH_VALUE}"', "see http://example.org/a?b=c",
    'colour = "#a1b2c3d4e5"', "pin: aaaaaaaaaaaa",
])
def test_other_literals_are_left_alone(text):
    assert not [s for s in secrets.scan(text) if s[0] == "named"]


@pytest.mark.parametrize("piece", ["x=", "token=\"", "a=b+", "a=f(", "<a>", "=`", "a = a\n", "password='x' + "])
def test_lexing_time_is_in_proportion(piece):
    secrets.scan(piece * 100_000)
