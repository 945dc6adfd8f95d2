"""Repair of conversations whose turns are lost, blank, doubled or in the wrong role: weighted interval parsing.

The roles of a sound conversation are `(s?(ua)+)?`: perhaps a system turn, then user and assistant in turn. In
Chomsky normal form the grammar has a nonterminal X[p,q] for each two states of that language's automaton: the
spans of rows whose repair leads from p to q. X[p,q] -> X[p,r] X[r,q] joins neighbouring spans, X[p,q] -> row is
an edit of one row (keep, rerole, delete), and both are closed under insertion of turns. A cell holds the least
(cost, audit) of its nonterminal, the audit being the edits' initials; of spans of equal cost none's audit begins
another's, so the least of two joined spans is the least joined to the least.

As the nonterminals are pairs of states, a repair of a span can be cut at any row: every split gives the same cell.
So the table is filled bottom-up by span length through one split a span: rows, then spans of 2, 4, ... rows up to
`WIDTH`, then spans of WIDTH such spans, and so on, each round dealt out by conversation and span. A conversation of
any length spreads over the tasks; only its audit, one character an edit, is one text at the end. Texts take no part
in the parse: they are read again and joined to the edits of their rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import conf_batches, stored
from barlab.operators.ranks import ordinals

#: Rows, or shorter spans, that one span joins.
WIDTH = 256
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: state -> {role initial: next state}; 0 begins, 1 has seen the system turn, 2 a user turn, 3 an assistant turn.
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
_RULES = [[(PAIRS.index((p, r)), PAIRS.index((r, q))) for r in range(4) if (p, r) in PAIRS and (r, q) in PAIRS] for p, q in PAIRS]

Cell = tuple[int, str] | None
Span = tuple[str, str, int, list[Cell]]
_SPACE = " \t\n\x0b\x0c\r"


def join(a: list[Cell], b: list[Cell]) -> list[Cell]:
    """The cells of two neighbouring spans together."""
    out: list[Cell] = []
    for rules in _RULES:
        best = None
        for i, j in rules:
            x, y = a[i], b[j]
            if x is not None and y is not None:
                cost = x[0] + y[0]
                if best is None or cost < best[0]:
                    best = (cost, x[1] + y[1])
                elif cost == best[0] and (audit := x[1] + y[1]) < best[1]:
                    best = (cost, audit)
        out.append(best)
    return out


def _cells(edits: Iterable[tuple[int, int, int, str]]) -> list[Cell]:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p, q, cost, audit in edits:
        best[p, q] = min(best.get((p, q), (cost, audit)), (cost, audit))
    return [best.get(x) for x in PAIRS]


def _inserted() -> list[Cell]:
    """Turns put in where there is no row; two reach all that can be reached."""
    none = [(p, p, 0, "") for p in STEPS]
    one = [(p, STEPS[p][s], INSERT, "I") for p in STEPS for s in ROLES if s in STEPS[p]]
    two = [(p, q, a + b, x + y) for p, r, a, x in one for r2, q, b, y in one if r == r2]
    return _cells(none + one + two)


CLOSURE = _inserted()


def leaf(initial: str, fault: str) -> list[Cell]:
    """The cells of one row, insertions on both sides included."""
    edits = [(p, p, DELETE, "D") for p in STEPS]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        edits += [(p, STEPS[p][initial], more, "K") for p in STEPS if initial in STEPS[p]]
        edits += [(p, STEPS[p][s], REROLE + more, "R") for p in STEPS for s in ROLES if s in STEPS[p]]
    return join(join(CLOSURE, _cells(edits)), CLOSURE)


def merge(a: Span, b: Span) -> Span:
    return a[0], b[1], a[2] + b[2] + (a[1] + b[0] not in LEGAL), join(a[3], b[3])


def parse(spans: list[Span]) -> Span:
    """Neighbouring spans joined two by two, shorter ones first, until one is left."""
    while len(spans) > 1:
        spans = [merge(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


_SPANS = "c string, span long, first string, last string, illegal long, costs array<long>, audits array<string>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _tables(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _emit(spans: Iterable[tuple[str, int, Span]]) -> Iterator[pa.RecordBatch]:
    names = [n.split()[0] for n in _SPANS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
    flat = ((c, n, x[0], x[1], x[2], [None if y is None else y[0] for y in x[3]], [None if y is None else y[1] for y in x[3]]) for c, n, x in spans)
    return _tables(flat, names, types, 500)


def _first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, str], list[Cell]] = {}

    def span(initial: str, fault: str) -> Span:
        kind = (initial if initial in ("s", "u", "a") else "", fault)
        if kind not in known:
            known[kind] = leaf(*kind)
        return initial, initial, 0, known[kind]

    return _emit((c, n, parse([span(r[2], r[3]) for r in rows])) for (c, n), rows in groupby(_rows(batches), lambda r: r[:2]))


def _next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def spans() -> Iterator[tuple[str, int, Span]]:
        for (c, n), rows in groupby(_rows(batches), lambda r: r[:2]):
            yield c, n, parse([(r[2], r[3], r[4], [None if k is None else (k, a) for k, a in zip(r[5], r[6])]) for r in rows])

    return _emit(spans())


def spans(rows: DataFrame) -> DataFrame:
    """c, cost, audit, illegal of each conversation from its rows (c, place, initial, fault)."""
    level = rows.select("c", F.floor(F.col("place") / WIDTH).alias("span"), "initial", "fault", "place")
    level = level.repartition("c", "span").sortWithinPartitions("c", "span", "place").drop("place")
    level = stored(level.mapInArrow(_first_level, _SPANS))
    while level.where("span > 0").limit(1).count():
        up = level.select("c", F.floor(F.col("span") / WIDTH).alias("up"), "span", "first", "last", "illegal", "costs", "audits")
        up = up.repartition("c", "up").sortWithinPartitions("c", "up", "span").drop("span").withColumnRenamed("up", "span")
        level = stored(up.mapInArrow(_next_level, _SPANS))
    ways = F.array(*(F.struct(F.col("costs")[i].alias("cost"), F.col("audits")[i].alias("audit")) for i in (PAIRS.index((0, q)) for q in FINAL)))
    best = F.array_min(F.filter(ways, lambda w: w["cost"].isNotNull()))
    return level.select("c", best["cost"].alias("cost"), best["audit"].alias("audit"), "illegal")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, step, edit, role, place) of each edit of an audit but deletions; an odd number of turns begins with the system's."""

    def steps() -> Iterator[tuple]:
        for c, audit in _rows(batches):
            place, out = -1, -((len(audit) - audit.count("D")) % 2)
            for i, edit in enumerate(audit):
                place += edit != "I"
                if edit != "D":
                    role = None if edit == "K" else ROLES["ua"[out % 2]]
                    yield c, i, edit, role, None if edit == "I" else place
                    out += 1

    return _tables(steps(), ["c", "step", "edit", "role", "place"], [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()])


def _named(rows: DataFrame) -> DataFrame:
    """rows as c (conv_id as text, null: empty), t (turn likewise), turn, role, text (null: one space) and said, the
    digest of role and text."""
    out = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("t"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    return out.withColumn("said", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def faulted(rows: DataFrame) -> DataFrame:
    """Each row's place in its conversation and its first fault: blank, duplicate, truncated or none ('').

    Rows go by turn, nulls first; ties by role, then by the digest of role and text, so that equal rows are neighbours."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    flags = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    narrow = ordinals(stored(_named(rows).select("c", "t", "turn", "role", "said", flags.alias("state"))), ["c"], ["turn", "role", "said"])
    first = narrow.where("state <> 'blank'").groupBy("c", "said").agg(F.min("place").alias("place")).withColumn("is_first", F.lit(True))
    fault = F.when(F.col("state") == "blank", "blank").when(F.col("is_first").isNull(), "duplicate").otherwise(F.col("state"))
    return stored(narrow.join(first, ["c", "said", "place"], "left").select("c", "t", "turn", "role", "said", "place", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault")))


def repaired(rows: DataFrame, faults: DataFrame, audits: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: c, step (their order), edit, role, text."""
    steps = stored(audits.select("c", "audit").mapInArrow(_walk, "c string, step long, edit string, role string, place long"))
    kept = steps.where("place IS NOT NULL").withColumnRenamed("role", "new").join(faults.select("c", "place", "t", "role", "said"), ["c", "place"])
    texts = _named(rows).select("c", "t", "said", "text").dropDuplicates(["c", "t", "said"])
    kept = kept.join(texts, ["c", "t", "said"]).select("c", "step", "edit", F.coalesce("new", "role").alias("role"), "text")
    return kept.unionByName(steps.where("place IS NULL").select("c", "step", "edit", "role", F.lit("").alias("text")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[tuple]:
        for c, rows in groupby(_rows(batches), lambda r: r[0]):
            h, gap = hashlib.sha256(), b""
            for _, role, text in rows:
                h.update(gap + role.encode() + b":")
                h.update(text.encode())
                gap = b"\n"
            yield c, h.hexdigest()

    return _tables(each(), ["c", "repaired_sha256"], [pa.string(), pa.string()])


def digests(turns: DataFrame) -> DataFrame:
    """c, repaired_sha256: `role:text` of the turns joined by newlines. A digest is sequential, so that a conversation's
    turns pass through one task, a batch at a time."""
    dealt = turns.repartition("c").sortWithinPartitions("c", "step").select("c", "role", "text")
    return dealt.mapInArrow(_digests, "c string, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report on conversations and the turns of the repaired ones.

    rows: conv_id, turn, role, text; nulls in role or text are one space, a null conv_id is a conversation of its own,
    null turns come first and count in no gap. A role that begins with none of s, u, a (an empty one too) can't be
    kept. Repeated rows are duplicates; an empty table gives no rows; other columns have no part. The report: c (conv_id as
    text, null: empty), gaps, blank, duplicate, truncated, illegal, cost, audit. The turns: see `repaired`."""
    conf_batches(rows.sparkSession)
    faults = faulted(rows)
    audits = stored(spans(faults))
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = faults.groupBy("c").agg(span.alias("gaps"), *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
    return counts.join(audits, "c"), repaired(rows, faults, audits)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after the trial damage by crc32(`conv_id:turn`) % 20, nulls as one space: 0 drops a row, 1 empties its
    text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("hit"))
    rows = rows.where("hit <> 0").withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def judge(conversations: DataFrame) -> DataFrame:
    """Every conv_id with the report on its damaged rows and the digest of their repair; where the damage leaves no
    row: zeros, an empty audit and the digest of an empty text."""
    report, turns = repair(damage(conversations))
    c = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("c", c)
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long")).cast("long").alias(n)
    return every.join(report, "c", "left").join(digests(turns), "c", "left").select(
        "conv_id", *(zero(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def oracle() -> str:
    """The same in DuckDB SQL: the least way to each state, row by row, in a recursive query."""
    byte = "list_reduce(range(8), lambda c, b: xor(c >> 1, 3988292384 * (c & 1)), xor(a & 255, x))"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    crc = f"xor(list_reduce(list_transform(string_split({key}, ''), lambda d: CAST(ord(d) AS BIGINT)), lambda a, x: xor(a >> 8, {byte}), 4294967295), 4294967295)"
    space = " || ".join(f"chr({ord(c)})" for c in _SPACE)
    steps = ", ".join(f"({p}, '{s}', {q})" for p, to in STEPS.items() for s, q in to.items())
    closure = ", ".join(f"({p}, {q}, {cell[0]}, '{cell[1]}')" for (p, q), cell in zip(PAIRS, CLOSURE) if cell)
    way = lambda cost, audit: f"lpad(CAST({cost} AS VARCHAR), 9, '0') || ':' || {audit}"
    return f"""WITH RECURSIVE hit AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS hit FROM conversations),
dam AS (SELECT c, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text, unnest(CASE hit WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE hit <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) - 1 AS place, count(*) OVER (PARTITION BY c) AS total, rtrim(text, {space}) AS bare FROM dam),
seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY place) > 1 AS again, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY place) AS before FROM ord),
r AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
step(p, sym, q) AS (VALUES {steps}), ins(p, q, cost, audit) AS (VALUES {closure}), states(p) AS (VALUES (0), (1), (2), (3)),
ed AS (SELECT c, place, p, p AS q, {DELETE} AS cost, 'D' AS audit FROM r, states
  UNION ALL SELECT c, place, p, q, CASE fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END, 'K' FROM r JOIN step ON sym = initial WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT c, place, p, q, {REROLE} + CASE fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END, 'R' FROM r, step WHERE sym IN ('u', 'a') AND fault NOT IN ('blank', 'duplicate')),
mv AS (SELECT ed.c, ed.place, ed.p, ins.q, ed.cost + ins.cost AS cost, ed.audit || ins.audit AS audit FROM ed JOIN ins ON ins.p = ed.q),
dp AS (SELECT c, CAST(-1 AS BIGINT) AS place, q, {way('cost', 'audit')} AS best FROM (SELECT DISTINCT c FROM r) x, ins WHERE p = 0
  UNION ALL SELECT dp.c, mv.place, mv.q, min({way('CAST(substr(best, 1, 9) AS BIGINT) + mv.cost', 'substr(best, 11) || mv.audit')}) FROM dp JOIN mv ON mv.c = dp.c AND mv.place = dp.place + 1 AND mv.p = dp.q GROUP BY dp.c, mv.place, mv.q),
won AS (SELECT dp.c, min(best) AS best FROM dp JOIN (SELECT DISTINCT c, total FROM r) t ON t.c = dp.c AND dp.place = t.total - 1 WHERE q IN (0, 3) GROUP BY dp.c),
au AS (SELECT c, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 11) AS audit, length(replace(substr(best, 11), 'D', '')) AS kept FROM won),
ch AS (SELECT c, audit, kept, unnest(range(1, length(audit) + 1)) AS i FROM au),
wk AS (SELECT c, i, kept, substr(audit, i, 1) AS e, length(replace(substr(audit, 1, i), 'I', '')) - 1 AS place, length(replace(substr(audit, 1, i), 'D', '')) - 1 AS out FROM ch),
tu AS (SELECT wk.c, i, CASE WHEN e = 'K' THEN r.role WHEN (out + kept) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE r.text END AS said FROM wk LEFT JOIN r ON r.c = wk.c AND r.place = wk.place WHERE e <> 'D'),
dg AS (SELECT c, sha256(string_agg(said, chr(10) ORDER BY i)) AS repaired_sha256 FROM tu GROUP BY c),
ct AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (place > 0 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c)
SELECT h.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id, c FROM hit) h LEFT JOIN ct USING (c) LEFT JOIN au USING (c) LEFT JOIN dg USING (c)"""
