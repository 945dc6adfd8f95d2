"""Secrets in texts: base patterns, and literals that source or configuration assigns to sensitive names.

A text is lexed for pairs: a name before `=`, `:`, `:=` or `=>` (a key in quotes or brackets, an XML element too), and
after it an expression of literals, bare words and names joined by operators, calls or adjacency. Names that the text
itself defines are references, as are `${name}`, `$name`, `%name%` and `{{name}}` within literals: so a constant given
to `a` that reaches `password` over `b` counts as the password. Sensitivity flows back from the names to all literals
that reach them; a literal's score is that times how much it looks like a key rather than a word or a placeholder.
A text is lexed in one task with memory in proportion to it, and nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import conf_batches, small_batches

#: Kinds in the order that spans of one start have.
KINDS = ("assign", "access", "hex", "named")
_BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: A run of fewer hexadecimal digits can't be a span: matches of this are the kept matches of `hex`.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")

#: How much a word of a name says that its value is secret; of two words together likewise.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "bearer": 0.9,
    "authorization": 0.9, "auth": 0.6, "cookie": 0.6, "salt": 0.6, "signature": 0.5, "pin": 0.5, "key": 0.4, ("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("secret", "key"): 1.0,
    ("signing", "key"): 1.0, ("encryption", "key"): 1.0, ("auth", "key"): 1.0, ("account", "key"): 0.9, ("session", "id"): 0.7, ("connection", "string"): 0.8,
}
#: Words by which a name speaks of a secret rather than holds one.
ABOUT = frozenset("public file path dir url uri name type length len size count max min field header label hint prompt policy expires ttl id regex pattern test".split())
LEAST = 0.5

_PAIR = re.compile(r":=|=>|[=:]")
_STRING = re.compile(r'''[rbfuRBFU]{0,2}(?:"([^"\\\n]*(?:\\.[^"\\\n]*)*)"|'([^'\\\n]*(?:\\.[^'\\\n]*)*)'|`([^`\\]*(?:\\.[^`\\]*)*)`)''')
_WORD = re.compile(r"\$\{[\w.\-]+\}|\{\{ ?[\w.\-]+ ?\}\}|[^\s,;\"'`(){}\[\]<>+&|:=]+(?:={1,2}(?![^\s,;\"'`(){}\[\]<>+&|]))?")
_MEMBER = re.compile(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+")
_GLUE = re.compile(r"[ \t]*(?:\+|\.\.|&|\|\|)[ \t]*(?:\\?\r?\n[ \t]*)?|[ \t]*\\\r?\n[ \t]*|[ \t]+(?=[\"'])")
_OPEN = re.compile(r"[ \t]*[(\[]*[ \t]*")
_BETWEEN = re.compile(r"[ \t]*,[ \t]*|[ \t]*(?=[\"'])")
_INNER = re.compile(r"\$\{([\w.\-]+)\}|\$(\w+)|%(\w+)%|\{\{ ?([\w.\-]+) ?\}\}")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*)>([^<>]+)(?=</)")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NOTHING = re.compile(r"(?i:(?:change|replace|your|my|example|sample|dummy|placeholder|redacted|todo|none|null|true|false|undefined|password|secret|token)\w*)|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|(.)\1*|[\W_]*")
_SCHEME = ("bearer", "basic", "token")


def sensitivity(name: str) -> float:
    """0 to 1: how surely a value of this name is secret; its words are cut at case, digits and signs."""
    words = [w.lower() for w in _PARTS.findall(name)]
    best = max((SENSITIVE.get(w, 0.0) for w in [*words, *zip(words, words[1:])]), default=0.0)
    return best * 0.4 if ABOUT.intersection(words) else best


def likeness(literal: str) -> float:
    """0 to 1: how much a literal looks like a key: its entropy a character, kinds of characters and length; 0 for placeholders."""
    if len(literal) < 6 or _NOTHING.fullmatch(literal):
        return 0.0
    n = len(literal)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    kinds = sum(1 for r in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]") if re.search(r, literal))
    spaces = sum(map(str.isspace, literal))
    return min(1.0, entropy / 2.75) * (1.0 if kinds > 1 else 0.55) * (1.0 if n >= 8 else 0.8) * (0.5 if spaces else 1.0) * (0.0 if spaces * 8 > n else 1.0)


def _left_name(text: str, at: int) -> str:
    """The name that ends before a separator, without quotes and brackets."""
    while at and text[at - 1] in " \t":
        at -= 1
    while at and text[at - 1] in "\"']":
        at -= 1
    end = at
    while at and (text[at - 1].isalnum() or text[at - 1] in "_$.-"):
        at -= 1
    return text[at:end].strip(".-$")


def _expression(text: str, at: int) -> tuple[list[tuple[bool, int, int]], int]:
    """The atoms (quoted?, start, end) from `at` on, and where scanning goes on."""
    at = _OPEN.match(text, at).end()
    atoms, on, inside = [], at, False
    while True:
        if s := _STRING.match(text, at):
            k = s.lastindex or 1
            atoms.append((True, *s.span(k)))
            at = on = s.end()
        elif w := _WORD.match(text, at):
            at = w.end()
            if text[at : at + 1] in ("(", "["):  # a call: what is given to it counts
                at, inside = at + 1, True
                continue
            atoms.append((False, *w.span()))
            if w[0].lower() in _SCHEME and text[at : at + 1] == " ":
                at += 1
                continue
        else:
            return atoms, on
        glue = _GLUE.match(text, at) or (_BETWEEN.match(text, at) if inside else None)
        if not glue or glue.end() == at and not inside:
            return atoms, on
        at = glue.end()


def named(text: str) -> list[tuple[int, int, float, str]]:
    """(start, end, score, name) of the literals that reach a sensitive name, by start."""
    if not _PAIR.search(text) and "</" not in text:
        return []
    pairs: list[tuple[str, list[tuple[bool, int, int]]]] = []
    at = 0
    while m := _PAIR.search(text, at):
        at = m.end()
        if name := _left_name(text, m.start()):
            atoms, on = _expression(text, at)
            if atoms:
                pairs.append((name, atoms))
                at = max(at, on)
    if "</" in text:
        pairs += [(m[1], [(True, *m.span(2))]) for m in _ELEMENT.finditer(text)]
    weights: dict[str, float] = {n: sensitivity(n) for n, _ in pairs}
    if not any(w >= LEAST for w in weights.values()):
        return []
    ends = {n: i for i, (n, _) in enumerate(pairs)}
    latest: dict[str, int] = {}
    literals: list[list[tuple[int, int]]] = []
    sources: list[list[int]] = []
    for i, (name, atoms) in enumerate(pairs):
        mine, uses = [], []
        for quoted, a, b in atoms:
            value = text[a:b]
            inner = [n for g in _INNER.findall(value) if (n := next(filter(None, g))) in ends]
            word = value.lstrip("$")
            refs = inner or ([word] if not quoted and word in ends and word != name else [])
            # the last value before this place, else the last in the text
            uses += [latest.get(r, ends[r]) for r in refs]
            if not refs and not _INNER.fullmatch(value) and (quoted or not _MEMBER.fullmatch(value)):
                mine.append((a, b))
        literals.append(mine)
        sources.append(uses)
        latest[name] = i
    flow: dict[int, tuple[float, str]] = {}
    for i in sorted(range(len(pairs)), key=lambda i: (-weights[pairs[i][0]], i)):
        weight, todo = weights[pairs[i][0]], [i]
        while todo and weight >= LEAST:
            j = todo.pop()
            if j not in flow:
                flow[j] = (weight, pairs[i][0])
                todo += sources[j]
    out: dict[int, tuple[int, int, float, str]] = {}
    for j, (weight, name) in flow.items():
        score = weight * likeness("".join(text[a:b] for a, b in literals[j]))
        if score >= LEAST:
            for a, b in literals[j]:
                if b - a >= 4 and text[a:b].lower() not in _SCHEME and (a not in out or out[a][2] < score):
                    out[a] = (a, b, score, name)
    return sorted(out.values())


def scan(text: str) -> list[tuple[str, int, int, float, str]]:
    """(kind, start, end, score, name) of all secrets, by start, then kind. Base patterns score 1; literals within their spans add none."""
    found: list[tuple[str, int, int, float, str]] = []
    for kind, pattern, group, least in _BASE:
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if len(m[group]) >= least:
                found.append((kind, m.start(), m.end(), 1.0, m[1].lower() if group else ""))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    extra, k, reach = [], 0, 0
    for a, b, score, name in named(text):
        while k < len(found) and found[k][1] <= a:
            reach = max(reach, found[k][2])
            k += 1
        if b > reach:
            extra.append(("named", a, b, score, name))
    return sorted(found + extra, key=lambda s: (s[1], KINDS.index(s[0]))) if extra else found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("name", pa.string())])


def _scan_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _SPAN]
    for b in small_batches(batches, "text", 2 << 20):
        spans = [[dict(zip(names, s)) for s in scan(t or "")] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score, name; code points, end exclusive) of every row.

    A null text is empty and has none; null and repeated doc_ids stay as they are; an empty table gives no rows; other
    columns have no part. Spans of a kind don't overlap; those of different kinds may. Of equal starts, kinds go as in KINDS."""
    conf_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_scan_part, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double,name:string>>")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans and all spans as text."""
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"] != "named")
    return find(docs).select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
