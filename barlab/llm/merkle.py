"""Merkle manifest of a dataset: a tree of hashes a group, their roots under one root, and proofs for every row.

Checkpoint and recompute: only every `EVERY` levels are written. A proof needs the nodes between too; they are
computed again for each aligned subtree from its stored descendants, give their siblings, and are dropped. A subtree
has ARITY ** EVERY stored nodes at most, so a group of any size spreads over all tasks, and a lost task computes only
its own subtrees again. Nodes are lowercase hex SHA-256 digests, and a node hashes its children's hex text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import let, stored
from barlab.operators.ranks import ordinals

ARITY = 8
#: Levels from one stored level to the next.
EVERY = 2
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's values: each `-` if null, else its UTF-8 byte count, `:` and itself."""
    text = [v.cast("string") for v in values]
    return digest(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text))


def group_key(value: Column) -> Column:
    """A key without nulls that sorts null first, then bytewise."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value.cast("string")))


def _parents(nodes: Column) -> Column:
    """The digest of each run of ARITY nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _siblings(nodes: Column, i: Column) -> Column:
    """The other nodes of node i's run, those to its left and those to its right joined."""
    own = i % ARITY
    left = F.array_join(F.slice(nodes, i - own + 1, own), "")
    right = F.array_join(F.slice(nodes, i + 2, F.lit(ARITY - 1) - own), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _blocks(level: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The stored nodes of each aligned subtree in order; at most ARITY ** EVERY in one."""
    row = F.struct("place", "node", *keep)
    own = F.floor(F.col("place") / ARITY**EVERY).alias("parent")
    return level.where("total > 1").groupBy("part", "total", own).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def _rises(k: int) -> Column:
    """Whether a tree of `total` nodes here has a level k + 1 above."""
    return F.col("total") > ARITY**k


def _top(nodes: Column) -> Column:
    for k in range(EVERY):
        nodes = F.when(_rises(k), _parents(nodes)).otherwise(nodes)
    return nodes[0]


def _paths(nodes: Column, then, k: int = 0, made: tuple[Column, ...] = ()) -> Column:
    """then(siblings of the nodes of each level within the subtree), the levels between computed on the way."""
    if k == EVERY:
        return then(made)
    each = F.when(_rises(k), F.transform(nodes, lambda _, i: _siblings(nodes, i)))
    return let(each, lambda e: let(_parents(nodes), lambda up: _paths(up, then, k + 1, (*made, e))))


def climb(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels over leaves (part, place, total, node), from these on up to where every part has one node."""
    levels, most = [leaves], leaves.agg(F.max("total")).first()[0] or 1
    while most > 1:
        nodes = F.transform("rows", lambda r: r["node"])
        up = _blocks(levels[-1]).select("part", "parent", "total", let(nodes, _top).alias("node"))
        levels.append(stored(up.select("part", F.col("parent").alias("place"), F.ceil(F.col("total") / ARITY**EVERY).alias("total"), "node")))
        most = -(-most // ARITY**EVERY)
    return levels


def tops(levels: Sequence[DataFrame]) -> DataFrame:
    """part and node of every tree's root: it is in the first level that holds one node of the part."""
    out = None
    for level in levels:
        one = level.where("total = 1").select("part", "node")
        out = one if out is None else out.unionByName(one)
    return out


def paths(levels: Sequence[DataFrame], roots: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """part, node, the kept columns of the leaves, roots' columns, and the path to the root (pairs of joined siblings,
    lowest first) of every leaf. roots has one row a part with `path`, the way on from there, and any other columns."""
    more = [c for c in roots.columns if c not in ("part", "path")]
    above = None
    for k in reversed(range(len(levels))):
        kept = list(keep) if k == 0 else []
        level = levels[k]
        done = level.where("total = 1").join(roots, "part").select("part", "place", "node", *kept, "path", *more)
        if above is not None:
            up = above.select("part", F.col("place").alias("parent"), F.col("path").alias("on"), *more)
            block = _blocks(level, kept).join(up, ["part", "parent"])

            def rows(made: tuple[Column, ...]) -> Column:
                def own(r: Column, i: Column) -> Column:
                    steps = [e[F.floor(i / ARITY**j).cast("int")] for j, e in enumerate(made)]
                    return F.struct(r["place"].alias("place"), r["node"].alias("node"), *(r[c].alias(c) for c in kept), F.array_compact(F.array(*steps)).alias("own"))

                return F.transform("rows", own)

            each = block.select("part", "on", *more, F.explode(let(F.transform("rows", lambda r: r["node"]), lambda n: _paths(n, rows))).alias("r"))
            done = done.unionByName(each.select("part", "r.place", "r.node", *(F.col("r")[c].alias(c) for c in kept), F.concat("r.own", "on").alias("path"), *more))
        above = done
    return above.drop("place")


def fold(path: Column, node: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def joined(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def prove(rows: DataFrame, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Proofs of rows (part, node and other columns): the kept columns, node, its path, subroot and root.

    A part's leaves ascend by `order` (nulls first), then by node; rows that are alike are leaves of their own. Parts
    ascend by their key. One row alone in its part is that part's root, one part alone is the whole's: then the path
    is empty. No rows: no proofs."""
    under = ordinals(stored(rows.select("part", "node", *dict.fromkeys([*order, *keep]))), ["part"], [*order, "node"])
    groups = climb(stored(under))
    over = ordinals(tops(groups).select(F.lit("").alias("part"), "node", F.col("part").alias("of")), ["part"], ["of"])
    whole = climb(stored(over))
    root = tops(whole).select("part", F.expr(f"cast(array() AS {_PATH})").alias("path"), F.col("node").alias("root"))
    subroots = paths(whole, root, keep=["of"]).select(F.col("of").alias("part"), "path", F.col("node").alias("subroot"), "root")
    return paths(groups, stored(subroots), keep=keep)


def audit(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, and whether each holds after the trial tampering.

    Leaves are digests of doc_id, source, lang, n_chars and text, in groups by lang. Where 3 divides the crc32 of the
    decimal doc_id, the text's A-Z are lower-cased before the root is folded from the original siblings. Nulls in any
    column are values of their own (a null doc_id is never tampered with, a null text stays null); equal rows are
    leaves of their own; an empty table gives no rows; other columns have no part."""
    text, doc = F.col("text"), F.col("doc_id")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    values = lambda t: [doc, F.col("source"), F.col("lang"), F.col("n_chars"), t]
    hit = (F.crc32(doc.cast("string")) % 3 == 0) & text.rlike("[A-Z]")
    tampered = F.when(hit, leaf(values(F.translate(text, upper, upper.lower()))))
    rows = docs.select(group_key(F.col("lang")).alias("part"), "doc_id", leaf(values(text)).alias("node"), tampered.alias("tampered"))
    got = prove(rows, order=["doc_id"], keep=["doc_id", "tampered"])
    return got.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(joined(F.col("path")), 256).alias("proof_sha256"),
        fold(F.col("path"), F.coalesce("tampered", "node")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_tree(leaves: str, name: str, levels: int) -> list[tuple[str, str]]:
    """CTEs of a tree's levels ({name}0 is `leaves`: part, i, n, node) and of the siblings of each node that has a parent."""
    out = [(f"{name}0", leaves)]
    for k in range(levels):
        run = "PARTITION BY part, i // 8 ORDER BY i ROWS BETWEEN"
        side = lambda rows: f"coalesce(string_agg(node, '') OVER ({run} {rows}), '')"
        out += [
            (f"{name}s{k}", f"SELECT part, i, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k} WHERE n > 1"),
            (f"{name}{k + 1}", f"SELECT part, i // 8 AS i, any_value((n + 7) // 8) AS n, sha256(string_agg(node, '' ORDER BY i)) AS node FROM {name}{k} WHERE n > 1 GROUP BY part, i // 8"),
        ]
    roots = " UNION ALL ".join(f"SELECT part, node FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return [*out, (f"{name}_roots", roots)]


def oracle(levels: int = 8) -> str:
    """The same in DuckDB SQL, for groups of up to 8 ** levels rows, and as many groups."""
    ser = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(cast({x} AS varchar)) || ':' || cast({x} AS varchar) END"
    lower = "array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN lower(c) ELSE c END), '')"
    row = lambda t: "sha256(" + " || ".join(ser(x) for x in ("doc_id", "source", "lang", "n_chars", t)) + ")"
    byte = "list_reduce(range(8), lambda c, b: xor(c >> 1, 3988292384 * (c & 1)), xor(a & 255, x))"
    crc = f"xor(list_reduce(list_transform(string_split(cast(doc_id AS varchar), ''), lambda d: cast(ord(d) AS bigint)), lambda a, x: xor(a >> 8, {byte}), 4294967295), 4294967295)"
    docs = f"SELECT doc_id, coalesce('=' || lang, '') AS part, {row('text')} AS node, CASE WHEN {crc} % 3 = 0 THEN {row(f'({lower})')} END AS bad FROM documents"
    at = "SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, node) - 1 AS i, count(*) OVER (PARTITION BY part) AS n FROM docs"
    ctes = [("docs", docs), *_sql_tree(at, "t", levels)]
    over = "SELECT '' AS part, part AS of, row_number() OVER (ORDER BY part) - 1 AS i, count(*) OVER () AS n, node FROM t_roots"
    ctes += _sql_tree(over, "u", levels)
    first = "SELECT d.doc_id, d.node AS leaf, q.node AS subroot, w.node AS root, '' AS proof, coalesce(d.bad, d.node) AS f, d.part, d.i, g.i AS gi"
    previous = f"{first} FROM t0 d JOIN t_roots q ON q.part = d.part JOIN u0 g ON g.of = d.part CROSS JOIN u_roots w"
    for j, (tree, k) in enumerate([("t", k) for k in range(levels)] + [("u", k) for k in range(levels)]):
        ctes.append((f"f{j}", previous))
        part, i = ("x.part", "x.i") if tree == "t" else ("''", "x.gi")
        previous = (
            f"SELECT x.doc_id, x.leaf, x.subroot, x.root, x.proof || coalesce(s.l || s.r, '') AS proof, CASE WHEN s.l IS NULL THEN x.f ELSE sha256(s.l || x.f || s.r) END AS f, x.part, x.i, x.gi "
            f"FROM f{j} x LEFT JOIN {tree}s{k} s ON s.part = {part} AND s.i = {i} // {ARITY**k}"
        )
    body = f"SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM ({previous}) z"
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in ctes) + " " + body
