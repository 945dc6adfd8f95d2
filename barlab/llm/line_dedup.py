"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Edits count in words. Lines within `edits` of each other (words put in, left out or replaced) share a variant:
what is left of each without at most so many words. Variants are keyed by an order-free hash, one step for each;
rows with equal keys are told apart by the words that are left, and compared word by word. For one edit, lines
that share neither their first nor their last half with a different line are set aside before, as no line within
the bound can exist for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import hot_join, let, small_side, stored

MASK = (1 << 40) - 1
_ID, _GONE = "barlab line doc_id", "barlab line gone"


def normal(text: Column) -> Column:
    """Each run of white space within a line as one space."""
    return F.regexp_replace(text, r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", " ")


def _id(line: Column) -> Column:
    """The identity of a line or word sequence, 128 bits."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, at (from 0), line (words with one space between) of every line that has words; rows without doc_id or text have none."""
    each = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split(normal(F.col("text")), "\n")).alias("at", "line"))
    return each.select("doc_id", "at", F.btrim("line", F.lit(" ")).alias("line")).where("line <> ''")


def n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _halves(line: Column, n: Column) -> Column:
    """Keys of the first and the last k words, k half of a pair's shorter line, be this the shorter or the longer one."""

    def ends(k: Column) -> list[Column]:
        k = k.cast("int")
        return [F.xxhash64(F.lit(0), k, F.call_function("substring_index", line, F.lit(" "), k)), F.xxhash64(F.lit(1), k, F.call_function("substring_index", line, F.lit(" "), -k))]

    return F.array_distinct(F.array(*ends(F.floor(n / 2)), *ends(F.floor((n - 1) / 2))))


def _variants(h: Column, edits: int) -> Column:
    """(gone, key) of the line less every set of at most `edits` words: an exclusive-or and a sum of word hashes; gone: their positions."""
    low = lambda x: x.bitwiseAND(F.lit(MASK))
    start = F.struct(
        F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)).alias("x"), F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + low(x)).alias("s"), F.array().cast("array<int>").alias("gone"),
    )

    def less(v: Column) -> Column:
        after = F.coalesce(F.try_element_at(v["gone"], F.lit(-1)), F.lit(-1)) if edits > 1 else F.lit(-1)
        one = F.transform(h, lambda x, i: F.struct(v["x"].bitwiseXOR(x).alias("x"), (v["s"] - low(x)).alias("s"), F.concat(v["gone"], F.array(i)).alias("gone")))
        return F.slice(one, after + 2, F.size(h)) if edits > 1 else one

    levels = [F.array(start)]
    for _ in range(edits):
        levels.append(F.flatten(F.transform(levels[-1], less)))
    return F.transform(F.concat(*levels), lambda v: F.struct(v["gone"].alias("gone"), F.xxhash64(v["x"], v["s"]).alias("key")))


def _without(words: Column, gone: Column) -> Column:
    return F.filter(words, lambda w, i: ~F.array_contains(gone, i))


def _parts(gaps: Column) -> Column:
    """All sub-multisets of a sorted array."""
    return F.aggregate(gaps, F.array(F.array().cast("array<int>")), lambda acc, g: F.array_distinct(F.concat(acc, F.transform(acc, lambda a: F.concat(a, F.array(g))))))


def near_earlier(lines: DataFrame, edits: int = 1) -> DataFrame:
    """id of each line for which an earlier line within `edits` exists; lines: id, first (place), words, once each.

    What is left of two lines is equal; each lacks words in some gaps, and the edit distance along it is the sum
    over gaps of the larger number of lacking words. It is within the bound if the gaps that they have in common
    are at least both counts less the bound. So for each part of such gaps the earliest line is a witness for all,
    and pairs needn't be listed. Each line is compared with its witness word by word."""
    hashed = lines.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    each = hashed.select("id", F.explode(_variants(F.col("h"), edits)).alias("v")).select("id", "v.gone", "v.key")
    shared = each.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key")
    rows = each.join(shared, "key").join(lines, "id").withColumn("rest", _id(_without(F.col("words"), F.col("gone"))))
    gaps = F.transform("gone", lambda d, k: d - k)
    rows = stored(rows.select("id", "gone", gaps.alias("gaps"), "rest", "first"))
    index = rows.select("rest", F.size("gaps").alias("b"), F.explode(_parts(F.col("gaps"))).alias("part"), "first", "id", "gone")
    index = index.groupBy("rest", "b", "part").agg(F.min(F.struct("first", "id", "gone")).alias("w"))
    need = lambda b: F.greatest(F.size("gaps") + b - edits, F.lit(0))
    asked = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("b")).where(need(F.col("b")) <= F.least(F.size("gaps"), F.col("b")))
    asked = asked.select("id", "gone", "first", "rest", "b", F.explode(F.filter(_parts(F.col("gaps")), lambda p: F.size(p) == need(F.col("b")))).alias("part"))
    pairs = asked.join(index, ["rest", "b", "part"]).where("w.first < first").select("id", "gone", F.col("w.id").alias("of"), F.col("w.gone").alias("its"))
    mine, other = lines.select("id", "words"), lines.select(F.col("id").alias("of"), F.col("words").alias("other"))
    alike = _without(F.col("words"), F.col("gone")) == _without(F.col("other"), F.col("its"))
    return pairs.join(mine, "id").join(other, "of").where(alike).select("id").distinct()


def _texts(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """id, first and words of the lines of firsts (id, first), from the documents that hold them first."""
    wanted = firsts.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("id", "first")).alias("wanted"))
    held = docs.select("doc_id", "text").join(small_side(stored(wanted), 100_000), "doc_id")
    line = lambda lines, x: F.btrim(F.get(lines, x["first"]["at"]), F.lit(" "))
    pick = lambda lines: F.transform("wanted", lambda x: F.struct(x["id"].alias("id"), x["first"].alias("first"), line(lines, x).alias("line")))
    cut = held.select(F.explode(let(F.split(normal(F.col("text")), "\n"), pick)).alias("x")).select("x.id", "x.first", "x.line")
    return cut.where(_id(F.col("line")) == F.col("id")).groupBy("id", "first").agg(F.split(F.first("line"), " ").alias("words"))


def removed_lines(docs: DataFrame, edits: int = 1, least_words: int = 10) -> DataFrame:
    """doc_id and gone (the positions, from 0) of the lines that dedup removes."""
    lines = lines_of(docs).withColumn("n", n_words(F.col("line")))
    halves = F.when(F.col("n") >= least_words, _halves(F.col("line"), F.col("n")) if edits == 1 else F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    keys = stored(lines.select("doc_id", "at", _id(F.col("line")).alias("id"), halves.alias("halves")))
    place = F.struct("doc_id", "at")
    firsts = stored(keys.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.any_value("halves").alias("halves")))
    half = firsts.select("id", F.explode("halves").alias("half"))
    met = half.groupBy("half").agg(F.count("*").alias("k")).where("k > 1").select("half") if edits == 1 else half.select("half").distinct()
    near_to = stored(half.join(met, "half").select("id").distinct())
    full = stored(_texts(docs, firsts.join(small_side(near_to), "id").select("id", "first")))
    near = near_earlier(full, edits).withColumn("near", F.lit(True))
    flagged = stored(firsts.drop("halves").join(near, "id", "left").where("n > 1 OR near"))
    gone = hot_join(keys.select("doc_id", "at", "id"), flagged, ["id"], keys.count())
    return gone.where(F.col("near") | (place > F.col("first"))).groupBy("doc_id").agg(F.collect_set("at").alias("gone"))


def dedup(docs: DataFrame, edits: int = 1, least_words: int = 10, counts: bool = True) -> DataFrame:
    """docs with the lines taken out that have an earlier line (by doc_id, then position) within the edit bound.

    The bound is `edits` words for lines of `least_words` words or more; shorter lines must have equal words.
    Variants grow as the power `edits` of a line's words. Lines are judged on the input: one may go because of a
    line that goes itself. Lines without words stay; white space within a line doesn't count. All columns pass;
    n_lines and n_removed are added (replaced if there) unless `counts` is off. Null text: stays null, no lines; a null doc_id: nothing
    goes. doc_id is a key: rows that repeat one lose the same lines, and none on account of each other."""
    gone = removed_lines(docs, edits, least_words).select(F.col("doc_id").alias(_ID), F.col("gone").alias(_GONE))
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(_GONE))
    rest = let(F.split("text", "\n"), lambda lines: F.array_join(F.transform(kept(lines), lambda i: F.get(lines, i)), "\n"))
    text = F.when(F.col(_GONE).isNull(), F.col("text")).otherwise(rest)
    out = docs.join(gone, F.col("doc_id") == F.col(_ID), "left")
    if not counts:
        return out.withColumn("text", text).drop(_ID, _GONE)
    count = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return out.withColumns({"n_lines": F.coalesce(count, F.lit(0)), "n_removed": F.coalesce(F.size(_GONE), F.lit(0)), "text": text}).drop(_ID, _GONE)





ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, pos - 1 AS pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), d AS (
  SELECT words, min({'doc_id': doc_id, 'at': pos}) AS first FROM l WHERE len(words) > 0 GROUP BY words
), v AS (
  SELECT words, first, i, CASE WHEN i < 0 THEN words ELSE list_concat(words[:i], words[i + 2:]) END AS rest
  FROM (SELECT words, first, unnest(range(-1, len(words))) AS i FROM d WHERE len(words) >= 10)
), near AS (
  SELECT DISTINCT a.words FROM v a JOIN v b ON a.rest = b.rest AND (a.i = b.i OR a.i < 0 OR b.i < 0) AND b.first < a.first
), gone AS (
  SELECT l.doc_id, l.pos FROM l JOIN d ON l.words = d.words
  WHERE {'doc_id': l.doc_id, 'at': l.pos} > d.first OR l.words IN (SELECT words FROM near)
)
SELECT p.doc_id, count(l.doc_id) AS n_lines, count(g.doc_id) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN g.doc_id IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '')) AS kept_sha256
FROM documents p LEFT JOIN l ON l.doc_id = p.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
GROUP BY p.doc_id"""
