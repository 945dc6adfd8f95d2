"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, the rest lower-cased words; windows of `WORDS`
such tokens are hash-joined with those of the benchmark items. A document holds an item if it has
at least `SHARE` of the item's distinct windows and the placeholders agree: along one of the offsets that
have the share, or else the most frequent, each value in the item must stand for one value in the document. Re-parameterised questions
share all windows and have other, but consistent, values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import literal, small_side, stored

WORDS, SHARE = 5, 0.8
# Placeholders and value brackets are private-use characters, which texts don't have (they would count as separators).
NUMBER, NAME, UNIT, OPEN, CLOSE = "", "", "", "", ""
UNITS = (
    "mm", "cm", "m", "km", "inches", "inch", "feet", "foot", "ft", "yards", "yard", "miles", "mile", "mg", "g", "kg", "grams", "pounds", "lb",
    "lbs", "oz", "ml", "l", "litres", "liters", "s", "sec", "seconds", "min", "minutes", "hours", "hour", "h", "days", "day", "weeks", "week",
    "months", "month", "years", "year", "percent", "dollars", "dollar", "euros", "euro", "cents", "degrees",
)
# Words that open a sentence without being a name.
OPENERS = (
    "a|an|the|this|that|these|those|if|when|where|who|whom|whose|what|which|why|how|in|on|at|by|for|from|to|of|with|as|and|or|but|so|then|there|it|its|is|are|was|were|"
    "do|does|did|can|could|will|would|should|has|have|had|he|she|they|we|you|i|his|her|their|our|my|your|after|before|while|during|each|every|all|some|any|no|not|one|let|given|"
    "suppose|find|calculate|compute|determine|question|answer"
)
# Repetition is of single characters only: Java's matcher recurses for each round of a repeated group.
_CAPITAL = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?!(?i:{OPENERS})(?!\p{{L}}))\p{{Lu}}\p{{L}}*+"
_NUMBER = r"\p{N}[\p{N}.,:/]*(?<=\p{N})"
_UNIT = rf"({NUMBER}(?:{OPEN}[^{CLOSE}]*+{CLOSE})? +)(%|" + "|".join(UNITS) + r")(?![\p{L}\p{N}])"
#: The streams of tokens: templates and plain words. A stream -n is of items of n plain words, fewer than WORDS.
TEMPLATE, PLAIN = 1, 2
_GAP = rf"[^\p{{L}}\p{{N}}{NUMBER}{NAME}{UNIT}]+"
_STRAY = rf"[{NUMBER}{NAME}{UNIT}{OPEN}{CLOSE}]"
_LONGS = 1 << 16  # of the bit table that benchmark windows set


def marked(text: Column, values: bool) -> Column:
    """The text lower-cased with placeholders for names (runs of capitalised words but sentence openers), numbers
    and units after numbers; with `values`, each is followed by its bracketed value."""
    v = (lambda k: f"{OPEN}${k}{CLOSE}") if values else (lambda k: "")
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _STRAY, " ")
    t = F.regexp_replace(t, _CAPITAL, NAME + v(0))
    t = F.replace(t, F.lit(f"{CLOSE} {NAME}{OPEN}"), F.lit(" ")) if values else F.regexp_replace(t, f"(?<={NAME}) {NAME}", "")
    t = F.regexp_replace(t, _NUMBER, f" {NUMBER}{v(0)} ")
    return F.regexp_replace(F.lower(t), _UNIT, f"$1{UNIT}{v(2)} ")


def tokens(mark: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(mark, f"{OPEN}[^{CLOSE}]*+{CLOSE}", ""), _GAP), "")


def _tokens_of(stream: int, text: Column) -> Column:
    plain = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(F.split(marked(text, False), _GAP) if stream == TEMPLATE else plain, "")


def window_keys(words: Column, n: int = WORDS, stream: int = TEMPLATE) -> Column:
    """Hashes of all windows of n tokens; fewer tokens: none."""
    whole = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.lit(stream), F.slice(words, i, n)))
    return F.when(F.size(words) >= n, whole).otherwise(F.array().cast("array<bigint>"))


def _keys(rows: DataFrame, key: str, short: list[int]) -> tuple[DataFrame, list[int]]:
    """key and, under the name of each stream, the keys of its windows in order."""
    both = rows.select(key, _tokens_of(TEMPLATE, F.col("text")).alias("t"), _tokens_of(PLAIN, F.col("text")).alias("p"))
    kinds = [(TEMPLATE, "t", WORDS), (PLAIN, "p", WORDS), *((-n, "p", n) for n in short)]
    return both.select(key, *(window_keys(F.col(c), n, k).alias(f"k{k}") for k, c, n in kinds)), [k for k, _, _ in kinds]


def _windows(rows: DataFrame, key: str, at: str, short: list[int], hits: Column | None = None) -> DataFrame:
    """key, stream, place and key of the windows of every stream; with `hits`, a bit table, only of those whose bit is set."""
    keyed, streams = _keys(rows, key, short)
    if hits is not None:
        keyed = keyed.withColumn("_hits", hits)

    def rows_of(k: int) -> Column:
        own, places = F.col(f"k{k}"), F.sequence(F.lit(0), F.size(f"k{k}") - 1)
        is_set = lambda i: F.getbit(F.get("_hits", F.pmod(F.get(own, i), F.lit(_LONGS)).cast("int")), F.pmod(F.shiftright(F.get(own, i), 16), F.lit(64)).cast("int")) == 1
        some = places if hits is None else F.filter(places, is_set)
        listed = F.transform(some, lambda i: F.struct(F.lit(k).alias("stream"), i.alias(at), F.get(own, i).alias("key")))
        return F.when(F.size(own) > 0, listed).otherwise(F.array().cast(f"array<struct<stream:int,{at}:int,key:bigint>>"))

    return keyed.select(key, F.explode(F.concat(*map(rows_of, streams))).alias("k")).select(key, "k.*")


def _bit_table(keys: DataFrame) -> Column:
    """A literal array of _LONGS longs, 512 KB whatever the benchmark's size, with a bit set for each key."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright("key", 16), F.lit(64)).cast("int"))
    own = keys.select(F.pmod("key", F.lit(_LONGS)).alias("id"), bit.alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(_LONGS).join(own, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    return literal(every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("table")))


def _slots(rows: DataFrame, key: str) -> DataFrame:
    """key, pos, kind and value of each placeholder."""
    mark = rows.select(key, marked(F.col("text"), True).alias("m"))
    split = mark.select(key, tokens(F.col("m")).alias("t"), F.regexp_extract_all("m", F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1)).alias("v"))
    is_slot = lambda t: t.isin(NUMBER, NAME, UNIT)
    at = split.select(key, "v", F.transform("t", lambda t, i: F.struct(i.alias("pos"), t.alias("kind"))).alias("all"))
    at = at.select(key, F.arrays_zip(F.filter("all", lambda x: is_slot(x["kind"])).alias("s"), F.col("v").alias("v")).alias("z"))
    return at.select(key, F.explode("z").alias("z")).select(key, F.col("z.s.pos").alias("pos"), F.col("z.s.kind").alias("kind"), F.col("z.v").alias("value"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, share: the items that documents hold.

    The templates and the plain words (which have no values to compare) are judged each by itself, and one that
    reaches the share is enough. An item of fewer than WORDS words is held where all of them follow each other.
    Null texts and rows with a null id hold nothing. Repeated rows count once; of items with equal texts each is
    found. Every offset that has the share of windows by itself is judged by its values, or else the most
    frequent ones; one that is consistent is enough. Windows whose bit no benchmark window sets are left out
    before the join; that has no bearing on the result."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", "text")
    size = items.select("item_id", "text", F.size(_tokens_of(PLAIN, F.col("text"))).alias("size"))
    short = sorted(r["size"] for r in size.where(F.col("size").between(1, WORDS - 1)).select("size").distinct().collect())
    cut = _windows(size, "item_id", "pos", short).join(size.select("item_id", "size"), "item_id").where("stream >= 0 OR stream = -size")
    grams = stored(cut.groupBy("item_id", "stream", "key").agg(F.min("pos").alias("pos")))
    pair = ["doc_id", "item_id"]
    sizes = grams.groupBy("item_id", "stream").agg(F.count("*").alias("n"))
    each = _windows(docs.where("doc_id IS NOT NULL"), "doc_id", "at", short, _bit_table(grams)).select("doc_id", "at", "key")
    met = stored(each.join(small_side(grams), "key").select(*pair, "stream", "key", (F.col("at") - F.col("pos")).alias("shift")).distinct())
    held = met.select(*pair, "stream", "key").distinct().groupBy(*pair, "stream").agg(F.count("*").alias("k")).join(sizes, ["item_id", "stream"])
    held = stored(held.where(F.col("k") >= SHARE * F.col("n")).select(*pair, "stream", "n", (F.col("k") / F.col("n")).alias("share")))
    typed = held.where(F.col("stream") == TEMPLATE)
    shifts = stored(met.where(F.col("stream") == TEMPLATE).join(typed.select(*pair, "n"), pair).groupBy(*pair, "shift", "n").count())
    most = shifts.groupBy(*pair).agg(F.max("count").alias("most"))
    whole = F.col("count") >= F.least(SHARE * F.col("n"), F.col("most"))
    offsets = stored(shifts.join(most, pair).where(whole).select(*pair, "shift"))
    asked = offsets.join(_slots(items, "item_id").withColumnRenamed("value", "old"), "item_id").withColumn("pos", F.col("pos") + F.col("shift"))
    suspects = docs.join(small_side(stored(asked.select("doc_id").distinct())), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    both = asked.join(_slots(suspects, "doc_id"), ["doc_id", "pos", "kind"])
    odd = both.groupBy(*pair, "shift", "kind", "old").agg((F.min("value") < F.max("value")).alias("differ")).where("differ")
    sound = offsets.join(odd.select(*pair, "shift").distinct(), [*pair, "shift"], "left_anti").select(*pair).distinct()
    found = held.where(F.col("stream") != TEMPLATE).select(*pair, "share").union(typed.join(sound, pair, "left_semi").select(*pair, "share"))
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_items and items (item ids in order, comma-joined; empty if none) added."""
    found = leaks(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item_id")).cast("array<string>"), ",").alias("items"))
    out = docs.drop("n_items", "items").join(small_side(stored(found), 100_000), "doc_id", "left")
    return out.withColumns({"n_items": F.coalesce("n_items", F.lit(0)), "items": F.coalesce("items", F.lit(""))})


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_template(text: str) -> str:
    """Letters and what lies between them are dealt with piece by piece, as DuckDB's patterns don't look around."""
    t = f"regexp_extract_all(regexp_replace(coalesce({text}, ''), {_sql(_STRAY)}, ' ', 'g'), '\\p{{L}}+|[^\\p{{L}}]+')"
    is_name = f"regexp_matches(x, '^\\p{{Lu}}') AND NOT regexp_full_match(lower(x), {_sql(OPENERS)}) AND NOT (i > 1 AND regexp_matches(p[i - 1], '\\p{{N}}$'))"
    t = f"array_to_string(list_transform([{t}], lambda p: array_to_string(list_transform(p, lambda x, i: CASE WHEN {is_name} THEN {_sql(NAME)} ELSE x END), '')), '')"
    t = f"regexp_replace({t}, '{NAME}( {NAME})+', '{NAME}', 'g')"
    t = f"regexp_replace({t}, '\\p{{N}}([\\p{{N}}.,:/]*\\p{{N}})?', {_sql(' ' + NUMBER + ' ')}, 'g')"
    t = f"regexp_replace(lower({t}), '({NUMBER} +)(%|{'|'.join(UNITS)})([^\\p{{L}}\\p{{N}}]|$)', {_sql(chr(92) + '1' + UNIT + ' ' + chr(92) + '3')}, 'g')"
    return f"list_filter(regexp_split_to_array({t}, {_sql(_GAP)}), lambda w: w <> '')"


def oracle() -> str:
    """DuckDB SQL for judge over windows of both streams (these tables' copies have no values that disagree, and no
    item of fewer than WORDS words; tests hold values and short items against brute force)."""
    plain = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"

    def grams(key: str, table: str) -> str:
        words = f"SELECT {key}, 1 AS stream, {_sql_template('text')} AS w FROM {table} UNION ALL SELECT {key}, 2, {plain} FROM {table}"
        return f"SELECT DISTINCT {key}, stream, w[i:i + {WORDS - 1}] AS key FROM (SELECT {key}, stream, w, unnest(range(1, len(w) - {WORDS - 2})) AS i FROM ({words}))"

    return f"""
WITH b AS ({grams('item_id', 'benchmark')}), d AS ({grams('doc_id', 'documents')}),
n AS (SELECT item_id, stream, count(*) AS n FROM b GROUP BY item_id, stream),
h AS (SELECT doc_id, item_id, stream, count(*) AS k FROM d JOIN b USING (stream, key) GROUP BY doc_id, item_id, stream),
f AS (SELECT DISTINCT doc_id, item_id FROM h JOIN n USING (item_id, stream) WHERE k >= {SHARE} * n)
SELECT p.doc_id, count(f.item_id) AS n_items, coalesce(string_agg(CAST(f.item_id AS VARCHAR), ',' ORDER BY f.item_id), '') AS items
FROM documents p LEFT JOIN f ON f.doc_id = p.doc_id GROUP BY p.doc_id"""
