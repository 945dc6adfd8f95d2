"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms of which one is enough (strict), and terms of which several distinct ones are needed (soft).
STRICT = (
    "adult", "bdsm", "camgirl", "camgirls", "casino", "cialis", "cumshot", "dildo", "escort", "escorts", "fetish", "gangbang", "hardcore", "hentai", "hookup", "jackpot", "keygen", "levitra",
    "malware", "milf", "nsfw", "nude", "nudes", "orgy", "phishing", "porn", "porno", "pornhub", "scam", "sexcam", "sextoys", "slots", "spam", "strapon", "striptease", "swingers", "viagra", "warez", "webcamsex",
    "xrated", "xvideos", "xxx",
)
SOFT = (
    "babe", "bet", "betting", "bingo", "bitcoin", "bonus", "buy", "cash", "cheap", "clickbait", "coupon", "crack", "credit", "dating", "deal", "deals", "debt", "diet", "discount", "download", "drugs", "earn", "farm", "forex",
    "free", "gamble", "gift", "girls", "guaranteed", "hack", "hot", "income", "insurance", "lottery", "loan", "loans", "lucky", "mobi", "money", "mortgage", "offer", "payday", "pharmacy", "pills", "poker", "prize", "promo",
    "replica", "rich", "roulette", "sale", "sex", "sexy", "singles", "stream", "torrent", "weightloss", "win", "winner",
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and its verdict, null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def vocabulary_hits(strict: Sequence[str], soft: Sequence[str]):
    """A pandas UDF url -> struct of distinct strict and soft terms that stand between boundaries.

    A boundary is the text's end or anything but an ASCII letter or digit. Null counts as empty."""

    @F.pandas_udf("strict_hits int, soft_hits int")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for kind, terms in enumerate((strict, soft)):
            for t in terms:
                machine.add_word(t, (kind, t))
        machine.make_automaton()

        def count(url: str | None) -> tuple[int, int]:
            text, found = (url or "").lower(), (set(), set())
            for end, (kind, t) in machine.iter(text) if text else ():
                before, after = text[end - len(t) : end - len(t) + 1] if end >= len(t) else "", text[end + 1 : end + 2]
                if not any(c.isascii() and c.isalnum() for c in (before, after) if c):
                    found[kind].add(t)
            return len(found[0]), len(found[1])

        for s in urls:
            yield pd.DataFrame([count(u) for u in s], columns=["strict_hits", "soft_hits"], dtype="int32")

    return hits


def terms_of(table: DataFrame, most: int = 100_000) -> tuple[list[str], list[str]]:
    """(strict, soft) terms from a table (term, weight): a weight of 1 or more is strict, a lower one above 0 soft.

    Terms are lower-cased, empty and null ones left out; of a term given twice the larger weight counts. Every
    task holds the vocabulary, so a table of more than `most` terms is an error."""
    rows = table.select(F.lower("term").alias("term"), "weight").where("term <> '' AND weight > 0").groupBy("term").agg(F.max("weight").alias("weight")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return sorted(r.term for r in rows if r.weight >= 1), sorted(r.term for r in rows if r.weight < 1)


_HITS = "barlab url hits"


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule] = (), *, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, least_soft: int = 2
) -> DataFrame:
    """Adds host, path, rule, strict_hits, soft_hits and verdict (allow or block) to pages.

    The longest fitting rule decides; else a url goes that has one strict term or `least_soft`
    distinct soft ones. A null url or one without ``://`` has empty host and path; a null url is allowed.
    The lists are parameters; `terms_of` reads them from a table. Repeated rows are judged alike, other columns pass, those of the added names are replaced. No shuffle."""
    host, path = F.col("host"), F.col("path")
    text, verdict = rule_of(host, path, rules)
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = out.withColumns({"rule": text, _HITS: vocabulary_hits(strict, soft)(F.col("url"))})
    bad = (F.col(_HITS).strict_hits >= 1) | (F.col(_HITS).soft_hits >= least_soft)
    return out.withColumns(
        {
            "strict_hits": F.col(_HITS).strict_hits,
            "soft_hits": F.col(_HITS).soft_hits,
            "verdict": F.coalesce(verdict, F.when(bad, "block").otherwise("allow")),
        }
    ).drop(_HITS)


def oracle(rules: Sequence[Rule], strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, least_soft: int = 2) -> str:
    """DuckDB SQL for the columns page_id, host, path, rule, verdict."""
    up = f"'{ascii_uppercase}', '{ascii_lowercase}'"
    order = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in order]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.text}'" for f, r in zip(fits, order)) + " END"
    said = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, order))
    hit = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    bad = " OR ".join(map(hit, strict)) + " OR " + " + ".join(f"CAST({hit(t)} AS INT)" for t in soft) + f" >= {least_soft}"
    return f"""
SELECT page_id, host, path, {rule} AS rule, CASE {said} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT page_id, coalesce(lower(url), '') AS low,
             coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), {up}), '') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
      FROM pages) p"""
