"""URL filter: longest fitting host and path rule, else a weighted vocabulary found by an Aho-Corasick automaton.

A term counts where neither neighbour is an ASCII letter or digit. One strict term rejects, and so do `soft_limit`
distinct soft terms. The automaton is built once per Python worker from the vocabulary, which is a parameter.

Defined cases: a null url or one without `://` has empty host and path, fits no rule, and the vocabulary looks at the
url itself (null as empty); repeated rows are judged one by one; of two fitting rules of one length, block wins; only
the id and the url are read, so extra columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str  # with its leading slash

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
STRICT = ("casino", "porn", "xxx", "viagra", "escort", "spam", "malware", "phishing", "hentai", "slots")
SOFT = ("cheap", "free", "pills", "bets", "bet", "ads", "track", "tracker", "click", "deal", "deals", "win", "farm", "poker", "adult", "loan", "loans", "crack", "torrent")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The fitting rule as a struct (rule, verdict), or null. The rules are tried from the longest, as one CASE."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def count_terms(strict: tuple[str, ...], soft: tuple[str, ...]):
    """A pandas UDF from a url to (distinct strict terms, distinct soft terms)."""

    @F.pandas_udf("struct<n_strict:int,n_soft:int>")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for kind, words in (("soft", soft), ("strict", strict)):
            for w in words:
                machine.add_word(w, (kind, w))
        machine.make_automaton()
        word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in batches:
            rows = []
            for url in batch:
                found = {"strict": set(), "soft": set()}
                low = (url or "").translate(LOWER)
                for end, (kind, w) in machine.iter(low):
                    start = end - len(w) + 1
                    if (start == 0 or low[start - 1] not in word) and (end + 1 == len(low) or low[end + 1] not in word):
                        found[kind].add(w)
                rows.append((len(found["strict"]), len(found["soft"])))
            yield pd.DataFrame(rows, columns=["n_strict", "n_soft"])

    return terms


LOWER = {c: c + 32 for c in range(65, 91)}


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = 2) -> DataFrame:
    """page_id, url, host, path, rule, n_strict, n_soft, verdict for each row. One scan of two columns, no shuffle."""
    df = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path = split_url(F.col("url"))
    df = df.withColumns({"host": host, "path": path, "_terms": count_terms(tuple(strict), tuple(soft))(F.col("url"))})
    df = df.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), tuple(rules)))
    vocabulary = F.when((F.col("_terms.n_strict") > 0) | (F.col("_terms.n_soft") >= soft_limit), "block").otherwise("allow")
    return df.select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_terms.n_strict").alias("n_strict"), F.col("_terms.n_soft").alias("n_soft"), F.coalesce(F.col("_rule.verdict"), vocabulary).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _hits(words: tuple[str, ...]) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN 1 ELSE 0 END" for w in words)


def _case(column: str) -> str:
    whens = []
    for r in sorted(RULES, key=lambda r: (-len(r.name), r.verdict != "block", r.name)):
        whens.append(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name if column == 'rule' else r.verdict}'")
    return "CASE " + " ".join(whens) + " END"


ORACLE = f"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
)
SELECT page_id, host, path, {_case("rule")} AS rule,
  coalesce({_case("verdict")}, CASE WHEN {_hits(STRICT)} > 0 OR {_hits(SOFT)} >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM p
"""

QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES = {"op8_url_filter": ORACLE}
