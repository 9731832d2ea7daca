"""Quality rules as a bitmask ledger, in DataFrame functions only.

`ledger` evaluates every rule once per document and stores the measurements and one failure bit per rule.
`apply_policy` turns a ledger into verdicts under a versioned policy (a set of bits), and `ablation` reports what each
rule contributes, both by bit operations on the stored mask, without reading texts again.

Defined cases: a null text counts as empty; an empty or blank text has no words, zero measurements and fails
`few_words`; repeated rows and ids are judged row by row; columns other than the id and the text are not read, so
extra columns of any name do no harm; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLANKS = " \t\n\x0b\f\r"
SPLIT = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"

#: Rule name, its bit, its condition of failure over the measurements. Bits are never given to another rule.
RULES: tuple[tuple[str, int, str], ...] = (
    ("few_words", 0, "n_words < 50"),
    ("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    ("symbols", 2, "10 * n_symbols > n_words"),
    ("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    ("shouting", 4, "2 * n_upper_words > n_words"),
    ("exclamations", 5, "10 * n_exclamations > 3 * n_words"),
    ("word_length", 6, "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    ("few_letter_words", 7, "5 * n_letter_words < 3 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that reject."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << bit for name, bit, _ in RULES if name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", tuple(name for name, _, _ in RULES))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows of three that occur twice or more. Distinct hashes prove distinct windows; else the windows
    themselves are sorted with their places, and equal neighbours give the places that repeat."""

    def places(t: Column) -> Column:
        again = F.filter(t, lambda x, k: x["w"].eqNullSafe(F.get(t, k - 1)["w"]) | x["w"].eqNullSafe(F.get(t, k + 1)["w"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    windows = F.transform(hashes, lambda h, i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))
    bound = F.transform(F.array(F.sort_array(windows)), places)  # an array of one: binds the sorted windows for the lambda
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(F.get(F.transform(bound, covered), F.lit(0)))


def measurements(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = df.withColumn("words", F.array_remove(F.split("t", SPLIT), ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.length(_without(x, BLANKS)) > 0))
    df = df.withColumn("hashes", F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("words", F.lit(1), F.size("words") - 2), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))))
    length = F.length("t")
    return df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("t"), BLANKS)).cast("long").alias("word_chars"),
        (length - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: (w == F.upper(w)) & (w != F.lower(w)))).cast("long").alias("n_upper_words"),
        (length - F.length(_without(F.col("t"), "!"))).cast("long").alias("n_exclamations"),
        F.size(F.filter("words", lambda w: F.lower(w) != F.upper(w))).cast("long").alias("n_letter_words"),
    )


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements and `failed_bits`, one row for each input row."""
    bits = [F.when(F.expr(cond), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for _, bit, cond in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measurements(docs, doc_id, text).withColumn("failed_bits", mask)


def apply_policy(led: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    return led.withColumn(column, F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that it alone rejects. The ledger is first counted by
    mask, at most 2^rules rows, so the rest works on a bounded table."""
    masks = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("b")) for name, bit, _ in RULES if name in policy.rules])
    rows = masks.select("m", "n", F.explode(rules).alias("r"))
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("m").bitwiseAND(F.col("r.b")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m") == F.col("r.b"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(table(spark, sf_dir, "documents")), V1)
    base_failed = F.col("failed_bits").bitwiseAND(F.lit(BASE.mask)) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "failed_bits")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d
), win AS (
  SELECT doc_id, i, w AS a, lead(w, 1) OVER v AS b, lead(w, 2) OVER v AS c FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)
), dup AS (
  SELECT doc_id, i FROM win WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) x(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words) AS n_words, list_sum(list_transform(words, lambda x: length(x))) AS wc,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_exclamations,
    len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x))) AS n_upper_words,
    len(list_filter(words, lambda x: upper(x) <> lower(x))) AS n_letter_words
  FROM d LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, coalesce(wc, 0) AS word_chars,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_upper_words > n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_exclamations > 3 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words > 0 AND (coalesce(wc, 0) < 2 * n_words OR coalesce(wc, 0) > 20 * n_words) THEN 64 ELSE 0 END
    + CASE WHEN 5 * n_letter_words < 3 * n_words THEN 128 ELSE 0 END AS bits
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (bits & 3) <> 0 AS base_failed,
  bits = 0 AS kept, CAST(bits AS BIGINT) AS failed_bits
FROM f
"""

QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": ORACLE}
