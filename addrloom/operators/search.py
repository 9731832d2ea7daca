"""Typeahead search over a prefix index."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dims import STATES, UNITS
from ..functions.text import ascii_key, haversine, within_one_edit

LONGEST = 24


def prefix_index(records: DataFrame, text: str, rec_id: str = "rec_id") -> DataFrame:
    """(prefix, rec_id), each once: all prefixes of up to 24 characters of every word. A table to be written partitioned or bucketed by
    prefix, so that a search reads few files."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(ascii_key(F.col(text)), F.lit(r"(\w+)"), 1), lambda w: w != ""))
    prefixes = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.least(F.length(w), F.lit(LONGEST))), lambda i: F.substr(w, F.lit(1), i))))
    return records.select(F.explode(F.array_distinct(prefixes)).alias("prefix"), F.col(rec_id).alias("rec_id"))


def _having_all(index: DataFrame, tokens: list[str], typos: bool) -> DataFrame:
    """rec_id and typo of records that hold every token, exactly or (only for a token that no record holds exactly) within one edit."""
    out = None
    for k, t in enumerate(tokens):
        exact = index.where(F.col("prefix") == t).select("rec_id").distinct().withColumn(f"_t{k}", F.lit(False))
        if typos and len(t) >= 3 and exact.isEmpty():
            close = index.where(F.length("prefix").between(len(t) - 1, len(t) + 1)).where(within_one_edit(F.col("prefix"), F.lit(t)))
            exact = close.select("rec_id").distinct().withColumn(f"_t{k}", F.lit(True))
        out = exact if out is None else out.join(exact, "rec_id")
    flags = [F.col(f"_t{k}") for k in range(len(tokens))]
    typo = flags[0]
    for f in flags[1:]:
        typo = typo | f
    return out.select("rec_id", typo.alias("typo"))


def search(records: DataFrame, index: DataFrame, query: str, max_results: int = 5, state: str | None = None, lat: float | None = None, lon: float | None = None, radius_km: float | None = None, typos: bool = True) -> DataFrame:
    """The best records (rec_id, street1, city, state, postal_code and the score) for a query: 1, plus 0.5 where the record starts with the query, times
    0.85 after a typo, plus up to 2 for being near. Ties go to the lesser id."""
    clean = " ".join(query.upper().split())
    tokens = re.findall(r"\w+", clean)
    if not tokens or max_results <= 0:
        return records.limit(0).withColumn("score", F.lit(0.0))
    unit = next((k for k, t in enumerate(tokens) if t in UNITS), None)
    ids = _having_all(index, tokens, typos)
    if unit and len(tokens) > 2 and ids.isEmpty():
        ids = _having_all(index, tokens[:unit], typos)
    rows = records.join(ids, "rec_id")
    if state:
        rows = rows.where(F.col("state") == STATES.get(state.upper().strip(), state.upper().strip()))
    whole = F.concat(F.concat_ws(", ", "street1", F.nullif("street2", F.lit("")), "city", "state"), F.lit(" "), F.col("postal_code"))
    score = (F.lit(1.0) + F.when(F.upper(whole).startswith(clean), 0.5).otherwise(0.0)) * F.when(F.col("typo"), 0.85).otherwise(1.0)
    if lat is not None and lon is not None:
        km = F.round(haversine(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude")), 1) / 1000.0
        if radius_km is not None:
            rows = rows.where(km <= radius_km)
        score = score + F.coalesce(F.greatest(F.lit(0.0), 2.0 - F.least(km / 50.0, F.lit(2.0))), F.lit(0.0))
    return rows.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "rec_id").limit(max_results)


def highlights(text: str, tokens: list[str]) -> list[tuple[int, int]]:
    """Merged ranges of a text that the tokens cover."""
    found = sorted((m.start(), m.end()) for t in dict.fromkeys(tokens) for m in re.finditer(re.escape(t), text.upper()))
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def merged_ranges(ranges):
    """The same merge as a Column over array<struct<start,end>>: sort, then fold into the last range or a new one."""
    kind = "array<struct<start:int,end:int>>"
    start = F.array().cast(kind)

    def step(out, r):
        last = F.get(out, F.size(out) - 1)
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (r["start"] <= last["end"]), joined).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(F.array_sort(ranges), start, step)
