"""Checks against a table of postal codes and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_key, damerau_levenshtein, within_one_edit
from ..plans.barrier import settle
from ..sources.files import postal_candidates

NOISE = ("THE", "OF", "CITY", "TOWN", "TOWNSHIP", "VILLAGE", "DE", "LA", "LE")
PENALTY = {"place_mismatch": 0.12, "state_mismatch": 0.25, "postal_unknown": 0.25}


def name_tokens(name: Column) -> Column:
    """Words of a folded name (`ascii_key`) without noise; ST is SAINT."""
    words = F.filter(F.split(F.regexp_replace(name, "[^A-Z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(*NOISE))
    return F.transform(words, lambda w: F.when(w == "ST", "SAINT").otherwise(w))


def names_agree(a: Column, b: Column) -> Column:
    """Of two names' words (`name_tokens`): the same, one name's words all in the other (three letters at least), or of four letters at
    least and one edit apart, two where a name has over eight letters. Only such longer names reach Python."""
    x, y = a, b
    subset = lambda p, q: (F.size(p) > 0) & (F.size(F.array_except(p, q)) == 0) & (F.length(F.array_join(p, "")) >= 3)
    a, b = F.array_join(x, ""), F.array_join(y, "")
    sure = (x == y) | subset(x, y) | subset(y, x) | ((F.least(F.length(a), F.length(b)) >= 4) & within_one_edit(a, b))
    ask = ~sure & (F.least(F.length(a), F.length(b)) >= 4) & (F.greatest(F.length(a), F.length(b)) > 8) & (F.abs(F.length(a) - F.length(b)) <= 2)
    return sure | F.coalesce(damerau_levenshtein(F.when(ask, a), F.when(ask, b)) <= 2, F.lit(False))


def validate(rows: DataFrame, places: DataFrame, id_col: str = "id") -> DataFrame:
    """id and status of rows (id, postal_code, city, state, iso2) against places (country, postal, place, admin1_code): confirmed, place_mismatch,
    state_mismatch, postal_unknown, or not_checked without a code. The finest spelling of the code that the table knows counts."""
    spelled = rows.withColumn("_city", ascii_key(F.col("city"))).select(id_col, "_city", "state", "iso2", F.posexplode(postal_candidates(F.col("postal_code"), F.col("iso2"))).alias("pos", "cand"))
    p = places.select(F.col("country").alias("_c"), F.upper("postal").alias("_p"), ascii_key(F.col("place")).alias("_name"), "admin1_code")
    spelled = settle(spelled.withColumn("_city", name_tokens(F.col("_city"))))
    p = settle(p.withColumn("_name", name_tokens(F.col("_name"))))
    met = settle(spelled.join(p, (F.col("iso2") == F.col("_c")) & (F.col("cand") == F.col("_p"))))
    met = met.withColumns({"_place": names_agree(F.col("_city"), F.col("_name")), "_state": (F.col("state") == "") | (F.coalesce("admin1_code", F.lit("")) == "") | (F.col("state") == F.col("admin1_code"))})
    best = met.groupBy(id_col, "pos").agg(F.max((F.col("_place") & F.col("_state"))).alias("both"), F.max("_place").alias("place_ok"), F.max("_state").alias("state_ok"))
    best = best.groupBy(id_col).agg(F.min_by(F.struct("both", "place_ok", "state_ok"), "pos").alias("m"))
    out = rows.join(best, id_col, "left")
    status = F.when(F.coalesce("postal_code", F.lit("")) == "", "not_checked").when(F.col("m").isNull(), "postal_unknown").when(F.col("m.both"), "confirmed").when(~F.col("m.state_ok"), "state_mismatch").otherwise("place_mismatch")
    return out.select(id_col, status.alias("status"))


def penalised(composite: Column, status: Column) -> Column:
    """The composite less the status' penalty, at least 0, rounded to 4 places."""
    loss = F.lit(0.0)
    for name, x in PENALTY.items():
        loss = F.when(status == name, x).otherwise(loss)
    return F.round(F.greatest(F.lit(0.0), composite - loss), 4)
