"""Corporate hubs: the first entry of a small ordered dimension whose patterns an address meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import first_by

SCHEMA = "ord int, provider string, category string, risk double, state string, city string, street_pattern string, unit_pattern string"


def token_run(text: Column, pattern: Column) -> Column:
    """Whether the pattern's words stand in the text between characters that are no letters or digits."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![A-Z0-9])\Q"), pattern, F.lit(r"\E(?![A-Z0-9])")))


def match_hubs(rows: DataFrame, hubs: DataFrame, id_col: str = "id") -> DataFrame:
    """id and the matching entry: state and first street word equal, street pattern as a run of tokens, unit and city where the entry
    names them; least ord wins. The pair (state, first word of the pattern) is an equality, so no row meets every entry."""
    h = hubs.select(*[F.col(c).alias(f"h_{c}") for c in hubs.columns]).withColumn("_w", F.split("h_street_pattern", " ")[0])
    words = rows.withColumn("_w", F.explode(F.array_distinct(F.split("street1", "[^A-Z0-9]+"))))
    met = words.join(h, (words["_w"] == h["_w"]) & (F.col("state") == F.col("h_state")))
    met = met.where(token_run(F.col("street1"), F.col("h_street_pattern")) & ((F.col("h_city") == "") | (F.col("h_city") == F.col("city"))) & ((F.col("h_unit_pattern") == "") | token_run(F.col("street2"), F.col("h_unit_pattern"))))
    return first_by(met.select(id_col, *[F.col(f"h_{c}").alias(c) for c in hubs.columns if c != "state" and c != "city"]), [id_col], "ord").drop("ord", "street_pattern", "unit_pattern")


def with_hubs(rows: DataFrame, hubs: DataFrame, id_col: str = "id") -> DataFrame:
    """rows with is_hub, hub_provider, hub_category and hub_risk; to be scored by `scoring`."""
    hit = match_hubs(rows, hubs, id_col).select(F.col(id_col).alias("_id"), F.col("provider").alias("hub_provider"), F.col("category").alias("hub_category"), F.col("risk").alias("hub_risk"))
    return rows.join(hit, F.col(id_col) == F.col("_id"), "left").drop("_id", "is_hub").withColumn("is_hub", F.col("hub_provider").isNotNull())
