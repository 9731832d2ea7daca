"""Entity resolution: duplicate groups by key, and the pairwise merge decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, key: str, id_col: str, least: int = 2) -> DataFrame:
    """Keys with several rows: count and least id. Members stay in the table; nothing is collected."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where(F.col("n") >= least)


def merge_decision(a: str, b: str) -> Column:
    """(may_merge, reason) for two structs of standardized columns: vetoes in order, then the units decide."""
    x = lambda side, c: F.col(f"{side}.{c}")
    text = lambda side, c: F.upper(F.trim(F.coalesce(x(side, c), F.lit(""))))
    both = lambda c: (text(a, c) != "") & (text(b, c) != "")
    private = x(a, "is_private_residence") | x(b, "is_private_residence") | (text(a, "street1") == "PRIVATE RESIDENCE") | (text(b, "street1") == "PRIVATE RESIDENCE")
    key_differs = both("normalized_address_key") & (x(a, "normalized_address_key") != x(b, "normalized_address_key"))
    no, yes = F.lit(False), F.lit(True)
    say = lambda ok, why: F.struct(ok.alias("may_merge"), F.lit(why).alias("reason"))
    return (
        F.when(~both("street1"), say(no, "EMPTY_STREET_ISOLATION")).when(private, say(no, "PRIVATE_RESIDENCE_ISOLATION"))
        .when(~both("building_key") | (x(a, "building_key") != x(b, "building_key")), say(no, "DISTINCT_BUILDINGS"))
        .when(x(a, "is_hub") | x(b, "is_hub") | x(a, "cmra") | x(b, "cmra"), say(no, "CO_LOCATION_ISOLATION_INVARIANT"))
        .when(both("street2") & (text(a, "street2") != text(b, "street2")), say(no, "SECONDARY_UNIT_MISMATCH"))
        .when((text(a, "street2") == "") != (text(b, "street2") == ""), say(no, "SECONDARY_UNIT_ASYMMETRY"))
        .when(key_differs, say(no, "KEY_MISMATCH")).when(both("street2"), say(yes, "MATCHING_SECONDARY_UNIT")).otherwise(say(yes, "SINGLE_TENANT_BUILDING"))
    )


def against_representative(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Each row with the decision against its building's representative (least id) of the same unit, or else of the building: one decision
    a row, so a building with many rows forms no pairs among them."""
    keyed = df.withColumn("_self", F.struct("*"))
    rep = keyed.groupBy("building_key", "street2").agg(F.min_by("_self", id_col).alias("rep"))
    joined = keyed.join(rep.withColumnRenamed("building_key", "_b").withColumnRenamed("street2", "_u"), (F.col("building_key") == F.col("_b")) & (F.col("street2") == F.col("_u")))
    out = joined.withColumn("decision", merge_decision("_self", "rep"))
    return out.select(id_col, F.col(f"rep.{id_col}").alias("rep_id"), F.col("decision.may_merge").alias("may_merge"), F.col("decision.reason").alias("reason"))
