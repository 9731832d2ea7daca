"""Address tables derived from the driver's tables by SQL that Spark and DuckDB both run as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("Oak", "Maple", "Washington", "First", "Second", "42nd", "5", "Martin Luther King", "Cedar Hill", "Elm", "Pine", "Lake View", "Third")
SUFFIXES = ("Street", "St", "Avenue", "ave.", "Boulevard", "Rd", "Drive", "Lane", "Court", "Pkwy", "Place")
DIRECTIONS = ("", "", "North ", "S ", "West ", "", "NE ")
UNITS = ("", " Apt 5", " Suite 200", " #12", "", " FL 3", ", Unit B-4")
PLACES = (("New York", "NY", "100"), ("Dallas", "Texas", "752"), ("Los Angeles", "california", "900"), ("Chicago", "IL", "606"), ("Denver", "Co", "802"), ("Miami", "US-FL", "331"), ("Boston", "MA", "021"), ("Seattle", "Washington", "981"))


def pick(values: tuple[str, ...], n: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE {n} % {len(values)} {whens} END"


def _text(n: str) -> str:
    return f"CAST({n} AS VARCHAR(20))"


def _zip(k: str) -> str:
    return f"{pick(tuple(p[2] for p in PLACES), k)} || right('00' || {_text(f'{k} % 100')}, 2)"


def street(k: str) -> str:
    return f"{_text(f'{k} * 7 % 900 + 1')} || ' ' || {pick(DIRECTIONS, k)} || {pick(NAMES, k)} || ' ' || {pick(SUFFIXES, k)}"


def addresses(address: str, building: str, table: str = "customer") -> str:
    """Addresses by two expressions over a table: the address' number, which picks the unit, and its building's, which picks all else."""
    return f"""
SELECT a AS addr_id, {street('k')} || {pick(UNITS, 'a')} AS street1, CAST('' AS VARCHAR(1)) AS street2, {pick(tuple(p[0] for p in PLACES), 'k')} AS city,
  CASE WHEN k % 29 = 0 THEN 'NV' WHEN k % 31 = 0 THEN '' ELSE {pick(tuple(p[1] for p in PLACES), 'k')} END AS state,
  CASE WHEN k % 17 = 0 THEN '12' WHEN k % 13 = 0 THEN {_zip('k')} || '-1234' ELSE {_zip('k')} END AS postal_code
FROM (SELECT CAST({address} AS BIGINT) AS a, CAST({building} AS BIGINT) AS k FROM {table}) c
"""


#: Five customers share a building, and some of them an address; both grow with the table.
_ADDRESS = "c_custkey - CASE WHEN c_custkey % 4 = 0 AND c_custkey % 5 <> 0 THEN 1 ELSE 0 END"
ADDR = addresses(_ADDRESS, "(c_custkey - c_custkey % 5) / 5")

LINES = f"""
SELECT s_suppkey AS addr_id, {street('k')} || ', ' || CASE WHEN k % 3 = 0 THEN 'Suite 10, ' ELSE '' END || {pick(tuple(p[0] for p in PLACES), 'k')} || ', '
  || {pick(('NY', 'TX', 'CA', 'IL', 'CO', 'FL', 'MA', 'WA'), 'k')} || ' ' || {_zip('k')} AS line
FROM (SELECT s_suppkey, CAST(s_suppkey AS BIGINT) AS k FROM supplier) s
"""

POINTS = """
SELECT CAST(s_suppkey AS BIGINT) AS point_id, 'K' || CAST(s_suppkey % 60 AS VARCHAR(20)) AS address_key, CAST(-90.0 + (s_suppkey * 3719 % 18001) / 100.0 AS DOUBLE) AS latitude,
  CAST(-180.0 + (s_suppkey * 7177 % 36000) / 100.0 AS DOUBLE) AS longitude
FROM supplier
"""

CENTERS = """
SELECT CAST(c_custkey AS BIGINT) AS center_id, CAST(-90.0 + (c_custkey * 2657 % 18001) / 100.0 AS DOUBLE) AS lat, CAST(-180.0 + (c_custkey * 5381 % 36000) / 100.0 AS DOUBLE) AS lon
FROM customer
"""

SEGMENTS = f"""
SELECT CAST(s_suppkey AS BIGINT) AS seg_id, upper({pick(('Oak St', 'Maple Ave', 'Elm Dr', 'Pine Ln'), 's_suppkey')}) AS street_name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE right('00000' || {_text('10000 + s_suppkey % 7')}, 5) END AS postal_code,
  CAST(s_suppkey * 20 % 900 + 1 AS INT) AS from_number, CAST(s_suppkey * 20 % 900 + 1 + (s_suppkey % 3 - 1) * 99 AS INT) AS to_number, CAST(30 + s_suppkey % 10 AS DOUBLE) AS start_lat, CAST(-100 + s_suppkey % 20 AS DOUBLE) AS start_lon,
  CAST(30 + s_suppkey % 10 AS DOUBLE) + 0.01 AS end_lat, CAST(-100 + s_suppkey % 20 AS DOUBLE) + 0.02 AS end_lon, {pick(('BOTH', 'ODD', 'EVEN'), 's_suppkey')} AS parity
FROM supplier
"""

HOUSES = f"""
SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey * 13 % 1000 AS INT) AS number, upper({pick(('Oak St', 'Maple Ave', 'Elm Dr', 'Pine Ln'), 'c_custkey')}) AS street_name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE right('00000' || {_text('10000 + c_custkey % 7')}, 5) END AS postal_code
FROM customer
"""

TYPOS = """
SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey AS BIGINT) AS nation, upper(n_name) AS clean,
  CASE c_custkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN substr(upper(n_name), 1, 1) || substr(upper(n_name), 3, 1) || substr(upper(n_name), 2, 1) || substr(upper(n_name), 4) WHEN 2 THEN substr(upper(n_name), 1, 3) || substr(upper(n_name), 5) ELSE substr(upper(n_name), 1, 2) || 'X' || substr(upper(n_name), 4) END AS dirty
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

CALIBRATION = """
SELECT CAST(l.doc_id AS BIGINT) AS id, CAST(n_chars % 1000 AS DOUBLE) / 1000.0 AS score, CASE WHEN (l.quality = 1) = (n_chars % 1000 > 300) THEN true ELSE false END AS was_correct
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

AUDIT = """
SELECT CAST(event_id AS BIGINT) AS seq, 'A' || CAST(event_id % 499 AS VARCHAR(20)) AS audit_id, event_type AS action_type
FROM events
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the queries above over the tables of a folder, without names in the session's catalog."""
    import re

    args, out = {}, sql
    for name in ("customer", "supplier", "nation", "events", "labels", "documents", "orders", "part"):
        if re.search(rf"(FROM|JOIN) {name}\b", out):
            out = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", out)
            args[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(out, **args)
