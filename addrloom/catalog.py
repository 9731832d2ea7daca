"""Registry of the engine's own queries and their oracle SQL. Each query applies an operator to a whole table of fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as X
from .functions import cleanup, country, dims, grammar, layout, text, us
from .operators import entity, evaluation, ledger, lookup, reference, registry, scoring, search
from .plans import sqlfunctions
from .plans.standardize import dedupe_apply, split_line, standardized
from .sources import files

FLAGSHIP = "shared_buildings_by_state"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL text that the oracles share


def _map(table: dict[str, str], key: str) -> str:
    return "(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "})[" + key + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in sorted(values)) + ")"


ZIP3_SQL = "CASE " + " ".join(f"WHEN z BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in dims.ZIP3_RANGES) + " END"
UNIT_SQL = us.UNIT.replace("'", "''")


def _zip3(z: str) -> str:
    return ZIP3_SQL.replace("WHEN z ", f"WHEN try_cast(substr({z}, 1, 3) AS INTEGER) ")


def _soundex(w: str) -> str:
    # H and W between two letters of one code do not part them: they are taken out first, behind the first letter.
    kept = f"substr({w}, 1, 1) || regexp_replace(substr({w}, 2), '[HW]', '', 'g')"
    x = f"translate({kept}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    for d in "0123456":
        x = f"regexp_replace({x}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {w} = '' THEN '' ELSE substr({w}, 1, 1) || substr(regexp_replace(substr({x}, 2), '0', '', 'g') || '000', 1, 3) END"


def _ordinal(n: str) -> str:
    return f"({n}) || CASE WHEN ({n}) % 100 BETWEEN 11 AND 13 THEN 'TH' WHEN ({n}) % 10 = 1 THEN 'ST' WHEN ({n}) % 10 = 2 THEN 'ND' WHEN ({n}) % 10 = 3 THEN 'RD' ELSE 'TH' END"


STD = f"""
WITH a AS ({X.ADDR}), b AS (
  SELECT addr_id, city, upper(state) AS st, upper(trim(postal_code)) AS pc, regexp_replace(regexp_replace(trim(upper(street1)), '\\s+', ' ', 'g'), '[ ,.-]+$', '') AS line,
    street1 AS raw1, city AS raw_city, state AS raw_state FROM a
), c AS (
  SELECT *, regexp_extract(line, '{UNIT_SQL}', 1) AS uk, regexp_extract(line, '{UNIT_SQL}', 2) AS uv, regexp_replace(line, '{UNIT_SQL}', '') AS street,
    CASE WHEN regexp_matches(pc, '^[0-9]{{5}}(-[0-9]{{4}})?$') THEN substr(pc, 1, 5) ELSE '' END AS zip5 FROM b
), d AS (
  SELECT *, CASE WHEN uv = '' THEN '' ELSE coalesce({_map(dims.UNITS, 'uk')}, 'STE') || ' ' || uv END AS street2,
    list_filter(list_transform(string_split(street, ' '), lambda x: regexp_replace(x, '^[ ,.-]+|[ ,.-]+$', '', 'g')), lambda x: x <> '') AS t FROM c
), e AS (
  SELECT *, len(t) AS n, CASE WHEN len(t) >= 4 THEN {_map(dims.DIRECTIONS, 't[2]')} END AS pre FROM d
), f AS (
  SELECT *, t[(CASE WHEN pre IS NULL THEN 2 ELSE 3 END):(n - 1)] AS name, {_map(dims.SUFFIXES, 't[n]')} AS suffix,
    regexp_replace(st, '^USA?-', '') AS st2 FROM e
), g AS (
  SELECT *, list_transform(name, lambda x: coalesce({_map(dims.ORDINALS, 'x')}, CASE WHEN regexp_matches(x, '^[0-9]{{1,3}}(ST|ND|RD|TH)?$') THEN {_ordinal("CAST(regexp_extract(x, '^[0-9]+') AS INTEGER)")} END, x)) AS spoken,
    coalesce({_map(dims.STATES, 'st2')}, st2) AS st3 FROM f
), std AS (
  SELECT addr_id, concat_ws(' ', t[1], pre, array_to_string(spoken, ' '), suffix) AS street1, street2, upper(city) AS city,
    CASE WHEN st3 IN {_in(dims.STATE_CODES)} THEN st3 ELSE coalesce({_zip3('zip5')}, st3) END AS state, pc AS postal_code, zip5, raw1, raw_city, raw_state, pre, spoken FROM g
)
"""
KEY_SQL = "concat_ws('|', street1, street2, city, state, zip5, 'USA')"
BUILDING_SQL = "concat_ws('|', street1, '', city, state, zip5, 'USA')"


def std(spark, d, score=False):
    return standardized(X.view(spark, d, X.ADDR), score=score).withColumn("addr_id", F.col("row.addr_id"))


# standardization and keys


@query(STD + f"""SELECT state, count(*) AS n_buildings, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT state, {BUILDING_SQL} AS b, count(*) AS n FROM std GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY state""")
def shared_buildings_by_state(spark, d):
    """How many buildings are shared by several customers, by state."""
    groups = std(spark, d).groupBy("state", "building_key").agg(F.count("*").alias("n")).where("n > 1")
    return groups.groupBy("state").agg(F.count("*").alias("n_buildings"), F.sum("n").alias("n_rows"))


@query(STD + f"SELECT addr_id, street1, street2, city, state, postal_code, zip5, {KEY_SQL} AS normalized_address_key, {BUILDING_SQL} AS building_key, 'standardized' AS address_status FROM std")
def standardize_structured(spark, d):
    return std(spark, d).select("addr_id", "street1", "street2", "city", "state", "postal_code", "zip5", "normalized_address_key", "building_key", "address_status")


_WORD = "regexp_replace(string_split(array_to_string(spoken, ' '), ' ')[1], '[^A-Z]', '', 'g')"


@query(STD + f"""SELECT addr_id, split_part(street1, ' ', 1) || '|' || CASE WHEN regexp_matches(spoken[1], '^[0-9]+(ST|ND|RD|TH)$') THEN '#' || regexp_extract(spoken[1], '^[0-9]+') ELSE {_soundex(_WORD)} END
  || '|' || CASE WHEN length(zip5) >= 5 THEN zip5 ELSE city END AS phonetic_key FROM std""")
def phonetic_keys(spark, d):
    return std(spark, d).select("addr_id", "phonetic_key")


@query(STD + f"SELECT {KEY_SQL} AS normalized_address_key, count(*) AS n, min(addr_id) AS first_id FROM std GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return entity.duplicate_groups(std(spark, d), "normalized_address_key", "addr_id")


_LINE = X.LINES
_PARTS = r"^\s*([^,]+?)\s*,\s*(?:((?:APT|SUITE|STE|UNIT|FL|FLOOR|BLDG|#)[^,]*?)\s*,\s*)?([A-Za-z .''-]+?)\s*,\s*([A-Za-z]{2}|[A-Za-z]+(?: [A-Za-z]+)?)\s+(\d{5}(?:-\d{4})?)\s*$"


@query(f"SELECT CAST(addr_id AS BIGINT) AS addr_id, " + ", ".join(f"regexp_extract(line, '(?i){_PARTS}', {k}) AS {c}" for k, c in enumerate(("street1", "street2", "city", "state", "postal_code"), 1)) + f" FROM ({_LINE})")
def split_comma_lines(spark, d):
    lines = X.view(spark, d, _LINE).withColumn("p", split_line(F.col("line")))
    return lines.select(F.col("addr_id").cast("long").alias("addr_id"), "p.*")


@query(f"SELECT count(*) AS n, count(DISTINCT line) AS n_lines, CAST(sum(CASE WHEN regexp_matches(line, '(?i){_PARTS}') THEN 1 ELSE 0 END) AS BIGINT) AS n_split FROM ({_LINE})")
def distinct_first(spark, d):
    """Distinct lines are split once and joined back to every row."""
    lines = X.view(spark, d, _LINE)
    done = dedupe_apply(lines, ["line"], lambda u: u.withColumn("p", split_line(F.col("line"))))
    return done.agg(F.count("*").alias("n"), F.countDistinct("line").alias("n_lines"), F.sum(F.when(F.col("p.postal_code") != "", 1).otherwise(0)).alias("n_split"))


@query(STD + f"""SELECT addr_id, CASE WHEN zip5 <> '' AND coalesce({_zip3('zip5')}, '') = state THEN 'AA' ELSE 'A1' END || ',BB' || CASE WHEN street2 <> '' THEN ',CC' ELSE '' END AS footnotes,
  CASE WHEN split_part(street2, ' ', 1) IN ('STE', 'FL', 'RM', 'DEPT', 'BLDG', 'OFC') THEN 'COMMERCIAL' WHEN split_part(street2, ' ', 1) IN ('APT', 'UNIT', 'LOT', 'TRLR', 'SPC') THEN 'RESIDENTIAL' ELSE 'UNKNOWN' END AS rdi,
  CASE WHEN zip5 <> '' AND coalesce({_zip3('zip5')}, '') <> state THEN 'UNDELIVERABLE' ELSE 'DELIVERABLE' END AS deliverability FROM std""")
def delivery_intelligence(spark, d):
    return scoring.delivery(std(spark, d)).select("addr_id", F.array_join("footnotes", ",").alias("footnotes"), "rdi", "deliverability")


SCORED = STD + f""", z AS (
  SELECT *, {_zip3('zip5')} AS zs, state IN {_in(dims.STATE_CODES)} AS ok_state, zip5 = '' AS no_zip FROM std
), p AS (
  SELECT *, 1.0 - CASE WHEN ok_state THEN 0 ELSE 0.40 END - CASE WHEN no_zip AND ok_state THEN 0.15 WHEN no_zip THEN 0.30 ELSE 0 END AS s_ref,
    CASE WHEN substr(zip5, 1, 3) IN {_in(scoring.METRO_ZIP3)} THEN 0.92 WHEN zs IS NOT NULL OR ok_state THEN 0.85 ELSE 0.50 END AS s_geo,
    CASE WHEN zs IS NOT NULL THEN CASE WHEN zs = state THEN 1.0 ELSE 0.20 END WHEN no_zip AND state = '' THEN 0.20 ELSE 0.80 END AS s_cross, zs IS NOT NULL AND zs <> state AS mismatch FROM z
), s AS (
  SELECT *, round(CAST(0.35 + 0.35 * s_ref + 0.15 * s_geo + 0.15 * s_cross AS DOUBLE), 4) AS composite FROM p
), scored AS (
  SELECT *, CASE WHEN composite >= 0.95 AND NOT mismatch THEN 'AUTO_PASS' WHEN composite >= 0.80 THEN 'FUZZY_REVIEW' ELSE 'MANUAL_STEWARDSHIP' END AS tier,
    CASE WHEN mismatch THEN 'ERR_ZIP_STATE_MISMATCH' ELSE '' END AS codes FROM s
)
"""


@query(SCORED + "SELECT addr_id, composite, tier, codes AS reason_codes FROM scored")
def confidence_scores(spark, d):
    return std(spark, d, score=True).select("addr_id", "composite", "tier", F.array_join("reason_codes", ",").alias("reason_codes"))


@query(SCORED + """SELECT CASE WHEN tier = 'MANUAL_STEWARDSHIP' THEN 'REJECT_UNPARSEABLE' WHEN mismatch THEN 'AUTO_HEAL' ELSE 'AUTO_PASS' END AS action_type,
  CASE WHEN tier = 'MANUAL_STEWARDSHIP' OR mismatch THEN 'PENDING' ELSE 'APPROVED' END AS review_status, tier = 'MANUAL_STEWARDSHIP' AS to_ledger, count(*) AS n FROM scored GROUP BY ALL""")
def stewardship_actions(spark, d):
    return scoring.stewardship(std(spark, d, score=True)).groupBy("action_type", "review_status", "to_ledger").agg(F.count("*").alias("n"))


@query(SCORED + "SELECT codes AS code, count(*) AS n FROM scored WHERE codes <> '' GROUP BY 1")
def failure_reasons(spark, d):
    return std(spark, d, score=True).select(F.explode("reason_codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(SCORED + "SELECT tier = 'AUTO_PASS' AND NOT mismatch AS strict, tier IN ('AUTO_PASS', 'FUZZY_REVIEW') AND NOT mismatch AS lax, count(*) AS n FROM scored GROUP BY ALL")
def valid_addresses(spark, d):
    scored = std(spark, d, score=True)
    return scored.groupBy(scoring.is_acceptable().alias("strict"), scoring.is_acceptable(False).alias("lax")).agg(F.count("*").alias("n"))


@query(STD + f""", k AS (SELECT *, {BUILDING_SQL} AS b FROM std), u AS (SELECT DISTINCT addr_id, b, street2 FROM k), r AS (SELECT b, street2, min(addr_id) AS rep_id FROM u GROUP BY 1, 2)
SELECT u.addr_id, r.rep_id, true AS may_merge, CASE WHEN u.street2 = '' THEN 'SINGLE_TENANT_BUILDING' ELSE 'MATCHING_SECONDARY_UNIT' END AS reason FROM u JOIN r ON u.b = r.b AND u.street2 = r.street2""")
def merge_with_representative(spark, d):
    rows = std(spark, d, score=True).dropDuplicates(["addr_id", "building_key", "street2"]).select("addr_id", "street1", "street2", "building_key", "normalized_address_key", "is_private_residence", "is_hub", "cmra")
    return entity.against_representative(rows, "addr_id")


@query(STD + f""", u AS (SELECT addr_id, any_value(street2) AS street2, any_value({BUILDING_SQL}) AS b FROM std GROUP BY addr_id)
SELECT x.addr_id AS a_id, y.addr_id AS b_id, x.street2 = y.street2 AS may_merge, CASE WHEN x.street2 <> '' AND y.street2 <> '' AND x.street2 <> y.street2 THEN 'SECONDARY_UNIT_MISMATCH' WHEN (x.street2 = '') <> (y.street2 = '') THEN 'SECONDARY_UNIT_ASYMMETRY'
  WHEN x.street2 <> '' THEN 'MATCHING_SECONDARY_UNIT' ELSE 'SINGLE_TENANT_BUILDING' END AS reason FROM u x JOIN u y ON x.b = y.b AND x.addr_id < y.addr_id""")
def merge_decisions(spark, d):
    """The decision for pairs of addresses that share a building, each different address once."""
    rows = std(spark, d, score=True).dropDuplicates(["addr_id"]).select("addr_id", "street1", "street2", "building_key", "normalized_address_key", "is_private_residence", "is_hub", "cmra")
    a, b = rows.select("building_key", F.struct("*").alias("a")), rows.select("building_key", F.struct("*").alias("b"))
    pairs = a.join(b, "building_key").where("a.addr_id < b.addr_id").withColumn("x", entity.merge_decision("a", "b"))
    return pairs.select(F.col("a.addr_id").alias("a_id"), F.col("b.addr_id").alias("b_id"), "x.may_merge", "x.reason")


# scalar functions

_A = f"({X.ADDR})"


@query(f"""SELECT addr_id, coalesce({_map(dims.STATES, 's')}, s) AS code FROM (SELECT addr_id, regexp_replace(upper(state), '^USA?-', '') AS s FROM {_A})""")
def state_codes(spark, d):
    return X.view(spark, d, X.ADDR).select("addr_id", us.us_state(F.col("state")).alias("code"))


@query(f"""SELECT addr_id, p AS formatted, CASE WHEN regexp_matches(p, '^[0-9]{{5}}(-[0-9]{{4}})?$') THEN substr(p, 1, 5) ELSE '' END AS zip5 FROM (SELECT addr_id, upper(postal_code) AS p FROM {_A})""")
def postal_codes(spark, d):
    return X.view(spark, d, X.ADDR).withColumn("p", us.us_postal(F.col("postal_code"))).select("addr_id", "p.*")


@query(f"SELECT z, {_zip3('z')} AS state, count(*) AS n FROM (SELECT right('000' || CAST(o_orderkey % 1000 AS VARCHAR(20)), 3) AS z FROM orders) GROUP BY ALL")
def zip3_states(spark, d):
    z = spark.read.parquet(f"{d}/orders.parquet").select(F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0").alias("z"))
    return z.groupBy("z", us.zip3_state(F.col("z")).alias("state")).agg(F.count("*").alias("n"))


@query(f"SELECT w, {_soundex('w')} AS code, count(*) AS n FROM (SELECT regexp_replace(upper(unnest(string_split(p_name, ' '))), '[^A-Z]', '', 'g') AS w FROM part) GROUP BY ALL")
def soundex_words(spark, d):
    w = spark.read.parquet(f"{d}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("w"))
    w = w.select(F.regexp_replace(F.upper("w"), "[^A-Z]", "").alias("w"))
    return w.groupBy("w").agg(F.count("*").alias("n")).select("w", text.soundex(F.col("w")).alias("code"), "n")


@query(f"SELECT CAST(o_orderkey % 1013 AS BIGINT) AS k, {_ordinal('CAST(o_orderkey % 1013 AS BIGINT)')} AS word, count(*) AS n FROM orders GROUP BY ALL")
def ordinals(spark, d):
    k = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") % 1013).cast("long").alias("k"))
    return k.groupBy("k").agg(F.count("*").alias("n")).select("k", text.number_to_ordinal(F.col("k")).alias("word"), "n")


@query(f"SELECT id, clean, dirty, CAST(damerau_levenshtein(clean, dirty) AS INTEGER) AS distance FROM ({X.TYPOS})")
def edit_distances(spark, d):
    return X.view(spark, d, X.TYPOS).select("id", "clean", "dirty", text.damerau_levenshtein("clean", "dirty").alias("distance"))


@query(f"SELECT id, damerau_levenshtein(clean, dirty) <= 1 AS close, damerau_levenshtein(dirty, upper(n_name)) <= 1 AS near_next FROM ({X.TYPOS}) t JOIN nation ON n_nationkey = (nation + 1) % 25")
def edits_within_one(spark, d):
    t = X.view(spark, d, X.TYPOS).join(spark.read.parquet(f"{d}/nation.parquet"), F.expr("n_nationkey = (nation + 1) % 25"))
    return t.select("id", text.within_one_edit(F.col("clean"), F.col("dirty")).alias("close"), text.within_one_edit(F.col("dirty"), F.upper("n_name")).alias("near_next"))


@query(f"""WITH t AS (SELECT DISTINCT dirty AS token FROM ({X.TYPOS})), s AS (SELECT token, upper(n_name) AS entry, damerau_levenshtein(token, upper(n_name)) AS distance FROM t, nation),
b AS (SELECT token, CAST(distance AS INTEGER) AS distance, count(*) AS n, min(entry) AS entry, row_number() OVER (PARTITION BY token ORDER BY distance) AS r FROM s WHERE distance <= 2 GROUP BY token, distance)
SELECT token, entry, distance FROM b WHERE r = 1 AND n = 1""")
def heal_names(spark, d):
    names = spark.read.parquet(f"{d}/nation.parquet").select(F.upper("n_name").alias("entry"))
    return lookup.heal_tokens(X.view(spark, d, X.TYPOS).select(F.col("dirty").alias("token")), names).select("token", "entry", "distance")


_SWAPS = ", ".join(f"substr(z, 1, {i - 1}) || substr(z, {i + 1}, 1) || substr(z, {i}, 1) || substr(z, {i + 2})" for i in range(1, 5))


@query(f"""WITH q AS (SELECT CAST(o_orderkey AS BIGINT) AS id, right('00000' || CAST(o_orderkey * 7919 % 100000 AS VARCHAR(20)), 5) AS z, {X.pick(('NY', 'TX', 'CA', 'IL'), 'o_orderkey')} AS state FROM orders),
s AS (SELECT *, list_distinct(list_filter([{_SWAPS}], lambda x: x <> z AND coalesce({_zip3('x')}, '') = state)) AS good FROM q)
SELECT id, CASE WHEN coalesce({_zip3('z')}, '') = state THEN z WHEN len(good) = 1 THEN good[1] END AS healed FROM s""")
def heal_zips(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    state = F.expr(X.pick(("NY", "TX", "CA", "IL"), "o_orderkey"))
    z = F.lpad((F.col("o_orderkey") * 7919 % 100000).cast("string"), 5, "0")
    return o.select(F.col("o_orderkey").cast("long").alias("id"), z.alias("z"), state.alias("state")).select("id", lookup.heal_zip(F.col("z"), F.col("state")).alias("healed"))


@query(f"""WITH q AS (SELECT addr_id, {X.pick(('TX', 'Austin', 'new york', 'Indiana', 'Ohio'), 'addr_id')} AS city, {X.pick(('Dallas', 'TX', 'Albany', 'IN', '', 'Miami'), 'addr_id')} AS state FROM {_A}),
s AS (SELECT *, upper(city) IN {_in((*dims.STATES, *dims.STATE_CODES))} AND upper(state) NOT IN {_in((*dims.STATES, *dims.STATE_CODES))} AND state <> '' AS swap FROM q)
SELECT addr_id, CASE WHEN swap THEN state ELSE city END AS city, CASE WHEN swap THEN city ELSE state END AS state FROM s""")
def city_state_swaps(spark, d):
    q = X.view(spark, d, X.ADDR).select("addr_id", F.expr(X.pick(("TX", "Austin", "new york", "Indiana", "Ohio"), "addr_id")).alias("c"), F.expr(X.pick(("Dallas", "TX", "Albany", "IN", "", "Miami"), "addr_id")).alias("s"))
    return q.withColumn("x", us.swap_city_state(F.col("c"), F.col("s"))).select("addr_id", "x.*")


_CELLS = X.pick(("=1+1", "+1", "-2", "@x", "plain", "a=b", ""), "p_partkey")


@query(f"SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN regexp_matches(c, '^[=+@-]') THEN '''' || c ELSE c END AS cell FROM (SELECT p_partkey, {_CELLS} AS c FROM part)")
def csv_cells(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), F.expr(_CELLS).alias("c"))
    return p.select("id", text.csv_guard(F.col("c")).alias("cell"))


_COUNTRY = X.pick(("", "us", "U.S.A.", "Deutschland", "fra", "Great Britain", "Atlantis", "JP", "canada"), "c_custkey")


@query(f"""SELECT id, CASE WHEN c = '' THEN 'USA' ELSE coalesce({_map(country.alias_table(), 'c')}, 'ZZZ') END AS iso3 FROM (SELECT CAST(c_custkey AS BIGINT) AS id, trim(regexp_replace(regexp_replace(upper({_COUNTRY}), '[^A-Z ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS c FROM customer)""")
def country_codes(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").cast("long").alias("id"), country.country_code(F.expr(_COUNTRY)).alias("iso3"))


_CODE = X.pick(("10115", "sw1a1aa", "K1A 0B1", "1012 ab", "00-001", "100-0001", "", "ABC", "11122", "01310-100", "12345-6789"), "c_custkey")
_ISO = X.pick(("DEU", "GBR", "CAN", "NLD", "POL", "JPN", "HKG", "USA", "SWE", "BRA", "ZZZ", "ARE", "USA"), "c_custkey")
_RULES = ", ".join(f"('{a}', '{p.replace(chr(39), chr(39) * 2)}')" for a, _, _, p, _ in country.COUNTRIES)


@query(f"""WITH r(iso, pattern) AS (VALUES {_RULES}), q AS (SELECT CAST(c_custkey AS BIGINT) AS id, upper({_CODE}) AS c, {_ISO} AS iso3 FROM customer),
j AS (SELECT q.*, pattern, regexp_full_match(c, coalesce(pattern, 'x')) AS fits FROM q LEFT JOIN r ON iso3 = iso)
SELECT id, iso3, coalesce(CASE WHEN pattern = '' THEN c = '' ELSE fits END, false) AND pattern IS NOT NULL AS is_valid, coalesce(pattern = '', false) AS is_non_postal_country,
  CASE WHEN pattern IS NULL THEN 'unknown_country' WHEN CASE WHEN pattern = '' THEN c = '' ELSE fits END THEN 'ok' WHEN pattern = '' THEN 'country_has_no_codes' WHEN c = '' THEN 'empty' ELSE 'pattern_mismatch' END AS reason FROM j""")
def validate_postal_codes(spark, d):
    q = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), F.expr(_CODE).alias("postal_code"), F.expr(_ISO).alias("iso3"))
    return country.validate_postal(q).select("id", "iso3", "is_valid", "is_non_postal_country", "reason")


@query(f"""SELECT CAST(addr_id AS BIGINT) AS addr_id, regexp_extract(line, '([0-9]{{5}})(-[0-9]{{4}})?$', 0) AS postal_code FROM ({_LINE})""")
def extract_postal_codes(spark, d):
    return X.view(spark, d, _LINE).select(F.col("addr_id").cast("long").alias("addr_id"), country.extract_postal(F.col("line"), F.lit("USA")).alias("postal_code"))


_RAW = X.pick(("N/A", "PO Box 12", "Private Residence", "12 Oak St", "unknown", "confidential", "p.o. box 7-a"), "c_custkey")


@query(f"""SELECT id, upper(s) IN {_in(us.GARBAGE)} AS is_garbage, regexp_matches(upper(s), '^P\\.?O\\.? BOX') AS is_box, upper(s) IN {_in(us.PLACEHOLDERS)} AS is_private FROM (SELECT CAST(c_custkey AS BIGINT) AS id, {_RAW} AS s FROM customer)""")
def line_predicates(spark, d):
    q = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), F.upper(F.expr(_RAW)).alias("s"))
    return q.select("id", F.col("s").isin(*us.GARBAGE).alias("is_garbage"), F.col("s").rlike(us.PO_BOX).alias("is_box"), F.col("s").isin(*us.PLACEHOLDERS).alias("is_private"))


# places

_DIST = "2 * {r} * asin(sqrt(greatest(0.0, least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({y} - {x}) / 2), 2)))))"


def _dist(r: float = 6371000.0) -> str:
    return _DIST.format(r=r, a="lat", b="latitude", x="lon", y="longitude")


@query(f"SELECT center_id, point_id, round({_dist()}, 3) AS distance_m FROM ({X.CENTERS}), ({X.POINTS}) WHERE {_dist()} <= 700000")
def points_within_radius(spark, d):
    out = lookup.radius_join(X.view(spark, d, X.CENTERS), X.view(spark, d, X.POINTS), 700_000.0)
    return out.select("center_id", "point_id", F.round("distance_m", 3).alias("distance_m"))


@query(f"SELECT center_id, point_id FROM (SELECT center_id, point_id, row_number() OVER (PARTITION BY center_id ORDER BY {_dist()}, point_id) AS n FROM ({X.CENTERS}), ({X.POINTS}) WHERE {_dist()} <= 1500000) WHERE n <= 3")
def nearest_points(spark, d):
    return lookup.radius_join(X.view(spark, d, X.CENTERS), X.view(spark, d, X.POINTS), 1_500_000.0, limit=3).select("center_id", "point_id")


@query(f"SELECT point_id, 'land' AS box FROM ({X.POINTS}) WHERE latitude BETWEEN 10 AND 50 AND longitude BETWEEN -120 AND 20 UNION ALL SELECT point_id, 'antimeridian' FROM ({X.POINTS}) WHERE latitude BETWEEN -60 AND 60 AND (longitude >= 150 OR longitude <= -160)")
def points_in_boxes(spark, d):
    p = X.view(spark, d, X.POINTS)
    a, b = lookup.within_box(p, -120, 10, 20, 50), lookup.within_box(p, 150, -60, -160, 60)
    return a.select("point_id", F.lit("land").alias("box")).unionByName(b.select("point_id", F.lit("antimeridian").alias("box")))


@query(f"""WITH j AS (SELECT h.id, h.number, s.*, row_number() OVER (PARTITION BY h.id ORDER BY s.seg_id) AS n FROM ({X.HOUSES}) h JOIN ({X.SEGMENTS}) s ON h.street_name = s.street_name
  AND h.number BETWEEN least(from_number, to_number) AND greatest(from_number, to_number) AND (s.postal_code IS NULL OR h.postal_code = s.postal_code OR h.postal_code = '')
  AND (parity = 'BOTH' OR (parity = 'ODD' AND number % 2 <> 0) OR (parity = 'EVEN' AND number % 2 = 0))),
m AS (SELECT *, CASE WHEN to_number = from_number THEN 0.5 ELSE greatest(0.0, least(1.0, CAST(number - from_number AS DOUBLE) / (to_number - from_number))) END AS mu, end_lon - start_lon AS dx, end_lat - start_lat AS dy, CASE WHEN number % 2 <> 0 THEN 0.00009 ELSE -0.00009 END AS side FROM j WHERE n = 1)
SELECT id, seg_id, round(start_lat + mu * dy + dx / sqrt(dx * dx + dy * dy) * side, 6) AS latitude, round(start_lon + mu * dx + -dy / sqrt(dx * dx + dy * dy) * side, 6) AS longitude FROM m""")
def interpolated_houses(spark, d):
    return lookup.interpolate_ranges(X.view(spark, d, X.HOUSES), X.view(spark, d, X.SEGMENTS)).select("id", "seg_id", "latitude", "longitude")


_POSTAL = "SELECT CAST(z AS VARCHAR(5)) AS postal_code, CAST(40 + length(z) AS DOUBLE) AS latitude, CAST(-74 - length(z) AS DOUBLE) AS longitude FROM (SELECT '10005' AS z UNION ALL SELECT '100' UNION ALL SELECT '75210' UNION ALL SELECT '606')"
_MUNICIPAL = "SELECT 'DENVER' AS name, 'CO' AS state, CAST(39.7 AS DOUBLE) AS latitude, CAST(-104.9 AS DOUBLE) AS longitude UNION ALL SELECT 'FL', '', CAST(27.7 AS DOUBLE), CAST(-81.6 AS DOUBLE) UNION ALL SELECT 'TX', '', CAST(31.0 AS DOUBLE), CAST(-97.5 AS DOUBLE)"


@query(STD + f""", p AS ({_POSTAL}), m AS ({_MUNICIPAL})
SELECT addr_id AS id, CASE WHEN a.postal_code IS NOT NULL THEN 'POSTAL' WHEN b.postal_code IS NOT NULL THEN 'ZIP3' WHEN c.name IS NOT NULL THEN 'MUNICIPAL' WHEN e.name IS NOT NULL THEN 'STATE' END AS stage,
  coalesce(a.latitude, b.latitude, c.latitude, e.latitude) AS latitude FROM std LEFT JOIN p a ON zip5 = a.postal_code LEFT JOIN p b ON substr(zip5, 1, 3) = b.postal_code LEFT JOIN m c ON std.city = c.name AND std.state = c.state LEFT JOIN m e ON std.state = e.name""")
def centroid_ladder(spark, d):
    rows = std(spark, d).select(F.col("addr_id").alias("id"), "zip5", "city", "state")
    return lookup.centroid_ladder(rows, spark.sql(_POSTAL), spark.sql(_MUNICIPAL)).select("id", "stage", "latitude")


@query(f"SELECT address_key, min(point_id) AS point_id FROM ({X.POINTS}) WHERE address_key NOT IN (SELECT address_key FROM ({X.POINTS}) WHERE point_id % 7 = 0) GROUP BY 1")
def ingest_new_points(spark, d):
    p = X.view(spark, d, X.POINTS)
    return lookup.new_points(p, p.where("point_id % 7 = 0")).select("address_key", "point_id")


@query("""WITH r AS (SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_suppkey % 300 - 150 AS DOUBLE) AS x, CAST(s_suppkey % 120 - 60 AS DOUBLE) AS y, CAST(1 + s_suppkey % 4 AS DOUBLE) AS w FROM supplier)
SELECT id, round(x + w / 2, 6) AS longitude, round(y + 1.0, 6) AS latitude FROM r""")
def polygon_centroids(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("CAST(s_suppkey AS BIGINT) AS id", "CAST(s_suppkey % 300 - 150 AS DOUBLE) AS x", "CAST(s_suppkey % 120 - 60 AS DOUBLE) AS y", "CAST(1 + s_suppkey % 4 AS DOUBLE) AS w")
    ring = F.expr("array(array(x, y), array(x + w, y), array(x + w, y + 2), array(x, y + 2), array(x, y))")
    return s.withColumn("c", files.ring_centroid(ring)).select("id", F.round("c.longitude", 6).alias("longitude"), F.round("c.latitude", 6).alias("latitude"))


# evaluation

_OK = "(o_orderkey % 7 <> 0)"


@query(f"SELECT o_orderpriority AS category, count(*) AS total, CAST(sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS BIGINT) AS passed, round(100.0 * sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) / count(*), 4) AS pct FROM orders GROUP BY ROLLUP (o_orderpriority)")
def accuracy_by_category(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_orderpriority", "category")
    return evaluation.accuracy(o, "category", F.expr(_OK))


def _report_rows():
    got = "CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN 'x' ELSE {} END"
    return f"SELECT CAST(c_nationkey AS BIGINT) AS country, c_name AS expected_name, {got.format('c_name')} AS got_name, c_mktsegment AS expected_segment, CASE WHEN c_custkey % 3 = 0 THEN 'y' ELSE c_mktsegment END AS got_segment FROM customer"


_W = "({p} + 3.8416 / (2 * n) {s} 1.96 * sqrt({p} * (1 - {p}) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)"


@query(f"""WITH q AS ({_report_rows()}), l AS (SELECT country, 'name' AS field, expected_name AS e, got_name AS g FROM q UNION ALL SELECT country, 'segment', expected_segment, got_segment FROM q),
a AS (SELECT country, field, count(*) AS n, count(*) FILTER (e = g) AS correct, count(*) FILTER (g <> '' AND e <> g) AS wrong, count(*) FILTER (g = '') AS missing FROM l GROUP BY GROUPING SETS ((country, field), (field)))
SELECT *, round(correct / n, 6) AS accuracy, round(greatest(0.0, {_W.format(p='(correct / n)', s='-')}), 6) AS ci_low, round(least(1.0, {_W.format(p='(correct / n)', s='+')}), 6) AS ci_high FROM a""")
def field_accuracy(spark, d):
    return evaluation.field_report(X.view(spark, d, _report_rows()), ["name", "segment"], "country")


@query(f"SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 9) AS mean_confidence, round(avg(CASE WHEN was_correct THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM ({X.CALIBRATION}) GROUP BY 1")
def reliability_bins(spark, d):
    r = evaluation.reliability(X.view(spark, d, X.CALIBRATION))
    return r.select("bin", "n", F.round("mean_confidence", 9).alias("mean_confidence"), F.round("accuracy", 9).alias("accuracy"))


@query(f"""WITH q AS ({X.CALIBRATION}), b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, abs(avg(score) - avg(CASE WHEN was_correct THEN 1.0 ELSE 0.0 END)) AS gap FROM q GROUP BY 1)
SELECT round((SELECT sum(n * gap) / sum(n) FROM b), 9) AS ece, round((SELECT avg(pow(score - CASE WHEN was_correct THEN 1.0 ELSE 0.0 END, 2)) FROM q), 9) AS brier""")
def calibration_errors(spark, d):
    e = evaluation.calibration_error(X.view(spark, d, X.CALIBRATION))
    return e.select(F.round("ece", 9).alias("ece"), F.round("brier", 9).alias("brier"))


@query()
def calibrated_scores(spark, d):
    """Isotonic knots are fitted over all rows and applied to all; a pool of violators has no SQL form."""
    rows = X.view(spark, d, X.CALIBRATION)
    return rows.select("id", "score", F.round(evaluation.calibrated(F.col("score"), *evaluation.fit_isotonic(rows)), 9).alias("calibrated"))


@query("SELECT quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.9) AS p90, quantile_disc(o_totalprice, 0.95) AS p95, quantile_disc(o_totalprice, 0.99) AS p99, round(avg(o_totalprice), 6) AS mean FROM orders")
def latency_percentiles(spark, d):
    r = evaluation.nearest_rank(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice")
    return r.withColumn("mean", F.round("mean", 6))


@query("SELECT CAST(c_custkey AS BIGINT) AS id FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS n FROM customer) WHERE n <= 2 ORDER BY c_acctbal, c_custkey LIMIT 15")
def worst_per_group(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return evaluation.worst(c, ["c_mktsegment"], [F.col("c_acctbal"), F.col("c_custkey")]).select(F.col("c_custkey").cast("long").alias("id"))


# ledger


def _ledger(spark, d):
    a = X.view(spark, d, X.AUDIT)
    return a.select("audit_id", F.col("seq").alias("version"), "action_type", F.when(F.col("action_type") == "error", "PENDING").otherwise("APPROVED").alias("review_status"), F.col("seq").alias("ts"))


_L = f"(SELECT audit_id, seq AS version, action_type, CASE WHEN action_type = 'error' THEN 'PENDING' ELSE 'APPROVED' END AS review_status, seq AS ts FROM ({X.AUDIT}))"


@query(f"SELECT audit_id, version, action_type, review_status FROM {_L} QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY version DESC) = 1")
def ledger_current(spark, d):
    return ledger.current(_ledger(spark, d)).select("audit_id", "version", "action_type", "review_status")


@query(f"SELECT audit_id, version FROM {_L} ORDER BY ts DESC, audit_id DESC LIMIT 100")
def ledger_newest(spark, d):
    return ledger.newest(_ledger(spark, d), 100).select("audit_id", "version")


@query(f"SELECT action_type, count(*) AS n FROM {_L} WHERE review_status = 'PENDING' GROUP BY 1")
def ledger_pending(spark, d):
    return ledger.listing(_ledger(spark, d), review_status="PENDING").groupBy("action_type").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT audit_id FROM {_L} WHERE audit_id NOT IN (SELECT audit_id FROM {_L} WHERE version % 3 = 0 AND version < 300)")
def ledger_append(spark, d):
    rows = _ledger(spark, d)
    return ledger.ensure_recorded(rows.where("version % 3 = 0 AND version < 300"), rows).select("audit_id")


@query(f"""WITH c AS (SELECT * FROM {_L} QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY version DESC) = 1)
SELECT audit_id, version + 1 AS version, 'MANUAL_OVERRIDE' AS action_type, 'APPROVED' AS review_status FROM c WHERE length(audit_id) = 2""")
def ledger_override(spark, d):
    rows = _ledger(spark, d)
    changes = rows.where("length(audit_id) = 2").select("audit_id", F.lit("MANUAL_OVERRIDE").alias("action_type")).distinct()
    return ledger.override(rows, changes, ["action_type"]).select("audit_id", "version", "action_type", "review_status")


@query(f"SELECT audit_id, max(version) AS version FROM {_L} GROUP BY 1")
def upserted(spark, d):
    rows = _ledger(spark, d).select("audit_id", "version")
    return ledger.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), "audit_id", "version")


# search


def _records(spark, d):
    s = std(spark, d).dropDuplicates(["addr_id"])
    return s.select(F.col("addr_id").alias("rec_id"), "street1", "street2", "city", "state", F.col("zip5").alias("postal_code"), F.concat_ws(" ", "street1", "street2", "city", "state", "zip5").alias("full"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))


_RECORDS = ", r AS (SELECT DISTINCT addr_id AS rec_id, street1, street2, city, state, zip5 FROM std), w AS (SELECT DISTINCT rec_id, unnest(regexp_extract_all(concat_ws(' ', street1, street2, city, state, zip5), '[A-Za-z0-9_]+')) AS w FROM r)"


@query(STD + _RECORDS + """, p AS (SELECT DISTINCT rec_id, substr(w, 1, i) AS prefix FROM w, range(1, 25) x(i) WHERE i <= length(w)) SELECT prefix, count(*) AS n FROM p GROUP BY 1""")
def prefix_counts(spark, d):
    return search.prefix_index(_records(spark, d), "full").groupBy("prefix").agg(F.count("*").alias("n"))


@query(STD + _RECORDS + """SELECT rec_id, street1, 1.0::DOUBLE AS score FROM r WHERE rec_id IN (SELECT rec_id FROM w WHERE starts_with(w, 'OAK')) AND rec_id IN (SELECT rec_id FROM w WHERE starts_with(w, 'DEN')) ORDER BY rec_id LIMIT 5""")
def search_prefixes(spark, d):
    r = _records(spark, d)
    return search.search(r, search.prefix_index(r, "full"), "oak den").select("rec_id", "street1", "score")


@query(STD + _RECORDS + """SELECT rec_id, street1, 0.85::DOUBLE AS score FROM r WHERE rec_id IN (SELECT rec_id FROM w WHERE damerau_levenshtein(w, 'WASHIGNTON') <= 1) ORDER BY rec_id LIMIT 5""")
def search_with_typo(spark, d):
    r = _records(spark, d)
    return search.search(r, search.prefix_index(r, "full"), "washignton").select("rec_id", "street1", "score")


# tables


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation")
def table_counts(spark, d):
    out = None
    for name in ("customer", "supplier", "nation"):
        n = spark.read.parquet(f"{d}/{name}.parquet").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(STD + "SELECT DISTINCT state, zip5 FROM std")
def distinct_states_and_zips(spark, d):
    return std(spark, d).select("state", "zip5").distinct()


# hubs, reference checks, layouts

_HUBS = """SELECT 1 AS ord, 'Tower' AS provider, 'REGISTERED_AGENT' AS category, CAST(0.9 AS DOUBLE) AS risk, 'NY' AS state, '' AS city, 'OAK ST' AS street_pattern, '' AS unit_pattern
UNION ALL SELECT 2, 'Suites', 'VIRTUAL_OFFICE', CAST(0.7 AS DOUBLE), 'TX', 'DALLAS', 'MAPLE', 'STE 200' UNION ALL SELECT 3, 'Late', 'REGISTERED_AGENT', CAST(0.5 AS DOUBLE), 'NY', '', 'OAK', ''
UNION ALL SELECT 4, 'Number', 'MAIL_DROP', CAST(0.6 AS DOUBLE), 'CO', '', '5TH', ''"""


@query(STD + f""", h AS ({_HUBS}), u AS (SELECT DISTINCT addr_id, street1, street2, city, state FROM std),
m AS (SELECT u.addr_id AS id, provider, category, risk, row_number() OVER (PARTITION BY addr_id ORDER BY ord) AS n FROM u JOIN h ON u.state = h.state AND (h.city = '' OR h.city = u.city)
  AND regexp_matches(street1, '(^|[^A-Z0-9])' || street_pattern || '($|[^A-Z0-9])') AND (unit_pattern = '' OR regexp_matches(street2, '(^|[^A-Z0-9])' || unit_pattern || '($|[^A-Z0-9])')))
SELECT id, provider, category, risk FROM m WHERE n = 1""")
def corporate_hubs(spark, d):
    rows = std(spark, d).select(F.col("addr_id").alias("id"), "street1", "street2", "city", "state").distinct()
    return registry.match_hubs(rows, spark.sql(_HUBS)).select("id", "provider", "category", "risk")


_PLACES = "SELECT 'US' AS country, '10005' AS postal, 'New York' AS place, 'NY' AS admin1_code UNION ALL SELECT 'US', '75210', 'Dallas', 'TX' UNION ALL SELECT 'US', '60611', 'Evanston', 'IL' UNION ALL SELECT 'US', '80213', 'Denver', 'XX' UNION ALL SELECT 'US', '33122', 'Miam', 'FL'"


@query(STD + f""", p AS ({_PLACES}), u AS (SELECT DISTINCT addr_id AS id, zip5, city, state FROM std)
SELECT id, CASE WHEN zip5 = '' THEN 'not_checked' WHEN place IS NULL THEN 'postal_unknown' WHEN state <> '' AND state <> admin1_code THEN 'state_mismatch' WHEN damerau_levenshtein(city, upper(place)) <= 1 THEN 'confirmed' ELSE 'place_mismatch' END AS status
FROM u LEFT JOIN p ON zip5 = postal""")
def reference_checks(spark, d):
    rows = std(spark, d).select(F.col("addr_id").alias("id"), F.col("zip5").alias("postal_code"), "city", "state", F.lit("US").alias("iso2")).distinct()
    return reference.validate(rows, spark.sql(_PLACES))


_L3 = X.pick(("USA", "DEU", "JPN", "GBR", "MEX", "HKG"), "addr_id")


@query(f"""WITH q AS (SELECT DISTINCT addr_id, street1, city, state, postal_code, {_L3} AS i FROM {_A})
SELECT addr_id, CASE WHEN i = 'JPN' THEN concat_ws(chr(10), 'C', postal_code, trim(concat_ws(' ', nullif(state, ''), city)), street1) WHEN i IN ('DEU', 'MEX') THEN concat_ws(chr(10), street1, postal_code || ' ' || city, nullif(state, ''), 'C')
  ELSE concat_ws(chr(10), street1, concat_ws(' ', city, nullif(state, ''), postal_code), 'C') END AS lines FROM q""")
def postal_layouts(spark, d):
    q = X.view(spark, d, X.ADDR).distinct().withColumn("i", F.expr(_L3))
    return q.select("addr_id", layout.postal_lines(F.col("street1"), F.col("street2"), F.col("city"), F.col("state"), F.col("postal_code"), F.col("i"), F.lit("C")).alias("lines"))


_SCRIPT = X.pick(("Main St", "улица Ленина", "東京都", "ひらがな町", "서울", "Ερμού", ""), "c_custkey")


@query(f"SELECT CAST(c_custkey AS BIGINT) AS id, {X.pick(('-', 'RUS', 'CHN', 'JPN', 'KOR', 'GRC', '-'), 'c_custkey')} AS iso3, {X.pick(('Main St', 'ulitsa Lenina', '東京都', 'ひらがな町', '서울', 'Ermoy', ''), 'c_custkey')} AS latin FROM customer")
def scripts(spark, d):
    q = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), F.expr(_SCRIPT).alias("s"))
    return q.select("id", F.coalesce(layout.script_country(F.col("s")), F.lit("-")).alias("iso3"), layout.transliterate(F.col("s")).alias("latin"))


@query(STD + f""", k AS (SELECT addr_id AS id, {KEY_SQL} AS address_key, {BUILDING_SQL} AS building_key FROM std), t AS (SELECT * FROM k WHERE id % 5 = 0), ek AS (SELECT address_key, min(id) AS rooftop FROM t GROUP BY 1), bk AS (SELECT building_key, min(id) AS rooftop FROM t GROUP BY 1)
SELECT id, CASE WHEN ek.rooftop IS NOT NULL THEN 'KEY' WHEN bk.rooftop IS NOT NULL THEN 'BUILDING' END AS stage, coalesce(ek.rooftop, bk.rooftop) AS rooftop FROM k LEFT JOIN ek ON k.address_key = ek.address_key LEFT JOIN bk ON k.building_key = bk.building_key""")
def rooftop_cascade(spark, d):
    k = std(spark, d).select(F.col("addr_id").alias("id"), F.col("normalized_address_key").alias("address_key"), "building_key")
    t = k.where("id % 5 = 0").select("address_key", "building_key", F.col("id").alias("rooftop"), F.col("id").alias("ord"))
    out = lookup.coalesce_lookups(k, "id", [("KEY", t, ["address_key"], "ord"), ("BUILDING", t, ["building_key"], "ord")], ["rooftop"])
    return out.select("id", "stage", "rooftop")


# clean-up and lines outside the US

_N = "CAST(c_custkey * 7 % 900 + 1 AS VARCHAR(20))"
_NAME = X.pick(("Oak", "Elm", "Pine Hill"), "c_custkey")
_WHO = X.pick(("Acme Holdings LLC", "Jane Roe", "Smith & Sons"), "c_custkey")
_CARE = f"CASE c_custkey % 4 WHEN 0 THEN 'c/o ' || {_WHO} || ', ' || {_N} || ' ' || {_NAME} || ' St' WHEN 1 THEN {_N} || ' ' || {_NAME} || ' St, Attn: ' || {_WHO} WHEN 2 THEN {_N} || ' ' || {_NAME} || ' St (C/O ' || {_WHO} || ')' ELSE {_N} || ' ' || {_NAME} || ' St' END"


@query(f"SELECT CAST(c_custkey AS BIGINT) AS id, {_N} || ' ' || {_NAME} || ' St' AS address, CASE WHEN c_custkey % 4 = 3 THEN '' ELSE {_WHO} END AS care_of FROM customer")
def care_of_clauses(spark, d):
    q = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), cleanup.care_of(F.expr(_CARE)).alias("x"))
    return q.select("id", "x.*")


_LINE1 = f"{_N} || ' ' || {_NAME} || ' St'"
_AGAIN = f"CASE c_custkey % 3 WHEN 0 THEN {_LINE1} || ', ' || {_LINE1} WHEN 1 THEN {_LINE1} || ' ' || {_LINE1} || ' ' || {_LINE1} ELSE {_LINE1} END"


@query(f"SELECT CAST(c_custkey AS BIGINT) AS id, {_LINE1} AS line FROM customer")
def repeats_collapsed(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), cleanup.collapse_repeats(F.expr(_AGAIN)).alias("line"))


_TOWN = X.pick(("New York", "Dallas", "Denver"), "c_custkey")
_ST = X.pick(("NY", "TX", "CO"), "c_custkey")
_TAIL = f"CASE c_custkey % 4 WHEN 0 THEN {_LINE1} || ', ' || {_TOWN} || ', ' || {_ST} || ' 10005' WHEN 1 THEN {_LINE1} || ' ' || {_TOWN} || ' ' || {_ST} WHEN 2 THEN {_LINE1} || ', USA' ELSE {_LINE1} END"


@query(f"SELECT CAST(c_custkey AS BIGINT) AS id, {_LINE1} AS line FROM customer")
def tails_cut(spark, d):
    q = spark.read.parquet(f"{d}/customer.parquet")
    return q.select(F.col("c_custkey").cast("long").alias("id"), cleanup.redundant_tail(F.expr(_TAIL), F.expr(_TOWN), F.expr(_ST), F.lit("10005")).alias("line"))


_CROSS = X.pick(("Cherry and Fourth Streets", "5th Ave & 42nd St", "Corner of Oak Road and Elm Lane", "Routes 60 and 155", "Smith and Jones"), "c_custkey")


@query(f"SELECT CAST(c_custkey AS BIGINT) AS id, CASE c_custkey % 5 WHEN 0 THEN 'CHERRY ST & 4TH ST' WHEN 1 THEN '5TH AVE & 42ND ST' WHEN 2 THEN 'OAK RD & ELM LN' WHEN 3 THEN 'RT 60 & RT 155' END AS line FROM customer")
def corners(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), cleanup.intersection(F.expr(_CROSS)).alias("line"))


@query(f"""WITH q AS (SELECT addr_id, state, postal_code, upper(regexp_replace(state, '\\.', '', 'g')) AS s, regexp_extract(postal_code, '^([0-9]{{5}})', 1) AS z FROM {_A}),
c AS (SELECT *, coalesce({_map(dims.STATES, 's')}, s) AS code, {_zip3('z')} AS by_zip FROM q), w AS (SELECT *, coalesce(code IN {_in(dims.STATE_CODES)} AND by_zip <> code, false) AS wrong FROM c)
SELECT addr_id, CASE WHEN wrong THEN by_zip ELSE state END AS state, CASE WHEN wrong THEN state END AS original FROM w""")
def states_corrected(spark, d):
    return X.view(spark, d, X.ADDR).select("addr_id", cleanup.correct_state(F.col("state"), F.col("postal_code"), F.lit("")).alias("x")).select("addr_id", "x.*")


_NUM = "CAST(100 + o_orderkey * 37 % 900 AS VARCHAR(20))"
_FITS = "({x} BETWEEN 100 AND 299 OR {x} BETWEEN 500 AND 549)"
_S1, _S2 = "substr(n, 2, 1) || substr(n, 1, 1) || substr(n, 3, 1)", "substr(n, 1, 1) || substr(n, 3, 1) || substr(n, 2, 1)"


@query(f"""WITH q AS (SELECT CAST(o_orderkey AS BIGINT) AS id, {_NUM} AS n FROM orders),
s AS (SELECT id, n, {_S1} AS a, {_S2} AS b, substr(n, 1, 1) <> substr(n, 2, 1) AND {_FITS.format(x=f'CAST({_S1} AS INTEGER)')} AS fa, substr(n, 2, 1) <> substr(n, 3, 1) AND {_FITS.format(x=f'CAST({_S2} AS INTEGER)')} AS fb FROM q)
SELECT id, CASE WHEN {_FITS.format(x='CAST(n AS INTEGER)')} THEN n WHEN fa AND NOT fb THEN a WHEN fb AND NOT fa THEN b END AS healed FROM s""")
def house_numbers_healed(spark, d):
    ranges = F.expr("array(named_struct('low', 100L, 'high', 299L), named_struct('low', 500L, 'high', 549L))")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"), cleanup.heal_house_number(F.expr(_NUM), ranges).alias("healed"))


_ABROAD = f"""CASE c_custkey % 5 WHEN 0 THEN {_NAME} || 'str. ' || {_N} || ', 10115 Berlin, Germany' WHEN 1 THEN 'Av. ' || {_NAME} || ' ' || {_N} || ', Int. 4, 03940 Puebla, PUE, Mexico'
  WHEN 2 THEN 'Flat 2, ' || {_N} || ' ' || {_NAME} || ' Street, Leeds LS6 2AA, United Kingdom' WHEN 3 THEN '4/' || {_N} || ' ' || {_NAME} || ' Road, Sydney NSW 2000, Australia' ELSE {_N} || ' Rue ' || {_NAME} || ', 75001 Paris, France' END"""


@query(f"""WITH q AS (SELECT CAST(c_custkey AS BIGINT) AS id, c_custkey % 5 AS k, {_N} AS n, upper({_NAME}) AS name FROM customer)
SELECT id, CASE k WHEN 0 THEN name || 'STRASSE ' || n WHEN 1 THEN 'AV ' || name || ' ' || n WHEN 2 THEN n || ' ' || name || ' ST' WHEN 3 THEN n || ' ' || name || ' RD' ELSE n || ' RUE ' || name END AS street1,
  CASE k WHEN 1 THEN 'INT 4' WHEN 2 THEN 'APT 2' WHEN 3 THEN 'UNIT 4' ELSE '' END AS street2, CASE k WHEN 0 THEN 'BERLIN' WHEN 1 THEN 'PUEBLA' WHEN 2 THEN 'LEEDS' WHEN 3 THEN 'SYDNEY' ELSE 'PARIS' END AS city,
  CASE k WHEN 1 THEN 'PUE' WHEN 3 THEN 'NSW' ELSE '' END AS state, CASE k WHEN 0 THEN '10115' WHEN 1 THEN '03940' WHEN 2 THEN 'LS6 2AA' WHEN 3 THEN '2000' ELSE '75001' END AS postal_code,
  CASE k WHEN 0 THEN 'DEU' WHEN 1 THEN 'MEX' WHEN 2 THEN 'GBR' WHEN 3 THEN 'AUS' ELSE 'FRA' END AS country, n AS house_number FROM q""")
def lines_abroad(spark, d):
    q = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), F.expr(_ABROAD).alias("line"))
    q = q.withColumn("country", grammar.country_at_end(F.col("line")))
    none = F.lit("")
    x = q.withColumn("x", grammar.international(F.col("line"), none, none, none, none, F.col("country")))
    return x.select("id", "x.street1", "x.street2", "x.city", "x.state", "x.postal_code", "country", "x.house_number")


@query(SCORED + """SELECT addr_id, CAST(0.99 AS DOUBLE) AS street1, CAST(CASE WHEN street2 = '' THEN 1.0 ELSE 0.85 END AS DOUBLE) AS street2, CAST(0.95 AS DOUBLE) AS city,
  round(CAST(CASE WHEN state = '' THEN 0.0 WHEN NOT ok_state THEN 0.20 WHEN NOT no_zip AND coalesce(zs, '') <> state THEN 0.35 WHEN raw_state = '' THEN 0.85 ELSE 0.97 END AS DOUBLE) + CASE WHEN zs = state THEN 0.02 ELSE 0 END, 4) AS state,
  CAST(CASE WHEN postal_code = '' THEN 0.0 WHEN no_zip THEN 0.30 ELSE 0.97 END AS DOUBLE) AS postal_code, CAST(0.60 AS DOUBLE) AS country FROM scored""")
def field_confidences(spark, d):
    return scoring.field_confidence(std(spark, d, score=True)).select("addr_id", "field_confidence.*")


@query(STD + f"SELECT addr_id, {KEY_SQL} AS key, CASE WHEN zip5 <> '' AND coalesce({_zip3('zip5')}, '') <> state THEN 'UNDELIVERABLE' ELSE 'DELIVERABLE' END AS deliverability, street1 FROM std")
def sql_functions(spark, d):
    """The registered SQL functions over the same rows as the plan."""
    sqlfunctions.register(spark)
    args = "street1, city, state, postal_code"
    return X.view(spark, d, X.ADDR).selectExpr("addr_id", f"standardize_address_key({args}) AS key", f"standardize_deliverability({args}) AS deliverability", f"standardize_address({args}).street1 AS street1")
