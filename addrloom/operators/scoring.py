"""Delivery intelligence, confidence, risk and ledger rules over standardized columns, as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..plans.barrier import settle
from ..functions.us import zip3_state

WEIGHTS = {"parse": 0.35, "ref": 0.35, "geo": 0.15, "cross": 0.15}
AUTO_PASS, FUZZY_REVIEW = 0.95, 0.80
# Names of private mailbox firms, matched as whole words.
CMRA_NAMES = ("THE UPS STORE", "UPS STORE", "POSTALANNEX", "POSTAL ANNEX", "MAIL BOXES ETC", "PAK MAIL", "POSTNET", "DAVINCI VIRTUAL", "DAVINCI MEETING", "REGUS", "INTELLIGENT OFFICE", "OFFICE EVOLUTION")
CMRA = rf"(?<![A-Z])PMB(?![A-Z])|PRIVATE MAILBOX|(?<![A-Z0-9])(?:{'|'.join(CMRA_NAMES)})(?![A-Z0-9])"
RESIDENTIAL_UNITS, COMMERCIAL_UNITS = ("APT", "UNIT", "LOT", "TRLR", "SPC"), ("STE", "FL", "RM", "DEPT", "BLDG", "OFC")


# Three-digit ZIP prefixes with a metropolitan centre and its place.
METRO_CENTROIDS = {
    "100": (40.7128, -74.0060), "101": (40.7549, -73.9840), "102": (40.7118, -74.0131), "103": (40.5795, -74.1502), "104": (40.8448, -73.8648), "606": (41.8781, -87.6298),
    "900": (34.0522, -118.2437), "901": (34.0522, -118.2437), "902": (34.0736, -118.4004), "941": (37.7749, -122.4194), "021": (42.3601, -71.0589), "022": (42.3584, -71.0598),
    "752": (32.7767, -96.7970), "770": (29.7604, -95.3698), "331": (25.7617, -80.1918), "200": (38.9072, -77.0369), "191": (39.9526, -75.1652), "802": (39.7392, -104.9903),
    "303": (33.7490, -84.3880), "981": (47.6062, -122.3321), "850": (33.4484, -112.0740), "554": (44.9778, -93.2650), "282": (35.2271, -80.8431),
}
METRO_ZIP3 = tuple(METRO_CENTROIDS)


def zip_agrees(state: Column, zip5: Column) -> Column:
    return F.coalesce(zip3_state(zip5) == state, F.lit(False))


def in_us(df: DataFrame) -> Column:
    """Whether a row is a US address; tables without `is_us` hold no others."""
    return F.col("is_us") if "is_us" in df.columns else F.lit(True)


def delivery(df: DataFrame) -> DataFrame:
    """Adds rdi, cmra, vacant, footnotes, deliverability from street1, street2, city, state, zip5, address_status, is_private_residence, is_hub
    and raw (the whole input line). Elsewhere than in the US a standardized row is deliverable and nothing more is known."""
    raw = F.upper(F.coalesce("raw", F.lit("")))
    s1, s2, failed = F.col("street1"), F.col("street2"), F.col("address_status") == "parse_failed"
    cmra = F.concat_ws(" ", s1, s2, raw).rlike(CMRA)
    kind = F.split(s2, " ")[0]
    digits = F.regexp_replace(F.split(s1, " ")[0], r"\D", "")
    agrees = ~failed & (F.length("zip5") == 5) & zip_agrees(F.col("state"), F.col("zip5"))
    box, rural, military = s1.startswith("PO BOX"), s1.rlike("^(RR|HC) "), F.col("city").isin("APO", "FPO", "DPO") | F.col("state").isin("AE", "AP", "AA")
    numbered = (digits != "") & ~digits.rlike("^0+$")
    street = (
        F.when(failed | (s1 == ""), F.array(F.lit("M1"))).when(box, F.array(F.lit("BB"), F.lit("PB"))).when(rural, F.array(F.lit("BB"), F.lit("RR"))).when(military, F.array(F.lit("BB"), F.lit("F1")))
        .when(digits.rlike("^0+$"), F.array(F.lit("M3"))).when(numbered & (s2 != ""), F.array(F.lit("BB"), F.lit("CC"))).when(numbered & F.col("is_hub"), F.array(F.lit("BB"), F.lit("N1")))
        .when(numbered, F.array(F.lit("BB"))).otherwise(F.array(F.lit("M1")))
    )
    notes = F.concat(F.array(F.when(agrees, F.lit("AA")).otherwise(F.lit("A1"))), street)
    home = in_us(df)
    out = df.withColumns({
        "cmra": home & cmra, "vacant": home & raw.rlike(r"\bVACANT\b"), "footnotes": F.when(home, notes).otherwise(F.array().cast("array<string>")),
        "rdi": F.when(~home, "UNKNOWN").when(F.col("is_hub") | cmra | kind.isin(*COMMERCIAL_UNITS), "COMMERCIAL").when(F.col("is_private_residence") | kind.isin(*RESIDENTIAL_UNITS), "RESIDENTIAL").otherwise("UNKNOWN"),
    })
    bad = F.arrays_overlap("footnotes", F.array(F.lit("M1"), F.lit("M3"))) | failed | (home & F.array_contains("footnotes", "A1") & (F.col("zip5") != ""))
    return settle(out.withColumn("deliverability", F.when(bad, "UNDELIVERABLE").when(F.array_contains("footnotes", "N1"), "REQUIRES_SECONDARY").otherwise("DELIVERABLE")))


def codes_of(*pairs: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in pairs]))


def confidence(df: DataFrame, metro_zip3: tuple[str, ...] = METRO_ZIP3) -> DataFrame:
    """Adds s_parse, s_ref, s_geo, s_cross, composite, tier and reason_codes. The four parts lose points for what is missing or
    disagrees, and the composite is their weighted sum, rounded to 4 places. Outside the US only a code in the city and a missing
    city cost points."""
    s1 = F.col("street1")
    failed = (F.col("address_status") == "parse_failed") | (s1 == "")
    special = s1.startswith("PO BOX") | s1.rlike("^(RR|HC) ") | F.col("is_private_residence") | s1.contains(" & ")
    no_number = ~special & ~F.split(s1, " ")[0].rlike(r"\d")
    odd_city = F.col("city").rlike(r"\d") | dims.within(dims.DIRECTIONS, F.col("city"))
    bad_state = ~dims.within(dims.STATE_CODES, F.col("state"))
    no_zip = F.length("zip5") != 5
    no_suffix = ~special & ~F.exists(F.split(s1, " "), lambda t: dims.within(set(dims.SUFFIXES.values()), t))
    mismatch = ~no_zip & ~zip_agrees(F.col("state"), F.col("zip5"))
    lose = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    has_city = F.length("city") >= 2
    by_zip = zip3_state(F.col("zip5"))
    geo = F.when(dims.within(metro_zip3, F.substring("zip5", 1, 3)), 0.92).when(by_zip.isNotNull() | ~bad_state, 0.85).otherwise(0.50)
    parts = {
        "s_parse": clamp(1.0 - lose(no_number, 0.35) - lose(odd_city, 0.25)),
        "s_ref": clamp(1.0 - lose(bad_state, 0.40) - F.when(no_zip & ~bad_state & has_city, 0.15).when(no_zip, 0.30).otherwise(0.0) - lose(no_suffix, 0.20)),
        "s_geo": clamp(geo - lose(odd_city, 0.30)),
        "s_cross": F.when(by_zip.isNotNull(), F.when(by_zip == F.col("state"), 1.0).when(F.col("state") != "", 0.20).otherwise(0.50)).when((F.length("zip5") < 3) & (F.col("state") == ""), 0.20).otherwise(0.80),
    }
    home = in_us(df)
    postal = F.col("postal_code") if "postal_code" in df.columns else F.col("zip5")
    coded = F.col("city").rlike(r"^\d") | ((F.coalesce(postal, F.lit("")) == "") & F.col("city").rlike(r"\b\d{2,}\b"))
    abroad = {
        "s_parse": F.when(coded, 0.75).otherwise(1.0), "s_ref": F.lit(1.0), "s_geo": F.when(coded, 0.50).when(F.col("city") != "", 0.90).otherwise(0.60), "s_cross": F.when(coded, 0.50).otherwise(1.0),
    }
    parts = {k: F.when(home, v).otherwise(abroad[k]) for k, v in parts.items()}
    codes = codes_of(
        ("WARN_POSTAL_IN_CITY", ~home & ~failed & coded), ("ERR_EMPTY_STREET", s1 == ""), ("ERR_PARSE_FAILED", failed & (s1 != "")), ("ERR_CITY_ANOMALY", home & ~failed & odd_city), ("ERR_MISSING_HOUSE_NUM", home & ~failed & no_number), ("ERR_UNRESOLVED_SUFFIX", home & ~failed & no_suffix),
        ("ERR_ZIP_STATE_MISMATCH", home & ~failed & mismatch), ("WARN_CRA_HUB_DETECTED", F.col("is_hub")), ("WARN_CMRA_DETECTED", F.col("cmra")), ("WARN_RESIDENTIAL_COMM", F.col("is_private_residence")), ("WARN_VACANT_DELIVERY_POINT", F.col("vacant")),
    )
    out = df.withColumns({k: F.when(failed, 0.0).otherwise(v) for k, v in parts.items()} | {"reason_codes": codes})
    total = WEIGHTS["parse"] * F.col("s_parse") + WEIGHTS["ref"] * F.col("s_ref") + WEIGHTS["geo"] * F.col("s_geo") + WEIGHTS["cross"] * F.col("s_cross")
    out = out.withColumn("composite", F.round(total, 4))
    errors = F.exists("reason_codes", lambda c: c.startswith("ERR_"))
    manual = failed | F.array_contains("reason_codes", "ERR_MISSING_HOUSE_NUM")
    tier = F.when(manual, "MANUAL_STEWARDSHIP").when((F.col("composite") >= AUTO_PASS) & ~errors, "AUTO_PASS").when(F.col("composite") >= FUZZY_REVIEW, "FUZZY_REVIEW").otherwise("MANUAL_STEWARDSHIP")
    return settle(out.withColumn("tier", tier))


def is_acceptable(strict: bool = True) -> Column:
    """Whether a scored row is a valid address: tier, deliverability and no error code."""
    tiers = ("AUTO_PASS",) if strict else ("AUTO_PASS", "FUZZY_REVIEW")
    return F.col("tier").isin(*tiers) & (F.col("deliverability") != "UNDELIVERABLE") & ~F.exists("reason_codes", lambda c: c.startswith("ERR_"))


def stewardship(df: DataFrame) -> DataFrame:
    """Adds action_type, review_status and whether the row belongs in the ledger."""
    manual = F.col("tier") == "MANUAL_STEWARDSHIP"
    failed = F.col("address_status") == "parse_failed"
    healed = F.arrays_overlap("reason_codes", F.array(F.lit("WARN_TYPO_HEALED"), F.lit("ERR_ZIP_STATE_MISMATCH")))
    errors = F.exists("reason_codes", lambda c: c.startswith("ERR_"))
    return df.withColumns({
        "action_type": F.when(failed | manual, "REJECT_UNPARSEABLE").when(healed, "AUTO_HEAL").otherwise("AUTO_PASS"),
        "review_status": F.when(manual | F.col("is_hub") | errors, "PENDING").otherwise("APPROVED"),
        "to_ledger": manual | F.col("is_hub") | failed,
    })


def corporate_risk(df: DataFrame) -> DataFrame:
    """Adds risk: the hub's base score with 0.05 more without a unit, 0.60 for a mail drop, 0.40 for a private residence."""
    base = F.when(F.col("is_hub"), F.coalesce("hub_risk", F.lit(0.85)) + F.when(F.col("street2") == "", 0.05).otherwise(0.0)).when(F.col("cmra"), 0.60).when(F.col("is_private_residence"), 0.40).otherwise(0.0)
    return df.withColumn("risk", F.round(F.least(F.lit(1.0), base), 4))


# Starting confidence of a street line by how it was parsed.
PATH_CONFIDENCE = {"expression": 0.99, "rules": 0.95, "international": 0.90}


def field_confidence(df: DataFrame, reference_status: Column | None = None) -> DataFrame:
    """Adds `field_confidence`, a struct of six heuristic values between 0 and 1, to standardized and scored rows: what was supplied,
    inferred or split off, how the street was parsed, whether ZIP and state agree, and the status of a reference check."""
    code = lambda c: F.array_contains("reason_codes", c)
    lose = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    clamp = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4)
    status = F.coalesce(reference_status if reference_status is not None else F.lit(None).cast("string"), F.lit(""))
    base = F.lit(0.90)
    for path, x in PATH_CONFIDENCE.items():
        base = F.when(F.col("parse_path") == path, x).otherwise(base)
    street = F.when(F.col("street1") == "", 0.0).when(F.col("is_private_residence"), 0.30).otherwise(base - lose(code("ERR_MISSING_HOUSE_NUM"), 0.35) - lose(code("ERR_UNRESOLVED_SUFFIX"), 0.20))
    unit = F.when((F.col("street2") == "") & F.array_contains("footnotes", "N1"), 0.50).when(F.col("street2") == "", 1.0).when(F.col("_street2") != "", 0.97).otherwise(0.85)
    city = F.when(F.col("city") == "", 0.0).otherwise(F.when(status == "confirmed", 0.99).when(status == "place_mismatch", 0.57).otherwise(0.95))
    mismatch = F.col("is_us") & (F.length("zip5") == 5) & ~zip_agrees(F.col("state"), F.col("zip5"))
    known = F.when(F.col("state") == "", F.when(F.col("is_us"), 0.0).otherwise(1.0)).when(F.col("is_us") & ~dims.within(dims.STATE_CODES, F.col("state")), 0.20).when(F.col("_state") == "", 0.85).otherwise(0.97)
    state = F.when(mismatch, F.least(known, F.lit(0.35))).when(F.col("is_us") & zip_agrees(F.col("state"), F.col("zip5")), known + 0.02).otherwise(known)
    state = F.when(status == "state_mismatch", F.least(state, F.lit(0.30))).otherwise(state)
    postal = F.when(F.col("postal_code") == "", 0.0).when(F.col("is_us") & (F.col("zip5") == ""), 0.30).otherwise(0.97)
    postal = F.when(status == "postal_unknown", F.least(postal, F.lit(0.30))).when(status.isin("confirmed", "place_mismatch", "state_mismatch"), postal + 0.03).otherwise(postal)
    country = F.when(F.col("_country") != "", 0.99).when(F.col("is_us"), 0.60).otherwise(0.70)
    parts = {"street1": street, "street2": unit, "city": city, "state": state, "postal_code": postal, "country": country}
    return df.withColumn("field_confidence", F.struct(*[clamp(v).alias(k) for k, v in parts.items()]))
