"""Clean-up expressions and address lines outside the US: worked examples, nulls and empty texts."""

import pytest
from pyspark.sql import functions as F

from addrloom.functions import cleanup as C
from addrloom.functions import grammar as G
from addrloom.plans.standardize import standardize


def each(spark, fn, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r.y for r in df.select("k", fn(F.col("x")).alias("y")).orderBy("k").collect()]


def test_care_of(spark):
    cases = {
        "c/o Acme Holdings LLC, 100 Main St": ("100 Main St", "Acme Holdings LLC"),
        "100 Main St, Attn: Jane Roe": ("100 Main St", "Jane Roe"),
        "100 Main St (C/O Bob)": ("100 Main St", "Bob"),
        "c/o Acme 500 Holdings LLC, 12 N Oak Ave Apt 4": ("12 N Oak Ave Apt 4", "Acme 500 Holdings LLC"),
        "12 Attention St": ("12 Attention St", ""),
        "c/o Jane Roe": ("", "Jane Roe"),
        "In care of Smith, PO Box 12": ("PO Box 12", "Smith"),
        "12 Oak St": ("12 Oak St", ""),
        "": ("", ""),
        None: ("", ""),
    }
    assert [tuple(r) for r in each(spark, C.care_of, list(cases))] == list(cases.values())


def test_repeats(spark):
    cases = {"100 MAIN ST, 100 main st": "100 MAIN ST", "STE 4075 4075 4075": "STE 4075", "CALLE 75 8-77 OF.301 CALLE 75 8-77 OF.301": "CALLE 75 8-77 OF.301", "Walla Walla": "Walla Walla", "A, A, A": "A", "": "", None: None}
    assert each(spark, C.collapse_repeats, list(cases)) == list(cases.values())
    long = "12 Oak St " * 100
    assert each(spark, C.collapse_repeats, [long]) == [long]


def test_tails(spark):
    tail = lambda x: C.redundant_tail(x, F.lit("New York"), F.lit("NY"), F.lit("10005"))
    cases = {"100 Wall St, New York, NY 10005, USA": "100 Wall St", "100 Wall St": "100 Wall St", "100 Wall St New York New York 10005": "100 Wall St", "New York": "", "": ""}
    assert each(spark, tail, list(cases)) == list(cases.values())


def test_corners(spark):
    cases = {
        "Cherry And Fourth Streets": "CHERRY ST & 4TH ST", "Routes 60 And 155": "RT 60 & RT 155", "Ranch Road 12 And River Road": "RANCH RD 12 & RIVER RD", "Corner of 5th Ave and 42nd St": "5TH AVE & 42ND ST",
        "The Village at Thornblade": None, "Suite 4 and 5": None, "Smith and Jones": None, "": None, None: None,
    }
    assert each(spark, C.intersection, list(cases)) == list(cases.values())


def test_small_helpers(spark):
    assert each(spark, C.rooftop_line, ["100 Main St Bldg 4 Ste 200", "PO Box 4", "100 Main St # 4", "", None]) == ["100 MAIN ST", None, "100 MAIN ST", None, None]
    assert each(spark, C.unit_digits, ["100 Main St Suite Four", "One Floor"]) == ["100 Main St Suite 4", "One Floor"]
    assert each(spark, C.po_box_spelling, ["P.O. Box #5", "PO Box5", "P O Box 5", "P.O.B. 5", "Post Office Box 5", "12 Oak St"]) == ["PO BOX 5"] * 5 + ["12 Oak St"]
    ranges = F.expr("array(named_struct('low', 100L, 'high', 199L))")
    assert each(spark, lambda x: C.heal_house_number(x, ranges), ["150", "510", "015", "051", "5", "510B", "", None]) == ["150", "150", "105", None, None, "150B", None, None]
    state = lambda z: C.correct_state(F.lit("NY"), z, F.lit(""))
    assert [tuple(r) for r in each(spark, state, ["90012", "10005-1234", "12", None])] == [("CA", "NY"), ("NY", None), ("NY", None), ("NY", None)]


@pytest.mark.parametrize(
    "line, iso3, want",
    [
        ("Musterstraße 12, 10115 Berlin, Germany", "DEU", ("MUSTERSTRASSE 12", "", "BERLIN", "", "10115", "12")),
        ("Torstr. 100, D-10119 Berlin, Deutschland", "DEU", ("TORSTRASSE 100", "", "BERLIN", "", "10119", "100")),
        ("Av. Insurgentes Sur 1602, Int. 401, Col. Crédito Constructor, 03940 Ciudad de México, CDMX, Mexico", "MEX", ("AV INSURGENTES SUR 1602", "INT 401", "CIUDAD DE MÉXICO", "CDMX", "03940", "1602")),
        ("ul. Marszałkowska 10/12, m. 14, 00-026 Warszawa, Poland", "POL", ("UL. MARSZAŁKOWSKA 10/12", "M. 14", "WARSZAWA", "", "00-026", "10/12")),
        ("Sheikh Zayed Road, P.O. Box 12345, Trade Centre 1, Dubai, United Arab Emirates", "ARE", ("SHEIKH ZAYED RD", "PO BOX 12345", "DUBAI", "", "", "")),
        ("15 High Street, Headingley, Leeds, LS6 2AA, UK", "GBR", ("15 HIGH ST", "", "LEEDS", "", "LS6 2AA", "15")),
        ("Flat 2, The Mansions, 15 High Street, Leeds LS6 2AA", "GBR", ("15 HIGH ST", "APT 2 THE MANSIONS", "LEEDS", "", "LS6 2AA", "15")),
        ("15 High Street, Leeds", "GBR", ("15 HIGH ST", "", "LEEDS", "", "", "15")),
        ("4/150 High Street, Sydney NSW 2000", "AUS", ("150 HIGH ST", "UNIT 4", "SYDNEY", "NSW", "2000", "150")),
        ("100 Rue de Paris, Lyon", "FRA", ("100 RUE DE PARIS", "", "LYON", "", "", "100")),
        ("", "FRA", ("", "", "", "", "", "")),
    ],
)
def test_lines_abroad(spark, line, iso3, want):
    empty = F.lit("")
    r = spark.createDataFrame([(line,)], "x string").select(G.international(F.col("x"), empty, empty, empty, empty, F.lit(iso3)).alias("y")).first().y
    assert (r.street1, r.street2, r.city, r.state, r.postal_code, r.house_number) == want


def test_standardized_abroad(spark):
    rows = [("Musterstraße 12, 10115 Berlin, Germany", None, None), ("15 High Street", "Leeds", "GBR"), ("100 Main St, Dallas, TX 75201", None, None)]
    got = standardize(spark.createDataFrame(rows, "street1 string, city string, country string")).collect()
    assert [(r.std_country, r.std_normalized_address_key, r.std_deliverability, r.std_tier) for r in got] == [
        ("DEU", "MUSTERSTRASSE 12||BERLIN||10115|DEU", "DELIVERABLE", "AUTO_PASS"), ("GBR", "15 HIGH ST||LEEDS|||GBR", "DELIVERABLE", got[1].std_tier), ("USA", "100 MAIN ST||DALLAS|TX|75201|USA", "DELIVERABLE", "AUTO_PASS"),
    ]


def test_every_country_has_a_family(spark):
    rows = {r.iso3: r for r in G.country_families(spark).collect()}
    assert len(rows) >= 249
    assert rows["DEU"].family == "germanic" and rows["DEU"].house_number_position == "after_street" and rows["DEU"].postal_position == "before_city"
    assert rows["KEN"].family == "mena_africa" and rows["JPN"].house_number_position == "cjk_hierarchical"
    assert set(G.FAMILY_OF) - set(rows) <= {"ATA", "BVT", "HMD"}


def test_sql_functions_of_texts_and_nulls(spark):
    from addrloom.plans import sqlfunctions

    sqlfunctions.register(spark)
    r = spark.sql("""SELECT standardize_address_key_text('100 Main Street, Suite 5, Dallas, TX 75201') AS key, standardize_address_key_text(CAST(NULL AS STRING)) AS none, standardize_address_key('', '', '', '') AS empty,
      standardize_address(CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)).street1 AS nothing, standardize_deliverability('100 Main St', 'Dallas', 'NY', '75201') AS bad, standardize_deliverability_text('PO Box 5, Dallas, TX 75201') AS box""").first()
    assert tuple(r) == ("100 MAIN ST|STE 5|DALLAS|TX|75201|USA", None, "", None, "UNDELIVERABLE", "DELIVERABLE")


def test_field_confidence_abroad(spark):
    from addrloom.operators.scoring import field_confidence
    from addrloom.plans.standardize import standardized

    df = spark.createDataFrame([("15 High Street", "Flat 4", "Leeds", "GBR"), ("", "", "", "")], "street1 string, street2 string, city string, country string")
    a, b = (r.field_confidence for r in field_confidence(standardized(df)).select("field_confidence").collect())
    assert tuple(a) == (0.9, 0.97, 0.95, 1.0, 0.0, 0.99)
    assert tuple(b) == (0.0, 1.0, 0.0, 0.0, 0.0, 0.6)
