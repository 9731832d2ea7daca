"""Countries and their postal codes: a dimension, look-ups over its aliases, validation and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Alpha-3, alpha-2, name, pattern of a postal code in capitals (empty: none is issued), example.
COUNTRIES = (
    ("USA", "US", "UNITED STATES", r"\d{5}(-\d{4})?", "12345"), ("CAN", "CA", "CANADA", r"[ABCEGHJ-NPRSTVXY]\d[A-Z] ?\d[A-Z]\d", "K1A 0B1"), ("GBR", "GB", "UNITED KINGDOM", r"(GIR ?0AA|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})", "SW1A 1AA"),
    ("IRL", "IE", "IRELAND", r"[A-Z]\d[\dW] ?[A-Z\d]{4}", "A65 F4E2"), ("DEU", "DE", "GERMANY", r"\d{5}", "10115"), ("FRA", "FR", "FRANCE", r"\d{5}", "75001"), ("ITA", "IT", "ITALY", r"\d{5}", "00118"),
    ("ESP", "ES", "SPAIN", r"(0[1-9]|[1-4]\d|5[0-2])\d{3}", "28001"), ("PRT", "PT", "PORTUGAL", r"\d{4}(-\d{3})?", "1000-001"), ("NLD", "NL", "NETHERLANDS", r"[1-9]\d{3} ?[A-Z]{2}", "1012 AB"),
    ("BEL", "BE", "BELGIUM", r"[1-9]\d{3}", "1000"), ("LUX", "LU", "LUXEMBOURG", r"(L-)?\d{4}", "1009"), ("CHE", "CH", "SWITZERLAND", r"[1-9]\d{3}", "8001"), ("AUT", "AT", "AUSTRIA", r"\d{4}", "1010"),
    ("DNK", "DK", "DENMARK", r"\d{4}", "1050"), ("NOR", "NO", "NORWAY", r"\d{4}", "0150"), ("SWE", "SE", "SWEDEN", r"\d{3} ?\d{2}", "111 22"), ("FIN", "FI", "FINLAND", r"\d{5}", "00100"), ("ISL", "IS", "ICELAND", r"\d{3}", "101"),
    ("POL", "PL", "POLAND", r"\d{2}-?\d{3}", "00-001"), ("CZE", "CZ", "CZECHIA", r"\d{3} ?\d{2}", "110 00"), ("SVK", "SK", "SLOVAKIA", r"\d{3} ?\d{2}", "811 01"), ("HUN", "HU", "HUNGARY", r"[1-9]\d{3}", "1011"),
    ("ROU", "RO", "ROMANIA", r"\d{6}", "010011"), ("BGR", "BG", "BULGARIA", r"\d{4}", "1000"), ("GRC", "GR", "GREECE", r"\d{3} ?\d{2}", "105 57"), ("HRV", "HR", "CROATIA", r"\d{5}", "10000"), ("SRB", "RS", "SERBIA", r"\d{5}", "11000"),
    ("UKR", "UA", "UKRAINE", r"\d{5}", "01001"), ("RUS", "RU", "RUSSIA", r"\d{6}", "101000"), ("TUR", "TR", "TURKEY", r"\d{5}", "06100"), ("ISR", "IL", "ISRAEL", r"\d{5}(\d{2})?", "9100000"), ("SAU", "SA", "SAUDI ARABIA", r"\d{5}(-\d{4})?", "11564"),
    ("ARE", "AE", "UNITED ARAB EMIRATES", "", ""), ("EGY", "EG", "EGYPT", r"\d{5}", "11511"), ("ZAF", "ZA", "SOUTH AFRICA", r"\d{4}", "8001"), ("NGA", "NG", "NIGERIA", r"\d{6}", "100001"), ("KEN", "KE", "KENYA", r"\d{5}", "00100"),
    ("MAR", "MA", "MOROCCO", r"\d{5}", "20000"), ("IND", "IN", "INDIA", r"[1-9]\d{2} ?\d{3}", "110001"), ("PAK", "PK", "PAKISTAN", r"\d{5}", "44000"), ("BGD", "BD", "BANGLADESH", r"\d{4}", "1000"), ("LKA", "LK", "SRI LANKA", r"\d{5}", "00100"),
    ("CHN", "CN", "CHINA", r"\d{6}", "100000"), ("JPN", "JP", "JAPAN", r"\d{3}-?\d{4}", "100-0001"), ("KOR", "KR", "SOUTH KOREA", r"\d{5}", "03051"), ("TWN", "TW", "TAIWAN", r"\d{3}(\d{2,3})?", "100"), ("HKG", "HK", "HONG KONG", "", ""),
    ("SGP", "SG", "SINGAPORE", r"\d{6}", "018956"), ("MYS", "MY", "MALAYSIA", r"\d{5}", "50000"), ("THA", "TH", "THAILAND", r"\d{5}", "10200"), ("IDN", "ID", "INDONESIA", r"\d{5}", "10110"), ("PHL", "PH", "PHILIPPINES", r"\d{4}", "1000"),
    ("VNM", "VN", "VIETNAM", r"\d{5,6}", "100000"), ("AUS", "AU", "AUSTRALIA", r"\d{4}", "2000"), ("NZL", "NZ", "NEW ZEALAND", r"\d{4}", "1010"), ("MEX", "MX", "MEXICO", r"\d{5}", "06000"), ("BRA", "BR", "BRAZIL", r"\d{5}-?\d{3}", "01310-100"),
    ("ARG", "AR", "ARGENTINA", r"([A-Z]?\d{4}([A-Z]{3})?)", "C1001AAA"), ("COL", "CO", "COLOMBIA", r"\d{6}", "110111"), ("CHL", "CL", "CHILE", r"\d{3}-?\d{4}", "8320000"), ("PER", "PE", "PERU", r"\d{5}", "15001"), ("PAN", "PA", "PANAMA", "", ""),
)

# Further names.
ALIASES = {
    "UNITED STATES OF AMERICA": "USA", "AMERICA": "USA", "U S A": "USA", "UK": "GBR", "GREAT BRITAIN": "GBR", "ENGLAND": "GBR", "SCOTLAND": "GBR", "WALES": "GBR", "NORTHERN IRELAND": "GBR",
    "DEUTSCHLAND": "DEU", "ESPANA": "ESP", "ITALIA": "ITA", "HOLLAND": "NLD", "NEDERLAND": "NLD", "THE NETHERLANDS": "NLD", "SCHWEIZ": "CHE", "SUISSE": "CHE", "OSTERREICH": "AUT", "SVERIGE": "SWE",
    "DANMARK": "DNK", "NORGE": "NOR", "SUOMI": "FIN", "POLSKA": "POL", "CZECH REPUBLIC": "CZE", "BRASIL": "BRA", "KOREA": "KOR", "REPUBLIC OF KOREA": "KOR", "UAE": "ARE", "RUSSIAN FEDERATION": "RUS", "TURKIYE": "TUR", "VIET NAM": "VNM",
}
UNKNOWN = "ZZZ"


def alias_table() -> dict[str, str]:
    out = {}
    for a3, a2, name, *_ in COUNTRIES:
        out |= {a3: a3, a2: a3, name: a3}
    return out | ALIASES


def country_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COUNTRIES), "iso3 string, iso2 string, name string, postal_pattern string, example string")


def country_code(country: Column) -> Column:
    """ISO alpha-3 of a code or name; USA where none is given; ZZZ where it names nothing known."""
    from .dims import lookup

    clean = F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(country, F.lit(""))), r"[^A-Z ]+", " "), r"\s+", " "))
    return F.when(clean == "", "USA").otherwise(F.coalesce(lookup(alias_table(), clean), F.lit(UNKNOWN)))


def validate_postal(rows: DataFrame, code: str = "postal_code", country: str = "iso3") -> DataFrame:
    """Adds is_valid, is_non_postal_country, formatted, reason. The rules are a fixed dimension, joined by code (broadcast)."""
    dim = F.broadcast(country_dim(rows.sparkSession).select(F.col("iso3").alias("_iso3"), "postal_pattern"))
    clean = F.trim(F.regexp_replace(F.upper(F.coalesce(F.col(code), F.lit(""))), r"\s+", " "))
    joined = rows.join(dim, F.col(country) == F.col("_iso3"), "left").withColumn("_c", clean)
    fits = F.expr("regexp_like(_c, concat('^(?:', postal_pattern, ')$'))")
    compact = F.regexp_replace("_c", "[ -]", "")
    formatted = (
        F.when(F.col(country).isin("GBR"), F.regexp_replace(compact, r"^(.+)(.{3})$", "$1 $2")).when(F.col(country).isin("CAN", "IRL"), F.regexp_replace(compact, r"^(.{3})(.+)$", "$1 $2"))
        .when(F.col(country) == "NLD", F.regexp_replace(compact, r"^(.{4})(.+)$", "$1 $2")).when(F.col(country).isin("SWE", "CZE", "SVK", "GRC"), F.regexp_replace(compact, r"^(.{3})(.+)$", "$1 $2"))
        .when(F.col(country) == "POL", F.regexp_replace(compact, r"^(.{2})(.+)$", "$1-$2")).when(F.col(country) == "JPN", F.regexp_replace(compact, r"^(.{3})(.+)$", "$1-$2"))
        .when(F.col(country) == "BRA", F.regexp_replace(compact, r"^(.{5})(.+)$", "$1-$2")).otherwise(F.col("_c"))
    )
    none = F.col("postal_pattern") == ""
    out = joined.withColumns({
        "is_non_postal_country": F.coalesce(none, F.lit(False)),
        "is_valid": F.coalesce(F.when(none, F.col("_c") == "").otherwise(fits), F.lit(False)),
        "formatted": F.when(F.coalesce(fits & ~none, F.lit(False)), formatted).otherwise(F.lit("")),
    })
    reason = F.when(F.col("postal_pattern").isNull(), "unknown_country").when(F.col("is_valid"), "ok").when(none, "country_has_no_codes").when(F.col("_c") == "", "empty").otherwise("pattern_mismatch")
    return out.withColumn("reason", reason).drop("_iso3", "_c", "postal_pattern")


def extract_postal(text: Column, iso3: Column) -> Column:
    """The last code of the country's pattern in a text that stands alone, or empty."""
    from .dims import lookup

    pattern = lookup({code: rf"(?<![A-Z0-9])({p})(?![A-Z0-9])" for code, _, _, p, _ in COUNTRIES if p}, iso3)
    found = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), pattern, 1)
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))
