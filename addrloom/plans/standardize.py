"""The standardization plan: clean, split by path, keys, scores. Every stage is a column, so what a query leaves out is pruned."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import us
from ..functions.country import country_code
from ..functions.grammar import country_at_end, international
from ..functions.rules import rule_street
from ..functions.text import coerce_text, squeeze
from .barrier import settle
from ..operators.scoring import confidence, delivery

MOST_CHARS = 600
FIELDS = ("street1", "street2", "city", "state", "postal_code", "country")
OUTPUT = ("street1", "street2", "city", "state", "postal_code", "zip5", "country", "normalized_address_key", "building_key", "phonetic_key", "address_status", "is_us", "is_private_residence", "parse_path", "rdi", "deliverability", "footnotes", "composite", "tier", "reason_codes")
LINE = r"^\s*([^,]+?)\s*,\s*(?:((?:APT|SUITE|STE|UNIT|FL|FLOOR|BLDG|#)[^,]*?)\s*,\s*)?([A-Za-z .'-]+?)\s*,\s*([A-Za-z]{2}|[A-Za-z]+(?: [A-Za-z]+)?)\s+(\d{5}(?:-\d{4})?)\s*$"


def resolve_columns(df: DataFrame, columns: dict[str, str] | None = None) -> dict[str, Column]:
    """Six input columns by name, by the caller's mapping, or by the usual aliases. A missing street raises; others warn and read as null."""
    aliases = {"street1": ("street", "address", "address1"), "street2": ("suite", "apt", "unit", "address2"), "city": (), "state": ("province",), "postal_code": ("zip", "zipcode", "postcode"), "country": ()}
    have = {c.lower(): c for c in df.columns}
    out = {}
    for field in FIELDS:
        wanted = (columns or {}).get(field)
        names = (wanted,) if wanted else (field, *aliases[field])
        found = next((have[n.lower()] for n in names if n.lower() in have), None)
        if found is None and field == "street1":
            raise ValueError(f"no column for street1 among {df.columns}")
        if found is None and wanted:
            warnings.warn(f"column {wanted!r} for {field} is missing and reads as null", stacklevel=3)
        out[field] = F.col(f"`{found}`") if found else F.lit(None).cast("string")
    return out


def split_line(line: Column) -> Column:
    """Fields of a canonical comma line, empty where it is none. The flag makes the unit's words match in any case."""
    part = lambda k: F.regexp_extract(line, "(?i)" + LINE, k)
    return F.struct(part(1).alias("street1"), part(2).alias("street2"), part(3).alias("city"), part(4).alias("state"), part(5).alias("postal_code"))


def standardized(df: DataFrame, columns: dict[str, str] | None = None, allow_locality: bool = False, score: bool = True) -> DataFrame:
    """The input's columns in one struct `row`, and the output columns beside it. No shuffle: one projection, with an Arrow batch only for
    lines that the expressions leave open."""
    given = {k: coerce_text(v) for k, v in resolve_columns(df, columns).items()}
    out = df.select(F.struct("*").alias("row"), *[v.alias(f"_{k}") for k, v in given.items()])
    single = (F.col("_city") == "") & (F.col("_postal_code") == "") & F.col("_street1").contains(",")
    out = out.withColumn("_line", F.when(single, split_line(F.col("_street1"))))
    take = lambda k: F.when(F.coalesce(F.col("_line.postal_code"), F.lit("")) != "", F.col(f"_line.{k}")).otherwise(F.col(f"_{k}"))
    out = out.withColumns({f"_{k}": take(k) for k in FIELDS[:5]})
    out = out.withColumn("raw", F.array_join(F.filter(F.array(*[F.col(f"_{k}") for k in FIELDS]), lambda x: x != ""), ", "))
    named = F.when((F.col("_country") == "") & single, country_at_end(F.col("_street1")))
    out = out.withColumns({"country": F.coalesce(named, country_code(F.col("_country"))), "_swap": us.swap_city_state(F.col("_city"), F.col("_state")), "_zip": us.us_postal(F.col("_postal_code"))})
    out = out.withColumn("is_us", F.col("country") == "USA")
    out = out.withColumns({"zip5": F.col("_zip.zip5"), "_phrase": us.street_phrase(F.col("_street1"))})
    intl = international(*[F.col(f"_{k}") for k in FIELDS[:5]], F.col("country"))
    out = out.withColumn("_intl", F.when(~F.col("is_us"), intl))
    open_ = F.col("is_us") & F.col("_phrase.street1").isNull() & (F.col("_street1") != "")
    out = out.withColumn("_rule", rule_street(F.when(open_, F.col("_street1"))))
    long = F.greatest(*[F.length(f"_{k}") for k in FIELDS]) > MOST_CHARS
    garbage = F.upper("_street1").isin(*us.GARBAGE)
    street1 = F.when(long | garbage, "").when(~F.col("is_us"), F.col("_intl.street1")).otherwise(F.coalesce("_phrase.street1", "_rule.street1", F.lit("")))
    own = F.when(F.col("_phrase.street1").isNotNull(), F.col("_phrase.unit")).otherwise(F.coalesce("_rule.unit", F.lit("")))
    second = F.upper(squeeze(F.col("_street2")))
    second = F.when(F.col("is_us"), F.coalesce(F.nullif(us.unit_of(second), F.lit("")), second)).otherwise(F.col("_intl.street2"))
    out = out.withColumns({
        "street1": street1, "street2": F.trim(F.concat_ws(" ", second, F.when(F.col("is_us"), own))), "city": F.when(F.col("is_us"), us.clean_city(F.col("_swap.city"))).otherwise(F.col("_intl.city")),
        "state": F.when(F.col("is_us"), us.us_state(F.col("_swap.state"), F.col("zip5"))).otherwise(F.col("_intl.state")),
        "postal_code": F.when(F.col("is_us"), F.col("_zip.formatted")).otherwise(F.col("_intl.postal_code")),
        "parse_path": F.when(~F.col("is_us"), "international").when(F.col("_phrase.street1").isNotNull(), "expression").when(F.coalesce("_rule.understood", F.lit(False)), "rules").otherwise("none"),
    })
    locality = (F.col("street1") == "") & (F.col("city") != "") & ((F.col("state") != "") | (F.col("postal_code") != "")) & ~garbage & ~long
    status = F.when((F.col("street1") != "") & (F.col("parse_path") != "none"), "standardized").when(locality & F.lit(allow_locality), "locality_only").otherwise("parse_failed")
    out = out.withColumns({"address_status": status, "is_private_residence": F.col("street1") == "PRIVATE RESIDENCE", "is_hub": F.lit(False)})
    code = F.when(F.col("is_us"), F.col("zip5")).otherwise(F.col("postal_code"))
    key = lambda unit: F.when(status.isin("standardized", "locality_only"), F.concat_ws("|", "street1", unit, "city", "state", code, "country"))
    out = out.withColumns({"normalized_address_key": key(F.col("street2")), "building_key": key(F.lit("")), "phonetic_key": us.phonetic_key(F.col("street1"), code, F.col("city"))})
    out = settle(out)
    return confidence(delivery(out)) if score else out


def standardize(df: DataFrame, columns: dict[str, str] | None = None, as_struct: bool = False, output_prefix: str = "std_", allow_locality: bool = False) -> DataFrame:
    """The input with its own columns, and the output as prefixed columns (those of the same name are replaced) or as one struct
    `standardized_address`."""
    out = standardized(df, columns, allow_locality)
    if as_struct:
        kept = [c for c in df.columns if c != "standardized_address"]
        return out.select(*[F.col(f"row.`{c}`") for c in kept], F.struct(*OUTPUT).alias("standardized_address"))
    new = [f"{output_prefix}{c}" for c in OUTPUT]
    kept = [c for c in df.columns if c not in new]
    return out.select(*[F.col(f"row.`{c}`") for c in kept], *[F.col(c).alias(n) for c, n in zip(OUTPUT, new)])


def dedupe_apply(df: DataFrame, keys: list[str], fn) -> DataFrame:
    """fn on the distinct keys, joined back null-safely: for functions that cost more than a shuffle of the keys."""
    done = fn(df.select(*keys).distinct())
    added = [c for c in done.columns if c not in keys]
    names = {k: f"_k{n}" for n, k in enumerate(keys)}
    small = done.select(*[F.col(k).alias(names[k]) for k in keys], *added)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(names[k]))
    return df.join(small, cond, "left").drop(*names.values())


def register_functions(spark: SparkSession) -> None:
    """SQL functions us_state_code, us_zip5, us_street, us_unit and damerau_levenshtein, by Arrow batches."""
    from ..functions.text import damerau_levenshtein

    for name in ("us_state_code", "us_zip5", "us_street", "us_unit"):
        spark.udf.register(name, _as_udf(name))
    spark.udf.register("damerau_levenshtein", damerau_levenshtein)


def _as_udf(name: str):
    """Arrow functions with the rule parser's results, for SQL text; tables should use `standardize`, whose expressions stay in the JVM."""
    from ..functions import dims
    from ..functions.rules import parse_street

    def state(x: str) -> str:
        return dims.STATES.get(x.strip().upper(), x.strip().upper())

    def zip5(x: str) -> str:
        digits = x.strip().replace("-", "").replace(" ", "")
        return digits[:5] if digits.isdigit() and len(digits) in (5, 9) else f"0{digits}" if digits.isdigit() and len(digits) == 4 else ""

    one = {"us_state_code": state, "us_zip5": zip5, "us_street": lambda x: parse_street(x)[0], "us_unit": lambda x: parse_street(x)[1]}[name]

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(one, na_action="ignore")

    return run
