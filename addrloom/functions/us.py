"""US addresses as Column expressions: state, postal code, street line, unit and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims
from .text import number_to_ordinal, soundex, squeeze

UNIT = r"(?:^|[\s,]+)(?:(APARTMENT|APT|SUITE|STE|UNIT|FLOOR|FL|ROOM|RM|BUILDING|BLDG|DEPARTMENT|DEPT|LOT|SPACE|SPC|TRAILER|TRLR|PMB)\.?\s*#?\s*|#\s*)([A-Z0-9][A-Z0-9-]*)\s*$"
PO_BOX = r"^(?:P\.?\s?O\.?|POST OFFICE)\s*(?:BOX|DRAWER)\s*#?\s*([A-Z0-9-]+)$"
PLACEHOLDERS = ("PRIVATE RESIDENCE", "CONFIDENTIAL", "PERSONAL RESIDENCE", "HOME OFFICE", "UNDISCLOSED", "RESIDENCE ONLY", "PRIVATE ADDRESS")
GARBAGE = ("N/A", "NONE", "NULL", "UNKNOWN", "-", ".", "NO ADDRESS")
LOOKUPS = {"directions": dims.DIRECTIONS, "suffixes": dims.SUFFIXES}


def zip3_state(zip5: Column) -> Column:
    """The state of a ZIP by its first three digits, or null: an array slot, so that no range is compared."""
    n = F.when(zip5.rlike(r"^\d{3}"), F.substring(zip5, 1, 3)).cast("int")
    return F.nullif(F.get(F.split(F.lit(dims.ZIP3_SLOTS), r"\|"), n), F.lit(""))


def us_state(state: Column, zip5: Column | None = None) -> Column:
    """A state's code from a code or name, with or without `US-`; else from the ZIP."""
    text = F.trim(F.regexp_replace(F.upper(F.trim(F.coalesce(state, F.lit("")))), r"^USA?-", ""))
    clean = F.regexp_replace(text, r"[^A-Z0-9\s]", "")
    code = F.coalesce(dims.lookup(dims.STATES, clean), clean)
    if zip5 is None:
        return code
    return F.when(dims.within(dims.STATE_CODES, code), code).otherwise(F.coalesce(zip3_state(zip5), code))


def us_postal(postal: Column) -> Column:
    """(formatted, zip5): ZIP, ZIP+4, or four digits that lost their zero; anything else is kept with an empty zip5."""
    clean = F.upper(F.trim(F.coalesce(postal, F.lit(""))))
    only = F.regexp_replace(clean, r"[- ]", "")
    zip5 = F.when(clean.rlike(r"^\d{4}$"), F.concat(F.lit("0"), clean)).when(only.rlike(r"^\d{5}$") & (~clean.contains("-") | clean.endswith("-")), only).when(only.rlike(r"^\d{9}$") & (~clean.contains("-") | clean.rlike(r"^\d{5}[-\s]\d{4}$")), F.substring(only, 1, 5)).otherwise("")
    formatted = F.when(zip5 == "", clean).when(F.length(only) == 9, F.concat(zip5, F.lit("-"), F.substring(only, 6, 4))).otherwise(zip5)
    return F.struct(formatted.alias("formatted"), zip5.alias("zip5"))


def swap_city_state(city: Column, state: Column) -> Column:
    """(city, state), exchanged where only the city field is a state."""
    is_state = lambda c: F.coalesce(dims.within((*dims.STATES, *dims.STATE_CODES), F.upper(F.regexp_replace(c, r"^[ .]+|[ .]+$", ""))), F.lit(False))
    swap = is_state(city) & ~is_state(state) & (F.coalesce(state, F.lit("")) != "")
    return F.struct(F.when(swap, state).otherwise(city).alias("city"), F.when(swap, city).otherwise(state).alias("state"))


def clean_city(city: Column) -> Column:
    return squeeze(F.regexp_replace(F.upper(F.coalesce(city, F.lit(""))), r"(?U)[^\w\s-]", ""))


def unit_of(line: Column) -> Column:
    """The unit at the end of an upper-case line, as `STE 200`; `#12` is a suite; empty without one."""
    kind, value = F.regexp_extract(line, UNIT, 1), F.regexp_extract(line, UNIT, 2)
    return F.when(value == "", "").otherwise(F.concat(F.coalesce(dims.lookup(dims.UNITS, kind), F.lit("STE")), F.lit(" "), value))


def street_phrase(line: Column) -> Column:
    """(street1, unit) of a plain street line, or a null street1 where only the rule parser can decide.

    Tokens are an array; the two directions and the suffix are read from its ends, and the name between is normalised token
    by token."""
    text = squeeze(F.upper(F.regexp_replace(F.coalesce(line, F.lit("")), r"[\r\n\t]+", " ")))
    text = F.regexp_replace(F.regexp_replace(text, r"[\s,]+(USA|US|UNITED STATES)$", ""), r"[ ,.-]+$", "")
    text = F.regexp_replace(text, r"^(\d+)([A-Z]{3,})", "$1 $2")
    unit, street = unit_of(text), F.regexp_replace(text, UNIT, "")
    tokens = F.filter(F.transform(F.split(street, " "), lambda t: F.regexp_replace(t, r"^[ ,.-]+|[ ,.-]+$", "")), lambda t: t != "")

    def parse(t: Column) -> Column:
        direction = lambda x: dims.lookup(dims.DIRECTIONS, x)
        n, house = F.size(t), F.get(t, F.lit(0))
        pre = F.when(n >= 4, direction(F.get(t, F.lit(1))))
        post = F.when(n - F.when(pre.isNotNull(), 1).otherwise(0) >= 4, direction(F.get(t, n - 1)))
        first = F.when(pre.isNotNull(), 2).otherwise(1)
        last = n - F.when(post.isNotNull(), 2).otherwise(1)
        suffix = dims.lookup(dims.SUFFIXES, F.get(t, last))
        name = F.slice(t, first + 1, F.greatest(last - first, F.lit(0)))
        number = lambda x: F.regexp_extract(x, r"^(\d{1,3})(?:ST|ND|RD|TH)?$", 1).try_cast("int")
        spoken = F.transform(name, lambda x: F.coalesce(dims.lookup(dims.ORDINALS, x), F.when(number(x) > 0, number_to_ordinal(number(x))), x))
        plain = (
            (n >= 3) & house.rlike(r"^\d+[A-Z]?$") & suffix.isNotNull() & F.size(name).between(1, 5)
            & ~(direction(F.get(t, F.lit(1))).isNotNull() & (direction(F.get(t, F.lit(2))).isNotNull() | (n == 3)))
            & ~F.exists(name, lambda x: x.rlike(r"^(\d{5}|COUNTY|CR|ROUTE|RT|RTE|STATE|HIGHWAY|HWY|INTERSTATE|US|SR|FM|\d/\d)$"))
        )
        return F.when(plain, F.concat_ws(" ", house, pre, F.array_join(spoken, " "), suffix, post))

    bound = F.get(F.transform(F.array(tokens), parse), F.lit(0))  # tokens are computed once
    street1 = F.when(text.isin(*PLACEHOLDERS), "PRIVATE RESIDENCE").when(text.rlike(PO_BOX), F.concat(F.lit("PO BOX "), F.regexp_extract(text, PO_BOX, 1))).otherwise(bound)
    return F.struct(street1.alias("street1"), F.when(text.rlike(PO_BOX) | text.isin(*PLACEHOLDERS), "").otherwise(unit).alias("unit"))


def phonetic_key(street1: Column, zip5: Column, city: Column) -> Column:
    """HOUSE|SOUNDEX or #N|LOCATION of a standardized street line, with its forms for PO boxes, rural routes and military units."""
    line = F.upper(F.trim(street1))
    loc = F.when(F.length(F.trim(zip5)) >= 5, F.substring(F.trim(zip5), 1, 5)).when(F.trim(city) != "", F.trim(city)).otherwise(F.trim(zip5))
    tokens = F.split(squeeze(F.regexp_replace(line, r"[,.;:]+", " ")), " ")

    def key(t: Column) -> Column:
        numbered = F.get(t, F.lit(0)).rlike(r"\d")
        fraction = F.get(t, F.lit(1)).isin("1/2", "1/4", "3/4")
        house = F.when(numbered & fraction, F.concat_ws(" ", F.get(t, F.lit(0)), F.get(t, F.lit(1)))).when(numbered, F.get(t, F.lit(0))).otherwise("")
        skip = F.when(numbered & fraction, 2).when(numbered, 1).otherwise(0)
        words = F.slice(t, skip + 1, F.greatest(F.size(t) - skip, F.lit(0)))
        is_dir, is_suffix = (lambda x: dims.lookup(dims.DIRECTIONS, x).isNotNull()), (lambda x: dims.lookup(dims.SUFFIXES, x).isNotNull())
        lead = is_dir(F.get(words, F.lit(0))) & (F.size(words) > 1) & ~((F.size(words) == 2) & is_suffix(F.get(words, F.lit(1))))
        word = F.coalesce(F.get(words, F.when(lead, 1).otherwise(0)), F.get(t, F.lit(1)), F.get(t, F.lit(0)))
        number = F.regexp_extract(word, r"^(\d+)(?:ST|ND|RD|TH)?$", 1)
        sound = F.when(number != "", F.concat(F.lit("#"), number)).otherwise(soundex(word))
        rural = F.get(t, F.lit(0)).isin("RR", "HC") & F.get(t, F.lit(1)).rlike(r"^\d+$")
        military = (F.size(t) >= 4) & (F.get(t, F.lit(0)) == "UNIT") & F.get(t, F.lit(1)).rlike(r"^\d+$")
        return (
            F.when(rural, F.concat_ws("|", F.concat_ws(" ", F.get(t, F.lit(0)), F.get(t, F.lit(1))), soundex(F.coalesce(F.get(t, F.lit(2)), F.get(t, F.lit(0)))), loc))
            .when(military, F.concat_ws("|", F.get(t, F.lit(1)), soundex(F.get(t, F.lit(2))), loc))
            .otherwise(F.concat_ws("|", house, sound, loc))
        )

    box = F.regexp_extract(line, r"^PO BOX\s+(\S+)", 1)
    out = F.when(box != "", F.concat(F.lit("POB "), box, F.lit("|"), loc)).otherwise(F.get(F.transform(F.array(tokens), key), F.lit(0)))
    return F.when(F.coalesce(line, F.lit("")) != "", F.nullif(F.regexp_replace(out, r"^\|+|\|+$", ""), F.lit("")))


def address_key(street1: Column, street2: Column, city: Column, state: Column, zip5: Column) -> Column:
    return F.concat_ws("|", street1, street2, city, state, zip5, F.lit("USA"))


def building_key(street1: Column, city: Column, state: Column, zip5: Column) -> Column:
    return F.concat_ws("|", street1, F.lit(""), city, state, zip5, F.lit("USA"))
