"""Cleaning of street lines ahead of parsing, as expressions: care-of clauses, box spellings, repeats, tails that repeat other fields,
corner addresses, units in words, state corrections and swapped digits of house numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims
from .text import squeeze
from .us import PLACEHOLDERS, PO_BOX, UNIT, zip3_state

MOST_CHARS = 600
ENDS = r"^[ ,.-]+|[ ,.-]+$"

# Words that end a street's name.
STREET_WORDS = "STREET ST AVENUE AVE BOULEVARD BLVD ROAD RD DRIVE DR LANE LN COURT CT PLACE PL CIRCLE CIR PARKWAY PKWY HIGHWAY HWY TERRACE TER TRAIL TRL PLAZA SQUARE SQ WAY LOOP ALLEY ALY TURNPIKE TPKE BROADWAY".split()
_TYPES = "|".join(STREET_WORDS)
_MARK = rf"(?:C\s*/\s*O\b|C\s*/\s*-(?=\s)|IN\s+CARE\s+OF\b|(?:ATTN|ATTENTION)\b(?!\s+(?:{_TYPES})\b))[:\s-]*"
CARE_BRACKETS = rf"(?i)[(\[]\s*{_MARK}([^)\]]*)[)\]]"
CARE_CLAUSE = rf"(?i)^(.*?)(?:^|[\s,]){_MARK}(.*)$"
STREETS = (rf"(?i)(?:^|[\s,])(\d+[A-Z]?\s+(?:[\w.'-]+\s+){{0,4}}?(?:{_TYPES})\b.*|(?:P\.?\s*O\.?\s*BOX|POST\s+OFFICE\s+BOX|RR|HC|PSC|CMR)\s.*)$", r"(?:^|[\s,])(\d+\s+[A-Za-z].*)$")


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def trim_ends(text: Column) -> Column:
    return F.regexp_replace(text, ENDS, "")


def po_box_spelling(text: Column) -> Column:
    """`P.O. Box #5`, `PO Box5`, `P.O.B. 5` and `Post Office Box 5` as `PO BOX 5`."""
    return F.regexp_replace(text, r"(?i)\b(?:P\.?\s*O\.?\s*B(?:OX|\.)|POB|POST\s+OFFICE\s+BOX)\s*#?\s*(?=\w)", "PO BOX ")


def care_of(text: Column) -> Column:
    """(address, care_of): the line without its care-of or attention clause, and who the clause names.

    Clauses in brackets go first. Behind a bare mark the address goes on at the first house number with a street word, a box, or
    else any number with a word; without one the line ends before the mark, or, if it begins with it, at the first comma."""

    def clause(t: Column) -> Column:
        before, after = trim_ends(F.regexp_extract(t, CARE_CLAUSE, 1)), F.trim(F.regexp_extract(t, CARE_CLAUSE, 2))
        found = bind(after, lambda a: F.coalesce(*[F.nullif(trim_ends(F.regexp_extract(a, p, 1)), F.lit("")) for p in STREETS], F.lit("")))

        def split(x: Column) -> Column:
            b, a, s = x["b"], x["a"], x["s"]
            tail = trim_ends(F.regexp_extract(a, r"^[^,]*,(.*\d.*)$", 1))
            kept = F.when(s != "", s).when(b != "", "").otherwise(tail)
            who = trim_ends(F.when(kept != "", F.substr(a, F.lit(1), F.call_function("instr", a, kept) - 1)).otherwise(a))
            return F.struct(F.concat_ws(", ", F.nullif(b, F.lit("")), F.nullif(kept, F.lit(""))).alias("address"), who.alias("care_of"))

        return F.when(t.rlike(CARE_CLAUSE), bind(F.struct(before.alias("b"), after.alias("a"), found.alias("s")), split)).otherwise(F.struct(t.alias("address"), F.lit("").alias("care_of")))

    def both(t: Column) -> Column:
        inner = trim_ends(F.regexp_extract(t, CARE_BRACKETS, 1))
        outer = bind(trim_ends(squeeze(F.regexp_replace(t, CARE_BRACKETS, " "))), clause)
        return bind(outer, lambda o: F.struct(o["address"].alias("address"), F.concat_ws("; ", F.nullif(inner, F.lit("")), F.nullif(o["care_of"], F.lit(""))).alias("care_of")))

    return bind(F.coalesce(text, F.lit("")), both)


def collapse_repeats(text: Column) -> Column:
    """`A, A` as `A`; runs of two or more words that follow themselves once; single words that follow themselves twice or more. Case is
    ignored. Lines of over MOST_CHARS characters stay as they are."""
    t = squeeze(text)
    for pattern in (r"(?i)^(.+?)(?:\s*[,;]\s*\1)+$", r"(?i)(?<!\S)(\S+(?:\s+\S+)+?)(?:[\s,]+\1)+(?!\S)", r"(?i)(?<!\S)(\S+)(?:\s+\1){2,}(?!\S)"):
        t = F.regexp_replace(t, pattern, "$1")
    return F.when(F.length(text) <= MOST_CHARS, t).otherwise(text)


_CODE_NAMES = {code: name for name, code in dims.STATES.items()}
_HAS_NAME = r"(?i)(?:^|\s)(?!(?:ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)(?:\s|$))\p{L}{2,}"


def redundant_tail(street: Column, city: Column, state: Column, postal: Column, passes: int = 2) -> Column:
    """The line without a country, postal code, state and city at its end that the other fields repeat; what is left must hold a name."""
    quoted = lambda x: F.concat(F.lit(r"\Q"), F.regexp_replace(F.trim(x), r"\\E", ""), F.lit(r"\E"))
    clean_state = F.upper(F.trim(F.coalesce(state, F.lit(""))))
    other = F.coalesce(dims.lookup(dims.STATES, clean_state), dims.lookup(_CODE_NAMES, clean_state), clean_state)
    patterns = [
        F.lit(r"(?i)[\s,]+(?:USA|U\.S\.A\.|UNITED STATES(?: OF AMERICA)?)$"),
        F.when(F.trim(postal) != "", F.concat(F.lit(r"(?i)[\s,]+(?:"), quoted(postal), F.lit("|"), quoted(F.substring(F.trim(postal), 1, 5)), F.lit(r")$"))),
        F.when(clean_state != "", F.concat(F.lit(r"(?i)[\s,]+(?:"), quoted(clean_state), F.lit("|"), quoted(other), F.lit(r")$"))),
        F.when(F.trim(city) != "", F.concat(F.lit(r"(?i)[\s,]+"), quoted(city), F.lit(r"$"))),
    ]

    def step(t: Column, k: int) -> Column:
        if k == passes * len(patterns):
            return t
        cut = F.regexp_replace(t, F.coalesce(patterns[k % len(patterns)], F.lit(r"(?!)")), F.lit(""))
        return bind(trim_ends(cut), lambda c: bind(F.when(c.rlike(_HAS_NAME), c).otherwise(t), lambda x: step(x, k + 1)))

    whole = bind(trim_ends(F.coalesce(street, F.lit(""))), lambda t: step(t, 0))
    return F.when(F.upper(F.trim(street)) == F.upper(F.trim(city)), "").otherwise(whole)


def correct_state(state: Column, postal: Column, country: Column) -> Column:
    """(state, original): a known US state that contradicts a valid ZIP becomes the ZIP's, and original says what it was; else null."""
    raw = F.upper(F.regexp_replace(F.trim(F.coalesce(state, F.lit(""))), r"\.", ""))
    code = F.coalesce(dims.lookup(dims.STATES, raw), raw)
    zip5 = F.regexp_extract(F.coalesce(postal, F.lit("")), r"^\s*(\d{5})(?:[-\s]?\d{4})?\s*$", 1)
    us = F.upper(F.trim(F.coalesce(country, F.lit("")))).isin("", "US", "USA", "UNITED STATES", "UNITED STATES OF AMERICA")
    by_zip = zip3_state(zip5)
    wrong = F.coalesce(us & dims.within(dims.STATE_CODES, code) & (by_zip != code), F.lit(False))
    return F.struct(F.when(wrong, by_zip).otherwise(state).alias("state"), F.when(wrong, state).alias("original"))


NUMBER_WORDS = "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN FOURTEEN FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN TWENTY".split()


def unit_digits(text: Column) -> Column:
    """Numbers in words behind a unit word, in digits: `Suite Four` as `Suite 4`."""
    for n, word in enumerate(NUMBER_WORDS, 1):
        text = F.regexp_replace(text, rf"(?i)\b(SUITE|STE|FLOOR|FL|UNIT|APT|APARTMENT|ROOM|RM|BUILDING|BLDG)\.?\s+{word}\b", f"$1 {n}")
    return text


_ROUTE_WORDS = {"ROUTE": "RT", "ROUTES": "RT", "RTE": "RT", "RTES": "RT", "HIGHWAY": "HWY", "HIGHWAYS": "HWY"}
# Words of premises that stand before AT without a crossing.
_PREMISES = "VILLAGE SHOPS COMMONS CENTER ESTATES LANDING GALLERIA PROMENADE MARKETPLACE RESIDENCES TOWERS".split()
CROSSING = r"^(.+?)\s+(AND|&|@|/|AT)\s+(.+)$"


def intersection(text: Column) -> Column:
    """`5TH AVE & 42ND ST` of a corner address, or null. A plural street word at the end counts for both streets; AT and @ need a street
    word on both sides, other joints on one."""

    def branch(words: Column) -> Column:
        # A suffix that comes first is the street's name.
        known = lambda w, k: F.coalesce(dims.lookup(dims.ORDINALS, w), dims.lookup(_ROUTE_WORDS, w), F.when(k > 0, dims.lookup(dims.SUFFIXES, w)), dims.lookup(dims.DIRECTIONS, w), w)
        return F.array_join(F.transform(words, known), " ")

    def is_type(w: Column) -> Column:
        return dims.lookup(dims.SUFFIXES, w).isNotNull() | dims.lookup(_ROUTE_WORDS, w).isNotNull()

    def words(t: Column, k: int) -> Column:
        return F.transform(F.split(F.regexp_extract(t, CROSSING, k), " "), lambda w: F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))

    def join(x: Column) -> Column:
        a, b = x["a"], x["b"]
        last = F.element_at(b, -1)
        shared = F.when(last.endswith("S") & dims.lookup(dims.SUFFIXES, last).isNull(), dims.lookup(dims.SUFFIXES, F.regexp_replace(last, "S$", "")))
        first = F.when(is_type(F.element_at(a, -1)), a).otherwise(F.array_append(a, shared))
        second = F.array_append(F.slice(b, 1, F.size(b) - 1), shared)
        at = x["joint"].isin("AT", "@")
        seen_a, seen_b = F.exists(a, is_type), F.exists(b, is_type)
        unit = F.get(a, F.lit(0)).isin("SUITE", "STE", "APT", "UNIT", "FLOOR", "FL") | F.get(b, F.lit(0)).isin("SUITE", "STE", "APT", "UNIT", "FLOOR", "FL")
        premises = at & F.arrays_overlap(a, F.array(*[F.lit(p) for p in _PREMISES]))
        plain = F.when(F.when(at, seen_a & seen_b).otherwise(seen_a | seen_b), F.concat_ws(" & ", branch(a), branch(b)))
        return F.when(unit | premises, F.lit(None)).when(shared.isNotNull(), F.concat_ws(" & ", branch(first), branch(second))).otherwise(plain)

    pair = r"^(?:ROUTES|RTES|RTS)\s+(\w+)\s+(?:AND|&)\s+(\w+)$"

    def corner(t: Column) -> Column:
        crossed = bind(F.struct(words(t, 1).alias("a"), F.regexp_extract(t, CROSSING, 2).alias("joint"), words(t, 3).alias("b")), join)
        return F.when(t.rlike(pair), F.regexp_replace(t, pair, r"RT $1 & RT $2")).when(t.rlike(CROSSING) & (F.length(t) >= 5), crossed)

    return bind(F.regexp_replace(squeeze(F.upper(F.coalesce(text, F.lit("")))), r"^(?:(?:THE\s+)?CORNER\s+OF|INTERSECTION\s+OF)\s+", ""), corner)


def rooftop_line(street: Column, passes: int = 4) -> Column:
    """The line without its units, for a building's place; null for boxes, private homes and empty lines. What looks like a unit's number
    but is a street word or direction is none."""

    def step(t: Column, k: int) -> Column:
        if k == passes:
            return F.nullif(t, F.lit(""))
        value = F.regexp_extract(t, UNIT, 2)
        is_unit = (value != "") & dims.lookup(dims.SUFFIXES, value).isNull() & dims.lookup(dims.DIRECTIONS, value).isNull()
        return bind(F.when(is_unit, trim_ends(F.regexp_replace(t, UNIT, ""))).otherwise(t), lambda x: step(x, k + 1))

    up = squeeze(F.upper(F.coalesce(street, F.lit(""))))
    return F.when(up.rlike(PO_BOX) | up.isin(*PLACEHOLDERS), F.lit(None).cast("string")).otherwise(bind(up, lambda t: step(t, 0)))


def heal_house_number(number: Column, ranges: Column) -> Column:
    """The number where it lies in one of the ranges (array of low, high); else the one swap of neighbouring digits that does, with the
    letters behind it; null without exactly one."""
    digits, rest = F.regexp_replace(number, r"\D", ""), F.regexp_extract(F.trim(number), r"^\d+(.*)$", 1)
    inside = lambda d: F.exists(ranges, lambda r: d.try_cast("long").between(r["low"], r["high"]))

    def heal(d: Column) -> Column:
        part = lambda i, n: F.substr(d, i, n)
        swap = lambda i: F.concat(part(F.lit(1), i - 1), part(i + 1, F.lit(1)), part(i, F.lit(1)), F.substr(d, i + 2))
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(d) - 1, F.lit(1))), lambda i: part(i, F.lit(1)) != part(i + 1, F.lit(1)))
        good = F.filter(F.transform(places, swap), inside)
        return F.when(F.length(d) < 2, F.lit(None)).when(inside(d), number).otherwise(bind(good, lambda g: F.when(F.size(g) == 1, F.concat(F.get(g, F.lit(0)), rest))))

    return bind(digits, heal)
