"""Text primitives as Column functions; Arrow UDFs only where Spark has no built-in."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

ZERO_WIDTH = "​‌‍⁠﻿"


def coerce_text(value: Column) -> Column:
    """Null, NaN and infinities become empty, integral decimals lose `.0`, zero-width characters go."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.when(F.lower(text).isin("nan", "inf", "-inf", "infinity", "-infinity"), "").otherwise(text)
    return F.trim(F.translate(F.regexp_replace(text, r"^(-?\d+)\.0$", "$1"), ZERO_WIDTH, ""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def soundex(text: Column) -> Column:
    """American Soundex of the letters A-Z of a word; empty without any."""
    return F.soundex(F.regexp_replace(F.upper(text), "[^A-Z]", ""))


def number_to_ordinal(n: Column) -> Column:
    """1 to 1ST, 11 to 11TH."""
    tail = F.when((n % 100).between(11, 13), "TH").when(n % 10 == 1, "ST").when(n % 10 == 2, "ND").when(n % 10 == 3, "RD").otherwise("TH")
    return F.concat(n.cast("string"), tail)


def words(text: Column) -> Column:
    """Upper-case tokens of word characters, `#`, `/` and `-`."""
    return F.regexp_extract_all(F.upper(text), F.lit(r"((?U)[\w#/-]+)"), 1)


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions, over a table that remembers each character's last row."""
    if a == b:
        return 0
    far, last = len(a) + len(b), {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            row, column = last.get(y, 0), match
            if x == y:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[row][column] + (i - row - 1) + 1 + (j - column - 1))
        last[x] = i
    return d[-1][-1]


@F.pandas_udf(IntegerType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict = {}
    out = []
    for pair in zip(a, b):
        if pair not in seen:
            seen[pair] = None if pair[0] is None or pair[1] is None else distance(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="Int32")


def within_one_edit(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance of one at most, without Python: a bounded built-in distance, or equal lengths whose two
    differing places are neighbours with their characters swapped."""
    plain = F.coalesce(F.levenshtein(a, b, 1) >= 0, F.lit(False))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    i = F.get(places, F.lit(0))
    swapped = (F.length(a) == F.length(b)) & (F.size(places) == 2) & (F.get(places, F.lit(1)) == i + 1)
    swapped = swapped & (F.substr(a, i, F.lit(2)) == F.reverse(F.substr(b, i, F.lit(2))))
    return plain | F.coalesce(swapped, F.lit(False))


#: Ligatures and letters that compatibility decomposition leaves, with their ASCII form.
LIGATURES = {"ß": "SS", "ẞ": "SS", "æ": "AE", "Æ": "AE", "œ": "OE", "Œ": "OE", "ø": "O", "Ø": "O", "ł": "L", "Ł": "L", "đ": "D", "Đ": "D", "ð": "D", "Ð": "D", "þ": "TH", "Þ": "TH", "ı": "I"}


def fold(text: str) -> str:
    """An upper-case ASCII key: marks dropped, ligatures spelled out, other letters and digits as `~` and their code."""
    spelled = "".join(LIGATURES.get(c, c) for c in text)
    out = []
    for c in unicodedata.normalize("NFKD", spelled):
        if c.isascii():
            out.append(c)
        elif unicodedata.category(c) != "Mn" and c.isalnum():
            out.append(f"~{ord(c):06X}")
    return " ".join("".join(out).upper().split())


@F.pandas_udf(StringType())
def _fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(fold, na_action="ignore")


def ascii_key(text: Column) -> Column:
    """`fold` for rows with other characters; ASCII rows stay in the JVM's result."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), squeeze(F.upper(text))).otherwise(_fold(text))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    """Great-circle distance in the unit of the radius: 6,371,000 m for search and radius joins, 6371.0088 km for reference checks."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2.0 * radius * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))


def csv_guard(cell: Column) -> Column:
    """A quote before cells that a spreadsheet would run as a formula."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)
