"""Postal layouts, scripts and transliteration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Countries whose lines go from the largest part to the smallest, those that write the code before the place; others write it behind.
TOP_DOWN = ("JPN", "CHN", "KOR", "TWN")
POSTAL_FIRST = ("DEU", "FRA", "ITA", "ESP", "PRT", "NLD", "BEL", "LUX", "CHE", "AUT", "DNK", "NOR", "SWE", "FIN", "ISL", "POL", "CZE", "SVK", "HUN", "ROU", "BGR", "GRC", "HRV", "SRB", "TUR", "ISR", "MEX")


def postal_lines(street1: Column, street2: Column, city: Column, state: Column, postal: Column, iso3: Column, country_name: Column) -> Column:
    """The address as lines, largest part first in East Asia; empty parts leave no gaps."""
    part = lambda *c: F.trim(F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in c]))
    lines = (
        F.when(iso3.isin(*TOP_DOWN), F.array(country_name, part(postal), part(state, city), part(street1), part(street2)))
        .when(iso3.isin(*POSTAL_FIRST), F.array(part(street1), part(street2), part(postal, city), part(state), country_name))
        .otherwise(F.array(part(street1), part(street2), part(city, state, postal), country_name))
    )
    return F.array_join(F.filter(lines, lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


#: Scripts that point to one country, in the order in which they are asked.
SCRIPTS = (("KOR", r"\p{IsHangul}"), ("JPN", r"[\p{IsHiragana}\p{IsKatakana}]"), ("CHN", r"\p{IsHan}"), ("RUS", r"\p{IsCyrillic}"), ("GRC", r"\p{IsGreek}"), ("ISR", r"\p{IsHebrew}"), ("THA", r"\p{IsThai}"), ("EGY", r"\p{IsArabic}"))


def script_country(text: Column, least: float = 0.3) -> Column:
    """The country of the first script that holds a share of the letters, or null. Kana decide before Han, which Japanese shares."""
    letters = F.nullif(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(0))
    out = None
    for iso3, pattern in SCRIPTS:
        share = F.regexp_count(text, F.lit(pattern)) / letters
        hit = share >= (0.05 if iso3 == "JPN" else least)
        out = F.when(hit, iso3) if out is None else out.when(hit, iso3)
    return out


# Latin spellings of Cyrillic and Greek small letters.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "yi", "є": "ye", "ґ": "g",
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
    "ά": "a", "έ": "e", "ή": "i", "ί": "i", "ϊ": "i", "ΐ": "i", "ό": "o", "ύ": "y", "ϋ": "y", "ΰ": "y", "ώ": "o",
}


def transliterate(text: Column) -> Column:
    """Cyrillic and Greek letters in Latin, capitals as capitals; other characters stay. Rows without either are returned as they are."""
    from .dims import lookup

    def letter(c: Column) -> Column:
        low = F.lower(c)
        spelled = lookup(LATIN, low)
        return F.coalesce(F.when(c == low, spelled).otherwise(F.initcap(spelled)), c)

    return F.when(text.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), F.array_join(F.transform(F.split(text, ""), letter), "")).otherwise(text)
