"""Rule parser for street lines that expressions leave open: routes, boxes, fractions, hyphenated numbers, intersections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .dims import DIRECTIONS, ORDINALS, SUFFIXES, UNITS, ordinal

_RURAL = re.compile(r"^(?:RURAL ROUTE|RR|R\.?R\.?)\s*#?(\d+)\s*,?\s*BOX\s*#?(\w+)$")
_CONTRACT = re.compile(r"^(?:HIGHWAY CONTRACT|HC)\s*#?(\d+)\s*,?\s*BOX\s*#?(\w+)$")
_MILITARY = re.compile(r"^(UNIT|PSC|CMR)\s+(\d+)\s*,?\s*BOX\s+(\w+)$")
_BOX = re.compile(r"^(?:P\.?\s?O\.?|POST OFFICE)\s*BOX\s*#?\s*([\w-]+)$")
_CROSS = re.compile(r"^(.+?)\s+(?:AND|&|@|AT)\s+(.+)$")
_UNIT = re.compile(rf"^(.*?)[\s,]+(?:({'|'.join(sorted(UNITS, key=len, reverse=True))})\.?\s*#?\s*|#\s*)([A-Z0-9][A-Z0-9-]*)$")
_ROUTES = {"COUNTY ROAD": "COUNTY ROAD", "CR": "COUNTY ROAD", "STATE ROUTE": "STATE ROUTE", "SR": "STATE ROUTE", "US HIGHWAY": "US HIGHWAY", "US HWY": "US HIGHWAY", "HIGHWAY": "HIGHWAY", "HWY": "HIGHWAY", "ROUTE": "ROUTE", "RTE": "ROUTE", "INTERSTATE": "INTERSTATE", "FM": "FM"}
_TENS = {"TWENTY": 20, "THIRTY": 30, "FORTY": 40, "FIFTY": 50, "SIXTY": 60, "SEVENTY": 70, "EIGHTY": 80, "NINETY": 90}


def _name(tokens: list[str]) -> list[str]:
    out, k = [], 0
    while k < len(tokens):
        t = tokens[k]
        nxt = tokens[k + 1] if k + 1 < len(tokens) else ""
        if t in _TENS and nxt in ORDINALS and len(ORDINALS[nxt]) == 3:
            out.append(ordinal(_TENS[t] + int(ORDINALS[nxt][0])))
            k += 1
        elif t in ORDINALS:
            out.append(ORDINALS[t])
        elif m := re.fullmatch(r"(\d{1,3})(?:ST|ND|RD|TH)?", t):
            out.append(ordinal(int(m[1])) if int(m[1]) else t)
        else:
            out.append(t)
        k += 1
    return out


def _street(tokens: list[str]) -> list[str]:
    """A street name read from the right: direction, suffix, name, direction."""
    post, suffix, pre = [], [], []
    if len(tokens) > 2 and tokens[-1] in DIRECTIONS:
        post, tokens = [DIRECTIONS[tokens[-1]]], tokens[:-1]
    for size in (2, 1):
        for start in (0, 1):
            head = " ".join(tokens[start : start + size])
            if head in _ROUTES and len(tokens) > start + size:
                lead = [DIRECTIONS[t] for t in tokens[:start] if t in DIRECTIONS]
                if len(lead) == start:
                    return [*lead, _ROUTES[head], *tokens[start + size :], *post]
    if len(tokens) > 1 and tokens[-1] in SUFFIXES:
        suffix, tokens = [SUFFIXES[tokens[-1]]], tokens[:-1]
    if len(tokens) > 1 and tokens[0] in DIRECTIONS and not (len(tokens) == 2 and tokens[1] in DIRECTIONS):
        pre, tokens = [DIRECTIONS[tokens[0]]], tokens[1:]
    return [*pre, *_name(tokens), *suffix, *post]


def parse_street(line: str | None) -> tuple[str, str, bool]:
    """(street1, unit, whether it was understood)."""
    text = re.sub(r"\s+", " ", (line or "").upper()).strip(" ,.-")
    for pattern, form in ((_BOX, "PO BOX {}"), (_RURAL, "RR {} BOX {}"), (_CONTRACT, "HC {} BOX {}"), (_MILITARY, "{} {} BOX {}")):
        if m := pattern.match(text):
            return form.format(*m.groups()), "", True
    units = []
    while m := _UNIT.match(text):
        units.insert(0, f"{UNITS.get(m[2] or '', 'STE')} {m[3]}")
        text = m[1].strip(" ,.-")
    if (m := _CROSS.match(text)) and not text[:1].isdigit():
        return " & ".join(" ".join(_street(x.split())) for x in m.groups()), " ".join(units), True
    tokens = [t for t in (t.strip(",.;:") for t in text.split()) if t]
    if len(tokens) < 2 or not tokens[0][0].isdigit():
        return " ".join(_street(tokens)) if tokens else "", " ".join(units), False
    house, rest = [tokens[0]], tokens[1:]
    if rest and re.fullmatch(r"\d/\d", rest[0]) and len(rest) > 1:
        house, rest = [*house, rest[0]], rest[1:]
    return " ".join([*house, *_street(rest)]), " ".join(units), True


@F.pandas_udf(StructType([StructField("street1", StringType()), StructField("unit", StringType()), StructField("understood", BooleanType())]))
def rule_street(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([parse_street(x) for x in batch], columns=["street1", "unit", "understood"])
