"""SQL functions over single US addresses, as Arrow functions for SQL text. Tables should use `standardize`, whose expressions stay in
the JVM; a test holds both to the same keys."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.rules import parse_street
from ..functions.us import GARBAGE, PLACEHOLDERS

ROW = "street1 string, street2 string, city string, state string, postal_code string, country string, normalized_address_key string, building_key string, address_status string, deliverability string"
_LINE = re.compile(r"^\s*([^,]+?)\s*,\s*(?:((?:APT|SUITE|STE|UNIT|FL|FLOOR|BLDG|#)[^,]*?)\s*,\s*)?([A-Za-z .'-]+?)\s*,\s*([A-Za-z]{2}|[A-Za-z]+(?: [A-Za-z]+)?)\s+(\d{5}(?:-\d{4})?)\s*$", re.I)


def _postal(code: str) -> tuple[str, str]:
    clean = code.strip().upper()
    if re.fullmatch(r"\d{4}", clean):
        clean = f"0{clean}"
    m = re.fullmatch(r"(\d{5})-?|(\d{5})[- ]?(\d{4})", clean)
    if not m:
        return clean, ""
    return (m[1], m[1]) if m[1] else (f"{m[2]}-{m[3]}", m[2])


#: Buildings where an address needs a unit; more are a parameter of `register`.
HUBS = frozenset(("100 WALL ST||NEW YORK|NY|10005|USA",))


def address(street1: str | None, city: str | None, state: str | None, postal: str | None, hubs: frozenset = HUBS) -> tuple | None:
    """The fields of ROW, or None where all arguments are null. An address in one of the hubs needs a unit to be deliverable."""
    if street1 is None and city is None and state is None and postal is None:
        return None
    street1, city, state, postal = (x or "" for x in (street1, city, state, postal))
    second = ""
    if not city and not postal and (m := _LINE.match(street1)):
        street1, second, city, state, postal = (x or "" for x in m.groups())
    up = " ".join(street1.upper().split())
    if up in GARBAGE:
        line, unit, known = "", "", False
    elif up in PLACEHOLDERS:
        line, unit, known = "PRIVATE RESIDENCE", "", True
    else:
        line, unit, known = parse_street(street1)
    unit = " ".join(x for x in (parse_street(f"1 X ST {second}")[1] if second else "", unit) if x)
    shown, zip5 = _postal(postal)
    code = re.sub(r"[^A-Z0-9\s]", "", re.sub(r"^USA?-", "", state.strip().upper()).strip())
    code = dims.STATES.get(code, code)
    by_zip = dims.ZIP3.get(zip5[:3], "") if zip5 else ""
    if code not in dims.STATE_CODES:
        code = by_zip or code
    city = " ".join(re.sub(r"[^\w\s-]", "", city.upper()).split())
    key = "|".join((line, unit, city, code, zip5, "USA")) if known and line else ""
    building = "|".join((line, "", city, code, zip5, "USA")) if known and line else ""
    numbered = bool(re.match(r"\d*[1-9]", line)) or line.startswith(("PO BOX", "RR ", "HC ")) or city in ("APO", "FPO", "DPO")
    good = bool(key) and numbered and not (zip5 and by_zip != code)
    return line, unit, city, code, shown, "USA", key, building, "standardized" if key else "parse_failed", "UNDELIVERABLE" if not good else "REQUIRES_SECONDARY" if building in hubs and not unit else "DELIVERABLE"


def _udf(returns: str, pick: Callable, hubs: frozenset):
    def four(a, b, c, d):
        return pick([address(*x, hubs) for x in zip(*(v.astype(object).where(v.notna(), None) for v in (a, b, c, d)))])

    def text(a):
        return pick([None if x is None else address(x, "", "", "", hubs) for x in a.astype(object).where(a.notna(), None)])

    out = pd.DataFrame if "," in returns else pd.Series
    for f in (four, text):
        f.__annotations__ = {**dict.fromkeys(f.__code__.co_varnames[: f.__code__.co_argcount], pd.Series), "return": out}
    return F.pandas_udf(four, returns), F.pandas_udf(text, returns)


def register(spark: SparkSession, hubs: frozenset = HUBS) -> None:
    """standardize_address, standardize_address_key and standardize_deliverability of (street1, city, state, postal_code), and of one
    text under the names with `_text`. Null where all arguments are null; a key is empty where the street is not understood."""
    names = [x.split()[0] for x in ROW.split(", ")]
    kinds = {"standardize_address": (ROW, None), "standardize_address_key": ("string", 6), "standardize_deliverability": ("string", 9)}
    for name, (returns, k) in kinds.items():
        if k is None:
            pick = lambda rows: pd.DataFrame([x or (None,) * len(names) for x in rows], columns=names)
        else:
            pick = lambda rows, k=k: pd.Series([None if x is None else x[k] for x in rows], dtype=object)
        four, text = _udf(returns, pick, hubs)
        spark.udf.register(name, four)
        spark.udf.register(f"{name}_text", text)
