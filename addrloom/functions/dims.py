"""Small dimensions as map literals. Each is a parameter of the functions that use it; these are the defaults."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Postal codes of the states, territories and military regions, by name.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE",
    "DISTRICT OF COLUMBIA": "DC", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS",
    "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS",
    "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY",
    "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI",
    "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA",
    "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY", "PUERTO RICO": "PR", "GUAM": "GU", "VIRGIN ISLANDS": "VI", "AMERICAN SAMOA": "AS",
}
STATE_CODES = frozenset((*STATES.values(), "MP", "AE", "AP", "AA", "FM", "MH", "PW"))

# First and last three-digit ZIP prefix of a state.
ZIP3_RANGES = (
    (5, 5, "NY"), (6, 7, "PR"), (8, 8, "VI"), (9, 9, "PR"), (10, 27, "MA"), (28, 29, "RI"), (30, 38, "NH"), (39, 49, "ME"), (50, 59, "VT"), (60, 69, "CT"),
    (70, 89, "NJ"), (90, 99, "AE"), (100, 149, "NY"), (150, 196, "PA"), (197, 199, "DE"), (200, 205, "DC"), (206, 219, "MD"), (220, 246, "VA"),
    (247, 268, "WV"), (270, 289, "NC"), (290, 299, "SC"), (300, 319, "GA"), (320, 349, "FL"), (350, 369, "AL"), (370, 385, "TN"), (386, 397, "MS"),
    (400, 427, "KY"), (430, 459, "OH"), (460, 479, "IN"), (480, 499, "MI"), (500, 528, "IA"), (530, 549, "WI"), (550, 567, "MN"), (570, 577, "SD"),
    (580, 588, "ND"), (590, 599, "MT"), (600, 629, "IL"), (630, 658, "MO"), (660, 679, "KS"), (680, 693, "NE"), (700, 714, "LA"), (716, 729, "AR"),
    (730, 749, "OK"), (750, 799, "TX"), (800, 816, "CO"), (820, 831, "WY"), (832, 838, "ID"), (840, 847, "UT"), (850, 865, "AZ"), (870, 884, "NM"),
    (889, 898, "NV"), (900, 961, "CA"), (967, 968, "HI"), (969, 969, "GU"), (970, 979, "OR"), (980, 994, "WA"), (995, 999, "AK"),
)

# Directional words and their codes.
DIRECTIONS = {
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
    "N": "N", "S": "S", "E": "E", "W": "W", "NE": "NE", "NW": "NW", "SE": "SE", "SW": "SW",
}

# Street suffixes of USPS Publication 28, by word; the codes stand for themselves as well.
_SUFFIX_WORDS = {
    "ALLEY": "ALY", "ANNEX": "ANX", "ARCADE": "ARC", "AVENUE": "AVE", "AV": "AVE", "BEACH": "BCH", "BEND": "BND", "BLUFF": "BLF", "BOULEVARD": "BLVD", "BRANCH": "BR",
    "BRIDGE": "BRG", "BROOK": "BRK", "BYPASS": "BYP", "CAMP": "CP", "CANYON": "CYN", "CAUSEWAY": "CSWY", "CENTER": "CTR", "CIRCLE": "CIR", "CLIFF": "CLF", "CLUB": "CLB",
    "COMMON": "CMN", "CORNER": "COR", "COURSE": "CRSE", "COURT": "CT", "COVE": "CV", "CREEK": "CRK", "CRESCENT": "CRES", "CROSSING": "XING", "DALE": "DL", "DAM": "DM",
    "DRIVE": "DR", "ESTATE": "EST", "EXPRESSWAY": "EXPY", "EXTENSION": "EXT", "FALLS": "FLS", "FERRY": "FRY", "FIELD": "FLD", "FLAT": "FLT", "FORD": "FRD", "FOREST": "FRST",
    "FREEWAY": "FWY", "GARDEN": "GDN", "GARDENS": "GDNS", "GATEWAY": "GTWY", "GLEN": "GLN", "GREEN": "GRN", "GROVE": "GRV", "HARBOR": "HBR", "HAVEN": "HVN", "HEIGHTS": "HTS",
    "HIGHWAY": "HWY", "HILL": "HL", "HILLS": "HLS", "HOLLOW": "HOLW", "ISLAND": "IS", "JUNCTION": "JCT", "KNOLL": "KNL", "LAKE": "LK", "LANDING": "LNDG", "LANE": "LN",
    "LODGE": "LDG", "MANOR": "MNR", "MEADOW": "MDW", "MEADOWS": "MDWS", "MILL": "ML", "MOUNT": "MT", "MOUNTAIN": "MTN", "ORCHARD": "ORCH", "PARKWAY": "PKWY", "PLACE": "PL",
    "PLAIN": "PLN", "PLAZA": "PLZ", "POINT": "PT", "PORT": "PRT", "PRAIRIE": "PR", "RANCH": "RNCH", "RIDGE": "RDG", "RIVER": "RIV", "ROAD": "RD", "SHORE": "SHR",
    "SPRING": "SPG", "SPRINGS": "SPGS", "SQUARE": "SQ", "STATION": "STA", "STREET": "ST", "STR": "ST", "SUMMIT": "SMT", "TERRACE": "TER", "TRACE": "TRCE", "TRAIL": "TRL",
    "TUNNEL": "TUNL", "TURNPIKE": "TPKE", "VALLEY": "VLY", "VIEW": "VW", "VILLAGE": "VLG", "VISTA": "VIS", "WALK": "WALK", "WAY": "WAY", "PARK": "PARK", "LOOP": "LOOP", "PIKE": "PIKE", "ROW": "ROW", "RUN": "RUN", "PATH": "PATH", "PASS": "PASS",
}
SUFFIXES = _SUFFIX_WORDS | {code: code for code in _SUFFIX_WORDS.values()}

# Secondary units and their codes.
UNITS = {
    "APARTMENT": "APT", "APT": "APT", "SUITE": "STE", "STE": "STE", "UNIT": "UNIT", "FLOOR": "FL", "FL": "FL", "ROOM": "RM", "RM": "RM", "BUILDING": "BLDG", "BLDG": "BLDG",
    "DEPARTMENT": "DEPT", "DEPT": "DEPT", "LOT": "LOT", "SPACE": "SPC", "SPC": "SPC", "TRAILER": "TRLR", "TRLR": "TRLR", "PMB": "PMB",
}

_ONES = ("FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH", "EIGHTH", "NINTH", "TENTH", "ELEVENTH", "TWELFTH", "THIRTEENTH", "FOURTEENTH", "FIFTEENTH", "SIXTEENTH", "SEVENTEENTH", "EIGHTEENTH", "NINETEENTH", "TWENTIETH")


def ordinal(n: int) -> str:
    return f"{n}{'TH' if 11 <= n % 100 <= 13 else {1: 'ST', 2: 'ND', 3: 'RD'}.get(n % 10, 'TH')}"


ORDINALS = {word: ordinal(k) for k, word in enumerate(_ONES, 1)}
ZIP3 = {f"{z:03d}": state for low, high, state in ZIP3_RANGES for z in range(low, high + 1)}


def literal(table: dict[str, str]) -> Column:
    """A map literal: one small expression that the optimizer folds to a constant, where a map of literals would be analysed entry by entry."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def lookup(table: dict[str, str], key: Column) -> Column:
    """The entry of a key, or null."""
    return F.try_element_at(literal(table), key)


def within(values: Iterable[str], key: Column) -> Column:
    """Whether a key is one of many values: a folded array."""
    return F.array_contains(F.split(F.lit("|".join(sorted(values))), r"\|"), key)


#: The state of each three-digit prefix at its number, empty where there is none.
ZIP3_SLOTS = "|".join(ZIP3.get(f"{z:03d}", "") for z in range(1000))
