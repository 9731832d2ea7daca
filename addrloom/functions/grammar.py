"""Address lines outside the US: one set of expressions, steered by a family of countries.

A family says where the house number stands, whether English street words are abbreviated, and which spellings are its own. A line
is cut at its commas; units and boxes are taken out, the piece with the postal code gives the city, pieces behind it the state, and
of those before it the first with a number is the street, what stands before that a building, what stands behind it a locality."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .cleanup import bind, po_box_spelling, trim_ends
from .country import alias_table, extract_postal
from .layout import POSTAL_FIRST, TOP_DOWN
from .text import squeeze

# Countries of each family; those of no list belong to DEFAULT.
FAMILIES = {
    "us": "USA PRI VIR GUM ASM MNP FSM MHL PLW UMI",
    "uk": "GBR GGY JEY IMN GIB FLK SHN PCN IOT SGS MLT CYP",
    "ireland": "IRL",
    "canada": "CAN",
    "australia": "AUS CCK CXR NFK HMD ATA",
    "new_zealand": "NZL COK NIU TKL",
    "germanic": "DEU AUT CHE LIE NLD BEL LUX DNK SWE NOR FIN ISL FRO GRL ALA SJM ABW CUW SXM BES SUR",
    "romance": "FRA ESP ITA PRT MCO AND SMR VAT GLP MTQ GUF REU MYT SPM BLM MAF NCL PYF WLF ATF",
    "eastern_europe": "POL CZE SVK HUN ROU MDA BGR GRC SRB HRV SVN BIH MNE MKD ALB EST LVA LTU RUS UKR BLR",
    "latin_america": "MEX BRA ARG CHL COL PER ECU VEN URY PRY BOL CRI GTM DOM CUB HND NIC SLV HTI",
    "offshore": "BMU CYM VGB PAN TCA AIA MSR BHS BRB JAM TTO ATG BLZ DMA GRD GUY KNA LCA VCT",
    "southeast_asia": "IDN MYS PHL THA VNM KHM LAO MMR BRN TLS",
    "singapore": "SGP",
    "hong_kong": "HKG",
    "east_asia": "JPN CHN KOR TWN MAC MNG PRK",
    "south_asia": "IND PAK BGD LKA NPL BTN MDV AFG",
    "eurasia": "TUR GEO ARM AZE KAZ UZB KGZ TJK TKM",
}
DEFAULT = "mena_africa"
FAMILY_OF = {iso3: family for family, countries in FAMILIES.items() for iso3 in countries.split()}
NATIVE = ("germanic", "romance", "eastern_europe", "latin_america", "east_asia", "eurasia")
# Countries of other families, or parts of a family, whose house number follows the street.
NUMBER_LAST = "SAU EGY ARE MAR DZA TUN ISR JOR LBN OMN KWT QAT BHR IRQ IRN YEM SYR PSE SDN LBY IDN VNM PAN ESP ITA PRT SMR VAT AND".split()
NUMBER_FIRST = "BEL LUX RUS COL HTI".split()
# Countries whose addresses name a state.
WITH_STATE = "USA CAN AUS BRA MEX IND MYS IDN NGA ARG VEN COL PHL CHN JPN KOR TWN ITA ESP DEU RUS PAK MMR ZAF FSM MHL PLW".split()

# Unit words of several languages and the code they get.
UNIT_CODES = {
    "FLAT": "APT", "APT": "APT", "APARTMENT": "APT", "UNIT": "UNIT", "SUITE": "STE", "STE": "STE", "FLOOR": "FL", "FL": "FL", "LEVEL": "LEVEL", "ROOM": "RM", "RM": "RM", "SHOP": "SHOP", "OFFICE": "OFC", "BLOCK": "BLK", "BLK": "BLK",
    "WOHNUNG": "WOHNUNG", "WHG": "WHG", "ZIMMER": "ZIMMER", "ETAGE": "ETAGE", "APPARTEMENT": "APT", "APPT": "APT", "BUREAU": "BUREAU", "INT": "INT", "INTERNO": "INT", "INTERIOR": "INT", "PISO": "PISO", "PUERTA": "PUERTA", "DEPTO": "DEPTO", "DPTO": "DPTO",
    "OF": "OF", "OFICINA": "OF", "APTO": "APTO", "SALA": "SALA", "LOJA": "LOJA", "M": "M.", "LOK": "LOK.", "KV": "KV.", "KAT": "KAT", "DAIRE": "DAIRE", "PO BOX": "PO BOX", "POSTFACH": "POSTFACH", "POSTBUS": "POSTBUS", "BP": "BP", "APARTADO": "APARTADO",
}
_KINDS = "|".join(sorted(UNIT_CODES, key=len, reverse=True))
UNIT_PIECE = rf"^({_KINDS})\b\.?\s*#?\s*([\w/-]+)$"
UNIT_END = rf"[\s,]+({'|'.join(k for k in sorted(UNIT_CODES, key=len, reverse=True) if k not in ('OF', 'BP', 'POSTFACH', 'POSTBUS'))})\b\.?\s*#?\s*([0-9]+[A-Z]?(?:-[0-9A-Z]+)?|[A-Z])$"
UNIT_LEAD = r"^(FLAT|UNIT|APT|APARTMENT|SUITE|STE|SHOP|OFFICE)\s+([0-9A-Z]+)[\s,]+(.*\S)$"
NORDIC = r"[\s,]+(\d+)\.\s*(TV|TH|MF)\.?$"
# Codes of states that stand behind the city.
REGIONS = {"AUS": "NSW|VIC|QLD|WA|SA|TAS|ACT|NT", "CAN": "ON|QC|BC|AB|MB|SK|NS|NB|NL|PE|YT|NT|NU"}
_NUMBER = r"\d+[A-Z]?(?:[-/]\d*[A-Z]?)?"


def family(iso3: Column) -> Column:
    return F.coalesce(dims.lookup(FAMILY_OF, iso3), F.lit(DEFAULT))


def number_last(iso3: Column) -> Column:
    last = family(iso3).isin("germanic", "eastern_europe", "latin_america", "eurasia") | dims.within(NUMBER_LAST, iso3)
    return last & ~dims.within(NUMBER_FIRST, iso3)


def _about(iso3: Column) -> Column:
    """What the expressions ask of a country, to be bound once."""
    return F.struct(iso3.alias("iso3"), family(iso3).alias("family"), number_last(iso3).alias("last"))


def _spell(line: Column, c: Column) -> Column:
    """Street words spelled as the family does."""
    iso3 = c["iso3"]
    german = F.regexp_replace(F.regexp_replace(line, r"(?<=\p{L})STR\.?(?=[\s,]|$)|(?<!\p{L})STR\.(?=[\s,]|$)", "STRASSE"), r"(?<=[\p{L}\s])PL\.(?=[\s,]|$)", "PLATZ")
    dutch = F.regexp_replace(F.regexp_replace(line, r"STR\.(?=[\s,]|$)", "STRAAT"), r"LN\.(?=[\s,]|$)", "LAAN")
    latin = F.regexp_replace(F.regexp_replace(line, r"^(?:AVENIDA|AVDA|AV)\.?\s+", "AV "), r"^(?:BOULEVARD|BVD|BLVD)\.?\s+", "BLVD ")

    def english(words: Column) -> Column:
        last = dims.lookup(dims.SUFFIXES, F.regexp_replace(F.element_at(words, -1), r"\.$", ""))
        return F.when((F.size(words) >= 2) & last.isNotNull(), F.concat_ws(" ", F.array_join(F.slice(words, 1, F.size(words) - 1), " "), last)).otherwise(F.array_join(words, " "))

    return (
        F.when(iso3.isin("DEU", "AUT", "CHE", "LIE"), german).when(iso3.isin("NLD", "BEL", "SUR", "ABW", "CUW", "SXM", "BES"), dutch).when(c["family"].isin("romance", "latin_america"), latin)
        .when(~c["family"].isin(*NATIVE), bind(F.split(line, " "), english)).otherwise(line)
    )


def _unit(kind: Column, value: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(dims.lookup(UNIT_CODES, kind), kind), value)


def _split_unit(line: Column, c: Column) -> Column:
    """(street, unit) of one piece: a unit before the number, behind the street, or in the forms of some countries."""
    x = lambda s, u: F.struct(trim_ends(s).alias("street"), u.alias("unit"))
    part = lambda p, k: F.regexp_extract(line, p, k)
    slash, dash = r"^(\d+[A-Z]?)/(\d+.*)$", r"^(.*\s\d+)-([A-Z])$"
    return (
        F.when(line.rlike(UNIT_LEAD), x(part(UNIT_LEAD, 3), _unit(part(UNIT_LEAD, 1), part(UNIT_LEAD, 2))))
        .when(c["family"].isin("australia", "new_zealand") & line.rlike(slash), x(part(slash, 2), _unit(F.lit("UNIT"), part(slash, 1))))
        .when((c["family"] == "germanic") & line.rlike(NORDIC), x(F.regexp_replace(line, NORDIC, ""), F.concat_ws(" ", part(NORDIC, 1), F.lower(part(NORDIC, 2)))))
        .when((c["iso3"] == "NLD") & line.rlike(dash), x(part(dash, 1), _unit(F.lit("APT"), part(dash, 2))))
        .when(line.rlike(UNIT_END), x(F.regexp_replace(line, UNIT_END, ""), _unit(part(UNIT_END, 1), part(UNIT_END, 2))))
        .otherwise(x(line, F.lit("")))
    )


def _street(pieces: Column, second: Column, c: Column) -> Column:
    """(street1, street2, locality, house_number) of a street's pieces and a second line."""
    boxes = F.filter(pieces, lambda p: p.rlike(UNIT_PIECE))
    rest = F.filter(pieces, lambda p: ~p.rlike(UNIT_PIECE))
    alone = F.size(rest) == 0
    split = F.transform(F.when(alone, F.slice(boxes, 1, 1)).otherwise(rest), lambda p: F.when(alone, F.struct(p.alias("street"), F.lit("").alias("unit"))).otherwise(_split_unit(p, c)))

    def arrange(v: Column) -> Column:
        s, more = v["split"], v["more"]
        streets = F.transform(s, lambda x: x["street"])
        at = lambda test: F.nullif(F.array_position(F.transform(streets, test), F.lit(True)), F.lit(0))
        typed = lambda t: t.rlike(r"\d") | (~c["family"].isin(*NATIVE) & dims.lookup(dims.SUFFIXES, F.element_at(F.split(t, " "), -1)).isNotNull())
        k = F.coalesce(F.when(~c["last"], at(lambda t: t.rlike(r"^\d"))), at(typed), F.lit(1)).cast("int")
        street = bind(F.get(streets, k - 1), lambda t: _spell(t, c))
        building = F.array_join(F.slice(streets, 1, k - 1), " ")
        locality = F.array_join(F.slice(streets, k + 1, F.greatest(F.size(streets) - k, F.lit(0))), ", ")
        units = F.filter(F.concat(F.transform(s, lambda x: x["unit"]), F.transform(more, lambda p: _unit(F.regexp_extract(p, UNIT_PIECE, 1), F.regexp_extract(p, UNIT_PIECE, 2)))), lambda u: u != "")
        own = F.when(second.rlike(UNIT_PIECE), _unit(F.regexp_extract(second, UNIT_PIECE, 1), F.regexp_extract(second, UNIT_PIECE, 2))).otherwise(second)
        line2 = F.array_join(F.filter(F.concat(units, F.array(building, own)), lambda u: u != ""), " ")
        first, end = F.regexp_extract(street, rf"^({_NUMBER})(?:\s|$)", 1), F.regexp_extract(street, rf"(?:^|\s)({_NUMBER})$", 1)
        number = F.when(c["last"], F.coalesce(F.nullif(end, F.lit("")), first)).otherwise(F.coalesce(F.nullif(first, F.lit("")), end))
        return F.struct(F.coalesce(street, F.lit("")).alias("street1"), line2.alias("street2"), locality.alias("locality"), F.coalesce(number, F.lit("")).alias("house_number"))

    return bind(F.struct(split.alias("split"), F.when(alone, F.slice(boxes, 2, F.greatest(F.size(boxes) - 1, F.lit(0)))).otherwise(boxes).alias("more")), arrange)


def country_at_end(line: Column) -> Column:
    """The country that the last piece of a comma line names, or null. Two letters are left alone: they are states as often."""
    last = bind(F.upper(trim_ends(F.element_at(F.split(line, ","), -1))), lambda p: F.when((F.length(p) >= 4) | p.isin("UK", "UAE"), dims.lookup(alias_table(), p)))
    return F.when(line.contains(","), last)


def international(street1: Column, street2: Column, city: Column, state: Column, postal: Column, iso3: Column) -> Column:
    """(street1, street2, locality, city, state, postal_code, house_number) of one address outside the US, in capitals."""
    line = po_box_spelling(squeeze(F.upper(F.coalesce(street1, F.lit("")))))
    pieces = F.filter(F.transform(F.split(line, ","), trim_ends), lambda p: (p != "") & ~(F.coalesce(dims.lookup(alias_table(), p) == iso3, F.lit(False)) & (F.length(p) > 1)))
    second = squeeze(F.upper(F.coalesce(street2, F.lit(""))))
    given = {k: squeeze(F.regexp_replace(F.upper(F.coalesce(v, F.lit(""))), "[,.]", " ")) for k, v in (("city", city), ("state", state))}
    code = F.upper(F.trim(F.coalesce(postal, F.lit(""))))

    def located(v: Column) -> Column:
        """(streets, city, state, code) of a line that holds the whole address."""
        ps, codes = v["ps"], v["codes"]
        n = F.size(ps)
        places = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get(codes, i - 1) != "") & ((i > 1) | (n == 1)))
        at = F.get(places, F.size(places) - 1)  # the last piece with a code, and not the first of several
        found = F.coalesce(F.get(codes, at - 1), F.lit(""))
        beside = trim_ends(squeeze(F.regexp_replace(F.get(ps, at - 1), F.concat(F.lit(r"(?:\b[A-Z]{1,2}-)?\Q"), found, F.lit(r"\E")), F.lit(" "))))

        def place(w: Column) -> Column:
            at, beside = w["at"], w["beside"]
            city_at = F.when(at.isNull(), n).when(beside != "", at).otherwise(at - 1)
            town = F.when(at.isNotNull() & (beside != ""), beside).otherwise(F.coalesce(F.get(ps, city_at - 1), F.lit("")))
            behind = F.coalesce(F.array_join(F.slice(ps, at + 1, F.greatest(n - at, F.lit(0))), ", "), F.lit(""))
            return F.struct(F.slice(ps, 1, F.greatest(city_at - 1, F.lit(0))).alias("streets"), town.alias("city"), behind.alias("behind"), w["found"].alias("code"))

        def region(x: Column) -> Column:
            pattern = F.concat(F.lit(r"^(.*\S)\s+("), F.coalesce(dims.lookup(REGIONS, iso3), F.lit("(?!)")), F.lit(")$"))
            own = F.call_function("regexp_extract", x["city"], pattern, F.lit(2))
            town = F.when(own != "", F.call_function("regexp_extract", x["city"], pattern, F.lit(1))).otherwise(x["city"])
            st = F.coalesce(F.nullif(given["state"], F.lit("")), F.nullif(own, F.lit("")), x["behind"])
            return F.struct(x["streets"].alias("streets"), town.alias("city"), st.alias("state"), F.coalesce(F.nullif(code, F.lit("")), x["code"]).alias("code"))

        return bind(bind(F.struct(at.alias("at"), beside.alias("beside"), found.alias("found")), place), region)

    def whole(x: Column) -> Column:
        c, at = x["c"], x["x"]
        s = _street(at["streets"], second, c)
        return bind(s, lambda s: F.struct(s["street1"].alias("street1"), s["street2"].alias("street2"), s["locality"].alias("locality"), at["city"].alias("city"), at["state"].alias("state"), at["code"].alias("postal_code"), s["house_number"].alias("house_number")))

    single = (F.coalesce(city, F.lit("")) == "") & (F.size(F.split(line, ",")) > 1)
    one_line = lambda ps: bind(F.struct(ps.alias("ps"), F.transform(ps, lambda p: extract_postal(p, iso3)).alias("codes")), located)
    fields = lambda ps: F.struct(ps.alias("streets"), given["city"].alias("city"), given["state"].alias("state"), code.alias("code"))
    parted = bind(pieces, lambda ps: F.when(single & (F.size(ps) > 0), one_line(ps)).otherwise(fields(ps)))
    return bind(F.struct(_about(iso3).alias("c"), parted.alias("x")), whole)


@lru_cache(maxsize=1)
def _iso_countries() -> tuple[tuple[str, str, str], ...]:
    """(alpha-3, alpha-2, English name) of the ISO countries that the JVM knows."""
    jvm = SparkSession.active()._jvm
    locale, english = jvm.java.util.Locale, jvm.java.util.Locale.ENGLISH
    found = []
    for a2 in locale.getISOCountries():
        x = jvm.java.util.Locale("", a2)
        found.append((x.getISO3Country(), a2, x.getDisplayCountry(english).upper()))
    return tuple(sorted(found))


def country_families(spark: SparkSession) -> DataFrame:
    """The dimension of all ISO countries: codes, name, family, places of house number and postal code, and whether a state is named."""
    dim = spark.createDataFrame(list(_iso_countries()), "iso3 string, iso2 string, name string")
    number = F.when(F.col("iso3").isin(*TOP_DOWN, "HKG", "MAC"), "cjk_hierarchical").when(number_last(F.col("iso3")), "after_street").otherwise("before_street")
    postal = F.when(F.col("iso3").isin(*TOP_DOWN), "leading_top").when(F.col("iso3").isin(*POSTAL_FIRST), "before_city").otherwise("after_city")
    return dim.select("iso3", "iso2", "name", family(F.col("iso3")).alias("family"), number.alias("house_number_position"), postal.alias("postal_position"), F.col("iso3").isin(*WITH_STATE).alias("uses_state"))
