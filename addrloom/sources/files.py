"""Readers of address files and reference feeds, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import csv_guard, squeeze
from ..functions.us import unit_of

# readers


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Header row, all columns as text; surplus cells are dropped and short rows padded."""
    return spark.read.options(header=True, mode="PERMISSIVE", **options).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object a line; blank lines are skipped; a bad line fails the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """One array of objects, or a single object, a file."""
    return spark.read.options(multiLine=True, mode="FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One address a line, as street1."""
    return spark.read.text(path).select(F.col("value").alias("street1")).where(F.trim("street1") != "")


def from_records(spark: SparkSession, records: list) -> DataFrame:
    """Strings, mappings with the usual aliases, sequences of up to six fields, or anything with a text form."""
    names = ("street1", "street2", "city", "state", "postal_code", "country")
    alias = {"street": 0, "address": 0, "address1": 0, "suite": 1, "apt": 1, "unit": 1, "address2": 1, "province": 3, "zip": 4, "zipcode": 4, "postcode": 4} | {n: k for k, n in enumerate(names)}
    rows = []
    for r in records:
        row: list = [None] * 6
        if isinstance(r, dict):
            for k, v in r.items():
                if (at := alias.get(str(k).lower())) is not None and row[at] is None and v is not None:
                    row[at] = str(v)
        elif isinstance(r, (list, tuple)):
            row[: min(6, len(r))] = [None if v is None else str(v) for v in r[:6]]
        else:
            row[0] = str(r)
        rows.append(tuple(row))
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def from_arrow(spark: SparkSession, table) -> DataFrame:
    """An Arrow table or record batch; `DataFrame.toArrow` is the way back."""
    import pyarrow as pa

    return spark.createDataFrame(pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table)


def _number(c: str) -> Column:
    return F.expr(f"try_cast(trim(`{c}`) as double)")


def valid_place(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def point_keys(df: DataFrame) -> DataFrame:
    """Adds address_key and building_key from street1, street2, city, state, postal_code, country."""
    return df.withColumns({"address_key": F.concat_ws("|", "street1", "street2", "city", "state", "postal_code", "country"), "building_key": F.concat_ws("|", "street1", F.lit(""), "city", "state", "postal_code", "country")})


def open_addresses(raw: DataFrame, country: str = "USA") -> DataFrame:
    """Points of an OpenAddresses table in either case of headers: rows without a street or with a bad place are left out, places are rounded
    to 6 decimals."""
    have = {c.upper(): c for c in raw.columns}
    text = lambda c: F.upper(F.trim(F.coalesce(F.col(f"`{have[c]}`").cast("string"), F.lit("")))) if c in have else F.lit("")
    lat, lon = _number(have["LATITUDE"]), _number(have["LONGITUDE"])
    out = raw.select(
        squeeze(F.concat_ws(" ", text("NUMBER"), text("STREET"))).alias("street1"), text("STREET").alias("_s"), unit_or_text(text("UNIT")).alias("street2"), text("CITY").alias("city"), text("REGION").alias("state"), text("POSTCODE").alias("postal_code"),
        F.coalesce(F.nullif(text("COUNTRY"), F.lit("")), F.lit(country)).alias("country"), F.round(lat, 6).alias("latitude"), F.round(lon, 6).alias("longitude"), text("ID").alias("parcel_id"))
    return point_keys(out.where((F.col("_s") != "") & valid_place(F.col("latitude"), F.col("longitude"))).drop("_s"))


def unit_or_text(text: Column) -> Column:
    return F.coalesce(F.nullif(unit_of(text), F.lit("")), text)


def tiger_segments(raw: DataFrame) -> DataFrame:
    """Street segments: seven columns are needed; rows whose numbers or places don't parse are left out."""
    need = ("street_name", "from_number", "to_number", "start_lat", "start_lon", "end_lat", "end_lon")
    if missing := [c for c in need if c not in raw.columns]:
        raise ValueError(f"missing columns {missing}")
    optional = lambda c, default: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(default)) if c in raw.columns else F.lit(default)
    out = raw.select(
        F.upper(F.trim("street_name")).alias("street_name"), *[F.expr(f"try_cast(trim(`{c}`) as int)").alias(c) for c in need[1:3]], *[_number(c).alias(c) for c in need[3:]], F.upper(optional("parity", "BOTH")).alias("parity"),
        optional("postal_code", None).cast("string").alias("postal_code"), F.upper(optional("city", "")).alias("city"), F.upper(optional("state", "")).alias("state"), optional("country_iso3", "USA").alias("country_iso3"), optional("source", "TIGER").alias("source"))
    good = valid_place(F.col("start_lat"), F.col("start_lon")) & valid_place(F.col("end_lat"), F.col("end_lon"))
    return out.where(F.col("from_number").isNotNull() & F.col("to_number").isNotNull() & good)


def ring_centroid(ring: Column) -> Column:
    """(lon, lat) of a ring array<array<double>>: the shoelace centroid about the first vertex, longitudes unwrapped; the vertices' mean where the
    area is none. A ring that only passes the antimeridian is brought back into range."""
    x0, y0 = F.get(F.get(ring, F.lit(0)), F.lit(0)), F.get(F.get(ring, F.lit(0)), F.lit(1))
    unwrap = lambda x: x - 360.0 * F.round((x - x0) / 360.0)
    pts = F.transform(ring, lambda p: F.struct((unwrap(F.get(p, F.lit(0))) - x0).alias("x"), (F.get(p, F.lit(1)) - y0).alias("y")))
    pairs = F.zip_with(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, q: s + f(q))
    area = total(lambda q: q["c"])
    mean = lambda k: F.aggregate(pts, F.lit(0.0), lambda s, p: s + p[k]) / F.size(pts)
    flat = F.abs(area) < 1e-15
    x = F.when(flat, mean("x")).otherwise(total(lambda q: q["x"] * q["c"]) / (3.0 * F.when(flat, F.lit(1.0)).otherwise(area)))
    y = F.when(flat, mean("y")).otherwise(total(lambda q: q["y"] * q["c"]) / (3.0 * F.when(flat, F.lit(1.0)).otherwise(area)))
    lon = F.pmod(x0 + x + 180.0, F.lit(360.0)) - 180.0
    return F.struct(lon.alias("longitude"), (y0 + y).alias("latitude"))


def osm_features(raw: DataFrame) -> DataFrame:
    """Points of GeoJSON texts (column `value`, one file a row): Point, Polygon or MultiPolygon features with addr tags."""
    feature = "struct<geometry:string,properties:string>"
    f = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), f"array<{feature}>")).alias("f"))
    tag = lambda k: F.upper(F.trim(F.coalesce(F.get_json_object("f.properties", f"$['addr:{k}']"), F.lit(""))))
    kind, coords = F.get_json_object("f.geometry", "$.type"), F.get_json_object("f.geometry", "$.coordinates")
    point = F.from_json(coords, "array<double>")
    ring = F.when(kind == "Polygon", F.get(F.from_json(coords, "array<array<array<double>>>"), F.lit(0))).when(kind == "MultiPolygon", F.get(F.get(F.from_json(coords, "array<array<array<array<double>>>>"), F.lit(0)), F.lit(0)))
    out = f.select(squeeze(F.concat_ws(" ", tag("housenumber"), tag("street"))).alias("street1"), tag("street").alias("_s"), unit_or_text(tag("unit")).alias("street2"), tag("city").alias("city"), tag("state").alias("state"), tag("postcode").alias("postal_code"),
        F.coalesce(F.nullif(tag("country"), F.lit("")), F.lit("USA")).alias("country"), kind.alias("_k"), point.alias("_p"), ring.alias("_r"))
    out = out.withColumn("_c", F.when(F.col("_k") == "Point", F.struct(F.get("_p", F.lit(0)).alias("longitude"), F.get("_p", F.lit(1)).alias("latitude"))).otherwise(ring_centroid(F.col("_r"))))
    out = out.withColumns({"latitude": F.round("_c.latitude", 6), "longitude": F.round("_c.longitude", 6)}).where((F.col("_s") != "") & valid_place(F.col("latitude"), F.col("longitude")))
    return point_keys(out.drop("_s", "_k", "_p", "_r", "_c"))


GEONAMES = ("country", "postal", "place", "admin1", "admin1_code", "admin2", "admin2_code", "admin3", "admin3_code", "latitude", "longitude", "accuracy")


def geonames(spark: SparkSession, path: str, countries: list[str] | None = None) -> DataFrame:
    """A GeoNames postal dump (tab-separated): one row for each (country, postal, place, admin1_code, admin2_code)."""
    schema = ", ".join(f"{c} string" for c in GEONAMES)
    raw = spark.read.schema(schema).options(sep="\t", quote="\u0000").csv(path)
    out = raw.where(F.col("place").isNotNull() & F.col("postal").isNotNull())
    if countries:
        out = out.where(F.col("country").isin(*countries))
    return out.withColumns({"latitude": _number("latitude"), "longitude": _number("longitude")}).dropDuplicates(["country", "postal", "place", "admin1_code", "admin2_code"])


def postal_candidates(postal: Column, country: Column) -> Column:
    """A code's spellings from fine to coarse: as it is, compact, first word, before a hyphen, and the countries' shorter forms."""
    c = F.upper(F.trim(F.coalesce(postal, F.lit(""))))
    compact = F.regexp_replace(c, r"[\s-]", "")
    more = F.when(country == "CA", F.substring(compact, 1, 3)).when(country == "NL", F.substring(compact, 1, 4)).when((country == "GB") & (F.length(compact) > 4), F.regexp_replace(compact, r".{3}$", ""))
    return F.array_distinct(F.filter(F.array_compact(F.array(c, compact, F.regexp_extract(c, r"^(\S+)", 1), F.regexp_extract(c, r"^([^-]+)", 1), more)), lambda x: x != ""))


# writers


def check_paths(*paths: str | None) -> None:
    """Input, output and audit paths must differ."""
    given = [p.rstrip("/") for p in paths if p]
    if len(set(given)) < len(given):
        raise ValueError(f"the same path is given twice: {given}")


def write_csv(df: DataFrame, path: str, guarded: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """CSV by Spark's commit protocol, so a failed run leaves no half output. Text cells of `guarded` columns (or of all `std_` columns) get the
    formula guard; booleans are written True and False, nested values as JSON."""
    kinds = dict(df.dtypes)
    cells = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if kinds[c] == "boolean":
            col = F.initcap(col.cast("string"))
        elif kinds[c].startswith(("struct", "array", "map")):
            col = F.to_json(col)
        elif kinds[c] == "string" and (c in guarded or c.startswith("std_")):
            col = csv_guard(col)
        cells.append(col.alias(c))
    df.select(*cells).write.mode(mode).option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def json_array(df: DataFrame) -> str:
    """A small table as one JSON array; large ones go to `write_jsonl`."""
    import json

    return json.dumps([json.loads(x) for x in df.toJSON().toLocalIterator()], indent=2)


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """Ledger export as SQL text, one statement a row."""
    value = lambda c: F.when(F.col(c).isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")))
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *[value(c) for c in df.columns]), F.lit(");")).alias("statement"))
