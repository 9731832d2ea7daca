"""Look-ups and joins by key, range, edit distance and place.

Reference tables are large in general: joins carry an equality wherever one exists (a key, a street, a grid cell), and leave it to
Spark's size statistics whether a side is broadcast. Every first match names its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import damerau_levenshtein, haversine


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the least order for each key: one partial aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(*keys, *[F.col(f"_first.{c}") for c in rest])


def coalesce_lookups(rows: DataFrame, id_col: str, steps: list[tuple[str, DataFrame, list[str], str]], payload: list[str]) -> DataFrame:
    """A cascade of equality look-ups: steps are (name, table, keys, order). The first step that hits gives the payload and its name."""
    out = rows
    for n, (_, dim, keys, order) in enumerate(steps):
        small = first_by(dim.select(*dict.fromkeys([*keys, order, *payload])), keys, order) if order else dim.dropDuplicates(keys)
        small = small.select(*[F.col(k).alias(f"_j{n}_{k}") for k in keys], F.struct(*payload).alias(f"_p{n}"))
        cond = F.lit(True)
        for k in keys:
            cond = cond & (F.col(k) == F.col(f"_j{n}_{k}"))
        out = out.join(small, cond, "left").drop(*[f"_j{n}_{k}" for k in keys])
    hit = F.coalesce(*[F.when(F.col(f"_p{n}").isNotNull(), F.lit(name)) for n, (name, *_) in enumerate(steps)])
    got = F.coalesce(*[F.col(f"_p{n}") for n in range(len(steps))])
    return out.withColumn("stage", hit).withColumn("_got", got).select(*rows.columns, "stage", *[F.col(f"_got.{c}").alias(c) for c in payload])


def interpolate_ranges(rows: DataFrame, segments: DataFrame, offset: float = 0.00009) -> DataFrame:
    """Street-range interpolation: rows (id, number, street_name, postal_code) with segments (seg_id, street_name, postal_code or null, from_number,
    to_number, start/end lat/lon, parity). Number inside the range and of its parity, first segment by seg_id; linear along the
    segment, moved to the side of the number by about 10 m. Numbers are whole.

    A range falls into blocks of 2^level numbers that start at a multiple of their size, two of a size at most. For each street, postal
    code, parity and block the first segment is kept, and a number looks into the one block of each size that holds it: joins are by
    equality, and no house meets all segments of its street. Rows of one street, number and postal code are looked up once."""
    down = lambda x, i: F.call_function("shiftright", x, i)

    def of_level(i: Column) -> Column:
        """The blocks of a size that lie in the range, but in no larger block of it: the first, if odd, and the last, if even."""
        first, end = -down(-F.col("_low"), i), down(F.col("_high") + 1, i)
        found = F.array(F.when((first < end) & (first % 2 != 0), first), F.when((first < end) & (end % 2 != 0), end - 1))
        return F.transform(F.array_compact(found), lambda x: F.struct(i.alias("level"), x.alias("block")))

    # Rows without a postal code take segments of any code, which are listed once more for them (kind 0); others take their code's and those without.
    none = F.lit("")
    code = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("code"))
    listed = F.array(code(0, none), F.when(F.col("postal_code").isNull(), code(2, none)).otherwise(code(1, F.col("postal_code"))))
    wanted = F.when(F.col("postal_code") == "", F.array(code(0, none))).otherwise(F.array(code(1, F.col("postal_code")), code(2, none)))

    s = segments.withColumn("s", F.struct(*[F.col(c).alias(f"s_{c}") for c in segments.columns]))
    low, high = (f("from_number", "to_number").cast("long") for f in (F.least, F.greatest))
    s = s.select("s", "street_name", low.alias("_low"), high.alias("_high"), F.explode(listed).alias("_code"), F.expr("CASE parity WHEN 'BOTH' THEN array(0, 1) WHEN 'ODD' THEN array(1) WHEN 'EVEN' THEN array(0) END").alias("_odd"))
    sizes = F.sequence(F.lit(0), F.floor(F.log2(F.col("_high") - F.col("_low") + 1)).cast("int") + 1)
    s = s.withColumn("_odd", F.explode("_odd")).withColumn("_block", F.explode(F.flatten(F.transform(sizes, of_level))))
    keys = ["street_name", "_code", "_odd", "_block"]
    first = s.groupBy(*keys).agg(F.min_by("s", "s.s_seg_id").alias("s"))

    rows = rows.select("id", "number", "street_name", F.coalesce("postal_code", none).alias("postal_code"))
    place = ["street_name", "number", "postal_code"]
    levels = F.broadcast(first.agg(F.collect_set("_block.level").alias("_levels")))  # 64 at most
    seen = rows.select(*place).distinct().crossJoin(levels).withColumn("_level", F.explode("_levels")).withColumn("_code", F.explode(wanted))
    number = F.col("number").cast("long")
    seen = seen.select(*place, "_code", F.when(number % 2 != 0, 1).otherwise(0).alias("_odd"), F.struct(F.col("_level").alias("level"), down(number, F.col("_level")).alias("block")).alias("_block"))
    best = seen.join(first, keys).groupBy(*place).agg(F.min_by("s", "s.s_seg_id").alias("s"))
    hit = rows.join(best, place).groupBy("id", "number").agg(F.min_by("s", "s.s_seg_id").alias("s")).select("id", "number", "s.*")
    span = F.col("s_to_number") - F.col("s_from_number")
    mu = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(span != 0, (F.col("number") - F.col("s_from_number")) / F.nullif(span, F.lit(0))).otherwise(0.5)))
    dx, dy = F.col("s_end_lon") - F.col("s_start_lon"), F.col("s_end_lat") - F.col("s_start_lat")
    length = F.sqrt(dx * dx + dy * dy)
    side = F.when(F.col("number") % 2 != 0, 1.0).otherwise(-1.0) * F.lit(offset)
    lat = F.col("s_start_lat") + mu * dy + F.when(length > 0, dx / F.nullif(length, F.lit(0.0)) * side).otherwise(0.0)
    lon = F.col("s_start_lon") + mu * dx + F.when(length > 0, -dy / F.nullif(length, F.lit(0.0)) * side).otherwise(0.0)
    return hit.select("id", F.col("s_seg_id").alias("seg_id"), F.round(lat, 6).alias("latitude"), F.round(lon, 6).alias("longitude"), F.lit("RANGE_INTERPOLATED").alias("precision"), F.lit(35.0).alias("accuracy_radius_m"))


def within_box(points: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    """Points in a box; one whose west is greater than its east crosses the antimeridian. Two comparisons that reach the scan."""
    lat = F.col("latitude").between(min_lat, max_lat)
    lon = F.col("longitude").between(min_lon, max_lon) if min_lon <= max_lon else (F.col("longitude") >= min_lon) | (F.col("longitude") <= max_lon)
    return points.where(lat & lon)


def _cell_row(lat: Column, step: Column) -> Column:
    return F.floor((lat + 90.0) / step).cast("long")


def _cell_columns(row: Column, step: Column) -> Column:
    """Number of columns of a row, by the shorter of its two edges: one at a pole, cells no narrower than high elsewhere."""
    edge = F.greatest(F.abs(row * step - 90.0), F.abs((row + 1) * step - 90.0))
    return F.greatest(F.lit(1), F.floor(F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(0.0)) * 360.0 / step)).cast("long")


def _cell_of(points: DataFrame, lat: str, lon: str, step: Column) -> DataFrame:
    """Adds the place's cell _r, _c in a grid of rows of a height in degrees."""
    n = _cell_columns(F.col("_r"), step)
    return points.withColumn("_r", _cell_row(F.col(lat), step)).withColumn("_c", F.least(F.floor(F.pmod(F.col(lon) + 180.0, F.lit(360.0)) * n / 360.0).cast("long"), n - 1))


def _cells_near(centers: DataFrame, reach: Column, step: Column) -> DataFrame:
    """A row for each cell _r, _c that the circle of a reach in degrees may touch. A circle spans the longitudes asin(sin(reach) / cos(lat)) to
    either side, and all of them where it holds a pole; columns wrap at the antimeridian."""
    lat, lon = F.col("lat"), F.col("lon")
    side = F.when(F.abs(lat) + reach >= 89.999, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / F.cos(F.radians(lat))))) + 1e-6)
    out = centers.withColumn("_side", side).withColumn("_r", F.explode(F.sequence(_cell_row(lat - reach, step), _cell_row(lat + reach, step))))
    n = F.col("_w")
    out = out.withColumn("_w", _cell_columns(F.col("_r"), step))
    first, last = (F.floor((lon + 180.0 + sign * F.col("_side")) * n / 360.0).cast("long") for sign in (-1, 1))
    columns = F.when(last - first + 1 >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(F.sequence(first, last), lambda c: F.pmod(c, n)))
    return out.withColumn("_c", F.explode(columns)).drop("_side", "_w")


def _degrees(metres: Column) -> Column:
    """The angle of a distance on `haversine`'s sphere, a little wider than rounding may make it."""
    return F.degrees(metres / 6_371_000.0) * (1 + 1e-9) + 1e-6


LEVELS = 10  # of grids for nearest points, each half as high as the one before


def radius_join(centers: DataFrame, points: DataFrame, radius_m: float, limit: int | None = None) -> DataFrame:
    """Points within a radius of each center (center_id, lat, lon), nearest first. Both sides get grid cells of the radius' height; a
    center looks into the cells its circle may touch, so the join is on (cell row, cell column) and no pair outside them is formed.
    With a limit, each center's circle is first narrowed to one that is sure to hold so many points. Its joins are merges: Spark's size
    estimates leave out that rows are repeated for each grid, and would broadcast tables that the driver cannot hold."""
    reach = _degrees(F.lit(float(radius_m)))
    step = F.greatest(reach, F.lit(1e-4))
    far = haversine(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    if limit is None:
        out = _cells_near(centers, reach, step).join(_cell_of(points, "latitude", "longitude", step), ["_r", "_c"])
        return out.withColumn("distance_m", far).where(F.col("distance_m") <= radius_m).drop("_r", "_c")

    # A cell that holds enough points, of any size, bounds the circle by the farthest of the first few of them.
    finer = step / F.call_function("shiftleft", F.lit(1), F.col("_l"))
    leveled = lambda df: df.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    cells = _cell_of(leveled(points), "latitude", "longitude", finer)
    some = F.row_number().over(Window.partitionBy("_l", "_r", "_c").orderBy("point_id"))
    few = cells.select("_l", "_r", "_c", "point_id", "latitude", "longitude").withColumn("_n", some).where(F.col("_n") <= limit)
    full = few.groupBy("_l", "_r", "_c").agg(F.collect_list(F.struct("latitude", "longitude")).alias("_few")).where(F.size("_few") == limit)
    own = _cell_of(leveled(centers.select("center_id", "lat", "lon")), "lat", "lon", finer).join(full.hint("merge"), ["_l", "_r", "_c"])
    bound = F.array_max(F.transform("_few", lambda x: haversine(F.col("lat"), F.col("lon"), x["latitude"], x["longitude"])))
    bounds = own.groupBy(F.col("center_id").alias("_id")).agg((F.min(bound) * (1 + 1e-9) + 1e-3).alias("_b"))
    narrow = centers.join(bounds.hint("merge"), F.col("center_id").eqNullSafe(F.col("_id")), "left")
    narrow = narrow.withColumn("_b", F.least(F.coalesce("_b", F.lit(float(radius_m))), F.lit(float(radius_m)))).drop("_id")

    # The circle is looked up in the finest grid that is no finer than it.
    level = F.floor(F.log2(step / _degrees(F.col("_b")))).cast("int")
    narrow = narrow.withColumn("_l", F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), level)))
    out = _cells_near(narrow, _degrees(F.col("_b")), finer).join(cells.hint("merge"), ["_l", "_r", "_c"])
    out = out.withColumn("distance_m", far).where(F.col("distance_m") <= F.col("_b")).drop("_l", "_r", "_c", "_b")
    rank = F.row_number().over(Window.partitionBy("center_id").orderBy("distance_m", "point_id"))
    return out.withColumn("_n", rank).where(F.col("_n") <= limit).drop("_n")


def centroid_ladder(rows: DataFrame, postal: DataFrame, municipal: DataFrame) -> DataFrame:
    """Postal centroid by ZIP, then by its first three digits, then the city's, then the state's."""
    z = postal.select(F.col("postal_code").alias("zip5"), F.lit(0).alias("ord"), "latitude", "longitude")
    z3 = postal.select(F.col("postal_code").alias("zip3"), F.lit(0).alias("ord"), "latitude", "longitude")
    m = municipal.select(F.col("name").alias("city"), "state", F.lit(0).alias("ord"), "latitude", "longitude")
    s = municipal.select(F.col("name").alias("state"), F.lit(0).alias("ord"), "latitude", "longitude")
    keyed = rows.withColumn("zip3", F.substring("zip5", 1, 3))
    steps = [("POSTAL", z, ["zip5"], "ord"), ("ZIP3", z3, ["zip3"], "ord"), ("MUNICIPAL", m, ["city", "state"], "ord"), ("STATE", s, ["state"], "ord")]
    return coalesce_lookups(keyed, "id", steps, ["latitude", "longitude"]).drop("zip3")


def new_points(points: DataFrame, stored: DataFrame) -> DataFrame:
    """Ingest: points whose key is not stored yet, one for each key (least point_id)."""
    return first_by(points.join(stored.select("address_key").distinct(), "address_key", "left_anti"), ["address_key"], "point_id")


def heal_zip(zip5: Column, state: Column) -> Column:
    """A ZIP of another state whose neighbouring digits, swapped in one place only, give one of this state; else null. A ZIP of the state
    stays."""
    zip3 = dims.literal(dims.ZIP3)
    fits = lambda z: F.coalesce(F.try_element_at(zip3, F.substring(z, 1, 3)) == state, F.lit(False))
    swaps = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.substr(zip5, F.lit(1), i - 1), F.substr(zip5, i + 1, F.lit(1)), F.substr(zip5, i, F.lit(1)), F.substr(zip5, i + 2, F.lit(5))))
    good = F.array_distinct(F.filter(swaps, lambda z: (z != zip5) & fits(z)))
    return F.when(fits(zip5), zip5).when(F.size(good) == 1, F.get(good, F.lit(0)))


def heal_tokens(tokens: DataFrame, dictionary: DataFrame, max_distance: int = 2, token: str = "token", entry: str = "entry", block: list[str] | None = None) -> DataFrame:
    """The one nearest entry of each different token within the distance, or no row. Tokens are made distinct first, and pairs are formed
    only where a key of deletions is shared: two words within k edits share a form after at most k deletions on either side.
    block: further columns that must be equal (such as the state)."""
    block = block or []

    def forms(df: DataFrame, column: str) -> DataFrame:
        w = F.col(column)
        drop = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1, F.length(x))))
        out = F.array(w)
        level = out
        for _ in range(max_distance):
            level = F.flatten(F.transform(level, drop))
            out = F.concat(out, level)
        return df.select(*block, column, F.explode(F.array_distinct(out)).alias("_form"))

    left, right = tokens.select(*block, token).distinct(), dictionary.select(*block, entry).distinct()
    pairs = forms(left, token).join(forms(right, entry), [*block, "_form"]).select(*block, token, entry).distinct()
    scored = pairs.withColumn("distance", damerau_levenshtein(F.col(token), F.col(entry))).where(F.col("distance") <= max_distance)
    best = scored.groupBy(*block, token, "distance").agg(F.count("*").alias("_n"), F.min(entry).alias(entry))
    return first_by(best, [*block, token], "distance").where("_n = 1").drop("_n")
