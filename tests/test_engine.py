import json
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from addrloom.functions import text
from addrloom.functions.rules import parse_street
from addrloom.operators import entity, evaluation, lookup, search
from addrloom.plans.standardize import register_functions, standardize, standardized
from addrloom.sources import files
from addrloom.streaming import jobs

COLUMNS = "street1 string, street2 string, city string, state string, postal_code string, country string"


def one(spark, *row, **more):
    row = (*row, *[None] * (6 - len(row)))
    return standardized(spark.createDataFrame([row], COLUMNS), **more).first()


def test_distance_vectors(spark):
    vectors = [("", "", 0), ("a", "", 1), ("", "a", 1), ("CA", "ABC", 2), ("MAIN", "MANI", 1), ("STREET", "STEET", 1), ("AVENUE", "AVE", 3), ("straße", "strasse", 2)]
    df = spark.createDataFrame(vectors, "a string, b string, d int")
    for r in df.select("d", text.damerau_levenshtein("a", "b").alias("x"), text.within_one_edit(F.col("a"), F.col("b")).alias("near")).collect():
        assert r.x == r.d and r.near == (r.d <= 1)


def test_soundex_vectors(spark):
    vectors = [("Robert", "R163"), ("Rupert", "R163"), ("Rubin", "R150"), ("Ashcraft", "A261"), ("Tymczak", "T522"), ("Pfister", "P236"), ("MAIN", "M500"), ("", ""), ("1234", ""), ("  - ", "")]
    df = spark.createDataFrame(vectors, "w string, c string")
    assert all(r.c == r.x for r in df.select("c", text.soundex(F.col("w")).alias("x")).collect())


def test_ascii_keys(spark):
    rows = [("straße", "STRASSE"), ("Łódź", "LODZ"), ("plain  text", "PLAIN TEXT"), ("東", "~006771"), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select("b", text.ascii_key(F.col("a")).alias("x")).collect()
    assert all(r.b == r.x for r in got)


@pytest.mark.parametrize(
    "row, street1, street2, city, state, zip5",
    [
        (("100 Wall St", "", "New York", "NY", "10005"), "100 WALL ST", "", "NEW YORK", "NY", "10005"),
        (("350 5th Ave", "", "New York", "NY", "10118"), "350 5TH AVE", "", "NEW YORK", "NY", "10118"),
        (("1600 Pennsylvania Ave NW", None, "Washington", "DC", "20500"), "1600 PENNSYLVANIA AVE NW", "", "WASHINGTON", "DC", "20500"),
        (("123 North Oak Street Apt 5", None, "Dallas", "Texas", "75201-1234"), "123 N OAK ST", "APT 5", "DALLAS", "TX", "75201"),
        (("P.O. Box 77", None, "Boston", "MA", "2101"), "PO BOX 77", "", "BOSTON", "MA", "02101"),
        (("RR 2 Box 152", None, "Ames", "IA", "50010"), "RR 2 BOX 152", "", "AMES", "IA", "50010"),
        (("12 South St", None, "Philadelphia", "PA", "19147"), "12 SOUTH ST", "", "PHILADELPHIA", "PA", "19147"),
        (("100 1/2 Twenty First Street", None, "New York", "NY", "10010"), "100 1/2 21ST ST", "", "NEW YORK", "NY", "10010"),
        (("500 County Road 12", None, "Austin", "TX", "78701"), "500 COUNTY ROAD 12", "", "AUSTIN", "TX", "78701"),
        (("1 Main St, Suite 10, Denver, CO 80202",), "1 MAIN ST", "STE 10", "DENVER", "CO", "80202"),
        (("9 Elm Ave", None, "TX", "Dallas", "75201"), "9 ELM AVE", "", "DALLAS", "TX", "75201"),
        (("Private Residence", None, "Miami", "FL", "33101"), "PRIVATE RESIDENCE", "", "MIAMI", "FL", "33101"),
    ],
)
def test_standardized_rows(spark, row, street1, street2, city, state, zip5):
    r = one(spark, *row)
    assert (r.street1, r.street2, r.city, r.state, r.zip5, r.address_status) == (street1, street2, city, state, zip5, "standardized")
    assert r.normalized_address_key == f"{street1}|{street2}|{city}|{state}|{zip5}|USA" and r.building_key == f"{street1}||{city}|{state}|{zip5}|USA"
    again = one(spark, r.street1, r.street2, r.city, r.state, r.postal_code)
    assert again.normalized_address_key == r.normalized_address_key


def test_failed_rows(spark):
    for row in [("", "", "", "", ""), ("N/A",), (None,), ("x" * 700, None, "A", "TX", "75201"), ("no number here", None, "A", "TX", "75201")]:
        r = one(spark, *row)
        assert r.address_status == "parse_failed" and r.normalized_address_key is None and r.tier == "MANUAL_STEWARDSHIP"
    assert one(spark, "", "", "Boston", "MA", "", allow_locality=True).address_status == "locality_only"


def test_scores_of_agreeing_and_disagreeing_rows(spark):
    good, bad = one(spark, "100 Wall St", "", "New York", "NY", "10005"), one(spark, "100 Wall St", "", "New York", "TX", "10005")
    assert good.tier == "AUTO_PASS" and good.deliverability == "DELIVERABLE" and good.composite == 0.988
    assert "ERR_ZIP_STATE_MISMATCH" in bad.reason_codes and bad.deliverability == "UNDELIVERABLE"


def test_columns_and_struct(spark):
    df = spark.createDataFrame([("100 Wall St", "NY", "10005", 7, "old")], "Address string, province string, zip string, row int, std_city string")
    flat = standardize(df)
    assert flat.columns[:4] == ["Address", "province", "zip", "row"] and flat.columns.count("std_city") == 1 and flat.first().std_street1 == "100 WALL ST"
    assert standardize(flat).first().std_zip5 == "10005"
    assert standardize(df, as_struct=True).first().standardized_address.street1 == "100 WALL ST"
    with pytest.raises(ValueError):
        standardize(df.drop("Address"))


def test_rule_parser():
    assert parse_street("Main St & 5th Ave")[0] == "MAIN ST & 5TH AVE"
    assert parse_street("Unit 1234 Box 5678")[0] == "UNIT 1234 BOX 5678"
    assert parse_street("123-45 Queens Blvd Apt 2")[:2] == ("123-45 QUEENS BLVD", "APT 2")
    for junk in (None, "", ",,,", "&", "1", "# #", "\x00" * 9, "é" * 50):
        parse_street(junk)


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT us_state_code('Texas') s, us_zip5('75201-1234') z, us_street('12 Oak Street Apt 4') a, us_unit('12 Oak Street Apt 4') u, damerau_levenshtein('CA', 'ABC') d").first()
    assert tuple(r) == ("TX", "75201", "12 OAK ST", "APT 4", 2)


def test_radius_join_near_poles_and_antimeridian(spark):
    rng = random.Random(1)
    pts = [(i, rng.choice([rng.uniform(-90, 90), 89.9, -89.95, 0.01]), rng.choice([rng.uniform(-180, 180), 179.99, -179.99, 180.0])) for i in range(400)]
    centers = [(i, a + rng.uniform(-0.3, 0.3) if abs(a) < 89 else a, b) for i, a, b in pts[:80]]
    p, c = spark.createDataFrame(pts, "point_id long, latitude double, longitude double"), spark.createDataFrame(centers, "center_id long, lat double, lon double")
    for r in (1000.0, 40_000.0, 900_000.0):
        got = {(x.center_id, x.point_id) for x in lookup.radius_join(c, p, r).collect()}
        d = text.haversine(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
        assert got == {(x.center_id, x.point_id) for x in c.crossJoin(p).where(d <= r).collect()}


@pytest.mark.parametrize("r", [1000.0, 700_000.0])
def test_radius_join_just_inside_the_radius(spark, r):
    """Points a little nearer than the radius in all directions from centers beside the edges of rows that are 1/111,320 degrees a metre high."""
    pts, centers = [], []
    d, step = r * 0.9998 / 6_371_000.0, r / 111_320.0
    for k in range(1, 28):
        lat = math.radians(k * step - 90 + (1e-5 if k % 2 else -1e-5) * step)
        for turn in range(0, 360, 15):
            i, lon, turn = len(pts), -180 + k * 13.1, math.radians(turn)
            to = math.asin(math.sin(lat) * math.cos(d) + math.cos(lat) * math.sin(d) * math.cos(turn))
            by = math.atan2(math.sin(turn) * math.sin(d) * math.cos(lat), math.cos(d) - math.sin(lat) * math.sin(to))
            centers.append((i, math.degrees(lat), lon))
            pts.append((i, math.degrees(to), (lon + math.degrees(by) + 540) % 360 - 180))
    p, c = spark.createDataFrame(pts, "point_id long, latitude double, longitude double"), spark.createDataFrame(centers, "center_id long, lat double, lon double")
    found = lookup.radius_join(c, p, r).where("center_id = point_id")
    assert found.count() == found.distinct().count() == len(pts)


def test_nearest_points_in_towns_and_deserts(spark):
    """The nearest few against all pairs; a center's cell may hold none, few or very many points, and pairs formed grow with the centers."""
    rng = random.Random(9)
    towns = [(0.0, 179.999), (51.5, 0.0), (89.99, 30.0), (-40.0, -71.3)]
    place = lambda spread: (lambda t: (max(-90.0, min(90.0, t[0] + rng.gauss(0, spread))), (t[1] + rng.gauss(0, spread) + 540) % 360 - 180))(rng.choice(towns))
    pts = [(i, *(place(0.02) if i % 3 else place(3.0) if i % 2 else (rng.uniform(-90, 90), rng.uniform(-180, 180)))) for i in range(2000)]
    pts += [(5000 + i, 51.5, 0.0) for i in range(30)]
    centers = [(i, *(place(0.02) if i % 3 else place(5.0) if i % 2 else (rng.uniform(-90, 90), rng.uniform(-180, 180)))) for i in range(400)] + [(400, 51.5, 0.0), (None, 51.4, 0.1)]
    p, c = spark.createDataFrame(pts, "point_id long, latitude double, longitude double"), spark.createDataFrame(centers, "center_id long, lat double, lon double")
    d = text.haversine(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    all_pairs = c.crossJoin(p).withColumn("d", d)
    for radius, limit in ((1_500_000.0, 3), (20_000.0, 1), (19_000_000.0, 7)):
        rank = F.row_number().over(Window.partitionBy("center_id").orderBy("d", "point_id"))
        want = sorted((str(r.center_id), r.point_id) for r in all_pairs.where(F.col("d") <= radius).withColumn("n", rank).where(F.col("n") <= limit).collect())
        found = lookup.radius_join(c, p, radius, limit=limit)
        assert set(found.columns) == {"center_id", "lat", "lon", "point_id", "latitude", "longitude", "distance_m"}
        assert sorted((str(r.center_id), r.point_id) for r in found.collect()) == want


def joined_rows(node) -> int:
    """Rows that the joins of a plan have made."""
    name, children = node.nodeName(), node.children()
    if name.startswith("AdaptiveSparkPlan"):
        return joined_rows(node.executedPlan())
    if name.endswith("QueryStage"):
        return joined_rows(node.plan())
    return (node.metrics().apply("numOutputRows").value() if "Join" in name else 0) + sum(joined_rows(children.apply(k)) for k in range(children.size()))


def test_nearest_points_form_few_pairs(spark):
    """Some 1,000 points lie within the radius of each center; not all of them are paired with it."""
    place = lambda seed, low: low + 5.0 * F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    c = spark.range(5000).select(F.col("id").alias("center_id"), place(1, 40).alias("lat"), place(2, 10).alias("lon"))
    p = spark.range(5000).select(F.col("id").alias("point_id"), place(3, 40).alias("latitude"), place(4, 10).alias("longitude"))
    found = lookup.radius_join(c, p, 120_000.0, limit=3)
    assert len(found.collect()) == 15_000
    assert 0 < joined_rows(found._jdf.queryExecution().executedPlan()) < 100 * 5000


def test_nearest_points_broadcast_no_large_table(spark):
    """Both tables are small as Spark estimates them, but not once their rows are repeated for each grid; a driver could not hold them."""
    place = lambda seed, low: low + 5.0 * F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    c = spark.range(20_000).select(F.col("id").alias("center_id"), place(1, 40).alias("lat"), place(2, 10).alias("lon"))
    p = spark.range(20_000).select(F.col("id").alias("point_id"), place(3, 40).alias("latitude"), place(4, 10).alias("longitude"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    try:
        assert len(lookup.radius_join(c, p, 120_000.0, limit=3).select("center_id", "point_id").collect()) == 60_000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_interpolation_takes_the_first_fitting_segment(spark):
    """Ranges of all widths, negative and single numbers, all parities, rows and segments with and without postal codes, against every pair."""
    rng = random.Random(7)
    codes = ["10005", "10006", None]
    segs, rows = [], []
    for i in range(300):
        low = rng.randint(-40, 900)
        ends = [low, low + rng.choice([0, 1, 7, 8, 63, 99, rng.randint(0, 400)])]
        rng.shuffle(ends)
        segs.append((i, rng.choice("AB"), rng.choice(codes + ["10007"]), *ends, 30.0, -100.0 - i, 30.01, -100.02 - i, rng.choice(["BOTH", "ODD", "EVEN", None])))
    for i in range(600):
        rows.append((i, rng.randint(-50, 1300), rng.choice(["A", "B", "C", None]), rng.choice(codes + [""])))
    rng.shuffle(segs)
    s = spark.createDataFrame(segs, "seg_id long, street_name string, postal_code string, from_number int, to_number int, start_lat double, start_lon double, end_lat double, end_lon double, parity string")
    h = spark.createDataFrame(rows, "id long, number int, street_name string, postal_code string")
    want = {}
    for i, n, street, code in rows:
        fit = [x[0] for x in segs if x[1] == street and min(x[3:5]) <= n <= max(x[3:5]) and (x[2] is None or not code or x[2] == code) and x[9] in ("BOTH", "ODD" if n % 2 else "EVEN")]
        if fit:
            want[i] = min(fit)
    found = lookup.interpolate_ranges(h, s)
    assert {r.id: r.seg_id for r in found.collect()} == want
    joins = re.findall(r"Join Inner, (.*)", found._jdf.queryExecution().optimizedPlan().toString())
    assert not any(re.search(" [<>]=? ", j) for j in joins)  # no range is tried on all pairs of a street


def test_isotonic_knots_and_calibration(spark):
    xs, ys = evaluation.fit_isotonic(spark.createDataFrame([(0.1, False), (0.2, True), (0.3, False), (0.4, True), (0.4, True), (0.9, True)], "score double, was_correct boolean"))
    assert xs == pytest.approx([0.1, 0.25, (0.4 + 0.4 + 0.9) / 3]) and ys == pytest.approx([0.0, 0.5, 1.0])
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.175,), (1.0,)], "s double").select(evaluation.calibrated(F.col("s"), xs, ys)).collect()]
    assert got == pytest.approx([0.0, 0.25, 1.0])


def test_search_highlights_and_ranges(spark):
    assert search.highlights("100 MAIN ST, MAINE", ["MAIN", "INE", "100"]) == [(0, 3), (4, 8), (13, 18)]
    df = spark.createDataFrame([([(4, 8), (0, 3), (7, 9), (13, 18)],)], "r array<struct<start:int,end:int>>")
    assert [tuple(x) for x in df.select(search.merged_ranges(F.col("r"))).first()[0]] == [(0, 3), (4, 9), (13, 18)]


def test_merge_vetoes(spark):
    base = {"street1": "1 A ST", "street2": "", "building_key": "k", "normalized_address_key": "k", "is_private_residence": False, "is_hub": False, "cmra": False}
    cases = [({}, "SINGLE_TENANT_BUILDING"), ({"street1": ""}, "EMPTY_STREET_ISOLATION"), ({"is_private_residence": True}, "PRIVATE_RESIDENCE_ISOLATION"), ({"building_key": "x"}, "DISTINCT_BUILDINGS"), ({"is_hub": True}, "CO_LOCATION_ISOLATION_INVARIANT"), ({"street2": "STE 1"}, "SECONDARY_UNIT_ASYMMETRY"), ({"normalized_address_key": "z"}, "KEY_MISMATCH")]
    kind = "struct<street1:string,street2:string,building_key:string,normalized_address_key:string,is_private_residence:boolean,is_hub:boolean,cmra:boolean>"
    for change, reason in cases:
        r = spark.createDataFrame([(tuple(base.values()), tuple((base | change).values()))], f"a {kind}, b {kind}").select(entity.merge_decision("a", "b").alias("x")).first().x
        assert r.reason == reason and r.may_merge == (reason == "SINGLE_TENANT_BUILDING")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("street,city,state,zip\n12 Oak St,Dallas,TX,75201,extra\n13 Oak St,Dallas\n")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows.count() == 2 and standardize(rows).first().std_street1 == "12 OAK ST"
    files.write_csv(rows.withColumns({"std_x": F.lit("=1"), "ok": F.lit(True)}), str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out")).first()
    assert back.std_x == "'=1" and back.ok == "True"
    (tmp_path / "a.jsonl").write_text('{"street1": "1 A St"}\n\n{"street1": "2 A St"}\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "a.json").write_text('[{"street1": "1 A St"}, {"street1": "2 A St"}]')
    assert files.read_json_array(spark, str(tmp_path / "a.json")).count() == 2
    assert len(json.loads(files.json_array(rows))) == 2
    assert [tuple(r)[:2] for r in files.from_records(spark, ["1 A St", {"address": "2 B St", "apt": 4}, ("3 C St", None)]).collect()] == [("1 A St", None), ("2 B St", "4"), ("3 C St", None)]
    assert files.from_arrow(spark, pa.table({"street1": ["x"]})).count() == 1
    assert files.insert_statements(spark.createDataFrame([("a'b", None)], "x string, y string"), "t").first()[0] == "INSERT INTO t (x, y) VALUES ('a''b', NULL);"
    with pytest.raises(ValueError):
        files.check_paths("/a", "/a/")


def test_feeds(spark, tmp_path):
    oa = spark.createDataFrame([("-122.1", "44.0", "742", "Evergreen Ter", "", "Springfield", "OR", "97477"), ("999", "44", "1", "X", "", "", "", ""), ("1", "2", "3", "", "", "", "", "")], "LON2 string, LATITUDE string, NUMBER string, STREET string, UNIT string, CITY string, REGION string, POSTCODE string").withColumnRenamed("LON2", "LONGITUDE")
    assert [r.address_key for r in files.open_addresses(oa).collect()] == ["742 EVERGREEN TER||SPRINGFIELD|OR|97477|USA"]
    tiger = spark.createDataFrame([("Market St", "1000", "1100", "37.7", "-122.4", "37.8", "-122.5"), ("Bad", "x", "1", "1", "1", "1", "1")], "street_name string, from_number string, to_number string, start_lat string, start_lon string, end_lat string, end_lon string")
    assert [(r.street_name, r.parity, r.from_number) for r in files.tiger_segments(tiger).collect()] == [("MARKET ST", "BOTH", 1000)]
    osm = {"features": [
        {"geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"addr:housenumber": "5", "addr:street": "Oak St"}},
        {"geometry": {"type": "Polygon", "coordinates": [[[179, 0], [-179, 0], [-179, 2], [179, 2], [179, 0]]]}, "properties": {"addr:street": "Pine St"}},
        {"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {}},
    ]}
    got = sorted((r.street1, r.longitude, r.latitude) for r in files.osm_features(spark.createDataFrame([(json.dumps(osm),)], "value string")).collect())
    assert got == [("5 OAK ST", 1.5, 2.5), ("PINE ST", -180.0, 1.0)]
    (tmp_path / "g.txt").write_text("US\t10005\tNew York\tNew York\tNY\t\t\t\t\t40.7\t-74.0\t4\n" * 2 + "GB\tSW1A\tLondon\t\t\t\t\t\t\t51.5\t-0.1\t4\n")
    assert files.geonames(spark, str(tmp_path / "g.txt")).count() == 2 and files.geonames(spark, str(tmp_path / "g.txt"), ["GB"]).count() == 1
    c = spark.createDataFrame([("SW1A 1AA", "GB"), ("1012 AB", "NL")], "p string, c string").select(files.postal_candidates(F.col("p"), F.col("c"))).collect()
    assert c[0][0] == ["SW1A 1AA", "SW1A1AA", "SW1A"] and c[1][0] == ["1012 AB", "1012AB", "1012"]


def test_stream_equals_batch(spark, tmp_path):
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.csv").write_text("street1,city,state,postal_code\n" + "".join(f"{i} Oak Street,Dallas,TX,75201\n" for i in range(k * 10 + 1, k * 10 + 6)))
    schema = "street1 string, city string, state string, postal_code string"
    jobs.stream_standardize(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), schema, files_per_batch=1).awaitTermination()
    streamed = {r.std_normalized_address_key for r in files.read_csv(spark, str(tmp_path / "out")).collect()}
    assert streamed == {r.std_normalized_address_key for r in standardize(files.read_csv(spark, str(tmp_path / "in"))).collect()} and len(streamed) == 15


def test_ledger_stream_appends_once(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "audit_id string, v int").coalesce(1).write.parquet(str(tmp_path / "in"))
    for k in range(2):
        rows = spark.readStream.schema("audit_id string, v int").parquet(str(tmp_path / "in"))
        jobs.stream_to_ledger(rows, str(tmp_path / "ledger"), str(tmp_path / f"ck{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2
