from pyspark.sql import functions as F

from zonemill.functions import classify, geometry, text


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_normal_form(spark):
    cases = [("\tRiver  Bank\n", "river bank"), ("ПЕРВАЯ\u00a0Линия", "первая линия"), ("Ｎｏ ７", "no 7"), ("Großer Weg", "grosser weg"), ("ﬁn", "fin"), ("\u3000x", "x"), ("Ё ё", "ё ё"), ("İ", "i̇"), ("", ""), (None, None)]
    assert one(spark, cases, "a string, b string", text.normalize_text(F.col("a"))) == [b for _, b in cases]
    assert one(spark, cases, "a string, b string", text.normalize(F.col("a"))) == [b for _, b in cases]
    plain = [a for a, _ in cases if a and text.normal_form(a) is not None]
    df = spark.createDataFrame([(a,) for a in plain], "a string").filter(text.is_plain(F.col("a")))
    assert all(r.a == r.b for r in df.select(text.normalize_plain(F.col("a")).alias("a"), text.normalize_text(F.col("a")).alias("b")).collect())
    assert df.count() >= 1


def test_building_classes(spark):
    b = lambda value, **more: {"building": value, **{k.replace("__", ":"): v for k, v in more.items()}}
    cases = [
        (b("bungalow"), "confirmed_residential"), (b("terrace", addr__housenumber="9"), "confirmed_residential"), (b("yes", addr__housenumber="12a"), "confirmed_residential"), (b("yes", addr__housenumber=""), "probable_residential"),
        (b("silo", addr__housenumber="3"), "non_residential"), (b("stable"), "outbuilding"), (b("yes", abandoned__amenity="pub"), "abandoned_or_ruin"), (b("detached", disused="no"), "confirmed_residential"),
        (b("collapsed"), "abandoned_or_ruin"), (b("dormitory", construction="minor"), "construction"), (b("construction", ruins="yes"), "abandoned_or_ruin"), (b("lighthouse"), "unknown"), ({"amenity": "fuel"}, "unknown"),
    ]
    assert one(spark, [(c,) for c, _ in cases], "t map<string,string>", classify.classify_building(F.col("t"))) == [c for _, c in cases]
    flats = [(b("apartments"), True), (b("dormitory"), True), (b("apartments", abandoned="yes"), False), (b("apartments", construction="yes"), False), (b("house"), False), ({"shop": "kiosk"}, False)]
    assert one(spark, [(c,) for c, _ in flats], "t map<string,string>", classify.is_apartment(F.col("t"))) == [c for _, c in flats]


def test_road_classes(spark):
    cases = [
        (("Harbour lane", "tertiary"), ("address_street", True, False)), (("Old Bridge", "residential"), ("bridge", False, False)), (("Bridge road", "secondary"), ("address_street", True, False)),
        (("Podul Mare", "service"), ("bridge", False, False)), (("E58", "trunk_link"), ("intercity", False, False)), (("Slope (steep)", "unclassified"), ("informal", False, True)), (("back way", "steps"), ("informal", False, True)),
        (("Yard", "service"), ("service", False, True)), (("Field", "track"), ("track", False, True)), (("Аллея Роз", "path"), ("address_street", True, True)), (("Dike", "cycleway"), ("path", False, False)), (("Q", "busway"), ("other", False, True)), ((None, "pedestrian"), ("address_street", True, False)),
    ]
    tags = [({k: v for k, v in (("name", n), ("highway", h)) if v},) for (n, h), _ in cases]
    assert [tuple(r) for r in one(spark, tags, "t map<string,string>", classify.classify_road(F.col("t")))] == [c for _, c in cases]


def test_tiers(spark):
    cases = [((5, 0, 0, False, 0, False), "A"), ((0, 8, 0, False, 0, False), "A"), ((0, 0, 1, False, 0, False), "A"), ((0, 0, 0, True, 0, False), "A"), ((0, 0, 0, False, 1, False), "A"), ((0, 3, 0, False, 0, True), "B"), ((0, 7, 0, False, 0, False), "C"), ((0, 2, 0, False, 0, True), "C")]
    cols = ["a", "r", "ap", "e", "p", "c"]
    got = one(spark, [c for c, _ in cases], "a int, r int, ap int, e boolean, p int, c boolean", classify.assign_tier(*map(F.col, cols))["tier"])
    assert got == [t for _, t in cases]


def test_keys_and_labels(spark):
    rows = [("Port", "Harbour Row", "4B", "Quay"), ("Port", " ", "4B", None), (None, "Harbour Row", "2", None)]
    df = "s string, t string, n string, d string"
    c = [F.col(x) for x in "stnd"]
    assert one(spark, rows, df, text.canonical_key(*c)) == ["port|quay|harbour row|4b", None, None]
    assert one(spark, rows, df, text.canonical_key(*c, district_needed=F.lit(False)))[0] == "port||harbour row|4b"
    assert one(spark, rows, df, text.canonical_key_short(*c[:3]))[0] == "port|harbour row|4b"
    assert one(spark, rows, df, text.full_address(c[0], c[3], c[1], c[2]))[0] == "Port, Quay, Harbour Row, дом 4B"
    assert one(spark, rows, df, text.display_address(c[1], c[3])) == ["Harbour Row (Quay)", "", "Harbour Row"]


def test_relation_warnings(spark):
    cases = [(1, True, {"type": "boundary", "boundary": "administrative", "admin_level": "8", "name": "x"}, []), (2, False, None, ["relation 2 not present in this PBF extract"]), (3, True, {"type": "route"}, ["unexpected type='route' (expected 'boundary')", "unexpected boundary=None (expected 'administrative')", "missing admin_level tag", "missing name tag"])]
    got = one(spark, [c[:3] for c in cases], "id long, f boolean, t map<string,string>", classify.relation_warnings(F.col("id"), F.col("f"), F.col("t"), ["8"]))
    assert got == [c[3] for c in cases]


def test_geometry(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    df = spark.createDataFrame([(square,)], "r array<struct<x:double,y:double>>")
    r = F.col("r")
    inside = lambda x, y: geometry.covers(r, F.lit(x), F.lit(y))
    row = df.select(geometry.area(r), geometry.length(r), geometry.centroid(r), geometry.midpoint(r), inside(1.0, 1.0), inside(4.0, 2.0), inside(0.0, 0.0), inside(4.1, 2.0), geometry.to_line(F.lit(2.0), F.lit(6.0), r)).first()
    assert row[0] == 16 and row[1] == 16 and tuple(row[2]) == (2, 2) and tuple(row[3]) == (4, 4)
    assert [*row[4:8]] == [True, True, True, False] and row[8] == 2
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-1.0, 2.0), (5.0, 2.0))])
    far = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-1.0, 9.0), (5.0, 9.0))])
    assert tuple(df.select(geometry.line_meets_ring(line, r), geometry.line_meets_ring(far, r)).first()) == (True, False)
    back = geometry.to_degrees(*geometry.to_metres(F.lit(29.5), F.lit(46.9), 29.4, 46.8), 29.4, 46.8)
    assert [round(x, 9) for x in df.select(*back).first()] == [29.5, 46.9]


def test_simple_rings():
    import numpy as np

    from zonemill.functions.geometry import simple_corners

    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    sound = [square, [(0, 0), (4, 0), (0, 4), (0, 0)], [(0, 0), (2, 0), (4, 0), (4, 4), (0, 0)]]
    broken = [square[:4], square[:2] + [(0, 0)], [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)], [(0, 0), (4, 0), (8, 0), (0, 0)], [*square[:2], (4, 9), (4, 4), *square[3:]], [*square[:2], (4, 0), *square[2:]], [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)], square[:-1] + square]
    for rings, want in ((sound, True), (broken, False)):
        for r in rings:
            x, y = np.array(r, float).T
            assert simple_corners(x, y) == want, r


def test_building_rings(spark):
    from zonemill.sources import osm

    at = lambda *p: [{"lon": float(x), "lat": float(y)} for x, y in p]
    rows = [(1, {"building": "yes"}, at((0, 0), (1, 0), (1, 1), (0, 0))), (2, {"building": "yes"}, at((0, 0), (1, 0), (1, 1))), (3, {"highway": "track"}, at((0, 0), (1, 0), (1, 1), (0, 0))), (4, {"building": "yes"}, None), (5, {"building": "yes"}, at((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)))]
    ways = spark.createDataFrame(rows, "id long, tags map<string,string>, coords array<struct<lon:double,lat:double>>")
    assert [(r.id, len(r.ring)) for r in osm.building_rings(ways).collect()] == [(1, 4)]
