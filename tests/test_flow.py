import random

from pyspark.sql import functions as F

from zonemill.operators import spatial
from zonemill.plans import flow, units


def test_bands_end_to_end(spark):
    rng = random.Random(3)
    rows, matrix = [], []
    for i in range(400):
        street = f"улица {i % 23}"
        outcome = "serviceable" if i % 20 else rng.choice(["tier_c", "outside_area", "no_street"])
        rows.append((f"n/{i}", "Город", None, street, str(i // 23 + 1), "A" if i % 3 else "B", "address", 29.0 + i * 1e-6, 46.0, outcome))
        matrix += [(f"n/{i}", None if i == 7 else 1000.0 + 20 * i + rng.randrange(50), 0.85), (f"n/{i}", 3000.0, 0.15)]
    rows += [("n/900", "Город", None, "улица 1", "1", "A", "address", 29.5, 46.0, "serviceable")]
    matrix += [("n/900", 2000.0, 1.0), ("n/7", None, 0.15)]
    u = spark.createDataFrame(rows, "uid string, settlement string, district string, street string, housenumber string, tier string, unit_type string, lon double, lat double, outcome string")
    out = flow.tariff_bands(u, spark.createDataFrame(matrix, "unit_id string, dist_m double, weight double"))
    banded, metrics = out["banded"].toPandas(), out["metrics"].orderBy("band").toPandas()
    disputed, lost = out["disputed"].count(), out["exceptions"].count()
    assert disputed == 2 and len(banded) + lost == len(rows)
    assert len(metrics) == 4 and abs(metrics.weight_share.sum() - 1) < 1e-9 and metrics.units.sum() == len(banded)
    assert all(metrics.max_value[i] <= metrics.min_value[i + 1] for i in range(3))
    assert sorted(metrics.weight_share)[0] > 0.03
    text = flow.markdown("Bands", {"metrics": out["metrics"], "edges": out["edges"]})
    assert text.startswith("# Bands") and text.count("\n| ") >= 8


def test_units_from_objects(spark):
    lon0, lat0 = 29.0, 46.0
    step = 0.0002
    square = lambda x, y: [(lon0 + (x + dx) * step, lat0 + (y + dy) * step) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    ways = spark.createDataFrame([(1, {"building": "house"}, square(0, 0)), (2, {"building": "warehouse"}, square(5, 0)), (3, {"building": "house"}, square(9, 0)[:3])], "id long, tags map<string,string>, coords array<struct<lon:double,lat:double>>")
    at = lambda x, y: (lon0 + x * step, lat0 + y * step)
    nodes = spark.createDataFrame([(10, {"addr:housenumber": "1"}, *at(0.5, 0.5)), (11, {"addr:housenumber": "2"}, *at(5.5, 0.5)), (12, {"addr:housenumber": "3"}, *at(20, 20)), (13, {"shop": "x"}, *at(1, 1)), (14, {"building": "house", "addr:housenumber": "4"}, *at(30, 0))], "id long, tags map<string,string>, lon double, lat double")
    found, prints = units.extract(nodes, ways, lon0, lat0)
    assert {r.uid: r.unit_type for r in found.collect()} == {"n/10": "address", "n/11": "address", "n/12": "address", "n/14": "building_addressed", "w/1": "building_unaddressed"}
    kept, merged, rejected = units.merge_addresses(found, prints)
    assert sorted(r.uid for r in kept.collect()) == ["n/12", "n/14", "w/1"] and [r.uid for r in merged.collect()] == ["n/10"]
    assert [(r.uid, r.reason) for r in rejected.collect()] == [("n/11", "non_residential")]


def test_zones_by_published_edges(spark):
    rows = [("a", 1.0, 2.0), ("b", None, 2.0), ("c", 9.0, None)]
    got = units.zone_for_units(spark.createDataFrame(rows, "uid string, central_km double, bam_km double"), [1.2, 3.0])
    assert [(r.uid, r.zone, r.reachable, r.beyond_last_edge) for r in got.orderBy("uid").collect()] == [("a", 0, True, False), ("b", None, False, False), ("c", 1, True, True)]
    assert [r.n for r in units.zone_counts(got, 3).orderBy("zone").collect()] == [1, 1, 0]


def test_cell_areas(spark):
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (15, 0), (30, 0), (500, 500)])], "id long, x double, y double")
    parts = spatial.cell_components(spatial.footprint(pts, 12, 10, 5))
    assert parts.select("part").distinct().count() == 2
    kept, review = spatial.drop_small(parts, pts, 5, least=3)
    assert kept.select("part").distinct().count() == 1 and [r.n for r in review.collect()] == [1]
    a, b = spatial.disc_cells(pts.filter("id = 0"), 20, 5), spatial.disc_cells(pts.filter("id = 1"), 20, 5)
    n = {h: spatial.overlay(a, b, h).count() for h in ("union", "intersection", "difference")}
    assert n["union"] == a.count() + b.count() - n["intersection"] and n["difference"] == a.count() - n["intersection"]
    left = spatial.clip_to_side(a, [(0.0, 0.0), (0.0, 1.0)], (-1.0, 0.0), 5)
    assert left.filter("applied AND cx < 0").count() == left.count() > 0
    assert spatial.erode(spatial.dilate(a, 10, 5), 10, 5).join(a, ["cx", "cy"], "left_anti").count() < a.count()
