import hashlib
import io
import json
from urllib.error import HTTPError

import pytest
from pyspark.sql import functions as F

from zonemill.errors import ConfigError, ProvenanceError, RoutingError, SpatialAuditUnavailable
from zonemill.operators import audit
from zonemill.plans import scan, village
from zonemill.sources import files, matrix, osm, router
from zonemill.streaming import counters

# A block with two outer rings and a hole, a road whose second node is missing, an address given by place, keys told twice.
MAP = """<?xml version='1.0' encoding='UTF-8'?>
<osm version="0.6">
  <node id="501" lat="10.0" lon="20.0"/><node id="502" lat="10.0" lon="20.4"/><node id="503" lat="10.4" lon="20.4"/><node id="504" lat="10.4" lon="20.0"/>
  <node id="511" lat="10.1" lon="20.1"/><node id="512" lat="10.1" lon="20.2"/><node id="513" lat="10.2" lon="20.2"/>
  <node id="601" lat="10.3" lon="20.3"><tag k="addr:housenumber" v="4b"/><tag k="addr:street" v="  Harbour Row"/></node>
  <node id="602" lat="10.3" lon="20.31"><tag k="addr:housenumber" v="4B"/><tag k="addr:street" v="HARBOUR   row "/></node>
  <node id="603" lat="10.3" lon="20.32"><tag k="addr:housenumber" v="4b"/><tag k="addr:street" v="harbour row"/><tag k="building" v="house"/></node>
  <node id="604" lat="10.31" lon="20.3"><tag k="addr:place" v="Hilltop"/><tag k="addr:housenumber" v="2"/></node>
  <node id="605" lat="10.32" lon="20.3"><tag k="addr:city" v="Port"/></node>
  <way id="700"><nd ref="501"/><nd ref="999"/><nd ref="503"/><tag k="highway" v="tertiary"/><tag k="name" v="Harbour Row"/></way>
  <way id="701"><nd ref="511"/><nd ref="513"/><tag k="highway" v="track"/></way>
  <way id="710"><nd ref="501"/><nd ref="502"/><nd ref="503"/></way>
  <way id="711"><nd ref="501"/><nd ref="504"/><nd ref="503"/></way>
  <way id="712"><nd ref="511"/><nd ref="512"/><nd ref="513"/><nd ref="511"/></way>
  <way id="713"><nd ref="512"/></way>
  <relation id="80"><member type="way" ref="710" role="outer"/><member type="way" ref="712" role="inner"/><member type="way" ref="711" role=""/><member type="node" ref="601" role="label"/><tag k="type" v="boundary"/></relation>
  <relation id="81"><member type="way" ref="710" role="outer"/><member type="way" ref="711" role="outer"/><member type="way" ref="712" role="outer"/></relation>
  <relation id="82"><member type="way" ref="710" role="outer"/></relation>
  <relation id="83"><member type="way" ref="713" role="outer"/></relation>
</osm>
"""


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("osm") / "map.osm"
    p.write_text(MAP, encoding="utf-8")
    return str(p)


def test_audit_of_a_file(spark, path):
    row = audit.source_audit(osm.read_objects(spark, path), ["tertiary", "primary"]).first().asDict()
    want = {"highway_ways": 2, "car_highway_ways": 1, "named_highway_ways": 1, "unique_road_names": 1, "buildings": 1, "buildings_with_housenumber": 1, "address_nodes": 3, "objects_with_addr_street": 3,
            "objects_with_addr_place": 1, "address_objects_without_housenumber": 1, "housenumber_without_street_or_place": 0, "duplicate_address_groups": 1, "duplicate_address_objects": 2}
    assert {k: row[k] for k in want} == want


def test_ways_members_and_boundary(spark, path):
    nodes, ways, rels = (osm.read_kind(spark, path, k) for k in ("node", "way", "relation"))
    assert [r["tags"]["addr:street"] for r in nodes.filter("id IN (601, 602)").orderBy("id").collect()] == ["  Harbour Row", "HARBOUR   row "]
    placed = osm.with_locations(ways, nodes)
    assert {r["id"]: len(r["coords"]) for r in placed.collect()} == {700: 2, 701: 2, 710: 3, 711: 3, 712: 4, 713: 1}
    assert {r["id"] for r in osm.with_locations(ways, nodes, whole=True).collect()} == {701, 710, 711, 712, 713}
    members = osm.member_lines(rels, placed)
    rings = osm.boundary(members, 80)
    assert sorted(len(r.ring) for r in rings.collect()) == [4, 5] and osm.boundary(members, 81).count() == 2
    for bad in (82, 83, 84):
        with pytest.raises(SpatialAuditUnavailable):
            osm.boundary(members, bad)
    counts = audit.member_counts(rels).filter("id = 80").first()
    assert counts["member_count"] == 4 and counts["member_type_counts"] == {"way": 3, "node": 1}
    # 511 to 513 lie on the hole's edge, which belongs to the area.
    assert {r["id"] for r in osm.clip(nodes, rings).collect()} == {501, 502, 503, 504, 511, 512, 513, 601, 602, 603, 604, 605}
    inner = spark.createDataFrame([(1, 20.15, 10.12), (2, 20.05, 10.05), (3, 20.5, 10.1), (4, None, 10.1)], "id long, lon double, lat double")
    assert [r["id"] for r in osm.clip(inner, rings).collect()] == [2]
    assert osm.in_box(nodes, 20.05, 10.05, 20.25, 10.25).count() == 3


def test_outline_of_an_extract():
    area = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    point = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}}
    assert osm.usable_area([area], 5) is area
    for bad in ([], [point], [point, area], [area, {"geometry": None}], [area, area], [{"geometry": {"type": "Polygon", "coordinates": []}}]):
        with pytest.raises(SpatialAuditUnavailable):
            osm.usable_area(bad, 5)


def test_scan(spark, path):
    nodes, ways = (osm.read_kind(spark, path, k) for k in ("node", "way"))
    found = scan.fabric(nodes, osm.with_locations(ways, nodes), 20.0, 10.0)
    home = found["homes"].collect()
    assert [(r["osm_id"], r["radius"], r["addressed"], r["street_norm"]) for r in home] == [(603, 7.0, True, "harbour row")]
    assert [r["id"] for r in found["streets"].collect()] == [700] and found["landuse"].count() == 0
    assert scan.point_of(nodes, 605, (1.0, 2.0)) == (20.3, 10.32) and scan.point_of(nodes, 1, (1.0000001, 2.0)) == (1.0, 2.0)
    city = scan.city(osm.read_objects(spark, path), osm.with_locations(ways, nodes, whole=True), "port")
    assert city["roads"].count() == 0 and tuple(city["counts"].first()) == (1, 4)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b,c"), (1, 'a"')], "k int, t string")
    files.write_csv(rows, str(tmp_path / "out"), ["t", "k"], ["k"])
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "out"), ["t", "k"]).orderBy("k").collect()] == [('a"', "1"), ("b,c", "2")]
    shapes = spark.createDataFrame([("x", '{"type":"Point","coordinates":[1.0000001,2]}'), ("w", '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}')], "name string, g string")
    files.write_json(files.feature_collection(shapes, "g", ["name"]), tmp_path / "f.geojson")
    back = files.read_features(spark, str(tmp_path / "f.geojson"))
    assert [r["properties"]["name"] for r in back.filter("type = 'Point'").collect()] == ["x"] and files.first_area(back).startswith("[[[0")
    with pytest.raises(ConfigError):
        files.first_area(back.filter("type = 'Point'"))
    m = files.Manifest("u", "r", "2024", None, "ab" * 32, None, None, "data/x")
    assert files.Manifest.from_json(m.to_json()) == m
    with pytest.raises(ConfigError):
        files.Manifest.from_json('{"source_url": "u"}')
    table = spark.createDataFrame([("1.json", "data\\x", "00" * 32), ("2.json", "data/x", "ab" * 32), ("3.json", "data/y", "")], "file string, local_path string, sha256 string")
    assert files.latest_manifest(table, "data/x").first()["file"] == "2.json" and files.latest_manifest(table, "data/z").isEmpty()
    assert village.dataset_version(table, "data/x", "map") == "map:" + "ab" * 6 and village.dataset_version(table, "data/y", "map") == "map:unknown"
    (tmp_path / "ids.yml").write_text("candidates:\n- id: 7\n- id: 5\n- 7\n")
    assert files.chosen_ids(None, tmp_path / "ids.yml", "candidates") == [7, 5] and files.chosen_ids([3, 3], "none", "x") == [3]
    assert files.tool_versions({"no": ["no-such-tool-here"]}) == {"no": None}


def test_router():
    def opener(url, timeout):
        if "nearest" in url:
            return io.BytesIO(b"{}")
        if "table" in url:
            return io.BytesIO(b'{"code": "Ok", "distances": [[1, null]], "durations": [[2, null]]}')
        if "9.000000" in url:
            return io.BytesIO(b'{"code": "NoRoute"}')
        far = 1500.4 if url.index("1.000000") < url.index("2.000000") else 1600.0
        return io.BytesIO(json.dumps({"code": "Ok", "routes": [{"distance": far, "duration": 90.2, "geometry": {"coordinates": [[1, 1], [2, 2]]}}]}).encode())

    r = router.Router("http://r", opener=opener)
    a, b, none = (1.0, 1.0), (2.0, 2.0), (9.0, 9.0)
    assert r.is_up() and r.route(a, none) is None
    assert r.route(a, b, geometry=True) == {"dist_m": 1500.4, "dur_s": 90.2, "km": 1.5, "min": 1.5, "line": [(1, 1), (2, 2)]}
    assert r.table([a], [b, none])["distances"] == [[1, None]]

    def refuses(url, timeout):
        raise HTTPError(url, 400, "InvalidQuery", {}, io.BytesIO())

    assert router.Router("http://r", opener=refuses).is_up() and router.Router("http://r", opener=lambda url, timeout: io.BytesIO(b"hello")).is_up()

    def down(url, timeout):
        raise OSError("no one there")

    assert not router.Router("http://r", opener=down).is_up()


def test_ways_through_a_village(spark):
    units = spark.createDataFrame([("a", "S", "D", "St", "1"), ("b", "S", "D", None, "2")], "uid string, settlement string, district string, street string, housenumber string")
    legs = [("a", "central", 1.0, 2.0, [(0.0, 0.0), (10.0, 10.0)]), ("b", "bam", 1.0, 2.0, [(0.0, 0.0), (10.0, 10.0)])]
    legs = spark.createDataFrame(legs, "uid string, role string, km double, min double, route array<struct<x:double,y:double>>")
    square = spark.createDataFrame([(1, [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)])], "ring_id int, ring array<struct<x:double,y:double>>")
    got = {r["uid"]: r for r in village.district_units(units, legs, [2.0, 3.0], "v", square).collect()}
    assert (got["a"]["through_village"], got["a"]["zone"], got["a"]["canonical_key"]) == (True, 1, "s|d|st|1")
    assert (got["b"]["through_village"], got["b"]["zone"], got["b"]["reachable"]) == (False, None, False)
    places = spark.createDataFrame([("o1", "bam", 1.0, 2.0), ("o2", "bam", 3.0, 4.0), ("o3", "other", 0.0, 0.0)], "origin_id string, role string, lon double, lat double")
    assert village.origins_by_role(places, ["central", "bam"]) == {"bam": (3.0, 4.0)}


def test_settings_and_json(tmp_path):
    assert files.to_json({"b": 1, "a": [1.0]}) == '{\n  "a": [\n    1.0\n  ],\n  "b": 1\n}\n'
    assert files.round_coordinates([1.1234567, 3, (2.0000001,)]) == [1.12346, 3, [2.0]]
    with pytest.raises(ConfigError):
        files.load_config(tmp_path / "no.yml", [])
    (tmp_path / "a.yml").write_text("a: 1\n")
    assert files.load_config(tmp_path / "a.yml", ["a"]) == {"a": 1}
    with pytest.raises(ConfigError):
        files.load_config(tmp_path / "a.yml", ["b"])
    assert files.settlement_feature("x", None, (1.0, 2.0))["geometry"]["type"] == "Point"
    with pytest.raises(ValueError):
        files.settlement_feature("x", {"type": "Point", "coordinates": []}, None)


def test_download(tmp_path):
    class Answer(io.BytesIO):
        headers, url = {"Content-Length": "3"}, "http://x/final"

    tries = []

    def flaky(url):
        tries.append(url)
        if len(tries) == 1:
            raise OSError("once")
        return Answer(b"abc")

    m = files.download("http://x", tmp_path / "f", opener=flaky)
    assert m.sha256 == hashlib.sha256(b"abc").hexdigest() and m.content_length == 3 and len(tries) == 2
    assert files.download("http://x", tmp_path / "f", expected=m.sha256) is None
    with pytest.raises(ProvenanceError):
        files.download("http://x", tmp_path / "f", expected="0")


def test_matrix(spark):
    o = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0)], "origin_id string, lon double, lat double")
    u = spark.createDataFrame([(str(i), float(i), 0.0) for i in range(7)], "unit_id string, lon double, lat double")

    def table(s, d):
        return {"code": "Ok", "distances": [[None if x == 3 else abs(x - a) for x, _ in d] for a, _ in s], "durations": [[1.0] * len(d)] * len(s)}

    m = matrix.fill(o, u, table, 2)
    assert m.count() == 14 and matrix.sanity(m).first()["unreachable"] == 2
    with pytest.raises(Exception, match=RoutingError.__name__):
        matrix.fill(o, u, lambda s, d: {"code": "No"}).count()


def test_streaming_counters(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:20:00", "a", 2.0), (2, "2024-01-01 05:00:00", "b", 3.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = counters.event_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["event_type"], r["n"], r["total"]) for r in spark.table("counted").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]
    assert counters.sessions(rows).count() == 2
