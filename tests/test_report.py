"""Reports of a district, its settings, and the line forms they need."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonemill.errors import ConfigError
from zonemill.functions import geometry
from zonemill.operators import graph
from zonemill.plans import report
from zonemill.sources import files


def test_settings(tmp_path):
    path = tmp_path / "area.yml"
    path.write_text("allowed:\n- {key: a, name: A, relation: 4, districts: [n, s]}\n- {key: b, name: B, relation: 5}\nexcluded: {c: too far}\n")
    found = report.ServiceSettings.load(str(path))
    assert found.allowed_keys == {"a", "b"} and found.excluded_keys == {"c"} and found.allowed[0].districts == ("n", "s")
    for text in ("allowed: [{key: a, name: A, relation: 4}]\nexcluded: {a: twice}\n", "allowed: [{name: A}]\nexcluded: {}\n", "allowed: []\n"):
        path.write_text(text)
        with pytest.raises(ConfigError):
            report.ServiceSettings.load(str(path))


def test_house_numbers_from_outside_are_a_reference_unless_verified():
    known = {"external_house_range_reference": "1-9", "external_example_house_numbers": ["1", "3"], "source": "s"}
    assert report.address_reference(known)["external_address_reference"]["verified_for_automatic_import"] is False
    official = report.address_reference(known | {"verified_for_automatic_import": True})
    assert official == {"official_address_support": {"house_range_official": "1-9", "verified_for_automatic_import": True, "source": "s"}}


def test_district_report(spark):
    zones = spark.createDataFrame([(2, 5), (1, 0)], "zone int, units long")
    ready = spark.createDataFrame([(7,)], "units_total long")
    known = {"external_house_range_reference": "1-9", "external_example_house_numbers": [], "source": "s"}
    got = report.district_report(known, {"parts": 1}, {"zones": zones, "readiness": ready}, ["approve"])
    assert got["zones"] == [{"zone": 1, "units": 0}, {"zone": 2, "units": 5}] and got["readiness"] == {"units_total": 7} and got["resolved"] is False
    cover = spark.createDataFrame([(2, "disconnected"), (1, "connected")], "id int, status string")
    assert {k: v for k, v in report.coverage_summary(cover).items() if k != "districts"} == {"districts_total": 2, "connected": 1, "disconnected": 1}
    units = spark.createDataFrame([("b", 2.0, 1.0, 4), ("a", 1.0, 1.0, 3), ("c", 0.0, 0.5, None)], "uid string, lon double, lat double, zone int")
    assert [f["properties"] for f in report.unit_features(units, ["zone"])["features"]] == [{"zone": None}, {"zone": 3}, {"zone": 4}]
    line = report.outline_feature([(0, 0), (1, 0), (1, 1)], {"kind": "x"})
    assert line["geometry"]["type"] == "LineString" and line["geometry"]["coordinates"][0] == line["geometry"]["coordinates"][-1]


def test_lines(spark):
    point = "struct<x:double,y:double>"
    rng = random.Random(4)
    wild = [(float(i), rng.random() * 4) for i in range(200)]
    rows = [(1, [(0.0, 0.0), (5.0, 1.0), (10.0, 0.0)]), (2, [(0.0, 0.0), (5.0, 9.0), (10.0, 0.0)]), (3, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (4, wild), (5, None), (6, [])]
    s = spark.createDataFrame(rows, f"id int, line array<{point}>")
    got = {r["id"]: None if r["s"] is None else [tuple(p) for p in r["s"]] for r in s.select("id", geometry.simplify(s["line"]).alias("s")).collect()}
    assert got[1] == [(0, 0), (10, 0)] and got[2] == rows[1][1] and got[3] == rows[2][1] and got[5] is None and got[6] == []
    assert len(got[4]) < 200
    kx, ky = np.array(got[4]).T
    for x, y in wild:  # no point is farther from the thinned line than the tolerance
        near = min(np.hypot(x - a - t * (b - a), y - c - t * (e - c)) for a, b, c, e in zip(kx[:-1], kx[1:], ky[:-1], ky[1:], strict=True) for t in [min(1, max(0, ((x - a) * (b - a) + (y - c) * (e - c)) / ((b - a) ** 2 + (e - c) ** 2)))])
        assert near <= 2 + 1e-9
    longer = {r["id"]: r["s"] and [tuple(p) for p in r["s"]] for r in s.filter("id in (2, 5, 6)").select("id", geometry.extend_line(s["line"], 10.0).alias("s")).collect()}
    assert longer[5] is None and longer[6] == [] and longer[2][1:-1] == rows[1][1]
    assert np.hypot(*longer[2][0]) == pytest.approx(10) and longer[2][-1][1] < 0


def test_global_rank(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(9)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k long, n long").repartition(7)
    got = {r["k"]: r["nth"] for r in graph.global_rank(frame, [F.col("n").desc(), F.col("k")], "nth").collect()}
    assert got == {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert graph.global_rank(frame.filter("k < 0"), ["n", "k"], "nth").count() == 0


def test_forms_of_disputed_addresses(spark, tmp_path):
    from zonemill.operators import addresses

    rows = [("k2", "u3", 1.0, 2.0, "B", None), ("k1", "u2", 3.0, 4.0, "A", "x"), ("k1", "u1", 5.0, 6.0, "A", "x")]
    ledger = addresses.disputed_ledger(spark.createDataFrame(rows, "canonical_key string, uid string, lon double, lat double, settlement string, street string"), "canonical_key", "uid")
    shown = report.disputed_features(ledger, "canonical_key", ["settlement"])["features"]
    assert [f["properties"]["uid"] for f in shown] == ["u1", "u2", "u3"] and shown[0]["geometry"]["coordinates"] == [5.0, 6.0]
    assert {f["properties"]["resolution"] for f in shown} == {"owner_review_required"}
    told = report.disputed_summary(ledger, "canonical_key", ["settlement", "street"])
    assert told["count"] == 2 and told["by_settlement"] == {"A": 1, "B": 1} and told["by_street"] == {"unknown": 1, "x": 1}
    assert [(a["canonical_key"], [c["uid"] for c in a["candidates"]]) for a in told["addresses"]] == [("k1", ["u1", "u2"]), ("k2", ["u3"])]
    files.write_csv(ledger, f"file://{tmp_path}/csv", ["canonical_key", "candidate", "uid"], ["canonical_key", "uid"])
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).count() == 3
