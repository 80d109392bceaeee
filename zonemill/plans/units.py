"""From map objects to delivery units: extraction, merging with buildings, rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, geometry
from ..operators import spatial


def extract(nodes: DataFrame, ways: DataFrame, lon0: float, lat0: float) -> tuple[DataFrame, DataFrame]:
    """(units, footprints). ways have coords (see sources.osm.with_locations). A building way needs four valid nodes; a
    node that is both building and address counts as building; footprints are closed building outlines with their class.
    units: uid, osm_type, osm_id, unit_type, building_class, street, housenumber, lon, lat, x, y."""
    t = F.col("tags")
    number, building = classify.truthy(t["addr:housenumber"]), t["building"].isNotNull()
    common = [t["addr:street"].alias("street"), t["addr:housenumber"].alias("housenumber"), classify.classify_building(t).alias("building_class")]
    node = nodes.filter(building | number).select(F.lit("n").alias("osm_type"), F.col("id").alias("osm_id"), "lon", "lat", building.alias("b"), number.alias("a"), *common)
    closed = ways.filter(building & (F.size("coords") >= 4))
    ring = F.transform("coords", lambda p: F.struct(*[c.alias(n) for c, n in zip(geometry.to_metres(p["lon"], p["lat"], lon0, lat0), "xy", strict=True)]))
    way = closed.select(F.lit("w").alias("osm_type"), F.col("id").alias("osm_id"), F.lit(True).alias("b"), number.alias("a"), *common, ring.alias("ring")).withColumn("c", geometry.centroid(F.col("ring")))
    lon, lat = geometry.to_degrees(F.col("c.x"), F.col("c.y"), lon0, lat0)
    footprints = way.filter(F.element_at("ring", 1) == F.element_at("ring", -1)).select("osm_id", "building_class", "ring")
    units = node.unionByName(way.withColumns({"lon": lon, "lat": lat}).drop("ring", "c"))
    units = units.filter(~F.col("b") | classify.is_anchor(F.col("building_class")))
    kind = F.when(~F.col("b"), "address").when(F.col("a"), "building_addressed").otherwise("building_unaddressed")
    x, y = geometry.to_metres(F.col("lon"), F.col("lat"), lon0, lat0)
    out = units.withColumns({"unit_type": kind, "uid": F.concat_ws("/", "osm_type", F.col("osm_id").cast("string")), "x": x, "y": y})
    return out.drop("a", "b"), footprints


def merge_addresses(units: DataFrame, footprints: DataFrame, size: float = 50.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, merged, rejected). Address nodes on a residential building are merged into it; those inside any other one, unknown
    ones too, are rejected with its class (of several the lowest id)."""
    address = units.filter("unit_type = 'address'")
    home = footprints.filter(classify.is_anchor(F.col("building_class")))
    on_home = spatial.containing(address, home, "uid", "osm_id", size).select("uid").distinct()
    merged = address.join(on_home, "uid", "left_semi")
    rest = address.join(on_home, "uid", "left_anti")
    other = footprints.filter(~classify.is_anchor(F.col("building_class"))).select(F.col("osm_id").alias("shape"), "building_class", "ring")
    hits = spatial.containing(rest, other, "uid", "shape", size).join(other.select("shape", F.col("building_class").alias("reason")), "shape")
    reasons = hits.groupBy("uid").agg(F.min_by("reason", "shape").alias("reason"))
    rejected = rest.join(reasons, "uid")
    kept = units.filter("unit_type <> 'address'").unionByName(rest.join(reasons.select("uid"), "uid", "left_anti"))
    return kept, merged, rejected


def zone_for_units(units: DataFrame, edges: list[float], central: str = "central_km", other: str = "bam_km", share: float = 0.85) -> DataFrame:
    """units with expected_km (a fixed mix of two distances), zone by published edges, reachable, beyond_last_edge. Without
    a central distance a unit is unreachable and has no zone."""
    from ..operators.bands import assign_band, fixed_mix

    cost = fixed_mix(F.col(central), F.col(other), share)
    out = units.withColumns({"reachable": F.col(central).isNotNull(), "expected_km": cost})
    zone = F.when(F.col("reachable"), assign_band(F.col("expected_km"), edges))
    return out.withColumns({"zone": zone, "beyond_last_edge": F.coalesce(F.col("expected_km") > edges[-1], F.lit(False))})


def zone_counts(units: DataFrame, zones: int) -> DataFrame:
    """(zone, n) for all zones, empty ones too."""
    wanted = units.sparkSession.range(zones).select(F.col("id").cast("int").alias("zone"))
    return wanted.join(units.groupBy("zone").agg(F.count(F.lit(1)).alias("n")), "zone", "left").withColumn("n", F.coalesce("n", F.lit(0)))
