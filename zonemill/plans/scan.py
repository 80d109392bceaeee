"""One pass over map objects with several results: the fabric around a place, a city's roads, a point, raw counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, geometry
from ..functions.text import normalize, resolve_name
from ..operators.audit import merge_segments


def _metres(lon0: float, lat0: float):
    return lambda p: F.struct(*[c.alias(n) for c, n in zip(geometry.to_metres(p["lon"], p["lat"], lon0, lat0), "xy", strict=True)])


def fabric(nodes: DataFrame, ways: DataFrame, lon0: float, lat0: float) -> dict[str, DataFrame]:
    """homes (buildings that may be lived in; radius 7 m around nodes, outlines of ways), streets (named address roads) and
    landuse (residential outlines), from nodes(id, tags, lon, lat) and ways(id, tags, coords)."""
    t = F.col("tags")
    own = [classify.truthy(t["addr:housenumber"]).alias("addressed"), classify.is_apartment(t).alias("apartment"), t["addr:housenumber"].alias("housenumber"),
           t["addr:street"].alias("street"), normalize(F.coalesce(t["addr:street"], F.lit(""))).alias("street_norm")]
    lived = classify.is_anchor(classify.classify_building(t))
    x, y = geometry.to_metres(F.col("lon"), F.col("lat"), lon0, lat0)
    points = nodes.filter(lived).select(F.lit("n").alias("osm_type"), F.col("id").alias("osm_id"), *own, x.alias("x"), y.alias("y"), F.lit(7.0).alias("radius"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("ring"))
    placed = ways.filter(F.size("coords") >= 2).withColumn("line", F.transform("coords", _metres(lon0, lat0)))
    closed = F.when(F.element_at("line", 1) == F.element_at("line", -1), F.col("line")).otherwise(F.concat("line", F.slice("line", 1, 1)))
    rings = placed.filter(F.size("coords") >= 3).withColumn("ring", closed).filter(geometry.area(F.col("ring")) > 0).withColumn("c", geometry.centroid(F.col("ring")))
    outlines = rings.filter(lived).select(F.lit("w").alias("osm_type"), F.col("id").alias("osm_id"), *own, F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.lit(None).cast("double").alias("radius"), "ring")
    road = classify.truthy(t["highway"]) & classify.truthy(t["name"]) & classify.classify_road(t)["is_address"]
    return {
        "homes": points.unionByName(outlines),
        "streets": placed.filter(road).select("id", t["name"].alias("name"), "line"),
        "landuse": rings.filter((t["landuse"] == "residential") & (F.size("coords") >= 4)).select("id", "ring"),
    }


def city(objects: DataFrame, ways: DataFrame, settlement: str, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """roads (a row for each named road of two places or more and no missing node), streets (merged by name) and counts of
    buildings and address objects of every kind. ways: with_locations(whole=True); overrides(name, fixed)."""
    t = F.col("tags")
    counts = objects.agg(F.count_if(t["building"].isNotNull()).alias("buildings"), F.count_if(t["addr:housenumber"].isNotNull()).alias("address_objects"))
    roads = ways.filter(t["highway"].isNotNull() & classify.truthy(t["name"]) & (F.size("coords") >= 2)).withColumn("name", t["name"])
    roads = roads.join(overrides, "name", "left") if overrides is not None else roads.withColumn("fixed", F.lit(None).cast("string"))
    places = F.transform("coords", lambda p: F.struct(F.round(p["lon"], 5).alias("lon"), F.round(p["lat"], 5).alias("lat")))
    roads = roads.select("id", "name", F.lit(settlement).alias("settlement"), classify.classify_road(t).alias("r"), resolve_name(t, F.col("fixed")).alias("n"), places.alias("coords"))
    roads = roads.select("id", "name", "settlement", F.col("r.road_class").alias("road_class"), F.col("r.is_address").alias("is_address"), F.col("r.review").alias("review"), F.col("n.display").alias("display"), F.col("n.status").alias("status"), "coords")
    order = ["address_street", "service", "track", "path", "informal", "bridge", "intercity", "other"]
    return {"roads": roads, "streets": merge_segments(roads, ["name"], ["display", "status"], order), "counts": counts}


def point_of(nodes: DataFrame, node_id: int, fallback: tuple[float, float], digits: int = 5) -> tuple[float, float]:
    """The place of one node, or the marker's where there is none, rounded."""
    row = nodes.filter(F.col("id") == node_id).select("lon", "lat").first()
    lon, lat = (row["lon"], row["lat"]) if row is not None and row["lon"] is not None else fallback
    return round(lon, digits), round(lat, digits)


def raw_counts(objects: DataFrame, ways: DataFrame) -> DataFrame:
    """One row: buildings (nodes, and ways of four nodes or more), address objects, and houses of flats, before any merge."""
    t = F.col("tags")
    shaped = ways.filter(F.size("coords") >= 4).select(F.col("id").alias("_way"))
    seen = objects.join(shaped, (objects["kind"] == "w") & (objects["id"] == shaped["_way"]), "left")
    building = t["building"].isNotNull() & ((F.col("kind") == "n") | F.col("_way").isNotNull())
    return seen.agg(F.count_if(building).alias("raw_buildings"), F.count_if(classify.truthy(t["addr:housenumber"])).alias("raw_address_objects"), F.count_if(building & classify.is_apartment(t)).alias("apartments"))


def apartments(objects: DataFrame) -> DataFrame:
    """Houses of flats with what their tags say of their size: flats and levels as whole numbers (of "5.0" or "5.5" 5; null
    where there is no number), entrances as they are written."""
    t = F.col("tags")
    number = lambda k: F.expr(f"try_cast(floor(try_cast(trim(tags['{k}']) AS double)) AS int)")
    entrances = F.coalesce(F.nullif(t["building:entrances"], F.lit("")), t["entrance"])
    return objects.filter(classify.is_apartment(t)).select("kind", "id", number("addr:flats").alias("flats"), number("building:levels").alias("levels"), entrances.alias("entrances"))
