"""Map-object files: XML scan with entity filter, node places joined into ways, boundaries, members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SpatialAuditUnavailable
from ..functions.geometry import is_simple
from ..operators.graph import cut_lineage
from ..operators.outlines import require_areas
from ..operators.spatial import containing

_TAG = "tag array<struct<_k:string,_v:string>>"
_SCHEMA = {
    "node": f"_id bigint, _lat double, _lon double, {_TAG}",
    "way": f"_id bigint, nd array<struct<_ref:bigint>>, {_TAG}",
    "relation": f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {_TAG}",
}


def read_kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Objects of one kind; only its rows are parsed. Attribute values keep their blanks. Tags are a map, null without any."""
    rows = spark.read.format("xml").option("rowTag", kind).option("ignoreSurroundingSpaces", "false").schema(_SCHEMA[kind]).load(path)
    tags = F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], F.coalesce(t["_v"], F.lit("")))))
    base = [F.lit({"node": "n", "way": "w", "relation": "r"}[kind]).alias("kind"), F.col("_id").alias("id"), tags.alias("tags")]
    if kind == "node":
        return rows.select(*base, F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))
    if kind == "way":
        return rows.select(*base, F.transform("nd", lambda n: n["_ref"]).alias("refs"))
    return rows.select(*base, F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members"))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """All objects as (kind, id, tags)."""
    out = None
    for kind in _SCHEMA:
        own = read_kind(spark, path, kind).select("kind", "id", "tags")
        out = own if out is None else out.unionByName(own)
    return out


def with_locations(ways: DataFrame, nodes: DataFrame, whole: bool = False) -> DataFrame:
    """ways with coords, the places of their nodes in order. whole: a way that lacks a node is dropped; else the node is."""
    places = ways.select("id", F.posexplode("refs").alias("pos", "ref"))
    found = places.join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref", "left")
    lines = found.groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("lon").isNotNull(), F.struct("pos", "lon", "lat")))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords"),
        F.count(F.lit(1)).alias("_n"), F.count("lon").alias("_ok"),
    )
    if whole:
        lines = lines.filter("_n = _ok")
    return ways.join(lines.drop("_n", "_ok"), "id", "inner" if whole else "left")


def building_rings(ways: DataFrame) -> DataFrame:
    """Ways (id, tags, coords; see with_locations with ``whole``) that are buildings with an area: closed, of four points or more, meeting
    themselves nowhere; with column ring. Others are dropped, as no outline can be made of them."""
    ring = F.transform("coords", lambda p: F.struct(p["lon"].cast("double").alias("x"), p["lat"].cast("double").alias("y")))
    return ways.filter(F.col("tags")["building"].isNotNull()).withColumn("ring", ring).filter(is_simple(F.col("ring")))


def member_lines(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """Members of kind way with their coords, in order; coords null where the way is missing or has under two nodes."""
    m = relations.select(F.col("id").alias("relation_id"), F.posexplode("members").alias("pos", "m")).filter("m.type IN ('way', 'w')")
    lines = ways.filter(F.size("coords") >= 2).select(F.col("id").alias("way_id"), "coords")
    return m.select("relation_id", "pos", F.col("m.ref").alias("way_id"), F.col("m.role").alias("role")).join(lines, "way_id", "left")


def outline_members(members: DataFrame) -> DataFrame:
    """Members that bound their relation's area (outer, inner or without a role) as (relation_id, line)."""
    rim = members.filter(F.coalesce(F.col("role"), F.lit("")).isin("outer", "inner", ""))
    return rim.select("relation_id", F.transform("coords", lambda p: F.struct(p["lon"].cast("double").alias("x"), p["lat"].cast("double").alias("y"))).alias("line"))


def boundary(members: DataFrame, relation_id: int) -> DataFrame:
    """(relation_id, chain, ring): all rings of one relation, holes and exclaves included. Missing members, open lines and
    relations without any are an error, and no box stands in for them."""
    return require_areas(outline_members(members.filter(F.col("relation_id") == relation_id)))


def usable_area(features: list[dict], relation_id: int) -> dict:
    """The one outline among GeoJSON features of a relation. None, several, an empty one, or a feature of another kind beside it
    is an error."""
    kinds = [(f.get("geometry") or {}).get("type") for f in features]
    areas = [f for f, k in zip(features, kinds, strict=True) if k in ("Polygon", "MultiPolygon")]
    if len(areas) != 1 or len(kinds) != 1 or not areas[0]["geometry"].get("coordinates"):
        raise SpatialAuditUnavailable(f"relation {relation_id}: {len(areas)} outlines among {kinds}")
    return areas[0]


def clip(points: DataFrame, rings: DataFrame, lon: str = "lon", lat: str = "lat", size: float = 0.001) -> DataFrame:
    """Objects inside a boundary(), whose edge is inside and whose holes are not. size: of the smallest border cells, in degrees."""
    key = F.monotonically_increasing_id()
    named = cut_lineage(points.withColumn("_at", key))
    at = named.select("_at", F.col(lon).alias("x"), F.col(lat).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return named.join(containing(at, rings, "_at", "relation_id", size).select("_at").distinct(), "_at", "left_semi").drop("_at")


def in_box(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return points.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))
