"""More queries over whole tables, with SQL: rules of classification, addresses, streets, bands, areas, districts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, geometry, text
from ..operators import addresses, audit, bands, graph, spatial, streets
from . import catalog as base
from . import scan, village
from .catalog import _CLASS_SQL, _DIST, _FOOTPRINT_SQL, _OBJECT_SQL, _POINTS_SQL, _RINGS_SQL, _STREETS_SQL, _apart, _objects, _parts_sql, _points, _query, _rings, _streets, _t, _units

# Classification.


@_query(f"""
WITH c AS (SELECT id, {_CLASS_SQL} AS k, building FROM ({_OBJECT_SQL}) o)
SELECT id, coalesce(building = 'apartments' AND k = 'confirmed_residential', false) AS apartment, k IN ('confirmed_residential', 'probable_residential') AS anchor, k = 'confirmed_residential' AS customer FROM c""")
def apartments(spark, d):
    k = classify.classify_building(F.col("tags"))
    return _objects(spark, d).select("id", classify.is_apartment(F.col("tags")).alias("apartment"), classify.is_anchor(k).alias("anchor"), classify.is_customer(k).alias("customer"))


@_query(f"""
SELECT id, coalesce(amenity IN ('restaurant', 'school', 'cafe'), false) OR coalesce(shop IN ('bakery', 'kiosk'), false) AS listed,
 (coalesce(amenity IN ('restaurant', 'school', 'cafe'), false) OR coalesce(shop IN ('bakery', 'kiosk'), false)) AND coalesce(name, '') <> '' AS poi,
 CASE WHEN v AND coalesce(name, '') <> '' THEN 'kept' WHEN v THEN 'unnamed_venue' WHEN amenity = 'bar' THEN 'no_takeaway_or_delivery' END AS venue
FROM (SELECT *, coalesce(amenity IN ('restaurant', 'cafe'), false) OR (coalesce(takeaway IN ('yes', 'only'), false) AND (amenity IS NOT NULL OR shop IS NOT NULL)) AS v FROM ({_OBJECT_SQL}) o) x""")
def venues(spark, d):
    t = F.col("tags")
    return _objects(spark, d).select("id", classify.is_whitelisted_poi(t, need_name=False).alias("listed"), classify.is_whitelisted_poi(t).alias("poi"), classify.food_venue(t).alias("venue"))


_STREET_ROWS = "SELECT l_suppkey AS street, count(*) % 9 AS near, count(DISTINCT l_orderkey) % 5 AS addressed, l_suppkey % 2 = 0 AS access FROM lineitem GROUP BY l_suppkey"


@_query(f"""
SELECT street, near >= 6 OR addressed >= 3 OR access AS relevant, CASE WHEN near >= 6 THEN 'dense_residential_buildings' WHEN addressed >= 3 THEN 'addressed_buildings' WHEN access THEN 'required_access_road' END AS reason FROM ({_STREET_ROWS}) s""")
def relevant_streets(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    s = spark.sql(_STREET_ROWS)
    return s.select("street", classify.street_is_relevant(F.col("near"), F.col("addressed"), F.col("access")).alias("r")).select("street", "r.*")


_TIER = "CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END"
_KIND = "CASE o_orderkey % 3 WHEN 0 THEN 'address' WHEN 1 THEN 'building_addressed' ELSE 'building_unaddressed' END"


@_query(f"""
SELECT o_orderkey, round((CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.3 ELSE 0.0 END::DOUBLE) * (CASE kind WHEN 'building_unaddressed' THEN 0.5 ELSE 1.0 END::DOUBLE), 4) AS weight,
 coalesce(tier IN ('A', 'B'), false) AS serviceable, CASE tier WHEN 'A' THEN 'standard' WHEN 'B' THEN 'low_density' WHEN 'C' THEN 'no_delivery' ELSE 'manual_review' END AS status,
 coalesce(tier IN ('A', 'B'), false) AS pricing FROM (SELECT o_orderkey, {_TIER} AS tier, {_KIND} AS kind FROM orders) o""")
def unit_weights(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.expr(_TIER).alias("tier"), F.expr(_KIND).alias("kind"))
    t = F.col("tier")
    return o.select("o_orderkey", classify.unit_weight(t, F.col("kind")).alias("weight"), classify.is_serviceable(t).alias("serviceable"), classify.service_status(t).alias("status"), classify.affects_pricing(t).alias("pricing"))


_STEMS = "SELECT DISTINCT p_brand AS territory, substr(p_name, 1, 4) AS stem FROM part WHERE p_size < 4"


@_query(f"""
WITH s AS ({_STEMS}), st AS (SELECT p_partkey AS id, p_brand AS territory, upper(p_name) AS ru, p_type AS name FROM part)
SELECT id, EXISTS (SELECT 1 FROM s WHERE s.territory = st.territory AND contains(lower(concat_ws(' ', ru, name)), lower(stem))) AS external FROM st""")
def external_evidence(spark, d):
    _t(spark, d, "part").createOrReplaceTempView("part")
    st = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("territory"), F.upper("p_name").alias("ru"), F.col("p_type").alias("name"))
    return addresses.evidence(st, spark.sql(_STEMS), "territory", F.col("ru"), F.col("name")).select("id", "external")


@_query("""
WITH n AS (SELECT s_suppkey AS id, s_suppkey % 7 <> 0 AS found, CASE WHEN s_suppkey % 3 = 0 THEN 'route' WHEN s_suppkey % 3 = 1 THEN 'boundary' END AS t, CASE WHEN s_suppkey % 5 <> 0 THEN 'administrative' END AS b,
 CASE s_suppkey % 4 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN '4' END AS l, CASE WHEN s_suppkey % 6 <> 0 THEN s_name END AS name FROM supplier)
SELECT id, CASE WHEN NOT found THEN concat('relation ', id, ' not present in this PBF extract') ELSE concat_ws('; ',
 CASE WHEN coalesce(t, '') <> 'boundary' THEN concat('unexpected type=', CASE WHEN t IS NULL THEN 'None' ELSE concat('''', t, '''') END, ' (expected ''boundary'')') END,
 CASE WHEN b IS NULL THEN 'unexpected boundary=None (expected ''administrative'')' END, CASE WHEN l IS NULL THEN 'missing admin_level tag' END,
 CASE WHEN l = '4' THEN 'admin_level=''4'' outside expected set [''8'', ''9'']' END, CASE WHEN name IS NULL THEN 'missing name tag' END) END AS warnings FROM n""")
def relation_checks(spark, d):
    k = F.col("s_suppkey")
    tags = {"type": F.when(k % 3 == 0, "route").when(k % 3 == 1, "boundary"), "boundary": F.when(k % 5 != 0, "administrative"), "admin_level": F.when(k % 4 == 0, "8").when(k % 4 == 1, "9").when(k % 4 == 2, "4"), "name": F.when(k % 6 != 0, F.col("s_name"))}
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in tags.items()]), lambda e: e["v"].isNotNull())
    rows = _t(spark, d, "supplier").select(k.alias("id"), (k % 7 != 0).alias("found"), F.map_from_entries(entries).alias("tags"))
    return rows.select("id", F.array_join(classify.relation_warnings(F.col("id"), F.col("found"), F.col("tags"), ["8", "9"]), "; ").alias("warnings"))


@_query("""
SELECT n_nationkey AS id, CASE WHEN n_name IN ('NATION_1', 'NATION_2') THEN 'East' WHEN n_name = 'NATION_3' THEN 'West' END AS settlement, CASE n_name WHEN 'NATION_1' THEN 'Old' WHEN 'NATION_2' THEN 'New' END AS district FROM nation""")
def settlement_of(spark, d):
    table = {"NATION_1": ("East", "Old"), "NATION_2": ("East", "New"), "NATION_3": ("West", None)}
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), classify.district_of(F.col("n_name"), table).alias("p")).select("id", "p.*")


# Addresses. Customers are units with a place.

_UNIT = """SELECT c_custkey AS uid, CASE WHEN c_custkey % 11 <> 0 THEN r_name END AS settlement, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS district,
 CASE WHEN c_custkey % 9 <> 0 THEN concat(' ', c_mktsegment, '  ', CAST(c_custkey % 40 AS VARCHAR(9))) END AS street, CASE WHEN c_custkey % 7 <> 0 THEN concat(CAST(c_custkey % 60 AS VARCHAR(9)), CASE WHEN c_custkey % 5 = 0 THEN 'A' ELSE '' END) END AS housenumber,
 c_acctbal AS cost, CAST(c_nationkey AS DOUBLE) / 1000 AS lon, CAST(c_custkey % 50 AS DOUBLE) / 10000 AS lat FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""
_NORM = "lower(trim(regexp_replace({}, '[\\x09-\\x0D\\x20]+', ' ', 'g')))"
_UNIT_SQL = f"SELECT *, coalesce({_NORM.format('street')}, '') AS sn, coalesce(lower(housenumber), '') AS hn, coalesce(lower(settlement), '') AS pn, coalesce(lower(district), '') AS dn FROM ({_UNIT}) u0"


def _places(spark: SparkSession, d: str) -> DataFrame:
    for t in ("customer", "nation", "region"):
        _t(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(_UNIT)


@_query(f"""
WITH u AS ({_UNIT_SQL})
SELECT uid, CASE WHEN pn <> '' AND sn <> '' AND hn <> '' THEN concat_ws('|', pn, dn, sn, hn) END AS key4, CASE WHEN pn <> '' AND sn <> '' AND hn <> '' THEN concat_ws('|', pn, CASE WHEN uid % 2 = 0 THEN dn ELSE '' END, sn, hn) END AS key_needed,
 CASE WHEN pn <> '' AND sn <> '' AND hn <> '' THEN concat_ws('|', pn, sn, hn) END AS key3, CASE WHEN street IS NULL THEN '' WHEN coalesce(district, '') = '' THEN trim(street) ELSE concat(trim(street), ' (', district, ')') END AS display,
 concat(concat_ws(', ', settlement, district, trim(street)), CASE WHEN hn <> '' THEN concat(', дом ', housenumber) ELSE '' END) AS full_address,
 CASE WHEN hn <> '' AND sn <> '' THEN 'verified_osm_address' WHEN hn <> '' THEN 'osm_housenumber_without_street' ELSE 'unaddressed_delivery_unit' END AS status FROM u""")
def address_forms(spark, d):
    s, dd, t, n = (F.col(c) for c in ("settlement", "district", "street", "housenumber"))
    u = _places(spark, d)
    return u.select("uid", text.canonical_key(s, t, n, dd).alias("key4"), text.canonical_key(s, t, n, dd, F.col("uid") % 2 == 0).alias("key_needed"), text.canonical_key_short(s, t, n).alias("key3"),
                    text.display_address(t, dd).alias("display"), text.full_address(s, dd, t, n).alias("full_address"), text.address_status(t, n).alias("status"))


@_query(f"""
WITH u AS ({_UNIT_SQL}) SELECT housenumber, CAST(row_number() OVER (ORDER BY CASE WHEN regexp_matches(housenumber, '[0-9]') THEN CAST(regexp_extract(housenumber, '[0-9]+') AS BIGINT) ELSE 1000000000 END, housenumber) AS INTEGER) AS place
FROM (SELECT DISTINCT coalesce(housenumber, '') AS housenumber FROM u) n""")
def house_order(spark, d):
    """House numbers in natural order, those without digits last: as many as there are different ones."""
    numbers = _places(spark, d).select(F.coalesce("housenumber", F.lit("")).alias("housenumber")).distinct()
    return graph.global_rank(numbers, [text.house_number_order(F.col("housenumber"))], "place").select("housenumber", F.col("place").cast("int").alias("place"))


@_query("""
SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE round((1 - p_retailprice / 7 / (p_size % 5 * 700)) * 100, 2) END AS pct FROM part""")
def reductions(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), text.reduction_pct((F.col("p_size") % 5 * 700).cast("double"), F.col("p_retailprice") / 7).alias("pct"))


@_query(f"SELECT id, round(x * (111320.0::DOUBLE * cos(radians(46.8))), 3) AS mx, round(y * 110540.0::DOUBLE, 3) AS my, round(x, 6) AS lon, round(y, 6) AS lat FROM ({_POINTS_SQL}) p")
def projected(spark, d):
    """To metres and back."""
    p = _points(spark, d)
    x, y = geometry.to_metres(F.col("x") + 29.4, F.col("y") + 46.8, 29.4, 46.8)
    lon, lat = geometry.to_degrees(x, y, 29.4, 46.8)
    return p.select("id", F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"), F.round(lon - 29.4, 6).alias("lon"), F.round(lat - 46.8, 6).alias("lat"))


@_query(f"""
WITH u AS ({_UNIT_SQL}), p AS (SELECT DISTINCT settlement, district, sn FROM u WHERE sn <> ''), k AS (SELECT sn, count(*) AS n, count(DISTINCT coalesce(settlement, '')) AS s FROM p GROUP BY sn)
SELECT DISTINCT sn AS street_norm FROM p JOIN k USING (sn) WHERE n > 1 AND (p.district IS NOT NULL OR (s = 1 AND settlement IS NOT NULL))""")
def district_needed(spark, d):
    return addresses.district_needed(addresses.street_qualifiers(_places(spark, d)))


@_query(f"""
WITH u AS ({_UNIT_SQL}), k AS (SELECT *, CASE WHEN pn <> '' AND sn <> '' AND hn <> '' THEN concat_ws('|', pn, dn, sn, hn) END AS key FROM u),
v AS (SELECT sn, settlement, district, count(key) AS a, count(*) - count(key) AS b FROM k WHERE sn <> '' GROUP BY sn, settlement, district), m AS (SELECT sn, count(*) AS n FROM v GROUP BY sn HAVING count(*) > 1)
SELECT 'repeated' AS list, v.sn AS name, settlement, district, a AS addresses, b AS others FROM v JOIN m USING (sn)
UNION ALL SELECT 'unplaced', CAST(uid AS VARCHAR), street, housenumber, 0, 0 FROM u WHERE pn = ''
UNION ALL SELECT 'conflict', key, NULL, NULL, count(*), CAST(round(greatest((max(lon) - min(lon)) * 76000, (max(lat) - min(lat)) * 111000)) AS BIGINT) FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1 AND greatest((max(lon) - min(lon)) * 76000, (max(lat) - min(lat)) * 111000) > 150""")
def name_review(spark, d):
    u = _places(spark, d)
    u = u.withColumn("canonical_key", text.canonical_key(*(F.col(c) for c in ("settlement", "street", "housenumber", "district"))))
    repeated, unplaced, conflicts = streets.name_review(u)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    a = repeated.select(F.lit("repeated").alias("list"), F.col("street_norm").alias("name"), "settlement", "district", F.col("address_count").alias("addresses"), F.col("unaddressed_units").alias("others"))
    b = unplaced.select(F.lit("unplaced"), F.col("uid").cast("string"), "street", "housenumber", zero, zero)
    c = conflicts.select(F.lit("conflict"), "canonical_key", none, none, "objects", F.round("spread_m").cast("long"))
    return a.union(b).union(c)


@_query(f"""
WITH u AS ({_UNIT_SQL}), k AS (SELECT *, concat_ws('|', pn, sn, hn) AS key FROM u WHERE pn <> '' AND sn <> '' AND hn <> ''), g AS (SELECT key, greatest((max(lon) - min(lon)) * 76000, (max(lat) - min(lat)) * 111000) AS spread FROM k GROUP BY key)
SELECT key, uid, CAST(row_number() OVER (PARTITION BY key ORDER BY uid) AS INTEGER) AS candidate, round(spread, 3) AS spread_m FROM k JOIN g USING (key) WHERE spread > 150""")
def disputed_ledger(spark, d):
    u = _places(spark, d)
    u = u.select("uid", "lon", "lat", "cost", text.canonical_key_short(F.col("settlement"), F.col("street"), F.col("housenumber")).alias("key"))
    _, disputed, _ = addresses.quarantine(u, "key", "lon", "lat", "cost", 0.05)
    return addresses.disputed_ledger(disputed, "key", "uid").select("key", "uid", "candidate", F.round("spread_m", 3).alias("spread_m"))


@_query("""
WITH b AS (SELECT lower(c_mktsegment) AS sn, CAST(c_custkey % 300 AS VARCHAR) AS number, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE c_nationkey % 4 END AS zone FROM customer),
s AS (SELECT sn, string_agg(DISTINCT CAST(zone AS VARCHAR), ',' ORDER BY CAST(zone AS VARCHAR)) AS zones, count(DISTINCT zone) AS n, min(zone) AS z FROM b GROUP BY 1), e AS (SELECT sn, number, count(DISTINCT zone) AS n, min(zone) AS z FROM b GROUP BY 1, 2),
r AS (SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' WHEN 2 THEN 'furniture' ELSE 'nowhere' END AS sn, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 350 AS VARCHAR) END AS number FROM orders)
SELECT request_id, CASE WHEN e.n = 1 THEN 'exact_address' WHEN s.n = 1 THEN 'street_only' WHEN s.n > 1 THEN 'ambiguous_street' ELSE 'not_found' END AS status, CAST(CASE WHEN e.n = 1 THEN e.z WHEN s.n = 1 THEN s.z END AS INTEGER) AS zone,
 CASE WHEN coalesce(e.n, 0) <> 1 AND s.n > 1 THEN zones END AS candidates FROM r LEFT JOIN s USING (sn) LEFT JOIN e ON e.sn = r.sn AND e.number = r.number""")
def free_text_lookup(spark, d):
    """Zones of addresses as typed: street and number in one text, and the zones to choose from where a street has several."""
    c = _t(spark, d, "customer")
    banded = c.select(F.lower("c_mktsegment").alias("street_norm"), (F.col("c_custkey") % 300).cast("string").alias("number"), F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE c_nationkey % 4 END").alias("zone"))
    k, n = F.col("o_orderkey") % 4, (F.col("o_orderkey") % 350).cast("string")
    street = F.when(k == 0, "BUILDING").when(k == 1, " Machinery").when(k == 2, "furniture ").otherwise("nowhere")
    asked = F.when(F.col("o_orderkey") % 3 == 0, street).when(F.col("o_orderkey") % 3 == 1, F.concat(street, F.lit(", "), n)).otherwise(F.concat(street, F.lit(" "), n))
    out = addresses.free_text_lookup(banded, _t(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), asked.alias("text")))
    return out.withColumn("candidates", F.array_join("candidates", ","))


@_query("""
SELECT coalesce(CASE WHEN p_size % 3 = 0 THEN upper(p_name) END, p_name) AS street, CASE WHEN p_size % 4 = 0 THEN '—' ELSE p_brand END AS place, count(*) AS segments FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'bolt') GROUP BY 1, 2""")
def viewer_search(spark, d):
    p = _t(spark, d, "part").select("p_name", "p_type", F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).alias("ru"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("place"))
    return streets.viewer_search(p, " BOLT ", ["p_name", "ru", "p_type"], ["ru", "p_name"], "place")


# Streets.


@_query("""
WITH s AS (SELECT o_orderkey AS seg, o_custkey AS cust FROM orders), l AS (SELECT c_custkey AS street, c_nationkey % 3 AS tier, c_custkey * 3 + k AS id FROM customer, (SELECT unnest([0, 1, 5]) AS k) x)
SELECT o_orderkey AS id, street, tier FROM orders JOIN l ON l.id = o_orderkey""")
def segment_tiers(spark, d):
    k = F.col("c_custkey") * 3
    lists = F.concat(k.cast("string"), F.lit("; "), (k + 1).cast("string"), F.lit(";;"), (k + 5).cast("string"), F.lit(";x"))
    s = _t(spark, d, "customer").select(F.col("c_custkey").alias("street"), (F.col("c_nationkey") % 3).alias("tier"), lists.alias("osm_ids"))
    return streets.segment_tiers(_t(spark, d, "orders").select(F.col("o_orderkey").alias("id")), s)


_SEG_DIST = "sqrt((x - greatest(sx, least(sx + 60, x))) ** 2 + (y - sy) ** 2)"
_MARK_SQL = f"SELECT o.*, x, y, {_CLASS_SQL} AS k FROM ({_OBJECT_SQL}) o JOIN ({_POINTS_SQL}) p ON p.id = o.id"


def _marks(spark: SparkSession, d: str) -> DataFrame:
    return _objects(spark, d).join(_points(spark, d).select("id", "x", "y"), "id")


@_query(f"""
WITH m AS ({_MARK_SQL}), s AS ({_STREETS_SQL}), h AS (SELECT street_id, m.* FROM m JOIN s ON {_SEG_DIST} <= 60)
SELECT s.street_id AS street, count(*) FILTER (k = 'confirmed_residential') AS confirmed_residential_buildings, count(*) FILTER (k = 'confirmed_residential' AND building = 'apartments') AS apartment_buildings,
 count(*) FILTER (k = 'probable_residential') AS probable_residential_buildings, count(*) FILTER (k = 'non_residential') AS nonresidential_buildings, count(*) FILTER (k = 'outbuilding') AS outbuildings,
 count(*) FILTER (k IN ('abandoned_or_ruin', 'construction')) AS abandoned_or_ruin, count("addr:housenumber") AS confirmed_addresses,
 count(*) FILTER ((amenity IN ('restaurant', 'school', 'cafe') OR shop IN ('bakery', 'kiosk')) AND name IS NOT NULL) AS civic_or_commercial_pois FROM s LEFT JOIN h USING (street_id) GROUP BY s.street_id""")
def street_evidence(spark, d):
    return streets.street_evidence(_streets(spark, d).select(F.col("street_id").alias("street"), "line"), _marks(spark, d))


# Small squares, one for every customer, as the core.
_CORE_SQL = "SELECT c_custkey AS ring_id, c_acctbal / 12 - 400 AS cx, CAST(c_custkey * 17 % 600 - 300 AS DOUBLE) AS cy, 3.0::DOUBLE AS h FROM customer"


def _core(spark: SparkSession, d: str) -> DataFrame:
    x, y, h = F.col("c_acctbal") / 12 - 400, (F.col("c_custkey") * 17 % 600 - 300).cast("double"), F.lit(3.0)
    corners = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("ring_id"), F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners]).alias("ring"))


_AWAY = "sqrt(greatest(0, sx - (cx + h), (cx - h) - (sx + 60)) ** 2 + greatest(0, abs(sy - cy) - h) ** 2)"


@_query(f"WITH s AS ({_STREETS_SQL}), c AS ({_CORE_SQL}) SELECT street_id, EXISTS (SELECT 1 FROM c WHERE {_AWAY} <= 20) AS connected FROM s")
def connected_to_core(spark, d):
    return streets.connected_to_core(_streets(spark, d).drop("tier"), _core(spark, d), "street_id", reach=20.0)


@_query(f"WITH s AS ({_STREETS_SQL}), c AS ({_CORE_SQL}) SELECT street_id, c.ring_id FROM s JOIN c ON {_AWAY} = 0")
def lines_through_areas(spark, d):
    return streets.touching_areas(_streets(spark, d), _core(spark, d), "street_id", "ring_id", 0.0, 20.0)


@_query(f"WITH s AS ({_STREETS_SQL}), r AS ({_RINGS_SQL}) SELECT street_id, ring_id FROM s JOIN r ON abs(sx + 30 - cx) + abs(sy - cy) <= h")
def streets_in_areas(spark, d):
    return streets.streets_in_areas(_streets(spark, d), _rings(spark, d), "street_id", "ring_id", 50, "abs(line[0].x + 30 - cx) + abs(y - cy) <= h", each=True)


_TIERED = "SELECT street, near % 3 AS confirmed_residential_buildings, addressed % 2 AS probable_residential_buildings, CASE WHEN near < 3 THEN 'C' ELSE 'A' END AS tier, access AS connected FROM (" + _STREET_ROWS + ") s"


@_query(f"SELECT * FROM (SELECT street, tier = 'C' AND NOT connected AS is_fringe, confirmed_residential_buildings + probable_residential_buildings BETWEEN 1 AND 2 AS is_thin FROM ({_TIERED}) t) f WHERE is_fringe OR is_thin")
def review_lists(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return streets.review_lists(spark.sql(_TIERED)).select("street", "is_fringe", "is_thin")


@_query(f"SELECT count(*) FILTER (tier <> 'C') AS unique_streets, count(*) FILTER (tier <> 'C' AND street_id % 3 = 0) AS named_ru, count(*) FILTER (tier <> 'C' AND street_id % 3 <> 0) AS needs_ru_review, count(*) FILTER (street_id % 5 = 0) AS needs_review FROM ({_STREETS_SQL}) s")
def street_stats(spark, d):
    k = F.col("street_id")
    rows = _streets(spark, d).select((F.col("tier") != "C").alias("is_address"), F.when(k % 3 == 0, "ok").otherwise("needs_ru_review").alias("status"), (k % 5 == 0).alias("review"))
    return audit.street_stats(rows)


@_query("""
WITH l AS (SELECT s_suppkey AS k, s_suppkey % 6 <> 0 AS joined FROM supplier), g AS (SELECT k, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (ORDER BY k) AS run FROM l)
SELECT k, min(k) OVER (PARTITION BY run) AS part FROM g""")
def merged_lines(spark, d):
    """Lines in a chain: each begins where the one before ends, but every sixth stands apart."""
    k = F.col("s_suppkey").cast("double")
    y = F.floor(F.col("s_suppkey") / 6) * 100.0
    line = F.array(F.struct((k * 10).alias("x"), y.alias("y")), F.struct((k * 10 + 10).alias("x"), y.alias("y")))
    return graph.merge_lines(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), line.alias("line")), "k")


# Bands.


@_query("SELECT uid, round(CASE WHEN other IS NULL THEN central ELSE central * 0.85::DOUBLE + other * (1 - 0.85::DOUBLE) END, 6) AS cost FROM (SELECT c_custkey AS uid, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS central, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey * 100 AS DOUBLE) END AS other FROM customer) c")
def fixed_mix(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")).alias("central"), F.when(F.col("c_custkey") % 5 != 0, (F.col("c_nationkey") * 100).cast("double")).alias("other"))
    return c.select("uid", F.round(bands.fixed_mix(F.col("central"), F.col("other")), 6).alias("cost"))


@_query("SELECT t AS unit_type, count(o_orderkey) AS n FROM (SELECT unnest(['1-URGENT', '2-HIGH', 'no such type']) AS t) w LEFT JOIN orders ON o_orderpriority = t GROUP BY t")
def unit_types(spark, d):
    return audit.summarise(_t(spark, d, "orders").select(F.col("o_orderpriority").alias("unit_type")), ["1-URGENT", "2-HIGH", "no such type"])


_SHARES = "SELECT least(CAST(floor(o_totalprice / 100000) AS INTEGER), 3) AS band, count(*) AS n FROM orders GROUP BY 1"


@_query(f"""
WITH b AS ({_SHARES}), s AS (SELECT n / sum(n) OVER () AS share FROM b), c AS (SELECT 5 - count(*) AS empty, min(share) AS lo, max(share) AS hi FROM s)
SELECT round(CASE WHEN empty > 0 THEN 0 ELSE lo END, 6) AS min_share, round(hi, 6) AS max_share, round(CASE WHEN empty > 0 THEN 0 ELSE lo / hi END, 6) AS balance, empty FROM c""")
def band_balance(spark, d):
    """Of five bands, of which the prices fill some."""
    b = _t(spark, d, "orders").groupBy(F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(3)).alias("band")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    out = bands.band_balance(audit.window_share(b, "n").withColumnRenamed("share", "weight_share"), 5)
    return out.select(*[F.round(c, 6).alias(c) for c in ("min_share", "max_share", "balance")], "empty")


@_query("""
SELECT o_orderkey AS uid, o_custkey AS street, reason FROM (SELECT *, unnest(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'tier_c' END, CASE WHEN o_custkey % 3 = 0 THEN 'outside_area' END, CASE WHEN o_totalprice < 20000 THEN 'unreachable' END], lambda x: x IS NOT NULL)) AS reason FROM orders) o""")
def exceptions(spark, d):
    o = _t(spark, d, "orders").withColumns({"uid": F.col("o_orderkey"), "street": F.col("o_custkey")})
    return audit.exceptions({"tier_c": o.filter("o_orderstatus = 'F'"), "outside_area": o.filter("o_custkey % 3 = 0"), "unreachable": o.filter("o_totalprice < 20000")}, ["uid", "street"])


@_query("""
WITH e AS (SELECT o_orderstatus AS model, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS band, max(o_totalprice) AS edge FROM orders GROUP BY 1, 2)
SELECT e.model, round(max(abs(e.edge - b.edge)), 4) AS max_abs_shift FROM e JOIN e b ON b.band = e.band AND b.model = 'F' GROUP BY e.model""")
def edge_shift(spark, d):
    e = _t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("model"), F.substring("o_orderpriority", 1, 1).cast("int").alias("band")).agg(F.max("o_totalprice").alias("edge"))
    return bands.edge_shift(e, e.filter("model = 'F'").select("band", "edge")).withColumn("max_abs_shift", F.round("max_abs_shift", 4))


@_query("""
WITH c AS (SELECT n_regionkey AS k, CAST(count(*) AS DOUBLE) AS n, avg(c_acctbal) AS balance, CAST(max(c_custkey) AS DOUBLE) AS last, 1.0::DOUBLE AS same FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
m AS (SELECT *, (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) AS a, (balance - min(balance) OVER ()) / (max(balance) OVER () - min(balance) OVER ()) AS b, (last - min(last) OVER ()) / (max(last) OVER () - min(last) OVER ()) AS e FROM c)
SELECT k, round(0.4 * a + 0.2 * (1 - b) + 0.3 * e + 0.1, 6) AS score FROM m""")
def composite_score(spark, d):
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    m = c.groupBy(F.col("n_regionkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("c_acctbal").alias("balance"), F.max("c_custkey").cast("double").alias("last"), F.lit(1.0).alias("same"))
    return bands.composite_score(m, {"n": 0.4, "balance": -0.2, "last": 0.3, "same": 0.1}).select("k", F.round("score", 6).alias("score"))


def _bins_of(where: str, weight: str = "weight", name: str = "") -> str:
    """Bins and their sums, as the catalog cuts them, of the units for which a condition holds. Names end in ``name``."""
    w = base._WIDTH
    return f"""raw{name} AS (SELECT CAST(floor(cost / CAST({w} AS DOUBLE)) AS BIGINT) AS bin, sum(cost * ({weight})) AS wx, sum({weight}) AS w FROM u WHERE {where} GROUP BY 1),
b{name} AS (SELECT bin, CASE WHEN w > 0 THEN wx / w ELSE (bin + 0.5) * CAST({w} AS DOUBLE) END AS value, w AS weight FROM raw{name}),
bins{name} AS (SELECT *, row_number() OVER o AS place, sum(weight) OVER o AS w, sum(weight * value) OVER o AS wx, sum(weight * value * value) OVER o AS wxx FROM b{name} WINDOW o AS (ORDER BY bin ROWS UNBOUNDED PRECEDING))"""


_COSTS_SQL = f"u AS (SELECT *, o_custkey % 10 = 0 AS new FROM ({base._UNITS_SQL}) u0)"


def _ends_of(k: int, name: str) -> str:
    ends = " UNION ALL ".join(f"SELECT {i} AS band, end{i + 1} AS p FROM c" for i in range(k))
    return f"SELECT band, value AS edge FROM (WITH c AS ({bands.cuts_sql(k, source=f'bins{name}')}) {ends}) e JOIN bins{name} ON place = p"


@_query(f"""
WITH {_COSTS_SQL}, {_bins_of('NOT new', name='1')}, {_bins_of('true', name='2')}, a AS ({_ends_of(3, '1')}), z AS ({_ends_of(3, '2')})
SELECT band, round(a.edge, 2) AS edge_without, round(z.edge, 2) AS edge_with, round(z.edge - a.edge, 2) AS drift FROM a JOIN z USING (band)""")
def control_drift(spark, d):
    """Edges without and with the units of every tenth customer."""
    u = _units(spark, d).select("o_custkey", F.col("cost").alias("value"), "weight")
    out = bands.control_drift(u.filter("o_custkey % 10 <> 0").drop("o_custkey"), u.filter("o_custkey % 10 = 0").drop("o_custkey"), 3, base._WIDTH)
    return out.select("band", *[F.round(c, 2).alias(c) for c in ("edge_without", "edge_with", "drift")])


_MODELS = {"tiers": "weight", "even": "1.0::DOUBLE", "flats": "weight * (1 + o_custkey % 3)"}


@_query(f"WITH {_COSTS_SQL}, " + ", ".join(_bins_of("true", w, m) for m, w in _MODELS.items()) + " " + " UNION ALL ".join(f"SELECT '{m}' AS model, {k} AS k, band, round(edge, 2) AS edge FROM ({_ends_of(k, m)}) x" for m in _MODELS for k in (2, 3)))
def model_sweep(spark, d):
    """Bands under three models of the units' weight, for several k."""
    w = F.col("weight")
    models = {"tiers": w, "even": F.lit(1.0), "flats": w * (1 + F.col("o_custkey") % 3)}
    return bands.model_sweep(_units(spark, d), "cost", models, base._WIDTH, [2, 3]).select("model", "k", "band", F.round("edge", 2).alias("edge"))


# Sets and lists.


@_query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_units(spark, d):
    return audit.top(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), 10, F.col("c_acctbal").desc(), F.col("c_custkey"))


@_query("SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)")
def units_without_orders(spark, d):
    orders = _t(spark, d, "orders").filter("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("k"))
    return audit.difference(_t(spark, d, "customer").select(F.col("c_custkey").alias("k")).unionByName(orders).distinct(), orders, ["k"])


@_query("SELECT 'disjoint' AS lists, NOT EXISTS (SELECT 1 FROM nation JOIN region ON n_name = r_name) AS disjoint UNION ALL SELECT 'shared', NOT EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey)")
def disjoint_lists(spark, d):
    one = lambda t, c: _t(spark, d, t).select(F.col(c).cast("string").alias("k"))
    first, second = audit.disjoint(one("nation", "n_name"), one("region", "r_name")), audit.disjoint(one("orders", "o_custkey"), one("customer", "c_custkey"))
    return first.select(F.lit("disjoint").alias("lists"), "disjoint").unionByName(second.select(F.lit("shared").alias("lists"), "disjoint"))


@_query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def source_boundaries(spark, d):
    rows = _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return village.source_boundaries(rows, _t(spark, d, "supplier").select(F.col("s_nationkey").alias("id")))


# Clusters and areas.

_CLUSTER_SQL = f"""p AS ({_POINTS_SQL}), e AS (SELECT p.id AS a, q.id AS b FROM p JOIN p q ON p.id <> q.id AND {_DIST} <= 12),
lab(node, root) USING KEY (node) AS (SELECT id, id FROM p UNION SELECT e.b, min(l.root) FROM lab l JOIN e ON e.a = l.node JOIN recurring.lab k ON k.node = e.b WHERE l.root < k.root GROUP BY e.b)"""


@_query(f"WITH RECURSIVE {_CLUSTER_SQL}, c AS (SELECT root AS cluster, count(*) AS n FROM lab GROUP BY root) SELECT cluster, n, row_number() OVER (ORDER BY n DESC, cluster) AS nth, n >= 5 AS is_dense FROM c")
def ordered_clusters(spark, d):
    return graph.ordered_clusters(_points(spark, d), "id", 12)


@_query(f"""
WITH RECURSIVE {_CLUSTER_SQL}, c AS (SELECT root AS cluster, avg(x) AS x, avg(y) AS y, count(*) AS n FROM lab JOIN p ON p.id = node GROUP BY root), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, cluster) AS nth FROM c),
k AS (SELECT * FROM r WHERE nth = 1 OR n >= 3), b AS (SELECT arg_min(nth, struct_pack(d := sqrt(x * x + y * y), n := nth)) AS nth FROM k WHERE nth > 1)
SELECT cluster, CASE WHEN k.nth = 1 THEN 'central' WHEN k.nth = b.nth THEN 'bam' ELSE 'outer_other' END AS role, round(x, 4) AS x, round(y, 4) AS y, CASE WHEN k.nth > 1 THEN round(0.15::DOUBLE * n / (SELECT sum(n) FROM k WHERE nth > 1), 6) WHEN b.nth IS NULL THEN 1.0 ELSE 0.85 END AS weight, n FROM k LEFT JOIN b ON true""")
def delivery_origins(spark, d):
    out = graph.delivery_origins(_points(spark, d), "id", 12, 0.15, (0.0, 0.0))
    return out.withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


_CELLS = "SELECT DISTINCT cx, cy FROM grid JOIN p ON id % 2 = {} AND sqrt(((cx + 0.5) * 10 - x) ** 2 + ((cy + 0.5) * 10 - y) ** 2) <= 15"


@_query(f"""
WITH {_FOOTPRINT_SQL}, a AS ({_CELLS.format(0)}), b AS ({_CELLS.format(1)})
SELECT 'intersection' AS how, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) * 100.0::DOUBLE AS area UNION ALL SELECT 'difference', (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) * 100.0::DOUBLE
UNION ALL SELECT 'union', (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) * 100.0::DOUBLE""")
def overlays(spark, d):
    p = _points(spark, d)
    a, b = (spatial.disc_cells(p.filter(F.col("id") % 2 == i), 15, 10) for i in (0, 1))
    out = None
    for how in ("intersection", "difference", "union"):
        own = spatial.area_of(spatial.overlay(a, b, how), 10).select(F.lit(how).alias("how"), "area")
        out = own if out is None else out.unionByName(own)
    return out


@_query(f"""
WITH {_FOOTPRINT_SQL}, c AS (SELECT cx, cy, (cx + 0.5) * 10 AS x, (cy + 0.5) * 10 AS y FROM disc), s AS (SELECT bool_or(2 * y - 3 * x < 0) AND bool_or(2 * y - 3 * x > 0) AS applied FROM c)
SELECT count(*) FILTER (2 * y - 3 * x > 0) AS left_cells, bool_and(applied) AS applied, count(*) FILTER (y < 33) AS not_north, count(*) FILTER (y >= 33) AS north, count(*) FILTER (x > -12) AS not_west, count(*) FILTER (x <= -12) AS west,
 count(*) AS whole FROM c CROSS JOIN s""")
def clipped_areas(spark, d):
    """One row: what a line leaves on the side of a point, what two directions keep and take off, and an area that a far line
    does not divide."""
    c = spatial.disc_cells(_points(spark, d), 12, 10)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    left = spatial.clip_to_side(c, [(0.0, 0.0), (2.0, 3.0)], (-5.0, 5.0), 10)
    out = left.agg(F.count(F.lit(1)).alias("left_cells"), F.bool_and("applied").alias("applied"))
    for direction, x, y in (("north", 0.0, 33.0), ("west", -12.0, 0.0)):
        kept, removed = spatial.clip_direction(c, x, y, direction, 10)
        out = out.crossJoin(count(kept, f"not_{direction}")).crossJoin(count(removed, direction))  # one row each
    return out.crossJoin(count(spatial.clip_to_side(c, [(9000.0, 0.0), (9000.0, 5.0)], (9500.0, 0.0), 10), "whole"))


_DRAWN = "SELECT cx, cy, arg_min(label % 4, struct_pack(d := d, u := id)) AS band FROM (SELECT cx, cy, id, label, sqrt(((cx + 0.5) * 10 - x) ** 2 + ((cy + 0.5) * 10 - y) ** 2) AS d FROM foot JOIN p ON sqrt(((cx + 0.5) * 10 - x) ** 2 + ((cy + 0.5) * 10 - y) ** 2) <= 9) n GROUP BY cx, cy"


def _footprint(spark: SparkSession, d: str) -> DataFrame:
    return spatial.footprint(_points(spark, d), 12, 10, 10)


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    u = _points(spark, d).select(F.col("id").alias("uid"), "x", "y", (F.col("label") % 4).alias("band"))
    return spatial.draw_bands(_footprint(spark, d), u, 10, 9)


@_query(f"WITH {_FOOTPRINT_SQL} {_DRAWN}")
def drawn_bands(spark, d):
    return _drawn(spark, d)


@_query(f"WITH RECURSIVE {_FOOTPRINT_SQL}, drawn AS ({_DRAWN}), {_parts_sql('SELECT cx, cy FROM foot EXCEPT SELECT cx, cy FROM drawn')} SELECT root AS part, count(*) * 100.0::DOUBLE AS area FROM lab GROUP BY root HAVING count(*) >= 2")
def coverage_gaps(spark, d):
    return spatial.coverage_gaps(_footprint(spark, d), _drawn(spark, d), 10, 200.0)


@_query(f"""
WITH p AS ({_POINTS_SQL}), r AS ({_RINGS_SQL}), h AS (SELECT id, label % 3 AS band, bool_or(ring_id % 3 = label % 3) AS own, count(ring_id) > 0 AS hit FROM p LEFT JOIN r ON abs(x - cx) + abs(y - cy) <= h GROUP BY id, label)
SELECT count(*) FILTER (hit AND own) AS own, count(*) FILTER (hit AND NOT own) AS other, count(*) FILTER (NOT hit) AS none FROM h""")
def verified_zones(spark, d):
    u = _points(spark, d).withColumns({"band": F.col("label") % 3, "_unit": F.struct("id", "label")})
    zones = _apart(_rings(spark, d)).select(F.col("ring_id").alias("shape"), (F.col("ring_id.ring_id") % 3).cast("int").alias("zone"), "ring", "cx", "cy", "h")
    return spatial.verify_zones(u, zones, "_unit", 50, base._HELD)


# Districts.


@_query(f"WITH {_FOOTPRINT_SQL}, b AS (SELECT DISTINCT CAST(floor(x / 10) AS BIGINT) AS cx, CAST(floor(y / 10) AS BIGINT) AS cy FROM p) SELECT round(100.0 * count(*) FILTER (b.cx IS NULL) / count(*), 1) AS empty_pct FROM foot LEFT JOIN b USING (cx, cy)")
def empty_share(spark, d):
    p = _points(spark, d)
    built = p.select(F.floor(F.col("x") / 10).alias("cx"), F.floor(F.col("y") / 10).alias("cy"))
    return village.empty_share(_footprint(spark, d), built)


@_query(f"""
WITH p AS ({_POINTS_SQL}), g AS (SELECT unnest(generate_series(-70, 70)) AS cx), grid AS (SELECT a.cx, b.cx AS cy FROM g a CROSS JOIN g b), home AS (SELECT * FROM p WHERE sqrt((x - 40) ** 2 + (y + 30) ** 2) <= 150)
SELECT DISTINCT cx, cy FROM grid JOIN home ON sqrt(((cx + 0.5) * 10 - x) ** 2 + ((cy + 0.5) * 10 - y) ** 2) <= 22""")
def village_footprint(spark, d):
    """Without closing, so that the area is the union of discs."""
    return village.village_footprint(_points(spark, d), (40.0, -30.0), 10, near=150.0, closing=0.0)


@_query(f"""
WITH p AS ({_POINTS_SQL}), r AS ({_RINGS_SQL}), near AS (SELECT id, x, y, label FROM p WHERE sqrt((x - 10) ** 2 + (y - 20) ** 2) <= 200)
SELECT id, CASE WHEN label = 4 THEN 'listed_street' WHEN EXISTS (SELECT 1 FROM r WHERE ring_id % 2 = 0 AND abs(near.x - cx) + abs(near.y - cy) <= h) THEN 'other_area' WHEN EXISTS (SELECT 1 FROM r WHERE ring_id % 2 = 1 AND abs(near.x - cx) + abs(near.y - cy) <= h) THEN 'served' ELSE 'new' END AS outcome FROM near""")
def new_units(spark, d):
    homes = _points(spark, d).withColumn("street_norm", F.concat(F.lit("street "), F.col("label").cast("string")))
    r = _rings(spark, d).drop("nth")
    return village.select_new(homes, (10.0, 20.0), 200.0, ["street 4"], _apart(r.filter("ring_id % 2 = 0")), _apart(r.filter("ring_id % 2 = 1")), 50, settle=base._HELD).select("id", "outcome")


# Distances of customers from two origins, by role; every thirteenth has none from the centre.
_LEGS = "SELECT c_custkey AS uid, 'central' AS role, c_acctbal / 1003 AS km, c_acctbal / 500 AS min FROM customer WHERE c_custkey % 13 <> 0 UNION ALL SELECT c_custkey, 'bam', CAST(c_nationkey AS DOUBLE), CAST(c_nationkey * 2 AS DOUBLE) FROM customer WHERE c_custkey % 5 <> 0"
_EDGES = [2.0, 4.0, 6.0, 8.0]
_DISTRICT_SQL = f"""u AS ({_UNIT_SQL}), m AS ({_LEGS}), w AS (SELECT uid, max(km) FILTER (role = 'central') AS c, max(km) FILTER (role = 'bam') AS b FROM m GROUP BY uid),
e AS (SELECT u.*, c IS NOT NULL AS reachable, CASE WHEN b IS NULL THEN c ELSE c * 0.85::DOUBLE + b * (1 - 0.85::DOUBLE) END AS km FROM u LEFT JOIN w USING (uid)),
z AS (SELECT *, CASE WHEN NOT reachable THEN NULL WHEN km <= 2 THEN 1 WHEN km <= 4 THEN 2 WHEN km <= 6 THEN 3 ELSE 4 END AS zone, CASE WHEN hn <> '' AND sn <> '' THEN 'v' WHEN hn <> '' THEN 'h' ELSE 'n' END AS s FROM e)"""


def _district(spark: SparkSession, d: str) -> DataFrame:
    legs = (_places(spark, d), spark.sql(_LEGS))
    return village.district_units(legs[0], legs[1].withColumn("route", F.lit(None).cast("array<struct<x:double,y:double>>")), _EDGES, "v1")


@_query(f"WITH {_DISTRICT_SQL} SELECT uid, reachable, round(km, 4) AS expected_km, zone, CASE WHEN pn <> '' AND sn <> '' AND hn <> '' THEN concat_ws('|', pn, dn, sn, hn) END AS canonical_key FROM z")
def district_units(spark, d):
    return _district(spark, d).select("uid", "reachable", F.round("expected_km", 4).alias("expected_km"), "zone", "canonical_key")


@_query(f"WITH {_DISTRICT_SQL} SELECT CAST(k AS INTEGER) AS zone, count(uid) FILTER (reachable) AS units, count(uid) FILTER (reachable AND s = 'v') AS addresses FROM (SELECT unnest(generate_series(1, 5)) AS k) w LEFT JOIN z ON zone = k GROUP BY k")
def units_per_zone(spark, d):
    return village.per_zone(_district(spark, d), 5, F.col("address_status") == "verified_osm_address")


@_query(f"""WITH {_DISTRICT_SQL} SELECT count(*) AS units_total, count(*) FILTER (reachable AND km IS NOT NULL) AS units_reachable, count(*) FILTER (NOT reachable) AS unreachable, count(*) FILTER (s = 'v') AS verified_osm_addresses,
 count(*) FILTER (s = 'h') AS osm_housenumber_without_street, count(*) FILTER (s = 'n') AS unaddressed_delivery_units, 0 AS through_village FROM z""")
def readiness(spark, d):
    return village.readiness(_district(spark, d))


@_query(f"WITH {_DISTRICT_SQL} SELECT count(*) FILTER (reachable AND km > 8) AS units_beyond_current_max, round(max(km) FILTER (reachable AND km > 8), 3) AS extended_to_km FROM z")
def scenario_keep_edges(spark, d):
    return village.scenario_keep_edges(_district(spark, d), _EDGES[-1])


@_query(f"""
WITH {_FOOTPRINT_SQL}, a AS ({_CELLS.format(0)}), v AS (SELECT * FROM a WHERE cy < -5), f AS (SELECT * FROM disc WHERE cy > -5)
SELECT (SELECT min(cy) FROM f) > (SELECT max(cy) FROM v) AS north_of_village, EXISTS (SELECT 1 FROM f JOIN v USING (cx, cy)) AS meets_village, NOT EXISTS (SELECT 1 FROM f JOIN a USING (cx, cy)) AS apart_from_service""")
def verification(spark, d):
    p = _points(spark, d)
    service = spatial.disc_cells(p.filter("id % 2 = 0"), 15, 10)
    return village.verification(spatial.disc_cells(p, 12, 10).filter("cy > -5"), service.filter("cy < -5"), service, 10)


_SUBURB_SQL = f"SELECT id, x, y FROM ({_POINTS_SQL}) p WHERE id % 10 = 0"


@_query(f"""
WITH s AS ({_SUBURB_SQL}), c AS ({_CORE_SQL}), q AS (SELECT id, min(sqrt(greatest(0, abs(x - cx) - h) ** 2 + greatest(0, abs(y - cy) - h) ** 2)) AS away FROM s CROSS JOIN c GROUP BY id), p AS ({_POINTS_SQL}),
n AS (SELECT s.id, count(p.id) AS n FROM s LEFT JOIN p ON p.id % 10 <> 0 AND sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) <= 30 GROUP BY s.id)
SELECT id, CAST(id AS VARCHAR) AS name, coalesce(away = 0, false) AS covered, round(away) AS distance_m, n AS addresses_near, CASE WHEN id % 20 = 0 THEN round(id / 1000, 3) END AS road_km, CASE WHEN id % 20 = 0 THEN round(id / 60, 2) END AS road_min,
 CASE WHEN away = 0 THEN 'connected' ELSE 'disconnected' END AS status FROM s LEFT JOIN q USING (id) JOIN n USING (id)""")
def district_coverage(spark, d):
    p = _points(spark, d)
    places = p.filter("id % 10 = 0").select("id", F.col("id").cast("string").alias("name"), "x", "y")
    roads = places.filter("id % 20 = 0").select("id", F.col("id").cast("double").alias("dist_m"), F.col("id").cast("double").alias("dur_s"))
    return village.district_coverage(places, _core(spark, d), p.filter("id % 10 <> 0").select("id", "x", "y"), roads, 50, 30.0)


# Map objects in one scan. Parts are objects; a way has as many places as its size says.


def _ways(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    coords = F.transform(F.sequence(F.lit(1), F.pmod(k, F.lit(7)) + 1), lambda i: F.struct((k / 1000 + i).alias("lon"), (i * i + F.lit(0.0)).alias("lat")))
    return _objects(spark, d).filter("kind = 'w'").withColumn("coords", coords)


@_query(f"""
WITH o AS ({_OBJECT_SQL}), r AS (SELECT *, coalesce(trim("name:ru"), '') AS ru FROM o WHERE kind = 'w' AND highway IS NOT NULL AND coalesce(name, '') <> '' AND id % 7 + 1 >= 2)
SELECT name, count(*) AS segments, min(id) AS min_id, arg_min(CASE WHEN ru <> '' THEN ru ELSE trim(name) END, id) AS display, arg_min(CASE WHEN ru <> '' THEN 'ok' ELSE 'needs_ru_review' END, id) AS status,
 (SELECT count(building) FROM o) AS buildings, (SELECT count("addr:housenumber") FROM o) AS address_objects FROM r GROUP BY name""")
def city_streets(spark, d):
    found = scan.city(_objects(spark, d), _ways(spark, d), "x")
    return found["streets"].crossJoin(F.broadcast(found["counts"])).select("name", "segments", "min_id", "display", "status", "buildings", "address_objects")  # counts: one row


@_query(f"""
WITH o AS ({_OBJECT_SQL}), k AS (SELECT *, {_CLASS_SQL} AS c FROM o)
SELECT count(*) FILTER (building IS NOT NULL AND (kind = 'n' OR (kind = 'w' AND id % 7 + 1 >= 4))) AS raw_buildings, count("addr:housenumber") AS raw_address_objects,
 count(*) FILTER (building = 'apartments' AND c = 'confirmed_residential' AND (kind = 'n' OR (kind = 'w' AND id % 7 + 1 >= 4))) AS apartments FROM k""")
def raw_counts(spark, d):
    return scan.raw_counts(_objects(spark, d), _ways(spark, d))


@_query(f"""
WITH s AS ({_STREETS_SQL}) SELECT street_id, sx - 25 AS x1, sx + 85 AS x2, sy AS y1, sy AS y2, CAST(4 AS INTEGER) AS points FROM s""")
def extended_lines(spark, d):
    line = geometry.extend_line(F.col("line"), 25.0)
    at = lambda i, c: F.element_at("longer", i)[c]
    s = _streets(spark, d).select("street_id", line.alias("longer"))
    return s.select("street_id", at(1, "x").alias("x1"), at(-1, "x").alias("x2"), at(1, "y").alias("y1"), at(-1, "y").alias("y2"), F.size("longer").alias("points"))


_ZONED = """SELECT o_totalprice AS km, sqrt(o_totalprice) AS minutes, CAST(1 + o_orderkey % 3 AS DOUBLE) AS weight, CASE WHEN o_custkey % 50 > 0 THEN concat('street ', CAST(o_custkey % 50 AS VARCHAR(10))) END AS street,
 o_orderkey % 4 > 0 AS addressed, CAST(CASE WHEN o_totalprice <= 60000 THEN 0 WHEN o_totalprice <= 150000 THEN 1 WHEN o_totalprice <= 250000 THEN 2 ELSE 3 END AS INTEGER) AS band FROM orders"""


@_query(f"""
WITH z AS ({_ZONED}),
r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY km) - 1 AS i, row_number() OVER (PARTITION BY band ORDER BY minutes) - 1 AS j, count(*) OVER (PARTITION BY band) AS n, sum(weight) OVER () AS total, sum(km * weight) OVER (PARTITION BY band) / sum(weight) OVER (PARTITION BY band) AS mean FROM z)
SELECT band, count(*) AS units, sum(weight) AS weight, min(km) AS min_value, max(km) AS max_value, round(sum(weight) / max(total), 6) AS weight_share, round(sqrt(sum(weight * (km - mean) * (km - mean)) / sum(weight)), 3) AS dispersion,
 max(CASE WHEN i = least(floor(n * 50 / 100), n - 1) THEN km END) AS p50, max(CASE WHEN i = least(floor(n * 75 / 100), n - 1) THEN km END) AS p75, max(CASE WHEN i = least(floor(n * 90 / 100), n - 1) THEN km END) AS p90,
 round(min(minutes), 6) AS minutes_min, round(max(minutes), 6) AS minutes_max, round(max(CASE WHEN j = least(floor(n * 50 / 100), n - 1) THEN minutes END), 6) AS minutes_p50,
 round(max(CASE WHEN j = least(floor(n * 75 / 100), n - 1) THEN minutes END), 6) AS minutes_p75, round(max(CASE WHEN j = least(floor(n * 90 / 100), n - 1) THEN minutes END), 6) AS minutes_p90,
 count(*) FILTER (addressed) AS address_units, array_to_string(list_sort(list(DISTINCT street) FILTER (street IS NOT NULL)), ', ') AS streets FROM r GROUP BY band""")
def zone_summary(spark, d):
    _t(spark, d, "orders").createOrReplaceTempView("orders")
    out, streets = bands.zone_summary(spark.sql(_ZONED), "km", "minutes", "weight", F.col("street"), F.col("addressed"))
    out = out.join(streets.groupBy("band").agg(F.sort_array(F.collect_list("street")).alias("streets")), "band", "left")
    digits = {"weight_share": 6, "dispersion": 3} | {f"minutes_{c}": 6 for c in ("min", "p50", "p75", "p90", "max")}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()}).withColumn("streets", F.array_join("streets", ", "))


@_query(f"WITH z AS ({_ZONED}) SELECT DISTINCT band, street FROM z WHERE street IS NOT NULL")
def zone_streets(spark, d):
    """A row for each street of a band, however many a band has."""
    _t(spark, d, "orders").createOrReplaceTempView("orders")
    return bands.zone_summary(spark.sql(_ZONED), "km", "minutes", "weight", F.col("street"), F.col("addressed"))[1]
