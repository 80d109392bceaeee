"""Classification of tagged map objects and grading of streets, as CASE expressions over a map of tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies of map tags, as results must have them.
STRONG_RESIDENTIAL = ["apartments", "house", "residential", "detached", "semidetached_house", "terrace", "dormitory", "bungalow"]
APARTMENT = ["apartments", "dormitory"]
OUTBUILDING = ["shed", "garage", "garages", "barn", "farm_auxiliary", "greenhouse", "carport", "hut", "cabin", "roof", "stable", "sty", "cowshed", "allotment_house", "shelter"]
NON_RESIDENTIAL = [
    "warehouse", "industrial", "commercial", "retail", "office", "school", "kindergarten", "college", "university", "hospital", "clinic", "church",
    "chapel", "synagogue", "mosque", "temple", "public", "civic", "government", "train_station", "transportation", "hangar", "kiosk", "service", "toilets",
    "fire_station", "sports_hall", "sports_centre", "stadium", "supermarket", "manufacture", "silo", "storage_tank", "water_tower", "bunker", "gatehouse",
    "military", "farm",
]
RUIN = ["ruins", "ruin", "abandoned", "collapsed"]
INTERCITY = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link"]
ADDRESS_ROAD = ["residential", "living_street", "unclassified", "tertiary", "tertiary_link", "secondary", "secondary_link", "road", "pedestrian"]
PATH = ["footway", "path", "cycleway", "steps", "bridleway"]
BRIDGE_WORDS = ["мост", "podul", "bridge"]
STREET_WORDS = [
    "улица", "ул", "переулок", "пер", "бульвар", "бул", "проспект", "пр", "шоссе", "тупик", "площадь", "пл", "проезд", "аллея", "набережная",
    "strada", "str", "stradela", "stradă", "bulevardul", "soseaua", "șoseaua", "street", "road", "alley", "lane",
]
FARMLAND = ["farmland", "farmyard", "orchard", "vineyard", "meadow", "greenhouse_horticulture", "allotments"]
FOREST = ["forest", "wood", "scrub", "grass", "park", "garden", "nature_reserve", "cemetery", "recreation_ground"]
STRONG_FOOD = ["restaurant", "fast_food", "cafe", "food_court"]
CONDITIONAL_FOOD = ["bar", "pub", "ice_cream"]
POI_WHITELIST = {
    "amenity": ["restaurant", "cafe", "fast_food", "food_court", "school", "kindergarten", "hospital", "clinic", "doctors", "pharmacy", "marketplace", "post_office", "bank", "townhall", "community_centre", "library", "college", "university", "veterinary"],
    "shop": ["supermarket", "convenience", "bakery", "butcher", "greengrocer", "general", "department_store", "mall", "kiosk"],
    "tourism": ["hotel", "guest_house", "hostel", "motel"],
}
TIER_WEIGHTS = {"A": 1.0, "B": 0.3, "C": 0.0}
TIER_STATUS = {"A": "standard", "B": "low_density", "C": "no_delivery"}
CONFIDENCE = {"address": 1.0, "building_addressed": 1.0, "building_unaddressed": 0.5}


def truthy(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def classify_building(tags: Column) -> Column:
    """One of seven classes. An address confirms a building=yes, and never rescues a warehouse."""
    b = tags["building"]
    gone = lambda k: F.coalesce(tags[k], F.lit("no")).isin("no", "") == F.lit(False)
    lifecycle = F.exists(F.map_keys(tags), lambda k: k.startswith("abandoned:") | k.startswith("disused:"))
    return (
        F.when(b.isNull(), "unknown")
        .when(lifecycle | gone("abandoned") | gone("disused") | gone("ruins") | b.isin(RUIN), "abandoned_or_ruin")
        .when((b == "construction") | truthy(tags["construction"]), "construction")
        .when(b.isin(OUTBUILDING), "outbuilding")
        .when(b.isin(NON_RESIDENTIAL), "non_residential")
        .when(b.isin(STRONG_RESIDENTIAL), "confirmed_residential")
        .when((b == "yes") & truthy(tags["addr:housenumber"]), "confirmed_residential")
        .when(b == "yes", "probable_residential")
        .otherwise("unknown")
    )


def is_apartment(tags: Column) -> Column:
    """A standing house of flats: neither ruined nor under construction."""
    return F.coalesce(tags["building"].isin(APARTMENT) & is_customer(classify_building(tags)), F.lit(False))


def is_anchor(building_class: Column) -> Column:
    return building_class.isin("confirmed_residential", "probable_residential")


def is_customer(building_class: Column) -> Column:
    return building_class == "confirmed_residential"


def classify_road(tags: Column) -> Column:
    """struct(road_class, is_address, review). The order of the tests is part of the rule."""
    name, way = F.trim(F.coalesce(tags["name"], F.lit(""))), F.coalesce(tags["highway"], F.lit(""))
    low = F.lower(name)
    # Runs of letters; numerals that are no decimal digits count as letters here, as word characters do.
    has_word = F.arrays_overlap(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), F.lit(1)), F.array(*map(F.lit, STREET_WORDS)))
    bridge = F.greatest(*[low.contains(w) for w in BRIDGE_WORDS]) & ~has_word
    informal = name.contains("(") | name.contains(")") | (name.rlike(r"\p{L}") & (name == low))
    case = lambda c, a, r: F.struct(F.lit(c).alias("road_class"), F.lit(a).alias("is_address"), F.lit(r).alias("review"))
    return (
        F.when(bridge, case("bridge", False, False))
        .when(way.isin(INTERCITY), case("intercity", False, False))
        .when(informal, case("informal", False, True))
        .when(way == "service", case("service", False, True))
        .when(way == "track", case("track", False, True))
        .when(way.isin(PATH) & has_word, case("address_street", True, True))
        .when(way.isin(PATH), case("path", False, False))
        .when(way.isin(ADDRESS_ROAD), case("address_street", True, False))
        .otherwise(case("other", False, True))
    )


def land_exclusion(tags: Column) -> Column:
    value = F.coalesce(*[F.when(truthy(tags[k]), tags[k]) for k in ("landuse", "natural", "leisure")], F.lit(""))
    return F.when(value.isin(FARMLAND), "farmland").when(value.isin(FOREST), "forest_or_park").otherwise("empty_land")


def street_is_relevant(near: Column, addressed: Column, has_access: Column, dense: int = 6, few: int = 3) -> Column:
    """struct(relevant, reason)."""
    case = lambda yes, why: F.struct(F.lit(yes).alias("relevant"), F.lit(why).cast("string").alias("reason"))
    return F.when(near >= dense, case(True, "dense_residential_buildings")).when(addressed >= few, case(True, "addressed_buildings")).when(has_access, case(True, "required_access_road")).otherwise(case(False, None))


@dataclass(frozen=True)
class TierThresholds:
    a_addresses: int = 5
    a_residential: int = 8
    b_min: int = 3
    b_max: int = 7
    c_max: int = 2


def assign_tier(confirmed_addresses: Column, residential: Column, apartments: Column, external: Column, pois: Column, connected: Column, t: TierThresholds = TierThresholds()) -> Column:
    """struct(tier, reason) of a street; residential is confirmed and probable buildings together."""
    case = lambda tier, why: F.struct(F.lit(tier).alias("tier"), F.lit(why).alias("reason"))
    return (
        F.when(apartments >= 1, case("A", "apartment_building"))
        .when(confirmed_addresses >= t.a_addresses, case("A", f"confirmed_addresses>={t.a_addresses}"))
        .when(residential >= t.a_residential, case("A", f"residential_buildings>={t.a_residential}"))
        .when(external, case("A", "verified_external_evidence"))
        .when(pois >= 1, case("A", "active_civic_or_commercial_poi"))
        .when(residential.between(t.b_min, t.b_max) & connected, case("B", "low_density_connected_to_core"))
        .when(residential <= t.c_max, case("C", "at_most_2_probable_residences"))
        .otherwise(case("C", "uncertain_or_disconnected_evidence"))
    )


def _lookup(key: Column, table: dict, default) -> Column:
    entries = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*entries)[key], F.lit(default))


def tier_weight(tier: Column, table: dict[str, float] | None = None) -> Column:
    return _lookup(tier, table or TIER_WEIGHTS, 0.0)


def service_status(tier: Column) -> Column:
    return _lookup(tier, TIER_STATUS, "manual_review")


def is_serviceable(tier: Column) -> Column:
    return F.coalesce(tier.isin("A", "B"), F.lit(False))


def affects_pricing(tier: Column) -> Column:
    return tier_weight(tier) > 0


def unit_weight(tier: Column, unit_type: Column) -> Column:
    return F.round(tier_weight(tier) * _lookup(unit_type, CONFIDENCE, 0.0), 4)


def is_whitelisted_poi(tags: Column, whitelist: dict[str, list[str]] | None = None, need_name: bool = True) -> Column:
    kinds = F.greatest(*[F.coalesce(tags[k].isin(v), F.lit(False)) for k, v in (whitelist or POI_WHITELIST).items()])
    return kinds & truthy(F.trim(tags["name"])) if need_name else kinds


def food_venue(tags: Column) -> Column:
    """'kept', the reason why a venue is left out, or null where there is no venue."""
    takeaway = F.coalesce(tags["takeaway"].isin("yes", "only"), F.lit(False)) | F.coalesce(tags["delivery"] == "yes", F.lit(False))
    venue = F.coalesce(tags["amenity"].isin(STRONG_FOOD), F.lit(False)) | (takeaway & (truthy(tags["amenity"]) | truthy(tags["shop"])))
    return (
        F.when(venue & truthy(F.trim(tags["name"])), "kept")
        .when(venue, "unnamed_venue")
        .when(tags["amenity"].isin(CONDITIONAL_FOOD), "no_takeaway_or_delivery")
    )


def relation_warnings(id_: Column, found: Column, tags: Column, levels: list[str] | None = None, type_: str = "boundary", boundary: str = "administrative") -> Column:
    """What a relation lacks to be a plausible boundary, as an array; a relation that is not there has one warning."""
    shown = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
    unlike = lambda k, v: F.when(~F.coalesce(tags[k] == v, F.lit(False)), F.concat(F.lit(f"unexpected {k}="), shown(tags[k]), F.lit(f" (expected '{v}')")))
    level = tags["admin_level"]
    tests = [unlike("type", type_), unlike("boundary", boundary), F.when(level.isNull(), "missing admin_level tag")]
    if levels:
        tests.append(F.when(level.isNotNull() & ~level.isin(levels), F.concat(F.lit("admin_level="), shown(level), F.lit(f" outside expected set {levels}"))))
    tests.append(F.when(~truthy(tags["name"]), "missing name tag"))
    absent = F.array(F.concat(F.lit("relation "), id_.cast("string"), F.lit(" not present in this PBF extract")))
    return F.when(found, F.array_compact(F.array(*tests))).otherwise(absent)


def district_of(territory: Column, table: dict[str, tuple[str, str | None]]) -> Column:
    """struct(settlement, district) of a territory key; both null for an unknown key."""
    value = F.lit(None).cast("struct<settlement:string,district:string>")
    for key, (settlement, district) in table.items():
        value = F.when(territory == key, F.struct(F.lit(settlement).alias("settlement"), F.lit(district).cast("string").alias("district"))).otherwise(value)
    return value
