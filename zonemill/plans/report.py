"""Reports of a detached district: plain dictionaries from bounded results, ready for sources.files.write_json."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..operators import audit
from ..sources.files import load_config, round_coordinates


@dataclass(frozen=True)
class Settlement:
    """An allowed settlement: its relation, and its place node and districts where known."""

    key: str
    name: str
    relation: int
    place_node: int | None = None
    districts: tuple[str, ...] = ()


@dataclass(frozen=True)
class ServiceSettings:
    """Settlements that are served, and those that are not, with a reason each."""

    allowed: tuple[Settlement, ...]
    excluded: dict[str, str]

    @classmethod
    def load(cls, path: str) -> ServiceSettings:
        """From YAML: ``allowed``, a list of the fields of Settlement, and ``excluded``, reasons by key. A key that is in both
        or twice in the list is an error."""
        raw = load_config(path, ["allowed", "excluded"])
        try:
            allowed = tuple(Settlement(**{**entry, "districts": tuple(entry.get("districts") or ())}) for entry in raw["allowed"] or ())
        except (TypeError, AttributeError) as e:
            raise ConfigError(f"{path}: {e}") from e
        excluded = dict(raw["excluded"] or {})
        keys = [s.key for s in allowed]
        if twice := sorted({k for k in keys if keys.count(k) > 1} | (set(keys) & set(excluded))):
            raise ConfigError(f"{path}: listed twice: {', '.join(twice)}")
        return cls(allowed, excluded)

    @property
    def allowed_keys(self) -> frozenset[str]:
        return frozenset(s.key for s in self.allowed)

    @property
    def excluded_keys(self) -> frozenset[str]:
        return frozenset(self.excluded)


def address_reference(provenance: dict) -> dict:
    """What a report may say of house numbers from outside the map: an official range if the source was verified for import,
    else a reference that is not to be imported."""
    # The field names of such a report and of its provenance record.
    if provenance.get("verified_for_automatic_import"):
        fields = {"house_range_official": provenance["external_house_range_reference"], "verified_for_automatic_import": True}
        return {"official_address_support": fields | {"source": provenance["source"]}}
    fields = {k: provenance[k] for k in ("external_house_range_reference", "external_example_house_numbers")}
    return {"external_address_reference": fields | {"verified_for_automatic_import": False, "source": provenance["source"]}}


def outline_feature(ring: Iterable[tuple[float, float]], properties: dict) -> dict:
    """A boundary that is only a reference, as a closed line, so that nothing draws it as an area."""
    points = [list(p) for p in ring]
    if points and points[0] != points[-1]:
        points.append(points[0])
    return {"type": "Feature", "properties": properties | {"geometry_kind": "boundary_line"}, "geometry": round_coordinates({"type": "LineString", "coordinates": points})}


def unit_features(units: DataFrame, fields: list[str]) -> dict:
    """Units of one district as points with these fields, from south to north, then from west to east, then by uid."""
    rows = units.select("uid", "lon", "lat", F.struct(*fields).alias("fields")).orderBy("lat", "lon", "uid")
    features = [
        {"type": "Feature", "properties": r["fields"].asDict(), "geometry": {"type": "Point", "coordinates": [r["lon"], r["lat"]]}}
        for r in rows.toLocalIterator()
    ]
    return {"type": "FeatureCollection", "features": features}


def disputed_features(ledger: DataFrame, key: str, fields: list[str]) -> dict:
    """The candidates of disputed addresses (operators.addresses.disputed_ledger) as points, by key and uid; none is chosen."""
    rows = ledger.select(key, "uid", "lon", "lat", F.struct(key, "uid", *fields).alias("fields")).orderBy(key, "uid")
    own = {"status": "disputed", "resolution": "owner_review_required"}  # fixed values: what a reader looks for
    features = [{"type": "Feature", "properties": own | r["fields"].asDict(), "geometry": {"type": "Point", "coordinates": [r["lon"], r["lat"]]}} for r in rows.toLocalIterator()]
    return {"type": "FeatureCollection", "features": features}


def disputed_summary(ledger: DataFrame, key: str, by: list[str]) -> dict:
    """How many addresses are disputed, by each column (missing ones apart), and the candidates of each."""
    each = ledger.select(key, *by).distinct()
    counts = {f"by_{c}": {r[c]: r["n"] for r in audit.count_by(each, c).collect()} for c in by}
    rest = [c for c in ledger.columns if c not in (key, *by)]
    listed = ledger.groupBy(key, *by).agg(F.sort_array(F.collect_list(F.struct("candidate", *[c for c in rest if c != "candidate"]))).alias("candidates")).orderBy(key)
    return {"count": each.select(key).distinct().count()} | counts | {"addresses": [r.asDict(recursive=True) for r in listed.toLocalIterator()]}


def coverage_summary(coverage: DataFrame) -> dict:
    """Districts (see village.district_coverage; a stated, short list) by id, with how many are connected."""
    rows = [r.asDict() for r in coverage.orderBy("id").collect()]
    connected = sum(r["status"] == "connected" for r in rows)
    return {"districts_total": len(rows), "connected": connected, "disconnected": len(rows) - connected, "districts": rows}


def district_report(provenance: dict, footprint: dict, counts: dict[str, DataFrame], decisions: list[str]) -> dict:
    """The audit of a district that awaits its owner's decision. counts: tables of one row (village.readiness, verification,
    scenario_keep_edges) or a row a zone (village.per_zone), by the names they get."""
    # Fixed value: a district is never resolved by a report.
    report = {"resolved": False, "footprint": footprint, "owner_decisions_required": decisions} | address_reference(provenance)
    for name, frame in counts.items():
        rows = [r.asDict() for r in (frame.orderBy("zone") if "zone" in frame.columns else frame).collect()]
        report[name] = rows if "zone" in frame.columns else rows[0]
    return report
