"""The band computation end to end: attributed units and a matrix to bands, metrics, ledger and report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import addresses, audit, bands


@dataclass(frozen=True)
class BandSettings:
    """Parameters of a run."""

    k: int = 4
    width_km: float = 0.05
    min_share: float = 0.05
    max_share: float = 1.0
    penalty: float = 0.3
    spread_limit_m: float = 150.0
    columns: tuple[str, ...] = field(default=("uid", "settlement", "district", "street", "housenumber"))


def tariff_bands(units: DataFrame, matrix: DataFrame, settings: BandSettings = BandSettings()) -> dict[str, DataFrame]:
    """units: uid, settlement, district, street, housenumber, tier, unit_type, lon, lat, outcome (see
    spatial.attribute_units). matrix: unit_id, dist_m, weight (of the origin). Returns banded units, edges, metrics, split
    streets, house ranges, disputed units, conflicts and the exceptions ledger."""
    s = settings
    served = units.filter("outcome = 'serviceable'").withColumn("weight", classify.unit_weight(F.col("tier"), F.col("unit_type")))
    cost = bands.expected_cost(matrix, ["unit_id"], "dist_m", "weight").select(F.col("unit_id").alias("uid"), (F.col("expected") / 1000).alias("expected_km"))
    costed = served.join(cost, "uid", "left")
    reached = costed.filter("expected_km IS NOT NULL")
    qualifiers = addresses.street_qualifiers(reached)
    needed = addresses.district_needed(qualifiers).withColumn("_needed", F.lit(True))
    keyed = reached.withColumn("street_norm", text.normalize(F.coalesce("street", F.lit("")))).join(needed, "street_norm", "left")
    key = text.canonical_key(F.col("settlement"), F.col("street"), F.col("housenumber"), F.col("district"), F.coalesce("_needed", F.lit(False)))
    keyed = keyed.withColumn("canonical_key", key).drop("_needed")
    kept, disputed, conflicts = addresses.quarantine(keyed, "canonical_key", "lon", "lat", "expected_km", s.width_km, s.spread_limit_m)
    bins = bands.prefix_sums(bands.make_bins(kept, F.col("expected_km"), F.col("weight"), s.width_km))
    placed = kept.withColumn("bin", F.floor(F.col("expected_km") / F.lit(s.width_km))).join(bins.select("bin", "place"), "bin")
    total = bins.agg(F.max("w").alias("_all"))
    cuts = bands.split_demand(placed.filter("street_norm <> '' AND unit_type <> 'building_unaddressed'"), "street_norm").crossJoin(F.broadcast(total))
    share = cuts.select(F.col("cut").cast("int").alias("place"), F.when(F.col("_all") > 0, F.col("cost") / F.col("_all")).otherwise(0.0).alias("split_share"))
    edges = bands.band_table(bins.join(share, "place", "left").fillna(0.0, ["split_share"]), s.k, min_share=s.min_share, max_share=s.max_share, penalty=s.penalty)
    banded = bands.assign_by_table(kept, "expected_km", edges)
    street = ["settlement", "street"]
    rejected = {label: units.filter(F.col("outcome") == label) for label in ("tier_c", "outside_area", "no_street")}
    rejected |= {"unreachable": costed.filter("expected_km IS NULL"), "disputed_address": disputed}
    return {
        "banded": banded,
        "edges": edges,
        "metrics": bands.band_metrics(banded, "expected_km", "weight"),
        "split_streets": bands.split_streets(banded.filter("street_norm <> ''"), street, "housenumber", "weight"),
        "house_ranges": bands.house_ranges(banded, [*street, "band"], "housenumber"),
        "disputed": disputed,
        "conflicts": conflicts,
        "exceptions": audit.exceptions(rejected, list(s.columns)),
    }


def markdown(title: str, tables: dict[str, DataFrame], rows: int = 50) -> str:
    """A report of bounded results: the first rows of each table, in the order of its first columns."""
    out = [f"# {title}", ""]
    for name, frame in tables.items():
        found = frame.orderBy(*frame.columns[: min(3, len(frame.columns))]).limit(rows).collect()
        out += [f"## {name}", "", "| " + " | ".join(frame.columns) + " |", "|" + "-|" * len(frame.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in found] + [""]
    return "\n".join(out)
