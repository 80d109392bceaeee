"""Distance matrices: a table of origins by units, filled by a routing service in batches or read as it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RoutingError

Table = Callable[[list[tuple[float, float]], list[tuple[float, float]]], dict]


def fill(origins: DataFrame, units: DataFrame, table: Table, chunk: int = 300) -> DataFrame:
    """(origin_id, unit_id, dist_m, dur_s), null where there is no way. ``table(sources, destinations)`` answers a mapping
    with code, distances and durations; any code but Ok is an error. Origins are a stated, short list; each batch of
    units asks for all of them, ``chunk`` destinations at a time."""
    sources = [(r["origin_id"], r["lon"], r["lat"]) for r in origins.select("origin_id", "lon", "lat").collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), chunk):
                part = batch.iloc[a : a + chunk]
                answer = table([(x, y) for _, x, y in sources], list(zip(part["lon"], part["lat"], strict=True)))
                if answer.get("code") != "Ok":
                    raise RoutingError(str(answer.get("code")))
                for i, (origin, _, _) in enumerate(sources):
                    yield pd.DataFrame({"origin_id": origin, "unit_id": part["unit_id"].to_numpy(), "dist_m": answer["distances"][i], "dur_s": answer["durations"][i]})

    return units.select("unit_id", "lon", "lat").mapInPandas(run, "origin_id string, unit_id string, dist_m double, dur_s double")


def straight(origins: DataFrame, units: DataFrame, limit: int = 1000) -> DataFrame:
    """All pairs of a stated list of origins with the units, by straight distance of x, y: a stand-in without a router. The
    origins are at most ``limit`` rows, which is what makes them fit for broadcast."""
    if origins.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} origins")
    o = F.broadcast(origins.select("origin_id", "weight", F.col("x").alias("ox"), F.col("y").alias("oy")))
    return units.crossJoin(o).withColumn("dist_m", F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))).drop("ox", "oy")


def sanity(matrix: DataFrame) -> DataFrame:
    """One row: pairs, unreachable ones, and those shorter than nothing or without a duration."""
    return matrix.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("dist_m").isNull()).alias("unreachable"), F.count_if((F.col("dist_m") < 0) | (F.col("dist_m").isNotNull() & F.col("dur_s").isNull())).alias("broken"))


def probe_report(probes: DataFrame, matrix: DataFrame, differs_m: float = 1.0, longer_m: float = 900.0) -> DataFrame:
    """What a sound routing graph must show, probe by probe: probe, expects, km, minutes, back_km, holds.

    probes: probe, expects, from_id, to_id; matrix: origin_id, unit_id, dist_m, dur_s, one row a pair. A probe that expects
    ``way`` holds where there is one; ``two_ways`` where there is one in both directions and they differ by more than
    ``differs_m``; ``detour`` where the way is longer than ``longer_m``, as one over a bridge is."""
    there = matrix.select(F.col("origin_id").alias("from_id"), F.col("unit_id").alias("to_id"), "dist_m", "dur_s")
    back = matrix.select(F.col("origin_id").alias("to_id"), F.col("unit_id").alias("from_id"), F.col("dist_m").alias("back_m"))
    met = probes.join(there, ["from_id", "to_id"], "left").join(back, ["from_id", "to_id"], "left")
    holds = F.when(F.col("expects") == "way", F.col("dist_m").isNotNull()).when(F.col("expects") == "two_ways", F.abs(F.col("dist_m") - F.col("back_m")) > differs_m).when(F.col("expects") == "detour", F.col("dist_m") > longer_m)
    km = lambda c: F.round(F.col(c) / 1000, 3)
    return met.select("probe", "expects", km("dist_m").alias("km"), F.round(F.col("dur_s") / 60, 2).alias("minutes"), km("back_m").alias("back_km"), F.coalesce(holds, F.lit(False)).alias("holds"))
