"""Files of small results and settings: CSV, GeoJSON, JSON, YAML, manifests, downloads."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import urllib.request
from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, ProvenanceError


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows as text, by header, columns as stated."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=False)


def write_csv(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """One sorted file with fixed columns: for reports of a bounded size."""
    rows.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def to_json(value: Any, pretty: bool = True) -> str:
    """The same bytes for the same value: sorted keys, fixed indent, one final newline."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2 if pretty else None, separators=None if pretty else (",", ":")) + "\n"


def write_json(value: Any, path: str | Path, pretty: bool = True) -> None:
    """Written beside its place first, so a reader never sees half a file."""
    part = Path(f"{path}.part")
    part.parent.mkdir(parents=True, exist_ok=True)
    part.write_text(to_json(value, pretty), encoding="utf-8", newline="\n")
    os.replace(part, path)


def round_coordinates(value: Any, digits: int = 5) -> Any:
    if isinstance(value, float):
        return round(value, digits)
    if isinstance(value, list | tuple):
        return [round_coordinates(v, digits) for v in value]
    if isinstance(value, dict):
        return {k: round_coordinates(v, digits) for k, v in value.items()}
    return value


def feature_collection(rows: DataFrame, geometry: str, properties: list[str]) -> dict:
    """A bounded result as GeoJSON; the geometry column is GeoJSON text."""
    features = [
        {"type": "Feature", "geometry": round_coordinates(json.loads(r[geometry])), "properties": {p: r[p] for p in properties}}
        for r in rows.select(geometry, *properties).orderBy(*properties).toLocalIterator()
    ]
    return {"type": "FeatureCollection", "features": features}


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(type, coordinates as JSON text, properties) of each feature of a GeoJSON file."""
    text = spark.read.text(path, wholetext=True)
    schema = "struct<features:array<struct<geometry:string,properties:map<string,string>>>>"
    rows = text.select(F.explode(F.from_json("value", schema)["features"]).alias("f"))
    return rows.select(F.get_json_object("f.geometry", "$.type").alias("type"), F.get_json_object("f.geometry", "$.coordinates").alias("coordinates"), "f.properties")


def first_area(features: DataFrame) -> str:
    """The coordinates of the first Polygon or MultiPolygon."""
    row = features.filter(F.col("type").isin("Polygon", "MultiPolygon")).first()
    if row is None:
        raise ConfigError("no polygon feature")
    return row["coordinates"]


def settlement_feature(name: str, geometry: dict | None, point: tuple[float, float] | None, properties: dict | None = None) -> dict:
    """A settlement's outline, or a point as a marker where there is none; never a buffer."""
    props = {"name": name, **(properties or {})}
    if geometry is None:
        props["boundary_status"] = "boundary_missing"
        geometry = {"type": "Point", "coordinates": list(point or ())}
    elif geometry["type"] not in ("Polygon", "MultiPolygon"):
        raise ValueError(f"{name}: not an outline: {geometry['type']}")
    return {"type": "Feature", "properties": props, "geometry": round_coordinates(geometry)}


def load_config(path: str | Path, keys: list[str]) -> dict:
    """A YAML mapping with at least these keys."""
    import yaml

    if not Path(path).is_file():
        raise ConfigError(f"{path}: missing")
    value = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ConfigError(f"{path}: not a mapping")
    if lacking := [k for k in keys if k not in value]:
        raise ConfigError(f"{path}: lacks {', '.join(lacking)}")
    return value


# The field names of a manifest, as files that are exchanged hold them.
@dataclass(frozen=True)
class Manifest:
    """Where a file came from."""

    source_url: str
    resolved_url: str
    downloaded_at: str
    content_length: int | None
    sha256: str
    etag: str | None
    last_modified: str | None
    local_path: str

    def to_json(self) -> str:
        return to_json(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        """From a manifest's text; size, etag and date may lack."""
        value = json.loads(text)
        try:
            return cls(**{f.name: value.get(f.name) if f.name in ("content_length", "etag", "last_modified") else value[f.name] for f in fields(cls)})
        except KeyError as error:
            raise ConfigError(f"manifest lacks {error}") from error


def tool_versions(commands: dict[str, list[str]]) -> dict[str, str | None]:
    """The first line that each command says of its version; None where it is not there."""
    out: dict[str, str | None] = {}
    for name, command in commands.items():
        try:
            said = subprocess.run(command, capture_output=True, text=True, timeout=30, check=False)
            out[name] = next(iter((said.stdout or said.stderr).splitlines()), None)
        except (OSError, subprocess.SubprocessError):
            out[name] = None
    return out


def chosen_ids(given: list[int] | None, config: str | Path, key: str) -> list[int]:
    """Ids given by hand replace those of the configuration; either way each once, in order."""
    found = given if given else [c["id"] if isinstance(c, dict) else c for c in load_config(config, [key])[key]]
    return list(dict.fromkeys(int(i) for i in found))


def latest_manifest(manifests: DataFrame, local_path: str) -> DataFrame:
    """Of manifests(file, local_path, ...) the one of the last file name for a path, back slashes read as slashes."""
    same = F.replace("local_path", F.lit("\\"), F.lit("/")) == local_path.replace("\\", "/")
    row = F.struct(*manifests.columns)
    return manifests.filter(same).agg(F.max_by(row, "file").alias("m")).filter("m IS NOT NULL").select("m.*")


def verify_files(spark: SparkSession, path: str, manifests: DataFrame) -> DataFrame:
    """(path, sha256, expected, ok) for files under a path."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    want = manifests.select(F.col("local_path"), F.col("sha256").alias("expected"))
    return files.join(want, F.col("path").endswith(F.col("local_path")), "left").withColumn("ok", F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)))


def build_problems(pin: dict, record: dict, folder: str | Path, steps: Iterable[str], profile: str, releases: str) -> list[str]:
    """What speaks against the record of a build: that it was not made by the pinned engine, from the kept files, in all steps.

    folder holds the kept files and CHECKSUMS.sha256, lines of hash, two spaces, name. steps: what the recorded commands must hold;
    profile: the kept file that the build says it used; releases: how the address of every pinned binary must begin."""
    folder, found = Path(folder), []
    listed = {}
    for line in (folder / "CHECKSUMS.sha256").read_text(encoding="utf-8").splitlines():
        digest, _, name = line.partition("  ")
        if name:
            listed[name] = digest
    kept = {name: hashlib.sha256((folder / name).read_bytes()).hexdigest() if (folder / name).is_file() else None for name in {*listed, profile}}
    found += [f"{name}: not the file that was listed" for name, digest in sorted(listed.items()) if kept[name] != digest]
    # The field names of a pin and of a build's record.
    built = record.get("engine", {}).get("version")
    if built != pin.get("version"):
        found.append(f"built by version {built}, pinned is {pin.get('version')}")
    if record.get("profile", {}).get("sha256") != kept[profile]:
        found.append(f"built with another {profile}")
    if not record.get("smoke_test", {}).get("passed"):
        found.append("the smoke test did not pass")
    said = " ".join(record.get("commands", []))
    found += [f"no command holds {step}" for step in steps if step not in said]
    found += [f"{name}: not a release of the engine" for name, url in sorted(pin.get("binaries", {}).items()) if not str(url).startswith(releases)]
    return found


def download(url: str, path: str | Path, expected: str | None = None, force: bool = False, retries: int = 3, opener=urllib.request.urlopen) -> Manifest | None:
    """Streams to a part file, hashing on the way, and renames it at the end. A file that is there is kept if its hash is the
    expected one (then there is no new manifest), else an error unless forced."""
    path = Path(path)
    if path.exists() and not force:
        if expected is None or hashlib.sha256(path.read_bytes()).hexdigest() != expected:
            raise ProvenanceError(f"{path}: does not match its manifest")
        return None
    part, last = Path(f"{path}.part"), None
    part.parent.mkdir(parents=True, exist_ok=True)
    for _ in range(retries):
        try:
            digest = hashlib.sha256()
            with opener(url) as answer, part.open("wb") as out:
                while chunk := answer.read(1 << 20):
                    digest.update(chunk), out.write(chunk)
                head = dict(getattr(answer, "headers", {}) or {})
                final = getattr(answer, "url", url)
            os.replace(part, path)
            size = head.get("Content-Length")
            return Manifest(url, final, datetime.now(UTC).isoformat(), int(size) if size else None, digest.hexdigest(), head.get("ETag"), head.get("Last-Modified"), path.as_posix())
        except OSError as error:
            last = error
            part.unlink(missing_ok=True)
    raise ProvenanceError(f"{url}: {last}")
