"""Map-object files in binary form as a Spark data source, ``spark.read.format("map_pbf")``.

The file is a row of blobs, each compressed by itself. The driver reads their headers only and deals runs of them out as
partitions; tasks unpack and decode their own blobs. Varints are decoded for a whole packed array at once, deltas summed, and
words taken from the blob's string table. A filter on ``kind`` is taken over by the reader: groups of other kinds are passed
over undecoded (where spark.sql.python.filterPushdown.enabled is true; the option ``kind`` does
the same by hand). Paths go through pyarrow, so a shared store works as well as a local file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = "kind string, id bigint, tags map<string,string>, lon double, lat double, refs array<bigint>, members array<struct<type:string,ref:bigint,role:string>>"
_TAGS = pa.map_(pa.string(), pa.string())
_MEMBERS = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))
_ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("tags", _TAGS), ("lon", pa.float64()), ("lat", pa.float64()), ("refs", pa.list_(pa.int64())), ("members", _MEMBERS)])
# Field numbers, kinds and units are fixed by the format.
_KINDS = ("n", "w", "r")
_TYPES = ("node", "way", "relation")
_NODE, _DENSE, _WAY, _RELATION = 1, 2, 3, 4


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message: whole numbers as they are, byte fields as views."""
    at, end = 0, len(data)
    while at < end:
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def packed(data: memoryview) -> np.ndarray:
    """All varints of a packed array, as unsigned 64-bit numbers."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.bitwise_or.reduceat(parts, first)


def signed(values: np.ndarray) -> np.ndarray:
    """Zigzag numbers: 0, -1, 1, -2, ..."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def _zigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def _signed64(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class _Block:
    """One unpacked blob of objects: its string table, its units, and its groups."""

    def __init__(self, data: bytes):
        self.words: list[str] = []
        self.groups: list[memoryview] = []
        self.step, self.lat0, self.lon0 = 100, 0, 0
        for number, value in fields(memoryview(data)):
            if number == 1:
                self.words = [bytes(v).decode("utf-8", "replace") for n, v in fields(value) if n == 1]
            elif number == 2:
                self.groups.append(value)
            elif number == 17:
                self.step = value
            elif number in (19, 20):
                setattr(self, "lat0" if number == 19 else "lon0", _signed64(value))

    def degrees(self, values: np.ndarray, zero: int) -> np.ndarray:
        return (values * self.step + zero) / 1e9

    def tags(self, keys: np.ndarray, values: np.ndarray) -> list[tuple[str, str]] | None:
        # A key told twice keeps its last value.
        return list({self.words[k]: self.words[v] for k, v in zip(keys.tolist(), values.tolist(), strict=True)}.items()) or None

    def rows(self, kinds: frozenset[str]) -> Iterator[pa.RecordBatch]:
        for group in self.groups:
            plain: dict[str, list[tuple]] = {k: [] for k in _KINDS}
            for number, value in fields(group):
                if number == _DENSE and "n" in kinds:
                    yield self._dense(value)
                elif number in (_NODE, _WAY, _RELATION) and (kind := {_NODE: "n", _WAY: "w", _RELATION: "r"}[number]) in kinds:
                    plain[kind].append({"n": self._node, "w": self._way, "r": self._relation}[kind](dict(fields(value))))
            for kind, found in plain.items():
                if found:
                    yield _batch(kind, *zip(*found, strict=True))

    def _dense(self, data: memoryview) -> pa.RecordBatch:
        own = dict(fields(data))
        none = memoryview(b"")
        ids, lat, lon = (np.cumsum(signed(packed(own.get(n, none)))) for n in (1, 8, 9))
        flat = packed(own.get(10, none)).astype(np.int64)
        tags: list = [None] * len(ids)
        if len(flat):
            # Keys and values in turn; a 0 where a key would stand ends a node's.
            at, node = 0, 0
            ends = np.flatnonzero(flat == 0)
            for end in ends.tolist():
                if end < at or (end - at) % 2:  # a 0 in a value's place is the empty word
                    continue
                if end > at:
                    tags[node] = self.tags(flat[at:end:2], flat[at + 1 : end : 2])
                at, node = end + 1, node + 1
        n = len(ids)
        return _batch("n", ids, tags, self.degrees(lon, self.lon0), self.degrees(lat, self.lat0), [None] * n, [None] * n)

    def _named(self, own: dict) -> list[tuple[str, str]] | None:
        none = memoryview(b"")
        return self.tags(packed(own.get(2, none)).astype(np.int64), packed(own.get(3, none)).astype(np.int64))

    def _node(self, own: dict) -> tuple:
        lon, lat = (float(self.degrees(np.int64(_zigzag(own[n])), zero)) for n, zero in ((9, self.lon0), (8, self.lat0)))
        return _zigzag(own[1]), self._named(own), lon, lat, None, None

    def _way(self, own: dict) -> tuple:
        refs = np.cumsum(signed(packed(own.get(8, memoryview(b""))))).tolist()
        return _signed64(own[1]), self._named(own), None, None, refs, None

    def _relation(self, own: dict) -> tuple:
        none = memoryview(b"")
        ids = np.cumsum(signed(packed(own.get(9, none)))).tolist()
        roles, types = (packed(own.get(n, none)).tolist() for n in (8, 10))
        members = [{"type": _TYPES[t], "ref": i, "role": self.words[r]} for t, i, r in zip(types, ids, roles, strict=True)]
        return _signed64(own[1]), self._named(own), None, None, None, members


def _batch(kind: str, ids, tags, lon, lat, refs, members) -> pa.RecordBatch:
    cols = [pa.array([kind] * len(ids)), pa.array(ids, pa.int64()), pa.array(tags, _TAGS), pa.array(lon, pa.float64()), pa.array(lat, pa.float64()), pa.array(refs, pa.list_(pa.int64())), pa.array(members, _MEMBERS)]
    return pa.RecordBatch.from_arrays(cols, schema=_ARROW)


def unpacked(blob: bytes) -> bytes:
    own = dict(fields(memoryview(blob)))
    if 1 in own:
        return bytes(own[1])
    if 3 in own:
        return zlib.decompress(own[3])
    if 7 in own:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(bytes(own[7]), max_output_size=own[2])
    raise ValueError("the blob is packed in a way that is not supported")


def blobs(file) -> Iterator[tuple[str, int, int]]:
    """(type, offset, size) of every blob, by its header alone."""
    while head := file.read(4):
        if len(head) < 4:
            raise ValueError("the file ends within a blob's length")
        (size,) = struct.unpack(">i", head)
        own = dict(fields(memoryview(file.read(size))))
        at = file.tell()
        yield bytes(own[1]).decode(), at, own[3]
        file.seek(at + own[3])


@dataclass
class _Run(InputPartition):
    """A stretch of blobs that follow one another."""

    places: list[tuple[int, int]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, kinds: frozenset[str], target: int):
        self.path, self.kinds, self.target = path, kinds, target

    def _open(self):
        fs, path = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        return fs.open_input_file(path)

    def partitions(self) -> list[InputPartition]:
        runs, held = [], 0
        with self._open() as file:
            for name, at, size in blobs(file):
                if name == "OSMData":
                    if not runs or held + size > self.target:
                        runs.append(_Run([]))
                        held = 0
                    runs[-1].places.append((at, size))
                    held += size
        return runs or [_Run([])]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        if not self.kinds:
            return
        with self._open() as file:
            for at, size in partition.places:
                file.seek(at)
                yield from _Block(unpacked(file.read(size))).rows(self.kinds)


class _FilteringReader(_Reader):
    def pushFilters(self, filters):  # noqa: N802  (Spark's name)
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("kind",):
                self.kinds &= frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            else:
                yield f


class MapPbf(DataSource):
    """Options: path; kind (n, w or r; all without); target (bytes of packed blobs in a partition); filters (whether Spark offers them)."""

    @classmethod
    def name(cls) -> str:
        return "map_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kinds = frozenset([self.options["kind"]] if self.options.get("kind") else _KINDS)
        reader = _FilteringReader if self.options.get("filters") == "true" else _Reader
        return reader(self.options["path"], kinds, int(self.options.get("target", 32 << 20)))


def read_kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Objects of one kind, node, way or relation, with the columns that osm.read_kind() gives."""
    short = dict(zip(_TYPES, _KINDS, strict=True))[kind]
    more = {"n": ["lon", "lat"], "w": ["refs"], "r": ["members"]}[short]
    return _source(spark).option("kind", short).load(path).filter(F.col("kind") == short).select("kind", "id", "tags", *more)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """All objects as (kind, id, tags)."""
    return _source(spark).load(path).select("kind", "id", "tags")


def _source(spark: SparkSession) -> DataFrameReader:
    # A reader that takes over filters is an error where Spark offers none.
    spark.dataSource.register(MapPbf)
    return spark.read.format("map_pbf").option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
