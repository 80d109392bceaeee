"""The binary reader against the XML reader, on a file written here."""

import struct
import xml.etree.ElementTree as ET
import zlib

import numpy as np
import pytest

from zonemill.sources import osm, pbf

from test_sources import MAP


def varint(n):
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def zig(n):
    return varint((n << 1) ^ (n >> 63))


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def deltas(values):
    return b"".join(zig(b - a) for a, b in zip([0, *values], values, strict=False))


class Words:
    def __init__(self):
        self.known = {"": 0}

    def __call__(self, word):
        return self.known.setdefault(word, len(self.known))

    def table(self):
        return field(1, b"".join(field(1, w.encode()) for w in self.known))


def block(groups, words, step=100, lat0=0, lon0=0):
    return words.table() + b"".join(field(2, g) for g in groups) + field(17, step) + field(19, lat0) + field(20, lon0)


def blob(kind, data, pack="zlib"):
    body = field(2, len(data)) + field(3, zlib.compress(data)) if pack == "zlib" else field(1, data)
    head = field(1, kind.encode()) + field(3, len(body))
    return struct.pack(">i", len(head)) + head + body


def named(el, words):
    tags = [(t.get("k"), t.get("v")) for t in el.iter("tag")]
    return field(2, b"".join(varint(words(k)) for k, _ in tags)) + field(3, b"".join(varint(words(v)) for _, v in tags)) if tags else b""


def units(degrees, step, zero):
    return round((float(degrees) * 1e9 - zero) / step)


@pytest.fixture(scope="module", params=["zlib", "raw"])
def files(request, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pbf")
    (folder / "map.osm").write_text(MAP, encoding="utf-8")
    root = ET.fromstring(MAP)
    out = blob("OSMHeader", field(4, b"OsmSchema-V0.6"), "raw")
    nodes = list(root.iter("node"))
    for part, dense, step, lat0, lon0 in ((nodes[:5], True, 100, 0, 0), (nodes[5:9], True, 1000, 5_000_000_000, -7_000_000_000), (nodes[9:], False, 100, 0, 0)):
        words = Words()
        lat, lon = [units(n.get("lat"), step, lat0) for n in part], [units(n.get("lon"), step, lon0) for n in part]
        if dense:
            flat = b"".join(b"".join(varint(words(t.get(c))) for t in n.iter("tag") for c in ("k", "v")) + b"\0" for n in part)
            group = field(2, field(1, deltas([int(n.get("id")) for n in part])) + field(8, deltas(lat)) + field(9, deltas(lon)) + field(10, flat))
        else:
            group = b"".join(field(1, b"\x08" + zig(int(n.get("id"))) + named(n, words) + b"\x40" + zig(y) + b"\x48" + zig(x)) for n, y, x in zip(part, lat, lon, strict=True))
        out += blob("OSMData", block([group], words, step, lat0, lon0), request.param)
    words = Words()
    ways = b"".join(field(3, field(1, int(w.get("id"))) + named(w, words) + field(8, deltas([int(n.get("ref")) for n in w.iter("nd")]))) for w in root.iter("way"))
    rels = b""
    for r in root.iter("relation"):
        m = list(r.iter("member"))
        ids, types = deltas([int(x.get("ref")) for x in m]), bytes(("node", "way", "relation").index(x.get("type")) for x in m)
        rels += field(4, field(1, int(r.get("id"))) + named(r, words) + field(8, b"".join(varint(words(x.get("role"))) for x in m)) + field(9, ids) + field(10, types))
    out += blob("OSMData", block([ways, rels], words), request.param)
    (folder / "map.osm.pbf").write_bytes(out)
    return str(folder / "map.osm"), str(folder / "map.osm.pbf")


def test_same_rows_as_the_xml_reader(spark, files):
    xml, binary = files
    for kind in ("node", "way", "relation"):
        want, got = osm.read_kind(spark, xml, kind), pbf.read_kind(spark, binary, kind)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert pbf.read_objects(spark, binary).count() == osm.read_objects(spark, xml).count()


def test_blobs_are_dealt_out_and_kinds_pushed_down(spark, files):
    _, binary = files
    assert pbf._source(spark).option("target", 1).load(binary).rdd.getNumPartitions() == 4
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = pbf._source(spark).load(binary).filter("kind = 'w' AND id > 710")
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "> 710" in plan and "= w" not in plan  # Spark filters ids; the kind is the reader's
        assert sorted(r.id for r in some.collect()) == [711, 712, 713]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_groups_of_other_kinds_are_not_decoded(files, monkeypatch):
    reader = pbf._Reader(files[1], frozenset("w"), 1 << 20)
    monkeypatch.setattr(pbf._Block, "_dense", None)
    monkeypatch.setattr(pbf._Block, "_relation", None)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 6


def test_numbers():
    rng = np.random.default_rng(1)
    values = [0, 1, 127, 128, 2**32, 2**63, 2**64 - 1, *map(int, rng.integers(0, 2**63, 500) >> rng.integers(0, 63, 500))]
    assert pbf.packed(memoryview(b"".join(map(varint, values)))).tolist() == values
    ints = [0, -1, 1, 2**62, -(2**62), -(2**63), 2**63 - 1]
    assert pbf.signed(pbf.packed(memoryview(b"".join(map(zig, ints))))).tolist() == ints


def test_broken_files_are_errors(tmp_path):
    (tmp_path / "x.pbf").write_bytes(b"\0\0")
    with pytest.raises(ValueError):
        pbf._Reader(str(tmp_path / "x.pbf"), frozenset("n"), 1).partitions()
    with pytest.raises(ValueError):
        pbf.unpacked(field(4, b"lzma"))
