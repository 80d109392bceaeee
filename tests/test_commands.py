"""Commands and their exit codes, and the check of a build against its pin."""

import hashlib
import json

import pytest

from zonemill.__main__ import main
from zonemill.sources import files


@pytest.fixture
def build(tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/car.lua").write_text("speed = 30")
    digest = hashlib.sha256(b"speed = 30").hexdigest()
    (tmp_path / "lib/CHECKSUMS.sha256").write_text(f"{digest}  car.lua\n")
    pin = {"version": "v7", "binaries": {"one": "https://host/releases/7.tgz"}}
    record = {"engine": {"version": "v7"}, "profile": {"sha256": digest}, "smoke_test": {"passed": True}, "commands": ["extract map", "serve --mode fast"]}
    return tmp_path, pin, record


def problems(build):
    folder, pin, record = build
    return files.build_problems(pin, record, folder / "lib", ["extract", "--mode fast"], "car.lua", "https://host/releases/")


def test_a_sound_build(build):
    assert problems(build) == []


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (lambda f, p, r: p.update(version="v8"), "pinned is v8"),
        (lambda f, p, r: r["profile"].update(sha256="0"), "another car.lua"),
        (lambda f, p, r: r.pop("smoke_test"), "smoke test"),
        (lambda f, p, r: r["commands"].pop(), "--mode fast"),
        (lambda f, p, r: p["binaries"].update(two="https://elsewhere/7.tgz"), "two: not a release"),
        (lambda f, p, r: (f / "lib/car.lua").write_text("speed = 90"), "car.lua: not the file"),
        (lambda f, p, r: (f / "lib/car.lua").unlink(), "car.lua: not the file"),
    ],
)
def test_what_speaks_against_a_build(build, change, said):
    change(*build)
    assert any(said in p for p in problems(build))


def test_verify_command(build, capsys):
    folder, pin, record = build
    (folder / "pin.json").write_text(json.dumps(pin))
    (folder / "record.json").write_text(json.dumps(record))
    call = ["verify", str(folder / "pin.json"), str(folder / "record.json"), str(folder / "lib"), "--profile", "car.lua", "--step", "extract", "--releases", "https://host/"]
    assert main(call) == 0
    (folder / "record.json").write_text(json.dumps(record | {"engine": {}}))
    assert main(call) == 1 and "pinned is v7" in capsys.readouterr().out
    assert main(["verify", str(folder / "none.json"), str(folder / "record.json"), str(folder), "--profile", "x"]) == 2


def test_download_command(tmp_path, capsys):
    (tmp_path / "there.bin").write_bytes(b"abc")
    url, path, manifest = (tmp_path / "there.bin").as_uri(), tmp_path / "out/here.bin", tmp_path / "m.json"
    assert main(["download", url, str(path), "--manifest", str(manifest)]) == 0 and path.read_bytes() == b"abc"
    first = manifest.read_text()
    assert json.loads(first)["sha256"] == hashlib.sha256(b"abc").hexdigest()
    assert main(["download", url, str(path), "--manifest", str(manifest)]) == 0 and manifest.read_text() == first and "kept" in capsys.readouterr().out
    path.write_bytes(b"changed")
    assert main(["download", url, str(path), "--manifest", str(manifest)]) == 1
    assert main(["download", url, str(path), "--manifest", str(manifest), "--force"]) == 0 and path.read_bytes() == b"abc"
    assert main(["download", (tmp_path / "none").as_uri(), str(tmp_path / "x"), "--retries", "1"]) == 1


def test_wrong_calls(capsys):
    assert main([]) == 2 and main(["no such"]) == 2 and main(["download"]) == 2 and main(["--help"]) == 0


def test_query_command(spark, tmp_path):
    assert main(["query", "unit_types", "/root/testdata/sf0.001", "--to", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert main(["query", "none", "/root/testdata/sf0.001"]) == 2


def test_files_against_their_manifests(spark, tmp_path):
    (tmp_path / "data").mkdir()
    for name, content in (("a.bin", b"abc"), ("b.bin", b"changed"), ("c.bin", b"unknown")):
        (tmp_path / "data" / name).write_bytes(content)
    known = [("data/a.bin", hashlib.sha256(b"abc").hexdigest()), ("data/b.bin", hashlib.sha256(b"as it was").hexdigest())]
    got = files.verify_files(spark, str(tmp_path / "data"), spark.createDataFrame(known, "local_path string, sha256 string"))
    assert {r.path.rsplit("/", 1)[1]: (r.ok, r.expected is not None) for r in got.collect()} == {"a.bin": (True, True), "b.bin": (False, True), "c.bin": (False, False)}
