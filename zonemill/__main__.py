"""python -m zonemill: small commands around the package. They end with 0 where all is well, 1 where the work found or met a
fault, 2 where they were called wrongly or a configuration is broken."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from .errors import ConfigError, ZonemillError
from .sources import files


def _download(args: argparse.Namespace) -> int:
    known = files.Manifest.from_json(Path(args.manifest).read_text(encoding="utf-8")) if args.manifest and Path(args.manifest).exists() else None
    made = files.download(args.url, args.path, known.sha256 if known else None, args.force, args.retries)
    if made and args.manifest:  # a file that was kept keeps its manifest too
        Path(args.manifest).write_text(made.to_json(), encoding="utf-8")
    print(f"{args.path}: {'downloaded' if made else 'kept'}")
    return 0


def _verify(args: argparse.Namespace) -> int:
    pin, record = (json.loads(Path(p).read_text(encoding="utf-8")) for p in (args.pin, args.record))
    found = files.build_problems(pin, record, args.folder, args.step, args.profile, args.releases)
    print("\n".join(found) or "the record fits its pin")
    return int(bool(found))


def _query(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from .plans import catalog

    if args.name not in catalog.queries():
        raise ConfigError(f"no query {args.name}")
    spark = SparkSession.builder.getOrCreate()
    out = catalog.queries()[args.name](spark, args.folder)
    out.write.mode("error").parquet(args.to) if args.to else out.show(args.rows, truncate=False)
    return 0


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="zonemill", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("download", help="fetch a file and write its manifest")
    p.set_defaults(run=_download)
    p.add_argument("url"), p.add_argument("path"), p.add_argument("--manifest"), p.add_argument("--force", action="store_true"), p.add_argument("--retries", type=int, default=3)
    p = sub.add_parser("verify", help="hold a build's record against its pin")
    p.set_defaults(run=_verify)
    p.add_argument("pin"), p.add_argument("record"), p.add_argument("folder"), p.add_argument("--profile", required=True)
    p.add_argument("--step", action="append", default=[]), p.add_argument("--releases", default="https://")
    p = sub.add_parser("query", help="run a query of the catalog over a folder of tables")
    p.set_defaults(run=_query)
    p.add_argument("name"), p.add_argument("folder"), p.add_argument("--to"), p.add_argument("--rows", type=int, default=20)
    return top


def main(argv: Sequence[str] | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as end:
        return int(end.code or 0)
    try:
        return args.run(args)
    except (ConfigError, json.JSONDecodeError, FileNotFoundError) as error:
        print(error, file=sys.stderr)
        return 2
    except ZonemillError as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
