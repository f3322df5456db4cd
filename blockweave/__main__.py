"""Command line: ``python -m blockweave compress | decompress | info | test | list``."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="blockweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("compress", "decompress"):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("output", nargs="?")
        c.add_argument("-p", "--password")
        c.add_argument("-t", "--threads", type=int, help="cores of a local session")
        c.add_argument("-f", "--force", action="store_true", help="overwrite")
        c.add_argument("-q", "--quiet", action="store_true")
        c.add_argument("-v", "--verbose", action="store_true")
        if name == "compress":
            c.add_argument("-l", "--level", type=int)
            c.add_argument("-s", "--split", type=int, help="MiB in a volume")
            c.add_argument("--fast", action="store_true")
            c.add_argument("--ratio", action="store_true")
    for name in ("info", "test", "list"):
        sub.add_parser(name).add_argument("input")
    return p


def session(threads: int | None):
    """The session that is running, or a local one."""
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{threads or '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def main(arguments: list[str] | None = None) -> int:
    from . import api
    from .sources import catalog

    a = parser().parse_args(arguments)
    try:
        if a.command == "info":
            out = api.info(a.input)
        elif a.command == "list":
            out = [r.asDict() for r in catalog.list_files(session(None), a.input).collect()]
        elif a.command == "test":
            out = api.test(session(None), a.input)
        elif a.command == "compress":
            mode = "fast" if a.fast else "ratio" if a.ratio else "balanced"
            out = api.compress(session(a.threads), a.input, a.output, mode, a.level, a.password, a.split and a.split * api.MIB, a.force)
            out |= {"ratio": round(100 * out["output_size"] / max(out["input_size"], 1), 2), "mb_per_second": round(out["input_size"] / 1e6 / max(out["elapsed"], 1e-9), 2)}
        else:
            out = api.decompress(session(a.threads), a.input, a.output, a.password, a.force)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if not getattr(a, "quiet", False):
        print(json.dumps(out, indent=2 if getattr(a, "verbose", False) else None))
    return 0 if a.command != "test" or out["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
