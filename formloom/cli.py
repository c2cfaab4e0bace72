"""python -m formloom.cli IN OUT [--from FORMAT] [--to FORMAT] [--list-formats]

Converts one file, or every file of a folder. Exit 0: done; 1: a typed error; 2: wrong usage.
"""

from __future__ import annotations

import os
import sys

from formloom.errors import FormatError, require
from formloom.plans.formats import ALIASES, BY_EXT, FORMATS

#: Fixed value: bytes of a single input.
MAX_BYTES = 256 << 20


def parse(argv: list[str]) -> dict:
    out: dict = {"paths": [], "from": None, "to": None, "list": False}
    at = 0
    while at < len(argv):
        a = argv[at]
        if a in ("--from", "--to"):
            if at + 1 >= len(argv):
                raise SystemExit(2)
            out[a[2:]] = argv[at + 1]
            at += 1
        elif a == "--list-formats":
            out["list"] = True
        elif a.startswith("-"):
            raise SystemExit(2)
        else:
            out["paths"].append(a)
        at += 1
    if not out["list"] and len(out["paths"]) != 2:
        raise SystemExit(2)
    return out


def _format(name: str | None) -> str | None:
    e = (name or "").lower().removeprefix(".")
    e = ALIASES.get(e, e)
    return e if e in BY_EXT else None


def main(argv: list[str]) -> int:
    args = parse(argv)
    if args["list"]:
        for ext, mime, category in FORMATS:
            print(f"{ext}\t{mime}\t{category}")
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from formloom.plans.convert import convert, routed
    from formloom.sources.files import scan

    src, dst = args["paths"]
    spark = SparkSession.builder.appName("formloom").getOrCreate()
    try:
        require(os.path.getsize(src) <= MAX_BYTES, "INPUT_TOO_LARGE")
        files = scan(spark, src)
        # The source's extension is never consulted; a hint is, and what the bytes say goes first.
        found = routed(files.withColumn("hint", F.lit(args["from"] or "")), "hint").first()
        source, target = found and found.ext or _format(args["from"]), _format(args["to"] or os.path.splitext(dst)[1])
        require(source, "UNSUPPORTED_FORMAT", "input")
        require(target, "UNSUPPORTED_FORMAT", "output")
        made = convert(files, source, target, ["path"]).first()
        with open(dst, "wb") as f:
            f.write(bytes(made.content))
        return 0
    except FormatError as e:
        print(e, file=sys.stderr)
        return 1
    except OSError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
