"""Command line: ``run``, ``validate``, ``apply`` and ``cache``. Exit codes: 0 done, 1 refused, 2 wrong usage."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .contracts import QueryError
from .engine import Project, batch_tools
from .functions.toon import encode_checked
from .operators import files
from .plans import batch
from .plans.operations import FolderFiles, Operations


def _project(root: str) -> Project:
    spark = SparkSession.builder.getOrCreate()
    found = files.scan(spark, os.path.abspath(root)).where(F.col("path").rlike(r"\.[cm]?[jt]sx?$") & ~F.col("path").rlike(r"(^|/)(node_modules|\.git|dist|coverage)/"))
    return Project(spark, found.select("path", F.col("content").cast("string").alias("text")), sources=FolderFiles(root))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evispark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "validate"):
        c = commands.add_parser(name)
        c.add_argument("document", help="a file, or - for standard input")
        if name == "run":
            c.add_argument("--form", choices=("json", "toon"), default="json")
    c = commands.add_parser("apply")
    c.add_argument("plan")
    c.add_argument("--hash", required=True)
    c.add_argument("--root", required=True)
    c = commands.add_parser("cache")
    c.add_argument("action", choices=("inspect", "clear"))
    c.add_argument("root")
    try:
        a = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        if a.command in ("run", "validate"):
            text = sys.stdin.read(batch.DOCUMENT_BYTES + 1) if a.document == "-" else open(a.document).read(batch.DOCUMENT_BYTES + 1)
            document = batch.load(text)
            if a.command == "run":
                out = batch.Runner(batch_tools(_project(document.get("project_root", ".")))).run(document)
                print(encode_checked(out) if a.form == "toon" else json.dumps(out, ensure_ascii=False, default=str))
            else:
                print(json.dumps({"valid": True, "steps": len(document["steps"])}))
        elif a.command == "apply":
            ops = Operations(FolderFiles(a.root))
            print(json.dumps(ops.apply(ops.load(a.plan).operation_id, a.hash)))
        else:
            from .sources.store import ParquetStore

            store = ParquetStore(SparkSession.builder.getOrCreate(), a.root)
            if a.action == "clear":
                fs, p = store._fs(a.root)
                fs.delete(p, True)
            print(json.dumps(store.inspect()))
        return 0
    except QueryError as e:
        print(json.dumps({"error": e.code, "message": e.message, "details": e.details}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
