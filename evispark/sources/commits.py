"""Numbered commits in a folder: whoever creates the next number first has made the change, everybody else has not.

A commit is a small JSON file whose number is its name. It is created exclusively, so that of two writers that start from
the same commit one wins and the other is refused. A file that its writer could not finish is passed over, and its number
is not used again. Paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from ..contracts import QueryError


class Commits:
    def __init__(self, spark: SparkSession, folder: str, stem: str = "commit"):
        self.spark, self.folder, self.stem = spark, folder.rstrip("/"), stem

    def place(self, name: str = ""):
        """The file system and the path of a name in the folder."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self, pattern: str, below: str = "") -> list[str]:
        """What the group of ``pattern`` is in the names that match it."""
        fs, p = self.place(below)
        return [m[1] for f in fs.listStatus(p) if (m := re.fullmatch(pattern, f.getPath().getName()))] if fs.exists(p) else []

    def numbers(self) -> list[int]:
        """Newest first."""
        return sorted(map(int, self.names(rf"{self.stem}-(\d+)\.json")), reverse=True)

    def read(self, number: int) -> dict | None:
        """A commit's body; None if it is not there or not whole."""
        fs, p = self.place(f"{self.stem}-{number}.json")
        if not fs.exists(p):
            return None
        opened = fs.open(p)
        try:
            return json.loads(bytes(opened.readAllBytes()))
        except ValueError:
            return None
        finally:
            opened.close()

    def latest(self) -> tuple[int, dict]:
        """The newest whole commit; number 0 and nothing if there is none."""
        for n in self.numbers():
            if (body := self.read(n)) is not None:
                return n, body
        return 0, {}

    def create(self, after: int, body: dict) -> int:
        """Commits ``body`` on top of number ``after``; refused with CONFLICT if another commit has come in since."""
        last = max(self.numbers(), default=0)
        if self.latest()[0] == after:
            number = max(last, after) + 1
            fs, p = self.place(f"{self.stem}-{number}.json")
            try:
                out = fs.create(p, False)
                out.write(bytearray(json.dumps(body).encode()))
                out.close()
                return number
            except Exception as e:
                if "AlreadyExists" not in str(e):
                    raise
        raise QueryError("CONFLICT", f"{self.folder} was changed by another writer")

    def delete(self, name: str) -> None:
        fs, p = self.place(name)
        fs.delete(p, True)
