"""A stream of a folder's changes: scans, their differences as events, and replay after a restart.

Each trigger scans the watched folder once. A scan that differs from the one before it is written, numbered, to the
journal folder; its number is the stream's offset, and the events between two offsets are the differences of the scans
between them. A restart therefore gives the same events for the same offsets, and a scan that no batch has taken yet is
not lost. Files that no batch needs any more are deleted when a batch is committed.

Watching fails closed: a folder of more than DIRECTORIES_MAX watched directories, or a scan with more than PENDING_MAX
changed paths, fails the query with what was exceeded; it is never cut short. Directories that are never watched are
not entered, links are not followed.

Defined cases: a folder that does not exist, or has gone, has no files; a file that changes and changes back between two
scans is not seen; one that changes twice is seen once; times are those of the scan.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .feed import DIRECTORIES_MAX, PENDING_MAX, UNWATCHED

NAME = "folder_changes"
SCHEMA = "scan bigint, ts timestamp, kind string, path string, size bigint"
Files = dict[str, list[int]]


def scan(folder: str, most: int = DIRECTORIES_MAX) -> Files:
    """Size and modification time in nanoseconds of every watched file, by path below the folder."""
    out: Files = {}
    waiting, seen = [""], 0
    while waiting:
        directory = waiting.pop()
        seen += 1
        if seen > most:
            raise ValueError(f"WATCH_LIMIT: more than {most} directories to watch")
        try:
            entries = list(os.scandir(os.path.join(folder, directory)))
        except (FileNotFoundError, NotADirectoryError):
            continue  # gone since its parent was read
        for e in entries:
            path = f"{directory}/{e.name}" if directory else e.name
            if e.is_symlink():
                continue
            if e.is_dir():
                waiting += [path] if e.name not in UNWATCHED else []
            elif e.is_file():
                try:
                    s = e.stat()
                except FileNotFoundError:
                    continue
                out[path] = [s.st_size, s.st_mtime_ns]
    return out


def differences(before: Files, after: Files) -> list[tuple[str, str, int | None]]:
    """(kind, path, size) of what was added, changed and removed, in order of path."""
    out = [("added" if p not in before else "changed", p, s[0]) for p, s in after.items() if before.get(p) != s]
    return sorted([*out, *(("removed", p, None) for p in before if p not in after)], key=lambda x: x[1])


class Journal:
    """Scans by number, each in a file that appears whole."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for f in os.listdir(self.folder) if (m := re.fullmatch(r"scan-(\d+)\.json", f)))

    def read(self, number: int) -> dict:
        if number == 0:
            return {"ts": 0.0, "files": {}}
        with open(f"{self.folder}/scan-{number}.json") as f:
            return json.load(f)

    def write(self, number: int, files: Files) -> None:
        fresh = f"{self.folder}/.fresh-{number}"
        with open(fresh, "w") as f:
            json.dump({"ts": time.time(), "files": files}, f)
            f.flush()
            os.fsync(f.fileno())
        os.rename(fresh, f"{self.folder}/scan-{number}.json")

    def forget(self, number: int) -> None:
        """Scans before ``number``, from which the next differences are taken."""
        for n in self.numbers():
            if n < number:
                os.remove(f"{self.folder}/scan-{n}.json")


class Events(InputPartition):
    """The events of one scan: at most as many as may be pending."""

    def __init__(self, number: int, ts: float, events: list[tuple[str, str, int | None]]):
        super().__init__(number)
        self.number, self.ts, self.events = number, ts, events


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        for needed in ("path", "journal"):
            if not options.get(needed):
                raise ValueError(f"the option {needed!r} is missing")
        self.folder, self.journal = options["path"], Journal(options["journal"])
        self.paths, self.directories = int(options.get("maxPaths", PENDING_MAX)), int(options.get("maxDirectories", DIRECTORIES_MAX))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"scan": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max(self.journal.numbers(), default=0)
        found = scan(self.folder, self.directories)
        changed = differences(self.journal.read(last)["files"], found)
        if last and len(changed) > self.paths:
            raise ValueError(f"WATCH_LIMIT: more than {self.paths} paths have changed")
        if changed:
            self.journal.write(last := last + 1, found)
        return {"scan": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, before = [], self.journal.read(start["scan"])["files"]
        for n in range(start["scan"] + 1, end["scan"] + 1):
            now = self.journal.read(n)
            out.append(Events(n, now["ts"], differences(before, now["files"])))
            before = now["files"]
        return out

    def read(self, partition: Events) -> Iterator[tuple]:
        from datetime import UTC, datetime

        ts = datetime.fromtimestamp(partition.ts, UTC)
        for kind, path, size in partition.events:
            yield partition.number, ts, kind, path, size

    def commit(self, end: dict) -> None:
        self.journal.forget(end["scan"])


class FolderChanges(DataSource):
    """format("folder_changes"): options path (the folder), journal (where scans are kept), maxPaths, maxDirectories.

    The first scan of a journal is the folder as it stands: its files are added, however many there are.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ChangeReader(self.options)


def changes(spark: SparkSession, path: str, journal: str, **options: int) -> DataFrame:
    """The stream of a folder's changes (scan, ts, kind, path, size)."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format(NAME).options(path=path, journal=journal, **{k: str(v) for k, v in options.items()}).load()


def standing(events: DataFrame) -> DataFrame:
    """The files that stand after a table of events: the batch fold of the stream."""
    last = events.groupBy("path").agg(F.max_by(F.struct("kind", "size"), "scan").alias("x"))
    return last.where("x.kind <> 'removed'").select("path", "x.size")
