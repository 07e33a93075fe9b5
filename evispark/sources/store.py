"""Stores of index entries behind one contract: in memory, and as parquet generations with checksums.

A stored entry is one row a file: file_path, content_hash, config_digest, symbols (an array), last_indexed_at. The
parquet store writes each generation to a folder of its own and then adds one small, numbered pointer file; the highest
number counts, so that readers see the old or the new generation, never half of one or none. The last generation stays
for those who still read it; those before it go. A generation is verified once, when it is first loaded: rows whose
checksum does not hold, or files that are not there, prove it corrupt, and then alone it is moved aside and the store
starts empty; any other failure to read is passed on. Indexes of the two schema versions before this one are brought up
to it when they are loaded. Paths go through Hadoop's file systems, so that any of them will do.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..contracts import QueryError
from ..functions.scalar import has

SCHEMA_VERSION = 3
SYMBOL = "struct<name:string,symbol_path:string,selector:string,kind:string,signature:string,line:int,end_line:int>"
ENTRY = f"file_path string, content_hash string, config_digest string, symbols array<{SYMBOL}>, last_indexed_at string"


class SymbolStore(Protocol):
    def load(self, project: str) -> DataFrame: ...
    def upsert(self, project: str, entries: DataFrame) -> None: ...
    def remove(self, project: str, paths: list[str]) -> None: ...
    def clear(self, project: str) -> None: ...
    def flush(self) -> None: ...


class _Queries:
    """What both stores answer alike, from load()."""

    spark: SparkSession

    def candidates(self, project: str, query: str) -> DataFrame:
        """Entries among which all are that hold ``query``."""
        return self.load(project)

    def symbols(self, project: str, query: str = "", kinds: list[str] | None = None, file_filter: str | None = None) -> DataFrame:
        """Matching symbols with file_path and symbol_position, in order of file and position."""
        out = self.candidates(project, query).select("file_path", F.posexplode("symbols").alias("symbol_position", "s")).select("file_path", "symbol_position", "s.*")
        if query:
            out = out.where(has(F.col("name"), query) | has(F.col("symbol_path"), query) | has(F.col("selector"), query))
        if kinds:
            out = out.where(F.col("kind").isin(kinds))
        if file_filter:
            out = out.where(has(F.col("file_path"), file_filter))
        return out.orderBy("file_path", "symbol_position")

    def count_symbols(self, project: str, **filters) -> int:
        return self.symbols(project, **filters).count()

    def refresh(self, project: str, plan: DataFrame, rebuilt: DataFrame) -> dict[str, int]:
        """Applies a refresh plan: rebuilt entries go in, removed ones go out, the rest stays."""
        counts = {r.action: r["count"] for r in plan.groupBy("action").count().collect()}
        keep = self.load(project).join(plan.where("action = 'reuse'").select("file_path"), "file_path", "left_semi")
        self._replace(project, keep.unionByName(rebuilt.select(*keep.columns)))
        return {k: counts.get(k, 0) for k in ("rebuild", "reuse", "remove")}

    def upsert(self, project: str, entries: DataFrame) -> None:
        old = self.load(project).join(entries.select("file_path"), "file_path", "left_anti")
        self._replace(project, old.unionByName(entries.select(*old.columns)))

    def remove(self, project: str, paths: list[str]) -> None:
        self._replace(project, self.load(project).where(~F.col("file_path").isin(paths)))

    def clear(self, project: str) -> None:
        self._replace(project, self.spark.createDataFrame([], ENTRY))

    def flush(self) -> None:
        """Every change is durable, as far as the store is, when its call returns."""


class MemoryStore(_Queries):
    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def put(self, name: str, table: DataFrame) -> None:
        self.tables[name] = table.cache()

    def get(self, name: str) -> DataFrame:
        return self.tables[name]

    def load(self, project: str) -> DataFrame:
        return self.tables.get(project) if project in self.tables else self.spark.createDataFrame([], ENTRY)

    def _replace(self, project: str, entries: DataFrame) -> None:
        old, new = self.tables.get(project), entries.cache()
        new.count()
        self.tables[project] = new
        if old is not None:
            old.unpersist()


COLUMNS = ("file_path", "content_hash", "config_digest", "symbols", "last_indexed_at")


def checksum(columns: Sequence[str] = COLUMNS) -> F.Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


#: What each older schema version lacks, and what stands there once it is brought up.
MIGRATIONS = {1: ("config_digest", "last_indexed_at"), 2: ("last_indexed_at",)}
NEVER = "1970-01-01T00:00:00.000Z"


class ParquetStore(_Queries):
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        #: generations that have been verified
        self.sound: set[str] = set()

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self, project: str) -> list[tuple[int, str]]:
        """Numbers and paths of a project's pointers, the one that counts first."""
        fs, p = self._fs(f"{self.root}/{project}")
        if not fs.exists(p):
            return []
        names = [(f.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(p)]
        found = [(int(m[1]), path) for name, path in names if (m := re.fullmatch(r"current-(\d+)\.json", name))]
        return sorted(found, reverse=True)

    def _pointed(self, project: str) -> tuple[int, str, int] | None:
        """Number, folder and schema version of the current generation."""
        for number, path in self._pointers(project):
            text = self.spark.read.text(path, wholetext=True).first()
            try:
                at = json.loads(text[0]) if text else {}
            except ValueError:
                continue  # half written by one that is no more: the one before it counts
            if 1 <= at.get("schema_version", 0) <= SCHEMA_VERSION:
                return number, f"{self.root}/{project}/{at['generation']}", at["schema_version"]
        return None

    def _current(self, project: str) -> str | None:
        at = self._pointed(project)
        return at[1] if at else None

    def load(self, project: str) -> DataFrame:
        at = self._pointed(project)
        if at is None:
            return self.spark.createDataFrame([], ENTRY)
        _, path, version = at
        fs, p = self._fs(path)
        if not fs.exists(p):
            self.quarantine(project)
            raise QueryError("INTERNAL_ERROR", f"the index of {project} is not where it was")
        lacking = MIGRATIONS.get(version, ())
        stored = [f for f in StructType.fromDDL(ENTRY) if f.name not in lacking]
        rows = self.spark.read.schema(StructType([*stored, StructField("checksum", StringType())])).parquet(path)
        if path not in self.sound:
            if rows.where(~checksum([f.name for f in stored]).eqNullSafe(F.col("checksum"))).limit(1).count():
                self.quarantine(project)
                raise QueryError("INTERNAL_ERROR", f"a checksum of {project} does not hold")
            self.sound.add(path)
        # an empty digest fits no configuration, so that what is brought up is rebuilt with the next refresh
        for name in lacking:
            rows = rows.withColumn(name, F.lit(NEVER if name == "last_indexed_at" else ""))
        return rows.select(*[f.name for f in StructType.fromDDL(ENTRY)])

    def quarantine(self, project: str) -> str:
        """Moves a project's folder aside; the next load starts empty."""
        fs, p = self._fs(f"{self.root}/{project}")
        aside = f"{self.root}/{project}.corrupt-{int(time.time() * 1000)}"
        fs.rename(p, self._fs(aside)[1])
        return aside

    def _replace(self, project: str, entries: DataFrame) -> None:
        before, name = self._pointed(project), f"gen={uuid.uuid4().hex}"
        path = f"{self.root}/{project}/{name}"
        entries.withColumn("checksum", checksum()).write.parquet(path)
        number = (before[0] if before else 0) + 1
        fs, pointer = self._fs(f"{self.root}/{project}/current-{number}.json")
        try:
            out = fs.create(pointer, False)  # by one writer alone
            out.write(bytearray(json.dumps({"schema_version": SCHEMA_VERSION, "generation": name}).encode()))
            out.close()
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            fs.delete(self._fs(path)[1], True)
            raise QueryError("CONFLICT", f"the index of {project} was changed by another writer") from e
        # of those before the last generation, nothing is read any more
        keep = {path, before[1] if before else path}
        for old, at in self._pointers(project):
            if old < number - 1:
                fs.delete(self._fs(at)[1], False)
        for f in fs.listStatus(self._fs(f"{self.root}/{project}")[1]):
            if f.getPath().getName().startswith("gen=") and f"{self.root}/{project}/{f.getPath().getName()}" not in keep:
                fs.delete(f.getPath(), True)

    def inspect(self, most: int = 4096) -> dict[str, int]:
        """Artifacts below the root, counted without reading them."""
        fs, p = self._fs(self.root)
        counts = {"files": 0, "bytes": 0, "quarantined": 0, "complete": 1}
        if not fs.exists(p):
            return counts
        found = fs.listFiles(p, True)
        while found.hasNext():
            f = found.next()
            if counts["files"] >= most:
                counts["complete"] = 0
                break
            counts["files"] += 1
            counts["bytes"] += f.getLen()
            counts["quarantined"] += ".corrupt-" in f.getPath().toString()
        return counts


def policy(setting: str | None) -> tuple[str, str]:
    """Whether an index persists, and why: disabled, canary or enabled; an unknown setting disables it."""
    value = (setting or "").strip().lower()
    if value in ("", "enabled", "on", "1", "true"):
        return "enabled", "default" if not value else "configured"
    if value == "canary":
        return "canary", "configured"
    return "disabled", "configured" if value in ("disabled", "off", "0", "false") else "unknown setting"
