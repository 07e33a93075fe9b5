"""An index store of immutable segments: a change writes what has changed, a search reads postings.

Entries (one row a file, as in the other stores) are dealt to buckets by a hash of their path. Every change writes one
segment: the changed entries of each bucket that has any, in a folder of its own, with a mark for those that were
removed. A numbered manifest lists each bucket's segments, newest first; creating the next number is what makes a change
valid, and only one writer can. Readers merge on read: of the versions of a path, the one of the newest segment counts. A
bucket with more than MOST segments is compacted into one, other buckets being left as they are.

Each segment carries postings: for every three neighbouring characters of a field that is searched, in small letters, the rows in
which they stand, in ascending blocks of BLOCK rows, which the file format stores as differences. A term's rows lie in the
intersection of its lists; a term of one or two characters begins some three (fields are filled up at the end), and its
rows lie in a union. Rows that remain are read from their buckets and searched themselves, so that a search gives what
a scan gives. A bucket of one segment, and a list, grow with the bucket alone: the number of buckets is a parameter, to
be set so that one bucket is a task's work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from ..contracts import QueryError
from ..plans.checkpoints import cut
from .commits import Commits
from .store import COLUMNS, ENTRY, _Queries, checksum

SEGMENT_VERSION = 1
BUCKETS, MOST, BLOCK = 64, 4, 1 << 16
GRAM = 3
#: What a segment's rows have beside an entry: their place, the change that wrote them, and whether they remove the path.
ROW = f"{ENTRY}, checksum string, removed boolean, seq bigint, bucket int, row bigint"
POSTING = "gram string, block bigint, rows array<bigint>, seq bigint, bucket int"


def searched(field: Column) -> Column:
    """What a search looks at in one field of a symbol: small letters, filled up so that GRAM characters begin at each one."""
    return F.concat(F.lower(field), F.lit("\0" * (GRAM - 1)))


def grams(text: Column) -> Column:
    """The runs of GRAM characters of ``text``: one pass of a pattern that takes none of what it finds, so that time grows
    with the text's length; a function over the text's characters would be given the whole text again for each of them."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))


def postings(rows: DataFrame) -> DataFrame:
    """(gram, block, rows, seq, bucket) of a segment's rows. Symbols are read one by one, and a row's grams are made
    different before they are shuffled: no list of a whole row's text is held."""
    each = rows.where("not removed").select("seq", "bucket", "row", F.explode("symbols").alias("s"))
    each = each.select("seq", "bucket", "row", F.explode(F.array("s.name", "s.symbol_path", "s.selector")).alias("field")).where("field is not null")
    each = each.select("seq", "bucket", "row", F.explode(grams(searched(F.col("field")))).alias("gram")).distinct()
    return each.groupBy("seq", "bucket", "gram", F.floor(F.col("row") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("row")).alias("rows")).select("gram", "block", "rows", "seq", "bucket")


def matching(lists: DataFrame, term: str) -> DataFrame:
    """(seq, bucket, row): rows of ``lists`` (postings) that may hold ``term``."""
    term = term.lower()
    if len(term) < GRAM:
        return lists.where(F.col("gram").startswith(term)).select("seq", "bucket", F.explode("rows").alias("row")).distinct()
    wanted = sorted({term[i : i + GRAM] for i in range(len(term) - GRAM + 1)})
    met = lists.where(F.col("gram").isin(wanted)).groupBy("seq", "bucket", "block").agg(F.collect_list("rows").alias("lists"))  # at most one list a gram
    both = F.aggregate("lists", F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    return met.where(F.size("lists") == len(wanted)).select("seq", "bucket", F.explode(both).alias("row"))


class SegmentStore(_Queries):
    """The store's contract over segments.

    Defined cases: a project without a manifest is empty; of entries with one path in one change, any one counts (they
    should not occur); removing what is not there writes a mark that compaction drops; a change without rows writes
    nothing; an empty term finds everything; a writer that was overtaken is refused with CONFLICT and its segment is
    deleted; a writer that died leaves a folder that no manifest names.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, most: int = MOST):
        self.spark, self.root, self.buckets, self.most = spark, root.rstrip("/"), buckets, most
        #: folders of segments whose checksums have been verified
        self.sound: set[str] = set()

    def _commits(self, project: str) -> Commits:
        return Commits(self.spark, f"{self.root}/{project}", "manifest")

    def manifest(self, project: str) -> dict:
        """The newest manifest: its number, and the segments of each bucket, newest first."""
        number, body = self._commits(project).latest()
        if number and body.get("schema_version") != SEGMENT_VERSION:
            raise QueryError("INTERNAL_ERROR", f"the index of {project} has another version")
        return {"number": number, "buckets": body.get("buckets", {})}

    def _commit(self, project: str, before: dict, buckets: dict[str, list[str]], segment: str | None = None) -> None:
        """Makes a change valid, unless another one has come in since ``before``; then its segment goes."""
        commits = self._commits(project)
        try:
            commits.create(before["number"], {"schema_version": SEGMENT_VERSION, "buckets": buckets})
        except QueryError:
            if segment:
                commits.delete(segment)
            raise
        # manifests before the last two go, and the segments that only these name
        numbers = commits.numbers()
        named = lambda n: {s for segments in (commits.read(n) or {}).get("buckets", {}).values() for s in segments}
        kept = set().union(*map(named, numbers[:2]))
        for n in numbers[2:]:
            for old in named(n) - kept:
                commits.delete(old)
            commits.delete(f"manifest-{n}.json")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("file_path"), F.lit(self.buckets)).cast("int")

    def _write(self, project: str, rows: DataFrame, seq: int) -> tuple[str, list[str]]:
        """A segment of ``rows`` (entries with removed) and its postings; its name and the buckets that it has."""
        segment = f"seg-{uuid.uuid4().hex}"
        path = f"{self.root}/{project}/{segment}"
        rows = rows.withColumn("bucket", self.bucket()).withColumn("seq", F.lit(seq).cast("long")).withColumn("checksum", checksum())
        rows = rows.withColumn("row", (F.row_number().over(W.partitionBy("bucket").orderBy("file_path")) - 1).cast("long"))
        rows.withColumn("b", F.col("bucket")).write.partitionBy("b").parquet(f"{path}/rows")
        written = self.spark.read.schema(ROW).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
        lists = postings(written).withColumn("b", F.col("bucket")).repartition("b").sortWithinPartitions("b", "gram", "block")
        lists.write.partitionBy("b").option("parquet.writer.version", "v2").parquet(f"{path}/postings")
        return segment, sorted(self._commits(project).names(r"b=(\d+)", f"{segment}/rows"), key=int)

    def _append(self, project: str, rows: DataFrame) -> list[int]:
        """Writes changed entries; the buckets that were written."""
        before = self.manifest(project)
        segment, written = self._write(project, rows.select(*COLUMNS, "removed"), before["number"] + 1)
        if not written:
            self._commits(project).delete(segment)
            return []
        self._commit(project, before, before["buckets"] | {b: [segment, *before["buckets"].get(b, [])] for b in written}, segment)
        if full := [int(b) for b, s in self.manifest(project)["buckets"].items() if len(s) > self.most]:
            self.compact(project, full)
        return [int(b) for b in written]

    def compact(self, project: str, buckets: list[int]) -> None:
        """One segment for each of ``buckets``; the others are not touched."""
        before = self.manifest(project)
        segment, written = self._write(project, self._rows(project, buckets).select(*COLUMNS, F.lit(False).alias("removed")), before["number"] + 1)
        after = {b: s for b, s in before["buckets"].items() if int(b) not in buckets}
        self._commit(project, before, after | {b: [segment] for b in written}, segment)

    def _folders(self, project: str, kind: str, buckets: list[int] | None = None) -> list[tuple[str, int]]:
        """The folders of ``kind`` (rows or postings) that count, with the number of segments of their bucket."""
        found = self.manifest(project)["buckets"]
        return [(f"{self.root}/{project}/{s}/{kind}/b={b}", len(segments)) for b, segments in found.items() if buckets is None or int(b) in buckets for s in segments]

    def _parquet(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _rows(self, project: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows that count of ``buckets`` (all). Only buckets of more than one segment are merged."""
        folders = self._folders(project, "rows", buckets)
        if fresh := [path for path, _ in folders if path not in self.sound]:
            if self._parquet(fresh, ROW).where(~checksum().eqNullSafe(F.col("checksum"))).limit(1).count():
                raise QueryError("INTERNAL_ERROR", f"a checksum of {project} does not hold")
            self.sound.update(fresh)
        alone = self._parquet([path for path, n in folders if n == 1], ROW)
        several = self._parquet([path for path, n in folders if n > 1], ROW)
        newest = several.groupBy("file_path").agg(F.max_by(F.struct(*[c for c in several.columns if c != "file_path"]), "seq").alias("x")).select("file_path", "x.*")
        return alone.unionByName(newest).where("not removed")

    def load(self, project: str) -> DataFrame:
        return self._rows(project).select(*StructType.fromDDL(ENTRY).names)

    def candidates(self, project: str, query: str) -> DataFrame:
        """Entries that may hold ``query``: by postings, then from the buckets in which there are any."""
        if not query:
            return self.load(project)
        commits, at = self._commits(project), len(f"{self.root}/{project}/")
        with_lists = {f"{s}/postings/b={b}" for s in {x for v in self.manifest(project)["buckets"].values() for x in v} for b in commits.names(r"b=(\d+)", f"{s}/postings")}
        lists = self._parquet([path for path, _ in self._folders(project, "postings") if path[at:] in with_lists], POSTING)
        met = cut(matching(lists, query))
        touched = [r.bucket for r in met.select("bucket").distinct().collect()]  # at most as many as there are buckets
        # a path's older versions are dropped by the merge, whichever of them the postings name
        return self._rows(project, touched).join(met, ["seq", "bucket", "row"], "left_semi").select(*StructType.fromDDL(ENTRY).names)

    def upsert(self, project: str, entries: DataFrame) -> list[int]:
        return self._append(project, entries.select(*COLUMNS, F.lit(False).alias("removed")))

    def _marks(self, paths: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in StructType.fromDDL(ENTRY)}
        return paths.select("file_path", *[F.lit(None).cast(kinds[c]).alias(c) for c in COLUMNS if c != "file_path"], F.lit(True).alias("removed"))

    def remove(self, project: str, paths: list[str]) -> list[int]:
        return self._append(project, self._marks(self.spark.createDataFrame([(p,) for p in paths], "file_path string")))

    def refresh(self, project: str, plan: DataFrame, rebuilt: DataFrame) -> dict[str, int]:
        """Applies a refresh plan in one change: rebuilt entries, and marks for what was removed."""
        counts = {r.action: r["count"] for r in plan.groupBy("action").count().collect()}
        gone = self._marks(plan.where("action = 'remove'").select("file_path"))
        self._append(project, rebuilt.select(*COLUMNS, F.lit(False).alias("removed")).unionByName(gone))
        return {k: counts.get(k, 0) for k in ("rebuild", "reuse", "remove")}

    def clear(self, project: str) -> None:
        self._commit(project, self.manifest(project), {})
