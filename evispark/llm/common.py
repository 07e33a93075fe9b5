"""Shared pieces of the training-data operators.

Everything here is size-independent: per-partition Arrow mappers that hold one slice of rows at a time,
tables written to the shared scratch folder to cut lineage, and connected components by joins.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes of text that a Python worker turns into objects at once.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20
#: Order of a row without doc_id: after every row that has one.
LAST_ID = (1 << 63) - 1
#: Tasks over which the rows of one key are dealt where a key may hold very many.
SALTS = 8
#: Rows of one key from which they are dealt to several tasks, where the number is known, and the most such keys that are
#: sent to every task.
HOT, HOT_KEYS = 100_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], stem: str) -> str:
    """A column name like ``stem`` that no column in ``taken`` has, whatever the case of its letters."""
    used = {c.lower() for c in taken}
    while stem.lower() in used:
        stem += "_"
    return stem


def fold() -> Column:
    """crc32 of doc_id as text modulo 4; remainder 2 is held out. A null doc_id is in no fold but learns nothing."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def held_out() -> Column:
    return F.coalesce(fold() == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() cuts at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text's UTF-8 bytes begin and end: those that bytes.split() gives."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _GAP[raw], [True]])))
    return edge[0::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(28))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any run of a sequence of 64-bit values, from prefix sums of value * base**i modulo 2**64."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15 | 5):
        self.base = base & (2**64 - 1)
        self.inverse = pow(self.base, -1, 2**64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            m = max(n + 1, 2 * len(self.up), 1 << 14)
            for name, b in (("up", self.base), ("down", self.inverse)):
                powers = np.full(m, b, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each [start, end)."""
        return mix((prefix[ends] - prefix[starts]) * self.down[starts])

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Hashes of every run of ``size`` values, by start."""
        n = len(prefix) - size
        return mix((prefix[size:] - prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


class SpanHashes:
    """Hashes of all words of a text at once, each by its bytes alone."""

    def __init__(self, seed: int):
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed | 1))
        self.rolling = Rolling(0xD6E8FEB86659FD93)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        starts, ends = word_spans(raw)
        return self.rolling.runs(self.rolling.prefix(self.values[raw]), starts, ends)


def window_minima(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, positions): from each start to the next, windows of ``width`` hashes have their leftmost minimum there.

    If there are fewer hashes, one window holds them all. The choice depends on the hashes in the window alone, so equal
    stretches choose alike wherever they lie.
    """
    n = len(hashes)
    if n <= width:
        return (np.zeros(1, np.int64), np.array([int(hashes.argmin())])) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    # blockwise minima from the left and from the right; a window is a tail of one block and a head of the next
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = hashes
    grid = padded.reshape(blocks, width)
    heads = np.minimum.accumulate(grid, axis=1).ravel()
    tails = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tails[: n - width + 1], heads[width - 1 : n])
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    stop = np.append(first[1:], len(least))
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)

    def leftmost(starts: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 21) // width)
        return np.concatenate([starts[i : i + step] + view[starts[i : i + step]].argmin(axis=1) for i in range(0, len(starts), step)] or [starts])

    # a minimum below the last one has just come in; otherwise the last one has just left
    entered = np.zeros(len(first), bool)
    entered[1:] = least[first[1:]] < least[first[1:] - 1]
    at = first + width - 1
    at[~entered] = leftmost(first[~entered])
    starts, places = [first], [at]
    # where the value stays and its place is left behind, an equal value follows
    while (late := at + 1 < stop).any():
        first, stop = at[late] + 1, stop[late]
        at = leftmost(first)
        starts.append(first)
        places.append(at)
    starts, places = np.concatenate(starts), np.concatenate(places)
    order = np.argsort(starts, kind="stable")
    return starts[order], places[order]


def slices(batches: Iterable[pa.RecordBatch], text: str | None = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that one slice holds few rows and, single long texts apart, few bytes."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if text is None or n == 0:
            if n:
                yield batch
            continue
        sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(batch.column(text)).to_pylist()])
        total = np.cumsum(sizes)
        while at < n:
            before = total[at - 1] if at else 0
            end = int(np.searchsorted(total, before + SLICE_BYTES, "right"))
            end = max(at + 1, min(end, at + SLICE_ROWS, n))
            yield batch.slice(at, end - at)
            at = end


def give_back() -> None:
    """Returns what a finished task has freed to the system: a worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict]], text: str | None = "text") -> DataFrame:
    """``make()`` runs once a partition and gives a function from a slice's columns to the columns of ``schema``.

    Where it gives two functions, the second one is called at the partition's end and may give more rows.
    """
    kinds = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)

    def rows(out: dict | None) -> Iterator[pa.RecordBatch]:
        if out is not None:
            cols = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in ((out[f.name], f) for f in arrow)]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        work, end = work if isinstance(work, tuple) else (work, None)
        for part in slices(batches, text):
            yield from rows(work({name: part.column(name) for name in part.schema.names}))
        if end is not None:
            yield from rows(end())
        part = work = end = None
        give_back()

    return df.mapInArrow(run, kinds)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset and the master is local, as in tests, a folder of this machine."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/evispark-{uuid.uuid4().hex}"
    if not known.isDefined():
        context.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the folder that all executors share, to cut lineage and to be read more than once.

    Reading them back survives lost executors. Each is deleted as soon as no later step reads it; those that a result
    still reads are deleted when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = shared_folder(spark)
        self.paths: dict[int, str] = {}

    def _at(self, path: str) -> tuple:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/evispark-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        where, system = self._at(path)
        system.deleteOnExit(where)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def free(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                where, system = self._at(path)
                system.delete(where, True)
                system.cancelDeleteOnExit(where)

    def settle(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now: it does so when the driver has collected its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()


def meet(rows: DataFrame, keyed: DataFrame, on: list[str], by: list[str], count: str = "c") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key and, as ``count``, about how many of ``rows`` have that key.

    The rows of a key with more than HOT are dealt to several tasks by a hash of ``by``. Such keys are broadcast if they are
    at most HOT_KEYS, else joined. ``keyed`` is read more than once and should be a written table.
    """
    cut = F.ceil(F.col(count) / HOT).cast("int")
    hot = keyed.where(F.col(count) > HOT).select(*on, cut.alias("cut"))
    few = hot.limit(HOT_KEYS + 1).count() <= HOT_KEYS
    dealt = rows.join(F.broadcast(hot) if few else hot, on, "left").withColumn("salt", F.pmod(F.xxhash64(*by), F.coalesce("cut", F.lit(1))).cast("int")).drop("cut")
    spread = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(cut, F.lit(1)) - 1)))
    return dealt.join(spread, [*on, "salt"]).drop("salt")


def forest(a: np.ndarray, b: np.ndarray, parent: dict) -> list[tuple[int, int]]:
    """Those of the links (a, b) that join two trees of ``parent``, which is updated; the others add nothing."""

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        r, s = root(x), root(y)
        if r != s:
            parent[max(r, s)] = min(r, s)
            out.append((x, y))
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, root), root the least node; nodes without edges are absent.

    Alternates two star rewritings that keep components: every neighbour above a node links to the least neighbour,
    then every neighbour below it does. The number of rounds grows with the logarithm of the longest chain. Least
    neighbours come from aggregates that combine before the shuffle, and the links of one node are dealt to SALTS tasks
    where they meet it, so that a node with very many links is no bottleneck. Links are never listed on the driver.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.table(e)
    mark = None

    def with_least(links: DataFrame) -> DataFrame:
        least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"])

    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = with_least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        after = scratch.table(small)
        scratch.free(now)
        now = after
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == mark:
            break
        mark = new
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    out = scratch.table(nodes)
    scratch.free(now)
    return out
