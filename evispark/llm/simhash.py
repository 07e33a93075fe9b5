"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, with exclusive-or and bit counts in numpy, tile by tile. A tile holds the
fingerprints of one band of bit counts, as wide as the radius and one; only tiles of the same or of neighbouring bands
are paired, for beyond these the bit counts differ by more than the radius. To keep the number of tile pairs in
proportion to the input, 64 bits are cut into six blocks first: at most four differing bits leave two blocks untouched,
so that two linked fingerprints meet in the tiles of one of the fifteen pairs of blocks. A tile of more than TILE
fingerprints is dealt by hash to several, each of which meets each of the others. No link is lost, and no cap is set.
Each task gives a spanning forest of the links it found, so that a group of n near copies gives about n rows, and
components follow from joins.

Defined cases: null texts and texts without words have fingerprint zero, linked like any other; very long texts are
hashed whole; null doc_id is never a component's id unless the component has no other; equal texts and repeated rows
have equal fingerprints and one component; ties for the document that stays go to the least text, then to one row; an
empty table gives an empty result; near_duplicates() ignores other columns, keep_one() passes them by untouched,
whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SALTS, Scratch, arrow_map, components, forest, meet, table

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Blocks of the 64 bits: (first bit, bits). Radius plus two blocks, so that any two linked fingerprints agree on two.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Fingerprints that a tile holds before they are dealt by hash.
TILE = 2048


def shingle_hashes(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by one space; of the whole sequence if it is shorter; none without words."""
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    buf = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(buf, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    return np.fromiter([digest(buf[a:b], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)], np.uint64, len(words) - size + 1)


def fingerprints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array, the 64 bits that are set in over half of its numbers."""
    out = np.zeros(len(hashes), np.uint64)
    for i, h in enumerate(hashes):
        if len(h):
            counts = np.zeros(64, np.int64)
            for at in range(0, len(h), 16384):
                part = h[at : at + 16384]
                counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id (or the columns of ``carry``) and fp, the fingerprint as a signed long."""
    carry = carry or ["doc_id"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def make():
        def work(cols: dict) -> dict:
            # bytes.lower() changes A-Z alone; bytes.split() gives the words
            hashes = [shingle_hashes((t or "").encode("utf-8").lower().split()) for t in cols["text"].to_pylist()]
            return {c: cols[c] for c in carry} | {"fp": fingerprints_of(hashes).view(np.int64)}

        return work

    return arrow_map(docs.select(*dict.fromkeys([*carry, "text"])), f"{kinds}, fp bigint", make)


def _tiles(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (tile, fp): every two of ``prints`` (fp, all different) that agree on two blocks meet in a tile."""
    block = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << n) - 1) for a, n in BLOCKS]
    rows = [F.struct(F.lit(i).alias("pair"), F.shiftleft(block[p], 11).bitwiseOR(block[q]).alias("value")) for i, (p, q) in enumerate(combinations(range(len(BLOCKS)), 2))]
    placed = prints.select("fp", F.explode(F.array(*rows)).alias("r")).select("fp", "r.pair", "r.value", F.bit_count("fp").alias("bits"))
    sizes = placed.groupBy("pair", "value").agg(F.count("*").alias("n")).where("n > 1")
    # a row of more than TILE is dealt to ``cut`` parts, and every two of them meet
    cut = F.ceil(F.col("n") / TILE).cast("long")
    met = placed.join(sizes, ["pair", "value"]).select("fp", "pair", "value", F.floor(F.col("bits") / (RADIUS + 1)).alias("band"), cut.alias("cut"), F.pmod(F.xxhash64("fp", F.lit(7)), cut).alias("part"))
    # the pair of bands (b, b + 1) is compared under b; a fingerprint of band b stands in it and in (b - 1, b)
    spread = met.withColumn("low", F.explode(F.array(F.col("band") - 1, F.col("band")))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)))
    return spread.select("fp", F.xxhash64("pair", "value", "low", F.least("part", "other"), F.greatest("part", "other")).alias("tile"))


def _compare(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within each tile: in each task, a forest that has the same components as all links it found."""

    def make():
        state: dict = {"tile": np.zeros(0, np.int64), "fp": np.zeros(0, np.uint64), "parent": {}}

        def links(tile: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
            bits = np.bitwise_count(fp).astype(np.int64)
            out, signed = [], fp.view(np.int64)
            near = np.flatnonzero(tile[1:] == tile[:-1])
            step = 1
            while len(near):
                # rows of a tile are in order of bit count: beyond the radius, no later row can be near
                near = near[bits[near + step] - bits[near] <= radius]
                hit = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= radius]
                if len(hit):
                    out += forest(signed[hit], signed[hit + step], state["parent"])
                step += 1
                near = near[near + step < len(tile)]
                near = near[tile[near] == tile[near + step]]
            if len(state["parent"]) > 200_000:
                state["parent"].clear()
            return out

        def work(cols: dict) -> dict:
            tile = np.concatenate([state["tile"], cols["tile"].to_numpy()])
            fp = np.concatenate([state["fp"], cols["fp"].to_numpy().view(np.uint64)])
            # the last tile may go on in the next batch; what is done now is compared again only there
            begin = int(np.searchsorted(tile, tile[-1]))
            found = links(tile, fp)
            state["tile"], state["fp"] = tile[begin:], fp[begin:]
            return {"a": [x for x, _ in found], "b": [y for _, y in found]}

        return work

    dealt = rows.repartition("tile").withColumn("bits", F.bit_count("fp")).sortWithinPartitions("tile", "bits").select("tile", "fp")
    return arrow_map(dealt, "a bigint, b bigint", make, text=None)


def classes(prints: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """For ``prints`` (doc_id, fp): rows (fp, root, component_id, c) for each different fingerprint and the number of its rows, written."""
    if radius != RADIUS:
        raise ValueError(f"the tiles guarantee radius {RADIUS}")
    ids = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")))
    edges = scratch.table(_compare(_tiles(ids.select("fp"), scratch), radius))
    roots = components(edges, scratch)
    scratch.free(edges)
    rooted = ids.join(roots, ids.fp == roots.node, "left").select("fp", "least", "c", F.coalesce("root", "fp").alias("root"), F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"))
    # a component may hold very many fingerprints: they meet its id in several tasks
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = scratch.table(rooted.join(least, ["root", "salt"]).select("fp", "root", "component_id", "c"))
    scratch.free(ids, roots)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.table(fingerprints(docs))
    found = classes(prints, scratch)
    # equal and empty texts have one fingerprint: its rows are dealt to several tasks
    return meet(prints, found, ["fp"], ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component, one row with the least doc_id (ties: the least text) stays."""
    scratch = Scratch(docs.sparkSession)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    prints = scratch.table(fingerprints(hashed, ["doc_id", "text_hash"]))
    found = classes(prints, scratch)
    # a component's rows that have its least doc_id: more than one only where ids repeat
    first = meet(prints, found, ["fp"], ["doc_id"]).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    chosen = first.select(F.col("k.doc_id").alias("chosen_id"), F.col("k.text_hash").alias("chosen_hash")).distinct()
    # the caller's columns travel in a struct, so that none of their names clashes
    plain = [c for c, k in docs.dtypes if "map<" not in k and "variant" not in k]  # of which there are hashes
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64(*plain).alias("place"))
    stay = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("text_hash") == F.col("chosen_hash")), "left_semi")
    one = W.partitionBy("doc_id", "text_hash").orderBy("place")
    return stay.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row.*")


def op5_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
