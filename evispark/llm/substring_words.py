"""Substring dedup over words by compaction of a sparse de Bruijn graph.

Token k-mers are the graph's edges. Of each document only those k-mers are kept that have the least hash of some run
of neighbours, so that every window holds one, chosen by the window's own words (a sparse de Bruijn graph, about one
edge in eighteen). Edges that repeat are linked to the next edge where neither branches: all occurrences of the one go
on to the other over the same words, and the other always comes from it. Joins of the links with themselves, doubling
their reach each time, compact every nonbranching path into one row: its first edge, its last one and its length in
words. Where a path's first edge stands, the whole path stands. Every window inside a path occurs in exactly the
documents that hold the path, so that one comparison settles it: the words at each source coordinate of the path are
read again and compared by a 128-bit digest. Windows that reach over a path's end are looked at only where the words
on the longer side of their edge repeat too; those are compared one by one by a 128-bit hash of their words, at their
coordinates. Nothing is sampled: the outcome is that of comparing every window with every other.

Defined cases: null and empty texts have no words; a document shorter than a window keeps all its words; very long texts
are compared whole; a row without doc_id counts as later than every row with one and never makes another one lose words;
rows that share a doc_id do not count as earlier than each other; rows that repeat have the same outcome; an empty table
gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, Rolling, Scratch, SpanHashes, arrow_map, meet, mix, table, window_minima, word_spans, words_of

WINDOW, EDGE = 50, 16


class Hashing:
    """Two independent 64-bit hashes of runs of words."""

    def __init__(self):
        self.words = SpanHashes(0x27D4EB2F165667C5)
        self.one, self.two = Rolling(0xC2B2AE3D27D4EB4F), Rolling(0x165667B19E3779F9)

    def __call__(self, data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of words, and prefixes for both hashes."""
        h = self.words(np.frombuffer(data, np.uint8))
        return len(h), self.one.prefix(h), self.two.prefix(mix(h))


def _edges(one: Rolling, prefix: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the chosen k-mers."""
    hashes = one.windows(prefix, k)
    at = np.unique(window_minima(hashes, window - k + 1)[1])
    return at, hashes[at]


def _identity(docs: DataFrame) -> DataFrame:
    """doc_id, text, ord (doc_id, or later than all), and rid: a hash of both, which rows that share it need not share."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    return docs.select("doc_id", "text", order.alias("ord"), F.xxhash64(order, "text").alias("rid"))


def _sides(window: int, k: int) -> tuple[int, int]:
    """Words before and after an edge, of which every window that holds it covers one or the other."""
    return (window - k) // 2, window - k - (window - k) // 2


def _occurrences(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Rows (edge, ord, rid, pos, gap, after, before, left, right): each chosen edge, how many words on the next one stands,
    hashes of the words up to the next and from the last one, and short hashes of the edge with the words on either side
    (0: there are not so many)."""
    less, more = _sides(window, k)

    def make():
        hashing = Hashing()

        def work(cols: dict) -> dict:
            out: dict[str, list] = {c: [] for c in ("edge", "ord", "rid", "pos", "gap", "after", "before", "left", "right")}
            orders, rids = cols["ord"].to_numpy(), cols["rid"].to_numpy()
            for text, order, rid in zip(cols["text"].to_pylist(), orders, rids, strict=True):
                if len(text or "") < 2 * window - 1:  # too few characters for so many words
                    continue
                n, prefix, other = hashing(text.encode("utf-8"))
                if n < window:
                    continue
                at, edge = _edges(hashing.one, prefix, window, k)
                link = np.zeros(len(at) + 1, np.uint64)
                # the span from an edge's first word to the next edge's last
                link[1:-1] = hashing.two.runs(other, at[:-1], at[1:] + k) | np.uint64(1)
                left = (hashing.two.runs(other, np.maximum(at - less, 0), at + k) | np.uint64(1)).view(np.int64).astype(np.int32)
                right = (hashing.two.runs(other, at, np.minimum(at + k + more, n)) | np.uint64(1)).view(np.int64).astype(np.int32)
                out["edge"].append(edge.view(np.int64))
                out["pos"].append(at.astype(np.int32))
                out["gap"].append(np.diff(at, append=at[-1]).astype(np.int32))
                out["after"].append(link[1:].view(np.int64))
                out["before"].append(link[:-1].view(np.int64))
                out["left"].append(np.where(at >= less, left, 0))
                out["right"].append(np.where(at + k + more <= n, right, 0))
                out["ord"].append(np.full(len(at), order, np.int64))
                out["rid"].append(np.full(len(at), rid, np.int64))
            return {c: np.concatenate(v) for c, v in out.items()} if out["edge"] else None

        return work

    return arrow_map(docs.select("text", "ord", "rid"), "edge bigint, ord bigint, rid bigint, pos int, gap int, after bigint, before bigint, left int, right int", make)


def _same(c: str) -> Column:
    """One value, not 0, at every occurrence."""
    return (F.min(c) == F.max(c)) & (F.min(c) != 0)


def paths(occurrences: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """Rows (edge, last, words, c): every nonbranching path of ``occurrences`` as its first edge, its last one, its length in
    words and how often it stands; edges that link with none are absent."""
    edges = scratch.table(occurrences.groupBy("edge").agg(F.count("*").alias("c"), _same("after").alias("one_after"), _same("before").alias("one_before"), F.min("after").alias("after"), F.min("before").alias("before"), F.min("gap").alias("gap")).where("one_after or one_before"))
    # a span's hash names the two edges that it lies between
    come = edges.where("one_before").select(F.col("before").alias("after"), F.col("edge").alias("to"))
    links = scratch.table(edges.where("one_after").join(come, "after").select("edge", "to", F.col("gap").cast("long").alias("far"), "c"))
    firsts = scratch.table(links.join(links.select(F.col("to").alias("edge")), "edge", "left_anti"))
    scratch.free(edges)
    # a link's reach doubles each time; a text ends, so that no path goes round
    while not firsts.isEmpty():
        on = links.select(F.col("edge").alias("to"), F.col("to").alias("beyond"), F.col("far").alias("more"))
        grow = lambda df: df.join(on, "to", "left").select("edge", F.coalesce("beyond", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), "c", F.col("beyond").isNotNull().alias("grew"))  # noqa: B023, E731
        longer = scratch.table(grow(firsts))
        if longer.where("grew").isEmpty():
            scratch.free(longer)
            break
        twice = scratch.table(grow(links).drop("grew"))
        scratch.free(firsts, links)
        firsts, links = longer.drop("grew"), twice
        scratch.paths[id(firsts)] = scratch.paths.pop(id(longer))
    out = firsts.select("edge", F.col("to").alias("last"), (F.col("far") + k).alias("words"), "c")
    scratch.paths[id(out)] = scratch.paths.pop(id(firsts))
    scratch.free(links)
    return out


def _settle(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Rows (ord, rid, start, stop, w1, w2): the windows of a path by the digest of its words, and open windows by their own hashes."""
    less, _ = _sides(window, k)

    def make():
        hashing = Hashing()

        def work(cols: dict) -> dict | None:
            out: dict[str, list] = {c: [] for c in ("ord", "rid", "start", "stop", "w1", "w2")}

            def add(order, rid, *more):
                n = len(more[0])
                for c, v in zip(out, (np.full(n, order, np.int64), np.full(n, rid, np.int64), *more), strict=True):
                    out[c].append(np.asarray(v))

            orders, rids = cols["ord"].to_numpy(), cols["rid"].to_numpy()
            for text, order, rid, edges in zip(cols["text"].to_pylist(), orders, rids, cols["edges"].to_pylist(), strict=True):
                data = (text or "").encode("utf-8")
                count, prefix, other = hashing(data)
                n = count - window + 1
                if n < 1:
                    continue
                # of a row that only shares the hash of another one, no edge stands at the place named
                listed = [e for e in edges if e["pos"] + max(e["words"], k) <= count]
                at = np.array([e["pos"] for e in listed], np.int64)
                there = hashing.one.runs(prefix, at, at + k).view(np.int64) == np.array([e["edge"] for e in listed], np.int64)
                found = [e for e, t in zip(listed, there.tolist(), strict=True) if t]
                open_ = np.zeros(n, bool)
                for e in found:
                    if e["lopen"]:
                        open_[max(e["pos"] + k - window, 0) : max(e["pos"] - less + 1, 0)] = True
                    if e["ropen"]:
                        open_[max(e["pos"] - less + 1, 0) : e["pos"] + 1] = True
                whole = [(e["pos"], e["words"]) for e in found if e["words"] >= window]
                if whole:
                    first, last = word_spans(np.frombuffer(data, np.uint8))
                    own = (b" ".join(data[first[a] : last[a + m - 1]].split()) for a, m in whole)
                    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in own), ">i8").reshape(-1, 2).astype(np.int64)
                    starts = np.array([a for a, _ in whole], np.int32)
                    stops = np.array([a + m - window + 1 for a, m in whole], np.int32)
                    for a, b in zip(starts, stops, strict=True):
                        open_[a:b] = False
                    add(order, rid, starts, stops, digests[:, 0], digests[:, 1])
                left = np.flatnonzero(open_)
                if len(left):
                    w1 = hashing.one.runs(prefix, left, left + window).view(np.int64)
                    w2 = hashing.two.runs(other, left, left + window).view(np.int64)
                    add(order, rid, left.astype(np.int32), (left + 1).astype(np.int32), w1, w2)
            return {c: np.concatenate(v) for c, v in out.items()} if out["ord"] else None

        return work

    return arrow_map(rows, "ord bigint, rid bigint, start int, stop int, w1 bigint, w2 bigint", make)


def removed_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, k: int = EDGE) -> DataFrame:
    """Rows (ord, rid, spans: array of (start, stop)) of word runs to remove, for rows of ``docs`` that lose some."""
    rows = _identity(docs)
    every = scratch.table(_occurrences(rows, window, k))
    twice = scratch.table(every.groupBy("edge").agg(F.min("ord").alias("least"), F.max("ord").alias("most"), F.count("*").alias("c")).where("least < most").select("edge", "c"))
    occurrences = scratch.table(meet(every, twice, ["edge"], ["rid", "pos"]).drop("c"))
    scratch.free(every, twice)
    scratch.settle()
    found = paths(occurrences, scratch, k)
    # sides of edges that repeat with them
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("words")), F.struct(F.lit(1).alias("side"), F.col("right").alias("words"))))
    repeated = occurrences.select("edge", "ord", sides.alias("s")).where("s.words <> 0").groupBy("edge", "s.side", "s.words").agg(F.min("ord").alias("a"), F.max("ord").alias("b"), F.count("*").alias("c")).where("a < b")
    repeated = scratch.table(repeated.select("edge", "side", "words", "c"))
    entry = lambda words, lopen, ropen: F.struct("edge", "pos", words.cast("int").alias("words"), lopen.alias("lopen"), ropen.alias("ropen")).alias("e")
    no, yes = F.lit(False), F.lit(True)
    parts = [meet(occurrences.select("edge", "rid", "pos"), found, ["edge"], ["rid", "pos"]).select("rid", entry(F.col("words"), no, no))]
    for side, (column, lopen, ropen) in enumerate((("left", yes, no), ("right", no, yes))):
        own = scratch.table(repeated.where(F.col("side") == side).select("edge", F.col("words").alias(column), "c"))
        parts.append(meet(occurrences.select("edge", "rid", "pos", column), own, ["edge", column], ["rid", "pos"]).select("rid", entry(F.lit(0), lopen, ropen)))
    at = scratch.table(parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("rid").agg(F.collect_set("e").alias("edges")))
    scratch.free(occurrences, repeated, found)
    scratch.settle()
    texts = rows.select("ord", "rid", "text").join(at, "rid").select("text", "ord", "rid", "edges")
    settled = scratch.table(_settle(texts, window, k))
    scratch.free(at)
    scratch.settle()
    first = scratch.table(settled.groupBy("w1", "w2").agg(F.min("ord").alias("least"), F.max("ord").alias("most"), F.count("*").alias("c")).where("least < most").select("w1", "w2", "least", "c"))
    spans = meet(settled, first, ["w1", "w2"], ["rid", "start"]).where("ord > least")
    out = scratch.table(spans.groupBy("ord", "rid").agg(F.collect_set(F.struct("start", (F.col("stop") + window - 1).alias("stop"))).alias("spans")))
    scratch.free(settled, first)
    scratch.settle()
    return out


def _kept(n: int, spans: list) -> np.ndarray:
    gone = np.zeros(n + 1, np.int64)
    for s in spans:
        gone[s["start"]] += 1
        gone[min(s["stop"], n)] -= 1
    return np.cumsum(gone)[:n] == 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = EDGE, texts: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, and the kept words' digest (or the kept text)."""
    scratch = Scratch(docs.sparkSession)
    spans = removed_spans(docs, scratch, window, k)
    rows = _identity(docs).join(spans, ["ord", "rid"], "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def work(cols: dict) -> dict:
            n, gone, kept = [], [], []
            for text, s in zip(cols["text"].to_pylist(), cols["spans"].to_pylist(), strict=True):
                words = words_of(text)
                stay = words
                if s:
                    stay = [words[i] for i in np.flatnonzero(_kept(len(words), s))]
                n.append(len(words))
                gone.append(len(words) - len(stay))
                joined = b" ".join(stay)
                kept.append(joined.decode("utf-8") if texts else hashlib.sha256(joined).hexdigest())
            return {"doc_id": cols["doc_id"], "n_words": n, "n_removed": gone, "kept_text" if texts else "kept_sha256": kept}

        return work

    return arrow_map(rows, f"doc_id {kind}, n_words bigint, n_removed bigint, {'kept_text' if texts else 'kept_sha256'} string", make)


def op2_debruijn_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
