"""Benchmark decontamination by SimHash of item-sized windows, a multi-index of Hamming blocks, and exact similarity.

Every run of a document's words as long as a benchmark item is a window of that item. Equal shingles of a window are
numbered, so that each numbered shingle weighs one, a window of any text has as many of them as its item, and weighted
similarity is plain overlap. A fingerprint has, for each of 256 bits, the majority of its numbered shingles' bits. From
the overlap that a similarity of SIMILARITY needs follows the probability that a bit differs, and from that the radius
of each item size: a window at the bound lies within it but for a probability of MISS.

The index cuts an item's fingerprint into blocks and holds all values near each block. Two fingerprints within the
radius have a block that differs in at most radius // blocks bits, so that a window's blocks, looked up as they are,
find every item within its radius. These candidates' whole distances are tested, and what lies within the radius is
verified by the exact similarity of the numbered shingles.

Windows of which less than half of the shingles are found in a bitmap of the whole benchmark's shingles are passed over
before they are fingerprinted: at the bound, eight ninths of a window's shingles are its item's. The bitmap has at most
LOOK bits; a benchmark that fills it costs time, not matches.

The benchmark goes to the tasks in parts of at most ITEMS items and PART bytes, in order of size; the corpus is read
once, however many parts there are, and a task holds one part's index and a bounded buffer of documents at a time.

Defined cases: null or empty documents and items match nothing; an item shorter than a shingle has one shingle, all
its words; equal items match each for itself; rows that repeat each have their rows; words are compared with A-Z in
lower case; texts are scanned whole, however long; a document that has fewer words than an item is one window; a
document that holds an item several times has one row for it, at its most similar (then first) window; null ids are
carried through; an empty table on either side gives no matches; leaks() ignores other columns, decontaminated() passes
them by untouched, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import combinations
from math import ceil, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, SpanHashes, arrow_map, mix, table

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, and the probability that a window at the bound lies beyond its radius.
BITS, MISS = 256, 1e-3
#: Items and bytes of text in one part, and bytes of documents that a task holds while it goes through several parts.
ITEMS, PART, BUFFER = 2000, 1 << 20, 16 << 20
#: Bits of the bitmap of the benchmark's shingles, least and most (as powers of two).
LOOK = (24, 27)
SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def spread(hashes: np.ndarray) -> np.ndarray:
    """Bits (rows of 256 of 0 and 1) of shingles."""
    wide = mix(hashes[:, None] ^ SALTS[None, :])
    return np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")


def numbered(hashes: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The n-th of equal shingles, as one of its own."""
    return np.where(nth > 1, mix(hashes + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), hashes)


def window_bits(h: np.ndarray, size: int) -> np.ndarray:
    """For each window of ``size`` shingles, by start: which of the 256 bits most of its numbered shingles have."""
    n = len(h)
    entering = leaving = None
    values, group = np.unique(h, return_inverse=True)
    if len(values) < n:
        # how many equal shingles a window holds when one enters at its end and when it leaves at its beginning
        key = group.astype(np.int64) * (2 * n + size) + np.arange(n)
        order = np.sort(key)
        rank = np.searchsorted(order, key)
        first = np.searchsorted(order, key - np.minimum(np.arange(n), size - 1))
        last = np.searchsorted(order, key + size)
        entering, leaving = spread(numbered(h, rank - first + 1)), spread(numbered(h, last - rank))
    else:
        entering = leaving = spread(h)
    added = np.zeros((n + 1, BITS), np.int32)
    np.cumsum(entering, axis=0, out=added[1:])
    gone = added
    if leaving is not entering:
        gone = np.zeros((n + 1, BITS), np.int32)
        np.cumsum(leaving, axis=0, out=gone[1:])
    return (2 * (added[size:] - gone[: n - size + 1]) > size).astype(np.uint8)


def needed(n: int, size: int) -> int:
    """Shingles that an item of ``n`` and a window of ``size`` must share to be similar."""
    return ceil(SIMILARITY * (n + size) / (1 + SIMILARITY) - 1e-9)


def _binomial(n: int, p: float) -> np.ndarray:
    """Probabilities of 0 to ``n`` successes."""
    if not 0 < p < 1:
        return np.eye(n + 1)[n if p >= 1 else 0]
    k = np.arange(n + 1)
    logs = lgamma(n + 1) - np.array([lgamma(i + 1) + lgamma(n - i + 1) for i in range(n + 1)]) + k * log(p) + (n - k) * log(1 - p)
    return np.exp(logs)


def _majority(own: np.ndarray, common: int, total: int) -> np.ndarray:
    """For 0 to ``common`` set bits in common, the probability that with one's own more than half of ``total`` are set."""
    tail = np.append(np.cumsum(own[::-1])[::-1], 0.0)
    least = np.floor(total / 2 - np.arange(common + 1)).astype(np.int64) + 1
    return tail[np.clip(least, 0, len(own))]


def differing(n: int, size: int) -> float:
    """The probability that a bit of an item of ``n`` and of a window of ``size`` shingles differs at the bound."""
    m = needed(n, size)
    item, window = _majority(_binomial(n - m, 0.5), m, n), _majority(_binomial(size - m, 0.5), m, size)
    return float((_binomial(m, 0.5) * (item * (1 - window) + window * (1 - item))).sum())


@lru_cache(maxsize=100_000)
def radius(n: int) -> int:
    """The distance beyond which a window at the bound lies with a probability of at most MISS."""
    least = ceil(SIMILARITY * n - 1e-9)
    sizes = range(least, n + 1) if n <= 300 else (least, (least + n) // 2, n)
    p = max(differing(n, s) for s in sizes if needed(n, s) <= s)
    beyond = 1 - np.cumsum(_binomial(BITS, p))
    return int(np.argmax(beyond <= MISS))


class Blocks:
    """How fingerprints are cut for items of one radius: so many blocks that one differs in at most two bits."""

    def __init__(self, radius: int):
        self.radius, self.count = radius, max(16, radius // 3 + 1)
        self.near = radius // self.count
        self.width = ceil(BITS / self.count)
        #: where each bit goes when every block has 16 bits of its own
        at = np.arange(BITS)
        block = at * self.count // BITS
        self.place = block * 16 + at - np.searchsorted(block, block)
        self.flips = np.array([sum(1 << b for b in some) for k in range(self.near + 1) for some in combinations(range(self.width), k)], np.int64)

    def values(self, bits: np.ndarray) -> np.ndarray:
        """Block number and value in one number, a column for each block."""
        wide = np.zeros((len(bits), self.count * 16), np.uint8)
        wide[:, self.place] = bits
        values = np.packbits(wide, axis=1, bitorder="little").view(np.uint16).astype(np.int64)
        return values + (np.arange(self.count) << self.width)[None, :]


class Group:
    """The multi-index of the items of one size."""

    def __init__(self, n: int, bits: np.ndarray):
        self.n, self.blocks = n, Blocks(radius(n))
        self.prints = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        near = self.blocks.values(bits)[:, :, None] ^ self.blocks.flips[None, None, :]
        item = np.broadcast_to(np.arange(len(bits))[:, None, None], near.shape)
        order = np.argsort(near.ravel(), kind="stable")
        self.keys, self.items = near.ravel()[order], item.ravel()[order].astype(np.int32)
        self.look = np.zeros(self.blocks.count << self.blocks.width, bool)
        self.look[self.keys] = True

    def near(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, item and distance of every pair within the radius."""
        values = self.blocks.values(bits)
        window, block = np.nonzero(self.look[values])
        key = values[window, block]
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        sizes = high - low
        at = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        pair = np.unique(np.repeat(window, sizes) * len(self.prints) + self.items[at])
        window, item = pair // len(self.prints), pair % len(self.prints)
        prints = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        distance = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1, dtype=np.int64)
        within = distance <= self.blocks.radius
        return window[within], item[within], distance[within]


class Shingles:
    """Hashes of a text's shingles, the same on every machine."""

    def __init__(self):
        self.words, self.rolling = SpanHashes(0x85EBCA77C2B2AE63), Rolling(0x9FB21C651E98DF25)

    def prefix(self, text: str | None) -> np.ndarray:
        return self.rolling.prefix(self.words(np.frombuffer((text or "").encode("utf-8").lower(), np.uint8)))

    def of(self, prefix: np.ndarray, q: int) -> np.ndarray:
        return self.rolling.windows(prefix, q)

    def item(self, text: str | None) -> tuple[int, np.ndarray]:
        """Words of a shingle, and the shingles of an item."""
        p = self.prefix(text)
        q = min(SHINGLE, len(p) - 1)
        return q, self.of(p, q) if q else np.zeros(0, np.uint64)


class Index:
    """The items of one part: for each length of a shingle and each size, a multi-index."""

    def __init__(self, items: list[tuple[object, str]]):
        shingles = Shingles()
        by: dict[tuple[int, int], list] = {}
        for item, text in items:
            q, h = shingles.item(text)
            if len(h):
                by.setdefault((q, len(h)), []).append((item, h))
        self.groups = []
        for (q, n), own in sorted(by.items()):
            group = Group(n, np.concatenate([window_bits(h, n) for _, h in own]))
            self.groups.append((q, n, group, [i for i, _ in own], [Counter(h.tolist()) for _, h in own]))

    def matches(self, by_length: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[object, int, float, int]]:
        """(item, start, similarity, distance) for each item that some window is similar to, from shingles and how many of
        them, up to each place, are in the benchmark."""
        out = []
        for q, n, group, ids, bags in self.groups:
            if q not in by_length:
                continue
            h, known = by_length[q]
            size = min(n, len(h))
            if needed(n, size) > size:
                continue
            starts = np.flatnonzero(2 * (known[size:] - known[: len(h) - size + 1]) >= size)
            best: dict[int, tuple[float, int, int]] = {}
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1) if len(starts) else []:
                for cut in range(0, len(run), 2048):
                    part = run[cut : cut + 2048]
                    low = int(part[0])
                    bits = window_bits(h[low : int(part[-1]) + size], size)[part - low]
                    for w, i, distance in zip(*(x.tolist() for x in group.near(bits)), strict=True):
                        s = int(part[w])
                        both = sum((Counter(h[s : s + size].tolist()) & bags[i]).values())
                        similarity = both / (size + n - both)
                        if similarity >= SIMILARITY and (i not in best or (similarity, -s) > (best[i][0], -best[i][1])):
                            best[i] = (similarity, s, distance)
            out += [(ids[i], s, similarity, distance) for i, (similarity, s, distance) in sorted(best.items())]
        return out


class Benchmark:
    """What the tasks get: a bitmap of all shingles and the items, part by part."""

    def __init__(self, benchmark: DataFrame, items: int = ITEMS, part: int = PART):
        context = benchmark.sparkSession.sparkContext
        shingles, lengths = Shingles(), set()
        self.parts, now, held = [], [], 0
        rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text", F.size(F.split("text", r"\s+")).alias("n"))
        total = rows.agg(F.sum("n")).first()[0] or 0
        self.bits = min(max(LOOK[0], (64 * total).bit_length()), LOOK[1])
        look = np.zeros(1 << (self.bits - 3), np.uint8)
        for r in rows.orderBy("n", "item_id", "text").toLocalIterator():
            q, h = shingles.item(r.text)
            if not q:
                continue
            lengths.add(q)
            at = h & np.uint64((1 << self.bits) - 1)
            np.bitwise_or.at(look, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            if now and (len(now) >= items or held + len(r.text) > part):
                self.parts.append(context.broadcast(now))
                now, held = [], 0
            now.append((r.item_id, r.text))
            held += len(r.text)
        if now:
            self.parts.append(context.broadcast(now))
        self.lengths, self.look = sorted(lengths), context.broadcast(look)


class Reader:
    """One task's view of the benchmark."""

    def __init__(self, parts, lengths, look, bits):
        self.parts, self.lengths, self.bits, self.shingles = parts, lengths, bits, Shingles()
        self.look = look.value

    def known(self, text: str | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length of a shingle: a text's shingles, and how many of them up to each place may be in the benchmark."""
        out = {}
        if not text:
            return out
        p = self.shingles.prefix(text)
        for q in self.lengths:
            h = self.shingles.of(p, q)
            at = h & np.uint64((1 << self.bits) - 1)
            there = self.look[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            if there.any():
                out[q] = (h, np.append(0, np.cumsum(there, dtype=np.int64)))
        return out

    def matches(self, found: list[dict]) -> list[list[tuple]]:
        """For each of some texts, as known() gives them, what it holds."""
        out: list[list[tuple]] = [[] for _ in found]
        for part in self.parts if found else []:
            index = _index(part)
            for own, x in zip(out, found, strict=True):
                own += index.matches(x)
        return out


_built: dict = {}


def _index(part) -> Index:
    """A part's index: a worker keeps the one it used last."""
    if part not in _built:
        _built.clear()
        _built[part] = Index(part.value)
    return _built[part]


def _buffered(reader: Reader, emit) -> tuple:
    """work and end for arrow_map: ``emit(rows, matches)`` gets rows whose texts share shingles with the benchmark."""
    held: list = []
    state = {"bytes": 0}
    limit = 0 if len(reader.parts) == 1 else BUFFER

    def flush() -> dict | None:
        rows, state["bytes"] = list(held), 0
        held.clear()
        return emit([r for r, _ in rows], reader.matches([x for _, x in rows])) if rows else None

    def add(row, found: dict) -> None:
        held.append((row, found))
        state["bytes"] += sum(16 * len(h) for h, _ in found.values())

    return add, flush, lambda: state["bytes"] > limit


def leaks(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS, part: int = PART) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, window_start (in words), similarity, distance."""
    names = ("doc_id", "item_id", "window_start", "similarity", "distance")
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    b = Benchmark(benchmark, items, part)
    parts, lengths, look, bits = b.parts, b.lengths, b.look, b.bits

    def make():
        reader = Reader(parts, lengths, look, bits)

        def emit(rows: list, found: list) -> dict:
            flat = [(d, *m) for d, own in zip(rows, found, strict=True) for m in own]
            return {c: [r[i] for r in flat] for i, c in enumerate(names)}

        add, flush, full = _buffered(reader, emit)

        def work(cols: dict) -> dict | None:
            for d, t in zip(cols["doc_id"].to_pylist(), cols["text"].to_pylist(), strict=True):
                if found := reader.known(t):
                    add(d, found)
            return flush() if full() else None

        return work, flush

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kinds[0]}, item_id {kinds[1]}, window_start bigint, similarity double, distance int", make)


def decontaminated(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS, part: int = PART) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    text = names[docs.columns.index("text")]
    b = Benchmark(benchmark, items, part)
    parts, lengths, look, bits = b.parts, b.lengths, b.look, b.bits

    def make():
        reader = Reader(parts, lengths, look, bits)

        def emit(rows: list, found: list) -> dict | None:
            clean = [r for r, own in zip(rows, found, strict=True) if not own]
            return {n: pa.concat_arrays([r[n] for r in clean]) for n in names} if clean else None

        add, flush, full = _buffered(reader, emit)

        def work(cols: dict) -> dict | None:
            clean = []
            for i, t in enumerate(cols[text].to_pylist()):
                found = reader.known(t)
                clean.append(not found)
                if found:
                    add({n: cols[n].slice(i, 1) for n in names}, found)
            out = [{n: cols[n].filter(pa.array(clean, pa.bool_())) for n in names}]
            if full() and (more := flush()):
                out.append(more)
            return {n: pa.concat_arrays([x[n] for x in out]) for n in names}

        return work, flush

    return arrow_map(docs.toDF(*names), schema, make, text=text).toDF(*docs.columns)


def op9_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
