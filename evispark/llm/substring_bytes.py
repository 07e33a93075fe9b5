"""Substring dedup over bytes by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A string of the threshold's length holds an anchor: the leftmost least hash of its k-grams, chosen by the string's own
bytes. Strings that are equal have equal anchors, so that the corpus falls apart into groups of stretches around
equal anchors, and a stretch whose anchor and further context occur once needs no more work. Where all occurrences of
two neighbouring anchors agree in everything between them, what lies inside is settled for all of them at once.
Groups of different stretches are packed into blocks of bounded size. Each block's Burrows-Wheeler transform is
extended backward, breadth first from the empty string: the intervals of length l settle where neighbouring suffixes
share exactly l bytes, so that common prefixes come out by increasing value, and at the threshold the search stops:
what is not settled then is shared over at least the threshold. A group that would not fit a block is split by further
context, the bytes before or after what its strings have in common, half of what is left each time, until its parts
fit. Nothing is sampled or capped, and every comparison is a transform's.

Repeats that are shorter than the threshold are never removed, but they show in n_repeated, which counts the bytes of
anchors that stand elsewhere too and of what is removed. Every string of SHORT bytes (about fifty words) holds an anchor
of its own size, and these are the anchors that are looked for; those of the longer strings are among them. So
n_repeated is above 0 for every text with a repeated string of SHORT bytes, and every byte in it belongs to a repeated
run of ANCHOR bytes.

Defined cases: null texts are empty; a text shorter than the threshold stays whole; very long texts are compared whole;
strings may overlap and may repeat within their own text; rows that repeat are each other's repeats; an empty table
gives an empty result; the doc_id may be null or repeat, and columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, Scratch, arrow_map, meet, mix, table, window_minima

LENGTH, SHORT, ANCHOR = 400, 250, 100
#: Symbols from which a block is full, and symbols of a group beyond which it is split by further context.
BLOCK, GROUP = 1 << 18, 2 << 20


class Hashing:
    """Two independent 64-bit hashes of runs of bytes."""

    def __init__(self):
        self.values = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(s)) for s in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)]
        self.one, self.two = Rolling(0xC2B2AE3D27D4EB4F), Rolling(0x165667B19E3779F9)

    def prefixes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.one.prefix(self.values[0][raw]), self.two.prefix(self.values[1][raw])


def _identity(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes that rows share only if they are equal in both."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.hash("text", "doc_id").alias("r2"))


def _occurrences(rows: DataFrame, length: int, short: int, k: int) -> DataFrame:
    """Rows (edge, r1, r2, pos, after, before): anchors of strings of ``short`` bytes; of those that are anchors of ``length``
    bytes too, hashes of the bytes up to the next such anchor and from the last one (0: none), which are null for others."""

    def make():
        hashing = Hashing()

        def work(cols: dict) -> dict | None:
            out: dict[str, list] = {c: [] for c in ("edge", "r1", "r2", "pos", "after", "before", "far")}
            for text, r1, r2 in zip(cols["text"].to_pylist(), cols["r1"].to_pylist(), cols["r2"].to_pylist(), strict=True):
                raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
                if len(raw) < short:
                    continue
                one, two = hashing.prefixes(raw)
                grams = hashing.one.windows(one, k)
                starts, places = window_minima(grams, short - k + 1)
                at = np.unique(places)
                far = at[:0]
                if len(raw) >= length:
                    # the least of a longer run is the least of one of the two shorter ones that cover it
                    least = np.repeat(places, np.diff(np.append(starts, len(raw) - short + 1)))
                    first, second = least[: len(raw) - length + 1], least[length - short :]
                    far = np.where(grams[first] <= grams[second], first, second)
                    far = np.unique(far[np.append(True, far[1:] != far[:-1])])
                link = np.zeros(len(far) + 1, np.uint64)
                if len(far) > 1:
                    link[1:-1] = hashing.two.runs(two, far[:-1], far[1:] + k) | np.uint64(1)
                there = np.isin(at, far)
                after, before = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
                after[there], before[there] = link[1:][: len(far)], link[:-1][: len(far)]
                for c, v in zip(out, (grams[at].view(np.int64), np.full(len(at), r1, np.int64), np.full(len(at), r2, np.int32), at.astype(np.int32), after.view(np.int64), before.view(np.int64), there), strict=True):
                    out[c].append(v)
            return {c: np.concatenate(v) for c, v in out.items()} if out["edge"] else None

        return work

    found = arrow_map(rows.select("text", "r1", "r2"), "edge bigint, r1 bigint, r2 int, pos int, after bigint, before bigint, far boolean", make)
    return found.select("edge", "r1", "r2", "pos", *[F.when(F.col("far"), F.col(c)).alias(c) for c in ("after", "before")])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where each row's structs begin and end, and their fields; a null field is -1."""
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    fields = [flat.type.field(i).name for i in range(flat.type.num_fields)]
    values = {c: v.fill_null(False if pa.types.is_boolean(v.type) else -1).to_numpy(zero_copy_only=False) for c, v in zip(fields, flat.flatten(), strict=True)}
    return np.append(0, ends).astype(np.int64), values


def _settle(rows: DataFrame, length: int, k: int) -> DataFrame:
    """Rows (r1, r2, start, n, g, f, core, bytes): runs of n settled string starts (g null), and open stretches by group g and
    hash f, with the place of the bytes that the whole group has in common."""
    half = (length - k) // 2

    def make():
        hashing = Hashing()

        def work(cols: dict) -> dict | None:
            out: dict[str, list] = {c: [] for c in ("r1", "r2", "start", "n", "g", "f", "core", "bytes")}
            kinds = dict(zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True))

            def add(r1, r2, start, *more):
                m = len(start)
                for c, v in zip(out, (np.full(m, r1), np.full(m, r2), np.asarray(start), *more), strict=True):
                    out[c].append(pa.nulls(m, kinds[c]) if v is None else pa.array(v, kinds[c]))

            ends, edges = _lists(cols["edges"])
            for i, (text, r1, r2) in enumerate(zip(cols["text"].to_pylist(), cols["r1"].to_pylist(), cols["r2"].to_pylist(), strict=True)):
                data = text.encode("utf-8")
                n = len(data) - length + 1
                mine = slice(ends[i], ends[i + 1])
                far = edges["far"][mine]
                at, joined = edges["pos"][mine][far].astype(np.int64), edges["joined"][mine][far]
                if n < 1 or not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, joined = at[order], joined[order]
                # paths of joined anchors, from each first one to the one that goes on otherwise
                last = np.flatnonzero(~joined | (np.arange(len(at)) == len(at) - 1))
                first = np.append(0, last[:-1] + 1)
                begin, end = at[first], np.minimum(at[last] + k - length + 1, n)
                begin, end = begin[end > begin], end[end > begin]
                inside = np.zeros(n + 1, np.int64)
                np.add.at(inside, begin, 1)
                np.add.at(inside, end, -1)
                inside = np.cumsum(inside)[:n] > 0
                if len(begin):
                    add(r1, r2, begin, end - begin, None, None, None, None)
                if inside.all():
                    continue
                raw = np.frombuffer(data, np.uint8)
                one, two = hashing.prefixes(raw)
                starts, places = window_minima(hashing.one.windows(one, k), length - k + 1)
                anchor = np.repeat(places, np.diff(np.append(starts, n)))
                known = np.zeros(len(raw), bool)
                known[at] = True
                open_ = known[anchor] & ~inside
                if not open_.any():
                    continue
                s = np.flatnonzero(open_)
                a = anchor[s]
                left = a - s >= half
                cut = np.flatnonzero(np.append(True, (np.diff(s) > 1) | (np.diff(a) != 0) | (left[1:] != left[:-1])))
                count = np.diff(np.append(cut, len(s)))
                s, a, left = s[cut], a[cut], left[cut]
                low = np.where(left, a - half, a)
                g = mix(hashing.two.runs(two, low, low + half + k) + left.astype(np.uint64))
                f = mix(hashing.one.runs(one, s, s + count + length - 1) + count.astype(np.uint64))
                add(r1, r2, s, count, g.view(np.int64), f.view(np.int64), low - s, [data[x : x + c + length - 1] for x, c in zip(s.tolist(), count.tolist(), strict=True)])
            return {c: pa.concat_arrays(v) for c, v in out.items()} if out["r1"] else None

        return work

    return arrow_map(rows, "r1 bigint, r2 int, start int, n int, g bigint, f bigint, core int, bytes binary", make)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes in order of at least their first ``depth`` symbols, by doubling."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    padded = np.zeros(n + 2, np.int64)
    padded[:n] = rank + 1
    base = int(padded.max()) + 1
    key = (padded[:n] * base + padded[1 : n + 1]) * base + padded[2 : n + 2] if base < 1 << 20 else None
    h = 3
    if key is None:
        key, h = padded[:n], 1
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if h >= depth or new.all():
            return order
        later = np.zeros(n, np.int64)
        later[: n - h] = rank[h:]
        key = rank * (n + 1) + later
        h *= 2


def shared_suffixes(symbols: np.ndarray, threshold: int) -> np.ndarray:
    """Starts of suffixes whose first ``threshold`` symbols also start elsewhere in ``symbols``."""
    n = len(symbols)
    order = suffix_order(symbols, threshold)
    bwt = symbols[order - 1]
    size = int(symbols.max()) + 1
    # where the suffix that is longer by the symbol before stands
    step = np.empty(n, np.int64)
    step[np.argsort(bwt, kind="stable")] = np.arange(n)
    #: whether the common prefix of suffixes i - 1 and i, in order, is known to be shorter than the threshold
    settled = np.zeros(n + 1, bool)
    settled[0] = settled[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(threshold):
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(len(owner)) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        key = owner * size + bwt[at]
        if len(low) < len(at):
            sort = np.argsort(key, kind="stable")
            key, at = key[sort], at[sort]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = np.append(first[1:], len(key)) - 1
        low, high = step[at[first]], step[at[last]] + 1
        new = ~settled[high]
        low, high = low[new], high[new]
        settled[high] = True
        if not len(low):
            break
    shared = ~settled
    return order[shared[:n] | shared[1:]]


def repeated_starts(sequences: list[np.ndarray], threshold: int) -> list[np.ndarray]:
    """For each of some different sequences, the starts of its strings of ``threshold`` symbols that also start elsewhere in them."""
    ends = np.cumsum([len(x) + 1 for x in sequences])
    begin = np.append(0, ends[:-1])
    symbols = np.full(int(ends[-1]), -1, np.int64)
    for b, x in zip(begin, sequences, strict=True):
        symbols[b : b + len(x)] = x
    # few numbers in the same order, then for each sequence an end of its own, which no other string holds
    used, small = np.unique(symbols[symbols >= 0], return_inverse=True)
    symbols[symbols >= 0] = small
    symbols[ends - 1] = len(used) + np.arange(len(ends))
    starts = np.sort(shared_suffixes(symbols, threshold))
    of = np.searchsorted(ends, starts, "right")
    return np.split(starts - begin[of], np.searchsorted(of, np.arange(1, len(ends))))


def condensed(stretch: bytes, core: int, size: int, symbol: int) -> np.ndarray:
    """A stretch as symbols, the ``size`` bytes from ``core`` on being one."""
    x = np.frombuffer(stretch, np.uint8)
    return np.concatenate([x[:core], [symbol], x[core + size :]]).astype(np.int64)


def _runs(starts: np.ndarray) -> list[dict]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.append(True, np.diff(starts) > 1))
    return [{"a": a, "n": n} for a, n in zip(starts[cut].tolist(), np.diff(np.append(cut, len(starts))).tolist(), strict=True)]


def _expand(stretches: DataFrame, size: int, length: int) -> DataFrame:
    """For different stretches (g, f, core, bytes) whose groups share ``size`` bytes: rows (g, f, runs) of those with repeats
    of ``length`` bytes, found block by block.

    The shared bytes count as one symbol. All strings of a stretch hold them, and no other string of as many symbols as
    they have then is long enough.
    """

    def make():
        state: dict = {"rows": [], "symbols": 0}

        def flush(whole: bool) -> dict | None:
            rows = state["rows"]
            # the last group may go on in the next batch
            end = len(rows)
            if not whole:
                while end and rows[end - 1][0] == rows[-1][0]:
                    end -= 1
            done, state["rows"] = rows[:end], rows[end:]
            state["symbols"] = sum(len(x[2]) - size + 2 for x in state["rows"])
            if not done:
                return None
            names = {g: 256 + i for i, g in enumerate(dict.fromkeys(x[0] for x in done))}
            found = repeated_starts([condensed(x[2], x[3], size, names[x[0]]) for x in done], length - size + 1)
            got = [(x[0], x[1], _runs(s)) for x, s in zip(done, found, strict=True) if len(s)]
            return {"g": [x[0] for x in got], "f": [x[1] for x in got], "runs": [x[2] for x in got]}

        def work(cols: dict) -> dict | None:
            out: dict = {"g": [], "f": [], "runs": []}
            for row in zip(*(cols[c].to_pylist() for c in ("g", "f", "bytes", "core")), strict=True):
                state["rows"].append(row)
                state["symbols"] += len(row[2]) - size + 2
                part = flush(False) if state["symbols"] >= BLOCK and row[0] != state["rows"][-2:][0][0] else None
                for c in out if part else ():
                    out[c] += part[c]
            return out

        return work, lambda: flush(True)

    parts = int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stretches.select("g", "f", "core", "bytes").repartition(parts, "g").sortWithinPartitions("g")
    return arrow_map(dealt, "g bigint, f bigint, runs array<struct<a:int,n:int>>", make, text="bytes")


def _part(pieces: DataFrame, size: int, more: int, length: int) -> DataFrame:
    """Pieces (g, f, c, n, core, bytes, rg, rf, off) cut in two by which of their strings have ``more`` bytes before what the
    group shares, and grouped by that and these bytes; for the others, by the bytes after it."""

    def make():
        hashing = Hashing()

        def work(cols: dict) -> dict:
            out: dict[str, list] = {c: [] for c in ("g", "f", "c", "n", "core", "bytes", "rg", "rf", "off")}
            for c, n, core, data, rg, rf, off in zip(*(cols[c].to_pylist() for c in ("c", "n", "core", "bytes", "rg", "rf", "off")), strict=True):
                one, two = hashing.prefixes(np.frombuffer(data, np.uint8))
                left = min(max(core - more + 1, 0), n)
                for side, a, b in ((1, 0, left), (0, left, n)):
                    if b > a:
                        low, end = (core - more if side else core), b + length - 1
                        g = mix(hashing.two.runs(two, np.array([low]), np.array([low + size + more])) + np.uint64(side))
                        f = mix(hashing.one.runs(one, np.array([a]), np.array([end])) + np.uint64(b - a))
                        for name, v in zip(out, (int(g.view(np.int64)[0]), int(f.view(np.int64)[0]), c, b - a, low - a, data[a:end], rg, rf, off + a), strict=True):
                            out[name].append(v)
            return out

        return work

    return arrow_map(pieces, "g bigint, f bigint, c bigint, n int, core int, bytes binary, rg bigint, rf bigint, off int", make, text="bytes")


def _kinds(pieces: DataFrame) -> DataFrame:
    """The different stretches of each group and how often they stand."""
    return pieces.groupBy("g", "f").agg(F.sum("c").alias("c"), *[F.any_value(c).alias(c) for c in ("n", "core", "bytes")])


def _loads(kinds: DataFrame, size: int) -> DataFrame:
    """Groups with more than one stretch and the symbols that their transform takes."""
    return kinds.groupBy("g").agg(F.count("*").alias("c"), F.sum(F.length("bytes") - size + 2).alias("symbols")).where("c > 1")


def _copied(kinds: DataFrame) -> DataFrame:
    """Rows (g, f, runs) of stretches that stand more than once: all their strings repeat."""
    return kinds.where("c > 1").select("g", "f", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("n"))).alias("runs"))


def _told(pieces: DataFrame, found: DataFrame, scratch: Scratch, by: list[str]) -> DataFrame:
    """``pieces`` with the runs that ``found`` (g, f, runs) has for their stretch; those without any are left out. A stretch that
    stands very often is dealt to several tasks."""
    each = found.groupBy("g", "f").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))  # one list for each time a group was split
    counts = pieces.groupBy("g", "f").agg(F.count("*").alias("c"))
    return meet(pieces, scratch.table(each.join(counts, ["g", "f"])), ["g", "f"], by).drop("c")


def _compared(pieces: DataFrame, scratch: Scratch, size: int, length: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows (g, f, runs) of repeats among pieces (g, f, c, n, core, bytes) that share ``size`` bytes, and the groups that fit
    no block and are not compared yet."""
    kinds = scratch.table(_kinds(pieces))
    loads = scratch.table(_loads(kinds, size))
    fit = meet(kinds.drop("c"), loads.where(F.col("symbols") <= GROUP).select("g", "c"), ["g"], ["f"])
    found = scratch.table(_copied(kinds).unionByName(_expand(fit, size, length)))
    big = scratch.table(loads.where(F.col("symbols") > GROUP).select("g", "c"))
    scratch.free(kinds, loads)
    return found, None if big.isEmpty() else big


def _split(pieces: DataFrame, big: DataFrame, scratch: Scratch, size: int, length: int) -> list[DataFrame]:
    """Like _expand, for the groups of pieces (g, f, c, n, core, bytes) that fit no block: rows (g, f, runs), one table for each
    time that what a group shares is widened, half of what is left of ``length`` at a time."""
    rest = scratch.table(meet(pieces.select("g", "f", F.col("c").alias("copies"), "n", "core", "bytes", F.col("g").alias("rg"), F.col("f").alias("rf"), F.lit(0).alias("off")), big, ["g"], ["f"]))
    out = []
    while True:
        more = -(-(length - size) // 2)
        parts = scratch.table(_part(rest.withColumn("c", F.col("copies")), size, more, length))
        size += more
        scratch.free(rest, big)
        found, big = _compared(parts, scratch, size, length)
        each = _told(parts.select("g", "f", "rg", "rf", "off"), found, scratch, ["rg", "rf", "off"]).select("rg", "rf", "off", F.explode("runs").alias("x"))
        runs = each.groupBy(F.col("rg").alias("g"), F.col("rf").alias("f"))
        out.append(scratch.table(runs.agg(F.collect_set(F.struct((F.col("off") + F.col("x.a")).alias("a"), F.col("x.n").alias("n"))).alias("runs"))))
        scratch.free(found)
        if big is None or size == length:
            scratch.free(parts)
            return out
        rest = scratch.table(meet(parts.withColumnRenamed("c", "copies"), big, ["g"], ["f"]))
        scratch.free(parts)


def removed_spans(rows: DataFrame, scratch: Scratch, length: int, short: int, k: int) -> DataFrame:
    """Rows (r1, r2, spans: array of (start, n), anchors: array of (pos, ...)): runs of n repeated starts of strings of
    ``length`` bytes, and the places of anchors that repeat."""
    occurrences = scratch.table(_occurrences(rows, length, short, k))
    same = lambda c: F.coalesce((F.min(c) == F.max(c)) & (F.min(c) != 0), F.lit(False))
    edges = scratch.table(occurrences.groupBy("edge").agg(F.count("*").alias("c"), F.count("after").alias("far"), same("after").alias("one_after"), same("before").alias("one_before"), F.min("after").alias("after"), F.min("before").alias("before")).where("c > 1"))
    # two anchors join if no occurrence of either goes on otherwise
    spans = edges.where("one_before").select(F.col("before").alias("span"))
    joined = scratch.table(edges.join(spans.distinct(), edges.one_after & (edges.after == spans.span), "left").select("edge", "c", (F.col("far") > 1).alias("many"), F.col("span").isNotNull().alias("joined")))
    entry = F.struct("pos", "joined", (F.col("many") & F.col("after").isNotNull()).alias("far"))
    at = scratch.table(meet(occurrences.select("edge", "r1", "r2", "pos", "after"), joined, ["edge"], ["r1", "pos"]).groupBy("r1", "r2").agg(F.collect_set(entry).alias("edges")))  # those of equal texts are equal
    scratch.free(occurrences, edges, joined)
    scratch.settle()
    texts = rows.where(F.octet_length("text") >= length).select("r1", "r2", "text").join(at.where(F.exists("edges", lambda e: e["far"])), ["r1", "r2"]).select("text", "r1", "r2", "edges")
    settled = scratch.table(_settle(texts, length, k))
    scratch.settle()
    # stretches of groups that have more than one occurrence
    open_ = settled.where("g is not null")
    groups = scratch.table(open_.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"))
    size = (length - k) // 2 + k
    pieces = scratch.table(_kinds(meet(open_, groups, ["g"], ["f"]).withColumn("c", F.lit(1).cast("long"))))
    scratch.free(groups)
    found, big = _compared(pieces, scratch, size, length)
    tables = [found] + (_split(pieces, big, scratch, size, length) if big is not None else [])
    scratch.free(pieces)
    runs = tables[0]
    for t in tables[1:]:
        runs = runs.unionByName(t)
    hits = _told(open_.select("g", "f", "r1", "r2", "start"), runs, scratch, ["r1", "start"]).select("r1", "r2", "start", F.explode("runs").alias("x")).select("r1", "r2", (F.col("start") + F.col("x.a")).alias("start"), F.col("x.n").alias("n"))
    every = settled.where("g is null").select("r1", "r2", "start", "n").unionByName(hits)
    spans = every.groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    out = scratch.table(at.select("r1", "r2", F.col("edges").alias("anchors")).join(spans, ["r1", "r2"], "left"))
    scratch.free(settled, at, *tables)
    scratch.settle()
    return out


def _covered(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes lie in some of the runs."""
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + sizes, -1)
    return np.cumsum(gone)[:-1] > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, short: int = SHORT, k: int = ANCHOR, texts: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, the kept bytes' digest (or the
    kept bytes), and n_repeated, the bytes of what is removed and of anchors that repeat."""
    if not k < short < length or 2 * (short - k + 1) < length - k + 1:
        raise ValueError("an anchor is shorter than the short strings, these than the removed ones, and two of them cover one")
    scratch = Scratch(docs.sparkSession)
    spans = removed_spans(_identity(docs), scratch, length, short, k)
    rows = _identity(docs).join(spans, ["r1", "r2"], "left").select("doc_id", "text", "spans", "anchors")
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = ("kept", "binary") if texts else ("kept_sha256", "string")

    def make():
        def work(cols: dict) -> dict:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], result[0]: [], "n_repeated": []}
            (ends, runs), (stops, anchors) = _lists(cols["spans"]), _lists(cols["anchors"])
            for i, text in enumerate(cols["text"].to_pylist()):
                data = (text or "").encode("utf-8")
                kept, n, repeated = data, 0, 0
                own, at = slice(ends[i], ends[i + 1]), anchors["pos"][stops[i] : stops[i + 1]]
                start, size = runs["start"][own], runs["n"][own] + (length - 1)
                if len(start):
                    gone = _covered(len(data), start, size)
                    n = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                if len(at):
                    repeated = int(_covered(len(data), np.concatenate([start, at]), np.concatenate([size, np.full(len(at), k)])).sum())
                for c, v in zip(out, (len(data), len(data) - len(kept), n, kept if texts else hashlib.sha256(kept).hexdigest(), repeated), strict=True):
                    out[c].append(v)
            return {"doc_id": cols["doc_id"]} | out

        return work

    return arrow_map(rows, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, {result[0]} {result[1]}, n_repeated bigint", make)


def op7_bwt_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
