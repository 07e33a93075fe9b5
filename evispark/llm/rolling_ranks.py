"""Sums, distinct categories and exact ranks over rolling windows of time, by merge-sort trees.

The rows of a key are cut into tiles of time. A tile answers the times of its own days and holds, besides their rows,
those of the day before, a day being as long as the longest window. Days with few rows share a tile (up to TILE rows), so
that tiles are alike in size however rows spread over keys and times; a tile with more than DENSE different rows is cut
again into slices by value (categories: by hash). Equal rows are counted before any shuffle that brings a tile together,
so that no tile and no slice grows with the number of copies, and a hot key is only more tiles.

In a tile, a merge-sort tree over the rows in time order holds each node's values sorted, with bridges (how many of a
node's first i values belong to its left child) and running weights: fractional cascading takes the rank of a value from
the root to every node on the way to a window's ends without another search. Ranks are found by binary search over the
root's values with summed node counts. Where a tile is sliced, slices first say how many values each window has in
them; the slice that holds the wanted rank is then asked for it. Distinct categories are the window's rows whose category
does not occur before them in the window: a count in a tree of the times at which each row's category came before.

Defined cases: a null key is a key of its own; rows with a null value count as events but have no length or rank; null
categories are not counted; rows with a null time are in no window, and their own windows are empty; rows that repeat
count each for itself; empty windows have 0 events, 0 sum, 0 categories and null ranks; an empty table gives an empty
result; other columns, whatever their names, are ignored. Values and times are 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Rows up to which neighbouring days share a tile, and the number of times that they may be joined two by two.
TILE, LEVELS = 8192, 5
#: Different rows of a tile beyond which it is cut into slices of about so many, and the most slices of one tile.
DENSE, SLICES = 1 << 18, 256
#: The ranks that windows are asked for, as percent: number ceil(p * m / 100) of m values.
RANKS = (50, 99)
NEVER = np.iinfo(np.int64).min


class MergeSortTree:
    """Weights of values by position ranges, for many ranges at once."""

    def __init__(self, values: np.ndarray, weights: np.ndarray | None = None):
        n = len(values)
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        self.bits = max(1, int(n).bit_length())  # so that n itself is a position
        self.left, self.weight = [], []
        weights = np.ones(n, np.int64) if weights is None else weights
        for level in range(self.bits + 1):
            # each node's positions in order of value, the nodes of a level side by side
            order = order[np.argsort(order >> (self.bits - level), kind="stable")]
            self.weight.append(np.concatenate([[0], np.cumsum(weights[order])]))
            if level < self.bits:
                goes_left = (order >> (self.bits - level - 1)) & 1 == 0
                self.left.append(np.concatenate([[0], np.cumsum(goes_left)]))

    def before(self, position: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The weight of those of the root's first ``rank`` values that lie before ``position``."""
        i, out = rank.copy(), np.zeros(len(position), np.int64)
        for level in range(self.bits):
            bit = self.bits - level - 1
            start = (position >> (bit + 1)) << (bit + 1)
            in_left = self.left[level][start + i] - self.left[level][start]
            right = (position >> bit) & 1 == 1
            # the left child lies wholly before the position
            at = start[right]
            out[right] += self.weight[level + 1][at + in_left[right]] - self.weight[level + 1][at]
            i = np.where(right, i - in_left, in_left)
        return out

    def count(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return self.before(high, rank) - self.before(low, rank)

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The weight of values less than ``bound`` at the positions [low, high)."""
        return self.count(low, high, np.searchsorted(self.sorted, bound, "left"))

    def select(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The least value up to which [low, high) holds the weight ``wanted``, which is at least 1 and at most its whole."""
        first, last = np.ones(len(low), np.int64), np.full(len(low), len(self.sorted), np.int64)
        while (first < last).any():
            mid = (first + last) >> 1
            enough = self.count(low, high, mid) >= wanted
            first, last = np.where(enough, first, np.minimum(mid + 1, last)), np.where(enough, mid, last)
        return self.sorted[first - 1] if len(first) else np.zeros(0, np.int64)


def wanted_rank(m: np.ndarray, percent: int) -> np.ndarray:
    return -(-m * percent // 100)


class Tile:
    """The rows of one tile or of one of its slices, in time order."""

    def __init__(self, rows: pa.Table):
        get = lambda c: rows.column(c).to_numpy()
        t, part, own, n = get("t"), get("part"), get("own"), get("n")
        present = rows.column("v").is_valid().to_numpy()
        event, valued, named = part & 1 > 0, (part & 2 > 0) & present, (part & 4 > 0) & rows.column("c").is_valid().to_numpy()
        v = rows.column("v").fill_null(0).to_numpy()
        at = np.flatnonzero(event)
        self.times, index = np.unique(t[at], return_inverse=True)
        each = np.zeros((2, len(self.times)), np.int64)
        for row, w in zip(each, (n, v * n * present), strict=True):
            np.add.at(row, index, w[at])
        self.events, self.sums = (np.concatenate([[0], np.cumsum(row)]) for row in each)
        self.asked = np.unique(t[at][own[at]])
        order = np.flatnonzero(valued)
        order = order[np.argsort(t[order], kind="stable")]
        self.value_times, self.values = t[order], MergeSortTree(v[order], n[order])
        # a category's first row at each time, and the time at which the category came before
        names = rows.column("c").combine_chunks().dictionary_encode()
        code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.flatnonzero(named)
        at = at[np.lexsort((t[at], code[at]))]
        same = code[at][1:] == code[at][:-1]
        first = np.concatenate([[True], ~(same & (t[at][1:] == t[at][:-1]))])[: len(at)]
        at = at[first]
        earlier = np.full(len(at), NEVER)
        same = code[at][1:] == code[at][:-1]
        earlier[1:][same] = t[at][:-1][same]
        order = np.argsort(t[at], kind="stable")
        self.name_times, self.names = t[at][order], MergeSortTree(earlier[order])

    def answer(self, key: dict, span: int, alone: bool) -> dict:
        """Columns for the times that the tile is asked for."""
        e = self.asked
        ends = lambda times: (np.searchsorted(times, e - span, "left"), np.searchsorted(times, e, "left"))
        low, high = ends(self.times)
        main = int(key["s"] == 0)  # the events are in every slice, for their times
        out = {"t": e, "span": np.full(len(e), span), "s": np.full(len(e), key["s"]), "n_events": main * (self.events[high] - self.events[low]), "total": main * (self.sums[high] - self.sums[low])}
        low, high = ends(self.name_times)
        out["n_categories"] = self.names.below(low, high, e - span)
        low, high = ends(self.value_times)
        out["m"] = self.values.count(low, high, np.full(len(e), len(self.values.sorted)))
        for p in RANKS:
            some = (out["m"] > 0) & alone
            found = np.zeros(len(e), np.int64)
            found[some] = self.values.select(low[some], high[some], wanted_rank(out["m"][some], p))
            out[f"rank_{p}"] = pa.array(found, mask=~some)
        return out

    def slice_ranks(self, asked: pa.Table) -> np.ndarray:
        """Values of the wanted ranks within this slice, for rows (t, span, wanted)."""
        t, span, wanted = (asked.column(c).to_numpy() for c in ("t", "span", "wanted"))
        low, high = np.searchsorted(self.value_times, t - span, "left"), np.searchsorted(self.value_times, t, "left")
        return self.values.select(low, high, wanted)


ANSWER = "k string, t bigint, span bigint, s int, n_events bigint, total bigint, n_categories bigint, m bigint, " + ", ".join(f"rank_{p} bigint" for p in RANKS)


def _div(x: Column, by: int) -> Column:
    """Floor of an exact division."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def _tiles(days: DataFrame) -> DataFrame:
    """(k, d, lv, i): each day of a key and its tile, which covers 2**lv days. ``days`` has (k, d, m)."""
    up = lambda d, lv: F.call_function("shiftright", d, lv)
    total = lambda x, lv: F.aggregate(F.filter("days", lambda y: up(y["d"], lv) == up(x["d"], lv)), F.lit(0).cast("long"), lambda a, y: a + y["m"])
    # totals grow with the level, and all days below a node see the same ones
    level = lambda x: F.size(F.filter(F.array(*[F.lit(j) for j in range(1, LEVELS + 1)]), lambda lv: total(x, lv) <= TILE))
    near = days.groupBy("k", F.shiftright("d", LEVELS).alias("u")).agg(F.collect_list(F.struct("d", "m")).alias("days"))  # at most 2**LEVELS
    each = near.select("k", F.explode(F.transform("days", lambda x: F.struct(x["d"].alias("d"), level(x).alias("lv")))).alias("x")).select("k", "x.d", "x.lv")
    return each.withColumn("i", up(F.col("d"), F.col("lv")))


def windows(rows: DataFrame, spans: tuple[int, ...], scratch: Scratch, dense: int = DENSE) -> DataFrame:
    """``rows`` (k: string, t: long, v: long, c: string) to one row for each different k and t and each span: n_events, total,
    n_categories, m (values) and rank_50, rank_99 over the rows of k with t - span <= time < t."""
    reach = max(spans)
    counted = rows.where("t is not null").groupBy("k", "t", "v", "c").agg(F.count("*").alias("n"))
    counted = scratch.table(counted.withColumn("d", _div(F.col("t"), reach)))
    tiles = scratch.table(_tiles(counted.groupBy("k", "d").agg(F.count("*").alias("m"))))
    own = counted.alias("r").join(tiles.alias("x"), F.col("r.k").eqNullSafe(F.col("x.k")) & (F.col("r.d") == F.col("x.d")))
    # a tile whose first day has rows of its own also needs the day before
    heads = tiles.where(F.col("d") == F.call_function("shiftleft", F.col("i"), F.col("lv")))
    halo = counted.alias("r").join(heads.alias("x"), F.col("r.k").eqNullSafe(F.col("x.k")) & (F.col("r.d") + 1 == F.col("x.d")))
    take = lambda df, mine: df.select("r.k", "x.lv", "x.i", "r.t", "r.v", "r.c", "r.n", F.lit(mine).alias("own"))
    members = scratch.table(take(own, True).unionByName(take(halo, False)))
    large = scratch.table(members.groupBy("k", "lv", "i").agg(F.count("*").alias("size")).where(F.col("size") > dense))
    whole = members.withColumns({"s": F.lit(0), "slices": F.lit(1), "part": F.lit(7)})
    sliced = not large.isEmpty()
    if sliced:
        whole = scratch.table(_sliced(members, large, dense))

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        k, _, _, s, slices = (x.as_py() for x in key)
        tile = Tile(group)
        parts = [tile.answer({"s": s}, span, slices == 1) for span in spans]
        cols = {c: pa.chunked_array([pa.array(p[c]) for p in parts]) for c in parts[0]}
        cols["k"] = pa.array([k] * (len(tile.asked) * len(spans)), pa.string())
        cols["s"] = cols["s"].cast(pa.int32())
        return pa.table({c.split()[0]: cols[c.split()[0]] for c in ANSWER.split(", ")})

    answers = whole.groupBy("k", "lv", "i", "s", "slices").applyInArrow(answer, ANSWER)
    if not sliced:
        return scratch.table(answers.drop("s"))
    return _from_slices(whole, scratch.table(answers), scratch)


def _sliced(members: DataFrame, large: DataFrame, dense: int) -> DataFrame:
    """``members`` with s (slice), slices and part: 1 the events at a time, in every slice; 2 a value; 4 a category; 7 all of it."""
    on = ["lv", "i"]
    with_large = members.alias("r").join(large.alias("x"), F.col("r.k").eqNullSafe(F.col("x.k")) & (F.col("r.lv") == F.col("x.lv")) & (F.col("r.i") == F.col("x.i")), "left").select("r.*", "x.size")
    plain = with_large.where("size is null").drop("size").withColumns({"s": F.lit(0), "slices": F.lit(1), "part": F.lit(7)})
    hot = with_large.where("size is not null")
    cuts = hot.groupBy("k", *on).agg(F.percentile_approx("v", [j / SLICES for j in range(1, SLICES)], 10_000).alias("cuts"), F.max("size").alias("size"))
    # every so many of the cuts, so that a slice has about ``dense`` rows; a slice holds all rows of its values
    number = F.least(F.lit(SLICES), F.ceil(F.col("size") / dense).cast("int"))
    step = F.greatest(F.floor(F.lit(SLICES) / number).cast("int"), F.lit(1))
    chosen = F.array_distinct(F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda c, j: (j + 1) % step == 0))
    cuts = cuts.select("k", *on, chosen.alias("cuts")).withColumn("slices", F.greatest(F.size("cuts") + 1, F.lit(2)))
    hot = hot.alias("r").join(cuts.alias("x"), F.col("r.k").eqNullSafe(F.col("x.k")) & (F.col("r.lv") == F.col("x.lv")) & (F.col("r.i") == F.col("x.i"))).select("r.*", "x.cuts", "x.slices")
    columns = ["k", *on, "t", "v", "c", "n", "own", "s", "slices", "part"]
    none = lambda kind: F.lit(None).cast(kind)
    values = hot.where("v is not null").groupBy("k", *on, "t", "v", "slices", "own").agg(F.sum("n").alias("n"), F.first("cuts").alias("cuts"))
    values = values.withColumns({"s": F.size(F.filter("cuts", lambda c: c < F.col("v"))), "c": none("string"), "part": F.lit(2)})
    names = hot.where("c is not null").groupBy("k", *on, "t", "c", "slices", "own").agg(F.lit(1).cast("long").alias("n"))
    names = names.withColumns({"s": F.pmod(F.xxhash64("c"), F.col("slices")).cast("int"), "v": none("long"), "part": F.lit(4)})
    # the sum of a time's values stands as the value of one event; the number of events comes beside it
    times = hot.groupBy("k", *on, "t", "slices", "own").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("total"))
    times = times.withColumn("x", F.explode(F.array(F.struct(F.lit(None).cast("long").alias("v"), (F.col("n") - F.when(F.col("total").isNull(), 0).otherwise(1)).alias("n")), F.struct(F.col("total").alias("v"), F.when(F.col("total").isNull(), 0).otherwise(1).cast("long").alias("n")))))
    times = times.select("k", *on, "t", "slices", "own", "x.v", "x.n").withColumns({"s": F.explode(F.sequence(F.lit(0), F.col("slices") - 1)), "c": none("string"), "part": F.lit(1)})
    out = plain.select(columns)
    for df in (values, names, times):
        out = out.unionByName(df.select(columns))
    return out


def _from_slices(whole: DataFrame, answers: DataFrame, scratch: Scratch) -> DataFrame:
    """Sums over slices; each wanted rank is asked of the slice that holds it."""
    by = ["k", "t", "span"]
    sums = scratch.table(answers.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("n_events", "total", "n_categories", "m")], *[F.max(f"rank_{p}").alias(f"rank_{p}") for p in RANKS]))
    running = Window.partitionBy(by).orderBy("s")
    along = answers.select(*by, "s", "m", F.sum("m").over(running).alias("upto"), F.sum("m").over(Window.partitionBy(by)).alias("all"), F.max("s").over(Window.partitionBy(by)).alias("last")).where("last > 0 and m > 0")
    wanted = along.withColumn("p", F.explode(F.array(*[F.lit(p) for p in RANKS]))).withColumn("wanted", _div(F.col("all") * F.col("p") + 99, 100) - (F.col("upto") - F.col("m")))
    wanted = wanted.where("wanted between 1 and m").select(*by, "s", "p", "wanted")
    # a time belongs to one tile, whose slices hold its values
    tile = whole.where("own and part = 1 and s = 0").select("k", "t", "lv", "i").distinct()
    asked = wanted.alias("a").join(tile.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.t") == F.col("b.t"))).select("a.*", "b.lv", "b.i")
    text = lambda c: F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(c, F.lit("")))  # noqa: E731  a cogroup's keys, null-safe
    data = whole.where("part = 2").select(text("k").alias("key"), "lv", "i", "s", "t", "v", "c", "n", "own", "part")
    asked = scratch.table(asked.select(text("k").alias("key"), "lv", "i", "s", "k", "t", "span", "p", "wanted"))

    def look(rows: pa.Table, ask: pa.Table) -> pa.Table:
        if not len(ask):
            return pa.table({"k": pa.array([], pa.string()), "t": pa.array([], pa.int64()), "span": pa.array([], pa.int64()), "p": pa.array([], pa.int32()), "found": pa.array([], pa.int64())})
        return pa.table({**{c: ask.column(c) for c in ("k", "t", "span", "p")}, "found": pa.array(Tile(rows).slice_ranks(ask))})

    on = ["key", "lv", "i", "s"]
    found = data.groupBy(on).cogroup(asked.groupBy(on)).applyInArrow(look, "k string, t bigint, span bigint, p int, found bigint")
    found = found.groupBy(by).agg(*[F.max(F.when(F.col("p") == p, F.col("found"))).alias(f"found_{p}") for p in RANKS])
    same = F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.span") == F.col("b.span"))
    out = sums.alias("a").join(found.alias("b"), same, "left")
    return scratch.table(out.select(*[f"a.{c}" for c in (*by, "n_events", "total", "n_categories", "m")], *[F.coalesce(f"a.rank_{p}", f"b.found_{p}").alias(f"rank_{p}") for p in RANKS]))


def event_time(doc_id: Column) -> Column:
    """60 * floor((doc_id + (h mod 1000)) / 6), h being the crc32 of doc_id in decimal."""
    return _div(doc_id + F.crc32(doc_id.cast("string").cast("binary")) % 1000, 6) * 60


def rolling_features(docs: DataFrame, time: Column, spans: tuple[int, ...] = (1800, 86400), dense: int = DENSE) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, lang, source) and each span: doc_id, window_s, event_s, n_events,
    sum_chars, n_langs, median_chars, high_chars over the rows of its source with event_s - window_s <= ``time`` < event_s."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("k"), time.cast("long").alias("t"), F.length("text").cast("long").alias("v"), F.col("lang").cast("string").alias("c"))
    rows = scratch.table(rows)
    found = windows(rows.drop("doc_id"), spans, scratch, dense)
    each = rows.select("doc_id", "k", "t", F.explode(F.array(*[F.lit(s).cast("long") for s in spans])).alias("span"))
    on = F.col("r.k").eqNullSafe(F.col("w.k")) & (F.col("r.t") == F.col("w.t")) & (F.col("r.span") == F.col("w.span"))
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(name)
    return each.alias("r").join(found.alias("w"), on, "left").select(
        "r.doc_id", F.col("r.span").alias("window_s"), F.col("r.t").alias("event_s"), zero("n_events", "n_events"), zero("total", "sum_chars"), zero("n_categories", "n_langs"),
        F.col("rank_50").alias("median_chars"), F.col("rank_99").alias("high_chars"),
    )


def op13_merge_sort_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rolling_features(docs, event_time(F.col("doc_id")))


#: crc32 bit by bit: each step shifts the remainder and subtracts the reversed polynomial where a one falls out
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
 lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"""
_OVER = "(PARTITION BY source ORDER BY event_s RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)"
_PART = """SELECT doc_id, {w}::BIGINT AS window_s, event_s, count(*) OVER {o} AS n_events, coalesce(sum(v) OVER {o}, 0)::BIGINT AS sum_chars,
 count(DISTINCT lang) OVER {o} AS n_langs, quantile_disc(v, 0.5) OVER {o} AS median_chars, quantile_disc(v, 0.99) OVER {o} AS high_chars FROM e"""
SQL = {
    "op13_merge_sort_windows": f"WITH e AS (SELECT doc_id, lang, source, length(text)::BIGINT AS v, 60 * floor((doc_id + ({_CRC}) % 1000) / 6)::BIGINT AS event_s FROM documents) "
    + " UNION ALL ".join(_PART.format(w=w, o=_OVER.format(w=w)) for w in (1800, 86400))
}
