"""Hard negatives for anchors by bit-sliced integer products.

Vectors become integers and are packed in blocks as bit-planes: plane k holds bit k of every component, 64 components to
a machine word, so that the product of two planes is a count of common ones and a score is a sum of such counts, weighed
by powers of two (the topmost plane is the sign, in two's complement). Every block of rows meets every block of anchors
once. There, for each anchor, the planes of the rows are processed from the most significant down. What the planes still
to come can add lies between the sums of the anchor's negative and of its positive components times 2**k - 1, so that
each score is in an interval that halves with every plane. A row is dropped as soon as its interval cannot qualify: it
meets none of the score windows that are asked for, or as many rows as are asked for are certain to lie above it.

Positives come first (the best rows of the anchor's own label); their scores give the windows in which negatives of
other labels are looked for. A block answers with its best few for each anchor; the best of these over all blocks are the
result, chosen in partial steps before the shuffle. Blocks have a bounded size, so that a task's memory is, however many
rows there are; anchors and rows are dealt to blocks by a hash of their id, so that frequent labels and equal vectors
fall in no one task.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part. Of rows that
share an id, the least by label and vector counts. Shorter vectors are filled up with zeros; an empty one scores 0.
Equal scores go by the smaller id. An anchor without positives, or a positive without a negative in its window, gives no
row; where the positive score is negative the window is empty. Components so large that
64 bits might not hold a score are refused. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Rows of a block and anchors of a block, on average.
ROWS, ANCHORS = 8192, 512
SCALE = 256


def quantised(rows: DataFrame, vector: Column, scale: int = SCALE) -> DataFrame:
    """``rows`` with q: floor(scale * x) of each component; without rows that take no part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    rows = rows.withColumn("q", F.transform(vector, lambda x: x.cast("double"))).where(F.col("q").isNotNull() & F.forall("q", fine))
    return rows.withColumn("q", F.transform("q", lambda x: F.floor(x * scale)))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, zeros at the end of short ones."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def planes(q: np.ndarray, bits: int) -> np.ndarray:
    """Words of the bit-planes of the rows ``q``: [plane, word, row], least significant plane first."""
    out = []
    for k in range(bits):
        ones = np.packbits(((q >> k) & 1).astype(np.uint8), axis=1, bitorder="little")
        out.append(ones.view(np.uint64).T)
    return np.ascontiguousarray(np.stack(out))


def weights(bits: int) -> np.ndarray:
    """What a one in each plane is worth."""
    out = np.int64(1) << np.arange(bits, dtype=np.int64)
    out[-1] = -out[-1]
    return out


class Anchor:
    """One anchor's planes, and the rows of a block that may still qualify."""

    def __init__(self, own: np.ndarray, bits: int):
        self.own, self.bits, self.weight = own, bits, weights(bits)
        whole = sum(int(self.weight[j]) * ((own[j][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) for j in range(bits))
        self.least, self.most = int(whole[whole < 0].sum()), int(whole[whole > 0].sum())

    def product(self, plane: np.ndarray) -> np.ndarray:
        """The anchor's product with one plane of each row."""
        out = np.zeros(plane.shape[1], np.int64)
        for j, w in enumerate(self.weight.tolist()):
            for word, mine in enumerate(self.own[j]):
                if mine:
                    out += np.bitwise_count(plane[word] & mine) * np.int64(w)
        return out

    def best(self, rows: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the rows ``at`` that are among the ``few`` best in any of the score windows [low, high], ties included, and their scores."""
        score = np.zeros(len(at), np.int64)
        spans = sorted({(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True) if a <= b})
        for k in range(self.bits - 1, -1, -1):
            if not spans or not len(at):
                return at[:0], score[:0]
            score += int(self.weight[k]) * self.product(rows[k][:, at])
            rest = (1 << k) - 1
            below, above = score + rest * self.least, score + rest * self.most
            live = (above >= min(a for a, _ in spans)) & (below <= max(b for _, b in spans))
            if rest * (self.most - self.least) <= max(b - a for a, b in spans):
                wanted = np.zeros(len(at), bool)
                for a, b in spans:
                    sure = below[(below >= a) & (above <= b)]
                    bar = max(a, int(np.partition(sure, len(sure) - few)[len(sure) - few])) if len(sure) >= few else a
                    wanted |= (above >= bar) & (below <= b)
                live &= wanted
            if not live.all():
                at, score = at[live], score[live]
        return at, score


def _packed(width: int, bits: int):
    """Packs a group of rows (vec_id, label, q, positives) into one row, in order of label and id."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("label", "ascending"), ("vec_id", "ascending")])
        one = lambda c: rows.column(c).combine_chunks()
        q = _matrix(one("q"), -(-max(width, 1) // 64) * 64)
        out = {"block": key[0].as_py(), "ids": one("vec_id").to_numpy().tobytes(), "labels": one("label").to_numpy().tobytes(), "planes": planes(q, bits).tobytes()}
        scores = one("scores")
        few = scores.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        out |= {"few": few.tobytes(), "scores": scores.flatten().to_numpy().tobytes(), "positives": one("positives").flatten().to_numpy().tobytes()}
        return pa.table({c: pa.array([v], pa.int64() if c == "block" else pa.binary()) for c, v in out.items()})

    return pack


PACKED = "block bigint, ids binary, labels binary, planes binary, few binary, scores binary, positives binary"


def _unpacked(rows: pa.Table, bits: int) -> dict[str, np.ndarray]:
    get = lambda c, kind: np.frombuffer(rows.column(c)[0].as_py(), kind)
    ids = get("ids", np.int64)
    return {"ids": ids, "labels": get("labels", np.int64), "planes": get("planes", np.uint64).reshape(bits, -1, len(ids)), "few": get("few", np.int32), "scores": get("scores", np.int64), "positives": get("positives", np.int64)}


def _blocks(rows: DataFrame, number: int, width: int, bits: int, name: str) -> DataFrame:
    """``rows`` dealt to ``number`` blocks by a hash of the id, one packed row each, columns named with ``name``."""
    block = F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(number)).alias("block")
    return rows.select(block, "vec_id", "label", "q", "scores", "positives").groupBy("block").applyInArrow(_packed(width, bits), PACKED)


def _top(found: DataFrame, by: list[str], few: int) -> DataFrame:
    """The ``few`` best rows of each group by score and id, with rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= few)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``rows`` (vec_id: long, label: long, q: array of longs) to one row for each anchor (rows for which ``anchors`` holds), each of
    its ``positives`` best rows of the same label, and each of the ``negatives`` best rows of other labels whose score is
    from ``low`` to ``high`` percent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    nothing = F.array().cast("array<bigint>")
    rows = rows.where("vec_id is not null and label is not null")
    rows = scratch.table(rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("x")).select("vec_id", "x.label", "x.q", nothing.alias("scores"), nothing.alias("positives")))
    chosen = rows.where(anchors)
    n, n_anchors, width, most = rows.agg(F.count("*"), F.count(F.when(anchors, 1)), F.max(F.size("q")), F.max(F.greatest(F.array_max("q"), -F.array_min("q") - 1))).first()
    width, most = width or 0, max(most or 0, 0)
    bits = most.bit_length() + 1
    if width << 2 * bits >= 1 << 62:
        raise ValueError("components are too large for products of 64 bits")
    n_blocks, n_asking = max(1, -(-n // ROWS)), max(1, -(-n_anchors // ANCHORS))
    blocks = scratch.table(_blocks(rows, n_blocks, width, bits, "rows"))
    deal = min(n_blocks * n_asking, 4 * spark.sparkContext.defaultParallelism + int(spark.conf.get("spark.sql.shuffle.partitions")))

    upto = lambda x: F.sequence(F.lit(0).cast("long"), F.lit(x - 1).cast("long"))

    def meet(asking: DataFrame, schema: str, find) -> DataFrame:
        """``find`` over every pair of a block of rows and a block of anchors, each pair a group of two packed rows."""
        left = blocks.withColumns({"r": F.col("block"), "a": F.explode(upto(n_asking))}).repartition(deal, "r", "a")
        right = asking.withColumns({"a": F.col("block"), "r": F.explode(upto(n_blocks))}).repartition(deal, "r", "a")

        def pair(rows_of: pa.Table, anchors_of: pa.Table) -> pa.Table:
            parts = []
            if len(rows_of) and len(anchors_of):
                block, ask = _unpacked(rows_of, bits), _unpacked(anchors_of, bits)
                start = np.concatenate([[0], np.cumsum(ask["few"])])
                for i in range(len(ask["ids"])):
                    first, last = np.searchsorted(block["labels"], ask["labels"][i], "left"), np.searchsorted(block["labels"], ask["labels"][i], "right")
                    parts += find(block, ask, i, first, last, slice(start[i], start[i + 1]))
            cols = [c.split() for c in schema.split(", ")]
            return pa.table({c: pa.array(np.concatenate([p[j] for p in parts] or [np.zeros(0, np.int64)]), pa.int64()) for j, (c, _) in enumerate(cols)})

        return left.groupBy("r", "a").cogroup(right.groupBy("r", "a")).applyInArrow(pair, schema)

    def alike(block, ask, i, first, last, own):  # the best of the anchor's label in a block
        at = np.arange(first, last)
        at = at[block["ids"][at] != ask["ids"][i]]
        far = np.array([1 << 62])
        at, score = Anchor(ask["planes"][:, :, i], bits).best(block["planes"], at, -far, far, positives)
        top = np.lexsort((block["ids"][at], -score))[:positives]
        return [(np.full(len(top), ask["ids"][i]), block["ids"][at[top]], score[top])]

    def unlike(block, ask, i, first, last, own):  # the best of other labels in a block, in each positive's window
        score_of, id_of = ask["scores"][own], ask["positives"][own]
        a, b = -(-score_of * low // 100), score_of * high // 100
        at = np.concatenate([np.arange(first), np.arange(last, len(block["ids"]))])
        at, score = Anchor(ask["planes"][:, :, i], bits).best(block["planes"], at, a, b, negatives)
        order = np.lexsort((block["ids"][at], -score))
        at, score = at[order], score[order]
        out = []
        for p in range(len(score_of)):
            top = np.flatnonzero((score >= a[p]) & (score <= b[p]))[:negatives]
            fill = lambda v: np.full(len(top), v)  # noqa: B023, E731
            out.append((fill(ask["ids"][i]), fill(id_of[p]), fill(score_of[p]), block["ids"][at[top]], score[top]))
        return out

    asking = _blocks(chosen, n_asking, width, bits, "anchors")
    best = scratch.table(_top(meet(asking, "anchor_id bigint, vec_id bigint, score bigint", alike), ["anchor_id"], positives))
    listed = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("x"))  # at most ``positives``
    listed = listed.select(F.col("anchor_id").alias("vec_id"), F.col("x.score").alias("scores"), F.col("x.vec_id").alias("positives"))
    asking = _blocks(chosen.drop("scores", "positives").join(listed, "vec_id"), n_asking, width, bits, "anchors")
    found = meet(asking, "anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint", unlike)
    top = _top(found, ["anchor_id", "positive_id"], negatives)
    return top.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"), F.col("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(rows.select(F.col("vec_id").cast("long"), label.alias("label"), "q"), F.col("vec_id") % 100 == 0)


SQL = {
    "op11_bit_sliced_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, list_inner_product(a.q, r.q)::BIGINT AS score
 FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
 vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""
}
