"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is a logistic of a bias, weights, and all pairwise interactions of a row's features through low-rank
factors. The sum over pairs is half of (the square of the sum minus the sum of the squares) for each factor, so that a
row is scored in time linear in its features.

Learned on the driver from a bounded sample of labelled rows (SAMPLE rows with at most LEARNED features in all, both
documented parameters) whose features come from the executors; everything else covers every row and whole texts.

Defined cases: null and empty texts have the statistics of an empty text and get a score like any other; very long
texts are read whole, and their word features stay at most 65,536; without any usable label every score is 0.5; a
doc_id with several labels counts with their mean, at least 0.5 being 1; null n_chars has a feature of its own; a null
doc_id is scored and never learned from; repeated rows score alike; an empty table gives an empty result; extra columns
are ignored by score() and passed by untouched by accepted(), whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, SpanHashes, arrow_map, fresh, held_out, table

#: Hashed word features (a power of two), factors, bins of a statistic, and labelled rows and features learned from.
WORDS, FACTORS, BINS, SAMPLE, LEARNED = 1 << 16, 8, 16, 6000, 10_000_000
STATISTICS = ("words", "length", "distinct", "adjacent", "upper", "digits", "symbols", "pipes", "marks", "points", "lines", "again", "foreign", "n_chars")
FEATURES = WORDS + BINS * len(STATISTICS)
THRESHOLD = 0.7

#: byte classes: 1 upper case, 2 digit, 3 of #*$%&<>, 4 |, 5 of !?, 6 of .,;:, 7 above ASCII
CLASSES = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!?", b".,;:", bytes(range(128, 256))), 1):
    CLASSES[list(_bytes)] = _kind


class Features:
    """Feature numbers and values of a document."""

    def __init__(self):
        self.hashes = SpanHashes(0x2545F4914F6CDD1D)

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode("utf-8")
        h = self.hashes(np.frombuffer(raw.lower(), np.uint8))
        n = max(len(h), 1)
        ids, counts = np.unique(h & np.uint64(WORDS - 1), return_counts=True)
        weight = 1 + np.log(counts)
        weight = weight / np.sqrt((weight**2).sum()) if len(weight) else weight
        kinds = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=8)
        lines = [x for x in (text or "").split("\n") if x.strip()]
        size = max(len(raw), 1)
        ratio = lambda x: min(int(x * (BINS - 1) + 0.999), BINS - 1)  # noqa: E731  0 only for 0
        log = lambda x: min(int(np.log2(1 + x)), BINS - 1)
        bins = (
            log(len(h)), log(size / n), ratio(len(np.unique(h)) / n), ratio(float((h[1:] == h[:-1]).sum()) / n), ratio(kinds[1] / size), ratio(kinds[2] / size),
            ratio(min(1, kinds[3] / n)), ratio(min(1, kinds[4] / n)), ratio(min(1, kinds[5] / n)), ratio(min(1, kinds[6] / n)), log(len(lines)),
            ratio(1 - len(set(lines)) / max(len(lines), 1)), ratio(kinds[7] / size), BINS - 1 if n_chars is None else min(log(max(n_chars, 0)), BINS - 2),
        )
        own = WORDS + BINS * np.arange(len(STATISTICS)) + np.array(bins)
        return np.concatenate([ids.astype(np.int64), own]), np.concatenate([weight, np.full(len(own), 0.5)])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def sums(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores of rows that begin at ``starts``, the factors' sums by row, and the products by feature."""
        products = values[:, None] * self.factors[ids]
        total = np.add.reduceat(products, starts)
        squares = np.add.reduceat(products**2, starts)
        linear = np.add.reduceat(values * self.weights[ids], starts)
        return self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1), total, products

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        raw = self.sums(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts)[0]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss by adaptive gradient steps; both classes weigh the same up to a factor of four."""
    random = np.random.default_rng(seed)
    if not len(rows):
        return Machine(0.0, np.zeros(FEATURES), np.zeros((FEATURES, FACTORS)))
    m = Machine(0.0, np.zeros(FEATURES), random.normal(0, 0.05, (FEATURES, FACTORS)))
    share = np.clip(labels.mean(), 0.02, 0.98)
    importance = np.where(labels > 0.5, 1.0, min(4.0, share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            sizes = np.array([len(rows[i][0]) for i in part])
            ids, values = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            raw, total, products = m.sums(ids, values, np.cumsum(sizes) - sizes)
            slope = importance[part] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) / len(part)
            by = np.repeat(np.arange(len(part)), sizes)
            g = slope[by] * values
            gv = g[:, None] * (total[by] - products)
            sort = np.argsort(ids, kind="stable")
            used, first = np.unique(ids[sort], return_index=True)
            gw = np.add.reduceat(g[sort], first) + decay * m.weights[used]
            gv = np.add.reduceat(gv[sort], first) + decay * m.factors[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            m.weights[used] -= rate * gw / np.sqrt(seen_w[used])
            m.factors[used] -= 0.5 * rate * gv / np.sqrt(seen_v[used])
            seen_b += slope.sum() ** 2
            m.bias -= rate * slope.sum() / np.sqrt(seen_b)
    return m


def _with_metadata(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.withColumn("n_chars", n)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learned: int = LEARNED) -> Machine:
    """Learn from at most ``sample`` labelled rows outside the held-out fold, chosen by hash of doc_id, with at most
    ``learned`` features in all, so that long texts don't fill the driver."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = _with_metadata(docs).select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id").select("text", "n_chars", "y")

    def make():
        features = Features()

        def work(cols: dict) -> dict:
            found = [features(t, n) for t, n in zip(cols["text"].to_pylist(), cols["n_chars"].to_pylist(), strict=True)]
            return {"y": cols["y"], "ids": [i.astype("<i4").tobytes() for i, _ in found], "values": [v.astype("<f4").tobytes() for _, v in found]}

        return work

    scratch = Scratch(docs.sparkSession)
    found = scratch.table(arrow_map(rows, "y double, ids binary, values binary", make).withColumn("h", F.xxhash64("ids", "values", "y")))
    sizes = found.groupBy("h").agg(F.sum(F.length("ids") / 4).alias("n")).orderBy("h").collect()
    taken = int(np.searchsorted(np.cumsum([r.n for r in sizes]), learned, "right"))
    last = sizes[taken - 1].h if taken else None
    got = found.where(F.col("h") <= F.lit(last)).collect()
    scratch.free(found)
    got.sort(key=lambda r: (r.h, zlib.crc32(r.ids)))  # the order of arrival is not fixed
    pairs = [(np.frombuffer(r.ids, "<i4").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(np.float64)) for r in got]
    return fit(pairs, np.array([r.y for r in got]))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, verdict: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted (or all its columns and the prediction as ``verdict``)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    keep = ["doc_id"] if verdict is None else docs.columns
    used = _with_metadata(docs).select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], held_out().alias("held"), "text", F.col("n_chars").alias("n"))
    small = Machine(machine.bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + (", held_out boolean, score double, predicted int" if verdict is None else f", `{verdict}` int")

    def make():
        features = Features()

        def work(cols: dict) -> dict:
            s = small.scores([features(t, n) for t, n in zip(cols["text"].to_pylist(), cols["n"].to_pylist(), strict=True)])
            out = {c: cols[f"c{i}"] for i, c in enumerate(keep)}
            if verdict is not None:
                return out | {verdict: (s >= threshold).astype(np.int32)}
            return out | {"held_out": cols["held"], "score": s.astype(np.float64), "predicted": (s >= threshold).astype(np.int32)}

        return work

    return arrow_map(used, schema, make)


def accepted(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold``."""
    verdict = fresh(docs.columns, "predicted")
    return score(docs, machine, threshold, verdict).where(F.col(verdict) == 1).select(*docs.columns)


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
