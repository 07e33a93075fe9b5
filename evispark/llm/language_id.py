"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams in order of frequency. A document's own most frequent n-grams
are compared with each profile: an n-gram costs the distance of its two ranks, or the profile's length if it is
missing there; the language with the least total is predicted.

Defined cases: null and empty texts and texts without a letter give ``und`` and score 0; texts of any length are
profiled whole; ties go to the language that sorts first, ties of frequency to the lesser n-gram; without any labelled
row every text gives ``und``; rows with null lang are predicted but not learned from; repeated rows are learned from as
often as they stand; a null doc_id is predicted and not held out; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, fold, held_out, table

#: N-gram lengths, entries of a profile, and labelled documents learned from for each language (a documented bound).
SIZES, PROFILE, SAMPLE = (1, 2, 3), 300, 1000
#: Parts into which a language's rows are dealt before its first ones are chosen.
PARTS = 256
UNKNOWN = "und"


class Letters:
    """Texts as sequences of small numbers: 0 for a run of other characters, so that n-grams know where words begin and end."""

    def __init__(self):
        self.kind = np.zeros(0x110000, bool)
        self.seen = np.zeros(0x110000, bool)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        new = np.unique(points[~self.seen[points]])
        for p in new.tolist():
            self.seen[p], self.kind[p] = True, chr(p).isalpha()
        letters = self.kind[points]
        out = np.where(letters, points, 0)
        # one gap between words, one at either end
        keep = letters.copy()
        keep[1:] |= letters[:-1]
        out = out[keep]
        return np.concatenate([[0], out, [0]]) if letters.any() else np.zeros(0, np.int64)


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams as numbers, 21 bits a letter, and their counts; the gap alone is none."""
    codes = codes.astype(np.int64)
    found = []
    for n in SIZES:
        if len(codes) >= n:
            x = codes[: len(codes) - n + 1].copy()
            for i in range(1, n):
                x = x << 21 | codes[i : len(codes) - n + 1 + i]
            found.append(x)
    values, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return values[values != 0], counts[values != 0]


def ranked(values: np.ndarray, counts: np.ndarray, top: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, in order; ties in order of value."""
    if len(values) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))[:top]]


def profiles(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[int]]:
    """Profiles of the languages of ``docs`` (doc_id, text, lang), from ``sample`` documents of each, chosen by hash."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id"))
    # the sample's bound by language, found on (lang, h) alone; one number a language comes to the driver
    # of each language, the first of every part, then the first of these: no task sees a whole language
    light = known.select("lang", "h", F.pmod("h", F.lit(PARTS)).alias("part"))
    for by in (["lang", "part"], ["lang"]):
        light = light.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("h"))).where(F.col("n") <= sample)
    bound = {r.lang: r.h for r in light.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not bound:
        return {}
    limits = F.create_map(*[F.lit(x) for item in sorted(bound.items()) for x in item])
    chosen = known.where(F.col("h") <= limits[F.col("lang")]).select("lang", "text")

    def make():
        letters = Letters()

        def work(cols: dict) -> dict:
            out: dict[str, list] = {"lang": [], "gram": [], "n": []}
            by: dict[str, list] = {}
            for lang, text in zip(cols["lang"].to_pylist(), cols["text"].to_pylist(), strict=True):
                by.setdefault(lang, []).append(letters.codes(text))
            for lang, parts in by.items():
                values, counts = grams(np.concatenate(parts))
                out["lang"] += [lang] * len(values)
                out["gram"].append(values)
                out["n"].append(counts)
            return {"lang": out["lang"], "gram": np.concatenate(out["gram"]), "n": np.concatenate(out["n"])}

        return work

    counted = arrow_map(chosen, "lang string, gram bigint, n bigint", make).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("part", F.pmod("gram", F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        top = top.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    rows = top.select("lang", "gram", "r").collect()
    out: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda x: (x.lang, x.r)):
        out.setdefault(row.lang, []).append(row.gram)
    return out


class Ranker:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, learned: dict[str, list[int]]):
        self.langs = sorted(learned)
        self.grams = np.unique(np.array([g for p in learned.values() for g in p], np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, np.array(learned[lang], np.int64))] = np.arange(len(learned[lang]))
        self.letters = Letters()

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes = self.letters.codes(text) if text else np.zeros(0, np.int64)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(*grams(codes))
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        there = self.ranks[:, at]
        known = (self.grams[at] == own) & (there >= 0)
        distance = np.where(known, np.abs(there - np.arange(len(own))), PROFILE).sum(axis=1)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (PROFILE * len(own))


def identify(docs: DataFrame, learned: dict[str, list[int]]) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score (1: the profile's own order)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        rank = Ranker(learned)

        def work(cols: dict) -> dict:
            found = [rank(t) for t in cols["text"].to_pylist()]
            return {"doc_id": cols["doc_id"], "held_out": cols["held"], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

        return work

    return arrow_map(docs.select("doc_id", held_out().alias("held"), "text"), f"doc_id {kind}, held_out boolean, lang_pred string, score double", make)


def op8_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, profiles(docs.where(fold() != 2)))
