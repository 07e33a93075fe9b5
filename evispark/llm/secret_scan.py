"""Secrets by base patterns and character Markov models, in DataFrame operations alone.

Base patterns with their checks find what is certain. Beside them, every run of characters of which keys and tokens are
made is a candidate. Two Markov models of order one, over the characters that candidates may have, give the likelihood
of a candidate: one learned from random strings, one from ordinary identifiers. A candidate whose log-likelihood ratio
reaches THRESHOLD is added with the kind ``random``. The threshold is the logarithm of a prior, not a figure of the
corpus: one secret in ODDS candidates.

What the models are trained from is labelled: random are the values of base spans in sampled documents, and strings
encoded from digests (hexadecimal in small and large letters, base 64, letters and digits, large letters and digits, with
dashes). Ordinary are those candidates of sampled documents that touch no base span and consist of regular words or of
numbers, names made of documents' words, joined as names in programs are (NAMES a document), and generated counters,
dates and versions. Base values of digits alone are neither. Both models count every pair of characters
PRIOR times more than seen. At most about SAMPLE documents are used, drawn by hash; the generated strings are the same
at any size, so that no table is too small for the models.

Positions are code points. They follow from the texts between matches: every text is scanned whole, nothing leaves the
row, and scoring needs no shuffle.

Defined cases: null texts are empty and have no spans; very long texts and very long candidates are scored like others,
in time in proportion to their length; rows that repeat have equal spans; a null doc_id is carried through; candidates
do not overlap, and one that touches a base span of any kind is not added; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pii import _found, _free, _one, texts

KINDS = ("assign", "access", "hex")
WORD = r"(?i:password|passwd|secret|token|api_?key)"
#: Runs of base characters are refused whole, so that a shorter part of one is never tried again.
BASE = {
    "assign": WORD + r"""["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": "AKIA[A-Z0-9]++",
    "hex": "[0-9a-f]{16,}+",
}
NEEDS = {"assign": WORD, "access": "AKIA", "hex": "[0-9a-f]{16}"}
VALUE = "[A-Za-z0-9+/_.=-]+$"
#: Candidates: runs that begin with a letter or digit; padding may follow.
CANDIDATE = "[A-Za-z0-9][A-Za-z0-9+/_-]{11,}+={0,2}"
#: A regular word, and names and numbers made of such: what is ordinary without being looked at.
REGULAR = "(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"
ORDINARY = rf"^{REGULAR}(?:[+/_-]+{REGULAR})*[+/_=-]*$"
#: Documents sampled for the models (a bound, in expectation), generated strings of each form, candidates for each secret
#: that the prior expects, what is added to the count of each pair of characters, and names made of a document's words.
SAMPLE, GENERATED, ODDS, PRIOR, NAMES = 20_000, 500, 100_000, 0.5, 60
THRESHOLD = math.log(ODDS)
#: Characters of candidates lie from + to z; the code before them stands for the beginning.
FIRST, CODES = ord("+") - 1, ord("z") - ord("+") + 2
SYMBOLS = 26 + 26 + 10 + 5


def _code(c: Column) -> Column:
    return F.ascii(c) - FIRST


def _valid(kind: str, x: Column) -> Column:
    return {"assign": F.length(F.regexp_extract(x, VALUE, 0)) >= 12, "access": F.length(x) >= 18, "hex": F.lit(True)}[kind]


def base_spans(df: DataFrame) -> DataFrame:
    """Adds, for the texts t and each kind, the array base_<kind> of what the base pattern finds and its check confirms."""
    for k in KINDS:
        df = _found(df, f"_{k}", BASE[k], NEEDS[k])
        df = df.withColumn(f"base_{k}", F.filter(f"_{k}", _one(lambda k, c: _valid(k, c["x"]), k))).drop(f"_{k}")
    return df


def candidates(df: DataFrame) -> DataFrame:
    """Adds near: the candidates of t that touch no base span."""
    df = _found(df, "runs", CANDIDATE, "[A-Za-z0-9][A-Za-z0-9+/_-]{11}")
    df = df.withColumn("taken", F.flatten(F.array(*[F.transform(f"base_{k}", lambda c: F.struct(c["s"], c["e"])) for k in KINDS])))
    return _free(df, "near", "runs", "taken").drop("runs", "taken")


def generated(spark: SparkSession, number: int = GENERATED) -> DataFrame:
    """Random strings x: digests of numbers, in the forms that keys have."""
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")).cast("binary"), 256)
    plain = F.base64(F.unhex(digest))
    alone = F.regexp_replace(plain, "[^A-Za-z0-9]", "")
    dashed = F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    forms = [digest, F.upper(digest), plain, alone, F.upper(alone), F.translate(plain, "+/", "-_"), dashed]
    return spark.range(number).select(F.explode(F.array(*forms)).alias("x"))


def numbered(spark: SparkSession, number: int = GENERATED) -> DataFrame:
    """Ordinary strings x that are mostly digits: counters, dates, times and versions."""
    i = F.col("id")
    day, time = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (i * 29).cast("int")), "yyyy-MM-dd"), F.date_format(F.timestamp_seconds(i * 1_000_003), "yyyyMMdd-HHmmss")
    forms = [day, time, (i * 7_919_000_003 + 1_000_000_000_000).cast("string"), F.format_string("%03d-%04d-%05d", i % 1000, i * 13 % 10_000, i * 311 % 100_000), F.format_string("%d/%d/%06d", i % 31, i % 12, i * 977)]
    return spark.range(number).select(F.explode(F.array(*forms)).alias("x"))


def _named(words: str) -> Column:
    """Names as programs have them, made of neighbouring words of a column of arrays."""

    def name(i: Column) -> Column:
        a, b = F.get(words, i), F.get(words, i + 1)
        joined = [F.concat(a, F.lit("_"), b), F.concat(a, F.lit("-"), b), F.concat(a, F.initcap(b)), F.upper(F.concat(a, F.lit("_"), b)), F.concat(a, F.lit("/"), b), F.concat(a, F.lit("_"), b, F.lit("=")), F.concat(a, (i % 10).cast("string"), F.lit("_"), b, (i % 7).cast("string"))]
        return F.element_at(F.array(*joined), i % len(joined) + 1)

    places = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.least(F.size(words) - 2, F.lit(NAMES - 1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, name)


def labelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (random: 1 or 0, x): labelled strings from about ``sample`` documents and from generated ones."""
    total = docs.count()
    share = int(min(1.0, sample / max(total, 1)) * (1 << 20))
    part = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < share)
    df = candidates(base_spans(texts(part)))
    found = F.flatten(F.array(*[F.transform(f"base_{k}", _one(lambda k, c: F.regexp_extract(c["x"], VALUE, 0) if k == "assign" else c["x"], k)) for k in KINDS]))
    values = F.filter(found, lambda x: ~x.rlike("^[0-9]+$"))  # a long number is a base span, but need not be random
    df = df.withColumn("words", F.regexp_extract_all("t", F.lit("[a-z]{2,12}"), F.lit(0)))
    ordinary = F.concat(F.transform(F.filter("near", lambda c: c["x"].rlike(ORDINARY)), lambda c: c["x"]), F.filter(_named("words"), lambda x: F.length(x) >= 12))
    rows = F.concat(F.transform(values, lambda x: F.struct(F.lit(1).alias("random"), x.alias("x"))), F.transform(ordinary, lambda x: F.struct(F.lit(0).alias("random"), x.alias("x"))))
    spark, mark = docs.sparkSession, lambda df, random: df.select(F.lit(random).alias("random"), "x")
    return df.select(F.explode(rows).alias("r")).select("r.random", "r.x").unionByName(mark(generated(spark), 1)).unionByName(mark(numbered(spark), 0))


def pairs(x: Column) -> Column:
    """For each character of a string, its place in a table of pairs: the code before it, then its own."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), _code)
    return F.zip_with(F.concat(F.array(F.lit(0)), codes), codes, lambda a, b: F.when(b.isNotNull(), a * CODES + b))


def learn(strings: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of characters (CODES * CODES of them), from rows (random, x)."""
    each = strings.select("random", F.explode(pairs(F.col("x"))).alias("p")).where("p is not null")
    seen = each.groupBy("random", "p").agg(F.count("*").alias("n")).collect()  # at most two for each pair of characters
    counts = {(r.random, r.p): r.n for r in seen}
    before: dict[tuple[int, int], int] = {}
    for (kind, p), n in counts.items():
        before[kind, p // CODES] = before.get((kind, p // CODES), 0) + n
    chance = lambda kind, p: (counts.get((kind, p), 0) + PRIOR) / (before.get((kind, p // CODES), 0) + PRIOR * SYMBOLS)
    return [round(math.log(chance(1, p) / chance(0, p)), 4) for p in range(CODES * CODES)]


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    return learn(labelled(docs, sample))


def ratio(x: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string, random against ordinary, in one walk over its characters."""
    chances = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # a constant once the plan is optimised
    step = lambda a, c: F.struct(_code(c).alias("at"), (a["sum"] + F.coalesce(F.get(chances, a["at"] * CODES + _code(c)), F.lit(0.0))).alias("sum"))
    return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"])


def detected(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """c0 (doc_id), base_<kind> and new: what the models add."""
    df = candidates(base_spans(texts(docs)))
    return df.withColumn("new", F.filter("near", lambda c: ratio(c["x"], model) >= threshold)).drop("near")


def _listed(names: dict[str, str]) -> Column:
    """kind:start:end of the spans in the columns of ``names`` (kind to column), by start and then in the order of ``names``."""
    each = [F.transform(c, _one(lambda k, x: F.struct(x["s"].alias("s"), F.lit(k[0]).alias("i"), x["e"].alias("e"), F.lit(k[1]).alias("kind")), (i, k))) for i, (k, c) in enumerate(names.items())]
    return F.array_join(F.transform(F.array_sort(F.flatten(F.array(*each))), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_random,
    the number of spans that the models add."""
    df = detected(docs, train(docs) if model is None else model, threshold)
    base = {k: f"base_{k}" for k in KINDS}
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select(F.col("c0").alias("doc_id"), *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(base | {"random": "new"}).alias("spans"), F.size("new").cast("long").alias("n_random"))


def op12_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
