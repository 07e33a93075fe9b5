"""Personal data by candidate gradient boosting, in DataFrame operations alone.

Base patterns with their checks find what is certain. High-recall generators propose further, overlapping spans; each
proposal's format and context become small numbers, boosted trees turn them into a score, and a threshold for each
kind, calibrated on rows that the trees did not see, selects the spans that are added.

What the trees learn from: in all documents every base span is rewritten, in its own context, into a wider form that
no base pattern takes (spelled-out signs, other separators, no plus, two numbers side by side, a longer address) or into
a broken one (a wrong check digit, a part too many). Proposals that are the rewritten span are positives; broken ones,
proposals of another kind, with other borders, and all proposals of the texts as they stand that touch no base span are
negatives, but for those that pass their kind's own check, of which nobody knows what they are. Calibration uses other
documents and, beside these forms, one that the trees never saw. Only proposals that could be added count in it. Generated
texts, with data of each kind and with numbers that are none, stand beside the documents at any size of the table, so that
no kind is without positives and negatives where documents are few. A kind whose precision does not reach PRECISION
adds nothing; ``switched_off`` names such kinds.

Positions are code points. They follow from the texts between matches, so that every text is scanned whole and
nothing leaves the row: no row is exploded, and scoring needs no shuffle. Sums and maxima along a text's matches are
taken in blocks, so that a text of very many matches takes time in proportion to them.

Defined cases: null texts are empty and have no spans; very long texts are scanned like others, with patterns that
never start again inside a run they have refused; equal rows have equal spans; of added spans that overlap, the first
one stays (of those that begin together, the longest); an empty table gives an empty result;
find() ignores other columns, redact() passes them by untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
#: A match starts where its run starts or where the match before ended; elsewhere the run has been refused already.
RUN = r"(?:\G|(?<![%s]))"
LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": RUN % LOCAL + rf"[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": RUN % "0-9" + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: How @ and the point of an address may be spelled out, and what may stand between the numbers of an address.
AT, DOT = r"\x20?[\[(]at[\])]\x20?", r"\x20?[\[(]dot[\])]\x20?"
BETWEEN = r"(?:[.,]|\[\.\]|\(\.\)|" + DOT + ")"
#: Proposals: wider than the base patterns, and overlapping each other and them.
GENERATORS = {
    "email": [RUN % LOCAL + rf"[{LOCAL}]++(?:@|{AT})[A-Za-z0-9-]++(?:(?:\.|{DOT})[A-Za-z0-9-]++)*+"],
    "ip": [RUN % "0-9A-Fa-f:." + rf"[0-9]++(?:{BETWEEN}[0-9]++){{3}}+", RUN % "0-9A-Fa-f:." + r"(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+"],
    "card": [r"[0-9](?:[\x20._/-]?[0-9]){11,}+", r"(?<![0-9])[0-9]{4}(?:[\x20._/-]?[0-9]{4}){3}[0-9]{0,3}(?![0-9])"],
    "phone": [r"(?:\+|\(|00)?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"],
}
#: What must stand in a text for a pattern to be tried at all.
NEEDS = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
CONTEXT = 24
#: Trees, learning rate, precision that a threshold must reach, and confirmed proposals that it must rest on.
TREES, RATE, PRECISION, CONFIRMED = 20, 0.3, 0.9, 10
#: Generated texts of each form that the trees learn from beside the documents.
GENERATED = 60
#: Elements that one step of a running sum copies.
BLOCK = 64
SPANS = "array<struct<s:int,e:int,x:string>>"


def _one(f: Callable, first) -> Callable[[Column], Column]:
    """``f`` with its first argument fixed, as the one-argument function that array functions take."""
    return lambda c: f(first, c)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled with its digits added, makes a multiple of ten with the others."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _octets(x: Column) -> Column:
    """Whether every part is at most 255, zeros before it or not."""
    parts = F.transform(F.split(x, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.length(p) < 4) & (F.coalesce(F.substring(F.concat(F.lit("0"), p), 1, 4).cast("int"), F.lit(0)) <= 255))


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return _octets(x)
    n = F.length(_digits(x))
    return {"card": n.between(16, 19) & _luhn(_digits(x)), "phone": n.between(8, 15)}.get(kind, F.lit(True))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _running(values: str, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``op`` over a column of arrays of ints, from 0 on, block by block."""
    n = F.size(values)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<int>>"))

    def along(x: Column, at: Column, before: bool) -> Column:
        step = lambda a, v: F.struct(op(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"] if before else op(a["at"], v))).alias("out"))
        return F.aggregate(x, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])

    heads = along(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), op)), F.lit(0), True)
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), heads.alias("head")), lambda z: along(z["block"], z["head"], False)))


def _before_each(df: DataFrame, name: str, values: Column, op: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds ``name``: for each element of ``values``, the result of ``op`` over those before it."""
    df = df.withColumn(name, values)
    return df.withColumn(name, F.slice(F.concat(F.array(F.lit(0)), _running(name, op)), 1, F.size(name)))


def _found(df: DataFrame, name: str, pattern: str, needs: str) -> DataFrame:
    """Adds ``name``: array of (s, e, x): start, end (exclusive) and text of each match of ``pattern`` in t."""
    tried = F.col("t").rlike(needs)
    df = df.withColumn("_m", F.when(tried, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    # the last piece, after the last match, goes with none
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.transform(F.slice(F.split("t", pattern, -1), 1, F.size("_m")), F.length)).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_n", F.transform(F.arrays_zip("_g", "_m"), lambda z: z["_g"] + F.length(z["_m"])))
    df = df.withColumn("_e", F.when(F.size("_m") == 1, F.col("_n")).otherwise(_running("_n", _plus)))
    return df.withColumn(name, F.transform(F.arrays_zip("_e", "_m"), lambda z: F.struct((z["_e"] - F.length(z["_m"])).alias("s"), z["_e"].alias("e"), z["_m"].alias("x")))).drop("_m", "_g", "_n", "_e")


def base_spans(df: DataFrame) -> DataFrame:
    """Adds, for the texts t and each kind, the array base_<kind> of what the base pattern finds and its check confirms."""
    for k in KINDS:
        df = _found(df, f"_{k}", BASE[k], "@" if k == "email" else r"\+[0-9]" if k == "phone" else "[0-9]")
        df = df.withColumn(f"base_{k}", F.filter(f"_{k}", _one(lambda k, c: _valid(k, c["x"]), k))).drop(f"_{k}")
    return df


def spans(df: DataFrame) -> DataFrame:
    """Adds, for the texts t and each kind, the arrays base_<kind> and near_<kind> (proposed)."""
    df = base_spans(df)
    for k in KINDS:
        for i, pattern in enumerate(GENERATORS[k]):
            df = _found(df, f"_near{i}", pattern, NEEDS[k])
        parts = [f"_near{i}" for i in range(len(GENERATORS[k]))]
        df = df.withColumn(f"near_{k}", F.array_distinct(F.concat(*parts)) if len(parts) > 1 else F.col(parts[0])).drop(*parts)
    return df


def texts(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` as c0, c1, ..., so that no name clashes, and the texts t."""
    return docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry or ["doc_id"])], F.coalesce(F.col("text"), F.lit("")).alias("t"))


def _meets(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _free(df: DataFrame, name: str, own: str, taken: str | None = None) -> DataFrame:
    """Adds ``name``: those of ``own`` (array of (s, e, x)) that touch none of ``taken`` (array of (s, e)), in order of start;
    without ``taken``, those that touch none before them."""
    place = lambda c, kind, i: F.struct(c["s"].alias("s"), F.lit(kind).alias("kind"), (-c["e"]).alias("e"), i.alias("i"))
    both = F.transform(own, lambda c, i: place(c, 1, i))
    if taken is not None:
        both = F.concat(F.transform(taken, lambda c: place(c, 0, F.lit(0))), both)
    df = df.withColumn("_both", F.when(F.size(own) > 0, F.array_sort(both)).otherwise(F.slice(both, 1, 0)))
    # in order of start: the furthest end before, and the nearest start of a taken span after
    far = 1 << 30
    df = _before_each(df, "_far", F.transform("_both", lambda x: F.when(F.lit(taken is None) | (x["kind"] == 0), -x["e"]).otherwise(0)), _most)
    df = _before_each(df, "_near", F.transform(F.reverse("_both"), lambda x: F.when(x["kind"] == 0, far - x["s"]).otherwise(0)), _most)
    kept = F.filter(F.arrays_zip("_both", "_far", F.reverse("_near").alias("_near")), lambda z: (z["_both"]["kind"] == 1) & (z["_far"] <= z["_both"]["s"]) & (far - z["_near"] >= -z["_both"]["e"]))
    return df.withColumn(name, F.transform(kept, lambda z: F.col(own)[z["_both"]["i"]])).drop("_both", "_far", "_near")


#: Words before a proposal that name its kind.
WORDS = {"email": "mail|contact|write", "ip": "(?:^|[^a-z])(?:ip|host|addr|server)", "card": "card|visa|account|pay", "phone": "phone|tel|call|mobile|fax"}


def _before(c: Column) -> Column:
    return F.substring("t", F.greatest(c["s"] - CONTEXT + 1, F.lit(1)), F.least(c["s"], F.lit(CONTEXT)))


def _normal(kind: str, x: Column) -> Column:
    """A span without what its form adds."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(x, AT, "@"), DOT, ".")
    return F.regexp_replace(F.regexp_replace(x, DOT, "."), "[^0-9A-Fa-f:]+", ".") if kind == "ip" else _digits(x)


def _sound(kind: str, x: Column) -> Column:
    """Whether a proposal passes its kind's check once its form is made plain."""
    plain = _normal(kind, x)
    if kind == "email":
        return plain.rlike(rf"^[{LOCAL}]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,}}$")
    if kind == "ip":
        return plain.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & _octets(plain) | plain.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
    return _valid(kind, x)


FEATURES = ("sound", "digits", "groups", "length", "letters", "paren", "bracket", "dot", "space", "dash", "other", "left", "right", "quoted", "word", "mark")


def features(kind: str, c: Column) -> Column:
    """Small numbers from a proposal's format and surroundings."""
    x = c["x"]
    plain = F.regexp_replace(x, r"^\+", "")
    before = _before(c)
    last, after = F.substring(before, -1, 1), F.substring(F.col("t"), c["e"] + 1, F.lit(1))
    flag = lambda p: x.rlike(p).cast("int")
    return F.array(
        _sound(kind, x).cast("int"), F.least(F.length(_digits(x)), F.lit(20)), F.least(F.size(F.split(plain, "[^0-9]+")), F.lit(8)), F.least(F.floor(F.length(plain) / 4).cast("int"), F.lit(12)),
        F.least(F.length(F.regexp_replace(x, "[^A-Za-z]", "")), F.lit(12)), flag("[()]"), flag(r"\["), flag(r"\."), flag(" "), flag("-"), flag("[,:/_]"),
        last.rlike(r"^[\p{L}\p{N}]$").cast("int"), after.rlike(r"^[\p{L}\p{N}]$").cast("int"), last.rlike("^[\"'=]$").cast("int"),
        F.lower(before).rlike(WORDS[kind]).cast("int"), after.rlike("^[.,;:!?]$").cast("int"),
    )


#: Forms in which the trees see a rewritten span, the form they are calibrated on, and the broken one.
SEEN, UNSEEN, BROKEN = (0, 1, 2), 3, 4


def rewritten(kind: str, x: Column, form: int) -> Column:
    """A base span in a wider form that no base pattern takes, or broken."""
    digits, grouped = _digits(x), lambda d, sep: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", "$1" + sep)
    name, host = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    spelled = lambda at, dot: F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))
    spread = lambda sep: F.replace(x, F.lit("."), F.lit(sep))
    wrong = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((F.substring(digits, -1, 1).cast("int") + 1) % 10).cast("string"))
    plain = F.substring(x, F.lit(2), F.length(x))
    return {
        "email": [spelled(" [at] ", " [dot] "), spelled("(at)", "(dot)"), spelled(" [at] ", "."), spelled(" (at) ", " (dot) "), spelled(" [at] ", "")],
        "ip": [spread(","), F.regexp_replace(F.md5(x.cast("binary")), "(.{4})(?=.)", "$1:"), spread("[.]"), spread("(.)"), F.concat(F.lit("9"), F.lpad(spread(","), 15, "9"))],
        "card": [grouped(digits, "."), F.concat(digits, F.lit(" "), digits), grouped(digits, "_"), grouped(digits, "/"), grouped(wrong, ".")],
        "phone": [plain, F.concat(F.lit("00"), digits), F.regexp_replace(plain, "[^0-9]+", "."), F.regexp_replace(x, r"^\+[0-9]+[\x20.-]*", ""), F.concat(digits, F.lit(" "), digits, F.lit(" "), digits)],
    }[kind][form]


def planted(df: DataFrame, form: int) -> DataFrame:
    """Texts t with their base spans rewritten (and held), and truth: array of (s, e, kind, plain), plain being null for broken ones."""

    def change(k: str, c: Column) -> Column:
        r = rewritten(k, c["x"], form)
        # of two cards side by side, each one is meant
        plain = F.lit(None).cast("string") if form == BROKEN else _normal(k, c["x"] if k == "card" else r)
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), F.lit(k).alias("kind"), r.alias("r"), plain.alias("plain"))

    every = F.concat(*[F.transform(f"base_{k}", _one(change, k)) for k in KINDS])
    df = df.select("t", "held", F.array_sort(every).alias("own")).where(F.size("own") > 0)
    # spans that begin inside another one stay as they are
    df = _before_each(df, "last", F.transform("own", lambda c: c["e"]), _most)
    df = df.withColumn("own", F.transform(F.filter(F.arrays_zip("own", "last"), lambda z: z["last"] <= z["own"]["s"]), lambda z: z["own"]))
    df = df.withColumn("last", F.slice(F.concat(F.array(F.lit(0)), F.transform("own", lambda c: c["e"])), 1, F.size("own")))
    df = df.withColumn("pieces", F.transform(F.arrays_zip("own", "last"), lambda z: F.struct(F.substring(F.col("t"), z["last"] + 1, z["own"]["s"] - z["last"]).alias("gap"), z["own"].alias("c"))))
    df = df.withColumn("at", F.transform("pieces", lambda p: F.length(p["gap"]) + F.length(p["c"]["r"]))).withColumn("at", _running("at", _plus))
    truth = F.transform(F.arrays_zip("pieces", "at"), lambda z: F.struct((z["at"] - F.length(z["pieces"]["c"]["r"])).alias("s"), z["at"].alias("e"), z["pieces"]["c"]["kind"].alias("kind"), z["pieces"]["c"]["plain"].alias("plain")))
    tail = F.substring(F.col("t"), F.element_at("own", -1)["e"] + 1, F.length("t"))
    return df.select(F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["gap"], p["c"]["r"])), ""), tail).alias("t"), "held", truth.alias("truth"))


@dataclass
class Trees:
    """Boosted trees of two levels: (feature, cut, value if both no, no-yes, yes-no, yes-yes)."""

    bias: float = 0.0
    trees: list[tuple[int, int, tuple[int, int], tuple[int, int], tuple[float, float, float, float]]] = field(default_factory=list)
    #: score from which a proposal is added
    threshold: float = float("inf")

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, c, (fl, cl), (fr, cr), v in self.trees:
            right = x[:, f] > c
            out += np.where(right, np.where(x[:, fr] > cr, v[3], v[2]), np.where(x[:, fl] > cl, v[1], v[0]))
        return out

    def column(self, f: Column) -> Column:
        """The raw score of a proposal with the features ``f``, an array."""
        out = F.lit(self.bias)
        for a, c, (fl, cl), (fr, cr), v in self.trees:
            out = out + F.when(f[a] > c, F.when(f[fr] > cr, v[3]).otherwise(v[2])).otherwise(F.when(f[fl] > cl, v[1]).otherwise(v[0]))
        return out


def _cut(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """Gain, feature and cut of the best split by gradients and curvatures."""
    best = (0.0, 0, 1 << 30)
    if not len(x):
        return best
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            r = x[:, f] > c
            gain = g[r].sum() ** 2 / (h[r].sum() + 1) + g[~r].sum() ** 2 / (h[~r].sum() + 1) - whole
            if gain > best[0] + 1e-9:
                best = (float(gain), f, int(c))
    return best


def boost(x: np.ndarray, y: np.ndarray, n: np.ndarray, trees: int = TREES, rate: float = RATE) -> Trees:
    """Second-order boosting of the logistic loss on rows with counts ``n``."""
    share = (y * n).sum() / max(n.sum(), 1)
    out = Trees(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    raw = np.full(len(x), out.bias)
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = n * (y - p), n * p * (1 - p)
        gain, f, c = _cut(x, g, h)
        if gain <= 1e-6:
            break
        right = x[:, f] > c
        _, fl, cl = _cut(x[~right], g[~right], h[~right])
        _, fr, cr = _cut(x[right], g[right], h[right])
        parts = [~right & ~(x[:, fl] > cl), ~right & (x[:, fl] > cl), right & ~(x[:, fr] > cr), right & (x[:, fr] > cr)]
        v = tuple(float(rate * g[m].sum() / (h[m].sum() + 1)) for m in parts)
        out.trees.append((f, c, (fl, cl), (fr, cr), v))
        raw = raw + sum(m * a for m, a in zip(parts, v, strict=True))
    return out


def calibrated(m: Trees, x: np.ndarray, y: np.ndarray, n: np.ndarray, precision: float = PRECISION) -> float:
    """The least score from which at least ``precision`` of unseen proposals are confirmed; infinite if there is none."""
    s = m.scores(x)
    for t in np.unique(s):
        took = s >= t
        if (n * y)[took].sum() >= CONFIRMED and (n * y)[took].sum() >= precision * n[took].sum():
            return float(t) - 1e-9
    return float("inf")


def _taken() -> Column:
    """The base spans of all kinds, which no added span may touch."""
    return F.flatten(F.array(*[F.transform(f"base_{k}", lambda c: F.struct(c["s"], c["e"])) for k in KINDS]))


def _examples(df: DataFrame) -> DataFrame:
    """Rows (held, kind, f, y) of the proposals that touch no base span: features, and whether ``truth`` (null: nothing is
    rewritten) confirms them. Where nothing is rewritten, those that pass their kind's check are left out."""
    df = df.withColumn("taken", _taken())
    each = []

    def example(k: str, c: Column) -> Column:
        plain, unknown = _normal(k, c["x"]), F.lit(False)
        if k != "phone":  # any number of as many digits passes a phone's check
            unknown = _sound(k, c["x"]) & ~F.coalesce(F.exists("truth", lambda p: _meets(p, c)), F.lit(False))
        mine = F.exists("truth", lambda p: (p["kind"] == k) & (p["s"] <= c["s"]) & (c["e"] <= p["e"]) & (p["plain"] == plain))
        return F.struct(F.lit(KINDS.index(k)).alias("kind"), features(k, c).alias("f"), F.coalesce(mine, F.lit(False)).cast("int").alias("y"), unknown.alias("unknown"))

    for k in KINDS:
        df = _free(df, f"free_{k}", f"near_{k}", "taken")
        each.append(F.transform(f"free_{k}", _one(example, k)))
    return df.select("held", F.explode(F.flatten(F.array(*each))).alias("r")).select("held", "r.*").where("not unknown")


def generated(spark: SparkSession, number: int = GENERATED) -> DataFrame:
    """Texts t with personal data of each kind, and others with numbers that are none, all made of numbers by rule."""
    i = F.col("id")
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    digits = lambda salt, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**n)).cast("string"), n, "0")
    head = F.concat(F.lit("4"), digits(1, 14))
    card = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string"))), _luhn), F.lit(0))
    card = F.when(i % 2 == 0, card).otherwise(F.regexp_replace(card, "([0-9]{4})(?=[0-9])", F.when(i % 3 == 0, "$1-").otherwise("$1 ")))
    name = F.concat_ws(".", F.element_at(F.array(*map(F.lit, ("ann", "lee", "info", "sam.roe", "x_y"))), (draw(2, 5) + 1).cast("int")), draw(3, 90).cast("string"))
    host = F.concat(F.lit("host"), draw(4, 40).cast("string"), F.element_at(F.array(F.lit(".org"), F.lit(".example.com"), F.lit("-net.de")), (draw(5, 3) + 1).cast("int")))
    address = F.concat_ws(".", *[draw(6 + j, 256).cast("string") for j in range(4)])
    phone = F.concat(F.lit("+"), (draw(11, 90) + 1).cast("string"), F.lit(" "), digits(12, 3), F.when(i % 2 == 0, "-").otherwise(" "), digits(13, 3), F.lit("-"), digits(14, 4))
    day = F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), draw(15, 12_000).cast("int")), "yyyy-MM-dd")
    forms = [
        ("please write to ", F.concat(name, F.lit("@"), host), " before noon."), ("it came from ", F.concat(name, F.lit("@"), host), ", so they say"),
        ("the server at ", address, " answers again"), ("seen ", address, " in the log"),
        ("the card ", card, " was charged"), ("paid with ", card, "."),
        ("call ", phone, " today"), ("my number is ", phone, ", thanks"),
        ("order ", digits(16, 10), " of "), ("it holds ", F.concat(digits(17, 4), F.lit(" "), digits(18, 4)), " rows"), ("since ", day, " nothing"), ("the sum is ", digits(19, 13), " now"),
        ("version ", F.concat_ws(".", draw(20, 20).cast("string"), draw(21, 20).cast("string"), draw(22, 2000).cast("string")), " is out"), ("item ", digits(23, 17), " of the list"),
    ]
    return spark.range(number).select(F.explode(F.array(*[F.concat(F.lit(a), x, F.lit(b), F.lit(" and so on "), draw(30 + j, 100).cast("string")) for j, (a, x, b) in enumerate(forms)])).alias("t"))


def train(docs: DataFrame) -> dict[str, Trees]:
    """Trees and thresholds of each kind, from the proposals of all documents and of generated texts."""
    scratch = Scratch(docs.sparkSession)
    both = texts(docs.select("doc_id", "text")).select("t").unionByName(generated(docs.sparkSession))
    plain = scratch.table(base_spans(both).withColumn("held", F.pmod(F.xxhash64("t"), F.lit(2)) == 0))
    # half of the documents, by text, is not seen by the trees
    made = plain.select("t", "held", F.lit(None).cast("array<struct<s:int,e:int,kind:string,plain:string>>").alias("truth"))
    for form in (*SEEN, UNSEEN, BROKEN):
        made = made.unionByName(planted(plain.where("held") if form == UNSEEN else plain, form))
    made = scratch.table(made)
    rows = _examples(spans(made))
    # one row for each different set of small numbers
    counts = rows.groupBy("kind", "f", "y", "held").agg(F.count("*").alias("n")).collect()
    counts.sort(key=lambda r: (r.kind, r.f, r.y, r.held))
    scratch.free(plain, made)
    out = {}
    for i, k in enumerate(KINDS):
        own = [r for r in counts if r.kind == i]
        x, y, n = np.array([r.f for r in own], np.int64).reshape(-1, len(FEATURES)), np.array([r.y for r in own], float), np.array([r.n for r in own], float)
        held_ = np.array([r.held for r in own], bool)
        out[k] = Trees()
        if {0.0, 1.0} <= set(y[~held_].tolist()):
            out[k] = boost(x[~held_], y[~held_], n[~held_])
            out[k].threshold = calibrated(out[k], x[held_], y[held_], n[held_])
    return out


def switched_off(models: dict[str, Trees]) -> list[str]:
    """Kinds that add nothing."""
    return [k for k in KINDS if models[k].threshold == float("inf")]


def detected(docs: DataFrame, models: dict[str, Trees], carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (as c0, c1, ...), t, base_<kind>, and all_<kind>: base spans and added ones, by start."""
    df = spans(texts(docs, carry)).withColumn("taken", _taken())
    for k in KINDS:
        new = F.array().cast("array<struct<s:int,e:int>>")
        if models[k].threshold < float("inf"):
            scored = F.filter(f"near_{k}", _one(lambda k, c: models[k].column(features(k, c)) >= models[k].threshold, k))
            df = df.withColumn("scored", scored)
            df = _free(df, "scored", "scored", "taken")
            df = _free(df, "scored", "scored")
            new = F.transform("scored", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))
        df = df.withColumn(f"new_{k}", new).withColumn("taken", F.concat("taken", f"new_{k}"))
        base = F.transform(f"base_{k}", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))
        df = df.withColumn(f"all_{k}", F.array_sort(F.concat(base, F.col(f"new_{k}")))).drop(f"near_{k}", f"new_{k}", "scored")
    return df.drop("taken")


def _listed(prefix: str) -> Column:
    each = [F.transform(f"{prefix}_{k}", _one(lambda k, c: F.concat_ws(":", F.lit(k), c["s"].cast("string"), c["e"].cast("string")), k)) for k in KINDS]
    return F.array_join(F.flatten(F.array(*each)), ",")


def find(docs: DataFrame, models: dict[str, Trees] | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_spans,
    the number of base and added spans of all kinds."""
    df = detected(docs, train(docs) if models is None else models)
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select(F.col("c0").alias("doc_id"), *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("all").alias("spans"), sum((F.size(f"all_{k}") for k in KINDS[1:]), F.size(f"all_{KINDS[0]}")).cast("long").alias("n_spans"))


def redact(docs: DataFrame, models: dict[str, Trees] | None = None) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets; n_chars, if there, counts the new text."""
    names = docs.columns
    df = detected(docs, train(docs) if models is None else models, names)
    tagged = F.flatten(F.array(*[F.transform(f"all_{k}", _one(lambda k, c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.lit(f"<{k}>").alias("tag")), k)) for k in KINDS]))
    df = df.withColumn("cuts", F.array_sort(tagged))
    # pieces between spans; of spans that overlap, the later one only adds its tail
    df = df.withColumn("ends", F.transform("cuts", lambda c: c["e"])).withColumn("ends", F.concat(F.array(F.lit(0)), _running("ends", _most)))
    piece = lambda z: F.concat(F.substring(F.col("t"), z["at"] + 1, F.greatest(z["cuts"]["s"] - z["at"], F.lit(0))), F.when(z["cuts"]["s"] >= z["at"], z["cuts"]["tag"]).otherwise(""))
    walk = F.concat(F.array_join(F.transform(F.arrays_zip("cuts", F.slice("ends", 1, F.size("cuts")).alias("at")), piece), ""), F.substring(F.col("t"), F.element_at("ends", -1) + 1, F.length("t")))
    i = names.index("text")
    text = F.when(F.col(f"c{i}").isNull(), F.lit(None)).when(F.size("cuts") == 0, F.col("t")).otherwise(walk)
    out = []
    for j, c in enumerate(names):
        if c == "text":
            out.append(text.alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.size("cuts") == 0, F.col(f"c{j}")).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"c{j}").alias(c))
    return df.select(*out)


def op6_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
