"""Plans that deal hot keys to several tasks, against plain Python."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from evispark.operators import delta, evidence, graph, occurrences


def test_smallest_containing_span(spark):
    r = random.Random(1)
    spans = [(f"f{r.randrange(2)}", a := r.randrange(-300, 300), a + r.choice([0, 1, 3, 8, 40, 200]) - (i % 20 == 0), f"s{i}") for i in range(150)]
    points = [(f"f{r.randrange(3)}", r.randrange(-350, 450), i) for i in range(300)]
    got = evidence.containing(spark.createDataFrame(points, "file string, at int, id int"), spark.createDataFrame(spans, "file string, a int, b int, name string"), ["file"], ["id"], "a", "b", "at", ["name"])
    want = {}
    for f, at, i in points:
        if around := [(b - a, n) for g, a, b, n in spans if g == f and a <= at <= b]:
            want[f, i] = min(around)
    assert {(x.file, x.id): (x.span.size, x.span.name) for x in got.collect()} == want
    none = spark.createDataFrame([], "file string, a int, b int, name string")
    assert not evidence.containing(spark.createDataFrame(points, "file string, at int, id int"), none, ["file"], ["id"], "a", "b", "at", ["name"]).collect()


@pytest.mark.parametrize("hot", [100_000, 6])
def test_surplus_of_hot_identities(spark, monkeypatch, hot):
    monkeypatch.setattr(delta, "HOT", hot)
    r = random.Random(2)
    rows = lambda n, at: [(r.choice(["hot", "hot", "hot", None, "x", "y"]), at + i) for i in range(n)]
    before, after = rows(60, 0), rows(80, 1000)
    got = delta.delta(spark.createDataFrame(before, "k string, line int"), spark.createDataFrame(after, "k string, line int"), ["k"], ["line"])

    def surplus(here, there):
        n, seen, out = Counter(k for k, _ in there), Counter(), set()
        for k, line in sorted(here, key=lambda x: x[1]):
            seen[k] += 1
            out |= {(k, line)} if seen[k] > n[k] else set()
        return out

    assert {(x.k, x.line) for x in got.where("change = 'added'").collect()} == surplus(after, before)
    assert {(x.k, x.line) for x in got.where("change = 'removed'").collect()} == surplus(before, after)


def test_prefix_within_bytes(spark):
    rows = [(i // 3, i, "x" * (i % 7) if i % 5 else None) for i in range(100)] + [(None, 1000, "null key")]
    df = spark.createDataFrame(rows, "a int, b int, text string")
    got = evidence.byte_prefix(df, ["a", "b"], F.octet_length("text"), 120)
    want, total = {}, 0
    for a, b, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        total += len(t or "")
        if total <= 120:
            want[a, b] = (t, total)
    assert {(x.a, x.b): (x.text, x.running) for x in got.collect()} == want


def test_passages_of_any_length(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcé\U0001f600") for _ in range(r.randrange(1, 5)))
    texts = [(i, " ".join(word() for _ in range(r.randrange(1, 30)))) for i in range(60)] + [(100, None), (101, ""), (102, "  two  spaces\nand a line")]
    passages = []
    for i in range(320):  # most of them shorter than three whole words
        t = r.choice(texts[:60])[1]
        a = r.randrange(len(t))
        passages.append((i, t[a : a + r.choice([1, 2, 3, 5, 9, 14, 30])]))
    passages += [(500, ""), (501, None), (502, "spaces\nand a"), (503, "zzz"), (504, " spaces\n"), (505, "spaces and")]
    got = occurrences.contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(passages, "p int, text string"), "id", "p")
    assert {(x.p, x.id) for x in got.collect()} == {(p, i) for p, s in passages for i, t in texts if s and t and s in t}
    nothing = spark.createDataFrame([], "p int, text string")
    assert not occurrences.contained(spark.createDataFrame(texts, "id int, text string"), nothing, "id", "p").collect()


@pytest.mark.parametrize("hub", [100_000, 3])
def test_walks_over_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    r = random.Random(7)
    pairs = {("hub", f"n{i:02d}") for i in range(30)} | {(f"n{r.randrange(30):02d}", f"n{r.randrange(30):02d}") for _ in range(25)} | {("root", "hub"), ("root", "n01")}
    edges = spark.createDataFrame([("call", f"e{i}", a, b) for i, (a, b) in enumerate(sorted(pairs))], "kind string, relationship_id string, src string, dst string")
    depth, waiting = {"root": 0}, deque(["root"])
    while waiting:
        a = waiting.popleft()
        for x, b in sorted(pairs):
            if x == a and b not in depth:
                depth[b] = depth[a] + 1
                waiting.append(b)
    got = graph.reach(edges, spark.createDataFrame([("root",)], "node string"))
    assert {x.node: x.depth for x in got.collect()} == depth
    ids = {p: f"e{i}" for i, p in enumerate(sorted(pairs))}
    best = {"root": []}
    for d in range(1, max(depth.values()) + 1):
        layer = {}
        for (a, b), e in ids.items():
            if depth.get(b) == d and depth.get(a) == d - 1:
                layer.setdefault(b, []).append([*best[a], e])
        best |= {b: min(p, key=lambda x: str(x).replace("'", '"').replace(", ", ",")) for b, p in layer.items()}
    assert {x.node: x.path for x in graph.canonical_paths(edges, "root").collect()} == {n: p for n, p in best.items() if n != "root"}
