"""What is kept and brought up to date: closures and tree digests, against making them anew."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evispark.contracts import QueryError
from evispark.operators import closure, graph, tree_digest
from evispark.operators.closure import StoredClosure


def pairs_of(edges):
    """All (node, ancestor) by walking from every node."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        waiting, seen = [a], set()
        while waiting:
            for b in after.get(waiting.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    waiting.append(b)
        out |= {(a, b) for b in seen if a != b}
    return out


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src string, dst string")


def test_closure_after_random_edits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(closure, "MOST", 2)
    r = random.Random(6)
    nodes = [f"n{i}" for i in range(14)]
    stored, held = StoredClosure(spark, str(tmp_path / "c")), set()
    for turn in range(6):
        come = {(r.choice(nodes), r.choice(nodes)) for _ in range(9 if turn else 14)}
        gone = set(r.sample(sorted(held), min(len(held), 6))) | {("n1", "nowhere")} | ({("n2", "n3")} if turn == 3 else set())
        if turn == 3:
            come |= {("n2", "n3")}  # comes and goes at once
        stored.update(frame(spark, come), frame(spark, gone))
        real = {e for e in come if e[0] != e[1]}
        held = (held | (real - gone)) - (gone - real)
        assert {tuple(x) for x in stored.edges().collect()} == held
        found = [tuple(x) for x in stored.pairs().collect()]
        assert len(found) == len(set(found)) and set(found) == pairs_of(held)
    assert len(stored.commits.latest()[1]["parts"]) <= 2
    assert {tuple(x) for x in graph.ancestors(frame(spark, held)).collect()} == pairs_of(held)


def test_closure_updates_change_little(spark, tmp_path):
    """A chain with a shortcut: taking the shortcut away changes no pair; a new edge adds its pairs alone."""
    chain = {(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)}
    edges = frame(spark, chain | {("n03", "n09")})
    pairs = graph.ancestors(edges)
    removed, added = closure.updated(pairs, edges, frame(spark, {("x", "n18")}), frame(spark, {("n03", "n09")}))
    assert removed.count() == 0 and sorted(x.ancestor for x in added.collect()) == ["n18", "n19", "n20"]
    stored = StoredClosure(spark, str(tmp_path / "c"))
    stored.update(edges, edges.limit(0))
    late = StoredClosure(spark, str(tmp_path / "c"))
    seen = late.commits.latest()
    stored.update(frame(spark, {("y", "n20")}), edges.limit(0))
    late.commits.latest, again = (lambda: seen), late.commits.latest
    monkey = late.commits.create
    late.commits.create = lambda after, body: (setattr(late.commits, "latest", again), monkey(after, body))[1]
    with pytest.raises(QueryError, match="CONFLICT"):
        late.update(frame(spark, {("z", "n20")}), edges.limit(0))
    assert stored.pairs().where("node = 'y'").count() == 1 and stored.pairs().where("node = 'z'").count() == 0


@pytest.mark.parametrize("short", [0, 1000])
def test_closure_keeps_pairs_of_inner_nodes_alone(spark, tmp_path, monkeypatch, short):
    """Sources over a chain: none of their pairs is stored, all are read; whether short sides are sent to all tasks or not."""
    monkeypatch.setattr(graph, "FEW", short)
    monkeypatch.setattr(closure, "MOST", 3)
    chain = {(f"n{i}", f"n{i + 1}") for i in range(5)}
    held = chain | {(f"s{i}", f"n{i % 3}") for i in range(60)} | {(f"s{i}", "n4") for i in range(0, 60, 7)}  # some have two edges
    stored = StoredClosure(spark, str(tmp_path / "c"))
    stored.update(frame(spark, held), spark.createDataFrame([], "src string, dst string"))
    kept = lambda what: spark.read.parquet(*[f"{stored.commits.folder}/{p}/{what}" for p in stored.commits.latest()[1]["parts"]])
    assert kept("pairs").count() == len(pairs_of({e for e in held if e[0] in "n0 n1 n2 n3 n4"})) and kept("pairs").where("node like 's%'").isEmpty()
    edits = [({("t", "s0"), ("t", "s1"), ("s1", "s2"), ("n5", "s3")}, {("n2", "n3")}), ({("n2", "n3"), ("s4", "s4")}, {("t", "s0"), ("s5", "n2"), ("n5", "s3")}), ({("s0", "s6")}, {("t", "s1"), ("s1", "s2")})]
    for come, gone in edits:
        stored.update(frame(spark, come), frame(spark, gone))
        held = (held | {e for e in come if e[0] != e[1]}) - gone
        found = [tuple(x) for x in stored.pairs().collect()]
        assert len(found) == len(set(found)) and set(found) == pairs_of(held)
        assert sorted(map(tuple, stored.edges().collect())) == sorted(held)
    # written anew, what no edge leads to any more is a source again
    assert len(stored.commits.latest()[1]["parts"]) == 1
    assert {x.node for x in kept("pairs").collect()} == {"n0", "n1", "n2", "n3", "n4", "s6"}


FILES = "path string, content_hash string"


def made(files, levels):
    """The tree in plain Python."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sums = {}
    for path, h in files:
        own, at = sha(f"{path}\0{h or ''}"), sha(path)[:levels]
        n, lanes = sums.get(at, (0, [0] * 8))
        sums[at] = (n + 1, [(a + int(own[8 * i : 8 * i + 8], 16)) % 2**32 for i, a in enumerate(lanes)])
    out = {p: (n, sha("|".join(["v1", str(n), *map(str, lanes)]))) for p, (n, lanes) in sums.items()}
    level = dict(out)
    for _ in range(levels):
        ups = {}
        for p, x in level.items():
            ups.setdefault(p[:-1], {})[p[-1]] = x
        level = {p: (sum(n for n, _ in c.values()), sha("".join(c[d][1] if d in c else "-" for d in "0123456789abcdef"))) for p, c in ups.items()}
        out |= level
    return out


def test_tree_digest(spark):
    r = random.Random(3)
    files = [(f"src/f{i}.ts", f"h{r.randrange(9)}") for i in range(120)] + [("odd é", None), ("", "x"), ("twice", "a"), ("twice", "a")]
    path, h = F.col("path"), F.col("content_hash")
    told = lambda t: {x.prefix: (x.n, x.digest) for x in t.select("prefix", "n", "digest").collect()}
    old = tree_digest.tree(spark.createDataFrame(files, FILES), path, h, 3)
    assert told(old) == made(files, 3) and tree_digest.root(old) == made(files, 3)[""][1]
    # one changed file touches one node a level
    fresh = tree_digest.updated(old, spark.createDataFrame(files[:1], FILES), spark.createDataFrame([(files[0][0], "other")], FILES), levels=3)
    assert sorted(len(x.prefix) for x in fresh.collect()) == [0, 1, 2, 3]
    now = [(files[0][0], "other"), *files[1:]]
    tree = tree_digest.replaced(old, fresh)
    assert told(tree) == made(now, 3)
    # files come, go and change; the order of parts does not count
    gone, come = r.sample(now, 30), [(f"new{i}", "h") for i in range(10)]
    left = list(now)
    for x in gone:
        left.remove(x)
    fresh = tree_digest.updated(tree, spark.createDataFrame(gone, FILES), spark.createDataFrame(come, FILES), levels=3)
    assert told(tree_digest.replaced(tree, fresh)) == made(left + come, 3)
    mixed = spark.createDataFrame(r.sample(left + come, len(left + come)), FILES).repartition(7)
    assert told(tree_digest.tree(mixed, path, h, 3)) == made(left + come, 3)
    # all of them gone
    everything = tree_digest.updated(old, spark.createDataFrame(files, FILES), spark.createDataFrame([], FILES), levels=3)
    empty = tree_digest.replaced(old, everything)
    nothing = tree_digest.tree(spark.createDataFrame([], FILES), path, h, 3)
    assert tree_digest.root(empty) == tree_digest.root(nothing) and told(nothing) == {}
    assert tree_digest.root(old) != tree_digest.root(tree)
