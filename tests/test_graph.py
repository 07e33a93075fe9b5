"""Graph walks against brute force on generated graphs, their budgets, ties and refusals."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from evispark.contracts import QueryError
from evispark.operators import evidence, files, graph, resolution


def edge_table(spark, pairs):
    return spark.createDataFrame([(i, "call", a, b) for i, a, b in pairs], "relationship_id string, kind string, src string, dst string")


def made(seed, nodes=9, edges=16):
    """A graph of places with roads between them; ids say nothing about where a road leads."""
    r = random.Random(seed)
    names = [f"place {c}" for c in "mnopqrstuvwx"[:nodes]]
    pairs = sorted({(r.choice(names), r.choice(names)) for _ in range(edges)})
    ids = r.sample(range(100, 1000), len(pairs))
    return names, [(f"road {i}", a, b) for i, (a, b) in zip(ids, pairs, strict=True) if a != b]


def simple_paths(roads, root, depth):
    """Every path of at most ``depth`` roads that meets no place twice: (end, ids)."""
    todo = [([root], [])]
    while todo:
        places, ids = todo.pop()
        if ids:
            yield places[-1], ids
        if len(ids) < depth:
            todo += [([*places, b], [*ids, i]) for i, a, b in roads if a == places[-1] and b not in places]


def fifo(roads, root, max_depth, max_nodes, max_edges):
    """The walk in words: first in, first out, a place's roads in order of the other end and the id."""
    nodes, taken, why, queue = {root: 0}, [], set(), [root]
    for place in queue:
        for i, other in sorted(((i, a) for i, a, b in roads if b == place), key=lambda x: (x[1], x[0])):
            if i in taken:
                continue
            new = other not in nodes
            if new and nodes[place] == max_depth:
                why.add("depth_limit")
            elif new and len(nodes) == max_nodes:
                why.add("record_limit")
            elif len(taken) == max_edges:
                why.add("edge_limit")
            else:
                taken.append(i)
                if new:
                    nodes[other] = nodes[place] + 1
                    queue.append(other)
    return nodes, set(taken), [x for x in ("depth_limit", "record_limit", "edge_limit") if x in why]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spines_are_the_first_of_the_shortest_paths(spark, seed):
    names, roads = made(seed)
    s = graph.call_spines(edge_table(spark, roads), names[0], "outgoing", 4, 100, 100)
    best: dict = {}
    for end, ids in simple_paths(roads, names[0], 4):
        best[end] = min(best.get(end, (99, "", [])), (len(ids), json.dumps(ids, separators=(",", ":")), ids))
    # layer by layer, so that a path goes on from its own first part
    assert {p["endpoint"]: len(p["relationship_ids"]) for p in s.paths} == {e: n for e, (n, _, _) in best.items()}
    assert all(p["relationship_ids"] == best[p["endpoint"]][2] for p in s.paths if len(p["relationship_ids"]) < 3)
    assert s.visited_nodes == len(best) + 1 and s.authority == "authoritative"
    ends = {i: (a, b) for i, a, b in roads}
    for p in s.paths:
        assert p["endpoints"] == [names[0], *[ends[i][1] for i in p["relationship_ids"]]]


def test_incoming_spines_are_outgoing_ones_turned_round(spark):
    names, roads = made(4)
    back = graph.call_spines(edge_table(spark, roads), names[1], "incoming", 3, 100, 100)
    ends = {i: (a, b) for i, a, b in roads}
    assert back.paths
    for p in back.paths:
        assert p["endpoints"] == [*[ends[i][0] for i in p["relationship_ids"]], names[1]] and p["endpoints"][0] == p["endpoint"]


FAN = [("road 1", "hub", "east"), ("road 2", "hub", "west"), ("road 3", "west", "far west")]


@pytest.mark.parametrize(("limits", "reason"), [((1, 9, 9), "depth_limit"), ((2, 2, 9), "node_limit"), ((2, 9, 1), "edge_limit")])
def test_spines_say_what_stopped_them(spark, limits, reason):
    assert graph.call_spines(edge_table(spark, FAN), "hub", "outgoing", *limits).reasons == [reason]


@pytest.mark.parametrize(("fresh", "complete"), list(itertools.product([True, False], repeat=2)))
def test_empty_spines_are_proven_only_with_authority(spark, fresh, complete):
    s = graph.call_spines(edge_table(spark, FAN), "nowhere", fresh=fresh, complete=complete)
    assert s.paths == [] and s.empty_proven == (fresh and complete)
    assert s.authority == ("untrusted" if not fresh else "authoritative" if complete else "incomplete")


@pytest.mark.parametrize("seed", [5, 6, 7, 8])
def test_budgeted_impact_against_the_walk_in_words(spark, seed):
    names, roads = made(seed, 10, 22)
    e = edge_table(spark, roads)
    for limits in ((3, 100, 100), (1, 100, 100), (4, 3, 100), (4, 100, 4), (4, 5, 6)):
        w = graph.bounded_impact(e, names[0], "incoming", *limits)
        assert (w.nodes, set(w.edges), w.reasons) == fifo(roads, names[0], *limits)
    whole = fifo(roads, names[0], 99, 999, 999)[0]
    assert {r.node: r.depth for r in graph.impact(e, names[0], "incoming").collect()} == whole


def test_whole_walks_have_no_silent_depth(spark):
    n = 36
    chain = edge_table(spark, [(str(i), f"n{i:02}", f"n{i + 1:02}") for i in range(n)])
    assert graph.impact(chain, "n00", "outgoing").count() == n + 1
    assert graph.canonical_paths(chain, "n00").where("node = 'n36'").first().depth == n
    assert graph.ancestors(chain).count() == n * (n + 1) // 2
    start = spark.createDataFrame([("n00",)], "node string")
    assert files.closure(chain, start, "src", "dst").count() == n + 1


def test_edges_at_one_endpoint(spark):
    e = edge_table(spark, [(f"road {i:02}", f"place {i:02}", "hub") for i in range(10)])
    rows = lambda **o: graph.incident(e, "hub", "incoming", **o).orderBy("relationship_id").collect()
    whole = rows()
    assert [r.other for r in whole] == [f"place {i:02}" for i in range(10)] and not whole[0].incomplete and whole[0].work_items == 10
    few = rows(max_edges=3)
    assert len(few) == 3 and few[0].incomplete and not few[0].work_limit_reached
    tired = rows(work=4)
    assert len(tired) == 4 and tired[0].incomplete and tired[0].work_limit_reached and tired[0].work_items == 4
    left = rows(exclude=["place 00", "place 03"], allow=[f"place {i:02}" for i in range(5)])
    assert [r.other for r in left] == ["place 01", "place 02", "place 04"] and left[0].excluded == 2 and not left[0].incomplete
    one = rows(stop_first=True)
    assert len(one) == 1 and not one[0].incomplete
    assert rows(kinds=["import"]) == []


def test_build_checks_edges_and_derives_authority(spark):
    row = ("a", "b", "call", "compiler", "exact", "resolved", "fresh", [])
    names = "src string, dst string, kind string, provenance string, confidence string, resolution string, state string, causes array<string>"
    built = graph.build(spark.createDataFrame([row, ("a", "c", "call", "syntax", "exact", "resolved", "fresh", [])], names))
    assert [r.compiler_authoritative for r in built.orderBy("dst").collect()] == [True, False]
    assert built.where(graph.exact(calls=True)).count() == 1
    for at, bad in ((2, "calls"), (7, ["source_change"])):
        with pytest.raises(Exception, match="not one of|has causes"):
            graph.build(spark.createDataFrame([(*row[:at], bad, *row[at + 1 :])], names)).collect()


def test_producers_of_edges(spark):
    t = spark.createDataFrame
    decl = t([(1, "x"), (2, "y")], "symbol_id int, dst string")
    assert [(r.src, r.dst) for r in graph.reference_edges(t([(1, "u"), (1, "x"), (1, "u")], "symbol_id int, src string"), decl).collect()] == [("u", "x")]
    assert {(r.kind, r.dst) for r in graph.heritage_edges(t([(1, "u", "extends"), (2, "u", "implements")], "symbol_id int, src string, clause string"), decl).collect()} == {("extends", "x"), ("implements", "y")}
    m = graph.module_edges(t([("a", "b", "f", "import"), ("a", "b", None, "import"), ("a", "b", "gone", "import")], "src_file string, dst_file string, name string, kind string"), t([("b", "f", "b#f")], "file string, name string, dst string"))
    assert {r.dst for r in m.collect()} == {"b#f", f"b\0{graph.MODULE}"}
    with pytest.raises(QueryError, match="INCOMPLETE"):
        graph.assert_closed(edge_table(spark, FAN), t([("hub",)], "node string"))


def test_closure_survives_cycles(spark):
    got = graph.ancestors(edge_table(spark, [("1", "a", "b"), ("2", "b", "c"), ("3", "c", "a")]))
    assert {(r.node, r.ancestor) for r in got.collect()} == {(x, y) for x in "abc" for y in "abc" if x != y}


def test_names_mean_one_declaration_of_their_file(spark):
    t = spark.createDataFrame
    declared = t([("lib", "open", 1), ("lib", "shut", 2), ("other", "open", 3), ("twice", "open", 4), ("twice", "open", 5)], "file string, name string, symbol_id int")
    brought = t([("app", "open", "lib"), ("other", "open", "lib"), ("both", "open", "lib"), ("both", "open", "other")], "file string, name string, target string")
    used = t([("app", "open"), ("app", "shut"), ("other", "open"), ("twice", "open"), ("both", "open"), ("lib", "shut")], "file string, name string")
    got = {(r.file, r.name): r.symbol_id for r in resolution.resolved(used, declared, brought).collect()}
    assert got == {("app", "open"): 1, ("app", "shut"): None, ("other", "open"): 3, ("twice", "open"): None, ("both", "open"): None, ("lib", "shut"): 2}


def test_candidates_are_tests_with_a_proof(spark):
    roads = [("r1", "wheel", "axle"), ("r2", "checks of wheel", "wheel"), ("r3", "checks of axle", "axle"), ("r4", "shed", "axle")]
    where = {"axle": "src/axle.ts", "wheel": "src/wheel.ts", "checks of wheel": "src/wheel.spec.ts", "checks of axle": "tests/axle.ts", "shed": "yard/shed.ts"}
    e = edge_table(spark, roads)
    found = evidence.test_candidates(e, graph.bounded_impact(e, "axle", "incoming", 5), where, ["yard"])
    assert [(c["file"], c["reason"], c["confidence"], c["evidence"]["relationship_ids"]) for c in found] == [
        ("tests/axle.ts", "direct_compiler_reference", "exact", ["r3"]),
        ("yard/shed.ts", "convention_match", "exact", ["r4"]),
        ("src/wheel.spec.ts", "transitive_compiler_reference", "high", ["r2", "r1"]),
    ]
    with pytest.raises(QueryError, match="INCOMPLETE_EVIDENCE"):
        evidence.test_candidates(e, graph.bounded_impact(e, "axle", "incoming", 1), where)


def test_candidates_of_a_walk_past_every_budget(spark):
    """More nodes than a budgeted walk may have; what both forms can answer, they answer alike."""
    roads = [("r1", "wheel", "axle"), ("r2", "checks of wheel", "wheel"), ("r3", "checks of axle", "axle"), ("r4", "shed", "axle"), ("r5", "axle", "wheel")]
    where = {"axle": "src/axle.ts", "wheel": "src/wheel.ts", "checks of wheel": "src/wheel.spec.ts", "checks of axle": "tests/axle.ts", "shed": "yard/shed.ts"}
    few = edge_table(spark, roads)
    want = evidence.test_candidates(few, graph.bounded_impact(few, "axle", "incoming", 5), where, ["yard"])
    files = spark.createDataFrame(list(where.items()), "node string, file string")
    got = evidence.proven_candidates(few, "axle", files, ["yard"]).orderBy("depth", "file").collect()
    assert [(r.file, r.reason, r.confidence, r.depth, r.direct, r.relationship_ids) for r in got] == [(c["file"], c["reason"], c["confidence"], c["evidence"]["depth"], c["evidence"]["direct"], c["evidence"]["relationship_ids"]) for c in want]
    many = few.unionByName(edge_table(spark, [(f"m{i:05}", f"t{i:05}", "axle") for i in range(6000)]))
    own = files.unionByName(spark.range(6000).selectExpr("concat('t', lpad(id, 5, '0')) node", "concat('tests/f', id % 3, '.ts') file"))
    found = {r.file: r.relationship_ids for r in evidence.proven_candidates(many, "axle", own).collect()}
    assert found == {"tests/axle.ts": ["r3"], "src/wheel.spec.ts": ["r2", "r1"]} | {f"tests/f{k}.ts": [f"m{k:05}"] for k in range(3)}


def test_tasks_are_as_many_as_the_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 10)
    e = edge_table(spark, [(f"e{i % 200}", f"n{i % 200}", f"n{i % 200 // 2}") for i in range(400)])
    one = graph.collect(e, e, rows=400)
    assert one.count() == 200 and one.rdd.getNumPartitions() == 40
    assert graph.Layers(e.select("src", "dst").distinct(), "src", "dst").edges.rdd.getNumPartitions() == 20
    assert graph.impact(e, "n0", "incoming").count() == 200


def test_first_neighbours_in_as_many_tasks_as_edges_ask_for(spark, monkeypatch):
    """Small nodes in more tasks; a hub in several, where each keeps its own first ones."""
    monkeypatch.setattr(graph, "ROWS", 100)
    order = [F.col("other"), F.col("relationship_id")]
    small = [(f"n{i % 150:03d}", f"o{i * 7919 % 1000:03d}", f"r{i:04d}") for i in range(900)]
    for rows in (small, small + [("hub", f"o{i * 7919 % 1000:03d}", f"h{i:04d}") for i in range(2000)]):
        near = graph.topk_neighbours(spark.createDataFrame(rows, "node string, other string, relationship_id string"), 3, order)
        assert near.columns == ["node", "other", "relationship_id", "rn"]
        held = {}
        for node, other, edge in sorted(rows):
            held.setdefault(node, []).append((other, edge))
        assert sorted((x.node, x.rn, x.other, x.relationship_id) for x in near.collect()) == [(n, i, *e) for n in sorted(held) for i, e in enumerate(held[n][:3], 1)]
        assert near.rdd.getNumPartitions() == -(-len(rows) // 100)
        assert ("_part" in near._jdf.queryExecution().toString()) == (len(rows) > 900)


def test_walks_leave_laid_out_edges_where_they_are(spark):
    """A layer's nodes come to the edges; the edges are not dealt out again for each layer."""
    e = edge_table(spark, [(f"e{i}", f"n{i % 50}", f"m{i % 90}") for i in range(400)])
    layers = graph.Layers(e.select("src", "dst").distinct(), "src", "dst")
    plan = layers.beside(spark.createDataFrame([("n1",), ("n2",)], "src string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


ODD = ['say "x"', "back\\slash", "tab\there", "a", "a b", "a!", "ab", "é", "call:x->y", "=b", ">a"]


@pytest.mark.parametrize(("direction", "hub"), [("both", 100_000), ("both", 3), ("outgoing", 3), ("incoming", 100_000)])
def test_paths_with_odd_ids_and_several_edges_between_nodes(spark, monkeypatch, direction, hub):
    """Ids of all kinds, made and given, more than one edge between two nodes, loops and lone neighbours: the first path by its JSON, none longer."""
    monkeypatch.setattr(graph, "HUB", hub)
    r = random.Random(11)
    nodes = ["a", "a b", "a!", "ab", "b>c", 'd"', "x", "y", *[f"n{i}" for i in range(8)]]
    rows = {(k := r.choice(["call", "call:x", "extends"]), a := r.choice(nodes), b := r.choice(nodes)): f"{k}:{a}->{b}" for _ in range(30)}
    rows |= {("import", r.choice(nodes), r.choice(nodes)): i for i in ODD}
    rows |= {("call", n, "x"): f"call:{n}->x" for n in ("lone 1", "lone 2")} | {("call", "x", "x"): "call:x->x"}
    table = spark.createDataFrame([(i, *k) for k, i in rows.items()], "relationship_id string, kind string, src string, dst string")
    ways = [(a, b, i) for (_, a, b), i in rows.items() if direction != "incoming"] + [(b, a, i) for (_, a, b), i in rows.items() if direction != "outgoing"]
    as_json = lambda ids: json.dumps(ids, ensure_ascii=False, separators=(",", ":"))
    best, layer = {"x": []}, {"x": []}
    while layer:
        reached = {}
        for a, b, i in ways:
            if a in layer and b not in best:
                reached[b] = min([*layer[a], i], reached.get(b, [*layer[a], i]), key=as_json)
        best, layer = best | reached, reached
    for root, want in (("x", best), ("nowhere", {"nowhere": []})):
        got = graph.canonical_paths(table, root, None, direction).collect()
        assert {(x.node, x.depth, tuple(x.path)) for x in got} == {(n, len(p), tuple(p)) for n, p in want.items() if p} and len(got) == len(want) - 1
    got = graph.canonical_paths(table, "x", 2, direction).collect()
    assert {(x.node, tuple(x.path)) for x in got} == {(n, tuple(p)) for n, p in best.items() if 0 < len(p) < 3}
