"""Relationship graphs: building, bounded walks, canonical paths.

Edges have relationship_id, src, dst (endpoint keys) and kind. Whole-graph answers are layer joins that never leave
the executors. Budgeted answers have at most a thousand nodes and five thousand edges, so that their state lives on
the driver, and only the edges around the current frontier are fetched, no more of each node than the budget can use.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..contracts import CONFIDENCES, DEPTH_DEFAULT, DEPTH_MAX, EDGE_KINDS, EDGES_DEFAULT, EDGES_MAX, NODES_DEFAULT, NODES_MAX, PROVENANCES, RESOLUTIONS, WORK_DEFAULT, QueryError, member, truncation
from ..plans.checkpoints import cut, laid


#: Edges of one node from which they are dealt to several tasks.
HUB = 100_000
#: Rows that one task is to hold.
ROWS = 1 << 20
#: Rows that all tasks may hold beside their own.
FEW = 50_000
#: Groups of nodes by which edges are counted.
BUCKETS = 1 << 16


def tasks(spark: SparkSession, rows: int) -> int:
    """The number of tasks for ``rows`` rows: what the session has, or more where a task would hold more than ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def few(rows: DataFrame) -> DataFrame:
    """Written ``rows``, sent to all tasks by the join they stand in if they are FEW."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def _one_of(c: str, among: Iterable[str]) -> Column:
    allowed = list(among)
    return F.when(F.col(c).isin(allowed), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} is not one of {', '.join(allowed)}: "), F.coalesce(F.col(c), F.lit("null")))))


def build(edges: DataFrame) -> DataFrame:
    """Checked edges with their id and authority.

    Takes src, dst, kind, provenance, confidence, resolution, state, causes; a fresh edge must have no causes.
    """
    out = edges.withColumns({"kind": _one_of("kind", EDGE_KINDS), "provenance": _one_of("provenance", PROVENANCES), "confidence": _one_of("confidence", CONFIDENCES), "resolution": _one_of("resolution", RESOLUTIONS)})
    out = out.withColumn("state", F.when((F.col("state") == "fresh") & (F.size("causes") > 0), F.raise_error(F.lit("a fresh edge has causes"))).otherwise(F.col("state")))
    out = out.withColumn("relationship_id", relationship_id(F.col("kind"), F.col("src"), F.col("dst")))
    return out.withColumn("compiler_authoritative", (F.col("provenance") == "compiler") & (F.col("confidence") == "exact") & (F.col("resolution") == "resolved") & (F.col("state") == "fresh"))


def relationship_id(kind: Column, src: Column, dst: Column) -> Column:
    return F.concat(kind, F.lit(":"), src, F.lit("->"), dst)


def exact(calls: bool = False) -> Column:
    """Edges that evidence may rest on; of calls, only calls."""
    c = F.col("compiler_authoritative") & (F.col("state") == "fresh") & (F.size("causes") == 0)
    return c & (F.col("kind") == "call") if calls else c


def dedup(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """One edge for each relationship_id. With ``rows``, about how many there are, a task holds about ROWS at any size."""
    dealt = edges if rows is None else edges.repartition(tasks(edges.sparkSession, rows), "relationship_id")
    return dealt.dropDuplicates(["relationship_id"])


def collect(*families: DataFrame, rows: int | None = None) -> DataFrame:
    """All families' edges (about ``rows``), each id once."""
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f)
    return dedup(out, rows)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints (node) of edges that no node has."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.join(nodes.select("node"), "node", "left_anti")


def assert_closed(edges: DataFrame, nodes: DataFrame) -> None:
    if bad := [r.node for r in dangling(edges, nodes).limit(20).collect()]:
        raise QueryError("INCOMPLETE_EVIDENCE", "edges end at unknown nodes", bad)


def neighbours(edges: DataFrame, direction: str) -> DataFrame:
    """Rows (relationship_id, kind, node, other): each edge from the end it is entered at."""
    member("direction", direction, ("incoming", "outgoing", "both"))
    out = edges.select("relationship_id", "kind", F.col("src").alias("node"), F.col("dst").alias("other"))
    into = edges.select("relationship_id", "kind", F.col("dst").alias("node"), F.col("src").alias("other"))
    return out if direction == "outgoing" else into if direction == "incoming" else out.unionByName(into.where("node <> other"))


def topk_neighbours(edges: DataFrame, k: int, order: list[Column], key: str = "node", whole: bool = True) -> DataFrame:
    """The first ``k`` edges of each node.

    Nodes are dealt to as many tasks as their edges ask for, hubs to several of which each keeps its own first k. To know
    them, edges are counted by BUCKETS of nodes. Not ``whole``, for edges around few nodes, they are not counted; then each
    task keeps its own first k before anything is shuffled.
    """
    first = lambda df, *by: df.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= k)
    if not whole:
        return first(edges, key)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    per = edges.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    # the number of edges, and the buckets that one task should not hold, at most one for each ROWS edges
    all_, full = per.agg(F.sum("_n"), F.collect_list(F.when(F.col("_n") > ROWS, F.struct("_bucket", F.ceil(F.col("_n") / ROWS).cast("int").alias("_parts"))))).first()
    n = tasks(edges.sparkSession, all_ or 0)
    if full:
        parts = edges.sparkSession.createDataFrame([tuple(f) for f in full], "_bucket long, _parts int")
        dealt = edges.withColumn("_bucket", bucket).join(F.broadcast(parts), "_bucket", "left")
        dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(*edges.columns), F.coalesce("_parts", F.lit(1))).cast("int"))
        edges = first(dealt.repartition(n, key, "_part"), key, "_part").select(*edges.columns)
    return first(edges.repartition(n, key), key)


class Layers:
    """Edges (``key``, ``other``, ...) written once, by the end that every layer joins on; hubs are dealt to several tasks by ``other``.

    Edges are dealt to as many tasks as their number asks for. There a node's edges, or those of a hub's part, are one row, which a
    layer that does not ask for them passes over. No layer reads the sources again or moves the edges; a layer's nodes meet a
    hub's edges in all its parts. With ``root``, edges stand there from both their ends, and of a walk from the root those
    of nodes with one neighbour are left out: the walk has come from that one.
    """

    def __init__(self, edges: DataFrame, key: str, other: str, root: str | None = None):
        self.key = key
        # the number of edges, and the groups of nodes that hold a hub, at most one for each HUB edges
        per = edges.groupBy(self._bucket().alias("_bucket")).agg(F.count("*").alias("_n"))
        all_, full = per.agg(F.sum("_n"), F.collect_list(F.when(F.col("_n") > HUB, F.struct("_bucket", "_n")))).first()
        hubs = [(b, -(-n // HUB)) for b, n in full if n > 2 * all_ // BUCKETS]
        self.none = not hubs
        n = tasks(edges.sparkSession, all_ or 0)
        by, rest = [key], F.struct(*[c for c in edges.columns if c != key])
        if not self.none:
            self.hubs = edges.sparkSession.createDataFrame(hubs, "_bucket long, _parts int")
            # parts of hubs from 1, other nodes are part 0
            by = [key, "_part"]
            edges = self._dealt(edges).withColumn("_part", F.coalesce(F.pmod(F.xxhash64(other), F.col("_parts")).cast("int") + 1, F.lit(0)))
        rows = edges.repartition(n, *by).groupBy(*by).agg(F.collect_list(rest).alias("_ends"))
        if root is not None:
            several = (F.size(F.array_distinct(F.col("_ends")[other])) > 1) | (F.col(key) == root)
            rows = rows.where(several if self.none else (F.col("_part") > 0) | several)
        self.edges = laid(rows)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(BUCKETS))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the number of parts of hubs."""
        return rows.withColumn("_bucket", self._bucket()).join(F.broadcast(self.hubs), "_bucket", "left").drop("_bucket")

    def beside(self, layer: DataFrame) -> DataFrame:
        """The edges of a layer's nodes (column named as the key), with the layer's columns."""
        # a layer's nodes are looked up: the edges are not sorted again for each layer
        if self.none:
            met = self.edges.join(layer.hint("shuffle_hash"), self.key)
        else:
            parts = F.sequence(F.when(F.col("_parts").isNull(), 0).otherwise(1), F.coalesce("_parts", F.lit(0)))
            spread = self._dealt(layer).withColumn("_part", F.explode(parts)).drop("_parts")
            met = self.edges.join(spread.hint("shuffle_hash"), [self.key, "_part"]).drop("_part")
        return met.select(*[c for c in met.columns if c != "_ends"], F.inline("_ends"))


def reach(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Rows (node, depth): everything that edges (src, dst) lead to within ``max_depth`` steps (None: any number), with the least depth."""
    layers = Layers(edges.select("src", "dst").distinct(), "src", "dst")
    found = frontier = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        # different nodes before they are shuffled
        step = layers.beside(frontier.select(F.col("node").alias("src"))).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if depth % 5 == 0:
            found = cut(found)
    return found


def impact(edges: DataFrame, root: str, direction: str = "incoming", max_depth: int | None = None) -> DataFrame:
    """Rows (node, depth, direct): the whole impact of ``root``, or what lies within ``max_depth`` of it."""
    n = neighbours(edges, direction).select(F.col("node").alias("src"), F.col("other").alias("dst"))
    start = edges.sparkSession.createDataFrame([(root,)], "node string")
    return reach(n, start, max_depth).withColumn("direct", F.col("depth") == 1)


def incident(edges: DataFrame, endpoint: str, direction: str, kinds: list[str] | None = None, max_edges: int = EDGES_DEFAULT, work: int = WORK_DEFAULT, allow: list[str] | None = None, exclude: list[str] = (), stop_first: bool = False) -> DataFrame:
    """The first edges at one endpoint in order of the other end and the id: relationship_id, kind, other, and in each row
    work_items (edges looked at), work_limit_reached, excluded (left out by ``exclude``) and incomplete.

    No more than ``work`` edges are looked at; ``allow`` names the only other ends that count; ``stop_first`` ends at the
    first edge. What max_edges or the work budget keeps out makes the answer incomplete.
    """
    near = neighbours(edges.where(F.col("kind").isin(kinds)) if kinds else edges, direction).where(F.col("node") == endpoint)
    seen = near.orderBy("other", "relationship_id").limit(work + 1)
    seen = cut(seen.withColumn("place", F.row_number().over(W.orderBy("other", "relationship_id"))))  # at most work + 1 rows
    looked = seen.where(F.col("place") <= work)
    out = F.col("other").isin(list(exclude)) if exclude else F.lit(False)
    fits = ~out & (F.col("other").isin(list(allow)) if allow is not None else F.lit(True))
    most = 1 if stop_first else max_edges
    counts = looked.agg(F.count("*").alias("work_items"), F.count_if(out).alias("excluded"), F.count_if(fits).alias("fitting"))
    limit = seen.agg((F.count("*") > work).alias("work_limit_reached"))
    found = looked.where(fits).orderBy("place").limit(most).select("relationship_id", "kind", "other")
    flags = counts.join(F.broadcast(limit))  # one row each
    short = F.lit(False) if stop_first else F.col("fitting") > most
    return found.join(F.broadcast(flags)).select("relationship_id", "kind", "other", "work_items", "work_limit_reached", "excluded", (F.col("work_limit_reached") | short).alias("incomplete"))


def call_edges(sites: DataFrame, site: list[str], target: str, most: int = EDGES_MAX, work: int = WORK_DEFAULT) -> DataFrame:
    """Rows (src, target, incomplete): one edge for each site with exactly one target, the first ``most`` in order of site, from
    no more than the first ``work`` sites. A budget that keeps something out marks every row."""
    looked = sites.select(*site, target).distinct().orderBy(*site, target).limit(work + 1)
    looked = cut(looked.withColumn("place", F.row_number().over(W.orderBy(*site, target))))  # at most work + 1 rows
    found = cut(unique_targets(looked.where(F.col("place") <= work), site, target))
    flags = looked.agg((F.count("*") > work).alias("over")).join(F.broadcast(found.agg((F.count("*") > most).alias("more"))))
    return found.orderBy(*site).limit(most).join(F.broadcast(flags)).select(*site, "target", (F.col("over") | F.col("more")).alias("incomplete"))


@dataclass
class Impact:
    """A budgeted walk's nodes (key: depth), selected edges, and why it stopped short, if it did."""

    root: str
    nodes: dict[str, int]
    edges: dict[str, tuple]
    reasons: list[str] = field(default_factory=list)

    @property
    def incomplete(self) -> bool:
        return bool(self.reasons)

    @property
    def truncation(self) -> dict:
        return truncation(self.reasons)

    def ordered_nodes(self) -> list[tuple[str, int, bool]]:
        return [(n, d, d == 1) for n, d in sorted(self.nodes.items(), key=lambda x: (x[1], x[0]))]


class _Around:
    """Fetches edges around nodes, in neighbour order, no more of each node than asked for."""

    def __init__(self, edges: DataFrame, direction: str, kinds: list[str] | None):
        self.all = neighbours(edges.where(F.col("kind").isin(kinds)) if kinds else edges, direction)

    def first(self, nodes: list[str], most: int) -> dict[str, list[tuple[str, str, str]]]:
        near = topk_neighbours(self.all.where(F.col("node").isin(nodes)), most, [F.col("other"), F.col("relationship_id")], whole=False)
        out: dict[str, list] = {n: [] for n in nodes}
        for r in near.orderBy("node", "rn").collect():
            out[r.node].append((r.relationship_id, r.other, r.kind))
        return out

    def among(self, node: str, known: Iterable[str]) -> list[tuple[str, str, str]]:
        rows = self.all.where((F.col("node") == node) & F.col("other").isin(list(known))).orderBy("other", "relationship_id")
        return [(r.relationship_id, r.other, r.kind) for r in rows.limit(2 * EDGES_MAX + 1).collect()]


def bounded_impact(edges: DataFrame, root: str, direction: str = "incoming", max_depth: int = DEPTH_DEFAULT, max_nodes: int = NODES_DEFAULT, max_edges: int = EDGES_DEFAULT, kinds: list[str] | None = None) -> Impact:
    """The impact of ``root`` under budgets: nodes enter in first-in first-out order, a node's edges in neighbour order.

    Edges between nodes that are already in are still selected when no node may enter any more. Reaching a budget
    exactly is no truncation; only something that it kept out is.
    """
    for name, value, low, high in (("max_depth", max_depth, 0, DEPTH_MAX), ("max_nodes", max_nodes, 1, NODES_MAX), ("max_edges", max_edges, 1, EDGES_MAX)):
        if not low <= value <= high:
            raise QueryError("INVALID_INPUT", f"{name} must lie from {low} to {high}")
    around = _Around(edges, direction, kinds)
    most = 2 * max_edges + 2
    result = Impact(root, {root: 0}, {})
    why: set[str] = set()
    layer = [root]
    while layer:
        near = around.first(layer, most)
        entered: list[str] = []
        for node in layer:
            depth, listed = result.nodes[node], near[node]
            if len(listed) == most:  # there may be more: those to known nodes count even far down the list
                seen = {e[0] for e in listed}
                listed = listed + [e for e in around.among(node, result.nodes) if e[0] not in seen]
            for edge, other, kind in listed:
                if edge in result.edges:
                    continue
                new = other not in result.nodes
                if new and depth + 1 > max_depth:
                    why.add("depth_limit")
                elif new and len(result.nodes) >= max_nodes:
                    why.add("record_limit")
                elif len(result.edges) >= max_edges:
                    why.add("edge_limit")
                else:
                    result.edges[edge] = (node, other, kind)
                    if new:
                        result.nodes[other] = depth + 1
                        entered.append(other)
        layer = entered
    result.reasons = [r for r in ("depth_limit", "record_limit", "edge_limit") if r in why]
    return result


def _told(edges: DataFrame, direction: str) -> DataFrame:
    """neighbours() with ``told`` for the id and kind: an id made by relationship_id() is told by its kind and way alone."""
    own = F.col("relationship_id")
    told = lambda way: F.when(own == relationship_id(F.col("kind"), F.col("src"), F.col("dst")), F.concat(F.lit(way), "kind")).otherwise(F.concat(F.lit("="), own)).alias("told")
    out = F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), told(">"))
    into = F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), told("<"))
    # both ends of an edge at once: edges are not made twice
    ends = {"outgoing": F.array(out), "incoming": F.array(into), "both": F.when(F.col("src") != F.col("dst"), F.array(out, into)).otherwise(F.array(out))}
    return edges.select(F.inline(ends[member("direction", direction, tuple(ends))]))


def _id() -> Column:
    """The id that _told() told."""
    rest = F.substr("told", F.lit(2))
    made = F.when(F.startswith("told", F.lit(">")), relationship_id(rest, F.col("node"), F.col("other"))).when(F.startswith("told", F.lit("<")), relationship_id(rest, F.col("other"), F.col("node")))
    return made.otherwise(rest)


def canonical_paths(edges: DataFrame, root: str, max_depth: int | None = None, direction: str = "outgoing") -> DataFrame:
    """Rows (node, depth, path): a shortest path to every node (within ``max_depth``); of several, that whose ids come first as JSON.

    Of two paths of one length, that comes first whose part before the last id does, or of equal parts, that whose last id
    does (an id stands for one edge). A layer's nodes are therefore numbered in the order of their paths (place), and what is
    shuffled for each edge is a number and an id. Paths are joined from the layer before, and written if a layer follows.
    """
    spark = edges.sparkSession
    layers = Layers(_told(edges, direction), "node", "other", root if direction == "both" else None)
    one = spark.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"), F.array().cast("array<string>").alias("path"))
    frontier, paths, above = one.select("node", "place"), one, None
    known, found = [frontier.select("node")], []
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = layers.beside(frontier).select(F.col("other").alias("node"), "place", F.to_json(F.array(_id())).alias("id"))
        # each task keeps one edge of a node before edges are shuffled
        best = step.groupBy("node").agg(F.min(F.struct("place", "id")).alias("_first")).select("node", F.col("_first.place").alias("above"), F.col("_first.id").alias("id"))
        # rows of later tasks have higher numbers
        layer = cut(best.join(reduce(DataFrame.unionByName, known), "node", "left_anti").orderBy("above", "id").withColumn("place", F.monotonically_increasing_id()))
        if layer.isEmpty():
            break
        if above is not None:
            paths = cut(above)
            found.append(paths)
        before = paths.select(F.col("place").alias("above"), F.col("path").alias("_path"))
        above = layer.join(before, "above").select("node", F.lit(depth).alias("depth"), "place", F.concat("_path", F.from_json("id", "array<string>")).alias("path"))
        frontier = layer.select("node", "place")
        # taken either way, edges lead no more than one layer back
        known = [*known, frontier.select("node")][-2 if direction == "both" else 0 :]
    out = paths.limit(0) if above is None else above
    for some in found:
        out = out.unionByName(some)
    return out.select("node", "depth", "path")


def shortest_paths(edges: DataFrame, root: str, max_depth: int | None = None) -> DataFrame:
    """Proof paths: like canonical_paths, with edges taken either way, each read from the node to the root."""
    return canonical_paths(edges, root, max_depth, "both").select("node", "depth", F.reverse("path").alias("path"))


@dataclass
class Spines:
    """Canonical shortest call paths under budgets."""

    paths: list[dict]
    visited_nodes: int
    visited_edges: int
    reasons: list[str]
    authority: str

    @property
    def incomplete(self) -> bool:
        return bool(self.reasons)

    @property
    def empty_proven(self) -> bool:
        return not self.paths and not self.reasons and self.authority == "authoritative"


def call_spines(edges: DataFrame, root: str, direction: str = "outgoing", max_depth: int = 3, max_nodes: int = 100, max_edges: int = 200, fresh: bool = True, complete: bool = True) -> Spines:
    """Layer by layer, one shortest path for each endpoint, ties to the ids that come first as JSON.

    Every edge that is looked at counts, those to known endpoints too. Paths of incoming walks run from the caller to the root.
    """
    import json

    around = _Around(edges, direction, None)
    trusted = fresh and ("compiler_authoritative" not in edges.columns or edges.where(~exact(calls=True)).isEmpty())
    records: dict[str, list[str]] = {root: []}
    routes: dict[str, list[str]] = {root: [root]}
    seen: set[str] = set()
    reasons: set[str] = set()
    layer, depth = [root], 0
    while layer and "edge_limit" not in reasons:
        near = around.first(sorted(layer), max_edges + 1)
        found: dict[str, tuple[str, list[str], list[str]]] = {}
        for node in sorted(layer):
            for edge, other, _ in sorted(near[node]):
                if edge not in seen:
                    if len(seen) >= max_edges:
                        reasons.add("edge_limit")
                        break
                    seen.add(edge)
                if other in routes[node] or other in records:
                    continue
                if depth >= max_depth:
                    reasons.add("depth_limit")
                    continue
                ids = records[node] + [edge] if direction == "outgoing" else [edge] + records[node]
                key = json.dumps(ids, ensure_ascii=False, separators=(",", ":"))
                if other not in found or key < found[other][0]:
                    found[other] = (key, ids, [*routes[node], other])
            if "edge_limit" in reasons:
                break
        layer = []
        for other in sorted(found):
            if len(records) >= max_nodes:
                reasons.add("node_limit")
                break
            records[other], routes[other] = found[other][1], found[other][2]
            layer.append(other)
        depth += 1
    paths = [{"endpoint": n, "endpoints": routes[n] if direction == "outgoing" else routes[n][::-1], "relationship_ids": ids} for n, ids in sorted(records.items()) if n != root]
    authority = "untrusted" if not trusted else "incomplete" if not complete else "authoritative"
    return Spines(paths, len(records), len(seen), [r for r in ("depth_limit", "node_limit", "edge_limit") if r in reasons], authority)


def unique_targets(sites: DataFrame, site: list[str], target: str) -> DataFrame:
    """Call sites that lead to exactly one target, with it; the others give no edge."""
    out = sites.groupBy(*site).agg(F.min(target).alias("target"), F.max(target).alias("_most"))
    return out.where(F.col("target") == F.col("_most")).drop("_most")


def reference_edges(occurrences: DataFrame, declarations: DataFrame) -> DataFrame:
    """Edges from the symbol around an occurrence (src, symbol_id) to its declaration (symbol_id, dst), none to itself."""
    out = occurrences.join(declarations, "symbol_id").where("src <> dst").select(F.lit("reference").alias("kind"), "src", "dst")
    return out.withColumn("relationship_id", relationship_id(F.col("kind"), F.col("src"), F.col("dst"))).dropDuplicates(["relationship_id"])


def heritage_edges(clauses: DataFrame, declarations: DataFrame) -> DataFrame:
    """Edges for clauses (src, symbol_id, clause: extends or implements)."""
    out = clauses.join(declarations, "symbol_id").select(_one_of("clause", ("extends", "implements")).alias("kind"), "src", "dst")
    return out.withColumn("relationship_id", relationship_id(F.col("kind"), F.col("src"), F.col("dst"))).dropDuplicates(["relationship_id"])


MODULE = "<module>@1"


def module_edges(specifiers: DataFrame, declarations: DataFrame) -> DataFrame:
    """Edges for import and export specifiers (src_file, dst_file, name or null, kind): to the declaration, or to the module where nothing is named."""
    d = declarations.select(F.col("file").alias("dst_file"), "name", "dst")
    out = specifiers.join(d, ["dst_file", "name"], "left")
    dst = F.coalesce("dst", F.when(F.col("name").isNull(), F.concat(F.col("dst_file"), F.lit(f"\0{MODULE}"))))
    out = out.select("kind", F.concat(F.col("src_file"), F.lit(f"\0{MODULE}")).alias("src"), dst.alias("dst")).where("dst is not null")
    return out.withColumn("relationship_id", relationship_id(F.col("kind"), F.col("src"), F.col("dst"))).dropDuplicates(["relationship_id"])


def ancestors(bases: DataFrame) -> DataFrame:
    """Rows (node, ancestor) for containers (src) and their bases (dst), direct and indirect; cycles end the search."""
    step = bases.select(F.col("src").alias("node"), F.col("dst").alias("ancestor")).where("node <> ancestor").distinct()
    direct = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    found = frontier = cut(step)
    while True:
        # pairs of many nodes end at few: the steps on are looked up, not dealt out by the end
        ends = cut(frontier.select("ancestor").distinct())
        on = few(cut(direct.join(few(ends), "ancestor", "left_semi")))
        more = frontier.join(on, "ancestor").select("node", F.col("next").alias("ancestor")).where("node <> ancestor").distinct()
        frontier = cut(more.join(found, ["node", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def override_edges(members: DataFrame, bases: DataFrame) -> DataFrame:
    """Both directions between members (container, name, symbol) of the same name in related containers."""
    a = members.select(F.col("container").alias("node"), "name", F.col("symbol").alias("src"))
    b = members.select(F.col("container").alias("ancestor"), "name", F.col("symbol").alias("dst"))
    one = a.join(ancestors(bases), "node").join(b, ["ancestor", "name"]).select("src", "dst")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
