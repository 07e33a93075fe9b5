"""Evidence around symbols: containing spans, references, candidates, omissions, and presentation under a byte budget."""

from __future__ import annotations

import json
from collections import Counter
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..contracts import CONTEXT_CHARS, TEST_PATTERNS, TEST_SEGMENTS, QueryError
from ..functions.scalar import has_segments, matches_glob
from .graph import Impact, impact, shortest_paths
from .ranges import running


def containing(points: DataFrame, spans: DataFrame, by: list[str], point: list[str], start: str, end: str, at: str, order: list[str]) -> DataFrame:
    """For each point (columns ``by`` and ``point``, ``at`` inside a span of the same ``by``): the smallest span around it.

    Places are whole numbers. A span of a length with k binary digits lies in one or two stretches of 2**k places, and a
    point looks into its own stretch for each k that occurs, so that points and spans meet near each other alone, and a
    key with very many of both is many keys. The best span is kept as an aggregate; a point's spans are never listed.
    """
    place = lambda c: F.col(c).cast("long")
    there = spans.where(F.col(end) >= F.col(start)).withColumn("_k", F.length(F.bin(place(end) - place(start))))
    stretch = lambda c: F.call_function("shiftright", place(c), F.col("_k"))
    there = there.withColumn("_stretch", F.explode(F.array_distinct(F.array(stretch(start), stretch(end)))))
    sizes = sorted(r[0] for r in there.select("_k").distinct().collect())  # at most 64
    asked = points.withColumn("_k", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).withColumn("_stretch", stretch(at))
    near = asked.join(there, [*by, "_k", "_stretch"]).where((F.col(start) <= F.col(at)) & (F.col(end) >= F.col(at)))
    best = F.min(F.struct((F.col(end) - F.col(start)).alias("size"), *[F.col(c) for c in order]))
    return near.groupBy(*dict.fromkeys([*by, *point])).agg(best.alias("span"))


def references(occurrences: DataFrame, declaration: Column, include_declaration: bool = True) -> DataFrame:
    """Occurrences with context cut to its limit, ordered by location as text; the declaration itself on demand."""
    out = occurrences.withColumn("is_declaration", declaration).withColumn("context", F.substring(F.trim("context"), 1, CONTEXT_CHARS))
    out = out if include_declaration else out.where(~F.col("is_declaration"))
    key = F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string"), F.col("is_declaration").cast("string"))
    return out.orderBy(F.collate(key, "UNICODE"))


def affected(rows: DataFrame, key: str, file: str) -> DataFrame:
    """Each key's different files, sorted and joined, and their number."""
    once = rows.select(key, file).distinct()
    return once.groupBy(key).agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_list(F.col(file))), ",").alias("files"))


def is_test(path: Column, custom: list[str] = ()) -> Column:
    """Whether a path is that of a test, by pattern or directory; the defaults always apply."""
    out = F.lit(False)
    for c in [*TEST_PATTERNS, *custom]:
        if any(x in c for x in "*?"):
            out = out | matches_glob(path, c)
    for c in [*TEST_SEGMENTS, *[x for x in custom if not any(y in x for y in "*?")]]:
        out = out | has_segments(path, c)
    return out


def candidate_files(nodes: DataFrame, root_file: str, test: Column) -> DataFrame:
    """Test files among nodes (node, file, depth): least depth and endpoints of each, but not the root's own file."""
    out = nodes.where((F.col("file") != root_file) & test)
    return out.groupBy("file").agg(F.min("depth").cast("int").alias("depth"), F.array_sort(F.collect_set("node")).alias("endpoints"))


def test_candidates(edges: DataFrame, walk: Impact, files: dict[str, str], custom: list[str] = ()) -> list[dict]:
    """Tests that may be affected, each with a proof path to the root; refuses on any gap in the evidence."""
    if walk.incomplete:
        raise QueryError("INCOMPLETE_EVIDENCE", "the walk was cut short", walk.reasons)
    spark = edges.sparkSession
    nodes = spark.createDataFrame([(n, files[n], d) for n, d in walk.nodes.items()], "node string, file string, depth int")
    found = candidate_files(nodes, files[walk.root], is_test(F.col("file"), custom)).collect()
    own = edges.where(F.col("relationship_id").isin(list(walk.edges)))
    proofs = {r.node: (r.depth, r.path) for r in shortest_paths(own, walk.root).collect()} if found else {}
    only_custom = {r.file for r in nodes.where(~is_test(F.col("file"))).select("file").distinct().collect()}
    out = []
    for r in found:
        paths = sorted((proofs[n][0], n, proofs[n][1]) for n in r.endpoints if n in proofs)
        if not paths:
            raise QueryError("INCOMPLETE_EVIDENCE", f"no path from {r.file} to the root")
        direct = r.depth == 1
        reason = "convention_match" if r.file in only_custom else "direct_compiler_reference" if direct else "transitive_compiler_reference"
        out.append({"file": r.file, "reason": reason, "confidence": "exact" if direct else "high", "evidence": {"depth": r.depth, "direct": direct, "relationship_ids": paths[0][2]}})
    return sorted(out, key=lambda x: (x["evidence"]["depth"], x["file"]))


def proven_candidates(edges: DataFrame, root: str, files: DataFrame, custom: list[str] = ()) -> DataFrame:
    """Rows (file, reason, confidence, depth, direct, relationship_ids): all tests that a change of ``root`` may affect.

    What test_candidates() gives for a walk without budgets, which no walk's size can make incomplete; nothing but the rows
    that are asked for leaves the executors. ``files`` (node, file) names files; a node that it does not name is no candidate.
    """
    nodes = impact(edges, root).join(files.select("node", "file"), "node")
    home = files.where(F.col("node") == root).select(F.col("file").alias("_home")).limit(1)
    test = nodes.where(is_test(F.col("file"), custom)).join(F.broadcast(home), F.col("file") == F.col("_home"), "left_anti")
    inside = edges.join(impact(edges, root).select(F.col("node").alias("dst")), "dst", "left_semi")
    proofs = shortest_paths(inside, root).select("node", F.col("depth").alias("_steps"), "path")
    # the first path by length and node; edges among what was reached lead to every candidate
    best = test.join(proofs, "node").groupBy("file").agg(F.min("depth").alias("depth"), F.min(F.struct("_steps", "node", "path"))["path"].alias("relationship_ids"))
    direct = F.col("depth") == 1
    reason = F.when(~is_test(F.col("file")), "convention_match").when(direct, "direct_compiler_reference").otherwise("transitive_compiler_reference")
    return best.select("file", reason.alias("reason"), F.when(direct, "exact").otherwise("high").alias("confidence"), F.col("depth").cast("int").alias("depth"), direct.alias("direct"), "relationship_ids")


def omission_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group and their total over all groups."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").cast("long").alias("total"))
    return counts.join(F.broadcast(total))  # one row


def omissions(rows: DataFrame, by: list[str], order: list[str], details: int) -> DataFrame:
    """The first ``details`` omitted rows of each group in order, with the group's number, the total and whether more follow."""
    first = rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= details)
    return first.join(omission_counts(rows, by), by).withColumn("has_more", F.col("n") > details)


def byte_prefix(rows: DataFrame, order: list[str], size: Column, budget: int) -> DataFrame:
    """The longest prefix in ``order`` (a key) whose sizes add up to no more than ``budget``, with the running sum.

    Keys and sizes alone are sorted, in ranges; only those before the range in which the budget ends, and that one, are
    looked at. The rows of the prefix are then fetched by their keys.
    """
    sized = rows.select(*order, F.coalesce(size, F.lit(0)).alias("_size"))
    prefix = running(sized, [F.col(c) for c in order], F.col("_size"), "running", budget).drop("_size")
    same = reduce(and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in order])
    return rows.alias("r").join(prefix.alias("p"), same).select("r.*", "p.running")


def _size(x: object) -> int:
    return len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode())


def _closed(result: dict) -> dict:
    """``result`` with used_bytes equal to the length of the JSON that holds it."""
    used = 0
    for _ in range(10):
        result["budget"]["used_bytes"] = used
        if (size := _size(result)) == used:
            return result
        used = size
    raise QueryError("INTERNAL_ERROR", "the size does not settle")


def present(clusters: list[dict], total: int, max_bytes: int, offset: int = 0, call_spines: list | None = None) -> dict:
    """A page of clusters {symbol, evidence?} whose JSON has at most ``max_bytes`` bytes.

    A cluster that does not fit is reduced to file, selector and kind, and what it lost is listed as omitted; if that
    does not fit either, the page ends before it. The first cluster must fit. Call spines go in whole or not at all,
    and details of omissions are dropped one by one before anything else is.
    """

    def result(symbols, evidence, omitted, details, spines, cut):
        end = offset + len(symbols)
        more = end < total
        counts = [{"category": c, "component": k, "n": n} for (c, k), n in sorted(Counter((o["category"], o["component"]) for o in omitted).items())]
        reason = "byte_limit" if cut else "record_limit" if more else None
        out = {
            "symbols": symbols,
            "evidence": evidence,
            "page": {"offset": offset, "total": total, "has_more": more, "next_offset": end if more else None},
            "omissions": {"counts": counts, "details": omitted[:details], "total": len(omitted), "has_more": details < len(omitted)},
            "budget": {"max_bytes": max_bytes, "used_bytes": 0},
            "truncation": {"truncated": reason is not None, "reason": reason},
        }
        return _closed(out | ({"call_spines": call_spines} if spines else {}))

    def fitting(symbols, evidence, omitted, cut):
        for spines in [True, False] if call_spines else [False]:
            for details in range(len(omitted), -1, -1):
                out = result(symbols, evidence, omitted, details, spines, cut)
                if out["budget"]["used_bytes"] <= max_bytes:
                    return out
        return None

    symbols, evidence, omitted, best, cut = [], [], [], None, False
    for c in clusters:
        own = [{"selector": c["symbol"]["selector"], **c["evidence"]}] if c.get("evidence") else []
        if (out := fitting([*symbols, c["symbol"]], [*evidence, *own], omitted, cut)) is not None:
            symbols, evidence, best = [*symbols, c["symbol"]], [*evidence, *own], out
            continue
        small = {k: c["symbol"][k] for k in ("file", "selector", "kind") if k in c["symbol"]}
        lost = [k for k in ("signature",) if c["symbol"].get(k)] + [k for k in ("source", "references") if (c.get("evidence") or {}).get(k)]
        more = omitted + [{"subject": small["selector"], "category": "budget", "component": k, "reason": "byte_limit"} for k in lost]
        if (out := fitting([*symbols, small], evidence, more, True)) is not None:
            symbols, omitted, best, cut = [*symbols, small], more, out, True
            continue
        if not symbols:
            raise QueryError("INVALID_INPUT", "the first cluster does not fit")
        cut = True
        best = fitting(symbols, evidence, omitted, True) or best
        break
    return best if best is not None else result([], [], [], 0, False, False)
