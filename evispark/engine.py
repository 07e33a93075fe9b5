"""Projects and their tools: one object for each collection of files, with bounded reads and reviewed writes.

Tools return plain values (a page of rows, a record), within the limits of ``contracts``; the tables behind them are at
hand as DataFrames. Sessions are kept in order of use, and one operation runs on a project at a time.
"""

from __future__ import annotations

import re
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import CONTEXT_CHARS, PAGE_DEFAULT, PAGE_MAX, SEARCH_DEFAULT, QueryError, member, page_bounds, relative_path
from .functions.toon import encode_checked
from .operators import delta, evidence, files, graph, resolution, search
from .plans.checkpoints import cut
from .plans.operations import Files, Operations
from .sources import extract
from .sources.store import SymbolStore
from .streaming.freshness import Status, step

# Sessions, waiting operations, seconds to wait and to run, and the most that a counter shows.
SESSIONS, QUEUE, WAIT_SECONDS, RUN_SECONDS, COUNT_MAX = 8, 32, 30.0, 120.0, 1_000_000


class Scheduler:
    """First in, first out, one at a time; refuses what would wait behind too many or for too long."""

    def __init__(self, capacity: int = QUEUE, wait: float = WAIT_SECONDS, deadline: float = RUN_SECONDS):
        self.capacity, self.wait, self.deadline = capacity, wait, deadline
        self.turn = threading.Condition()
        self.waiting: list[object] = []
        self.running = self.closed = False
        self.counts = dict.fromkeys(("admitted", "completed", "failed", "rejected", "timed_out", "cancelled"), 0)

    def _count(self, what: str) -> None:
        self.counts[what] = min(self.counts[what] + 1, COUNT_MAX)

    def run(self, work: Callable[[], Any], spark: SparkSession | None = None) -> Any:
        ticket = object()
        with self.turn:
            if self.closed:
                raise QueryError("SERVER_SHUTTING_DOWN", "no further operation is admitted")
            if len(self.waiting) >= self.capacity:
                self._count("rejected")
                raise QueryError("PROJECT_QUEUE_FULL", f"{self.capacity} operations wait already")
            self.waiting.append(ticket)
            ready = self.turn.wait_for(lambda: not self.running and self.waiting[0] is ticket, self.wait)
            self.waiting.remove(ticket)
            if not ready:
                self._count("timed_out")
                self.turn.notify_all()
                raise QueryError("QUEUE_WAIT_TIMEOUT", "the operation waited too long")
            self.running = True
            self._count("admitted")
        tag = f"evispark-{id(ticket)}"
        watch = None
        if spark is not None:
            spark.addTag(tag)
            watch = threading.Timer(self.deadline, spark.sparkContext.cancelJobsWithTag, [tag])
            watch.start()
        began = time.monotonic()
        try:
            out = work()
            self._count("completed")
            return out
        except Exception as e:
            late = time.monotonic() - began >= self.deadline
            self._count("cancelled" if late else "failed")
            if late:
                raise QueryError("OPERATION_DEADLINE_EXCEEDED", "the operation ran too long") from e
            raise
        finally:
            if watch is not None:
                watch.cancel()
                spark.removeTag(tag)
            with self.turn:
                self.running = False
                self.turn.notify_all()

    def shutdown(self) -> None:
        """Admits nothing further and waits for what runs."""
        with self.turn:
            self.closed = True
            self.turn.wait_for(lambda: not self.running, self.deadline)


class Sessions:
    """Projects by key, least recently used first; a busy one is never dropped."""

    def __init__(self, most: int = SESSIONS):
        self.most, self.open = most, OrderedDict()

    def get(self, key: str, make: Callable[[], Project]) -> Project:
        if key not in self.open:
            while len(self.open) >= self.most:
                idle = next((k for k, p in self.open.items() if not p.scheduler.running and not p.scheduler.waiting), None)
                if idle is None:
                    raise QueryError("PROJECT_CAPACITY_EXCEEDED", "all sessions are busy")
                del self.open[idle]
            self.open[key] = make()
        self.open.move_to_end(key)
        return self.open[key]


@dataclass
class Project:
    """Files (path, text), and the edges that some producer has projected, if there are any."""

    spark: SparkSession
    files: DataFrame
    edges: DataFrame | None = None
    diagnostics: DataFrame | None = None
    status: Status = field(default_factory=lambda: step(Status(), "sync_succeeded", evidence=True))
    sources: Files | None = None
    scheduler: Scheduler = field(default_factory=Scheduler)
    #: an index that outlives the project, and the name and configuration it is kept under
    store: SymbolStore | None = None
    name: str = "project"
    config_digest: str = ""

    def __post_init__(self) -> None:
        self.operations = Operations(self.sources) if self.sources is not None else None
        self._symbols: DataFrame | None = None

    @property
    def symbols(self) -> DataFrame:
        """The project's declarations: extracted once, or read from the store once it is up to date."""
        if self._symbols is None:
            if self.store is None:
                self._symbols = cut(extract.symbols(self.files).withColumnRenamed("path", "file_path"))
            else:
                self.refresh()
                self._symbols = self.store.symbols(self.name)
        return self._symbols

    def refresh(self, files_now: DataFrame | None = None) -> dict[str, int]:
        """Brings the index up to date with the files (or with ``files_now``): only new and changed ones are extracted."""
        if files_now is not None:
            self.files = files_now
        self._symbols = None
        if self.store is None:
            return {}
        now = self.files.select(F.col("path").alias("file_path"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
        plan = cut(files.refresh_plan(now, self.store.load(self.name), self.config_digest))
        wanted = self.files.join(plan.where("action = 'rebuild'").select(F.col("file_path").alias("path")), "path", "left_semi")
        stamp = time.strftime("%Y-%m-%dT%H:%M:%S.000Z", time.gmtime())
        return self.store.refresh(self.name, plan, extract.entries(wanted, self.config_digest, stamp))

    def verify_index(self) -> bool:
        """Whether the store answers as the files do; where it does not, it is cleared, and the files answer."""
        columns = ["file_path", "symbol_position", "selector", "kind", "signature", "line", "end_line"]
        base = extract.symbols(self.files).withColumnRenamed("path", "file_path").select(*columns)
        if self.store is None or not search.answer(base, self.store.symbols(self.name).select(*columns))[1]:
            return True
        self.store.clear(self.name)
        self._symbols = None
        return False

    def _page(self, rows: DataFrame, order: list, offset: int, limit: int, most: int = PAGE_MAX) -> dict:
        page_bounds(offset, limit, most)
        items = [r.asDict(recursive=True) for r in rows.orderBy(*order).offset(offset).limit(limit).collect()]
        total = rows.count()
        more = offset + len(items) < total
        return {"items": items, "total": total, "offset": offset, "limit": limit, "has_more": more, "next_offset": offset + len(items) if more else None, "freshness": self.freshness()}

    def freshness(self) -> dict:
        return {"state": self.status.state, "causes": list(self.status.causes)}

    # --- reads ---

    def list_files(self, glob_filter: str | None = None, offset: int = 0, limit: int = PAGE_DEFAULT) -> dict:
        rows = self.files.select("path")
        return self._page(rows.where(files.has(F.col("path"), glob_filter)) if glob_filter else rows, [files.by_language("path"), "path"], offset, limit)

    def get_project_status(self) -> dict:
        s = self.status
        return self.freshness() | {"index": s.index, "compiler": s.compiler, "pending_files": list(s.pending), "errors": list(s.errors), "operations": dict(self.scheduler.counts)}

    def get_file(self, file: str, offset: int = 0, limit: int = PAGE_MAX, symbols_only: bool = False) -> dict:
        path = files.resolve(self.files, relative_path(file))
        own = self.files.where(F.col("path") == path)
        head = own.select(F.sha2(F.col("text").cast("binary"), 256).alias("h"), F.size(files.line_array(F.col("text"))).alias("n")).first()
        if symbols_only:
            return self._page(self.symbols.where(F.col("file_path") == path), ["symbol_position"], offset, limit) | {"file": path, "content_hash": head.h}
        page_bounds(offset, limit)
        rows = files.line_slice(own, "path", offset, limit).orderBy("line").collect()
        return {"file": path, "content_hash": head.h, "total_lines": head.n, "lines": [{"line": r.line, "text": r.line_text} for r in rows], "freshness": self.freshness()}

    def get_outline(self, file: str) -> dict:
        path = files.resolve(self.files, relative_path(file))
        rows = self.symbols.where(F.col("file_path") == path).orderBy("symbol_position").collect()  # one file's
        return {"file": path, "symbols": [r.asDict() for r in rows]}

    def declaration(self, file: str, symbol: str) -> dict:
        """The one declaration that a selector or path names."""
        path = files.resolve(self.files, relative_path(file))
        own = self.symbols.where((F.col("file_path") == path) & ((F.col("selector") == symbol) | (F.col("symbol_path") == symbol)))
        found = own.withColumn("runs", resolution.executable()).orderBy("symbol_position").collect()  # one file's
        if len(found) != 1:
            bodies = [r for r in found if r.runs and r.end_line > r.line]
            if len(bodies) != 1:
                raise QueryError("AMBIGUOUS_TARGET" if found else "NOT_FOUND", f"{symbol!r} has {len(found)} declarations", [r.selector for r in found[:20]])
            found = bodies
        return found[0].asDict()

    def get_symbol_source(self, file: str, symbol: str) -> dict:
        d = self.declaration(file, symbol)
        text = self.files.where(F.col("path") == d["file_path"]).select(F.array_join(F.slice(files.line_array(F.col("text")), d["line"], d["end_line"] - d["line"] + 1), "\n").alias("s")).first().s
        return {"file": d["file_path"], "selector": d["selector"], "start_line": d["line"], "end_line": d["end_line"], "source": text}

    def search_symbols(self, query: str, kinds: list[str] | None = None, file_filter: str | None = None, detail: str = "summary", offset: int = 0, limit: int = SEARCH_DEFAULT) -> dict:
        found = search.candidates(self.symbols, query, kinds=kinds, file_filter=file_filter)
        out = self._page(found, ["rank", "file_path", "symbol_position"], offset, limit)
        keep = search.DETAIL[member("detail", detail, search.DETAIL)]
        return out | {"items": [{k: r[k] for k in keep if k in r} for r in out["items"]]}

    def where_meant(self, symbol: dict) -> DataFrame:
        """Files (path) in which a declaration's name means that declaration: its own, and those that import it from there."""
        top = self.symbols.where(~F.contains("symbol_path", F.lit(".")))
        declared = top.select(F.col("file_path").alias("file"), "name", F.concat_ws("\0", "file_path", "symbol_path").alias("symbol_id"))
        outer = symbol["symbol_path"].split(".")[0]  # a member is reached through what holds it
        meant = resolution.scope(declared, extract.imports(self.files)).where((F.col("name") == outer) & (F.col("symbol_id") == F.lit(f"{symbol['file_path']}\0{outer}")))
        own = self.files.where(F.col("path") == symbol["file_path"]).select("path")
        return meant.select(F.col("file").alias("path")).unionByName(own).distinct()

    def references(self, symbol: dict) -> DataFrame:
        """Whole-word occurrences of a declaration's name where it means that declaration. Equal names of other files are not
        its references; that an occurrence is one is syntax, not proof."""
        word = rf"(?<![\w$]){re.escape(symbol['name'])}(?![\w$])"
        rows = files.lines(self.files.join(self.where_meant(symbol), "path", "left_semi"), "path").where(F.col("line_text").rlike(word))
        parts = F.split("line_text", word, -1)
        rows = rows.withColumn("p", parts).select("path", "line", "line_text", F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("i", "_"), "p")
        before = F.aggregate(F.slice("p", F.lit(1), F.col("i") + 1), F.lit(0), lambda a, x: a + F.length(x))
        column = before + F.col("i") * len(symbol["name"]) + 1
        declared = (F.col("path") == symbol["file_path"]) & (F.col("line") == symbol["line"]) & (F.col("i") == 0)
        return rows.select(F.col("path").alias("file"), "line", column.cast("int").alias("column"), declared.alias("is_declaration"), F.substring(F.trim("line_text"), 1, CONTEXT_CHARS).alias("context"), F.lit("syntax").alias("provenance"))

    def find_references(self, file: str, symbol: str, include_declaration: bool = True, offset: int = 0, limit: int = PAGE_DEFAULT) -> dict:
        found = self.references(self.declaration(file, symbol))
        shown = found if include_declaration else found.where(~F.col("is_declaration"))
        order = files.by_language(F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string"), F.col("is_declaration").cast("string")))
        out = self._page(shown, [order], offset, limit)
        touched = found.select("file").distinct()
        affected = [r.file for r in touched.orderBy("file").limit(PAGE_MAX + 1).collect()]
        more = len(affected) > PAGE_MAX
        return out | {"declaration_count": 1, "reference_count": found.where(~F.col("is_declaration")).count(), "affected_files": affected[:PAGE_MAX], "affected_files_truncated": more}

    def _proven(self) -> DataFrame:
        if self.status.state != "fresh":
            raise QueryError("STALE_WORKSPACE", "relationships are only answered for a fresh project")
        if self.edges is None:
            raise QueryError("INCOMPLETE_EVIDENCE", "no relationships have been supplied")
        return self.edges.where(graph.exact()) if "compiler_authoritative" in self.edges.columns else self.edges

    def get_impact(self, root: str, direction: str = "incoming", **budget: Any) -> dict:
        w = graph.bounded_impact(self._proven(), root, direction, **budget)
        return {"root": root, "direction": direction, "nodes": [{"endpoint": n, "depth": d, "direct": x} for n, d, x in w.ordered_nodes()], "edges": sorted(w.edges), "incomplete": w.incomplete, "truncation": w.truncation, "truncation_reasons": w.reasons}

    def find_test_candidates(self, root: str, file_of: Callable[[str], str], conventions: list[str] = (), offset: int = 0, limit: int = PAGE_DEFAULT, **budget: Any) -> dict:
        edges = self._proven()
        w = graph.bounded_impact(edges, root, "incoming", **budget)
        found = evidence.test_candidates(edges, w, {n: file_of(n) for n in w.nodes}, list(conventions))
        page_bounds(offset, limit)
        return {"candidates": found[offset : offset + limit], "total": len(found), "proven_empty": not found}

    def get_diagnostics(self, offset: int = 0, limit: int = PAGE_DEFAULT) -> dict:
        if self.diagnostics is None:
            raise QueryError("INCOMPLETE_EVIDENCE", "no diagnostics have been supplied")
        key = files.by_language(F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string"), F.col("code").cast("string")))
        counts = delta.category_counts(self.diagnostics, "category", ["Error", "Warning"]).first()
        return self._page(self.diagnostics, [key], offset, limit) | {"error_count": counts.n_Error, "warning_count": counts.n_Warning}

    def explore(self, query: str | None = None, file: str | None = None, symbol: str | None = None, detail: str = "summary", offset: int = 0, limit: int = SEARCH_DEFAULT, reference_limit: int = 20, max_bytes: int = 64 << 10) -> dict:
        """Symbols by query, by file, or one by name, with evidence by level of detail, within ``max_bytes``."""
        if not 1 << 10 <= max_bytes <= 1 << 20 or not 0 <= reference_limit <= 100:
            raise QueryError("INVALID_INPUT", "max_bytes or reference_limit is out of bounds")
        member("detail", detail, ("selectors", "summary", "context", "full"))
        route = "symbol" if symbol else "query" if query else "file"
        if symbol:
            rows, total = [self.declaration(file or "", symbol)], 1
        else:
            found = search.candidates(self.symbols, query, file_filter=file) if query else self.symbols.where(F.col("file_path") == files.resolve(self.files, relative_path(file or "")))
            page = self._page(found, ["rank", "file_path", "symbol_position"] if query else ["file_path", "line", "symbol_position"], offset, limit)
            rows, total = page["items"], page["total"]
        wanted = search.expansion(detail)
        clusters = []
        for r in rows:
            shown = {"file": r["file_path"], "selector": r["selector"], "kind": r["kind"]} | ({} if detail == "selectors" else {"signature": r["signature"]})
            more: dict[str, Any] = {}
            if wanted["source"]:
                more["source"] = {"text": self.get_symbol_source(r["file_path"], r["selector"])["source"]}
            if wanted["references"] and reference_limit:
                refs = self.find_references(r["file_path"], r["selector"], limit=reference_limit)
                more["references"] = {"items": refs["items"], "has_more": refs["has_more"]}
            clusters.append({"symbol": shown, "evidence": more or None})
        return evidence.present(clusters, total, max_bytes, offset) | {"route": route, "freshness": self.freshness(), "completeness": "syntax"}

    # --- writes ---

    def _writable(self) -> Operations:
        if self.operations is None:
            raise QueryError("INVALID_INPUT", "the project was opened without files to write")
        return self.operations

    @staticmethod
    def _prepared(plan) -> dict:
        return {"operation_id": plan.operation_id, "plan_hash": plan.plan_hash, "kind": plan.kind, "status": plan.status, "affected_files": plan.affected_files(), "reference_count": plan.reference_count, "workspace_hash": plan.workspace_hash, "post_workspace_hash": plan.post_workspace_hash, "blocked": plan.blocked, "diagnostics_added": plan.added_problems}

    def rename_symbol(self, name: str, new_name: str, file: str | None = None) -> dict:
        """Renames a declaration, and its name where it means that declaration. Without ``file``, one file alone may declare it."""
        own = self.symbols.where((F.col("name") == name) | (F.col("symbol_path") == name) | (F.col("selector") == name))
        if file is not None:
            path = files.resolve(self.files, relative_path(file))
            own = own.where(F.col("file_path") == path)
        found = own.select("file_path", "symbol_path", "name", "selector").distinct().orderBy("file_path", "symbol_path").limit(21).collect()
        if len({(r.file_path, r.symbol_path) for r in found}) != 1:
            raise QueryError("AMBIGUOUS_TARGET" if found else "NOT_FOUND", f"{name!r} has {len(found)} declarations", [f"{r.file_path}:{r.selector}" for r in found[:20]])
        meant = [r.path for r in self.where_meant(found[0].asDict()).collect()]  # files that a rename would write
        return self._prepared(self._writable().rename_symbol(found[0].name, new_name, meant))

    def replace_symbol_body(self, path: str, symbol_path: str, body: str) -> dict:
        return self._prepared(self._writable().replace_symbol_body(path, symbol_path, body))

    def scaffold_class(self, path: str, name: str, methods: list[dict]) -> dict:
        return self._prepared(self._writable().scaffold_class(path, name, methods))

    def get_operation_preview(self, operation_id: str, path: str | None = None) -> dict:
        plan = self._writable().plans.get(operation_id)
        if plan is None:
            raise QueryError("NOT_FOUND", f"no plan {operation_id}")
        return {"operation_id": operation_id, "plan_hash": plan.plan_hash, "preview": plan.preview(path)}

    def apply_operation(self, operation_id: str, plan_hash: str) -> dict:
        return self._writable().apply(operation_id, plan_hash)


TOOLS = ("list_files", "get_project_status", "explore", "get_outline", "get_symbol_source", "search_symbols", "find_references", "get_impact", "find_test_candidates", "get_diagnostics", "get_file", "rename_symbol", "replace_symbol_body", "scaffold_class", "get_operation_preview", "apply_operation")


def call(project: Project, tool: str, values: dict, form: str = "json") -> Any:
    """Runs a tool in its turn; ``form`` may be toon, the compact text."""
    member("tool", tool, TOOLS)
    out = project.scheduler.run(lambda: getattr(project, tool)(**values), project.spark)
    return encode_checked(out) if member("form", form, ("json", "toon")) == "toon" else out


def batch_tools(project: Project) -> dict[str, Callable[..., Any]]:
    """The tools that batch documents may name."""
    from .plans.batch import PREPARES, READS

    return {t: (lambda t: lambda project_root=None, **v: call(project, t, v))(t) for t in READS + PREPARES}
