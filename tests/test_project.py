"""Tools of a project, turns, sessions and the command line."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from evispark import cli, engine
from evispark.contracts import QueryError
from evispark.functions.toon import decode
from evispark.plans.operations import MemoryFiles
from evispark.sources import extract, store
from evispark.streaming.freshness import Status

TEXTS = {"src/a.ts": "export class Client {\n  request(x: string): void { go(); }\n}\nfunction go() {\n  return 1;\n}\n", "src/b.ts": "import { Client } from './a';\nconst c = new Client(); // Client\n", "test/a.test.ts": "import { Client } from '../src/a';\nnew Client();\n", "src/other.ts": "class Client {}\nnew Client();\n"}


@pytest.fixture
def project(spark):
    edges = spark.createDataFrame([("e1", "reference", "b", "a"), ("e2", "reference", "t", "b")], "relationship_id string, kind string, src string, dst string")
    diagnostics = spark.createDataFrame([(1, "Error", "src/a.ts", 10, 1, "m"), (2, "Warning", "src/a.ts", 2, 1, "n")], "code int, category string, file string, line int, column int, message string")
    return engine.Project(spark, spark.createDataFrame(list(TEXTS.items()), "path string, text string"), edges, diagnostics, sources=MemoryFiles({k: v.encode() for k, v in TEXTS.items()}))


def test_reads(project):
    assert [f["path"] for f in project.list_files("SRC")["items"]] == ["src/a.ts", "src/b.ts", "src/other.ts"]
    got = project.get_file("a.ts", 1, 2)
    assert got["file"] == "src/a.ts" and [x["line"] for x in got["lines"]] == [2, 3] and got["total_lines"] == 6
    assert [s["symbol_path"] for s in project.get_outline("src/a.ts")["symbols"]] == ["Client", "Client.request", "go"]
    assert project.get_symbol_source("src/a.ts", "go")["source"] == "function go() {\n  return 1;\n}"
    assert project.search_symbols("client")["items"][0]["selector"] == "Client@1"
    refs = project.find_references("src/a.ts", "Client", limit=3)
    assert refs["reference_count"] == 5 and refs["total"] == 6 and refs["next_offset"] == 3 and refs["affected_files"] == ["src/a.ts", "src/b.ts", "test/a.test.ts"]
    assert {(r["line"], r["column"]) for r in refs["items"] if r["file"] == "src/b.ts"} == {(1, 10), (2, 15)}
    d = project.get_diagnostics()
    assert [x["line"] for x in d["items"]] == [10, 2] and (d["error_count"], d["warning_count"]) == (1, 1)
    shown = project.explore(query="client", detail="full")
    assert shown["route"] == "query" and shown["evidence"][0]["source"]["text"].startswith("export class Client")
    assert project.explore(file="src/a.ts")["page"]["total"] == 3 and project.explore(file="src/a.ts", symbol="go")["route"] == "symbol"


def test_relationships_need_a_fresh_project(project):
    assert [n["endpoint"] for n in project.get_impact("a", max_depth=1)["nodes"]] == ["a", "b"] and project.get_impact("a", max_depth=1)["truncation"]["reason"] == "depth_limit"
    found = project.find_test_candidates("a", {"a": "src/a.ts", "b": "src/b.ts", "t": "test/a.test.ts"}.get)
    assert [c["file"] for c in found["candidates"]] == ["test/a.test.ts"] and not found["proven_empty"]
    project.status = Status()
    with pytest.raises(QueryError, match="STALE"):
        project.get_impact("a")


def test_writes(project):
    with pytest.raises(QueryError, match="AMBIGUOUS_TARGET"):
        project.rename_symbol("Client", "Api")
    plan = engine.call(project, "rename_symbol", {"name": "Client", "new_name": "Api", "file": "src/a.ts"})
    assert "+export class Api" in project.get_operation_preview(plan["operation_id"], "src/a.ts")["preview"]
    assert project.apply_operation(plan["operation_id"], plan["plan_hash"])["files"] == ["src/a.ts", "src/b.ts", "test/a.test.ts"]
    assert isinstance(decode(engine.call(project, "get_project_status", {}, "toon")), dict)


def test_equal_names_of_other_files_stay(project):
    """Two files declare the same name: neither's references nor a rename touch the other's."""
    refs = project.find_references("src/other.ts", "Client")
    assert refs["affected_files"] == ["src/other.ts"] and refs["reference_count"] == 1
    plan = project.rename_symbol("Client", "Other", "src/other.ts")
    assert [x["file"] for x in plan["affected_files"]] == ["src/other.ts"]


def test_imports(spark):
    t = spark.createDataFrame([("a/b/c.ts", "import { x, type Y as Z } from '../d';\nimport q, { r } from './e.js'\nexport { s } from '../../top';\nimport { none } from './gone';"), ("a/d.ts", ""), ("a/b/e.ts", ""), ("top/index.ts", "")], "path string, text string")
    assert {(r.file, r.name, r.target) for r in extract.imports(t).collect()} == {("a/b/c.ts", n, f) for n, f in (("x", "a/d.ts"), ("Y", "a/d.ts"), ("r", "a/b/e.ts"), ("s", "top/index.ts"))}


def test_index_of_a_project(spark, project, tmp_path):
    project.store, project.config_digest = store.ParquetStore(spark, f"file://{tmp_path}/idx"), "c1"
    assert project.refresh() == {"rebuild": 4, "reuse": 0, "remove": 0}
    assert project.search_symbols("client")["items"][0]["selector"] == "Client@1" and project.verify_index()
    texts = TEXTS | {"src/b.ts": "function added() {\n}\n"}
    del texts["src/other.ts"]
    now = spark.createDataFrame(list(texts.items()), "path string, text string")
    assert project.refresh(now) == {"rebuild": 1, "reuse": 2, "remove": 1}
    assert [s["symbol_path"] for s in project.get_outline("src/b.ts")["symbols"]] == ["added"]
    forged = project.store.load("project").withColumn("symbols", F.slice("symbols", 1, 0))
    project.store.upsert("project", forged)
    assert not project.verify_index() and [s["symbol_path"] for s in project.get_outline("src/b.ts")["symbols"]] == ["added"]


def test_turns():
    s = engine.Scheduler(capacity=1, wait=0.2)
    hold, started = threading.Event(), threading.Event()
    first = threading.Thread(target=s.run, args=(lambda: (started.set(), hold.wait(5)),))
    first.start()
    started.wait(5)
    with pytest.raises(QueryError, match="TIMEOUT|DEADLINE"):
        s.run(lambda: 1)
    hold.set()
    first.join()
    assert s.run(lambda: 7) == 7 and s.counts["completed"] == 2 and s.counts["timed_out"] == 1
    s.shutdown()
    with pytest.raises(QueryError, match="SHUTTING_DOWN"):
        s.run(lambda: 1)


def test_sessions(project):
    s = engine.Sessions(2)
    for key in "abca":
        s.get(key, lambda: project)
    assert list(s.open) == ["c", "a"]
    project.scheduler.running = True
    with pytest.raises(QueryError, match="PROJECT_"):
        s.get("z", lambda: project)


def test_command_line(spark, tmp_path, capsys):
    for path, text in TEXTS.items():
        (tmp_path / "p" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / path).write_text(text)
    doc = {"version": 1, "project_root": str(tmp_path / "p"), "steps": [{"id": "s", "tool": "search_symbols", "input": {"query": "go"}}, {"id": "src", "tool": "get_symbol_source", "foreach": {"$ref": "/s/items"}, "input": {"file": {"$item": "/file_path"}, "symbol": {"$item": "/selector"}}}], "emit": {"$ref": "/src/0/source"}}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    assert cli.main(["validate", str(tmp_path / "d.json")]) == 0 and json.loads(capsys.readouterr().out)["valid"]
    assert cli.main(["run", str(tmp_path / "d.json")]) == 0 and json.loads(capsys.readouterr().out).startswith("function go()")
    (tmp_path / "d.json").write_text("{}")
    assert cli.main(["run", str(tmp_path / "d.json")]) == 1 and cli.main(["nothing"]) == 2
