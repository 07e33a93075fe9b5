"""Search, files, deltas, stores, presentation, batch documents, operations, streams."""

import json
import random

import pytest

from evispark import contracts
from evispark.contracts import QueryError
from evispark.functions import pointer, redaction, scalar, toon
from evispark.operators import delta, diagnostics, evidence, files, occurrences, search
from evispark.plans import batch
from evispark.plans.operations import FolderFiles, MemoryFiles, Operations
from evispark.sources import extract, store
from evispark.streaming import feed, freshness
from pyspark.sql import functions as F


@pytest.mark.parametrize(("query", "rank"), [("Api.Client.request@42", 0), ("Api.Client.request", 1), ("request", 2), ("Api.Client", 3), ("Client", 4)])
def test_ranks(spark, query, rank):
    t = spark.createDataFrame([("request", "Api.Client.request", 42, "f", "k", 0)], "name string, symbol_path string, line int, file_path string, kind string, symbol_position int")
    assert [r["rank"] for r in search.candidates(t, query).collect()] == [rank]


def test_pages(spark):
    t = spark.range(5).withColumnRenamed("id", "n")
    last = search.page(t, [F.col("n")], 3, 2).orderBy("n").collect()
    assert [(r.n, r.total, r.has_more, r.next_offset) for r in last] == [(3, 5, False, None), (4, 5, False, None)]
    assert search.page(t, [F.col("n")], 0, 2).first().next_offset == 2
    for bad in ((-1, 2), (0, 0), (0, 501)):
        with pytest.raises(QueryError):
            search.page(t, [F.col("n")], *bad)


@pytest.mark.parametrize(("text", "lines"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\rc\n\nd", ["a", "b", "c", "", "d"])])
def test_lines(spark, text, lines):
    t = spark.createDataFrame([(1, text)], "k int, text string")
    assert [r.line_text for r in files.lines(t, "k").orderBy("line").collect()] == lines


def test_scan_and_resolve(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("x")
    (tmp_path / "a.ts").write_text("y")
    got = files.scan(spark, str(tmp_path), "*.ts")
    assert sorted(r.path for r in got.select("path").collect()) == ["a.ts", "src/a.ts"]
    assert files.resolve(got, "a.ts") == "a.ts"
    t = spark.createDataFrame([("x/a.ts",), ("y/a.ts",), ("z/b.ts",)], "path string")
    assert files.resolve(t, "b.ts") == "z/b.ts"
    for wanted, code in (("a.ts", "AMBIGUOUS_TARGET"), ("c.ts", "NOT_FOUND")):
        with pytest.raises(QueryError, match=code):
            files.resolve(t, wanted)


def test_refresh_refuses_what_does_not_fit(spark):
    t = lambda rows: spark.createDataFrame(rows, "file_path string, content_hash string, config_digest string")
    now, old = t([("a", "1", "c"), ("b", "2", "c")]), t([("a", "1", "c"), ("z", "9", "c")])
    good = files.checked_refresh(now, old, t([("b", "2", "c")]), "c").collect()
    assert {r.file_path: r.action for r in good} == {"a": "reuse", "b": "rebuild", "z": "remove"}
    for rebuilt, why in (([], "no.* none|has none"), ([("b", "3", "c")], "hash"), ([("b", "2", "c"), ("q", "1", "c")], "not current"), ([("b", "2", "c")] * 2, "repeats")):
        with pytest.raises(QueryError, match=why):
            files.checked_refresh(now, old, t(rebuilt), "c")


def test_surplus_keeps_later_rows_and_ignores_position(spark):
    t = lambda rows: spark.createDataFrame(rows, "code int, message string, line int")
    assert delta.delta(t([(1, "m", 1)]), t([(1, "m", 12)]), ["code", "message"], ["line"]).count() == 0
    assert [(r.line, r.change) for r in delta.delta(t([(1, "m", 1)]), t([(1, "m", 1), (1, "m", 2)]), ["code", "message"], ["line"]).collect()] == [(2, "added")]


@pytest.fixture(params=["memory", "parquet"])
def stores(request, spark, tmp_path):
    return store.MemoryStore(spark) if request.param == "memory" else store.ParquetStore(spark, f"file://{tmp_path}/idx")


def entry(path, names, h="h"):
    return (path, h, "c", [(n, f"M.{n}", f"M.{n}@{i}", "Function", "sig", i, i) for i, n in enumerate(names, 1)], "2026-08-06T00:00:00.000Z")


def test_stores_conform(spark, stores):
    t = lambda *rows: spark.createDataFrame(list(rows), store.ENTRY)
    stores.upsert("p", t(entry("b.ts", ["Beta", "gamma"]), entry("a.ts", ["alpha"])))
    stores.upsert("q", t(entry("x.ts", ["other"])))
    assert [(r.file_path, r.name) for r in stores.symbols("p").collect()] == [("a.ts", "alpha"), ("b.ts", "Beta"), ("b.ts", "gamma")]
    assert stores.count_symbols("p", query="BETA") == 1 and stores.count_symbols("p", kinds=["Class"]) == 0 and stores.count_symbols("p", file_filter="A.T") == 1
    stores.upsert("p", t(entry("b.ts", ["delta"], "h2")))
    assert [r.name for r in stores.symbols("p").collect()] == ["alpha", "delta"]
    plan = spark.createDataFrame([("a.ts", "remove"), ("b.ts", "reuse"), ("c.ts", "rebuild")], "file_path string, action string")
    assert stores.refresh("p", plan, t(entry("c.ts", ["new"]))) == {"rebuild": 1, "reuse": 1, "remove": 1}
    stores.remove("p", ["c.ts"])
    assert [r.name for r in stores.symbols("p").collect()] == ["delta"]
    stores.clear("p")
    stores.flush()
    assert stores.count_symbols("p") == 0 and stores.count_symbols("q") == 1


def test_corrupt_index_is_moved_aside(spark, tmp_path):
    s = store.ParquetStore(spark, f"file://{tmp_path}/idx")
    s.upsert("p", spark.createDataFrame([entry("a.ts", ["alpha"])], store.ENTRY))
    path = s._current("p")
    bad = spark.read.parquet(path).withColumn("content_hash", F.lit("forged")).collect()
    spark.createDataFrame(bad, f"{store.ENTRY}, checksum string").write.mode("overwrite").parquet(path)
    with pytest.raises(QueryError, match="INTERNAL_ERROR"):
        s.load("p")
    assert s.load("p").count() == 0 and s.inspect()["quarantined"] > 0
    assert [store.policy(x)[0] for x in (None, "canary", "off", "?")] == ["enabled", "canary", "disabled", "disabled"]


def test_old_indexes_are_brought_up(spark, tmp_path):
    s = store.ParquetStore(spark, f"file://{tmp_path}/idx")
    for version, lacking in store.MIGRATIONS.items():
        project = f"p{version}"
        old = spark.createDataFrame([entry("a.ts", ["alpha"])], store.ENTRY).drop(*lacking)
        old.withColumn("checksum", store.checksum(old.columns)).write.parquet(f"{s.root}/{project}/gen=1")
        (tmp_path / "idx" / project / "current-1.json").write_text(json.dumps({"schema_version": version, "generation": "gen=1"}))
        row = s.load(project).first()
        assert (row.file_path, row.symbols[0].name, row.last_indexed_at) == ("a.ts", "alpha", store.NEVER)
        s.upsert(project, spark.createDataFrame([entry("b.ts", ["beta"])], store.ENTRY))
        assert s._pointed(project)[2] == store.SCHEMA_VERSION and s.count_symbols(project) == 2


def test_readers_keep_the_generation_they_have(spark, tmp_path):
    s = store.ParquetStore(spark, f"file://{tmp_path}/idx")
    t = lambda n: spark.createDataFrame([entry("a.ts", [n])], store.ENTRY)
    s.upsert("p", t("one"))
    reading = s.symbols("p")
    s.upsert("p", t("two"))
    assert [r.name for r in reading.collect()] == ["one"] and [r.name for r in s.symbols("p").collect()] == ["two"]
    # a pointer that was never finished does not count, and nothing but proof of corruption moves an index aside
    (tmp_path / "idx/p/current-99.json").write_text('{"schema_ver')
    assert [r.name for r in s.symbols("p").collect()] == ["two"]
    (tmp_path / "idx/p/current-100.json").write_text(json.dumps({"schema_version": store.SCHEMA_VERSION + 1, "generation": "later"}))
    assert s.inspect()["quarantined"] == 0 and s.count_symbols("p") == 1


def test_index_never_changes_an_answer(spark):
    base, other = spark.range(3), spark.range(4)
    assert search.answer(base, base)[1] is False
    rows, corrupt = search.answer(base, other)
    assert corrupt and rows.count() == 3


SOURCE = """// class Comment {}
namespace API {
  export class Client extends Base {
    private token = "}{";
    constructor(url: string) { this.go(); }
    request(path: string): void { if (path) { } }
  }
}
export const transform = (x) => x;
function last() { return 1; }
"""


def test_extraction(spark):
    got = extract.symbols(spark.createDataFrame([("a.ts", SOURCE)], "path string, text string")).orderBy("symbol_position").collect()
    assert [r.symbol_path for r in got] == ["API", "API.Client", "API.Client.token", "API.Client.constructor", "API.Client.request", "transform", "last"]
    assert (got[1].line, got[1].end_line, got[4].signature) == (3, 7, "request(path: string): void")
    f = spark.createDataFrame([("a.ts", SOURCE)], "path string, text string")
    assert extract.outline(f).first().n_symbols == 7
    one = extract.source_of(f, extract.symbols(f).where("name = 'last'").select("path", "line", "end_line")).first()
    assert one.source == "function last() { return 1; }"


def value(r, depth=0):
    pick = r.randrange(8 if depth < 3 else 5)
    text = lambda: "".join(r.choice('ab,:"\\{}[] \n-é1') for _ in range(r.randrange(6)))
    if pick < 5:
        return [None, r.random() < 0.5, r.randrange(-99, 99), r.random(), text()][pick]
    if pick == 5:
        return {text(): value(r, depth + 1) for _ in range(r.randrange(4))}
    if pick == 6:
        keys = [text() + str(i) for i in range(r.randrange(1, 4))]
        return [{k: value(r, 9) for k in keys} for _ in range(r.randrange(4))]
    return [value(r, depth + 1) for _ in range(r.randrange(4))]


def test_tabular_text_round_trips():
    r = random.Random(5)
    for _ in range(800):
        x = value(r)
        assert toon.decode(toon.encode(x)) == x
    rows = [{"id": i, "name": f"n{i}"} for i in range(100)]
    assert len(toon.encode_checked(rows)) < len(json.dumps(rows)) / 2


def cluster(i, size=10):
    return {"symbol": {"file": "f", "selector": f"s{i}@1", "kind": "k", "signature": "x" * size}, "evidence": {"source": {"text": "y" * size}}}


def test_presentation_counts_its_own_bytes():
    out = evidence.present([cluster(0), cluster(1)], 2, 4096)
    assert out["budget"]["used_bytes"] == len(json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode()) and not out["truncation"]["truncated"]


def test_presentation_reduces_what_does_not_fit():
    out = evidence.present([cluster(0, 4000)], 1, 1024)
    assert out["symbols"] == [{"file": "f", "selector": "s0@1", "kind": "k"}] and out["page"]["next_offset"] is None and out["truncation"]["reason"] == "byte_limit"
    assert [(c["component"], c["n"]) for c in out["omissions"]["counts"]] == [("signature", 1), ("source", 1)]
    many = evidence.present([cluster(i, 100) for i in range(50)], 50, 3000)
    assert 0 < len(many["symbols"]) < 50 and many["page"]["next_offset"] == len(many["symbols"]) and many["budget"]["used_bytes"] <= 3000
    with pytest.raises(QueryError, match="INVALID_INPUT"):
        evidence.present([cluster(0)], 1, 100)
    spines = evidence.present([cluster(0)], 1, 4096, call_spines=[{"endpoint": "a"}])
    assert "call_spines" in spines and "call_spines" not in evidence.present([cluster(0)], 1, 700, call_spines=["z" * 600])


def test_batch_documents():
    runner = batch.Runner({"list": lambda n: list(range(n)), "square": lambda x: {"v": x * x}})
    doc = {"version": 1, "steps": [{"id": "a", "tool": "list", "input": {"n": 4}}, {"id": "b", "tool": "square", "foreach": {"$ref": "/a"}, "input": {"x": {"$item": ""}}}], "emit": {"last": {"$ref": "/b/3/v"}, "all": {"$ref": "/b"}}}
    assert runner.run(doc) == {"last": 9, "all": [{"v": 0}, {"v": 1}, {"v": 4}, {"v": 9}]}
    for change, code in (({"emit": {"$ref": "/b/9"}}, "MISSING_REFERENCE"), ({"emit": {"$ref": "/z"}}, "INVALID_REFERENCE"), ({"steps": [doc["steps"][1]]}, "INVALID_REFERENCE"), ({"steps": [{"id": "a", "tool": "list", "input": {"n": {"$item": ""}}}]}, "INVALID_ITEM"), ({"steps": [{"id": "a", "tool": "list", "input": {"n": 300}}, doc["steps"][1]], "emit": 1}, "FOREACH_LIMIT"), ({"steps": [{"id": "a", "tool": "list", "input": {"n": "x"}}], "emit": 1}, "TOOL_ERROR"), ({"version": 2}, "INVALID_INPUT")):
        with pytest.raises(QueryError, match=code):
            runner.run(doc | change)
    with pytest.raises(QueryError, match="cannot run"):
        batch.validate({"version": 1, "steps": [{"id": "a", "tool": "apply_operation", "input": {}}]})


def test_pointers():
    assert pointer.resolve({"a/b": [{"~": 7}]}, "#/a~1b/0/~0") == 7
    for bad, code in (("a", "INVALID"), ("/__proto__", "INVALID"), ("/x", "MISSING")):
        with pytest.raises(QueryError, match=code):
            pointer.resolve({"a": 1}, bad)


def test_operations(tmp_path):
    clock = [0.0]
    f = MemoryFiles({"a.ts": b"export function go() { return 1; } // go\n", "b.ts": b"import { go } from './a'; go(); const s = 'go';\n"})
    ops = Operations(f, lambda: clock[0])
    plan = ops.rename_symbol("go", "run")
    assert plan.reference_count == 3 and set(plan.changes) == {"a.ts", "b.ts"} and "+export function run()" in plan.preview("a.ts")
    ops.export(plan.operation_id, str(tmp_path / "plan.json"))
    again = Operations(f, lambda: clock[0])
    assert again.load(str(tmp_path / "plan.json")).plan_hash == plan.plan_hash
    with pytest.raises(QueryError, match="CONFLICT"):
        again.apply(plan.operation_id, "0")
    assert again.apply(plan.operation_id, plan.plan_hash)["replayed"] is False and f["b.ts"] == b"import { run } from './a'; run(); const s = 'go';\n"
    assert again.apply(plan.operation_id, plan.plan_hash)["replayed"] is True
    late, bad = ops.scaffold_class("c.ts", "C", [{"name": "m"}]), ops.replace_symbol_body("a.ts", "run", "return (2;")
    assert bad.blocked
    with pytest.raises(QueryError, match="BLOCKED"):
        ops.apply(bad.operation_id, bad.plan_hash)
    f["d.ts"] = b""
    with pytest.raises(QueryError, match="CONFLICT"):
        ops.apply(late.operation_id, late.plan_hash)
    clock[0] = 901
    with pytest.raises(QueryError, match="NOT_FOUND"):
        ops.apply(late.operation_id, late.plan_hash)


def test_apply_rolls_back(tmp_path):
    class Failing(MemoryFiles):
        def write(self, path, data):
            if path == "b.ts":
                raise OSError("full")
            super().write(path, data)

    f = Failing({"a.ts": b"let go = 1;", "b.ts": b"go;"})
    ops = Operations(f)
    plan = ops.rename_symbol("go", "run")
    with pytest.raises(OSError):
        ops.apply(plan.operation_id, plan.plan_hash)
    assert f == {"a.ts": b"let go = 1;", "b.ts": b"go;"}


EVENTS = ["source_changed", "config_changed", "compiler_rebuild_started", "sync_succeeded", "sync_failed", "stale_detected", "index_failed", "watcher_failed", "index_recovered", "watcher_recovered"]


def test_states():
    s = freshness.Status()
    for event, evidence_, state in (("source_changed", False, "pending"), ("sync_succeeded", False, "pending"), ("sync_succeeded", True, "fresh"), ("index_failed", False, "degraded"), ("sync_succeeded", True, "degraded"), ("watcher_failed", False, "degraded"), ("index_recovered", False, "degraded"), ("watcher_recovered", False, "pending"), ("compiler_rebuild_started", False, "rebuilding"), ("sync_failed", False, "stale"), ("nonsense", False, "degraded")):
        s = freshness.step(s, event, evidence_)
        assert s.state == state, event


def test_fold_is_the_machine(spark):
    r = random.Random(9)
    rows, expected = [], {}
    for k in range(60):
        s = freshness.Status()
        for i in range(r.randrange(1, 12)):
            e, ok = r.choice(EVENTS), r.random() < 0.7
            s = freshness.step(s, e, ok)
            rows.append((k, i, e, ok, None))
        expected[k] = s.state
    got = freshness.fold(spark.createDataFrame(rows, "k int, seq int, event string, evidence boolean, detail string"), "k")
    assert {x.k: x.state for x in got.collect()} == expected


def test_status_stream(spark, tmp_path):
    schema = "project string, seq bigint, event string, evidence boolean, detail string"
    spark.createDataFrame([("p", 1, "source_changed", False, "a.ts"), ("p", 2, "sync_succeeded", True, None), ("q", 1, "index_failed", False, "disk")], schema).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = freshness.stream(s, "project").writeStream.format("memory").queryName("status").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.key: r.state for r in spark.table("status").collect()} == {"p": "fresh", "q": "degraded"}


def test_debounce_stream(spark, tmp_path):
    schema = "project string, ts timestamp, path string"
    rows = [("p", "2026-01-01 00:00:00", "a"), ("p", "2026-01-01 00:00:01", "b"), ("p", "2026-01-01 00:10:00", "c"), ("p", "2026-01-02 00:00:00", "z")]
    spark.createDataFrame(rows, "project string, ts string, path string").selectExpr("project", "cast(ts as timestamp) ts", "path").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = feed.stream(s, "project", "5 seconds").writeStream.format("memory").queryName("feed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r.paths) for r in spark.table("feed").collect()) == [("a", "b"), ("c",)]


def test_watched_directories(spark):
    got = feed.watched(spark.createDataFrame([("src/a/x.ts",), ("node_modules/y.ts",)], "path string")).collect()
    assert [r.directory for r in got] == ["", "src", "src/a"]


def test_validators():
    assert contracts.relative_path("'src\\a.ts'") == "src/a.ts"
    assert contracts.conventions([" a ", "a", "b"]) == ["a", "b"] and contracts.kinds_in_order(["call", "import"]) == ["import", "call"]
    for f, x in ((contracts.relative_path, "/a"), (contracts.relative_path, "a/../b"), (contracts.conventions, ["../x"])):
        with pytest.raises(QueryError):
            f(x)
    with pytest.raises(QueryError):
        contracts.span(3, None, 2)


def test_text_functions(spark):
    t = spark.createDataFrame([("aé" * 40, "a/test/b.spec.ts", 'token = "s3cret" in /home/me/x')], "long string, path string, said string")
    r = t.select(redaction.truncated_bytes(F.col("long"), 30).alias("cut"), scalar.matches_glob(F.col("path"), "**/*.spec.*").alias("g"), scalar.has_segments(F.col("path"), "test").alias("seg"), redaction.redacted(F.col("said")).alias("red")).first()
    assert len(r.cut.encode()) <= 30 and r.cut.endswith("... [truncated]") and r.g and r.seg and r.red == "token=[REDACTED] in [path-redacted]"


def test_short_passages_are_found_too(spark):
    texts = spark.createDataFrame([(1, "a quick test of things that are said often here"), (2, "nothing"), (3, None)], "doc_id int, text string")
    passages = spark.createDataFrame([(1, "test of"), (2, "noth"), (3, "quick test of things that are"), (4, ""), (5, None), (6, "never")], "item_id int, text string")
    got = occurrences.contained(texts, passages, "doc_id", "item_id")
    assert {(r.item_id, r.doc_id) for r in got.collect()} == {(1, 1), (2, 2), (3, 1)}


def test_values_that_are_json():
    assert contracts.json_safe({"a": [1, 2.5, None, True, {"b": "c"}]})["a"][1] == 2.5
    deep: list = []
    for _ in range(70):
        deep = [deep]
    for bad in (float("nan"), float("inf"), {1: 2}, {"a": {3}}, object(), deep):
        with pytest.raises(QueryError, match="INVALID_INPUT"):
            contracts.json_safe(bad)


def test_files_of_a_folder(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "dist").mkdir()
    (tmp_path / "src/a.ts").write_text("function go() {}\ngo();\n")
    (tmp_path / "dist/a.ts").write_text("go();\n")
    (tmp_path / "out.ts").symlink_to("/etc/hostname")
    there = FolderFiles(str(tmp_path))
    assert there.paths() == ["out.ts", "src/a.ts"] and there.read("src/none.ts") is None
    with pytest.raises(QueryError, match="outside"):
        there.read("out.ts")
    (tmp_path / "out.ts").unlink()
    ops = Operations(there)
    plan = ops.rename_symbol("go", "run")
    with there.lock(), pytest.raises(QueryError, match="CONFLICT"):
        ops.apply(plan.operation_id, plan.plan_hash)
    assert ops.apply(plan.operation_id, plan.plan_hash)["files"] == ["src/a.ts"]
    assert (tmp_path / "src/a.ts").read_text() == "function run() {}\nrun();\n" and (tmp_path / "dist/a.ts").read_text() == "go();\n"


def test_rescan_reads_only_what_changed(spark):
    t = lambda rows: spark.createDataFrame(rows, "path string, text string")
    seen = []

    def extract_(f):
        seen.append(sorted(r.path for r in f.select("path").collect()))
        return f.select("path", "content_hash", F.length("text").alias("n"))

    first = files.rescan(spark.createDataFrame([], "path string, content_hash string, n int"), t([("a", "x"), ("b", "yy")]), extract_).drop("reused")
    now = t([("b", "yy"), ("c", "zzz"), ("a", "xxxx")])
    again = files.rescan(first, now, extract_, verify=lambda: now)
    assert {(r.path, r.n, r.reused) for r in again.collect()} == {("a", 4, False), ("b", 2, True), ("c", 3, False)}
    assert seen[1] == ["a", "c"]
    with pytest.raises(QueryError, match="CONFLICT"):
        files.rescan(first, now, extract_, verify=lambda: t([("b", "yy")]))


def test_diagnostics_of_rows(spark):
    t = spark.createDataFrame([(1, 5, "x"), (2, None, None), (3, 50, "y")], "k int, n int, s string")
    rules = [diagnostics.Rule(1, "Error", F.col("n") > 10, F.concat(F.lit("n is "), F.col("n").cast("string"))), diagnostics.Rule(2, "Warning", F.col("s").isNull(), F.lit("no s"))]
    assert {(r.k, r.code, r.category, r.message) for r in diagnostics.scan(t, ["k"], rules).collect()} == {(3, 1, "Error", "n is 50"), (2, 2, "Warning", "no s")}
    with pytest.raises(QueryError):
        diagnostics.scan(t, ["k"], [diagnostics.Rule(1, "Fatal", F.lit(True), F.lit(""))])
