"""The segment store: what a change writes, what a search reads, writers that meet, and what is damaged."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from evispark.contracts import QueryError
from evispark.sources import segments
from evispark.sources.segments import SegmentStore
from evispark.sources.store import ENTRY, MemoryStore


def entry(path, names, digest="c"):
    return (path, f"hash of {names}", digest, [(n, f"{path}.{n}", f"{n}@{i + 1}", "MethodDeclaration", None, i + 1, i + 1) for i, n in enumerate(names)], "2026-08-06T00:00:00.000Z")


def frame(spark, entries):
    return spark.createDataFrame(entries, ENTRY)


def held(store):
    return {r.file_path: [s.name for s in r.symbols or []] for r in store.load("p").collect()}


def files_of(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_a_change_writes_its_buckets_alone(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path), buckets=6, most=3)
    start = {f"src/f{i}.ts": [f"name{i}", "shared"] for i in range(40)}
    assert sorted(store.upsert("p", frame(spark, [entry(k, v) for k, v in start.items()]))) == list(range(6))
    before, old = files_of(tmp_path), store.manifest("p")["buckets"]
    assert store.upsert("p", frame(spark, [entry("src/f7.ts", ["changed"])])) and len(store.manifest("p")["buckets"]) == 6
    now = store.manifest("p")["buckets"]
    assert sum(now[b] != old[b] for b in old) == 1
    new = files_of(tmp_path) - before
    assert len(new) == 2 and {p.split("/")[-3] for p in new} == {"rows", "postings"} and before <= files_of(tmp_path)
    want = start | {"src/f7.ts": ["changed"]}
    assert held(store) == want
    assert {r.name for r in store.symbols("p", "name7").collect()} == set()  # the older version is not found any more
    # removed, brought back, nothing to do
    store.remove("p", ["src/f7.ts", "src/none.ts"])
    assert held(store) == {k: v for k, v in want.items() if k != "src/f7.ts"}
    assert store.upsert("p", frame(spark, [])) == []
    # more segments than allowed are compacted, in their bucket alone
    untouched = {b: s for b, s in store.manifest("p")["buckets"].items() if len(s) == 1}
    for i in range(4):
        store.upsert("p", frame(spark, [entry("src/f7.ts", [f"again{i}", None])]))
    assert max(map(len, store.manifest("p")["buckets"].values())) <= 3
    assert all(store.manifest("p")["buckets"][b] == s for b, s in untouched.items())
    assert held(store) == want | {"src/f7.ts": ["again3", None]}
    store.clear("p")
    assert held(store) == {} and store.symbols("p", "again").collect() == []


def test_refresh_in_one_change(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path), buckets=3)
    store.upsert("p", frame(spark, [entry("a", ["x"]), entry("b", ["y"]), entry("c", ["z"])]))
    plan = spark.createDataFrame([("a", "reuse"), ("b", "rebuild"), ("c", "remove"), ("d", "rebuild")], "file_path string, action string")
    number = store.manifest("p")["number"]
    assert store.refresh("p", plan, frame(spark, [entry("b", ["y2"]), entry("d", ["w"])])) == {"rebuild": 2, "reuse": 1, "remove": 1}
    assert store.manifest("p")["number"] == number + 1 and held(store) == {"a": ["x"], "b": ["y2"], "d": ["w"]}


def test_search_equals_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 4)
    r = random.Random(8)
    store, plain = SegmentStore(spark, str(tmp_path), buckets=2), MemoryStore(spark)
    name = lambda: "".join(r.choice("abABéßÜ\U0001f600._$ ") for _ in range(r.randrange(1, 9)))
    rows = {f"f{i}": [name() for _ in range(r.randrange(0, 5))] for i in range(60)}
    store.upsert("p", frame(spark, [entry(k, v) for k, v in rows.items()]))
    rows |= {k: [name()] for k in r.sample(sorted(rows), 15)}
    store.upsert("p", frame(spark, [entry(k, rows[k]) for k in sorted(rows) if len(rows[k]) == 1]))
    plain.put("p", frame(spark, [entry(k, v) for k, v in rows.items()]))
    some = [n for v in rows.values() for n in v]
    terms = ["", "a", "é", "ab", "f1.", "@1", "no such", "\U0001f600", *r.sample(some, 3), some[0][1:3] or "b"]
    for term in terms:
        got, want = (s.symbols("p", term).select("file_path", "name", "selector").collect() for s in (store, plain))
        assert sorted(got) == sorted(want), term
    assert [tuple(x) for x in store.symbols("p", "a", file_filter="F1").collect()] == [tuple(x) for x in plain.symbols("p", "a", file_filter="F1").collect()]


def test_a_search_reads_postings_and_the_buckets_they_name(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path), buckets=16)
    store.upsert("p", frame(spark, [entry(f"f{i}", [f"word{i}", "needle" if i == 3 else "hay"]) for i in range(50)]))
    read = {p.split("file:")[-1] for p in store.candidates("p", "NEEDLE").inputFiles()}
    rows = {p for p in read if "/rows/" in p}
    assert len(rows) == 1 and not store.candidates("p", "nothing like it").inputFiles()
    lists = store._parquet([p for p, _ in store._folders("p", "postings")], segments.POSTING)
    plan = segments.matching(lists, "needle")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan and "/rows/" not in plan
    # lists ascend, block by block
    for r in lists.collect():
        assert r.rows == sorted(set(r.rows)) and {x // segments.BLOCK for x in r.rows} == {r.block}


def test_of_two_writers_one_wins(spark, tmp_path):
    one, two = SegmentStore(spark, str(tmp_path), buckets=2), SegmentStore(spark, str(tmp_path), buckets=2)
    one.upsert("p", frame(spark, [entry("a", ["x"])]))
    seen = two.manifest("p")
    two.manifest = lambda project: seen if not late.append(1) and len(late) == 1 else SegmentStore.manifest(two, project)
    late = []
    one.upsert("p", frame(spark, [entry("b", ["y"])]))
    with pytest.raises(QueryError, match="CONFLICT"):
        two.upsert("p", frame(spark, [entry("c", ["z"])]))
    assert held(one) == {"a": ["x"], "b": ["y"]}
    named = {s for v in one.manifest("p")["buckets"].values() for s in v}
    assert {d for d in os.listdir(tmp_path / "p") if d.startswith("seg-")} == named


def test_what_is_damaged(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path), buckets=2)
    store.upsert("p", frame(spark, [entry("a", ["x"])]))
    # a manifest that was not finished, and a segment of a writer that died, change nothing
    (tmp_path / "p" / "manifest-9.json").write_text('{"schema_ver')
    (tmp_path / "p" / "seg-dead" / "rows").mkdir(parents=True)
    assert held(store) == {"a": ["x"]}
    store.upsert("p", frame(spark, [entry("b", ["y"])]))
    assert held(store) == {"a": ["x"], "b": ["y"]} and store.manifest("p")["number"] == 10
    # rows that are not what was written
    folder = next(p for p, _ in store._folders("p", "rows"))
    rows = spark.read.schema(segments.ROW).parquet(folder).collect()
    spark.createDataFrame(rows, segments.ROW).withColumn("content_hash", F.lit("forged")).write.mode("overwrite").parquet(folder)
    with pytest.raises(QueryError, match="checksum"):
        SegmentStore(spark, str(tmp_path), buckets=2).load("p")


def test_postings_of_a_file_of_very_many_symbols(spark, tmp_path):
    names = [f"Größe {i} of a rather long name" for i in range(8000)] + ["two\nlines", "x", None]
    store = SegmentStore(spark, str(tmp_path), buckets=2)
    began = time.time()
    store.upsert("p", frame(spark, [entry("src/big.ts", names), entry("src/small.ts", ["y"])]))
    assert time.time() - began < 60
    for term, want in (("GRÖSSE 77", 0), ("größe 7777 ", 1), ("o\nl", 1), ("ig.ts.x", 1), ("x", 1), ("\U0001f600", 0)):
        found = {(r.file_path, r.name) for r in store.symbols("p", term).collect()}
        every = {(f, n) for f, ns in (("src/big.ts", names), ("src/small.ts", ["y"])) for i, n in enumerate(ns) if any(term.lower() in x.lower() for x in (n or "", f"{f}.{n}", f"{n}@{i + 1}"))}
        assert len(found) == want and found == every, term
