"""Reviewed changes of a table, and differences line by line, against plain Python."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from evispark.contracts import QueryError
from evispark.operators import line_diff
from evispark.plans import reviewed
from evispark.plans.reviewed import ReviewedTable

FILES = "path string, text string"


def frame(spark, files):
    return spark.createDataFrame(sorted(files.items()), FILES)


def held(table):
    return {r.path: r.text for r in table.load().collect()}


def test_changes_are_staged_applied_and_undone(spark, tmp_path):
    table = ReviewedTable(spark, str(tmp_path / "t"), levels=2)
    start = {f"f{i}": f"text {i}" for i in range(12)} | {"empty": ""}
    plan = table.prepare(frame(spark, start))
    assert held(table) == {} and not plan.blocked and plan.n_files == 13 and table.digest() == plan.base_digest
    with pytest.raises(QueryError, match="hash"):
        table.apply(plan.operation_id, "0" * 64)
    with pytest.raises(QueryError, match="NOT_FOUND"):
        table.apply("op-unknown", plan.plan_hash)
    receipt = table.apply(plan.operation_id, plan.plan_hash)
    assert held(table) == start and table.digest() == plan.new_digest
    assert table.apply(plan.operation_id, plan.plan_hash) == receipt and table.commits.latest()[0] == 1  # the same receipt, no second commit
    change = table.prepare(frame(spark, {"f1": "changed", "f2": None, "new": "n", "f3": "text 3"}))
    assert change.n_files == 3 and {(r.path, r.before_hash is None, r.after_hash is None) for r in table.preview(change.operation_id).collect()} == {("f1", False, False), ("f2", False, True), ("new", True, False)}
    table.apply(change.operation_id, change.plan_hash)
    now = {k: v for k, v in start.items() if k != "f2"} | {"f1": "changed", "new": "n"}
    assert held(table) == now
    table.undo()
    assert held(table) == start and table.digest() == plan.new_digest
    # the same table again, two commits later: the plan made on it still fits
    again = table.prepare(frame(spark, {"f5": "x"}))
    table.apply(again.operation_id, again.plan_hash)
    table.undo()
    with pytest.raises(QueryError, match="NOT_FOUND"):
        table.undo()
    kinds = [r.kind for r in table.receipts().orderBy("place").collect()]
    assert kinds == ["apply", "apply", "undo", "apply", "undo"]
    for bad, code in (({"none": None}, "NOT_FOUND"),):
        with pytest.raises(QueryError, match=code):
            table.prepare(frame(spark, bad))
    with pytest.raises(QueryError, match="repeats"):
        table.prepare(spark.createDataFrame([("a", "1"), ("a", "2")], FILES))


def test_of_two_writers_one_wins_and_a_crash_changes_nothing(spark, tmp_path, monkeypatch):
    one, two = ReviewedTable(spark, str(tmp_path), levels=2), ReviewedTable(spark, str(tmp_path), levels=2)
    first = one.prepare(frame(spark, {"a": "1"}))
    one.apply(first.operation_id, first.plan_hash)
    plans = [t.prepare(frame(spark, {"a": x})) for t, x in ((one, "one"), (two, "two"))]
    outcome = {}

    def work(name, table, plan):
        try:
            outcome[name] = table.apply(plan.operation_id, plan.plan_hash)["operation_id"]
        except QueryError as e:
            outcome[name] = e.code

    threads = [threading.Thread(target=work, args=(n, t, p)) for n, t, p in (("one", one, plans[0]), ("two", two, plans[1]))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [n for n, x in outcome.items() if x.startswith("op-")]
    assert len(won) == 1 and set(outcome.values()) - {outcome[won[0]]} <= {"CONFLICT", "STALE_WORKSPACE"}
    assert held(one) == {"a": won[0]}
    # whatever was written before the commit is not part of the table
    plan = one.prepare(frame(spark, {"a": "lost", "b": "lost"}))
    monkeypatch.setattr(one.commits, "create", lambda *a: (_ for _ in ()).throw(RuntimeError("power")))
    with pytest.raises(RuntimeError):
        one.apply(plan.operation_id, plan.plan_hash)
    assert held(two) == {"a": won[0]}
    (tmp_path / "commit-7.json").write_text('{"parts": [')
    assert held(two) == {"a": won[0]}
    two.apply(plan.operation_id, plan.plan_hash)
    assert held(one) == {"a": "lost", "b": "lost"}


def test_blocked_and_expired_plans(spark, tmp_path, monkeypatch):
    errors = lambda rows: rows.where(F.contains("text", F.lit("bad"))).select("path", F.lit(1).alias("code"), F.lit("is bad").alias("message"), F.lit(1).alias("line"))
    table = ReviewedTable(spark, str(tmp_path), errors, levels=1)
    ok = table.prepare(frame(spark, {"a": "fine"}))
    table.apply(ok.operation_id, ok.plan_hash)
    worse = table.prepare(frame(spark, {"a": "bad", "b": "bad"}))
    assert worse.blocked and worse.n_new_errors == 2
    with pytest.raises(QueryError, match="MUTATION_BLOCKED"):
        table.apply(worse.operation_id, worse.plan_hash)
    monkeypatch.setattr(reviewed, "LIFETIME", -1)
    late = table.prepare(frame(spark, {"a": "late"}))
    with pytest.raises(QueryError, match="expired"):
        table.apply(late.operation_id, late.plan_hash)
    assert held(table) == {"a": "fine"}


def test_hunks_give_the_new_text():
    r = random.Random(4)
    for turn in range(400):
        words = [f"{r.choice('abcdefghijklmnopqrstuvwxyz')}\n" for _ in range(r.randrange(0, 40))] if turn % 2 else [f"line {i}\n" for i in range(r.randrange(0, 40))]
        new = list(words)
        for _ in range(r.randrange(0, 6)):
            i = r.randrange(len(new) + 1)
            new[i : i + r.randrange(3)] = [f"{r.choice('xyz')}\n" for _ in range(r.randrange(3))]
        if r.random() < 0.2:
            r.shuffle(new)
        found = line_diff.hunks(words, new)
        assert line_diff.patched(words, found) == new
        assert all(a + n <= b for (a, n, _), (b, _, _) in zip(found, found[1:], strict=False))
    # one changed line among many is one hunk of one line
    old = [f"{i}\n" for i in range(5000)]
    assert line_diff.hunks(old, [*old[:2500], "x\n", *old[2501:]]) == [(2500, 1, ["x\n"])]
    same = ["same\n"] * 3000
    assert line_diff.hunks(same, ["same\n"] * 2990) == [(2990, 10, [])]


def test_differences_of_a_table(spark):
    before = {"a": "1\n2\n3\n", "b": "x", "c": "", "d": "gone\n", "e": None, "f": "no end", "g": "same\n" * 3}
    after = {"a": "1\n3\n4", "b": "x", "c": "now\n", "e": "was null", "f": "no end\n", "g": None, "h": "", "i": None}
    one, two = frame(spark, before).withColumnRenamed("path", "hunk"), frame(spark, after).withColumnRenamed("path", "hunk")
    with pytest.raises(QueryError, match="hunk"):  # a key that is named like a column of the result
        line_diff.line_diff(one, two, "hunk")
    found = line_diff.line_diff(frame(spark, before), frame(spark, after), "path")
    rows = {(r.path, r.hunk): (r.change, r.old_at, r.n_old, r.lines) for r in found.collect()}
    assert rows == {
        ("a", 0): ("changed", 2, 1, []), ("a", 1): ("changed", 4, 0, ["4"]), ("c", 0): ("changed", 1, 0, ["now\n"]), ("d", 0): ("removed", 1, 1, []),
        ("e", 0): ("added", 1, 0, ["was null"]), ("f", 0): ("changed", 1, 1, ["no end\n"]), ("g", 0): ("removed", 1, 3, []), ("h", 0): ("added", 1, 0, []),
    }
    got = {r.path: r.text for r in line_diff.applied(frame(spark, before), found, "path").collect()}
    assert {k: v or "" for k, v in got.items()} == {k: v or "" for k, v in after.items() if v is not None}
    empty = frame(spark, before).limit(0)
    assert not line_diff.line_diff(empty, empty, "path").collect() and not line_diff.applied(empty, found.limit(0), "path").collect()
