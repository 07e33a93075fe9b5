"""Counters against counts."""

import threading

from pyspark.sql import functions as F

from evispark.plans.counters import Counters


def told(counters):
    return {(r.scope, r.name): r.n for r in counters.table().collect()}


def test_counters_of_queries(spark, tmp_path):
    counters = Counters(spark, str(tmp_path / "c"), most=150)
    rows = spark.range(100)
    seen = counters.observed(rows, "refresh", all=F.count("*"), even=F.count_if(F.col("id") % 2 == 0), none=F.sum(F.lit(None).cast("long")))
    assert counters.flush() == 0 and told(counters) == {}  # nothing has run
    seen.write.format("noop").mode("overwrite").save()
    assert counters.flush() == 3 and counters.flush() == 0
    assert told(counters) == {("refresh", "all"): 100, ("refresh", "even"): 50, ("refresh", "none"): 0}
    counters.observed(rows, "refresh", all=F.count("*")).write.format("noop").mode("overwrite").save()
    counters.observed(rows.where("id < 3"), "other", all=F.count("*")).write.format("noop").mode("overwrite").save()
    assert counters.flush() == 2
    assert told(counters) == {("refresh", "all"): 150, ("refresh", "even"): 50, ("refresh", "none"): 0, ("other", "all"): 3}  # saturated


def test_counters_of_two_writers_and_of_a_stream(spark, tmp_path):
    pair = [Counters(spark, str(tmp_path / "c")) for _ in range(2)]
    for i, c in enumerate(pair):
        c.add("s", {"n": i + 1})
    threads = [threading.Thread(target=c.flush) for c in pair]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert told(pair[0]) == {("s", "n"): 3}
    spark.range(40).write.parquet(str(tmp_path / "in"))
    counters = pair[0]
    listener = counters.listen()
    try:
        stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
        query = counters.observed(stream, "stream", rows=F.count("*")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        for _ in range(100):
            if counters.seen:
                break
            threading.Event().wait(0.1)
    finally:
        spark.streams.removeListener(listener)
    counters.flush()
    assert told(pair[1])["stream", "rows"] == 40
