"""The stream of a folder's changes against the folder, over restarts and limits."""

import os
import random

import pytest

from evispark.streaming import changes, feed


def put(folder, path, text):
    os.makedirs(os.path.dirname(folder / path) or folder, exist_ok=True)
    (folder / path).write_text(text)


def start(spark, tmp_path, **options):
    stream = changes.changes(spark, str(tmp_path / "src"), str(tmp_path / "journal"), **options)
    return stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()


def test_a_made_history_equals_its_fold(spark, tmp_path):
    folder, r = tmp_path / "src", random.Random(4)
    for d in ("a", "b/c", "node_modules/x", ".git"):
        os.makedirs(folder / d)
    want, seen = {}, []
    names = [f"{d}/f{i}.ts" for d in ("a", "b", "b/c") for i in range(6)]
    put(folder, "node_modules/x/never.ts", "x")
    put(folder, ".git/never", "x")
    query = start(spark, tmp_path)
    try:
        for turn in range(7):
            before = dict(want)
            for name in r.sample(names, 5):
                if name in want and r.random() < 0.4:
                    os.remove(folder / name)
                    del want[name]
                else:
                    want[name] = f"turn {turn} " + "x" * r.randrange(50)
                    put(folder, name, want[name])
            query.processAllAvailable()
            seen.append({(("added" if n not in before else "changed"), n, len(want[n])) for n in want if before.get(n) != want[n]} | {("removed", n, None) for n in before if n not in want})
            if turn == 3:  # a restart between two batches, with a change while nobody looks
                query.stop()
                put(folder, "late.ts", "late")
                want["late.ts"] = "late"
                seen.append({("added", "late.ts", 4)})
                query = start(spark, tmp_path)
                query.processAllAvailable()
    finally:
        query.stop()
    events = spark.read.schema(changes.SCHEMA).parquet(str(tmp_path / "out"))
    rows = events.collect()
    assert [{(e.kind, e.path, e.size) for e in rows if e.scan == n} for n in sorted({e.scan for e in rows})] == [s for s in seen if s]
    assert len(rows) == sum(map(len, seen))  # each event once
    assert {e.path: e.size for e in changes.standing(events).collect()} == {n: len(t) for n, t in want.items()}
    assert {p: s[0] for p, s in changes.scan(str(folder)).items()} == {n: len(t) for n, t in want.items()}
    # a burst of changes settles into the batches of the debounced feed
    settled = feed.debounced(events.selectExpr("'p' AS project", "ts", "path"), "project", "1 hour").collect()
    assert sum(b.n_events for b in settled) == len(rows)
    assert len(changes.Journal(str(tmp_path / "journal")).numbers()) <= 2  # what is committed is forgotten


def test_offsets_give_the_same_events_again(tmp_path):
    put(tmp_path / "src", "a.ts", "1")
    options = {"path": str(tmp_path / "src"), "journal": str(tmp_path / "journal")}
    reader = changes.ChangeReader(options)
    first = reader.latestOffset()
    put(tmp_path / "src", "b.ts", "22")
    second = reader.latestOffset()
    assert (first, second, reader.latestOffset()) == ({"scan": 1}, {"scan": 2}, {"scan": 2})
    told = lambda r, a, b: [e for p in r.partitions(a, b) for e in r.read(p)]
    once = told(reader, reader.initialOffset(), second)
    assert [e[2:] for e in once] == [("added", "a.ts", 1), ("added", "b.ts", 2)]
    assert told(changes.ChangeReader(options), {"scan": 0}, {"scan": 2}) == once
    reader.commit(first)
    assert told(changes.ChangeReader(options), first, second) == once[1:]


def test_watching_fails_closed(spark, tmp_path):
    folder = tmp_path / "src"
    put(folder, "a.ts", "1")
    query = start(spark, tmp_path, maxPaths=3)
    try:
        query.processAllAvailable()
        for i in range(4):
            put(folder, f"n{i}.ts", "x")
        with pytest.raises(Exception, match="WATCH_LIMIT: more than 3 paths"):
            query.processAllAvailable()
    finally:
        query.stop()
    for i in range(feed.DIRECTORIES_MAX):
        os.makedirs(folder / f"d{i}")
    with pytest.raises(ValueError, match="512 directories"):
        changes.scan(str(folder))
    assert len(changes.scan(str(folder), feed.DIRECTORIES_MAX + 1)) == 5
    assert changes.scan(str(tmp_path / "nowhere")) == {}
    for i in range(feed.PENDING_MAX + 1):
        put(folder, f"m{i}.ts", "x")
    reader = changes.ChangeReader({"path": str(folder), "journal": str(tmp_path / "other"), "maxDirectories": "600"})
    assert reader.latestOffset() == {"scan": 1}  # what stands at the start is no burst
    for i in range(feed.PENDING_MAX + 1):
        put(folder, f"m{i}.ts", "changed")
    with pytest.raises(ValueError, match="65 paths"):
        reader.latestOffset()
