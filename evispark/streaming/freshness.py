"""Freshness of a project as a state machine over status events: as a fold over a table, and as a stateful stream.

States: fresh, pending, stale, rebuilding, degraded. A failed component dominates until it recovers, and ``fresh`` is
only reached with complete evidence. An event that is not known degrades and says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# What a status keeps at most.
FILES, ERRORS, ERROR_CHARS = 64, 8, 512
FAILURES = ("index_failure", "watcher_failure")


@dataclass(frozen=True)
class Status:
    state: str = "pending"
    causes: tuple[str, ...] = ()
    pending: tuple[str, ...] = ()
    errors: tuple[str, ...] = ()
    index: str = "disabled"
    compiler: str = "ready"
    invalid: bool = False

    @property
    def failing(self) -> bool:
        return self.invalid or any(c in FAILURES for c in self.causes)


def _with(causes: tuple[str, ...], cause: str) -> tuple[str, ...]:
    return tuple(sorted({*causes, cause}))


def _recovered(s: Status, cause: str) -> Status:
    s = replace(s, causes=tuple(c for c in s.causes if c != cause))
    return replace(s, state="degraded" if s.failing else "pending")


def step(s: Status, event: str, evidence: bool = False, detail: str | None = None) -> Status:
    """The status after one event. ``evidence``: a complete snapshot with its time; ``detail``: a file, a cause or an error."""
    kept = "degraded" if s.state == "degraded" else None
    if event == "source_changed":
        files = tuple(sorted({*s.pending, *([detail] if detail else [])}))[:FILES]
        return replace(s, state=kept or "pending", causes=_with(s.causes, "source_change"), pending=files)
    if event == "config_changed":
        return replace(s, state=kept or "pending", causes=_with(s.causes, "config_change"))
    if event == "compiler_rebuild_started":
        return replace(s, state=kept or "rebuilding", causes=_with(s.causes, "compiler_rebuild"), compiler="rebuilding")
    if event == "sync_succeeded":
        if s.failing:
            return replace(s, state="degraded", compiler="ready")
        if not evidence:
            return replace(s, state="pending", compiler="ready")
        return replace(s, state="fresh", causes=(), pending=(), errors=(), compiler="ready")
    if event == "sync_failed":
        return replace(s, state="degraded" if s.failing else "stale", causes=_with(s.causes, detail or "source_change"), compiler="failed")
    if event == "stale_detected":
        return replace(s, state="degraded" if s.failing else "stale", causes=_with(s.causes, detail or "source_change"))
    if event in ("index_failed", "watcher_failed"):
        errors = (*s.errors, (detail or event)[:ERROR_CHARS])[-ERRORS:]
        return replace(s, state="degraded", causes=_with(s.causes, event.replace("_failed", "_failure")), errors=errors, index="failed" if event == "index_failed" else s.index)
    if event in ("index_recovered", "watcher_recovered"):
        return _recovered(s, event.replace("_recovered", "_failure"))
    if event == "component_recovered":
        return _recovered(s, detail or "")
    if event == "index_ready":
        return replace(s, index="ready")
    if event == "index_disabled":
        return replace(s, index="disabled", causes=tuple(c for c in s.causes if c != "index_failure"))
    return replace(s, state="degraded", invalid=True)


def fold(events: DataFrame, key: str) -> DataFrame:
    """The last status of each key from a table of (key, seq, event, evidence, detail): one row, state and causes.

    Only what the last events can still change is kept: the order-free parts are aggregates that combine before the
    shuffle, so that a key with very many events is never listed in one place.
    """
    # per event kind, the last sequence number says whether its cause still stands
    kinds = ("source_changed", "config_changed", "compiler_rebuild_started", "sync_succeeded", "sync_failed", "stale_detected", "index_failed", "watcher_failed", "index_recovered", "watcher_recovered", "index_disabled")
    last = {k: F.max(F.when(F.col("event") == k, F.col("seq"))).alias(f"last_{k}") for k in kinds}
    unknown = F.max(~F.col("event").isin([*kinds, "index_ready", "component_recovered"])).alias("invalid")
    proven = F.max(F.when((F.col("event") == "sync_succeeded") & F.col("evidence"), F.col("seq"))).alias("proven")
    moving = [*kinds[:6], "index_recovered", "watcher_recovered"]
    end = F.max_by("event", F.when(F.col("event").isin(moving), F.col("seq"))).alias("end")
    out = events.groupBy(key).agg(*last.values(), unknown, proven, end)
    at = lambda k: F.coalesce(F.col(f"last_{k}"), F.lit(-1))
    index = at("index_failed") > F.greatest(at("index_recovered"), at("index_disabled"))
    watcher = at("watcher_failed") > at("watcher_recovered")
    state = (
        F.when(F.col("invalid") | index | watcher, "degraded")
        .when(F.col("end").isin("sync_failed", "stale_detected"), "stale")
        .when(F.col("end") == "compiler_rebuild_started", "rebuilding")
        .when((F.col("end") == "sync_succeeded") & (F.col("proven") == F.col("last_sync_succeeded")), "fresh")
        .otherwise("pending")
    )
    return out.select(key, state.alias("state"), index.alias("index_failing"), watcher.alias("watcher_failing"))


class Machine(StatefulProcessor):
    """The same machine over a stream of (key, seq, event, evidence, detail), one status row for each batch of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "state string, causes string, pending string, errors string, index string, compiler string, invalid boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        split = lambda x: tuple(x.split("\n")) if x else ()
        s = Status()
        if self.status.exists():
            v = self.status.get()
            s = Status(v[0], split(v[1]), split(v[2]), split(v[3]), v[4], v[5], v[6])
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for event, evidence, detail in zip(events["event"], events["evidence"], events["detail"], strict=True):
            s = step(s, event, bool(evidence), None if pd.isna(detail) else detail)
        self.status.update((s.state, "\n".join(s.causes), "\n".join(s.pending), "\n".join(s.errors), s.index, s.compiler, s.invalid))
        yield pd.DataFrame({"key": [key[0]], "state": [s.state], "causes": [",".join(s.causes)]})

    def close(self) -> None:
        pass


def stream(events: DataFrame, key: str) -> DataFrame:
    """Status rows (key, state, causes) of a stream; needs the RocksDB state store."""
    return events.groupBy(key).transformWithStateInPandas(Machine(), outputStructType="key string, state string, causes string", outputMode="Update", timeMode="None")
