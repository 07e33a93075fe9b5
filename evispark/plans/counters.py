"""Counters of what queries do, observed while they run and kept as a table.

``observed`` attaches aggregates to a table; whatever query then runs over it counts as it goes, with no pass of its own.
``flush`` writes what has been counted since as one numbered commit; ``table`` adds the commits up. Totals saturate at
MOST, so that no counter ever overflows or leaks how large something is beyond that. Streams are counted by a listener, batch
by batch.

Defined cases: a table that no query has run over counts nothing (flush does not wait for it, and may be called again); a
query that fails is not counted; a null count is 0; counters of one name in one scope add up.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.scalar import saturated
from ..sources.commits import Commits

MOST = 1_000_000
#: Milliseconds for which events of ended queries are waited for.
WAIT = 30_000
PREFIX = "counters of "


class Counters:
    def __init__(self, spark: SparkSession, folder: str, most: int = MOST):
        self.spark, self.commits, self.most = spark, Commits(spark, folder), most
        self.open: list[tuple[str, Observation]] = []
        self.seen: list[tuple[str, str, int]] = []
        self.lock = threading.Lock()

    def observed(self, rows: DataFrame, scope: str, /, **counts: Column) -> DataFrame:
        """``rows``; when a query runs over it, ``counts`` (aggregates) are counted in ``scope``."""
        exprs = [F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in counts.items()]
        if rows.isStreaming:
            return rows.observe(PREFIX + scope, *exprs)
        seen = Observation(f"{PREFIX}{scope} {uuid.uuid4().hex}")
        self.open.append((scope, seen))
        return rows.observe(seen, *exprs)

    def add(self, scope: str, counts: dict[str, int]) -> None:
        with self.lock:
            self.seen += [(scope, name, int(n)) for name, n in counts.items()]

    def listen(self) -> StreamingQueryListener:
        """A listener, registered, that counts the batches of observed streams."""
        counters = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:  # noqa: N802
                pass

            def onQueryProgress(self, event) -> None:  # noqa: N802
                for name, row in event.progress.observedMetrics.items():
                    if name.startswith(PREFIX):
                        counters.add(name.removeprefix(PREFIX), row.asDict())

            def onQueryIdle(self, event) -> None:  # noqa: N802
                pass

            def onQueryTerminated(self, event) -> None:  # noqa: N802
                pass

        listener = Listener()
        self.spark.streams.addListener(listener)
        return listener

    def flush(self) -> int:
        """Commits what was counted since the last flush; the number of counters."""
        self.spark._jsc.sc().listenerBus().waitUntilEmpty(WAIT)  # queries that have ended are told of behind their end
        waiting = []
        for scope, seen in self.open:
            if seen._jo is not None and seen._jo.future().isCompleted():
                self.add(scope, seen.get)
            else:
                waiting.append((scope, seen))
        self.open = waiting
        with self.lock:
            rows, self.seen = self.seen, []
        if rows:
            while True:
                number, body = self.commits.latest()
                total = {(s, n): c for s, n, c in body.get("counters", [])}
                for s, n, c in rows:
                    total[s, n] = min(total.get((s, n), 0) + c, self.most)
                try:
                    self.commits.create(number, {"counters": [[s, n, c] for (s, n), c in sorted(total.items())]})
                    break
                except Exception as e:
                    if "CONFLICT" not in str(e):
                        raise  # somebody else has flushed: add to theirs
        return len(rows)

    def table(self) -> DataFrame:
        """(scope, name, n): all counters, saturated."""
        rows = [tuple(x) for x in self.commits.latest()[1].get("counters", [])]
        found = self.spark.createDataFrame(rows, "scope string, name string, n bigint")
        return found.groupBy("scope", "name").agg(saturated(F.sum("n"), self.most).alias("n"))
