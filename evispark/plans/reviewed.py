"""Reviewed changes of a table of files: prepared, looked at, applied as one commit, undone as another one.

A change is staged first: its rows, the hash of each file before and after, and a plan hash over all of them are written
beside the table, and errors that it would bring are counted. Applying names the plan hash; it is refused unless the
table still has the digest that the plan was made on. What makes it valid is one numbered commit, so that of two writers
one wins, and a crash leaves the old table or the new one. The commit also holds the receipt: applying a plan again gives
the receipt of the first time. Undoing commits the parts of the state before it. The table's digest is that of a tree
(``operators.tree_digest``), brought up to date by changed paths.

Defined cases: an empty folder is an empty table; files that change to what they are take no part; removing what is not
there is refused, as are a path that repeats in one change, a plan that has expired or is blocked, and a wrong hash.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import QueryError
from ..operators import delta, tree_digest
from ..sources.commits import Commits
from .checkpoints import cut

ROW = "path string, text string, content_hash string, there boolean, at bigint"
CHANGE = "path string, text string, before_hash string, after_hash string"
#: Seconds for which a prepared change can be applied.
LIFETIME = 900
LEVELS = 3


@dataclass(frozen=True)
class Plan:
    """What a prepared change is: to be looked at, and named when it is applied."""

    operation_id: str
    plan_hash: str
    base_digest: str
    new_digest: str
    n_files: int
    n_new_errors: int
    expires_at: float

    @property
    def blocked(self) -> bool:
        return self.n_new_errors > 0


class ReviewedTable:
    """A table of files (path, text) under reviewed changes. ``errors`` gives rows (path, code, message, line) of a table's errors."""

    def __init__(self, spark: SparkSession, folder: str, errors: Callable[[DataFrame], DataFrame] | None = None, levels: int = LEVELS):
        self.spark, self.commits, self.errors, self.levels = spark, Commits(spark, folder), errors, levels

    def _at(self, name: str) -> str:
        return f"{self.commits.folder}/{name}"

    def _rows(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], "path string, text string, content_hash string")
        rows = self.spark.read.schema(ROW).parquet(*[self._at(f"{p}/rows") for p in parts])
        if len(parts) > 1:
            rows = rows.groupBy("path").agg(F.max_by(F.struct("text", "content_hash", "there"), "at").alias("x")).select("path", "x.*")
        return rows.where("there").select("path", "text", "content_hash")

    def load(self) -> DataFrame:
        return self._rows(self.commits.latest()[1].get("parts", []))

    def _tree(self, body: dict) -> DataFrame:
        if body.get("tree"):
            return self.spark.read.parquet(self._at(f"{body['tree']}/tree"))
        return tree_digest.tree(self.load().limit(0), F.col("path"), F.col("content_hash"), self.levels)

    def digest(self) -> str:
        return tree_digest.root(self._tree(self.commits.latest()[1]))

    def prepare(self, changes: DataFrame) -> Plan:
        """Stages ``changes`` (path, text: null removes the file)."""
        number, body = self.commits.latest()
        now = self._rows(body.get("parts", []))
        asked = cut(changes.select("path", "text", F.sha2(F.col("text").cast("binary"), 256).alias("after_hash")))
        if not asked.groupBy("path").count().where("count > 1").isEmpty():
            raise QueryError("INVALID_INPUT", "a path repeats")
        met = asked.join(now.select("path", F.col("content_hash").alias("before_hash")), "path", "left")
        if not met.where("after_hash is null and before_hash is null").isEmpty():
            raise QueryError("NOT_FOUND", "a file to be removed is not there")
        met = met.where(~F.col("before_hash").eqNullSafe(F.col("after_hash")))
        operation = f"op-{uuid.uuid4().hex}"
        met.select("path", "text", "before_hash", "after_hash").write.parquet(self._at(f"{operation}/changes"))
        staged = self.spark.read.schema(CHANGE).parquet(self._at(f"{operation}/changes"))
        self._stage(operation, staged, number + 1)
        # a tree over the changes: its root is a hash of all of them, whatever their order
        both = F.concat_ws(">", F.coalesce("before_hash", F.lit("")), F.coalesce("after_hash", F.lit("")))
        plan_hash = tree_digest.root(tree_digest.tree(staged, F.col("path"), both, self.levels))
        old = cut(self._tree(body))
        gone = staged.where("before_hash is not null").select("path", F.col("before_hash").alias("content_hash"))
        come = staged.where("after_hash is not null").select("path", F.col("after_hash").alias("content_hash"))
        tree = tree_digest.replaced(old, tree_digest.updated(old, gone, come, levels=self.levels))
        tree.write.parquet(self._at(f"{operation}/tree"))
        new_errors = 0
        if self.errors is not None:
            after = self._rows([*body.get("parts", []), operation])
            new_errors = delta.surplus(self.errors(after), self.errors(now), ["path", "code", "message"], ["line"]).count()
        plan = Plan(operation, plan_hash, tree_digest.root(old), tree_digest.root(self.spark.read.parquet(self._at(f"{operation}/tree"))), staged.count(), new_errors, time.time() + LIFETIME)
        self.spark.createDataFrame([tuple(vars(plan).values())], "operation_id string, plan_hash string, base_digest string, new_digest string, n_files bigint, n_new_errors bigint, expires_at double").coalesce(1).write.parquet(self._at(f"{operation}/plan"))
        return plan

    def _stage(self, operation: str, staged: DataFrame, at: int) -> None:
        rows = staged.select("path", "text", F.col("after_hash").alias("content_hash"), F.col("after_hash").isNotNull().alias("there"), F.lit(at).cast("long").alias("at"))
        rows.write.mode("overwrite").parquet(self._at(f"{operation}/rows"))

    def preview(self, operation: str) -> DataFrame:
        """(path, text, before_hash, after_hash) of a prepared change."""
        return self.spark.read.schema(CHANGE).parquet(self._at(f"{operation}/changes"))

    def apply(self, operation: str, plan_hash: str) -> dict:
        """The receipt of a change that is now, or was before, applied."""
        number, body = self.commits.latest()
        receipts = body.get("receipts", [])
        if done := next((r for r in receipts if r["operation_id"] == operation), None):
            return done
        if operation not in self.commits.names("(op-[0-9a-f]+)"):
            raise QueryError("NOT_FOUND", f"no change {operation}")
        plan = Plan(**self.spark.read.parquet(self._at(f"{operation}/plan")).first().asDict())
        if plan.plan_hash != plan_hash:
            raise QueryError("INVALID_INPUT", "that is not the hash of the plan")
        if plan.blocked:
            raise QueryError("MUTATION_BLOCKED", f"{plan.n_new_errors} new errors")
        if plan.expires_at < time.time():
            raise QueryError("STALE_WORKSPACE", "the plan has expired")
        if tree_digest.root(self._tree(body)) != plan.base_digest:
            raise QueryError("STALE_WORKSPACE", "the table is no longer what the plan was made on")
        if number and self.spark.read.schema(ROW).parquet(self._at(f"{operation}/rows")).where(F.col("at") != number + 1).limit(1).count():
            self._stage(operation, self.preview(operation), number + 1)  # the same table, some commits later
        receipt = {"operation_id": operation, "kind": "apply", "plan_hash": plan_hash, "base_digest": plan.base_digest, "new_digest": plan.new_digest, "n_files": plan.n_files}
        self.commits.create(number, {"parts": [*body.get("parts", []), operation], "tree": operation, "before": body.get("parts", []), "before_tree": body.get("tree"), "receipts": [*receipts, receipt]})
        return receipt

    def undo(self) -> dict:
        """Brings back the table before the last applied change, as a commit of its own."""
        number, body = self.commits.latest()
        if not number or body["before"] is None:
            raise QueryError("NOT_FOUND", "there is no change to be undone")
        last = body["receipts"][-1]
        receipt = {"operation_id": f"undo-{uuid.uuid4().hex}", "kind": "undo", "plan_hash": last["plan_hash"], "base_digest": last["new_digest"], "new_digest": last["base_digest"], "n_files": last["n_files"]}
        self.commits.create(number, {"parts": body["before"], "tree": body["before_tree"], "before": None, "before_tree": None, "receipts": [*body["receipts"], receipt]})
        return receipt

    def receipts(self) -> DataFrame:
        """All receipts in order, as a table."""
        rows = [(i, *r.values()) for i, r in enumerate(self.commits.latest()[1].get("receipts", []))]
        return self.spark.createDataFrame(rows, "place int, operation_id string, kind string, plan_hash string, base_digest string, new_digest string, n_files bigint")
