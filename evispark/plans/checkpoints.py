"""Lineage cuts for iterative plans, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset and the master is local, as in tests, a folder of this machine."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.gettempdir()}/evispark-{uuid.uuid4().hex}"
        context.setCheckpointDir(base)
    return (spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: later rounds read it, and survive a lost executor."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def laid(df: DataFrame) -> DataFrame:
    """``df`` written like cut(), for what is dealt out by keys and joined on them again and again.

    Later plans know how it is dealt and do not deal it again. Spark does not keep that of a plan which it may still adapt.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        # a plan is made once and kept: this one is not adapted
        return cut(df.select("*"))
    finally:
        conf.set(name, before)
