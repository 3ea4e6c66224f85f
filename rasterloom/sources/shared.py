"""Scratch folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; only where it is unset and Spark runs in one process
    (tests) a temporary folder takes its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='rasterloom-')}")
        folder = _own[0]
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
