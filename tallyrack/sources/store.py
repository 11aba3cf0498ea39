"""Where tables that a query writes for itself are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; an own one only where unset."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        _own = _own or tempfile.mkdtemp(prefix="tallyrack-")
        base = f"file://{_own}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
