"""The folder that executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir for checkpoints; where it is unset, in local mode only, a new local folder."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    found = context.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(found or tempfile.mkdtemp(prefix="chronolane-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, as a plain path that Python opens on driver and executors alike."""
    shared(spark)
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    scheme, _, rest = folder.rpartition(":")
    if scheme not in ("", "file"):
        raise RuntimeError("recordings are written to folders that Python can open; spark.checkpoint.dir names another kind")
    return f"/{rest.strip('/')}/{name}-{uuid.uuid4().hex}"
