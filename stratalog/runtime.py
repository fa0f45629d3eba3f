"""Session helpers: shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .model import QueryError


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; a cluster
    without a shared folder is refused, because a lost executor would take its
    machine-local files with it.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named is None:
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if conf is None:
            if not sc.master.startswith("local"):
                raise QueryError("set spark.checkpoint.dir to a shared folder")
            conf = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(conf)
        named = sc.getCheckpointDir()
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` out once and read it back: cuts lineage and pins random values."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

