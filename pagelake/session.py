"""Session construction and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings every job here relies on (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can see, as named by the cluster in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made and recorded, but only on a
    local master (tests); elsewhere executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def local_path(path: str) -> str:
    """Path for file calls on a shared mount that was named as a ``file:`` URI; other stores are refused."""
    if re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*:/", path):
        raise ValueError(f"file writers need a mounted folder, not {path}")
    return path.removeprefix("file://").removeprefix("file:")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Materialise ``df`` as parquet in the shared folder and read it back.

    Survives lost executors (unlike a local checkpoint) and lets several
    consumers share one computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
