"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

# AQE does the run-time work: it sizes shuffle partitions, picks broadcast joins from
# measured sizes and splits skewed join partitions, also where that costs one more shuffle.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Call sites of single column expressions help debugging only and slow down plan building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "crewline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_watched: list[list[tuple[SparkSession, str]]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Delete the shared folders that are taken within the block when it ends, well or not."""
    _watched.append([])
    try:
        yield
    finally:
        for spark, path in _watched.pop():
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    A machine-local folder is taken only in local mode, where the setting is usually absent.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = tempfile.mkdtemp(prefix="crewline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if _watched:
        _watched[-1].append((spark, path))
    return path
