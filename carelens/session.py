"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import threading
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job wants; applied only where neither the cluster nor the
# caller has set the key.
DEFAULTS: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The cleaning projection has ~40 aliased columns; inferring constraints
    # through it grows combinatorially when such a plan is joined.
    "spark.sql.constraintPropagation.enabled": "false",
    # HotSpot does not JIT methods over 8000 bytes of bytecode; the fused
    # cleaning projection exceeds that, so let Spark split it instead of
    # running one huge interpreted method (documented setting for HotSpot).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, app_name: str = "carelens",
                  conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in DEFAULTS.items():
        if not given.contains(key) and key not in (conf or {}):
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("WARN")
    return spark


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# codec of intermediate results: they take half of the disk that the default takes
STORED = {"compression": "zstd"}
_lock, _within, _before = threading.Lock(), Counter(), {}


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions inside delete their shuffle files as they end; else those stay until the driver collects its garbage.

    For results that are written: what reads them needs no shuffle of the action that made them.  Threads may share it.
    """
    key = id(spark)
    with _lock:
        if not _within[key]:
            _before[key] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _within[key] += 1
    try:
        yield
    finally:
        with _lock:
            _within[key] -= 1
            if not _within[key]:
                del _within[key]
                before = _before.pop(key)
                if before is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, before)


def file_by_file(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` whose scans give each file a task of its own, where they would pack many into one."""
    other = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        other.conf.set(key, "128m")
    return other


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    A cluster must name a folder every executor can reach; only a local-mode
    session (tests, laptops) gets a private temporary one when it is unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="carelens-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path
