"""Files and folders through the file system that Spark resolves a path on."""

from __future__ import annotations

import json
import os
import socket
import time
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system): the one Spark itself resolves the path on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of this library's own, if it is there."""
    where, fs = file_system(spark, path)
    fs.delete(where, True)


class TargetClaimed(RuntimeError):
    """Another load has claimed the target, or one that died has left its claim."""


def _create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file if there is none, in one step; False if there is one."""
    where, fs = file_system(spark, path)
    if fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then
        try:
            with open(where.toUri().getPath(), "x", encoding="utf-8") as f:
                f.write(text)
            return True
        except FileExistsError:
            return False
    try:
        out = fs.create(where, False)
    except Py4JJavaError:
        if fs.exists(where):
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


def _read(spark: SparkSession, path: str) -> str:
    where, fs = file_system(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def claim_path(spark: SparkSession, target: str, is_table: bool) -> str:
    """The claim on ``target``: beside a folder, or in the warehouse for a catalog table."""
    if is_table:
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_claim-{target}"
    parent, name = os.path.split(target.rstrip("/"))
    return f"{parent}/_claim-{name}"


@contextmanager
def claimed(spark: SparkSession, path: str, clear: bool = False) -> Iterator[None]:
    """Hold the claim file at ``path``; ``TargetClaimed`` if it is there.

    The file is created without overwriting, so of two that try at once one
    fails.  It goes when the block ends, also by an error.  If the process dies
    it stays; ``clear`` then removes it first.
    """
    if clear:
        remove(spark, path)
    where, fs = file_system(spark, path)
    fs.mkdirs(where.getParent())
    mine = json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "application": spark.sparkContext.applicationId,
                       "since": time.strftime("%Y-%m-%dT%H:%M:%S%z")})
    if not _create_new(spark, path, mine):
        try:
            held = _read(spark, path)
        except Py4JJavaError:  # released meanwhile
            held = "gone by now"
        raise TargetClaimed(f"another load holds {path} ({held}); if that load is dead, clear its claim and start again")
    try:
        yield
    finally:
        remove(spark, path)
