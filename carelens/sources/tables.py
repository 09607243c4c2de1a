"""The fact table and summary tables: Parquet by default, JDBC when given connection options.

A location is a path (Parquet), a catalog table name, or a ``dict`` of Spark JDBC options.
For JDBC reads pass ``partitionColumn``/``lowerBound``/``upperBound``/
``numPartitions`` so the scan runs as parallel range queries instead of
one task.

A summary folder holds one ``version=N`` folder per update.  A version is complete
once Spark's committer has marked it; readers take the newest complete one, so they
see an update whole or not at all, and a writer that dies leaves the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carelens.operators.load import read_target
from carelens.operators.summaries import SCOPE_KEYS, with_scope_keys
from carelens.session import STORED
from carelens.sources.files import file_system, remove

Location = str | dict
# complete versions that stay: readers that started before an update still have theirs
KEPT_VERSIONS = 3


def read_fact(spark: SparkSession, location: Location) -> DataFrame:
    if isinstance(location, dict):
        return spark.read.format("jdbc").options(**location).load()
    return read_target(spark, location)


def versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(number, complete) of the versions of a summary folder, in order."""
    where, fs = file_system(spark, path)
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()]
    numbers = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return [(n, fs.exists(file_system(spark, f"{path}/version={n}/_SUCCESS")[0])) for n in numbers]


def read_summary(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of a summary; None if there is none.  A folder without versions is read as it is."""
    path = path.rstrip("/")
    found = versions(spark, path)
    complete = [n for n, done in found if done]
    if complete:
        return spark.read.parquet(f"{path}/version={complete[-1]}")
    where, fs = file_system(spark, path)
    return spark.read.parquet(path) if not found and fs.exists(where) else None


def write_summary(summary: DataFrame, location: Location) -> None:
    """Replace a summary table.  Parquet rows get keys of the scope columns, are clustered
    by them so that row-group statistics prune scoped reads, and go to a version of their own;
    JDBC targets are truncated, not dropped, so their indexes and column types survive."""
    if isinstance(location, dict):
        (summary.write.format("jdbc").options(**location).option("truncate", "true")
         .mode("overwrite").save())
        return
    spark, path = summary.sparkSession, location.rstrip("/")
    found = versions(spark, path)
    (with_scope_keys(summary).sortWithinPartitions(*SCOPE_KEYS.values()).write.options(**STORED)
     .parquet(f"{path}/version={found[-1][0] + 1 if found else 1}"))
    done = [n for n, complete in versions(spark, path) if complete]
    for n, complete in found:
        if n not in done[-KEPT_VERSIONS:]:  # old ones, and what dead writers left
            remove(spark, f"{path}/version={n}")
