"""Distributed global row numbering.

``row_number() OVER (ORDER BY k)`` without a partition runs in one task.  Here
the rows are range-partitioned and sorted on ``k`` across the cluster, each
row is tagged with its partition and position, the tagged rows are written
under the checkpoint folder (so re-execution cannot move a row; as compressed
columns, a fraction of what an RDD checkpoint takes), and each partition's
start offset comes from a table with one row per partition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from carelens.functions.sizing import broadcast_bounded
from carelens.session import STORED, checkpoint_dir, file_by_file, shuffles_removed

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | position
MAX_PARTITIONS = 1_000_000


# rows that one task sorts, about
ROWS_PER_TASK = 200_000


def tasks_for(rows: int, least: int = 1) -> int:
    """Tasks for about ``rows`` rows: their number grows with the rows, what one of them holds does not."""
    return max(-(-rows // ROWS_PER_TASK), least)


def sort_rows(df: DataFrame, order: list[Column | str], tasks: int) -> DataFrame:
    """``df`` sorted over the cluster, in ``tasks`` tasks; rows for one task are left to the session's sort."""
    if tasks == 1:
        return df.orderBy(*order)
    return df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)


def number_rows(df: DataFrame, order: list[Column | str], name: str, start: int = 1, tasks: int | None = None,
                dealt: bool = False) -> DataFrame:
    """Add ``name`` = 1-based (or ``start``-based) position of each row in ``order``.

    ``order`` must be a total order for the result to be deterministic.  ``tasks`` (see ``tasks_for``) sort the
    rows; left to the session, a fixed number of tasks hold more each, the more rows there are.  Rows that are
    ``dealt`` already, by ranges of ``order``, are sorted where they are, and each task's rows are read by one task again.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/carelens-numbered-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        ((df.sortWithinPartitions(*order) if dealt else sort_rows(df, order, tasks) if tasks else df.orderBy(*order))
         .withColumn("_part", F.spark_partition_id())
         .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
         .write.options(**STORED, **({"maxRecordsPerFile": 2 * ROWS_PER_TASK} if dealt else {})).parquet(folder))
    tagged, read = spark.read.parquet(folder), (file_by_file(spark) if dealt else spark).read.parquet(folder)
    # One row per partition (bounded by the partition count); checked before broadcasting.
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        broadcast_bounded(offsets, MAX_PARTITIONS).join(read, "_part")  # in the session of the offsets
        .withColumn(name, (F.col("_off") + F.col("_pos") + start).cast("long"))
        .drop("_part", "_pos", "_off")
    )
