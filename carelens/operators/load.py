"""Incremental fact load: only records whose hash is not in the target yet.

The source system inserts while ignoring duplicate keys; here the stored
hashes that the load repeats are found first (a semi join whose build side is
the load, so a small load is broadcast and the fact is not shuffled), and the
load's records without them are appended.  Both sides are unique on the hash,
and SHA-256 keys spread evenly over shuffle partitions, so no join has a hot
key.  Re-running a load appends nothing.

Appended rows carry ``load_id``, one more than the largest in the target.
Summaries follow it to fold each load once; it does not depend on any clock.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from carelens.schema import fact_schema


def new_records(clean: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Clean rows whose hash is not in ``existing`` (all of them when there is no target)."""
    if existing is None:
        return clean
    stored = existing.select("source_row_hash").join(clean.select("source_row_hash"), "source_row_hash", "left_semi")
    return clean.join(stored, "source_row_hash", "left_anti").select(*clean.columns)


# Buckets of a fact created as a catalog table.  At 100 TB this gives ~25 GB per bucket
# spread over many files (every load appends files to each bucket).
DEFAULT_BUCKETS = 4096


def is_table_name(target: str) -> bool:
    """A catalog identifier (``db.fact``) rather than a path."""
    return "/" not in target and "://" not in target and "\\" not in target


def _empty_fact(spark: SparkSession) -> DataFrame:
    """No rows, which the planner knows: a first load then joins, and shuffles, nothing."""
    return spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fact_schema()])


def read_target(spark: SparkSession, target: str) -> DataFrame:
    """The fact at ``target`` (path or catalog table); an absent target is an empty fact."""
    if is_table_name(target):
        if spark.catalog.tableExists(target):
            return spark.table(target)
        return _empty_fact(spark)
    try:
        return spark.read.schema(fact_schema()).parquet(target)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return _empty_fact(spark)
        raise


def append_new(spark: SparkSession, clean: DataFrame, target: str, partition_by: list[str] | None = None,
               buckets: int = DEFAULT_BUCKETS) -> int:
    """Append the new records of ``clean`` to the fact at ``target``; return how many were appended.

    ``target`` is a Parquet path or a catalog table name.  A table target is
    created bucketed (and sorted) by ``source_row_hash``: later loads then
    read the existing fact already partitioned on the join key, and only the
    new records are shuffled.  ``clean`` should be materialised by the caller,
    since both joins read it.  The appended rows are counted by the write.
    """
    existing = read_target(spark, target)
    # a column maximum: Parquet answers it from the footers
    load_id = (existing.agg(F.max("load_id")).first()[0] or 0) + 1
    appended = Observation()
    fresh = (new_records(clean, existing).withColumns({"created_at": F.current_timestamp(), "load_id": F.lit(load_id).cast("long")})
             .observe(appended, F.count(F.lit(1)).alias("rows")))
    if is_table_name(target):
        if spark.catalog.tableExists(target):
            fresh.select(*spark.table(target).columns).write.insertInto(target)
        else:
            writer = fresh.write.format("parquet").bucketBy(buckets, "source_row_hash").sortBy("source_row_hash")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.saveAsTable(target)
        spark.catalog.refreshTable(target)
        return appended.get["rows"]
    writer = fresh.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return appended.get["rows"]
