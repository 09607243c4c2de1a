"""Quality counters of one load (one row, eight bigint counters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

COUNTERS = [
    "input_rows", "clean_rows", "inserted_rows", "exact_duplicate_rows", "discarded_core_missing_rows",
    "discarded_redacted_facility_rows", "invalid_numeric_values", "code_description_mismatches",
]


def quality_summary(collapsed: DataFrame, inserted_rows: Column | int | None = None) -> DataFrame:
    """Counters from the collapsed records of ``clean.collapse_duplicates``.

    Fates are tested in order redacted -> duplicate -> core-missing -> clean,
    so ``input = redacted + duplicates + core_missing + clean``.  Mismatches
    count every non-redacted input row; invalid numerics count every row.
    ``inserted_rows`` defaults to ``clean_rows`` (a first load into an empty
    target).
    """
    red = F.col("_redacted")
    kept = ~red
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    s = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0)).cast("long")
    counts = collapsed.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).cast("long").alias("input_rows"),
        n(kept & ~F.col("_core_missing")).alias("clean_rows"),
        s(kept, F.col("_copies") - 1).alias("exact_duplicate_rows"),
        n(kept & F.col("_core_missing")).alias("discarded_core_missing_rows"),
        s(red, F.col("_copies")).alias("discarded_redacted_facility_rows"),
        F.coalesce(F.sum("_invalid"), F.lit(0)).cast("long").alias("invalid_numeric_values"),
        s(kept, F.col("_mismatch")).alias("code_description_mismatches"),
    )
    if inserted_rows is None:
        inserted = F.col("clean_rows")
    elif isinstance(inserted_rows, Column):
        inserted = inserted_rows
    else:
        inserted = F.lit(inserted_rows)
    return counts.withColumn("inserted_rows", inserted.cast("long")).select(*COUNTERS)
