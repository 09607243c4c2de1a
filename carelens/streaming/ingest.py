"""Continuous ingest of discharge files dropped into a landing folder.

A file stream lists new files (their paths only, no content); every
micro-batch hands its files to the batch ingest in ``foreachBatch``, which
reads each file's own header and maps columns by name, whatever their order or
delimiter.  The load skips records that are stored already, so a batch that is
replayed after a failure appends nothing twice.  Quality counters of every
batch are appended to a log table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from carelens.plans.jobs import ingest


def new_files(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of the paths of new ``.csv`` and ``.tsv`` files in ``landing_dir``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{csv,tsv,CSV,TSV}")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(landing_dir).select("path")


def start_ingest(spark: SparkSession, landing_dir: str, target: str, checkpoint_location: str,
                 quality_log: str, current_year: int | None = None, available_now: bool = False,
                 max_files_per_trigger: int | None = None, summary_dir: str | None = None,
                 clear_claim: bool = False) -> StreamingQuery:
    """Start the continuous ingest; ``available_now`` processes what is there and stops.

    With ``summary_dir`` every micro-batch also folds its new records into the
    summary tables there, so they stay current without rescanning the fact.
    ``clear_claim`` removes the claim that a stream which died has left on the
    target, before the first micro-batch.
    """
    claim = {"clear": clear_claim}

    def load_batch(batch: DataFrame, epoch_id: int) -> None:
        paths = sorted(r.path for r in batch.collect())  # one short row per new file
        if not paths:
            return
        counters = ingest(spark, paths, target, current_year, summary_dir=summary_dir, clear_claim=claim["clear"])
        claim["clear"] = False
        row = {"epoch_id": int(epoch_id), **counters}
        spark.createDataFrame([row]).withColumn("loaded_at", F.current_timestamp()) \
            .write.mode("append").parquet(quality_log)

    writer = (new_files(spark, landing_dir, max_files_per_trigger)
              .writeStream.foreachBatch(load_batch).option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
