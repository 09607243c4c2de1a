"""What each filter of a chain removes, in every order, by a retracting stream.

Five filters judge whole texts (words: maximal runs of anything but ASCII white
space; case matters).  A text fails

* A  with fewer than 50 words,
* B  if 100 * distinct words < 65 * words,
* C  if 100 * characters A-Z > 5 * code points,
* D  if it holds any of ``#$%&*|``,
* E  if a row with a smaller doc_id has the same text, wherever it is.

All files are read once, as a fixed number of micro-batches of a stream that
ends when they are through.  State is keyed by the text (128 bits of its SHA-256):
the smallest doc_id seen and how many rows of each part hold it.  The states of
about ``TEXTS`` texts, dealt by their hashes, are kept and updated together; how
many such buckets there are follows from the number of rows.  A row enters its part's
counter of failure masks at once, as a copy (E) unless its doc_id is the smallest
so far.  When a smaller doc_id arrives, the rows counted before as first are
retracted from their mask and added to the mask with E.  The sum of all changes
is the same whatever the order of files.  Each batch's changes are summed by part and
written to a folder of its own, replaced as a whole if the batch runs again, so
a lost executor or a restarted batch counts nothing twice.  State is kept by the
session's state store (about 80 bytes a text; the RocksDB provider keeps it on
disk instead of the executors' memory).  Rows of one text are
combined inside each task before they are dealt to its state, so a text that
makes up a third of the table is a few rows per task.

A part's 32 counters then give all 120 orders: a fixed table says what each
mask means to each step of each order.

Null texts count as empty and a null part as an empty name.  Rows without a doc_id
are no copies and make none; rows that share text and smallest doc_id are all
first; a doc_id with several labels has a label if any row says so.  An empty
table gives an empty result.  Columns are taken by exact name; others are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from carelens.llm.shared import cut, pick, prepare
from carelens.session import checkpoint_dir

FILTERS = "ABCDE"
COPY = 16  # the mask of filter E
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CHANGES = "part string, mask int, good int, toxic int, n long"
_STATE = "texts string"
TEXTS = 512
_STREAMING = {
    "spark.sql.caseSensitive": "true",  # columns by exact name, so that others cannot clash
}


def failures(text: Column) -> Column:
    """Mask of the filters A to D (bits 1, 2, 4, 8) that a text, not null, fails."""
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = [n < 50, 100 * different.cast("long") < 65 * n.cast("long"),
             100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def combined(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows of one text, part and labels as one: the smallest doc_id, rows that have it, rows above it."""
    keys = ["bucket", "key", "mask", "part", "good", "toxic"]

    def flush(held):
        rows = pa.Table.from_batches(held)
        null = rows.filter(rows["doc_id"].is_null())
        rows = rows.filter(rows["doc_id"].is_valid())
        rows = rows.group_by([*keys, "doc_id"]).aggregate([([], "count_all")])
        low = rows.group_by(keys).aggregate([("doc_id", "min"), ("count_all", "sum")])
        first = rows.join(low.select([*keys, "doc_id_min"]).rename_columns([*keys, "doc_id"]), [*keys, "doc_id"], join_type="right outer")
        first = first.select([*keys, "count_all"]).rename_columns([*keys, "at_low"])
        low = low.join(first, keys)
        above = pa.compute.subtract(low["count_all_sum"], low["at_low"])
        names = [*keys, "low", "at_low", "above", "named"]
        out = pa.table([*(low[k] for k in keys), low["doc_id_min"], low["at_low"], above, pa.array([True] * low.num_rows, pa.bool_())],
                       names=names)
        null = null.group_by(keys).aggregate([([], "count_all")])
        zero = pa.array([0] * null.num_rows, pa.int64())
        null = pa.table([*(null[k] for k in keys), zero, null["count_all"], zero, pa.array([False] * null.num_rows, pa.bool_())], names=names)
        return pa.concat_tables([out, null.cast(out.schema)]).combine_chunks().to_batches()

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= most:
            yield from flush(held)
            held, size = [], 0
    if size:
        yield from flush(held)


def arrive(rows: Iterator[tuple], low: int | None, held: Counter) -> tuple[int | None, Counter, Counter]:
    """State (smallest doc_id, rows that have it) and changes to the counters after ``rows`` of one text."""
    changes = Counter()
    for mask, part, good, toxic, at, at_low, above in rows:
        kind = part, good, toxic
        changes[kind, mask | COPY] += above
        if at is None:
            changes[kind, mask] += at_low
            continue
        if low is None or at < low:
            for earlier, n in held.items():
                changes[earlier, mask] -= n
                changes[earlier, mask | COPY] += n
            low, held = at, Counter()
        if at == low:
            held[kind] += at_low
        changes[kind, mask if at == low else mask | COPY] += at_low
    return low, held, changes


def _update(bucket, frames, state):
    """Changes to the counters by new rows of a bucket of texts: (part, mask, good, toxic, n)."""
    texts = json.loads(state.get[0]) if state.exists else {}
    arrived = {}
    for f in frames:
        for key, mask, part, good, toxic, low, at_low, above, named in zip(*(f[c].tolist() for c in (
                "key", "mask", "part", "good", "toxic", "low", "at_low", "above", "named"))):
            arrived.setdefault(key, []).append((mask, part, good, toxic, low if named else None, at_low, above))
    total = Counter()
    for key, rows in arrived.items():
        low, held = texts.get(key, (None, []))
        low, held, changes = arrive(iter(rows), low, Counter({(p, g, t): n for p, g, t, n in held}))
        if low is not None:
            texts[key] = low, [[*kind, n] for kind, n in held.items()]
        total.update(changes)
    state.update((json.dumps(texts),))
    yield pd.DataFrame([(*kind, mask, n) for (kind, mask), n in total.items() if n], columns=["part", "good", "toxic", "mask", "n"]
                       ).astype({"good": "int32", "toxic": "int32", "mask": "int32", "n": "int64"})[["part", "mask", "good", "toxic", "n"]]


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings while a stream runs; its files are read with the session's own."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counters(spark: SparkSession, path: str, labels: DataFrame, part: str = "source", batches: int = 4) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail.

    ``path`` is a Parquet file or folder of (doc_id, text, ``part``).  Its files
    are dealt to ``batches`` micro-batches.
    """
    prepare(spark)
    folder = f"{checkpoint_dir(spark)}/filter-audit-{uuid.uuid4().hex}"
    marks = pick(labels, doc_id="long", quality="double", toxic="double").where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = cut(marks.withColumn("spread", F.lit(0)))
    spark.createDataFrame([], _CHANGES).write.parquet(f"{folder}/changes/batch=-1")

    def write(changes: DataFrame, number: int) -> None:
        (changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
         .write.mode("overwrite").parquet(f"{folder}/changes/batch={number}"))

    with _settings(spark, _STREAMING):
        table = spark.read.parquet(path)
        kinds = {f.name: f.dataType for f in table.schema.fields}
        schema = T.StructType([T.StructField(c, kinds[c]) for c in ("doc_id", "text", part)])
        files = -(-len(table.inputFiles()) // batches) or 1
        buckets = table.count() // TEXTS + 1  # from the files' footers
        # the last letter as a pattern: a path that may be one file is then not taken for a folder of partitions;
        # no file is too old to count
        docs = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("maxFileAge", "36500d")
                .parquet(f"{path[:-1]}[{path[-1]}]"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                           F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
        rows = rows.select("doc_id", "part", F.substring(F.sha2("text", 256), 1, 32).alias("key"), failures(F.col("text")).alias("mask"))
        # rows without a doc_id find no label; spread, they do not meet in one task
        rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("key"), F.lit(1024))).otherwise(0).cast("int"))
        rows = rows.join(marks, ["doc_id", "spread"], "left").select(
            F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "mask", "part",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")], "doc_id")
        rows = rows.mapInArrow(combined, "bucket long, key string, mask int, part string, good int, toxic int, low long, at_low long, above long, named boolean")
        changes = rows.groupBy("bucket").applyInPandasWithState(_update, _CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)
        stream = (changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress")
                  .trigger(availableNow=True).start())
        stream.awaitTermination()
    written = spark.read.schema(f"{_CHANGES}, batch int").parquet(f"{folder}/changes")
    total = written.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    total = cut(total)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return total


def order_steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, mask of the step's filter, mask of the filters before it) of every order."""
    return [("".join(FILTERS[i] for i in order), k + 1, 1 << order[k], sum(1 << i for i in order[:k]))
            for order in permutations(range(len(FILTERS))) for k in range(len(order))]


def audit(spark: SparkSession, path: str, labels: DataFrame, part: str = "source", batches: int = 4) -> DataFrame:
    """What every step of every order keeps and removes in each part, and its filter's Shapley sum.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), one
    row per part, order and step.
    """
    steps = spark.createDataFrame(order_steps(), "filter_order string, step int, bit int, earlier int")
    steps = steps.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))))
    fails, before = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    # among all orders, each of the k filters that a document fails comes first equally often
    steps = steps.select("filter_order", "step", "mask", (~fails & ~before).alias("stays"), (fails & ~before).alias("goes"),
                         (fails & before).alias("again"), (F.col("mask") == F.col("bit")).alias("alone"),
                         F.when(fails, (F.lit(120) / F.bit_count("mask")).cast("long")).otherwise(0).alias("orders"))
    rows = counters(spark, path, labels, part, batches).repartition("part").join(F.broadcast(steps), "mask")

    def total(what, when):
        return F.sum(F.when(F.col(when), F.col(what)).otherwise(0)).cast("long")

    return rows.groupBy("part", "filter_order", "step").agg(
        total("n", "stays").alias("kept"), total("n", "goes").alias("removed"), total("n", "again").alias("redundant"),
        total("n", "alone").alias("unique_fails"), total("good", "goes").alias("good_lost"),
        total("toxic", "goes").alias("toxic_lost"), F.sum(F.col("n") * F.col("orders")).cast("long").alias("shapley"))
