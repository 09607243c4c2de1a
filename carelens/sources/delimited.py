"""Discharge CSV/TSV files -> raw source strings with provenance.

* Delimiter: tab for a ``.tsv`` suffix (any case), comma otherwise; header row;
  UTF-8 (a byte-order mark on the header is dropped with the header line).
* Every field is read as a string, by position, under an explicit schema: no
  inference pass.  Header names are read from the first line of each file and
  mapped through the fixed alias table; unknown headers are dropped, absent
  optional ones become NULL, missing mandatory ones raise ``ValueError``.
  Files that share a header layout are read by one scan.
* Null tokens are compared before trimming (`` NA `` stays text).
* Rows with more fields than the header are quarantined, short rows are
  padded with NULLs.  Detection reads the schema one column wider than the
  header plus Spark's corrupt-record column, which is null only for a row that
  fits the wider schema exactly and else holds the row's text.
* Files are read line by line, in splits.  A line with an odd number of quotes
  belongs to a record with a line break inside quotes (or holds a stray quote):
  what was read of its file is dropped, and that file is read again as whole
  records, in one task.  So only files with such lines are read twice.
* ``source_row_number`` is the record's ordinal among the kept records of its
  file plus 2 (line 1 is the header).  It is exact across any number of
  input splits: kept rows carry (file, split start, position among the kept
  rows), one small table holds each split's record counts and first positions;
  the running sum of the counts gives each split's first ordinal.
* A quarantined row's ``line`` is its ordinal among all records of its file, kept
  or not, plus 2, by a second running sum; blank lines do not count.
* Folders are listed and headers read through the file system that Spark
  resolves the path on, whatever its scheme.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from carelens.functions.sizing import broadcast_bounded
from carelens.functions.text import null_tokens_to_null
from carelens.schema import HEADER_ALIASES, NULL_TOKENS, RAW_COLUMNS, REQUIRED_HEADERS
from carelens.session import STORED, checkpoint_dir, shuffles_removed
from carelens.sources.files import file_system

_OVERFLOW, _CORRUPT = "_overflow", "_corrupt_record"
TAGS = ["_file", "_block", "_pos", "_line", "_fields", "_odd"]
# ``_block`` of a file that is read as whole records
WHOLE = -1
# lines that a quoted header may span
HEADER_LINES = 1000

# One row per input split (32 bytes: path hash, split start, first position,
# offset).  100 TB in 128 MB splits is ~800k rows, ~25 MB; beyond this bound
# the split table is sort-merge joined instead of broadcast.
MAX_BROADCAST_SPLITS = 2_000_000
# records of one file of an intermediate result
RECORDS_PER_FILE = 250_000


def delimiter_for(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


def read_header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Header fields of one file (BOM removed; quotes honoured, also around line breaks)."""
    where, fs = file_system(spark, path)
    stream = fs.open(where)
    lines = []
    try:
        java = spark._jvm.java
        reader = java.io.BufferedReader(java.io.InputStreamReader(stream, java.nio.charset.StandardCharsets.UTF_8))
        while (line := reader.readLine()) is not None:
            lines.append(line)
            if sum(x.count('"') for x in lines) % 2 == 0:
                break
            if len(lines) == HEADER_LINES:
                raise ValueError(f"header of {path} has no closing quote in {HEADER_LINES} lines")
    finally:
        stream.close()
    text = "\n".join(lines).lstrip("\ufeff")
    if not text:
        raise ValueError(f"empty source file: {path}")
    return next(csv.reader(io.StringIO(text), delimiter=sep))


def read_headers(spark: SparkSession, paths: list[str]) -> "OrderedDict[tuple, list[str]]":
    """Files by (delimiter, header); first lines are read by several threads at once."""
    def layout(path: str) -> tuple:
        sep = delimiter_for(path)
        return sep, tuple(read_header(spark, path, sep))

    layouts: "OrderedDict[tuple, list[str]]" = OrderedDict()
    with ThreadPoolExecutor(max_workers=16) as pool:
        for path, found in zip(paths, pool.map(layout, paths)):
            layouts.setdefault(found, []).append(path)
    return layouts


def column_positions(header: list[str]) -> dict[str, int]:
    """Fact column -> position of the first header that maps to it; validates mandatory headers."""
    positions: dict[str, int] = {}
    for i, name in enumerate(header):
        target = HEADER_ALIASES.get(name)
        if target is not None and target not in positions:
            positions[target] = i
    missing = sorted(set(REQUIRED_HEADERS) - set(positions))
    if missing:
        raise ValueError(f"no header for {', '.join(missing)} among {header}")
    return positions


def _scan(spark: SparkSession, paths: list[str], width: int, sep: str, multi_line: bool) -> DataFrame:
    return (spark.read.schema(csv_schema(width))
            .option("header", True).option("sep", sep).option("encoding", "UTF-8")
            .option("quote", '"').option("escape", '"')  # RFC 4180: a quote inside quotes is doubled
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
            .option("multiLine", multi_line)
            # a pruned parser does not see how many fields a line has
            .option("columnPruning", False)
            .csv(paths))


def _project(df: DataFrame, header: list[str], sep: str, whole: bool) -> DataFrame:
    """Positional fields -> source file name, the 33 raw columns (null tokens applied), ``_long``, split tags."""
    positions = column_positions(list(header))
    width, text = len(header), F.col(_CORRUPT)
    count = lambda where, what: F.length(where) - F.length(F.replace(where, F.lit(what), F.lit("")))
    # what stands between quotes separates nothing; few rows have so many separators that this must be looked at
    fields = F.when(text.isNull(), width + 1).otherwise(count(F.regexp_replace(text, '"[^"]*+"', ""), sep) + 1)
    many = F.when(count(text, sep) > width, fields > width).otherwise(False)
    long_row = F.col(_OVERFLOW).isNotNull() | text.isNull() | many
    odd = F.lit(False) if whole else F.coalesce(count(text, '"') % 2 == 1, F.lit(False))
    cols = [F.col("_metadata.file_name").alias("source_file_name")]
    for name in RAW_COLUMNS:
        if name in positions:
            cols.append(null_tokens_to_null(F.col(f"_c{positions[name]}"), NULL_TOKENS).alias(name))
        else:
            cols.append(F.lit(None).cast("string").alias(name))
    cols += [long_row.alias("_long"), F.when(long_row, fields).alias("_fields"), odd.alias("_odd"),
             F.col("_metadata.file_path").alias("_file"),
             (F.lit(WHOLE) if whole else F.col("_metadata.file_block_start")).cast("long").alias("_block")]
    return df.select(*cols)


def with_positions(untagged: DataFrame) -> DataFrame:
    """Add ``_line``, which counts the lines of a split, and ``_pos``, which counts the kept ones (null for the others)."""
    # a branch that is not taken does not advance the counter
    return untagged.withColumns({"_pos": F.when(~F.col("_long"), F.monotonically_increasing_id()),
                                 "_line": F.monotonically_increasing_id()})


def csv_schema(width: int) -> T.StructType:
    return T.StructType(
        [T.StructField(f"_c{i}", T.StringType()) for i in range(width)]
        + [T.StructField(_OVERFLOW, T.StringType()), T.StructField(_CORRUPT, T.StringType())])


def expand_paths(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Files to read, on any file system: a folder expands to its ``.csv``/``.tsv`` files in name order."""
    out: list[str] = []
    for p in [paths] if isinstance(paths, str) else list(paths):
        where, fs = file_system(spark, p)
        if not fs.exists(where):
            raise FileNotFoundError(f"no such source: {p}")
        if fs.getFileStatus(where).isDirectory():
            names = sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isFile())
            out += [f"{p.rstrip('/')}/{n}" for n in names
                    if n.lower().endswith((".csv", ".tsv")) and not n.startswith((".", "_"))]
        else:
            out.append(p)
    if not out:
        raise ValueError("no source files to read")
    return out


def read_tagged(spark: SparkSession, paths: str | list[str], multi_line: bool = False) -> DataFrame:
    """Raw records of one or more files with ``_long`` (quarantine flag) and position tags.

    Columns: ``source_file_name``, the 33 raw columns, ``_long`` and ``TAGS``.
    Lines are taken for records; those marked ``_odd`` show files for which
    this is wrong (see ``read_records``).  With ``multi_line``, and for files
    whose header has a line break, records are read whole, each file in one task.
    """
    layouts = read_headers(spark, expand_paths(spark, paths))
    frames = []
    for (sep, header), group in layouts.items():
        whole = multi_line or any("\n" in name for name in header)
        frames.append(with_positions(_project(_scan(spark, group, len(header), sep, whole), list(header), sep, whole)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def split_table(tagged: DataFrame) -> DataFrame:
    """One row per input split: its file, start, records, kept and quarantined ones, first positions, odd lines."""
    return tagged.groupBy(F.xxhash64("_file").alias("_fid"), "_file", "_block").agg(
        F.count_if(~F.col("_long")).alias("_n"), F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_lines"),
        F.min("_line").alias("_first_line"), F.count_if(F.col("_long")).alias("_quarantined"), F.max("_odd").alias("_odd"))


Save = Callable[[DataFrame, str], DataFrame]


def read_records(spark: SparkSession, paths: str | list[str], save: Save, prepare: Callable[[DataFrame], DataFrame] | None = None,
                 multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tagged records, split table) of the files, records with line breaks inside quotes included.

    ``save(df, name)`` writes an intermediate result and returns what was written;
    ``prepare`` is applied to tagged records, row by row, before they are written.
    Rows whose split is not in the split table belong to no record.
    """
    prepared, prepare = prepare is not None, prepare or (lambda df: df)
    rows = save(prepare(read_tagged(spark, paths, multi_line)), "lines")
    splits = save(split_table(rows), "splits")
    broken = [unquote(r[0]) for r in splits.where("_odd").select("_file").distinct().collect()]  # of the files listed above
    if not broken:
        return rows, splits
    # one task parses a file; what prepares its records then reads them in as many tasks as they need
    again = save(read_tagged(spark, broken, multi_line=True), "records")
    if prepared:
        again = save(prepare(again), "prepared-records")
    files = splits.where("_odd").select("_file").distinct()
    splits = save(splits.join(files, "_file", "left_anti").select(*splits.columns)
                  .unionByName(split_table(again)), "all-splits")
    return rows.unionByName(again), splits


def _numbered(rows: DataFrame, splits: DataFrame, counted: str, first: str, position: str, max_broadcast_splits: int) -> DataFrame:
    """``rows`` with ``_number``: ordinal + 2 in their file, by running sums over the split table."""
    collision = (splits.select("_fid", "_file").distinct().groupBy("_fid").count()
                 .where(F.col("count") > 1).limit(1).count() > 0)
    key = "_file" if collision else "_fid"
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(key, "_block", F.col(first).alias("_start"), F.coalesce(F.sum(counted).over(earlier), F.lit(0)).alias("_offset"))
    rows = rows.withColumn("_fid", F.xxhash64("_file")).join(broadcast_bounded(offsets, max_broadcast_splits), [key, "_block"])
    return rows.withColumn("_number", (F.col("_offset") + (F.col(position) - F.col("_start")) + 2).cast("long"))


def number_records(tagged: DataFrame, splits: DataFrame, max_broadcast_splits: int = MAX_BROADCAST_SPLITS) -> DataFrame:
    """Replace the position tags of kept records by ``source_row_number`` (ordinal in file + 2).

    Works on the reader's output or on anything derived from it row by row
    (e.g. the staged cleaning output) as long as the tags are carried along.
    Splits are keyed by a 64-bit hash of the file path so the broadcast split
    table is 32 bytes a row (~25 MB for the ~800k splits of 100 TB); if two
    paths ever share a hash, the path itself is used as the key instead.
    """
    rest = [c for c in tagged.columns if c not in ("source_file_name", "_long", *TAGS)]
    numbered = _numbered(tagged.where(~F.col("_long")), splits, "_n", "_first", "_pos", max_broadcast_splits)
    return numbered.select("source_file_name", F.col("_number").alias("source_row_number"), *rest)


def quarantined(tagged: DataFrame, splits: DataFrame, max_broadcast_splits: int = MAX_BROADCAST_SPLITS) -> DataFrame:
    """(source_file_name, line, fields) of the rows with more fields than their header."""
    rows = _numbered(tagged.where("_long"), splits, "_lines", "_first_line", "_line", max_broadcast_splits)
    return rows.select("source_file_name", F.col("_number").alias("line"), F.col("_fields").cast("int").alias("fields"))


def saver(spark: SparkSession, folder: str) -> Save:
    """Writes intermediate results under ``folder``."""
    def save(df: DataFrame, name: str) -> DataFrame:
        # a file written by one task is read again by many
        with shuffles_removed(spark):
            df.write.option("maxRecordsPerFile", RECORDS_PER_FILE).options(**STORED).parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")
    return save


def read_discharge_file(spark: SparkSession, paths: str | list[str], multi_line: bool = False) -> DataFrame:
    """Kept raw records with ``source_file_name`` and ``source_row_number``; the files are read at once."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/carelens-read-{uuid.uuid4().hex}"
    return number_records(*read_records(spark, paths, saver(spark, folder), multi_line=multi_line))
