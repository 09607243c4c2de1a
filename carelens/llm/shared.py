"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from carelens.session import checkpoint_dir

ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
         "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
         "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def prepare(spark: SparkSession) -> None:
    """Set the checkpoint folder and make this package importable on the executors, once per context."""
    checkpoint_dir(spark)
    sc = spark.sparkContext
    if getattr(sc, "_carelens_shipped", False):
        return
    import carelens
    root = os.path.dirname(os.path.abspath(carelens.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="carelens-py-"), "carelens_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("carelens", os.path.relpath(full, root)))
    sc.addPyFile(archive)  # Spark's own file server hands it to executors
    sc._carelens_shipped = True


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Select columns by exact name, cast to the given types.

    Columns are addressed by position, so extra columns whose names differ only
    in case, or repeat, cannot clash; the first exact match wins.
    """
    prepare(df.sparkSession)
    names = df.columns
    missing = [c for c in kinds if c not in names]
    if missing:
        raise ValueError(f"columns {missing} are not among {names}")
    return (df.toDF(*[f"c{i}" for i in range(len(names))])
            .select(*[F.col(f"c{names.index(c)}").cast(kind).alias(c) for c, kind in kinds.items()]))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder now; lost executors re-read it instead of recomputing."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id) -> F.Column:
    """True for the documents no classifier may learn from: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def batch(spec: str, columns: Iterable) -> pa.RecordBatch:
    """An Arrow batch of ``columns`` (lists or arrays), typed and named by a DDL-like ``spec``."""
    fields = [f.split() for f in spec.split(",")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=ARROW[kind]) for (_, kind), c in zip(fields, columns)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def groups_of(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Slices of ``texts`` (None as empty) of about ``most`` characters, each with its first index."""
    first, held, size = 0, [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def from_text(df: DataFrame, spec: str, fn, keep: tuple[str, ...] = ()) -> DataFrame:
    """Append the columns of ``spec``, computed by ``fn`` from slices of the ``text`` column.

    ``fn(texts)`` gets a list of texts (null as empty) and returns one list or
    array per column.  Other columns pass through untouched; ``text`` goes
    unless ``keep`` names it.
    """
    passed = [f for f in df.schema.fields if f.name != "text" or "text" in keep]
    schema = T.StructType([*passed, *T._parse_datatype_string(spec).fields])
    kinds = [f.split()[1] for f in spec.split(",")]
    names = schema.names

    def run(batches):
        stage_memo("begun", object)
        for b in batches:
            columns = [b.column(f.name) for f in passed]
            for first, texts in groups_of(b.column("text").to_pylist()):
                made = [a if isinstance(a, pa.Array) else pa.array(a, type=ARROW[k]) for k, a in zip(kinds, fn(texts))]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in columns), *made], names=names)

    return df.mapInArrow(run, schema)


def carry(df: DataFrame, **kinds: str) -> DataFrame:
    """``pick`` plus the whole row as struct ``row``, for operators that keep or drop rows."""
    prepare(df.sparkSession)
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(c)}").cast(kind).alias(c) for c, kind in kinds.items()],
                        F.struct("*").alias("row"))


def carried(df: DataFrame, like: DataFrame) -> DataFrame:
    """The rows of ``carry(like)`` that are left, with the columns of ``like``."""
    return df.select("row.*").toDF(*like.columns)


def dealt(rows: DataFrame, key: str, most: int, weight: str | None = None, heavy: int = 0) -> DataFrame:
    """Add (lo, hi, mine): groups of more than ``most`` rows become pairs of blocks.

    A row (with an ``id``) belongs to block ``mine`` of its group and goes to
    every pair (lo, hi) that its block is part of.  With ``weight``, a block has
    about ``heavy`` of that column's sum at most.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(weight or F.lit(0)).alias("w"))
    blocks = F.ceil(F.col("n") / most)
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.col("w") / heavy))
    large = sizes.select(key, blocks.cast("long").alias("blocks")).where("blocks > 1")
    rows = rows.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return rows.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")}).drop("other")


def by_group(df: DataFrame, keys: list[str], fn, spec: str) -> DataFrame:
    """``fn(table)`` of each group's rows (integer ``keys``, not null); it returns the columns of ``spec``.

    Groups arrive sorted, one is held at a time, and results leave in batches.
    """
    def run(batches):
        stage_memo("begun", object)
        held, current, made, size = [], None, [], 0
        for b in batches:
            columns = [b.column(k).to_numpy() for k in keys]
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            for a, z in zip(starts, starts[1:]):
                key = tuple(c[a] for c in columns)
                if held and key != current:
                    made.append(batch(spec, fn(pa.Table.from_batches(held))))
                    size += made[-1].num_rows
                    held = []
                    if size > 10_000 or len(made) > 1000:
                        yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                        made, size = [], 0
                current = key
                held.append(b.slice(a, z - a))
        if held:
            made.append(batch(spec, fn(pa.Table.from_batches(held))))
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, spec)


def ascii_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: ``bytes.split`` breaks on exactly those six bytes."""
    return text.encode("utf-8", "surrogatepass").split()


_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def folded_words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


_KEPT: dict = {}


def give_back() -> None:
    """Return freed memory to the system: workers outlive their stages, and Arrow and the C library keep what was freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def stage_memo(name, make):
    """An object that this worker keeps for the tasks of one stage; what earlier stages left is dropped first."""
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    gone = [k for k, (kept_for, _) in _KEPT.items() if kept_for != stage]
    for old in gone:
        del _KEPT[old]
    if gone:
        give_back()
    if name not in _KEPT:
        _KEPT[name] = stage, make()
    return _KEPT[name][1]


class WordHashes(dict):
    """word -> 64-bit hash, memoised; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return stage_memo("words", WordHashes).of(words)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers of a hash base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15

    def run(x):
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.cumprod(out)
    return run(np.uint64(base)), run(np.uint64(pow(base, -1, 1 << 64)))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


class Words:
    """Words of many byte strings at once: places in one buffer and 64-bit hashes.

    The strings' words must be parted by single spaces.  ``counts`` has the
    words of each string; word i is ``data[starts[i]:ends[i]]``.
    """

    def __init__(self, strings: list[bytes]):
        self.data = b"\n".join(strings)
        raw = np.frombuffer(self.data, np.uint8)
        power, inverse = powers(1 << max(21, len(raw).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[:len(raw)])])
        apart = np.flatnonzero((raw == 32) | (raw == 10))
        starts, ends = np.concatenate([[0], apart + 1]), np.concatenate([apart, [len(raw)]])
        full = ends > starts
        self.starts, self.ends = starts[full], ends[full]
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))
        edges = np.cumsum(np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings)))
        self.counts = np.diff(np.searchsorted(self.starts, edges), prepend=0)

    def windows(self, size: int) -> np.ndarray:
        """First words of all runs of ``size`` words that lie in one string."""
        ends = np.repeat(np.cumsum(self.counts), self.counts)
        at = np.arange(len(ends))
        return at[at + size <= ends]


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of each run of ``k`` consecutive word hashes (order matters)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * base + h[j:j + n]
    return mix(out)


def sample_labels(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most ``bound`` training rows (doc_id, label) of a label table.

    Held-out ids and null ids or labels go; a doc_id with several labels takes
    their rounded mean; the ``bound`` smallest id hashes are taken, so the
    choice depends on the ids alone.
    """
    rows = pick(labels, doc_id="long", **{column: "double"})
    return (rows.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
