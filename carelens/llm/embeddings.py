"""Embedding near-duplicates by collision-counting projections.

Equal vectors form a class, represented by the smallest id.  Representatives
are projected on many random directions:

1. Signs of some projections place each vector into one bucket per table, with
   about ``occupancy`` vectors to a bucket; the number of tables follows from
   ``miss``, the chance that a pair at the threshold never shares a bucket.
   Counting collisions over whole sorted projections would cost the square of
   the table; inside buckets it does not.
2. Inside a bucket, each of ``projections`` further projections (one byte each)
   is sorted, and the vectors inside the window centred on each query collide
   with it.  A pair passes if it collides often enough; the count is set so that
   a pair at the threshold falls short with probability ``miss``.
3. Passing pairs join vectors to candidate groups.  Inside a group all vectors
   are compared by cosine in double precision, which verifies every passing
   pair without listing pairs: a task emits, for each vector, its number of
   links and one link to its group's smallest id.

A bucket or candidate group of more than ``most`` vectors is dealt into blocks,
and each pair of blocks is a task of its own, so no task holds more than two
blocks.

Null vectors, vectors with null or non-finite components and zero vectors link
with nothing; vectors of different lengths are not compared; null ids are left
out; an id that repeats counts once, with the vector of the smallest digest; an
empty table gives an empty result; other columns (labels too) are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from carelens.llm.links import components
from carelens.llm.shared import batch, by_group, cut, dealt, mix, pick

WIDTH = 2.0  # half a window, in standard deviations of a threshold pair's difference
STEPS = 10  # quantisation steps in half a window


def least_collisions(n: int, miss: float) -> int:
    """The count that a threshold pair reaches among ``n`` projections but with probability ``miss``."""
    p = math.erf(WIDTH / math.sqrt(2))
    tail = 0.0
    for c in range(n + 1):
        tail += math.comb(n, c) * p**c * (1 - p)**(n - c)
        if tail > miss:
            return c
    return n


def table_count(bits: int, cosine: float, miss: float) -> int:
    """Tables of ``bits`` signs so that a threshold pair shares no bucket with probability ``miss``."""
    together = (1 - math.acos(cosine) / math.pi)**bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-together))) if together < 1 else 1


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([dim, seed]).standard_normal((dim, n))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def smallest_linked(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id reachable from each row over a symmetric boolean matrix."""
    a, b = np.nonzero(linked)
    low = ids.copy()
    while len(a):
        before = low.copy()
        np.minimum.at(low, a, low[b])
        if (low == before).all():
            break
    return low


def colliding(sketch: np.ndarray, least: int) -> np.ndarray:
    """Pairs of rows that fall into each other's window on ``least`` columns at least."""
    n = len(sketch)
    counts = np.zeros((n, n), np.uint8)
    for values in sketch.T:
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        low = np.searchsorted(ranked, values - STEPS - 1, side="left")
        size = np.searchsorted(ranked, values + STEPS + 1, side="right") - low
        ends = np.cumsum(size)
        inside = order[np.repeat(low - (ends - size), size) + np.arange(ends[-1])]
        counts[np.repeat(np.arange(n), size), inside] += 1
    return counts >= least


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, projections: int = 64, miss: float = 1e-6,
                    occupancy: int = 128, most: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every id; links are pairs of cosine ``cosine`` or more."""
    spec = "vec_id long, dim int, code binary, unit binary"

    def describe(batches):
        for b in batches:
            ids, units, codes, dims = b.column("vec_id").to_pylist(), [], [], []
            for v in b.column("embedding").to_pylist():
                x = np.array([np.nan] if v is None else [np.nan if c is None else c for c in v], np.float64)
                top = np.abs(x).max(initial=0)
                good = len(x) > 0 and np.isfinite(top) and top > 0
                if good:
                    scaled = x / top  # no square overflows or vanishes
                    unit = scaled / np.sqrt(scaled @ scaled)
                units.append(unit.astype("<f8").tobytes() if good else None)
                codes.append(xxhash.xxh3_128_digest((x + 0.0).astype("<f8").tobytes()) if good else None)
                dims.append(len(x))
            yield batch(spec, [ids, dims, codes, units])

    rows = pick(vectors, vec_id="long", embedding="array<double>").where("vec_id is not null")
    rows = cut(rows.mapInArrow(describe, spec))
    known = rows.groupBy("vec_id").agg(F.min("code").alias("code"))
    classes = cut(known.where("code is not null").groupBy("code").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size")))
    reps = cut(rows.join(classes, "code").where("vec_id = id").dropDuplicates(["id"]).select("id", "size", "dim", "unit"))
    n = reps.count()
    bits = max(1, math.ceil(math.log2(max(2, n / occupancy))))
    tables, least = table_count(bits, cosine, miss), least_collisions(projections, miss)
    step = WIDTH * math.sqrt(2 - 2 * cosine) / STEPS
    spec = "id long, buckets array<bigint>, sketch binary"

    def place(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim), pa.int64())
                x = _matrix(b.column("unit").take(at))
                signs = (x @ _directions(dim, bits * tables, 1) > 0).reshape(len(x), tables, bits)
                code = np.tile(np.arange(tables, dtype=np.uint64) + np.uint64(int(dim) << 32), (len(x), 1))
                for j in range(bits):
                    code = mix(code * np.uint64(3) + signs[:, :, j].astype(np.uint64))
                sketch = np.clip(np.rint(x @ _directions(dim, projections, 2) / step) + 128, 0, 255).astype(np.uint8)
                yield batch(spec, [b.column("id").take(at), list(code.astype(np.int64)), [s.tobytes() for s in sketch]])

    placed = reps.mapInArrow(place, spec).select("id", "sketch", F.explode("buckets").alias("bucket"))

    def group(t: pa.Table):
        ids = t.column("id").to_numpy()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.int16)
        low = smallest_linked(colliding(sketch, least), ids)
        moved = low < ids
        return ids[moved], low[moved]

    candidates = components(by_group(dealt(placed, "bucket", most), ["bucket", "lo", "hi"], group, "a long, b long"))
    spec = "id long, links long, low long"

    def verify(t: pa.Table):
        ids, weight, mine = (t.column(c).to_numpy() for c in ("id", "size", "mine"))
        dims, units = t.column("dim").to_numpy(), t.column("unit")
        links, low = np.zeros(len(ids), np.int64), ids.copy()
        across = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = _matrix(units.take(pa.array(at, pa.int64())).combine_chunks())
            linked = x @ x.T >= cosine
            np.fill_diagonal(linked, False)
            if across:  # pairs inside a block belong to that block's own task
                linked &= mine[at][:, None] != mine[at][None, :]
            links[at] = linked @ weight[at]
            low[at] = smallest_linked(linked, ids[at])
        return ids, links, low

    inside = reps.join(candidates, "id")
    found = cut(by_group(dealt(inside, "component", most), ["component", "lo", "hi"], verify, spec))
    whole = components(found.where("low < id").select(F.col("id").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    result = (known.join(classes, "code", "left").join(links, "id", "left").join(whole, "id", "left")
              .select("vec_id", F.when(F.col("size").isNull(), F.lit(0)).otherwise(
                  F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
                  F.coalesce("component", "id", "vec_id").alias("component_id")))
    return result.withColumn("kept", F.col("vec_id") == F.col("component_id"))
