"""MinHash near-duplicates with sequential Bayesian verification.

1. Words are lower-cased (A-Z), cut at ASCII white space; a document's set holds
   its distinct runs of ``shingle`` words (a shorter document is one run).
   Documents with equal sets form a class, represented by the smallest doc_id.
2. Signatures are cut into bands; representatives that share a band are
   candidates.  The number of bands follows from ``miss``, the chance that a
   pair at the threshold shares none.
3. A candidate pair's signatures are compared in batches.  After each one the
   pair goes if the posterior probability (uniform prior) that its similarity
   reaches the threshold is below ``miss``.
4. Survivors are verified on their whole sets (64-bit hashes of the runs).

A band shared by many documents is not expanded into all pairs.  Each bucket's
members are first compared with one hub, twice with different hubs, and linked
components are merged; pairs inside a component need no test.  For what is left
in buckets that more than one component shares, signatures travel to the
bucket; its tasks compare all pairs across components and emit, instead of
pairs, one link from each component to the smallest that it may belong to.  The
sets of each such group of components then meet, and pairs across components
are compared again and verified until no two of them link.  Buckets of more than
``most`` documents are dealt into pairs of blocks by their signatures, and groups
by the size of their sets, so that sets are copied only where they would not fit.

Null and empty texts have no set and link with nothing; null doc_ids are
reported alone, without a component; a doc_id that repeats is one document, its
set that of the row with the smallest fingerprint; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from carelens.llm.links import components
from carelens.llm.shared import (batch, by_group, carried, carry, cut, dealt, from_text, mix, pick, stage_memo,
                                 window_hashes, word_hashes)

BATCH = 20


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``shingle`` words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    return np.unique(window_hashes(word_hashes(words), min(shingle, len(words)) or 1))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:n] | np.uint64(1))[:, None], x[n:][:, None]


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima of linear functions of the hashes, high 32 bits."""
    a, b = _functions(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 1024):
        low = np.minimum(low, (a * hashes[lo:lo + 1024] + b).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def band_count(similarity: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` values so that a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def least_matches(n: int, similarity: float, miss: float) -> int:
    """Fewest matches among ``n`` compared values with P(similarity >= threshold | matches) >= ``miss``."""
    for m in range(n + 1):
        # posterior Beta(m + 1, n - m + 1): its upper tail is a binomial sum
        if sum(math.comb(n + 1, k) * similarity**k * (1 - similarity)**(n + 1 - k) for k in range(m + 1)) >= miss:
            return m
    return n


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    grid = sig.reshape(-1, rows).astype(np.uint64)
    code = np.arange(len(grid), dtype=np.uint64) + np.uint64(1)
    for r in range(rows):
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + grid[:, r])
    return code.astype(np.int64)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = 5, miss: float = 1e-6,
                    most: int = 4096, heavy: int = 8_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Two documents link if 100 * intersection >= percent * union of their sets.
    """
    bands = band_count(percent / 100, rows, miss)
    size = bands * rows

    def describe(texts):
        sets = [shingle_set(t, shingle) for t in texts]
        with np.errstate(over="ignore"):
            return [list(map(len, sets)), [int(np.bitwise_xor.reduce(s).astype(np.int64)) if len(s) else 0 for s in sets],
                    [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets],
                    [_bands(signature(s, size), rows) if len(s) else [] for s in sets]]

    def detail(texts):
        sets = [shingle_set(t, shingle) for t in texts]
        return [[signature(s, size).astype("<u4").tobytes() for s in sets], [s.astype("<u8").tobytes() for s in sets]]

    texts = pick(docs, doc_id="long", text="string")
    found = cut(from_text(texts, "n_shingles long, x long, s long, bands array<bigint>", describe))
    key = ["n_shingles", "x", "s"]
    known = (found.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("k"))
             .select("doc_id", *[f"k.{c}" for c in key]))
    classes = known.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("id"))
    # one row per class and band, of bands with two classes at least
    banded = (found.join(classes, key).where("doc_id = id").dropDuplicates(["id"])
              .select("id", F.explode("bands").alias("bucket")))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"),
                                          F.min(F.struct(F.xxhash64("id", "bucket"), "id")).alias("any"))
    buckets = cut(banded.join(shared.where("n > 1"), "bucket").select("bucket", "id", "low", F.col("any.id").alias("any")))

    wanted = buckets.select(F.col("id").alias("doc_id")).distinct()
    sets = from_text(texts.join(wanted, "doc_id", "left_semi"), "sig binary, hashes binary", detail)
    # a doc_id that repeats: the row whose set is the class's
    sets = cut(sets.groupBy("doc_id").agg(F.min_by(F.struct("sig", "hashes"), F.octet_length("hashes")).alias("d"))
               .select(F.col("doc_id").alias("id"), "d.sig", "d.hashes"))

    pairs = buckets.select(F.col("low").alias("u"), F.col("id").alias("v"))
    tested = cut(_ordered(pairs))
    links = cut(verified(tested, sets, percent, size, miss))
    part = _shared_by_components(buckets, links)
    pairs = _ordered(part.select(F.col("any").alias("u"), F.col("id").alias("v")))
    links = links.union(cut(verified(pairs.join(tested, ["a", "b"], "left_anti"), sets, percent, size, miss)))
    part = _shared_by_components(buckets, links)
    links = links.union(_across(part, sets, percent, size, miss, most, heavy))

    whole = components(links).withColumnRenamed("id", "rep")
    rep = classes.withColumnRenamed("id", "rep")
    result = (known.join(rep, key, "left").join(whole, "rep", "left")
              .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")))
    result = result.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = found.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"),
                                                    F.lit(True).alias("kept"))
    return result.unionByName(nameless)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b of pairs (u, v)."""
    return pairs.where("u != v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def _shared_by_components(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """``buckets`` with each id's component, of the buckets that hold more than one."""
    part = cut(buckets.join(components(links), "id", "left")
               .withColumn("component", F.coalesce("component", "id")))
    ends = part.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    return part.join(ends.where("c0 != c1").select("bucket"), "bucket", "left_semi")


def _stops(size: int, percent: int, miss: float) -> list[tuple[int, int, int]]:
    """(start, stop, matches needed up to stop) of each batch of signature values."""
    ends = [*range(BATCH, size, BATCH), size]
    return [(a, b, least_matches(b, percent / 100, miss)) for a, b in zip([0, *ends], ends)]


class _Joined:
    """The components of a group's rows, merged step by step; each set is named by its smallest component."""

    def __init__(self, component: np.ndarray):
        self.names, self.of = np.unique(component, return_inverse=True)
        self.root = np.arange(len(self.names))

    def roots(self, rows) -> np.ndarray:
        return self.root[self.of[rows]]

    def join(self, x: int, y: int) -> None:
        x, y = sorted((int(x), int(y)))
        self.root[self.root == y] = x


def surviving(sig: np.ndarray, joined: _Joined, mine: np.ndarray, across: bool, stops) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows) of different components that no batch prunes, a row at a time.

    What the caller joins meanwhile is not compared any more.  ``across``: only pairs of different blocks
    (those inside one belong to another task).
    """
    for i in range(len(sig) - 1):
        apart = joined.roots(slice(i + 1, None)) != joined.roots(i)
        if across:
            apart &= mine[i + 1:] != mine[i]
        rest = np.flatnonzero(apart) + i + 1
        matches = np.zeros(len(rest), np.int64)
        for start, stop, need in stops:
            matches += (sig[rest, start:stop] == sig[i, start:stop]).sum(axis=1)
            alive = matches >= need
            rest, matches = rest[alive], matches[alive]
            if not len(rest):
                break
        if len(rest):
            yield i, rest


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _across(part: DataFrame, sets: DataFrame, percent: int, size: int, miss: float, most: int, heavy: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, enough of them to connect what links."""
    stops = _stops(size, percent, miss)

    def rows_of(t: pa.Table):
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(t.num_rows, size)
        across = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        joined = _Joined(t.column("component").to_numpy())
        return joined, surviving(sig, joined, t.column("mine").to_numpy(), across, stops)

    def maybe(t: pa.Table):
        joined, found = rows_of(t)
        for i, rest in found:
            for other in np.unique(joined.roots(rest)).tolist():
                joined.join(joined.roots(i), other)
        moved = np.flatnonzero(joined.root != np.arange(len(joined.root)))
        return joined.names[moved], joined.names[joined.root[moved]]

    def confirm(t: pa.Table):
        joined, found = rows_of(t)
        sets = [np.frombuffer(h.as_buffer(), "<u8") for h in t.column("hashes")]
        sizes = np.array([len(x) for x in sets], np.int64)
        starts = np.cumsum(sizes) - sizes
        hashes, place = np.unique(np.concatenate(sets), return_inverse=True)
        mine = np.zeros(len(hashes), np.int64)  # which hashes the row at hand has
        links = []
        for row, others in found:
            spot = place[starts[row]:starts[row] + sizes[row]]
            mine[spot] = 1
            for some in np.split(others, np.flatnonzero(np.diff(np.cumsum(sizes[others]) // 1_000_000)) + 1):
                ends = np.cumsum(sizes[some])
                at = np.repeat(starts[some] - (ends - sizes[some]), sizes[some]) + np.arange(ends[-1])
                both = np.add.reduceat(mine[place[at]], ends - sizes[some])
                for k in some[100 * both >= percent * (sizes[row] + sizes[some] - both)].tolist():
                    x, y = joined.roots(row), joined.roots(k)
                    if x != y:
                        joined.join(x, y)
                        links.append((joined.names[joined.of[row]], joined.names[joined.of[k]]))
            mine[spot] = 0
        return list(zip(*links)) if links else ([], [])

    keys = ["bucket", "lo", "hi"]
    # ids are dealt first; signatures and sets join the blocks
    blocks = dealt(part.select("bucket", "id", "component"), "bucket", most)
    groups = components(by_group(blocks.join(sets.select("id", "sig"), "id"), keys, maybe, "a long, b long"))
    groups = groups.select(F.col("id").alias("component"), F.col("component").alias("bucket"))
    members = part.select("id", "component").distinct().join(groups, "component")
    members = members.join(sets.select("id", F.octet_length("hashes").alias("bytes")), "id")
    blocks = dealt(members, "bucket", most, "bytes", heavy).drop("bytes")
    return cut(by_group(blocks.join(sets, "id"), keys, confirm, "a long, b long"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int, size: int, miss: float) -> DataFrame:
    """The pairs (a, b) that link: signatures compared in batches, then survivors' whole sets."""
    spec = "a long, b long"

    def prune(batches):
        stage_memo("begun", object)
        for b in batches:
            if not b.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(-1, size) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for start, stop, need in _stops(size, percent, miss):
                matches[alive] += (one[alive, start:stop] == two[alive, start:stop]).sum(axis=1)
                alive = alive[matches[alive] >= need]
            yield batch(spec, [b.column("a").take(alive), b.column("b").take(alive)])

    def confirm(batches):
        stage_memo("begun", object)
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("hashes_a").to_pylist(), b.column("hashes_b").to_pylist())):
                if _linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent):
                    keep.append(i)
            yield batch(spec, [b.column("a").take(pa.array(keep, pa.int64())), b.column("b").take(pa.array(keep, pa.int64()))])

    def beside(rows, column):
        for side in ("a", "b"):
            rows = rows.join(sets.select(F.col("id").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        return rows

    survivors = cut(beside(pairs, "sig").mapInArrow(prune, spec))
    return beside(survivors, "hashes").mapInArrow(confirm, spec)


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, unchanged: that of the smallest doc_id.

    Each distinct text of a doc_id that repeats is a document of its own, and so is each without a doc_id;
    these come last.  Of rows equal in doc_id and text one stays.  Texts without a word are no copies.
    """
    rows = carry(docs, doc_id="long", text="string").withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    repeated = cut(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id"))
    if repeated.isEmpty():
        rows = rows.withColumn("key", F.col("doc_id"))
    else:
        several = repeated.where("doc_id is not null")
        odd = rows.join(several, "doc_id", "left_semi").union(rows.where("doc_id is null").select("doc_id", "text", "row", "hash"))
        odd = odd.dropDuplicates(["doc_id", "hash"])
        firsts = odd.where("doc_id is not null").groupBy("doc_id").agg(F.min("hash").alias("hash")).withColumn("key", F.col("doc_id"))
        high = 1 << 62  # above any doc_id
        later = F.xxhash64("doc_id", "hash").bitwiseAND(F.lit(high - 1)).bitwiseOR(F.lit(high))
        odd = odd.join(firsts, ["doc_id", "hash"], "left").withColumn("key", F.coalesce("key", later))
        plain = rows.where("doc_id is not null").join(several, "doc_id", "left_anti").withColumn("key", F.col("doc_id"))
        rows = plain.unionByName(odd)
    found = near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"), shingle, percent).withColumnRenamed("doc_id", "key")
    if not repeated.isEmpty():  # the smallest key need not have the smallest doc_id
        found = found.join(odd.select("key", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("order")), "key", "left")
        found = found.withColumn("order", F.coalesce("order", "key"))
        best = found.groupBy("component_id").agg(F.min(F.struct("order", "key")).alias("best"))
        found = found.join(best, "component_id").withColumn("kept", F.col("best.key") == F.col("key"))
    gone = found.where(~F.col("kept")).select("key")
    return carried(rows.join(gone, "key", "left_anti"), docs)
