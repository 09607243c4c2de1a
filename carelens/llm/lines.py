"""Line dedup by a segment-partition edit join.

Two lines are near-duplicates if their edit distance is at most ``edits``.  If
the shorter is split into ``edits`` + 1 segments, one of them stands unchanged
in the other, near its old place:

1. Every distinct line indexes its segments under (its length, segment number,
   hash) and probes, for each length that a partner can have, the substrings
   that a segment can have become.
2. Index and probe keys are joined.  A 64-bit parity of the lines' character
   pairs (one edit changes four bits at most) is compared inside the join, so a
   segment shared by very many lines yields only pairs that may be close.
3. Candidates are verified with a banded bit-parallel edit distance, after their
   common ends are cut.

Linked lines form classes; equal lines are one member however often they occur.
In a class that occurs in ``least_docs`` documents at least, every occurrence
but the first (by doc_id, then place) is removed.

Lines are cut at line feeds and compared without surrounding blanks.  Those
under ``min_chars`` characters skip the edit join: with ``short`` equal ones
form a class, else they are never removed.  Blank lines always stay.  Null and
empty texts stay as they are, a null doc_id comes after all others, rows that
repeat a doc_id count as one document for ``least_docs`` (those without one by
their texts) and are told apart by their texts' hashes (equal rows keep or lose
the same lines), an empty table gives an empty result.  A line is named by its
64-bit hash.

A row goes whole if cutting its lines would take ``most_cut`` of its characters
or more, so a copy leaves no fragment; the others keep their first lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from carelens.llm.links import components
from carelens.llm.shared import batch, carried, carry, cut, groups_of, mix, powers, prepare

BLANKS = " \t\r\x0b\x0c"
NO_ID = (1 << 63) - 1


class Hashed:
    """Hashes of any substrings of some lines, from prefix sums over their characters."""

    def __init__(self, lines: list[str]):
        self.sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
        self.starts = np.cumsum(self.sizes) - self.sizes
        power, self.inverse = powers(1 << max(21, len(chars).bit_length()))
        code = mix(chars.astype(np.uint64) + np.uint64(1))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:len(chars)])])
        # parity of character pairs, those that end a line and begin the next left out
        pairs = mix(code[:-1] * np.uint64(3) + code[1:]) >> np.uint64(58)
        bits = np.concatenate([np.uint64(1) << pairs, np.zeros(1, np.uint64)])[:len(chars)]
        bits[(self.starts + self.sizes - 1)[self.sizes > 0]] = 0
        self.parity = np.bitwise_xor.reduceat(bits, np.minimum(self.starts, len(bits) - 1)) if len(bits) else \
            np.zeros(len(lines), np.uint64)
        self.parity[self.sizes == 0] = 0

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        a = self.starts + start
        return (self.sums[a + size] - self.sums[a]) * self.inverse[a]


def segment(length: np.ndarray, number: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment ``number`` of ``count``: even, the longer ones last."""
    short, longer = length // count, length % count
    first_long = count - longer
    return number * short + np.maximum(number - first_long, 0), short + (number >= first_long)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of the substrings to probe.

    With i errors to the left of a matching segment at most and the rest to its
    right, shifts beyond both bounds are covered by another segment.
    """
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            right = edits - i
            out += [(less, i, s) for s in range(max(-i, less - right), min(i, less + right) + 1)]
    return out


def line_keys(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parity, index keys, probe keys) of lines longer than 2 * ``edits``."""
    text, count = Hashed(lines), edits + 1

    def key(length, number, start, size):
        code = text.of(start, size)
        return mix(mix(code + np.uint64(number + 1)) + length.astype(np.uint64)).astype(np.int64)

    index = [key(text.sizes, i, *segment(text.sizes, i, count)) for i in range(count)]
    probe = []
    for less, i, shift in probes(edits):
        length = text.sizes - less
        start, size = segment(length, i, count)
        inside = (start + shift >= 0) & (start + shift + size <= text.sizes)
        # a place outside the line matches no segment: its key is one of no length
        probe.append(np.where(inside, key(length, i, np.where(inside, start + shift, 0), np.where(inside, size, 0)), 0))
    return text.parity, np.stack(index, axis=1), np.stack(probe, axis=1)


def close(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Whether each pair's edit distance is at most ``edits``.

    Bit d of a word stands for the diagonal d - ``edits`` of the band; word e
    holds the diagonals reachable with e edits.  All pairs advance together, one
    character of the right side at a time, and leave when no bit is left.
    """
    n, band = len(left), 2 * edits + 1
    ends, rests = [], []
    for x, y in zip(left, right):
        x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in (x, y))
        k = min(len(x), len(y))
        differ = x[:k] != y[:k]
        head = int(differ.argmax()) if differ.any() else k
        x, y = x[head:], y[head:]
        k -= head
        differ = x[len(x) - k:][::-1] != y[len(y) - k:][::-1]
        tail = int(differ.argmax()) if differ.any() else k
        rests.append((x[:len(x) - tail], y[:len(y) - tail]))
        ends.append((len(x) - tail, len(y) - tail))
    ends = np.array(ends, np.int64).reshape(n, 2)
    result = np.zeros(n, bool)
    alive = np.flatnonzero(np.abs(ends[:, 0] - ends[:, 1]) <= edits)
    alive = alive[np.argsort(ends[alive, 1], kind="stable")]
    for lo in range(0, len(alive), 4096):
        some = alive[lo:lo + 4096]
        width = int(ends[some].max(initial=0))
        if width * len(some) > 1 << 23:  # long rests: fewer at a time
            for r in some:
                result[r] = _walk([rests[r]], ends[[r]], edits, band)[0]
        else:
            result[some] = _walk([rests[r] for r in some], ends[some], edits, band)
    return result


def _walk(rests: list[tuple[np.ndarray, np.ndarray]], ends: np.ndarray, edits: int, band: int) -> np.ndarray:
    n, width = len(rests), int(ends.max(initial=0))
    # characters are numbered from 2; 0 and 1 pad the sides and match nothing
    x, y = np.zeros((n, width + band), np.int64), np.ones((n, width + 1), np.int64)
    for i, (a, b) in enumerate(rests):
        x[i, edits:edits + len(a)], y[i, :len(b)] = a.astype(np.int64) + 2, b.astype(np.int64) + 2
    full = (1 << band) - 1
    words = np.stack([np.full(n, sum(1 << (edits + d) for d in range(e + 1)), np.int64) for e in range(edits + 1)])
    result, rows = np.zeros(n, bool), np.arange(n)
    for j in range(width + 1):
        done = ends[rows, 1] == j
        if done.any():
            goal = edits + ends[rows, 0] - ends[rows, 1]
            result[rows[done]] = (words[edits, done] >> goal[done]) & 1 == 1
        stay = ~done & (words[edits] != 0)
        if not stay.all():
            rows, words = rows[stay], words[:, stay]
        if not len(rows):
            break
        match = np.zeros(len(rows), np.int64)
        for d in range(band):
            match |= (x[rows, j + d] == y[rows, j]).astype(np.int64) << d
        new = np.empty_like(words)
        new[0] = words[0] & match
        for e in range(1, edits + 1):
            # match; substitution; extra character on the right; extra character on the left
            new[e] = (words[e] & match | words[e - 1] | words[e - 1] >> 1 | new[e - 1] << 1) & full
        words = new
    return result


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, tie, at, id, line) of every line of ``min_chars`` characters or more."""
    doc = F.coalesce("doc_id", F.lit(NO_ID))
    rows = docs.select(doc.alias("doc"), F.xxhash64("text").alias("tie"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.withColumn("line", F.trim("line", F.lit(BLANKS))).where(F.length("line") >= min_chars)
    return rows.withColumn("id", F.xxhash64("line"))


def near_lines(lines: DataFrame, edits: int = 1) -> DataFrame:
    """(a, b): ids of the lines (id, line) whose edit distance is ``edits`` at most; equal lines share an id."""
    spec = "id long, parity long, index array<bigint>, probe array<bigint>"

    def describe(batches):
        seen: set[int] = set()  # saves repeats; forgetting some is harmless
        for b in batches:
            ids = b.column("id").to_pylist()
            new = {}
            for i, d in enumerate(ids):
                if d not in seen:
                    new.setdefault(d, i)
            if len(seen) > 200_000:
                seen.clear()
            seen.update(new)
            at = list(new.values())
            for first, some in groups_of(b.column("line").take(pa.array(at, pa.int64())).to_pylist()):
                parity, index, probe = line_keys(some, edits)
                yield batch(spec, [[ids[i] for i in at[first:first + len(some)]], parity.astype(np.int64), list(index), list(probe)])

    keyed = lines.select("id", "line").mapInArrow(describe, spec).dropDuplicates(["id"])
    keyed = cut(keyed)
    index = keyed.select("id", "parity", F.explode("index").alias("key"))
    probe = keyed.select("id", "parity", F.explode("probe").alias("key")).where("key != 0")
    near = F.bit_count(F.col("i.parity").bitwiseXOR(F.col("p.parity"))) <= 4 * edits
    pairs = (index.alias("i").join(probe.alias("p"), (F.col("i.key") == F.col("p.key")) & (F.col("i.id") != F.col("p.id")) & near)
             .select(F.least("i.id", "p.id").alias("a"), F.greatest("i.id", "p.id").alias("b")).distinct())
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = lines.select("id", "line").join(wanted, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))
    texts = cut(texts)
    spec2 = "a long, b long"

    def verify(batches):
        for b in batches:
            good = close(b.column("line_a").to_pylist(), b.column("line_b").to_pylist(), edits)
            at = pa.array(np.flatnonzero(good), pa.int64())
            yield batch(spec2, [b.column("a").take(at), b.column("b").take(at)])

    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("id").alias(side), F.col("line").alias(f"line_{side}")), side)
    return pairs.mapInArrow(verify, spec2)


def _places(docs: DataFrame, edits: int, min_chars: int, short: bool) -> DataFrame:
    """(doc, tie, at, line_class) of every line that can be removed."""
    if min_chars <= 2 * edits:
        raise ValueError("min_chars must be over twice the edits")
    lines = _lines(docs, 1 if short else min_chars)
    classes = components(near_lines(lines.where(F.length("line") >= min_chars), edits))
    return lines.select("doc", "tie", "at", "id").join(classes, "id", "left").select(
        "doc", "tie", "at", F.coalesce("component", "id").alias("line_class"))


def _firsts(places: DataFrame, least_docs: int) -> DataFrame:
    """(line_class, first) of the classes that lose lines."""
    # documents of a class, counted on (class, doc) rows that were combined before the shuffle
    per_doc = places.groupBy("line_class", "doc", F.when(F.col("doc") == NO_ID, F.col("tie"))).agg(
        F.min(F.struct("tie", "at")).alias("place"), F.count(F.lit(1)).alias("n"))
    firsts = per_doc.groupBy("line_class").agg(
        F.min(F.struct("doc", "place")).alias("first"), F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    return firsts.where((F.col("docs") >= least_docs) & (F.col("n") > 1)).select("line_class", "first")


def _repeats(places: DataFrame, least_docs: int) -> DataFrame:
    """(doc, tie, gone): places of the lines to remove from each text (null doc_ids as the largest long)."""
    own = F.struct("doc", F.struct("tie", "at").alias("place"))
    return (places.join(_firsts(places, least_docs), "line_class").where(own != F.col("first")).groupBy("doc", "tie")
            .agg(F.collect_set("at").alias("gone")))


def remove_repeats(docs: DataFrame, edits: int = 1, least_docs: int = 2, min_chars: int = 24,
                   drop_emptied: bool = False, short: bool = False, most_cut: float | None = None) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``.

    A text that loses every line becomes empty; ``drop_emptied`` drops the rows
    of texts that lost lines and have nothing but blanks left, ``most_cut`` those
    that lost that share of their characters.
    """
    prepare(docs.sparkSession)
    keyed = carry(docs, doc_id="long", text="string")
    rows = keyed.withColumns({"doc": F.coalesce("doc_id", F.lit(NO_ID)), "tie": F.xxhash64("text")})
    rows = rows.join(_repeats(_places(keyed, edits, min_chars, short), least_docs), ["doc", "tie"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")
    rows = rows.withColumn("left", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept))
    if drop_emptied:
        rows = rows.where(F.col("gone").isNull() | (F.trim("left", F.lit(BLANKS + "\n")) != ""))
    if most_cut is not None:
        rows = rows.where(F.col("gone").isNull() | (F.length("text") - F.length("left") < F.lit(most_cut) * F.length("text")))
    at = docs.columns.index("text")
    return carried(rows.select(F.col("row").withField(f"c{at}", F.col("left")).alias("row")), docs)
