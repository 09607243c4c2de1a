"""Benchmark decontamination with a broadcast hash set of test n-grams.

Texts are normalised to words of letters, digits and non-ASCII characters with
A-Z lower-cased.  Every run of ``window`` words of a benchmark item (an item
with fewer words is one run) goes into a hash set that is broadcast; documents
are scanned once, a hash match is verified on the words themselves, and the
words inside any verified run are hit.

The set is broadcast only up to ``max_bytes`` of benchmark text.  A larger
benchmark is split into slices of that size by the hash of the item; the
documents are scanned once per slice, and hits are merged.

Null or empty texts have no words and are never hit; null item texts and items
without words match nothing; an item with a null id marks words but is not
listed; items that repeat count once per id; repeated documents are judged row
by row; empty tables give empty results or no hits; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from carelens.llm.shared import carried, carry, cut, folded_words, from_text, pick

_BASE = 0x9E3779B97F4A7C15


def _run_hashes(ids: np.ndarray, k: int, base: int) -> np.ndarray:
    n = len(ids) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        out = out * np.uint64(base) + ids[j:j + n]
    return out


class Grams:
    """The distinct runs of a benchmark slice: by length, their hashes, words and items."""

    def __init__(self, items: list[tuple[int | None, str]], window: int):
        self.words: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in folded_words(text or "")]
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                found.setdefault(k, {}).setdefault(tuple(ids[i:i + k]), set()).add(item)
        self.by_length = {}
        for k, runs in found.items():
            rows = np.array(list(runs), np.uint64)
            owners = [sorted(i for i in s if i is not None) for s in runs.values()]
            for base in range(_BASE, _BASE + 2000, 2):  # a base without collisions among the runs
                hashes = np.concatenate([_run_hashes(r, k, base) for r in rows])
                order = np.argsort(hashes)
                if len(np.unique(hashes)) == len(hashes):
                    break
            self.by_length[k] = (base, hashes[order], rows[order], [owners[i] for i in order])

    def scan(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[list[int]]]:
        """Word count, hit positions and items of each text."""
        split = [folded_words(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        # one run of ids with a 0 after each text: no benchmark word is 0, so no run crosses it
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        ids = np.zeros(int((sizes + 1).sum()), np.uint64)
        for a, words in zip(starts, split):
            ids[a:a + len(words)] = np.fromiter(map(self.words.get, words, repeat(0)), np.uint64, len(words))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        edges = np.zeros(len(ids) + 1, np.int64)
        items: list[set] = [set() for _ in texts]
        for k, (base, hashes, rows, owners) in self.by_length.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(unknown[k:] == unknown[:-k])
            if not len(at):
                continue
            code = np.zeros(len(at), np.uint64)
            for j in range(k):
                code = code * np.uint64(base) + ids[at + j]
            row = np.minimum(np.searchsorted(hashes, code), len(hashes) - 1)
            same = hashes[row] == code
            at, row = at[same], row[same]
            for j in range(k):
                same = rows[row, j] == ids[at + j]
                at, row = at[same], row[same]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + k, -1)
            for doc, r in set(zip((np.searchsorted(starts, at, side="right") - 1).tolist(), row.tolist())):
                items[doc].update(owners[r])
        inside = np.cumsum(edges[:-1]) > 0
        return sizes, [np.flatnonzero(inside[a:a + n]) for a, n in zip(starts, sizes)], [sorted(s) for s in items]


def scan(rows: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = 32_000_000) -> DataFrame:
    """Append to rows with a ``text``: n_words, hits (positions of the words hit) and items (ids found)."""
    spark = rows.sparkSession
    items = pick(benchmark, item_id="long", text="string").where("text is not null").distinct()  # repeats would fill one slice
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(size / max_bytes))
    made = "n_words long, hits array<bigint>, items array<bigint>"
    for n in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == n)
        # at most about max_bytes of text
        grams = spark.sparkContext.broadcast(Grams([tuple(r) for r in part.collect()], window))
        found = from_text(rows, made, lambda texts, grams=grams: grams.value.scan(texts), keep=("text",))
        if slices > 1:
            found = cut(found.withColumns({c: F.array_sort(F.array_union(c, f"before_{c}")) for c in ("hits", "items")}
                                          if n else {}).drop("before_hits", "before_items"))
            rows = found.drop("n_words").withColumnsRenamed({"hits": "before_hits", "items": "before_items"})
    return found


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def without_words(text: str, hits: list[int]) -> str:
    """The text without the words at these positions and what stands between two of them."""
    spans = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, kept = [], 0
    for first in (h for h, before in zip(hits, [-2, *hits]) if h != before + 1):
        last = first
        gone = set(hits)
        while last + 1 in gone:
            last += 1
        out.append(text[kept:spans[first][0]])
        kept = spans[last][1]
    return "".join([*out, text[kept:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, remove: str = "documents",
                  max_bytes: int = 32_000_000) -> DataFrame:
    """``docs`` without the hit rows (``remove="documents"``), or with the hit words cut out of text (``"spans"``)."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    rows = scan(carry(docs, text="string"), benchmark, window, max_bytes)
    if remove == "documents":
        return carried(rows.where(F.size("hits") == 0), docs)
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def cleaned(batches):
        for b in batches:
            texts = [without_words(t, h) if h else t for t, h in
                     zip(b.column("text").to_pylist(), b.column("hits").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    at = docs.columns.index("text")
    left = rows.select("row", "text", "hits").mapInArrow(cleaned, schema)
    return carried(left.select(F.col("row").withField(f"c{at}", F.col("text")).alias("row")), docs)
