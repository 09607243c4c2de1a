"""Substring dedup: windows of words counted exactly through super-k-mers.

Each text is cut into runs of consecutive windows that share a minimiser (the
smallest hash among the ``SEED``-word runs of the window).  Such a run, a
super-k-mer, is shuffled as one packed string to the bucket of its minimiser.
All occurrences of a window meet in one bucket, where windows are sorted by
hash, equal neighbours are compared byte by byte, and the smallest doc_id of
each distinct window is found.  The results go back to the places where the
strings occur, and words covered by a window that an earlier document also has
are removed.

Equal strings are combined in the map task before the shuffle, and travel in
compressed blocks, one for each group of minimisers; the number of groups grows
with the corpus.  A minimiser whose low bits (``COUNTED``) stand for more than
``hot`` super-k-mers is not one bucket: its windows travel alone, keyed by their
own hash, so equal ones still meet and different ones spread.  At most
``MOST_HOT`` low bits can be hot, since the bound rises with the corpus.  Strings are judged in key order, a
bounded number at a time.  On the way back, places whose string cannot be in the
results are left out by a bitmap of fixed size (``MARKS`` bits).

Null and empty texts have no words; a null doc_id counts as later than all
others; documents with fewer words than the window keep all; a doc_id that
repeats is judged row by row, and rows of one doc_id never remove each other's
words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Observation, functions as F, types as T

from carelens.llm.shared import Words, ascii_words, batch, by_group, cut, groups_of, mix, pick, window_hashes

SEED = 3
MOST_HOT = 10_000
MARKS = 1 << 25
LEVEL = 9  # of the blocks' compression
COUNTED = 1 << 24  # minimisers are counted by their low bits: so many counts at most
GROUP = 100_000  # super-k-mers in a group of minimisers, about
LAST = np.iinfo(np.int64).max


def _lowest(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values, by doubling."""
    low, span = values, 1
    while 2 * span <= size:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    rest = size - span
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def super_kmers(words: Words, window: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first word, windows) of each super-k-mer; windows whose minimiser's low bits are ``hot`` (sorted) stand alone."""
    at = words.windows(window)
    if not len(at):
        return np.empty(0, np.int64), at, at
    seed = min(SEED, window)
    low = _lowest(window_hashes(words.hashes, seed), window - seed + 1)[at]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)])
    if len(hot):
        bits = low & np.uint64(COUNTED - 1)
        alone = hot[np.minimum(np.searchsorted(hot, bits), len(hot) - 1)] == bits
        low = np.where(alone, window_hashes(words.hashes, window, seed=1)[at], low)
        new |= alone
        new[1:] |= alone[:-1]
    first = np.flatnonzero(new)
    return low[first].astype(np.int64), at[first], np.diff(np.concatenate([first, [len(at)]]))


def _texts(b: pa.RecordBatch, window: int, hot: np.ndarray):
    """(first row, words, keys, first words, counts) of slices of a batch."""
    for at, texts in groups_of(b.column("text").to_pylist(), 1_000_000):
        words = Words([b" ".join(ascii_words(t)) for t in texts])
        yield at, words, *super_kmers(words, window, hot)


def _strings(words: Words, first: np.ndarray, counts: np.ndarray, window: int) -> list[bytes]:
    """The packed words of each super-k-mer."""
    return [words.data[a:z] for a, z in zip(words.starts[first].tolist(), words.ends[first + counts + window - 2].tolist())]


def minimisers(rows: DataFrame, window: int, hot: int) -> tuple[int, np.ndarray]:
    """Super-k-mers in the corpus; sorted low bits of minimisers with more than ``hot`` or a ``MOST_HOT``-th of them."""
    spec = "key int, n int"

    def count(batches):
        for b in batches:
            keys = [k for _, _, k, _, _ in _texts(b, window, np.empty(0, np.uint64))]
            if keys:
                bits = (np.concatenate(keys) & (COUNTED - 1)).astype(np.int32)
                yield batch(spec, np.unique(bits, return_counts=True))

    seen = Observation()
    counts = rows.select("text").mapInArrow(count, spec).groupBy("key").agg(F.sum("n").alias("n"))
    large = cut(counts.observe(seen, F.sum("n").alias("total")).where(F.col("n") > hot))
    total = seen.get["total"] or 0
    found = large.where(F.col("n") > total // MOST_HOT).select("key").collect()  # at most MOST_HOT
    return total, np.sort(np.array([r.key for r in found], np.int64).astype(np.uint64))


def _block(keys: np.ndarray, docs: np.ndarray, several: np.ndarray, strings: list[bytes]) -> bytes:
    """Keys are sorted; of each, its top half and what that exceeds the one before by are enough to tell groups apart."""
    head = np.array([len(keys)], "<i8")
    short = (keys >> 32).astype("<u4")
    parts = [head.tobytes(), np.diff(short, prepend=short[:1] * 0).tobytes(), docs.astype("<i8").tobytes(), several.astype(np.uint8).tobytes()]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([*parts, b"\n".join(strings)]))


def _unblock(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    keys = np.cumsum(np.frombuffer(raw, "<u4", n, 8), dtype=np.uint32)
    docs = np.frombuffer(raw, "<i8", n, 8 + 4 * n)
    return keys, docs, np.frombuffer(raw, np.uint8, n, 8 + 12 * n) > 0, raw[8 + 13 * n:].split(b"\n")


def packed(rows: DataFrame, window: int, hot: np.ndarray, groups: int, held: int = 100_000) -> DataFrame:
    """(part, block): super-k-mers combined within each task, in blocks of one group of minimisers.

    A block holds keys, the smallest doc_id of the task's occurrences, whether
    there are larger ones, and the strings.  At most ``held`` strings wait in a
    task at a time, and one slice of texts.
    """
    spec = "part long, block binary"

    def pack(batches):
        table: dict[bytes, list] = {}

        def flushed():
            key, strings, doc, several = (list(c) for c in zip(*table.values()))
            key, doc, several = np.array(key, np.int64), np.array(doc, np.int64), np.array(several, bool)
            part = (mix(key.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((key, part))
            edges = np.flatnonzero(np.diff(part[order], prepend=-1))
            parts, blocks = [], []
            for at in np.split(order, edges[1:]):
                parts.append(int(part[at[0]]))
                blocks.append(_block(key[at], doc[at], several[at], [strings[i] for i in at.tolist()]))
            table.clear()
            return batch(spec, [parts, blocks])

        for b in batches:
            docs = b.column("doc").to_numpy()
            for at, words, keys, first, counts in _texts(b, window, hot):
                owners = docs[at + np.searchsorted(np.cumsum(words.counts), first, side="right")]
                for key, doc, string in zip(keys.tolist(), owners.tolist(), _strings(words, first, counts, window)):
                    row = table.get(string)
                    if row is None:
                        table[string] = [key, string, doc, False]
                    elif doc != row[2]:
                        row[2], row[3] = min(doc, row[2]), True
                if len(table) >= held:
                    yield flushed()
        if table:
            yield flushed()

    return rows.select("doc", "text").mapInArrow(pack, spec)


def first_documents(strings: list[bytes], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest doc of every window of the strings, flat, and the windows of each string."""
    words = Words(strings)
    counts = words.counts - window + 1
    at = words.windows(window)
    doc = np.repeat(docs, counts)
    code = window_hashes(words.hashes, window, seed=2)[at]
    order = np.argsort(code, kind="stable")
    ranked, place = code[order], at[order]
    same = ranked[1:] == ranked[:-1]
    begin, end = words.starts[place], words.ends[place + window - 1]
    if any(words.data[a:b] != words.data[c:d] for a, b, c, d in zip(*(
            x.tolist() for i in (np.flatnonzero(same), np.flatnonzero(same) + 1) for x in (begin[i], end[i])))):
        # two windows with one hash: rank by the words themselves
        begin, end = words.starts[at].tolist(), words.ends[at + window - 1].tolist()
        _, code = np.unique(np.array([words.data[a:b] for a, b in zip(begin, end)], object), return_inverse=True)
        order = np.argsort(code, kind="stable")
        ranked = code[order]
        same = ranked[1:] == ranked[:-1]
    group = np.flatnonzero(np.concatenate([[True], ~same]))
    low = np.minimum.reduceat(doc[order], group)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(low, np.diff(np.concatenate([group, [len(order)]])))
    return out, counts


def judged(blocks: DataFrame, window: int, most_bytes: int = 1_500_000) -> DataFrame:
    """(code, mark, firsts): the smallest doc of each window of the strings that occur in a later document too.

    One group of minimisers is held at a time; complete keys of about
    ``most_bytes`` are judged together.
    """
    def judge(t: pa.Table):
        keys, docs, several, strings = zip(*map(_unblock, t.column("block").to_pylist()))
        keys, docs, several = np.concatenate(keys), np.concatenate(docs), np.concatenate(several)
        strings = [s for some in strings for s in some]
        order = np.argsort(keys, kind="stable")
        size = np.cumsum([len(strings[i]) for i in order.tolist()])
        new_key = np.flatnonzero(keys[order][1:] != keys[order][:-1]) + 1  # where judging may be cut
        wanted = np.searchsorted(size, np.arange(most_bytes, size[-1], most_bytes))
        cuts = np.unique(new_key[np.minimum(np.searchsorted(new_key, wanted), len(new_key) - 1)]) if len(new_key) else []
        codes, firsts = [], []
        for at in np.split(order, cuts):
            some = [strings[i] for i in at.tolist()]
            low, counts = first_documents(some, docs[at], window)
            ends = np.cumsum(counts)
            later = np.add.reduceat((low < np.repeat(docs[at], counts)).astype(np.int64), ends - counts) > 0
            chosen = {some[i]: i for i in np.flatnonzero(later | several[at]).tolist()}
            codes += [xxhash.xxh3_128_digest(s) for s in chosen]
            firsts += [low[ends[i] - counts[i]:ends[i]] for i in chosen.values()]
        return codes, _marks(codes), firsts

    return by_group(blocks, ["part"], judge, "code binary, mark long, firsts array<bigint>")


def _marks(codes: list[bytes]) -> np.ndarray:
    return (np.frombuffer(b"".join(codes), "<u8")[::2] % np.uint64(MARKS)).astype(np.int64)


def marked(results: DataFrame) -> np.ndarray:
    """Bitmap of the results' marks as 64-bit words; at most ``MARKS`` / 64 rows come to the driver."""
    words = (results.groupBy(F.shiftright("mark", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(mark & 63 as int))")).alias("bits")).toArrow())
    out = np.zeros(MARKS // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def occurrences(rows: DataFrame, window: int, hot: np.ndarray, marks) -> DataFrame:
    """(doc, tie, code, first): every place of a string whose mark is set in the broadcast bitmap."""
    spec = "doc long, tie long, code binary, first int"

    def find(batches):
        for b in batches:
            docs, ties = b.column("doc").to_numpy(), b.column("tie").to_numpy()
            for at, words, _, first, counts in _texts(b, window, hot):
                codes = [xxhash.xxh3_128_digest(s) for s in _strings(words, first, counts, window)]
                mark = _marks(codes)
                kept = np.flatnonzero(marks.value[mark >> 6] >> (mark & 63).astype(np.uint64) & np.uint64(1))
                ends = np.cumsum(words.counts)
                row = np.searchsorted(ends, first[kept], side="right")
                yield batch(spec, [docs[at + row], ties[at + row], [codes[i] for i in kept.tolist()],
                                   first[kept] - (ends - words.counts)[row]])

    return rows.select("doc", "tie", "text").mapInArrow(find, spec)


def remove_repeats(docs: DataFrame, window: int = 13, hot: int = 200_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): words outside every window that a document with a smaller id has."""
    rows = (pick(docs, doc_id="long", text="string").withColumn("doc", F.coalesce("doc_id", F.lit(int(LAST))))
            .withColumn("tie", F.xxhash64("text")))
    total, keys = minimisers(rows, window, hot)
    results = cut(judged(packed(rows, window, keys, total // GROUP + 1), window))
    marks = docs.sparkSession.sparkContext.broadcast(marked(results))  # MARKS / 8 bytes
    places = (occurrences(rows, window, keys, marks).join(results, "code")
              .select("doc", "tie", F.filter(F.transform("firsts", lambda low, i: F.when(
                  low < F.col("doc"), (F.col("first") + i).cast("int"))), lambda x: x.isNotNull()).alias("at"))
              .where(F.size("at") > 0).distinct()
              .groupBy("doc", "tie").agg(F.flatten(F.collect_list("at")).alias("at")))
    places = cut(places)
    # only texts that lose words meet their places; a bitmap of fixed size tells the others apart
    mark = F.pmod(F.xxhash64("doc", "tie"), F.lit(MARKS)).alias("mark")
    losing = docs.sparkSession.sparkContext.broadcast(marked(places.select(mark)))
    texts = rows.select("doc_id", "doc", "tie", "text", mark)
    spec = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                         T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def chosen(b, wanted):
        marks = b.column("mark").to_numpy()
        found = losing.value[marks >> 6] >> (marks & 63).astype(np.uint64) & np.uint64(1)
        return b.filter(pa.array(found == wanted))

    def maybe_losing(batches):
        for b in batches:
            yield chosen(b, 1)

    def left_alone(batches):
        for b in batches:
            some = chosen(b, 0)
            for first, texts in groups_of(some.column("text").to_pylist()):
                words = [ascii_words(t) for t in texts]
                yield batch("doc_id long, n_words long, n_removed long, kept string",
                            [some.column("doc_id").slice(first, len(texts)), list(map(len, words)), [0] * len(texts),
                             [b" ".join(w).decode("utf-8", "surrogatepass") for w in words]])

    def remove(batches):
        for b in batches:
            ids, starts = b.column("doc_id"), b.column("at").to_pylist()
            for first, texts in groups_of(b.column("text").to_pylist()):
                sizes, gone, kept = [], [], []
                for text, at in zip(texts, starts[first:first + len(texts)]):
                    words = ascii_words(text)
                    sizes.append(len(words))
                    edges = np.zeros(len(words) + 1, np.int64)
                    if at:
                        np.add.at(edges, at, 1)
                        np.add.at(edges, np.array(at) + window, -1)
                    out = np.cumsum(edges[:-1]) > 0
                    gone.append(int(out.sum()))
                    kept.append(b" ".join(w for w, o in zip(words, out.tolist()) if not o).decode("utf-8", "surrogatepass"))
                yield batch("doc_id long, n_words long, n_removed long, kept string",
                            [ids.slice(first, len(texts)), sizes, gone, kept])

    cutting = texts.mapInArrow(maybe_losing, texts.schema).join(places, ["doc", "tie"], "left")
    return texts.mapInArrow(left_alone, spec).union(cutting.select("doc_id", "text", "at").mapInArrow(remove, spec))
