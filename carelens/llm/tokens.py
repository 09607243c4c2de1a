"""Sub-word encoding with a public tokenizer, and token tables in doc_id order.

The `tokenizers` library encodes every distinct chunk once per worker; texts
are then assembled from the memoised chunks.  A text is cut before each space
that a non-space follows.  Byte-level pre-tokenizers start a new token there
whatever surrounds it (a space belongs to the word after it, and a white-space
run never takes the space before a word), so the concatenated chunk ids are
the ids of the whole text.  New chunks without white space go to the library
many at a time, joined by spaces, and are told apart again by the tokens that
begin with a space.  New chunks of printable ASCII are cut here where the
byte-level pre-tokenizer cuts them, and only their distinct pieces go to the
library's model.  Tests compare the ids with the library's for whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from carelens.llm.shared import batch, cut, give_back, pick, stage_memo

_BEFORE_WORD = re.compile(r" (?=[^\s᠎])")
_SPACE_RUN = re.compile(r" [\s᠎]")
_SPACE = re.compile(r"[\s᠎]")
# ASCII chunks, and their pieces once a space is written as \u0120 and a line end as \u010a (the byte-level alphabet)
_ASCII = re.compile(r"[!-~]+(?:\n[!-~]+)*")
_PIECE = re.compile("'(?:s|t|re|ve|m|ll|d)|\u0120?[A-Za-z]+|\u0120?[0-9]+|\u0120?[^A-Za-z0-9\u0120\u010a]+|\u010a")
JOINED = 200
PIECED = 20_000
GROUP = 500_000


class _Memo(dict):
    """chunk -> row of ``table``; unseen chunks get the next row and wait in ``new``.

    Beyond ``most`` chunks, those used only once since the last clearing go.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.table, self.new, self.uses = most, _Ragged(), [], np.zeros(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n

    def rows(self, chunks: pa.StringArray, code) -> np.ndarray:
        """Rows of ``chunks``; ``code`` turns the new ones into (flat ids, sizes).

        Arrow tells equal chunks apart, so each is looked up once a batch.
        """
        if len(self) > self.most:
            self._clear()
        coded = chunks.dictionary_encode()
        at = coded.indices.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False)  # to_pylist takes far longer
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.table.extend(*code(self.new))
            self.new = []
        uses = np.zeros(len(self), np.int64)
        uses[:len(self.uses)] = self.uses
        uses[found] += np.bincount(at, minlength=len(found))
        self.uses = uses
        return found[at]

    def _clear(self) -> None:
        order = np.argsort(-self.uses, kind="stable")[:self.most // 2]
        kept = order[self.uses[order] > 1]
        chunks = list(self)
        flat, ends = self.table.gather(kept)
        self.clear()
        self.update((chunks[k], i) for i, k in enumerate(kept.tolist()))
        self.table, self.uses = _Ragged(), np.ones(len(kept), np.int64)
        self.table.extend(flat, np.diff(ends, prepend=0))


class ChunkEncoder:
    """Token ids of whole texts from memoised chunks; memos hold at most ``most`` chunks and one batch."""

    def __init__(self, path: str, most: int = 150_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True  # a text that spells one out is ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        self.cuts_ascii = (parts["normalizer"] is None and parts["model"]["type"] == "BPE"
                           and (before.get("type"), before.get("use_regex"), before.get("add_prefix_space")) == ("ByteLevel", True, False)
                           and all(t["special"] for t in parts["added_tokens"]))
        self.model = self.tokenizer.model
        self.heads, self.after_space = _Memo(most), _Memo(most)

    def _by_library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = []
        for lo in range(0, len(chunks), 4096):  # the library's results are large objects
            rows += [e.ids for e in self.tokenizer.encode_batch_fast(chunks[lo:lo + 4096], add_special_tokens=False)]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes.sum())), sizes

    def _by_model(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_by_library`` for words of ``_ASCII``, each after a space: the model sees each distinct piece once."""
        pieces = _PIECE.findall(("\u0120" + "\u0120".join(words)).replace("\n", "\u010a"))
        place = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        rows = [[t.id for t in self.model.tokenize(p)] for p in place]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes.sum()))
        at = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        opens = np.fromiter((p[0] == "\u0120" for p in place), bool, len(place))[at]
        ids, ends = _take(flat, (np.cumsum(sizes) - sizes)[at], sizes[at])
        return ids, np.diff((ends - sizes[at])[opens], append=len(ids))

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_by_library`` for words without white space, each after a space."""
        flat, _ = self._by_library([" " + " ".join(words[lo:lo + JOINED]) for lo in range(0, len(words), JOINED)])
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) != len(words):
            raise ValueError("the tokenizer does not give every word a token of its own that begins with a space")
        return flat, np.diff(starts, append=len(flat))

    def _after_space(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of chunks that follow a space, which is theirs."""
        ascii_, plain, other = [], [], []
        for i, c in enumerate(chunks):
            if self.cuts_ascii and _ASCII.fullmatch(c):
                ascii_.append(i)
            elif c and not _SPACE.search(c):
                plain.append(i)
            else:
                other.append(i)
        made = [self._by_model([chunks[i] for i in ascii_[lo:lo + PIECED]]) for lo in range(0, len(ascii_), PIECED)]
        made.append(self._joined([chunks[i] for i in plain]))
        made.append(self._by_library([" " + chunks[i] for i in other]))
        flat, sizes = (np.concatenate(x) for x in zip(*made))
        order = np.argsort(np.array([*ascii_, *plain, *other], np.int64))
        return _take(flat, (np.cumsum(sizes) - sizes)[order], sizes[order])[0], sizes[order]

    def encode(self, texts: list[str] | pa.StringArray) -> list[np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        chunks, sizes = _chunks(texts)
        first = np.zeros(len(chunks), bool)
        first[np.cumsum(sizes) - sizes] = True
        h = self.heads.rows(chunks.filter(pa.array(first)), self._by_library)
        r = self.after_space.rows(chunks.filter(pa.array(~first)), self._after_space)
        head_ids, head_ends = self.heads.table.gather(h)
        ids, ends = self.after_space.table.gather(r)
        ends, head_ends = np.concatenate([[0], ends]), np.concatenate([[0], head_ends])
        out, a = [], 0
        for i, n in enumerate((sizes - 1).tolist()):
            out.append(np.concatenate([head_ids[head_ends[i]:head_ends[i + 1]], ids[ends[a]:ends[a + n]]]))
            a += n
        return out


def _chunks(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The chunks of all ``texts`` (not null), one after the other, and how many each text has."""
    split = pc.split_pattern(texts, " ")
    sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
    flat = split.flatten()
    runs = [i for i, t in enumerate(texts.to_pylist()) if _SPACE_RUN.search(t)]
    if not runs:
        return flat, sizes
    # only the spaces before a non-space part chunks there
    ends, parts, done = np.cumsum(sizes), [], 0
    for i in runs:
        chunks = _BEFORE_WORD.split(texts[i].as_py())
        parts += [flat.slice(done, ends[i] - sizes[i] - done), pa.array(chunks, flat.type)]
        done, sizes[i] = ends[i], len(chunks)
    return pa.concat_arrays([*parts, flat.slice(done)]), sizes


class _Ragged:
    """Rows of ids, appended to and gathered by index."""

    def __init__(self):
        self.flat, self.used = np.empty(1024, np.uint32), 0
        self.starts, self.sizes, self.rows = np.empty(1024, np.int64), np.empty(1024, np.int64), 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        ends = self.used + np.cumsum(sizes)
        self.flat = self._room(self.flat, self.used + len(flat))
        self.flat[self.used:self.used + len(flat)] = flat
        for name, values in (("starts", ends - sizes), ("sizes", sizes)):
            kept = self._room(getattr(self, name), self.rows + len(sizes))
            kept[self.rows:self.rows + len(sizes)] = values
            setattr(self, name, kept)
        self.used, self.rows = self.used + len(flat), self.rows + len(sizes)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.empty(max(n, 2 * len(a)) - len(a), a.dtype)])

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated rows of ``index`` and the end of each."""
        return _take(self.flat, self.starts[index], self.sizes[index])


def _take(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)], ends


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker, stage and tokenizer file.

    A task has one core: the library's own threads would take those of other
    tasks, and memory for each.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return stage_memo(("encoder", path), lambda: ChunkEncoder(path))


def in_doc_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt into ranges of doc_id, sorted within each.

    The text's hash breaks ties, so a doc_id that repeats is spread and ordered
    too.  Null ids come first.
    """
    rows = pick(docs, doc_id="long", text="string").withColumn("tie", F.xxhash64("text"))
    return rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Slices (doc_ids, ids with the end id) of a partition of ``in_doc_order``, in order."""
    coder = encoder(path)
    give_back()  # what the task before has freed
    end = np.array([end_id], np.uint32)
    for b in batches:
        doc_ids = b.column("doc_id").to_pylist()
        texts = b.column("text")
        # slices of about GROUP bytes; a longer text is one of its own
        nth = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64) // GROUP
        edges = [0, *(np.flatnonzero(np.diff(nth)) + 1).tolist(), len(texts)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield doc_ids[lo:hi], [np.concatenate([i, end]) for i in coder.encode(pc.fill_null(texts.slice(lo, hi - lo), ""))]


_TABLE = "part int, before long, doc_id long, n_tokens long, ids binary"


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(part, before, doc_id, n_tokens, ids), checkpointed: each document's ids with the end id.

    ``part`` numbers the doc_id ranges in order; ``before`` counts the ids that
    precede the document in its part.  ids are little-endian unsigned 32-bit.
    """
    def encode(batches):
        part, before = TaskContext.get().partitionId(), 0
        for doc_ids, ids in encoded(batches, path, end_id):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = before + np.cumsum(sizes)
            yield batch(_TABLE, [np.full(len(ids), part), ends - sizes, doc_ids, sizes,
                                 [i.astype("<u4").tobytes() for i in ids]])
            before = int(ends[-1])

    return cut(in_doc_order(docs).mapInArrow(encode, _TABLE))


def part_offsets(parts: DataFrame) -> DataFrame:
    """(part, offset): ids in all earlier parts, from per-part totals.

    The second pass of the prefix sum: one row per part, so the window and the
    broadcast of its result are bounded by the number of partitions.
    """
    totals = parts.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).cast("long").alias("offset"))
