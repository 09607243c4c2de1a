"""Concatenate and cut: pack documents into sequences of fixed length.

All documents, in doc_id order and each followed by the end id, form one long
run of ids that is cut every ``length`` ids.  Two passes give each document its
place in that run: the ids of each partition are counted while it is encoded,
the totals are summed over partitions, and the second pass cuts every
document's ids at the window edges.  Only the last sequence can be short, so
padding is less than one sequence in the whole corpus.

Null texts count as empty (their piece is the end id alone), null doc_ids come
first, rows that repeat are packed as often as they occur, an empty table gives
no pieces, and columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from carelens.llm.shared import batch, cut, stage_memo
from carelens.llm.tokens import part_offsets, token_table

_PIECES = ("part int, doc_id long, start long, length long, doc_tokens long, "
           "sequence_id long, offset long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """One row per piece: a run of one document's ids inside one sequence.

    (part, doc_id, start, length, doc_tokens, sequence_id, offset, ids); ids are
    little-endian unsigned 32-bit integers.
    """
    table = token_table(docs, tokenizer, end_id)
    # one row per partition of the token table
    placed = table.join(F.broadcast(part_offsets(table)), "part")

    def slices(batches):
        stage_memo("begun", object)  # the encoder of the stage before goes
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column("offset").to_numpy() + b.column("before").to_numpy()
            sizes = b.column("n_tokens").to_numpy()
            first, last = at // length, (at + sizes - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(at)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            sequence = first[row] + nth
            begin = np.maximum(sequence * length, at[row])
            end = np.minimum((sequence + 1) * length, (at + sizes)[row])
            start = begin - at[row]
            ids = b.column("ids")
            doc_ids = b.column("doc_id")
            for lo in range(0, len(row), 4096):
                s = slice(lo, lo + 4096)
                cuts = [memoryview(ids[int(r)].as_buffer())[4 * a:4 * (a + n)] for r, a, n in
                        zip(row[s], start[s], (end - begin)[s])]
                yield batch(_PIECES, [b.column("part").take(row[s]), doc_ids.take(row[s]), start[s],
                                      (end - begin)[s], sizes[row[s]], sequence[s], begin[s] % length,
                                      [bytes(c) for c in cuts]])

    return placed.mapInArrow(slices, _PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves.

    A partition's pieces are consecutive, so it assembles its own windows; a
    window that its first or last piece belongs to may reach into neighbours
    and is emitted as a boundary record.  Only those, at most two a partition,
    are grouped.  A group holds at most one sequence of ids.
    """
    spec = "sequence_id long, at long, boundary boolean, ids binary"

    def windows(batches):
        current, at, held, first = None, 0, [], True
        for b in batches:
            done = []
            for sequence, offset, ids in zip(b.column("sequence_id").to_pylist(), b.column("offset").to_pylist(),
                                             b.column("ids").to_pylist()):
                if sequence != current:
                    if current is not None:
                        done.append((current, at, first, b"".join(held)))
                        first = False
                    current, at, held = sequence, offset, []
                held.append(ids)
            if done:
                yield batch(spec, list(zip(*done)))
        if current is not None:
            yield batch(spec, [[current], [at], [True], [b"".join(held)]])

    made = cut(pieces.mapInArrow(windows, spec))
    whole = made.where(~F.col("boundary")).select("sequence_id", "ids")
    joined = (made.where("boundary").groupBy("sequence_id")
              .agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("run"))
              .select("sequence_id", F.aggregate("run", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids")))
    return whole.unionByName(joined).select(
        "sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")
