"""Token ids in files of patched frame-of-reference blocks.

A file's rows are segments: a run of documents of one doc_id range whose ids are
coded together.  A segment's payload is

    "PFR1"  ids (u64)  blocks (u32)  start of each block (u32 each)  blocks

and a block of 128 ids is

    minimum (u32)  width (u8)  exceptions (u8)  packed (16 * width bytes)
    positions of the exceptions (u8 each)  their values (u32 each)

The block minimum is subtracted, the rest is packed at the width that the
``percentile`` quantile of the block needs, and larger values go to the
exception list.  The block starts make any id reachable without unpacking what
precedes it (``read_block``).  Spark's writer commits the files, in any store
it can write to, so a lost task leaves none half written.

Null texts count as empty (the end id alone), null doc_ids come first, repeated
rows are kept, an empty table gives a folder without segments, and columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from carelens.llm.shared import batch
from carelens.llm.tokens import encoded, in_doc_order, part_offsets

BLOCK = 128
HEAD = struct.Struct("<4sQI")
MAGIC = b"PFR1"


def _widths(rest: np.ndarray, percentile: float) -> np.ndarray:
    """Bits that the ``percentile`` quantile of each row (sorted copy) needs."""
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    value = np.partition(rest, at, axis=1)[:, at].astype(np.float64)
    return np.where(value > 0, np.floor(np.log2(np.maximum(value, 1))) + 1, 0).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, 128) values below 2**width -> (rows, 16 * width) bytes."""
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    words = np.zeros((2 * width, values.shape[0]), np.uint64)
    for j in range(BLOCK):
        word, shift = divmod(j * width, 64)
        words[word] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(values.shape[0], 16 * width)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    rows = packed.shape[0]
    if not width:
        return np.zeros((rows, BLOCK), np.uint32)
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(rows, 2 * width).T)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((BLOCK, rows), np.uint32)
    for j in range(BLOCK):
        word, shift = divmod(j * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[word + 1] << np.uint64(64 - shift)
        out[j] = value & mask
    return np.ascontiguousarray(out.T)


def encode_ids(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """Payload of a segment; ``ids`` are unsigned and below 2**32."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return HEAD.pack(MAGIC, 0, 0)
    grid = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], np.uint32)]).astype(np.uint32).reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    width = _widths(rest, percentile)
    large = rest >> np.minimum(width, 31)[:, None].astype(np.uint32) > 0
    large[width == 32] = False
    n_large = large.sum(axis=1)
    sizes = 6 + 16 * width + 5 * n_large
    starts = HEAD.size + 4 * blocks + np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.zeros(HEAD.size + 4 * blocks + int(sizes.sum()), np.uint8)
    out[:HEAD.size] = np.frombuffer(HEAD.pack(MAGIC, n, blocks), np.uint8)
    out[HEAD.size:HEAD.size + 4 * blocks] = starts.astype("<u4").view(np.uint8)
    for k in range(4):
        out[starts + k] = (low >> np.uint32(8 * k)).astype(np.uint8)
    out[starts + 4], out[starts + 5] = width, n_large
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        mask = np.uint32((1 << int(w)) - 1)
        out[(starts[rows] + 6)[:, None] + np.arange(16 * w)] = _pack(rest[rows] & mask, int(w))
    row, position = np.nonzero(large)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_large) - n_large, n_large)
    after = starts[row] + 6 + 16 * width[row]
    out[after + nth] = position
    value = rest[row, position]
    for k in range(4):
        out[after + n_large[row] + 4 * nth + k] = (value >> np.uint32(8 * k)).astype(np.uint8)
    return out.tobytes()


def _u32(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    value = np.zeros(len(at), np.uint32)
    for k in range(4):
        value |= data[at + k].astype(np.uint32) << np.uint32(8 * k)
    return value


def _blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts``, one row each."""
    low, width, n_large = _u32(data, starts), data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    out = np.empty((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out[rows] = _unpack(data[(starts[rows] + 6)[:, None] + np.arange(16 * w)], int(w))
    row = np.repeat(np.arange(len(starts)), n_large)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_large) - n_large, n_large)
    after = starts[row] + 6 + 16 * width[row]
    out[row, data[after + nth]] = _u32(data, after + n_large[row] + 4 * nth)
    return out + low[:, None]


def _head(payload: bytes) -> tuple[np.ndarray, int, np.ndarray]:
    magic, n, blocks = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    data = np.frombuffer(payload, np.uint8)
    starts = np.frombuffer(payload, "<u4", blocks, HEAD.size).astype(np.int64)
    return data, n, starts


def decode_ids(payload: bytes) -> np.ndarray:
    data, n, starts = _head(payload)
    return _blocks(data, starts).reshape(-1)[:n]


def read_block(payload: bytes, block: int) -> np.ndarray:
    """The ids of one block, found through the index of block starts."""
    data, n, starts = _head(payload)
    return _blocks(data, starts[block:block + 1])[0][:n - block * BLOCK]


_FILE = "part int, segment int, first long, n_tokens long, doc_ids binary, has_id binary, sizes binary, payload binary"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2,
                      segment_ids: int = 1 << 20, percentile: float = 0.9) -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending doc_id order.

    A segment ends with the document that brings it to ``segment_ids`` ids.
    """
    def segments(batches):
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, ids, held = [], [], 0

        def made():
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return batch(_FILE, [[part], [segment], [first], [held],
                                 [np.array([d or 0 for d in doc_ids], "<i8").tobytes()],
                                 [np.array([d is not None for d in doc_ids], np.uint8).tobytes()],
                                 [sizes.astype("<i8").tobytes()], [encode_ids(np.concatenate(ids), percentile)]])

        for some_ids, arrays in encoded(batches, tokenizer, end_id):
            for d, a in zip(some_ids, arrays):
                doc_ids.append(d)
                ids.append(a)
                held += len(a)
                if held >= segment_ids:
                    yield made()
                    segment, first, doc_ids, ids, held = segment + 1, first + held, [], [], 0
        if ids:
            yield made()

    # the payload is packed already
    (in_doc_order(docs).mapInArrow(segments, _FILE)
     .write.option("compression", "uncompressed").mode("errorifexists").parquet(folder))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ``start`` counts the ids of all before it."""
    files = spark.read.parquet(folder)
    spec = "doc_id long, start long, n_tokens long, ids binary"

    def documents(batches):
        for b in batches:
            for offset, first, doc_ids, has_id, sizes, payload in zip(
                    *(b.column(c).to_pylist() for c in ("offset", "first", "doc_ids", "has_id", "sizes", "payload"))):
                raw = decode_ids(payload).astype("<u4").tobytes()
                sizes = np.frombuffer(sizes, "<i8")
                ends = np.cumsum(sizes)
                known = np.frombuffer(has_id, np.uint8)
                names = [int(d) if k else None for d, k in zip(np.frombuffer(doc_ids, "<i8"), known)]
                yield batch(spec, [names, offset + first + ends - sizes, sizes,
                                   [raw[4 * (e - s):4 * e] for s, e in zip(sizes, ends)]])

    # one row per partition of the writing job
    placed = files.join(F.broadcast(part_offsets(files.select("part", "n_tokens"))), "part")
    return placed.select("offset", "first", "doc_ids", "has_id", "sizes", "payload").mapInArrow(documents, spec)
