"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

1. The model's normaliser is applied here, by its compiled character map (a
   double-array trie): at each place the longest prefix that the map knows is
   replaced, else one character is copied.  All places of a text are walked
   through the trie at once, one byte deeper a step; only replacements of more
   than one character, which are rare, are then chosen from left to right.
   Every normalised byte keeps the offset of the original byte it came from.
   Spaces are collapsed, marked and given a prefix as the model says.
2. The library segments the normalised text, with its own normalisation
   switched off.  Long texts go to it in segments, cut before a space mark that
   follows another character; no piece of such a model spans that place (this
   is checked), so the ids are those of the whole text and memory is bounded.
3. The pieces' lengths give their ends among the normalised bytes, and the
   alignment projects these to byte spans of the original UTF-8 text.  Of the
   byte pieces of one character the last has its span, the others are empty.

Null and empty texts are empty; rows without a doc_id, repeated rows and ties
are encoded like any other row; an empty table gives an empty result; other
columns are ignored.  A model with user-defined symbols is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from carelens.llm.shared import batch, groups_of, pick, stage_memo

MARK = "▁"  # stands for a space
_MARK = np.frombuffer(MARK.encode(), np.uint8)
_UNKNOWN, _CONTROL, _USER, _BYTE = 2, 3, 4, 6  # types of pieces in a model file
_BPE = 2
SEGMENT = 32_768


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def wire_fields(data: bytes) -> Iterator[tuple[int, int, bytes | int, bytes]]:
    """(field, wire type, value, raw) of a serialised protocol-buffer message."""
    at = 0
    while at < len(data):
        start = at
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
        else:
            size, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else _number(data, at)
            value, at = data[at:at + size], at + size
        yield key >> 3, key & 7, value, data[start:at]


def _with_size(size: int) -> bytes:
    out = b""
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return out + bytes([size])


def _take(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class CharacterMap:
    """Longest-prefix lookup in a compiled character map, for all places of a text at once."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4)
        self.strings = np.frombuffer(compiled[4 + size:], np.uint8)
        self.ends = np.flatnonzero(self.strings == 0)  # replacements are closed by a zero byte

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> np.uint32(10)) << ((unit & np.uint32(512)) >> np.uint32(6))

    def longest(self, raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place: bytes of the longest known prefix (0: none) and where its replacement starts."""
        length, value = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        alive = np.arange(len(places))
        node = np.full(len(places), self._offset(self.units[:1])[0], np.uint32)
        depth = 0
        while len(alive):
            inside = places[alive] + depth < len(raw)
            alive, node = alive[inside], node[inside]
            byte = raw[places[alive] + depth].astype(np.uint32)
            node = node ^ byte
            unit = self.units[node]
            match = (unit & np.uint32(0x800000FF)) == byte
            alive, node, unit = alive[match], node[match], unit[match]
            node = node ^ self._offset(unit)
            depth += 1
            leaf = (unit >> np.uint32(8)) & np.uint32(1) == 1
            length[alive[leaf]] = depth
            value[alive[leaf]] = self.units[node[leaf]] & np.uint32(0x7FFFFFFF)
        return length, value

    def apply(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes of UTF-8 ``raw`` and, for each, where the replaced prefix starts."""
        places = np.flatnonzero((raw & 0xC0) != 0x80)
        own = np.diff(places, append=len(raw))
        length, value = self.longest(raw, places)
        start = np.ones(len(places), bool)
        until = 0
        for i in np.flatnonzero(length > own).tolist():
            if places[i] >= until:
                until = places[i] + length[i]
                start[i + 1:np.searchsorted(places, until)] = False
        places, own, length, value = places[start], own[start], length[start], value[start]
        known = length > 0
        size = np.where(known, self.ends[np.searchsorted(self.ends, value)] - value if len(self.ends) else 0, own)
        pool = np.concatenate([raw, self.strings])
        return _take(pool, np.where(known, len(raw) + value, places), size), np.repeat(places, size)


class Model:
    """A SentencePiece model file: normaliser with alignment, segmentation and decoding."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor
        top = list(wire_fields(data))
        spec = {f: v for f, _, v, _ in wire_fields(next((v for f, _, v, _ in top if f == 3), b""))}
        trainer = {f: v for f, _, v, _ in wire_fields(next((v for f, _, v, _ in top if f == 2), b""))}
        self.prefix, self.squeeze, self.escape = (bool(spec.get(f, 1)) for f in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        self.map = CharacterMap(spec[2]) if spec.get(2) else None
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"  # name, and all three switches off
        self.segmenter = SentencePieceProcessor()
        self.segmenter.load_from_serialized_proto(
            b"".join(raw for f, _, _, raw in top if f != 3) + b"\x1a" + _with_size(len(plain)) + plain)
        self.decoder = SentencePieceProcessor()
        self.decoder.load_from_serialized_proto(data)
        entries = [{f: v for f, _, v, _ in wire_fields(v)} for f, _, v, _ in top if f == 1]
        pieces, kinds = [e.get(1, b"").decode() for e in entries], np.array([e.get(3, 1) for e in entries])
        if (kinds == _USER).any():
            raise ValueError("models with user-defined symbols are not supported")
        self.sizes = np.array([len(p.encode()) for p in pieces], np.int64)
        self.sizes[kinds == _BYTE] = 1
        self.sizes[kinds == _CONTROL] = 0
        self.unknown = int(np.flatnonzero(kinds == _UNKNOWN)[0]) if (kinds == _UNKNOWN).any() else -1
        spanning = re.compile(f"[^{MARK}]{MARK}")
        self.separable = (trainer.get(3, 1) == _BPE and self.escape and not self.suffix
                          and not any(spanning.search(p) for p in pieces))

    @cached_property
    def ends(self) -> tuple[int, int]:
        return self.decoder.bos_id(), self.decoder.eos_id()

    def normalise(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes, and the original offset of each plus the one where the last ends."""
        raw = np.frombuffer(text.encode(), np.uint8)
        out, at = self.map.apply(raw) if self.map else (raw, None)
        if at is None:  # every character stands for itself
            places = np.flatnonzero((raw & 0xC0) != 0x80)
            at = np.repeat(places, np.diff(places, append=len(raw)))
        space = out == 32
        end = len(raw)
        if self.squeeze:
            kept = ~space
            kept[1:] |= space[1:] & ~space[:-1]
            solid = np.flatnonzero(~space)
            if not len(solid):
                return np.empty(0, np.uint8), np.zeros(1, np.int64)
            kept[:solid[0]] = False
            if solid[-1] + 1 < len(out):
                end = int(at[solid[-1] + 1])
            kept[solid[-1] + 1:] = False
            out, at, space = out[kept], at[kept], space[kept]
        if not len(out):
            return np.empty(0, np.uint8), np.zeros(1, np.int64)
        first, last = int(at[0]), end
        if self.escape and space.any():
            size = np.where(space, 3, 1)
            at = np.repeat(at, size)
            shift = np.cumsum(size) - size
            wide = np.empty(len(at), np.uint8)
            wide[shift[~space]] = out[~space]
            for j in range(3):
                wide[shift[space] + j] = _MARK[j]
            out = wide
        dummy = _MARK if self.escape else np.frombuffer(b" ", np.uint8)
        if self.prefix and not self.suffix:
            out, at = np.concatenate([dummy, out]), np.concatenate([np.full(len(dummy), first), at])
        if self.squeeze and out[-len(dummy):].tobytes() == dummy.tobytes():  # marks that the text itself ends with
            left = len(out.tobytes().decode().rstrip(dummy.tobytes().decode()).encode())
            out, at, last = out[:left], at[:left], int(at[left])
        if self.prefix and self.suffix:
            out, at = np.concatenate([out, dummy]), np.concatenate([at, np.full(len(dummy), last)])
        return out, np.append(at, last)

    def _segments(self, normal: str) -> list[str]:
        if not self.separable or len(normal) <= SEGMENT:
            return [normal]
        out, start = [], 0
        while len(normal) - start > SEGMENT:
            cut = start + SEGMENT
            while True:  # the next mark that follows something else
                cut = normal.find(MARK, cut)
                if cut < 0 or normal[cut - 1] != MARK:
                    break
                cut += 1
            if cut < 0:
                break
            out.append(normal[start:cut])
            start = cut
        return [*out, normal[start:]]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the begin and end id, and the original byte span (begin, end) of each."""
        out, at = self.normalise(text)
        segments = self._segments(out.tobytes().decode())
        ids = np.concatenate([np.empty(0, np.int64), *self.segmenter.encode_as_numpy(segments, num_threads=1)]).astype(np.int64)
        sizes = self.sizes[ids]
        if self.unknown >= 0 and (ids == self.unknown).any():  # as long as what they stand for
            parts = self.segmenter.encode_as_pieces(segments, num_threads=1)
            sizes = np.array([len(p.encode()) for part in parts for p in part], np.int64)
            sizes[ids != self.unknown] = self.sizes[ids[ids != self.unknown]]
        ends = np.cumsum(sizes)
        first, last = self.ends
        return (np.concatenate([[first], ids, [last]]), np.concatenate([[0], at[ends - sizes], [at[-1]]]),
                np.concatenate([[0], at[ends], [at[-1]]]))

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode(ids)


def _model(name: str) -> Model:
    """One model per Python worker and stage."""
    def load():
        with open(name, "rb") as f:
            return Model(f.read())
    return stage_memo(("pieces", name), load)


def encode(docs: DataFrame, model: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids, begins, ends) of every row: little-endian unsigned 32-bit ids with their byte spans.

    ``model`` is the path of a model file that every worker can open.  With
    ``decoded``, a last column has the text that the ids stand for.
    """
    spec = "doc_id long, ids binary, begins binary, ends binary" + ", decoded string" * decoded

    def run(batches):
        coder = _model(model)
        for b in batches:
            doc_ids = b.column("doc_id")
            for first, texts in groups_of(b.column("text").to_pylist()):
                rows = [coder.encode(t) for t in texts]
                columns = [[c.astype("<u4").tobytes() for c in column] for column in zip(*rows)]
                if decoded:
                    columns.append([coder.decode(ids.tolist()) for ids, _, _ in rows])
                yield batch(spec, [doc_ids.slice(first, len(texts)), *columns])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, spec)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` (with binary ``ids``) and the text that the ids stand for, as ``decoded``; null ids give null."""
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        coder = _model(model)
        for b in (whole.slice(lo, 500) for whole in batches for lo in range(0, whole.num_rows, 500)):
            texts = [coder.decode(np.frombuffer(i.as_buffer(), "<u4").tolist()) if i.is_valid else None for i in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
