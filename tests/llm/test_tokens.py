"""op2 and op6: token files and packing against the tokenizers library run on whole texts."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carelens.llm import packing, token_files, tokens
from carelens.llm.tokens import ChunkEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a ", " a", "a  b", "a \n b\n\n c", "x  y   z", "it's we're 's ' s 'something I'LL", "<|endoftext|> a",
       "\t\t a", "a\n", "日本 語 ok", "a 　b", "1 22 a1 ...'s", "a.\nB c,d\n\nE it's x\n y", "é.É×a ÷b",
       "x\n\n\ny z.\n\tw", "a\x00b \x1cc", "ﬁń \U0001f600 ok", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts(library):
    rng = random.Random(3)
    parts = ["the", "The", ",", ".", "\n", " ", "  ", "'s", "don't", "é", "ß", "42", "\t", "–", "🙂", "漢字", "|", " ", "x" * 40]
    texts = ODD + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(60))) for _ in range(400)]
    for most in (50, 100_000):  # a small memo is emptied all the time
        coder = ChunkEncoder(PATH, most)
        for lo in range(0, len(texts), 40):
            for text, ids in zip(texts[lo:lo + 40], coder.encode(texts[lo:lo + 40])):
                assert ids.tolist() == ids_of(library, text), text[:80]


def test_a_batch_looks_each_chunk_up_once_and_cuts_new_ones_into_distinct_pieces(library):
    class Counted(type(ChunkEncoder(PATH).heads)):
        looked = 0

        def __getitem__(self, chunk):
            self.looked += 1
            return super().__getitem__(chunk)

    class Model:
        seen = []

        def tokenize(self, piece):
            self.seen.append(piece)
            return library.model.tokenize(piece)

    coder = ChunkEncoder(PATH)
    coder.after_space, coder.model = Counted(150_000), Model()
    texts = ["a tree, a tree. a tree's\nleaf and  wood"] * 50
    assert [i.tolist() for i in coder.encode(texts)] == [ids_of(library, texts[0])] * 50
    assert coder.after_space.looked == 6  # "tree,", "a", "tree.", "tree's\nleaf", "and ", "wood"
    assert sorted(Model.seen) == sorted({"\u0120tree", ",", "\u0120a", ".", "'s", "\u010a", "leaf", "\u0120wood"})


def test_tasks_do_not_use_the_threads_of_the_library(monkeypatch):
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "")  # restored afterwards
    monkeypatch.delenv("TOKENIZERS_PARALLELISM")
    tokens.encoder(PATH)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_memos_and_slices_of_a_task_stay_small(library, monkeypatch):
    coder = ChunkEncoder(PATH)
    monkeypatch.setattr(tokens, "encoder", lambda path: coder)
    texts = [" ".join(f"w{1000 * i + j}" for j in range(1000)) for i in range(300)]
    b = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    sizes = []
    for ids, rows in tokens.encoded(iter([b]), PATH, 2):
        assert rows[-1].tolist() == ids_of(library, texts[ids[-1]]) + [2]
        assert len(coder.after_space) <= 150_000 + 1000 * len(ids)
        sizes.append(sum(len(texts[d]) for d in ids))
    assert max(sizes) < 520_000 and sum(sizes) == sum(map(len, texts))


@pytest.mark.parametrize("group", [1, 30, 500_000])
def test_slices_of_a_batch_hold_every_row_in_order(library, monkeypatch, group):
    monkeypatch.setattr(tokens, "GROUP", group)
    texts = [None, *ODD, None]
    b = pa.RecordBatch.from_arrays([pa.array([None, *range(len(texts) - 1)], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = [(d, i.tolist()) for ids, rows in tokens.encoded(iter([b.slice(0, 0), b]), PATH, 2) for d, i in zip(ids, rows)]
    assert got == [(d, ids_of(library, t) + [2]) for d, t in zip([None, *range(len(texts) - 1)], texts)]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
@pytest.mark.parametrize("high", [1, 2, 50257, 2**31, 2**32])
def test_blocks_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n).astype(np.uint32)
    ids[::9] = 0
    payload = token_files.encode_ids(ids)
    assert (token_files.decode_ids(payload) == ids).all()
    for block in range(-(-n // token_files.BLOCK)):
        assert (token_files.read_block(payload, block) == ids[128 * block:128 * (block + 1)]).all()


def test_rare_large_ids_go_to_exception_lists():
    ids = np.arange(128, dtype=np.uint32) % 16
    ids[5] = 50_000
    assert len(token_files.encode_ids(ids)) < token_files.HEAD.size + 4 + 6 + 16 * 5 + 5


def documents(spark):
    rows = [(5, "five words in this text"), (3, None), (4, ""), (None, "no id"), (7, "same"), (7, "same"), (7, "other"),
            (1, "long text, " * 900)] + [(100 + i, t) for i, t in enumerate(ODD)]
    return rows, spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, Text string, ids int")


def test_token_files(spark, workdir, library):
    rows, docs = documents(spark)
    token_files.write_token_files(docs, f"{workdir}/files", PATH, end_id=2, segment_ids=500)
    got = sorted(token_files.read_token_files(spark, f"{workdir}/files").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([d for d, _ in rows], key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.start, r.n_tokens, ids[-1]) == (at, len(ids), 2)
        assert ids[:-1] in [ids_of(library, t) for d, t in rows if d == r.doc_id]
        at += len(ids)


def test_packing(spark, library):
    rows, docs = documents(spark)
    pieces = packing.pack(docs, PATH, end_id=1, length=64)
    got = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    run = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist()
    at = 0
    for r in got:
        assert (r.sequence_id, r.offset) == divmod(at, 64) and 0 < r.length <= 64 - r.offset
        at += r.length
    assert at == sum(len(ids_of(library, t)) + 1 for _, t in rows)
    by_doc = [r for r in got if r.doc_id == 1]
    assert sum((np.frombuffer(r.ids, "<u4").tolist() for r in by_doc), []) == ids_of(library, rows[7][1]) + [1]
    assert {r.doc_tokens for r in by_doc} == {len(ids_of(library, rows[7][1])) + 1}
    made = sorted(packing.sequences(pieces).collect(), key=lambda r: r.sequence_id)
    assert [r.n_tokens for r in made] == [64] * (at // 64) + [at % 64] * (at % 64 > 0)
    assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in made]).tolist() == run


def test_empty_tables(spark, workdir):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 0
    assert packing.sequences(packing.pack(docs, PATH)).count() == 0
    token_files.write_token_files(docs, f"{workdir}/none", PATH)
    assert token_files.read_token_files(spark, f"{workdir}/none").count() == 0


def test_spark_crc_is_unsigned(spark):
    raw = np.array([7, 9], "<u4").tobytes()
    assert spark.createDataFrame([(raw,)], "b binary").select(F.crc32("b")).first()[0] == zlib.crc32(raw)
