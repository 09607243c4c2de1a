"""op12: normalisation, ids, spans and decoding against the sentencepiece library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from carelens.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a", " a ", "a  b", "  two  spaces  ", "\t\n", "a\n\nb", "▁", "a▁b", "▁▁ x ▁", "<s>", "</s> <unk>", "<0x41>",
       "Ｆｕｌｌ　ｗｉｄｔｈ", "①②③ ½", "ﬁne ﬂow", "éäố", "한국어 각", "ｶﾞｷﾞ", "日本 語", "؀x", "😀😀 🏽",
       "a\x00b", "​ zero", " nb sp", "¨ ¨", "x" * 200, "ABC éÉ ß", "﻿ bom", "א ב", "ﷺ", "̈́", "line\r\nend "]


def variants():
    """The public model with other normalisers: compiled maps of the library's own rules, and other switches."""
    data = open(PATH, "rb").read()
    out = {"own": data}
    for rule in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"):
        for squeeze in (True, False):
            for prefix in (True, False):
                n = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True,
                                                          remove_extra_whitespaces=squeeze)
                spec = n.serialized_normalizer_spec()
                fields = b"".join(raw for f, _, _, raw in pieces.wire_fields(data) if f != 3)
                out[f"{rule}-{squeeze}-{prefix}"] = fields + b"\x1a" + pieces._with_size(len(spec)) + spec
    return out


def texts():
    rng = random.Random(5)
    parts = [*ODD, "the ", "word", "́", "̧", " ", "  ", "é", "가", "ᄀ", "ᅡ", "ᆨ", "Å", "ﾞ", "…", "\t", "\n", "İ", "ẞ"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(150)]


@pytest.mark.parametrize("name", variants())
def test_ids_spans_and_normal_form_are_the_librarys(name):
    data = variants()[name]
    library = sentencepiece.SentencePieceProcessor()
    library.load_from_serialized_proto(data)
    model = pieces.Model(data)
    for text in texts():
        normal, at = model.normalise(text)
        assert normal.tobytes().decode() == library.normalize(text), repr(text)
        ids, begins, ends = model.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), repr(text)
        found = library.encode_as_offset_mapping(text)["offsets"]
        places = np.array([0, *np.cumsum([len(c.encode()) for c in text])])
        want = [(int(places[a]), int(places[b])) for a, b in found]
        assert list(zip(begins[1:-1].tolist(), ends[1:-1].tolist())) == want, repr(text)
        assert model.decode(ids.tolist()) == library.decode(ids.tolist())
        assert (begins <= ends).all() and (ends <= len(text.encode())).all()


def test_spans_give_back_the_text():
    model = pieces.Model(open(PATH, "rb").read())
    for text in texts():
        _, begins, ends = model.encode(text)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(begins.tolist(), ends.tolist())) == raw


def test_long_texts_go_in_segments(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    model = pieces.Model(open(PATH, "rb").read())
    rng = random.Random(1)
    text = "".join(rng.choice(["word", " ", "  ", "é", "\n", "漢", "ing", "▁"]) for _ in range(5000)) + " " * 300 + "x" * 900
    for segment in (1, 7, 400):
        monkeypatch.setattr(pieces, "SEGMENT", segment)
        assert len(model._segments(model.normalise(text)[0].tobytes().decode())) > 3
        assert model.encode(text)[0].tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_query_on_odd_rows(spark, workdir):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(None, "no id"), (1, None), (1, None), (2, "same"), (2, "same"), (2, "other"), (3, "long text " * 20_000),
            *((10 + i, t) for i, t in enumerate(ODD))]
    docs = spark.createDataFrame([(t, d, "x", 1) for d, t in rows], "text string, doc_id long, decoded string, ids int")
    for name, table in (("full", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{workdir}/{name}/documents.parquet")
        got = queries.QUERIES["op12_sentencepiece"](spark, f"{workdir}/{name}").select(
            "doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
        want = []
        for d, t in rows if name == "full" else []:
            ids = library.encode(t or "", add_bos=True, add_eos=True)
            want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_clashing_column_names_are_ignored(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 9)], "doc_id long, text string, Text string, IDS int")
    row = pieces.encode(docs, PATH).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [1, 264, 287, 2]


def test_stored_ids_are_decoded(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = [[1, 264, 287, 2], [], None, [1, 2], [30000] * 1200, [3 + 0xE6, 3 + 0x97], [3 + 0xF0, 300]]  # with broken byte pieces
    rows = spark.createDataFrame([(i, None if x is None else bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)],
                                 "n int, ids binary")
    got = {r.n: r.decoded for r in pieces.decode(rows, PATH).collect()}
    assert got == {i: None if x is None else library.decode(x) for i, x in enumerate(ids)}
