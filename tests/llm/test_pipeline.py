"""The pipeline's stages against plain versions, and the queries' SQL."""

import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from carelens.llm import queries

SF = "/root/testdata/sf0.01"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        made = spark.read.parquet(f"{folder}/{name}")
        out[name] = ({r.doc_id: r for r in docs.collect()} if "text" in docs.columns else {}, made)
        docs = made
    return out


def test_stages_keep_the_columns_and_only_drop_rows(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for name in list(stages)[:-1]:
        before, made = stages[name]
        assert made.columns == columns
        rows = made.collect()
        assert len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= set(before)
        if name != "lines":
            assert all(before[r.doc_id] == r for r in rows)


def test_quality_stage(spark, stages):
    before, made = stages["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in made.collect()}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert sum(d in kept for d in bad) <= 0.2 * len(bad)


def test_lines_stage_cuts_whole_lines(stages):
    before, made = stages["lines"]
    for r in made.collect():
        left, lines = r.text.split("\n"), iter(before[r.doc_id].text.split("\n"))
        assert r.text == before[r.doc_id].text or all(line in lines for line in left)


def line_classes(found):
    """A name for the class of each line: linked by one edit from 24 characters on."""
    low = {s: s for s in found}

    def name(s):
        while low[s] != s:
            s = low[s]
        return s

    def close(a, b):
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]

    shorter = {}  # lines within one edit share themselves or one less character
    for s in found:
        if len(s) >= 24:
            for v in {s, *(s[:i] + s[i + 1:] for i in range(len(s)))}:
                shorter.setdefault(hash(v), []).append(s)
    for group in shorter.values():
        for a, b in itertools.combinations(group, 2):
            if close(a, b):
                a, b = sorted((name(a), name(b)))
                low[b] = a
    return {s: name(s) for s in found}


def test_lines_stage_equals_a_plain_version(stages):
    before, made = stages["lines"]
    split = {d: [s.strip(" \t\r\x0b\x0c") for s in r.text.split("\n")] for d, r in before.items()}
    classes = line_classes({s for ls in split.values() for s in ls if s})
    split = {d: [classes.get(s) for s in ls] for d, ls in split.items()}

    first, holders = {}, {}
    for d in sorted(split):
        for i, c in enumerate(split[d]):
            first.setdefault(c, (d, i))
            holders.setdefault(c, set()).add(d)
    want = {}
    for d, ls in split.items():
        text = before[d].text
        kept = [s for i, (s, c) in enumerate(zip(text.split("\n"), ls)) if not c or len(holders[c]) < 7 or first[c] == (d, i)]
        if len(kept) == len(ls) or ("".join(kept).strip(" \t\r\x0b\x0c") and len(text) - len("\n".join(kept)) < 0.5 * len(text)):
            want[d] = "\n".join(kept)
    assert len(want) < len(before) and sum(t != before[d].text for d, t in want.items()) > 20
    assert {r.doc_id: r.text for r in made.collect()} == want


def test_near_stage(stages):
    before, made = stages["near"]
    sets = {}
    for d, r in before.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(LOWER))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    ids = sorted(d for d in sets if sets[d])
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if not sets[a].isdisjoint(sets[b])
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    assert {r.doc_id for r in made.collect()} == {d for d in low if low[d] == d}


def test_leaks_stage(spark, stages):
    before, made = stages["leaks"]
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    runs = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = fold(r.text)
        runs |= {tuple(w[i:i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)}
    words, sizes = {d: fold(r.text) for d, r in before.items()}, {len(x) for x in runs}
    clean = {d for d, w in words.items() if not any(tuple(w[i:i + n]) in runs for n in sizes for i in range(len(w)))}
    assert {r.doc_id for r in made.collect()} == clean


def test_packing_stage_holds_every_id_in_order(stages):
    before, made = stages["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rows = sorted(made.collect(), key=lambda r: (r.sequence_id, r.offset))
    assert {r.doc_id for r in rows} == set(before)
    place, done = (0, 0), {}
    for r in rows:
        place = place if r.sequence_id == place[0] else (r.sequence_id, 0)
        assert (r.sequence_id, r.offset) == place and place[1] + r.length <= 2048  # gapless
        place = (r.sequence_id, place[1] + r.length)
        ids = done.setdefault(r.doc_id, np.array([*library.encode(before[r.doc_id].text, add_special_tokens=False).ids, 1], "<u4"))
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert sum(r.length for r in rows) == sum(map(len, done.values()))


def odd_documents(spark):
    """Nulls, empty and repeated texts, repeated and missing ids, clashing and extra columns."""
    good = " ".join(f"word{i % 17} and more of it, number {i}." for i in range(60))
    other = "Something else that is quite long enough to be kept by any filter here. " * 5
    shared = [(100 + i, f"A line that very many documents share, word for word.\nown text {i} " + "of a document " * (5 + i)) for i in range(8)]
    rows = [(1, good), (1, good), (2, good.replace("number 7.", "number x.")), (2, other), (3, other), (None, good), (None, other), (None, None),
            (4, None), (5, ""), (6, " \n\t"), (7, "x"), (8, "word " * 30_000), *shared]
    schema = "doc_id long, text string, lang string, source string, n_chars long, Text string, `text ` string, row int, `key` int, hash string, " \
             "score double, left string, gone int, items int, hits string, doc int, tie int"
    return rows, spark.createDataFrame([(d, t, "en", "s", 5, "T", "t ", 1, 2, "h", 0.5, "l", 3, 4, "x", 5, 6) for d, t in rows], schema)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows_and_empty_tables(spark, name):
    rows, docs = odd_documents(spark)
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs.limit(0), SF).count() == 0
    made = stage(spark, docs, SF)
    if name == "packing":
        done = Counter()
        for r in made.collect():
            done[r.doc_id] += r.length
        library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        want = Counter()
        for d, t in rows:
            want[d] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
        assert done == want
        return
    assert made.columns == docs.columns
    got = made.collect()
    texts = [(r[0], r[1]) for r in got]
    assert all(tuple(r)[2:] == tuple(docs.first())[2:] for r in got)
    if name == "lines":
        first = next(t for d, t in rows if d == 100)
        assert (100, first) in texts and all((100 + i, rows[13 + i][1].split("\n")[1]) in texts for i in range(1, 8))
        rest = [sorted((x for x in some if x[0] not in range(100, 108)), key=str) for some in (rows, texts)]
        assert rest[0] == rest[1]
    elif name == "near":
        want = [(1, rows[0][1]), (2, rows[3][1]), (4, None), (5, ""), (6, " \n\t"), (7, "x"), (8, rows[12][1]), (None, None), *rows[13:]]
        assert sorted(texts, key=str) == sorted(want, key=str)
    elif name == "leaks":
        assert sorted(texts, key=str) == sorted(rows, key=str)
    else:
        assert set(texts) <= set(rows)


def test_run_equals_the_stages(spark, stages):
    run = corpus_pipeline.run(spark, SF)
    made = stages["packing"][1]
    assert run.exceptAll(made).count() == 0 and made.exceptAll(run).count() == 0


def test_entry_has_every_operator():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if re.match(r"op\d", n)}
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "lines", "near", "leaks", "packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    made = queries.QUERIES[name](spark, SF)
    assert sorted(made.columns) == sorted(columns)
    got = [tuple(r[c] for c in columns) for r in made.collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
