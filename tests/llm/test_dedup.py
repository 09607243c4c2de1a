"""op3, op4, op5, op8, op9 against brute force, with hot groups, ties, nulls and empty tables."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from carelens.llm import decontaminate, embeddings, lines, minhash, substring
from carelens.llm.links import components

LOWER = {c: c + 32 for c in range(65, 91)}


def smallest(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest({n for a, b in links if a != b for n in (a, b)}, [(a, b) for a, b in links if a != b])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op5 ---------------------------------------------------------------------

def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def check_minhash(spark, rows, n, percent, most):
    docs = spark.createDataFrame([(d, t, "z", 0) for d, t in rows], "doc_id long, text string, Doc_Id string, component_id int")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, n, percent, most=most).collect()}
    sets = {}
    for d, t in rows:
        sets.setdefault(d, shingles(t, n))
    ids = sorted(d for d in sets if d is not None)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = smallest(ids, links)
    for d in ids:
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(sets[d]), low[d], low[d] == d), d
    return got, docs, len(links)


def near_copies(rng, base, count, changes):
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randrange(changes + 1)):
            words[rng.randrange(len(words))] = "v%d" % rng.randrange(10**6)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("n, percent, most", [(3, 85, 1024), (5, 80, 16)])
def test_minhash(spark, n, percent, most):
    rng = random.Random(n)
    words = ["w%d" % i for i in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(60)]
    for size, changes in ((120, 9), (25, 6), (8, 3)):  # copies around the threshold, more than a third of the rows
        texts += near_copies(rng, rng.choices(words, k=150), size, changes)
    texts += [texts[0].upper(), texts[0].replace(" ", "\t\n"), None, "", "  ", "one", "ONE", "one two", "w " * 30_000]
    rng.shuffle(texts)
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    got, docs, links = check_minhash(spark, rows + [(None, "one"), rows[0]], n, percent, most)
    assert links > 500 and got[None].kept and got[None].component_id is None
    kept = minhash.keep_first(docs, n, percent)
    assert kept.columns == docs.columns
    left = [r[0] for r in kept.collect()]
    assert sorted(left) == sorted(d for d, r in got.items() if d is not None and r.kept)  # the row without an id is a copy of "one"
    assert minhash.near_duplicates(docs.limit(0), n, percent).count() == 0


def test_keep_first_of_repeated_and_missing_ids(spark):
    a, b, c = "one two three four five six seven", "quite another text with other words in it", "a third one that nobody else has at all"
    schema = "doc_id long, text string, Text string, key int, hash string, row int"
    left = lambda rows: sorted((
        (r[0], r[1]) for r in minhash.keep_first(spark.createDataFrame([(*r, "x", 1, "h", 2) for r in rows], schema)).collect()), key=str)
    assert left([(1, a), (2, a), (2, b), (None, a), (None, a), (3, b), (3, b)]) == [(1, a), (2, b)]
    assert left([(1, a), (1, a)]) == [(1, a)]
    assert left([(None, a), (None, a), (None, b)]) == [(None, a), (None, b)]
    assert left([(5, a), (5, b), (5, c), (4, c)]) == [(4, c), (5, a), (5, b)]
    assert left([(1, None), (1, None), (2, ""), (None, ""), (3, a)]) == sorted([(1, None), (2, ""), (None, ""), (3, a)], key=str)
    assert left([]) == []


def test_groups_are_dealt_by_the_size_of_their_sets(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(3000)]
    texts = near_copies(rng, rng.choices(words, k=150), 150, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {tuple(r) for r in minhash.near_duplicates(docs, 3, 85).collect()}
    for most, heavy in ((4096, 20_000), (40, 10**9)):
        assert {tuple(r) for r in minhash.near_duplicates(docs, 3, 85, most=most, heavy=heavy).collect()} == want


def test_minhash_bounds():
    assert (1 - 0.8**5) ** minhash.band_count(0.8, 5, 1e-6) <= 1e-6
    need = minhash.least_matches(40, 0.8, 1e-6)
    assert 0 < need < 32 and minhash.least_matches(40, 0.8, 1e-2) > need


# --- op4 ---------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        if kind == 0:
            s.insert(i, rng.choice("abé"))
        elif s and kind == 1:
            s.pop(min(i, len(s) - 1))
        elif s:
            s[min(i, len(s) - 1)] = rng.choice("abé")
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_join_kernel(edits):
    rng = random.Random(edits)
    left = ["".join(rng.choices("abé", k=rng.randrange(8, 30))) for _ in range(800)] + ["", "a", "x" * 9000]
    right = [edited(rng, s, rng.randrange(edits + 3)) for s in left[:800]] + ["a", "", "x" * 9000 + "y"]
    near = np.array([distance(a, b) <= edits for a, b in zip(left[:802], right)] + [True])
    assert (lines.close(left, right, edits) == near).all()
    (pa, ia, qa), (pb, ib, qb) = lines.line_keys(left[:800], edits), lines.line_keys(right[:800], edits)
    for k in np.flatnonzero(near[:800]):
        assert bin((int(pa[k]) ^ int(pb[k])) & (1 << 64) - 1).count("1") <= 4 * edits
        short, long = (ia[k], qb[k]) if len(left[k]) <= len(right[k]) else (ib[k], qa[k])
        assert set(short) & set(long)


@pytest.mark.parametrize("edits, least_docs", [(1, 2), (2, 2), (1, 4)])
def test_line_dedup(spark, edits, least_docs):
    rng = random.Random(10 * edits + least_docs)
    pool = ["".join(rng.choices("abcdefgh ", k=rng.randrange(6, 60))) for _ in range(60)]
    hot = "the same footer stands under all of these pages"
    rows = []
    for d in range(80):
        text = [edited(rng, rng.choice(pool), rng.randrange(3)) for _ in range(rng.randrange(6))] + [hot] * (d % 2)
        rows.append((3 * d % 80, "\n".join(text)))
    rows += [(90, None), (91, ""), (None, hot + "\n" + pool[0]), rows[3], (92, "  " + hot + " \t\nshort"), (93, "\n\n"), (94, hot)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, TEXT int")
    out = lines.remove_repeats(docs, edits, least_docs, min_chars=20)
    assert out.columns == docs.columns
    places = []
    for d, t in rows:
        places += [((d is None, d), t, i, s.strip(lines.BLANKS)) for i, s in enumerate((t or "").split("\n"))]
    places = [p for p in places if len(p[3]) >= 20]
    distinct = sorted({p[3] for p in places})
    low = smallest(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if distance(a, b) <= edits])
    members = {}
    for p in places:
        members.setdefault(low[p[3]], []).append(p)
    gone = set()
    for group in members.values():
        if len({p[0] for p in group}) >= least_docs:
            first = min((p[0], p[2]) for p in group)
            gone |= {(p[0], p[1], p[2]) for p in group if (p[0], p[2]) != first}
    want = []
    for d, t in rows:
        kept = None if t is None else "\n".join(s for i, s in enumerate(t.split("\n")) if ((d is None, d), t, i) not in gone)
        want.append((d, kept))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r[0], r[1]) for r in out.collect()], key=key) == sorted(want, key=key)
    dropped = lines.remove_repeats(docs, edits, least_docs, min_chars=20, drop_emptied=True)
    assert dropped.count() == sum(k is None or k == t or bool(k.strip(lines.BLANKS + "\n")) for (_, k), (_, t) in zip(want, rows))
    assert lines.remove_repeats(docs.limit(0)).count() == 0


def test_short_lines_are_compared_as_they_are(spark):
    rows = [(1, "All rights reserved.\nSee more\n\n}"), (2, "all rights reserved.\n  See more \t\n\n}"), (3, "Menu\nAll rights reserved."),
            (4, "Menu\nMenu!"), (None, "Menu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in lines.remove_repeats(docs, short=True).collect()}
    assert out == {1: rows[0][1], 2: "all rights reserved.\n", 3: "Menu", 4: "Menu!", None: ""}
    out = {r.doc_id: r.text for r in lines.remove_repeats(docs).collect()}
    assert out == dict(rows)


def test_lines_repeated_inside_one_document(spark):
    line = "one line of more than twenty-four characters"
    rows = [(1, f"{line}\na\n{line}.\nb\na"), (2, "c\nd"), (None, "e\nf"), (None, "g\nf")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = lines.remove_repeats(docs, least_docs=1, short=True)
    left = sorted(r.text for r in out.collect())
    assert left[:2] == ["c\nd", "e"] + [] or left[0] == "c\nd"
    assert f"{line}\na\nb" in left and sum("f" in t.split("\n") for t in left) == 1
    # rows without a doc_id are documents of their own: two of them share a line
    out = lines.remove_repeats(docs, least_docs=2, short=True)
    left = [r.text for r in out.collect()]
    assert rows[0][1] in left and sum("f" in t.split("\n") for t in left) == 1


def test_documents_that_lose_most_of_their_text_go_whole(spark):
    words = ["w%d" % i for i in range(400)]
    parts = [" ".join(words[i:i + 40]) for i in range(0, 400, 40)]
    own = "an own line that no other document has but this one " * 30
    rows = [(5, "\n".join(parts)), (7, "\n".join(parts[:9] + ["x y z"])), (8, own + "\n" + parts[2]), (9, parts[0] + "\n" + parts[1]),
            (None, "\n".join(parts)), (11, own[:-1]), (12, None), (13, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in lines.remove_repeats(docs, short=True, most_cut=0.5).collect()}
    assert out == {5: rows[0][1], 8: rows[2][1].split("\n")[0], 12: None, 13: ""}
    left = corpus_pipeline.dedup_lines(spark, docs, "")  # the stage: more than six documents
    assert {r.doc_id: r.text for r in left.collect()} == dict(rows)


# --- op8 ---------------------------------------------------------------------

@pytest.mark.parametrize("window, hot", [(13, 200_000), (13, 3), (4, 5), (2, 200_000)])
def test_substring_dedup(spark, monkeypatch, window, hot):
    monkeypatch.setattr(substring, "MOST_HOT", 10**6)
    rng = random.Random(window + hot)
    words = ["w%d" % i for i in range(500)] + ["É", "é"]
    passage = rng.choices(words, k=60)
    texts = []
    for i in range(90):
        text = rng.choices(words, k=rng.randrange(0, 60))
        if i % 3 == 0:  # a third shares a passage
            text[5:5] = passage[rng.randrange(20):]
        texts.append(" ".join(text))
    texts += [texts[0]] * 5 + [texts[1].replace(" ", "\n\t"), None, "", "same " * 3000, "same " * 40, " ".join(passage[:window])]
    rows = [(11 * i % 997, t) for i, t in enumerate(texts)]
    rows += [(None, texts[0]), (None, texts[0]), (rows[0][0], "a doc id that repeats " + " ".join(passage))]
    docs = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, n_words string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_removed, r.kept) for r in
                 substring.remove_repeats(docs, window, hot).collect())
    split = [(float("inf") if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    low = {}
    for d, ws in split:
        for i in range(len(ws) - window + 1):
            s = tuple(ws[i:i + window])
            low[s] = min(low.get(s, d), d)
    want = []
    for (d, _), (e, ws) in zip(rows, split):
        out = {j for i in range(len(ws) - window + 1) if low[tuple(ws[i:i + window])] < e for j in range(i, i + window)}
        want.append((d is None, d, len(ws), len(out), " ".join(w for j, w in enumerate(ws) if j not in out)))
    assert got == sorted(want)
    assert substring.remove_repeats(docs.limit(0), window, hot).count() == 0


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring, "window_hashes", lambda h, k, seed=0: np.zeros(len(h) - k + 1, np.uint64))
    low, counts = substring.first_documents([b"a b c d", b"a b c", b"x y z", b"b c d"], np.array([9, 4, 2, 1]), 3)
    assert low.tolist() == [4, 1, 4, 2, 1] and counts.tolist() == [2, 1, 1, 1]


# --- op9 ---------------------------------------------------------------------

def test_decontamination(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(300)] + ["Éa", "日本"]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(10, 25)))) for i in range(40)]
    items += [(50, "Short, item"), (50, items[3][1]), (51, None), (52, "..."), (None, items[4][1]), (10, items[0][1])]
    texts = [" ".join(rng.choices(words, k=50)) for _ in range(60)]
    for i in range(0, 60, 2):
        texts[i] += " | " + items[i % 40][1].upper().replace(" ", ", ") + "!" + texts[i + 1][:40]
    texts += [None, "", "a short ITEM here", items[1][1], items[1][1][3:], "pad " * 20_000 + items[2][1]]
    rows = list(enumerate(texts)) + [(None, items[4][1]), (0, texts[0])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, HITS int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    runs = {}
    for i, t in items:
        ws = fold(t)
        k = min(10, len(ws))
        for j in range(len(ws) - k + 1 if k else 0):
            runs.setdefault(tuple(ws[j:j + k]), set()).add(i)
    want = []
    for d, t in rows:
        ws, hits, found = fold(t), set(), set()
        for k in {len(r) for r in runs}:
            for j in range(len(ws) - k + 1):
                if (owners := runs.get(tuple(ws[j:j + k]))) is not None:
                    hits |= set(range(j, j + k))
                    found |= owners
        want.append((d is None, d, len(ws), sorted(hits), sorted(i for i in found if i is not None)))
    for most in (32_000_000, 700):  # one slice, many slices
        got = decontaminate.scan(docs.select("doc_id", "text"), bench, 10, most).collect()
        assert sorted((r.doc_id is None, r.doc_id, r.n_words, r.hits, r["items"]) for r in got) == sorted(want)
    assert sum(bool(w[3]) for w in want) > 30
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[3] for w in want)
    cut = decontaminate.decontaminate(docs, bench, remove="spans")
    assert cut.columns == docs.columns
    left = {(r[0], r[1]) for r in cut.collect()}
    assert (62, "a  here") in left and all(t is None or (d, t) in left for (d, t), w in zip(rows, want) if not w[3])
    assert decontaminate.scan(docs.limit(0).select("doc_id", "text"), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


# --- op3 ---------------------------------------------------------------------

@pytest.mark.parametrize("most, occupancy", [(2048, 128), (16, 8)])
def test_embeddings(spark, most, occupancy):
    rng = np.random.default_rng(occupancy)
    base = rng.standard_normal((120, 24))
    near = base[rng.integers(0, 6, 150)] + 0.13 * rng.standard_normal((150, 24))  # around the threshold
    chain = [np.concatenate([[np.cos(a), np.sin(a)], np.zeros(22)]) for a in np.arange(0, 2.5, 0.25)]
    vectors = [v.tolist() for v in [*base, *near, *chain]] + [(3 * base[7]).tolist()] * 2 + [base[8].tolist()] * 60
    vectors += [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None] * 12, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0],
                [1e-320] * 24, [1e300] * 24]
    rows = [(13 * i % 1009, v, i % 3) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows + [rows[0], (None, vectors[0], 1)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame, occupancy=occupancy, most=most).collect()}
    good = {i: np.array(v, float) / max(map(abs, v)) for i, v, _ in rows
            if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    low = smallest([r[0] for r in rows], links)
    degree = {i: 0 for i, _, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {
        i: (degree[i], low[i], low[i] == i) for i in degree}
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_collisions_are_calibrated():
    least = embeddings.least_collisions(64, 1e-6)
    rng = np.random.default_rng(1)
    a = rng.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal((4000, 32))
    side -= (side * a).sum(axis=1)[:, None] * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side / np.linalg.norm(side, axis=1)[:, None]
    step = embeddings.WIDTH * np.sqrt(0.1) / embeddings.STEPS
    directions = embeddings._directions(32, 64, 2)
    gap = np.abs(np.rint(a @ directions / step) - np.rint(b @ directions / step))
    assert ((gap <= embeddings.STEPS + 1).sum(axis=1) >= least).all()
    assert embeddings.table_count(9, 0.95, 1e-6) < 40




def test_components_of_few_links_take_few_tasks(spark):
    from carelens.llm.links import components

    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = components(spark.createDataFrame([(i, i + 1) for i in range(5)] + [(40, 30), (None, 3)], "a long, b long"))
        assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(6)] + [(30, 30), (40, 30)]
        assert found.rdd.getNumPartitions() < 80  # of one table, and of the distinct ids made from it
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_steps_of_few_links_are_checkpointed_in_few_files(spark, monkeypatch):
    from carelens.llm import links

    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    parts = []

    def cut(df, plain=links.cut):
        out = plain(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(links, "cut", cut)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = links.components(spark.createDataFrame([(i, i + 1) for i in range(5)], "a long, b long"))
        assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(6)]
        assert len(parts) > 2 and set(parts[1:]) == {1}  # the first table is not counted yet
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_blocks_of_strings_keep_groups_in_few_bytes():
    import numpy as np

    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(-2**63, 2**63 - 1, 2000).repeat(2))
    strings = [str(i).encode() for i in range(len(keys))]
    docs, several = np.arange(len(keys)) + 2**40, np.arange(len(keys)) % 3 == 0
    block = substring._block(keys, docs, several, strings)
    short, got_docs, got_several, got = substring._unblock(block)
    assert got == strings and (got_docs == docs).all() and (got_several == several).all()
    assert ((short[1:] == short[:-1]) == (keys[1:] == keys[:-1])).all()
    assert len(block) < len(substring.zstandard.ZstdCompressor(level=3).compress(
        keys.tobytes() + docs.tobytes() + several.tobytes() + b"\n".join(strings)))


def test_memory_of_an_earlier_stage_goes_back_to_the_system(monkeypatch):
    import re
    from pathlib import Path
    from types import SimpleNamespace

    from carelens.llm import shared

    def resident():
        return int(re.search(r"\nRss:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024

    def blocks(n):
        return [bytes(3000) for _ in range(n)]

    stage = SimpleNamespace(stageId=lambda: 1)
    monkeypatch.setattr(shared, "TaskContext", SimpleNamespace(get=lambda: stage))
    monkeypatch.setattr(shared, "_KEPT", {})
    shared.stage_memo("large", lambda: blocks(60_000))
    last = blocks(1)  # above the others, so what they leave is no end of the heap
    full = resident()
    stage.stageId = lambda: 2
    shared.stage_memo("begun", object)
    assert last and full - resident() > 120
