"""op13: the retracting stream against a plain audit of the whole table, whatever the order of files."""

import random
import re
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from carelens.llm import filter_audit, queries

MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {f for f, bad in zip("ABCD", (len(words) < 50, 100 * len(set(words)) < 65 * len(words),
                                         100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search(r"[#$%&*|]", text))) if bad}


def plain_audit(rows, labels):
    good, toxic = ({d for d, *marks in labels if d is not None and marks[k] == 1} for k in (0, 1))
    low = {}
    for d, t, _ in rows:
        if d is not None:
            low[t or ""] = min(d, low.get(t or "", d))
    fails = [(part or "", fails_of(t or "") | ({"E"} if d is not None and d > low[t or ""] else set()), d) for d, t, part in rows]
    out = {}
    for part in {p for p, _, _ in fails}:
        mine = [(f, d) for p, f, d in fails if p == part]
        share = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [(f, d) for f, d in left if x in f]
                out[part, "".join(order), k + 1] = [
                    len(left) - len(gone), len(gone), sum(x in f for f, _ in mine) - len(gone), sum(f == {x} for f, _ in mine),
                    sum(d in good for _, d in gone), sum(d in toxic for _, d in gone)]
                share[x] += len(gone)
                left = [(f, d) for f, d in left if x not in f]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return out


def rows_and_labels(n=120):
    rng = random.Random(11)
    texts = ["", None, " \t\n", "A" * 30, "#", "\x1c one \x85 two", "é" * 60, *(
        " ".join(rng.choice(["alpha", "Beta", "x%", "c", "d", "e" * rng.randrange(1, 9)] + [f"w{i}" for i in range(m)])
                 for _ in range(m)) for m in (20, 49, 50, 51, 80, 200)), "same text, " * 30, "w " * 3000]
    rows = [(rng.choice([None, *range(30), *range(2**60, 2**60 + 30)]), rng.choice(texts + ["one very common text"] * 8), rng.choice(["a", "b", None, "", "Ü'x"]))
            for _ in range(n)]
    rows += rows[:5]  # repeated rows
    labels = [(rng.choice([None, *range(35), *range(2**60, 2**60 + 35)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    return rows, labels


def write(folder, rows, labels, files, odd=True):
    columns = {"doc_id": pa.int64(), "text": pa.string(), "source": pa.string()}
    for i in range(files):
        mine = rows[i::files]
        table = pa.table({c: pa.array([r[k] for r in mine], t) for k, (c, t) in enumerate(columns.items())})
        if odd:
            table = table.append_column("Text", pa.array(["other"] * len(mine), pa.string())).append_column(
                "mask", pa.array([7] * len(mine), pa.int32()))
        (folder / "documents.parquet").mkdir(parents=True, exist_ok=True)
        pq.write_table(table, folder / "documents.parquet" / f"part-{i}.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in labels], pa.int64()), "quality": pa.array([r[1] for r in labels], pa.int32()),
                             "toxic": pa.array([r[2] for r in labels], pa.int32())}), folder / "labels.parquet")


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): [r[m] for m in MEASURES] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_equals_plain_version(spark, tmp_path):
    rows, labels = rows_and_labels()
    rows.sort(key=lambda r: -1 if r[0] is None else -r[0])  # small ids arrive last
    rows = [r for k in range(5) for r in rows[k * 25:(k + 1) * 25]]
    want = plain_audit(rows, labels)
    for i, files in enumerate((1, 5)):
        write(tmp_path / str(i), rows, labels, files)
        assert found(queries.QUERIES["op13_filter_audit"](spark, str(tmp_path / str(i)))) == want


def test_empty_tables(spark, tmp_path):
    write(tmp_path, [], [], 2)
    assert found(queries.QUERIES["op13_filter_audit"](spark, str(tmp_path))) == {}


def test_settings_of_the_session_are_put_back(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in filter_audit._STREAMING}
    write(tmp_path, [(1, "a", "x")], [], 1, odd=False)
    filter_audit.counters(spark, str(tmp_path / "documents.parquet"), spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert {k: spark.conf.get(k, None) for k in filter_audit._STREAMING} == before


@pytest.mark.parametrize("seed", range(20))
def test_retraction_does_not_depend_on_the_order_of_arrival(seed):
    rng = random.Random(seed)
    rows = [(3, rng.choice("ab"), rng.randrange(2), 0, rng.choice([None, 1, 2, 3, 9]), 1, 0) for _ in range(12)]
    known = [r[4] for r in rows if r[4] is not None]
    want = Counter((r[1:4], 3 if r[4] is None or r[4] == min(known) else 3 | filter_audit.COPY) for r in rows)
    rng.shuffle(rows)
    low, held, total = None, Counter(), Counter()
    for lo in range(0, 12, 4):  # three micro-batches
        low, held, changes = filter_audit.arrive(iter(rows[lo:lo + 4]), low, held)
        total.update(changes)
    assert {k: n for k, n in total.items() if n} == want


def test_earlier_mask_is_retracted():
    row = lambda at: (5, "p", 1, 0, at, 1, 0)
    low, held, first = filter_audit.arrive(iter([row(8)]), None, Counter())
    assert first[("p", 1, 0), 5] == 1
    _, _, second = filter_audit.arrive(iter([row(3)]), low, held)
    assert second[("p", 1, 0), 5] == 0 and second[("p", 1, 0), 21] == 1


def test_rows_of_one_text_are_combined_in_their_task():
    rng = random.Random(2)
    rows = [(7, "k%d" % (rng.randrange(3)), 1, rng.choice("ab"), 0, rng.randrange(2), rng.choice([None, 1, 2, 3])) for _ in range(300)]
    names = ["bucket", "key", "mask", "part", "good", "toxic", "doc_id"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[lo:lo + 50]], t) for i, t in enumerate(types)], names)
               for lo in range(0, 300, 50)]
    for most in (1, 120, 10**6):
        out = [r for b in filter_audit.combined(iter(batches), most) for r in b.to_pylist()]
        got = Counter()
        for r in out:
            got[tuple(r[c] for c in names[:6])] += r["at_low"] + r["above"]
        assert got == Counter(r[:6] for r in rows)
        if most == 10**6:
            assert len(out) <= 2 * len(got)
            for r in out:
                mine = [x[6] for x in rows if x[:6] == tuple(r[c] for c in names[:6]) and x[6] is not None]
                assert r["named"] or not r["low"]
                if r["named"]:
                    assert (r["low"], r["at_low"]) == (min(mine), mine.count(min(mine)))
