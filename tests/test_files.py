"""Real CSV/TSV files in a temp folder: headers, aliases, null tokens, ragged rows, ordinals, reload."""

import os

import pytest
from pyspark.sql import functions as F

from carelens.plans.jobs import ingest, summarise
from carelens.schema import HEADER_ALIASES
from carelens.sources.delimited import number_records, quarantined, read_discharge_file, read_records, read_tagged, saver, split_table
from carelens.sources.tables import read_summary

HEADERS = [h for h in HEADER_ALIASES if h != "County"]  # 33 headers


def row(**kv):
    base = {"Facility Name": "Fac A", "Discharge Year": "2021", "CCSR Diagnosis Code": "D1",
            "Length of Stay": "3", "Total Charges": "$1,027,545.65", "Hospital County": "Kings"}
    base.update(kv)
    return base


def write(path, headers, rows, sep=",", bom=False):
    def q(v):
        v = "" if v is None else str(v)
        return f'"{v}"' if (sep in v or '"' in v) else v
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8") as f:
        f.write(sep.join(headers) + "\n")
        for r in rows:
            f.write(sep.join(q(r.get(h)) for h in headers) + "\n")
    return path


def test_full_csv_and_tsv(spark, workdir):
    rows = [row(), row(**{"Facility Name": "Fac, B"})]
    c = write(os.path.join(workdir, "full.csv"), HEADERS, rows, bom=True)
    t = write(os.path.join(workdir, "full.tsv"), HEADERS, rows, sep="\t")
    u = write(os.path.join(workdir, "FULL.TSV"), HEADERS, rows, sep="\t")
    for p in (c, t, u):
        got = read_discharge_file(spark, p).orderBy("source_row_number").collect()
        assert [r["facility_name"] for r in got] == ["Fac A", "Fac, B"]
        assert [r["source_row_number"] for r in got] == [2, 3]
        assert got[0]["total_charges"] == "$1,027,545.65"
        assert got[0]["source_file_name"] == os.path.basename(p)


def test_county_alias_first_wins(spark, workdir):
    hs = ["Facility Name", "Discharge Year", "CCSR Diagnosis Code", "Length of Stay", "County"]
    p = write(os.path.join(workdir, "county.csv"), hs, [{**row(), "County": "Queens"}])
    assert read_discharge_file(spark, p).first()["hospital_county"] == "Queens"
    hs2 = hs[:4] + ["Hospital County", "County"]
    p2 = write(os.path.join(workdir, "both.csv"), hs2, [{**row(), "County": "Queens"}])
    assert read_discharge_file(spark, p2).first()["hospital_county"] == "Kings"


def test_minimal_missing_extra(spark, workdir):
    hs = ["Discharge Year", "CCSR Diagnosis Code", "Length of Stay"]
    p = write(os.path.join(workdir, "minimal.csv"), hs, [row()])
    r = read_discharge_file(spark, p).first()
    assert r["facility_name"] is None and r["discharge_year"] == "2021"
    with pytest.raises(ValueError, match="length_of_stay"):
        read_discharge_file(spark, write(os.path.join(workdir, "missing.csv"), hs[:2], [row()]))
    p3 = write(os.path.join(workdir, "extra.csv"), hs + ["Unknown Column"], [{**row(), "Unknown Column": "u"}])
    assert "Unknown Column" not in read_discharge_file(spark, p3).columns


def test_ragged_rows(spark, workdir):
    p = os.path.join(workdir, "ragged.csv")
    with open(p, "w") as f:
        f.write("Facility Name,Discharge Year,CCSR Diagnosis Code,Length of Stay\n")
        f.write("A,2021,D1,3\n")        # fine
        f.write("B,2021\n")             # short: padded
        f.write("C,2021,D1,3,xx\n")     # long: quarantined
        f.write("D,2021,D1,3,\n")       # long (one extra empty field): quarantined
        f.write("E,2021,D1,4\n")
        f.write("F,2021,D1,3,,\n")     # two extra empty fields
        f.write('"G, ""g""",2021,D1,"1, 2, 3, 4, 5"\n')  # separators inside quotes are none
        f.write('"H, h",2021,D1,3,"x, y",z\n')
    tagged = read_tagged(spark, p)
    assert tagged.where("_long").count() == 4
    rows, splits = read_records(spark, p, saver(spark, os.path.join(workdir, "read")))
    assert sorted((r.line, r.fields) for r in quarantined(rows, splits).collect()) == [(4, 5), (5, 5), (7, 6), (9, 6)]
    got = read_discharge_file(spark, p).orderBy("source_row_number").collect()
    assert [(r["facility_name"], r["source_row_number"]) for r in got] == [("A", 2), ("B", 3), ("E", 4), ('G, "g"', 5)]
    assert got[1]["length_of_stay"] is None


def test_null_tokens(spark, workdir):
    p = os.path.join(workdir, "nulls.csv")
    toks = ["", " ", "N/A", "NA", "NULL", "null", "nan", "#N/A", " NA "]
    with open(p, "w") as f:
        f.write("Facility Name,Race,Discharge Year,CCSR Diagnosis Code,Length of Stay\n")
        for t in toks:
            f.write(f"F,{t},2021,D1,3\n")
    got = [r["race"] for r in read_discharge_file(spark, p).orderBy("source_row_number").collect()]
    assert got == [None] * 8 + [" NA "]


def test_ordinals_across_many_splits(spark, workdir):
    p = os.path.join(workdir, "multi_split.csv")
    n = 3000
    with open(p, "w") as f:
        f.write("Facility Name,Race,Discharge Year,CCSR Diagnosis Code,Length of Stay\n")
        for i in range(n):
            f.write(f"F{i},r{i % 7},2021,D1,{i % 5}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_discharge_file(spark, p)
        blocks = read_tagged(spark, p).select("_block").distinct().count()
        got = {r["facility_name"]: r["source_row_number"] for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert blocks > 10
    assert got == {f"F{i}": i + 2 for i in range(n)}


def test_ingest_twice_and_summarise(spark, workdir):
    rows = [row(), row(), row(**{"Facility Name": "Fac B", "Gender": "female"}),
            row(**{"Facility Name": "Redacted for Confidentiality"}), row(**{"Length of Stay": "120 +"})]
    p = write(os.path.join(workdir, "load.csv"), HEADERS, rows)
    target = os.path.join(workdir, "fact")
    first = ingest(spark, p, target, current_year=2024)
    assert first["input_rows"] == 5 and first["inserted_rows"] == 2 and first["clean_rows"] == 2
    assert first["exact_duplicate_rows"] == 1 and first["discarded_redacted_facility_rows"] == 1
    assert first["discarded_core_missing_rows"] == 1 and first["invalid_numeric_values"] == 1
    second = ingest(spark, p, target, current_year=2024)
    assert second["inserted_rows"] == 0 and second["clean_rows"] == 2
    fact = spark.read.parquet(target)
    assert fact.count() == 2
    assert fact.where(F.col("created_at").isNull()).count() == 0
    out = os.path.join(workdir, "summaries")
    summarise(spark, target, out)
    op = read_summary(spark, os.path.join(out, "hospital_operation_summary"))
    assert op.agg(F.sum("discharge_count")).first()[0] == 2
    assert op.where(F.col("updated_at").isNull()).count() == 0


def test_split_layout_does_not_change_the_load(spark, workdir):
    p = os.path.join(workdir, "splits.csv")
    with open(p, "w") as f:
        f.write("Facility Name,Race,Discharge Year,CCSR Diagnosis Code,Length of Stay\n")
        for i in range(2000):
            f.write(f"F{i % 300},r{i % 3},2021,D{i % 11},{i % 4}\n")  # many exact repeats
    loads = []
    for size in ("2048", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            target = os.path.join(workdir, f"fact_{size}")
            counters = ingest(spark, p, target, current_year=2024)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        rows = sorted((r["source_row_hash"], r["source_row_number"])
                      for r in spark.read.parquet(target).select("source_row_hash", "source_row_number").collect())
        loads.append((counters, rows))
    assert loads[0] == loads[1]
    assert loads[0][0]["inserted_rows"] == len({(i % 300, i % 3, i % 11, i % 4) for i in range(2000)})


def test_bucketed_table_target(spark, workdir):
    from carelens.operators.clean import clean_records, collapse_duplicates, stage
    from carelens.operators.load import new_records
    from carelens.sources.delimited import read_discharge_file

    rows = [row(**{"Facility Name": f"Fac {i % 40}", "Race": f"r{i}"}) for i in range(300)]
    p = write(os.path.join(workdir, "bucketed.csv"), HEADERS, rows)
    first = ingest(spark, p, "fact_bucketed", current_year=2024)
    assert first["inserted_rows"] == 300
    again = ingest(spark, p, "fact_bucketed", current_year=2024)
    assert again["inserted_rows"] == 0 and spark.table("fact_bucketed").count() == 300
    # the existing side of the semi join is read bucketed: no shuffle above its scan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # written out first, as the ingest job does
        clean_records(collapse_duplicates(stage(read_discharge_file(spark, p), 2024))).write.parquet(f"{workdir}/clean")
        clean = spark.read.parquet(f"{workdir}/clean")
        plan = new_records(clean, spark.table("fact_bucketed"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    assert "Sort" in lines[scan - 1] and "Exchange" not in lines[scan - 1]


def test_folder_of_files(spark, workdir):
    folder = os.path.join(workdir, "drop")
    os.makedirs(folder)
    write(os.path.join(folder, "b.csv"), HEADERS, [row(**{"Race": "b"})])
    write(os.path.join(folder, "a.TSV"), HEADERS, [row(**{"Race": "a"}), row(**{"Race": "c"})], sep="\t")
    write(os.path.join(folder, "_skip.csv"), HEADERS, [row(**{"Race": "z"})])
    got = sorted((r["source_file_name"], r["source_row_number"], r["race"])
                 for r in read_discharge_file(spark, folder).collect())
    assert got == [("a.TSV", 2, "a"), ("a.TSV", 3, "c"), ("b.csv", 2, "b")]


def test_text_is_scanned_once(spark, workdir):
    p = write(os.path.join(workdir, "one.csv"), HEADERS, [row(), row()])
    plan = read_tagged(spark, p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1


def test_quarantined_lines_take_no_ordinal_in_any_split(spark, workdir):
    p = os.path.join(workdir, "ragged.csv")
    good = row(**{"Race": "x" * 200})
    with open(p, "w", encoding="utf-8") as f:
        f.write(",".join(f'"{h}"' for h in HEADERS) + "\n")
        want = []
        for i in range(400):
            values = [f'"{good.get(h) or ""}"' for h in HEADERS]
            if i % 7 == 3 or 100 < i < 110:
                values += ["extra", "fields"]
            else:
                want.append(len(want) + 2)
            f.write(",".join(values) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        got = sorted(r[0] for r in read_discharge_file(spark, p).select("source_row_number").collect())
    finally:
        spark.conf.set(key, before)
    assert got == want


def test_split_table_does_not_grow_with_quarantined_lines(spark, workdir):
    p = os.path.join(workdir, "thirds.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("Facility Name,Discharge Year,CCSR Diagnosis Code,Length of Stay\n")
        for i in range(300):
            f.write(f"F{i},2021,D1,3" + (",long,row" if i % 3 == 0 else "") + "\n")
    tagged = read_tagged(spark, p)
    rows = tagged.collect()
    assert all((r["_pos"] is None) == r["_long"] for r in rows) and sum(r["_long"] for r in rows) == 100
    numbered = number_records(tagged, split_table(tagged))
    assert "collect_list" not in numbered._jdf.queryExecution().toString()
    got = {r["facility_name"]: r["source_row_number"] for r in numbered.collect()}
    assert got == {f"F{i}": n + 2 for n, i in enumerate(i for i in range(300) if i % 3)}


def test_folders_and_schemes(spark, workdir):
    folder = os.path.join(workdir, "landing")
    os.makedirs(folder)
    write(os.path.join(folder, "a.csv"), HEADERS, [row()])
    write(os.path.join(folder, "b.csv"), HEADERS[::-1], [row()])
    for path in (folder, f"file:{folder}", f"file://{folder}/"):
        rows = read_discharge_file(spark, path).collect()
        assert sorted(r["source_file_name"] for r in rows) == ["a.csv", "b.csv"]
        assert len({r["facility_name"] for r in rows}) == 1
    with pytest.raises(FileNotFoundError):
        read_tagged(spark, os.path.join(workdir, "absent.csv"))


def broken_files(workdir):
    """A folder with a plain file, one with line breaks in fields, one with them in its header, one with a stray quote."""
    folder = os.path.join(workdir, "odd files")
    os.makedirs(folder)
    head = "Facility Name,Discharge Year,CCSR Diagnosis Code,Length of Stay,Patient Disposition"
    files = {
        "plain.csv": head + "".join(f"\nP{i},2021,D{i},3,x" for i in range(50)) + "\n",
        "breaks.csv": head + "".join(f'\nB{i},2021,D{i},3,"Home, or\r\n\n""Care"" {i}"' if i % 3 else f"\nB{i},2021,D{i},3,y\n"
                                     for i in range(50)) + '\nlong,2021,D,3,"a\nb",extra\n',
        "header.csv": '"Some\nNote",' + head + "".join(f"\nn,H{i},2021,D{i},3,z" for i in range(5)) + "\n",
        "stray.csv": head + '\nS0,2021,D0,3,5" pipe\nS1,2021,D1,3,w\n',
    }
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return folder


@pytest.mark.parametrize("split", ["200", "1000000"])
def test_line_breaks_inside_quotes(spark, workdir, split):
    import pandas as pd

    folder = broken_files(workdir)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows, splits = read_records(spark, folder, saver(spark, os.path.join(workdir, "read")))
        got = sorted(map(tuple, number_records(rows, splits).select(
            "source_file_name", "source_row_number", "facility_name", "patient_disposition").collect()))
        whole = splits.where("_block = -1").select("_file").distinct().collect()
        long = [tuple(r) for r in quarantined(rows, splits).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = []
    for name in sorted(os.listdir(folder)):
        table = pd.read_csv(os.path.join(folder, name), dtype=str, on_bad_lines="skip", encoding="utf-8-sig")
        want += [(name, i + 2, r["Facility Name"], r["Patient Disposition"]) for i, r in table.iterrows()]
    assert got == want
    assert {os.path.basename(r[0]) for r in whole} == {"breaks.csv", "header.csv", "stray.csv"}
    assert long == [("breaks.csv", 52, 6)]


def test_ingest_loads_records_with_line_breaks(spark, workdir):
    p = os.path.join(workdir, "three.csv")
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write("Facility Name,Discharge Year,CCSR Diagnosis Code,Length of Stay,Patient Disposition\n"
                'A,2021,D1,3,Home\nB,2021,D1,3,"Home\nCare"\nC,2021,D1,3,Home\nD,2021,D1,3,Home,x\n')
    log = os.path.join(workdir, "quarantine")
    got = ingest(spark, p, os.path.join(workdir, "fact"), current_year=2024, quarantine=log)
    assert (got["input_rows"], got["clean_rows"], got["inserted_rows"], got["long_rows"]) == (3, 3, 3, 1)
    fact = spark.read.parquet(os.path.join(workdir, "fact"))
    assert {(r.facility_name, r.source_row_number, r.patient_disposition) for r in fact.collect()} == {
        ("A", 2, "Home"), ("B", 3, "Home\nCare"), ("C", 4, "Home")}
    assert [(r.source_file_name, r.line, r.fields) for r in spark.read.parquet(log).collect()] == [("three.csv", 5, 6)]
    ck = spark.conf.get("spark.checkpoint.dir")
    assert not [d for d in os.listdir(ck) if d.startswith("carelens-ingest-")]  # run folders go


def test_staged_rows_are_read_once_by_the_dedup(spark, workdir, monkeypatch):
    from carelens.plans import jobs

    p = write(os.path.join(workdir, "one.csv"), HEADERS, [row(**{"Race": f"r{i}"}) for i in range(20)])
    plans = []

    def spy(folder_saver):
        def make(spark, folder):
            save = folder_saver(spark, folder)

            def wrapped(df, name):
                plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
                return save(df, name)
            return wrapped
        return make

    monkeypatch.setattr(jobs, "saver", spy(jobs.saver))
    ingest(spark, p, os.path.join(workdir, "fact"), current_year=2024)
    assert [name for name, _ in plans] == ["lines", "splits", "collapsed"]
    assert dict(plans)["splits"].count("Relation") == 1 and dict(plans)["collapsed"].count("Relation") == 2  # rows, split table
