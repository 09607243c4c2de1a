"""What is stored, sorted and computed once, so that larger tables fit."""

import hashlib
import os
import time

from pyspark.sql import functions as F

from carelens.functions.ordinal import number_rows
from carelens.operators.clean import record_hash
from carelens.plans.catalog import FactSummaries
from carelens.session import checkpoint_dir
from carelens.sources import fixtures
from carelens.sources.delimited import read_records, saver


def _rdd_checkpoints(spark):
    root = checkpoint_dir(spark)
    return {os.path.join(p, d) for p, ds, _ in os.walk(root) for d in ds if d.startswith("rdd-")}


def test_numbered_rows_are_stored_as_columns(spark):
    before = _rdd_checkpoints(spark)
    rows = number_rows(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], "n").collect()
    assert sorted((r.k, r.n) for r in rows) == [(k, k + 1) for k in range(1000)]
    assert _rdd_checkpoints(spark) == before


def test_hash_of_records_with_and_without_marks(spark):
    def expected(values):
        text = [None if v is None else v.replace("\\", "\\\\").replace("|", "\\|").replace("<", "\\<") for v in values]
        return hashlib.sha256("|".join("<NULL>" if t is None else t for t in text).encode()).hexdigest()

    rows = [("a", None, ""), ("a|b", "<NULL>", None), ("\\|", "é<", "c\\"), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = df.select("*", record_hash([F.col(c) for c in df.columns]).alias("h")).collect()
    assert [r.h for r in got] == [expected(tuple(r)[:3]) for r in got]


def test_hash_of_wide_records_stays_compilable(spark, capsys):
    df = spark.range(1).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(33)])
    df.select(record_hash([F.col(c) for c in df.columns])).explain("codegen")
    sizes = [int(x.split(";")[0]) for x in capsys.readouterr().out.split("maxMethodCodeSize:")[1:]]
    assert all(size < 8000 for size in sizes)  # larger methods are interpreted


def test_records_with_line_breaks_are_prepared_from_what_was_stored(spark, workdir):
    header = "Discharge Year,CCSR Diagnosis Code,Length of Stay,Facility Name"
    with open(f"{workdir}/a.csv", "w") as f:
        f.write(f'{header}\n2020,A,1,"x\ny"\n2021,B,2,z\n')
    seen, folder = [], f"{workdir}/stored"

    def prepare(df):
        seen.append(df.inputFiles())
        return df

    rows, _ = read_records(spark, f"{workdir}/a.csv", saver(spark, folder), prepare)
    assert all(p.endswith(".parquet") for p in seen[-1])
    assert {r[0] for r in rows.where(F.col("_block") == -1).select("facility_name").collect()} == {"x\ny", "z"}


def test_no_task_sorts_a_whole_file(spark, monkeypatch):
    lines = spark.range(1, 400).select(F.col("id").alias("source_row_number"), *[F.lit("v").alias(c) for c in fixtures.RAW_COLUMNS])
    monkeypatch.setattr(fixtures, "raw_discharges", lambda *_: lines)
    monkeypatch.setattr(type(lines), "sortWithinPartitions", None)
    files = fixtures.rendered_files(spark, "")
    assert len(files) == fixtures.FILES
    for k, path in enumerate(files):
        with open(path.removeprefix("file:")) as f:
            text = f.read()
        expected = [n for n in range(1, 400) if n % fixtures.FILES == k]
        assert text.count("v" + (",v" if k % 2 == 0 else "\tv")) > 0 and text.endswith("\n")
        first = text.split("\n", 1)[0]
        assert "Facility Name" in first
        blank = sum(n % 43 == 9 for n in expected)
        breaks = sum(k in (1, 6) and n % 5 == 0 and n % 41 != 7 for n in expected)
        assert text.count("\n") >= 1 + len(expected) + blank and text.count("\n") <= 1 + len(expected) + blank + breaks + len(expected)


def test_summary_is_built_once(spark):
    fact = spark.createDataFrame([("A", "C", "F", "Medicare", 10, 5)], "hospital_service_area string, hospital_county string, "
                                 "facility_name string, payment_typology_1 string, total_charges int, total_costs int")
    stored = []
    lookup = FactSummaries(fact, lambda df: stored.append(df) or df)
    assert lookup("patient_payment_summary") is lookup("patient_payment_summary")
    assert len(stored) == 1


def test_sorted_rows_go_to_as_many_tasks_as_there_are_rows_for(spark, monkeypatch):
    from carelens.functions import ordinal

    monkeypatch.setattr(ordinal, "ROWS_PER_TASK", 100)
    assert [ordinal.tasks_for(n) for n in (0, 100, 101, 1000)] == [1, 1, 2, 10]
    rows = number_rows(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], "n", tasks=ordinal.tasks_for(1000))
    assert all(r["n"] == r["k"] + 1 for r in rows.collect())
    held = ordinal.sort_rows(spark.range(1000), ["id"], 10).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 10


def test_numbers_of_texts_with_marks(spark):
    from carelens.functions.numbers import parse_number, parse_texts
    from carelens.functions.text import normalize_text

    texts = ["1", " $ 1,000.5 ", "$,", "120 +", "1e3", "\u00a0-5\u00a0", "", None, "$\u2003 7", "~", "+.5", "1$2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(parse_number(F.col("t")), parse_texts(F.array(normalize_text(F.col("t"))))[0]).collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    assert [None if r[1] is None else float(r[1]) for r in got] == [1, 1000.5, None, None, 1000, -5, None, None, 7, None, 0.5, 12]


def test_counters_need_no_other_columns(spark):
    from carelens.operators.clean import collapse_duplicates, for_counters, stage
    from carelens.operators.quality import quality_summary
    from test_rules import raw_frame

    rows = [{"race": "x"}, {"race": "x"}, {"race": "y", "facility_name": "Redacted for Confidentiality"}, {"length_of_stay": "12a"}]
    staged = stage(raw_frame(spark, rows), 2024)
    assert quality_summary(collapse_duplicates(for_counters(staged))).collect() == quality_summary(collapse_duplicates(staged)).collect()


def test_counters_sort_and_store_no_texts_of_required_values(spark):
    from carelens.operators.clean import REQUIRED_VALUES, clean_records, collapse_duplicates, for_counters, stage
    from test_rules import raw_frame

    rows = [{"race": "x"}, {"facility_name": " "}, {"race": "x"}]
    kept = for_counters(stage(raw_frame(spark, rows), 2024))
    assert not set(REQUIRED_VALUES) & set(kept.columns)
    collapsed = collapse_duplicates(kept)
    assert sorted((r["_copies"], r["_core_missing"]) for r in collapsed.collect()) == sorted(
        (r["_copies"], r["_core_missing"]) for r in collapse_duplicates(stage(raw_frame(spark, rows), 2024)).collect())
    assert set(clean_records(collapsed).columns) == {"source_row_hash", "source_file_name", "source_row_number"}


def test_a_visible_edge_is_a_range_and_no_set_of_texts(spark, capsys):
    from carelens.functions.text import normalize_text, tidy

    texts = [chr(i) + "a" + chr(j) for i in (*range(1, 130), 0xA0, 0x2003, 0x1F600) for j in (9, 32, 33, 126, 127, 0x85, 0x3000, 0x1F600)]
    texts += [*map(chr, range(1, 300)), "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    made = df.select("t", tidy(F.col("t")).alias("tidy"), normalize_text(F.col("t")).alias("text"))
    for t, neat, text in made.collect():
        assert text == ((t.strip() or None) if t is not None else None)
        assert neat is None if t is None else neat == (t != "" and all("!" <= c <= "~" for c in (t[0], t[-1])))
    made.explain(True)
    assert " INSET " not in capsys.readouterr().out  # 94 texts hashed and compared for each field of each record


def test_a_report_stores_only_what_its_summaries_read(spark):
    from carelens.operators.report import report_facts
    from carelens.operators.summaries import SUMMARIES
    from carelens.plans import registry
    from carelens.sources.fixtures import discharges
    from conftest import SF_SMALL

    fact = discharges(spark, SF_SMALL)
    for kind, tables in registry.REPORT_TABLES.items():
        asked = set()
        report_facts(lambda name: asked.add(name) or SUMMARIES[name](fact), kind)
        assert asked == set(tables)
        kept = fact.select(*registry._read_columns(fact, tables))
        for table in tables:
            SUMMARIES[table](kept)  # every column is there
    assert "ccsr_diagnosis_code" not in registry._read_columns(fact, registry.REPORT_TABLES["patient"])


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def _left(spark, before):
    """Shuffle files beyond ``before``; they are removed in the background."""
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_written_results_leave_no_shuffle_files(spark, workdir):
    key, rows = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.range(1000).withColumn("k", F.col("id") % 7)
    was, before = spark.conf.get(key, None), _shuffle_files(spark)
    saver(spark, workdir)(rows.repartition(5, "k"), "dealt")
    assert not _left(spark, before)
    number_rows(rows.repartitionByRange(4, "id"), ["id"], "n", dealt=True)
    assert spark.conf.get(key, None) == was


def test_dealt_rows_are_numbered_and_read_by_as_many_tasks(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartitionByRange(9, "k")
    numbered = number_rows(rows, ["k"], "n", dealt=True)
    assert all(r["n"] == r["k"] + 1 for r in numbered.collect())
    assert numbered.groupBy(F.spark_partition_id()).count().count() == 9


def test_raw_records_are_not_shuffled_again_once_numbered(spark):
    from conftest import SF_SMALL

    plan = fixtures.raw_discharges(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan


def test_records_are_shuffled_under_the_bytes_of_their_hash(spark):
    from carelens.operators.clean import collapse_duplicates, stage
    from test_rules import raw_frame

    staged = stage(raw_frame(spark, [{"race": "x"}, {"race": "x"}, {"race": "y"}]), 2024)
    collapsed = collapse_duplicates(staged)
    assert {r[0] for r in collapsed.select("source_row_hash").collect()} == {r[0] for r in staged.select("source_row_hash").collect()}
    assert "lower(hex(_hash" in collapsed._jdf.queryExecution().optimizedPlan().toString()


def test_a_first_load_joins_nothing(spark, workdir):
    from carelens.operators.load import new_records, read_target
    from carelens.schema import fact_schema

    stored = read_target(spark, f"{workdir}/none")
    assert stored.schema == fact_schema() and stored.count() == 0
    load = spark.createDataFrame([("h", 1), (None, 2)], "source_row_hash string, n int")
    fresh = new_records(load, stored)
    assert "Join" not in fresh._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.n for r in fresh.collect()) == [1, 2]


def test_a_load_in_slices_is_the_whole_load(spark, monkeypatch):
    from carelens.plans import registry
    from conftest import SF_SMALL

    whole = registry.QUERIES["load_partial_overlap"](spark, SF_SMALL)
    monkeypatch.setattr(registry, "ROWS_PER_SLICE", 2000)
    cut = registry.QUERIES["load_partial_overlap"](spark, SF_SMALL)
    assert "carelens-slices" in "".join(cut.inputFiles()) and cut.schema == whole.schema
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))


def test_rendered_files_and_summary_folders_leave_little_behind(spark):
    from carelens.plans import registry
    from conftest import SF_SMALL

    root, before = checkpoint_dir(spark), _shuffle_files(spark)
    there = set(os.listdir(root))
    fixtures.rendered_files(spark, SF_SMALL)
    assert not {f for f in _left(spark, before) if f.endswith(".data")}
    registry.QUERIES["summary_folder_patient_payment"](spark, SF_SMALL)
    (folder,) = (d for d in set(os.listdir(root)) - there if d.startswith("carelens-folder-"))
    assert sorted(os.listdir(f"{root}/{folder}")) == ["fact", "summaries"]
