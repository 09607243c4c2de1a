"""The command-line jobs end to end on files in a temp folder."""

import json
import os

from carelens.plans import jobs
from carelens.sources.tables import read_summary
from test_files import HEADERS, row, write


def test_cli_ingest_summarise_serve_report(spark, workdir, capsys):
    p = write(os.path.join(workdir, "cli.csv"), HEADERS,
              [row(**{"Facility Name": f"Fac {i % 3}", "Race": f"r{i}", "Payment Typology 1": "Medicare"})
               for i in range(30)])
    fact, out, log = (os.path.join(workdir, n) for n in ("fact", "summaries", "quality"))
    counters = jobs.ingest(spark, [p], fact, current_year=2024)
    jobs.log_quality(spark, counters, [p], log)
    assert spark.read.parquet(log).first()["inserted_rows"] == 30
    jobs.summarise(spark, fact, out)
    answer, fresh = jobs.serve(spark, out, "hospital_ranking", hospital_county="Kings", limit=2)
    assert [r["rank"] for r in answer.collect()] == [1, 2]
    assert fresh.first()["updated_at"] is not None
    buckets, _ = jobs.serve(spark, out, "chart_payment_buckets")
    assert {r["payment_bucket"]: r["discharge_count"] for r in buckets.collect()}["Medicare"] == 30
    facts = jobs.report(spark, out, "operations", hospital_county="Kings")
    got = {(r["section"], r["metric"]): r["value_text"] for r in facts.where("position = 0").collect()}
    assert got[("kpi", "discharge_count")] == "30" and got[("operations", "ranked_hospitals")] == "3"
    assert json.loads(json.dumps(counters))["clean_rows"] == 30


def test_incremental_summaries_equal_rebuild(spark, workdir):
    from pyspark.sql import functions as F

    day1 = [row(**{"Facility Name": f"Fac {i % 4}", "Race": f"r{i}", "APR MDC Code": f"M{i % 3}",
                   "APR MDC Description": f"Sys {i % 3}", "Type of Admission": "Emergency" if i % 2 else "Urgent",
                   "Emergency Department Indicator": "Y" if i % 3 else None}) for i in range(40)]
    day2 = day1[:10] + [row(**{"Facility Name": f"Fac {i % 5}", "Race": f"s{i}", "APR MDC Code": f"M{i % 4}",
                               "APR MDC Description": f"System {i % 4}", "Total Charges": None})
                        for i in range(25)]
    p1 = write(os.path.join(workdir, "day1.csv"), HEADERS, day1)
    p2 = write(os.path.join(workdir, "day2.csv"), HEADERS, day2)
    fact, inc, full = (os.path.join(workdir, n) for n in ("fact", "incremental", "rebuilt"))
    jobs.ingest(spark, p1, fact, current_year=2024, summary_dir=inc)
    second = jobs.ingest(spark, p2, fact, current_year=2024, summary_dir=inc)
    assert second["inserted_rows"] == 25
    jobs.summarise(spark, fact, full)
    from carelens.operators.summaries import SUMMARIES
    # an update cut short: the fact has the rows, one summary missed them; rerunning catches up
    jobs.update_summaries(spark, fact, inc)  # nothing new: no table changes
    for name in SUMMARIES:
        a = read_summary(spark, os.path.join(inc, name)).drop("updated_at")
        b = read_summary(spark, os.path.join(full, name)).drop("updated_at").select(*a.columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
    assert read_summary(spark, os.path.join(inc, "hospital_operation_summary")).agg(
        F.sum("discharge_count")).first()[0] == 65


def test_interrupted_summary_update_catches_up(spark, workdir):
    from carelens.operators.summaries import SUMMARIES

    p1 = write(os.path.join(workdir, "a.csv"), HEADERS, [row(**{"Race": f"a{i}"}) for i in range(12)])
    p2 = write(os.path.join(workdir, "b.csv"), HEADERS, [row(**{"Race": f"b{i}"}) for i in range(7)])
    fact, summ = os.path.join(workdir, "fact"), os.path.join(workdir, "summ")
    jobs.ingest(spark, p1, fact, current_year=2024, summary_dir=summ)
    jobs.ingest(spark, p2, fact, current_year=2024)          # appended, but the summary update "failed"
    op = lambda: read_summary(spark, os.path.join(summ, "hospital_operation_summary"))
    assert op().agg({"discharge_count": "sum"}).first()[0] == 12
    jobs.update_summaries(spark, fact, summ)                   # the rerun catches up
    jobs.update_summaries(spark, fact, summ)                   # and a second rerun changes nothing
    assert op().agg({"discharge_count": "sum"}).first()[0] == 19
    for name in SUMMARIES:
        assert read_summary(spark, os.path.join(summ, name)).agg(
            {"discharge_count": "sum"}).first()[0] in (19, 0, None) or name == "patient_medical_surgical_summary"


def test_summaries_follow_loads_not_the_clock(spark, workdir, monkeypatch):
    from pyspark.sql import functions as F

    from carelens.operators import load

    stalled = F.to_timestamp(F.lit("2020-01-01 00:00:00"))
    monkeypatch.setattr(load.F, "current_timestamp", lambda: stalled)
    fact, summ = os.path.join(workdir, "fact"), os.path.join(workdir, "summ")
    for day, n in (("a", 12), ("b", 7), ("c", 5)):
        p = write(os.path.join(workdir, f"{day}.csv"), HEADERS, [row(**{"Race": f"{day}{i}"}) for i in range(n)])
        jobs.ingest(spark, p, fact, current_year=2024, summary_dir=summ)
    stored = spark.read.parquet(fact)
    assert stored.select("created_at").distinct().count() == 1
    assert sorted(r[0] for r in stored.select("load_id").distinct().collect()) == [1, 2, 3]
    total = read_summary(spark, os.path.join(summ, "hospital_operation_summary")).agg(F.sum("discharge_count")).first()[0]
    assert total == 24


def test_answers_are_delivered_whole(spark, workdir, capsys):
    from pyspark.sql import functions as F

    frame = spark.range(1234).select("id", F.lit(None).cast("string").alias("note"))
    jobs.deliver(frame)
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert sorted(x["id"] for x in lines) == list(range(1234)) and lines[0]["note"] is None
    jobs.deliver(frame, os.path.join(workdir, "out"))
    assert spark.read.parquet(os.path.join(workdir, "out")).count() == 1234


def test_summarise_a_catalog_table(spark, workdir):
    p = write(os.path.join(workdir, "t.csv"), HEADERS, [row(**{"Race": f"r{i}"}) for i in range(9)])
    spark.sql("DROP TABLE IF EXISTS fact_by_name")
    jobs.ingest(spark, p, "fact_by_name", current_year=2024)
    jobs.summarise(spark, "fact_by_name", os.path.join(workdir, "s"), tables=["hospital_operation_summary"])
    assert read_summary(spark, os.path.join(workdir, "s", "hospital_operation_summary")).first()["discharge_count"] == 9
    spark.sql("DROP TABLE fact_by_name")


def test_partly_overlapping_load(spark, workdir):
    rows = [row(**{"Race": f"r{i}"}) for i in range(20)]
    fact = os.path.join(workdir, "fact")
    first = jobs.ingest(spark, write(os.path.join(workdir, "a.csv"), HEADERS, rows[:12]), fact, current_year=2024)
    second = jobs.ingest(spark, "file:" + write(os.path.join(workdir, "b.csv"), HEADERS, rows[6:]), fact, current_year=2024)
    assert (first["inserted_rows"], second["inserted_rows"], second["clean_rows"]) == (12, 8, 14)
    assert spark.read.parquet(fact).count() == 20


def test_two_loads_at_once_leave_unique_records(spark, workdir):
    from concurrent.futures import ThreadPoolExecutor

    from carelens.sources.files import TargetClaimed

    rows = [row(**{"Race": f"r{i}"}) for i in range(60)]
    files = [write(os.path.join(workdir, f"{k}.csv"), HEADERS, rows[lo:lo + 40]) for k, lo in enumerate((0, 20))]
    fact = os.path.join(workdir, "fact")

    def load(path):
        try:
            return jobs.ingest(spark, path, fact, current_year=2024)["inserted_rows"]
        except TargetClaimed as e:
            assert "another load holds" in str(e)
            return None

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(load, files))
    assert sorted(got, key=str) == [40, None]
    assert [load(f) for f in files] == [0 if got[0] else 20, 20 if got[0] else 0]  # the claim is gone
    stored = spark.read.parquet(fact)
    assert stored.count() == stored.select("source_row_hash").distinct().count() == 60


def test_claim_of_a_dead_load_is_reported_and_cleared(spark, workdir):
    import pytest

    from carelens.sources.files import TargetClaimed, claim_path

    p = write(os.path.join(workdir, "a.csv"), HEADERS, [row()])
    fact = os.path.join(workdir, "fact")
    with open(claim_path(spark, fact, False), "w") as f:
        f.write("host x, pid 1")
    with pytest.raises(TargetClaimed, match="host x, pid 1"):
        jobs.ingest(spark, p, fact, current_year=2024)
    assert not os.path.exists(fact)
    assert jobs.ingest(spark, p, fact, current_year=2024, clear_claim=True)["inserted_rows"] == 1
    with pytest.raises(FileNotFoundError):  # a load that fails leaves no claim
        jobs.ingest(spark, os.path.join(workdir, "absent.csv"), fact, current_year=2024)
    assert jobs.ingest(spark, p, fact, current_year=2024)["inserted_rows"] == 0
    assert not [n for n in os.listdir(workdir) if n.startswith("_claim")]


def test_readers_see_an_update_whole_or_not_at_all(spark, workdir, monkeypatch):
    import threading

    from carelens.operators.summaries import SUMMARIES
    from carelens.plans.catalog import FolderSummaries
    from carelens.sources.tables import KEPT_VERSIONS, versions

    fact, summ = os.path.join(workdir, "fact"), os.path.join(workdir, "summ")
    days = [write(os.path.join(workdir, f"{d}.csv"), HEADERS, [row(**{"Race": f"{d}{i}"}) for i in range(10)]) for d in range(6)]
    jobs.ingest(spark, days[0], fact, current_year=2024, summary_dir=summ)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(FolderSummaries(spark, summ)("hospital_operation_summary").agg({"discharge_count": "sum"}).first()[0])

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for d in days[1:4]:
            jobs.ingest(spark, d, fact, current_year=2024, summary_dir=summ)
    finally:
        stop.set()
        reader.join()
    assert seen == sorted(seen) and set(seen) <= {10, 20, 30, 40}

    # an update killed between two tables is caught up by the next
    write_summary, left = jobs.write_summary, [4]

    def killed(table, path):
        left[0] -= 1
        if left[0] < 0:
            table.limit(0).write.parquet(f"{path}/version=99")
            os.remove(f"{path}/version=99/_SUCCESS")  # as a writer leaves it that dies
            raise RuntimeError("killed")
        write_summary(table, path)

    monkeypatch.setattr(jobs, "write_summary", killed)
    try:
        jobs.ingest(spark, days[4], fact, current_year=2024, summary_dir=summ)
    except RuntimeError:
        pass
    monkeypatch.setattr(jobs, "write_summary", write_summary)
    totals = [FolderSummaries(spark, summ)(n).agg({"discharge_count": "sum"}).first()[0] for n in SUMMARIES]
    assert set(totals) <= {40, 50, 0, None} and 40 in totals
    jobs.ingest(spark, days[5], fact, current_year=2024, summary_dir=summ)
    totals = [FolderSummaries(spark, summ)(n).agg({"discharge_count": "sum"}).first()[0] for n in SUMMARIES]
    assert set(totals) <= {60, 0, None}
    for n in SUMMARIES:
        found = versions(spark, os.path.join(summ, n))
        assert len(found) <= KEPT_VERSIONS and all(done for _, done in found)
