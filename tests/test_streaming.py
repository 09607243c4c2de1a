"""File-stream ingest: new files are loaded once; replays and reruns append nothing."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from test_files import HEADERS, row, write

from carelens.sources.files import claim_path
from carelens.streaming import start_ingest


def test_stream_ingest_once(spark, workdir):
    landing = os.path.join(workdir, "landing")
    os.makedirs(landing)
    write(os.path.join(landing, "day1.csv"), HEADERS, [row(), row(), row(**{"Facility Name": "Fac B"})])
    target, log = os.path.join(workdir, "fact"), os.path.join(workdir, "quality")
    ckpt = os.path.join(workdir, "stream-ckpt")
    q = start_ingest(spark, landing, target, ckpt, log, current_year=2024, available_now=True)
    q.awaitTermination(120)
    assert spark.read.parquet(target).count() == 2
    # a second day: one new record, one already loaded; the stream died while it held the target
    with open(claim_path(spark, target, False), "w") as f:
        f.write("dead")
    write(os.path.join(landing, "day2.csv"), HEADERS, [row(**{"Facility Name": "Fac C"}), row()])
    with pytest.raises(StreamingQueryException, match="dead"):
        start_ingest(spark, landing, target, ckpt, log, current_year=2024, available_now=True).awaitTermination(120)
    q = start_ingest(spark, landing, target, ckpt, log, current_year=2024, available_now=True, clear_claim=True)
    q.awaitTermination(120)
    fact = spark.read.parquet(target)
    assert fact.count() == 3
    assert sorted(r[0] for r in fact.select("facility_name").collect()) == ["Fac A", "Fac B", "Fac C"]
    logs = spark.read.parquet(log).orderBy("epoch_id").collect()
    assert [r["inserted_rows"] for r in logs] == [2, 1]
    assert [r["input_rows"] for r in logs] == [3, 2]


def test_stream_maps_each_files_own_header(spark, workdir):
    landing, target = os.path.join(workdir, "landing"), os.path.join(workdir, "fact")
    os.makedirs(landing)
    swapped = list(HEADERS)
    i, j = swapped.index("Total Charges"), swapped.index("Total Costs")
    swapped[i], swapped[j] = swapped[j], swapped[i]
    write(os.path.join(landing, "a.csv"), HEADERS, [row(**{"Race": "a", "Total Charges": "20", "Total Costs": "10"})])
    write(os.path.join(landing, "b.csv"), swapped, [row(**{"Race": "b", "Total Charges": "40", "Total Costs": "30"})])
    write(os.path.join(landing, "c.tsv"), HEADERS[::-1], [row(**{"Race": "c", "Total Charges": "60", "Total Costs": "50"})],
          sep="\t")
    start_ingest(spark, landing, target, os.path.join(workdir, "ck"), os.path.join(workdir, "q"), current_year=2024,
                 available_now=True).awaitTermination(120)
    got = {r["race"]: (int(r["total_charges"]), int(r["total_costs"])) for r in spark.read.parquet(target).collect()}
    assert got == {"a": (20, 10), "b": (40, 30), "c": (60, 50)}
