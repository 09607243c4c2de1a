"""Write the physical plans of the main stages to docs/PLANS.md (operator trees only).

usage: python tools/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from carelens.operators import serving as Q  # noqa: E402
from carelens.operators.clean import clean_records, collapse_duplicates, stage  # noqa: E402
from carelens.operators.load import new_records  # noqa: E402
from carelens.operators.summaries import SUMMARIES, grouping_sets_aggregate, merge_summary, split_summary  # noqa: E402
from carelens.plans.catalog import FolderSummaries  # noqa: E402
from carelens.plans.jobs import summarise  # noqa: E402
from carelens.session import build_session  # noqa: E402
from carelens.sources.fixtures import discharges, raw_discharges  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n")[0]
    scans = [line for line in text.splitlines()
             if line.startswith(("PushedFilters", "ReadSchema")) and len(line) < 400]
    return "\n".join([head, ""] + scans)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    work = tempfile.mkdtemp(prefix="carelens-plans-", dir="/tmp")
    spark = build_session("local[8]", conf={"spark.sql.shuffle.partitions": "16", "spark.ui.enabled": "false",
                                            "spark.checkpoint.dir": os.path.join(work, "ck")})
    spark.sparkContext.setLogLevel("ERROR")
    discharges(spark, sf_dir).write.parquet(f"{work}/fact")
    fact = spark.read.parquet(f"{work}/fact")
    summarise(spark, f"{work}/fact", f"{work}/summaries")
    lk = FolderSummaries(spark, f"{work}/summaries")
    raw = raw_discharges(spark, sf_dir)
    staged = stage(raw, 2026)
    staged.write.parquet(f"{work}/staged")
    clean_records(collapse_duplicates(spark.read.parquet(f"{work}/staged"))).write.parquet(f"{work}/loaded")
    sections = [
        ("Fixture fact: star join (lineitem x orders pinned to sort-merge; small dimensions broadcast by AQE)",
         discharges(spark, sf_dir)),
        ("Cleaning + keep-first dedup (partial SortAggregate before the one shuffle by record hash)",
         collapse_duplicates(spark.read.parquet(f"{work}/staged"))),
        ("Insert-ignore: anti join on the hash against the existing fact (hash column only)",
         new_records(clean_records(collapse_duplicates(spark.read.parquet(f"{work}/staged"))),
                     spark.read.parquet(f"{work}/loaded"))),
        ("All summaries in one scan (grouping sets, hash aggregate)", grouping_sets_aggregate(fact)),
        ("One summary split out of the grouping-sets result (description collapse)",
         split_summary(spark.read.parquet(f"{work}/fact").transform(grouping_sets_aggregate), "diagnosis_summary")),
        ("Incremental summary update: current table + summary of the new rows, re-aggregated (no fact scan)",
         merge_summary("diagnosis_summary", lk("diagnosis_summary").drop("updated_at"),
                       SUMMARIES["diagnosis_summary"](fact.limit(100)))),
        ("Serving: disposition top-10 in a facility scope (pushed filter, partial agg, take-ordered, scalar total)",
         Q.disposition(lk("patient_disposition_summary"), Q.Scope.of(facility_name="Supplier#000000001"))),
        ("Serving: hospital comparison page 2 (take-ordered with offset, numbered page)",
         Q.hospital_comparison(lk("hospital_operation_summary"), page=2, page_size=5)),
    ]
    out = ["# Physical plans of the main stages", "",
           f"Generated by `tools/dump_plans.py` from `{sf_dir}` (local[8], 16 shuffle partitions, AQE on; "
           "initial plans, before AQE's runtime re-planning).", ""]
    for title, df in sections:
        out += [f"## {title}", "", "```", tree(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
