"""Job entry points: ingest files -> fact, fact -> summaries, summaries -> answers.

``python -m carelens.plans.jobs ingest  --target FACT [--summaries DIR] [--quality-log LOG] [--quarantine LOG] FILE|FOLDER ...``
``python -m carelens.plans.jobs summarise --fact FACT --out SUMMARY_DIR [--per-table]``
``python -m carelens.plans.jobs serve --summaries SUMMARY_DIR QUERY [--param k=v ...] [--out DIR]``
``python -m carelens.plans.jobs report --summaries SUMMARY_DIR TYPE [--param scope=value ...] [--out DIR]``
``python -m carelens.plans.jobs stream LANDING --target FACT --checkpoint CK --quality-log LOG [--summaries DIR] [--once]``

Ingest writes its two intermediate results (per-record cleaning output, then
the de-duplicated records) under ``spark.checkpoint.dir``: each later step
reads columnar files instead of re-parsing text, lineage stays short, and a
lost executor costs only the tasks of the current step.
"""

from __future__ import annotations

import argparse
import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from carelens.operators import charts, serving
from carelens.operators.report import report_facts
from carelens.operators.clean import clean_records, collapse_duplicates, stage
from carelens.operators.load import append_new, is_table_name, read_target
from carelens.operators.quality import COUNTERS, quality_summary
from carelens.operators.summaries import (
    SUMMARIES, grouping_sets_aggregate, merge_summary, split_summary, with_updated_at,
)
from carelens.plans.catalog import FolderSummaries
from carelens.session import STORED, build_session, checkpoint_dir, shuffles_removed
from carelens.sources.delimited import number_records, quarantined, read_records, saver
from carelens.sources.files import claim_path, claimed, remove
from carelens.sources.tables import read_fact, read_summary, write_summary


def ingest(spark: SparkSession, sources: str | list[str], target: str, current_year: int | None = None,
           multi_line: bool = False, summary_dir: str | None = None, quarantine: str | None = None,
           clear_claim: bool = False) -> dict[str, int]:
    """Clean the source files and append their new records to the fact at ``target``.

    Returns the quality counters plus ``long_rows`` (quarantined lines).  With
    ``summary_dir``, the summaries there are then brought up to date from the
    newly appended fact rows (see ``update_summaries``).  With ``quarantine``,
    the file, line and number of fields of each quarantined line are appended to
    the Parquet table there.  Files with line breaks inside quotes are found
    while reading; ``multi_line`` only saves reading them twice.

    The load claims ``target`` until it ends: two loads at once would not see
    each other's records and could store one twice, so the second raises
    ``TargetClaimed``.  ``clear_claim`` first removes what a dead load has left.
    """
    with claimed(spark, claim_path(spark, target, is_table_name(target)), clear_claim), shuffles_removed(spark):
        run = f"{checkpoint_dir(spark).rstrip('/')}/carelens-ingest-{uuid.uuid4().hex}"
        save = saver(spark, run)
        # 1. parse + clean row by row (one narrow pass over the text), keep position tags
        staged, splits = read_records(spark, sources, save, lambda raw: stage(raw, current_year), multi_line)
        long_rows = splits.agg(F.coalesce(F.sum("_quarantined"), F.lit(0))).first()[0]
        # 2. ordinals from the split table, then one shuffle by record hash (map-side combined)
        collapsed = save(collapse_duplicates(number_records(staged, splits)), "collapsed")
        # 3. anti-join against the target and append; counters from the collapsed records
        inserted = append_new(spark, clean_records(collapsed), target)
        if quarantine and long_rows:
            quarantined(staged, splits).withColumn("loaded_at", F.current_timestamp()).write.mode("append").parquet(quarantine)
        if summary_dir is not None:
            update_summaries(spark, target, summary_dir)
        row = quality_summary(collapsed, inserted).first().asDict()
        remove(spark, run)  # kept after a failure, to look at
    return {**{k: int(row[k]) for k in COUNTERS}, "long_rows": int(long_rows)}


# Newest fact ``load_id`` folded into a summary table (same value on every row).
FOLDED = "_folded_through"


def _folded_rows(fact: DataFrame, mark: int | None) -> DataFrame:
    """Fact rows of the loads after ``mark`` (all loads when None).

    The predicate reaches the Parquet scan, so files of earlier loads are
    skipped on their ``load_id`` statistics instead of being read.
    """
    return fact.where(F.col("load_id").isNotNull() if mark is None else F.col("load_id") > mark)


def _newest(df: DataFrame, column: str) -> int | None:
    """Largest value of ``column``; None if there is none or no such column (a fact read over JDBC)."""
    return df.agg(F.max(column)).first()[0] if column in df.columns else None


def _stamped(table: DataFrame, mark: int | None) -> DataFrame:
    return with_updated_at(table).withColumn(FOLDED, F.lit(mark).cast("long"))


def update_summaries(spark: SparkSession, target: str, summary_dir: str, parallel_writes: int = 4) -> list[str]:
    """Fold fact rows appended since each summary's watermark into it.

    A summary table carries ``_folded_through``, the newest fact
    ``load_id`` it contains.  Its update reads only newer fact rows,
    summarises them and merges them into the current rows.  That equals a
    rebuild because every measure is additive and descriptions are ``max``.
    Each table moves its own watermark with its rows, in one new version, so an update cut short
    by a failure is simply run again: tables already updated fold nothing
    twice, and the others catch up.  A table without a watermark is rebuilt
    from the whole fact.
    """
    fact = read_target(spark, target)
    run = f"{checkpoint_dir(spark).rstrip('/')}/carelens-summaries-{uuid.uuid4().hex}"

    def current_of(name: str) -> DataFrame | None:
        current = read_summary(spark, f"{summary_dir.rstrip('/')}/{name}")
        return current if current is not None and FOLDED in current.columns else None

    currents = {name: current_of(name) for name in SUMMARIES}
    marks = {name: _newest(cur, FOLDED) for name, cur in currents.items() if cur is not None}
    # The rows past a watermark are read from the fact once per distinct watermark
    # (normally one: every table was last updated together) and kept small in the
    # checkpoint folder, instead of each table filtering the fact again.
    newer_by_mark: dict[int | None, DataFrame] = {}
    newest_by_mark: dict[int | None, int | None] = {}
    for i, mark in enumerate(sorted(set(marks.values()), key=lambda m: -1 if m is None else m)):
        _folded_rows(fact, mark).write.options(**STORED).parquet(f"{run}/newer-{i}")
        newer_by_mark[mark] = spark.read.parquet(f"{run}/newer-{i}")
        newest_by_mark[mark] = _newest(newer_by_mark[mark], "load_id")

    def one(name: str) -> str:
        path = f"{summary_dir.rstrip('/')}/{name}"
        current = currents[name]
        if current is None:
            table, mark = SUMMARIES[name](fact), _newest(fact, "load_id")
        else:
            newer = newer_by_mark[marks[name]]
            mark = newest_by_mark[marks[name]]
            if mark is None:
                return name
            table = merge_summary(name, current.drop("updated_at", FOLDED), SUMMARIES[name](newer))
        write_summary(_stamped(table, mark), path)  # a version of its own: the current one stays while it is read
        return name

    with shuffles_removed(spark), ThreadPoolExecutor(max_workers=max(1, parallel_writes)) as pool:
        names = list(pool.map(one, list(SUMMARIES)))
    remove(spark, run)
    return names


def summarise(spark: SparkSession, fact_location, out_dir: str, tables: list[str] | None = None,
              single_pass: bool = True, parallel_writes: int = 4) -> list[str]:
    """Rebuild the summary tables from the fact.

    ``single_pass`` (default) reads the fact once: one grouping-sets
    aggregate computes every summary's groups, is written under
    ``spark.checkpoint.dir`` partitioned by grouping id, and each table is
    split out of its own partition.  On a cluster reading a large fact from
    remote storage the scan dominates, and this reads each needed column
    once instead of once per table.  ``single_pass=False`` runs one
    column-pruned aggregation per table.

    The table writes are independent Spark jobs; ``parallel_writes`` of them
    are submitted at once (Spark schedules concurrent jobs from separate
    threads), so small tables do not leave the cluster idle between jobs.
    """
    fact = read_fact(spark, fact_location)
    names = tables or list(SUMMARIES)
    mark = _newest(fact, "load_id")  # watermark for later incremental updates
    if single_pass:
        run = f"{checkpoint_dir(spark).rstrip('/')}/carelens-summaries-{uuid.uuid4().hex}"
        # partitioned by grouping id: each table's split reads only its own set
        with shuffles_removed(spark):
            grouping_sets_aggregate(fact).write.options(**STORED).partitionBy("_gid").parquet(run)
        groups = spark.read.parquet(run)
        build = lambda name: split_summary(groups, name)
    else:
        build = lambda name: SUMMARIES[name](fact)

    def write(name: str) -> str:
        write_summary(_stamped(build(name), mark), f"{out_dir.rstrip('/')}/{name}")
        return name

    with shuffles_removed(spark), ThreadPoolExecutor(max_workers=max(1, parallel_writes)) as pool:
        written = list(pool.map(write, names))
    if single_pass:
        remove(spark, run)
    return written


# serving query name -> (summary table, function)
SERVING = {
    "areas": ("hospital_operation_summary", serving.areas),
    "counties": ("hospital_operation_summary", serving.counties),
    "facilities": ("hospital_operation_summary", serving.facilities),
    "age_gender": ("patient_age_gender_summary", serving.age_gender),
    "payment": ("patient_payment_summary", serving.payment),
    "disposition": ("patient_disposition_summary", serving.disposition),
    "admission_emergency": ("patient_admission_emergency_summary", serving.admission_emergency),
    "medical_surgical": ("patient_medical_surgical_summary", serving.medical_surgical),
    "kpi": ("hospital_operation_summary", serving.kpi),
    "hospital_resources": ("hospital_operation_summary", serving.hospital_resources),
    "hospital_ranking": ("hospital_operation_summary", serving.hospital_ranking),
    "hospital_comparison": ("hospital_operation_summary", serving.hospital_comparison),
    "disease_systems": ("disease_system_summary", serving.disease_systems),
    "top_diagnoses": ("diagnosis_summary", serving.top_diagnoses),
    "severity": ("patient_risk_summary", serving.severity),
    "drilldown": ("disease_drilldown_summary", serving.drilldown),
    "breadcrumb": ("disease_drilldown_summary", serving.breadcrumb),
    "freshness": ("hospital_operation_summary", serving.latest_updated_at),
    "chart_kpi_cards": ("hospital_operation_summary", charts.kpi_cards),
    "chart_payment_buckets": ("patient_payment_summary", charts.payment_buckets),
    "chart_age_gender_pivot": ("patient_age_gender_summary", charts.age_gender_pivot),
    "chart_admission_emergency": ("patient_admission_emergency_summary", charts.admission_emergency_split),
    "chart_systems_top10": ("disease_system_summary", charts.systems_top10),
    "chart_hospital_bubbles": ("hospital_operation_summary", charts.hospital_bubbles),
    "chart_drilldown_bubbles": ("disease_drilldown_summary", charts.drilldown_bubbles),
}

# answers about the whole table or with filters of their own
_UNSCOPED = {"areas", "counties", "facilities", "freshness"}


def serve(spark: SparkSession, summary_dir: str, query: str, **params) -> tuple[DataFrame, DataFrame]:
    """Run one serving query; returns (answer, freshness of the summary it read)."""
    table, fn = SERVING[query]
    summary = FolderSummaries(spark, summary_dir)(table)
    if query not in _UNSCOPED:
        scope = serving.Scope.of(params.pop("hospital_service_area", None), params.pop("hospital_county", None),
                                 params.pop("facility_name", None))
        params["scope"] = scope
    return fn(summary, **params), serving.latest_updated_at(summary)


def report(spark: SparkSession, summary_dir: str, report_type: str, **scope) -> DataFrame:
    """Fact pack of one report type under a scope (long rows: section, position, metric, value_text)."""
    return report_facts(FolderSummaries(spark, summary_dir), report_type, serving.Scope.of(
        scope.get("hospital_service_area"), scope.get("hospital_county"), scope.get("facility_name")))


def deliver(answer: DataFrame, out: str | None = None) -> None:
    """Write every row of ``answer`` to ``out``, or print every row as JSON, one partition at a time."""
    if out:
        answer.write.mode("overwrite").parquet(out)
        return
    for line in answer.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
        print(line[0])


def log_quality(spark: SparkSession, counters: dict[str, int], sources: list[str], quality_log: str) -> None:
    """Append one load's counters (with its files and time) to a quality log table."""
    row = {**counters, "sources": ",".join(sources)}
    spark.createDataFrame([row]).withColumn("loaded_at", F.current_timestamp()).write.mode("append").parquet(
        quality_log)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="carelens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("sources", nargs="+")
    a.add_argument("--target", required=True, help="Parquet path, or a catalog table name (created bucketed)")
    a.add_argument("--current-year", type=int)
    a.add_argument("--multi-line", action="store_true", help="read every file as whole records at once, one task each")
    a.add_argument("--quarantine", help="append file, line and fields of lines with too many fields to this Parquet table")
    a.add_argument("--clear-claim", action="store_true", help="remove the claim that a dead load has left on the target")
    a.add_argument("--quality-log", help="append the load's counters to this Parquet table")
    a.add_argument("--summaries", help="update the summaries in this folder from the new records only")
    s = sub.add_parser("summarise")
    s.add_argument("--fact", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--per-table", action="store_true", help="one aggregation per table instead of one scan")
    q = sub.add_parser("serve")
    q.add_argument("--summaries", required=True)
    q.add_argument("query", choices=sorted(SERVING))
    q.add_argument("--param", action="append", default=[], help="name=value")
    q.add_argument("--out", help="write the answer as Parquet here instead of printing it")
    st = sub.add_parser("stream", help="ingest files as they arrive in a landing folder")
    st.add_argument("landing")
    st.add_argument("--target", required=True)
    st.add_argument("--checkpoint", required=True, help="streaming checkpoint location (shared storage)")
    st.add_argument("--quality-log", required=True)
    st.add_argument("--summaries", help="keep the summaries in this folder up to date")
    st.add_argument("--current-year", type=int)
    st.add_argument("--clear-claim", action="store_true", help="remove the claim that a dead load has left on the target")
    st.add_argument("--once", action="store_true", help="process the files present now, then stop")
    r = sub.add_parser("report")
    r.add_argument("--summaries", required=True)
    r.add_argument("report_type", choices=["comprehensive", "operations", "patient", "disease"])
    r.add_argument("--param", action="append", default=[], help="scope column=value")
    r.add_argument("--out", help="write the facts as Parquet here instead of printing them")
    args = ap.parse_args(argv)
    spark = build_session(app_name=f"carelens-{args.cmd}")
    if args.cmd == "ingest":
        counters = ingest(spark, args.sources, args.target, args.current_year, args.multi_line, args.summaries, args.quarantine,
                          args.clear_claim)
        if args.quality_log:
            log_quality(spark, counters, args.sources, args.quality_log)
        print(json.dumps(counters))
    elif args.cmd == "summarise":
        print(json.dumps(summarise(spark, args.fact, args.out, single_pass=not args.per_table)))
    elif args.cmd == "stream":
        from carelens.streaming import start_ingest

        query = start_ingest(spark, args.landing, args.target, args.checkpoint, args.quality_log,
                             current_year=args.current_year, available_now=args.once, summary_dir=args.summaries,
                             clear_claim=args.clear_claim)
        query.awaitTermination()
    elif args.cmd == "report":
        facts = report(spark, args.summaries, args.report_type, **dict(kv.split("=", 1) for kv in args.param))
        deliver(facts.orderBy("section", "position", "metric"), args.out)
    else:
        params = dict(kv.split("=", 1) for kv in args.param)
        answer, fresh = serve(spark, args.summaries, args.query, **params)
        deliver(answer, args.out)
        deliver(fresh)
    spark.stop()


if __name__ == "__main__":
    main()
