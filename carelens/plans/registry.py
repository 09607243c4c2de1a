"""The query catalogue: every operator as ``(spark, sf_dir) -> DataFrame``, plus its oracle SQL.

Entries read the driver's star tables and derive their discharge inputs from
them (``sources.fixtures``), so each one's work grows with the tables.
Decimal sums are returned as doubles and ``updated_at`` is left out where a
result is compared with DuckDB.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from carelens.operators import charts as C
from carelens.operators import serving as Q
from carelens.operators.summaries import SUMMARIES
from carelens.plans import oracle_sql as O
from carelens.plans.catalog import FactSummaries
from carelens.schema import SCOPE_COLUMNS
from carelens.session import STORED, checkpoint_dir, shuffles_removed
from carelens.sources.delimited import saver
from carelens.sources.fixtures import discharges

Query = Callable[[SparkSession, str], DataFrame]

# Scope and code literals used by the scoped variants (values present in the star at every scale).
AREA = {"hospital_service_area": "ASIA"}
AREA_COUNTY = {"hospital_service_area": "AMERICA", "hospital_county": "NATION_1"}
FACILITY = {"facility_name": "Supplier#000000001"}
MDC, DRG = "MEDIUM", "003"

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLE[name] = oracle


def comparable(df: DataFrame) -> DataFrame:
    """Decimal columns as double, ``updated_at`` dropped."""
    cols = []
    for f in df.schema.fields:
        if f.name == "updated_at":
            continue
        c = df[f.name]
        cols.append(c.cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else c)
    return df.select(*cols)


def summaries(spark: SparkSession, sf_dir: str) -> FactSummaries:
    return FactSummaries(discharges(spark, sf_dir))


# --- C1-C10: summaries -------------------------------------------------------

_SUMMARY_KEYS = {
    "patient_age_gender_summary": "summary_age_gender",
    "patient_payment_summary": "summary_payment",
    "patient_disposition_summary": "summary_disposition",
    "patient_admission_emergency_summary": "summary_admission_emergency",
    "patient_medical_surgical_summary": "summary_medical_surgical",
    "hospital_operation_summary": "summary_hospital_operation",
    "disease_system_summary": "summary_disease_system",
    "diagnosis_summary": "summary_diagnosis",
    "patient_risk_summary": "summary_risk",
    "disease_drilldown_summary": "summary_drilldown",
}


def _summary_query(table: str) -> Query:
    return lambda spark, sf_dir: comparable(summaries(spark, sf_dir)(table))


SUMMARY_COLUMNS: dict[str, list[str]] = {
    "patient_age_gender_summary": ["age_group", "age_group_sort", "gender", "discharge_count"],
    "patient_payment_summary": ["payment_typology_1", "discharge_count", "total_charges_sum", "total_costs_sum"],
    "patient_disposition_summary": ["patient_disposition", "discharge_count", "length_of_stay_sum",
                                    "total_charges_sum", "total_costs_sum"],
    "patient_admission_emergency_summary": ["type_of_admission", "emergency_department_indicator",
                                            "discharge_count", "length_of_stay_sum"],
    "patient_medical_surgical_summary": ["apr_medical_surgical_description", "discharge_count",
                                         "length_of_stay_sum", "total_charges_sum", "total_costs_sum"],
    "hospital_operation_summary": ["discharge_count", "length_of_stay_sum", "total_charges_sum", "total_costs_sum",
                                   "charge_cost_gap_sum", "emergency_charges_sum", "non_emergency_charges_sum",
                                   "emergency_costs_sum", "non_emergency_costs_sum", "emergency_yes_count",
                                   "emergency_known_count"],
    "disease_system_summary": ["apr_mdc_code", "apr_mdc_description", "discharge_count", "length_of_stay_sum",
                               "total_charges_sum", "total_costs_sum"],
    "diagnosis_summary": ["ccsr_diagnosis_code", "ccsr_diagnosis_description", "discharge_count",
                          "length_of_stay_sum", "total_charges_sum", "total_costs_sum"],
    "patient_risk_summary": ["apr_severity_code", "apr_risk_of_mortality", "apr_severity_description",
                             "discharge_count", "length_of_stay_sum", "total_charges_sum", "total_costs_sum"],
    "disease_drilldown_summary": ["apr_mdc_code", "apr_drg_code", "ccsr_diagnosis_code", "apr_mdc_description",
                                  "apr_drg_description", "ccsr_diagnosis_description", "discharge_count",
                                  "length_of_stay_sum", "total_charges_sum", "total_costs_sum"],
}

for _table, _key in _SUMMARY_KEYS.items():
    assert _table in SUMMARIES
    register(_key, _summary_query(_table),
             O.summary_sql(_table, ["hospital_service_area", "hospital_county", "facility_name"]
                           + SUMMARY_COLUMNS[_table]))


# --- D1-D17: serving queries -------------------------------------------------

def _scope(d: dict | None) -> Q.Scope:
    return Q.Scope.of(**(d or {}))


def _stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` as written under the checkpoint folder: compressed columns, of which each later step reads its own."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/carelens-stored-{uuid.uuid4().hex}"
    return saver(spark, folder)(df, "rows")


# answers that read their summary twice: for a total or a largest value, and for the rows
_READ_TWICE = {Q.age_gender, Q.payment, Q.disposition, Q.admission_emergency, Q.medical_surgical, Q.disease_systems,
               Q.top_diagnoses, Q.severity, C.drilldown_bubbles}


_DRILLED = [column for level in Q.LEVELS.values() for column in level]


def _on(table: str, fn: Callable[..., DataFrame], **kwargs) -> Query:
    """``fn`` over a summary.  One that is read twice and whole is stored first, so the fact is joined and
    aggregated once; a scope is better left to reach the tables."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fact = discharges(spark, sf_dir)
        if fn is C.drilldown_bubbles:
            # many groups: a task that joins and sorts line items should not hold their aggregate too
            fact = _stored(spark, fact.select(*SCOPE_COLUMNS, *_DRILLED, "length_of_stay", "total_charges", "total_costs"))
        summary = FactSummaries(fact)(table)
        whole = fn in _READ_TWICE and not kwargs.get("scope", Q.ALL).items()
        return fn(_stored(spark, summary) if whole else summary, **kwargs)
    return run


OP = "hospital_operation_summary"

register("q_areas", _on(OP, Q.areas), O.filter_values_sql("hospital_service_area"))
register("q_counties", _on(OP, Q.counties), O.filter_values_sql("hospital_county"))
register("q_counties_in_area", _on(OP, Q.counties, hospital_service_area="ASIA"),
         O.filter_values_sql("hospital_county", AREA))
register("q_facilities", _on(OP, Q.facilities), O.filter_values_sql("facility_name"))
register("q_facilities_in_county", _on(OP, Q.facilities, **AREA_COUNTY),
         O.filter_values_sql("facility_name", AREA_COUNTY))

for _suffix, _sc in (("", None), ("_area", AREA), ("_facility", FACILITY)):
    register(f"q_age_gender{_suffix}", _on("patient_age_gender_summary", Q.age_gender, scope=_scope(_sc)),
             O.age_gender_sql(_sc))
    register(f"q_payment{_suffix}", _on("patient_payment_summary", Q.payment, scope=_scope(_sc)),
             O.payment_sql(_sc))
    register(f"q_disposition{_suffix}", _on("patient_disposition_summary", Q.disposition, scope=_scope(_sc)),
             O.disposition_sql(_sc))
    register(f"q_admission_emergency{_suffix}",
             _on("patient_admission_emergency_summary", Q.admission_emergency, scope=_scope(_sc)),
             O.admission_emergency_sql(_sc))
    register(f"q_medical_surgical{_suffix}",
             _on("patient_medical_surgical_summary", Q.medical_surgical, scope=_scope(_sc)),
             O.medical_surgical_sql(_sc))
    register(f"q_kpi{_suffix}", _on(OP, Q.kpi, scope=_scope(_sc)), O.kpi_sql(_sc))
    register(f"q_hospital_resources{_suffix}", _on(OP, Q.hospital_resources, scope=_scope(_sc)),
             O.hospital_resources_sql(_sc))
    register(f"q_disease_systems{_suffix}", _on("disease_system_summary", Q.disease_systems, scope=_scope(_sc)),
             O.disease_systems_sql(_sc))
    register(f"q_top_diagnoses{_suffix}", _on("diagnosis_summary", Q.top_diagnoses, scope=_scope(_sc)),
             O.top_diagnoses_sql(_sc))
    register(f"q_severity{_suffix}", _on("patient_risk_summary", Q.severity, scope=_scope(_sc)),
             O.severity_sql(_sc))

register("q_kpi_empty_scope", _on(OP, Q.kpi, scope=_scope({"facility_name": "No Such Facility"})),
         O.kpi_sql({"facility_name": "No Such Facility"}))
register("q_disposition_top20", _on("patient_disposition_summary", Q.disposition, limit=20),
         O.disposition_sql(None, limit=20))
register("q_top_diagnoses_top30", _on("diagnosis_summary", Q.top_diagnoses, limit=30),
         O.top_diagnoses_sql(None, limit=30))

for _sort in ("discharge_count", "total_charges", "average_length_of_stay", "average_cost"):
    for _order in ("desc", "asc"):
        register(f"q_hospital_ranking_{_sort}_{_order}",
                 _on(OP, Q.hospital_ranking, sort_by=_sort, order=_order, limit=10),
                 O.hospital_ranking_sql(None, _sort, _order, 10))
register("q_hospital_ranking_area_top50", _on(OP, Q.hospital_ranking, scope=_scope(AREA), limit=50),
         O.hospital_ranking_sql(AREA, "discharge_count", "desc", 50))

register("q_hospital_comparison", _on(OP, Q.hospital_comparison), O.hospital_comparison_sql())
register("q_hospital_comparison_page2_cost",
         _on(OP, Q.hospital_comparison, sort_by="average_cost", order="asc", page=2, page_size=15),
         O.hospital_comparison_sql(None, "average_cost", "asc", 2, 15))
register("q_hospital_comparison_keyword",
         _on(OP, Q.hospital_comparison, keyword="supplier#0000000", page_size=100),
         O.hospital_comparison_sql(None, "discharge_count", "desc", 1, 100, "supplier#0000000"))

DD = "disease_drilldown_summary"
register("q_drilldown_mdc", _on(DD, Q.drilldown, level="mdc"), O.drilldown_sql("mdc"))
register("q_drilldown_drg", _on(DD, Q.drilldown, level="drg", apr_mdc_code=MDC), O.drilldown_sql("drg", None, MDC))
register("q_drilldown_ccsr", _on(DD, Q.drilldown, level="ccsr", apr_mdc_code=MDC, apr_drg_code=DRG),
         O.drilldown_sql("ccsr", None, MDC, DRG))
register("q_drilldown_drg_area", _on(DD, Q.drilldown, level="drg", scope=_scope(AREA), apr_mdc_code=MDC),
         O.drilldown_sql("drg", AREA, MDC))
register("q_breadcrumb_mdc", _on(DD, Q.breadcrumb, apr_mdc_code=MDC), O.breadcrumb_sql(None, MDC))
register("q_breadcrumb_drg", _on(DD, Q.breadcrumb, scope=_scope(AREA), apr_mdc_code=MDC, apr_drg_code=DRG),
         O.breadcrumb_sql(AREA, MDC, DRG))


# --- B1-B18, A6: cleaning, de-duplication, quality, incremental load ----------

from carelens.operators.clean import collapse_duplicates, clean_records, for_counters, stage  # noqa: E402
from carelens.operators.load import new_records  # noqa: E402
from carelens.operators.quality import quality_summary  # noqa: E402
from carelens.sources.files import remove  # noqa: E402
from carelens.sources.fixtures import raw_discharges  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

# "Current year" of the range rule, fixed so results do not change with the calendar.
CURRENT_YEAR = 2026

_NUMERIC_COLS = ["length_of_stay", "discharge_year", "apr_severity_code", "apr_risk_of_mortality", "birth_weight",
                 "total_charges", "total_costs"]
_CANONICAL_COLS = ["gender", "type_of_admission", "apr_medical_surgical_description",
                   "emergency_department_indicator"]
_TEXT_COLS = [c for c in O.RAW_COLS if c not in _NUMERIC_COLS + _CANONICAL_COLS + ["zip_code_3"]]
_DERIVED_COLS = ["age_group_sort", "zip_code_3", "zip_region_type", "is_facility_redacted", "birth_weight",
                 "disposition_group", "_redacted"]

_RENAMES = {"_invalid": "invalid_numeric_values", "_mismatch": "code_description_mismatches",
            "_redacted": "is_redacted"}


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(raw_discharges(spark, sf_dir), CURRENT_YEAR)


def _clean_select(columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        st = _staged(spark, sf_dir)
        cols = [F.col("source_row_number")]
        for c in columns:
            col = F.col(c)
            if c in ("_invalid", "_mismatch"):
                col = col.cast("long")
            cols.append(col.alias(_RENAMES.get(c, c)))
        return comparable(st.select(*cols))
    return run


for _key, _cols in (
    ("clean_text", _TEXT_COLS),
    ("clean_numbers", _NUMERIC_COLS + ["_invalid"]),
    ("clean_canonical", _CANONICAL_COLS),
    ("clean_derived", _DERIVED_COLS),
    ("clean_mismatch", ["_mismatch"]),
    ("clean_hash", ["source_row_hash"]),
    ("clean_gap", ["total_charges", "total_costs", "charge_cost_gap"]),
):
    register(_key, _clean_select(_cols), O.clean_select_sql(CURRENT_YEAR, _cols))


def _collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_duplicates(_staged(spark, sf_dir))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_duplicates(for_counters(_staged(spark, sf_dir)))


register("clean_dedup",
         lambda spark, sf_dir: _collapsed(spark, sf_dir).select(
             "source_row_hash", "source_file_name", "source_row_number", F.col("_copies").alias("copies"),
             F.col("_redacted").alias("is_redacted"), F.col("_core_missing").alias("core_missing")),
         O.dedup_sql(CURRENT_YEAR))
register("clean_fact", lambda spark, sf_dir: comparable(clean_records(_collapsed(spark, sf_dir))),
         O.clean_fact_sql(CURRENT_YEAR))
register("quality_summary", lambda spark, sf_dir: quality_summary(_counted(spark, sf_dir)),
         O.quality_sql(CURRENT_YEAR))


def _load_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(new_records(clean_records(_collapsed(spark, sf_dir)), None))


# records whose joins with the stored ones are shuffled at once
ROWS_PER_SLICE = 10_000_000


def _load_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new records when those of every second row number are stored already.

    Equal hashes are in one slice, so slices are joined one after the other; each leaves the disk before the next.
    """
    slices = max(1, -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // ROWS_PER_SLICE))  # counted in the footers
    if slices == 1:
        return _half_stored(spark, _collapsed(spark, sf_dir))[1]
    folder = f"{checkpoint_dir(spark).rstrip('/')}/carelens-slices-{uuid.uuid4().hex}"
    slice_of = F.coalesce(F.pmod(F.crc32(F.col("source_row_hash").cast("binary")), F.lit(slices)), F.lit(0))
    collapsed, save = _collapsed(spark, sf_dir), saver(spark, folder)
    with shuffles_removed(spark):
        collapsed.withColumn("_slice", slice_of).write.options(**STORED).partitionBy("_slice").parquet(f"{folder}/collapsed")
    for k in range(slices):
        part = spark.read.schema(collapsed.schema).parquet(f"{folder}/collapsed/_slice={k}")
        save(_new_half(clean_records(part)), f"fresh/_slice={k}")
        remove(spark, f"{folder}/collapsed/_slice={k}")
    return spark.read.parquet(f"{folder}/fresh").drop("_slice")


def _new_half(load: DataFrame) -> DataFrame:
    return new_records(load, load.where("source_row_number % 2 = 0"))


def _half_stored(spark: SparkSession, collapsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(collapsed load, new records) when the records of every second row number are stored already."""
    collapsed = _stored(spark, collapsed)
    return collapsed, _new_half(clean_records(collapsed))


def _load_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records a load has, finds stored and inserts, when all of them are stored."""
    load = _stored(spark, clean_records(_collapsed(spark, sf_dir)))
    inserted = new_records(load, load).select(F.count(F.lit(1))).scalar()
    return load.agg(F.count(F.lit(1)).alias("load_rows")).withColumn("inserted_rows", inserted)


def _quality_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    collapsed = _stored(spark, _counted(spark, sf_dir))
    load = clean_records(collapsed)
    return quality_summary(collapsed, new_records(load, load).select(F.count(F.lit(1))).scalar())


def _quality_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    collapsed, fresh = _half_stored(spark, _counted(spark, sf_dir))
    return quality_summary(collapsed, fresh.select(F.count(F.lit(1))).scalar())


register("load_first", _load_first, O.clean_fact_sql(CURRENT_YEAR))
register("load_partial_overlap", lambda spark, sf_dir: comparable(_load_partial(spark, sf_dir)),
         O.clean_fact_sql(CURRENT_YEAR) + " AND source_row_number % 2 <> 0")
register("load_rerun", _load_rerun,
         f"SELECT count(*) AS load_rows, CAST(0 AS BIGINT) AS inserted_rows FROM ({O.clean_fact_sql(CURRENT_YEAR)})")
register("quality_summary_rerun", _quality_rerun, O.quality_sql(CURRENT_YEAR, inserted="false"))
register("quality_partial_overlap", _quality_partial, O.quality_sql(CURRENT_YEAR, inserted="source_row_number % 2 <> 0"))


# --- A1-A7, A9, A11: the raw records as files, read and ingested -------------

from carelens.plans.jobs import ingest  # noqa: E402
from carelens.sources.delimited import quarantined, read_discharge_file, read_records  # noqa: E402
from carelens.sources.fixtures import rendered_files  # noqa: E402


def _src_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_discharge_file(spark, rendered_files(spark, sf_dir)).select(*sorted(O._PRESENT))


def _src_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_discharge_file(spark, rendered_files(spark, sf_dir)).select(
        "source_file_name", "source_row_number", "total_charges", "patient_disposition")


def _src_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/carelens-read-{uuid.uuid4().hex}"
    return quarantined(*read_records(spark, rendered_files(spark, sf_dir), saver(spark, folder)))


def _src_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rendered_files(spark, sf_dir)
    counters = ingest(spark, files, f"{files[0]}-fact", CURRENT_YEAR)
    return spark.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in counters.items()])


register("src_records", _src_records, O.src_records_sql())
register("src_ordinals", _src_ordinals, O.src_ordinals_sql())
register("src_quarantine", _src_quarantine, O.src_quarantine_sql())
register("src_ingest_quality", _src_quality, O.src_quality_sql(CURRENT_YEAR))


# --- E5-E10: chart re-aggregations; F1-F5: report fact packs ------------------

from carelens.operators.report import report_facts  # noqa: E402

for _suffix, _sc in (("", None), ("_area", AREA)):
    register(f"chart_payment_buckets{_suffix}",
             _on("patient_payment_summary", C.payment_buckets, scope=_scope(_sc)), O.payment_buckets_sql(_sc))
    register(f"chart_age_gender_pivot{_suffix}",
             _on("patient_age_gender_summary", C.age_gender_pivot, scope=_scope(_sc)), O.age_gender_pivot_sql(_sc))
    register(f"chart_admission_emergency{_suffix}",
             _on("patient_admission_emergency_summary", C.admission_emergency_split, scope=_scope(_sc)),
             O.admission_split_sql(_sc))
    register(f"chart_systems_top10{_suffix}", _on("disease_system_summary", C.systems_top10, scope=_scope(_sc)),
             O.systems_top10_sql(_sc))
    register(f"chart_hospital_bubbles{_suffix}", _on(OP, C.hospital_bubbles, scope=_scope(_sc)),
             O.hospital_bubbles_sql(_sc))
register("chart_drilldown_bubbles_mdc", _on(DD, C.drilldown_bubbles, level="mdc"), O.drilldown_bubbles_sql("mdc"))
register("chart_drilldown_bubbles_ccsr", _on(DD, C.drilldown_bubbles, level="ccsr", apr_mdc_code=MDC, apr_drg_code=DRG),
         O.drilldown_bubbles_sql("ccsr", None, MDC, DRG))
register("chart_drilldown_bubbles_drg", _on(DD, C.drilldown_bubbles, level="drg", apr_mdc_code=MDC),
         O.drilldown_bubbles_sql("drg", None, MDC))


def _read_columns(fact: DataFrame, tables: list[str]) -> list[str]:
    """The columns of ``fact`` that the summaries ``tables`` are made of."""
    made = {c for t in tables for c in [*SCOPE_COLUMNS, *SUMMARY_COLUMNS[t]]}
    if OP in tables:
        made.add("emergency_department_indicator")
    return [c for c in fact.columns if c in made or f"{c}_sum" in made]


def stored_summaries(spark: SparkSession, sf_dir: str, tables: list[str]) -> FactSummaries:
    """The summaries ``tables`` of a fact whose columns they need are stored first, each stored when asked for:
    answers read it more than once."""
    fact = discharges(spark, sf_dir)
    return FactSummaries(_stored(spark, fact.select(*_read_columns(fact, tables))), lambda summary: _stored(spark, summary))


REPORT_TABLES = {
    "operations": [OP],
    "patient": [OP, *[t for t in SUMMARIES if t.startswith("patient_") and t != "patient_risk_summary"]],
    "disease": [OP, "disease_system_summary", "diagnosis_summary", "patient_risk_summary"],
    "comprehensive": [t for t in SUMMARIES if t != DD],
}


def _report(report_type: str, scope: dict | None = None) -> Query:
    return lambda spark, sf_dir: report_facts(stored_summaries(spark, sf_dir, REPORT_TABLES[report_type]), report_type,
                                              _scope(scope) or Q.ALL)


for _rt in ("comprehensive", "operations", "patient", "disease"):
    register(f"report_{_rt}", _report(_rt), O.report_sql(_rt))
register("report_comprehensive_facility", _report("comprehensive", FACILITY), O.report_sql("comprehensive", FACILITY))
register("report_patient_area", _report("patient", AREA), O.report_sql("patient", AREA))
register("report_comprehensive_empty", _report("comprehensive", {"facility_name": "No Such Facility"}),
         O.report_sql("comprehensive", {"facility_name": "No Such Facility"}))


# --- A10: freshness, of a summary stamped with the newest order date at midnight UTC ---

from carelens.operators.summaries import with_updated_at  # noqa: E402


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.max(F.to_date("o_orderdate"))).scalar()
    at = F.timestamp_seconds(F.unix_date(newest).cast("long") * 86400)
    return Q.latest_updated_at(with_updated_at(summaries(spark, sf_dir)(OP), at))


register("q_freshness", _freshness,
         "SELECT strftime(max(CAST(o_orderdate AS DATE)), '%Y-%m-%d') || 'T08:00:00+08:00' AS updated_at FROM orders")

# --- A8, A9: a fact folder, summarised, added to, its summaries updated and read back ---

from carelens.plans.jobs import FOLDED, summarise, update_summaries  # noqa: E402
from carelens.operators.summaries import SCOPE_KEYS  # noqa: E402
from carelens.sources.tables import read_summary  # noqa: E402


def _summary_folder(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = f"{checkpoint_dir(spark).rstrip('/')}/carelens-folder-{uuid.uuid4().hex}"
        # stored first: both loads are cut from it
        fact = saver(spark, root)(discharges(spark, sf_dir).withColumn(
            "load_id", F.pmod(F.crc32(F.col("facility_name").cast("binary")), F.lit(2)) + 1), "both")
        fact.where("load_id = 1").write.options(**STORED).parquet(f"{root}/fact")
        summarise(spark, f"{root}/fact", f"{root}/summaries")
        fact.where("load_id = 2").write.options(**STORED).mode("append").parquet(f"{root}/fact")
        remove(spark, f"{root}/both")
        update_summaries(spark, f"{root}/fact", f"{root}/summaries")
        return comparable(read_summary(spark, f"{root}/summaries/{table}").drop(FOLDED, *SCOPE_KEYS.values()))
    return run


for _table in ("patient_payment_summary", "disease_drilldown_summary"):
    register(f"summary_folder_{_table.removesuffix('_summary')}", _summary_folder(_table), ORACLE[_SUMMARY_KEYS[_table]])


# --- D0-D3, D12: case and accents do not matter ---------------------------------

def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation summary with other spellings of the area in half of the facilities."""
    odd = F.substring("facility_name", -1, 1).isin(*"13579")
    area = F.col("hospital_service_area")
    return summaries(spark, sf_dir)(OP).withColumn("hospital_service_area", F.when(odd, F.replace(F.lower(area), F.lit("a"), F.lit("á")))
                                                   .otherwise(area))


_SPELLED = "CASE WHEN right(facility_name, 1) IN ('1','3','5','7','9') THEN replace(lower(hospital_service_area), 'a', 'á') ELSE hospital_service_area END"
FOLDED_AREA = {"hospital_service_area": "ásIA"}
register("q_areas_spelled", lambda spark, sf_dir: Q.areas(_spelled(spark, sf_dir)),
         O.with_summary(OP, f"SELECT min(a) AS hospital_service_area FROM (SELECT {_SPELLED} AS a FROM summ) "
                            "WHERE a IS NOT NULL GROUP BY strip_accents(lower(a))"))
register("q_counties_spelled", lambda spark, sf_dir: Q.counties(_spelled(spark, sf_dir), "ÁSIA"),
         O.filter_values_sql("hospital_county", AREA))
register("q_kpi_spelled", lambda spark, sf_dir: comparable(Q.kpi(_spelled(spark, sf_dir), _scope(FOLDED_AREA))),
         O.kpi_sql(AREA))
register("q_payment_spelled", _on("patient_payment_summary", Q.payment, scope=_scope(FOLDED_AREA)), O.payment_sql(FOLDED_AREA))
register("q_hospital_comparison_spelled", _on(OP, Q.hospital_comparison, page_size=7, keyword="sÜpplier#00000000_"),
         O.hospital_comparison_sql(None, "discharge_count", "desc", 1, 7, "sÜpplier#00000000_"))

# queries without SQL to check them
NO_ORACLE: set[str] = set()


# --- more parameter combinations of the serving layer -------------------------

register("q_breadcrumb_unknown", _on(DD, Q.breadcrumb, apr_mdc_code="no such code", apr_drg_code=DRG),
         O.breadcrumb_sql(None, "no such code", DRG))
register("q_drilldown_ccsr_facility",
         _on(DD, Q.drilldown, level="ccsr", scope=_scope(FACILITY), apr_mdc_code=MDC, apr_drg_code=DRG),
         O.drilldown_sql("ccsr", FACILITY, MDC, DRG))
register("q_drilldown_mdc_with_parent", _on(DD, Q.drilldown, level="mdc", apr_mdc_code=MDC),
         O.drilldown_sql("mdc", None, MDC))
register("q_hospital_ranking_county", _on(OP, Q.hospital_ranking, scope=_scope(AREA_COUNTY),
                                          sort_by="average_length_of_stay", order="desc", limit=5),
         O.hospital_ranking_sql(AREA_COUNTY, "average_length_of_stay", "desc", 5))
register("q_hospital_comparison_area_keyword",
         _on(OP, Q.hospital_comparison, scope=_scope(AREA), sort_by="total_charges", order="desc", page=1,
             page_size=7, keyword="00000001"),
         O.hospital_comparison_sql(AREA, "total_charges", "desc", 1, 7, "00000001"))
register("q_hospital_comparison_past_end", _on(OP, Q.hospital_comparison, page=500, page_size=100),
         O.hospital_comparison_sql(None, "discharge_count", "desc", 500, 100))
register("q_hospital_comparison_deep", _on(OP, Q.hospital_comparison, sort_by="average_cost", order="asc", page=4, page_size=6, shallow=5),
         O.hospital_comparison_sql(None, "average_cost", "asc", 4, 6))
register("q_top_diagnoses_top1_county", _on("diagnosis_summary", Q.top_diagnoses, scope=_scope(AREA_COUNTY), limit=1),
         O.top_diagnoses_sql(AREA_COUNTY, limit=1))
register("q_disposition_top1_facility",
         _on("patient_disposition_summary", Q.disposition, scope=_scope(FACILITY), limit=1),
         O.disposition_sql(FACILITY, limit=1))


# --- C1-C10 again, as the summarise job builds them by default: one scan -----

from carelens.operators.summaries import grouping_sets_aggregate, split_summary  # noqa: E402


def _single_scan_query(table: str) -> Query:
    return lambda spark, sf_dir: comparable(split_summary(grouping_sets_aggregate(discharges(spark, sf_dir)), table))


for _table, _key in _SUMMARY_KEYS.items():
    register(_key.replace("summary_", "summary_single_scan_"), _single_scan_query(_table), ORACLE[_key])


# --- F5 display variants: KPI cards -------------------------------------------

for _suffix, _sc in (("", None), ("_facility", FACILITY), ("_empty", {"facility_name": "No Such Facility"})):
    register(f"chart_kpi_cards{_suffix}", _on(OP, C.kpi_cards, scope=_scope(_sc)), O.kpi_cards_sql(_sc))
