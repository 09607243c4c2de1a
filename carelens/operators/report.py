"""Report fact packs: the numbers behind each written report, as long rows.

A report is a fixed list of serving answers under one scope.  Each answer is
turned into ``(report_type, section, position, metric, value_text)`` rows by one
aggregate: it gathers the answer's rows in order into one list (top-N lists and
breakdowns by a code list, so their size does not grow with the data), and the
section's metrics (position 0), taken from the list's size and its first row,
and the table's cells (positions from 1) are read off that list.  So a summary is
scanned once for each answer taken from it.  A section also names the answers
it rests on, under ``<section>.sources``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from carelens.functions.format import count_text, decimal_text, label_text, money_text, percent_text
from carelens.operators import serving as Q
from carelens.operators.serving import SummaryLookup
from carelens.schema import NOT_AVAILABLE

OUT = ["report_type", "section", "position", "metric", "value_text"]
OP = "hospital_operation_summary"

#: column -> its text
Cells = dict[str, Callable[[Column], Column]]


def _fact(section: str, position: Column, metric: str, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), position.cast("int").alias("position"), F.lit(metric).alias("metric"),
                    value.alias("value_text"))


def _facts(answer: DataFrame, order: list[Column], texts: Cells, section: str, counted: str | None = None,
           first: dict[str, str] | None = None, table: str | None = None, cells: list[str] | None = None) -> DataFrame:
    """Rows (section, position, metric, value_text) of one answer, whose rows are sorted by ``order``, ascending.

    ``counted`` names the metric that counts the answer's rows, ``first`` the metrics that show a column of its
    first row, ``table`` the section in which ``cells`` of every row are listed.
    """
    row = F.struct(F.lit(1).alias("_row"), *[o.alias(f"_o{i}") for i, o in enumerate(order)], *[text(F.col(c)).alias(c) for c, text in texts.items()])
    rows = F.col("rows")
    facts = [_fact(section, F.lit(0), counted, count_text(F.size(rows)))] if counted else []
    top = F.get(rows, F.lit(0))
    facts += [_fact(section, F.lit(0), metric, F.when(F.size(rows) > 0, top[c]).otherwise(F.lit(NOT_AVAILABLE)))
              for metric, c in (first or {}).items()]
    found = F.array(*facts)
    if table:
        listed = F.transform(rows, lambda r, i: F.array(*[_fact(table, i + 1, c, r[c]) for c in cells or texts]))
        found = F.concat(found, F.flatten(listed))
    return answer.agg(F.sort_array(F.collect_list(row)).alias("rows")).select(F.inline(found))


def _sources(like: DataFrame, section: str, answers: list[str]) -> DataFrame:
    spark = like.sparkSession
    return spark.range(1).select(F.inline(F.array(*[_fact(f"{section}.sources", F.lit(i), "source", F.lit(a))
                                                    for i, a in enumerate(answers, 1)])))


def kpi_section(lookup: SummaryLookup, scope: Q.Scope) -> list[DataFrame]:
    texts = {"hospital_count": count_text, "discharge_count": count_text, "average_length_of_stay": decimal_text,
             "total_charges": money_text, "total_costs": money_text, "emergency_ratio": percent_text}
    kpi = Q.kpi(lookup(OP), scope)
    return [_facts(kpi, [], texts, "kpi", first={c: c for c in texts}), _sources(kpi, "kpi", ["kpi"])]


def operations_section(lookup: SummaryLookup, scope: Q.Scope) -> list[DataFrame]:
    ranking = Q.hospital_ranking(lookup(OP), scope, limit=10)
    texts = {"facility_name": label_text, "hospital_county": label_text, "discharge_count": count_text, "average_cost": money_text}
    return [_facts(ranking, [F.col("rank")], texts, "operations", "ranked_hospitals",
                   {"top_facility_name": "facility_name", "top_discharge_count": "discharge_count", "top_average_cost": "average_cost"},
                   "operations.hospitals"),
            _sources(ranking, "operations", ["hospital_ranking"])]


def patient_section(lookup: SummaryLookup, scope: Q.Scope) -> list[DataFrame]:
    most = -F.col("discharge_count")
    money = {"discharge_count": count_text, "total_charges": money_text, "total_costs": money_text}
    ages = Q.age_gender(lookup("patient_age_gender_summary"), scope)
    sort = F.col("age_group_sort")
    payments = Q.payment(lookup("patient_payment_summary"), scope)
    dispositions = Q.disposition(lookup("patient_disposition_summary"), scope, limit=10)
    admissions = Q.admission_emergency(lookup("patient_admission_emergency_summary"), scope)
    admission = ["type_of_admission", "emergency_department_indicator"]
    kinds = Q.medical_surgical(lookup("patient_medical_surgical_summary"), scope)
    kind = "apr_medical_surgical_description"
    return [
        _facts(ages, [most, sort.isNull(), sort, F.col("gender")], {"age_group": label_text, "gender": label_text}, "patient",
               "age_gender_groups", {"top_age_group": "age_group", "top_gender": "gender"}),
        _facts(payments, [most, F.col("payment_typology_1")], {"payment_typology_1": label_text, **money}, "patient", "payment_types",
               {"top_payment": "payment_typology_1", "top_payment_count": "discharge_count"}, "patient.payments"),
        _facts(dispositions, [F.col("position")], {"patient_disposition": label_text, **money}, "patient", "dispositions",
               {"top_disposition": "patient_disposition"}, "patient.dispositions"),
        _facts(admissions, [F.col(c) for c in admission], {**dict.fromkeys(admission, label_text), "discharge_count": count_text},
               "patient", "admission_emergency_groups", table="patient.admission_emergency"),
        _facts(kinds, [most, F.col(kind)], {kind: label_text, **money}, "patient", table="patient.medical_surgical"),
        _sources(ages, "patient", ["age_gender", "payment", "disposition", "admission_emergency", "medical_surgical"]),
    ]


def disease_section(lookup: SummaryLookup, scope: Q.Scope) -> list[DataFrame]:
    most = -F.col("discharge_count")
    systems = Q.disease_systems(lookup("disease_system_summary"), scope)
    diagnoses = Q.top_diagnoses(lookup("diagnosis_summary"), scope, limit=10)
    severity = Q.severity(lookup("patient_risk_summary"), scope)
    return [
        _facts(systems, [most, F.coalesce(F.col("apr_mdc_code"), F.lit(""))], {"apr_mdc_code": label_text, "discharge_count": count_text},
               "disease", "disease_systems", {"top_system_code": "apr_mdc_code", "top_system_count": "discharge_count"}),
        _facts(diagnoses, [F.col("position")],
               {"ccsr_diagnosis_code": label_text, "ccsr_diagnosis_description": label_text, "discharge_count": count_text},
               "disease", "top_diagnoses", {"top_diagnosis_code": "ccsr_diagnosis_code"}, "disease.diagnoses"),
        _facts(severity, [], {}, "disease", "severity_levels"),
        _sources(systems, "disease", ["disease_systems", "top_diagnoses", "severity"]),
    ]


SECTIONS = {
    "comprehensive": [kpi_section, operations_section, patient_section, disease_section],
    "operations": [kpi_section, operations_section],
    "patient": [kpi_section, patient_section],
    "disease": [kpi_section, disease_section],
}


def report_facts(lookup: SummaryLookup, report_type: str, scope: Q.Scope = Q.ALL) -> DataFrame:
    """All section facts of one report type under one scope."""
    if report_type not in SECTIONS:
        raise ValueError(f"unknown report type: {report_type}")
    parts = [part for section in SECTIONS[report_type] for part in section(lookup, scope)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("report_type", F.lit(report_type)).select(*OUT)
