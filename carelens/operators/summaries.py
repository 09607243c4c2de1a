"""The ten additive summary tables (fact -> scope grain + dimensions).

Every summary is one ``groupBy(scope columns, dims).agg(...)``: Spark plans a
partial aggregate before the shuffle and a final one after, so a hot
facility or code is combined on the map side.  Measures are additive (counts
and decimal sums), which is what lets any scope be re-aggregated exactly
later.  Descriptions are ``max`` (deterministic, decomposable) rather than
"first non-null", which depends on row order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from carelens.functions.text import fold
from carelens.schema import DEC_SUM, EMERGENCY_NO, EMERGENCY_YES, MEDICAL_SURGICAL_KINDS, SCOPE_COLUMNS

SCOPE = list(SCOPE_COLUMNS)


def _count() -> Column:
    return F.count(F.lit(1)).cast("long").alias("discharge_count")


def _sum(col: str, alias: str) -> Column:
    return F.sum(col).cast(DEC_SUM).alias(alias)


def _base() -> list[Column]:
    return [_count(), _sum("length_of_stay", "length_of_stay_sum"),
            _sum("total_charges", "total_charges_sum"), _sum("total_costs", "total_costs_sum")]


def _when_sum(cond: Column, value: Column, alias: str) -> Column:
    return F.sum(F.when(cond, value).otherwise(0)).cast(DEC_SUM).alias(alias)


def age_gender(fact: DataFrame) -> DataFrame:
    return fact.groupBy(*SCOPE, "age_group", "age_group_sort", "gender").agg(_count())


def payment(fact: DataFrame) -> DataFrame:
    return fact.groupBy(*SCOPE, "payment_typology_1").agg(
        _count(), _sum("total_charges", "total_charges_sum"), _sum("total_costs", "total_costs_sum"))


def disposition(fact: DataFrame) -> DataFrame:
    return fact.groupBy(*SCOPE, "patient_disposition").agg(*_base())


def admission_emergency(fact: DataFrame) -> DataFrame:
    return fact.groupBy(*SCOPE, "type_of_admission", "emergency_department_indicator").agg(
        _count(), _sum("length_of_stay", "length_of_stay_sum"))


def medical_surgical(fact: DataFrame) -> DataFrame:
    kinds = F.trim(F.col("apr_medical_surgical_description")).isin(*MEDICAL_SURGICAL_KINDS)
    return fact.where(kinds).groupBy(*SCOPE, "apr_medical_surgical_description").agg(*_base())


def hospital_operation(fact: DataFrame) -> DataFrame:
    ed = F.col("emergency_department_indicator")
    yes, no = ed == EMERGENCY_YES, ed == EMERGENCY_NO
    return fact.groupBy(*SCOPE).agg(
        *_base(),
        _sum("charge_cost_gap", "charge_cost_gap_sum"),
        _when_sum(yes, F.col("total_charges"), "emergency_charges_sum"),
        _when_sum(no, F.col("total_charges"), "non_emergency_charges_sum"),
        _when_sum(yes, F.col("total_costs"), "emergency_costs_sum"),
        _when_sum(no, F.col("total_costs"), "non_emergency_costs_sum"),
        F.sum(F.when(yes, 1).otherwise(0)).cast("long").alias("emergency_yes_count"),
        F.sum(F.when(ed.isin(EMERGENCY_YES, EMERGENCY_NO), 1).otherwise(0)).cast("long").alias("emergency_known_count"),
    )


def _with_descriptions(fact: DataFrame, codes: list[str], descriptions: list[str]) -> DataFrame:
    """``base`` measures by scope + codes, with ``max`` of each code's description.

    ``max`` over strings cannot use the hash aggregate (its buffer is not
    fixed-width) and would sort every fact row.  So the fact is first
    hash-aggregated by codes *and* descriptions (strings are fine as keys),
    and the descriptions are collapsed in a second aggregate over that
    group-level result, which is tiny next to the fact.
    """
    keys = [*SCOPE, *codes]
    fine = fact.groupBy(*keys, *descriptions).agg(*_base())
    return fine.groupBy(*keys).agg(
        *[F.max(d).alias(d) for d in descriptions],
        F.sum("discharge_count").cast("long").alias("discharge_count"),
        *[F.sum(c).cast(DEC_SUM).alias(c) for c in ("length_of_stay_sum", "total_charges_sum", "total_costs_sum")])


def disease_system(fact: DataFrame) -> DataFrame:
    return _with_descriptions(fact, ["apr_mdc_code"], ["apr_mdc_description"])


def diagnosis(fact: DataFrame) -> DataFrame:
    return _with_descriptions(fact, ["ccsr_diagnosis_code"], ["ccsr_diagnosis_description"])


def risk(fact: DataFrame) -> DataFrame:
    return _with_descriptions(fact, ["apr_severity_code", "apr_risk_of_mortality"], ["apr_severity_description"])


def drilldown(fact: DataFrame) -> DataFrame:
    return _with_descriptions(fact, ["apr_mdc_code", "apr_drg_code", "ccsr_diagnosis_code"],
                              ["apr_mdc_description", "apr_drg_description", "ccsr_diagnosis_description"])


# table name -> builder
SUMMARIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "patient_age_gender_summary": age_gender,
    "patient_payment_summary": payment,
    "patient_disposition_summary": disposition,
    "patient_admission_emergency_summary": admission_emergency,
    "patient_medical_surgical_summary": medical_surgical,
    "hospital_operation_summary": hospital_operation,
    "disease_system_summary": disease_system,
    "diagnosis_summary": diagnosis,
    "patient_risk_summary": risk,
    "disease_drilldown_summary": drilldown,
}


#: scope column -> stored key that ignores case and accents (see ``fold``)
SCOPE_KEYS = {c: f"_key_{c}" for c in SCOPE_COLUMNS}


def with_scope_keys(summary: DataFrame) -> DataFrame:
    """Add the folded keys by which stored summaries are clustered and filtered."""
    return summary.withColumns({key: fold(F.col(c)) for c, key in SCOPE_KEYS.items()})


def with_updated_at(summary: DataFrame, at: Column | None = None) -> DataFrame:
    """Stamp a summary with its build time (the freshness the serving layer reports), or with ``at``."""
    return summary.withColumn("updated_at", F.current_timestamp() if at is None else at)


# ---------------------------------------------------------------------------
# all ten summaries from one scan of the fact
# ---------------------------------------------------------------------------

_MS_KEY = "_medical_surgical"

# summary -> (its keys in the grouping-sets aggregate, descriptions to collapse per code, codes)
_SETS: dict[str, tuple[list[str], list[str], list[str]]] = {
    "patient_age_gender_summary": (["age_group", "age_group_sort", "gender"], [], []),
    "patient_payment_summary": (["payment_typology_1"], [], []),
    "patient_disposition_summary": (["patient_disposition"], [], []),
    "patient_admission_emergency_summary": (["type_of_admission", "emergency_department_indicator"], [], []),
    "patient_medical_surgical_summary": ([_MS_KEY], [], []),
    "hospital_operation_summary": ([], [], []),
    "disease_system_summary": (["apr_mdc_code", "apr_mdc_description"], ["apr_mdc_description"], ["apr_mdc_code"]),
    "diagnosis_summary": (["ccsr_diagnosis_code", "ccsr_diagnosis_description"], ["ccsr_diagnosis_description"],
                          ["ccsr_diagnosis_code"]),
    "patient_risk_summary": (["apr_severity_code", "apr_risk_of_mortality", "apr_severity_description"],
                             ["apr_severity_description"], ["apr_severity_code", "apr_risk_of_mortality"]),
    "disease_drilldown_summary": (
        ["apr_mdc_code", "apr_drg_code", "ccsr_diagnosis_code", "apr_mdc_description", "apr_drg_description",
         "ccsr_diagnosis_description"],
        ["apr_mdc_description", "apr_drg_description", "ccsr_diagnosis_description"],
        ["apr_mdc_code", "apr_drg_code", "ccsr_diagnosis_code"]),
}

# Summaries rolled up from a finer set instead of being expanded themselves:
# summary -> (finer summary, keys kept, descriptions collapsed).  Every set
# carries every measure, so a roll-up is exact (sums of sums).
_ROLLUPS: dict[str, tuple[str, list[str], list[str]]] = {
    "hospital_operation_summary": ("patient_disposition_summary", [], []),
    "disease_system_summary": ("disease_drilldown_summary", ["apr_mdc_code"], ["apr_mdc_description"]),
    "diagnosis_summary": ("disease_drilldown_summary", ["ccsr_diagnosis_code"], ["ccsr_diagnosis_description"]),
}

# Which measures each summary keeps (beyond discharge_count).
_MEASURES: dict[str, list[str]] = {
    "patient_age_gender_summary": [],
    "patient_payment_summary": ["total_charges_sum", "total_costs_sum"],
    "patient_admission_emergency_summary": ["length_of_stay_sum"],
    "hospital_operation_summary": [
        "length_of_stay_sum", "total_charges_sum", "total_costs_sum", "charge_cost_gap_sum", "emergency_charges_sum",
        "non_emergency_charges_sum", "emergency_costs_sum", "non_emergency_costs_sum", "emergency_yes_count",
        "emergency_known_count"],
}
_BASE_SUMS = ["length_of_stay_sum", "total_charges_sum", "total_costs_sum"]


def _all_keys() -> list[str]:
    keys: list[str] = []
    for own, _, _ in _SETS.values():
        keys += [k for k in own if k not in keys]
    return [*SCOPE, *keys]


def grouping_sets_aggregate(fact: DataFrame) -> DataFrame:
    """One pass over the fact computing every summary's groups, tagged by ``_gid``.

    The fact is read once; Spark expands each row into the ten grouping sets
    and partially aggregates them before one shuffle.  Sets that are roll-ups
    of a finer set (see ``_ROLLUPS``) are not expanded; ``split_summary``
    re-aggregates them from the finer set's small result.  Every measure is a
    fixed-width count or decimal sum, so it stays a hash aggregate;
    descriptions are grouping keys here and are collapsed per code later on
    the (small) group-level result.  The medical/surgical set keys on the
    description only where it passes that summary's filter.
    """
    ed = F.col("emergency_department_indicator")
    yes, no = ed == EMERGENCY_YES, ed == EMERGENCY_NO
    kinds = F.trim(F.col("apr_medical_surgical_description")).isin(*MEDICAL_SURGICAL_KINDS)
    src = fact.withColumn(_MS_KEY, F.when(kinds, F.col("apr_medical_surgical_description")))
    keys = _all_keys()
    sets = [[*SCOPE, *own] for name, (own, _, _) in _SETS.items() if name not in _ROLLUPS]
    return src.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_gid"),
        *_base(),
        _sum("charge_cost_gap", "charge_cost_gap_sum"),
        _when_sum(yes, F.col("total_charges"), "emergency_charges_sum"),
        _when_sum(no, F.col("total_charges"), "non_emergency_charges_sum"),
        _when_sum(yes, F.col("total_costs"), "emergency_costs_sum"),
        _when_sum(no, F.col("total_costs"), "non_emergency_costs_sum"),
        F.sum(F.when(yes, 1).otherwise(0)).cast("long").alias("emergency_yes_count"),
        F.sum(F.when(ed.isin(EMERGENCY_YES, EMERGENCY_NO), 1).otherwise(0)).cast("long").alias("emergency_known_count"),
    )


def _gid(own: list[str]) -> int:
    keys = _all_keys()
    members = set(SCOPE) | set(own)
    return sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in members)


_ALL_MEASURES = ["length_of_stay_sum", "total_charges_sum", "total_costs_sum", "charge_cost_gap_sum",
                 "emergency_charges_sum", "non_emergency_charges_sum", "emergency_costs_sum",
                 "non_emergency_costs_sum", "emergency_yes_count", "emergency_known_count"]


def _sum_measure(m: str) -> Column:
    out = F.sum(m)
    return (out.cast("long") if m.endswith("_count") else out.cast(DEC_SUM)).alias(m)


def split_summary(groups: DataFrame, name: str) -> DataFrame:
    """One summary table out of ``grouping_sets_aggregate``; same schema as ``SUMMARIES[name]``."""
    measures = _MEASURES.get(name, _BASE_SUMS)
    if name in _ROLLUPS:
        finer, codes, descriptions = _ROLLUPS[name]
        rows = groups.where(F.col("_gid") == _gid(_SETS[finer][0]))
        return rows.groupBy(*SCOPE, *codes).agg(
            *[F.max(d).alias(d) for d in descriptions],
            F.sum("discharge_count").cast("long").alias("discharge_count"),
            *[_sum_measure(m) for m in measures])
    own, descriptions, codes = _SETS[name]
    rows = groups.where(F.col("_gid") == _gid(own))
    if name == "patient_medical_surgical_summary":
        rows = rows.where(F.col(_MS_KEY).isNotNull()).withColumnRenamed(_MS_KEY, "apr_medical_surgical_description")
        own = ["apr_medical_surgical_description"]
    if descriptions:
        return rows.groupBy(*SCOPE, *codes).agg(
            *[F.max(d).alias(d) for d in descriptions],
            F.sum("discharge_count").cast("long").alias("discharge_count"),
            *[_sum_measure(m) for m in measures])
    return rows.select(*SCOPE, *own, "discharge_count", *measures)


# ---------------------------------------------------------------------------
# incremental maintenance: fold a load's new records into existing summaries
# ---------------------------------------------------------------------------

# Description columns of each summary (collapsed with max); every other
# non-measure column is a key.
DESCRIPTIONS: dict[str, list[str]] = {
    "disease_system_summary": ["apr_mdc_description"],
    "diagnosis_summary": ["ccsr_diagnosis_description"],
    "patient_risk_summary": ["apr_severity_description"],
    "disease_drilldown_summary": ["apr_mdc_description", "apr_drg_description", "ccsr_diagnosis_description"],
}


def _is_measure(column: str) -> bool:
    return column == "discharge_count" or column.endswith("_sum") or column.endswith("_count")


def merge_summary(name: str, current: DataFrame, delta: DataFrame) -> DataFrame:
    """``current`` + ``delta`` re-aggregated at the summary's grain (both without ``updated_at``).

    Exact because every measure is additive (counts, decimal sums) and
    descriptions are ``max``; the work is proportional to the summary's size
    plus the new records, not to the fact.
    """
    columns = [c for c in delta.columns if c != "updated_at"]
    descriptions = DESCRIPTIONS.get(name, [])
    keys = [c for c in columns if not _is_measure(c) and c not in descriptions]
    both = current.select(*columns).unionByName(delta.select(*columns))
    aggs = [F.max(d).alias(d) for d in descriptions]
    for c in columns:
        if _is_measure(c):
            total = F.sum(c)
            aggs.append((total.cast("long") if c.endswith("_count") else total.cast(DEC_SUM)).alias(c))
    return both.groupBy(*keys).agg(*aggs).select(*columns)
