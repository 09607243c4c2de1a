"""Chart re-aggregations the dashboard computes from serving answers.

All of them are small aggregations over a scoped summary (or a serving
answer) expressed as conditional sums — no joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from carelens.functions.format import display_count, display_days, display_money, display_percent
from carelens.functions.text import strip
from carelens.operators import serving as Q
from carelens.schema import EMERGENCY_YES, NO_DESCRIPTION, PAYMENT_BUCKETS


def _n_when(cond) -> F.Column:
    return F.coalesce(F.sum(F.when(cond, F.col("discharge_count"))), F.lit(0)).cast("long")


def payment_buckets(payment_summary: DataFrame, scope: Q.Scope = Q.ALL) -> DataFrame:
    """The five payment buckets in display order, 0 when a bucket is empty; unknown/NULL -> Other."""
    key = F.lower(strip(F.col("payment_typology_1")))
    named = PAYMENT_BUCKETS[:-1]
    matches = [key == b.lower() for b in named]
    other = ~F.coalesce(key.isin(*[b.lower() for b in named]), F.lit(False))
    sums = scope.apply(payment_summary).agg(
        *[_n_when(m).alias(f"b{i}") for i, m in enumerate(matches)], _n_when(other).alias(f"b{len(named)}"))
    args = []
    for i, name in enumerate(PAYMENT_BUCKETS):
        args += [F.lit(i + 1), F.lit(name), F.col(f"b{i}")]
    return sums.select(F.stack(F.lit(len(PAYMENT_BUCKETS)), *args)).toDF(
        "position", "payment_bucket", "discharge_count")


def age_gender_pivot(age_gender_summary: DataFrame, scope: Q.Scope = Q.ALL) -> DataFrame:
    """Per age group: M and F counts (0 when absent); other genders are left out of both."""
    g = F.col("gender")
    return scope.apply(age_gender_summary).groupBy("age_group").agg(
        F.max("age_group_sort").alias("age_group_sort"),
        _n_when(g == "M").alias("male_count"),
        _n_when(g == "F").alias("female_count"),
    ).orderBy(F.col("age_group_sort").asc_nulls_last(), "age_group")


def admission_emergency_split(admission_summary: DataFrame, scope: Q.Scope = Q.ALL) -> DataFrame:
    """Per admission type: ED = Y versus everything else (N and unknown together)."""
    yes = F.coalesce(F.col("emergency_department_indicator") == EMERGENCY_YES, F.lit(False))
    return scope.apply(admission_summary).groupBy("type_of_admission").agg(
        _n_when(yes).alias("emergency_count"), _n_when(~yes).alias("non_emergency_count")
    ).orderBy("type_of_admission")


def systems_top10(system_summary: DataFrame, scope: Q.Scope = Q.ALL) -> DataFrame:
    """The ten largest disease systems with their chart position."""
    rows = Q.disease_systems(system_summary, scope)
    order = [F.desc("discharge_count"), F.coalesce(F.col("apr_mdc_code"), F.lit("")).asc()]
    top = rows.orderBy(*order).limit(10)
    return Q.numbered(top, order).select(
        "position", "apr_mdc_code", "apr_mdc_description", "discharge_count",
        F.coalesce("apr_mdc_code", F.lit("")).alias("code_label"),
        F.coalesce("apr_mdc_description", F.lit(NO_DESCRIPTION)).alias("description_label"))


def hospital_bubbles(operation: DataFrame, scope: Q.Scope = Q.ALL) -> DataFrame:
    """Bubble chart points: (discharges, average cost or 0, average stay or 0) per hospital."""
    rows = Q.hospital_resources(operation, scope)
    return rows.select(
        "facility_name", "hospital_county", "hospital_service_area", "discharge_count",
        F.coalesce("average_cost", F.lit(0.0)).alias("bubble_average_cost"),
        F.coalesce("average_length_of_stay", F.lit(0.0)).alias("bubble_average_length_of_stay"),
        "emergency_ratio")


def drilldown_bubbles(drilldown_summary: DataFrame, level: str, scope: Q.Scope = Q.ALL,
                      apr_mdc_code: str | None = None, apr_drg_code: str | None = None) -> DataFrame:
    """Drill-down level with bubble size ``round(16 + 66 * sqrt(count / max(largest, 1)))``."""
    rows = Q.drilldown(drilldown_summary, level, scope, apr_mdc_code, apr_drg_code)
    largest = F.greatest(F.coalesce(rows.select(F.max("discharge_count")).scalar(), F.lit(0)), F.lit(1))
    size = F.floor(F.lit(16.0) + F.sqrt(F.col("discharge_count") / largest) * 66 + 0.5).cast("int")
    label = F.when(F.coalesce(F.length("description"), F.lit(0)) > 0, F.col("description")).otherwise(NO_DESCRIPTION)
    return rows.select("code", "description", "discharge_count", size.alias("symbol_size"),
                       label.alias("description_label"))


def kpi_cards(operation: DataFrame, scope: Q.Scope = Q.ALL) -> DataFrame:
    """The KPI row as the dashboard cards show it (display text per figure)."""
    k = Q.kpi(operation, scope)
    return k.select(
        display_count(F.col("hospital_count")).alias("hospital_count_text"),
        display_count(F.col("discharge_count")).alias("discharge_count_text"),
        display_days(F.col("average_length_of_stay")).alias("average_length_of_stay_text"),
        display_money(F.col("total_charges")).alias("total_charges_text"),
        display_money(F.col("total_costs")).alias("total_costs_text"),
        display_money(F.col("average_cost")).alias("average_cost_text"),
        display_percent(F.col("emergency_ratio")).alias("emergency_ratio_text"),
    )
