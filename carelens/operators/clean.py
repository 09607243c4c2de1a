"""Cleaning rules, record hash and keep-first de-duplication.

``stage`` maps raw source strings to typed, cleaned records, one output row
per input row, and tags each with the facts the quality counters need
(``_invalid`` numeric values, ``_mismatch`` pairs, ``_redacted``).  Every rule
is a Column expression in one projection, so the whole stage is a single
narrow, code-generated step after the scan.

``collapse_duplicates`` then keeps the first occurrence of each distinct
record.  It is an aggregation keyed by the record hash with ``min`` over
(file, row number, record): partial aggregation collapses a hot record on the
map side, so a record repeated across a third of the input never lands in one
task (a ``row_number`` window would).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from carelens.functions.numbers import parse_texts, to_stored
from carelens.functions.text import canonical_text, lookup, normalize_text
from carelens.schema import (
    ADMISSION_ALIASES, AGE_GROUP_SORT, CODE_DESCRIPTION_PAIRS, DEC_MONEY, EMERGENCY_ALIASES, EMERGENCY_NO,
    EMERGENCY_YES, FACT_COLUMNS, GENDER_ALIASES, HASH_NULL, HASH_SEPARATOR, MEDICAL_SURGICAL_ALIASES,
    MIN_DISCHARGE_YEAR, NEWBORN, NUMERIC_TYPES, RAW_COLUMNS, REDACTED_FACILITY, REQUIRED_VALUES, VALID_LEVEL_CODES,
    ZIP_LOCAL, ZIP_OUT_OF_STATE, ZIP_OUT_OF_STATE_TOKEN, ZIP_UNKNOWN,
)

PROVENANCE = ["source_file_name", "source_row_number"]


def range_rules(current_year: int | Column) -> dict[str, callable]:
    """Value -> Column(bool) violation test per numeric column; NULL is never a violation."""
    year = current_year if isinstance(current_year, Column) else F.lit(current_year)
    valid_codes = [F.lit(v) for v in VALID_LEVEL_CODES]
    return {
        "length_of_stay": lambda v: v < 0,
        "discharge_year": lambda v: (v < MIN_DISCHARGE_YEAR) | (v > year),
        "apr_severity_code": lambda v: ~v.isin(*valid_codes),
        "apr_risk_of_mortality": lambda v: ~v.isin(*valid_codes),
        "total_charges": lambda v: v < 0,
        "total_costs": lambda v: v < 0,
        "birth_weight": lambda v: v <= 0,
    }


def charge_cost_gap(charges: Column, costs: Column) -> Column:
    return (charges - costs).cast(DEC_MONEY)


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")),
                               F.lit(HASH_SEPARATOR), F.lit("\\" + HASH_SEPARATOR)),
                     F.lit("<"), F.lit("\\<"))


def record_hash(cols: list[Column]) -> Column:
    """SHA-256 of the record's values joined by ``|``; NULL as ``<NULL>``; ``\\ | <`` escaped.

    The values are handled as one array: spelled out per column, the escapes make a method that the JVM
    does not compile.  Few records hold a character to escape, so one look at the whole record decides.
    """
    texts = F.array(*[c.cast("string") for c in cols])
    special = F.array_join(texts, "").rlike(r"[\\|<]")
    return F.sha2(F.array_join(F.when(special, F.transform(texts, _escaped)).otherwise(texts), HASH_SEPARATOR, HASH_NULL), 256)


def stage(raw: DataFrame, current_year: int | Column | None = None) -> DataFrame:
    """Clean every raw record (one row in, one row out).

    ``raw`` carries ``source_file_name``, ``source_row_number`` and the 33 raw
    string columns (null tokens already applied by the reader).  The result
    has the 41 fact columns (``source_row_hash`` included) plus ``_invalid``
    (count of invalid numeric values), ``_mismatch`` (count of one-sided
    code/description pairs) and ``_redacted``.

    The rules run as a few stacked projections — text, parsed numbers,
    violations, stored values, tallies — so each intermediate is computed
    once and the plan stays linear in the number of columns.  Numbers are
    parsed as an array: one small expression for all columns, where one per
    column, and the texts beside them, make a method too large for the JVM to compile.
    """
    if current_year is None:
        current_year = F.year(F.current_date())
    rules = range_rules(current_year)
    c = F.col
    # provenance and any position tags pass through untouched
    prov = [x for x in raw.columns if x not in RAW_COLUMNS]
    numeric = list(NUMERIC_TYPES)

    words = [x for x in RAW_COLUMNS if x not in NUMERIC_TYPES]
    tx = raw.select(*prov, *[normalize_text(c(x)).alias(x) for x in words],
                    F.transform(F.array(*[c(x).cast("string") for x in numeric]), normalize_text).alias("_texts"))
    nx = tx.select(*prov, *words, *[c("_texts")[i].alias(x) for i, x in enumerate(numeric)],
                   parse_texts(c("_texts")).alias("_numbers"))
    px = nx.select("*", *[c("_numbers")[i].alias(f"_p_{x}") for i, x in enumerate(numeric)])
    vx = px.select("*", *[F.coalesce(rules[x](c(f"_p_{x}")), F.lit(False)).alias(f"_v_{x}") for x in numeric])

    canonical = {
        "gender": canonical_text(c("gender"), GENDER_ALIASES),
        "type_of_admission": canonical_text(c("type_of_admission"), ADMISSION_ALIASES),
        "apr_medical_surgical_description": canonical_text(c("apr_medical_surgical_description"),
                                                           MEDICAL_SURGICAL_ALIASES),
        "emergency_department_indicator": canonical_text(c("emergency_department_indicator"), EMERGENCY_ALIASES),
        "zip_code_3": F.upper(c("zip_code_3")),
    }
    sx = vx.select(
        *prov,
        *[canonical[x].alias(x) if x in canonical else
          (F.when(~c(f"_v_{x}"), to_stored(c(f"_p_{x}"), NUMERIC_TYPES[x])).alias(x) if x in NUMERIC_TYPES else c(x))
          for x in RAW_COLUMNS],
        *[c(x).isNotNull().alias(f"_t_{x}") for x in numeric],
        *[c(f"_v_{x}") for x in numeric],
        F.coalesce(F.upper(c("facility_name")) == REDACTED_FACILITY, F.lit(False)).alias("_redacted"),
    )
    invalid = [(c(f"_t_{x}") & c(x).isNull() & ~c(f"_v_{x}")).cast("int") + c(f"_v_{x}").cast("int")
               for x in numeric]
    ed = c("emergency_department_indicator")
    zip_text = c("zip_code_3")
    fixed = sx.select(
        *prov,
        *[x for x in RAW_COLUMNS if x not in ("emergency_department_indicator", "birth_weight")],
        F.when(ed.isin(EMERGENCY_YES, EMERGENCY_NO), ed).alias("emergency_department_indicator"),
        F.when(c("type_of_admission") == NEWBORN, c("birth_weight")).alias("birth_weight"),
        lookup(c("age_group"), AGE_GROUP_SORT, "int").alias("age_group_sort"),
        F.when(zip_text == ZIP_OUT_OF_STATE_TOKEN, ZIP_OUT_OF_STATE)
        .when(zip_text.rlike(r"(?U)^\d{3}$"), ZIP_LOCAL)
        .when(zip_text.isNotNull(), ZIP_UNKNOWN).alias("zip_region_type"),
        c("_redacted").cast("int").alias("is_facility_redacted"),
        F.lit(None).cast("string").alias("disposition_group"),
        sum(invalid[1:], invalid[0]).alias("_invalid"),
        "_redacted",
    )
    mismatch = sum(((c(a).isNull() != c(b).isNull()).cast("int") for a, b in CODE_DESCRIPTION_PAIRS), F.lit(0))
    return fixed.select(
        "*",
        mismatch.alias("_mismatch"),
        record_hash([c(x) for x in RAW_COLUMNS]).alias("source_row_hash"),
        charge_cost_gap(c("total_charges"), c("total_costs")).alias("charge_cost_gap"),
    )


def for_counters(staged: DataFrame) -> DataFrame:
    """What the quality counters and the load look at; equal hashes mean equal records, so the rest decides nothing.

    Of the required values only whether one is missing is kept, so neither they nor their texts are sorted and shuffled.
    """
    return staged.select("source_row_hash", *PROVENANCE, core_missing().alias("_core_missing"), "_redacted", "_invalid", "_mismatch")


def core_missing(cols: tuple[str, ...] = REQUIRED_VALUES) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNull().cast("int")) > 0


def collapse_duplicates(staged: DataFrame) -> DataFrame:
    """One row per distinct record (by hash): its first occurrence plus per-record tallies.

    ``_copies`` is how many input rows carried the record; ``_invalid`` and
    ``_mismatch`` are summed over those rows.  Ordering for "first" is
    (source_file_name, source_row_number), the order rows were read in.
    """
    payload = [c for c in staged.columns if c not in ("source_row_hash", "_invalid", "_mismatch")]
    ordered = PROVENANCE + [c for c in payload if c not in PROVENANCE]
    first = (
        # shuffled as bytes, half of their text
        staged.groupBy(F.unhex("source_row_hash").alias("_hash"))
        .agg(
            F.min(F.struct(*ordered)).alias("_first"),
            F.count(F.lit(1)).alias("_copies"),
            F.sum("_invalid").alias("_invalid"),
            F.sum("_mismatch").alias("_mismatch"),
        )
    )
    rows = first.select(F.lower(F.hex("_hash")).alias("source_row_hash"), "_first.*", "_copies", "_invalid", "_mismatch")
    return rows if "_core_missing" in rows.columns else rows.withColumn("_core_missing", core_missing())


def clean_records(collapsed: DataFrame) -> DataFrame:
    """Rows that enter the fact: not redacted, all required values present; fact column order (those there are)."""
    return collapsed.where(~F.col("_redacted") & ~F.col("_core_missing")).select(*[c for c in FACT_COLUMNS if c in collapsed.columns])


def clean(raw: DataFrame, current_year: int | Column | None = None) -> DataFrame:
    """Raw source strings -> clean, de-duplicated fact rows."""
    return clean_records(collapse_duplicates(stage(raw, current_year)))
