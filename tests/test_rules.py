"""One hand-written frame per cleaning rule, with its boundary values."""

from decimal import Decimal

from pyspark.sql import functions as F

from carelens.operators.clean import clean, collapse_duplicates, stage
from carelens.operators.quality import quality_summary
from carelens.schema import RAW_COLUMNS


def raw_frame(spark, rows):
    """rows: list of dicts of raw column -> text; row numbers follow list order."""
    full = []
    for i, r in enumerate(rows):
        base = {"facility_name": "Fac", "discharge_year": "2020", "ccsr_diagnosis_code": "D1",
                "length_of_stay": "3"}
        base.update(r)
        full.append(("f.csv", i + 2, *[base.get(c) for c in RAW_COLUMNS]))
    schema = "source_file_name string, source_row_number long, " + ", ".join(f"{c} string" for c in RAW_COLUMNS)
    return spark.createDataFrame(full, schema)


def staged_rows(spark, rows, year=2024):
    return [r.asDict() for r in stage(raw_frame(spark, rows), year).orderBy("source_row_number").collect()]


def test_text_strip_like_python(spark):
    out = staged_rows(spark, [{"race": "\t x  "}, {"race": "   "}, {"race": "　"}, {"race": " a b "},
                              {"race": "\x1fy\x1c"}])
    assert [r["race"] for r in out] == ["x", None, None, "a b", "y"]


def test_numbers_parse_and_count(spark):
    out = staged_rows(spark, [
        {"total_charges": "$1,027,545.65"}, {"total_charges": "120 +"}, {"total_charges": "-1"},
        {"total_charges": "0"}, {"total_charges": "1e3"}, {"total_charges": "inf"}, {"total_charges": ".5"},
    ])
    assert [r["total_charges"] for r in out] == [Decimal("1027545.65"), None, None, Decimal("0.00"),
                                                 Decimal("1000.00"), None, Decimal("0.50")]
    assert [r["_invalid"] for r in out] == [0, 1, 1, 0, 0, 1, 0]


def test_year_and_code_ranges(spark):
    years = staged_rows(spark, [{"discharge_year": y} for y in ("1999", "2000", "2024", "2025", "2021.0")], 2024)
    assert [r["discharge_year"] for r in years] == [None, 2000, 2024, None, 2021]
    assert [r["_invalid"] for r in years] == [1, 0, 0, 1, 0]
    sev = staged_rows(spark, [{"apr_severity_code": v} for v in ("0", "1", "4", "5", "3.5", None)])
    assert [r["apr_severity_code"] for r in sev] == [None, 1, 4, None, None, None]
    assert [r["_invalid"] for r in sev] == [1, 0, 0, 1, 1, 0]


def test_los_and_weight_rules(spark):
    out = staged_rows(spark, [
        {"length_of_stay": "-1"}, {"length_of_stay": "0"},
        {"birth_weight": "0", "type_of_admission": "Newborn"},
        {"birth_weight": "3,100", "type_of_admission": "newborn"},
        {"birth_weight": "3100", "type_of_admission": "Urgent"},
        {"birth_weight": "3100"},
    ])
    assert out[0]["length_of_stay"] is None and out[0]["_invalid"] == 1
    assert out[1]["length_of_stay"] == Decimal("0.00")
    assert [r["birth_weight"] for r in out[2:]] == [None, Decimal("3100.00"), None, None]
    assert out[2]["_invalid"] == 1


def test_canonical_values(spark):
    out = staged_rows(spark, [
        {"gender": "male", "type_of_admission": "EMERGENCY", "apr_medical_surgical_description": "surgical",
         "emergency_department_indicator": "yes"},
        {"gender": " Female", "type_of_admission": "Trauma", "apr_medical_surgical_description": "other",
         "emergency_department_indicator": "0"},
        {"gender": "U", "emergency_department_indicator": "maybe"},
        {"emergency_department_indicator": "TRUE"},
    ])
    assert [r["gender"] for r in out] == ["M", "F", "U", None]
    assert [r["type_of_admission"] for r in out] == ["Emergency", "Trauma", None, None]
    assert [r["apr_medical_surgical_description"] for r in out] == ["Surgical", "other", None, None]
    assert [r["emergency_department_indicator"] for r in out] == ["Y", "N", None, "Y"]


def test_age_zip_redaction(spark):
    out = staged_rows(spark, [
        {"age_group": "0 to 17", "zip_code_3": "oos"},
        {"age_group": "70 or Older", "zip_code_3": "123"},
        {"age_group": "Unlisted", "zip_code_3": "12a"},
        {"zip_code_3": "٣٤٥", "facility_name": "redacted for confidentiality"},
    ])
    assert [r["age_group_sort"] for r in out] == [1, 5, None, None]
    assert [r["zip_code_3"] for r in out] == ["OOS", "123", "12A", "٣٤٥"]
    assert [r["zip_region_type"] for r in out] == ["OUT_OF_STATE", "LOCAL", "UNKNOWN", "LOCAL"]
    assert [r["_redacted"] for r in out] == [False, False, False, True]


def test_mismatch_and_gap(spark):
    out = staged_rows(spark, [
        {"apr_drg_code": "001", "total_charges": "10.5", "total_costs": "3.25"},
        {"apr_drg_description": "x", "apr_mdc_code": "1", "apr_mdc_description": "y", "total_charges": "5"},
    ])
    assert [r["_mismatch"] for r in out] == [2, 2]  # diagnosis description missing + one drg side
    assert out[0]["charge_cost_gap"] == Decimal("7.25")
    assert out[1]["charge_cost_gap"] is None


def test_hash_separator_is_escaped(spark):
    out = staged_rows(spark, [{"race": "a|b", "ethnicity": "c"}, {"race": "a", "ethnicity": "b|c"},
                              {"race": "<NULL>"}, {}])
    hashes = [r["source_row_hash"] for r in out]
    assert len(set(hashes)) == 4
    assert all(len(h) == 64 for h in hashes)


def test_dedup_keeps_first_and_counts(spark):
    rows = [{"race": "x"}, {"race": " x "}, {"race": "y"}, {"race": "x"},
            {"facility_name": "REDACTED FOR CONFIDENTIALITY"}, {"facility_name": "Redacted for confidentiality"},
            {"length_of_stay": "-4"}, {"length_of_stay": None, "race": "z"}]
    raw = raw_frame(spark, rows)
    collapsed = collapse_duplicates(stage(raw, 2024))
    kept = {r["race"]: r["source_row_number"] for r in clean(raw, 2024).collect()}
    assert kept == {"x": 2, "y": 4}
    q = quality_summary(collapsed).first().asDict()
    assert q == {"input_rows": 8, "clean_rows": 2, "inserted_rows": 2, "exact_duplicate_rows": 2,
                 "discarded_core_missing_rows": 2, "discarded_redacted_facility_rows": 2,
                 "invalid_numeric_values": 1, "code_description_mismatches": 6}
    assert q["input_rows"] == (q["clean_rows"] + q["exact_duplicate_rows"] + q["discarded_core_missing_rows"]
                               + q["discarded_redacted_facility_rows"])


def test_dedup_hot_record_is_one_group(spark):
    # a third of the input is one record: still one output row, first occurrence kept
    rows = [{"race": "hot"}] * 300 + [{"race": f"r{i}"} for i in range(600)]
    out = clean(raw_frame(spark, rows), 2024).where(F.col("race") == "hot").collect()
    assert len(out) == 1 and out[0]["source_row_number"] == 2
