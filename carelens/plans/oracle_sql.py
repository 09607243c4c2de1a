"""DuckDB SQL that independently computes each catalogue query.

The driver runs every ``queries()`` entry and the SQL here side by side over
the same Parquet tables and compares row counts, schemas and value hashes.
The SQL is written from the rules (not generated from the Spark plans):
the star -> discharge views of FIXTURES.md, then the summaries, then each
serving query with integer half-up rounding.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# inputs (FIXTURES.md §2 and §3)
# ---------------------------------------------------------------------------

FACT_VIEW = """
SELECT
  CASE WHEN s_suppkey % 29 <> 7 THEN r_name END AS hospital_service_area,
  CASE WHEN s_suppkey % 29 <> 7 THEN n_name END AS hospital_county,
  lpad(cast(s_suppkey AS string), 6, '0') AS permanent_facility_id,
  s_name AS facility_name,
  CASE WHEN l_orderkey % 101 = 0 THEN 'Unlisted'
       WHEN o_orderpriority LIKE '1%' THEN '0 to 17' WHEN o_orderpriority LIKE '2%' THEN '18 to 29'
       WHEN o_orderpriority LIKE '3%' THEN '30 to 49' WHEN o_orderpriority LIKE '4%' THEN '50 to 69'
       ELSE '70 or Older' END AS age_group,
  CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE cast(substr(o_orderpriority, 1, 1) AS int) END AS age_group_sort,
  CASE l_returnflag WHEN 'A' THEN 'M' WHEN 'R' THEN 'F' ELSE 'U' END AS gender,
  cast(l_quantity AS decimal(10,2)) AS length_of_stay,
  CASE WHEN o_orderstatus = 'O' THEN 'Emergency' WHEN o_orderstatus = 'F' THEN 'Elective'
       WHEN l_linenumber = 1 THEN 'Newborn' WHEN l_linenumber = 6 THEN NULL ELSE 'Urgent' END AS type_of_admission,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'O' THEN 'Y' ELSE 'N' END AS emergency_department_indicator,
  p_name AS patient_disposition,
  year(l_shipdate) + 10 AS discharge_year,
  p_brand AS ccsr_diagnosis_code, concat('Diagnosis ', p_brand) AS ccsr_diagnosis_description,
  lpad(cast(p_size % 10 AS string), 3, '0') AS apr_drg_code, concat('Group ', cast(p_size % 10 AS string)) AS apr_drg_description,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE p_type END AS apr_mdc_code,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE concat('System ', p_type) END AS apr_mdc_description,
  CASE WHEN l_linenumber <= 4 THEN l_linenumber END AS apr_severity_code,
  CASE l_linenumber WHEN 1 THEN 'Minor' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Major' WHEN 4 THEN 'Extreme' END AS apr_severity_description,
  CASE WHEN (l_orderkey + l_linenumber) % 5 > 0 THEN cast((l_orderkey + l_linenumber) % 5 AS int) END AS apr_risk_of_mortality,
  CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN 'Surgical' ELSE 'Medical' END AS apr_medical_surgical_description,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Medicare' WHEN 'BUILDING' THEN 'Medicaid' WHEN 'FURNITURE' THEN 'Blue Cross/Blue Shield'
       WHEN 'HOUSEHOLD' THEN 'Private Health Insurance' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'Self-Pay' END END AS payment_typology_1,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 211 > 0 THEN cast(l_extendedprice AS decimal(16,2)) END AS total_charges,
  cast(cast(l_extendedprice AS decimal(16,2)) * (1 - cast(l_discount AS decimal(4,2))) AS decimal(16,2)) AS total_costs
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
"""

FACT_CTE = ("fact AS (SELECT *, CAST(total_charges - total_costs AS DECIMAL(16,2)) AS charge_cost_gap "
            f"FROM ({FACT_VIEW}) AS d)")

F3 = "hospital_service_area, hospital_county, facility_name"
BASE = ("count(*) AS discharge_count, sum(length_of_stay) AS length_of_stay_sum, "
        "sum(total_charges) AS total_charges_sum, sum(total_costs) AS total_costs_sum")


def _ed_sum(flag: str, col: str) -> str:
    return f"sum(CASE WHEN emergency_department_indicator = '{flag}' THEN {col} ELSE 0 END)"


SUMMARY_SQL: dict[str, str] = {
    "patient_age_gender_summary":
        f"SELECT {F3}, age_group, age_group_sort, gender, count(*) AS discharge_count FROM fact "
        f"GROUP BY {F3}, age_group, age_group_sort, gender",
    "patient_payment_summary":
        f"SELECT {F3}, payment_typology_1, count(*) AS discharge_count, sum(total_charges) AS total_charges_sum, "
        f"sum(total_costs) AS total_costs_sum FROM fact GROUP BY {F3}, payment_typology_1",
    "patient_disposition_summary":
        f"SELECT {F3}, patient_disposition, {BASE} FROM fact GROUP BY {F3}, patient_disposition",
    "patient_admission_emergency_summary":
        f"SELECT {F3}, type_of_admission, emergency_department_indicator, count(*) AS discharge_count, "
        f"sum(length_of_stay) AS length_of_stay_sum FROM fact "
        f"GROUP BY {F3}, type_of_admission, emergency_department_indicator",
    "patient_medical_surgical_summary":
        f"SELECT {F3}, apr_medical_surgical_description, {BASE} FROM fact "
        f"WHERE trim(apr_medical_surgical_description) IN ('Medical', 'Surgical') "
        f"GROUP BY {F3}, apr_medical_surgical_description",
    "hospital_operation_summary":
        f"SELECT {F3}, {BASE}, sum(charge_cost_gap) AS charge_cost_gap_sum, "
        f"{_ed_sum('Y', 'total_charges')} AS emergency_charges_sum, "
        f"{_ed_sum('N', 'total_charges')} AS non_emergency_charges_sum, "
        f"{_ed_sum('Y', 'total_costs')} AS emergency_costs_sum, "
        f"{_ed_sum('N', 'total_costs')} AS non_emergency_costs_sum, "
        f"sum(CASE WHEN emergency_department_indicator = 'Y' THEN 1 ELSE 0 END) AS emergency_yes_count, "
        f"sum(CASE WHEN emergency_department_indicator IN ('Y', 'N') THEN 1 ELSE 0 END) AS emergency_known_count "
        f"FROM fact GROUP BY {F3}",
    "disease_system_summary":
        f"SELECT {F3}, apr_mdc_code, max(apr_mdc_description) AS apr_mdc_description, {BASE} FROM fact "
        f"GROUP BY {F3}, apr_mdc_code",
    "diagnosis_summary":
        f"SELECT {F3}, ccsr_diagnosis_code, max(ccsr_diagnosis_description) AS ccsr_diagnosis_description, {BASE} "
        f"FROM fact GROUP BY {F3}, ccsr_diagnosis_code",
    "patient_risk_summary":
        f"SELECT {F3}, apr_severity_code, apr_risk_of_mortality, "
        f"max(apr_severity_description) AS apr_severity_description, {BASE} FROM fact "
        f"GROUP BY {F3}, apr_severity_code, apr_risk_of_mortality",
    "disease_drilldown_summary":
        f"SELECT {F3}, apr_mdc_code, apr_drg_code, ccsr_diagnosis_code, "
        f"max(apr_mdc_description) AS apr_mdc_description, max(apr_drg_description) AS apr_drg_description, "
        f"max(ccsr_diagnosis_description) AS ccsr_diagnosis_description, {BASE} FROM fact "
        f"GROUP BY {F3}, apr_mdc_code, apr_drg_code, ccsr_diagnosis_code",
}

# ---------------------------------------------------------------------------
# rounding helpers (exact, half up, non-negative inputs)
# ---------------------------------------------------------------------------


def avg_sql(total: str, n: str, digits: int = 2) -> str:
    scale = 10 ** digits
    return (f"(CASE WHEN ({total}) IS NOT NULL AND ({n}) <> 0 THEN "
            f"CAST((2 * CAST(({total}) * {scale} AS BIGINT) + CAST({n} AS BIGINT)) // (2 * CAST({n} AS BIGINT)) AS DOUBLE)"
            f" / {scale} END)")


def ratio_sql(num: str, den: str, digits: int = 4) -> str:
    scale = 10 ** digits
    return (f"(CASE WHEN CAST({den} AS BIGINT) <> 0 THEN "
            f"CAST((2 * CAST(coalesce({num}, 0) AS BIGINT) * {scale} + CAST({den} AS BIGINT)) "
            f"// (2 * CAST({den} AS BIGINT)) AS DOUBLE) / {scale} END)")


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST(coalesce({expr}, 0) AS BIGINT)"


def where(scope: dict[str, str] | None, *extra: str) -> str:
    parts = [f"{k} COLLATE NOCASE.NOACCENT = '{v}'" for k, v in (scope or {}).items()] + list(extra)
    return ("WHERE " + " AND ".join(parts)) if parts else ""


def with_summary(name: str, body: str, scope: dict[str, str] | None = None, *extra: str) -> str:
    """``WITH fact, summ(scoped summary) <body>``."""
    return (f"WITH {FACT_CTE}, summ_all AS ({SUMMARY_SQL[name]}), "
            f"summ AS (SELECT * FROM summ_all {where(scope, *extra)}) {body}")


# ---------------------------------------------------------------------------
# summaries as compared (decimal sums as DOUBLE, no updated_at)
# ---------------------------------------------------------------------------

_SUMMARY_SUM_COLUMNS = {
    "length_of_stay_sum", "total_charges_sum", "total_costs_sum", "charge_cost_gap_sum", "emergency_charges_sum",
    "non_emergency_charges_sum", "emergency_costs_sum", "non_emergency_costs_sum",
}


def summary_sql(name: str, columns: list[str]) -> str:
    sel = []
    for c in columns:
        if c in _SUMMARY_SUM_COLUMNS:
            sel.append(f"CAST({c} AS DOUBLE) AS {c}")
        elif c.endswith("_count"):
            sel.append(f"CAST({c} AS BIGINT) AS {c}")
        else:
            sel.append(c)
    return f"WITH {FACT_CTE}, s AS ({SUMMARY_SQL[name]}) SELECT {', '.join(sel)} FROM s"


# ---------------------------------------------------------------------------
# serving queries
# ---------------------------------------------------------------------------

def filter_values_sql(column: str, scope: dict[str, str] | None = None) -> str:
    return with_summary("hospital_operation_summary",
                        f"SELECT min({column}) AS {column} FROM summ GROUP BY strip_accents(lower({column}))", scope,
                        f"{column} IS NOT NULL", f"trim({column}) <> ''")


_TOTAL = "t AS (SELECT sum(discharge_count) AS total FROM summ)"


def age_gender_sql(scope=None) -> str:
    return _with_cte("patient_age_gender_summary", f"""{_TOTAL},
      g AS (SELECT age_group, age_group_sort, gender, sum(discharge_count) AS n FROM summ GROUP BY ALL)""",
                     f"""SELECT age_group, age_group_sort, gender, {big('n')} AS discharge_count,
             {ratio_sql('n', 'total')} AS discharge_ratio FROM g, t""", scope)


def _money_cols(n: str = "n", charges: str = "ch", costs: str = "co") -> str:
    return (f"{dbl(charges)} AS total_charges, {dbl(costs)} AS total_costs, "
            f"{avg_sql(charges, n)} AS average_charge, {avg_sql(costs, n)} AS average_cost")


def _with_cte(name: str, ctes: str, body: str, scope=None, *extra: str) -> str:
    return (f"WITH {FACT_CTE}, summ_all AS ({SUMMARY_SQL[name]}), "
            f"summ AS (SELECT * FROM summ_all {where(scope, *extra)}), {ctes} {body}")


def payment_sql(scope=None) -> str:
    return _with_cte("patient_payment_summary", f"""{_TOTAL},
      g AS (SELECT payment_typology_1, sum(discharge_count) AS n, sum(total_charges_sum) AS ch,
                   sum(total_costs_sum) AS co FROM summ GROUP BY ALL)""",
                     f"""SELECT payment_typology_1, {big('n')} AS discharge_count,
             {ratio_sql('n', 'total')} AS discharge_ratio, {_money_cols()} FROM g, t""", scope)


def disposition_sql(scope=None, limit: int = 10) -> str:
    return _with_cte("patient_disposition_summary", f"""{_TOTAL},
      g AS (SELECT patient_disposition, sum(discharge_count) AS n, sum(length_of_stay_sum) AS los,
                   sum(total_charges_sum) AS ch, sum(total_costs_sum) AS co FROM summ GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (ORDER BY n DESC, patient_disposition ASC NULLS FIRST) AS rn FROM g)""",
                     f"""SELECT patient_disposition, {big('n')} AS discharge_count,
             {ratio_sql('n', 'total')} AS discharge_ratio, {avg_sql('los', 'n')} AS average_length_of_stay,
             {_money_cols()}, CAST(rn AS INTEGER) AS position FROM r, t WHERE rn <= {limit}""", scope)


def admission_emergency_sql(scope=None) -> str:
    return _with_cte("patient_admission_emergency_summary", f"""{_TOTAL},
      g AS (SELECT type_of_admission, emergency_department_indicator, sum(discharge_count) AS n,
                   sum(length_of_stay_sum) AS los FROM summ GROUP BY ALL)""",
                     f"""SELECT type_of_admission, emergency_department_indicator, {big('n')} AS discharge_count,
             {ratio_sql('n', 'total')} AS discharge_ratio, {avg_sql('los', 'n')} AS average_length_of_stay
             FROM g, t""", scope)


def medical_surgical_sql(scope=None) -> str:
    return _with_cte("patient_medical_surgical_summary", f"""{_TOTAL},
      g AS (SELECT apr_medical_surgical_description, sum(discharge_count) AS n, sum(length_of_stay_sum) AS los,
                   sum(total_charges_sum) AS ch, sum(total_costs_sum) AS co FROM summ GROUP BY ALL)""",
                     f"""SELECT apr_medical_surgical_description, {big('n')} AS discharge_count,
             {ratio_sql('n', 'total')} AS discharge_ratio, {avg_sql('los', 'n')} AS average_length_of_stay,
             {_money_cols()} FROM g, t""", scope)


def kpi_sql(scope=None) -> str:
    return _with_cte("hospital_operation_summary", """
      k AS (SELECT count(DISTINCT facility_name) AS hc, coalesce(sum(discharge_count), 0) AS n,
                   sum(length_of_stay_sum) AS los, sum(total_charges_sum) AS ch, sum(total_costs_sum) AS co,
                   sum(emergency_yes_count) AS y, sum(emergency_known_count) AS kn,
                   sum(emergency_charges_sum) AS ech, sum(non_emergency_charges_sum) AS nch,
                   sum(emergency_costs_sum) AS eco, sum(non_emergency_costs_sum) AS nco FROM summ)""",
                     f"""SELECT {big('hc')} AS hospital_count, {big('n')} AS discharge_count,
             {avg_sql('los', 'n')} AS average_length_of_stay, {_money_cols()},
             {ratio_sql('y', 'kn')} AS emergency_ratio, {dbl('ech')} AS emergency_charges,
             {dbl('nch')} AS non_emergency_charges, {dbl('eco')} AS emergency_costs,
             {dbl('nco')} AS non_emergency_costs FROM k""", scope)


_HOSP_G = f"""g AS (SELECT {F3}, sum(discharge_count) AS n, sum(length_of_stay_sum) AS los,
                   sum(total_charges_sum) AS ch, sum(total_costs_sum) AS co,
                   sum(emergency_yes_count) AS y, sum(emergency_known_count) AS kn FROM summ GROUP BY ALL)"""
_HOSP_COLS = (f"facility_name, hospital_county, hospital_service_area, {big('n')} AS discharge_count, "
              f"{dbl('ch')} AS total_charges, {dbl('co')} AS total_costs, "
              f"{avg_sql('los', 'n')} AS average_length_of_stay, {avg_sql('co', 'n')} AS average_cost, "
              f"{ratio_sql('y', 'kn')} AS emergency_ratio")
_SORT_SQL = {
    "discharge_count": "n",
    "total_charges": "ch",
    "average_length_of_stay": "(CAST(los AS DOUBLE) / nullif(n, 0))",
    "average_cost": "(CAST(co AS DOUBLE) / nullif(n, 0))",
}


def _hosp_order(sort_by: str, order: str) -> str:
    nulls = "NULLS LAST" if order == "desc" else "NULLS FIRST"
    return (f"{_SORT_SQL[sort_by]} {order.upper()} {nulls}, facility_name ASC NULLS FIRST, "
            f"hospital_county ASC NULLS FIRST, hospital_service_area ASC NULLS FIRST")


def hospital_resources_sql(scope=None) -> str:
    return _with_cte("hospital_operation_summary", _HOSP_G, f"SELECT {_HOSP_COLS} FROM g", scope)


def hospital_ranking_sql(scope=None, sort_by="discharge_count", order="desc", limit=10) -> str:
    return _with_cte("hospital_operation_summary",
                     _HOSP_G + f", r AS (SELECT *, row_number() OVER (ORDER BY {_hosp_order(sort_by, order)}) AS rn FROM g)",
                     f"SELECT CAST(rn AS INTEGER) AS rank, {_HOSP_COLS} FROM r WHERE rn <= {limit}", scope)


def hospital_comparison_sql(scope=None, sort_by="discharge_count", order="desc", page=1, page_size=20,
                            keyword=None) -> str:
    extra = [f"strip_accents(facility_name) ILIKE strip_accents('%{keyword}%')"] if keyword else []
    skip = (page - 1) * page_size
    return _with_cte("hospital_operation_summary",
                     _HOSP_G + f", r AS (SELECT *, row_number() OVER (ORDER BY {_hosp_order(sort_by, order)}) AS rn FROM g),"
                     " t AS (SELECT count(*) AS total FROM g)",
                     f"SELECT CAST(rn AS INTEGER) AS position, {_HOSP_COLS}, {page} AS page, {page_size} AS page_size, "
                     f"CAST(total AS BIGINT) AS total FROM r, t WHERE rn > {skip} AND rn <= {skip + page_size}",
                     scope, *extra)


def _disease_sql(name: str, code: str, desc: str, scope=None, keep: str | None = None) -> tuple[str, str]:
    ctes = f"""{_TOTAL},
      g AS (SELECT {code}, max({desc}) AS {desc}, sum(discharge_count) AS n, sum(length_of_stay_sum) AS los,
                   sum(total_charges_sum) AS ch, sum(total_costs_sum) AS co FROM summ GROUP BY {code})"""
    cols = (f"{code}, {desc}, {big('n')} AS discharge_count, {avg_sql('los', 'n')} AS average_length_of_stay, "
            f"{dbl('ch')} AS total_charges, {dbl('co')} AS total_costs, {ratio_sql('n', 'total')} AS discharge_ratio")
    return ctes, cols


def disease_systems_sql(scope=None) -> str:
    ctes, cols = _disease_sql("disease_system_summary", "apr_mdc_code", "apr_mdc_description")
    return _with_cte("disease_system_summary", ctes, f"SELECT {cols} FROM g, t", scope)


def top_diagnoses_sql(scope=None, limit=10) -> str:
    ctes, cols = _disease_sql("diagnosis_summary", "ccsr_diagnosis_code", "ccsr_diagnosis_description")
    ctes += (", r AS (SELECT *, row_number() OVER (ORDER BY n DESC, coalesce(ccsr_diagnosis_code, '') ASC) AS rn "
             "FROM g)")
    return _with_cte("diagnosis_summary", ctes,
                     f"SELECT {cols}, CAST(rn AS INTEGER) AS position FROM r, t WHERE rn <= {limit}", scope)


def severity_sql(scope=None) -> str:
    ctes, cols = _disease_sql("patient_risk_summary", "apr_severity_code", "apr_severity_description")
    return _with_cte("patient_risk_summary", ctes, f"SELECT {cols} FROM g, t", scope,
                     "apr_severity_code IS NOT NULL")


_DRILL = {
    "mdc": ("apr_mdc_code", "apr_mdc_description"),
    "drg": ("apr_drg_code", "apr_drg_description"),
    "ccsr": ("ccsr_diagnosis_code", "ccsr_diagnosis_description"),
}


def drilldown_sql(level: str, scope=None, mdc: str | None = None, drg: str | None = None) -> str:
    code, desc = _DRILL[level]
    extra = ([f"apr_mdc_code = '{mdc}'"] if mdc else []) + ([f"apr_drg_code = '{drg}'"] if drg else [])
    ctes = f"""g AS (SELECT {code} AS code, max({desc}) AS description, sum(discharge_count) AS n,
                   sum(length_of_stay_sum) AS los, sum(total_charges_sum) AS ch, sum(total_costs_sum) AS co
                   FROM summ GROUP BY {code})"""
    return _with_cte("disease_drilldown_summary", ctes,
                     f"SELECT code, description, {big('n')} AS discharge_count, {dbl('ch')} AS total_charges, "
                     f"{dbl('co')} AS total_costs, {avg_sql('los', 'n')} AS average_length_of_stay FROM g",
                     scope, *extra)


def breadcrumb_sql(scope=None, mdc: str | None = None, drg: str | None = None) -> str:
    if not mdc:
        return ("SELECT CAST(NULL AS INTEGER) AS position, CAST(NULL AS VARCHAR) AS level, "
                "CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS description WHERE false")
    parts = [f"SELECT 1 AS position, 'mdc' AS level, '{mdc}' AS code, max(apr_mdc_description) AS description "
             f"FROM summ WHERE apr_mdc_code = '{mdc}'"]
    if drg:
        parts.append(f"SELECT 2 AS position, 'drg' AS level, '{drg}' AS code, max(apr_drg_description) AS description "
                     f"FROM summ WHERE apr_mdc_code = '{mdc}' AND apr_drg_code = '{drg}'")
    body = " UNION ALL ".join(parts)
    return (f"WITH {FACT_CTE}, summ_all AS ({SUMMARY_SQL['disease_drilldown_summary']}), "
            f"summ AS (SELECT * FROM summ_all {where(scope)}) "
            f"SELECT CAST(position AS INTEGER) AS position, level, code, description FROM ({body}) AS b")


# ---------------------------------------------------------------------------
# raw discharges and the cleaning rules
# ---------------------------------------------------------------------------

RAW_VIEW = """
WITH star AS (
  SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
copies AS (
  SELECT *, 1 AS copy_no FROM star UNION ALL SELECT *, 2 AS copy_no FROM star WHERE l_orderkey % 97 = 0)
SELECT
  'synthetic.csv' AS source_file_name,
  1 + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, copy_no) AS source_row_number,
  CASE WHEN l_orderkey % 11 = 0 THEN concat('  ', r_name, ' ') ELSE r_name END AS hospital_service_area,
  n_name AS hospital_county,
  CASE WHEN l_orderkey % 113 = 0 THEN 'Redacted for Confidentiality' WHEN l_orderkey % 211 = 0 THEN '  ' ELSE s_name END AS facility_name,
  CASE WHEN l_orderkey % 101 = 0 THEN 'Unlisted' WHEN o_orderpriority LIKE '1%' THEN '0 to 17' WHEN o_orderpriority LIKE '2%' THEN '18 to 29'
       WHEN o_orderpriority LIKE '3%' THEN '30 to 49' WHEN o_orderpriority LIKE '4%' THEN '50 to 69' ELSE '70 or Older' END AS age_group,
  CASE WHEN s_suppkey % 5 = 0 THEN 'oos' WHEN s_suppkey % 5 = 1 THEN '12a' WHEN s_suppkey % 5 = 2 THEN NULL
       ELSE lpad(cast(s_suppkey % 1000 AS string), 3, '0') END AS zip_code_3,
  CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linenumber < 4 THEN 'male' ELSE 'M' END
       WHEN 'R' THEN CASE WHEN l_linenumber < 4 THEN ' Female' ELSE 'f' END ELSE 'U' END AS gender,
  CASE WHEN l_orderkey % 89 = 0 THEN '120 +' WHEN l_orderkey % 83 = 0 THEN '-1' ELSE cast(cast(l_quantity AS int) AS string) END AS length_of_stay,
  CASE WHEN o_orderstatus = 'O' THEN 'EMERGENCY' WHEN o_orderstatus = 'F' THEN 'elective' WHEN l_linenumber = 1 THEN 'Newborn'
       WHEN l_linenumber = 6 THEN NULL ELSE 'Trauma' END AS type_of_admission,
  CASE WHEN l_orderkey % 71 = 0 THEN '1999' ELSE cast(year(l_shipdate) + 10 AS string) END AS discharge_year,
  CASE WHEN l_orderkey % 127 = 0 THEN NULL ELSE p_brand END AS ccsr_diagnosis_code,
  CASE WHEN l_orderkey % 131 = 0 THEN NULL ELSE concat('Diagnosis ', p_brand) END AS ccsr_diagnosis_description,
  cast(l_linenumber AS string) AS apr_severity_code,
  CASE WHEN l_linenumber = 1 THEN 'Minor' ELSE cast(l_linenumber AS string) END AS apr_risk_of_mortality,
  CASE WHEN l_partkey % 7 = 0 THEN '' WHEN l_partkey % 3 = 0 THEN 'surgical' ELSE 'MEDICAL' END AS apr_medical_surgical_description,
  CASE WHEN l_linenumber = 7 THEN 'maybe' WHEN l_linestatus = 'O' THEN 'yes' ELSE '0' END AS emergency_department_indicator,
  CASE WHEN l_linenumber = 2 THEN '0' ELSE '3,100' END AS birth_weight,
  CASE WHEN l_orderkey % 67 = 0 THEN '-5' ELSE concat('$', cast(cast(l_extendedprice AS decimal(16,2)) AS string)) END AS total_charges,
  cast(cast(cast(l_extendedprice AS decimal(16,2)) * (1 - cast(l_discount AS decimal(4,2))) AS decimal(16,2)) AS string) AS total_costs,
  CAST(NULL AS VARCHAR) AS patient_disposition
FROM copies
"""

# the same records as the files hold them: file, line, number of fields; short lines lose their last three fields
FILE_LINES = f"""
SELECT * REPLACE (
    'discharges-' || source_row_number % 8 || CASE source_row_number % 2 WHEN 0 THEN '.csv' ELSE '.tsv' END AS source_file_name,
    CASE WHEN short AND source_row_number % 2 = 0 THEN NULL ELSE total_costs END AS total_costs,
    CASE WHEN short AND source_row_number % 2 = 0 THEN NULL ELSE total_charges END AS total_charges,
    CASE WHEN short AND source_row_number % 2 = 0 THEN NULL ELSE emergency_department_indicator END AS emergency_department_indicator,
    CASE WHEN short AND source_row_number % 2 = 1 THEN NULL ELSE hospital_service_area END AS hospital_service_area,
    CASE WHEN short AND source_row_number % 2 = 1 THEN NULL ELSE hospital_county END AS hospital_county,
    CASE WHEN source_row_number % 8 IN (1, 6) AND source_row_number % 5 = 0 THEN 'Home, self-care' || chr(10) || 'with "aid"'
         WHEN source_row_number % 5 = 3 THEN 'Left "early", by' || chr(9) || 'choice' END AS patient_disposition),
  1 + row_number() OVER (PARTITION BY source_row_number % 8 ORDER BY source_row_number) AS line, 33 + excess AS fields
FROM (SELECT *, CASE source_row_number % 37 WHEN 5 THEN 1 WHEN 11 THEN 2 WHEN 17 THEN 1 WHEN 23 THEN 3 ELSE 0 END AS excess,
             source_row_number % 41 = 7 AND excess = 0 AS short FROM ({RAW_VIEW}))"""

FILES_VIEW = f"""SELECT * REPLACE (1 + row_number() OVER (PARTITION BY source_file_name ORDER BY line) AS source_row_number)
FROM ({FILE_LINES}) WHERE excess = 0"""

RAW_COLS = [
    "hospital_service_area", "hospital_county", "operating_certificate_number", "permanent_facility_id",
    "facility_name", "age_group", "zip_code_3", "gender", "race", "ethnicity", "length_of_stay",
    "type_of_admission", "patient_disposition", "discharge_year", "ccsr_diagnosis_code",
    "ccsr_diagnosis_description", "ccsr_procedure_code", "ccsr_procedure_description", "apr_drg_code",
    "apr_drg_description", "apr_mdc_code", "apr_mdc_description", "apr_severity_code",
    "apr_severity_description", "apr_risk_of_mortality", "apr_medical_surgical_description",
    "payment_typology_1", "payment_typology_2", "payment_typology_3", "birth_weight",
    "emergency_department_indicator", "total_charges", "total_costs",
]
_PRESENT = {
    "hospital_service_area", "hospital_county", "facility_name", "age_group", "zip_code_3", "gender",
    "length_of_stay", "type_of_admission", "discharge_year", "ccsr_diagnosis_code", "ccsr_diagnosis_description",
    "apr_severity_code", "apr_risk_of_mortality", "apr_medical_surgical_description",
    "emergency_department_indicator", "birth_weight", "total_charges", "total_costs", "patient_disposition",
}
_NUMERIC = {
    "length_of_stay": ("DECIMAL(10,2)", "{v} < 0"),
    "discharge_year": ("INTEGER", "({v} < 2000 OR {v} > {year})"),
    "apr_severity_code": ("INTEGER", "{v} NOT IN (1, 2, 3, 4)"),
    "apr_risk_of_mortality": ("INTEGER", "{v} NOT IN (1, 2, 3, 4)"),
    "birth_weight": ("DECIMAL(10,2)", "{v} <= 0"),
    "total_charges": ("DECIMAL(16,2)", "{v} < 0"),
    "total_costs": ("DECIMAL(16,2)", "{v} < 0"),
}
_NUM_RE = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def _canon(col: str, pairs: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs)
    return f"coalesce(CASE upper(t_{col}) {whens} END, t_{col})"


def staged_sql(year: int) -> str:
    """CTE chain ``raw -> tx (text) -> px (parsed) -> cl (cleaned) -> staged``."""
    tx = ", ".join(
        [f"nullif(trim({c}), '') AS t_{c}" if c in _PRESENT else f"CAST(NULL AS VARCHAR) AS t_{c}"
         for c in RAW_COLS])
    px = []
    for c in _NUMERIC:
        t = f"trim(replace(replace(t_{c}, ',', ''), '$', ''))"
        px.append(f"CASE WHEN regexp_full_match({t}, '{_NUM_RE}') THEN TRY_CAST({t} AS DECIMAL(38,6)) END AS p_{c}")
    cl, invalid = [], []
    for c in RAW_COLS:
        if c in _NUMERIC:
            typ, rule = _NUMERIC[c]
            viol = f"coalesce({rule.format(v=f'p_{c}', year=year)}, false)"
            val = f"round(p_{c}, 0)" if typ == "INTEGER" else f"p_{c}"
            stored = f"CASE WHEN NOT {viol} THEN TRY_CAST({val} AS {typ}) END"
            cl.append(f"{stored} AS {c}")
            invalid.append(f"CAST({viol} AS INTEGER)")
            invalid.append(f"CAST(t_{c} IS NOT NULL AND NOT {viol} AND ({stored}) IS NULL AS INTEGER)")
        elif c == "gender":
            cl.append(f"{_canon(c, [('M', 'M'), ('MALE', 'M'), ('F', 'F'), ('FEMALE', 'F')])} AS {c}")
        elif c == "type_of_admission":
            cl.append(f"{_canon(c, [('EMERGENCY', 'Emergency'), ('URGENT', 'Urgent'), ('ELECTIVE', 'Elective'), ('NEWBORN', 'Newborn')])} AS {c}")
        elif c == "apr_medical_surgical_description":
            cl.append(f"{_canon(c, [('MEDICAL', 'Medical'), ('SURGICAL', 'Surgical')])} AS {c}")
        elif c == "emergency_department_indicator":
            ed = _canon(c, [("Y", "Y"), ("YES", "Y"), ("TRUE", "Y"), ("1", "Y"), ("N", "N"), ("NO", "N"),
                            ("FALSE", "N"), ("0", "N")])
            cl.append(f"CASE WHEN {ed} IN ('Y', 'N') THEN {ed} END AS {c}")
        elif c == "zip_code_3":
            cl.append(f"upper(t_{c}) AS {c}")
        else:
            cl.append(f"t_{c} AS {c}")
    derived = (
        "CASE t_age_group WHEN '0 to 17' THEN 1 WHEN '18 to 29' THEN 2 WHEN '30 to 49' THEN 3 "
        "WHEN '50 to 69' THEN 4 WHEN '70 or Older' THEN 5 END AS age_group_sort, "
        "CASE WHEN upper(t_zip_code_3) = 'OOS' THEN 'OUT_OF_STATE' "
        "WHEN regexp_full_match(upper(t_zip_code_3), '[0-9]{3}') THEN 'LOCAL' "
        "WHEN t_zip_code_3 IS NOT NULL THEN 'UNKNOWN' END AS zip_region_type, "
        "coalesce(upper(t_facility_name) = 'REDACTED FOR CONFIDENTIALITY', false) AS _redacted, "
        "CAST(NULL AS VARCHAR) AS disposition_group"
    )
    esc = lambda c: (f"coalesce(replace(replace(replace(CAST({c} AS VARCHAR), '\\', '\\\\'), '|', '\\|'), '<', '\\<'), "  # noqa: E731
                     "'<NULL>')")
    pairs = [("ccsr_diagnosis_code", "ccsr_diagnosis_description"), ("ccsr_procedure_code", "ccsr_procedure_description"),
             ("apr_drg_code", "apr_drg_description"), ("apr_mdc_code", "apr_mdc_description")]
    mismatch = " + ".join(f"CAST(({a} IS NULL) <> ({b} IS NULL) AS INTEGER)" for a, b in pairs)
    hashed = f"sha256(concat_ws('|', {', '.join(esc(c) for c in RAW_COLS)}))"
    cl_cols = ", ".join(c for c in RAW_COLS if c != "birth_weight")
    return f"""
raw AS ({RAW_VIEW}),
tx AS (SELECT source_file_name, source_row_number, {tx} FROM raw),
px AS (SELECT *, {', '.join(px)} FROM tx),
cl0 AS (SELECT source_file_name, source_row_number, {', '.join(cl)}, {derived},
               {' + '.join(invalid)} AS _invalid FROM px),
cl AS (SELECT source_file_name, source_row_number, {cl_cols},
              CASE WHEN type_of_admission = 'Newborn' THEN birth_weight END AS birth_weight,
              age_group_sort, zip_region_type, CAST(_redacted AS INTEGER) AS is_facility_redacted, disposition_group,
              _invalid, _redacted FROM cl0),
staged AS (SELECT *, {mismatch} AS _mismatch, {hashed} AS source_row_hash,
                  CAST(total_charges - total_costs AS DECIMAL(16,2)) AS charge_cost_gap FROM cl)"""


def _first_rows() -> str:
    return """
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_row_hash ORDER BY source_file_name, source_row_number) AS _rn,
                  count(*) OVER (PARTITION BY source_row_hash) AS _copies,
                  sum(_invalid) OVER (PARTITION BY source_row_hash) AS _inv_sum,
                  sum(_mismatch) OVER (PARTITION BY source_row_hash) AS _mis_sum FROM staged),
firsts AS (SELECT *, (facility_name IS NULL OR discharge_year IS NULL OR ccsr_diagnosis_code IS NULL
                      OR length_of_stay IS NULL) AS _core_missing FROM ranked WHERE _rn = 1)"""


FACT_OUT = [
    "source_row_hash", "source_file_name", "source_row_number", "hospital_service_area", "hospital_county",
    "operating_certificate_number", "permanent_facility_id", "facility_name", "is_facility_redacted", "age_group",
    "age_group_sort", "zip_code_3", "zip_region_type", "gender", "race", "ethnicity", "length_of_stay",
    "type_of_admission", "emergency_department_indicator", "patient_disposition", "disposition_group",
    "discharge_year", "ccsr_diagnosis_code", "ccsr_diagnosis_description", "ccsr_procedure_code",
    "ccsr_procedure_description", "apr_drg_code", "apr_drg_description", "apr_mdc_code", "apr_mdc_description",
    "apr_severity_code", "apr_severity_description", "apr_risk_of_mortality", "apr_medical_surgical_description",
    "payment_typology_1", "payment_typology_2", "payment_typology_3", "birth_weight", "total_charges",
    "total_costs", "charge_cost_gap",
]


def _fact_cols() -> str:
    dec = {"length_of_stay", "birth_weight", "total_charges", "total_costs", "charge_cost_gap"}
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in dec else
                     ("CAST(source_row_number AS BIGINT) AS source_row_number" if c == "source_row_number" else c)
                     for c in FACT_OUT)


def clean_select_sql(year: int, columns: list[str]) -> str:
    """Per raw row: ``source_row_number`` plus chosen staged columns."""
    dec = {"length_of_stay", "birth_weight", "total_charges", "total_costs", "charge_cost_gap"}
    cols = ["CAST(source_row_number AS BIGINT) AS source_row_number"] + [
        f"CAST({c} AS DOUBLE) AS {c}" if c in dec else
        ("CAST(_invalid AS BIGINT) AS invalid_numeric_values" if c == "_invalid" else
         ("CAST(_mismatch AS BIGINT) AS code_description_mismatches" if c == "_mismatch" else
          ("_redacted AS is_redacted" if c == "_redacted" else c)))
        for c in columns]
    return f"WITH {staged_sql(year)} SELECT {', '.join(cols)} FROM staged"


def src_records_sql() -> str:
    cols = ", ".join(f"nullif({c}, '') AS {c}" for c in RAW_COLS if c in _PRESENT)
    return f"SELECT {cols} FROM ({FILES_VIEW})"


def src_ordinals_sql() -> str:
    return f"SELECT source_file_name, CAST(source_row_number AS BIGINT) AS source_row_number, total_charges, patient_disposition FROM ({FILES_VIEW})"


def src_quarantine_sql() -> str:
    return f"SELECT source_file_name, CAST(line AS BIGINT) AS line, CAST(fields AS INTEGER) AS fields FROM ({FILE_LINES}) WHERE excess > 0"


def src_quality_sql(year: int) -> str:
    return (f"SELECT *, (SELECT count(*) FROM ({FILE_LINES}) WHERE excess > 0) AS long_rows "
            f"FROM ({quality_sql(year).replace(RAW_VIEW, FILES_VIEW)})")


def dedup_sql(year: int) -> str:
    return (f"WITH {staged_sql(year)}, {_first_rows()} SELECT source_row_hash, source_file_name, "
            "CAST(source_row_number AS BIGINT) AS source_row_number, CAST(_copies AS BIGINT) AS copies, "
            "_redacted AS is_redacted, _core_missing AS core_missing FROM firsts")


def clean_fact_sql(year: int) -> str:
    return (f"WITH {staged_sql(year)}, {_first_rows()} SELECT {_fact_cols()} FROM firsts "
            "WHERE NOT _redacted AND NOT _core_missing")


def quality_sql(year: int, inserted: str = "true") -> str:
    """Counters; of the clean records, those that satisfy ``inserted`` are new."""
    inserted = f"sum(CASE WHEN NOT _redacted AND NOT _core_missing AND {inserted} THEN 1 ELSE 0 END)"
    return f"""WITH {staged_sql(year)}, {_first_rows()}
SELECT CAST(sum(_copies) AS BIGINT) AS input_rows,
       CAST(sum(CASE WHEN NOT _redacted AND NOT _core_missing THEN 1 ELSE 0 END) AS BIGINT) AS clean_rows,
       CAST({inserted} AS BIGINT) AS inserted_rows,
       CAST(sum(CASE WHEN NOT _redacted THEN _copies - 1 ELSE 0 END) AS BIGINT) AS exact_duplicate_rows,
       CAST(sum(CASE WHEN NOT _redacted AND _core_missing THEN 1 ELSE 0 END) AS BIGINT) AS discarded_core_missing_rows,
       CAST(sum(CASE WHEN _redacted THEN _copies ELSE 0 END) AS BIGINT) AS discarded_redacted_facility_rows,
       CAST(sum(_inv_sum) AS BIGINT) AS invalid_numeric_values,
       CAST(sum(CASE WHEN NOT _redacted THEN _mis_sum ELSE 0 END) AS BIGINT) AS code_description_mismatches
FROM firsts"""


# ---------------------------------------------------------------------------
# charts
# ---------------------------------------------------------------------------

_BUCKETS = ["Medicare", "Medicaid", "Blue Cross/Blue Shield", "Private Health Insurance"]


def payment_buckets_sql(scope=None) -> str:
    names = ", ".join(f"'{b.lower()}'" for b in _BUCKETS)
    sums = [f"coalesce(sum(CASE WHEN k = '{b.lower()}' THEN discharge_count END), 0) AS b{i}"
            for i, b in enumerate(_BUCKETS)]
    sums.append(f"coalesce(sum(CASE WHEN k IS NULL OR k NOT IN ({names}) THEN discharge_count END), 0) AS b4")
    rows = " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS INTEGER) AS position, '{b}' AS payment_bucket, CAST(b{i} AS BIGINT) AS discharge_count "
        f"FROM b" for i, b in enumerate(_BUCKETS + ["Other"]))
    return _with_cte("patient_payment_summary",
                     f"k AS (SELECT lower(trim(payment_typology_1)) AS k, discharge_count FROM summ), "
                     f"b AS (SELECT {', '.join(sums)} FROM k)", rows, scope)


def age_gender_pivot_sql(scope=None) -> str:
    return _with_cte("patient_age_gender_summary", "x AS (SELECT 1)",
                     "SELECT age_group, max(age_group_sort) AS age_group_sort, "
                     "CAST(coalesce(sum(CASE WHEN gender = 'M' THEN discharge_count END), 0) AS BIGINT) AS male_count, "
                     "CAST(coalesce(sum(CASE WHEN gender = 'F' THEN discharge_count END), 0) AS BIGINT) AS female_count "
                     "FROM summ GROUP BY age_group", scope)


def admission_split_sql(scope=None) -> str:
    return _with_cte("patient_admission_emergency_summary", "x AS (SELECT 1)",
                     "SELECT type_of_admission, "
                     "CAST(coalesce(sum(CASE WHEN emergency_department_indicator = 'Y' THEN discharge_count END), 0) AS BIGINT) AS emergency_count, "
                     "CAST(coalesce(sum(CASE WHEN emergency_department_indicator IS DISTINCT FROM 'Y' THEN discharge_count END), 0) AS BIGINT) AS non_emergency_count "
                     "FROM summ GROUP BY type_of_admission", scope)


def systems_top10_sql(scope=None) -> str:
    return (f"SELECT CAST(row_number() OVER (ORDER BY discharge_count DESC, coalesce(apr_mdc_code, '') ASC) AS INTEGER) "
            f"AS position, apr_mdc_code, apr_mdc_description, discharge_count, coalesce(apr_mdc_code, '') AS code_label, "
            f"coalesce(apr_mdc_description, '暂无描述') AS description_label FROM ({disease_systems_sql(scope)}) AS s "
            f"QUALIFY position <= 10")


def hospital_bubbles_sql(scope=None) -> str:
    return (f"SELECT facility_name, hospital_county, hospital_service_area, discharge_count, "
            f"coalesce(average_cost, 0.0) AS bubble_average_cost, "
            f"coalesce(average_length_of_stay, 0.0) AS bubble_average_length_of_stay, emergency_ratio "
            f"FROM ({hospital_resources_sql(scope)}) AS h")


def drilldown_bubbles_sql(level: str, scope=None, mdc=None, drg=None) -> str:
    return (f"WITH d AS ({drilldown_sql(level, scope, mdc, drg)}), m AS (SELECT greatest(coalesce(max(discharge_count), 0), 1) AS largest FROM d) "
            f"SELECT code, description, discharge_count, "
            f"CAST(floor(CAST(16 AS DOUBLE) + sqrt(discharge_count / largest) * 66 + 0.5) AS INTEGER) AS symbol_size, "
            f"CASE WHEN coalesce(length(description), 0) > 0 THEN description ELSE '暂无描述' END AS description_label "
            f"FROM d, m")


# ---------------------------------------------------------------------------
# report fact packs
# ---------------------------------------------------------------------------

_NA = "'暂无'"


def _count_t(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN {_NA} ELSE format('{{:,}}', CAST({x} AS BIGINT)) END)"


def _dec_t(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN {_NA} ELSE format('{{:,.2f}}', CAST({x} AS DOUBLE)) END)"


def _money_t(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN {_NA} ELSE '$' || format('{{:,.2f}}', CAST({x} AS DOUBLE)) END)"


def _pct_t(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return (f"(CASE WHEN {x} IS NULL THEN {_NA} ELSE "
            f"format('{{:.2f}}', CASE WHEN {v} <= 1 THEN {v} * 100 ELSE {v} END) || '%' END)")


def _label_t(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


def _metric_rows(rt: str, section: str, source: str, metrics: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{rt}' AS report_type, '{section}' AS section, CAST(0 AS INTEGER) AS position, "
        f"'{m}' AS metric, {expr} AS value_text FROM {source}" for m, expr in metrics)


def _table_rows(rt: str, section: str, source: str, pos: str, cells: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{rt}' AS report_type, '{section}' AS section, CAST({pos} AS INTEGER) AS position, "
        f"'{m}' AS metric, {expr} AS value_text FROM {source}" for m, expr in cells)


def _first_t(src: str, order: str, col: str, fmt) -> str:
    """Formatted ``col`` of the first row of ``src`` in ``order``; placeholder when empty."""
    return (f"(CASE WHEN (SELECT count(*) FROM {src}) > 0 THEN "
            f"{fmt(f'(SELECT {col} FROM {src} ORDER BY {order} LIMIT 1)')} ELSE {_NA} END)")


def _source_rows(rt: str, section: str, answers: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{rt}' AS report_type, '{section}.sources' AS section, CAST({i} AS INTEGER) AS position, "
        f"'source' AS metric, '{a}' AS value_text" for i, a in enumerate(answers, 1))


def report_sql(rt: str, scope=None) -> str:
    ctes = {
        "k": kpi_sql(scope), "rk": hospital_ranking_sql(scope, "discharge_count", "desc", 10),
        "ag": age_gender_sql(scope), "pm": payment_sql(scope), "ms": medical_surgical_sql(scope),
        "dp": disposition_sql(scope, 10), "ae": admission_emergency_sql(scope),
        "sy": disease_systems_sql(scope), "dg": top_diagnoses_sql(scope, 10), "sv": severity_sql(scope),
    }
    one = "(SELECT 1 AS one) AS o"
    parts = [_metric_rows(rt, "kpi", "k", [
        ("hospital_count", _count_t("hospital_count")), ("discharge_count", _count_t("discharge_count")),
        ("average_length_of_stay", _dec_t("average_length_of_stay")),
        ("total_charges", _money_t("total_charges")), ("total_costs", _money_t("total_costs")),
        ("emergency_ratio", _pct_t("emergency_ratio"))]), _source_rows(rt, "kpi", ["kpi"])]
    if rt in ("comprehensive", "operations"):
        parts.append(_source_rows(rt, "operations", ["hospital_ranking"]))
        parts.append(_metric_rows(rt, "operations", one, [
            ("ranked_hospitals", _count_t("(SELECT count(*) FROM rk)")),
            ("top_facility_name", _first_t("rk", "rank", "facility_name", _label_t)),
            ("top_discharge_count", _first_t("rk", "rank", "discharge_count", _count_t)),
            ("top_average_cost", _first_t("rk", "rank", "average_cost", _money_t))]))
        parts.append(_table_rows(rt, "operations.hospitals", "rk", "rank", [
            ("facility_name", _label_t("facility_name")), ("hospital_county", _label_t("hospital_county")),
            ("discharge_count", _count_t("discharge_count")), ("average_cost", _money_t("average_cost"))]))
    if rt in ("comprehensive", "patient"):
        age_o = "discharge_count DESC, age_group_sort ASC NULLS LAST, gender ASC NULLS FIRST"
        pay_o = "discharge_count DESC, payment_typology_1 ASC NULLS FIRST"
        med_o = "discharge_count DESC, apr_medical_surgical_description ASC NULLS FIRST"
        parts.append(_source_rows(rt, "patient", ["age_gender", "payment", "disposition", "admission_emergency", "medical_surgical"]))
        parts.append(_metric_rows(rt, "patient", one, [
            ("dispositions", _count_t("(SELECT count(*) FROM dp)")),
            ("top_disposition", _first_t("dp", "position", "patient_disposition", _label_t)),
            ("admission_emergency_groups", _count_t("(SELECT count(*) FROM ae)")),
            ("age_gender_groups", _count_t("(SELECT count(*) FROM ag)")),
            ("payment_types", _count_t("(SELECT count(*) FROM pm)")),
            ("top_payment", _first_t("pm", pay_o, "payment_typology_1", _label_t)),
            ("top_payment_count", _first_t("pm", pay_o, "discharge_count", _count_t)),
            ("top_age_group", _first_t("ag", age_o, "age_group", _label_t)),
            ("top_gender", _first_t("ag", age_o, "gender", _label_t))]))
        money = [("discharge_count", _count_t("discharge_count")), ("total_charges", _money_t("total_charges")),
                 ("total_costs", _money_t("total_costs"))]
        parts.append(_table_rows(rt, "patient.dispositions", "dp", "position",
                                 [("patient_disposition", _label_t("patient_disposition"))] + money))
        ae_o = "type_of_admission ASC NULLS FIRST, emergency_department_indicator ASC NULLS FIRST"
        parts.append(_table_rows(rt, "patient.admission_emergency", f"(SELECT *, row_number() OVER (ORDER BY {ae_o}) AS rn FROM ae) AS a",
                                 "rn", [("type_of_admission", _label_t("type_of_admission")),
                                        ("emergency_department_indicator", _label_t("emergency_department_indicator")), money[0]]))
        parts.append(_table_rows(rt, "patient.payments", f"(SELECT *, row_number() OVER (ORDER BY {pay_o}) AS rn FROM pm) AS p",
                                 "rn", [("payment_typology_1", _label_t("payment_typology_1"))] + money))
        parts.append(_table_rows(rt, "patient.medical_surgical",
                                 f"(SELECT *, row_number() OVER (ORDER BY {med_o}) AS rn FROM ms) AS m", "rn",
                                 [("apr_medical_surgical_description", _label_t("apr_medical_surgical_description"))]
                                 + money))
    if rt in ("comprehensive", "disease"):
        sys_o = "discharge_count DESC, coalesce(apr_mdc_code, '') ASC"
        parts.append(_source_rows(rt, "disease", ["disease_systems", "top_diagnoses", "severity"]))
        parts.append(_metric_rows(rt, "disease", one, [
            ("disease_systems", _count_t("(SELECT count(*) FROM sy)")),
            ("top_diagnoses", _count_t("(SELECT count(*) FROM dg)")),
            ("severity_levels", _count_t("(SELECT count(*) FROM sv)")),
            ("top_system_code", _first_t("sy", sys_o, "apr_mdc_code", _label_t)),
            ("top_system_count", _first_t("sy", sys_o, "discharge_count", _count_t)),
            ("top_diagnosis_code", _first_t("dg", "position", "ccsr_diagnosis_code", _label_t))]))
        parts.append(_table_rows(rt, "disease.diagnoses", "dg", "position", [
            ("ccsr_diagnosis_code", _label_t("ccsr_diagnosis_code")),
            ("ccsr_diagnosis_description", _label_t("ccsr_diagnosis_description")),
            ("discharge_count", _count_t("discharge_count"))]))
    with_ = ", ".join(f"{n} AS ({sql})" for n, sql in ctes.items())
    return f"WITH {with_} " + " UNION ALL ".join(f"({p})" for p in parts)


# ---------------------------------------------------------------------------
# dashboard display variants
# ---------------------------------------------------------------------------

def _fixed2_sql(x: str) -> str:
    return f"format('{{:.2f}}', CAST({x} AS DOUBLE))"


def _disp_money(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return (f"(CASE WHEN {x} IS NULL THEN '--' WHEN abs({v}) >= 100000000 THEN {_fixed2_sql(f'{v} / 100000000')} || ' 亿' "
            f"WHEN abs({v}) >= 10000 THEN {_fixed2_sql(f'{v} / 10000')} || ' 万' "
            f"ELSE format('{{:,}}', CAST(round({v}) AS BIGINT)) END)")


def kpi_cards_sql(scope=None) -> str:
    return (f"SELECT format('{{:,}}', coalesce(hospital_count, 0)) AS hospital_count_text, "
            f"format('{{:,}}', coalesce(discharge_count, 0)) AS discharge_count_text, "
            f"CASE WHEN average_length_of_stay IS NULL THEN '--' ELSE {_fixed2_sql('average_length_of_stay')} || ' 天' END "
            f"AS average_length_of_stay_text, {_disp_money('total_charges')} AS total_charges_text, "
            f"{_disp_money('total_costs')} AS total_costs_text, {_disp_money('average_cost')} AS average_cost_text, "
            f"CASE WHEN emergency_ratio IS NULL THEN '--' ELSE {_fixed2_sql('emergency_ratio * 100')} || '%' END "
            f"AS emergency_ratio_text FROM ({kpi_sql(scope)}) AS k")
