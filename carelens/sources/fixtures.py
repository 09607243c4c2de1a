"""Discharge inputs derived from the TPC-H-like star tables (see FIXTURES.md).

``discharges`` is a clean fact (inputs of the summaries and serving queries);
``raw_discharges`` holds uncleaned source strings (inputs of the cleaning rules).
Both are plain joins plus column expressions, planned by Catalyst: the star's
small dimensions (nation, region) are broadcast after a row-count check, the
others are left to the planner so AQE can broadcast them when their runtime
size is under the threshold and sort-merge them otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import BoundedSemaphore

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from carelens.functions.ordinal import number_rows, sort_rows, tasks_for
from carelens.functions.sizing import broadcast_bounded
from carelens.operators.clean import charge_cost_gap
from carelens.schema import HEADER_ALIASES, RAW_COLUMNS
from carelens.session import STORED, checkpoint_dir, shuffles_removed
from carelens.sources.files import file_system, remove

# nation x region is fixed by the star's definition (25 x 5); anything far
# beyond that is not a dimension to broadcast.
_GEO_MAX_ROWS = 10_000
# suppliers with their names and places, ~100 bytes each: broadcast, the line items need no shuffle for them
_SUPPLIER_MAX_ROWS = 500_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _star(spark: SparkSession, sf_dir: str, with_customer: bool, deal: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The line items with what belongs to them.  ``deal`` shuffles them; suppliers that are broadcast come after it."""
    t = lambda n: _table(spark, sf_dir, n)
    lineitem = t("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    if with_customer:
        customer = t("customer").select("c_custkey", "c_mktsegment")
        orders = orders.join(customer, orders.o_custkey == customer.c_custkey)
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name")
    supplier = t("supplier").select("s_suppkey", "s_name", "s_nationkey").join(
        broadcast_bounded(geo, _GEO_MAX_ROWS), F.col("s_nationkey") == F.col("n_nationkey"))
    part = t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    # lineitem x orders is fact x fact at any scale: pin it to a sort-merge join
    # so the planner never broadcasts the line items (it would at small scale,
    # leaving the whole join to the single task streaming ``orders``).
    # Suppliers come last: their names and places need not be shuffled for the parts.
    rows = (lineitem.join(orders.hint("merge"), lineitem.l_orderkey == orders.o_orderkey)
            .join(part, lineitem.l_partkey == part.p_partkey))
    if supplier.limit(_SUPPLIER_MAX_ROWS + 1).count() <= _SUPPLIER_MAX_ROWS:
        return deal(rows).join(F.broadcast(supplier), F.col("l_suppkey") == F.col("s_suppkey"))
    return deal(rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")))


def _age_group(orderkey: Column, priority: Column) -> Column:
    return (
        F.when(orderkey % 101 == 0, "Unlisted")
        .when(priority.startswith("1"), "0 to 17").when(priority.startswith("2"), "18 to 29")
        .when(priority.startswith("3"), "30 to 49").when(priority.startswith("4"), "50 to 69")
        .otherwise("70 or Older")
    )


def _money(c: Column) -> Column:
    return c.cast("decimal(16,2)")


def _costs() -> Column:
    return (_money(F.col("l_extendedprice")) * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(16,2)")


def discharges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean fact: one discharge per line item, with ``charge_cost_gap`` added by the engine."""
    c = F.col
    hidden = c("s_suppkey") % 29 == 7
    ln = c("l_linenumber")
    fact = _star(spark, sf_dir, with_customer=True).select(
        F.when(~hidden, c("r_name")).alias("hospital_service_area"),
        F.when(~hidden, c("n_name")).alias("hospital_county"),
        F.lpad(c("s_suppkey").cast("string"), 6, "0").alias("permanent_facility_id"),
        c("s_name").alias("facility_name"),
        _age_group(c("l_orderkey"), c("o_orderpriority")).alias("age_group"),
        F.when(c("l_orderkey") % 101 != 0, F.substring("o_orderpriority", 1, 1).cast("int")).alias("age_group_sort"),
        F.when(c("l_returnflag") == "A", "M").when(c("l_returnflag") == "R", "F").otherwise("U").alias("gender"),
        c("l_quantity").cast("decimal(10,2)").alias("length_of_stay"),
        F.when(c("o_orderstatus") == "O", "Emergency").when(c("o_orderstatus") == "F", "Elective")
        .when(ln == 1, "Newborn").when(ln != 6, "Urgent").alias("type_of_admission"),
        F.when(ln == 7, None).when(c("l_linestatus") == "O", "Y").otherwise("N").alias("emergency_department_indicator"),
        c("p_name").alias("patient_disposition"),
        (F.year("l_shipdate") + 10).alias("discharge_year"),
        c("p_brand").alias("ccsr_diagnosis_code"),
        F.concat(F.lit("Diagnosis "), c("p_brand")).alias("ccsr_diagnosis_description"),
        F.lpad((c("p_size") % 10).cast("string"), 3, "0").alias("apr_drg_code"),
        F.concat(F.lit("Group "), (c("p_size") % 10).cast("string")).alias("apr_drg_description"),
        F.when(c("l_partkey") % 97 != 0, c("p_type")).alias("apr_mdc_code"),
        F.when(c("l_partkey") % 97 != 0, F.concat(F.lit("System "), c("p_type"))).alias("apr_mdc_description"),
        F.when(ln <= 4, ln).alias("apr_severity_code"),
        F.when(ln == 1, "Minor").when(ln == 2, "Moderate").when(ln == 3, "Major").when(ln == 4, "Extreme")
        .alias("apr_severity_description"),
        F.when((c("l_orderkey") + ln) % 5 > 0, ((c("l_orderkey") + ln) % 5).cast("int")).alias("apr_risk_of_mortality"),
        F.when(c("l_partkey") % 7 == 0, None).when(c("l_partkey") % 3 == 0, "Surgical").otherwise("Medical")
        .alias("apr_medical_surgical_description"),
        F.when(c("c_mktsegment") == "AUTOMOBILE", "Medicare").when(c("c_mktsegment") == "BUILDING", "Medicaid")
        .when(c("c_mktsegment") == "FURNITURE", "Blue Cross/Blue Shield")
        .when(c("c_mktsegment") == "HOUSEHOLD", "Private Health Insurance")
        .when(c("c_custkey") % 2 == 0, "Self-Pay").alias("payment_typology_1"),
        F.when((c("l_orderkey") * 7 + ln) % 211 > 0, _money(c("l_extendedprice"))).alias("total_charges"),
        _costs().alias("total_costs"),
    )
    return fact.withColumn("charge_cost_gap", charge_cost_gap(F.col("total_charges"), F.col("total_costs")))


_RAW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "copy_no"]
# what the records are made of besides; nothing else is sorted and written
_SUPPLIER_VALUES = ["s_name", "n_name", "r_name"]
_RAW_VALUES = [*_SUPPLIER_VALUES, "o_orderstatus", "o_orderpriority", "p_brand"]


def raw_discharges(spark: SparkSession, sf_dir: str, file_name: str = "synthetic.csv") -> DataFrame:
    """Uncleaned source strings after header aliasing (every raw column; absent ones NULL).

    Records with ``l_orderkey % 97 = 0`` appear twice (``copy_no`` 1 and 2),
    produced by one generator instead of a second pass over the star.
    """
    c = F.col
    ln = c("l_linenumber")
    ok = c("l_orderkey")
    # counted in the footers
    tasks = tasks_for(_table(spark, sf_dir, "lineitem").count(), spark.sparkContext.defaultParallelism)
    keys = [x for x in _RAW_ORDER if x != "copy_no"]

    def deal(rows: DataFrame) -> DataFrame:
        # copies and the suppliers' names are made after the shuffle
        return rows.select(*[x for x in rows.columns if x in (*keys, "s_suppkey", *_RAW_VALUES)]).repartitionByRange(tasks, *keys)

    star = _star(spark, sf_dir, with_customer=False, deal=deal).withColumn(
        "copy_no", F.explode(F.when(ok % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    # what is made of the rows is wide, so a task reads no more of them than one has sorted
    numbered = number_rows(star.select(*_RAW_ORDER, *_RAW_VALUES), _RAW_ORDER, "_ordinal", dealt=True)
    money = _money(c("l_extendedprice"))
    values = {
        "source_file_name": F.lit(file_name),
        "source_row_number": (c("_ordinal") + 1).cast("long"),
        "hospital_service_area": F.when(ok % 11 == 0, F.concat(F.lit("  "), c("r_name"), F.lit(" "))).otherwise(c("r_name")),
        "hospital_county": c("n_name"),
        "facility_name": F.when(ok % 113 == 0, "Redacted for Confidentiality").when(ok % 211 == 0, "  ")
        .otherwise(c("s_name")),
        "age_group": _age_group(ok, c("o_orderpriority")),
        "zip_code_3": F.when(c("l_suppkey") % 5 == 0, "oos").when(c("l_suppkey") % 5 == 1, "12a")
        .when(c("l_suppkey") % 5 != 2, F.lpad((c("l_suppkey") % 1000).cast("string"), 3, "0")),
        "gender": F.when(c("l_returnflag") == "A", F.when(ln < 4, "male").otherwise("M"))
        .when(c("l_returnflag") == "R", F.when(ln < 4, " Female").otherwise("f")).otherwise("U"),
        "length_of_stay": F.when(ok % 89 == 0, "120 +").when(ok % 83 == 0, "-1")
        .otherwise(c("l_quantity").cast("int").cast("string")),
        "type_of_admission": F.when(c("o_orderstatus") == "O", "EMERGENCY").when(c("o_orderstatus") == "F", "elective")
        .when(ln == 1, "Newborn").when(ln != 6, "Trauma"),
        "discharge_year": F.when(ok % 71 == 0, "1999").otherwise((F.year("l_shipdate") + 10).cast("string")),
        "ccsr_diagnosis_code": F.when(ok % 127 != 0, c("p_brand")),
        "ccsr_diagnosis_description": F.when(ok % 131 != 0, F.concat(F.lit("Diagnosis "), c("p_brand"))),
        "apr_severity_code": ln.cast("string"),
        "apr_risk_of_mortality": F.when(ln == 1, "Minor").otherwise(ln.cast("string")),
        "apr_medical_surgical_description": F.when(c("l_partkey") % 7 == 0, "")
        .when(c("l_partkey") % 3 == 0, "surgical").otherwise("MEDICAL"),
        "emergency_department_indicator": F.when(ln == 7, "maybe").when(c("l_linestatus") == "O", "yes").otherwise("0"),
        "birth_weight": F.when(ln == 2, "0").otherwise("3,100"),
        "total_charges": F.when(ok % 67 == 0, "-5").otherwise(F.concat(F.lit("$"), money.cast("string"))),
        "total_costs": _costs().cast("string"),
    }
    cols = [values["source_file_name"].alias("source_file_name"), values["source_row_number"].alias("source_row_number")]
    cols += [values.get(name, F.lit(None).cast("string")).alias(name) for name in RAW_COLUMNS]
    return numbered.select(*cols)


FILES = 8
# files whose lines are shuffled at the same time; each has many tasks, and what waits for it is on disk
SORTED_AT_ONCE = 2
#: Separators and fields that quarantined lines have in excess, by the remainder of their number modulo 37.
EXCESS = {5: ["x"], 11: ["", ""], 17: [""], 23: ["x", "", "y"]}


def _quoted(value: Column, sep: str) -> Column:
    plain = F.coalesce(value, F.lit(""))
    return F.when(plain.rlike(f'[{sep}"\n]'), F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(plain)


def rendered_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The raw records as files with source headers: four as CSV, four as TSV with the columns reversed.

    Record n is in file n % 8.  Fields hold separators, quotes and, in files 1 and 6, line breaks; some lines
    have too many or too few fields, and some are blank.  Written under the shared checkpoint folder; returns
    the files.
    """
    header_of = {column: header for header, column in reversed(HEADER_ALIASES.items())}
    n = F.col("source_row_number")
    rows = raw_discharges(spark, sf_dir).withColumn("file_no", (n % FILES).cast("int"))
    rows = rows.withColumn("patient_disposition", F.when(F.col("file_no").isin(1, 6) & (n % 5 == 0), 'Home, self-care\nwith "aid"')
                           .when(n % 5 == 3, 'Left "early", by\tchoice'))
    lines, headers = [], []
    for kind, sep, columns in ((0, ",", RAW_COLUMNS), (1, "\t", RAW_COLUMNS[::-1])):
        fields = [_quoted(F.col(c), sep) for c in columns]
        full, short = (F.concat_ws(sep, *fields[:k]) for k in (len(columns), len(columns) - 3))
        line = F.when(n % 41 == 7, short).otherwise(full)
        for rest, excess in EXCESS.items():
            line = F.when(n % 37 == rest, F.concat(full, F.lit(sep + sep.join(excess)))).otherwise(line)
        line = F.when(n % 43 == 9, F.concat(line, F.lit("\n"))).otherwise(line)
        lines.append(F.when(F.col("file_no") % 2 == kind, line))
        headers += [(k, 0, sep.join(header_of[c] for c in columns)) for k in range(kind, FILES, 2)]
    rows = rows.select("file_no", n.alias("n"), F.coalesce(*lines).alias("line"))
    rows = rows.union(spark.createDataFrame(headers, "file_no int, n long, line string"))
    root = f"{checkpoint_dir(spark).rstrip('/')}/carelens-files-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        rows.write.options(**STORED).partitionBy("file_no").parquet(f"{root}/lines")

    def parts(folder: str) -> list:
        where, fs = file_system(spark, folder)
        found = [f.getPath() for f in fs.listStatus(where)]
        return sorted((p for p in found if p.getName().startswith("part-")), key=lambda p: p.getName())

    def write(k: int) -> str:
        # the lines are sorted over the cluster; the task that writes the file only copies the sorted parts, in their order
        lines = spark.read.schema("n long, line string").parquet(f"{root}/lines/file_no={k}")
        with sorting:
            sort_rows(lines, ["n"], tasks_for(lines.count())).select("line").write.options(**STORED).parquet(f"{root}/sorted-{k}")
        remove(spark, f"{root}/lines/file_no={k}")
        whole = reduce(DataFrame.union, [spark.read.schema("line string").parquet(part.toString()) for part in parts(f"{root}/sorted-{k}")])
        whole.coalesce(1).write.text(f"{root}/file-{k}")
        (part,) = parts(f"{root}/file-{k}")
        fs = file_system(spark, root)[1]
        file = f"{root}/discharges-{k}.{'tsv' if k % 2 else 'csv'}"
        fs.rename(part, file_system(spark, file)[0])
        remove(spark, f"{root}/sorted-{k}")
        return file

    sorting = BoundedSemaphore(SORTED_AT_ONCE)
    with shuffles_removed(spark), ThreadPoolExecutor(max_workers=FILES) as pool:
        files = list(pool.map(write, range(FILES)))
    remove(spark, f"{root}/lines")
    return files
