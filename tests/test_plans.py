"""Plan shapes the scale design relies on."""

from carelens.operators.clean import collapse_duplicates, stage
from carelens.operators.summaries import SUMMARIES, grouping_sets_aggregate
from carelens.sources.fixtures import discharges

from conftest import SF_SMALL
from test_rules import raw_frame


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _partial_before_exchange(plan: str) -> bool:
    lines = plan.splitlines()
    exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    return any("partial_" in line for line in lines[exchange + 1:])


def test_summaries_combine_on_the_map_side(spark):
    fact = discharges(spark, SF_SMALL)
    for name, build in SUMMARIES.items():
        plan = plan_of(build(fact))
        assert _partial_before_exchange(plan), name
        assert "Window" not in plan, name
    assert _partial_before_exchange(plan_of(grouping_sets_aggregate(fact)))


def test_dedup_combines_on_the_map_side(spark):
    plan = plan_of(collapse_duplicates(stage(raw_frame(spark, [{"race": "x"}, {"race": "x"}]), 2024)))
    assert _partial_before_exchange(plan)
    assert "partial_min" in plan and "Window" not in plan


def test_cleaning_is_one_narrow_stage(spark):
    plan = plan_of(stage(raw_frame(spark, [{"race": "x"}]), 2024))
    assert "Exchange" not in plan and "Window" not in plan


def test_scoped_serving_read_pushes_the_filter(spark, workdir):
    import os

    from carelens.operators import serving as Q
    from carelens.plans.catalog import FolderSummaries
    from carelens.plans.jobs import summarise

    fact = os.path.join(workdir, "fact")
    discharges(spark, SF_SMALL).write.parquet(fact)
    summarise(spark, fact, os.path.join(workdir, "s"))
    op = FolderSummaries(spark, os.path.join(workdir, "s"))("hospital_operation_summary")
    plan = plan_of(Q.kpi(op, Q.Scope.of(facility_name="Supplier#000000001")))
    assert "EqualTo(_key_facility_name,supplier#000000001)" in plan
    assert "ReadSchema" in plan and "patient_disposition" not in plan


def test_split_table_falls_back_to_path_key_on_hash_collision(spark, workdir, monkeypatch):
    import os

    from pyspark.sql import functions as F

    from carelens.sources import delimited
    from test_files import HEADERS, row, write

    a = write(os.path.join(workdir, "a.csv"), HEADERS, [row(**{"Race": f"a{i}"}) for i in range(5)])
    b = write(os.path.join(workdir, "b.csv"), HEADERS, [row(**{"Race": f"b{i}"}) for i in range(3)])
    monkeypatch.setattr(delimited.F, "xxhash64", lambda c: F.lit(42).cast("long"))  # every path collides
    got = sorted((r["source_file_name"], r["source_row_number"])
                 for r in delimited.read_discharge_file(spark, [a, b]).collect())
    assert got == [("a.csv", n) for n in range(2, 7)] + [("b.csv", n) for n in range(2, 5)]


def test_no_python_evaluation_in_any_catalogue_plan(spark):
    from carelens.plans.registry import QUERIES

    for name, query in QUERIES.items():
        plan = plan_of(query(spark, SF_SMALL))
        assert "EvalPython" not in plan and "PythonUDF" not in plan and "MapInPandas" not in plan, name
