"""Exact half-up ratios and averages against Python's decimal arithmetic (random cases, one Spark job)."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from carelens.functions.measures import average, ratio


def test_ratio_and_average_half_up(spark):
    rnd = random.Random(7)
    cases = []
    for _ in range(3000):
        den = rnd.choice([1, 2, 3, 7, 8, 10, 16, 400, 12345, 10 ** 9 + 7, rnd.randint(1, 10 ** 6)])
        num = rnd.randint(0, den * 3)
        cents = rnd.randint(-10 ** 12, 10 ** 12)
        cases.append((num, den, Decimal(cents) / 100))
    # exact ties on purpose
    cases += [(1, 8, Decimal("0.05")), (5, 10 ** 5 * 2, Decimal("1.25")), (1, 20000, Decimal("-0.03"))]
    df = spark.createDataFrame(cases, "num long, den long, total decimal(20,2)")
    got = df.select(ratio(F.col("num"), F.col("den")).alias("r"),
                    average(F.col("total"), F.col("den")).alias("a")).collect()
    for (num, den, total), row in zip(cases, got):
        r = (Decimal(num) / Decimal(den)).quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP)
        a = (total / Decimal(den)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        assert row["r"] == float(r), (num, den)
        assert row["a"] == float(a), (total, den)


def test_null_and_zero_denominators(spark):
    df = spark.createDataFrame([(None, 0, None), (3, None, Decimal("1.00")), (None, 4, Decimal("2.00"))],
                               "num long, den long, total decimal(20,2)")
    got = df.select(ratio(F.col("num"), F.col("den")).alias("r"),
                    average(F.col("total"), F.col("den")).alias("a")).collect()
    assert [(r["r"], r["a"]) for r in got] == [(None, None), (None, None), (0.0, 0.5)]


def test_display_formats(spark):
    from carelens.functions.format import display_count, display_days, display_money, display_percent

    df = spark.createDataFrame([(2.5,), (9999.4,), (12345.0,), (-3.5,), (None,), (123456789.0,)], "v double")
    got = [r[0] for r in df.select(display_money(F.col("v"))).collect()]
    assert got == ["3", "9,999", "1.23 万", "-4", "--", "1.23 亿"]
    row = spark.createDataFrame([(0.1234, 3.5, None)], "r double, d double, n long").select(
        display_percent(F.col("r")), display_days(F.col("d")), display_count(F.col("n"))).first()
    assert list(row) == ["12.34%", "3.50 天", "0"]
