"""Spark rules against the Python/pandas behaviour they re-express, on generated inputs."""

import math
import random
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from carelens.functions.numbers import parse_number
from carelens.functions.text import normalize_text

SPACES = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ",
          " ", " ", " ", "　"]
NOT_SPACES = ["​", "﻿", "_", "x", "é", "中"]


def test_strip_matches_python(spark):
    rnd = random.Random(11)
    values = []
    for _ in range(4000):
        parts = [rnd.choice(SPACES + NOT_SPACES) for _ in range(rnd.randint(0, 6))]
        values.append("".join(parts))
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(normalize_text(F.col("v"))).collect()]
    want = [v.strip() or None for v in values]
    assert got == want


def _number_inputs(rnd):
    atoms = ["0", "1", "7", "42", "1000", ".", ",", "$", "-", "+", "e", "E", " ", "a", "_"]
    fixed = ["1,027,545.65", "$300.00", "120 +", "-1", "1e3", "1E-2", ".5", "5.", "+.5", "-0", "00012",
             "3,100", "$-5", "1_000", "0x10", "12a", "--1", "1.2.3", "e5", "1e", "$", ",", "1,,2", "$1$"]
    out = list(fixed)
    for _ in range(3000):
        out.append("".join(rnd.choice(atoms) for _ in range(rnd.randint(1, 7))))
    return out


def test_numbers_match_pandas_to_numeric(spark):
    values = _number_inputs(random.Random(5))
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(parse_number(F.col("v"))).collect()]
    cleaned = pd.Series(values, dtype="string").str.strip().replace({"": pd.NA})
    cleaned = cleaned.str.replace(",", "", regex=False).str.replace("$", "", regex=False)
    checked = 0
    for raw, text, mine in zip(values, cleaned, got):
        theirs = pd.to_numeric(pd.Series([text], dtype="string"), errors="coerce").iloc[0]
        if theirs is pd.NA or (isinstance(theirs, float) and math.isnan(theirs)):
            assert mine is None, raw
        elif isinstance(theirs, float) and math.isinf(theirs):
            assert mine is None, raw  # documented: infinities cannot be stored, treated as invalid
        else:
            if abs(float(theirs)) >= 1e32:
                continue  # beyond decimal(38,6): documented as a parse failure
            assert mine is not None, raw
            assert float(mine) == float(Decimal(str(theirs))) or abs(float(mine) - float(theirs)) <= 1e-6 * max(
                1.0, abs(float(theirs))), raw
        checked += 1
    assert checked > 2500


def test_reader_matches_pandas_read_csv(spark, workdir):
    import csv
    import os

    from carelens.schema import NULL_TOKENS
    from carelens.sources.delimited import read_discharge_file

    rnd = random.Random(3)
    pieces = ["a", "b c", "x,y", 'say "hi"', " NA ", "NA", "", " ", "null", "N/A", "nan", "#N/A", "\\", "é"]
    headers = ["Facility Name", "Race", "Ethnicity", "Discharge Year", "CCSR Diagnosis Code", "Length of Stay"]
    rows = [[rnd.choice(pieces) for _ in headers] for _ in range(400)]
    path = os.path.join(workdir, "quoting.csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, quoting=csv.QUOTE_MINIMAL).writerows([headers] + rows)
    theirs = pd.read_csv(path, dtype="string", na_values=["", " ", "N/A", "NA", "NULL", "null"],
                         keep_default_na=True)
    mine = read_discharge_file(spark, path).orderBy("source_row_number").select(
        "facility_name", "race", "ethnicity", "discharge_year", "ccsr_diagnosis_code", "length_of_stay").collect()
    assert len(mine) == len(theirs)
    for got, (_, want) in zip(mine, theirs.iterrows()):
        assert [None if v is pd.NA else v for v in want.tolist()] == list(got)
    assert set(NULL_TOKENS) >= {"", " ", "NA", "null", "N/A", "nan", "#N/A"}


def test_blank_lines_take_no_ordinal(spark, workdir):
    import os

    from carelens.sources.delimited import read_discharge_file

    path = os.path.join(workdir, "blank.csv")
    with open(path, "w") as f:
        f.write("Facility Name,Discharge Year,CCSR Diagnosis Code,Length of Stay\n")
        f.write("A,2021,D1,3\n\n\nB,2021,D1,3\n,,,\n\nC,2021,D1,3\n")
    theirs = pd.read_csv(path, dtype="string")
    want = [(None if v is pd.NA else v, i + 2) for i, v in enumerate(theirs["Facility Name"])]
    got = [(r["facility_name"], r["source_row_number"])
           for r in read_discharge_file(spark, path).orderBy("source_row_number").collect()]
    assert got == want


def test_canonicalize_matches_python(spark):
    from carelens.functions.text import canonicalize
    from carelens.schema import EMERGENCY_ALIASES, GENDER_ALIASES

    rnd = random.Random(9)
    words = ["male", "Male", "MALE", "f", "Female", "fEmAlE", "m", "U", "yes", "No", "true", "1", "0", "ß", "ǆ",
             "straße", "ﬀ", "é"]
    values = []
    for _ in range(2000):
        w = rnd.choice(words)
        values.append(rnd.choice(["", " ", "\t", "\xa0"]) + w + rnd.choice(["", " ", "　"]))
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for aliases in (GENDER_ALIASES, EMERGENCY_ALIASES):
        got = [r[0] for r in df.select(canonicalize(F.col("v"), aliases)).collect()]
        want = [aliases.get(v.strip().upper(), v.strip() or None) if v.strip() else None for v in values]
        assert got == want


def test_fold_ignores_case_and_accents(spark):
    import unicodedata

    from carelens.functions.text import fold

    texts = ["kings", "KINGS", "K\u00ceNGS", "Ki\u0301ngs  ", "stra\u00dfe", "STRASSE", "\u00e5\u00c5", "\u017d\u0161\u0159", "\u03ac\u0391", "\u0439 \u0418",
             "\u1ed9 \u1ea4", "no accents", "", " lead", "\u6f22\u5b57", "l\u2019h\u00f4pital", "#%_\\", None]

    def plain(t):
        parts = unicodedata.normalize("NFD", t.lower().replace("\u00df", "ss"))
        return unicodedata.normalize("NFC", "".join(c for c in parts if not unicodedata.combining(c))).rstrip(" ")

    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fold(F.col("t"))).collect()]
    assert got == [None if t is None else plain(t) for t in texts]
    assert len(set(got[:4])) == 1 and got[4] == got[5]
