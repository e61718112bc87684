"""Phrases and their intervals, asked on Wednesday, 15 March 2023."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from provenlace.functions.time_phrases import resolve

D = date
CASES = {
    "2023-01-05": (D(2023, 1, 5), D(2023, 1, 6)), "2023/1/5": (D(2023, 1, 5), D(2023, 1, 6)), "2022-12": (D(2022, 12, 1), D(2023, 1, 1)),
    "This day": (D(2023, 3, 15), D(2023, 3, 16)), "tomorrow?": (D(2023, 3, 16), D(2023, 3, 17)),
    "this week": (D(2023, 3, 13), D(2023, 3, 20)), "previous week": (D(2023, 3, 6), D(2023, 3, 13)), "next year": (D(2024, 1, 1), D(2025, 1, 1)),
    "last month": (D(2023, 2, 1), D(2023, 3, 1)), "during 2021": (D(2021, 1, 1), D(2022, 1, 1)), "the year 2020": (D(2020, 1, 1), D(2021, 1, 1)),
    "May of 2022": (D(2022, 5, 1), D(2022, 6, 1)), "2022 sept": (D(2022, 9, 1), D(2022, 10, 1)),
    "last march": (D(2022, 3, 1), D(2022, 4, 1)), "this march": (D(2023, 3, 1), D(2023, 4, 1)), "in april": (D(2022, 4, 1), D(2022, 5, 1)), "feb": (D(2023, 2, 1), D(2023, 3, 1)),
    "last 7 days": (D(2023, 3, 9), D(2023, 3, 16)), "past 1 year": (D(2022, 3, 1), D(2023, 3, 16)), "previous 2 weeks": (D(2023, 3, 2), D(2023, 3, 16)),
    "later than yesterday": (D(2023, 3, 14), None), "up to 2022": (None, D(2022, 1, 1)), "until next week": (None, D(2023, 3, 20)),
    "between yesterday and tomorrow": (D(2023, 3, 14), D(2023, 3, 17)), "between june and january": (D(2022, 6, 1), D(2023, 2, 1)),
    "between 2020 and 2017": None, "between 2020 and 2018": (D(2020, 1, 1), D(2021, 1, 1)),
    "2023-06-31": None, "past 3000 years": None, "since whenever": None, "": None, "a while ago": None, "last 4 fortnights": None, None: None,
}


def test_vocabulary(spark):
    seconds = lambda d: None if d is None else (d - D(1970, 1, 1)).days * 86400
    rows = spark.createDataFrame([(p,) for p in CASES], "phrase string")
    rows = resolve(rows.withColumn("day", F.lit(D(2023, 3, 15))), "phrase", "day", "r")
    got = {r.phrase: None if r.r is None else (r.r.lo, r.r.hi) for r in rows.collect()}
    want = {p: None if ends is None else tuple(map(seconds, ends)) for p, ends in CASES.items()}
    assert {p: (got[p], want[p]) for p in CASES if got[p] != want[p]} == {}


@pytest.mark.parametrize("phrase", ["between 2024-02-29 and 2023-02-28"])
def test_a_day_that_later_years_lack(spark, phrase):
    rows = spark.range(1).select(F.lit(phrase).alias("phrase"), F.lit(D(2023, 3, 15)).alias("day"))
    row = resolve(rows, "phrase", "day", "r").first()
    assert row.r is None or row.r.lo == (D(2024, 2, 29) - D(1970, 1, 1)).days * 86400
