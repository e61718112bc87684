"""Time phrases of a closed vocabulary as half-open intervals, in built-in expressions only."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary's months (also by their first three letters, and sept).
MONTHS = "january february march april may june july august september october november december".split()
NUMBERS = {name: i for i, m in enumerate(MONTHS, 1) for name in (m, m[:3])} | {"sept": 9}
FILLERS = ("in", "during", "of", "the", "on")
BACK = "last|past|previous"


def _date(text: Column) -> Column:
    """A date, or null where the text is none or lies before year 1."""
    d = text.try_cast("date")
    return F.when(F.year(d) >= 1, d)


def _span(lo: Column, hi: Column) -> Column:
    lo = F.when(F.year(lo) >= 1, lo)
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def _day(d: Column) -> Column:
    return _span(d, F.date_add(d, 1))


def _months(first: Column, n: int) -> Column:
    return _span(first, F.add_months(first, n))


def normalised(phrase: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(phrase)), r"[^\p{L}\p{N}_\s/-]+", " "), "_", " "))


def bounded(text: Column, today: Column) -> Column:
    """(lo, hi) dates of a normalised phrase with two ends; null if the vocabulary has none like it."""
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    iso = F.regexp_replace(text, "/", "-")
    step = r"^(this|last|past|previous|next)\s+(week|month|year)$"
    by = F.when(part(step, 1) == "this", 0).when(part(step, 1) == "next", 1).otherwise(-1)
    week = F.date_add(F.trunc(today, "week"), by * 7)
    year = r"^(?:in\s+|during\s+|the\s+year\s+)?(\d{4})$"
    tokens = F.filter(F.split(text, r"\s+"), lambda w: ~w.isin(*FILLERS))
    a, b = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    number = F.create_map(*map(F.lit, chain.from_iterable(NUMBERS.items())))
    na, nb = F.try_element_at(number, a), F.try_element_at(number, b)
    month_of = lambda y, m: _months(_date(F.concat_ws("-", y.cast("string"), m.cast("string"), F.lit("1"))), 1)
    latest = lambda m, this: month_of(F.year(today) - F.when(m < F.month(today), 0).when((m == F.month(today)) & F.lit(this), 0).otherwise(1), m)
    count = rf"^(?:{BACK})\s+(\d{{1,6}})\s+(day|week|month|year)s?$"
    n, unit = F.coalesce(part(count, 1).try_cast("int"), F.lit(0)), part(count, 2)
    start = (
        F.when(unit == "day", F.date_sub(F.date_add(today, 1), n))
        .when(unit == "week", F.date_sub(F.date_add(today, 1), n * 7))
        .when(unit == "month", F.add_months(F.trunc(today, "month"), -n))
        .otherwise(F.add_months(F.trunc(today, "month"), n * -12))
    )
    two, y4 = F.size(tokens) == 2, r"^\d{4}$"
    return (
        F.when(text.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"), _day(_date(iso)))
        .when(text.rlike(r"^\d{4}[-/]\d{1,2}$"), _months(_date(F.concat(iso, F.lit("-1"))), 1))
        .when(text.isin("today", "this day"), _day(today))
        .when(text == "yesterday", _day(F.date_sub(today, 1)))
        .when(text == "tomorrow", _day(F.date_add(today, 1)))
        .when(
            text.rlike(step),
            F.when(part(step, 2) == "week", _span(week, F.date_add(week, 7)))
            .when(part(step, 2) == "month", _months(F.add_months(F.trunc(today, "month"), by), 1))
            .otherwise(_months(F.add_months(F.trunc(today, "year"), by * 12), 12)),
        )
        .when(text.rlike(year), _months(_date(F.concat(part(year, 1), F.lit("-1-1"))), 12))
        .when(two & na.isNotNull() & b.rlike(y4), month_of(b, na))
        .when(two & nb.isNotNull() & a.rlike(y4), month_of(a, nb))
        .when(two & a.isin(*BACK.split("|")) & nb.isNotNull(), latest(nb, False))
        .when(two & (a == "this") & nb.isNotNull(), latest(nb, True))
        .when((F.size(tokens) == 1) & na.isNotNull(), latest(na, True))
        .when(text.rlike(count), _span(start, F.date_add(today, 1)))
    )


def _years_on(span: Column, years: int) -> Column:
    """The same days so many years later; null where one of them does not exist."""
    ends = [F.add_months(span[x], 12 * years) for x in ("lo", "hi")]
    same = (F.day(ends[0]) == F.day(span["lo"])) & (F.day(ends[1]) == F.day(span["hi"]))
    return F.when(same, F.struct(ends[0].alias("lo"), ends[1].alias("hi")))


def resolve(rows: DataFrame, phrase_col: str, day_col: str, out: str = "resolved") -> DataFrame:
    """rows with (lo, hi) in epoch seconds (UTC), a null end being open; null for a phrase that the vocabulary does not have.

    since, after, from and later than open the end; before, until, prior to, up to and earlier than the start;
    between A and B ends with B, which moves on by up to two years if it lies before A. Null and blank phrases, and
    days that no calendar has, are null. All columns are kept, one named like out is replaced. The parts that a phrase may consist of go
    through one expression, an array's, so that the plan stays small.
    """
    after, before = r"^(?:since|after|from|later\s+than)\s+(.*)$", r"^(?:before|prior\s+to|until|up\s+to|earlier\s+than)\s+(.*)$"
    between = r"^between\s+(.*?)\s+and\s+(.*)$"
    text, kind, spans = F.col("__text"), F.col("__kind"), F.col("__spans")
    rows = rows.drop(out).withColumn("__text", normalised(F.col(phrase_col)))
    rows = rows.withColumn("__kind", F.when(text.rlike(after), 1).when(text.rlike(before), 2).when(text.rlike(between), 3).otherwise(0))
    parts = F.array(text, F.regexp_extract(text, after, 1), F.regexp_extract(text, before, 1), F.regexp_extract(text, between, 1), F.regexp_extract(text, between, 2))
    rows = rows.withColumn("__spans", F.transform(parts, lambda x: bounded(x, F.col(day_col))))
    a, b = F.get(spans, F.lit(3)), F.get(spans, F.lit(4))
    rows = rows.withColumn("__later", F.array(b, _years_on(b, 1), _years_on(b, 2)))
    one, two, three = (F.get("__later", F.lit(i)) for i in range(3))
    end = F.when(one["lo"] >= a["lo"], one).when(two["lo"] >= a["lo"], two).when(two.isNotNull() & (three["lo"] >= a["lo"]), three)
    rows = rows.withColumn("__end", end)
    seconds = lambda d: F.unix_date(d) * F.lit(86400).cast("long")
    none = F.lit(None).cast("long")
    pair = lambda known, lo, hi: F.when(known.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))
    found = (
        F.when(kind == 1, pair(F.get(spans, F.lit(1)), seconds(F.get(spans, F.lit(1))["lo"]), none))
        .when(kind == 2, pair(F.get(spans, F.lit(2)), none, seconds(F.get(spans, F.lit(2))["lo"])))
        .when(kind == 3, pair(F.col("__end"), seconds(a["lo"]), F.greatest(seconds(a["hi"]), seconds(F.col("__end.hi")))))
        .otherwise(pair(F.get(spans, F.lit(0)), seconds(F.get(spans, F.lit(0))["lo"]), seconds(F.get(spans, F.lit(0))["hi"])))
    )
    return rows.withColumn(out, found).drop("__text", "__kind", "__spans", "__later", "__end")


#: Phrases and, in the checking engine's own words, their ends for a day d.
PHRASES = {
    "today": ("d", "d + 1"),
    "Yesterday!": ("d - 1", "d"),
    "last week": ("date_trunc('week', d)::DATE - 7", "date_trunc('week', d)::DATE"),
    "next month": ("(date_trunc('month', d) + INTERVAL 1 MONTH)::DATE", "(date_trunc('month', d) + INTERVAL 2 MONTH)::DATE"),
    "this year": ("date_trunc('year', d)::DATE", "(date_trunc('year', d) + INTERVAL 1 YEAR)::DATE"),
    "last 3 weeks": ("d + 1 - 21", "d + 1"),
    "past 2 months": ("(date_trunc('month', d) - INTERVAL 2 MONTH)::DATE", "d + 1"),
    "in March 2023": ("DATE '2023-03-01'", "DATE '2023-04-01'"),
    "2023-02-30": ("NULL", "NULL"),
    "since 2022": ("DATE '2022-01-01'", "NULL"),
    "before 2023-05-09": ("NULL", "DATE '2023-05-09'"),
    "between Nov 2022 and Feb 2022": ("DATE '2022-11-01'", "DATE '2023-03-01'"),
    "whenever": ("NULL", "NULL"),
}


def time_phrase_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("day")).distinct()
    found = resolve(days.crossJoin(F.broadcast(phrases)), "phrase", "day", "r")  # a dozen phrases
    return found.select(F.unix_date("day").cast("long").alias("day"), "phrase", "r.lo", "r.hi")


ORACLE = " UNION ALL ".join(
    "SELECT d - DATE '1970-01-01' AS day, '{}' AS phrase, epoch({})::BIGINT AS lo, epoch({})::BIGINT AS hi FROM d".format(
        p, *(f"({x})::DATE" if x != "NULL" else "NULL::DATE" for x in ends)
    )
    for p, ends in PHRASES.items()
)
ORACLE = f"WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) {ORACLE}"
