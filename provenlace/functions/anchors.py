"""Which of a question's titles it is about, and subjects of its decomposed steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(text: Column) -> Column:
    """Lower case, runs of blanks as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def step_subject(step: Column) -> Column:
    """What stands before '>>' in a step; null if that is empty or names an earlier step ('#1')."""
    head = F.trim(F.split(step, ">>").getItem(0))
    return F.when((head != "") & ~head.startswith("#"), head)


def _longest(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.min(F.struct((-F.length("title")).alias("n"), F.col("title").alias("title"))).alias("t")).select(key, F.col("t.title").alias("anchor"))


def title_in_question(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """(question_id, anchor): the longest title (the first one among equals) of titles (question_id, title) that occurs in the question's text.

    Both are folded first; a blank title occurs nowhere. Questions without such a title have a null anchor.
    A question meets its own titles only: one equi-join, and one aggregation with partial results.
    """
    pairs = questions.select("question_id", folded(F.col("text")).alias("q")).join(titles.select("question_id", "title"), "question_id")
    title = folded(F.col("title"))
    found = _longest(pairs.filter((title != "") & F.contains("q", title)), "question_id")
    return questions.select("question_id").join(found, "question_id", "left")


def subject_title(steps: DataFrame, titles: DataFrame) -> DataFrame:
    """(question_id, anchor): the longest of a question's titles that equals its subject, holds it or is part of it.

    steps: (question_id, step); its subject is what stands before '>>'. Null without a subject or such a title.
    """
    subject = steps.select("question_id", folded(step_subject(F.col("step"))).alias("s"))
    pairs = subject.join(titles.select("question_id", "title").filter("title <> ''"), "question_id")
    title = folded(F.col("title"))
    found = _longest(pairs.filter((F.col("s") != "") & (F.contains(title, F.col("s")) | F.contains(F.col("s"), title))), "question_id")
    return steps.select("question_id").join(found, "question_id", "left")
