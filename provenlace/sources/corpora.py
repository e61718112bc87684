"""Conversation corpora in JSON files, flattened to turns and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = ("turn_id", "conv_id", "session_id", "speaker", "ts", "text")
SESSIONS = (
    "question_id STRING, question_type STRING, question STRING, question_date STRING, answer STRING, answer_session_ids ARRAY<STRING>, "
    "haystack_session_ids ARRAY<STRING>, haystack_dates ARRAY<STRING>, haystack_sessions ARRAY<ARRAY<STRUCT<role: STRING, content: STRING, has_answer: BOOLEAN>>>"
)
SAMPLES = (
    "sample_id STRING, conversation STRING, "
    "qa ARRAY<STRUCT<question: STRING, answer: STRING, adversarial_answer: STRING, category: INT, evidence: ARRAY<STRING>>>"
)
#: Date formats of the two kinds of corpora, once the day of the week is taken out.
SESSION_DATE = "yyyy/MM/dd HH:mm"
SAMPLE_DATE = "h:mm a 'on' d MMMM, yyyy"
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def pinned(spark: SparkSession, path: str, sha256: str | None) -> str:
    """path, once its file's digest is the given one (None: not checked)."""
    if sha256 is not None:
        found = [r[0] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).collect()]
        if found != [sha256.lower()]:
            raise ValueError(f"{path}: expected one file with SHA-256 {sha256}, found {found}")
    return path


def _needed(name: str) -> Column:
    """The column, or an error where a record lacks it."""
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"a record has no {name}"))).otherwise(F.col(name))


def _iso(text: Column, form: str) -> Column:
    return F.date_format(F.to_timestamp(text, form), ISO)


def read_sessions(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """A JSON list of questions, each with its sessions; a record without id or sessions is an error."""
    raw = spark.read.schema(SESSIONS).json(pinned(spark, path, sha256), multiLine=True)
    needed = {"question_id", "haystack_session_ids", "haystack_dates", "haystack_sessions"}
    return raw.select(*[_needed(c).alias(c) if c in needed else F.col(c) for c in raw.columns])


def session_turns(corpus: DataFrame, prefix: str = "sessions", only: DataFrame | None = None) -> DataFrame:
    """Turns of read_sessions' rows, and whether each is marked as evidence; ``only`` (question_id, session_id) picks sessions.

    A turn's id is prefix, question, session and place, joined by slashes. Its time (UTC) is its session's.
    """
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("s"), F.col("haystack_dates").alias("d"), F.col("haystack_sessions").alias("turns"))
    sessions = corpus.select("question_id", F.explode(zipped).alias("z")).select("question_id", F.col("z.s").alias("session_id"), "z.d", "z.turns")
    if only is not None:
        sessions = sessions.join(only.select("question_id", "session_id").distinct(), ["question_id", "session_id"], "left_semi")
    day = F.regexp_replace("d", r"\s*\([^)]*\)\s*", " ")
    turns = sessions.select("question_id", "session_id", _iso(day, SESSION_DATE).alias("ts"), F.posexplode("turns").alias("ix", "t"))
    return turns.select(
        F.concat_ws("/", F.lit(prefix), "question_id", "session_id", F.col("ix").cast("string")).alias("turn_id"),
        F.col("question_id").alias("conv_id"), "session_id", F.col("t.role").alias("speaker"), "ts", F.col("t.content").alias("text"),
        F.coalesce("t.has_answer", F.lit(False)).alias("is_evidence"),
    )


def question_meta(corpus: DataFrame) -> DataFrame:
    """A row per question of read_sessions: its fields and how many sessions and turns it has to search."""
    turns = F.aggregate("haystack_sessions", F.lit(0), lambda n, s: n + F.size(s))
    return corpus.select(
        "question_id", "question_type", "question", "question_date", "answer", "answer_session_ids",
        F.size("haystack_sessions").alias("n_sessions"), turns.alias("n_haystack_turns"),
    )


def read_samples(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """A JSON list of conversations with their questions; a record without id, conversation or qa is an error."""
    raw = spark.read.schema(SAMPLES).json(pinned(spark, path, sha256), multiLine=True)
    return raw.select(*[_needed(c).alias(c) for c in raw.columns])


def sample_turns(corpus: DataFrame, prefix: str = "samples") -> DataFrame:
    """Turns of read_samples' rows with text, and their dia_id; sessions are numbered as their keys say, not as text sorts.

    A turn's place counts the turns of its session, those without text included.
    """
    entries = corpus.select("sample_id", F.from_json("conversation", "MAP<STRING, STRING>").alias("m"))
    sessions = entries.select("sample_id", "m", F.explode(F.map_keys("m")).alias("key")).filter(F.col("key").rlike(r"^session_\d+$"))
    sessions = sessions.select(
        "sample_id", F.regexp_extract("key", r"(\d+)$", 1).cast("int").alias("session_no"), F.col("key").alias("session_id"),
        F.from_json(F.element_at("m", F.col("key")), "ARRAY<STRUCT<speaker: STRING, text: STRING, dia_id: STRING>>").alias("turns"),
        _iso(F.upper(F.element_at("m", F.concat("key", F.lit("_date_time")))), "h:mm a 'ON' d MMMM, yyyy").alias("ts0"),
        _iso(F.element_at("m", F.concat("key", F.lit("_date_time"))), SAMPLE_DATE).alias("ts1"),
    )
    turns = sessions.select("sample_id", "session_no", "session_id", F.coalesce("ts1", "ts0").alias("ts"), F.posexplode("turns").alias("ix", "t"))
    return turns.filter(F.trim(F.coalesce("t.text", F.lit(""))) != "").select(
        F.concat_ws("/", F.lit(prefix), "sample_id", "session_id", F.col("ix").cast("string")).alias("turn_id"),
        F.col("sample_id").alias("conv_id"), "session_id", F.col("t.speaker").alias("speaker"), "ts", F.col("t.text").alias("text"),
        "session_no", F.col("t.dia_id").alias("dia_id"),
    )


def sample_questions(corpus: DataFrame) -> DataFrame:
    """Questions of read_samples' rows, numbered inside their sample."""
    q = corpus.select(F.col("sample_id").alias("conv_id"), F.posexplode("qa").alias("ix", "q"))
    return q.select("conv_id", "ix", F.concat_ws("/", "conv_id", F.col("ix").cast("string")).alias("question_id"), "q.*")


def evidence_turns(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """(question_id, turn_id) of the evidence that the turns have; other marks are left out."""
    marks = questions.select("conv_id", "question_id", F.explode("evidence").alias("dia_id")).distinct()
    return marks.join(turns.select("conv_id", "dia_id", "turn_id"), ["conv_id", "dia_id"]).select("question_id", "turn_id")
