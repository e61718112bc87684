"""One relational plan, written once, for Spark SQL and for the checking engine.

A plan is SQL with a few macros, for the places where the two engines spell things differently.
Spark runs it through Catalyst; the other rendering is the oracle that results are compared with.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

MACROS: dict[str, tuple[str, str]] = {
    # name: (Spark, oracle); $1, $2, ... are the arguments
    "sha16": ("substr(sha2(concat_ws(chr(31), $*), 256), 1, 16)", "substr(sha256(concat_ws(chr(31), $*)), 1, 16)"),
    "sha": ("sha2($1, 256)", "sha256($1)"),
    "rr": ("regexp_replace($1, $2, $3)", "regexp_replace($1, $2, $3, 'g')"),
    "rlike": ("($1 RLIKE $2)", "regexp_matches($1, $2)"),
    "rx": ("regexp_extract($1, $2, $3)", "regexp_extract($1, $2, $3)"),
    "split": ("split($1, $2)", "string_split($1, $2)"),
    "explode": ("explode($1)", "unnest($1)"),
    "posexplode": ("posexplode($1) AS (pos, $2)", "unnest($1) AS $2, generate_subscripts($1, 1) - 1 AS pos"),
    "seq": ("explode(sequence($1, $2))", "unnest(generate_series($1, $2))"),
    "sagg": ("listagg($1, $2) WITHIN GROUP (ORDER BY $1)", "string_agg($1, $2 ORDER BY $1)"),
    "saggby": ("listagg($1, $2) WITHIN GROUP (ORDER BY $3)", "string_agg($1, $2 ORDER BY $3)"),
    "idiv": ("($1 div $2)", "($1 // $2)"),
    "pct": ("percentile($1, $2)", "quantile_cont($1, $2)"),
    "bits": ("bit_count($1)", "bit_count($1)::INT"),
    "shl": ("shiftleft(CAST(1 AS BIGINT), CAST($1 AS INT))", "(1::BIGINT << ($1)::INT)"),
    "dot": (
        "aggregate(zip_with($1, $2, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (a, x) -> a + x)",
        "list_dot_product($1::DOUBLE[], $2::DOUBLE[])",
    ),
    "json": ("get_json_object($1, $2)", "json_extract_string($1, $2)"),
    "epoch": ("unix_timestamp($1)", "epoch($1)::BIGINT"),
    "words": ("filter(split($1, ' '), w -> w <> '')", "list_filter(string_split($1, ' '), lambda w: w <> '')"),
    "firstnn": ("first_value($1) IGNORE NULLS", "first_value($1 IGNORE NULLS)"),
    "len": ("CAST(size($1) AS BIGINT)", "len($1)::BIGINT"),
    "distinct": ("array_distinct($1)", "list_distinct($1)"),
    "inter": ("array_intersect($1, $2)", "list_intersect($1, $2)"),
    "uni": ("array_union($1, $2)", "list_distinct(list_concat($1, $2))"),
    "join": ("array_join($1, ' ')", "array_to_string($1, ' ')"),
    "epochday": ("unix_timestamp(to_timestamp($1))", "epoch($1::TIMESTAMP)::BIGINT"),
}
#: Numbers with a point are doubles on both sides, not decimals.
POINT = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.])")
CALL = re.compile(r"@(\w+)\(")


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    args, depth, start, quoted = [], 0, at, False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]" and depth:
            depth -= 1
        elif c == ")":
            return [*args, text[start:i].strip()], i + 1
        elif c == "," and not depth:
            args.append(text[start:i].strip())
            start = i + 1
    raise ValueError(f"a macro call does not end: {text[at : at + 60]}")


def render(sql: str, spark: bool) -> str:
    while m := CALL.search(sql):
        args, end = _arguments(sql, m.end())
        body = MACROS[m[1]][0 if spark else 1].replace("$*", ", ".join(args))
        for i in range(len(args), 0, -1):
            body = body.replace(f"${i}", args[i - 1])
        sql = sql[: m.start()] + body + sql[end:]
    sql = POINT.sub(r"\1E0", sql)
    return sql.replace("\\", "\\\\") if spark else sql


def plan(body: str, *views: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A query function and its oracle SQL. views: the names of the shared views the body reads."""
    from provenlace.plans.views import with_views

    sql = with_views(body, views)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = render(sql, True)
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    return run, render(with_views(body, views, plain=True), False)
