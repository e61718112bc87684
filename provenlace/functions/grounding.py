"""Quotes grounded in the text they come from: exact, normalised, then the closest span of whole words, with offsets into the raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenlace.storage import cut

#: Fixed value: the similarity that a fuzzy match needs.
ACCEPT = 0.85
GRAM = 3
#: White space as a character is tested for it, the separators 1C to 1F among it.
BLANK = "(?U)[\\s\\x1c-\\x1f]"
WORD = "[\\p{L}\\p{N}_]"


def with_offsets(df: DataFrame, text: str, norm: str, offsets: str) -> DataFrame:
    """df with the normalised ``text`` (lower case character by character, white space collapsed and stripped) and the offset, in characters
    of the text, at which each of its characters starts; one more entry is the text's length.

    One character may give several in lower case, which all have its offset. A null text gives null and null, an empty
    or blank one '' and [its length].
    """
    chars, blank, kept = f"__chars_{norm}", f"__blank_{norm}", f"__kept_{norm}"
    at = F.sequence(F.lit(0), F.size(chars) - 1)
    some = F.when(F.size(chars) > 0, at).otherwise(F.array().cast("array<int>"))
    # a blank stays if something else stands right before it
    stays = F.filter(some, lambda i: ~F.get(blank, i) | ((i > 0) & ~F.coalesce(F.get(blank, i - 1), F.lit(True))))
    last_blank = F.coalesce(F.get(blank, F.element_at(kept, -1)), F.lit(False))
    trimmed = F.when(F.size(kept) > 0, F.when(last_blank, F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.col(kept))).otherwise(F.col(kept))
    lower = lambda i: F.when(F.get(blank, i), F.lit(" ")).otherwise(F.lower(F.get(chars, i)))
    pieces = F.transform(trimmed, lambda i: F.struct(lower(i).alias("c"), i.alias("i")))
    out = df.withColumn(chars, _characters(text)).withColumn(blank, F.transform(chars, lambda c: c.rlike(BLANK)))
    out = out.withColumn(kept, stays).withColumn(kept, pieces)
    spread = F.flatten(F.transform(kept, lambda p: F.array_repeat(p["i"], F.length(p["c"]))))
    out = out.withColumn(norm, F.when(F.col(text).isNotNull(), F.array_join(F.transform(kept, lambda p: p["c"]), "")))
    return out.withColumn(offsets, F.when(F.col(text).isNotNull(), F.concat(spread, F.array(F.size(chars))))).drop(chars, blank, kept)


def _raw_end(offsets: str, last: Column) -> Column:
    """The end, in the raw text, of the normalised character at ``last``: the first larger offset after it."""
    own = F.get(offsets, last)
    return F.element_at(F.filter(F.slice(offsets, last + 2, F.lit(4)), lambda x: x > own), 1)


def _characters(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


def _grams(chars: str) -> Column:
    """Every run of GRAM characters; by way of an array of characters, so that a long text is passed once."""
    return F.transform(
        F.sequence(F.lit(0), F.size(chars) - GRAM), lambda i: F.concat(*[F.get(chars, i + k) for k in range(GRAM)])
    )


def _words(inside: str) -> tuple[Column, Column]:
    """Positions at which words start and those right after they end, from an array that says of each character if it is part of one."""
    at = F.sequence(F.lit(0), F.size(inside))
    own, before = (lambda i: F.coalesce(F.get(inside, i), F.lit(False))), (lambda i: F.coalesce(F.get(inside, i - 1), F.lit(False)))
    return F.filter(at, lambda i: own(i) & ~before(i)), F.filter(at, lambda i: ~own(i) & before(i))


def closest_spans(rows: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(row_id, start, end, distance, score) of rows (row_id, text, quote; both normalised): each quote's closest span of whole words.

    A span's score is 1 - edit distance / the longer length; spans under ``accept`` don't count, ties go to the first start, then the
    shorter span. All spans that could count are looked at and few others: at this score at most k edits lie between, so the span
    shares so many grams of GRAM characters with the quote, all within k of its diagonal, that bands of diagonals with fewer
    are left out. Where k edits may leave no gram whole, or quote or text is shorter than one, every start is looked at.
    Grams meet inside their row, so that only those of both sides leave it, and edit distances are only computed up to k.
    What is read by row id is merged: a plan knows the size of the files alone, not that of the arrays made from them, and would broadcast these.
    """
    most = (1 - accept) / accept if accept > 0 else float("inf")
    edits = F.floor(F.least(F.col("m") * most + 1e-9, F.col("m") + F.length("text").cast("double"))).cast("int")
    q = rows.filter((F.length("quote") > 0) & (F.length("text") > 0)).withColumn("m", F.length("quote")).withColumn("k", edits)
    least = F.col("m") - GRAM + 1 - F.col("k") * GRAM
    told = (least > 0) & (F.length("text") >= GRAM)
    long = q.filter(told)
    # outer generators throughout, as the filter inferred for others would be pushed down and make the arrays anew for each element
    arrays = long.withColumn("__ours", _characters("quote")).withColumn("__theirs", _characters("text"))
    arrays = arrays.select("row_id", "k", "m", _grams("__ours").alias("ours"), _grams("__theirs").alias("theirs"))
    shared = arrays.select("row_id", "k", "m", "ours", F.posexplode_outer("theirs").alias("p", "gram")).filter(F.array_contains("ours", F.col("gram")))
    places = F.filter(F.sequence(F.lit(0), F.size("ours") - 1), lambda j: F.get("ours", j) == F.col("gram"))
    width = F.col("k") + 1
    hits = shared.select("row_id", "k", "m", "p", F.explode_outer(places).alias("j")).withColumn("band", F.floor((F.col("p") - F.col("j")) / width))
    # a match's diagonals are 2 k + 1 wide at most, so they lie in three neighbouring bands
    near = hits.select("row_id", "k", "m", "j", F.explode(F.array(F.col("band") - 2, F.col("band") - 1, F.col("band"))).alias("band"))
    bands = near.groupBy("row_id", "k", "m", "band").agg(F.countDistinct("j").alias("n")).filter(F.col("n") >= least)
    bands = bands.select("row_id", (F.col("band") * width - F.col("k")).alias("from"), ((F.col("band") + 3) * width + F.col("k")).alias("upto"))
    everywhere = q.filter(~told).select("row_id", F.lit(0).cast("long").alias("from"), F.length("text").cast("long").alias("upto"))
    bands = bands.unionByName(everywhere)
    starts, ends = _words("inside")
    worded = q.withColumn("inside", F.transform(_characters("text"), lambda c: c.rlike(WORD))).withColumn("starts", starts).withColumn("ends", ends)
    placed = worded.drop("inside").join(bands.hint("merge"), "row_id")
    from_here = F.filter("starts", lambda s: (s >= F.col("from")) & (s <= F.col("upto")))
    spans = placed.select("row_id", "text", "quote", "m", "k", "ends", F.explode_outer(from_here).alias("start")).filter("start IS NOT NULL")
    fits = F.filter("ends", lambda e: (e > F.col("start")) & (F.abs(e - F.col("start") - F.col("m")) <= F.col("k")))
    spans = spans.select("row_id", "text", "quote", "m", "start", F.explode_outer(fits).alias("end")).filter("end IS NOT NULL")
    span = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    spans = spans.select("row_id", "quote", "m", "start", "end", span.alias("span")).distinct()
    # the built-in takes its bound as a constant, so spans further off than their own k go by the score
    scored = spans.withColumn("distance", F.levenshtein("span", "quote")).withColumn("score", 1 - F.col("distance") / F.greatest(F.col("m"), F.col("end") - F.col("start")))
    best = F.min_by(F.struct("start", "end", "distance", "score"), F.struct(-F.col("score"), F.col("start"), F.col("end"))).alias("b")
    return scored.filter(F.col("score") >= accept - 1e-9).groupBy("row_id").agg(best).select("row_id", "b.*")


def ground(rows: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(row_id, rung, start, end, score) of every row (row_id, text, quote): where in its text the quote stands.

    exact: the quote as it is, at its first place; normalised: after lower case and collapsed white space; fuzzy: the closest span
    of whole words of the normalised text; failed: none, with null offsets. Offsets are characters of the raw text, with no blank at
    either end of a normalised or fuzzy match. Null, empty and blank quotes and null texts fail; row_id is unique.
    """
    base = rows.select("row_id", "text", "quote")
    exact = F.when(F.trim(F.regexp_replace("quote", BLANK, " ")) != "", F.expr("locate(quote, text)"))
    both = with_offsets(with_offsets(base, "text", "n", "o"), "quote", "nq", "oq").withColumn("hit", F.coalesce(exact, F.lit(0)))
    at = F.when(F.col("nq") != "", F.expr("locate(nq, n)") - 1)
    # written once: three ways read it, and filters that are pushed into it would make its arrays anew for each character
    both = cut(both.withColumn("at", F.coalesce(F.when(F.col("hit") == 0, at), F.lit(-1))))
    one = F.lit(1.0)
    sure = both.filter("hit > 0").select("row_id", F.lit("exact").alias("rung"), (F.col("hit") - 1).alias("start"), (F.col("hit") - 1 + F.length("quote")).alias("end"), one.alias("score"))
    normal = both.filter("at >= 0").select(
        "row_id", F.lit("normalised").alias("rung"), F.get("o", F.col("at")).alias("start"), _raw_end("o", F.col("at") + F.length("nq") - 1).alias("end"), one.alias("score")
    )
    rest = both.filter("hit = 0 AND at < 0")
    found = closest_spans(rest.select("row_id", F.col("n").alias("text"), F.col("nq").alias("quote")), accept)
    loose = rest.select("row_id", "o").join(found.hint("merge"), "row_id", "left").select(
        "row_id", F.when(F.col("score").isNull(), "failed").otherwise("fuzzy").alias("rung"), F.get("o", F.col("start")).alias("start"),
        F.when(F.col("score").isNotNull(), _raw_end("o", F.col("end") - 1)).alias("end"), "score",
    )
    return sure.unionByName(normal).unionByName(loose)


def grounded_claims(quotes: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(claim_id, grounded, quotes, exact, normalised, fuzzy, failed) of quotes (row_id, claim_id, text, quote): a claim is grounded if all of its quotes are."""
    rungs = ("exact", "normalised", "fuzzy", "failed")
    told = quotes.select("row_id", "claim_id").join(ground(quotes, accept).hint("merge"), "row_id")
    counted = told.groupBy("claim_id").agg(F.count(F.lit(1)).alias("quotes"), *[F.count_if(F.col("rung") == r).alias(r) for r in rungs])
    return counted.select("claim_id", (F.col("failed") == 0).alias("grounded"), "quotes", *rungs)
