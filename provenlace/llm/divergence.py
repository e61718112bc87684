"""Source divergence audit: terms as wide vectors of source counts, compared pair by pair in higher-order functions."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenlace.llm.common import cut, table

#: Distinct terms a task holds before it passes its partial counts on.
HELD = 300_000
#: Bytes of a text that are split at a time.
SLICE = 1 << 20
#: Groups up to which the table of them goes to all tasks; beyond it is joined by (lang, salt).
BROADCAST_GROUPS = 100_000
SALTS = 64
#: Everything but letters A-Z, a-z and bytes of other characters becomes a blank; A-Z becomes a-z.
FOLD = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def _slices(text: bytes) -> Iterator[bytes]:
    """text folded, in parts that end at a blank."""
    folded = text.translate(FOLD)
    at = 0
    while len(folded) - at > SLICE:
        end = folded.find(b" ", at + SLICE)
        if end < 0:
            break
        yield folded[at:end]
        at = end
    yield folded[at:]


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, term, n (occurrences), d (rows with it), summed within a task as far as HELD allows."""
    slim = docs.select(
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        d: dict[tuple, Counter] = defaultdict(Counter)
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                keys = list(terms)
                rows = d[lang, source]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.string()), pa.array(keys, pa.binary()),
                        pa.array([terms[k] for k in keys], pa.int64()), pa.array([rows[k] for k in keys], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "d"],
                )
            n.clear()
            d.clear()

        for b in batches:
            for group in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, seen = group[:2], set()
                had = len(n[key])
                for part in _slices(group[2]):
                    words = part.split()
                    n[key].update(words)
                    seen.update(words)
                d[key].update(seen)
                size += len(n[key]) - had
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    found = slim.mapInArrow(run, "lang string, source string, term binary, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(1000000000 * (count + 1) / total) for total over count and under 9e15, three decimals at a time so that no long overflows."""
    out, rest = F.call_function("div", count + 1, total), (count + 1) % total
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, total), (rest * 1000) % total
    return out + 1


def contribution(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(
    docs: DataFrame,
    least_rows: int = 3,
    top_terms: int = 200,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """lang, source, part, item, value, rank: how each source's terms differ from those of its language's other sources.

    Terms are runs of letters A-Z, a-z and of all characters from U+0080 on, A-Z lower-cased. A language keeps the
    terms of at least ``least_rows`` of its rows. With p a term's share in a source, smoothed by one, in parts of
    1e9 and rounded down (plus 1), part ``pair`` has the sum over kept terms of floor((p - q)^2 / q) against every
    other source q, and part ``term`` the ``top_terms`` largest of these for terms more frequent than in the whole
    language. Ranks break ties by item. Null language, source and text are ''; a row without terms still makes its
    group known; a language without kept terms has pairs of value 0; one with a single source has none. Repeated
    rows count each; an empty table gives an empty result; other columns are ignored. Long texts are split in parts
    of a megabyte. A hot source or term is summed within tasks before anything is shuffled.
    """
    counts = term_counts(docs, text_col, lang_col, source_col)
    # the pivot: one row per kept term, with its counts by source
    terms = cut(
        counts.groupBy("lang", "term")
        .agg(F.sum("d").alias("d"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
        .filter(F.col("d") >= least_rows)
        .select("lang", F.col("term").cast("string").alias("term"), "by_source")
    )
    group = (F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    totals = terms.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sides = (
        docs.select(*group).distinct()
        .join(totals, ["lang", "source"], "left")
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
        .join(kept, "lang", "left")
        .select("lang", F.col("s.source").alias("sources"), F.col("s.n").alias("totals"), F.coalesce("v", F.lit(0)).alias("v"))
    )
    sides = cut(sides)
    groups = sides.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0]
    if groups <= BROADCAST_GROUPS:
        joined = terms.join(F.broadcast(sides), "lang")
    else:
        salted = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = terms.withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(salted, ["lang", "salt"])
    wide = joined.withColumn("n", F.transform("sources", lambda s: F.coalesce(F.element_at("by_source", s), F.lit(0))))
    wide = wide.withColumn("p", F.zip_with("n", "totals", lambda n, total: share(n, total + F.col("v"))))

    # floor((p - q)^2 / q) = floor(p^2 / q) - 2 p + q, and floor(p^2 / p) = p, so the sums of quotients hold all that is needed
    quotients = F.flatten(F.transform(F.transform("p", lambda p: p * p), lambda s: F.transform("p", lambda q: F.call_function("div", s, q))))
    # an outer generator: for others, an inferred filter on the array's size would make the array twice
    emitted = wide.select("lang", quotients.alias("f")).select("lang", F.posexplode_outer("f").alias("at", "f"))
    sums = cut(emitted.groupBy("lang", "at").agg(F.sum("f").alias("value")))
    pairs = (
        sides.select("lang", "sources", F.posexplode("sources").alias("i", "source"))
        .select("lang", "source", "i", F.size("sources").alias("m"), F.posexplode("sources").alias("j", "item"))
        .filter("i != j")
    )
    for name, i, j in (("both", "i", "j"), ("left", "i", "i"), ("right", "j", "j")):
        side = sums.select("lang", F.col("at").alias(name + "_at"), F.col("value").alias(name))
        pairs = pairs.withColumn(name + "_at", F.col(i) * F.col("m") + F.col(j)).join(side, ["lang", name + "_at"], "left")
    value = F.coalesce(F.col("both") - 2 * F.col("left") + F.col("right"), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))

    add = lambda a, b: a + b
    whole = share(F.aggregate("n", F.lit(0).cast("long"), add), F.aggregate("totals", F.lit(0).cast("long"), add) + F.col("v"))
    over = (
        wide.withColumn("q", whole)
        .select("lang", F.col("term").alias("item"), "q", F.explode_outer(F.arrays_zip("sources", "n", "p")).alias("s"))
        .filter((F.col("s.n") > 0) & (F.col("s.p") > F.col("q")))
        .select("lang", F.col("s.sources").alias("source"), F.lit("term").alias("part"), "item", contribution(F.col("s.p"), F.col("q")).alias("value"))
    )
    # the best of each bucket of terms first, so that no task orders all of a source's terms
    order = [F.col("value").desc(), F.col("item")]
    bucket = F.pmod(F.xxhash64("item"), F.lit(SALTS))
    best = over.withColumn("r", F.row_number().over(W.partitionBy("lang", "source", bucket).orderBy(*order))).filter(F.col("r") <= top_terms).drop("r")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(*order)).alias("rank")
    return pairs.select("*", rank).unionByName(best.select("*", rank).filter(F.col("rank") <= top_terms))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') lang, coalesce(source, '') source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ts
  FROM documents),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) term FROM d) GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT l.lang, count(k.term) v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY 1),
occ AS (SELECT lang, source, term, count(*) n FROM (SELECT lang, source, unnest(ts) term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT total FROM g LEFT JOIN occ USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) n, 1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 1) // (t.total + v.v) p
  FROM g JOIN kept k USING (lang) LEFT JOIN occ o USING (lang, source, term) JOIN tot t USING (lang, source) JOIN v USING (lang)),
whole AS (
  SELECT x.lang, x.term, 1 + 1000000000::HUGEINT * (x.n + 1) // (t.total + v.v) q
  FROM (SELECT lang, term, sum(n)::HUGEINT n FROM occ GROUP BY ALL) x
  JOIN (SELECT lang, sum(total)::HUGEINT total FROM tot GROUP BY 1) t USING (lang) JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(pair.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (
  SELECT p.lang, p.source, 'term' part, p.term item, ((p.p - q) * (p.p - q) // q)::BIGINT AS value
  FROM p JOIN whole w ON p.lang = w.lang AND p.term = w.term WHERE p.n > 0 AND p.p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""
