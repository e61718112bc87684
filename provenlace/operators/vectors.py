"""Nearest vectors of stated queries: blocks of queries against blocks of all rows, as matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Cosines that a task holds at once.
HELD = 1 << 20


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float)


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    usable = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(F.filter(vec_col, lambda x: x != 0)) > 0)
    return df.filter(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def _dealt(queries: DataFrame, rows: DataFrame, query_block: int, row_block: int):
    """Every block of queries beside every block of rows, cogrouped."""
    n_queries, n_rows = (max(1, -(-df.count() // size)) for df, size in ((queries, query_block), (rows, row_block)))
    deal = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n))).withColumn(
        other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    )
    left, right = deal(queries, "qb", n_queries, "rb", n_rows), deal(rows, "rb", n_rows, "qb", n_queries)
    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb"))


def _scored(q: pd.DataFrame, r: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
    """Rounded cosines of some queries at a time with all rows, so that a task holds about HELD of them at once; a row's own is -inf."""
    a, b, ids, own = _matrix(q["v"]), _matrix(r["v"]), r["id"].to_numpy(), q["id"].to_numpy()
    a /= np.linalg.norm(a, axis=1)[:, None]
    b /= np.linalg.norm(b, axis=1)[:, None]
    some = max(1, HELD // len(ids))
    for i in range(0, len(own), some):
        part = slice(i, i + some)
        out = np.round(a[part] @ b.T, 6)
        out[own[part][:, None] == ids] = -np.inf
        yield part, out


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 2048, row_block: int = 16384) -> DataFrame:
    """(question_id, node_id, score, rank): each query's k rows of the largest cosine, exactly; ties by the smaller id.

    A query does not find the row of its own id. Null ids and vectors, and vectors of length 0, are left out on both sides; scores are
    rounded to six places before they are ranked. Every block of queries meets every block of rows in one task of bounded size, which
    passes on k rows a query only, so rows are sent as often as there are blocks of queries.
    """
    queries, rows = _usable(queries, id_col, vec_col), _usable(rows, id_col, vec_col)

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"question_id": [], "node_id": [], "score": []})
        r = r.sort_values("id")
        ids, own, most, found = r["id"].to_numpy(), q["id"].to_numpy(), min(k, len(r)), []
        for part, out in _scored(q, r):
            at = np.argsort(-out, axis=1, kind="stable")[:, :most]
            found.append((np.repeat(own[part], most), ids[at].ravel(), np.take_along_axis(out, at, 1).ravel()))
        found = pd.DataFrame(dict(zip(("question_id", "node_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))
        return found[np.isfinite(found["score"])]

    part = _dealt(queries, rows, query_block, row_block).applyInPandas(best, "question_id long, node_id long, score double")
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), "node_id"))
    return part.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def cosine_scaled(queries: DataFrame, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 256, row_block: int = 4096) -> DataFrame:
    """(question_id, node_id, s): each query's cosines with all other rows, scaled to 0 to 1 between its least and its largest; 0 where all are the same.

    What is left out is what ``cosine_topk`` leaves out. A pair per query and row is the result, so pairs are never shuffled: one pass over the blocks finds
    each query's ends, which its vector carries into a second one that puts the pairs out, at most query_block x row_block in a task at once.
    """
    queries, rows = _usable(queries, id_col, vec_col), _usable(rows, id_col, vec_col)

    def least_and_most(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"id": [], "lo": [], "hi": []})
        own = q["id"].to_numpy()
        found = [(own[part], np.where(np.isfinite(out), out, np.inf).min(1), out.max(1)) for part, out in _scored(q, r)]
        found = pd.DataFrame(dict(zip(("id", "lo", "hi"), map(np.concatenate, zip(*found, strict=True)), strict=True)))
        return found[np.isfinite(found["hi"])]

    def pairs(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"question_id": [], "node_id": [], "s": []})
        ids, own, lo, hi, found = r["id"].to_numpy(), q["id"].to_numpy(), q["lo"].to_numpy()[:, None], q["hi"].to_numpy()[:, None], []
        for part, out in _scored(q, r):
            flat = hi[part] == lo[part]
            s = np.where(flat, 0.0, (out - lo[part]) / np.where(flat, 1.0, hi[part] - lo[part]))
            x, y = np.nonzero(np.isfinite(out))
            found.append((own[part][x], ids[y], s[x, y]))
        return pd.DataFrame(dict(zip(("question_id", "node_id", "s"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    ends = _dealt(queries, rows, query_block, row_block).applyInPandas(least_and_most, "id long, lo double, hi double")
    ends = ends.groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return _dealt(queries.join(ends, "id"), rows, query_block, row_block).applyInPandas(pairs, "question_id long, node_id long, s double")
