"""Sharding: balanced label propagation over linked documents, under exact row quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.llm.common import bucket_count, cut, fresh, gapless_rank, hash_bucket, table


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (at + 1).cast("int"))


def _range_of(ends: list[int], rank: Column) -> Column:
    """The number of ends that are at most rank: the index of the range rank falls in."""
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= rank)).cast("int")


def _allowed(moves: dict[tuple[int, int], int], room: list[int], k: int) -> list[int]:
    """How many of the moves a to b may go ahead: swaps with b to a, then what room b has."""
    swaps = {(a, b): min(n, moves.get((b, a), 0)) for (a, b), n in moves.items()}
    room = list(room)
    out = [0] * (k * k)
    for (a, b), n in sorted(moves.items()):
        more = min(n - swaps[a, b], room[b])
        room[b] -= more
        out[a * k + b] = swaps[a, b] + more
    return out


def balanced_shards(rows: DataFrame, link: str, identity: list[str], shards: int, rounds: int = 3) -> DataFrame:
    """Add shard to rows so that shard sizes differ by one row at most and few links are cut.

    Rows with the same non-null ``link`` are linked. Linked rows start on shards dealt out evenly.
    In each round every link group counts its rows by shard, and rows ask to move to the shard
    that has most of them (ties by a hash). Moves from a to b go ahead as far as they swap with
    moves from b to a or b has room under its quota; a group's moves are ranked together. Rows
    without links then fill the shards up to their quotas. A group larger than half a quota is
    split into pieces of that size, and each piece moves by itself.

    identity: columns that order rows among equals (rows equal in all of them are interchangeable).
    rows is read more than once and must be cut. Driver-side state: counts by pair of shards.
    """
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    buckets = bucket_count(total)
    multi = cut(rows.filter(F.col(link).isNotNull()).groupBy(link).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1"))
    marked = cut(rows.join(multi, link, "left").withColumn("__h", F.xxhash64(*identity)))
    pieces = F.ceil(F.col("__n") / F.lit(max(1, quota[0] // 2)))
    linked = marked.filter("__n > 1").withColumn("__piece", F.xxhash64(link, F.pmod("__h", pieces)))
    # rows of one piece rank together; a large piece is dealt over several buckets
    linked = linked.withColumn("__b", hash_bucket(buckets, "__piece", F.pmod("__h", F.ceil(F.col("__n") / 64))))
    order = ["__piece", "__h", *identity]
    linked = gapless_rank(linked, [], "__b", order, "__rank")
    linked = cut(linked.withColumn("shard", (F.col("__rank") % shards).cast("int")).drop("__rank"))
    for _ in range(rounds):
        held = linked.groupBy("__piece", "shard").agg(F.count(F.lit(1)).alias("__c"))
        wish = cut(
            held.groupBy("__piece").agg(F.max_by("shard", F.struct("__c", F.xxhash64("__piece", "shard"))).alias("__to"))
        )
        asked = cut(linked.join(wish, "__piece"))
        flows = {(r["shard"], r["__to"]): r["n"] for r in asked.groupBy("shard", "__to").agg(F.count(F.lit(1)).alias("n")).collect()}
        load = [sum(n for (a, _), n in flows.items() if a == s) for s in range(shards)]
        moves = {ab: n for ab, n in flows.items() if ab[0] != ab[1]}
        if not moves:
            break
        allowed = _allowed(moves, [q - x for q, x in zip(quota, load, strict=True)], shards)
        staying, moving = asked.filter("shard = __to"), asked.filter("shard <> __to")
        moving = gapless_rank(moving, ["shard", "__to"], "__b", order, "__rank")
        goes = F.col("__rank") < _pick(allowed, F.col("shard") * shards + F.col("__to"))
        moving = moving.withColumn("shard", F.when(goes, F.col("__to")).otherwise(F.col("shard"))).drop("__rank")
        linked = cut(staying.unionByName(moving).drop("__to"))
    placed = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends, at = [], 0
    for s in range(shards):
        at += quota[s] - placed.get(s, 0)
        ends.append(at)
    single = marked.filter("__n IS NULL").withColumn("__b", hash_bucket(buckets, "__h", F.lit(1)))
    single = gapless_rank(single, [], "__b", ["__h", *identity], "__rank").withColumn("shard", _range_of(ends, F.col("__rank")))
    return linked.select(*rows.columns, "shard").unionByName(single.select(*rows.columns, "shard"))


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Shard and slot of every row: id, size, text_crc32, law, shard, slot, grown_shard.

    Documents with equal texts are linked (null texts are one text of their own). The law is
    ``rows``: shards hold the same number of rows, or one more. size is the text's UTF-8 bytes
    (none for null) plus 1. slot numbers the rows of a shard from 0 without gaps. grown_shard is
    null under this law. Null ids and repeated rows are rows like any other; an empty table gives
    an empty result; of further columns those named in ``carry`` are kept. Reruns give the same result.
    """
    t = F.col(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(t, F.lit("")).cast("binary")).cast("long").alias("crc"),
            F.coalesce(F.unhex(F.md5(t.cast("binary"))), F.lit(b"null").cast("binary")).alias("link"),
            *carry,
        )
    )
    identity = ["id", "size", "crc", "link", *carry]
    spread = cut(balanced_shards(rows, "link", identity, shards, rounds))
    spread = spread.withColumn("__b", hash_bucket(bucket_count(rows.count()), *identity))
    ranked = gapless_rank(spread, ["shard"], "__b", identity, "slot")
    return ranked.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), *carry,
    )


def sharded_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard, as ``shard_documents`` has them.

    Every row, repeated ones too, gets a place of its own; all columns are kept, those named like a new one are replaced.
    """
    own = fresh("row")
    rows = cut(docs.withColumn(own, F.monotonically_increasing_id()))
    placed = shard_documents(rows, shards, id_col, text_col, rounds, carry=(own,)).drop(id_col)
    return rows.drop(*[c for c in placed.columns if c != own]).join(placed, own).drop(own)


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
