"""Cross-tokenizer alignment: bitsets of token ends; AND gives shared cuts, ranks map cuts to token ranges."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenlace.llm.common import cut, table
from provenlace.llm.token_counts import _byte_chars

#: Characters of text after which a block of rows is closed; a longer text is a block of its own.
BLOCK = 8 << 20
#: Chunks whose bitsets are made together, and that are encoded as one string.
SLICE, RUN = 20_000, 64
#: Neither tokenizer has a token across a blank that follows something else than white space.
CHUNK = re.compile(r"(?<=\S) ")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Bits:
    """A packed bitset over byte positions, with rank by popcount."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, positions: np.ndarray, size: int) -> Bits:
        flags = np.zeros((size + 64) // 64 * 64, bool)
        flags[positions] = True
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def positions(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits set before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte = {c: b for b, c in _byte_chars().items()}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        added = {t["id"] for t in json.loads(a_json)["added_tokens"]}
        for entry, i in vocab.items():
            if i not in added:
                self.a_bytes[i] = bytes(byte[c] for c in entry)
        self.blank = self.b.piece_to_id("▁")
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            hexa = BYTE_PIECE.fullmatch(piece)
            self.b_bytes.append(bytes([int(hexa[1], 16)]) if hexa and self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_len, self.b_len = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.decimal = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]

    def encode(self, runs: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Token ids of each run, which begins with a blank; B adds that blank itself."""
        a = [e.ids for e in self.a.encode_batch_fast(runs, add_special_tokens=False)]
        b = self.b.encode([r[1:] for r in runs], num_threads=1)
        # of nothing, B makes nothing; inside a text a last blank is a piece
        return a, [ids if run != " " else [self.blank] for run, ids in zip(runs, b, strict=True)]

    def faithful(self, run: str, a: list[int], b: list[int]) -> bool:
        raw = run.encode("utf-8", "surrogatepass")
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))


class Aligned:
    """Chunks with their tokens, groups and links; chunks of ``bad`` are not given back by their tokens."""

    def __init__(self, chunks: list[str], both: Tokenizers):
        self.n = np.zeros((len(chunks), 4), np.int64)  # tokens of A and of B, groups, links
        self.bad = np.zeros(len(chunks), bool)
        self.groups = [b""] * len(chunks)
        links: list[np.ndarray] = []
        for i in range(0, len(chunks), SLICE):
            links.append(self._slice(chunks, i, min(len(chunks), i + SLICE), both))
        self.links = np.concatenate([np.zeros(0, np.int64), *links])

    def _slice(self, chunks: list[str], lo: int, hi: int, both: Tokenizers) -> np.ndarray:
        runs, members = [], []
        held: list[int] = []

        def close() -> None:
            if held:
                runs.append("".join(chunks[k] for k in held))
                members.append(held.copy())
                held.clear()

        for k in range(lo, hi):
            if chunks[k][-1].isspace():  # only at the end of a text; white space there would meet the next chunk's blank
                close()
                held.append(k)
                close()
            else:
                held.append(k)
                if len(held) == RUN:
                    close()
        close()
        a_ids, b_ids, sound = [], [], []
        for run, who, a, b in zip(runs, members, *both.encode(runs), strict=True):
            if both.faithful(run, a, b):
                a_ids += a
                b_ids += b
                sound += who
                continue
            for k, a, b in zip(who, *both.encode([chunks[k] for k in who]), strict=True):
                if both.faithful(chunks[k], a, b):
                    a_ids += a
                    b_ids += b
                    sound.append(k)
                else:
                    self.bad[k] = True
        if not sound:
            return np.zeros(0, np.int64)
        a, b, who = (np.array(x, np.int64) for x in (a_ids, b_ids, sound))
        a_end, b_end = np.cumsum(both.a_len[a]), np.cumsum(both.b_len[b])
        size = int(a_end[-1])
        a_bits, b_bits = Bits.of(a_end - 1, size), Bits.of(b_end - 1, size)
        shared, either = (a_bits & b_bits).positions(), a_bits | b_bits
        # a chunk's end is the end of the tokens that fill it
        lengths = np.fromiter((len(chunks[k].encode("utf-8", "surrogatepass")) for k in sound), np.int64, len(sound))
        ends = np.cumsum(lengths)
        upto = np.stack([a_bits.rank(ends), b_bits.rank(ends), (a_bits & b_bits).rank(ends), either.rank(ends)], axis=1)
        self.n[who] = np.diff(upto, axis=0, prepend=0)
        a_cut, b_cut = a_bits.rank(shared + 1).tolist(), b_bits.rank(shared + 1).tolist()
        a_text, b_text = [both.decimal[i] for i in a_ids], [both.decimal[i] for i in b_ids]
        a_at = b_at = 0
        groups = []
        for x, y in zip(a_cut, b_cut, strict=True):
            groups.append(f"{','.join(a_text[a_at:x])}|{','.join(b_text[b_at:y])}")
            a_at, b_at = x, y
        last = 0
        for k, g in zip(sound, upto[:, 2].tolist(), strict=True):
            self.groups[k] = ";".join(groups[last:g]).encode()
            last = g
        # between two neighbouring ends of either kind stands one token of A and one of B: a link
        at = either.positions()
        return (a[a_bits.rank(at)] << 32) | b[b_bits.rank(at)]


def encode_blocks(docs: DataFrame, a_json: str, b_model: bytes, id_col: str, text_col: str) -> DataFrame:
    """One row per block of rows: each row's figures, its chunks by number, and the block's links with how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast((a_json, b_model))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(*shared.value)
        ids: list = []
        docs_codes: list[list[int]] = []
        number: dict[str, int] = defaultdict(count().__next__)
        block, size = 0, 0

        def close() -> pa.RecordBatch:
            chunks = list(number)
            aligned = Aligned(chunks, both)
            times = np.zeros(len(chunks), np.int64)
            n = np.zeros((len(ids), 4), np.int64)
            digests, kept = [], []
            for i, codes in enumerate(docs_codes):
                c = np.array(codes, np.int64)
                if not len(c) or aligned.bad[c].any():
                    digests.append("")
                    kept.append(np.zeros(0, np.int32))
                    continue
                n[i] = aligned.n[c].sum(0)
                times += np.bincount(c, minlength=len(chunks))
                digests.append(hashlib.sha256(b";".join(map(aligned.groups.__getitem__, codes))).hexdigest())
                kept.append(c.astype(np.int32))
            per_chunk = aligned.n[:, 3]
            pairs, at = np.unique(aligned.links, return_inverse=True)
            weight = np.bincount(at, weights=np.repeat(times, per_chunk), minlength=len(pairs)).astype(np.int64)
            lists = {
                "id": ids, **{c: n[:, j] for j, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "digest": digests,
                "n_chunks": np.fromiter(map(len, kept), np.int64, len(kept)),
                "sizes": [sum(map(len, kept)), len(chunks), len(aligned.links)], "pair": pairs, "times": weight,
            }
            binary = {"chunks": np.concatenate([np.zeros(0, np.int32), *kept]), "links": per_chunk.astype(np.int32), "link": at.astype(np.int32)}
            key = f"{TaskContext.get().partitionId()}-{block}"
            kinds = {"id": schema.field("id").type, "digest": pa.list_(pa.string())}
            arrays = [pa.array([key])]
            arrays += [pa.array([v], kinds.get(k, pa.list_(pa.int64()))) for k, v in lists.items()]
            arrays += [pa.array([pa.compress(v.tobytes(), codec="zstd", asbytes=True)], pa.binary()) for v in binary.values()]
            return pa.RecordBatch.from_arrays(arrays, ["block", *lists, *binary])

        for b in batches:
            schema = pa.schema([("id", pa.list_(b.schema.field(0).type))])
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                if ids and size + len(text) > BLOCK:
                    yield close()
                    ids, docs_codes, number, block, size = [], [], defaultdict(count().__next__), block + 1, 0
                ids.append(i)
                codes = []
                if text:
                    first, *rest = CHUNK.split(" " + text)
                    codes = [number[first], *map(number.__getitem__, map(" ".__add__, rest))]
                docs_codes.append(codes)
                size += len(text)
        if ids:
            yield close()

    longs = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    return slim.mapInArrow(
        run, f"block string, id array<{kind}>, {longs}, digest array<string>, n_chunks array<long>, sizes array<long>, pair array<long>, times array<long>, "
        "chunks binary, links binary, link binary",
    )


def align(docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row's whole text under both tokenizers.

    A, a byte-level BPE file, encodes a blank and the text, B, a sentencepiece model, the text, before which it puts a
    blank itself; both without special tokens, whose strings inside a text are plain text. Null and empty texts, and
    texts that either tokenizer's bytes do not give back, have no tokens: zeros and ''. Null ids and repeated rows are
    rows like any other, ties for a B id's highest count all count, an empty table gives an empty result, other columns
    are ignored.

    Chunks between blanks are aligned once per block of about 8 million characters; a longer text is a block of
    its own, whose chunk numbers a task holds. Counts of id pairs are summed within blocks, then over the corpus, and
    go back to the blocks by joins, one row per block and pair; nothing is broadcast but the tokenizer files.
    """
    blocks = cut(encode_blocks(docs, a_json, b_model, id_col, text_col))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    totals = (
        blocks.select(F.explode(F.arrays_zip("pair", "times")).alias("s")).select("s.pair", "s.times").filter("times > 0")
        .groupBy("pair").agg(F.sum("times").alias("n"))
        .withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(b_id)))
    )
    back = (
        blocks.select("block", F.posexplode("pair").alias("k", "pair"))
        .join(totals, "pair", "left")
        .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.lit(False)).alias("best")))).alias("c"))
    )
    told = blocks.drop("pair", "times").join(back.select("block", F.col("c.n").alias("n"), F.col("c.best").alias("best")), "block", "left")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                values = lambda c, row=row: row.column(c)[0].values
                packed = zip(("chunks", "links", "link"), values("sizes").to_pylist(), strict=True)
                chunks, links, link = (np.frombuffer(pa.decompress(row.column(c)[0].as_buffer(), 4 * n, codec="zstd"), np.int32) for c, n in packed)
                n_chunks = values("n_chunks").to_numpy()
                sums = []
                for column in ("best", "n"):
                    known = row.column(column)[0].is_valid
                    per_pair = np.asarray(values(column).to_numpy(zero_copy_only=False), np.int64) if known else np.zeros(0, np.int64)
                    running = np.concatenate([[0], np.cumsum(per_pair[link])])
                    ends = np.cumsum(links, dtype=np.int64)
                    per_chunk = running[ends] - running[ends - links]
                    running = np.concatenate([[0], np.cumsum(per_chunk[chunks])])
                    ends = np.cumsum(n_chunks)
                    sums.append(pa.array(running[ends] - running[ends - n_chunks]))
                out = [*(values(c) for c in names[:5]), *sums, values("digest")]
                yield pa.RecordBatch.from_arrays(out, [*names[:5], "n_best", "count_sum", "groups_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    figures = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return told.mapInArrow(run, f"id {kind}, {figures}").withColumnRenamed("id", id_col)


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return align(table(spark, sf_dir, "documents"), a.read(), b.read())
