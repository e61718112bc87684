"""Token counts: BPE by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.llm.common import table

NONE = np.int32(2**31 - 1)
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 600_000
#: Characters whose pre-tokens are merged together.
SETTLED = 2_000_000
ODD = re.compile("[\x1c-\x1f]")
BLANK = regex.compile(r"\p{White_Space}")


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PairTable:
    """Hash table from a pair of symbols to the rank of its merge and the merged symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, bits: int = 20):
        keys = (left.astype(np.int64) << 20) | right
        rank = np.arange(len(keys), dtype=np.int32)
        self.bits, self.levels = bits, []
        while len(keys):
            slot = self._slot(keys, len(self.levels))
            _, at = np.unique(slot, return_index=True)
            k = np.full(1 << bits, -1, np.int64)
            r = np.full(1 << bits, NONE, np.int32)
            m = np.zeros(1 << bits, np.int32)
            k[slot[at]], r[slot[at]], m[slot[at]] = keys[at], rank[at], merged[at]
            self.levels.append((k, r, m))
            rest = np.ones(len(keys), bool)
            rest[at] = False
            keys, rank, merged = keys[rest], rank[rest], merged[rest]

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        mult = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[level % 4])
        return ((keys.astype(np.uint64) * mult) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.int64) << 20) | right
        rank = np.full(len(keys), NONE, np.int32)
        merged = np.zeros(len(keys), np.int32)
        for level, (k, r, m) in enumerate(self.levels):
            slot = self._slot(keys, level)
            hit = k[slot] == keys
            rank[hit], merged[hit] = r[slot[hit]], m[slot[hit]]
        return rank, merged


class Bpe:
    """A tokenizer file's pre-tokenisation and merges, for counting only."""

    def __init__(self, spec: dict):
        model = spec["model"]
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
        if (model["type"], split["type"], byte_level["type"], kinds) != ("BPE", "Split", "ByteLevel", ["NFC", "Replace", "Lowercase"]) or not plain:
            raise ValueError("the tokenizer file is not of the kind that is counted here")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = _byte_chars()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[chars[b] + suffix] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32)
        self.pairs = PairTable(*ids.T)
        # blanks are those of Unicode, as the tokenizer's own regex engine has it
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def merge(self, words: list[str]) -> np.ndarray:
        """Symbols left of each word when no pair can merge: every word's lowest-rank pair merges in each step."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(size) - 1
        sym[ends] = self.final[flat[ends]]
        left, alive = np.ones(len(raw), np.int64), np.arange(len(raw))
        while len(alive):
            starts = np.cumsum(size) - size
            rank = np.full(len(sym), NONE, np.int32)
            merged = np.zeros(len(sym), np.int32)
            inside = np.ones(len(sym), bool)
            inside[starts + size - 1] = False
            at = np.flatnonzero(inside)
            rank[at], merged[at] = self.pairs.look_up(sym[at], sym[at + 1])
            low = np.minimum.reduceat(rank, starts)
            going = low != NONE
            if not going.all():
                left[alive[~going]] = size[~going]
                keep = np.repeat(going, size)
                sym, rank, merged = sym[keep], rank[keep], merged[keep]
                alive, size, low = alive[going], size[going], low[going]
                if not len(alive):
                    break
            owner = np.repeat(np.arange(len(alive)), size)
            hits = np.flatnonzero(rank == low[owner])
            # of overlapping pairs (a run of one symbol) every second merges, from the left
            new_run = np.ones(len(hits), bool)
            new_run[1:] = np.diff(hits) != 1
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run_start) % 2 == 0]
            sym[hits] = merged[hits]
            stay = np.ones(len(sym), bool)
            stay[hits + 1] = False
            sym = sym[stay]
            size = size - np.bincount(owner[hits], minlength=len(alive))
        return left

    def pieces(self, text: str, most: int = 1 << 20) -> Iterator[str]:
        """text in parts of about ``most`` characters that begin at a blank."""
        at = 0
        while len(text) - at > most:
            cut = BLANK.search(text, at + most)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def pre_tokens(self, chunk: str) -> list[str]:
        if not chunk.isascii():
            # lower() would look at a sigma's place in the word
            chunk = unicodedata.normalize("NFC", chunk).replace("\u03a3", "\u03c3")
        return self.words(chunk.lower())

    def chunks(self, text: str) -> tuple[list[str], int]:
        """text cut at blanks, which no pre-token holds, and the number of added tokens."""
        parts, n = [text], 0
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            n = len(parts) - 1
        out: list[str] = []
        for p in parts:
            # split() also takes four control characters for blanks that are none here
            out += BLANK.split(p) if ODD.search(p) else p.split()
        return out, n

    def learn(self, chunks: set[str]) -> None:
        """Count the symbols of chunks that aren't known."""
        again = chunks.intersection(self.older)
        self.known.update((c, self.older[c]) for c in again)
        new = list(chunks - again)
        words, n = [], []
        for c in new:
            w = self.pre_tokens(c)
            words += w
            n.append(len(w))
        distinct = dict.fromkeys(words)
        sizes = dict(zip(distinct, self.merge(list(distinct)).tolist(), strict=True)) if distinct else {}
        each = np.fromiter(map(sizes.__getitem__, words), np.int64, len(words))
        total = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(np.array(n, np.int64)) if n else np.zeros(0, np.int64)
        self.known.update(zip(new, (total[ends] - total[ends - n]).tolist() if n else [], strict=True))

    def count(self, texts: Iterable[str | None]) -> list[int]:
        total: list[int] = []
        held: list[tuple[int, list[str]]] = []
        missing: set[str] = set()
        size = 0

        def settle() -> None:
            if missing:
                self.learn(missing)
                missing.clear()
            for i, chunks in held:
                total[i] += sum(map(self.known.__getitem__, chunks))
            held.clear()
            if len(self.known) > REMEMBERED:
                self.older, self.known = self.known, {}

        for i, text in enumerate(texts):
            total.append(0)
            for piece in self.pieces(text or ""):
                chunks, added = self.chunks(piece)
                total[i] += added
                held.append((i, chunks))
                missing |= set(chunks).difference(self.known)
                size += len(piece)
                if size > SETTLED:
                    settle()
                    size = 0
        settle()
        return total


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8) and n_tokens of every row's whole text.

    Counts are those of the tokenizer file (byte-level BPE after NFC, blanks and lower case) without
    begin and end tokens; its added tokens' strings inside a text count as one token each. A null
    text counts as empty: 0 and 0. Null ids, repeated rows and ties are rows like any other; an
    empty table gives an empty result; further columns are ignored. Rows stream through Arrow
    batches; a text of any length is worked on in parts of about a million characters.
    """
    sc = docs.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = sc.broadcast(json.load(file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(spec.value)
        for batch in batches:
            counts = bpe.count(t.as_py() for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    )
    out = slim.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def op4_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
