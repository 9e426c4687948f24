"""Token counts by rank-synchronous byte-pair merging of ragged arrays.

The vocabulary file's normaliser and splitter rules are applied to whole texts; each distinct
pre-token of a batch becomes a row of symbol ids in one flat array. In each round every row's
lowest-rank pair is found at once and all its occurrences in the row merge (left to right,
without overlap); rounds end when no row has a mergeable pair. A document's count is the sum
over its pre-tokens, and one for each special token's string in it.

Edge cases: null counts as empty text (0 tokens); white space only gives 0 tokens; texts of
any length are split whole; repeated rows and null ids each keep their row; an empty table gives no rows; other columns are
ignored; the cache of pre-token counts is bounded and only saves time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from . import textblocks as tb
from .tables import table, texts_of

LIMIT = 2048
CACHE_ENTRIES = 1_000_000
NONE = np.int64(2**62)
#: Letters up to here are the same in all Unicode versions.
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def listed(codes: list[int]) -> str:
    """Sorted codes as ranges of a character class."""
    at = np.array(codes)
    first = np.concatenate([[True], np.diff(at) != 1])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(at[first].tolist(), at[np.concatenate([first[1:], [True]])].tolist(), strict=True))


def split_pattern(pattern: str) -> str:
    """The pattern with the letter and number classes of the tokenizer library's Unicode version."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name in ("L", "N"):
        own = {ord(c) for c in regex.findall(rf"\p{{{name}}}", every)}
        pieces = pre_tokenizers.Split(Regex(rf"\p{{{name}}}+"), "removed", invert=True).pre_tokenize_str(every)
        theirs = {ord(c) for piece, _ in pieces for c in piece}
        more, less = sorted(theirs - own), sorted(own - theirs)
        if more or less:
            inside = rf"[\p{{{name}}}{listed(more) if more else ''}]" + (f"--[{listed(less)}]" if less else "")
            pattern = pattern.replace(rf"\p{{{name}}}", f"[{inside}]")
    return pattern


class WordBPE:
    """A BPE vocabulary with word ends, a Split pre-tokeniser and NFC, white-space and lower-case rules."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # a pair listed twice keeps its last rank, as a map filled in order would
        last = {k: i for i, k in enumerate(key.tolist())}
        self.key = np.array(sorted(last), np.int64)
        self.rank = np.array([last[k] for k in self.key.tolist()], np.int64)
        self.made = made
        steps = spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("another normaliser than NFC, Replace, Lowercase")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.rule = split["pattern"]["Regex"]
        self.pattern = regex.compile(self.rule)
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in special)) if special else None
        self.marks = special
        self.cache: dict[str, int] = {}

    @cached_property
    def any_pattern(self) -> regex.Pattern:
        return regex.compile(split_pattern(self.rule), regex.V1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word; words are not empty."""
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[raw]
        last = np.cumsum(lengths) - 1
        symbol[last] = self.final[raw[last]]
        row = np.repeat(np.arange(len(words)), lengths)
        counts = np.ones(len(words), np.int64)
        follows = np.concatenate([row[1:] == row[:-1], [False]])
        rank = np.full(len(symbol), NONE)
        at = np.flatnonzero(follows)
        rank[at] = self.ranks(symbol[at], symbol[at + 1])
        while len(symbol):
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            size = np.diff(np.concatenate([start, [len(row)]]))
            best = np.minimum.reduceat(rank, start)
            counts[row[start]] = size
            going = best < NONE
            if not going.any():
                break
            if not going.all():  # settled rows leave
                stay = np.repeat(going, size)
                symbol, row, rank = symbol[stay], row[stay], rank[stay]
                start = np.cumsum(size[going]) - size[going]
                size, best = size[going], best[going]
            hit = rank == np.repeat(best, size)
            # an overlapping run of hits (x x x) merges its 1st, 3rd, ... pair
            idx = np.flatnonzero(hit)
            run_start = np.concatenate([[True], (idx[1:] != idx[:-1] + 1) | (row[idx[1:]] != row[idx[:-1]])])
            place = np.arange(len(idx)) - np.flatnonzero(run_start)[np.cumsum(run_start) - 1]
            idx = idx[place % 2 == 0]
            symbol[idx] = self.made[rank[idx]]
            keep = np.ones(len(symbol), bool)
            keep[idx + 1] = False
            touched = np.zeros(len(symbol), bool)
            touched[idx] = True
            symbol, row, rank, touched = symbol[keep], row[keep], rank[keep], touched[keep]
            # only pairs at a merged symbol change
            before = np.flatnonzero(touched) - 1
            again = np.unique(np.concatenate([np.flatnonzero(touched), before[before >= 0]]))
            rank[again] = NONE
            again = again[again < len(row) - 1]
            again = again[row[again] == row[again + 1]]
            rank[again] = self.ranks(symbol[again], symbol[again + 1])
        return counts

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text.lower())
        # the file's own normaliser, and its classes too where Unicode versions differ
        text = self.normalise(text)
        return (self.any_pattern if BEYOND_LATIN.search(text) else self.pattern).findall(text)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, without added ones."""
        extra = [0] * len(texts)
        split: list[list[str]] = []
        for k, text in enumerate(texts):
            if self.special is not None and any(m in text for m in self.marks):
                parts = self.special.split(text)
                extra[k] = len(parts) - 1
                split.append([w for part in parts for w in self.split(part)])
            else:
                split.append(self.split(text))
        known = self.cache
        if len(known) > CACHE_ENTRIES:
            known.clear()
        fresh = list({w for words in split for w in words if w not in known})
        if fresh:
            known.update(zip(fresh, self.merge([w.encode() for w in fresh]).tolist(), strict=True))
        get = known.__getitem__
        return [sum(map(get, words)) + n for words, n in zip(split, extra, strict=True)]


@lru_cache(2)
def loaded(path: str) -> WordBPE:
    """One model for all tasks of a Python worker."""
    return WordBPE(path)


def counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for block in tb.blocks(batches):
            raw = block.data.tobytes()
            texts = [raw[s:e].decode() for s, e in zip(block.starts.tolist(), block.ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [tb.column(block.rows, "doc_id"), pa.array(block.ends - block.starts), pa.array(model.count(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for the vocabulary file (a path on every executor)."""
    counts = texts_of(docs).mapInArrow(counter(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
