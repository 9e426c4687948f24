"""Secrets in texts: fixed patterns, and password guess costs of credential-context values.

Three base kinds come from patterns (assign, access, hex). The fourth, guess, looks at values
that stand after a credential word and an assignment sign: the cheapest way to guess the value
is found by dynamic programming over its segmentations into dictionary words (with capitals
and letter substitutions), dates, repeats, keyboard walks, sequences and brute-force spans. Words are a short list of
those that people put in passwords, and after them the whole words of a public tokeniser's vocabulary file, by rank. A
value whose cost is at least ``STRONG`` (log 10 of guesses: out of reach of slow offline guessing) is a secret and adds its span; cheap
ones, such as words, dates and placeholders, add nothing. Base spans always stay.

Edge cases: null is empty text without spans; an empty table gives no rows; a null doc_id keeps its row; texts of any length are scanned whole; spans
count code points, end exclusive, and may overlap between kinds; repeated documents each
keep their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .tables import table, texts_of

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: A credential word with its suffixes, an assignment sign and perhaps a scheme, or a scheme alone; then a quoted value or a bare one.
WORD = r"""pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|api[_-]?key|access[_-]?key|private[_-]?key"""
CONTEXT = re.compile(rf"""(?:(?i:(?:{WORD})(?:[_-][a-z0-9]{{1,20}}){{0,3}})["'\]]*\s*(?::=|=>|[:=]|\bis\b)\s*(?i:(?:bearer|basic)\s+)?|\b(?i:bearer)\s+)(?:"([^"\n]{{6,}})"|'([^'\n]{{6,}})'|`([^`\n]{{6,}})`|["'`]?([^\s"'`<>,;]{{6,}}))""", re.ASCII)
NEEDLES = (b"pass", b"pwd", b"secret", b"token", b"credential", b"auth", b"bearer", b"key")
STRONG = 10.0
SHORTEST_VALUE = 6

# Words that people put in passwords, commonest first.
COMMON = (
    "password pass admin user login welcome letmein secret test guest root master changeme default example "
    "qwerty abc dragon monkey shadow sunshine princess football baseball superman batman iloveyou love hello "
    "freedom whatever trustno hunter killer summer winter spring autumn january february march april june july "
    "august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "company server database system access token key value none null true false sample demo dummy placeholder "
    "your my the my and for you not with this that have from here key one two three four five six seven eight nine ten "
    "red blue green black white orange purple yellow silver golden computer internet windows google samsung apple "
    "michael jordan daniel thomas robert andrew joshua george charlie jessica ashley michelle amanda nicole "
    "soccer hockey ranger tigger buster ginger pepper cookie cheese coffee chocolate banana flower angel magic star"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(COMMON)))}
# Rows of a keyboard, and what stands for a letter.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
SUBSTITUTES = str.maketrans("0134578@$!|+", "oleastbasilt")
KEY_AT = {c: (r, k) for r, row in enumerate(KEY_ROWS) for k, c in enumerate(row)}
DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:(?:19|20)?\d\d))")
#: Longer words of a vocabulary are not looked up; none of those files' words is a common password.
LONGEST_WORD = 24
#: log10 of the choices at each step of a keyboard walk.
STEP = math.log10(1.6)
#: Repeats of longer periods and longer walks cost STRONG or more by themselves, so no decision depends on them.
LONGEST_PERIOD = math.ceil(STRONG) - 1
LONGEST_WALK = math.ceil((STRONG - math.log10(len(KEY_AT)) - math.log10(2)) / STEP) + 1


@lru_cache(2)
def ranked_words(vocabulary: str | None) -> dict[str, int]:
    """Ranks of COMMON, then of the whole words of a vocabulary file (a BPE model with word ends, whose ids rise as words get rarer)."""
    ranks = dict(RANK)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model["end_of_word_suffix"]
        words = sorted((i, w[: -len(end)]) for w, i in model["vocab"].items() if w.endswith(end))
        for _, word in words:
            if word.isascii() and word.isalpha() and 3 <= len(word) <= LONGEST_WORD:
                ranks.setdefault(word, len(ranks) + 1)
    return ranks


def alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def neighbours(a: str, b: str) -> bool:
    x, y = KEY_AT.get(a), KEY_AT.get(b)
    return x is not None and y is not None and abs(x[0] - y[0]) <= 1 and abs(x[1] - y[1]) <= 1 and x != y


def word_cost(piece: str, ranks: dict[str, int]) -> float | None:
    """log10 guesses of a dictionary word with its capitals and substitutions."""
    low = piece.lower()
    plain = low if low in ranks else low.translate(SUBSTITUTES)
    if plain not in ranks:
        return None
    upper = sum(c.isupper() for c in piece)
    capitals = 0.0 if not upper else math.log10(2) if upper == len(piece) or piece[0].isupper() and upper == 1 else math.log10(math.comb(len(piece), min(upper, len(piece) - upper)) + 2)
    swaps = sum(a != b for a, b in zip(low, plain, strict=True))
    return math.log10(ranks[plain] + 1) + capitals + swaps * math.log10(2)


def guess_cost(value: str, ranks: dict[str, int] = RANK, longest: int = LONGEST_WORD) -> tuple[float, list[tuple[str, int, int]]]:
    """Least log10 guesses over all segmentations, and the segments (kind, start, end) that reach it."""
    n = len(value)
    low = value.lower()
    best = [0.0] + [math.inf] * n
    came: list[tuple[str, int, int] | None] = [None] * (n + 1)

    def offer(kind: str, i: int, j: int, cost: float) -> None:
        total = best[i] + cost + (math.log10(2) if i else 0.0)  # each further segment doubles the arrangements
        if total < best[j]:
            best[j], came[j] = total, (kind, i, j)

    # how far the value goes on repeating itself with each period
    reach = [[0] * (n + LONGEST_PERIOD + 1) for _ in range(LONGEST_PERIOD + 1)]
    for period in range(1, LONGEST_PERIOD + 1):
        row = reach[period]
        for i in range(n - period - 1, -1, -1):
            row[i] = row[i + 1] + 1 if value[i] == value[i + period] else 0
    for i in range(n):
        for j in range(i + 2, min(n, i + longest) + 1):
            cost = word_cost(value[i:j], ranks)
            if cost is not None:
                offer("word", i, j, cost)
        for j in range(i + 4, min(n, i + 10) + 1):
            if DATE.fullmatch(value, i, j):
                offer("date", i, j, math.log10(366 * 120) if j - i > 4 else math.log10(120))
        for period in range(1, min(LONGEST_PERIOD, (n - i) // 2) + 1):
            times = reach[period][i] // period + 1
            if times >= 2:
                unit = sum(math.log10(alphabet(c)) for c in value[i : i + period])
                # a next segment can only claim the last copies of a long run
                for t in range(2 if period > 1 else 3, times + 1) if times <= 256 else (*range(2, 65), *range(times - 191, times + 1)):
                    offer("repeat", i, i + t * period, unit + math.log10(t))
        j = i + 1
        while j < min(n, i + LONGEST_WALK) and neighbours(low[j - 1], low[j]):
            j += 1
            if j - i >= 3:
                offer("walk", i, j, math.log10(len(KEY_AT)) + math.log10(2) + (j - i - 1) * STEP)
        for delta in (1, -1):
            j = i + 1
            while j < n and ord(low[j]) - ord(low[j - 1]) == delta:
                j += 1
                if j - i >= 3:
                    offer("sequence", i, j, math.log10(alphabet(low[i])) + math.log10(2 * (j - i)))
        # brute force: a span of one more character; runs of these join in the result
        cost = math.log10(alphabet(value[i]))
        if best[i] + cost < best[i + 1]:
            best[i + 1], came[i + 1] = best[i] + cost, ("brute", i, i + 1)
    segments: list[tuple[str, int, int]] = []
    at = n
    while at:
        kind, i, j = came[at]
        if segments and kind == "brute" == segments[-1][0]:
            segments[-1] = ("brute", i, segments[-1][2])
        else:
            segments.append((kind, i, j))
        at = i
    return best[n], segments[::-1]


@lru_cache(100_000)
def cost_of(value: str, vocabulary: str | None = None) -> float:
    return guess_cost(value, ranked_words(vocabulary))[0]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]


def guess_spans(text: str, vocabulary: str | None = None) -> list[tuple[int, str, int]]:
    out = []
    for m in CONTEXT.finditer(text):
        value = m[m.lastindex]
        value = value.rstrip(".)]}:!?") if m.lastindex == 4 else value
        if len(value) >= SHORTEST_VALUE and cost_of(value, vocabulary) >= STRONG:
            out.append((m.start(m.lastindex), "guess", m.start(m.lastindex) + len(value)))
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def candidates(block: tb.Block) -> np.ndarray:
    """Documents in which any kind may occur: a needle or a long enough hex run."""
    low = tb.LOWER[block.data].tobytes()
    raw = block.data.tobytes()
    places = []
    for text, needles in ((low, NEEDLES), (raw, (b"AKIA",))):
        for needle in needles:
            at = text.find(needle)
            while at >= 0:
                k = int(np.searchsorted(block.starts, at, side="right")) - 1
                places.append(k)
                at = text.find(needle, int(block.ends[k]))  # on to the next document
    hexadecimal = np.zeros(256, bool)
    hexadecimal[48:58] = hexadecimal[97:103] = True
    start, end = tb.runs(hexadecimal[block.data])
    long = block.doc_of(start[end - start >= LEAST["hex"]])
    return np.unique(np.concatenate([np.array(places, np.int64), long]))


def scan(vocabulary: str | None):
    return lambda batches: scanned(batches, vocabulary)


def scanned(batches: Iterator[pa.RecordBatch], vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for block in tb.blocks(batches):
        n = len(block.starts)
        counts = {k: [0] * n for k in KINDS}
        digests, spans = [nothing] * n, [""] * n
        for k in candidates(block).tolist():
            text = block.data[block.starts[k] : block.ends[k]].tobytes().decode("utf-8", "replace")
            base, more = base_spans(text), guess_spans(text, vocabulary)
            for _, kind, _ in base + more:
                counts[kind][k] += 1
            digests[k] = hashlib.sha256(joined(base).encode()).hexdigest()
            spans[k] = joined(base + more)
        yield pa.RecordBatch.from_arrays(
            [tb.column(block.rows, "doc_id")] + [pa.array(counts[k], pa.int64()) for k in KINDS] + [pa.array(digests), pa.array(spans)],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"],
        )


def secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row a document: counts by kind, the digest of its base spans, and all spans. vocabulary: a file of ranked words on every executor."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return texts_of(docs).mapInArrow(scan(vocabulary), schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")
