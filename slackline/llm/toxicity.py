"""Toxicity scores of deobfuscated text.

1. Character language model: 4-gram counts over every text of the corpus (added up by range
   of cells, so no task or driver holds more than the fixed table of 28**4 cells).
2. Noisy channel: tokens with letters replaced by digits or signs, letters repeated three
   times or more, or single letters spaced out become a character lattice; Viterbi search
   under the language model restores the likeliest word.
3. Score: logistic regression on the presence of words and word beginnings in the text
   and its restored words. Features are those that labelled toxic documents favour. The
   model is fitted on at most SAMPLE labelled documents outside the held-out fold, the ones
   with the smallest hash of doc_id; everything else covers all data.

Edge cases: null is empty text, which gets the score of a document without features; an empty table gives no rows; a
null doc_id has a null held_out; rows with equal doc_id are scored each; very long texts are a block of their own; rows
of ``labels`` with a null label or id are not used; repeated label rows of a document
count as often as they stand there; without toxic labels every score is near 0; other columns
are ignored, and neither lang, source nor doc_id is part of a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .tables import Scratch, rows_of, table, texts_of

SAMPLE = 20_000
#: Feature selection, part of fitting on the sample: at most FEATURES of those that LEAST_TOXIC toxic documents hold, LEAST_LIFT times
#: as often as clean ones, with a gain (documents times log lift) of LEAST_GAIN.
FEATURES = 4096
LEAST_TOXIC, LEAST_LIFT, LEAST_GAIN = 3, 4, 8
PREFIXES = (4, 5, 6)
FOLDS = 5
SYMBOLS = 28
CELLS = SYMBOLS**4
RANGES = 64
TASKS_A_SUM = 256
#: Tokens up to this length are remembered; longer ones are decoded each time.
LONGEST_CACHED = 64

# What a writer may put for a letter.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz",
}
#: Signs that may stand for any letter.
MASKS = {c for c, letters in LEET.items() if len(letters) == 26}
LETTERS = np.arange(1, 27)
#: Log probabilities of the channel: a letter was replaced; a sign is only a sign; a letter was repeated.
REPLACED, SIGN, REPEATED = math.log(0.3), math.log(0.05), math.log(0.4)
#: A word ends inside spaced text.
WORD_END = math.log(0.3)
#: The text of an arc for any letter; a run of more signs than MASKED does not stand for so many letters, but for one or none.
ANY, ANY_TWICE = "?", "??"
MASKED = 12
#: States from which on a step is taken over the whole cube of them.
DENSE = 800

SYMBOL = np.zeros(256, np.int32)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = 27
LETTER = SYMBOL > 0
IS_LEET = np.zeros(256, bool)
IS_LEET[[ord(c) for c in LEET]] = True
GAP = np.zeros(256, bool)
GAP[[ord(c) for c in " .-_*"]] = True
SINGLE = LETTER | IS_LEET

_SIGNS = re.escape("".join(LEET))
TOKEN = re.compile(rf"[a-z\u0080-￿{_SIGNS}]+")
INNER = re.compile(rf"[{_SIGNS}][a-z\u0080-￿]|[a-z\u0080-￿][{_SIGNS}]")
TRIPLE = re.compile(r"([a-z\u0080-￿])\1\1")
SPACED = re.compile(rf"(?<![a-z0-9\u0080-￿])(?:[a-z\u0080-￿{_SIGNS}][ .\-_*]){{3,}}[a-z\u0080-￿{_SIGNS}](?![a-z0-9\u0080-￿])")


def fold() -> F.Column:
    """doc_id's part of the split; 0 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for block in tb.blocks(batches):
        s = SYMBOL[tb.LOWER[block.data]]
        s = np.concatenate([np.zeros(3, np.int32), s])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one boundary between words
        s = np.concatenate([np.zeros(2, np.int32), s])
        code = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
        total += np.bincount(code, minlength=CELLS)
    task = TaskContext.get().partitionId()
    parts = total.reshape(RANGES, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(RANGES), pa.int32()), pa.array(np.full(RANGES, task // TASKS_A_SUM), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["cells", "salt", "counts"]
    )


def add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for cells, salt, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            sums[cells, salt] = sums.get((cells, salt), 0) + np.frombuffer(counts, np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["cells", "salt", "counts"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Log P(symbol | three before it) over the whole corpus, smoothed by shorter contexts."""
    schema = "cells int, salt int, counts binary"
    some = texts_of(docs).select("text").mapInArrow(count_cells, schema).repartition(RANGES, "cells", "salt").mapInArrow(add_cells, schema)
    rows = some.repartition(RANGES, "cells").mapInArrow(add_cells, schema).collect()  # RANGES rows of fixed size
    counts = np.zeros((RANGES, CELLS // RANGES))
    for row in rows:
        counts[row.cells] = np.frombuffer(row.counts, np.int64)
    c4 = counts.reshape((SYMBOLS,) * 4)
    p = (c4.sum((0, 1, 2)) + 1) / (c4.sum() + SYMBOLS)
    for c in (c4.sum((0, 1)), c4.sum(0), c4):
        p = (c + 4 * p) / (c.sum(-1, keepdims=True) + 4)
    return np.log(p).astype(np.float32)


class Decoder:
    """Viterbi search of a token's character lattice; states are the last three symbols."""

    def __init__(self, log_p: np.ndarray) -> None:
        self.log_p = log_p
        self.cached = lru_cache(200_000)(self._restore)
        self.tails: list[tuple[np.ndarray, np.ndarray]] = []

    def restore(self, token: str, spaced: bool = False) -> str:
        return self.cached(token, spaced) if len(token) <= LONGEST_CACHED else self._restore(token, spaced)

    @staticmethod
    def lattice(token: str, spaced: bool = False) -> list[list[tuple[int, str, float]]]:
        """For each place, the arcs that leave it: their end, the string and its log probability (ANY: any letter).

        A run of equal characters has arcs across it whole (it may stand for one letter) and one for each of
        its signs, which may stand for different letters; so have the letters of spaced text, where a word may end between them."""
        out: list[list[tuple[int, str, float]]] = [[] for _ in token]
        for m in re.finditer(r"(.)\1*", token, re.S):
            char, i, j = m[1], m.start(), m.end()
            n = j - i
            if char in LEET:
                choices = [(c, REPLACED - math.log(len(LEET[char]))) for c in LEET[char]]
                out[i].append((j, "", SIGN * min(n, 2)))
                made = [((ANY, ANY_TWICE), choices[0][1])] if len(choices) == 26 else [((c, c * 2), p) for c, p in choices]
                out[i] += [(j, c[0], p) for c, p in made] if n == 1 else [(j, c[k - 1], p + (REPEATED if k < n else 0)) for c, p in made for k in (1, 2)]
                if n > 1 and (len(choices) < 26 or n <= MASKED):
                    for k in range(i, j):
                        out[k] += [(k + 1, ANY, choices[0][1])] if len(choices) == 26 else [(k + 1, c, p) for c, p in choices]
                continue
            out[i] += [(j, char, REPEATED), (j, char * 2, REPEATED)] if n > 2 else [(j, char * n, 0.0)]
            if spaced and n > 1:
                for k in range(i, j):
                    out[k].append((k + 1, char, 0.0))
        return out

    def _restore(self, token: str, spaced: bool = False) -> str:
        masked = [c for c in token if c in MASKS]
        if masked and not spaced and token[-1] in MASKS:
            head = token.rstrip(token[-1])
            if head and not any(c in MASKS for c in head):
                return self._restore_tail(head, token[-1], len(token) - len(head))
        if masked:
            return self._restore_masked(token, spaced)
        link = max(self._search(token, spaced).items(), key=lambda x: x[1][0] + float(self.log_p[(*x[0], 0)]))[1][1]
        return self._text(link)

    @staticmethod
    def _text(link: tuple | None) -> str:
        pieces = []
        while link is not None:
            link, text = link
            pieces.append(text)
        return "".join(reversed(pieces))

    def _tails(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For every state the best score of n letters of any kind and the word's end, and the first of those letters."""
        cube = (SYMBOLS,) * 3
        if not self.tails:
            self.tails.append((self.log_p[:, :, :, 0], np.zeros(cube, np.int8)))
        while len(self.tails) <= n:
            made = self.log_p[:, :, :, 1:27] + self.tails[-1][0][None, :, :, 1:27]
            self.tails.append((made.max(-1), (made.argmax(-1) + 1).astype(np.int8)))
        return self.tails[n]

    def _restore_tail(self, head: str, sign: str, n: int) -> str:
        """A token that ends in n signs for any letter: the search over the head, then the best tail of each of its states."""
        channel = REPLACED - math.log(len(LEET[sign]))
        best, made = -math.inf, ""
        for state, (score, link) in self._search(head, False).items():
            a, b, c = state
            twice = self.log_p[a, b, c, 1:27] + self.log_p[b, c, LETTERS, LETTERS] + self.log_p[c, LETTERS, LETTERS, 0]
            ways = [(score + SIGN * min(n, 2) + float(self._tails(0)[0][state]), 0, False)]
            ways.append((score + channel + (REPEATED if n > 1 else 0) + float(self._tails(1)[0][state]), 1, False))
            if n > 1:
                ways.append((score + channel + (REPEATED if n > 2 else 0) + float(twice.max()), 2, True))
            if 1 < n <= MASKED:
                ways.append((score + n * channel + float(self._tails(n)[0][state]), n, False))
            s, k, double = max(ways, key=lambda w: w[0])
            if s > best:
                best, text = s, self._text(link)
                if double:
                    text += chr(97 + int(twice.argmax())) * 2
                for left in range(0 if double else k, 0, -1):
                    d = int(self._tails(left)[1][a, b, c])
                    text += chr(96 + d)
                    a, b, c = b, c, d
                made = text
        return made

    def _search(self, token: str, spaced: bool) -> dict:
        """The states after a token without signs for any letter, with their scores and texts as linked pieces."""
        log_p = self.log_p
        # state -> score and the made text as linked pieces
        beams: list[dict | None] = [{} for _ in range(len(token) + 1)]
        beams[0] = {(0, 0, 0): (0.0, None)}
        for place, arcs in enumerate(self.lattice(token, spaced)):
            beam = beams[place]
            beams[place] = None
            if spaced and place:
                for (a, b, c), (score, made) in list(beam.items()):
                    s = score + WORD_END + float(log_p[a, b, c, 0])
                    if c and s > beam.get((b, c, 0), (-math.inf,))[0]:
                        beam[b, c, 0] = (s, (made, " "))
            for end, text, channel in arcs:
                fresh = beams[end]
                for (a, b, c), (score, made) in beam.items():
                    s = score + channel
                    for char in text:
                        d = ord(char) - 96 if "a" <= char <= "z" else 27
                        s += float(log_p[a, b, c, d])
                        a, b, c = b, c, d
                    if s > fresh.get((a, b, c), (-math.inf,))[0]:
                        fresh[a, b, c] = (s, (made, text))
        return beams[-1]

    def _after_any(self, states: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States after one more letter of any kind: (state, best score, the state before it)."""
        values, before = np.full(SYMBOLS**3, -np.inf, np.float32), np.zeros(SYMBOLS**3, np.int32)
        if len(states) > DENSE:
            cube = np.full(SYMBOLS**3, -np.inf, np.float32)
            cube[states] = scores
            cube = cube.reshape((SYMBOLS,) * 3)
            pairs = np.arange(SYMBOLS**2)
            for d in range(1, 27):
                made = (cube + self.log_p[:, :, :, d]).reshape(SYMBOLS, -1)
                best = made.argmax(0)
                values[pairs * SYMBOLS + d], before[pairs * SYMBOLS + d] = made[best, pairs], best * SYMBOLS**2 + pairs
        else:
            made = (scores[:, None] + self.log_p.reshape(-1, SYMBOLS)[states, 1:27]).reshape(-1)
            into = (states[:, None] % SYMBOLS**2 * SYMBOLS + np.arange(1, 27)).reshape(-1)
            order = np.argsort(made, kind="stable")  # of several ways into a state the best is written last
            values[into[order]], before[into[order]] = made[order], np.repeat(states, 26)[order]
        reached = np.flatnonzero(values > -np.inf)
        return reached, values[reached], before[reached]

    def _restore_masked(self, token: str, spaced: bool) -> str:
        """The same search over arrays, where signs stand for any letter and many states may be reached."""
        log_p, flat = self.log_p, self.log_p.reshape(-1, SYMBOLS)
        score = [np.full(SYMBOLS**3, -np.inf, np.float32) for _ in range(len(token) + 1)]
        came = [np.zeros((2, SYMBOLS**3), np.int32) for _ in range(len(token) + 1)]  # the state before, and the arc
        arcs_into: list[tuple[int, str]] = [(-1, "")]  # (place it leaves, text)
        score[0][0] = 0.0

        def offer(end: int, states: np.ndarray, values: np.ndarray, before: np.ndarray, place: int, text: str) -> None:
            better = values > score[end][states]
            at = states[better]
            arcs_into.append((place, text))
            score[end][at], came[end][0, at], came[end][1, at] = values[better], before[better], len(arcs_into) - 1

        for place, arcs in enumerate(self.lattice(token, spaced)):
            states = np.flatnonzero(score[place] > -np.inf)
            if spaced and place:
                inside = states[states % SYMBOLS > 0]
                values, order = score[place][inside] + np.float32(WORD_END) + flat[inside, 0], np.argsort(score[place][inside] + flat[inside, 0], kind="stable")
                after = inside % SYMBOLS**2 * SYMBOLS
                last = np.full(SYMBOLS**3, -1)
                last[after[order]] = order  # the best way into each state
                pick = last[np.unique(after)]
                offer(place, after[pick], values[pick], inside[pick], place, " ")
                states = np.flatnonzero(score[place] > -np.inf)
            now = score[place][states]
            for end, text, channel in arcs:
                if text in (ANY, ANY_TWICE):
                    to, values, before = self._after_any(states, now)
                    if text == ANY_TWICE:
                        d = to % SYMBOLS
                        values, twice = values + flat[to, d], to % SYMBOLS**2 * SYMBOLS + d
                        order = np.argsort(values, kind="stable")
                        last = np.full(SYMBOLS**3, -1)
                        last[twice[order]] = order
                        pick = last[np.unique(twice)]
                        to, values, before = twice[pick], values[pick], before[pick]
                    offer(end, to, values + np.float32(channel), before, place, text)
                    continue
                to, values = states, now
                for char in text:
                    d = ord(char) - 96 if "a" <= char <= "z" else 27
                    to, values = to % SYMBOLS**2 * SYMBOLS + d, values + flat[to, d]
                order = np.argsort(values, kind="stable")
                last = np.full(SYMBOLS**3, -1)
                last[to[order]] = order
                pick = last[np.unique(to)]
                offer(end, to[pick], values[pick] + np.float32(channel), states[pick], place, text)
        final = score[-1].reshape((SYMBOLS,) * 3) + log_p[:, :, :, 0]
        place, state, pieces = len(token), int(final.argmax()), []
        while arc := int(came[place][1, state]):
            before, (start, text) = int(came[place][0, state]), arcs_into[arc]
            letter = chr(96 + state % SYMBOLS)
            pieces.append(letter if text == ANY else letter * 2 if text == ANY_TWICE else text)
            place, state = start, before
        return "".join(reversed(pieces))

    def restored(self, text: str) -> list[str]:
        """The words restored from a lower-case text's obfuscated tokens."""
        out = []
        for m in TOKEN.finditer(text):
            token = m[0]
            if (INNER.search(token) or TRIPLE.search(token)) and any(c.isalpha() for c in token):
                out.append(self.restore(token))
        for m in SPACED.finditer(text):
            letters = m[0][::2]
            out += [self.restore(letters), self.restore(letters, True)]  # as one word, and as several
        return out


def suspicious(data: np.ndarray) -> np.ndarray:
    """Places in lower-case bytes where an obfuscated token may stand."""
    n = len(data)
    if n < 8:
        return np.arange(n)
    letter, leet = LETTER[data], IS_LEET[data]
    hit = np.zeros(n, bool)
    hit[:-1] = leet[:-1] & letter[1:] | letter[:-1] & leet[1:]
    same = data[1:] == data[:-1]
    hit[:-2] |= same[:-1] & same[1:] & letter[:-2]
    single, gap = SINGLE[data], GAP[data]
    pair = single[:-1] & gap[1:]
    hit[:-6] |= pair[:-5] & pair[2:-3] & pair[4:-1] & single[6:]
    return np.flatnonzero(hit)


def features(block: tb.Block, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hash) pairs, not distinct: whole words and word beginnings, restored words too."""
    data = tb.LOWER[block.data]
    docs, hashes = word_features(data, block.doc_of)
    flagged = np.unique(block.doc_of(suspicious(data)))
    words, owners = [], []
    for k in flagged.tolist():
        found = decoder.restored(data[block.starts[k] : block.ends[k]].tobytes().decode("utf-8", "replace"))
        words += [w.encode() for w in found]
        owners += [k] * len(found)
    if words:
        flat = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
        begin = np.cumsum([0] + [len(w) + 1 for w in words])[:-1]
        place = np.array(owners)
        more_docs, more = word_features(flat, lambda at: place[np.searchsorted(begin, at, side="right") - 1])
        docs, hashes = np.concatenate([docs, more_docs]), np.concatenate([hashes, more])
    return docs, hashes


def word_features(data: np.ndarray, doc_of) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = tb.runs(LETTER[data])
    owner = doc_of(starts)
    docs, hashes = [owner], [tb.span_hash(data, starts, ends)]
    for n in PREFIXES:
        long = ends - starts >= n
        docs.append(owner[long])
        hashes.append(tb.mix(tb.span_hash(data, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(hashes)


def count_features(log_p):
    """(feature, toxic, clean): documents of each label that hold it, pre-summed by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(log_p.value)
        for block in tb.blocks(batches, limit=8_000_000):
            docs, hashes = features(block, decoder)
            order = np.lexsort((docs, hashes))
            docs, hashes = docs[order], hashes[order]
            first = np.concatenate([[True], (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])]) if len(docs) else np.zeros(0, bool)
            docs, hashes = docs[first], hashes[first]
            toxic = tb.column(block.rows, "toxic").to_numpy(zero_copy_only=False)[docs]
            start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(docs) else np.zeros(0, np.int64)
            n_toxic = np.add.reduceat(toxic, start).astype(np.int64) if len(start) else start
            n = np.diff(np.concatenate([start, [len(docs)]]))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[start].view(np.int64)), pa.array(n_toxic), pa.array(n - n_toxic)], ["feature", "toxic", "clean"])

    return run


def held_features(log_p, names: np.ndarray):
    """The chosen features (by place in names) of each labelled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(log_p.value)
        for block in tb.blocks(batches):
            docs, place = chosen(block, decoder, names)
            lists = [[] for _ in range(len(block.starts))]
            for d, p in zip(docs.tolist(), place.tolist(), strict=True):
                lists[d].append(p)
            yield pa.RecordBatch.from_arrays([tb.column(block.rows, "toxic").cast(pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["toxic", "held"])

    return run


def chosen(block: tb.Block, decoder: Decoder, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, place in the sorted names) pairs."""
    docs, hashes = features(block, decoder)
    if not len(names):
        return docs[:0], docs[:0]
    maybe = np.zeros(1 << 16, bool)
    maybe[(names & np.uint64(0xFFFF)).astype(np.int64)] = True
    few = np.flatnonzero(maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(names, hashes[few]), len(names) - 1)
    good = names[at] == hashes[few]
    pair = np.unique(docs[few[good]] * len(names) + at[good])
    return pair // len(names), pair % len(names)


@dataclass
class Model:
    names: np.ndarray
    weights: np.ndarray
    bias: float


def fit(rows: list[tuple[int, list[int]]], names: np.ndarray, rounds: int = 400, ridge: float = 0.01) -> Model:
    """Logistic regression by accelerated gradient steps; weights are never negative, as features were chosen for toxicity."""
    y = np.array([r[0] for r in rows], float)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([c for r in rows for c in r[1]], np.int64)
    n = max(1, len(rows))
    w = look = np.zeros(len(names))
    rate = min(max((y.sum() + 0.5) / (n + 1), 1e-4), 1 - 1e-4)
    bias = look_bias = math.log(rate / (1 - rate))
    widest = np.bincount(doc, minlength=n).max(initial=0) + 1
    step = 4 * n / widest / n
    t = 1.0
    for _ in range(rounds):
        z = look_bias + np.bincount(doc, look[col], n)
        error = 1 / (1 + np.exp(-z)) - y
        fresh = np.maximum(0, look - step * (np.bincount(col, error[doc], len(names)) / 10 + ridge * look))
        fresh_bias = look_bias - step * error.mean()
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        look, look_bias = fresh + (before - 1) / t * (fresh - w), fresh_bias + (before - 1) / t * (fresh_bias - bias)
        w, bias = fresh, fresh_bias
    return Model(names, w, bias)


def train(docs: DataFrame, labels: DataFrame, log_p, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled documents outside the held-out fold."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic in (0, 1)").filter(fold() != 0)
    rows = scratch.save(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample), "sample")
    # at most ``sample`` small rows: a fixed bound, whatever the corpus
    picked = texts_of(docs).join(F.broadcast(rows), "doc_id").select("text", "toxic")
    picked = scratch.save(picked, "picked")
    counted = picked.mapInArrow(count_features(log_p), "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = picked.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    if not total.toxic or total.toxic == total.n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 20.0 if total.toxic else -20.0)
    lift = (F.col("toxic") + 0.5) / (total.toxic + 1) / ((F.col("clean") + 0.5) / (total.n - total.toxic + 1))
    few = counted.filter(F.col("toxic") >= LEAST_TOXIC).withColumn("gain", F.col("toxic") * F.log(lift)).filter((lift > LEAST_LIFT) & (F.col("gain") > LEAST_GAIN)).orderBy(F.desc("gain"), "feature").limit(FEATURES)
    names = np.sort(np.array([r.feature for r in few.select("feature").collect()], np.int64).view(np.uint64))
    held = picked.mapInArrow(held_features(log_p, names), "toxic int, held array<int>").collect()  # a row for each sampled document
    model = fit([(r.toxic, list(r.held)) for r in sorted(held, key=lambda r: (r.toxic, r.held))], names)
    scratch.drop("sample", "picked")
    return model


def scores(block: tb.Block, decoder: Decoder, model: Model) -> np.ndarray:
    at, place = chosen(block, decoder, model.names)
    z = model.bias + np.bincount(at, model.weights[place], len(block.starts))
    return 1 / (1 + np.exp(-z))


def score(docs: DataFrame, model: Model, log_p) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(log_p.value)
        for block in tb.blocks(batches):
            yield pa.RecordBatch.from_arrays([tb.column(block.rows, "doc_id"), pa.array(scores(block, decoder, model))], ["doc_id", "score"])

    rows = texts_of(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    log_p = docs.sparkSession.sparkContext.broadcast(language_model(docs))  # a fixed table of 28**4 floats
    return score(docs, train(docs, labels, log_p), log_p)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose own text is not predicted toxic, with their columns; null and repeated ids too."""
    log_p = docs.sparkSession.sparkContext.broadcast(language_model(docs))
    model = train(docs, labels, log_p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(log_p.value)
        for block in tb.blocks(batches):
            yield block.rows.filter(pa.array(scores(block, decoder, model) < 0.5))

    return rows_of(docs).mapInArrow(run, docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
