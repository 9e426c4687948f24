"""License notices in texts: word grams pick candidates, banded alignment measures them.

All of a template's word k-grams go into an inverted index, with k such that a notice that still
meets the coverage keeps a gram: fingerprint -> (template, place). A document's k-grams are looked up
there; each hit's diagonal is a candidate region, which a banded local alignment (match 2, mismatch
and gap -1) compares with the template. Regions that match at least ``COVERAGE`` of a template's
words are reported with coverage and byte span; hits inside them need no alignment of their own. Of
templates that claim the same words the one that covers most of them is reported.

Words are compared by 64-bit hashes of their bytes.

Edge cases: null or empty text has no notices; an empty table gives no rows; texts of any length are scanned whole; a notice
that stands several times is reported each time; of equal spans the template with the higher coverage, then
the first name is reported; repeated documents each keep their row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .license_texts import TEMPLATES
from .minhash import PLACE
from .tables import table, texts_of

GRAM = 4
BAND = 24
STRETCH = 64
COVERAGE = 0.8

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = tb.LOWER[data]
    starts, ends = tb.runs(WORD_BYTE[data])
    return starts, ends, tb.span_hash(data, starts, ends)


def grams(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        out += words[k : k + len(out)] * PLACE[k]
    return tb.mix(out)


def gram_size(n_words: int) -> int:
    """Words of the longest run that stays somewhere in a template however its permitted edits (one at least) fall, up to GRAM."""
    edits = max(1, n_words - math.ceil(COVERAGE * n_words))
    return max(1, min(GRAM, n_words, -(-(n_words - edits) // (edits + 1))))


class Index:
    def __init__(self, templates: dict[str, str]) -> None:
        self.names = [name.split("|")[0] for name in templates]
        self.words = [word_hashes(np.frombuffer(f"{t}\n".encode(), np.uint8))[2] for t in templates.values()]
        posting: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.sizes = sorted({gram_size(len(words)) for words in self.words})
        for t, words in enumerate(self.words):
            hashes = grams(words, gram_size(len(words)))
            for k, h in enumerate(hashes.tolist()):
                posting[h].append((t, k))
        self.keys = np.array(sorted(posting), np.uint64)
        self.posting = [posting[int(k)] for k in self.keys]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of grams in the index, and their entries."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        entry = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        good = self.keys[entry] == hashes[at]
        return at[good], entry[good]


def banded_alignment(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment near words[i + diagonal] ~ template[i]: matched words, first and last word + 1 of the region."""
    m, width = len(template), 2 * band + 1
    ramp = np.arange(width)
    # of equal scores the one nearest the diagonal asked for
    aside = np.abs(ramp - band)
    best, at = width, (0, 0)
    score = np.zeros((m + 1, width), np.int32)
    move = np.zeros((m + 1, width), np.int8)
    for i in range(1, m + 1):
        j = i - 1 + diagonal - band + ramp
        inside = (j >= 0) & (j < len(words))
        same = inside & (words[np.clip(j, 0, max(0, len(words) - 1))] == template[i - 1])
        slope = score[i - 1] + np.where(same, 2, -1)
        skip = np.append(score[i - 1, 1:], 0) - 1  # a template word without partner
        row = np.maximum(np.maximum(slope, skip), 0)
        row[~inside] = 0
        fill = np.maximum.accumulate(row + ramp) - ramp  # words without partner
        score[i] = np.where(inside, fill, 0)
        move[i] = np.select([score[i] == 0, score[i] == slope, score[i] == skip], [0, 1, 2], 3)
        value = score[i] * (width + 1) - aside
        k = int(value.argmax())
        if value[k] > best:
            best, at = int(value[k]), (i, k)
    i, k = at
    matched, end = 0, i + diagonal - band + k
    start = end
    while i and 0 <= k < width and move[i, k]:
        j = i - 1 + diagonal - band + k
        if move[i, k] == 1:
            matched += int(words[j] == template[i - 1])
            i, start = i - 1, j
        elif move[i, k] == 2:
            i, k = i - 1, k + 1
        else:
            k, start = k - 1, j
    return matched, start, end


def band_of(n_words: int) -> int:
    """A short template's band does not reach its next copy."""
    return max(1, min(BAND, n_words // 2))


def reachable(template: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> bool:
    """Whether the band holds enough of the template's words for a notice; spares alignments."""
    near = words[max(0, diagonal - band) : max(0, diagonal + len(template) + band)]
    return np.isin(near, template).sum() >= COVERAGE * len(template)


def notices(index: Index, words: np.ndarray, places: np.ndarray, entries: np.ndarray) -> list[tuple[str, float, int, int]]:
    """(name, coverage, first word, last word + 1) of the notices in one document."""
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for place, entry in zip(places.tolist(), entries.tolist(), strict=True):
        for t, k in index.posting[entry]:
            hits[t].append((place - k, place))
    out = []
    for t, found in hits.items():
        template = index.words[t]
        band, passed, claimed = band_of(len(template)), -math.inf, np.zeros(len(words), bool)
        for diagonal, place in sorted(found):
            if diagonal <= passed or claimed[place]:
                continue
            matched, first, last = banded_alignment(template, words, diagonal, band) if reachable(template, words, diagonal, band) else (0, 0, 0)
            if matched >= COVERAGE * len(template):
                out.append((index.names[t], matched / len(template), first, last, matched))
                claimed[first:last] = True
            else:  # nor do its near diagonals: the band held them too
                passed = diagonal + band // 2
    return best_of_overlapping(out)


def best_of_overlapping(found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int]]:
    """Of notices that share half of the shorter one's span, the one with most matched words, then the highest coverage."""
    kept: list[tuple[str, float, int, int]] = []
    reach: dict[int, list[tuple[int, int]]] = defaultdict(list)  # kept spans by stretches of words
    for name, coverage, first, last, _ in sorted(set(found), key=lambda x: (-x[4], -x[1], x[2], x[0])):
        stretches = range(first // STRETCH, (last - 1) // STRETCH + 1)
        if not any(2 * (min(last, b) - max(first, a)) >= min(last - first, b - a) for s in stretches for a, b in reach[s]):
            kept.append((name, coverage, first, last))
            for s in stretches:
                reach[s].append((first, last))
    return sorted(kept, key=lambda x: (x[2], x[3], x[0]))


MATCHES = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())]))


def scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for block in tb.blocks(batches):
            starts, ends, words = word_hashes(block.data)
            doc = block.doc_of(starts)
            found = []
            for size in index.sizes:
                places, entries = index.hits(grams(words, size))
                whole = doc[places] == doc[np.minimum(places + size - 1, len(words) - 1)] if len(words) else places == -1
                found.append((places[whole], entries[whole]))
            places, entries = (np.concatenate([f[k] for f in found]) for k in range(2))
            order = np.argsort(places, kind="stable")
            places, entries = places[order], entries[order]
            matches: list[list[dict]] = [[] for _ in block.starts]
            for k in np.unique(doc[places]).tolist():
                a, b = np.searchsorted(doc, [k, k + 1])
                own = slice(*np.searchsorted(places, [a, b]))
                for name, coverage, first, last in notices(index, words[a:b], places[own] - a, entries[own]):
                    matches[k].append({"license": name, "coverage": coverage, "start_byte": int(starts[a + first] - block.starts[k]), "end_byte": int(ends[a + last - 1] - block.starts[k])})
            yield pa.RecordBatch.from_arrays([tb.column(block.rows, "doc_id"), pa.array(matches, MATCHES)], ["doc_id", "matches"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id and its matches (license, coverage, start_byte, end_byte), in order of place."""
    return texts_of(docs).mapInArrow(scan(templates or TEMPLATES), "doc_id long, matches array<struct<license:string,coverage:double,start_byte:long,end_byte:long>>")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start_byte"].cast("string"), m["end_byte"].cast("string"), F.round(m["coverage"], 4).cast("string")))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("best_coverage"), F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))
