"""Operator 6: benchmark decontamination by SimHash of item-sized windows.

Texts and items are lower-cased, ASCII punctuation is dropped, words are split at white space. An item's fingerprint is
the 128-bit SimHash of its 5-word shingles (of the whole item, if it is shorter). A text's windows of an item's length
have fingerprints from running sums of bit votes. A multi-index (16 blocks of 8 bits, each matched within one bit) finds
every window within 31 bits of an item: more would need two or more differing bits in every block. A found window is
verified by exact weighted Jaccard similarity of shingle counts, SIMILARITY or more.

At that similarity a window shares a shingle with its item, so windows are only laid where a text has a shingle of the
benchmark; this loses nothing. Two texts of similarity 0.8 differ in 19 of 128 bits in the mean, 31 is three standard
deviations above; windows that start at the wrong word but overlap enough are tried too.

Items go to executors in groups of at most ITEMS (the benchmark's size is checked, a larger one takes several groups,
each another pass over the texts); texts are judged where they are read, nothing is shuffled but findings.

Defined results: null and empty texts match nothing; items without a word are skipped; null item ids are kept as null;
items with equal text are found alike; repeated rows give repeated findings; empty tables give no rows; other columns
are ignored, or kept by keep().
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm import common

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, WITHIN = 128, 16, 31
ITEMS = 20_000
WORDS_KEPT = 100_000
#: Found pairs that are compared at a time, about.
PAIRS = 1_000_000
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_P = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_words = _Words()


def word_codes(text: str | None) -> np.ndarray:
    words = [] if text is None else text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words."""
    n = len(codes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size))
        for k in range(size):
            out = _mixed(out * _P[k] + codes[k : k + n])
    return out


def votes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of a shingle's 128 bits."""
    with np.errstate(over="ignore"):
        both = np.stack([hashes, _mixed(hashes + _P[0])], 1)
    return np.unpackbits(both.view(np.uint8).reshape(len(hashes), BITS // 8), axis=1, bitorder="little").astype(np.int8) * np.int8(2) - np.int8(1)


def _similarity(a: np.ndarray, b_values: np.ndarray, b_counts: np.ndarray) -> float:
    values, counts = np.unique(a, return_counts=True)
    at = np.searchsorted(b_values, values)
    at[at == len(b_values)] = 0
    same = b_values[at] == values
    least = np.minimum(counts[same], b_counts[at[same]]).sum()
    return float(least / (counts.sum() + b_counts.sum() - least))


#: What a block value differs by from those within one bit of it.
_FLIPS = [0, *(1 << k for k in range(8))]


class Benchmark:
    """Index of items: (item_id, text) pairs."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        self.items = []  # id, words, shingle size, shingle values, their counts
        of: dict[int, list[int]] = defaultdict(list)
        fingerprints = []
        for item_id, text in items:
            codes = word_codes(text)
            if not len(codes):
                continue
            size = min(SHINGLE, len(codes))
            hashes = shingles(codes, size)
            values, counts = np.unique(hashes, return_counts=True)
            for v in values.tolist():
                of[v].append(len(self.items))
            self.items.append((item_id, len(codes), size, values, counts))
            fingerprints.append(np.packbits(votes(hashes).sum(0, dtype=np.int32) > 0, bitorder="little"))
        self.sizes = sorted({x[2] for x in self.items})
        self.values = np.array(sorted(of), np.uint64)
        self.of = [of[v] for v in sorted(of)]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.values & np.uint64(0xFFFF)).astype(np.int64)] = True
        # Multi-index by window length: for each block and value, the items of that length within one bit of it there.
        self.index = {}
        for length in {x[1] for x in self.items}:
            members = np.array([k for k, x in enumerate(self.items) if x[1] == length])
            blocks = np.stack([fingerprints[k] for k in members])
            value = np.concatenate([256 * np.arange(BLOCKS) + (blocks ^ flip) for flip in _FLIPS]).ravel()
            order = np.argsort(value, kind="stable")
            first = np.searchsorted(value[order], np.arange(256 * BLOCKS + 1))
            self.index[length] = (members, blocks, first, np.tile(np.repeat(np.arange(len(members)), BLOCKS), len(_FLIPS))[order])

    def candidates(self, length: int, windows: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) within 31 bits; windows: their 16 blocks each."""
        members, blocks, first, table = self.index[length]
        out = []
        step = max(1, PAIRS // (1 + len(members)))
        for low in range(0, len(windows), step):
            part = windows[low : low + step]
            value = (256 * np.arange(BLOCKS) + part).ravel()
            n = first[value + 1] - first[value]
            w = np.repeat(np.repeat(np.arange(len(part)), BLOCKS), n)
            m = table[np.repeat(first[value] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            near = np.bitwise_count(part.view(np.uint64)[w] ^ blocks.view(np.uint64)[m]).sum(1, dtype=np.int64) <= WITHIN
            both = np.unique(w[near] * len(members) + m[near])
            out += zip((low + both // len(members)).tolist(), members[both % len(members)].tolist(), strict=True)
        return out

    def find(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window of each item that the text holds."""
        if not self.items or not text:
            return []
        codes = word_codes(text)
        best: dict[int, tuple[float, int]] = {}
        for size in self.sizes:
            hashes = shingles(codes, size)
            hit = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)]) if len(hashes) else []
            if not len(hit):
                continue
            at = np.searchsorted(self.values, hashes[hit])
            at[at == len(self.values)] = 0
            real = self.values[at] == hashes[hit]
            starts: dict[int, set[int]] = defaultdict(set)
            for place, value in zip(hit[real].tolist(), at[real].tolist(), strict=True):
                for length in {self.items[k][1] for k in self.of[value] if self.items[k][2] == size}:
                    starts[length].update(range(max(0, place - (length - size)), min(place, max(0, len(codes) - length)) + 1))
            for length, places in starts.items():
                self._windows(hashes, size, length, np.array(sorted(places)), best)
        return [(self.items[k][0], s, start, self.items[k][1]) for k, (s, start) in sorted(best.items())]

    def _windows(self, hashes: np.ndarray, size: int, length: int, places: np.ndarray, best: dict) -> None:
        """Judge windows of `length` words that start at the places; a text shorter than that is one window."""
        span = min(length - size + 1, len(hashes))
        places = places[places + span <= len(hashes)]
        for run in np.split(places, np.flatnonzero(np.diff(places) > span) + 1):
            for low in range(0, len(run), 2048):
                part = run[low : low + 2048]
                if not len(part):
                    continue
                first, last = int(part[0]), int(part[-1]) + span
                sums = np.zeros((last - first + 1, BITS), np.int32)
                np.cumsum(votes(hashes[first:last]), axis=0, out=sums[1:])
                windows = np.packbits(sums[part - first + span] - sums[part - first] > 0, axis=1, bitorder="little")
                for w, k in self.candidates(length, windows):
                    start = int(part[w])
                    s = _similarity(hashes[start : start + span], self.items[k][3], self.items[k][4])
                    if s >= SIMILARITY and (k not in best or (-s, start) < (-best[k][0], best[k][1])):
                        best[k] = (s, start)


def groups(benchmark: DataFrame, most: int = ITEMS) -> Iterator[list[tuple]]:
    """Items in lists of about `most` at the largest, so that what is sent at a time is bounded."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n = max(1, -(-items.count() // most))
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"
_ARROW = pa.schema([(c.split()[0], pa.float64() if c.endswith("double") else pa.int64()) for c in SCHEMA.split(", ")])


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each text and item that it holds, at the best window."""
    out = None
    for items in groups(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Benchmark(sent.value)
            for part in common.rows(batches, "doc_id", "text"):
                yield common.record_batch(_ARROW, [(doc_id, *found) for doc_id, text in part for found in index.find(text)])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns."""
    for items in groups(benchmark):
        docs = docs.where(_clean(docs.sparkSession, items)("text"))
    return docs


def _clean(spark: SparkSession, items: list[tuple]):
    """A column function text -> whether it holds none of the items."""
    sent = spark.sparkContext.broadcast(items)

    def make():
        index = Benchmark(sent.value)
        return lambda texts: pa.array([not index.find(t) for t in texts], pa.bool_())

    return common.text_function("boolean", make)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text"))
