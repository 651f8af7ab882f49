"""Operator 3: quality rules on repetition, from a suffix array of each text's words.

A suffix array of the words (numbers for equal words) is built by prefix doubling: after step k, rank[k][i] numbers the
2^k words from place i. Doubling ends when all ranks of a step differ. Common prefixes of neighbours in the array come
from the same ranks by binary lifting. A place's longest repeated prefix is the larger one of its two: an LCP interval
of that length holds it, and the spans of all maximal repeated substrings of MIN_REPEAT words or more are just the
union of these prefixes. A text passes if it passes the base rules, if the union covers at most MAX_COVERED of its
words, and if the longest repeat has at most MAX_REPEAT words.

Rows are judged where they are read: nothing is shuffled, and memory holds one text's arrays.

Defined results: null, empty and blank texts have no words and fail the base; repeated rows give repeated rows; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm import common

MIN_REPEAT = 8
MAX_COVERED = 0.3
MAX_REPEAT = 100
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\r\x0b\x0c"


def codes(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, from 0, in the order in which they come first."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def suffix_array(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and, for its neighbours k and k + 1, the length of their common prefix."""
    n = len(code)
    if n < 2:
        return np.arange(n), np.empty(0, np.int64)
    ranks, width = [np.unique(code, return_inverse=True)[1].astype(np.int64)], 1
    while ranks[-1].max() < n - 1:
        rank = ranks[-1]
        following = np.zeros(n, np.int64)
        following[: n - width] = rank[width:] + 1 if width < n else 0
        ranks.append(np.unique(rank * (n + 1) + following, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    left, right, common_length = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        step = 1 << k
        rank, same = ranks[k], (left + step <= n) & (right + step <= n)
        same[same] = rank[left[same]] == rank[right[same]]
        common_length += step * same
        left, right = left + step * same, right + step * same
    return order, common_length


def repeats(code: np.ndarray, least: int = MIN_REPEAT) -> tuple[int, int]:
    """Words in the union of repeated substrings of `least` words or more, and the longest one's words."""
    n = len(code)
    if n <= least:
        return 0, 0
    window = code[: n - least + 1].copy()  # most texts repeat nothing: a hash of each run of `least` words shows that
    with np.errstate(over="ignore"):
        for k in range(1, least):
            window = window * np.int64(6364136223846793005) + code[k : n - least + 1 + k] + np.int64(1442695040888963407)
    ordered = np.sort(window)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0, 0
    order, shared = suffix_array(code)
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = shared
    longest[order[1:]] = np.maximum(longest[order[1:]], shared)
    edges = np.zeros(n + 1, np.int64)
    start = np.flatnonzero(longest >= least)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + longest[start], -1)
    return int((np.cumsum(edges[:-1]) > 0).sum()), int(longest.max()) if len(start) else 0


def repeated_words(code: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(code)
    if n < 4:
        return 0
    window = (code[:-2] * (n + 1) + code[1:-1]) * (n + 1) + code[2:] if n < 2_000_000 else np.unique(np.stack([code[:-2], code[1:-1], code[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    ordered = np.sort(window)
    twice = ordered[1:] == ordered[:-1]
    if not twice.any():
        return 0
    again = np.unique(ordered[1:][twice])
    at = np.searchsorted(again, window)
    at[at == len(again)] = 0
    hit = again[at] == window
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def judge(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered_words, longest_repeat."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(raw.translate(None, _CONTINUATION + _SPACES))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACES)]
    code = codes(words)
    repeat_words = repeated_words(code)
    covered, longest = repeats(code)
    base_failed = n < MIN_WORDS or 100 * repeat_words > 50 * n
    kept = not base_failed and covered <= MAX_COVERED * n and longest <= MAX_REPEAT
    return n, chars, symbols, len(lines) - len(set(lines)), repeat_words, base_failed, kept, covered, longest


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"
_ARROW = pa.schema([("doc_id", pa.int64())] + [(c.split()[0], pa.bool_() if c.split()[1] == "boolean" else pa.int64()) for c in SCHEMA.split(", ")])


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, the columns of SCHEMA) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.rows(batches, "doc_id", "text"):
            yield common.record_batch(_ARROW, [(doc_id, *judge(text)) for doc_id, text in part])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {SCHEMA}")


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(common.table(spark, sf_dir, "documents", "doc_id", "text"))


