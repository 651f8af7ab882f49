"""Operator 4: language identification by rank-order profiles.

A text's letters are lower-cased, everything else becomes a blank, runs of blanks one. Its n-grams of one to three
characters (three code points fit in a long) are ranked by frequency, ties by the n-gram's number. A language's profile
is the same ranking over all its training texts, cut at PROFILE n-grams. A text's distance to a profile sums, over its
PROFILE most frequent n-grams, how far each is out of place; one that the profile lacks counts PROFILE places. The
nearest profile names the language; ties go to the first name.

Counts are gathered from every training text: each task sums its own, a shuffle by (language, n-gram) adds them up, and
each language's first PROFILE are taken. Profiles (languages x PROFILE) are broadcast, so the alphabet bounds them.

keep() sets its least fit from the same texts: for each language half the median fit (LEAST_SHARE) of the training texts
that its profile wins. A language none of whose training texts its own profile wins keeps nothing.

Defined results: `und` with score 0 if the text is null or has no letter, or if nothing was learnt; null lang is not
learnt from; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored, or kept by keep().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksmith.llm import common

PROFILE = 400
ORDERS = 3
HELD_OUT = (5, 0)
UNKNOWN = "und"
#: keep() rejects a text that fits its nearest profile worse than this share of the median fit of the language's training texts.
LEAST_SHARE = 0.5
PENDING = 2_000_000


def _fold_table() -> np.ndarray:
    """Each code point's lower-case letter, or a blank."""
    table = np.full(0x110000, 32, np.int64)
    for c in np.flatnonzero(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)).tolist():
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


_fold: np.ndarray | None = None


def letters(text: str | None) -> np.ndarray:
    """Code points of the folded text with a blank at either end; empty if the text has no letter."""
    global _fold
    if _fold is None:
        _fold = _fold_table()
    if not text:
        return np.empty(0, np.int64)
    points = _fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate(([32], points, [32]))
    blank = points == 32
    if blank.all():
        return np.empty(0, np.int64)
    return points[~(blank & np.concatenate(([False], blank[:-1])))]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text (as numbers, ascending) and their counts; those of blanks alone are left out."""
    points = letters(text)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parts, gram = [points[points != 32]], points
    for n in range(2, ORDERS + 1):
        if len(points) < n:
            break
        gram = (gram[: len(points) - n + 1] << 21) | points[n - 1 :]
        parts.append(gram)
    ordered = np.sort(np.concatenate(parts))
    edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[edge], np.diff(np.append(edge, len(ordered)))


def ranked(gram: np.ndarray, count: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by number."""
    if len(gram) > 4 * most:  # those above the count of place `most`, ties included
        least = np.partition(count, len(count) - most)[len(count) - most]
        gram, count = gram[count >= least], count[count >= least]
    return gram[np.lexsort((gram, -count))[:most]]


class Profiles:
    """Languages and, for each n-gram of any profile, its place in each (PROFILE where it has none)."""

    def __init__(self, profiles: dict[str, np.ndarray]) -> None:
        self.languages = sorted(profiles)
        self.grams = np.unique(np.concatenate([profiles[k] for k in self.languages])) if profiles else np.empty(0, np.int64)
        self.places = np.full((len(self.grams) + 1, len(self.languages)), PROFILE, np.int32)
        for k, name in enumerate(self.languages):
            self.places[np.searchsorted(self.grams, profiles[name]), k] = np.arange(len(profiles[name]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language and 1 - distance / the largest possible distance."""
        top = ranked(*grams(text))
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, top)
        found = at < len(self.grams)
        found[found] = self.grams[at[found]] == top[found]
        at[~found] = len(self.grams)
        own = np.where(found[:, None] & (self.places[at] < PROFILE), np.abs(self.places[at] - np.arange(len(top))[:, None]), PROFILE)
        distance = own.sum(0)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (PROFILE * len(top)))


def learnt_rows(docs: DataFrame) -> DataFrame:
    """The rows that train() learns from: not held out, with a lang and a text."""
    modulus, held = HELD_OUT
    learnt = docs.select(F.col("lang").cast("string").alias("lang"), "text", common.remainder_column(F.col("doc_id"), modulus).alias("rest"))
    return learnt.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("rest") != held)).select("lang", "text")


def train(docs: DataFrame) -> Profiles:
    """Profiles of the languages of all rows that are not held out and have a lang."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str, list] = {}
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, parts in pending.items():
                gram, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": gram, "n": n})

        for part in common.rows(batches, "lang", "text"):
            for lang, text in part:
                gram, n = grams(text)
                if len(gram):
                    pending.setdefault(lang, []).append((gram, n))
                    size += len(gram)
            if size > PENDING:
                yield from emit()
                pending, size = {}, 0
        yield from emit()

    counts = common.cut(learnt_rows(docs).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")  # each task keeps its own first PROFILE before the shuffle
    profiles: dict[str, list[int]] = {}
    for r in counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= PROFILE).orderBy("lang", "place").collect():  # PROFILE rows a language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles({k: np.array(v, np.int64) for k, v in profiles.items()})


def identifier(spark: SparkSession, profiles: Profiles):
    """A column function text -> struct<lang_pred, score>."""
    sent = spark.sparkContext.broadcast(profiles)

    def make():
        nearest = sent.value.nearest

        def named(texts: list) -> pa.Array:
            found = [nearest(t) for t in texts]
            return pa.StructArray.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.float64())], names=["lang_pred", "score"])

        return named

    return common.text_function("lang_pred string, score double", make)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    run = identifier(docs.sparkSession, train(docs))
    modulus, held = HELD_OUT
    return docs.select("doc_id", (common.remainder_column(F.col("doc_id"), modulus) == held).alias("held_out"), run("text").alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def least_fits(docs: DataFrame, profiles: Profiles) -> dict[str, float]:
    """For each language, LEAST_SHARE of the median fit of its training texts that its profile wins."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.rows(batches, "lang", "text"):
            found = [(lang, fit) for lang, (name, fit) in ((lang, sent.value.nearest(text)) for lang, text in part) if name == lang]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k for k, _ in found], pa.string()), "fit": pa.array([v for _, v in found], pa.float64())})

    fits = learnt_rows(docs).mapInArrow(run, "lang string, fit double")
    return {r["lang"]: LEAST_SHARE * r["fit"] for r in fits.groupBy("lang").agg(F.percentile_approx("fit", 0.5).alias("fit")).collect()}  # a row a language


def keep(docs: DataFrame, languages: list[str] | None = None, least_fit: float | None = None) -> DataFrame:
    """The rows of docs whose language is known (and one of `languages`, if given), with their columns.

    A text must fit its language by least_fit, or where none is given by least_fits() of the training texts.
    """
    profiles = train(docs)
    run = identifier(docs.sparkSession, profiles)
    mark = common.fresh(docs, "__found")
    held = docs.select(*[F.col(f"`{c}`") for c in docs.columns], run("text").alias(mark))
    right = F.col(f"{mark}.lang_pred") != UNKNOWN
    if least_fit is not None:
        right &= F.col(f"{mark}.score") >= least_fit
    else:
        enough = F.lit(False)
        for name, least in least_fits(docs, profiles).items():
            enough |= (F.col(f"{mark}.lang_pred") == name) & (F.col(f"{mark}.score") >= least)
        right &= enough
    if languages is not None:
        right &= F.col(f"{mark}.lang_pred").isin(languages)
    return held.where(right).drop(mark)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
