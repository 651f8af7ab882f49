"""Operator 11: phrase collocations from vertical positional inverted lists.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line breaks and into words at spaces and tabs; everything is
counted per language. A map task turns its texts into chunks of one language: for each word of the chunk the sorted list of
its positions (as gaps). Positions count on by one from word to word and skip one between pieces, so that words stand side
by side within a piece if and only if their positions do.

A phrase's list holds the positions at which it begins; its length is the phrase's frequency in the chunk. Lists of one more
word come from merging a phrase's list, moved on by its words, with the lists of single words. Only phrases that are
frequent in the whole language are extended (each part of a frequent phrase is frequent), so between two lengths the chunks'
lengths of lists are shuffled by hash of the phrase into buckets, added up, and each chunk is told which of its phrases
are frequent. Frequent words get numbers in their bucket, so phrases are compared exactly, by their words' numbers.

Layout: chunks are written once to the shared folder, dealt by chunk, so that what buckets tell them comes to them by the
only shuffle of a length. A bucket holds at most one entry for each of a chunk's phrases, so that a phrase of a third of all
places has no more entries than there are chunks. Joins of candidates with their parts' frequencies keep parts that are
in more than limit candidates where they are (components.spread_join). The best of a language are found among the best of
each of its slices.

Arithmetic is exact: scores are quotients of decimals of up to 38 digits.

Defined results: a null text has no words, a null language is `und`; texts without words give no phrases; repeated rows
count each; ties are ordered by frequency and by the phrase's bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracksmith.llm import common, components

LEAST, LONGEST, TOP, SHARE = 10, 3, 2000, 50
SCALE = 1_000_000
#: Tokens of a chunk, entries of a bucket (about), candidates of a slice (about).
CHUNK_TOKENS = 1_000_000
BUCKET_TOKENS = 1_000_000
SLICE_ROWS = 500_000

#: What ends a piece, and what ends a word.
ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_FOLD = bytes(46 if c in ENDS else 32 if c in SPACES else common.LOWER[c] for c in range(256))
NONE = np.uint32(0xFFFFFFFF)


def tokens(text: str | None) -> list[bytes]:
    """A text's words, and a full stop between pieces."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(b".", b" . ").split()


class _Numbers(dict):
    """Numbers of words in order of their first appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


_CHUNK = "chunk string, lang string, n_tokens long, buckets binary, edges binary, words binary, lengths binary, gaps binary, far binary"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _gaps(positions: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted lists, one after the other, as 16-bit gaps; a larger one's upper part stands apart with its place."""
    gaps = np.diff(positions, prepend=0)
    gaps[starts] = positions[starts]
    high = np.flatnonzero(gaps >> 16)
    return gaps.astype(np.uint16).tobytes(), np.stack((high, gaps[high] >> 16)).astype(np.uint32).tobytes()


def _positions(gaps: bytes, far: bytes, lengths: np.ndarray) -> np.ndarray:
    """The lists of _gaps()."""
    step = np.frombuffer(gaps, np.uint16).astype(np.int64)
    place, high = np.frombuffer(far, np.uint32).reshape(2, -1)
    step[place] |= high.astype(np.int64) << 16
    total = np.cumsum(step)
    starts = np.cumsum(lengths) - lengths
    return total - np.repeat(total[starts] - step[starts], lengths)


def _lists(name: str, lang: str, numbers: _Numbers, at: list[int], buckets: int) -> tuple:
    """A chunk's row: words in order of bucket, and the list of each."""
    at = np.asarray(at)
    stop = numbers[b"."]
    words = list(numbers)
    bucket = np.fromiter((xxhash.xxh64_intdigest(word, zlib.crc32(lang.encode())) % buckets for word in words), np.int64, len(words))
    bucket[stop] = -1  # first, and then left out
    rank = np.empty(len(words), np.int64)
    order = np.argsort(bucket, kind="stable")
    rank[order] = np.arange(len(words))
    places = np.argsort(rank[at], kind="stable")
    lengths = np.bincount(rank[at], minlength=len(words))[1:]
    places = places[len(places) - lengths.sum() :]
    own, edges = np.unique(bucket[order[1:]], return_index=True)
    gaps, far = _gaps(places, np.cumsum(lengths) - lengths)
    return name, lang, int(lengths.sum()), own.astype(np.uint32).tobytes(), edges.astype(np.uint32).tobytes(), b" ".join(words[k] for k in order[1:]), lengths.astype(np.uint32).tobytes(), gaps, far


def chunks(docs: DataFrame, buckets: int, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The rows of _lists() of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, size = TaskContext.get().partitionId(), 0, 0
        held: dict[str, tuple[_Numbers, list[int]]] = {}

        def emit(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            numbers, at = held.pop(lang)
            size -= len(at)
            if len(numbers) > 1:
                yield common.record_batch(_arrow(_CHUNK), [_lists(f"{task}-{number}", lang, numbers, at, buckets)])
            number += 1

        for part in common.rows(batches, "lang", "text"):
            for lang, text in part:
                numbers, at = held.setdefault(lang, (_Numbers({b".": 0}), []))
                before = len(at)
                at.extend(map(numbers.__getitem__, tokens(text)))
                at.append(0)
                size += len(at) - before
                if size >= 2 * chunk_tokens or len(at) >= chunk_tokens:
                    yield from emit(max(held, key=lambda x: len(held[x][1])))
        for lang in list(held):
            yield from emit(lang)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, _CHUNK)


class Chunk:
    """A chunk's lists, with the numbers of its frequent words."""

    def __init__(self, row: dict, told: list[dict]) -> None:
        lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self.at = _positions(row["gaps"], row["far"], lengths)
        self.word = np.repeat(np.concatenate([np.frombuffer(t["told"], np.uint32) for t in told]), lengths)
        keep = self.word != NONE
        self.at, self.word = self.at[keep], self.word[keep]
        order = np.argsort(self.at)
        #: Lists of single words, merged: sorted positions and the word at each.
        self.at, self.word = self.at[order], self.word[order]

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of phrases of one word, and their numbers (one column)."""
        return self.at, self.word[:, None]

    def extend(self, at: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists of one more word: positions whose phrase is followed by a frequent word."""
        k = phrase.shape[1]
        place = np.searchsorted(self.at, at + k)
        place[place == len(self.at)] = 0
        found = self.at[place] == at + k if len(self.at) else np.zeros(0, bool)
        return at[found], np.column_stack((phrase[found], self.word[place[found]]))


def _keys(phrase: np.ndarray) -> list[np.ndarray]:
    """Columns of numbers, two in 64 bits."""
    wide = phrase.astype(np.uint64)
    return [wide[:, k] << np.uint64(32) | wide[:, k + 1] if k + 1 < wide.shape[1] else wide[:, k] for k in range(0, wide.shape[1], 2)]


def _mixed(keys: list[np.ndarray], buckets: int) -> np.ndarray:
    """A phrase's bucket."""
    out = np.zeros(len(keys[0]), np.uint64)
    with np.errstate(over="ignore"):
        for key in keys:
            out = (out ^ key) * np.uint64(0x9E3779B97F4A7C15)
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
    return (out % np.uint64(buckets)).astype(np.int64)


def grouped(phrase: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different phrases by bucket, the bucket and number of places of each, and the phrase of each row."""
    keys = _keys(phrase)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    starts = np.flatnonzero(new)
    bucket = _mixed([key[order[starts]] for key in keys], buckets)
    by_bucket = np.argsort(bucket, kind="stable")
    rank = np.empty(len(starts), np.int64)
    rank[by_bucket] = np.arange(len(starts))
    of_row = np.empty(len(order), np.int64)
    of_row[order] = rank[np.cumsum(new) - 1]
    return phrase[order[starts[by_bucket]]], bucket[by_bucket], np.diff(starts, append=len(order))[by_bucket], of_row


_COUNTS = "lang string, bucket long, chunk string, phrases binary, lengths binary"
#: What a bucket says: to a chunk (told) or of the whole language (one row a frequent phrase, chunk is null).
_SAYS = "lang string, bucket long, chunk string, told binary, phrase binary, n long"


def word_counts(lists: DataFrame) -> DataFrame:
    """For each chunk and bucket: words joined by spaces, and the lengths of their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.rows(batches, "chunk", "lang", "buckets", "edges", "words", "lengths", step=1):
            for chunk, lang, buckets, edges, words, lengths in part:
                words, lengths = words.split(b" "), np.frombuffer(lengths, np.uint32)
                edge = [*np.frombuffer(edges, np.uint32).tolist(), len(words)]
                yield common.record_batch(_arrow(_COUNTS), [(lang, int(b), chunk, b" ".join(words[i:j]), lengths[i:j].tobytes()) for b, i, j in zip(np.frombuffer(buckets, np.uint32), edge, edge[1:], strict=False)])

    return lists.select("chunk", "lang", "buckets", "edges", "words", "lengths").mapInArrow(run, _COUNTS)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one bucket and language, which stand side by side."""
    held: list[tuple] = []
    for part in common.rows(batches, "lang", "bucket", "chunk", "phrases", "lengths"):
        for row in part:
            if held and held[0][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _by_bucket(counts: DataFrame) -> DataFrame:
    return counts.repartition("bucket").sortWithinPartitions("bucket", "lang", "chunk")


def word_totals(counts: DataFrame, buckets: int, least: int) -> DataFrame:
    """_SAYS of words: told has the numbers of a chunk's words (NONE: infrequent), phrase is the word and its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, number = -1, 0
        for held in _groups(batches):
            lang, bucket = held[0][:2]
            if bucket != before:
                before, number = bucket, 0
            total: dict[bytes, int] = {}
            for *_, words, lengths in held:
                for word, n in zip(words.split(b" "), np.frombuffer(lengths, np.uint32).tolist(), strict=True):
                    total[word] = total.get(word, 0) + n
            named: dict[bytes, int] = {}
            for word in sorted(word for word, n in total.items() if n >= least):
                named[word] = number * buckets + bucket
                number += 1
            if number * buckets >= NONE:
                raise ValueError("over 2^32 frequent words")
            out = [(lang, bucket, chunk, np.fromiter((named.get(word, NONE) for word in words.split(b" ")), np.uint32).tobytes(), None, None) for _, _, chunk, words, _ in held]
            out += [(lang, bucket, None, word, np.array([k], ">u4").tobytes(), total[word]) for word, k in named.items()]
            yield common.record_batch(_arrow(_SAYS), out)

    return _by_bucket(counts).mapInArrow(run, _SAYS)


def phrase_counts(lists: DataFrame, told: list[DataFrame], buckets: int) -> DataFrame:
    """For each chunk and bucket: phrases of len(told) + 1 words that begin and end with a frequent one, and lengths of lists.

    told: what buckets said of phrases of one word, two words, and so on.
    """
    joined, names = lists, [f"told_{k}" for k in range(len(told))]
    for name, says in zip(names, told, strict=True):
        joined = joined.join(says.where("chunk is not null").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "told"))).alias(name)), "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["chunk", "lang", "lengths", "gaps", "far", *names]
        for part in common.rows(batches, *fields, step=1):
            for values in part:
                row = dict(zip(fields, values, strict=True))
                own = Chunk(row, row["told_0"])
                at, phrase = own.extend(*own.first())
                for name in names[1:]:
                    _, bucket, _, of_row = grouped(phrase, buckets)
                    sizes = np.bincount(bucket, minlength=buckets)
                    frequent = np.concatenate([np.unpackbits(np.frombuffer(t["told"], np.uint8), count=sizes[t["bucket"]]) for t in row[name]] or [np.empty(0, np.uint8)]).astype(bool)
                    keep = frequent[of_row]
                    at, phrase = at[keep], phrase[keep]
                    longer_at, longer = own.extend(at, phrase)
                    ends_well = np.isin(longer_at + 1, at, assume_unique=True)  # the rest of a frequent phrase is frequent
                    at, phrase = longer_at[ends_well], longer[ends_well]
                phrase, bucket, n, _ = grouped(phrase, buckets)
                own_buckets, edges = np.unique(bucket, return_index=True)
                edge = [*edges.tolist(), len(n)]
                out = []
                for b, i, j in zip(own_buckets.tolist(), edge, edge[1:], strict=False):
                    some = n[i:j]
                    out.append((row["lang"], b, row["chunk"], phrase[i:j].tobytes(), (some.astype(np.uint8) if some.max() < 256 else some.astype(np.uint32)).tobytes()))
                yield common.record_batch(_arrow(_COUNTS), out)

    return joined.select("chunk", "lang", "lengths", "gaps", "far", *names).mapInArrow(run, _COUNTS)


def phrase_totals(counts: DataFrame, words: int, buckets: int, least: int) -> DataFrame:
    """_SAYS of phrases: told has a bit for each of a chunk's phrases, phrase the numbers of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches):
            lang, bucket = held[0][:2]
            phrases = [np.frombuffer(p, np.uint32).reshape(-1, words) for *_, p, _ in held]
            lengths = np.concatenate([np.frombuffer(n, np.uint8 if len(n) == len(p) else np.uint32).astype(np.int64) for p, (*_, n) in zip(phrases, held, strict=True)])
            different, _, _, of_row = grouped(np.concatenate(phrases), 1)
            total = np.zeros(len(different), np.int64)
            np.add.at(total, of_row, lengths)
            frequent = total >= least
            edge = np.cumsum([0, *map(len, phrases)])
            out = [(lang, bucket, chunk, np.packbits(frequent[of_row[i:j]]).tobytes(), None, None) for (_, _, chunk, *_), i, j in zip(held, edge, edge[1:], strict=False)]
            numbers = different[frequent].astype(">u4")
            out += [(lang, bucket, None, None, p.tobytes(), n) for p, n in zip(numbers, total[frequent].tolist(), strict=True)]
            yield common.record_batch(_arrow(_SAYS), out)

    return _by_bucket(counts).mapInArrow(run, _SAYS)


def best(candidates: DataFrame, group: str, order: list, top: int, slices: int) -> DataFrame:
    """The first rows of each group with their rank: the first of each slice of the group, then the first of these."""
    slice_ = common.fresh(candidates, "slice")
    cut = candidates.withColumn(slice_, F.pmod(F.xxhash64(*candidates.columns), F.lit(slices)))
    some = cut.withColumn("rank", F.row_number().over(Window.partitionBy(group, slice_).orderBy(*order))).where(F.col("rank") <= top).drop(slice_, "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, bucket_tokens: int = BUCKET_TOKENS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to `longest` words of each language.

    A phrase of at least `least` places is left out if one that holds it has `share` hundredths of its places.
    """
    size = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(16, -(-int(size) // (5 * bucket_tokens)))  # a token has some six characters
    lists = common.cut(chunks(docs, buckets, chunk_tokens).repartition("chunk"))
    says = [common.cut(word_totals(word_counts(lists), buckets, least))]
    for words in range(2, longest + 1):
        says.append(common.cut(phrase_totals(phrase_counts(lists, says, buckets), words, buckets, least)))
    numbers = says[0].where("chunk is null").select("phrase", F.col("told").cast("string").alias("word"), F.col("n").alias("f"))
    whole = [s.where("chunk is null").select("lang", "phrase", F.col("n").alias("a")) for s in says]
    frequency = whole[0].select("phrase", F.col("a").alias("f"))
    longer = whole[1]
    for more in whole[1:]:
        frequency = frequency.unionByName(more.select("phrase", F.col("a").alias("f")))
    for more in whole[2:]:
        longer = longer.unionByName(more)

    # Parts of a longer phrase that it explains: 4 bytes a word.
    size_of = lambda c: (F.length(c) / 4).cast("int")
    inner = [longer.where(size_of("phrase") == n).select(F.col("a").alias("most"), F.explode(F.array(*[F.expr(f"substring(phrase, {4 * at + 1}, {4 * m})") for m in range(2, n) for at in range(n - m + 1)])).alias("phrase")) for n in range(3, longest + 1)]
    kept = longer
    if inner:
        held = inner[0]
        for more in inner[1:]:
            held = held.unionByName(more)
        held = held.groupBy("phrase").agg(F.max("most").alias("most"))
        kept = longer.join(held, "phrase", "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")

    totals = lists.groupBy("lang").agg(F.sum("n_tokens").alias("n"))
    tokens_ = lists.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    limit = components.most(int(tokens_))  # a part of that many places is in fewer candidates, and few parts have them
    named = frequency.select(F.col("phrase").alias("part"), "f", F.col("f").alias("n"))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr(f"sequence(1, cast(length(phrase) / 4 as int) - 1)")).alias("k"))
    cuts = cuts.select("*", F.expr("substring(phrase, 1, 4 * k)").alias("part"))
    cuts = components.spread_join(cuts, named, "part", limit).withColumnRenamed("f", "l").drop("part")
    cuts = cuts.select("*", F.expr("substring(phrase, 4 * k + 1)").alias("part"))
    cuts = components.spread_join(cuts, named, "part", limit).withColumnRenamed("f", "r").drop("part")
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumns({"above": F.lit(SCALE).cast("decimal(7,0)") * wide("a") * wide("a"), "below": wide("l") * wide("r")}).withColumn("score", F.expr("above div below"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # Words back for numbers, one place after the other.
    rows = lowest.withColumn("text", F.array().cast("array<string>"))
    spelt = numbers.select(F.col("phrase").alias("part"), "word", F.col("f").alias("n"))
    for k in range(longest):
        rows = rows.select("*", F.expr(f"substring(phrase, {4 * k + 1}, 4)").alias("part"))
        here = components.spread_join(rows.where("length(part) = 4"), spelt, "part", limit)
        rows = here.withColumn("text", F.concat("text", F.array("word"))).drop("word", "part").unionByName(rows.where("length(part) < 4").drop("part"))
        rows = common.cut(rows)
    found = rows.select("lang", F.concat_ws(" ", "text").alias("phrase"), "a", "l", "r", "score")
    slices = max(8, found.count() // SLICE_ROWS)
    ranked = best(found, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, slices)
    return ranked.join(F.broadcast(totals) if totals.count() <= components.HEAVY else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents", "lang", "text"))
