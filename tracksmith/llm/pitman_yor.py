"""Operator 10: language-model scores from a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Tokens are words and one end a text. A word's restaurants form a tree: the leaf (a class of words before), its parent (the
last two bytes of the word before, which leaves share), the root, and the uniform base 1 / (V + 1). A table of a restaurant
is a customer of its parent. Leaves are classes: CONTEXT_BITS bits of hashes, of the suffix (SUFFIX_BITS) and of the word
before. Their number is fixed; what grows with the corpus are the dishes in them, (word, leaf) and their customers.

    p(w | r) = (c(w,r) - d t(w,r) + (theta + d T(r)) p(w | parent(r))) / (theta + C(r))

The state is the number of tables t of each dish (word, restaurant) with its c customers; sizes of tables are summed out.
With discount d = 1/2 the number of seatings of c customers at t tables (a generalised Stirling number) has a closed form,
so a dish's t, given all else, has weights whose ratios are

    P(t + 1) / P(t) = 2 p(w | parent) (c - t) (x + t) / (t (2 c - t - 1)),    x = 2 theta + tables of other dishes

They fall with t, so there is one mode; draw_tables() adds up from it as far as weights count at all, for any c. A Gibbs
sweep redraws all dishes' t from the leaves to the root, each given the other dishes' tables of the sweep before, so that
words don't wait for each other. Sweeps start at one table a dish. Probabilities are averaged over the last SAMPLES states,
each with the totals T and C of the very same state, so over all words and one unknown word they add up to one. Random
numbers are hashes of (word, restaurant, sweep): results don't depend on the layout. A text's score is the sum of log10 of
its tokens' averaged probabilities.

Layout: map tasks turn texts into one compact row for each (chunk of texts, bucket of words); everything about a word,
counts as well as tokens to be scored, is in the word's bucket, already added up by (word, context) within a text. The
rows are shuffled once, and checkpointed. One pass a sweep adds up the state's totals over buckets (a number a restaurant,
bounded by CONTEXT_BITS), repeating the sweeps before; the last pass scores and returns sums for the texts that have tokens
in a task's buckets, at most one a token. The end token, which every text has, is in no bucket: its counts by leaf are added up
from the chunks' heads, its restaurants are seated beside the buckets, and its probabilities (a number a leaf) are
broadcast. Memory: one bucket (about BUCKET_TOKENS tokens, more where one word alone has more).

Defined results: null and empty texts are one end token; null ids count as the empty text for the remainder; with no
training text every probability is uniform over one word; repeated rows are trained and scored each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm import common

CONTEXT_BITS, SUFFIX_BITS = 16, 8
LEAVES, PARENTS = 1 << CONTEXT_BITS, 1 << SUFFIX_BITS
DISCOUNT = 0.5
#: Of leaves, their parents and the root.
STRENGTHS = (1.0, 1.0, 1.0)
SWEEPS, SAMPLES = 3, 2
HELD_OUT = (7, 2)
CHUNK_TOKENS = 1_000_000
BUCKET_TOKENS = 1_000_000
WORDS_KEPT = 300_000
#: Weights below the largest by this factor's exponential don't count.
NEGLIGIBLE = 36.0
CELLS = 1_000_000
#: Texts whose sums a task holds, about.
TEXTS_HELD = 1_000_000


def code_of(word: bytes) -> int:
    """64 bits: a hash of the word's last two bytes, then the word's."""
    suffix = xxhash.xxh32_intdigest(word[-2:], 5) & (PARENTS - 1)
    return suffix << 64 - SUFFIX_BITS | xxhash.xxh64_intdigest(word) >> SUFFIX_BITS


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        code = self[word] = code_of(word)
        return code


_words = _Words()
#: No word is empty, so the empty one is a text's end, and the word before its first token.
END = code_of(b"")


def contexts_of(codes: np.ndarray) -> np.ndarray:
    """The leaf that follows each word."""
    return (codes >> np.uint64(64 - CONTEXT_BITS)).astype(np.uint16)


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's words and end, and the leaf of each."""
    found = common.lower_words(text)
    codes = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    codes = np.append(codes, np.uint64(END))
    return codes, contexts_of(np.append(np.uint64(END), codes[:-1]))


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (codes & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)


_ROW = "chunk string, bucket int, n_trained int, words binary, runs binary, texts binary, contexts binary, counts binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _chunk(name: str, held: list[tuple], buckets: int) -> list[tuple]:
    """Rows of a chunk of texts (codes, contexts, trained, doc_id): one a bucket, and the chunk's head (bucket below 0).

    Texts are numbered with those to be trained first. A bucket's row: words, entries a word, and each entry's text,
    context and count. End tokens are in no bucket: the head has the context of each.
    """
    held = sorted(held, key=lambda x: not x[2])
    trained = sum(t for _, _, t, _ in held)
    size = np.array([len(w) for w, *_ in held])
    code, context = np.concatenate([w for w, *_ in held]), np.concatenate([c for _, c, *_ in held])
    text = np.repeat(np.arange(len(held), dtype=np.uint32), size)
    last = np.cumsum(size) - 1
    endings = context[last]
    keep = np.ones(len(code), bool)
    keep[last] = False
    code, context, text = code[keep], context[keep], text[keep]
    bucket = bucket_of(code, buckets).astype(np.uint32)
    order = np.lexsort((context, text, code, bucket))
    code, context, text, bucket = code[order], context[order], text[order], bucket[order]
    first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (text[1:] != text[:-1]) | (context[1:] != context[:-1])))) if len(code) else np.empty(0, np.int64)
    count = np.diff(first, append=len(code)).astype(np.uint32)
    code, context, text, bucket = code[first], context[first], text[first], bucket[first]
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    small = np.uint16 if len(held) < 65536 else np.uint32
    out = []
    for b in np.flatnonzero(np.diff(edge)):
        s = slice(edge[b], edge[b + 1])
        w, n = code[s], count[s]
        at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        runs = np.diff(np.append(at, len(w))).astype(np.uint32)
        out.append((name, int(b), trained, w[at].tobytes(), runs.tobytes(), text[s].astype(small).tobytes(), context[s].tobytes(), (n.astype(np.uint8) if n.max() < 256 else n).tobytes()))
    ids = [i for *_, i in held]
    home = -1 - zlib.crc32(name.encode()) % buckets
    out.append((name, home, trained, size.astype(np.int64).tobytes(), np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), endings.tobytes(), b""))
    return out


def chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """The rows of _chunk() of all texts."""
    modulus, held_out = HELD_OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for part in common.rows(batches, "doc_id", "text"):
            for doc_id, text in part:
                code, context = tokens(text)
                held.append((code, context, common.remainder(doc_id, modulus) != held_out, doc_id))
                size += len(code)
                if size >= CHUNK_TOKENS:
                    yield common.record_batch(_schema(_ROW), _chunk(f"{task}-{number}", held, buckets))
                    number, held, size = number + 1, [], 0
        if held:
            yield common.record_batch(_schema(_ROW), _chunk(f"{task}-{number}", held, buckets))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROW)


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def uniform(code: np.ndarray, restaurant: np.ndarray | int, level: int, sweep: int) -> np.ndarray:
    """A number in [0, 1) of each dish, the same wherever it is drawn."""
    with np.errstate(over="ignore"):
        key = _mixed(code + np.uint64(0x9E3779B97F4A7C15)) + np.asarray(restaurant, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        key = _mixed(key ^ np.uint64(level << 8 | sweep))
    return (key >> np.uint64(11)) * 2.0**-53


def _ratio(t: np.ndarray, c: np.ndarray, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(t + 1) / P(t)."""
    return 2 * p * (c - t) * (x + t) / (t * (2 * c - t - 1))


def draw_tables(c: np.ndarray, x: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Tables of dishes with c customers, by inversion of u; x: 2 theta + tables of other dishes, p: the parent's probability."""
    t = np.minimum(c, 1)
    at = np.flatnonzero(c > 1)
    c, x, p, u = c[at].astype(float), x[at], p[at], u[at]
    low, high = np.ones(len(at)), c.copy()
    while (low < high).any():  # the mode: the least t whose next weight is smaller
        middle = np.floor((low + high) / 2)
        rises = (low < high) & (_ratio(middle, c, x, p) >= 1)
        high = np.where((low < high) & ~rises, middle, high)
        low = np.where(rises, middle + 1, low)
    mode = low
    bend = 1 / np.maximum(c - mode, 0.5) + 1 / mode - 1 / (x + mode) - 1 / (2 * c - mode - 1)
    half = np.ceil(9 / np.sqrt(np.maximum(bend, 1e-18)) + 9)
    out = np.empty(len(at), np.int64)
    left = np.arange(len(at))
    while len(left):
        first, last = np.maximum(1, mode[left] - half[left]), np.minimum(c[left], mode[left] + half[left])
        order = np.argsort(last - first, kind="stable")
        left, first, last = left[order], first[order], last[order]
        width = (last - first + 1).astype(np.int64)
        again = []
        low_at = 0
        while low_at < len(left):
            # Rows of a matrix: as many of at most twice the first one's width as CELLS allow.
            most = int(np.searchsorted(width, 2 * width[low_at], "right"))
            most = min(most, low_at + max(1, CELLS // int(width[most - 1])))
            some, a, b = left[low_at:most], first[low_at:most, None], last[low_at:most, None]
            place = a + np.arange(int(width[most - 1]))
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.log(_ratio(place[:, :-1], c[some, None], x[some, None], p[some, None]))
            weight = np.concatenate((np.zeros((len(some), 1)), np.cumsum(step, axis=1)), axis=1)
            weight[place > b] = -np.inf
            weight -= weight.max(1, keepdims=True)
            ends = weight[np.arange(len(some)), width[low_at:most] - 1]
            short = (a[:, 0] > 1) & (weight[:, 0] > -NEGLIGIBLE) | (b[:, 0] < c[some]) & (ends > -NEGLIGIBLE)
            total = np.exp(weight).cumsum(1)
            out[some] = a[:, 0] + np.minimum((u[some, None] * total[:, -1:] >= total).sum(1), width[low_at:most] - 1)
            again.append(some[short])
            low_at = most
        left = np.concatenate(again)
        half[left] *= 4
    t[at] = out
    return t


class Totals:
    """Of a state: tables T of each leaf, each parent and the root; customers C of leaves don't change."""

    def __init__(self, flat: np.ndarray) -> None:
        self.flat = flat
        self.c_leaf, self.t_leaf, rest = flat[:LEAVES].astype(float), flat[LEAVES : 2 * LEAVES].astype(float), flat[2 * LEAVES :]
        self.t_parent, self.t_root = rest[:PARENTS].astype(float), float(rest[PARENTS])
        self.c_parent, self.c_root = self.t_leaf.reshape(PARENTS, -1).sum(1), self.t_parent.sum()
        self.tokens, self.words = int(rest[PARENTS + 1]), int(rest[PARENTS + 2])
        self.base = 1 / (self.words + 1)


def parent_of(leaf: np.ndarray) -> np.ndarray:
    return leaf >> (CONTEXT_BITS - SUFFIX_BITS)


class Bucket:
    """Restaurants of the words of a bucket."""

    def __init__(self, code: np.ndarray, context: np.ndarray, count: np.ndarray) -> None:
        """Training entries in any order; equal (word, context) are added up. One table a dish."""
        key = np.lexsort((context, code))
        code, context, count = code[key], context[key].astype(np.int64), count[key].astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (context[1:] != context[:-1])))) if len(code) else np.empty(0, np.int64)
        self.context = context[new]
        self.c = [np.add.reduceat(count, new) if len(new) else count]
        self.words, self.of_word = np.unique(code[new], return_inverse=True)
        self.above, self.place = np.unique(self.of_word.astype(np.int64) * PARENTS + parent_of(self.context), return_inverse=True)
        self.word_of_above, self.parent = self.above // PARENTS, self.above % PARENTS
        self.own = self.of_word.astype(np.int64) * LEAVES + self.context
        self.counts = np.bincount(self.of_word, self.c[0], len(self.words)).astype(np.int64)
        ones = lambda n: np.ones(n, np.int64)
        self.t = [ones(len(self.context)), ones(len(self.above)), ones(len(self.words))]
        self._climb()

    def _climb(self) -> None:
        """Customers of parents are the tables below."""
        above = np.bincount(self.place, self.t[0], len(self.above)).astype(np.int64)
        self.c = [self.c[0], above, np.bincount(self.word_of_above, self.t[1], len(self.words)).astype(np.int64)]

    def totals(self) -> np.ndarray:
        """This bucket's share of Totals.flat."""
        by = lambda at, values, n: np.bincount(at, values, n).astype(np.int64)
        return np.concatenate((by(self.context, self.c[0], LEAVES), by(self.context, self.t[0], LEAVES), by(self.parent, self.t[1], PARENTS), [self.t[2].sum(), self.counts.sum(), len(self.words)]))

    def parents(self, state: Totals) -> tuple[np.ndarray, np.ndarray]:
        """p(word | root) of each word, p(word | parent) of each (word, parent)."""
        d, (_, middle, top) = DISCOUNT, STRENGTHS
        root = (self.c[2] - d * self.t[2] + (top + d * state.t_root) * state.base) / (top + state.c_root)
        y = self.parent
        return root, (self.c[1] - d * self.t[1] + (middle + d * state.t_parent[y]) * root[self.word_of_above]) / (middle + state.c_parent[y])

    def sweep(self, state: Totals, number: int) -> None:
        """One Gibbs sweep from the leaves to the root; state: the totals of the state that this bucket is in."""
        root, above = self.parents(state)
        x = [STRENGTHS[0] / DISCOUNT + state.t_leaf[self.context] - self.t[0], STRENGTHS[1] / DISCOUNT + state.t_parent[self.parent] - self.t[1], STRENGTHS[2] / DISCOUNT + state.t_root - self.t[2]]
        self.t[0] = draw_tables(self.c[0], x[0], above[self.place], uniform(self.words[self.of_word], self.context, 0, number))
        self._climb()
        self.t[1] = draw_tables(self.c[1], x[1], root[self.word_of_above], uniform(self.words[self.word_of_above], self.parent, 1, number))
        self._climb()
        self.t[2] = draw_tables(self.c[2], x[2], np.full(len(self.words), state.base), uniform(self.words, 0, 2, number))

    def chain(self, states: list[Totals]) -> Iterator[int]:
        """Sweep from each of the states to the next; yields the number of the state that this bucket is in."""
        for number, state in enumerate(states):
            yield number
            self.sweep(state, number + 1)
        yield len(states)

    def locate(self, code: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of entries' words, (word, parent) and (word, context); -1 where there is none."""
        def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
            at = np.searchsorted(sorted_keys, keys)
            at[at == len(sorted_keys)] = 0
            return np.where(sorted_keys[at] == keys, at, -1) if len(sorted_keys) else np.full(len(keys), -1)

        w = find(self.words, code)
        known = w >= 0
        y, x = np.full(len(w), -1), np.full(len(w), -1)
        leaf = context[known].astype(np.int64)
        y[known] = find(self.above, w[known] * PARENTS + parent_of(leaf))
        x[known] = find(self.own, w[known] * LEAVES + leaf)
        return w, y, x

    def probability(self, context: np.ndarray, places: tuple[np.ndarray, ...], state: Totals) -> np.ndarray:
        """Of entries at places (of locate()); state: the totals of the state that this bucket is in."""
        w, y, x = places
        d, (leaf, middle, top) = DISCOUNT, STRENGTHS
        root, above = self.parents(state)
        take = lambda values, at: np.where(at >= 0, values[at], 0) if len(values) else np.zeros(len(at))
        p = np.where(w >= 0, take(root, w), (top + d * state.t_root) * state.base / (top + state.c_root))
        k = parent_of(context.astype(np.int64))
        p = np.where(y >= 0, take(above, y), (middle + d * state.t_parent[k]) * p / (middle + state.c_parent[k]))
        return (take(self.c[0] - d * self.t[0], x) + (leaf + d * state.t_leaf[context]) * p) / (leaf + state.c_leaf[context])

    def average(self, code: np.ndarray, context: np.ndarray, states: list[Totals]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each entry, averaged over the last states, and its word's count in training."""
        places = self.locate(code, context)
        mean = np.zeros(len(code))
        for number in self.chain(states[:-1]):
            if number >= len(states) - SAMPLES:
                mean += self.probability(context, places, states[number]) / SAMPLES
        return mean, np.where(places[0] >= 0, self.counts[places[0]], 0) if len(self.counts) else np.zeros(len(code), np.int64)


class Entries:
    """Rows of a bucket, one a chunk, as arrays."""

    def __init__(self, rows: list[tuple]) -> None:
        codes, texts, contexts, counts, trained, self.chunks, chunk_of = [], [], [], [], [], [], []
        for chunk, _, n_trained, words, runs, text, context, count in rows:
            run = np.frombuffer(runs, np.uint32)
            n = int(run.sum())
            text = np.frombuffer(text, np.uint16 if len(text) == 2 * n else np.uint32).astype(np.uint32)
            codes.append(np.repeat(np.frombuffer(words, np.uint64), run))
            texts.append(text)
            contexts.append(np.frombuffer(context, np.uint16))
            counts.append(np.frombuffer(count, np.uint8 if len(count) == n else np.uint32).astype(np.uint32))
            trained.append(text < n_trained)
            chunk_of.append(np.full(n, len(self.chunks), np.int32))
            self.chunks.append(chunk)
        self.code, self.text, self.context = np.concatenate(codes), np.concatenate(texts), np.concatenate(contexts)
        self.count, self.trained, self.chunk_of = np.concatenate(counts), np.concatenate(trained), np.concatenate(chunk_of)

    def model(self) -> Bucket:
        some = self.trained
        return Bucket(self.code[some], self.context[some], self.count[some])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for part in common.rows(batches, *[c.split()[0] for c in _ROW.split(", ")], step=64):
        for row in part:
            if held and held[0][1] != row[1]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


SLICES = 16
_SLICE = "slice int, numbers binary"


def _added(rows: DataFrame, run) -> np.ndarray | None:
    """Sum of the arrays that tasks give in slices; a slice a task adds up, and a fixed number of sums comes to the driver."""

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.int64) for b in part["numbers"].to_pylist())
        return pa.Table.from_batches([common.record_batch(_schema(_SLICE), [(part["slice"][0].as_py(), total.tobytes())])])

    found = {r["slice"]: np.frombuffer(r["numbers"], np.int64) for r in rows.mapInArrow(run, _SLICE).groupBy("slice").applyInArrow(add, _SLICE).collect()}
    return np.concatenate([found[k] for k in range(SLICES)]) if found else None


def _sliced(flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    if flat.any():
        yield common.record_batch(_schema(_SLICE), [(k, part.tobytes()) for k, part in enumerate(np.array_split(flat, SLICES))])


def end_counts(rows: DataFrame) -> np.ndarray:
    """How many end tokens of training stand after each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(LEAVES, np.int64)
        for part in common.rows(batches, "n_trained", "contexts", step=16):
            for trained, contexts in part:
                flat += np.bincount(np.frombuffer(contexts, np.uint16)[:trained], minlength=LEAVES)
        yield from _sliced(flat)

    counts = _added(rows.where("bucket < 0"), run)
    return np.zeros(LEAVES, np.int64) if counts is None else counts


def end_model(counts: np.ndarray) -> Bucket:
    """The end token's restaurants, one table a dish."""
    leaf = np.flatnonzero(counts)
    return Bucket(np.full(len(leaf), END, np.uint64), leaf.astype(np.uint16), counts[leaf])


def _state(rows: DataFrame, ends: Bucket, states: list[Totals]) -> Totals:
    """Totals of the state after the last of the states."""
    sent = rows.sparkSession.sparkContext.broadcast([s.flat for s in states])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [Totals(flat) for flat in sent.value]
        flat = np.zeros(2 * LEAVES + PARENTS + 3, np.int64)
        for held in _by_bucket(batches):
            model = Entries(held).model()
            for _ in model.chain(before):
                pass
            flat += model.totals()
        yield from _sliced(flat)

    total = _added(rows.where("bucket >= 0"), run)
    if states:
        ends.sweep(states[-1], len(states))
    return Totals(ends.totals() if total is None else total + ends.totals())


_PART = "chunk string, kind int, n_trained int, texts binary, score binary, logs binary, known binary, sizes binary, ids binary, nulls binary, endings binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _endings(ends: Bucket, states: list[Totals]) -> tuple[np.ndarray, int]:
    """log10 of the end token's probability after each leaf, and its count in training."""
    mean, count = ends.average(np.full(LEAVES, END, np.uint64), np.arange(LEAVES).astype(np.uint16), states)
    return np.log10(mean), int(count[0])


def scores(docs: DataFrame, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    size = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(16, -(-int(size) // (5 * bucket_tokens)))  # a token has some six characters
    rows = common.cut(chunks(docs, buckets).repartition("bucket").sortWithinPartitions("bucket", "chunk"))
    states: list[Totals] = []
    n_ends = end_counts(rows)
    ends = end_model(n_ends)
    for _ in range(SWEEPS + 1):
        states.append(_state(rows, ends, states))
    train_tokens, vocabulary = states[0].tokens, states[0].words
    context = docs.sparkSession.sparkContext
    sent, end_scores_of = context.broadcast([s.flat for s in states]), context.broadcast(_endings(end_model(n_ends), states))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_states = [Totals(flat) for flat in sent.value]
        sums: dict[str, np.ndarray] = {}

        def emit() -> pa.RecordBatch:
            out = []
            for chunk, own in sums.items():
                at = np.flatnonzero(own[3])
                out.append((chunk, 1, None, at.astype(np.uint32).tobytes(), own[0][at].astype(np.float32).tobytes(), own[1][at].tobytes(), own[2][at].astype(np.uint32).tobytes(), None, None, None, None))
            sums.clear()
            return common.record_batch(_schema(_PART), out)

        for held in _by_bucket(batches):
            data = Entries(held)
            mean, c = data.model().average(data.code, data.context, model_states)
            count = data.count
            values = (count * np.log10(mean), count * np.log10(c + 1.0), count * (c > 0), count)
            edge = np.searchsorted(data.chunk_of, np.arange(len(data.chunks) + 1))
            for k, chunk in enumerate(data.chunks):
                s = slice(edge[k], edge[k + 1])
                texts = int(data.text[s].max()) + 1
                own = sums.setdefault(chunk, np.zeros((4, texts)))
                if own.shape[1] < texts:
                    own = sums[chunk] = np.concatenate((own, np.zeros((4, texts - own.shape[1]))), axis=1)
                for i, v in enumerate(values):
                    own[i, :texts] += np.bincount(data.text[s], v[s], texts)
            if sum(own.shape[1] for own in sums.values()) > TEXTS_HELD:
                yield emit()
        if sums:
            yield emit()

    partial = rows.where("bucket >= 0").mapInArrow(score, _PART)
    none = F.lit(None).cast("binary")
    heads = rows.where("bucket < 0").select("chunk", F.lit(0).alias("kind"), "n_trained", none.alias("texts"), none.alias("score"), none.alias("logs"), none.alias("known"), F.col("words").alias("sizes"), F.col("runs").alias("ids"), F.col("texts").alias("nulls"), F.col("contexts").alias("endings"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end_scores, end_count = end_scores_of.value

        def whole(head: dict, sums: np.ndarray) -> pa.RecordBatch:
            n = np.frombuffer(head["sizes"], np.int64)
            ids = pa.array(np.frombuffer(head["ids"], np.int64), mask=np.frombuffer(head["nulls"], np.uint8) > 0)
            base = sums[1] + math.log10(end_count + 1) - n * math.log10(train_tokens + vocabulary + 1)
            known = sums[2].round().astype(np.int64) + (end_count > 0)
            columns = [ids, np.arange(len(n)) >= head["n_trained"], n, known, np.full(len(n), train_tokens), base, sums[0] + end_scores[np.frombuffer(head["endings"], np.uint16)]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_schema(RESULT))

        names = [c.split()[0] for c in _PART.split(", ")]
        head, sums = None, np.empty(0)
        for part in common.rows(batches, *names, step=64):
            for row in part:
                row = dict(zip(names, row, strict=True))
                if row["kind"] == 0:
                    if head is not None:
                        yield whole(head, sums)
                    head, sums = row, np.zeros((3, len(row["sizes"]) // 8))
                else:
                    at = np.frombuffer(row["texts"], np.uint32)
                    sums[:, at] += np.stack([np.frombuffer(row["score"], np.float32).astype(float), np.frombuffer(row["logs"], float), np.frombuffer(row["known"], np.uint32).astype(float)])
        if head is not None:
            yield whole(head, sums)

    return heads.unionByName(partial).repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(finish, RESULT)


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents", "doc_id", "text"))
