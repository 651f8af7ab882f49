"""Operator 9: SimHash near-duplicates by anchor points of a covering code.

A text's fingerprint has a bit set where over half of its shingles' XXH64 have it set. Fingerprints that differ in
RADIUS (4) bits or fewer are linked. To find all links without comparing all pairs:

* 64 bits are cut into three blocks (22, 21, 21); two fingerprints within 4 bits differ in at most one bit in some block.
* A block's anchors are a covering code: the perfect Hamming code of 15 bits (covering radius 1) times all values of
  the 6 or 7 bits left. Every block value is within 1 bit of an anchor, its home.
* Each fingerprint is replicated to every anchor within covering radius + threshold = 2 bits. Whoever is within one
  bit of it in the block has its home among these. So each anchor compares those at home with all that were sent there.

Equal fingerprints are one node from the start. An anchor's rows stream through a task in order of the anchor. Small
anchors are compared by shifts over the whole batch; in a large one (a big group of near copies) a breadth-first search
drops what it has reached, so that dense groups cost about as much as they have members. A batch of anchors emits each
fingerprint with the least that it reaches there, not all pairs; connected components of these are those of all links.

classes() has these fingerprints. similar() and keep_one() have them too, found by the same anchors: whatever classes()
links is linked there. Besides, they link texts of a similarity of 0.8 or more in five-word shingles, most of which lie about
10 of 64 bits apart, too far for any index of 4. For these a text has two more things, both of its set of five-word
shingles alone, so that it doesn't matter whether copies differ in scattered words or in one passage:

* BANDS keys, each of the least values that BAND_ROWS hashes take on the set. Two sets have such a least value in common
  with a probability of their similarity, so a pair at 0.8 has no key in common with a probability of (1 - 0.8^5)^40,
  1.2e-7. Each key is an anchor that all its texts are at home at.
* LIKE, a SimHash of 256 bits: sets of similarity s differ in a share arccos(2 s / (1 + s)) / pi of the bits in the mean at
  the most, 39 at 0.8; the smallest sets (four of five shingles) in 48, as a tie gives a zero, with a standard deviation
  of 6. LIKE_RADIUS (80) lies five above that.

Two texts are candidates if they share a key and LIKE holds; those connected make a class. Such texts are linked if the
Jaccard similarity of their sets of five-word shingles, taken within the classes (confirm.py), really is 0.8 or more.
Groups are the connected components of both kinds of links together.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; rows with a null
doc_id have a fingerprint but no component and link nobody; repeated rows give repeated rows; rows of one id and different
texts are linked each by its own text; an empty table gives no rows; other columns are ignored, or kept by keep_one(),
where of each group the row of the least (id, hash of the text) stays, once if it is repeated, and rows with a null id stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm import common, confirm
from tracksmith.llm.components import components, most, spread_join

SHINGLE = 4
SEED = 42
RADIUS = 4
#: First bit and bits of each block of 64 bits.
BLOCKS = ((0, 22), (22, 21), (43, 21))
CODE_BITS = 15
LIKE_SHINGLE, LIKE_WORDS, SIMILARITY = 5, 4, 0.8
BANDS, BAND_ROWS = 40, 5
#: The largest share of bits in which two sets of that similarity differ in the mean: four shingles of five.
_SHARE = 3 / 16
LIKE_RADIUS = math.ceil(64 * LIKE_WORDS * _SHARE + 5 * math.sqrt(64 * LIKE_WORDS * _SHARE * (1 - _SHARE)))
#: Anchors of more rows are searched breadth-first.
LARGE = 96


def fingerprint(text: str | None) -> int:
    words = common.lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    found = np.array(hashes, np.uint64)
    for at in range(0, len(found), 8192):
        total += np.unpackbits(found[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * total > len(found)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.rows(batches, "doc_id", "text"):
            found = np.array([fingerprint(t) for _, t in part], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array(found)], schema=_FINGERPRINTS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _spread(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several independent hashes of each hash."""
    with np.errstate(over="ignore"):
        a = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return a ^ (a >> np.uint64(32))


def _majority(hashes: np.ndarray, n: int) -> np.ndarray:
    """SimHash of 64 n bits as n numbers."""
    total = np.zeros(64 * n, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        total += np.unpackbits(np.stack([_spread(part, k) for k in range(n)], 1).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)


_ODD = _spread(np.arange(BANDS * BAND_ROWS, dtype=np.uint64), 40) | np.uint64(1)
_FLIP = _spread(np.arange(BANDS * BAND_ROWS, dtype=np.uint64), 41)


def bands(shingles: np.ndarray) -> np.ndarray:
    """Keys of a set of shingle hashes that is not empty; which band a key is of goes into it."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        part = shingles[at : at + 256]
        least = np.minimum(least, ((part[None, :] ^ _FLIP[:, None]) * _ODD[:, None]).min(1))
    key = _spread(np.arange(BANDS, dtype=np.uint64), 42)
    for k in range(BAND_ROWS):
        key = _spread(key ^ least[k::BAND_ROWS], 43)
    return key


def _runs(codes: np.ndarray) -> np.ndarray:
    """A hash of each shingle of LIKE_SHINGLE words (of the whole text, if shorter)."""
    size = min(LIKE_SHINGLE, len(codes))
    runs = np.zeros(max(len(codes) - size + 1, 0) if size else 0, np.uint64)
    for k in range(size):
        runs = _spread(runs ^ codes[k : k + len(runs)], 7 + k)
    return runs


def _codes(text: str | None) -> np.ndarray:
    words = common.lower_words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of a text's different shingles, in order; none if there is no word."""
    return np.unique(_runs(_codes(text)))


def set_name(shingles: np.ndarray) -> int:
    """One number for a shingle set, as a signed long; 0 for the empty set."""
    return int(_spread(shingles, 20).sum(dtype=np.uint64).view(np.int64)) if len(shingles) else 0


def signature(text: str | None) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Name and size of the shingle set, its LIKE fingerprint as LIKE_WORDS numbers and its band keys; zeros and no key if there is no word."""
    shingles = shingle_set(text)
    if not len(shingles):
        return 0, 0, np.zeros(LIKE_WORDS, np.uint64), np.empty(0, np.uint64)
    return set_name(shingles), len(shingles), _majority(shingles, LIKE_WORDS), bands(shingles)


_SIGNATURE = [f"w{k}" for k in range(LIKE_WORDS)]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, node, size, w0, w1, ..., bands) of every row; numbers as signed longs, bands as the keys' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.rows(batches, "doc_id", "text", "text_hash"):
            found = [signature(t) for _, t, _ in part]
            prints = np.array([p for _, _, p, _ in found], np.uint64).reshape(len(part), -1).view(np.int64)
            own = {"doc_id": pa.array([i for i, *_ in part], pa.int64()), "text_hash": pa.array([h for *_, h in part], pa.int64()), "fp": np.array([fingerprint(t) for _, t, _ in part], np.uint64).view(np.int64), "node": pa.array([n for n, *_ in found], pa.int64()), "size": pa.array([n for _, n, *_ in found], pa.int64())}
            yield pa.RecordBatch.from_pydict(own | {w: prints[:, k] for k, w in enumerate(_SIGNATURE)} | {"bands": pa.array([b.tobytes() for *_, b in found], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, ", ".join(["doc_id long", "text_hash long", "fp long", "node long", "size long", *[f"{w} long" for w in _SIGNATURE], "bands binary"]))


def _alike(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which rows of numbers are within LIKE_RADIUS of one."""
    return np.bitwise_count(many ^ one).sum(1, dtype=np.int64) <= LIKE_RADIUS


class Rule(NamedTuple):
    """When nodes are linked: the first `words` numbers differ in `radius` bits at most, the others in `like` (if there are any)."""

    words: int = 1
    radius: int = RADIUS
    like: int | None = None

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row by row; a, b: matrices of numbers, or one of them a single row."""
        near = np.bitwise_count(a[..., : self.words] ^ b[..., : self.words]).sum(-1, dtype=np.int64) <= self.radius
        if self.like is not None:
            at = np.flatnonzero(near)
            near[at] = np.bitwise_count((a[at] if a.ndim == 2 else a)[..., self.words :] ^ (b[at] if b.ndim == 2 else b)[..., self.words :]).sum(-1, dtype=np.int64) <= self.like
        return near


CONTRACT = Rule()
SIMILAR = Rule(0, 0, LIKE_RADIUS)


def _syndrome(bits: np.ndarray) -> np.ndarray:
    """Of the Hamming code: the xor of the (one-based) places of set bits; a code word has 0."""
    out = np.zeros(bits.shape, np.uint64)
    for place in range(1, CODE_BITS + 1):
        out ^= ((bits >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    return out


def anchors(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, row of prints, whether it is the home) for every anchor within 2 bits of a block, block by block.

    prints: a row of 64-bit numbers a fingerprint; each number has three blocks.
    """
    everyone = np.arange(len(prints))
    one = np.uint64(1)
    for block in range(len(BLOCKS) * prints.shape[1]):
        number, (first, width) = block // len(BLOCKS), BLOCKS[block % len(BLOCKS)]
        value = (prints[:, number] >> np.uint64(first)) & np.uint64((1 << width) - 1)
        code, free = value & np.uint64((1 << CODE_BITS) - 1), value >> np.uint64(CODE_BITS)
        syndrome = _syndrome(code)
        mark = np.uint64(block) << np.uint64(40)

        def cell(code: np.ndarray, free: np.ndarray, mark: np.uint64 = mark) -> np.ndarray:
            return (mark | free << np.uint64(CODE_BITS) | code).view(np.int64)

        off = syndrome != 0
        home = np.where(off, code ^ (one << (np.maximum(syndrome, one) - one)), code)
        yield cell(home, free), everyone, np.ones(len(prints), bool)
        for i in range(width - CODE_BITS):  # the home code word, the free bits one away
            yield cell(home, free ^ (one << np.uint64(i))), everyone, np.zeros(len(prints), bool)
            for j in range(i):  # two away, where the code bits are a word themselves
                some = everyone[~off]
                yield cell(home[some], free[some] ^ (one << np.uint64(i)) ^ (one << np.uint64(j))), some, np.zeros(len(some), bool)
        for place in range(1, CODE_BITS + 1):  # code words two bits away: flip `place` and the place that mends the rest
            other = syndrome ^ np.uint64(place)
            some = everyone[off & (other > np.uint64(place))]
            flips = (one << np.uint64(place - 1)) | (one << (other[some] - one))
            yield cell(code[some] ^ flips, free[some]), some, np.zeros(len(some), bool)


def _tree(key: np.ndarray, prints: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links that connect those rows of prints (all different) that are connected, in one anchor."""
    left = np.arange(len(key))
    links = []
    while len(left):
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            near = rule.holds(prints[left], prints[frontier.pop()])
            if near.any():
                reached = left[near]
                links.extend((int(x), int(key[root])) for x in key[reached])
                frontier.extend(reached)
                left = left[~near]
    return links


def _stars(pairs: np.ndarray) -> np.ndarray:
    """Links that connect what pairs connect: each key with the least one it reaches, so no more links than keys."""
    keys, place = np.unique(pairs, return_inverse=True)
    a, b = place.reshape(-1, 2).T
    label = np.arange(len(keys))
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(keys))
    return np.stack([keys[moved], keys[label[moved]]], 1)


def _compare(cell: np.ndarray, home: np.ndarray, key: np.ndarray, prints: np.ndarray, rule: Rule) -> np.ndarray:
    """Links (n x 2, of keys) within whole anchors; rows are in order of the anchor, those at home first."""
    start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.append(start, len(cell)))
    out = []
    small = np.repeat(size <= LARGE, size)
    place = np.arange(len(cell)) - np.repeat(start, size)
    room = np.repeat(size, size) - place  # rows from here to the anchor's end
    at = np.flatnonzero(small & home & (room > 1))
    shift = 1
    while len(at):
        near = rule.holds(prints[at], prints[at + shift])
        out.append(np.stack([key[at[near]], key[at[near] + shift]], 1))
        shift += 1
        at = at[room[at] > shift]
    for k in np.flatnonzero(size > LARGE):
        whole = slice(start[k], start[k] + size[k])
        links = _tree(key[whole], prints[whole], rule)
        if links:
            out.append(np.array(links, np.int64))
    return _stars(np.concatenate(out)) if out else np.empty((0, 2), np.int64)


def links(nodes: DataFrame, key: str = "fp", numbers: tuple[str, ...] | list[str] = ("fp",), rule: Rule = CONTRACT) -> DataFrame:
    """(a, b): links between keys of nodes, enough to connect all that are connected.

    nodes: one row for each different fingerprint, whose 64-bit parts are the columns `numbers`, as signed longs. Their
    anchors are those of the first rule.words numbers; if that is 0, the keys in the column `bands`.
    """
    carried = list(dict.fromkeys([key, *numbers]))
    of = [carried.index(n) for n in numbers]

    def matrix(columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([columns[k] for k in of], 1).view(np.uint64)

    def keyed(part: pa.RecordBatch) -> pa.RecordBatch:
        held = [b or b"" for b in part.column(len(carried)).to_pylist()]
        at = np.repeat(np.arange(len(held)), [len(b) // 8 for b in held])
        cell = np.frombuffer(b"".join(held), np.int64)
        return pa.RecordBatch.from_pydict({"cell": cell, "home": np.ones(len(at), bool)} | {c: part.column(k).to_numpy(zero_copy_only=False)[at] for k, c in enumerate(carried)})

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1_000):
                part = batch.slice(low, 1_000)
                if not rule.words:
                    yield keyed(part)
                    continue
                columns = [part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(carried))]
                found = list(anchors(matrix(columns)[:, : rule.words]))
                at = np.concatenate([i for _, i, _ in found])
                yield pa.RecordBatch.from_pydict({"cell": np.concatenate([c for c, _, _ in found]), "home": np.concatenate([h for _, _, h in found])} | {c: columns[k][at] for k, c in enumerate(carried)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def pairs(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            found = _compare(columns[0], columns[1], columns[2], matrix(list(columns[2:])), rule)
            return pa.RecordBatch.from_pydict({"a": found[:, 0], "b": found[:, 1]})

        for batch in batches:
            new = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(2 + len(carried)))
            if not len(new[0]):
                continue
            held.append(new)
            if held[0][0][0] != new[0][-1]:  # a new anchor has begun: all anchors before it are whole
                whole = tuple(np.concatenate([h[k] for h in held]) for k in range(len(new)))
                edge = int(np.searchsorted(whole[0], whole[0][-1]))
                held = [tuple(c[edge:] for c in whole)]
                yield pairs(tuple(c[:edge] for c in whole))
        if held:
            yield pairs(tuple(np.concatenate([h[k] for h in held]) for k in range(len(held[0]))))

    cells = nodes.select(*carried, *(() if rule.words else ("bands",))).mapInArrow(replicate, ", ".join(["cell long", "home boolean", *[f"{c} long" for c in carried]]))
    return cells.repartition("cell").sortWithinPartitions("cell", F.desc("home")).mapInArrow(compare, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    found = common.cut(fingerprints(docs))
    limit = most(found.count())
    nodes = common.cut(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    known = nodes.where("least is not null").select("fp", "least")
    groups = components(links(known))
    joined = known.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = spread_join(joined, joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "component", limit)
    named = common.cut(nodes.select("fp", "n").join(named.select("fp", "component_id"), "fp", "left"))
    return spread_join(found, named, "fp", limit).select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _fingerprint_links(found: DataFrame, limit: int) -> DataFrame:
    """(a, b): links between nodes that have one fingerprint, or fingerprints within RADIUS; enough to connect all of them."""
    held = common.cut(found.select("fp", "node").distinct())
    first = common.cut(held.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    same = spread_join(held, first, "fp", limit).select(F.col("node").alias("a"), F.col("first").alias("b"))
    return common.cut(links(first.select(F.col("first").alias("node"), "fp"), "node").unionByName(same).where("a <> b"))


def _grouped(docs: DataFrame, chunk: int) -> DataFrame:
    """(doc_id, text_hash, best) of every row of docs with an id; best is the least (doc_id, text_hash) of the row's group."""
    found = common.cut(signatures(docs).where("doc_id is not null"))
    limit = most(found.count())
    row = F.min(F.struct("doc_id", "text_hash", "size", *_SIGNATURE, "bands")).alias("row")
    nodes = common.cut(found.groupBy("node").agg(row, F.count("*").alias("n")).select("node", "n", F.struct("row.doc_id", "row.text_hash").alias("own"), F.col("row.doc_id").alias("least"), "row.size", *[f"row.{w}" for w in _SIGNATURE], "row.bands"))
    members = nodes.drop("bands", "n", "own").join(components(links(nodes, "node", _SIGNATURE, SIMILAR)), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    alike = confirm.confirmed(texts, members, _SIGNATURE, shingle_set, set_name, _alike, SIMILARITY, chunk)
    groups = components(_fingerprint_links(found, limit).unionByName(alike))
    joined = nodes.select("node", "own", F.col("n").alias("rows")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = spread_join(joined, joined.groupBy("component").agg(F.min("own").alias("best"), F.count("*").alias("n")), "component", limit)
    named = common.cut(named.select("node", "best", F.col("rows").alias("n")))
    return spread_join(found.select("doc_id", "text_hash", "node"), named, "node", limit).select("doc_id", "text_hash", "best")


def similar(docs: DataFrame, chunk: int = confirm.CHUNK) -> DataFrame:
    """(doc_id, component_id) of every row of docs: what classes() links and texts of similarity 0.8 are linked, a component is named by its least id."""
    nameless = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("component_id")).where("doc_id is null")
    return _grouped(docs, chunk).select("doc_id", F.col("best.doc_id").alias("component_id")).unionByName(nameless)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs of each group of similar(), that of the least (id, hash of the text); rows with a null id stay."""
    key, text = common.fresh(docs, "__id"), common.fresh(docs, "__hash")
    rows = common.cut(_grouped(docs, confirm.CHUNK).select(F.col("doc_id").alias(key), F.col("text_hash").alias(text), (F.struct("doc_id", "text_hash") == F.col("best")).alias("stays")))
    gone = rows.where("not stays").select(key, text).distinct()
    twice = rows.where("stays").groupBy(key, text).count().where("count > 1").select(key, text)
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("doc_id").cast("long").alias(key), F.xxhash64("text").alias(text))
    kept = keyed.join(gone, [key, text], "left_anti")
    if not twice.isEmpty():
        kept = kept.join(twice, [key, text], "left_anti").unionByName(kept.join(twice, [key, text], "left_semi").dropDuplicates([key, text]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
