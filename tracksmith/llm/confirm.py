"""Exact check of near-duplicate candidates: Jaccard similarity of sets of word shingles, within classes of candidates.

Candidates come as classes of nodes (different shingle sets) that some looser rule connects. confirmed() returns links of
pairs whose similarity is really at least the one asked, enough to connect all that such pairs connect:

* A class is cut into chunks of about CHUNK shingles by a hash of the node, so a class of any size is many bounded tasks.
  In a chunk a breadth-first search drops what it has reached, so a dense group costs about as much as its texts are long.
* Classes of more than one chunk go on: the nodes that stand for a chunk's groups meet in a second search; the nodes that
  are still outside their class's largest group then visit every chunk of it, in blocks of CHUNK shingles.

Only a pair that also passes `fits`, a rule on the nodes' numbers, is compared exactly.
Texts travel once (those of classes of two or more); the sets are made where they are compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.llm import common
from tracksmith.llm.components import components

#: Shingles of one task's texts; only a single longer text exceeds it.
CHUNK = 1_500_000

Fits = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Sets:
    """Sets of numbers, side by side, with exact similarities of one to many."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.first = np.cumsum(self.size) - self.size
        values, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), bool)

    def alike(self, one: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Those of others whose Jaccard similarity with one is at least that."""
        n = self.size[one]
        sizes = self.size[others]
        others = others[(sizes > 0) & (np.minimum(n, sizes) >= similarity * np.maximum(n, sizes) - 1e-9)]
        if not len(others):
            return others
        sizes = self.size[others]
        edge = np.cumsum(sizes) - sizes
        own = self.code[self.first[one] : self.first[one] + n]
        self.mark[own] = True
        shared = np.add.reduceat(self.mark[self.code[np.repeat(self.first[others] - edge, sizes) + np.arange(sizes.sum())]].astype(np.int64), edge)
        self.mark[own] = False
        return others[shared >= similarity * (n + sizes - shared) - 1e-9]


def _chunk(table: pa.Table, numbers: list[str], shingles: Callable, name: Callable) -> tuple[np.ndarray, np.ndarray, Sets, pa.Table]:
    """Nodes, their numbers, their sets and rows of a chunk, once each; a row whose text is not its node's is left out."""
    nodes = table["node"].to_numpy()
    rows, sets = [], []
    seen = set()
    for at, node in enumerate(nodes.tolist()):
        if node in seen:
            continue
        found = shingles(table["text"][at].as_py())
        if name(found) == node:
            seen.add(node)
            rows.append(at)
            sets.append(found)
    table = table.take(pa.array(rows, pa.int64()))
    matrix = np.stack([table[n].to_numpy() for n in numbers], 1).view(np.uint64)
    return nodes[rows], matrix, Sets(sets or [np.empty(0, np.uint64)]), table


def _within(numbers: list[str], shingles: Callable, name: Callable, fits: Fits, similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Of a chunk: each node with the least node that it reaches."""

    def run(table: pa.Table) -> pa.Table:
        nodes, prints, sets, _ = _chunk(table, numbers, shingles, name)
        left = np.argsort(nodes)
        a, b = [], []
        while len(left):
            root, frontier, left = left[0], [left[0]], left[1:]
            while frontier and len(left):
                at = frontier.pop()
                near = sets.alike(at, left[fits(prints[left], prints[at])], similarity)
                if len(near):
                    a.append(nodes[near])
                    b.append(np.full(len(near), nodes[root]))
                    frontier.extend(near)
                    left = left[~np.isin(left, near)]
        return pa.table({"a": np.concatenate(a) if a else np.empty(0, np.int64), "b": np.concatenate(b) if b else np.empty(0, np.int64)})

    return run


def _visits(numbers: list[str], shingles: Callable, name: Callable, fits: Fits, similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Of a chunk and visitors: links between groups (labels) that differ, one at least where there are any."""

    def run(table: pa.Table) -> pa.Table:
        nodes, prints, sets, rows = _chunk(table, numbers, shingles, name)
        label = rows["label"].to_numpy().copy()
        visitor = rows["visitor"].to_numpy(zero_copy_only=False)
        home = np.flatnonzero(rows["home"].to_numpy(zero_copy_only=False))
        a, b = [], []
        for at in np.flatnonzero(visitor):
            others = home[label[home] != label[at]]
            for near in sets.alike(at, others[fits(prints[others], prints[at])], similarity):
                if label[near] != label[at]:
                    a.append(nodes[at])
                    b.append(nodes[near])
                    label[label == label[near]] = label[at]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _labels(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with the column label: the least node of the group that links make."""
    groups = components(links).select("node", F.col("component").alias("label"))
    return members.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _parts(df: DataFrame, chunk: int) -> DataFrame:
    """(component, chunks): in how many chunks the nodes of df go."""
    return df.groupBy("component").agg(F.ceil(F.sum("size") / F.lit(chunk)).alias("chunks"))


def confirmed(docs: DataFrame, members: DataFrame, numbers: list[str], shingles: Callable, name: Callable, fits: Fits, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between nodes.

    docs: doc_id long, text. members: (node, component, least, size, numbers...), a row a node, of classes of two nodes or
    more; least is the id of a text whose set it is, size the set's. shingles(text) is the sorted set, name(set) the node.
    """
    rule = (numbers, shingles, name, fits, similarity)

    def texts(nodes: DataFrame) -> DataFrame:
        return nodes.join(docs.select(F.col("doc_id").alias("least"), "text"), "least")

    def placed(nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))

    def search(nodes: DataFrame) -> DataFrame:
        return texts(nodes).groupBy("component", "chunk").applyInArrow(_within(*rule), "a long, b long")

    members = common.cut(placed(members.join(_parts(members, chunk), "component")))
    links = common.cut(search(members))
    large = members.where("chunks > 1")
    if large.isEmpty():
        return links
    heads = _labels(large, links).where("label = node").drop("label", "chunk", "chunks")
    links = common.cut(links.unionByName(search(placed(heads.join(_parts(heads, chunk), "component")))))
    labelled = common.cut(_labels(large, links))
    sizes = labelled.groupBy("component", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    outside = common.cut(labelled.join(main, "component").where("label <> main").drop("main"))
    if outside.isEmpty():
        return links
    blocks = _parts(outside, chunk).withColumnRenamed("chunks", "blocks")
    at_home = labelled.join(blocks, "component").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    guests = outside.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = at_home.withColumn("home", F.lit(True)).withColumn("visitor", F.lit(False)).unionByName(guests.withColumn("home", F.lit(False)).withColumn("visitor", F.lit(True)))
    key = [c for c in met.columns if c not in ("home", "visitor")]
    met = met.groupBy(*key).agg(F.max("home").alias("home"), F.max("visitor").alias("visitor"))
    return common.cut(links.unionByName(texts(met).groupBy("component", "chunk", "block").applyInArrow(_visits(*rule), "a long, b long")))
