"""Operator 12: centroid clustering of integer vectors by blocked matrix products, with exact arithmetic.

A component x becomes the integer floor(1024 x). Squared distances are |x|^2 - 2 x.c + |c|^2, one float64 matrix product a
block. All its terms are integers; if no component of a vector or of a centroid is over safe(), every sum of them, in
whatever order, stays below 2^53, so float64 gives the exact integers. Vectors over it, and all vectors while a centroid
is over it, are measured in Python's integers instead, which have no bound.

A round is one pass over the blocks: nearest centroids, sums and counts of each cluster in a block by one more product (sums
of BLOCK components of at most safe() stay below 2^53 too), added up as Python's integers within a task and then over tasks
by RDD.treeAggregate; 8 x 65 numbers come to the driver, whatever the size. New centroids are exact floors of quotients.
Blocks are written once to the shared folder, so that rounds read no embeddings again and a lost executor repeats only its
blocks of a round.

Defined results: vectors with another number of components, or with a null or non-finite one, get no row; so do null
vectors. A null id counts as the empty text in the hash; repeated rows are vectors each; equal hashes are ordered by the
vector. Fewer vectors than centroids give as many centroids as vectors, none gives no rows. Distances and inertias that
don't fit 64 bits are null (assignment stays exact); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm import common

CLUSTERS, COMPONENTS, ROUNDS, FACTOR, SEED = 8, 64, 10, 1024, 3
BLOCK = 4096

_BLOCKS = "ids binary, nulls binary, vectors binary, large binary"
_BLOCKS_ARROW = pa.schema([(c.split()[0], pa.binary()) for c in _BLOCKS.split(", ")])


def safe(components: int) -> int:
    """The largest magnitude of components up to which no squared distance reaches 2^53."""
    return isqrt(((1 << 53) - 1) // (4 * components))


def integer(x: float) -> int:
    """floor(FACTOR x), also where the product is no finite float."""
    numerator, denominator = x.as_integer_ratio()
    return FACTOR * numerator // denominator


def usable(vectors: DataFrame, vector: str, components: int = COMPONENTS) -> DataFrame:
    """Rows whose vector has all its components, each a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where((F.size(vector) == components) & finite)


def blocks(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Blocks of (id, v): ids, which of them are null, int32 vectors, and those over safe() by place, as Python's integers."""
    most = safe(components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
                scaled = np.floor(np.clip(x, -most, most) * FACTOR)
                large = {int(k): [integer(float(c)) for c in x[k]] for k in np.flatnonzero((np.abs(scaled) > most).any(1))}
                scaled[list(large)] = 0
                ids, nulls = part.column("id").fill_null(0), part.column("id").is_null()
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in (ids.to_numpy().tobytes(), nulls.to_numpy(zero_copy_only=False).tobytes(), scaled.astype(np.int32).tobytes(), pickle.dumps(large) if large else None)], schema=_BLOCKS_ARROW)
        common.release()

    return vectors.mapInArrow(run, _BLOCKS)


def exact_nearest(vector: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    """Distance and number of the nearest centroid, in integers without bound."""
    return min((sum((a - b) ** 2 for a, b in zip(vector, c, strict=True)), k) for k, c in enumerate(centroids))


def nearest(x: np.ndarray, large: dict[int, list[int]], centroids: list[list[int]]) -> tuple[np.ndarray, dict[int, int], np.ndarray]:
    """Of each vector the nearest centroid (ties: the smaller number); of those measured as Python's integers the distance; of the others."""
    apart = dict(large)
    most = safe(x.shape[1])
    if any(abs(v) > most for c in centroids for v in c):
        apart |= {k: x[k].tolist() for k in range(len(x)) if k not in large}
        found, distance = np.zeros(len(x), np.int64), np.zeros(len(x))
    else:
        c, y = np.array(centroids, float), x.astype(float)
        squares = (y * y).sum(1)[:, None] - 2 * (y @ c.T) + (c * c).sum(1)
        found = squares.argmin(1)
        distance = squares[np.arange(len(x)), found]
    exact = {}
    for k, vector in apart.items():
        exact[k], found[k] = exact_nearest(vector, centroids)
    return found, exact, distance


def _block(row: Row | dict) -> tuple[np.ndarray, dict[int, list[int]]]:
    large = pickle.loads(row["large"]) if row["large"] else {}
    return np.frombuffer(row["vectors"], np.int32).reshape(len(row["ids"]) // 8, -1), large


def _halves(d: np.ndarray, by: np.ndarray, n: int) -> list[int]:
    """Exact sums by cluster of up to BLOCK integers below 2^53, held as float64."""
    high, low = np.divmod(d, 2.0**26)
    return [(int(a) << 26) + int(b) for a, b in zip(np.bincount(by, high, n), np.bincount(by, low, n), strict=True)]


def _zero(clusters: int, components: int) -> list[list[int]]:
    """Of each cluster: sums of components, count, sum of distances."""
    return [[0] * (components + 2) for _ in range(clusters)]


def _add(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)]


def sums(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Over all blocks, by cluster: exact sums of components, count, sum of distances."""
    clusters, components = len(centroids), len(centroids[0])
    sent = table.sparkSession.sparkContext.broadcast(centroids)  # a few numbers, whatever the size

    def within(total: list[list[int]], row: Row) -> list[list[int]]:
        x, large = _block(row)
        found, exact, distance = nearest(x, large, sent.value)
        own = np.zeros((clusters, len(x)))
        own[found, np.arange(len(x))] = 1
        own[:, list(large)] = 0
        out = [[*map(int, p), int(n)] for p, n in zip(own @ x.astype(float), own.sum(1), strict=True)]
        distance[list(exact)] = 0
        for k, s in enumerate(_halves(distance, found, clusters)):
            out[k].append(s)
        for k, vector in large.items():
            out[found[k]] = [a + b for a, b in zip(out[found[k]], [*vector, 1, 0], strict=True)]
        for k, d in exact.items():
            out[found[k]][-1] += d
        return _add(total, out)

    return table.rdd.treeAggregate(_zero(clusters, components), within, _add)


RESULT = "id long, cluster int, distance long"
_RESULT_ARROW = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def fits(n: int) -> int | None:
    """A number, or null if it has over 64 bits."""
    return n if n < 1 << 63 else None


def assigned(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of every vector of the blocks."""
    sent = table.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.rows(batches, "ids", "nulls", "vectors", "large", step=1):
            for values in part:
                row = dict(zip(("ids", "nulls", "vectors", "large"), values, strict=True))
                found, exact, distance = nearest(*_block(row), sent.value)
                whole = distance.astype(np.int64)
                missing = np.zeros(len(whole), bool)
                for k, d in exact.items():
                    whole[k], missing[k] = (d, False) if d < 1 << 63 else (0, True)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.int32)), pa.array(whole, mask=missing)], schema=_RESULT_ARROW)

    return table.mapInArrow(run, RESULT)


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", clusters: int = CLUSTERS, components: int = COMPONENTS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(id_column, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector, and the centroids."""
    spark = vectors.sparkSession
    kept = usable(vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")), "v", components)
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    table = common.cut(blocks(kept, components))
    centroids = [[integer(x) for x in r["v"]] for r in first]
    totals: list[list[int]] = []
    if centroids:
        for _ in range(rounds):
            found = sums(table, centroids)
            centroids = [[s // row[components] for s in row[:components]] if row[components] else old for row, old in zip(found, centroids, strict=True)]
        totals = sums(table, centroids)
    inertia = fits(sum(row[-1] for row in totals))
    about = [(k, fits(row[-1]), inertia, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, (row, c) in enumerate(zip(totals, centroids, strict=True))]
    named = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = assigned(table, centroids or [[0] * components]).join(F.broadcast(named), "cluster")  # a row a cluster
    return rows.select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))[0]
