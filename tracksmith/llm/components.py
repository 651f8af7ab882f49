"""Connected components of links in a table, by alternating large-star and small-star steps.

Each step is an aggregation with map-side sums and a join; nothing but two numbers a step comes to the driver. A step has
several shuffles, each with as many tasks as there are shuffle partitions on both sides, and each task leaves files. So where
PART links a task make fewer tasks than that, the steps run in so few: every row takes part as before.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.llm import common

MOST_STEPS = 60
#: A key that has more than one row in HEAVY (and over 1,000) is joined by broadcast; there are fewer than HEAVY of these.
HEAVY = 20_000
#: Links a task, where that makes fewer tasks than there are shuffle partitions.
PART = 20_000


def most(rows: int) -> int:
    """Rows of a key up to which it is joined by shuffle."""
    return max(1000, rows // HEAVY)


def spread_join(rows: DataFrame, named: DataFrame, key: str, limit: int) -> DataFrame:
    """rows joined with named, which has a row for each key and in n how many rows have it.

    Rows of a key that has over `limit` stay where they are and its row is broadcast, so that no task gets them all.
    """
    values = [c for c in named.columns if c not in (key, "n")]
    heavy = F.broadcast(named.where(F.col("n") > limit).select(key, *[F.col(c).alias(f"__{c}") for c in values], F.lit(True).alias("__heavy")))
    marked = rows.join(heavy, key, "left")
    own = rows.columns
    few = marked.where("__heavy is null").select(*own).join(named.where(F.col("n") <= limit).select(key, *values), key)
    return marked.where("__heavy").select(*own, *[F.col(f"__{c}").alias(c) for c in values]).unionByName(few)


def components(links: DataFrame) -> DataFrame:
    """(node, component): component is the least node reachable; nodes without a link are not in the result.

    links: (a long, b long), in any direction, repeated or not; loops are ignored, nulls too.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = common.cut(edges), None
    total = edges.count()
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(df: DataFrame) -> DataFrame:
        tasks = max(1, math.ceil(total / PART))
        return df.coalesce(tasks) if tasks < partitions else df

    for _ in range(MOST_STEPS):
        edges = packed(edges)
        both = packed(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = packed(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = packed(packed(spread_join(both.where("v > u"), least, "u", most(total)).select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        least = packed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = common.cut(packed(packed(small).distinct()))
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        total = sums["n"]
        if before == (sums["n"], sums["s"]):
            break
        before = (sums["n"], sums["s"])
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(packed(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
