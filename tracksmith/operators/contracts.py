"""Contracts: checks with reasons, tiers, duplicates, leakage and fingerprints of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions.expr import reasons


def judge(df: DataFrame, checks: dict[str, Column], out: str = "rejections") -> DataFrame:
    """df with the sorted names of the failed checks, joined by commas; each check is the condition to reject."""
    return df.withColumn(out, F.array_join(reasons(*[(c, k) for k, c in checks.items()]), ","))


def content_hash(df: DataFrame, by: list[str], order: str, content: str) -> DataFrame:
    """SHA-256 of a group's texts in order, joined by line ends."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content])
    return df.groupBy(*by).agg(F.sha2(F.array_join(rows, "\n"), 256).alias("content_hash"))


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of a that b lacks, and of b that a lacks (as multisets)."""
    both = a.withColumn("__s", F.lit(1)).unionByName(b.withColumn("__s", F.lit(-1)))
    net = both.groupBy(*a.columns).agg(F.sum("__s").alias("net"))
    return net.agg(F.coalesce(F.sum(F.greatest("net", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("net"), F.lit(0))), F.lit(0)).alias("only_right"))


def later_copies(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """df with `copy`: true for every row of a key but the first.

    An aggregation and a join, so that a key with a third of all rows is not sorted in one task.
    """
    first = df.groupBy(*key).agg(F.min(order).alias("__first"))
    return df.join(first, key).withColumn("copy", F.col(order) > F.col("__first")).drop("__first")


def merge_candidates(df: DataFrame, key: list[str], order: str, policy: str, source: str, replayed: str) -> DataFrame:
    """One row a key: the first row's order, number of copies, sources in order, whether all replayed, policy or `mixed`."""
    return df.groupBy(*key).agg(
        F.min(order).alias("first_row"), (F.count("*") - 1).alias("copies"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(source))), lambda x: x[source]), ",").alias("sources"),
        F.bool_and(replayed).alias("replay_ok"), F.when(F.countDistinct(policy) > 1, "mixed").otherwise(F.min(policy)).alias("policy"),
    )


def hidden_keys(df: DataFrame, json: str, hidden: list[str]) -> DataFrame:
    """df with the hidden keys among a JSON object's own keys, joined by commas."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    return df.withColumn("hidden", F.array_join(F.array_sort(F.array_intersect(keys, F.array(*[F.lit(h) for h in hidden]))), ","))


def hidden_paths(df: DataFrame, key: str, json: str, hidden: list[str]) -> DataFrame:
    """(key, path) of hidden keys at any depth, by a walk over the parsed value in Arrow batches."""
    import pandas as pd

    names = frozenset(hidden)

    def walk(value):
        stack = [("$", None, value)]
        while stack:
            path, own, value = stack.pop()
            if own in names:
                yield path
            children = [(f"{path}.{k}", k, v) for k, v in value.items()] if isinstance(value, dict) else [(f"{path}[{i}]", None, v) for i, v in enumerate(value)] if isinstance(value, list) else []
            stack += reversed(children)

    def run(parts):
        import json as parser

        for part in parts:
            out = []
            for k, raw in part.itertuples(index=False):
                try:
                    value = parser.loads(raw) if raw else None
                except (ValueError, RecursionError):  # no JSON, or nested deeper than the parser goes
                    continue
                out += [(k, p) for p in walk(value)]
            yield pd.DataFrame(out, columns=["key", "path"])

    return df.select(F.col(key).alias("key"), F.col(json).alias("json")).mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, path string")


def forbidden(df: DataFrame, text: str, phrases: list[str]) -> Column:
    hits = [F.contains(F.col(text), F.lit(p)) for p in phrases]
    out = hits[0]
    for h in hits[1:]:
        out |= h
    return out


def drift(a: DataFrame, b: DataFrame, key: str, metrics: list[str], tolerance: float) -> DataFrame:
    """(metric, compared, differing): recomputed against stored values, relative tolerance."""
    joined = a.select(key, *[F.col(m).alias(f"l_{m}") for m in metrics]).join(b.select(key, *[F.col(m).alias(f"r_{m}") for m in metrics]), key)
    off = lambda m: F.abs(F.col(f"l_{m}") - F.col(f"r_{m}")) > tolerance * F.greatest(F.abs(F.col(f"l_{m}")), F.abs(F.col(f"r_{m}")))
    sums = joined.agg(*[F.count("*").alias("n"), *[F.count_if(off(m)).alias(m) for m in metrics]])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col("n").alias("compared"), F.col(m).alias("differing")) for m in metrics])).alias("r")).select("r.*")


def two_files(train: DataFrame, validation: DataFrame, key: str, content: str, splits: DataFrame, split: str, least: dict[str, int]) -> DataFrame:
    """(check, n): faults of a training and a validation file together; 0 means that a check holds.

    Repeated contents within each file (all but the first), keys in both files, keys that the split map (key, split) puts
    elsewhere or doesn't know, and rows that a file lacks of `least` ({"train": .., "validation": ..}).
    """
    files = {"train": train.select(key, content), "validation": validation.select(key, content)}
    both = files["train"].withColumn("__file", F.lit("train")).unionByName(files["validation"].withColumn("__file", F.lit("validation")))
    copies = both.groupBy("__file", content).agg((F.count("*") - 1).alias("n")).groupBy("__file").agg(F.sum("n").alias("n"))
    shared = both.groupBy(key).agg(F.countDistinct("__file").alias("f")).agg(F.count_if(F.col("f") > 1).alias("n"))
    placed = both.join(splits.select(key, F.col(split).alias("__split")), key, "left").groupBy("__file").agg(F.count_if(~F.col("__split").eqNullSafe(F.col("__file"))).alias("n"), F.count("*").alias("rows"))
    names = both.sparkSession.createDataFrame([(f, n) for f, n in least.items()], "__file string, least bigint")
    per_file = names.join(copies.withColumnRenamed("n", "repeated"), "__file", "left").join(placed.withColumnRenamed("n", "misplaced"), "__file", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = F.array(*[F.struct(F.concat(F.lit(f"{name}_"), "__file").alias("check"), value.alias("n")) for name, value in (("repeated", zero(F.col("repeated"))), ("misplaced", zero(F.col("misplaced"))), ("missing", F.greatest(F.lit(0).cast("long"), F.col("least") - zero(F.col("rows")))))])
    return per_file.select(F.explode(rows).alias("r")).select("r.*").unionByName(shared.select(F.lit("in_both").alias("check"), F.col("n").cast("long").alias("n")))
