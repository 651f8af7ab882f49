"""Digests of whole tables, manifests that are written with a run's data, and checks of artifacts against them."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksmith.sources import tables

FANOUT, LEAST_LEVELS = 1024, 2
MANIFEST = "_manifest"


def indexed(df: DataFrame, by: list[str], order: list[str], out: str = "__index") -> DataFrame:
    """df with each row's place (from 0) in its group's order; equal rows get places in any order.

    The table is dealt out by ranges of (by, order); rows are numbered within (group, range), and the counts of the ranges
    before are added, so that no task orders a whole group. The numbered rows are written to the shared folder once, as ranges
    of another run of the same plan could be cut elsewhere.
    """
    spark, path = df.sparkSession, tables.scratch(df.sparkSession, "indexed")
    dealt = df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    dealt.withColumn("__k", F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)) - 1).write.parquet(path)
    numbered = spark.read.schema(dealt.withColumn("__k", F.lit(0)).schema).parquet(path)
    counts = numbered.groupBy("__part", *by).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("__part")  # a row a range
    before = counts.withColumn("__before", F.sum("__n").over(w) - F.col("__n")).drop("__n")
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["__part", *by]])
    joined = numbered.alias("a").join(before.alias("b"), same)
    return joined.select("a.*", (F.col("a.__k") + F.col("b.__before")).alias(out)).drop("__part", "__k")


def tree_digest(df: DataFrame, by: list[str], order: list[str], content: Column, fanout: int = FANOUT) -> DataFrame:
    """(by, rows, digest): an order-true digest of each group as the root of a tree of SHA-256.

    A leaf is the hash of a row's content (null: the empty text); a node is the hash of its up to `fanout` children's hex
    digits, joined by line ends, and covers consecutive rows. Levels go on until every group has one node (LEAST_LEVELS at
    least, so that all groups have as many). No node has over `fanout` children, whatever a group holds.
    """
    hashed = df.select(*by, *[F.col(c) for c in order if c not in by], F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256).alias("h"))
    nodes = indexed(hashed, by, order).select(*by, F.col("__index"), "h", F.lit(1).cast("long").alias("n"))
    counts = df.groupBy(*by).agg(F.count("*").alias("n")) if by else df.agg(F.count("*").alias("n"))
    left = counts.agg(F.max("n").alias("m")).first()["m"] or 0
    level = 0
    while level < LEAST_LEVELS or left > 1:
        up = nodes.withColumn("__parent", F.floor(F.col("__index") / fanout))
        children = F.transform(F.array_sort(F.collect_list(F.struct("__index", "h"))), lambda x: x["h"])
        nodes = up.groupBy(*by, "__parent").agg(F.sha2(F.array_join(children, "\n"), 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("__parent", "__index")
        left, level = -(-left // fanout), level + 1
    return nodes.select(*by, F.col("n").alias("rows"), F.col("h").alias("digest"))


def row_text(df: DataFrame) -> Column:
    """A row as JSON with its columns in order of name, nulls written."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def manifest_of(df: DataFrame, order: list[str], name: str) -> dict:
    """What a manifest says of a table: name, columns, rows, digest in the given order."""
    found = tree_digest(df, [], order, row_text(df)).first()
    return {"name": name, "columns": sorted(df.columns), "order": order, "rows": found["rows"] if found else 0, "digest": found["digest"] if found else None}


def verify(manifest: dict, copies: dict[str, DataFrame], expected: DataFrame | None = None) -> DataFrame:
    """(artifact, check, ok): the manifest's fields, and of each copy (say its JSON lines and its Parquet) columns, rows and digest.

    Order counts: a copy whose rows are the same in another order of the manifest's columns has another digest only if
    rows are equal in these columns. `expected` is held to the same digest.
    """
    spark = next(iter(copies.values())).sparkSession
    fields = {"name", "columns", "order", "rows", "digest"}
    out = [("manifest", "fields", set(manifest) == fields)]
    order = list(manifest.get("order") or [])
    for name, df in {**copies, **({"expected": expected} if expected is not None else {})}.items():
        same = sorted(df.columns) == manifest.get("columns")
        out.append((name, "columns", same))
        own = manifest_of(df, order, "") if same and set(order) <= set(df.columns) else {"rows": df.count(), "digest": None}
        out += [(name, "rows", own["rows"] == manifest.get("rows")), (name, "digest", own["digest"] is not None and own["digest"] == manifest.get("digest"))]
    return spark.createDataFrame(out, "artifact string, check string, ok boolean")


def _file_sums(df: DataFrame) -> DataFrame:
    """(file, rows, sum): of each part file its rows and an order-free sum of their hashes."""
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.select(file.alias("file"), F.xxhash64(row_text(df)).cast("decimal(38,0)").alias("h")).groupBy("file").agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("sum"))


def write_run(df: DataFrame, path: str, flags: dict[str, bool] | None = None) -> None:
    """Write a table as Parquet with a manifest beside it: of each part file rows and sum, and the run's flags.

    The manifest is written after the data, from what was written, so a run without one did not end.
    """
    spark = df.sparkSession
    df.write.parquet(f"{path}/data")
    sums = _file_sums(spark.read.parquet(f"{path}/data"))
    sums.withColumn("flags", F.lit(json.dumps(flags or {}, sort_keys=True))).write.parquet(f"{path}/{MANIFEST}")


def check_run(spark: SparkSession, path: str) -> DataFrame:
    """(file, status) of a run's part files: same, changed, missing or added, by reading them again."""
    now = _file_sums(spark.read.parquet(f"{path}/data")).select("file", F.col("rows").alias("rows_now"), F.col("sum").alias("sum_now"))
    both = spark.read.parquet(f"{path}/{MANIFEST}").join(now, "file", "full")
    status = F.when(F.col("rows_now").isNull(), "missing").when(F.col("rows").isNull(), "added").when((F.col("rows") == F.col("rows_now")) & (F.col("sum") == F.col("sum_now")), "same").otherwise("changed")
    return both.select("file", status.alias("status"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A run's table, if all its part files are as its manifest says."""
    bad = check_run(spark, path).where("status <> 'same'").orderBy("file").limit(5).collect()
    if bad:
        raise ValueError(f"files differ from the manifest: {[(r['file'], r['status']) for r in bad]}")
    return spark.read.parquet(f"{path}/data")


def complete(spark: SparkSession, path: str, expected: DataFrame, key: str, valid: str) -> DataFrame:
    """One row: whether an evaluation run is complete: its files whole, all flags set, each expected key there once and valid.

    (expected, found, valid, invalid, unknown, repeated, flags, files_ok, complete)
    """
    results = spark.read.parquet(f"{path}/data").select(F.col(key).alias("k"), F.coalesce(valid, F.lit(False)).alias("v"))
    per = results.groupBy("k").agg(F.count("*").alias("n"), F.bool_and("v").alias("v"))
    both = expected.select(F.col(key).alias("k"), F.lit(True).alias("asked")).distinct().join(per, "k", "full")
    sums = both.agg(F.count("asked").alias("expected"), F.count_if(F.expr("asked AND n IS NOT NULL")).alias("found"), F.count_if(F.expr("asked AND v")).alias("valid"), F.count_if(F.expr("asked AND NOT v")).alias("invalid"), F.count_if(F.expr("asked IS NULL")).alias("unknown"), F.count_if(F.expr("n > 1")).alias("repeated"))
    files = check_run(spark, path).agg(F.count_if(F.expr("status <> 'same'")).alias("bad"))
    flags = spark.read.parquet(f"{path}/{MANIFEST}").agg(F.max("flags").alias("flags"))
    joined = sums.join(F.broadcast(files), F.lit(True)).join(F.broadcast(flags), F.lit(True))  # one row each
    set_ = F.forall(F.map_values(F.from_json("flags", "map<string,boolean>")), lambda x: x)
    whole = (F.col("valid") == F.col("expected")) & (F.col("invalid") == 0) & (F.col("unknown") == 0) & (F.col("repeated") == 0)
    return joined.withColumn("files_ok", F.col("bad") == 0).withColumn("complete", whole & F.coalesce(set_, F.lit(True)) & F.col("files_ok")).drop("bad")
