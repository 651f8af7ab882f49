"""Operator 13: mix of sources by target weights, with hash thresholds found in histograms. DataFrame functions only.

A source's target is its weight's share of all sizes, at most MOST times its own size; what is over is shared anew by
weight. With all targets settled, target = min(MOST x size, level x weight) for one level, which is found by rounds of one
aggregation over the sources each: every round holds fixed the sources that the level before has filled.

A target of f times its source's size takes every document floor(f) times, and once more those whose hash is at most the
source's threshold. Budgets are nested: the same hash serves every target, so a larger target takes all that a smaller
one takes. The threshold is searched digit by digit: sizes are added up by source and the first BITS bits of the hash (a
histogram), the bucket in which the budget ends is found from running sums over the histogram, and only the documents of
that bucket go into the next histogram, by their next bits. After all digits one hash is left, whose documents
are taken if that ends nearer to the target (ties: not). Documents are filtered by the threshold and never sorted.

Layout: texts are read once; ids, sources, sizes and hashes are written to the shared folder. A histogram has at most 2^BITS
rows a source, so its running sums are bounded, and it is added up before it is shuffled. Sources are joined with documents
by broadcast where they have many (components.spread_join), by shuffle otherwise. Two numbers a round come to the driver.

The hash is the first 60 bits of the MD5 of id and text: reruns and other layouts agree, and copies of a text under other
ids have their own.

Defined results: a null text or one without words has size 0 and takes 0; sources of size 0 have target 0, and share
nothing; a null source is a source of its own, the last; equal rows (same id, text and source) are taken alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracksmith.llm import common, components

#: Weights of the sources in order, repeating; targets are at most MOST times a source's size.
WEIGHTS, MOST = (5, 2, 1), 3
#: Bits of a digit, and digits, of the hash.
BITS, DIGITS = 15, 4
WORD = r"[^\x20\x09-\x0D]+"


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, size, h): source is a key that is never null: the source after a 0, or 1 for none."""
    text, source = F.col(text_column), F.col(source_column)
    key = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_column).alias("doc_id"), key.alias("source"), size.alias("size"), hash_of(F.col(id_column), text).alias("h"))


def numbered(sources: DataFrame) -> DataFrame:
    """sources with their place (from 0) in the order of code points: places within ranges, and counts of the ranges before."""
    ranged = common.cut(sources.repartitionByRange("source").sortWithinPartitions("source").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    own = Window.partitionBy("part")
    counts = ranged.groupBy("part").agg(F.count("*").alias("of_part"), F.min("at").alias("first"))
    starts = counts.withColumn("before", F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a range
    return ranged.join(F.broadcast(starts), "part").withColumn("place", F.col("at") - F.col("first") + F.coalesce("before", F.lit(0))).drop("part", "at", "of_part", "first", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size, n) with the column target."""
    cycle = F.array(*map(F.lit, weights))
    weighed = common.cut(numbered(sources).withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).drop("place"))
    sums = weighed.where("source_size > 0").agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    total, level = sums["s"] or 0, None
    filled, weight = 0, sums["w"] or 0
    while weight:
        now = (total - filled) / weight
        if now == level:
            break
        level = now
        full = (most * F.col("source_size")).cast("double") <= level * F.col("weight")
        sums = weighed.where("source_size > 0").agg(F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)).alias("s"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("w")).first()
        filled, weight = sums["s"], sums["w"]
    return weighed.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.lit(float(level or 0)) * F.col("weight")))


def thresholds(rows: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """sources with `whole` (times that every document is taken) and `threshold` (largest hash taken once more).

    limit: rows of a source up to which its rows are joined by shuffle.
    """
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = sources.withColumn("whole", ratio).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    # The budget's bucket so far: its first bits, and the sizes below it.
    found = goal.withColumns({"bucket": F.lit(0).cast("long"), "below": F.lit(0).cast("long")})
    inside = rows.select("source", "size", "h")
    for digit in range(DIGITS):
        right = BITS * (DIGITS - 1 - digit)
        bars = inside.groupBy("source", F.shiftright("h", right).alias("bucket")).agg(F.sum("size").alias("sum"))
        up_to = F.sum("sum").over(Window.partitionBy("source").orderBy("bucket"))
        bars = bars.withColumn("up_to", up_to).join(found.select("source", "rest", F.col("below").alias("under")), "source")
        ends = bars.where((F.col("under") + F.col("up_to")).cast("double") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", "sum", (F.col("under") + F.col("up_to") - F.col("sum")).alias("below"))).alias("e"))
        found = common.cut(goal.join(ends.select("source", "e.*"), "source", "left"))
        if digit < DIGITS - 1:
            here = found.where("bucket is not null").select("source", F.col("bucket").alias("in_bucket"), "n")
            inside = common.cut(components.spread_join(inside, here, "source", limit).where(F.shiftright("h", right) == F.col("in_bucket")).select("source", "size", "h"))
    # The last bucket is one hash: its documents are taken if that ends nearer.
    nearer = (F.col("below") + F.col("sum")).cast("double") - F.col("rest") < F.col("rest") - F.col("below").cast("double")
    threshold = F.when(F.col("bucket").isNull(), F.lit((1 << BITS * DIGITS) - 1)).when(nearer, F.col("bucket")).otherwise(F.col("bucket") - 1)
    return found.withColumn("threshold", threshold.cast("long")).drop("bucket", "sum", "below")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(id_column, size, source_size, target, taken) of every row of docs."""
    rows = common.cut(sized(docs, id_column, text_column, source_column))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    limit = components.most(rows.count())
    found = thresholds(rows, targets(sources, weights, most), limit)
    wanted = found.select("source", "source_size", "target", "whole", "threshold", "n")
    joined = components.spread_join(rows, wanted, "source", limit)
    taken = F.col("size") * (F.col("whole") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0))
    return joined.select(F.col("doc_id").alias(id_column), "size", "source_size", "target", taken.cast("long").alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents", "doc_id", "text", "source"))
