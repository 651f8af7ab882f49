"""Selection of rollout groups whose rewards vary, and rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions.expr import is_true


def signals(df: DataFrame, reward: Column, valid: Column, infrastructure: Column, reason: Column) -> DataFrame:
    """df with reward, invalid and a reason where invalid."""
    bad = ~is_true(valid) | is_true(infrastructure)
    return df.withColumn("reward", reward).withColumn("invalid", bad).withColumn("invalid_reason", F.when(bad, F.coalesce(reason, F.lit("reward_invalid"))))


def classify(df: DataFrame, group: str, size: int, tolerance: float = 1e-12) -> DataFrame:
    """(group, n, n_invalid, status): incomplete, sampling_invalid, constant or kept, the first that holds."""
    sums = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if("invalid").alias("n_invalid"), (F.max("reward") - F.min("reward")).alias("spread"))
    status = F.when(F.col("n") != size, "incomplete").when(F.col("n_invalid") > 0, "sampling_invalid").when(F.col("spread") <= tolerance, "constant").otherwise("kept")
    return sums.select(group, "n", "n_invalid", status.alias("status"))


def retained(df: DataFrame, group: str, size: int) -> DataFrame:
    """Rows of kept groups, and valid rows of incomplete and invalid ones."""
    joined = df.join(classify(df, group, size).select(group, "status"), group)
    return joined.where((F.col("status") == "kept") | (F.col("status").isin("incomplete", "sampling_invalid") & ~F.col("invalid")))


def best_subset(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """(group, spread, n_different, rows): the subset of `size` rows of greatest spread, then most different rewards, then first.

    Clean rows only, if there are enough of them. Subsets are built one row at a time by ordered joins within a group;
    the sampler bounds a group's rows (three batches of four).
    """
    clean = F.sum((~F.col("degraded")).cast("int")).over(Window.partitionBy(group))
    rows = df.withColumn("__clean", clean).where(f"__clean < {size} OR NOT degraded").select(group, order, "reward")
    sets = rows.select(group, F.array(order).alias("rows"), F.array("reward").alias("rewards"))
    for _ in range(size - 1):
        more = rows.select(group, F.col(order).alias("__o"), F.col("reward").alias("__r"))
        sets = sets.join(more, group).where(F.col("__o") > F.element_at("rows", -1)).select(group, F.array_append("rows", F.col("__o")).alias("rows"), F.array_append("rewards", F.col("__r")).alias("rewards"))
    scored = sets.select(group, "rows", F.round(F.array_max("rewards") - F.array_min("rewards"), 12).alias("spread"), F.size(F.array_distinct("rewards")).alias("n_different"))
    return scored.groupBy(group).agg(F.min_by(F.struct("spread", "n_different", "rows"), F.struct((-F.col("spread")).alias("a"), (-F.col("n_different")).alias("b"), F.col("rows").alias("c"))).alias("s")).select(group, "s.spread", "s.n_different", F.array_join(F.col("s.rows").cast("array<string>"), ",").alias("rows"))


def accumulate(df: DataFrame, group: str, batch: str, size: int, most_batches: int = 3) -> DataFrame:
    """(group, ready_batch): the first batch after which a group has `size` valid rows of different rewards; null if none."""
    upto = Window.partitionBy(group).orderBy(batch).rangeBetween(Window.unboundedPreceding, 0)
    valid = F.when(~F.col("invalid"), F.col("reward"))
    running = df.where(F.col(batch) < most_batches).select(group, batch, F.count(valid).over(upto).alias("n"), (F.max(valid).over(upto) - F.min(valid).over(upto)).alias("spread"))
    return running.groupBy(group).agg(F.min(F.when((F.col("n") >= size) & (F.col("spread") > 1e-12), F.col(batch))).alias("ready_batch"))


def first_seen(df: DataFrame, group: str, order: str) -> DataFrame:
    """(group, first_at), the order in which groups came first."""
    return df.groupBy(group).agg(F.min(order).alias("first_at"))


def examples(messages: DataFrame, conversation: str, turn: str, role: str, length: Column, most: int) -> DataFrame:
    """One example for each assistant message: lengths of context and target; none of a conversation with an overlong one."""
    w = Window.partitionBy(conversation).orderBy(turn)
    sized = messages.withColumn("__n", length)
    out = sized.withColumn("context_length", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("target_length", F.col("__n"))
    mine = out.where(F.col(role) == "assistant")
    longest = F.max(F.col("context_length") + F.col("target_length")).over(Window.partitionBy(conversation))
    return mine.withColumn("__longest", longest).where(f"__longest <= {most}").select(conversation, turn, "context_length", "target_length")


def pad(df: DataFrame, values: str, by: list[str], filler: int, left: bool) -> DataFrame:
    """Arrays padded to their batch's longest, with a mask."""
    width = F.max(F.size(values)).over(Window.partitionBy(*by))
    fill = lambda x, n: F.array_repeat(F.lit(x), n)
    missing = F.col("__width") - F.size(values)
    ones = F.array_repeat(F.lit(1), F.size(values))
    both = lambda a, b: F.concat(b, a) if left else F.concat(a, b)
    return df.withColumn("__width", width).withColumn("padded", both(F.col(values), fill(filler, missing))).withColumn("mask", both(ones, fill(0, missing))).drop("__width")


def training_rows(df: DataFrame, split: str, order: list[str], spread: str, nested: dict[str, list[str]] | None = None, width: int = 1000) -> DataFrame:
    """df with `index`, the row's number in its split by `order`, and structs of columns by the names in `nested`.

    No task orders a whole split: spread, a number that comes first in the order, is cut into ranges of `width`; rows are
    numbered within (split, range), and ranges are counted up in a table of a row for each.
    """
    ranged = df.withColumn("__range", F.floor(F.col(spread) / width))
    sizes = ranged.groupBy(split, "__range").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(split).orderBy("__range")) - F.col("__n")).drop("__n")
    numbered = ranged.withColumn("__k", F.row_number().over(Window.partitionBy(split, "__range").orderBy(*order)))
    out = numbered.join(before, [split, "__range"]).withColumn("index", (F.col("__before") + F.col("__k") - 1).cast("long")).drop("__range", "__k", "__before")
    return out.withColumns({name: F.struct(*columns) for name, columns in (nested or {}).items()})
