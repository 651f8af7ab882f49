"""The bounded sampler across groups: updates of several prompts, a few generation batches each, a limit of skips in a row.

An update has `required` prompts. After each generation batch every prompt's valid rows so far are its pool; the prompt is
ready if the pool (its clean rows, if there are `size` of them) has `size` rows whose rewards spread beyond the tolerance.
An update trains after the first batch at which all its prompts are ready at once, else it is skipped after the last one.
A run ends at the update that makes more than `most_skips` skips in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.operators import groups

SIZE, REQUIRED, BATCHES, SKIPS, TOLERANCE = 4, 2, 3, 10, 1e-6


def pools(rollouts: DataFrame, size: int = SIZE, batches: int = BATCHES, tolerance: float = TOLERANCE) -> DataFrame:
    """(run, update, uid, batch, n, ready): each prompt after each generation batch, also one that brought it no valid row."""
    key = ["run", "update", "uid"]
    clean = F.when(~F.col("degraded"), F.col("reward"))
    valid = rollouts.where(f"NOT invalid AND batch < {batches}").groupBy(*key, "batch").agg(
        F.count("*").alias("n"), F.min("reward").alias("low"), F.max("reward").alias("high"), F.count(clean).alias("n_clean"), F.min(clean).alias("low_clean"), F.max(clean).alias("high_clean"))
    grid = rollouts.select(*key).distinct().withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    so_far = Window.partitionBy(*key).orderBy("batch")  # a row a batch
    kinds = {"n": F.sum, "low": F.min, "high": F.max, "n_clean": F.sum, "low_clean": F.min, "high_clean": F.max}
    sums = grid.join(valid.withColumn("batch", F.col("batch").cast("int")), [*key, "batch"], "left").withColumns({c: f(c).over(so_far) for c, f in kinds.items()})
    enough = F.coalesce(F.col("n_clean"), F.lit(0)) >= size
    spread = F.when(enough, F.col("high_clean") - F.col("low_clean")).when(F.col("n") >= size, F.col("high") - F.col("low"))
    return sums.select(*key, "batch", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(spread > tolerance, F.lit(False)).alias("ready"))


def updates(rollouts: DataFrame, size: int = SIZE, required: int = REQUIRED, batches: int = BATCHES, most_skips: int = SKIPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(run, update, status, sampled_batches, accepted, candidates, across_batches, consecutive_skips), a row an update.

    rollouts: run, update, uid, batch, reward, invalid, degraded; more columns are ignored. status: trained; skipped;
    exhausted (the skip beyond the limit, where the run ends); not_reached (later updates of the run); wrong_groups (not
    `required` prompts: neither trains nor counts as a skip). An update is a step of a run, so a run's updates are one sequence.
    """
    key = ["run", "update"]
    after = pools(rollouts, size, batches, tolerance)
    ends = after.groupBy(*key, "batch").agg(F.count("*").alias("prompts"), F.count_if("ready").alias("ready"))
    ends = ends.groupBy(*key).agg(F.max("prompts").alias("prompts"), F.min(F.when(F.col("ready") >= required, F.col("batch"))).alias("at"))
    right = F.col("prompts") == required
    ends = ends.withColumn("trained", right & F.col("at").isNotNull()).withColumn("sampled_batches", F.when(F.col("trained"), F.col("at") + 1).otherwise(batches))
    taken = rollouts.where("NOT invalid").join(ends, key).where(F.col("batch") < F.col("sampled_batches")).groupBy(*key, "uid").agg(F.count("*").alias("n"), F.countDistinct("batch").alias("n_batches"))
    counts = taken.groupBy(*key).agg(F.sum("n").alias("candidates"), F.count_if(F.col("n_batches") > 1).alias("across_batches"))
    in_order = Window.partitionBy("run").orderBy("update")
    skip = (right & ~F.col("trained")).cast("int")
    runs = ends.join(counts, key, "left").withColumn("__streak", F.sum(F.col("trained").cast("int")).over(in_order))
    runs = runs.withColumn("skips", F.when(F.col("trained"), F.lit(0)).otherwise(F.sum(skip).over(Window.partitionBy("run", "__streak").orderBy("update"))))
    over = F.min(F.when(right & (F.col("skips") > most_skips), F.col("update"))).over(Window.partitionBy("run"))
    status = (
        F.when(F.col("update") > F.col("__over"), "not_reached").when(F.col("update") == F.col("__over"), "exhausted")
        .when(~right, "wrong_groups").when(F.col("trained"), "trained").otherwise("skipped")
    )
    runs = runs.withColumn("__over", over).withColumn("status", status)
    reached: Column = F.col("status") != "not_reached"
    return runs.select(*key, "status", F.when(reached, F.col("sampled_batches").cast("long")).alias("sampled_batches"), F.when(F.col("status") == "trained", F.col("prompts")).otherwise(0).cast("long").alias("accepted"), F.when(reached, F.coalesce("candidates", F.lit(0))).alias("candidates"), F.when(reached, F.coalesce("across_batches", F.lit(0))).alias("across_batches"), F.when(reached, F.col("skips")).alias("consecutive_skips"))


def selected(rollouts: DataFrame, decided: DataFrame, order: str, size: int = SIZE) -> DataFrame:
    """(run, update, uid, spread, n_different, rows): of each prompt of a trained update the rows to train on, by `order`.

    order: a number that grows with batch and row within a prompt. decided: what updates() gives.
    """
    trained = decided.where("status = 'trained'").select("run", "update", "sampled_batches")
    pool = rollouts.where("NOT invalid").join(trained, ["run", "update"]).where("batch < sampled_batches")
    best = groups.best_subset(pool.withColumn("prompt", F.struct("run", "update", "uid")), "prompt", order, size)
    return best.select("prompt.run", "prompt.update", "prompt.uid", "spread", "n_different", "rows")
