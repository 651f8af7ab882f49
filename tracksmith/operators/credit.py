"""Turn-level credit: causal chains, evidence, advantages, mask spans.

All are window or aggregate expressions over (trajectory, turn); a trajectory is one window partition, so it must fit a
task, trajectories need not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions.expr import clamp, is_true

# Evidence for a chain that was completed, for one that was not, and penalties.
CHAIN, SEARCH, ANSWER = 0.20, 0.45, 0.35
PARTIAL_FIELD, PARTIAL_CAP, PARTIAL_SEARCH, PARTIAL_ANSWER = 0.05, 0.10, 0.20, 0.05
PENALTIES = {
    "exact_query_repeat": -0.20,
    "wrong_aspect": -0.20,
    "invisible_answer_id": -0.20,
    "wrong_answer": -0.15,
    "malformed_tool_call": -0.15,
    "no_tool_output": -0.15,
    "semantic_repeat": -0.10,
    "no_progress_action": -0.10,
}
GUARD_PENALTY = -0.15
CLIP, MIX, BAND, EPSILON = 0.50, 0.50, 0.20, 1.0e-6


def chains(turns: DataFrame, trajectory: str = "trajectory", turn: str = "turn") -> DataFrame:
    """turns with their aspect's answer_at (last correct visible answer), search_at (last normal search before it) and completed.

    Turns without an aspect are in no chain.
    """
    w = Window.partitionBy(trajectory, "aspect")
    t = F.col(turn)
    named = F.col("aspect").isNotNull()
    right = named & (F.col("choice") == "answer") & F.col("answer_visible") & F.col("correct_answer")
    out = turns.withColumn("answer_at", F.max(F.when(right, t)).over(w))
    seen = named & (F.col("choice") == "search") & F.col("normal_candidates") & (F.col("answer_at").isNull() | (t < F.col("answer_at")))
    out = out.withColumn("search_at", F.max(F.when(seen, t)).over(w))
    cut = F.coalesce("search_at", "answer_at")
    field = named & (F.col("choice") == "action") & F.col("field_resolved")
    out = out.withColumn("in_chain", field & (cut.isNull() | (t < cut)))
    return out.withColumn("chain_n", F.sum(F.col("in_chain").cast("int")).over(w)).withColumn("completed", F.col("answer_at").isNotNull() & F.col("search_at").isNotNull())


def evidence(turns: DataFrame, trajectory: str = "trajectory", turn: str = "turn") -> DataFrame:
    """chains() with `evidence` of each turn: success evidence, then at most one penalty, clipped."""
    out = chains(turns, trajectory, turn)
    aspect = Window.partitionBy(trajectory, "aspect")
    t = F.col(turn)
    field = (F.col("choice") == "action") & F.col("field_resolved")
    done = F.when(F.col("in_chain"), CHAIN / F.col("chain_n")).otherwise(0.0) + F.when(t == F.col("search_at"), SEARCH).otherwise(0.0) + F.when(t == F.col("answer_at"), ANSWER).otherwise(0.0)
    before = F.coalesce(F.sum(field.cast("int")).over(aspect.orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    partial = F.when(field & (before < round(PARTIAL_CAP / PARTIAL_FIELD)), PARTIAL_FIELD).otherwise(0.0)
    partial = F.when(F.col("normal_candidates"), F.greatest(partial, F.lit(PARTIAL_SEARCH))).otherwise(partial)
    partial = partial + F.when((F.col("choice") == "answer") & F.col("answer_visible") & ~F.col("correct_answer"), PARTIAL_ANSWER).otherwise(0.0)
    out = out.withColumn("gain", F.when(F.col("aspect").isNull(), 0.0).when(F.col("completed"), done).otherwise(partial))
    specific = F.least(*[F.when(F.col(k), v) for k, v in PENALTIES.items()])
    cause = F.coalesce(*[F.when(F.col(k), F.lit(k)) for k in PENALTIES], F.when(F.col("guard_rejected"), F.lit("guard_rejected")), F.lit("none"))
    out = out.withColumn("penalty", F.coalesce(specific, F.when(F.col("guard_rejected"), GUARD_PENALTY), F.lit(0.0))).withColumn("cause", cause)
    blamable = (F.col("penalty") < 0) & ~F.col("infrastructure_failure")
    first = F.min(F.when(blamable, t)).over(Window.partitionBy(trajectory, "aspect", "cause"))
    value = F.col("gain") + F.when(blamable & (t == first), F.col("penalty")).otherwise(0.0)
    out = out.withColumn("evidence", F.when(F.col("infrastructure_failure") | ~is_true(F.col("reward_valid")), 0.0).otherwise(clamp(value, -CLIP, CLIP)))
    return out.drop("gain")


def normalised(df: DataFrame, by: list[str], value: str, out: str = "z") -> DataFrame:
    """(x - mean) / (population deviation + epsilon); 0 for one row or no spread."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn(out, F.when((F.count("*").over(w) <= 1) | (sd < EPSILON), 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / (sd + EPSILON)))


def reshape(df: DataFrame, trajectory: str, advantage: str, value: str, tokens: str, out: str = "turn_advantage") -> DataFrame:
    """Spread a trajectory's advantage over its turns by evidence of its sign; the token-weighted mean stays."""
    w = Window.partitionBy(trajectory)
    a = F.col(advantage)
    routed = F.when(a > 0, F.greatest(F.lit(0.0), F.col(value))).otherwise(F.greatest(F.lit(0.0), -F.col(value)))
    most = F.max("__routed").over(w)
    weight = F.when(most < EPSILON, 1.0).otherwise(1.0 + MIX * BAND * F.try_divide(F.col("__routed"), most))
    mean = F.sum(F.col(tokens) * F.col("__weight")).over(w) / F.sum(tokens).over(w)
    shaped = df.withColumn("__routed", routed).withColumn("__weight", weight)
    return shaped.withColumn(out, F.when(F.abs(a) < EPSILON, 0.0).otherwise(a * F.col("__weight") / mean)).drop("__routed", "__weight")


def spans(df: DataFrame, by: list[str], order: str, mask: str) -> DataFrame:
    """Half-open runs (start, stop) of rows whose mask holds; order numbers rows without gaps."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.where(mask).withColumn("__island", F.col(order) - F.row_number().over(w)).groupBy(*by, "__island").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop")).drop("__island")


def credit_metrics(df: DataFrame, by: list[str], value: str = "evidence") -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"), F.count_if(v == 0).alias("zero"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"))
