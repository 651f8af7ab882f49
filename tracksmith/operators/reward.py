"""Trajectory reward and result metrics as column expressions on one row a trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksmith.functions.expr import clamp, is_true, ratio

# Weights of the reward's terms, their scale, and the largest penalties.
WEIGHTS = {"completion": 3.0, "preference": 0.20, "phase": 0.08, "search": 0.06, "quality": 0.04, "efficiency": 0.02}
SCALE = 3.4
CAP = 4
COUNT_PENALTIES = {"guard_rejections": 0.08, "invalid_actions": 0.03, "exact_repeats": 0.02, "semantic_repeats": 0.02}
ASPECT_PENALTIES = {"blocked_aspects": 0.08, "ambiguous_actions": 0.02, "unsearched_answers": 0.03, "wrong_answers": 0.04}
FLAG_PENALTIES = {"parallel_tool_calls": 0.05, "no_tool_output": 0.02, "max_steps_reached": 0.02}
BEST, CORRECT = 1.0, 0.8


def answer_quality(selected: Column, best: Column, correct: Column) -> Column:
    """1 for the best id, 0.8 for another accepted one, else 0."""
    return F.when(selected == best, BEST).when(F.array_contains(correct, selected), CORRECT).otherwise(0.0)


def aspect_scores(df: DataFrame, task: str) -> DataFrame:
    """Rows (task, selected, best_id, correct_ids, n_active, n_preferences, searched) of each aspect with quality, coverage, grounding."""
    quality = answer_quality(F.col("selected"), F.col("best_id"), F.col("correct_ids"))
    grounding = F.when(is_true(F.col("searched")), 0.25 + 0.75 * ratio(F.col("n_active"), F.col("n_preferences"))).otherwise(0.0)
    scored = df.withColumn("quality", F.coalesce(quality, F.lit(0.0))).withColumn("grounding", grounding)
    return scored.groupBy(task).agg(
        F.count("*").alias("aspects"), F.sum("quality").alias("quality_sum"), F.sum(F.col("quality") * F.col("grounding")).alias("grounded_sum"),
        F.count_if(F.col("quality") > 0).alias("correct"), F.count_if(F.col("quality") == BEST).alias("best"),
        F.count("selected").alias("submitted"), F.count_if(is_true(F.col("searched"))).alias("searched"), F.every(F.col("grounding") == 1.0).alias("fully_grounded"),
    )


def preference_sets(df: DataFrame, known: str, active: str, passive: str) -> DataFrame:
    """Known active ids, known passive ids that are not active, and their covered shares (0 if nothing is known)."""
    a = F.array_intersect(active, known)
    p = F.array_except(F.array_intersect(passive, known), a)
    n = F.size(F.array_distinct(known))
    return df.withColumn("n_active", F.size(a)).withColumn("n_passive", F.size(p)).withColumn("active_coverage", ratio(F.size(a), n)).withColumn("passive_coverage", ratio(F.size(p), n)).withColumn("preference_coverage", ratio(F.size(F.array_union(a, p)), n))


def effective_steps(steps: Column, attempts: Column, rejections: Column) -> Column:
    """Environment steps or accepted attempts, the larger, and a quarter step for each rejection."""
    made = F.greatest(F.lit(0), F.coalesce(attempts, steps))
    rejected = F.least(rejections, made)
    return F.greatest(F.greatest(F.lit(0), steps), made - rejected) + 0.25 * rejected


def efficiency(effective: Column, preferences: Column, aspects: Column, most: int = 20) -> Column:
    """1 within the useful budget, falling to 0 at `most` steps."""
    budget = preferences + 2 * aspects
    return F.when(effective <= budget, 1.0).when(budget >= most, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.try_divide(effective - budget, (F.lit(most) - budget).cast("double"))))


def penalty(aspects: Column) -> Column:
    """Sum of eleven capped penalties, from columns of their names."""
    total = F.lit(0.0)
    for name, weight in COUNT_PENALTIES.items():
        total += weight * ratio(F.least(F.greatest(F.col(name), F.lit(0)), F.lit(CAP)), F.lit(CAP))
    for name, weight in ASPECT_PENALTIES.items():
        total += weight * ratio(F.least(F.greatest(F.col(name), F.lit(0)), aspects), aspects)
    for name, weight in FLAG_PENALTIES.items():
        total += F.when(is_true(F.col(name)), weight).otherwise(0.0)
    return total


def phase_score(successes: Column, opportunities: Column) -> Column:
    return F.when(opportunities == 0, 1.0).otherwise(ratio(F.least(successes, opportunities), opportunities))


def reward(df: DataFrame, most_steps: int = 20) -> DataFrame:
    """df with efficiency, penalty, raw and terminal reward (0 where the reward isn't valid).

    Columns: aspects, correct, searched, quality_sum, preferences, n_active, n_passive, successes, opportunities, steps,
    attempts, guard_rejections and the other penalty names, reward_valid.
    """
    n = F.col("aspects")
    steps = effective_steps(F.col("steps"), F.col("attempts"), F.col("guard_rejections"))
    terms = {
        "completion": ratio(F.col("correct"), n),
        "preference": ratio(F.col("n_active") + F.col("n_passive"), F.col("preferences")),
        "phase": phase_score(F.col("successes"), F.col("opportunities")),
        "search": ratio(F.col("searched"), n),
        "quality": ratio(F.col("quality_sum"), n),
        "efficiency": efficiency(steps, F.col("preferences"), n, most_steps),
    }
    out = df.withColumns({f"{k}_term": v for k, v in terms.items()}).withColumn("policy_penalty", penalty(n))
    raw = -F.col("policy_penalty")
    for name, weight in WEIGHTS.items():
        raw += weight * F.col(f"{name}_term")
    out = out.withColumn("raw_reward", raw)
    return out.withColumn("terminal_reward", F.when(is_true(F.col("reward_valid")), clamp(F.col("raw_reward") / SCALE, -1.0, 1.0)).otherwise(0.0))


def legacy_squash(raw: Column) -> Column:
    """The older scale: positive values up to 1, negative ones through tanh."""
    return F.when(raw >= 0, F.least(F.lit(1.0), raw)).otherwise(-F.tanh(-raw / 1.5))


def outcome(aspects: Column, correct: Column, submitted: Column) -> Column:
    return F.when(correct == aspects, "full").when(correct > 0, "partial").when(submitted > 0, "wrong_only").otherwise("no_answer")
