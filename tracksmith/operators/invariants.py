"""Stored results are held against the formulas that made them: ranges, joint rules, and each figure derived anew.

All rules of a row are worked out in one projection; nothing is shuffled. Defined results: a figure that is null, not a number or
infinite breaks its own rule, never one that it is only an input of; a result without aspects breaks `aspects` and derives 0.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksmith.functions.expr import clamp, is_true, ratio
from tracksmith.operators import reward

# What an aspect's quality can be, how near a stored ratio and a stored reward must be to the derived one.
QUALITIES = (0.0, 0.8, 1.0)
NEAR, NEAR_REWARD = 1e-9, 1e-8
# Fixed value: how an episode that ran out of steps ends.
OUT_OF_STEPS = "max_steps"
INPUTS = {"completion": "completion", "preference": "preference", "phase": "phase_score", "search": "search", "quality": "answer_quality", "efficiency": "efficiency"}


def finite(x: Column) -> Column:
    """Neither null, nor infinite, nor not a number."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def public_penalty(df: DataFrame, aspects: Column) -> DataFrame:
    """df with `__penalty`: the reward's penalty as far as a stored result shows it, so without the flags of single turns."""
    own = {"parallel_tool_calls": F.lit(False), "no_tool_output": F.lit(False), "max_steps_reached": F.col("termination") == OUT_OF_STEPS}
    return df.withColumns(own).withColumn("__penalty", reward.penalty(aspects))


def _phase_item(good: Callable[[Column], Column]) -> Column:
    """Whether all phases' entries are good; a null one is not."""
    return F.forall(F.map_values("phases"), lambda p: is_true(good(p)))


def result_problems(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, problem, stored, derived): one row a rule that a result breaks; stored and derived are null where a rule has no figure.

    Columns of df: valid, transcript_size, termination, inner_termination, aspects (array of names), quality (map of an aspect),
    completion, correct_rate, submission, correct_itinerary, gold_itinerary, active, passive, preference, search,
    phases (map of structs successes, opportunities, rate), phase_score, attempts, steps, inner_attempts, inner_steps,
    guard_rejections, effective_steps, rejection_rate, answer_quality, efficiency, policy_penalty, raw_reward, terminal_reward and
    the counts of `reward.COUNT_PENALTIES` and `reward.ASPECT_PENALTIES`.
    """
    c = F.col
    n = F.size("aspects")
    near = lambda a, b, by=NEAR: is_true(finite(a) & (F.abs(a - b) <= by))
    within = lambda x: is_true((x >= 0) & (x <= 1))
    own = F.transform("aspects", lambda a: F.try_element_at("quality", a))
    completion = ratio(F.size(F.filter(own, lambda q: q > 0)), n)
    whole = near(c("completion"), F.lit(1.0)) & near(c("submission"), F.lit(1.0))
    union = F.least(F.lit(1.0), c("active") + c("passive"))
    in_range = within(c("active")) & within(c("passive")) & within(c("preference"))
    total = lambda f: F.aggregate(F.map_values("phases"), F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(p[f], F.lit(0)))
    phase = F.when(total("opportunities") == 0, 1.0).otherwise(F.try_divide(total("successes").cast("double"), total("opportunities")))
    expected_rate = lambda p: F.when(p["opportunities"] == 0, 1.0).otherwise(F.try_divide(p["successes"].cast("double"), p["opportunities"]))
    counted = is_true((c("attempts") >= 0) & (c("steps") >= 0) & (c("guard_rejections") >= 0) & (c("guard_rejections") <= c("attempts")) & (c("steps") <= c("attempts")))
    effective = reward.effective_steps(c("steps"), c("attempts"), c("guard_rejections"))
    raw = functools.reduce(operator.add, [weight * c(INPUTS[name]) for name, weight in reward.WEIGHTS.items()]) - c("__penalty")
    given = finite(c("policy_penalty"))
    for name in INPUTS.values():
        given &= finite(c(name))
    rules = [
        ("invalid", is_true(c("valid")), None, None),
        ("transcript_kept", is_true(c("transcript_size") == 0), None, None),
        ("aspects", is_true(n > 0), None, None),
        ("quality_keys", is_true(F.array_sort(F.map_keys("quality")) == F.array_sort("aspects")), None, None),
        ("quality_values", F.forall(own, lambda q: is_true(q.isin(*QUALITIES))), None, None),
        ("completion", near(c("completion"), completion), "completion", completion),
        ("correct_rate", near(c("correct_rate"), c("completion")), "correct_rate", c("completion")),
        ("submission", within(c("submission")) & is_true(c("submission") + NEAR >= c("completion")), "submission", None),
        ("correct_itinerary", c("correct_itinerary").eqNullSafe(whole), None, None),
        ("gold_itinerary", ~is_true(c("gold_itinerary")) | is_true(c("correct_itinerary")), None, None),
        ("preference_range", in_range, "preference", None),
        ("preference", ~in_range | near(c("preference"), union), "preference", union),
        ("search", within(c("search")), "search", None),
        ("phase_counts", c("phases").isNotNull() & _phase_item(lambda p: (p["successes"] >= 0) & (p["successes"] <= p["opportunities"]) & (p["rate"] >= 0) & (p["rate"] <= 1)), None, None),
        ("phase_rates", _phase_item(lambda p: F.abs(p["rate"] - expected_rate(p)) <= NEAR), None, None),
        ("phase_score", c("phases").isNull() | near(c("phase_score"), phase), "phase_score", phase),
        ("step_counts", counted, None, None),
        ("inner_steps", ~counted | (F.coalesce("inner_attempts", "attempts").eqNullSafe(c("attempts")) & F.coalesce("inner_steps", "steps").eqNullSafe(c("steps"))), None, None),
        ("effective_steps", ~counted | near(c("effective_steps"), effective), "effective_steps", effective),
        ("rejection_rate", ~counted | near(c("rejection_rate"), ratio(c("guard_rejections"), c("attempts"))), "rejection_rate", ratio(c("guard_rejections"), c("attempts"))),
        *[(f"{name}_not_finite", finite(c(name)), name, None) for name in ("terminal_reward", "raw_reward", "policy_penalty", "answer_quality", "efficiency")],
        ("policy_penalty", ~given | near(c("policy_penalty"), c("__penalty"), NEAR_REWARD), "policy_penalty", c("__penalty")),
        ("raw_reward", ~given | near(c("raw_reward"), raw, NEAR_REWARD), "raw_reward", raw),
        ("terminal_reward", ~given | near(c("terminal_reward"), clamp(raw / reward.SCALE, -1.0, 1.0), NEAR_REWARD), "terminal_reward", clamp(raw / reward.SCALE, -1.0, 1.0)),
        ("termination", c("termination").eqNullSafe(c("inner_termination")), None, None),
    ]
    none = F.lit(None).cast("double")
    broken = [
        F.when(~is_true(good), F.struct(F.lit(problem).alias("problem"), (c(stored).cast("double") if stored else none).alias("stored"), (derived if derived is not None else none).cast("double").alias("derived")))
        for problem, good, stored, derived in rules
    ]
    return public_penalty(df, n).select(*key, F.explode(F.array_compact(F.array(*broken))).alias("__p")).select(*key, "__p.*")
