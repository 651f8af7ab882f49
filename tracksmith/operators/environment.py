"""The deterministic part of an episode: searches that fail by count, forced elicitation, choices, rewards and the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions import expr


def steps(turns: DataFrame, key: str, turn: str, aspects: Column, reward: Column, every: int = 5, patience: int = 3, most: int = 20, scale: float = 1.0, cost: float = 0.0) -> DataFrame:
    """turns up to each episode's end, with what the environment makes of each.

    turns: choice, aspect, on_topic (of an action: whether it asks for a preference). search_fails: every `every`-th search
    of the episode; forced: an action off topic after patience - 1 others since the last one on topic, which starts anew;
    taken: an answer on an aspect that has one; choices: aspects answered so far; step_reward: scaled, less the cost, in
    [0, 1], nothing for a failed search or a taken aspect; ends: all aspects have a choice, or `most` steps are done.
    """
    w = Window.partitionBy(key).orderBy(turn)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    search, answer, act = (F.col("choice") == c for c in ("search", "answer", "action"))
    off = act & ~expr.is_true(F.col("on_topic"))
    first = F.row_number().over(Window.partitionBy(key, "choice", "aspect").orderBy(turn)) == 1
    out = turns.withColumns({
        "step": F.row_number().over(w),
        "search_fails": search & (F.sum(search.cast("int")).over(upto) % every == 0),
        "__run": F.sum((act & ~off).cast("int")).over(upto),
        "taken": answer & ~first,
        "choices": F.sum((answer & first).cast("int")).over(upto),
    })
    offs = F.sum(off.cast("int")).over(Window.partitionBy(key, "__run").orderBy(turn).rowsBetween(Window.unboundedPreceding, 0))
    paid = F.when(F.col("search_fails") | F.col("taken"), 0.0).otherwise(reward)
    out = out.withColumn("forced", off & (offs % patience == 0)).withColumn("step_reward", expr.clamp(paid * scale - cost, 0.0, 1.0))
    out = out.withColumn("ends", (F.col("choices") >= aspects) | (F.col("step") >= most))
    before = F.coalesce(F.max(F.col("ends").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("__over", before).where("__over = 0").drop("__over", "__run")


STRICT, CANONICAL = "strict", "canonical"


def next_plan(strategy: str | None = None) -> Column:
    """struct<phase, aspect, field, options, problem>: what the teacher does next, from the columns of a session.

    aspects (array, in order), answered, complete (aspects whose preferences are known), searched (arrays), asked (array of
    `aspect.field`), fields and options (maps from an aspect to an array). The first aspect without an answer is asked
    about, field by field, then searched, then answered from its visible options. Fields are asked in their order; STRICT
    begins with the second one, CANONICAL goes backwards. problem: why there is no plan (phase is null then).
    """
    aspect = F.get(F.array_except("aspects", "answered"), F.lit(0))
    none = F.array().cast("array<string>")
    fields = F.coalesce(F.try_element_at("fields", aspect), none)
    turned = F.concat(F.slice(fields, F.lit(2), F.greatest(F.size(fields), F.lit(1))), F.slice(fields, 1, 1)) if strategy == STRICT else F.reverse(fields) if strategy == CANONICAL else fields
    field = F.get(F.filter(turned, lambda f: ~F.array_contains("asked", F.concat(aspect, F.lit("."), f))), F.lit(0))
    options = F.coalesce(F.try_element_at("options", aspect), none)
    asks, searches = ~F.array_contains("complete", aspect), ~F.array_contains("searched", aspect)
    problem = (
        F.when(aspect.isNull(), "environment_not_terminated_after_answers").when(asks & field.isNull(), F.concat(F.lit("preference_coverage_unreachable."), aspect))
        .when(~asks & ~searches & (F.size(options) == 0), F.concat(F.lit("search_no_visible_options."), aspect))
    )
    phase = F.when(problem.isNotNull(), None).when(asks, "elicit").when(searches, "search").otherwise("answer")
    return F.struct(phase.alias("phase"), F.when(phase.isNotNull(), aspect).alias("aspect"), F.when(phase == "elicit", field).alias("field"), F.when(phase == "answer", options).alias("options"), problem.alias("problem"))
