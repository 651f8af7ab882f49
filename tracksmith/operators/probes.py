"""Boundaries of offline probes: from a probe's own transcript, or from the source that its metadata names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.operators import public_control, rollouts, targets

# Kinds of probes and the label that each gives; the text of a backend that is down.
ANSWER_PROBE, PREFERENCE_PROBE, FALLBACK_PROBE = "search_answer_probe", "preference_boundary_probe", "fallback_recovery_probe"
#: Labels of a transcript that show the state after their turn.
AFTER = ("first_fallback", "second_fallback", "explicit_no_preference")
DOWN = "Currently the searching backend is experiencing some issues. Please try again later."


def event_turns(asked: DataFrame, turns: DataFrame) -> DataFrame:
    """(probe, event): the turn that a probe is about; probes whose source has none are left out.

    asked: probe, trajectory, at (a turn, or null), named (an aspect, or null). It is the turn `at` if the source has it,
    else the first search that names the aspect, else the first search.
    """
    met = asked.join(turns.select("trajectory", "turn", "choice", "content"), "trajectory")
    search = F.col("choice") == "search"
    rank = F.when(F.col("turn").eqNullSafe(F.col("at")), 0).when(search & targets.mentions(F.col("content"), F.col("named")), 1).when(search, 2)
    best = met.withColumn("__rank", rank).where("__rank IS NOT NULL").groupBy("probe").agg(F.min(F.struct("__rank", "turn")).alias("b"))
    return best.select("probe", F.col("b.turn").alias("event"))


def boundaries(probes: DataFrame, metadata: DataFrame, turns: DataFrame, down: str = DOWN) -> DataFrame:
    """(probe, turn, label, phase): labels of probes, and the phase before the turn (after it for fallbacks and no preference,
    and for the answer of a probe without a transcript).

    probes: probe, transcript (a trajectory of turns, or null), kind, task, context, double (whether a second search failed),
    original and retry (searches). metadata: kind, task, context, ord (of several rows the last counts), trajectory, at,
    named, down (null: the usual text). turns: trajectory, turn, choice, content, feedback, message. A probe with a
    transcript has all its boundaries; one without a source has none; else its kind gives one label.
    """
    walked = public_control.walk(turns, "trajectory", "turn", follow=True)
    seen = probes.where("transcript IS NOT NULL").select("probe", F.col("transcript").alias("trajectory")).join(walked, "trajectory")
    own = seen.select("probe", "turn", F.explode("labels").alias("label"), "phase", "phase_before")
    own = own.select("probe", "turn", "label", F.when(F.col("label").isin(*AFTER), F.col("phase")).otherwise(F.col("phase_before")).alias("phase"))
    last = rollouts.last_of_key(metadata, ["kind", "task", "context"], "ord", ["trajectory", "at", "named", "down"])
    asked = probes.where("transcript IS NULL").join(last, ["kind", "task", "context"])
    placed = asked.join(event_turns(asked, turns), "probe")
    there = placed.select("probe", "kind", "trajectory", F.col("event").alias("turn")).join(walked.select("trajectory", "turn", "phase", "phase_before"), ["trajectory", "turn"])
    single = there.where(F.col("kind").isin(ANSWER_PROBE, PREFERENCE_PROBE)).select(
        "probe", "turn", F.when(F.col("kind") == ANSWER_PROBE, "valid_search_to_answer").otherwise("preference_complete_to_search").alias("label"), F.when(F.col("kind") == ANSWER_PROBE, F.col("phase")).otherwise(F.col("phase_before")).alias("phase"))
    # What was recorded before the event, then the probe's searches, which all fail.
    fallen = placed.where((F.col("kind") == FALLBACK_PROBE) & F.col("original").isNotNull())
    first = turns.groupBy("trajectory").agg(F.min_by("message", "turn").alias("message"))
    history = fallen.select("probe", "trajectory", "event").join(turns, "trajectory").where("turn < event").select("probe", "turn", "choice", "content", "feedback", "message")
    again = F.array(F.struct(F.lit(0).alias("k"), F.col("original").alias("content")), F.struct(F.lit(1).alias("k"), F.when(F.col("double"), F.col("retry")).alias("content")))
    made = fallen.join(first, "trajectory").select("probe", "event", "down", "message", F.explode(again).alias("s")).where("s.content IS NOT NULL")
    made = made.select("probe", (F.col("event") + F.col("s.k")).alias("turn"), F.lit("search").alias("choice"), "s.content", F.coalesce(F.nullif("down", F.lit("")), F.lit(down)).alias("feedback"), "message")
    ended = public_control.replay(public_control.walk(history.unionByName(made), "probe", "turn", follow=True), "probe", "turn")
    ends = made.groupBy("probe").agg(F.max("turn").alias("turn"))
    fallback = ended.join(ends, "probe").join(fallen.select("probe", "double"), "probe").select("probe", "turn", F.when(F.col("double"), "second_fallback").otherwise("first_fallback").alias("label"), "phase")
    return own.unionByName(single).unionByName(fallback)
