"""Replay of a trajectory's control state: a fold over its turns, in the JVM.

A trajectory's turns are gathered into an array, sorted and reduced by aggregate(); the state is a struct. The phases:
eliciting, then (after `threshold` turns without progress) search_required; a normal search leads to answer_required; a
failed one to retry_required; a second failed one blocks the aspect. A visible answer closes it. Closed aspects give way
to the next one; after the last the trajectory is done. In guarded phases calls of the wrong kind are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ELICIT, SEARCH, RETRY, ANSWER, DONE = "eliciting", "search_required", "retry_required", "answer_required", "done"
STATE = "struct<phase:string,aspect:int,streak:int,max_streak:int,fallbacks:int,answered:int,blocked:int,rejected:int>"


def _step(aspects: int, threshold: int):
    def merge(s: Column, t: Column) -> Column:
        phase, choice, outcome = s["phase"], t["choice"], t["outcome"]
        needs = F.when(phase.isin(SEARCH, RETRY), "search").when(phase == ANSWER, "answer")
        illegal = needs.isNotNull() & (choice != needs) | (phase == ANSWER) & (choice == "answer") & (outcome != "visible")
        found = (choice == "search") & (outcome == "normal")
        failed = (choice == "search") & (outcome != "normal")
        answered = (choice == "answer") & (outcome == "visible")
        blocks = failed & (s["fallbacks"] >= 1)
        closes = answered | blocks
        idle = (phase == ELICIT) & ((choice == "action") & (outcome != "progress") | (choice == "answer") & (outcome != "visible"))
        streak = F.when(idle, s["streak"] + 1).when(found | answered | (choice == "action") & (outcome == "progress"), 0).otherwise(s["streak"])
        following = F.when(closes & (s["aspect"] + 1 >= aspects), DONE).when(closes, ELICIT).when(found, ANSWER).when(failed, RETRY).when(idle & (streak >= threshold), SEARCH).otherwise(phase)
        moved = F.struct(
            following.alias("phase"),
            F.when(closes, s["aspect"] + 1).otherwise(s["aspect"]).alias("aspect"),
            F.when(closes, 0).otherwise(streak).alias("streak"),
            F.greatest(s["max_streak"], streak).alias("max_streak"),
            F.when(closes, 0).when(failed, s["fallbacks"] + 1).otherwise(s["fallbacks"]).alias("fallbacks"),
            (s["answered"] + answered.cast("int")).alias("answered"),
            (s["blocked"] + (blocks & ~answered).cast("int")).alias("blocked"),
            s["rejected"].alias("rejected"),
        )
        refused = F.struct(*[s[n].alias(n) for n in ("phase", "aspect", "streak", "max_streak", "fallbacks", "answered", "blocked")], (s["rejected"] + 1).alias("rejected"))
        return F.when(phase == DONE, s).when(illegal, refused).otherwise(moved).cast(STATE)

    return merge


def start() -> Column:
    return F.struct(F.lit(ELICIT).alias("phase"), *[F.lit(0).alias(n) for n in ("aspect", "streak", "max_streak", "fallbacks", "answered", "blocked", "rejected")]).cast(STATE)


def replay(turns: DataFrame, trajectory: str, turn: str, aspects: int = 3, threshold: int = 4) -> DataFrame:
    """(trajectory, turns, final state) from rows (trajectory, turn, choice, outcome)."""
    gathered = turns.groupBy(trajectory).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "choice", "outcome"))).alias("t"))
    return gathered.select(trajectory, F.size("t").alias("turns"), F.aggregate("t", start(), _step(aspects, threshold)).alias("s")).select(trajectory, "turns", "s.*")


def counted(turns: DataFrame, trajectory: str, turn: str, aspects: int = 3, threshold: int = 4) -> DataFrame:
    """(trajectory, chances and successes of each guarded phase, switches of aspect), counted along the replay."""
    step = _step(aspects, threshold)
    phases = {"search": SEARCH, "retry": RETRY, "answer": ANSWER}
    names = [f"{n}_{what}" for n in phases for what in ("chances", "successes")] + ["switches"]
    kind = "struct<s:" + STATE + "," + ",".join(f"{n}:bigint" for n in names) + ">"

    def merge(c: Column, t: Column) -> Column:
        after = step(c["s"], t)
        accepted = after["rejected"] == c["s"]["rejected"]
        add = lambda n, x: (c[n] + x.cast("bigint")).alias(n)
        counts = [add(f"{n}_{what}", (c["s"]["phase"] == p) & (accepted if what == "successes" else F.lit(True))) for n, p in phases.items() for what in ("chances", "successes")]
        return F.struct(after.alias("s"), *counts, add("switches", after["aspect"] > c["s"]["aspect"])).cast(kind)

    none = F.struct(start().alias("s"), *[F.lit(0).alias(n) for n in names]).cast(kind)
    gathered = turns.groupBy(trajectory).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "choice", "outcome"))).alias("t"))
    return gathered.select(trajectory, F.aggregate("t", none, merge).alias("c")).select(trajectory, *[f"c.{n}" for n in names])


def guard(phase: Column, choice: Column, outcome: Column) -> Column:
    """Reason to reject a call before it runs, or null."""
    return (
        F.when(phase == DONE, "episode is complete")
        .when((phase == SEARCH) & (choice != "search"), "a search is required")
        .when((phase == RETRY) & (choice != "search"), "a revised search is required")
        .when((phase == ANSWER) & (choice != "answer"), "an answer is required")
        .when((choice == "answer") & (outcome != "visible"), "the answer is not visible")
    )


def stall(turns: DataFrame, trajectory: str, turn: str, progress: str, threshold: int) -> DataFrame:
    """(trajectory, longest, stalled_at): longest run without progress, and the turn at which a run reaches the threshold."""
    w = Window.partitionBy(trajectory).orderBy(turn)
    runs = turns.withColumn("__run", F.sum(F.col(progress).cast("int")).over(w))
    sized = runs.withColumn("__at", F.sum((~F.col(progress)).cast("int")).over(Window.partitionBy(trajectory, "__run").orderBy(turn)))
    return sized.groupBy(trajectory).agg(F.max("__at").alias("longest"), F.min(F.when(F.col("__at") == threshold, F.col(turn))).alias("stalled_at"))


def repeats(turns: DataFrame, trajectory: str, turn: str, signature: str, meaning: str) -> DataFrame:
    """(trajectory, exact_repeats, semantic_repeats): same signature before; else same meaning before."""
    exact = F.row_number().over(Window.partitionBy(trajectory, signature).orderBy(turn)) > 1
    same = F.row_number().over(Window.partitionBy(trajectory, meaning).orderBy(turn)) > 1
    marked = turns.withColumn("__e", exact).withColumn("__s", same & F.col(meaning).isNotNull())
    return marked.groupBy(trajectory).agg(F.count_if("__e").alias("exact_repeats"), F.count_if(F.col("__s") & ~F.col("__e")).alias("semantic_repeats"))


def monotone(snapshots: DataFrame, trajectory: str, turn: str, shrinking: str, growing: str) -> DataFrame:
    """(trajectory, violations): turns at which a set grows that may only shrink, or a count falls that may only grow."""
    w = Window.partitionBy(trajectory).orderBy(turn)
    before = snapshots.withColumn("__set", F.lag(shrinking).over(w)).withColumn("__n", F.lag(growing).over(w))
    wrong = (F.size(F.array_except(shrinking, F.col("__set"))) > 0) | (F.col(growing) < F.col("__n"))
    return before.groupBy(trajectory).agg(F.count_if(wrong).alias("violations"))


def boundaries(turns: DataFrame, trajectory: str, turn: str, signature: str) -> DataFrame:
    """(trajectory, turn, label): places worth learning from: repeated, first_fallback, second_fallback, search_to_answer."""
    w = Window.partitionBy(trajectory).orderBy(turn)
    failed = (F.col("choice") == "search") & (F.col("outcome") != "normal")
    marked = turns.withColumn("__seen", F.row_number().over(Window.partitionBy(trajectory, signature).orderBy(turn)) > 1).withColumn("__failed", F.sum(failed.cast("int")).over(w)).withColumn("__before", F.lag(F.struct("choice", "outcome")).over(w))
    labels = F.array_compact(F.array(
        F.when(F.col("__seen"), F.lit("repeated")), F.when(failed & (F.col("__failed") == 1), F.lit("first_fallback")), F.when(failed & (F.col("__failed") == 2), F.lit("second_fallback")),
        F.when((F.col("__before.choice") == "search") & (F.col("__before.outcome") == "normal") & (F.col("choice") == "answer"), F.lit("search_to_answer")),
    ))
    return marked.select(trajectory, turn, F.explode(labels).alias("label"))


def last_phase(text: Column, phases: list[str]) -> Column:
    """The phase named last in a rendered note."""
    return F.get(F.reverse(F.regexp_extract_all(text, F.lit("(" + "|".join(phases) + ")"), F.lit(1))), 0)
