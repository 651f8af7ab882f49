"""A session's reward ledger: checked snapshots, what a step elicited, searched and answered, repeats, and the stall cut.

Input: a row a step of trajectory, turn, choice, signature, meaning and meaning_aspect (null: no single meaning), ambiguous,
options (ids that an answer names), and the snapshot after the step: remaining (preferences), to_search (aspects), chosen
(initials of answered options) as arrays, active and passive (how many preferences came to light). A session begins with
all `known` preferences and `aspects` open and nothing chosen. Only steps between two snapshots that hold are counted: the
step's own must follow from the one before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions.expr import is_true

SNAPSHOT = ("remaining", "to_search", "chosen", "active", "passive")


def _within(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def _snapshot_faults(name: Callable[[str], Column], when: str) -> list[Column]:
    """What is wrong with one snapshot by itself; a null part is missing."""
    missing = F.greatest(*[name(c).isNull().cast("int") for c in SNAPSHOT]) > 0
    checks = {
        "missing": missing,
        "unknown_preference": ~_within(name("remaining"), F.col("known")),
        "unknown_aspect": ~_within(name("to_search"), F.col("aspects")),
        "negative_count": (name("active") < 0) | (name("passive") < 0),
        "more_elicited_than_known": name("active") + name("passive") > F.size(F.array_distinct("known")),
    }
    return [F.when(is_true(c), F.lit(f"{when}_{n}")) for n, c in checks.items()]


def transitions(steps: DataFrame) -> DataFrame:
    """steps with `before` (the snapshot before) and `violations`: names of all that is wrong with a step's snapshots.

    The sets may only shrink (chosen only grow), the counts only grow, and together by no more than newly left `remaining`.
    """
    in_order = Window.partitionBy("trajectory").orderBy("turn")
    opening = F.struct(F.col("known").alias("remaining"), F.col("aspects").alias("to_search"), F.array().cast("array<string>").alias("chosen"), F.lit(0).cast("long").alias("active"), F.lit(0).cast("long").alias("passive"))
    now = F.struct(*[F.col(c).cast("long").alias(c) if c in ("active", "passive") else F.col(c) for c in SNAPSHOT])
    rows = steps.withColumn("before", F.when(F.row_number().over(in_order) == 1, opening).otherwise(F.lag(now).over(in_order)))
    before = lambda c: F.col(f"before.{c}")
    newly = F.size(F.array_distinct(F.array_except(before("remaining"), F.col("remaining"))))
    joint = {
        "preferences_grow": ~_within(F.col("remaining"), before("remaining")),
        "aspects_grow": ~_within(F.col("to_search"), before("to_search")),
        "choices_shrink": ~_within(before("chosen"), F.col("chosen")),
        "active_falls": F.col("active") < before("active"),
        "passive_falls": F.col("passive") < before("passive"),
        "counts_exceed_elicited": F.col("active") - before("active") + F.col("passive") - before("passive") > newly,
    }
    names = [*_snapshot_faults(before, "before"), *_snapshot_faults(F.col, "after"), *[F.when(is_true(c), F.lit(n)) for n, c in joint.items()]]
    return rows.withColumn("violations", F.array_compact(F.array(*names)))


def violation_counts(moved: DataFrame) -> DataFrame:
    """(trajectory, violation, n, first_turn) of transitions()."""
    each = moved.select("trajectory", "turn", F.explode("violations").alias("violation"))
    return each.groupBy("trajectory", "violation").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


def _by_number(ids: Column, target: Callable[[Column], Column] | None = None) -> Column:
    """Ids in order of their number (those of the target first), ids without one last."""
    number = lambda x: F.when(F.regexp_like(x, F.lit(r"^.\d+$")), F.substr(x, F.lit(2)).cast("long"))
    keyed = F.transform(ids, lambda x: F.struct((~target(x) if target else F.lit(False)).alias("away"), F.coalesce(number(x), F.lit(2**62)).alias("number"), x.alias("id")))
    return F.transform(F.array_sort(keyed), lambda x: x["id"])


def attributed(moved: DataFrame, preference_aspect: Callable[[Column], Column], option_initial: Callable[[Column], Column]) -> DataFrame:
    """transitions() with what each sound step brought: active_ids, passive_ids, searched, answered, and whether it got on.

    Preferences that came to light go to the active count first, the asked aspect's before others, by number; the rest to the
    passive count. Options count as answers if their initial is newly chosen in an answer; the first of an aspect is kept.
    """
    sound = F.size("violations") == 0
    none = F.array().cast("array<string>")
    delta = lambda c: F.greatest(F.coalesce(F.col(c) - F.col(f"before.{c}"), F.lit(0)), F.lit(0)).cast("int")
    newly = F.array_except("before.remaining", "remaining")
    asked = lambda x: F.coalesce(preference_aspect(x) == F.col("meaning_aspect"), F.lit(False))
    rows = moved.withColumn("active_ids", F.when(sound, F.slice(_by_number(newly, asked), 1, delta("active"))).otherwise(none))
    rows = rows.withColumn("passive_ids", F.when(sound, F.slice(_by_number(F.array_except(newly, F.col("active_ids"))), 1, delta("passive"))).otherwise(none))
    rows = rows.withColumn("searched", F.when(sound, F.array_except("before.to_search", "to_search")).otherwise(none))
    opened = F.when(sound & (F.col("choice") == "answer"), F.array_except("chosen", "before.chosen")).otherwise(none)
    rows = rows.withColumn("__opened", opened).withColumn("answered", F.filter(F.coalesce("options", none), lambda o: F.array_contains("__opened", option_initial(o)))).drop("__opened")
    upto = Window.partitionBy("trajectory").orderBy("turn")
    rows = rows.withColumn("searched_so_far", F.array_distinct(F.flatten(F.collect_list("searched").over(upto))))
    initials = F.transform("answered", option_initial)
    earlier = F.flatten(F.collect_list(initials).over(upto.rowsBetween(Window.unboundedPreceding, -1)))
    got_on = (F.size("active_ids") + F.size("passive_ids") + F.size("searched") > 0) | (delta("active") + delta("passive") > 0)
    return rows.withColumn("answer_progress", sound & (F.size(F.array_except(initials, F.coalesce(earlier, none))) > 0)).withColumn("progress", sound & (got_on | F.col("answer_progress")))


def sessions(steps: DataFrame, option_initial: Callable[[Column], Column], correct: Callable[[Column], Column]) -> DataFrame:
    """A row a trajectory of attributed(): repeats, what was elicited, searched and answered, and faults.

    exact_repeats: a signature seen before; semantic_repeats: another signature of a meaning seen before. Of an aspect's
    answers the first is kept (`turn:position` orders them); each answer in an aspect not searched yet, and each wrong one, counts.
    """
    first = lambda c: F.row_number().over(Window.partitionBy("trajectory", c).orderBy("turn")) == 1
    exact = ~first("signature")
    marked = steps.withColumn("__exact", exact)
    fresh = Window.partitionBy("trajectory", "meaning", "__exact").orderBy("turn")
    marked = marked.withColumn("__semantic", ~F.col("__exact") & F.col("meaning").isNotNull() & (F.row_number().over(fresh) > 1))
    union = lambda c: F.array_join(_by_number(F.array_distinct(F.flatten(F.collect_list(c)))), ",")
    sums = marked.groupBy("trajectory").agg(
        F.count_if("__exact").alias("exact_repeats"), F.count_if("__semantic").alias("semantic_repeats"), F.count_if("ambiguous").alias("ambiguous_actions"),
        union("active_ids").alias("active"), union("passive_ids").alias("passive"), union("searched").alias("searched"),
        F.count_if("progress").alias("progress_steps"), F.count_if(F.size("violations") > 0).alias("unsound_steps"))
    answers = steps.select("trajectory", "turn", "searched_so_far", F.posexplode("answered").alias("at", "option")).withColumn("initial", option_initial(F.col("option")))
    kept = answers.groupBy("trajectory", "initial").agg(F.min_by("option", F.struct("turn", "at")).alias("option"), F.count_if(~F.array_contains("searched_so_far", F.col("initial"))).alias("unsearched"), F.count_if(~correct(F.col("option"))).alias("wrong"))
    by_session = kept.groupBy("trajectory").agg(F.array_join(F.array_sort(F.collect_list("option")), ",").alias("answers"), F.sum("unsearched").alias("unsearched_answers"), F.sum("wrong").alias("wrong_answers"))
    return sums.join(by_session, "trajectory", "left").fillna(0, ["unsearched_answers", "wrong_answers"]).fillna("", ["answers"])


def stall_cut(steps: DataFrame, threshold: int) -> DataFrame:
    """(trajectory, longest, recovery_at, recovered_at, stopped_at): where a session without progress is cut.

    steps: trajectory, turn, choice, progress, answer_progress, has_options, sound. At `threshold` steps in a row without
    progress one answer-only step is pending if options are visible; an answer that gets on clears it, anything else stops
    the session, as does a second stall, or one with no option visible. The first step that isn't sound ends the watch.
    """
    state = "struct<idle:long,longest:long,pending:boolean,recovery_at:long,recovered_at:long,stopped_at:long,watching:boolean>"
    names = ["idle", "longest", "pending", "recovery_at", "recovered_at", "stopped_at", "watching"]
    start = F.from_json(F.lit('{"idle":0,"longest":0,"pending":false,"watching":true}'), state)

    def step(s: Column, x: Column) -> Column:
        live = s["watching"] & x["sound"] & s["stopped_at"].isNull()
        saved = s["pending"] & (x["choice"] == "answer") & x["answer_progress"]
        idle = F.when(saved | (~s["pending"] & x["progress"]), F.lit(0)).when(s["pending"], s["idle"]).otherwise(s["idle"] + 1)
        stalled = ~s["pending"] & (idle >= threshold)
        again = stalled & s["recovery_at"].isNotNull()
        opens = stalled & ~again & x["has_options"]
        stops = (s["pending"] & ~saved) | again | (stalled & ~again & ~x["has_options"])
        after = F.struct(
            idle.cast("long").alias("idle"), F.greatest(s["longest"], idle).cast("long").alias("longest"), opens.alias("pending"), F.when(opens, x["turn"]).otherwise(s["recovery_at"]).alias("recovery_at"),
            F.when(saved, x["turn"]).otherwise(s["recovered_at"]).alias("recovered_at"), F.when(stops, x["turn"]).otherwise(s["stopped_at"]).alias("stopped_at"), F.lit(True).alias("watching"))
        kept = F.struct(*[(s[n] & x["sound"] if n == "watching" else s[n]).alias(n) for n in names])
        return F.when(live, after.cast(state)).otherwise(kept.cast(state))

    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("progress", "answer_progress", "has_options", "sound")]
    told = steps.groupBy("trajectory").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "choice", *flags))).alias("t"))
    return told.select("trajectory", F.aggregate("t", start, step).alias("s")).select("trajectory", "s.longest", "s.recovery_at", "s.recovered_at", "s.stopped_at")
