"""Evaluation: fixed-denominator summaries, paired deltas, checkpoint choice, gates and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions import expr


def summary(expected: DataFrame, results: DataFrame, task: str, stratum: str, metrics: list[str], valid: str = "valid") -> DataFrame:
    """Means over all expected tasks (missing and invalid ones count 0) and over valid ones, by stratum and in total.

    Results of unknown tasks are dropped. The total has a null stratum. One shuffle by task, one small one by stratum.
    """
    known = results.select(task, F.col(valid), *metrics)
    joined = expected.select(task, stratum).join(known, task, "left").withColumn("__valid", expr.is_true(F.col(valid)))
    value = lambda m: F.when(F.col("__valid"), F.coalesce(F.col(m).cast("double"), F.lit(0.0))).otherwise(0.0)
    aggs = [F.count("*").alias("expected"), F.count(valid).alias("completed"), F.sum(F.col("__valid").cast("long")).alias("valid_n")]
    aggs += [F.sum(value(m)).alias(f"__{m}") for m in metrics]
    total = joined.groupingSets([[stratum], []], stratum).agg(*aggs)
    out = [stratum, "expected", "completed", "valid_n"]
    for m in metrics:
        out += [(F.col(f"__{m}") / F.col("expected")).alias(f"mean_{m}"), (F.col(f"__{m}") / F.greatest(F.col("valid_n"), F.lit(1))).alias(f"valid_mean_{m}")]
    return total.select(*out)


def map_means(results: DataFrame, values: str, valid: str = "valid") -> DataFrame:
    """(key, mean, n) of a map column's entries over valid rows."""
    rows = results.where(expr.is_true(F.col(valid))).select(F.explode(values).alias("key", "value"))
    return rows.groupBy("key").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def counters(results: DataFrame, reason: str) -> DataFrame:
    """(reason, n); null reasons count as `missing`."""
    return results.groupBy(F.coalesce(F.col(reason), F.lit("missing")).alias("reason")).agg(F.count("*").alias("n"))


def duplicates(results: DataFrame, task: str) -> DataFrame:
    """Ids of more than one row; must be empty."""
    return results.groupBy(task).agg(F.count("*").alias("n")).where("n > 1")


def completion(expected: DataFrame, results: DataFrame, task: str) -> DataFrame:
    """One row: expected, completed (known ids with a result), unknown ids among the results."""
    marks = expected.select(task).withColumn("e", F.lit(1)).join(results.select(task).distinct().withColumn("r", F.lit(1)), task, "full")
    return marks.agg(F.count("e").alias("expected"), F.sum((F.col("e").isNotNull() & F.col("r").isNotNull()).cast("long")).alias("completed"), F.sum((F.col("e").isNull() & F.col("r").isNotNull()).cast("long")).alias("unknown"))


def paired_deltas(expected: DataFrame, stages: DataFrame, task: str, stage: str, order: list[str], metrics: list[str]) -> DataFrame:
    """Mean change of each metric between stages that follow one another; a missing value counts 0. (left, right, metric, delta)"""
    wide = stages.groupBy(task).pivot(stage, order).agg(*[F.sum(m).alias(m) for m in metrics])
    name = (lambda s, m: f"{s}_{m}" if len(metrics) > 1 else s)
    joined = expected.select(task).join(wide, task, "left")
    deltas = [(a, b, m) for a, b in zip(order, order[1:], strict=False) for m in metrics]
    sums = joined.agg(F.count("*").alias("__n"), *[F.sum(F.coalesce(F.col(name(b, m)), F.lit(0.0)) - F.coalesce(F.col(name(a, m)), F.lit(0.0))).alias(f"d{k}") for k, (a, b, m) in enumerate(deltas)])
    rows = F.array(*[F.struct(F.lit(a).alias("left_stage"), F.lit(b).alias("right_stage"), F.lit(m).alias("metric"), (F.col(f"d{k}") / F.col("__n")).alias("delta")) for k, (a, b, m) in enumerate(deltas)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def select_checkpoint(candidates: DataFrame, reference: dict[str, float], least_valid: float = 0.98, tolerance: float = 0.01) -> DataFrame:
    """Candidates with their rejection reasons and whether they are chosen (by metrics in order, then the lower step).

    A metric that is null counts 0.
    """
    known = lambda k: F.coalesce(F.col(k).cast("double"), F.lit(0.0))
    why = expr.reasons(
        (known("valid_rate") < least_valid, "valid_rate"),
        *[(known(k) < v - tolerance, f"{k}_regressed") for k, v in reference.items()],
    )
    judged = candidates.withColumn("rejections", F.array_join(why, ","))
    rank = F.struct(*[known(k).alias(k) for k in ("terminal", "correct", "aligned", "efficiency")], (-F.col("step")).alias("s"))
    best = judged.where("rejections = ''").agg(F.max_by("step", rank).alias("best"))  # one row
    return judged.join(F.broadcast(best)).withColumn("selected", F.coalesce(F.col("step") == F.col("best"), F.lit(False))).drop("best")


def rates(df: DataFrame, conditions: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Share of rows for which each condition is true."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.avg(expr.is_true(c).cast("double")).alias(k) for k, c in conditions.items()])


def transitions(turns: DataFrame, task: str, order: list[str], choice: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(source, target, sources, moves, rate): how often a choice is followed at once by another. Trailing sources count."""
    after = turns.withColumn("__next", F.lead(choice).over(Window.partitionBy(task).orderBy(*order)))
    aggs = []
    for k, (a, b) in enumerate(pairs):
        aggs += [F.count_if(F.col(choice) == a).alias(f"s{k}"), F.count_if((F.col(choice) == a) & (F.col("__next") == b)).alias(f"m{k}")]
    rows = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.col(f"s{k}").alias("sources"), F.col(f"m{k}").alias("moves"), F.coalesce(F.try_divide(F.col(f"m{k}").cast("double"), F.col(f"s{k}")), F.lit(0.0)).alias("rate")) for k, (a, b) in enumerate(pairs)])
    return after.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def followed_by(turns: DataFrame, task: str, turn: str, choice: str, first: str, others: list[str]) -> DataFrame:
    """(task, violated): whether one of `others` comes after the first `first`. A plain aggregation, no sort."""
    sums = turns.groupBy(task).agg(F.min(F.when(F.col(choice) == first, F.col(turn))).alias("a"), F.max(F.when(F.col(choice).isin(others), F.col(turn))).alias("b"))
    return sums.select(task, F.coalesce(F.col("a") < F.col("b"), F.lit(False)).alias("violated"))


def gate(values: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(gate, value, threshold, passed) for a one-row table; an unobservable (null) value fails."""
    rows = []
    for name, (sign, limit) in limits.items():
        v = F.col(name).cast("double")
        good = {">=": v >= limit, "<=": v <= limit, "=": v == limit}[sign]
        rows.append(F.struct(F.lit(name).alias("gate"), v.alias("value"), F.lit(float(limit)).alias("threshold"), F.coalesce(good, F.lit(False)).alias("passed")))
    return values.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a_value, b_value, change) of two tables, keys of either."""
    left, right = a.select(key, F.col(value).alias("a_value")), b.select(key, F.col(value).alias("b_value"))
    return left.join(right, key, "full").withColumn("change", F.col("b_value") - F.col("a_value"))


def length_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """min, nearest-rank p50, p90, p95, max."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), *[expr.nearest_rank(value, s).alias(f"p{round(100 * s)}") for s in (0.5, 0.9, 0.95)], F.max(value).alias("most"))


def curve(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Population deviation, number of decreases, first and last value of a series."""
    step = df.withColumn("__before", F.lag(value).over(Window.partitionBy(*by).orderBy(order)))
    return step.groupBy(*by).agg(F.count("*").alias("points"), F.stddev_pop(value).alias("deviation"), F.count_if(F.col(value) < F.col("__before")).alias("decreases"), F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))


def attempt_history(attempts: DataFrame, task: str, attempt: str, outcome: str) -> DataFrame:
    """(task, attempts, history): outcomes of the attempts in order, as text."""
    return attempts.groupBy(task).agg(F.count("*").alias("attempts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(attempt, outcome))), lambda x: x[outcome]), ">").alias("history"))


def first_accepted(attempts: DataFrame, task: str, attempt: str, accepted: str) -> DataFrame:
    """(task, tries, accepted_attempt): the first accepted attempt, null if none."""
    return attempts.groupBy(task).agg(F.count("*").alias("tries"), F.min(F.when(F.col(accepted), F.col(attempt))).alias("accepted_attempt"))


def digest(df: DataFrame, by: list[str], order: str, content: str) -> DataFrame:
    """SHA-256 over the ordered rows' own hashes, by group."""
    own = df.select(*by, F.col(order).alias("o"), F.sha2(F.col(content), 256).alias("h"))
    return own.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))


def dump_problems(tasks: DataFrame, dump: DataFrame, task: str, size: int | None = None) -> DataFrame:
    """(problem, task_id, n): why a validation dump is no result of these tasks; no rows if it is.

    wrong_size (another number of tasks than `size`, in n) and repeated_task of the tasks; unknown_task and repeated_result
    of the dump, whose null ids count as the empty text. A task without a result is no problem: it counts 0.
    """
    name = F.coalesce(F.col(task).cast("string"), F.lit("")).alias("task_id")
    asked = tasks.groupBy(name).agg(F.count("*").alias("asked"))
    given = dump.groupBy(name).agg(F.count("*").alias("given"))
    both = asked.join(given, "task_id", "full")
    kinds = F.array_compact(F.array(
        F.when(F.col("asked") > 1, F.struct(F.lit("repeated_task").alias("problem"), F.col("asked").alias("n"))), F.when(F.col("asked").isNull(), F.struct(F.lit("unknown_task").alias("problem"), F.col("given").alias("n"))),
        F.when(F.col("asked").isNotNull() & (F.col("given") > 1), F.struct(F.lit("repeated_result").alias("problem"), F.col("given").alias("n")))))
    found = both.select("task_id", F.explode(kinds).alias("x")).select("x.problem", "task_id", "x.n")
    if size is None:
        return found
    return found.unionByName(tasks.agg(F.count("*").alias("n")).where(F.col("n") != size).select(F.lit("wrong_size").alias("problem"), F.lit(None).cast("string").alias("task_id"), "n"))


def dump_results(tasks: DataFrame, dump: DataFrame, task: str, stratum: str, metrics: dict[str, str | None], size: int | None = None) -> DataFrame:
    """(task, stratum, valid, metrics, guard_rejections): a validation dump as results; ValueError if it has problems.

    metrics: a name and the column that takes its place where it is null (or None: 0). Only a reward that is said to be valid
    makes a result valid. A dump has no guard counts, so these are 0.
    """
    bad = dump_problems(tasks, dump, task, size).orderBy("problem", "task_id").limit(5).collect()
    if bad:
        raise ValueError(f"not a dump of these tasks: {[tuple(r) for r in bad]}")
    zero = F.lit(0.0)
    value = {m: F.coalesce(F.col(m).cast("double"), F.col(other).cast("double") if other else zero, zero) for m, other in metrics.items()}
    rows = dump.select(task, F.coalesce(F.col("reward_valid"), F.lit(False)).alias("valid"), *[v.alias(m) for m, v in value.items()])
    return rows.join(tasks.select(task, stratum), task).withColumn("guard_rejections", F.lit(0).cast("long"))


def consistency(stored: DataFrame, recomputed: DataFrame, key: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(key, metric, stored, recomputed, same) of every column but the key that both summaries have, null-safe.

    A row that only one of them has is compared with nulls, so a stratum that was dropped or made up shows.
    """
    common = [c for c in stored.columns if c in recomputed.columns and c not in key]
    long = lambda df, name: df.select(*key, *[F.col(c).cast("double").alias(c) for c in common]).unpivot(key, common, "metric", name)
    left, right = long(stored, "stored"), long(recomputed, "recomputed")
    condition = F.col("a.metric") == F.col("b.metric")
    for c in key:
        condition &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = left.alias("a").join(right.alias("b"), condition, "full")
    same = F.coalesce(F.abs(F.col("a.stored") - F.col("b.recomputed")) <= tolerance, F.col("a.stored").isNull() & F.col("b.recomputed").isNull())
    return both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in key], F.coalesce("a.metric", "b.metric").alias("metric"), "a.stored", "b.recomputed", same.alias("same"))
