"""How the driver's tables feed the operators: each function gives an operator's input, SQL gives the same rows.

The SQL texts are WITH clauses that the oracle queries begin with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, composition, ord: a customer is a task, the market segment its composition."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("task_id"), F.col("c_mktsegment").alias("composition"), F.col("c_custkey").alias("ord"))


TASKS = "tasks AS (SELECT CAST(c_custkey AS VARCHAR) AS task_id, c_mktsegment AS composition, c_custkey AS ord FROM customer)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's result, from the orders of the customer with an even key sum: valid, terminal, completion, steps, reason."""
    per = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("task_id")).agg(
        F.count("*").alias("steps"), F.sum(F.floor("o_totalprice").cast("long")).alias("price"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.min("o_orderpriority").alias("reason"))
    return per.select("task_id", "steps", (F.col("steps") > 3).alias("valid"), ((F.col("price") % 1000) / 1000.0).alias("terminal"), (F.col("done") / F.col("steps")).alias("completion"), F.when(F.col("steps") % 5 != 0, F.col("reason")).alias("reason"))


RESULTS = """results AS (SELECT task_id, steps, steps > 3 AS valid, (price % 1000) / 1000.0::DOUBLE AS terminal, done / steps::DOUBLE AS completion,
  CASE WHEN steps % 5 <> 0 THEN reason END AS reason
  FROM (SELECT CAST(o_custkey AS VARCHAR) AS task_id, count(*) AS steps, sum(CAST(floor(o_totalprice) AS BIGINT)) AS price, count(*) FILTER (o_orderstatus = 'F') AS done, min(o_orderpriority) AS reason FROM orders GROUP BY 1))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events are the turns of a trajectory, numbered from 0 by time."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    v = F.coalesce(F.col("value"), F.lit(0.0))
    i = F.col("event_id")
    kind = F.col("event_type")
    choice = F.when(kind.isin("click", "signup"), "search").when(kind == "purchase", "answer").otherwise("action")
    outcome = F.when((kind == "click") & (i % 3 != 0), "normal").when(kind == "click", "fallback").when(kind == "signup", "empty").when((kind == "purchase") & (i % 4 != 0), "visible").when(kind == "purchase", "hidden").when((kind == "view") & (i % 2 == 0), "progress").otherwise("none")
    return e.select(F.col("user_id").alias("trajectory"), "event_id", n.cast("long").alias("turn"), choice.alias("choice"), outcome.alias("outcome"), (F.floor(v) % 7).cast("long").alias("bucket"), F.concat(F.lit("a"), (i % 3).cast("string")).alias("aspect"))


TURNS = """turns AS (SELECT user_id AS trajectory, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn,
  CASE WHEN event_type IN ('click','signup') THEN 'search' WHEN event_type = 'purchase' THEN 'answer' ELSE 'action' END AS choice,
  CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN 'normal' WHEN event_type = 'click' THEN 'fallback' WHEN event_type = 'signup' THEN 'empty'
       WHEN event_type = 'purchase' AND event_id % 4 <> 0 THEN 'visible' WHEN event_type = 'purchase' THEN 'hidden' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'progress' ELSE 'none' END AS outcome,
  CAST(floor(coalesce(value, 0)) AS BIGINT) % 7 AS bucket, 'a' || (event_id % 3) AS aspect FROM events)"""


def credited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the flags that credit needs."""
    i, c = F.col("event_id"), F.col("choice")
    flags = {
        "field_resolved": (c == "action") & (i % 2 == 0), "normal_candidates": F.col("outcome") == "normal", "answer_visible": F.col("outcome") == "visible",
        "correct_answer": (F.col("outcome") == "visible") & (i % 5 != 0), "wrong_answer": (c == "answer") & (i % 5 == 0), "exact_query_repeat": (c == "search") & (i % 11 == 0),
        "wrong_aspect": i % 13 == 0, "invisible_answer_id": F.col("outcome") == "hidden", "malformed_tool_call": i % 17 == 0, "no_tool_output": i % 19 == 0, "semantic_repeat": i % 7 == 0,
        "no_progress_action": (c == "action") & (i % 3 == 0), "guard_rejected": i % 6 == 0, "infrastructure_failure": i % 23 == 0, "reward_valid": F.col("trajectory") % 10 != 0,
    }
    return turns(spark, sf_dir).withColumns(flags).withColumn("tokens", F.col("bucket") + 1)


CREDITED = TURNS + """, credited AS (SELECT *, choice = 'action' AND event_id % 2 = 0 AS field_resolved, outcome = 'normal' AS normal_candidates, outcome = 'visible' AS answer_visible,
  outcome = 'visible' AND event_id % 5 <> 0 AS correct_answer, choice = 'answer' AND event_id % 5 = 0 AS wrong_answer, choice = 'search' AND event_id % 11 = 0 AS exact_query_repeat,
  event_id % 13 = 0 AS wrong_aspect, outcome = 'hidden' AS invisible_answer_id, event_id % 17 = 0 AS malformed_tool_call, event_id % 19 = 0 AS no_tool_output, event_id % 7 = 0 AS semantic_repeat,
  choice = 'action' AND event_id % 3 = 0 AS no_progress_action, event_id % 6 = 0 AS guard_rejected, event_id % 23 = 0 AS infrastructure_failure, trajectory % 10 <> 0 AS reward_valid, bucket + 1 AS tokens FROM turns)"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a rollout; every six of a customer's are one prompt's, the last prompt may have fewer."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = read(spark, sf_dir, "orders").withColumn("n", n.cast("long")).select(F.expr("o_custkey * 1000000 + n DIV 6").alias("uid"), F.expr("n % 6").alias("row"), (F.floor(F.col("o_totalprice") / 1000) % 4 / 4.0).alias("reward"), (F.col("o_orderkey") % 9 == 0).alias("invalid"), (F.col("o_orderstatus") == "P").alias("degraded"), F.col("o_orderkey").alias("orderkey"))
    return o.withColumn("batch", F.expr("row DIV 2"))


ROLLOUTS = """rollouts AS (SELECT *, row // 2 AS batch FROM (SELECT o_custkey * 1000000 + n // 6 AS uid, n % 6 AS row,
  (CAST(floor(o_totalprice / 1000) AS BIGINT) % 4) / 4.0::DOUBLE AS reward, o_orderkey % 9 = 0 AS invalid, o_orderstatus = 'P' AS degraded, o_orderkey AS orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)))"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward inputs of a trajectory, from its turns."""
    c = lambda x: F.count_if(x)
    t = turns(spark, sf_dir)
    rows = t.groupBy("trajectory").agg(
        F.count("*").alias("steps"), F.countDistinct("aspect").alias("aspects"), F.countDistinct(F.when(F.col("outcome") == "visible", F.col("aspect"))).alias("correct"),
        F.countDistinct(F.when(F.col("outcome") == "normal", F.col("aspect"))).alias("searched"), F.countDistinct("bucket").alias("preferences"), F.countDistinct(F.when(F.col("outcome") == "progress", F.col("bucket"))).alias("n_active"),
        c(F.col("outcome") == "hidden").alias("invalid_actions"), c(F.col("outcome") == "fallback").alias("exact_repeats"), c(F.col("outcome") == "empty").alias("semantic_repeats"), c(F.col("event_id") % 9 == 0).alias("guard_rejections"),
        c(F.col("event_id") % 21 == 0).alias("blocked_aspects"), c(F.col("event_id") % 15 == 0).alias("ambiguous_actions"), c(F.col("event_id") % 14 == 0).alias("unsearched_answers"), c(F.col("event_id") % 27 == 0).alias("wrong_answers"),
        F.count_if(F.col("choice") == "search").alias("opportunities"), c(F.col("outcome") == "normal").alias("successes"))
    return rows.withColumns({
        "quality_sum": F.col("correct") * 0.8, "n_passive": F.lit(0), "attempts": F.col("steps") + 2, "parallel_tool_calls": F.col("trajectory") % 4 == 0, "no_tool_output": F.col("trajectory") % 6 == 0,
        "max_steps_reached": F.col("steps") > 20, "reward_valid": F.when(F.col("trajectory") % 11 != 0, F.col("trajectory") % 12 != 0)})


COUNTERS = TURNS + """, counters AS (SELECT *, correct * 0.8::DOUBLE AS quality_sum, 0 AS n_passive, steps + 2 AS attempts, trajectory % 4 = 0 AS parallel_tool_calls, trajectory % 6 = 0 AS no_tool_output, steps > 20 AS max_steps_reached,
  CASE WHEN trajectory % 11 <> 0 THEN trajectory % 12 <> 0 END AS reward_valid FROM (SELECT trajectory, count(*) AS steps, count(DISTINCT aspect) AS aspects, count(DISTINCT CASE WHEN outcome = 'visible' THEN aspect END) AS correct,
  count(DISTINCT CASE WHEN outcome = 'normal' THEN aspect END) AS searched, count(DISTINCT bucket) AS preferences, count(DISTINCT CASE WHEN outcome = 'progress' THEN bucket END) AS n_active,
  count(*) FILTER (outcome = 'hidden') AS invalid_actions, count(*) FILTER (outcome = 'fallback') AS exact_repeats, count(*) FILTER (outcome = 'empty') AS semantic_repeats, count(*) FILTER (event_id % 9 = 0) AS guard_rejections,
  count(*) FILTER (event_id % 21 = 0) AS blocked_aspects, count(*) FILTER (event_id % 15 = 0) AS ambiguous_actions, count(*) FILTER (event_id % 14 = 0) AS unsearched_answers, count(*) FILTER (event_id % 27 = 0) AS wrong_answers,
  count(*) FILTER (choice = 'search') AS opportunities, count(*) FILTER (outcome = 'normal') AS successes FROM turns GROUP BY 1))"""
