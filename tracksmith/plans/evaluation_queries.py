"""Registered queries: evaluation, rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracksmith.functions import expr
from tracksmith.operators import evaluation, reward, rollouts
from tracksmith.plans.bind import COUNTERS, RESULTS, TASKS, TURNS, counters, read, results, tasks, turns
from tracksmith.plans.splits_queries import query

METRICS = ["terminal", "completion", "steps"]
E9 = 6


def rounded(df, *names):
    return df.withColumns({n: F.round(n, E9) for n in names})


def _means(sql_metric: str) -> str:
    v = f"sum(CASE WHEN v THEN coalesce({sql_metric}, 0) ELSE 0 END)"
    return f"round({v} / count(*)::DOUBLE, 6) AS mean_{sql_metric}, round({v} / greatest(sum(v::INT), 1)::DOUBLE, 6) AS valid_mean_{sql_metric}"


A_1 = f"""WITH {TASKS}, {RESULTS}, j AS (SELECT t.composition, r.valid, coalesce(r.valid, false) AS v, terminal, completion, steps FROM tasks t LEFT JOIN results r USING (task_id))
SELECT composition, count(*) AS expected, count(valid) AS completed, CAST(sum(v::INT) AS BIGINT) AS valid_n, {', '.join(map(_means, METRICS))} FROM j GROUP BY GROUPING SETS ((composition), ())"""


@query("a_1", A_1)
def a_1(spark, d):
    out = evaluation.summary(tasks(spark, d), results(spark, d), "task_id", "composition", METRICS)
    return rounded(out, *[f"{p}mean_{m}" for m in METRICS for p in ("", "valid_")])


@query("a_2", f"WITH x AS ({A_1}) SELECT composition, expected, mean_terminal FROM x WHERE composition IS NOT NULL")
def _(spark, d):
    return a_1(spark, d).where("composition IS NOT NULL").select("composition", "expected", "mean_terminal")


@query("a_3", "SELECT key, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT l_returnflag AS key, l_quantity / 50 AS v FROM lineitem WHERE l_discount > 0.02 UNION ALL SELECT l_linestatus, l_tax FROM lineitem WHERE l_discount > 0.02) GROUP BY 1")
def _(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_discount") > 0.02).alias("valid"), F.create_map("l_returnflag", F.col("l_quantity") / 50, "l_linestatus", F.col("l_tax")).alias("q"))
    return rounded(evaluation.map_means(rows, "q"), "mean")


@query("a_4", f"WITH {RESULTS} SELECT coalesce(reason, 'missing') AS reason, count(*) AS n FROM results GROUP BY 1")
def _(spark, d):
    return evaluation.counters(results(spark, d), "reason")


@query("a_5", f"WITH {TASKS}, {RESULTS}, e AS (SELECT * FROM tasks WHERE ord % 2 = 0) SELECT (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM e WHERE task_id IN (SELECT task_id FROM results)) AS completed, (SELECT count(*) FROM results WHERE task_id NOT IN (SELECT task_id FROM e)) AS unknown")
def _(spark, d):
    return evaluation.completion(tasks(spark, d).where("ord % 2 = 0"), results(spark, d), "task_id")


@query("a_6", f"WITH {TASKS}, {RESULTS} SELECT count(*) AS n, CAST(0 AS BIGINT) AS guard_rejections, round(avg(CASE WHEN r.valid THEN terminal ELSE 0 END), 6) AS terminal FROM tasks LEFT JOIN results r USING (task_id)")
def _(spark, d):
    out = evaluation.summary(tasks(spark, d), results(spark, d), "task_id", "composition", ["terminal"]).where("composition IS NULL")
    return out.select(F.col("expected").alias("n"), F.lit(0).cast("long").alias("guard_rejections"), F.round("mean_terminal", 6).alias("terminal"))


@query("a_6_all", f"WITH {TASKS}, {RESULTS} SELECT count(*) AS n, CAST(0 AS BIGINT) AS guard_rejections, round(avg(CASE WHEN r.valid THEN terminal ELSE 0 END), 6) AS terminal FROM tasks LEFT JOIN results r USING (task_id)")
def _(spark, d):
    out = evaluation.summary(tasks(spark, d), results(spark, d), "task_id", "composition", ["terminal"]).where("composition IS NULL")
    return out.select(F.col("expected").alias("n"), F.lit(0).cast("long").alias("guard_rejections"), F.round("mean_terminal", 6).alias("terminal"))


STAGES = "stages AS (SELECT CAST(o_custkey AS VARCHAR) AS task_id, o_orderstatus AS stage, floor(o_totalprice) / 1000 AS price FROM orders)"


@query("a_7", f"""WITH {TASKS}, {STAGES}, w AS (SELECT task_id, coalesce((SELECT sum(price) FROM stages s WHERE s.task_id = t.task_id AND stage = 'F'), 0) AS f, coalesce((SELECT sum(price) FROM stages s WHERE s.task_id = t.task_id AND stage = 'O'), 0) AS o, coalesce((SELECT sum(price) FROM stages s WHERE s.task_id = t.task_id AND stage = 'P'), 0) AS p FROM tasks t)
  SELECT 'F' AS left_stage, 'O' AS right_stage, 'price' AS metric, round(avg(o - f), 4) AS delta FROM w UNION ALL SELECT 'O', 'P', 'price', round(avg(p - o), 4) FROM w""")
def _(spark, d):
    stages = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("task_id"), F.col("o_orderstatus").alias("stage"), (F.floor("o_totalprice") / 1000).alias("price"))
    return evaluation.paired_deltas(tasks(spark, d), stages, "task_id", "stage", ["F", "O", "P"], ["price"]).withColumn("delta", F.round("delta", 4))


CANDIDATES = "candidates AS (SELECT n_nationkey AS step, 0.97::DOUBLE + (n_nationkey % 4) / 100.0::DOUBLE AS valid_rate, (n_nationkey * 7 % 10) / 10.0::DOUBLE AS terminal, (n_nationkey * 3 % 10) / 10.0::DOUBLE AS correct, (n_nationkey % 5) / 5.0::DOUBLE AS aligned, n_regionkey / 5.0::DOUBLE AS efficiency FROM nation)"


@query("a_8", f"""WITH {CANDIDATES}, judged AS (SELECT *, array_to_string(list_filter([CASE WHEN correct < 0.3 - 0.01 THEN 'correct_regressed' END, CASE WHEN terminal < 0.5 - 0.01 THEN 'terminal_regressed' END, CASE WHEN valid_rate < 0.98 THEN 'valid_rate' END], lambda x: x IS NOT NULL), ',') AS rejections FROM candidates)
  SELECT *, coalesce(step = (SELECT arg_max(step, (terminal, correct, aligned, efficiency, -step)) FROM judged WHERE rejections = ''), false) AS selected FROM judged""")
def _(spark, d):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    c = read(spark, d, "nation").select(n.alias("step"), (F.lit(0.97) + (n % 4) / 100.0).alias("valid_rate"), ((n * 7 % 10) / 10.0).alias("terminal"), ((n * 3 % 10) / 10.0).alias("correct"), ((n % 5) / 5.0).alias("aligned"), (r / 5.0).alias("efficiency"))
    return evaluation.select_checkpoint(c, {"terminal": 0.5, "correct": 0.3})


@query("a_9", f"WITH {RESULTS} SELECT count(*) AS n, round(avg((completion > 0)::INT), 6) AS any_done, round(avg((completion = 1)::INT), 6) AS all_done, round(avg(coalesce(reason = '1-URGENT', false)::INT), 6) AS urgent FROM results")
def _(spark, d):
    return rounded(evaluation.rates(results(spark, d), {"any_done": F.col("completion") > 0, "all_done": F.col("completion") == 1, "urgent": F.col("reason") == "1-URGENT"}), "any_done", "all_done", "urgent")


def _pair(a, b):
    return f"SELECT '{a}' AS source, '{b}' AS target, count(*) FILTER (choice = '{a}') AS sources, count(*) FILTER (choice = '{a}' AND nxt = '{b}') AS moves, round(count(*) FILTER (choice = '{a}' AND nxt = '{b}') / count(*) FILTER (choice = '{a}')::DOUBLE, 6) AS rate FROM x"


@query("a_10", f"WITH {TURNS}, x AS (SELECT *, lead(choice) OVER (PARTITION BY trajectory ORDER BY turn) AS nxt FROM turns) {_pair('action', 'search')} UNION ALL {_pair('search', 'answer')}")
def _(spark, d):
    return rounded(evaluation.transitions(turns(spark, d), "trajectory", ["turn"], "choice", [("action", "search"), ("search", "answer")]), "rate")


@query("a_11", f"WITH {TURNS} SELECT trajectory, coalesce(min(turn) FILTER (choice = 'answer') < max(turn) FILTER (choice IN ('action', 'search')), false) AS violated FROM turns GROUP BY 1")
def _(spark, d):
    return evaluation.followed_by(turns(spark, d), "trajectory", "turn", "choice", "answer", ["action", "search"])


@query("a_12", f"WITH {TURNS} SELECT outcome AS reason, count(*) AS n FROM turns WHERE choice <> 'action' GROUP BY 1")
def _(spark, d):
    return evaluation.counters(turns(spark, d).where("choice <> 'action'"), "outcome")


@query("a_13", f"WITH {TURNS} SELECT aspect, choice, count(*) AS n, round(avg((outcome = 'normal')::INT), 6) AS normal, round(avg((bucket > 3)::INT), 6) AS big FROM turns GROUP BY 1, 2")
def _(spark, d):
    return rounded(evaluation.rates(turns(spark, d), {"normal": F.col("outcome") == "normal", "big": F.col("bucket") > 3}, ["aspect", "choice"]), "normal", "big")


@query("a_14", """WITH v AS (SELECT avg(quality) AS quality, avg(toxic) AS toxic, CAST(NULL AS DOUBLE) AS unseen FROM labels)
  SELECT 'quality' AS gate, round(quality, 6) AS value, 0.8::DOUBLE AS threshold, quality >= 0.8 AS passed FROM v UNION ALL SELECT 'toxic', round(toxic, 6), 0.05, toxic <= 0.05 FROM v UNION ALL SELECT 'unseen', NULL, 0, false FROM v""")
def _(spark, d):
    v = read(spark, d, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic")).withColumn("unseen", F.lit(None).cast("double"))
    return rounded(evaluation.gate(v, {"quality": (">=", 0.8), "toxic": ("<=", 0.05), "unseen": ("=", 0.0)}), "value")


@query("a_15", "WITH a AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1) SELECT source, a.n AS a_value, b.n AS b_value, b.n - a.n AS change FROM a FULL JOIN b USING (source)")
def _(spark, d):
    docs = read(spark, d, "documents").select("source", "lang")
    of = lambda lang: docs.where(F.col("lang") == lang).groupBy("source").agg(F.count("*").alias("n"))
    return evaluation.compare(of("en"), of("de"), "source", "n")


@query("a_16", f"WITH {RESULTS} SELECT count(*) AS attempted, count(*) FILTER (valid) AS accepted, count(*) FILTER (valid AND completion >= 0.7) AS gold, round(coalesce(count(*) FILTER (valid) / nullif(count(*), 0)::DOUBLE, 0), 6) AS rate FROM results")
def _(spark, d):
    r = rollouts.teacher_summary(results(spark, d), F.col("valid"), F.col("completion") >= 0.7)
    return r.withColumn("rate", F.round("rate", 6))


LENGTHS = "count(n_chars) AS n, min(n_chars) AS least, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS most"


@query("a_17", f"SELECT lang, {LENGTHS} FROM documents GROUP BY 1")
def _(spark, d):
    return evaluation.length_summary(read(spark, d, "documents").select("lang", "n_chars"), "n_chars", ["lang"])


@query("x_16", f"SELECT source, {LENGTHS} FROM documents GROUP BY 1")
def _(spark, d):
    return evaluation.length_summary(read(spark, d, "documents").select("source", "n_chars"), "n_chars", ["source"])


@query("a_18", "SELECT p.lang, p.source, count(*) AS n FROM documents p GROUP BY GROUPING SETS ((lang), (source))")
def _(spark, d):
    return rollouts.counts_by(read(spark, d, "documents").select("lang", "source"), ["lang", "source"])


@query("a_19", f"WITH {TURNS}, x AS (SELECT trajectory, list(bucket ORDER BY turn) AS s FROM turns GROUP BY 1) SELECT trajectory, s[-1] AS last_score, CAST(len(list_filter(s, lambda v: v = 6)) AS BIGINT) AS top FROM x")
def _(spark, d):
    return rollouts.last_scores(turns(spark, d), "trajectory", "turn", "bucket", 6)


@query("a_20", f"WITH {TURNS} SELECT outcome AS reason, count(*) AS n FROM turns WHERE choice = 'search' GROUP BY 1")
def _(spark, d):
    return evaluation.counters(turns(spark, d).where("choice = 'search'"), "outcome")


@query("a_22", "SELECT o_custkey, count(*) AS attempts, string_agg(o_orderstatus, '>' ORDER BY o_orderkey) AS history FROM orders GROUP BY 1")
def _(spark, d):
    return evaluation.attempt_history(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey", "o_orderstatus")


@query("x_14", "SELECT o_custkey, count(*) AS tries, min(o_orderkey) FILTER (o_orderstatus = 'F') AS accepted_attempt FROM orders GROUP BY 1")
def _(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("ok"))
    return evaluation.first_accepted(o, "o_custkey", "o_orderkey", "ok")


@query("a_23", "WITH x AS (SELECT *, lag(p) OVER (PARTITION BY k ORDER BY o) AS b FROM (SELECT o_custkey % 20 AS k, o_orderkey AS o, floor(o_totalprice) AS p FROM orders)) SELECT k, count(*) AS points, round(stddev_pop(p), 3) AS deviation, count(*) FILTER (p < b) AS decreases, arg_min(p, o) AS first_value, arg_max(p, o) AS last_value FROM x GROUP BY 1")
def _(spark, d):
    o = read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("k"), F.col("o_orderkey").alias("o"), F.floor("o_totalprice").cast("double").alias("p"))
    return evaluation.curve(o, ["k"], "o", "p").withColumn("deviation", F.round("deviation", 3))


@query("a_24", "SELECT lang, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS digest FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(spark, d):
    return evaluation.digest(read(spark, d, "documents").where("text IS NOT NULL").select("lang", "doc_id", "text"), ["lang"], "doc_id", "text")


# Rewards

_RATIO = lambda n, q: f"(CASE WHEN {q} <= 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ({n})::DOUBLE / {q})) END)"
_MADE = "greatest(0, coalesce(attempts, steps))"
_EFFECTIVE = f"(greatest(greatest(0, steps), {_MADE} - least(guard_rejections, {_MADE})) + 0.25 * least(guard_rejections, {_MADE}))"
_BUDGET = "(preferences + 2 * aspects)"
_EFFICIENCY = f"(CASE WHEN {_EFFECTIVE} <= {_BUDGET} THEN 1.0 WHEN {_BUDGET} >= 20 THEN 0.0 ELSE greatest(0.0, 1.0 - ({_EFFECTIVE} - {_BUDGET})::DOUBLE / (20 - {_BUDGET})) END)"
_PENALTY = " + ".join([f"{w} * {_RATIO(f'least(greatest({n}, 0), 4)', '4')}" for n, w in reward.COUNT_PENALTIES.items()] + [f"{w} * {_RATIO(f'least(greatest({n}, 0), aspects)', 'aspects')}" for n, w in reward.ASPECT_PENALTIES.items()] + [f"CASE WHEN {n} THEN {w} ELSE 0 END" for n, w in reward.FLAG_PENALTIES.items()])
_PHASE = f"CASE WHEN opportunities = 0 THEN 1.0 ELSE {_RATIO('least(successes, opportunities)', 'opportunities')} END"
_RAW = f"3.0 * {_RATIO('correct', 'aspects')} + 0.2 * {_RATIO('n_active + n_passive', 'preferences')} + 0.08 * ({_PHASE}) + 0.06 * {_RATIO('searched', 'aspects')} + 0.04 * {_RATIO('quality_sum', 'aspects')} + 0.02 * {_EFFICIENCY} - ({_PENALTY})"


@query("m_1", f"WITH {COUNTERS} SELECT trajectory, round({_RATIO('n_active', 'preferences')}, 6) AS active, round({_RATIO('steps', 'aspects')}, 6) AS clamped, {_RATIO('steps', '0')}::DOUBLE AS vacuous FROM counters")
def _(spark, d):
    c = counters(spark, d)
    return c.select("trajectory", F.round(expr.ratio(F.col("n_active"), F.col("preferences")), 6).alias("active"), F.round(expr.ratio(F.col("steps"), F.col("aspects")), 6).alias("clamped"), expr.ratio(F.col("steps"), F.lit(0)).alias("vacuous"))


@query("m_2", f"WITH {COUNTERS}, x AS (SELECT trajectory, reward_valid, {_RAW} AS raw FROM counters) SELECT trajectory, round(raw, 6) AS raw_reward, round(CASE WHEN coalesce(reward_valid, false) THEN least(1, greatest(-1, raw / 3.4)) ELSE 0 END, 6) AS terminal_reward FROM x")
def _(spark, d):
    return rounded(reward.reward(counters(spark, d)).select("trajectory", "raw_reward", "terminal_reward"), "raw_reward", "terminal_reward")


PARTS = "parts AS (SELECT l_orderkey AS task, l_linenumber, CASE WHEN l_quantity > 5 THEN l_partkey END AS selected, CASE WHEN l_returnflag = 'N' THEN l_partkey ELSE -1 END AS best_id, l_partkey % 3 AS m, CAST(floor(l_quantity) AS BIGINT) % 4 AS n_active, 3 AS n_preferences, l_linestatus = 'O' AS searched FROM lineitem), scored AS (SELECT *, CASE WHEN selected = best_id THEN 1.0 WHEN selected IS NOT NULL AND m > 0 THEN 0.8 ELSE 0.0 END AS q, CASE WHEN searched THEN 0.25 + 0.75 * least(1.0, n_active::DOUBLE / 3) ELSE 0.0 END AS g FROM parts)"


@query("m_3", f"WITH {PARTS} SELECT task, count(*) AS aspects, round(sum(q)::DOUBLE, 6) AS quality_sum, round(sum(q * g)::DOUBLE, 6) AS grounded_sum, count(*) FILTER (q > 0) AS correct, count(*) FILTER (q = 1) AS best, count(selected) AS submitted, count(*) FILTER (searched) AS searched, bool_and(g = 1) AS fully_grounded FROM scored GROUP BY 1")
def _(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.when(F.col("l_quantity") > 5, F.col("l_partkey")).alias("selected"), F.when(F.col("l_returnflag") == "N", F.col("l_partkey")).otherwise(-1).alias("best_id"), F.when(F.col("l_partkey") % 3 > 0, F.array("l_partkey")).otherwise(F.array().cast("array<bigint>")).alias("correct_ids"), (F.floor("l_quantity") % 4).alias("n_active"), F.lit(3).alias("n_preferences"), (F.col("l_linestatus") == "O").alias("searched"))
    return rounded(reward.aspect_scores(x, "task"), "quality_sum", "grounded_sum")


SETS = TURNS + ", sets AS (SELECT trajectory, list_distinct(list(bucket) FILTER (bucket < 5)) AS k, list_distinct(list(bucket) FILTER (outcome = 'progress')) AS a, list_distinct(list(bucket) FILTER (outcome = 'none')) AS p FROM turns GROUP BY 1), act AS (SELECT trajectory, coalesce(k, []) AS k, list_intersect(coalesce(a, []), coalesce(k, [])) AS a, list_intersect(coalesce(p, []), coalesce(k, [])) AS p0 FROM sets), pas AS (SELECT trajectory, k, a, list_filter(p0, lambda x: NOT list_contains(a, x)) AS p FROM act)"


@query("m_4", f"WITH {SETS} SELECT trajectory, len(a)::INT AS n_active, len(p)::INT AS n_passive, round({_RATIO('len(a)', 'len(k)')}, 6) AS active_coverage, round({_RATIO('len(p)', 'len(k)')}, 6) AS passive_coverage, round({_RATIO('len(a) + len(p)', 'len(k)')}, 6) AS preference_coverage FROM pas")
def _(spark, d):
    s = turns(spark, d).groupBy("trajectory").agg(F.collect_set(F.when(F.col("bucket") < 5, F.col("bucket"))).alias("k"), F.collect_set(F.when(F.col("outcome") == "progress", F.col("bucket"))).alias("a"), F.collect_set(F.when(F.col("outcome") == "none", F.col("bucket"))).alias("p"))
    return rounded(reward.preference_sets(s, "k", "a", "p").drop("k", "a", "p"), "active_coverage", "passive_coverage", "preference_coverage")


@query("m_5", f"WITH {COUNTERS} SELECT trajectory, {_EFFECTIVE}::DOUBLE AS effective, round({_EFFICIENCY}, 6) AS efficiency FROM counters")
def _(spark, d):
    c = counters(spark, d).withColumn("effective", reward.effective_steps(F.col("steps"), F.col("attempts"), F.col("guard_rejections")).cast("double"))
    return c.select("trajectory", "effective", F.round(reward.efficiency(F.col("effective"), F.col("preferences"), F.col("aspects")), 6).alias("efficiency"))


@query("m_6", f"WITH {COUNTERS} SELECT trajectory, round(({_PENALTY})::DOUBLE, 6) AS policy_penalty FROM counters")
def _(spark, d):
    return counters(spark, d).select("trajectory", F.round(reward.penalty(F.col("aspects")), 6).alias("policy_penalty"))


@query("m_7", f"WITH {COUNTERS} SELECT trajectory, round(({_PHASE})::DOUBLE, 6) AS phase FROM counters")
def _(spark, d):
    return counters(spark, d).select("trajectory", F.round(reward.phase_score(F.col("successes"), F.col("opportunities")), 6).alias("phase"))


@query("m_8", f"WITH {COUNTERS} SELECT trajectory, correct = aspects AND aspects > 0 AND trajectory % 2 = 0 AS gold_itinerary, correct = aspects AND aspects > 0 AS correct_itinerary, correct = aspects AND aspects > 0 AND searched = aspects AS fully_grounded, coalesce(reward_valid, false) AND correct = aspects AND aspects > 0 AND searched = aspects AS aligned FROM counters")
def _(spark, d):
    found = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.greatest("correct", F.lit(1))), lambda i: F.struct(i, F.when(i <= F.col("correct"), F.when(F.col("trajectory") % 2 == 0, 1.0).otherwise(0.8)).otherwise(0.0))))
    return counters(spark, d).select("trajectory", *rollouts.itinerary_flags(found, F.col("aspects"), F.col("searched"), F.col("reward_valid")))


@query("m_9", "SELECT c_custkey, round(CASE WHEN r >= 0 THEN least(1, r) ELSE -tanh(-r / 1.5) END, 6) AS squashed FROM (SELECT c_custkey, c_acctbal / 1000 AS r FROM customer)")
def _(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.round(reward.legacy_squash(F.col("c_acctbal") / 1000), 6).alias("squashed"))


@query("m_12", "SELECT l_orderkey, count(*) AS aspects, CAST(sum(floor(l_quantity)) AS BIGINT) AS preferences FROM lineitem GROUP BY 1")
def _(spark, d):
    return rollouts.preference_counts(read(spark, d, "lineitem"), "l_orderkey", F.floor("l_quantity"))


@query("m_13", "SELECT o_custkey, CAST(sum(coalesce(nullif(o_orderkey % 3, 0), 1 + o_orderkey % 5 + o_orderkey % 2)) AS BIGINT) AS requests FROM orders GROUP BY 1")
def _(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_custkey", rollouts.request_estimate(k % 3, F.lit(1), k % 5, k % 2).alias("r")).groupBy("o_custkey").agg(F.sum("r").alias("requests"))


@query("m_14", f"WITH {COUNTERS}, x AS (SELECT CASE WHEN correct = aspects THEN 'full' WHEN correct > 0 THEN 'partial' WHEN invalid_actions > 0 THEN 'wrong_only' ELSE 'no_answer' END AS outcome FROM counters) SELECT c AS outcome, (SELECT count(*) FROM x WHERE x.outcome = c) AS n FROM (VALUES ('full'), ('partial'), ('wrong_only'), ('no_answer')) v(c)")
def _(spark, d):
    names = spark.createDataFrame([(n,) for n in ("full", "partial", "wrong_only", "no_answer")], "outcome string")
    found = counters(spark, d).groupBy(reward.outcome(F.col("aspects"), F.col("correct"), F.col("invalid_actions")).alias("outcome")).agg(F.count("*").alias("n"))
    return names.join(found, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))
