"""Registered queries: stored results derived anew, rendered notes and their replay, run summaries, sources, pools and subsets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracksmith.functions import expr
from tracksmith.operators import events, invariants, notes, pools, rollouts
from tracksmith.plans.bind import RESULTS, TASKS, TURNS, read, results, tasks, turns
from tracksmith.plans.splits_queries import query
from tracksmith.sources import tables

# Results: an order is a result, its line numbers are aspects; 26 of 31 keep their figures, with one fault each. Both dialects read these texts.

_LINES = "CASE WHEN max(l_quantity) > 25 THEN 1e0 WHEN max(l_quantity) > 5 THEN 8e-1 ELSE 0e0 END * CASE WHEN l_orderkey % 31 = 3 THEN 5e-1 ELSE 1e0 END"
_COUNTS = {"guard_rejections": "k % 4", "invalid_actions": "k % 6", "exact_repeats": "k % 5", "semantic_repeats": "k % 3", "blocked_aspects": "k % 2", "ambiguous_actions": "k % 2", "unsearched_answers": "k % 4", "wrong_answers": "k % 3"}
_SPENT = "8e-2 * least({guard_rejections}, 4) / 4 + 3e-2 * least({invalid_actions}, 4) / 4 + 2e-2 * least({exact_repeats}, 4) / 4 + 2e-2 * least({semantic_repeats}, 4) / 4 + 8e-2 * least({blocked_aspects}, n) / n + 2e-2 * least({ambiguous_actions}, n) / n + 3e-2 * least({unsearched_answers}, n) / n + 4e-2 * least({wrong_answers}, n) / n + CASE WHEN k % 7 = 0 THEN 2e-2 ELSE 0e0 END".format(**{c: f"({e})" for c, e in _COUNTS.items()})
_RAW = "3e0 * {0}completion + 2e-1 * {0}preference + 8e-2 * {0}phase_score + 6e-2 * {0}search + 4e-2 * {0}answer_quality + 2e-2 * {0}efficiency"
_RIGHT = {
    "b_completion": "correct / CAST(n AS DOUBLE)", "b_submission": "CASE WHEN k % 2 = 0 THEN 1e0 ELSE correct / CAST(n AS DOUBLE) END", "b_active": "k % 4 / 4e0", "b_passive": "k % 3 / 3e0", "b_preference": "least(1e0, k % 4 / 4e0 + k % 3 / 3e0)", "b_search": "k % 5 / 4e0",
    "b_rate": "CASE WHEN k % 3 + k % 2 = 0 THEN 1e0 ELSE k % 3 / CAST(k % 3 + k % 2 AS DOUBLE) END", "b_phase_score": "CASE WHEN k % 3 + k % 2 + k % 4 = 0 THEN 1e0 ELSE (k % 3 + k % 4) / CAST(k % 3 + k % 2 + k % 4 AS DOUBLE) END",
    "b_attempts": "6 + k % 10", "b_steps": "6 + k % 10 - k % 4 - k % 3", "b_effective": "6 + k % 10 - k % 4 + 25e-2 * (k % 4)", "b_rejection_rate": "k % 4 / CAST(6 + k % 10 AS DOUBLE)", "b_answer_quality": "qsum / n", "b_efficiency": "k % 9 / 8e0", "b_penalty": _SPENT,
    "b_raw": _RAW.format("b_") + " - b_penalty",
}
# A column, its right value, and what stands there instead in rows of one fault.
_FAULTY = {
    "valid": ("true", {1: "CAST(NULL AS BOOLEAN)"}), "transcript_size": ("0", {2: "3"}), "completion": ("b_completion", {5: "b_completion + 1e-1"}), "correct_rate": ("b_completion", {6: "b_completion - 2e-9"}), "submission": ("b_submission", {7: "2e0", 8: "-1e-1"}),
    "correct_itinerary": ("b_completion = 1 AND b_submission = 1", {9: "NOT (b_completion = 1 AND b_submission = 1)"}), "gold_itinerary": ("b_completion = 1 AND b_submission = 1 AND k % 2 = 0", {10: "true"}), "active": ("b_active", {11: "15e-1"}), "passive": ("b_passive", {}),
    "preference": ("b_preference", {12: "b_preference * 5e-1"}), "search": ("b_search", {13: "11e-1", 27: "CAST('Infinity' AS DOUBLE)"}), "s1": ("k % 3", {14: "7"}), "o1": ("k % 3 + k % 2", {}), "rate": ("b_rate", {15: "b_rate * 99e-2"}), "phase_score": ("b_phase_score", {16: "b_phase_score * 99e-2"}),
    "attempts": ("b_attempts", {17: "b_steps - 1"}), "steps": ("b_steps", {}), "inner_attempts": ("b_attempts", {18: "b_attempts + 1", 17: "b_steps - 1", 28: "CAST(NULL AS BIGINT)"}), "inner_steps": ("b_steps", {}), "effective_steps": ("b_effective", {19: "b_effective + 25e-2"}), "rejection_rate": ("b_rejection_rate", {20: "b_rejection_rate + 1e-3"}),
    "answer_quality": ("b_answer_quality", {21: "CAST(NULL AS DOUBLE)"}), "efficiency": ("b_efficiency", {22: "CAST('NaN' AS DOUBLE)"}), "policy_penalty": ("b_penalty", {23: "b_penalty + 1e-7"}), "raw_reward": ("b_raw", {24: "b_raw + 1e-7"}), "terminal_reward": ("greatest(-1e0, least(1e0, b_raw / 34e-1))", {25: "b_raw"}),
    "termination": ("CASE WHEN k % 7 = 0 THEN 'max_steps' ELSE 'completed' END", {}), "inner_termination": ("CASE WHEN k % 7 = 0 THEN 'max_steps' ELSE 'completed' END", {26: "CAST(NULL AS VARCHAR(9))"}),
}
_STORED = [f"CASE k % 31 {' '.join(f'WHEN {i} THEN {e}' for i, e in faults.items())} ELSE {right} END AS {c}" if faults else f"{right} AS {c}" for c, (right, faults) in _FAULTY.items()]
_BASE = [f"{e} AS {c}" for c, e in {**_COUNTS, **_RIGHT}.items()]


def stored(spark, d):
    """Results with their stored figures, as invariants.result_problems() takes them."""
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")).agg(F.expr(_LINES.replace("l_orderkey", "any_value(l_orderkey)")).alias("q"))
    held = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("a"), F.count("*").alias("n"), F.count_if(F.col("q") > 0).alias("correct"), F.sum("q").alias("qsum"))
    names = F.transform("a", lambda x: F.concat(F.lit("a"), x["i"].cast("string")))
    wider = F.when(F.col("k") % 31 == 4, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    full = held.selectExpr("*", *_BASE).selectExpr("*", *_STORED).withColumn("aspects", names)
    entry = lambda s, o, r: F.struct(s.cast("long").alias("successes"), o.cast("long").alias("opportunities"), r.cast("double").alias("rate"))
    phases = F.create_map(F.lit("search_required"), entry(F.col("s1"), F.col("o1"), F.col("rate")), F.lit("candidate_answer"), entry(F.col("k") % 4, F.col("k") % 4, F.lit(1.0)))
    return full.withColumn("quality", F.map_from_arrays(F.concat("aspects", wider), F.concat(F.transform("a", lambda x: x["q"]), F.transform(wider, lambda x: F.lit(1.0))))).withColumn("phases", phases)


_NUMBER = "isfinite({0})"
_RULES = [
    ("invalid", "valid", None, None), ("transcript_kept", "transcript_size = 0", None, None), ("quality_keys", "k % 31 <> 4", None, None), ("quality_values", "odd = 0", None, None), ("completion", "abs(completion - correct / n) <= 1e-9", "completion", "correct / n"), ("correct_rate", "abs(correct_rate - completion) <= 1e-9", "correct_rate", "completion"),
    ("submission", "submission BETWEEN 0 AND 1 AND submission + 1e-9 >= completion", "submission", None), ("correct_itinerary", "correct_itinerary = (abs(completion - 1) <= 1e-9 AND abs(submission - 1) <= 1e-9)", None, None), ("gold_itinerary", "NOT gold_itinerary OR correct_itinerary", None, None),
    ("preference_range", "active BETWEEN 0 AND 1", "preference", None), ("preference", "active > 1 OR abs(preference - least(1, active + passive)) <= 1e-9", "preference", "least(1, active + passive)"), ("search", "search BETWEEN 0 AND 1", "search", None), ("phase_counts", "s1 <= o1", None, None),
    ("phase_rates", "abs(rate - CASE WHEN o1 = 0 THEN 1 ELSE s1 / o1 END) <= 1e-9", None, None), ("phase_score", "abs(phase_score - ph) <= 1e-9", "phase_score", "ph"), ("step_counts", "counted", None, None), ("inner_steps", "NOT counted OR coalesce(inner_attempts, attempts) = attempts", None, None),
    ("effective_steps", "NOT counted OR abs(effective_steps - b_effective) <= 1e-9", "effective_steps", "b_effective"), ("rejection_rate", "NOT counted OR abs(rejection_rate - b_rejection_rate) <= 1e-9", "rejection_rate", "b_rejection_rate"),
    ("answer_quality_not_finite", _NUMBER.format("answer_quality"), "answer_quality", None), ("efficiency_not_finite", _NUMBER.format("efficiency"), "efficiency", None),
    ("policy_penalty", "NOT given OR abs(policy_penalty - b_penalty) <= 1e-8", "policy_penalty", "b_penalty"), ("raw_reward", "NOT given OR abs(raw_reward - raw) <= 1e-8", "raw_reward", "raw"), ("terminal_reward", "NOT given OR abs(terminal_reward - greatest(-1, least(1, raw / 3.4))) <= 1e-8", "terminal_reward", "greatest(-1, least(1, raw / 3.4))"),
    ("termination", "termination IS NOT DISTINCT FROM inner_termination", None, None),
]
_BROKEN = ", ".join(f"CASE WHEN NOT coalesce({good}, false) THEN {{'problem': '{p}', 'stored': CAST({s or 'NULL'} AS DOUBLE), 'derived': CAST({v or 'NULL'} AS DOUBLE)}} END" for p, good, s, v in _RULES)


@query("v_18_derived", f"""WITH lines AS (SELECT l_orderkey AS k, l_linenumber AS i, {_LINES} AS q FROM lineitem GROUP BY 1, 2), held AS (SELECT k, count(*) AS n, count(*) FILTER (q > 0) AS correct, sum(q) AS qsum, count(*) FILTER (q NOT IN (0e0, 8e-1, 1e0)) AS odd FROM lines GROUP BY 1),
  base AS (SELECT *, {', '.join(_BASE)} FROM held), stored AS (SELECT *, {', '.join(_STORED)} FROM base), s AS (SELECT *, guard_rejections <= attempts AND steps <= attempts AS counted, answer_quality IS NOT NULL AND isfinite(answer_quality) AND isfinite(efficiency) AND isfinite(search) AS given,
  CASE WHEN o1 + k % 4 = 0 THEN 1 ELSE (s1 + k % 4) / (o1 + k % 4) END AS ph, {_RAW.format('')} - b_penalty AS raw FROM stored),
  p AS (SELECT k, unnest(list_filter([{_BROKEN}], lambda x: x IS NOT NULL)) AS p FROM s) SELECT k, p.problem AS problem, round(p.stored, 7) AS stored, round(p.derived, 7) AS derived FROM p""")
def _(spark, d):
    found = invariants.result_problems(stored(spark, d), ["k"])
    return found.withColumns({c: expr.signed_round(F.col(c), 7) for c in ("stored", "derived")})


# Notes: after each turn of eight comes a note on a state made from the event's columns; every sixth refuses the call first.

_P = "CASE event_id % 11 WHEN 0 THEN 'ELICITING' WHEN 1 THEN 'SEARCH_REQUIRED' WHEN 2 THEN 'SEARCH_RETRY_REQUIRED' WHEN 3 THEN 'ANSWER_REQUIRED' WHEN 4 THEN 'SWITCH_ASPECT_REQUIRED' WHEN 5 THEN 'ANSWERED' WHEN 6 THEN 'SEARCH_REQUIRED' WHEN 7 THEN 'ANSWER_REQUIRED' WHEN 8 THEN 'SWITCH_ASPECT_REQUIRED' ELSE 'ELICITING' END"
_STATE = f"""{TURNS}, st AS (SELECT trajectory * 1000 + turn // 8 AS trajectory, turn, choice, event_id, CASE WHEN event_id % 13 <> 0 THEN aspect END AS aspect, {_P} AS phase, event_id % 17 = 0 AS done, event_id % 2 = 0 AS blocked, event_id % 4 AS f,
  CASE WHEN event_id % 3 = 0 THEN 'H10,H' || bucket END AS ids, CASE WHEN event_id % 5 = 0 THEN 'old' END AS prior FROM turns), notes AS (SELECT *, 'Public control | Current public aspect: ' || coalesce(aspect, 'none') || ' | Current control state: ' || phase
  || ' | Current aspect fallback count: ' || CASE WHEN aspect IS NULL THEN 0 ELSE f END || ' | Current visible option IDs: ' || CASE WHEN aspect IS NULL OR ids IS NULL THEN 'none' WHEN ids < 'H10,H10' THEN array_to_string(list_sort(string_split(ids, ',')), ',') ELSE ids END
  || ' | Allowed next tool calls: ' || CASE WHEN done THEN 'none' WHEN aspect IS NULL THEN 'action' WHEN phase = 'ELICITING' THEN 'action, search, answer (visible ID only)' WHEN phase = 'SEARCH_REQUIRED' THEN 'search' WHEN phase = 'SEARCH_RETRY_REQUIRED' THEN 'search (revised query)' WHEN phase = 'ANSWER_REQUIRED' THEN 'answer (one visible option ID)'
     WHEN phase = 'ANSWERED' THEN 'none for this aspect' ELSE 'none for this aspect; next public aspect only' END
  || CASE WHEN prior IS NULL THEN '' ELSE chr(10) || 'Transition: SWITCH_ASPECT_REQUIRED | Previous public aspect: old is ' || CASE WHEN f > 1 THEN 'BLOCKED' ELSE 'ANSWERED' END || '; do not call that aspect again. Continue only with current public aspect: ' || coalesce(aspect, 'none') || '.' END
  || CASE WHEN NOT done AND phase = 'ELICITING' AND aspect IS NULL THEN '' ELSE chr(10) || 'Constraint: ' || CASE WHEN done THEN 'Do not issue another tool call or fabricate completion.' WHEN phase = 'ELICITING' THEN 'Ask only for a missing preference visible in the conversation; do not repeat an answered or declined preference.'
     WHEN phase = 'SEARCH_REQUIRED' THEN 'Do not call action; search using information already visible in the conversation.' WHEN phase = 'SEARCH_RETRY_REQUIRED' THEN 'Rewrite the query materially once; do not repeat the previous query.' WHEN phase = 'ANSWER_REQUIRED' THEN 'Answer with exactly one ID from the visible option list; do not search or call action.'
     WHEN phase = 'ANSWERED' THEN 'This aspect is answered; do not call a tool for it again.' WHEN blocked THEN 'The current aspect is blocked; do not search or answer it, and do not fabricate an answer.' ELSE 'The current aspect is terminal; do not call it again; continue with the next public aspect.' END END AS note FROM st)"""


def noted(spark, d):
    """(trajectory, turn, choice, event_id, note): eight turns in a row are a session."""
    t, e = turns(spark, d), F.col("event_id")
    phase = F.expr(_P)
    ids = F.when(e % 3 == 0, F.array(F.lit("H10"), F.concat(F.lit("H"), F.col("bucket").cast("string"))))
    note = notes.render(F.when(e % 13 != 0, F.col("aspect")), phase, e % 4, ids, e % 17 == 0, e % 2 == 0, F.when(e % 5 == 0, "old"), F.when(e % 4 > 1, "blocked").otherwise("answered"))
    return t.select(F.expr("trajectory * 1000 + turn DIV 8").alias("trajectory"), "turn", "choice", "event_id", note.alias("note"))


@query("t_25_notes", f"WITH {_STATE} SELECT trajectory, turn, note FROM notes")
def _(spark, d):
    return noted(spark, d).select("trajectory", "turn", "note")


@query("f_14_notes", f"""WITH {_STATE}, m AS (SELECT trajectory, 2 * turn AS turn, choice, NULL AS note, false AS refused, NULL AS phase, NULL AS blocked, false AS switched FROM notes UNION ALL
  SELECT trajectory, 2 * turn + 1, NULL, note, event_id % 6 = 0, phase, CASE WHEN phase = 'SWITCH_ASPECT_REQUIRED' AND ((f >= 2 AND aspect IS NOT NULL) OR (blocked AND NOT done)) THEN coalesce(aspect, 'none') END, prior IS NOT NULL FROM notes),
  o AS (SELECT *, coalesce(last_value(phase IGNORE NULLS) OVER (PARTITION BY trajectory ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'ELICITING') AS p, coalesce(lead(refused) OVER (PARTITION BY trajectory ORDER BY turn), false) AS bad FROM m),
  c AS (SELECT trajectory, count(*) FILTER (p = 'SEARCH_REQUIRED' AND choice = 'search' AND NOT bad) AS search_required_successes, count(*) FILTER (p = 'SEARCH_REQUIRED' AND choice IS NOT NULL) AS search_required_opportunities, count(*) FILTER (p = 'SEARCH_RETRY_REQUIRED' AND choice = 'search' AND NOT bad) AS retry_search_successes,
  count(*) FILTER (p = 'SEARCH_RETRY_REQUIRED' AND choice IS NOT NULL) AS retry_search_opportunities, count(*) FILTER (p = 'ANSWER_REQUIRED' AND choice = 'answer' AND NOT bad) AS candidate_answer_successes, count(*) FILTER (p = 'ANSWER_REQUIRED' AND choice IS NOT NULL) AS candidate_answer_opportunities,
  count(*) FILTER (switched) AS aspect_switch_successes, count(*) FILTER (switched) AS aspect_switch_opportunities, count(DISTINCT blocked) AS blocked_aspects FROM o GROUP BY 1)
  SELECT *, CASE WHEN search_required_opportunities + retry_search_opportunities + candidate_answer_opportunities + aspect_switch_opportunities = 0 THEN 1 ELSE (search_required_successes + retry_search_successes + candidate_answer_successes + aspect_switch_successes) / (search_required_opportunities + retry_search_opportunities + candidate_answer_opportunities + aspect_switch_opportunities) END AS score FROM c""")
def _(spark, d):
    n = noted(spark, d)
    refusal = F.when(F.col("event_id") % 6 == 0, "Public Control rejected this call.\n").otherwise("")
    calls = n.select("trajectory", (2 * F.col("turn")).alias("turn"), F.lit("assistant").alias("role"), "choice", F.lit(None).cast("string").alias("text"))
    answers = n.select("trajectory", (2 * F.col("turn") + 1).alias("turn"), F.lit("tool").alias("role"), F.lit(None).cast("string").alias("choice"), F.concat(refusal, "note").alias("text"))
    return notes.metrics(calls.unionByName(answers), "trajectory", "turn", "role", "choice", "text")


# A run of the teacher: an order is an attempt at its customer's task.

_ATTEMPT = {
    "accepted": "k % 5 = 0", "tier": "CASE WHEN k % 5 = 0 THEN CASE WHEN k % 3 = 0 THEN 'gold' ELSE 'silver' END END", "steps": "CASE WHEN k % 13 <> 0 THEN k % 9 END", "requests": "CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN k % 20 WHEN 2 THEN NULL ELSE 7 END",
    "r1": "CASE WHEN k % 5 <> 0 THEN CASE k % 3 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'fallback' ELSE 'repeat' END END", "r2": "CASE WHEN k % 7 = 1 THEN 'ambiguous' END", "g1": "CASE WHEN k % 6 < 2 THEN 'teacher_protocol_retry' END", "g2": "CASE WHEN k % 10 = 3 THEN 'malformed' END", "tokens": "k % 100",
}


@query("a_16_run", f"""WITH a AS (SELECT o_orderkey AS k, o_custkey AS task FROM orders), b AS (SELECT task, {', '.join(f'{e} AS {c}' for c, e in _ATTEMPT.items())}, k % 17 = 0 AS hidden FROM a),
  p AS (SELECT *, coalesce(nullif(requests, 0), coalesce(steps, 0) + (g1 IS NOT NULL)::INT + (g2 IS NOT NULL)::INT + hidden::INT) AS asked FROM b), t AS (SELECT task, bool_or(accepted) AS ok, min(tier) FILTER (accepted) AS tier, count(*) AS attempts, sum(coalesce(steps, 0)) AS steps, sum(asked) AS requests FROM p GROUP BY 1),
  n AS (SELECT count(*) AS tasks, count(*) FILTER (ok) AS accepted, count(*) FILTER (ok AND tier = 'gold') AS gold, count(*) FILTER (ok AND tier = 'silver') AS silver, count(*) FILTER (NOT ok) AS rejected, sum(attempts)::BIGINT AS attempts, sum(steps)::BIGINT AS environment_steps, sum(requests)::BIGINT AS teacher_requests FROM t)
  SELECT 'total' AS kind, name, n FROM (UNPIVOT n ON COLUMNS(*) INTO NAME name VALUE n) UNION ALL SELECT 'rejection', x, count(*) FROM (SELECT r1 AS x FROM b UNION ALL SELECT r2 FROM b) WHERE x IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'generation', x, count(*) FROM (SELECT g1 AS x FROM b UNION ALL SELECT g2 FROM b UNION ALL SELECT 'unknown' FROM b WHERE hidden) WHERE x IS NOT NULL GROUP BY 2 UNION ALL SELECT 'usage', 'input', sum(tokens)::BIGINT FROM b UNION ALL SELECT 'usage', 'output', sum(2 * tokens)::BIGINT FROM b WHERE tokens % 2 = 0""")
def _(spark, d):
    a = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("task"))
    a = a.selectExpr("*", *[f"{e} AS {c}" for c, e in _ATTEMPT.items()])
    hidden = F.when(F.col("k") % 17 == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    usage = F.when(F.col("tokens") % 2 == 0, F.create_map(F.lit("input"), F.col("tokens"), F.lit("output"), 2 * F.col("tokens"))).otherwise(F.create_map(F.lit("input"), F.col("tokens")))
    a = a.withColumns({"rejections": F.array_compact(F.array("r1", "r2")), "diagnostics": F.concat(F.array_compact(F.array("g1", "g2")), hidden), "usage": usage})
    return rollouts.teacher_run(a, "task")


# Sources and pools: an order is a row, its line numbers are its scenario's aspects.

_BEST = "CASE WHEN l_orderkey % 23 = 9 AND l_linenumber % 2 = 1 THEN NULL ELSE 'H' || min(l_partkey) END"


@query("v_3_sources", f"""WITH lines AS (SELECT l_orderkey AS k, l_linenumber AS i, {_BEST} AS best FROM lineitem WHERE l_orderkey % 37 <> 0 GROUP BY 1, 2), s AS (SELECT k, count(*) AS n, count(best) AS known, list(best ORDER BY i DESC) FILTER (best IS NOT NULL) AS ids FROM lines GROUP BY 1),
  r AS (SELECT o_orderkey AS k, n, known, ids, o_orderkey % 23 AS f FROM orders LEFT JOIN s ON s.k = o_orderkey), p AS (SELECT k, unnest(list_filter([CASE WHEN f = 1 THEN 'other_ability' END, CASE WHEN f = 2 THEN 'other_style' END, CASE WHEN f IN (3, 4, 5) THEN 'roles' END, CASE WHEN f = 6 THEN 'content_missing' END,
  CASE WHEN f = 7 THEN 'no_task_id' END, CASE WHEN f = 8 THEN 'other_split' END, CASE WHEN f = 14 THEN 'tool_task_id' END, CASE WHEN n IS NULL AND f <> 7 THEN 'no_scenario' END, CASE WHEN f <> 7 AND n > known THEN 'best_id_missing' END, CASE WHEN f IN (10, 13) THEN 'ground_truth_no_list' END,
  CASE WHEN f <> 7 AND n = known AND (f = 11 OR (f = 12 AND (n <> 2 OR ids[1] <> ids[2]))) THEN 'ground_truth_differs' END, CASE WHEN f = 15 AND n IS NOT NULL THEN 'no_difficulty' END], lambda x: x IS NOT NULL)) AS problem FROM r) SELECT k, problem FROM p""")
def _(spark, d):
    lines = read(spark, d, "lineitem").where("l_orderkey % 37 <> 0").groupBy("l_orderkey", "l_linenumber").agg(F.expr(_BEST.replace("l_orderkey %", "any_value(l_orderkey) %").replace("l_linenumber %", "any_value(l_linenumber) %")).alias("best"))
    known = pools.scenarios(lines.withColumn("aspect", F.concat(F.lit("a"), F.col("l_linenumber").cast("string"))), "l_orderkey", "aspect", "best")
    k, f = F.col("o_orderkey"), F.col("o_orderkey") % 23
    quoted = F.concat(F.lit("['"), F.array_join("best_ids", "', '"), F.lit("']"))
    more = F.concat(F.lit("['more', '"), F.array_join("best_ids", "', '"), F.lit("']"))
    twice = F.concat(F.lit("['"), F.get("best_ids", F.lit(0)), F.lit("', '"), F.get("best_ids", F.lit(0)), F.lit("']"))
    truth = F.when(f == 10, F.lit("['H1', 'H2'")).when(f == 13, F.lit("[1, 'H2']")).when(F.col("best_ids").isNull() | (F.size("best_ids") == 0), F.lit("[]")).when(f == 11, more).when(f == 12, twice).otherwise(quoted)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    system, user = message("system", F.lit("s")), message("user", F.when(f != 6, F.lit("u")))
    prompt = F.when(f == 3, F.array(user, system)).when(f == 4, F.array(system, user, user)).when(f != 5, F.array(system, user))
    sources = read(spark, d, "orders").join(known, k == F.col("l_orderkey"), "left").select(
        k.alias("k"), prompt.alias("prompt"), F.when(f != 7, k.cast("string")).alias("task_id"), F.when(f == 14, "other").when(f != 7, k.cast("string")).alias("tool_task_id"), F.when(f == 8, "test").otherwise("train").alias("split"), truth.alias("ground_truth"),
        F.when(f != 1, "interaction").otherwise("x").alias("ability"), F.when(f != 2, "rule").alias("style"))
    scenarios = known.select(F.col("l_orderkey").cast("string").alias("task_id"), "aspects", "best_ids", F.when(F.col("l_orderkey") % 23 != 15, "hard").otherwise("").alias("difficulty"))
    return pools.source_problems(sources, scenarios, "k", {"ability": "interaction", "style": "rule"}, "train")


_POOL = {"id": "CASE k % 29 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'twin' || CAST(k % 7 AS VARCHAR(20)) ELSE CAST(k AS VARCHAR(20)) END", "composition": "CASE WHEN k % 11 = 0 THEN NULL ELSE '22' END", "difficulty": "CASE WHEN k % 13 = 0 THEN '' ELSE 'hard' END", "source": "CASE k % 17 WHEN 0 THEN 'test' WHEN 1 THEN NULL ELSE 'train' END"}


@query("x_12_pool", f"""WITH o AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT k, {', '.join(f'{e} AS {c}' for c, e in _POOL.items())} FROM o), q AS (SELECT id, unnest(list_filter([CASE WHEN coalesce(id, '') = '' THEN 'no_id' END, CASE WHEN k % 19 = 0 THEN 'roles' END, CASE WHEN composition IS NULL THEN 'no_composition' END,
  CASE WHEN difficulty = '' THEN 'no_difficulty' END, CASE WHEN source IS NULL THEN 'no_source' END, CASE WHEN source = 'test' THEN 'other_split' END], lambda x: x IS NOT NULL)) AS problem FROM p) SELECT id, problem, count(*) AS n FROM q GROUP BY 1, 2 UNION ALL SELECT id, 'repeated_id', count(*) FROM p WHERE id <> '' GROUP BY 1 HAVING count(*) > 1""")
def _(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("k")).selectExpr("*", *[f"{e} AS {c}" for c, e in _POOL.items()])
    roles = F.when(F.col("k") % 19 == 0, F.array(F.lit("user"))).otherwise(F.array(F.lit("system"), F.lit("user")))
    return pools.pool_problems(rows.withColumn("prompt", F.transform(roles, lambda r: F.struct(r.alias("role")))), "id", "prompt", ["composition", "difficulty"], "source", "train")


@query("x_13_subset", f"""WITH {TASKS}, d AS (SELECT *, CASE WHEN ord % 50 = 1 THEN '0' ELSE task_id END AS d_id FROM tasks WHERE ord % 47 <> 5), e AS (SELECT ord, task_id AS id, CASE WHEN ord % 41 = 3 THEN 'other' ELSE composition END AS s FROM tasks),
  q AS (SELECT composition, count(*) + (composition = 'BUILDING')::INT AS quota FROM tasks GROUP BY 1), c AS (SELECT composition, count(*) AS n FROM d GROUP BY 1)
  SELECT 'id' AS problem, ord::VARCHAR AS place, id AS stated, d_id AS found FROM e LEFT JOIN d USING (ord) WHERE id IS DISTINCT FROM d_id UNION ALL SELECT 'stratum', ord::VARCHAR, s, composition FROM e LEFT JOIN d USING (ord) WHERE s IS DISTINCT FROM composition
  UNION ALL SELECT 'repeated_id', d_id, '1', count(*)::VARCHAR FROM d GROUP BY d_id HAVING count(*) > 1 UNION ALL SELECT 'quota', composition, quota::VARCHAR, n::VARCHAR FROM q JOIN c USING (composition) WHERE quota <> n
  UNION ALL SELECT 'selected_task_count', NULL, (SELECT count(*) FROM tasks)::VARCHAR, (SELECT count(*) FROM d)::VARCHAR UNION ALL SELECT 'source_task_count', NULL, '471', '470'""")
def _(spark, d):
    t = tasks(spark, d)
    entries = t.select("ord", F.col("task_id").alias("id"), F.when(F.col("ord") % 41 == 3, "other").otherwise(F.col("composition")).alias("stratum"))
    quotas = t.groupBy(F.col("composition").alias("stratum")).agg((F.count("*") + F.when(F.col("stratum") == "BUILDING", 1).otherwise(0)).alias("quota"))
    changed = t.where("ord % 47 <> 5").withColumn("task_id", F.when(F.col("ord") % 50 == 1, "0").otherwise(F.col("task_id")))
    header = {"schema_version": "subset-v1", "source_task_count": 470, "selected_task_count": t.count()}
    return pools.subset_problems(changed, entries, quotas, header, {"schema_version": "subset-v1", "source_task_count": 471}, "ord", "task_id", "composition")


# Fallbacks by text, and episodes whose last step leaves out the check of one choice.

_SAID = {
    "note": f"CASE event_id % 9 WHEN 0 THEN 'Judging of agent''s latest utterance failed: x' WHEN 1 THEN 'Responding system met some issues' WHEN 2 THEN 'so: Responding system met some issues' WHEN 3 THEN NULL ELSE 'fine' END",
    "feedback": "CASE event_id % 8 WHEN 0 THEN 'I am not sure how to respond to your latest utterance.' WHEN 1 THEN 'The searching backend is experiencing some issues' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'ok' END",
    "output": "repeat('By default will return N/A', event_id % 3) || CASE WHEN event_id % 5 = 0 THEN 'By default turn to normal conversation' ELSE '' END",
}


@query("t_23_texts", f"""WITH {TURNS}, s AS (SELECT trajectory, turn, choice, event_id, {', '.join(f'{e} AS {c}' for c, e in _SAID.items())} FROM turns), l AS (SELECT *, max(CASE WHEN choice <> 'action' THEN turn END) OVER (PARTITION BY trajectory ORDER BY turn) AS at FROM s),
  j AS (SELECT l.trajectory, l.feedback, s.note FROM l LEFT JOIN s ON s.trajectory = l.trajectory AND s.turn = l.at WHERE l.feedback IS NOT NULL)
  SELECT trajectory, count(*) AS steps, count(*) FILTER (note LIKE 'Judging%') AS judgment_fallbacks, count(*) FILTER (note LIKE 'Responding%' OR feedback LIKE '%not sure%') AS response_fallbacks, count(*) FILTER (feedback LIKE '%backend%') AS search_fallbacks FROM j GROUP BY 1""")
def _(spark, d):
    said = turns(spark, d).selectExpr("trajectory", "turn", "CASE WHEN choice <> 'action' THEN 'agent' ELSE 'env' END AS role", *[f"{e.replace(chr(39) * 2 + 's', chr(92) + chr(39) + 's')} AS {c}" for c, e in _SAID.items()])
    return rollouts.step_fallbacks(said, "trajectory", "turn", "role", "note", "feedback")


@query("t_23_output", "SELECT event_id, event_id % 3 AS search_fallbacks, (event_id % 5 = 0)::INT AS judgment_fallbacks FROM events")
def _(spark, d):
    said = read(spark, d, "events").selectExpr("event_id", f"{_SAID['output'].replace('event_id % 3', 'CAST(event_id % 3 AS INT)')} AS output")
    return said.select("event_id", *rollouts.output_fallbacks(F.col("output")))


@query("f_16_choices", "WITH c AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n, count(DISTINCT CASE WHEN l_quantity > 20 THEN l_linenumber END) AS m FROM lineitem GROUP BY 1) SELECT k, k % 11 = 0 OR (k % 3 <> 0 AND k % 5 <> 0 AND k % 7 <> 0 AND m >= n) AS terminated FROM c")
def _(spark, d):
    held = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_linenumber").alias("aspects"), F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_linenumber"))).alias("chosen"))
    k = F.col("k")
    aspects = F.when(k % 5 != 0, F.when(k % 7 == 0, F.array().cast("array<int>")).otherwise(F.col("aspects")))
    return held.select("k", rollouts.one_choice_terminated(F.when(k % 2 == 0, k % 11 == 0).when(k % 11 == 0, True), k % 3 != 0, aspects, F.col("chosen")).alias("terminated"))


# Turn events: cumulative counters and texts made from an event's columns; a quarter of the calls is refused.

_TURN = {
    "category": "CASE event_id % 16 WHEN 0 THEN 'guard_rejection' WHEN 4 THEN 'public_phase_guard' WHEN 8 THEN 'unknown_tool' WHEN 12 THEN 'no_tool_output' END",
    "reason": "CASE event_id % 5 WHEN 0 THEN 'This  query was ALREADY attempted' WHEN 1 THEN 'Do not repeat the query' WHEN 2 THEN 'use the current public aspect only' WHEN 3 THEN 'Answer ID is not visible' END",
    "content": "CASE event_id % 7 WHEN 0 THEN 'H1' WHEN 1 THEN ' H2 ,' WHEN 2 THEN 'H1, H2' WHEN 3 THEN NULL ELSE 'H9' END", "no_preference": "event_id % 6 = 1", "normal_search": "CASE WHEN event_id % 4 <> 3 THEN outcome = 'normal' END", "n_shown": "event_id % 3",
    "phase_before": "CASE WHEN event_id % 2 = 0 THEN 'search_retry_required' ELSE 'eliciting' END", "aspect_before": "CASE WHEN event_id % 9 <> 0 THEN aspect END", "aspect_after": "CASE WHEN event_id % 10 <> 0 THEN CASE WHEN event_id % 11 = 0 THEN 'other' ELSE aspect END END",
}
_GROWS = {"preferences": "outcome = 'progress'", "answers": "choice = 'answer'", "exact_repeats": "event_id % 7 = 2", "semantic_repeats": "event_id % 9 = 4", "infrastructure_errors": "event_id % 23 = 1", "wrong_answers": "choice = 'answer' AND event_id % 5 = 1"}


@query("f_13_events", f"""WITH {TURNS}, s AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _TURN.items())}, count(*) FILTER (outcome = 'fallback') OVER (PARTITION BY trajectory, aspect ORDER BY turn) AS fallbacks FROM turns), m AS (SELECT *, category IS NULL AS made, CASE event_id % 7 WHEN 0 THEN 'H1' WHEN 1 THEN 'H2' WHEN 4 THEN 'H9' WHEN 5 THEN 'H9' WHEN 6 THEN 'H9' END AS id,
  outcome = 'progress' OR (choice = 'action' AND no_preference) AS resolved, coalesce(normal_search, false) AND n_shown > 0 AS normal, outcome = 'fallback' AND category IS NULL AS fell FROM s)
  SELECT trajectory, turn, made AND resolved AS field_resolved, made AND normal AS normal_candidates, made AND choice = 'answer' AND coalesce(id IN ('H1', 'H2'), false) AS answer_visible, fell AND fallbacks = 1 AS first_fallback, fell AND fallbacks >= 2 AS second_fallback, made AND normal AND event_id % 2 = 0 AS rewritten_retry,
  made AND aspect_before IS NOT NULL AND aspect_after IS DISTINCT FROM aspect_before AS switched_aspect, made AND choice = 'action' AND NOT resolved AS no_progress_action, CASE WHEN made THEN event_id % 7 = 2 ELSE choice = 'search' AND event_id % 5 < 2 END AS exact_query_repeat, made AND event_id % 9 = 4 AS semantic_repeat,
  made AND event_id % 23 = 1 AS infrastructure_failure, made AND choice = 'answer' AND coalesce(id = 'H1', false) AS correct_answer, made AND choice = 'answer' AND event_id % 5 = 1 AS wrong_answer, event_id % 16 IN (0, 4) AS guard_rejected, event_id % 16 = 8 AS malformed_tool_call, event_id % 16 = 12 AS no_tool_output,
  NOT made AND choice IN ('search', 'answer') AND event_id % 5 = 2 AS wrong_aspect, NOT made AND choice = 'answer' AND event_id % 5 = 3 AS invisible_answer_id, (made AND outcome = 'progress')::BIGINT AS new_preferences FROM m""")
def _(spark, d):
    w = Window.partitionBy("trajectory").orderBy("turn")
    t = turns(spark, d).selectExpr("*", *[f"{e} AS {c}" for c, e in _TURN.items()])
    t = t.withColumns({c: F.count_if(F.expr(e)).over(w) for c, e in _GROWS.items()}).withColumn("search_fallbacks", F.count_if(F.col("outcome") == "fallback").over(Window.partitionBy("trajectory", "aspect").orderBy("turn")))
    t = t.withColumns({"shown": F.slice(F.array(F.lit("H1"), F.lit("H2")), F.lit(1), F.col("n_shown").cast("int")), "visible": F.array(F.lit("H1"), F.lit("H2")), "correct_ids": F.array(F.lit("H1"))})
    return events.turn_events(t, "trajectory", "turn")


# Probes: an event is the call at a probe's place, the three before it are what the actor did before.

_KIND = "CASE event_id % 5 WHEN 0 THEN 'normal_search_result' WHEN 1 THEN 'preference_complete' WHEN 2 THEN 'first_fallback' WHEN 3 THEN 'second_fallback' ELSE 'confused_history' END"
_CALLED = "CASE choice WHEN 'answer' THEN CASE WHEN bucket < 3 THEN 'H' || bucket WHEN bucket < 5 THEN 'H1, H2' ELSE 'none' END ELSE CASE WHEN bucket % 2 = 0 THEN 'Search  hotels in ' ELSE 'search flight to ' END || CASE WHEN bucket < 4 THEN 'Rome' ELSE 'Oslo' END END"
_NAMED = "(choice <> 'answer' AND bucket % 2 = {0})"


@query("m_15_probes", f"""WITH {TURNS}, s AS (SELECT *, {_KIND} AS category, {_CALLED} AS content, event_id % 13 <> 0 AS ok FROM turns), b AS (SELECT *, list(choice || ':' || content) OVER w AS sigs, list(choice || ':' || content) FILTER (choice = 'search') OVER w AS q FROM s WINDOW w AS (PARTITION BY trajectory ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
  m AS (SELECT *, choice || ':' || content AS sig, ok AND choice = 'search' AS search FROM b)
  SELECT trajectory, turn, ok AS protocol_valid, event_id % 5 = 0 AND ok AND choice = 'answer' AS answer_at_1, event_id % 5 = 0 AND ok AND choice = 'answer' AND bucket IN (1, 2) AS visible_id_only, event_id % 5 = 1 AND search AS search_at_1, event_id % 5 = 1 AND search AS clean_search_at_1, event_id % 5 = 1 AND search AND bucket % 2 = 0 AS search_targets_current_aspect,
  event_id % 5 = 2 AND search AND coalesce(len(q), 0) > 0 AND q[-1] <> sig AS changed_query, event_id % 5 = 2 AND search AND coalesce(list_contains(q, sig), false) AS exact_query_repeat, event_id % 5 = 3 AND ok AND {_NAMED.format(1)} AS switch_aspect, event_id % 5 = 3 AND search AND bucket % 2 = 0 AS same_aspect_search,
  event_id % 5 = 4 AND ok AND coalesce(list_contains(sigs, sig), false) AS repeated_action, event_id % 5 = 4 AND search AND coalesce(list_contains(q, sig), false) AS repeated_search FROM m""")
def _(spark, d):
    w = Window.partitionBy("trajectory").orderBy("turn").rowsBetween(-3, -1)
    t = turns(spark, d).selectExpr("trajectory", "turn", "event_id", "choice", f"{_KIND} AS category", f"{_CALLED} AS content")
    t = t.withColumn("earlier", F.collect_list(F.struct("choice", "content")).over(w)).withColumn("choice", F.when(F.col("event_id") % 13 != 0, F.col("choice")))
    aspects = {"current": F.lit("hotel"), "failed": F.when(F.col("event_id") % 2 == 0, "hotel"), "following": F.lit("flight"), "visible": F.array(F.lit("H1"), F.lit("H2"))}
    return events.probe_flags(t.withColumns(aspects), ["trajectory", "turn"])


# Boundary contexts: an order is a candidate; copies have customer, kind and month in common.

_CANDIDATE = {"boundary_type": "CASE o_orderkey % 3 WHEN 0 THEN 'first_fallback' WHEN 1 THEN 'second_fallback' ELSE 'preference_complete' END", "eligible": "o_orderkey % 4 = 0", "task": "o_custkey % 60"}
_SPLIT = "CASE task % 7 WHEN 0 THEN 'evaluation' WHEN 1 THEN 'other' WHEN 2 THEN NULL ELSE 'train' END"


@query("a_18_manifest", f"""WITH o AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _CANDIDATE.items())} FROM orders), k AS (SELECT task, boundary_type, o_orderstatus, count(*) AS n, bool_or(eligible) AS eligible, count(*) FILTER (o_orderkey % 2 = 0) AS teachers, count(*) FILTER (o_orderkey % 5 = 0) AS failed, count(*) FILTER (o_orderkey % 9 = 0 AND o_orderkey % 10 <> 7) AS none FROM o GROUP BY 1, 2, 3),
  u AS (SELECT *, {_SPLIT} AS split, CASE WHEN task % 11 <> 0 THEN '22' END AS composition FROM k)
  SELECT * FROM (SELECT 'total' AS section, 'raw_candidates' AS name, sum(n)::BIGINT AS n FROM u UNION ALL SELECT 'total', 'unique_contexts', count(*) FROM u UNION ALL SELECT 'total', 'duplicates_removed', sum(n - 1)::BIGINT FROM u UNION ALL SELECT 'by_boundary_type', boundary_type, count(*) FROM u GROUP BY 2
  UNION ALL SELECT 'by_project_split', coalesce(split, 'unknown'), count(*) FROM u GROUP BY 2 UNION ALL SELECT 'by_composition', coalesce(composition, 'unknown'), count(*) FROM u GROUP BY 2 UNION ALL SELECT 'by_source_kind', 'teacher', sum(teachers)::BIGINT FROM u UNION ALL SELECT 'by_source_kind', 'failed', sum(failed)::BIGINT FROM u UNION ALL SELECT 'by_source_kind', 'unknown', sum(none)::BIGINT FROM u
  UNION ALL SELECT 'checks', 'evaluation_contexts', count(*) FILTER (split = 'evaluation') FROM u UNION ALL SELECT 'checks', 'training_contexts', count(*) FILTER (eligible) FROM u UNION ALL SELECT 'checks', 'evaluation_marked_training', count(*) FILTER (split = 'evaluation' AND eligible) FROM u UNION ALL SELECT 'checks', 'unresolved_tasks', count(DISTINCT task) FILTER (split IS NULL OR split = 'other') FROM u)""")
def _(spark, d):
    o = read(spark, d, "orders").selectExpr("*", *[f"{e} AS {c}" for c, e in _CANDIDATE.items()])
    k = F.col("o_orderkey")
    kinds = F.concat(F.array_compact(F.array(F.when(k % 2 == 0, "teacher"), F.when(k % 5 == 0, "failed"))), F.when(k % 9 == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    rows = o.select(F.col("task").alias("task_id"), "boundary_type", "o_orderstatus", F.expr(_SPLIT).alias("project_split"), F.when(F.col("task") % 11 != 0, "22").alias("composition"), F.col("eligible").alias("training_eligible"), F.when(k % 10 != 7, kinds).alias("source_kinds"))
    return rollouts.boundary_manifest(rows, ["task_id", "boundary_type", "o_orderstatus"], ["train", "validation", "evaluation"])


@query("a_18_inventory", "SELECT source, count(*) AS files, sum(coalesce(n_chars, 0))::BIGINT AS n_chars FROM documents GROUP BY 1")
def _(spark, d):
    return rollouts.source_inventory(read(spark, d, "documents").select("source", "n_chars"), "source", ["n_chars"])


# States, options and sinks

@query("x_2_state", """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_partkey) AS p, count(*) AS n FROM lineitem GROUP BY 1, 2), x AS (SELECT k, i, p, unnest(generate_series(1, CASE WHEN p % 5 = 0 THEN 0 ELSE n END)) AS j FROM l),
  y AS (SELECT *, 'P' || row_number() OVER (PARTITION BY k ORDER BY i, j) AS id FROM x WHERE (p + j) % 6 >= 4), z AS (SELECT k, string_agg(id || ':' || 'd' || i || ':' || 't' || j, ',' ORDER BY i, j) AS preferences FROM y GROUP BY 1)
  SELECT k, coalesce(preferences, '') AS preferences, string_agg('d' || i, ',' ORDER BY i) AS search_arguments, coalesce(string_agg('B' || p, ',' ORDER BY i) FILTER (p % 4 <> 0), '') AS best_options, coalesce(string_agg('C' || p || ',D' || p, ',' ORDER BY i) FILTER (p % 3 <> 0), '') AS correct_options FROM l LEFT JOIN z USING (k) GROUP BY k, preferences""")
def _(spark, d):
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")).agg(F.min("l_partkey").alias("p"), F.count("*").alias("n"))
    text = lambda prefix: F.concat(F.lit(prefix), F.col("p").cast("string"))
    one = lambda j: F.slice(F.array(F.lit("a"), F.lit("s"), F.concat(F.lit("t"), j.cast("string")), F.lit("e"), F.lit("m")), F.lit(1), ((F.col("p") + j) % 6).cast("int"))
    lists = F.when(F.col("p") % 5 != 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("n")), one))
    rows = lines.select("k", "i", F.concat(F.lit("d"), F.col("i").cast("string")).alias("dimension"), lists.alias("lists"), F.when(F.col("p") % 4 != 0, text("B")).alias("best"), F.when(F.col("p") % 3 != 0, F.array(text("C"), text("D"))).alias("correct"))
    made = rollouts.initial_state(rows, "k", "i", "dimension", "lists", "best", "correct")
    said = F.transform("preferences", lambda x: F.concat_ws(":", x["id"], x["dimension"], x["preference"]))
    return made.select("k", F.array_join(said, ",").alias("preferences"), *[F.array_join(c, ",").alias(c) for c in ("search_arguments", "best_options", "correct_options")])


@query("io_14_options", """WITH o AS (SELECT o_custkey AS task, CASE o_orderstatus WHEN 'F' THEN 'correct' WHEN 'O' THEN 'wrong' ELSE 'noise' END AS kind, o_orderkey AS option FROM orders), h AS (SELECT *, sha256('seed' || chr(0) || task || '|' || kind || '|' || option) AS h FROM o),
  n AS (SELECT *, row_number() OVER (PARTITION BY task, kind ORDER BY h) AS n FROM h), k AS (SELECT * FROM n WHERE kind = 'correct' OR (kind = 'wrong' AND n <= 3) OR (kind = 'noise' AND n <= 2)) SELECT task, option, row_number() OVER (PARTITION BY task ORDER BY sha256(h), n) - 1 AS place FROM k""")
def _(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "correct").when(F.col("o_orderstatus") == "O", "wrong").otherwise("noise")
    options = read(spark, d, "orders").select(F.col("o_custkey").alias("task"), kind.alias("kind"), F.col("o_orderkey").alias("option"), F.lit("t").alias("type"), F.lit("r").alias("reason"))
    return tables.option_lists(options, ["task"], "kind", "option", "seed", {"wrong": 3, "noise": 2})


@query("io_9_written", f"WITH {RESULTS}, t AS (SELECT task_id, CASE WHEN valid AND completion >= 0.6 THEN 'gold' WHEN valid AND completion >= 0.3 THEN 'silver' ELSE 'rejected' END AS tier FROM results) SELECT tier, count(*) AS n, sum(task_id::BIGINT)::BIGINT AS ids FROM t GROUP BY 1 UNION ALL SELECT 'diagnostics', count(*), sum(o_orderkey)::BIGINT FROM orders")
def _(spark, d):
    tier = F.when(F.col("valid"), F.when(F.col("completion") >= 0.6, "gold").when(F.col("completion") >= 0.3, "silver"))
    base = tables.scratch(spark, "collection")
    paths = {name: f"{base}/{name}" for name in ("gold", "silver", "rejected", "diagnostics")}
    tables.write_collection(results(spark, d).select("task_id", tier.alias("tier")), read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("task_id")), paths, "tier")
    found = [spark.read.schema("task_id string").json(path).select(F.lit(name).alias("tier"), F.col("task_id").cast("long").alias("id")) for name, path in paths.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).groupBy("tier").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("io_10_written", "SELECT c_mktsegment, count(*)::VARCHAR AS n, (count(*) FILTER (c_nationkey % 2 = 0))::VARCHAR AS by_even, CASE WHEN count(*) FILTER (c_nationkey % 25 = 0) > 0 THEN (count(*) FILTER (c_nationkey % 25 = 0))::VARCHAR END AS by_first FROM customer GROUP BY 1")
def _(spark, d):
    path, even, first = tables.scratch(spark, "comparison"), F.count_if(F.col("c_nationkey") % 2 == 0), F.count_if(F.col("c_nationkey") % 25 == 0)
    by = F.map_filter(F.create_map(F.lit("even"), even, F.lit("first"), first), lambda k, v: (v > 0) | (k == "even"))
    tables.write_csv(read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), by.alias("by")), path, "by", ["even", "first"])
    return spark.read.option("header", "true").csv(path)
