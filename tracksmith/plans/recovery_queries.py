"""Registered queries: targets of boundaries, the environment's steps, an audit of two files, a configuration."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tracksmith.operators import contracts, environment, probes, rollouts, targets
from tracksmith.plans.bind import TURNS, read, turns
from tracksmith.plans.record_queries import cases, expected, put
from tracksmith.plans.splits_queries import query
from tracksmith.plans.trajectory_queries import talk
from tracksmith.sources import tables

FIELDS = {"hotel": {"rating": "star rating", "room": "room type"}, "flight": {"time": "departure time"}, "apartment": {}}
SCHEMA = "boundary string, phase string, aspect string, public_aspects array<string>, answered array<string>, blocked array<string>, visible array<string>, source_choice string, source_content string, last_search string, asked array<string>, split string"


def boundary() -> dict:
    return dict(boundary="explicit_no_preference", phase="ELICITING", aspect="hotel", public_aspects=["hotel", "flight", "apartment"], answered=[], blocked=[], visible=[], source_choice=None, source_content=None, last_search=None, asked=[], split="train")


def at(**values) -> list:
    return [put(k, v) for k, v in values.items()]


SEARCH = "Search for hotel options using the preferences stated by the user."
REUSE = dict(boundary="preference_complete_to_search", source_choice="search", source_content="Hotels in Rome")
REPLY = dict(boundary="valid_search_to_answer", phase="ANSWER_REQUIRED", visible=["H1", "H2"], source_choice="answer", source_content="H2")
RETRY = dict(boundary="first_fallback", phase="SEARCH_RETRY_REQUIRED", last_search="hotel in Rome")
LEAVE = dict(boundary="second_fallback", phase="SWITCH_ASPECT_REQUIRED", blocked=["hotel"])
#: Changes of the boundary: target (null: none), method, reasons, part.
FAULTS = [
    (at(), ("What star rating do you prefer for a hotel?", "deterministic_next_public_field", "", "train")), (at(asked=["hotel.rating"]), ("What room type do you prefer for a hotel?", "deterministic_next_public_field", "", "train")),
    (at(asked=["hotel.rating", "hotel.room"]), (SEARCH, "deterministic_no_preference_search", "", "train")), (at(phase="SEARCH_REQUIRED", split="validation"), (SEARCH, "deterministic_no_preference_search", "", "validation")), (at(phase="ANSWER_REQUIRED"), (None, "deterministic_next_public_field", "elicitation_phase_mismatch", "rejected")),
    (at(aspect=None, boundary="first_fallback"), (None, "deterministic_query_rewrite", "no_current_public_aspect", "rejected")), (at(boundary="visible_options_pending_answer", split="evaluation"), (None, "quarantine", "answer_id_not_determinable_without_hidden_correctness", "excluded_evaluation")),
    (at(**REUSE), ("Hotels in Rome", "accepted_teacher_or_source_prefix", "", "train")), (at(**REUSE, split="evaluation"), ("Hotels in Rome", "accepted_teacher_or_source_prefix", "", "excluded_evaluation")), (at(boundary="preference_complete_to_search"), (None, "accepted_teacher_or_source_prefix", "source_target_not_found", "rejected")),
    (at(**REUSE | {"source_choice": "action", "source_content": "which flight", "phase": "ANSWER_REQUIRED"}), (None, "accepted_teacher_or_source_prefix", "source_target_choice_not_search,search_target_aspect_mismatch,search_phase_mismatch", "rejected")),
    (at(**REPLY), ("H2", "accepted_teacher_or_source_prefix", "", "train")), (at(**REPLY | {"source_content": "H9"}), (None, "accepted_teacher_or_source_prefix", "answer_id_not_visible", "rejected")), (at(**REPLY | {"source_content": "H1, H2"}), (None, "accepted_teacher_or_source_prefix", "answer_not_exactly_one_option_id", "rejected")), (at(**REPLY | {"source_content": "F1", "visible": ["F1"], "phase": "ELICITING"}), (None, "accepted_teacher_or_source_prefix", "answer_aspect_mismatch,answer_phase_mismatch", "rejected")),
    (at(**RETRY), ("Revised search for hotel: hotel in Rome", "deterministic_query_rewrite", "", "train")), (at(**RETRY | {"last_search": None}), (None, "deterministic_query_rewrite", "original_search_not_found", "rejected")), (at(**RETRY | {"phase": "ELICITING"}), (None, "deterministic_query_rewrite", "retry_phase_mismatch", "rejected")),
    (at(**LEAVE), ("What departure time do you prefer for a flight?", "deterministic_aspect_switch", "", "train")), (at(**LEAVE, answered=["flight"]), (None, "deterministic_aspect_switch", "no_safe_field_for_next_aspect", "rejected")), (at(**LEAVE, answered=["flight", "apartment"]), (None, "deterministic_aspect_switch", "no_next_open_public_aspect", "rejected")),
    (at(**LEAVE | {"blocked": [], "phase": "ELICITING"}), (None, "deterministic_aspect_switch", "switch_phase_mismatch,failed_aspect_not_publicly_blocked", "rejected")), (at(boundary="repeated_no_progress_action"), (SEARCH, "deterministic_public_search", "", "train")), (at(boundary="repeated_no_progress_action", phase="ANSWER_REQUIRED"), (None, "deterministic_public_search", "search_phase_mismatch", "rejected")), (at(boundary="other"), (None, "unknown_boundary", "unknown_boundary_type", "rejected")),
]


def routed(spark, d):
    made = targets.validate(targets.construct(cases(spark, d, boundary(), FAULTS, SCHEMA), FIELDS))
    return targets.routed(made, "split")


F_6 = expected(FAULTS, list, "target, method, reasons, part")


@query("f_6", F_6)
def _(spark, d):
    return routed(spark, d).select("o_orderkey", F.col("target_content").alias("target"), "method", F.array_join("reasons", ",").alias("reasons"), "part")


@query("f_7", f"WITH r AS ({F_6}), n AS (SELECT method, part, count(*) AS n FROM r GROUP BY 1, 2) SELECT method, part, n, round(n / sum(n) OVER (PARTITION BY method)::DOUBLE, 6) AS share FROM n")
def _(spark, d):
    return targets.shares(routed(spark, d), "method").withColumn("share", F.round("share", 6))


@query("f_15", f"""WITH {TURNS}, a AS (SELECT trajectory, turn, choice, bucket % 3 AS aspect, outcome = 'progress' AS on_topic, CASE bucket % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.0 END::DOUBLE AS r FROM turns),
  b AS (SELECT *, row_number() OVER w AS step, count(*) FILTER (choice = 'search') OVER w AS searches, count(*) FILTER (choice = 'action' AND on_topic) OVER w AS run, choice = 'answer' AND row_number() OVER (PARTITION BY trajectory, choice, aspect ORDER BY turn) > 1 AS taken FROM a WINDOW w AS (PARTITION BY trajectory ORDER BY turn)),
  c AS (SELECT *, choice = 'search' AND searches % 5 = 0 AS search_fails, count(*) FILTER (choice = 'answer' AND NOT taken) OVER (PARTITION BY trajectory ORDER BY turn) AS choices, choice = 'action' AND NOT on_topic AND count(*) FILTER (choice = 'action' AND NOT on_topic) OVER (PARTITION BY trajectory, run ORDER BY turn) % 3 = 0 AS forced FROM b),
  e AS (SELECT *, choices >= 4 OR step >= 20 AS ends FROM c), f AS (SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY trajectory ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM e)
  SELECT trajectory, turn, search_fails, forced, taken, choices, round(least(1, greatest(0, CASE WHEN search_fails OR taken THEN 0 ELSE r END - 0.1)), 6)::DOUBLE AS step_reward, ends FROM f WHERE NOT gone""")
def _(spark, d):
    k = F.col("bucket") % 3
    t = turns(spark, d).select("trajectory", "turn", "choice", k.alias("aspect"), (F.col("outcome") == "progress").alias("on_topic"))
    out = environment.steps(t, "trajectory", "turn", F.lit(4), rollouts.answer_score(F.col("aspect"), F.lit(0), F.array(F.lit(0), F.lit(1))), cost=0.1)
    return out.select("trajectory", "turn", "search_fails", "forced", "taken", "choices", F.round("step_reward", 6).alias("step_reward"), "ends")


@query("x_19", """WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN 'same' ELSE c_name END AS c FROM customer WHERE c_custkey % 4 <> 0), v AS (SELECT c_custkey AS k, c_name AS c FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 9 = 0),
  s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'validation' WHEN c_custkey % 7 <> 0 THEN 'train' END AS s FROM customer)
  SELECT 'repeated_train' AS "check", count(*) - count(DISTINCT c) AS n FROM t UNION ALL SELECT 'repeated_validation', count(*) - count(DISTINCT c) FROM v UNION ALL SELECT 'misplaced_train', count(*) FILTER (s IS DISTINCT FROM 'train') FROM t JOIN s USING (k) UNION ALL SELECT 'misplaced_validation', count(*) FILTER (s IS DISTINCT FROM 'validation') FROM v JOIN s USING (k)
  UNION ALL SELECT 'missing_train', 0 UNION ALL SELECT 'missing_validation', greatest(0, 1000000 - count(*)) FROM v UNION ALL SELECT 'in_both', count(*) FROM t JOIN v USING (k)""")
def _(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("c"))
    train = c.where("k % 4 <> 0").withColumn("c", F.when(F.col("k") % 10 == 0, "same").otherwise(F.col("c")))
    placed = c.select("k", F.when(F.col("k") % 4 == 0, "validation").when(F.col("k") % 7 != 0, "train").alias("split")).where("split IS NOT NULL")
    return contracts.two_files(train, c.where("k % 4 = 0 OR k % 9 = 0"), "k", "c", placed, "split", {"train": 1, "validation": 1_000_000})


@query("io_13", """SELECT 'most_steps' AS name, '20' AS value UNION ALL SELECT 'parameters', '["choice","content","thought"]' UNION ALL SELECT 'ratios', '{"train":0.65,"validation":0.05}'""")
def _(spark, d):
    config = {"parameters": ["choice", "content", "thought"], "most_steps": 20, "ratios": {"validation": 0.05, "train": 0.65}}
    path = tables.scratch(spark, "config")
    spark.createDataFrame([(json.dumps(config, indent=1),)], "value string").coalesce(1).write.text(path)
    return tables.contract(spark, path, config)


@query("x_4")
def _(spark, d):
    t = talk(spark, d)
    k = F.col("trajectory")
    kind = F.element_at(F.array(F.lit(probes.ANSWER_PROBE), F.lit(probes.PREFERENCE_PROBE), F.lit(probes.FALLBACK_PROBE)), (k % 3 + 1).cast("int"))
    each = t.select("trajectory").distinct().withColumn("kind", kind)
    asked = each.select(k.alias("probe"), F.when(k % 5 == 0, k).alias("transcript"), "kind", F.lit("t").alias("task"), k.alias("context"), (k % 2 == 0).alias("double"), F.lit("hotel by the sea").alias("original"), F.lit("cheap hotel inland").alias("retry"))
    known = each.select("kind", F.lit("t").alias("task"), k.alias("context"), F.lit(0).alias("ord"), "trajectory", F.lit(None).cast("long").alias("at"), F.lit("hotel").alias("named"), F.lit(None).cast("string").alias("down"))
    return probes.boundaries(asked, known, t)


SESSION = "aspects array<string>, answered array<string>, complete array<string>, searched array<string>, asked array<string>, fields map<string,array<string>>, options map<string,array<string>>"


def session() -> dict:
    return dict(aspects=["hotel", "flight"], answered=[], complete=[], searched=[], asked=[], fields={"hotel": ["rating", "room", "chain"], "flight": ["time"]}, options={"hotel": ["H1", "H2"]})


#: Changes of the session: phase, aspect, field (in order, strict, canonical), options, problem.
PLANS = [
    (at(), ("elicit", "hotel", "rating", "room", "chain", None, None)), (at(asked=["hotel.room"]), ("elicit", "hotel", "rating", "chain", "chain", None, None)), (at(asked=["hotel.room", "hotel.chain"]), ("elicit", "hotel", "rating", "rating", "rating", None, None)),
    (at(asked=["hotel.room", "hotel.chain", "hotel.rating"]), (None, None, None, None, None, None, "preference_coverage_unreachable.hotel")), (at(complete=["hotel"]), ("search", "hotel", None, None, None, None, None)), (at(complete=["hotel"], searched=["hotel"]), ("answer", "hotel", None, None, None, "H1,H2", None)),
    (at(answered=["hotel"]), ("elicit", "flight", "time", "time", "time", None, None)), (at(answered=["hotel"], complete=["flight"], searched=["flight"]), (None, None, None, None, None, None, "search_no_visible_options.flight")), (at(answered=["flight", "hotel"]), (None, None, None, None, None, None, "environment_not_terminated_after_answers")),
]


@query("f_19", expected(PLANS, list, "phase, aspect, field, strict, canonical, options, problem"))
def _(spark, d):
    s = cases(spark, d, session(), PLANS, SESSION).select("o_orderkey", environment.next_plan().alias("p"), environment.next_plan(environment.STRICT).alias("s"), environment.next_plan(environment.CANONICAL).alias("c"))
    return s.select("o_orderkey", "p.phase", "p.aspect", "p.field", F.col("s.field").alias("strict"), F.col("c.field").alias("canonical"), F.array_join("p.options", ",").alias("options"), "p.problem")
