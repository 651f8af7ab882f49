"""Registered queries: admission of records and metrics of results.

The driver's tables have no tool calls, so each order is given a record: a good one with one fault, by the remainder of its
key. The SQL states what each fault must lead to.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable

from pyspark.sql import functions as F

from tracksmith.operators import records
from tracksmith.plans.bind import read
from tracksmith.plans.splits_queries import query

TOOL, SCHEMA, PREFIX, STEP, SOURCE, VERSION = "act", "trajectory-4", "prefix-1", "step-1", "target-1", "reward-3"


def call(number: int, choice: str = "search", content: str = "rooms", reply: str = "ok", **fields) -> list[dict]:
    arguments = fields.pop("arguments", json.dumps({"thought": "t", "choice": choice, "content": content}))
    own = {"id": f"c{number}", "type": "function", "function": {"name": TOOL, "arguments": arguments}}
    return [{"role": "assistant", "content": "", "tool_calls": [own], **fields}, {"role": "tool", "name": TOOL, "tool_call_id": f"c{number}", "content": reply}]


def messages() -> list[dict]:
    return [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, *call(0, "action", "which stars"), *call(1)]


def reward() -> dict:
    own = dict(reward_version=VERSION, reward_valid=True, terminal_reward=0.9, completion_rate=1.0, correct_itinerary=True, gold_itinerary=True, fully_grounded=True, active_preference_coverage=0.5, passive_preference_coverage=0.25, policy_penalty=0.0, infrastructure_errors=[])
    return own | {k: 0 for k in records.COUNTERS}


def record() -> dict:
    own = dict(schema_version=SCHEMA, task_id="t", composition="22", difficulty="d", source_split="train", teacher_model="a", simulator_model="b", messages=messages(), terminated=True, truncated=False, expected_aspects=["hotel", "flight"], answered_aspects=["flight", "hotel"], simulator_fallbacks=0, simulator_judgment_fallbacks=0, simulator_search_fallbacks=0, generation_diagnostics=[])
    return own | reward() | {"reward_breakdown": reward() | {"raw_terminal_reward": 0.9}}


def put(path: str, value) -> Callable[[dict], None]:
    """Set a value at a path of keys and places."""
    def run(r: dict) -> None:
        *way, last = [int(k) if k.lstrip("-").isdigit() else k for k in path.split(".")]
        for k in way:
            r = r[k]
        r[last] = value

    return run


def both(field: str, value) -> list[Callable]:
    """Of record and reward alike."""
    return [put(field, value), put(f"reward_breakdown.{field}", value)]


def made(base: dict, faults: list) -> list[dict]:
    out = []
    for fault, _ in faults:
        one = copy.deepcopy(base)
        for change in fault if isinstance(fault, list) else [fault]:
            change(one)
        out.append(one)
    return out


def nothing(r: dict) -> None:
    """No fault."""


def drop(r: dict) -> None:
    r["messages"].pop()


#: Fault of the messages, reasons.
MESSAGE_FAULTS = [
    (nothing, ""), (put("messages", None), "invalid_messages"), (put("messages", messages()[:3]), "invalid_messages"), (put("messages.0.role", "user"), "invalid_message_prefix"), (drop, "unpaired_assistant_tool_messages"),
    (put("messages.2.role", "user"), "invalid_assistant_message"), (put("messages.2.content", "text"), "assistant_content_must_be_empty"), (put("messages.2.tool_calls", []), "assistant_must_contain_one_tool_call"),
    (put("messages.2.tool_calls.0.type", "code"), "wrong_tool_call_type"), ([put("messages.2.tool_calls.0.id", "c1"), put("messages.3.tool_call_id", "c1")], "invalid_or_duplicate_tool_call_id"), (put("messages.2.tool_calls.0.id", ""), "invalid_or_duplicate_tool_call_id,tool_call_id_mismatch"),
    (put("messages.2.tool_calls.0.function.name", "other"), "wrong_function_name"), (put("messages.2.tool_calls.0.function.arguments", "{"), "invalid_tool_arguments_json"), (put("messages.2.tool_calls.0.function.arguments", "[1]"), "invalid_tool_arguments_json"),
    (put("messages.2.tool_calls.0.function.arguments", '{"thought":"t","choice":"search"}'), "invalid_tool_arguments"), (put("messages.3.role", "user"), "invalid_tool_message"), (put("messages.3.tool_call_id", "c9"), "tool_call_id_mismatch"), (put("messages.3.name", "other"), "wrong_tool_message_name"),
    (put("messages.3.content", None), "invalid_tool_message_content"), (put("messages.3.content", "This is too vague and general."), "vague_action_feedback"), (put("messages.5.content", "You already recommended an option"), "duplicate_recommendation_feedback"), (put("messages.5.content", "Invalid option ID format"), "invalid_option_id_feedback"),
]
#: Fault of the record, gold reasons.
GOLD_FAULTS = [
    *MESSAGE_FAULTS, (put("schema_version", "old"), "legacy_or_unknown_schema"), *[(put(f, " "), f"missing_{f}") for f in ("task_id", "composition", "difficulty", "teacher_model", "simulator_model")], (put("source_split", None), "missing_source_split,not_official_train"), (put("source_split", "test"), "not_official_train"),
    (put("terminated", False), "not_terminated"), (put("truncated", None), "truncated"), (put("reward_breakdown", None), "missing_reward_evidence"), (both("reward_version", "old"), "wrong_reward_version"), (put("reward_breakdown.reward_version", "old"), "reward_mismatch_reward_version,wrong_reward_version"), (both("reward_valid", False), "reward_invalid"),
    (both("completion_rate", 0.5), "incomplete_reward_completion"), (both("correct_itinerary", False), "incorrect_itinerary"), (both("policy_penalty", 0.1), "policy_penalty"), (both("terminal_reward", None), "invalid_terminal_reward"), (both("terminal_reward", 0.6), "terminal_reward_below_threshold"), (put("terminal_reward", 0.8), "reward_mismatch_terminal_reward"),
    *[(both(f, 1), f) for f in records.COUNTERS], (put("exact_repeats", 2), "exact_repeats,reward_mismatch_exact_repeats"), (put("reward_breakdown.wrong_answers", None), "reward_mismatch_wrong_answers"), (both("gold_itinerary", None), "invalid_gold_itinerary"), (both("fully_grounded", None), "invalid_fully_grounded"),
    (both("active_preference_coverage", 1.5), "invalid_active_preference_coverage"), (both("passive_preference_coverage", None), "invalid_passive_preference_coverage"), (both("infrastructure_errors", None), "invalid_infrastructure_errors"), (both("infrastructure_errors", ["x"]), "infrastructure_error"), (put("answered_aspects", ["hotel"]), "incomplete_aspect_answers"),
]
MASK = put("messages.2.loss_mask", True)
MARK = put("generation_diagnostics", [{"reason": "search_repair_allowed"}])
JUDGED = put("simulator_judgment_fallbacks", 1)
#: Faults, tier, reasons against admission as gold or silver.
TIER_FAULTS = [
    ([nothing], ("gold", "")), ([MASK], ("silver", "")), ([MARK], ("silver", "")), (both("terminal_reward", 0.5), (None, "invalid_silver_admission")), ([MASK, *both("terminal_reward", 0.5)], ("silver", "")), ([MARK, put("messages.3.content", "too vague and general")], ("silver", "")), ([MASK, *both("reward_valid", False)], ("silver", "")),
    ([MASK, JUDGED, *both("reward_valid", False)], ("silver", "")), ([MARK, JUDGED, *both("reward_valid", False)], ("silver", "unmasked_silver_judgment_fallback")), ([MASK, put("simulator_judgment_fallbacks", 2), *both("reward_valid", False)], (None, "invalid_silver_admission")), ([MASK, put("simulator_search_fallbacks", 1), *both("reward_valid", False)], (None, "invalid_silver_admission")),
    ([MASK, *both("reward_valid", False), put("reward_breakdown.raw_terminal_reward", 0.3)], (None, "invalid_silver_admission")), ([MASK, *both("wrong_answers", 1)], (None, "wrong_answers")), ([MASK, *both("completion_rate", 0.5)], (None, "incomplete_reward_completion")), ([MASK, put("truncated", True)], (None, "truncated")), ([MASK, *both("infrastructure_errors", ["x"])], ("silver", "")),
]


def prefix() -> dict:
    kept = [{"choice": "action", "aspect": "hotel", "reward": 0.2}, {"choice": "search", "aspect": "hotel", "reward": 0.2}]
    return dict(schema_version=PREFIX, task_id="t", composition="22", source_split="train", messages=messages(), prefix_action_count=2, retained_action_evidence=kept, source_failure_reasons=["environment.wrong_answer: H3"], failed_answer={"aspect": "hotel", "content": "H3", "environment_turn": 3})


PREFIX_SCHEMA = "schema_version string, task_id string, composition string, source_split string, messages " + records.MESSAGES + ", prefix_action_count bigint, retained_action_evidence array<struct<choice:string,aspect:string,reward:double>>, source_failure_reasons array<string>, failed_answer struct<aspect:string,content:string,environment_turn:bigint>"
ANSWERED = [put("messages", [*messages()[:4], *call(1, "answer", "H3")]), put("retained_action_evidence.1.choice", "answer")]
PREFIX_FAULTS = [
    (nothing, ""), (put("schema_version", None), "legacy_or_unknown_prefix_schema"), (put("task_id", ""), "missing_task_id"), (put("source_split", "test"), "not_official_train"), (put("messages.4.loss_mask", True), "prefix_contains_loss_masked_action"), (put("prefix_action_count", 3), "prefix_action_count_mismatch"), (ANSWERED, "prefix_does_not_end_after_successful_search"),
    (put("retained_action_evidence", None), "invalid_retained_action_evidence,prefix_search_aspect_mismatch"), (put("retained_action_evidence.0.reward", 0.0), "nonpositive_retained_action"), (put("retained_action_evidence.0.choice", "search"), "retained_action_evidence_mismatch"), (put("source_failure_reasons", ["other"]), "invalid_prefix_source_failure"), (put("source_failure_reasons", []), "invalid_prefix_source_failure"),
    (put("failed_answer", None), "missing_removed_failed_answer"), (put("failed_answer.aspect", "flight"), "prefix_search_aspect_mismatch"), (put("failed_answer.content", ""), "invalid_removed_failed_answer_content"), (put("failed_answer.environment_turn", 0), "invalid_removed_failed_answer_turn"), (put("messages.3.name", "other"), "wrong_tool_message_name"),
]


def step() -> dict:
    m = messages()[:-1]
    m[2]["loss_mask"] = True
    return dict(schema_version=STEP, source_schema_version=SOURCE, task_id="t", composition="22", boundary_type="b", project_split="train", policy_version="1", actor_policy_version="1", target_status="accepted", has_state=True, has_target=True, messages=m)


STEP_SCHEMA = "schema_version string, source_schema_version string, task_id string, composition string, boundary_type string, project_split string, policy_version string, actor_policy_version string, target_status string, has_state boolean, has_target boolean, messages " + records.MESSAGES
STEP_FAULTS = [
    (nothing, ""), (put("schema_version", "x"), "legacy_or_unknown_recovery_schema"), (put("source_schema_version", "x"), "wrong_recovery_source_schema"), (put("policy_version", ""), "missing_policy_version"), (put("project_split", "evaluation"), "evaluation_record_not_trainable"), (put("target_status", "rejected"), "target_not_accepted"), (put("has_state", False), "missing_public_state"),
    (put("has_target", None), "missing_target_assistant"), (put("messages", None), "invalid_messages"), (put("messages.0.role", "user"), "invalid_message_prefix"), (put("messages.4.role", "user"), "recovery_target_must_be_final_assistant"), (put("messages.2.loss_mask", None), "historical_assistant_must_be_loss_masked,recovery_requires_one_unmasked_assistant"),
    (put("messages.4.loss_mask", True), "recovery_requires_one_unmasked_assistant,target_assistant_must_not_be_loss_masked"), (put("messages.3.content", "too vague and general"), ""), (put("messages.3.tool_call_id", "c8"), "tool_call_id_mismatch"),
]


def cases(spark, d, base: dict, faults: list, schema: str):
    """orders, each with the record of its key's remainder."""
    table = spark.createDataFrame([dict(one, case=k) for k, one in enumerate(made(base, faults))], schema + ", case bigint")  # as many rows as faults
    return read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % len(faults)).alias("case")).join(F.broadcast(table), "case")


def expected(faults: list, what: Callable = lambda x: [x], names: str = "rejections") -> str:
    literal = lambda x: "NULL" if x is None else f"'{x}'"
    values = ", ".join(f"({k}, {', '.join(literal(x) for x in what(reasons))})" for k, (_, reasons) in enumerate(faults))
    return f"SELECT o_orderkey, {names} FROM orders JOIN (VALUES {values}) v(k, {names}) ON o_orderkey % {len(faults)} = k"


def joined(x):
    return F.array_join(x, ",")


@query("v_6", expected(MESSAGE_FAULTS))
def _(spark, d):
    return cases(spark, d, record(), MESSAGE_FAULTS, records.RECORD).select("o_orderkey", joined(records.message_reasons(F.col("messages"), TOOL)).alias("rejections"))


@query("v_7", expected(GOLD_FAULTS))
def _(spark, d):
    return cases(spark, d, record(), GOLD_FAULTS, records.RECORD).select("o_orderkey", joined(records.gold_reasons(TOOL, SCHEMA, [VERSION])).alias("rejections"))


@query("v_8", expected(TIER_FAULTS, lambda x: [x[0]], "tier"))
def _(spark, d):
    return cases(spark, d, record(), TIER_FAULTS, records.RECORD).select("o_orderkey", records.tier(records.attempt_reasons([VERSION])).alias("tier"))


@query("v_9", expected(TIER_FAULTS, lambda x: [x[1]]))
def _(spark, d):
    gold, attempt = records.gold_reasons(TOOL, SCHEMA, [VERSION]), records.attempt_reasons([VERSION])
    return cases(spark, d, record(), TIER_FAULTS, records.RECORD).select("o_orderkey", joined(records.admission_reasons(gold, attempt, ("gold", "silver"))).alias("rejections"))


@query("v_10", expected(PREFIX_FAULTS))
def _(spark, d):
    return cases(spark, d, prefix(), PREFIX_FAULTS, PREFIX_SCHEMA).select("o_orderkey", joined(records.prefix_reasons(TOOL, PREFIX)).alias("rejections"))


@query("v_10_recovery", expected(STEP_FAULTS))
def _(spark, d):
    return cases(spark, d, step(), STEP_FAULTS, STEP_SCHEMA).select("o_orderkey", joined(records.recovery_reasons(TOOL, STEP, SOURCE)).alias("rejections"))


@query("m_11", """WITH r AS (SELECT o_orderkey AS k, o_totalprice / 1000000 AS x, CASE o_orderkey % 3 WHEN 0 THEN [1.0, 0.8, 0.0] WHEN 1 THEN [0.8] ELSE [] END AS q FROM orders WHERE o_orderkey % 5 <> 4),
  m AS (SELECT *, CASE WHEN len(q) > 0 THEN list_sum(q) / len(q) ELSE 0 END::DOUBLE AS mean FROM r)
  SELECT k AS o_orderkey, round(mean, 6) AS micro_avg, coalesce(list_max(q), 0)::DOUBLE AS micro_max, len(list_filter(q, lambda v: v = 1.0))::DOUBLE AS number_of_1, len(list_filter(q, lambda v: v = 0.8))::DOUBLE AS number_of_08, round(x, 6) AS terminal_reward, (k % 2)::DOUBLE AS gold_itinerary, 0.0::DOUBLE AS correct_itinerary, 0.0::DOUBLE AS user_aligned_success,
  0.5::DOUBLE AS completion, CASE WHEN k % 2 = 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS answer_submission_rate, 0.25::DOUBLE AS active_coverage, 0.0::DOUBLE AS passive_coverage, 0.0::DOUBLE AS efficiency, 0.0::DOUBLE AS policy_penalty, (k % 20)::DOUBLE AS actor_attempts, 0.0::DOUBLE AS environment_steps, (k % 4)::DOUBLE AS invalid_actions, 0.0::DOUBLE AS exact_repeats, 0.0::DOUBLE AS semantic_repeats,
  round(CASE WHEN k % 7 = 0 THEN 0.125 ELSE mean END, 6)::DOUBLE AS answer_quality, 0.25::DOUBLE AS preference_coverage, CASE WHEN k % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS phase_transition_score, 0.0::DOUBLE AS guard_rejection_rate, 0.0::DOUBLE AS blocked_aspects FROM m""")
def _(spark, d):
    k = "o_orderkey"
    given = {
        "terminal_reward": "o_totalprice / 1000000", "quality_by_aspect": f"CASE {k} % 3 WHEN 0 THEN map('a', 1.0D, 'b', 0.8D, 'c', 0.0D) WHEN 1 THEN map('a', 0.8D) END", "gold_itinerary": f"{k} % 2 = 1", "completion_rate": "0.5D", "answer_submission_rate": f"if({k} % 2 = 0, 0.75D, null)",
        "active_preference_coverage": "0.25D", "invalid_actions": f"{k} % 4", "answer_quality": f"if({k} % 7 = 0, 0.125D, null)", "phase_transition_score": f"if({k} % 2 = 0, 0.5D, null)",
    }
    kind = records.RESULT.split("reward struct<")[1][:-1]
    fields = [f.split(":", 1) for f in kind.replace("map<string,double>", "map<string;double>").split(",")]
    reward_row = F.struct(*[F.expr(given.get(name, "null")).cast(t.replace(";", ",")).alias(name) for name, t in fields])
    o = read(spark, d, "orders").select(k, (F.col(k) % 5 != 4).alias("infrastructure_valid"), (F.col(k) % 20).alias("actor_attempts"), F.lit(None).cast("long").alias("environment_steps"), reward_row.alias("reward"))
    made_metrics = o.select(k, records.result_metrics().alias("m")).where("m IS NOT NULL")
    return made_metrics.select(k, *[F.round(f"m.{name}", 6).alias(name) for name in records.METRICS])
