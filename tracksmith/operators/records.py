"""Admission of recorded trajectories: message contract, gold gate, tiers, prefix and recovery gates.

All are column expressions over one record a row (schemas MESSAGES and RECORD); each gives the sorted names of all reasons
against a record. Names that a project chooses itself (tool, schema and reward versions) are parameters. A value of a wrong
type is a null in a typed record and counts as one that is missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracksmith.functions.expr import is_true, let
from tracksmith.operators import transcripts

MESSAGES = "array<struct<role:string,content:string,name:string,tool_call_id:string,loss_mask:boolean,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>>"
# What must not occur in a trajectory, what record and reward must agree in, ranges.
COUNTERS = ("invalid_actions", "exact_repeats", "semantic_repeats", "ambiguous_actions", "unsearched_answers", "wrong_answers")
AGREED = ("reward_version", "reward_valid", "terminal_reward", "completion_rate", "correct_itinerary", "gold_itinerary", "fully_grounded", "active_preference_coverage", "passive_preference_coverage", "policy_penalty", "infrastructure_errors")
SHARES = ("active_preference_coverage", "passive_preference_coverage")
FLOOR = 0.7
# Phrases of an environment that refuses a call, and the reasons they stand for.
REFUSALS = {"too vague and general": "vague_action_feedback", "already recommended an option": "duplicate_recommendation_feedback", "Invalid option ID format": "invalid_option_id_feedback"}
# Reasons of a collected attempt and of a stored record that a silver one may have; marks of a repair.
SILVER_ATTEMPT = ("vague_action_feedback", "simulator_judgment_fallback", "reward_invalid", "terminal_reward_below_threshold", "infrastructure_error")
SILVER_RECORD = ("vague_action_feedback", "reward_invalid", "terminal_reward_below_threshold", "infrastructure_error")
REPAIRS = ("search_repair_allowed", "vague_action_repair_allowed", "judgment_fallback_allowed", "loss_masked_repair")
# How the reasons of a failed last answer begin.
FAILED_ANSWER = ("environment.wrong_answer", "environment.answer_not_recorded", "environment.answer_not_matching_public_requirement")

_NONE = "array<string>"


def _names(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that hold; a null check holds, as what is missing is no evidence."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for c, name in checks])).cast(_NONE)


def _sorted(*parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def _not_in(x: Column, low: float, high: float) -> Column:
    return x.isNull() | F.isnan(x.cast("double")) | ~x.between(low, high)


def _pairs(messages: Column, body) -> Column:
    """body(pair) of each (assistant `a`, tool `t`) of the messages after the first two."""
    rest = F.slice(messages, F.lit(3), F.greatest(F.size(messages) - 2, F.lit(0)))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return let(rest, lambda m: F.transform(F.transform(numbers(F.floor(F.size(m) / 2).cast("int")), lambda i: F.struct(F.get(m, 2 * i).alias("a"), F.get(m, 2 * i + 1).alias("t"))), body))


def refusals(content: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(content, F.lit(phrase)), F.lit(name)) for phrase, name in REFUSALS.items()])).cast(_NONE)


def _pair(pair: Column, tool: str) -> Column:
    """Reasons of one call and its reply."""
    assistant, reply = pair["a"], pair["t"]
    own = _names((F.coalesce(assistant["content"], F.lit("")) != "", "assistant_content_must_be_empty"))

    def called(x: Column) -> Column:
        call, parts = x["call"], x["parts"]
        named = F.coalesce(call["function"]["name"] == tool, F.lit(False))
        checks = _names(
            (F.coalesce(call["type"], F.lit("")) != "function", "wrong_tool_call_type"), (F.coalesce(call["id"], F.lit("")) == "", "invalid_or_duplicate_tool_call_id"), (~named, "wrong_function_name"),
            (named & ~parts["is_object"], "invalid_tool_arguments_json"), (named & parts["is_object"] & parts["error"].isNotNull(), "invalid_tool_arguments"),
        )
        replied = F.when(F.coalesce(reply["role"], F.lit("")) != "tool", "invalid_tool_message").when(~reply["tool_call_id"].eqNullSafe(call["id"]), "tool_call_id_mismatch").when(F.coalesce(reply["name"], F.lit("")) != tool, "wrong_tool_message_name").when(reply["content"].isNull(), "invalid_tool_message_content")
        return F.concat(checks, F.array_compact(F.array(replied)), refusals(F.coalesce(reply["content"], F.lit(""))))

    call = F.get(assistant["tool_calls"], 0)
    one = F.when(F.coalesce(F.size(assistant["tool_calls"]) == 1, F.lit(False)), let(F.struct(call.alias("call"), transcripts.call_parts(call["function"]["arguments"]).alias("parts")), called))
    whole = F.concat(own, F.coalesce(one, F.array(F.lit("assistant_must_contain_one_tool_call"))))
    return F.when(F.coalesce(assistant["role"], F.lit("")) != "assistant", F.array(F.lit("invalid_assistant_message"))).otherwise(whole)


def message_reasons(messages: Column, tool: str) -> Column:
    """Against the message contract: system and user, then pairs of an assistant with one call of the tool and its reply."""
    found = F.flatten(_pairs(messages, lambda p: _pair(p, tool)))
    ids = F.filter(_pairs(messages, lambda p: F.when((p["a"]["role"] == "assistant") & (F.size(p["a"]["tool_calls"]) == 1), F.get(p["a"]["tool_calls"], 0)["id"])), lambda x: F.coalesce(x, F.lit("")) != "")
    repeated = let(ids, lambda x: F.size(x) != F.size(F.array_distinct(x)))
    first = F.transform(F.slice(messages, 1, 2), lambda x: x["role"])
    whole = _names(
        (~first.eqNullSafe(F.array(F.lit("system"), F.lit("user"))), "invalid_message_prefix"), (F.size(messages) % 2 == 1, "unpaired_assistant_tool_messages"),
        (repeated, "invalid_or_duplicate_tool_call_id"),
    )
    return F.when(messages.isNull() | (F.size(messages) < 4), F.array(F.lit("invalid_messages"))).otherwise(_sorted(whole, found))


def gold_reasons(tool: str, schema: str, versions: list[str], official: str = "train", floor: float = FLOOR) -> Column:
    """Every reason against a record (columns of RECORD) that is to be gold."""
    c, r = F.col, F.col("reward_breakdown")
    texts = ("task_id", "composition", "difficulty", "source_split", "teacher_model", "simulator_model")
    own = _names(
        (~c("schema_version").eqNullSafe(F.lit(schema)), "legacy_or_unknown_schema"), *[(_blank(c(f)), f"missing_{f}") for f in texts], (~is_true(c("terminated")), "not_terminated"),
        (~c("truncated").eqNullSafe(F.lit(False)), "truncated"), (~c("source_split").eqNullSafe(F.lit(official)), "not_official_train"),
        (F.size(F.array_except("expected_aspects", "answered_aspects")) + F.size(F.array_except("answered_aspects", "expected_aspects")) != 0, "incomplete_aspect_answers"),
    )
    known = lambda x: F.coalesce(x.isin(*versions), F.lit(False))
    number = lambda x, wanted: x.isNull() | (x != wanted)
    terminal = c("terminal_reward")
    bad = terminal.isNull() | F.isnan(terminal) | (F.abs(terminal) == float("inf"))
    rewarded = _names(
        (~(known(c("reward_version")) & known(r["reward_version"])), "wrong_reward_version"), (~(is_true(c("reward_valid")) & is_true(r["reward_valid"])), "reward_invalid"),
        (number(c("completion_rate"), 1.0), "incomplete_reward_completion"), (~is_true(c("correct_itinerary")), "incorrect_itinerary"), (number(c("policy_penalty"), 0.0), "policy_penalty"),
        (bad, "invalid_terminal_reward"), (~bad & (terminal < floor), "terminal_reward_below_threshold"),
        *[(number(c(f), 0), f) for f in COUNTERS], *[(r[f].isNull() | ~r[f].eqNullSafe(c(f)), f"reward_mismatch_{f}") for f in COUNTERS], *[(~r[f].eqNullSafe(c(f)), f"reward_mismatch_{f}") for f in AGREED],
        *[(c(f).isNull(), f"invalid_{f}") for f in ("gold_itinerary", "fully_grounded")], *[(_not_in(c(f), 0.0, 1.0), f"invalid_{f}") for f in SHARES],
        (c("infrastructure_errors").isNull(), "invalid_infrastructure_errors"), (F.coalesce(F.size("infrastructure_errors") > 0, F.lit(False)), "infrastructure_error"),
    )
    return _sorted(own, message_reasons(c("messages"), tool), F.when(r.isNull(), F.array(F.lit("missing_reward_evidence"))).otherwise(rewarded))


def attempt_reasons(versions: list[str], floor: float = FLOOR) -> Column:
    """Every reason against a collected attempt, before it is stored."""
    c, r, m = F.col, F.col("reward_breakdown"), F.coalesce("messages", F.array().cast(MESSAGES))
    one = lambda a: F.coalesce(F.size(a["tool_calls"]) == 1, F.lit(False)) & (a["role"] == "assistant")
    pair = lambda a, t: F.when(~one(a), "assistant_must_contain_one_tool_call").when((t["role"] != "tool") | ~t["tool_call_id"].eqNullSafe(F.get(a["tool_calls"], 0)["id"]), "tool_call_id_mismatch")
    first = F.transform(F.slice(m, 1, 2), lambda x: x["role"])
    contract = F.when((F.size(m) < 4) | ~first.eqNullSafe(F.array(F.lit("system"), F.lit("user"))), F.array(F.lit("invalid_message_prefix"))).otherwise(F.concat(_names((F.size(m) % 2 == 1, "unpaired_assistant_tool_messages")), F.array_compact(_pairs(m, lambda p: pair(p["a"], p["t"])))))
    said = F.flatten(F.transform(F.filter(m, lambda x: x["role"] == "tool"), lambda x: refusals(F.coalesce(x["content"], F.lit("")))))
    own = _names(
        (~is_true(c("terminated")), "not_terminated"), (is_true(c("truncated")), "truncated"),
        (F.size(F.array_except("expected_aspects", "answered_aspects")) + F.size(F.array_except("answered_aspects", "expected_aspects")) != 0, "incomplete_aspect_answers"),
        *[(F.coalesce(c(f"{name}s"), F.lit(0)) > 0, name) for name in ("simulator_fallback", "simulator_judgment_fallback", "simulator_search_fallback")],
    )
    terminal = r["terminal_reward"]
    rewarded = _names(
        (~F.coalesce(r["reward_version"].isin(*versions), F.lit(False)), "wrong_reward_version"), (~is_true(r["reward_valid"]), "reward_invalid"), (~r["completion_rate"].eqNullSafe(F.lit(1.0)), "incomplete_reward_completion"),
        (~is_true(r["correct_itinerary"]), "incorrect_itinerary"), (~r["policy_penalty"].eqNullSafe(F.lit(0.0)), "policy_penalty"), (terminal.isNull() | F.isnan(terminal) | (terminal < floor), "terminal_reward_below_threshold"),
        *[(F.coalesce(r[f], F.lit(0)) != 0, f) for f in COUNTERS], (F.coalesce(F.size(r["infrastructure_errors"]) > 0, F.lit(False)), "infrastructure_error"),
    )
    return _sorted(own, contract, said, F.when(r.isNull(), F.array(F.lit("missing_reward_evidence"))).otherwise(rewarded))


def tier(reasons: Column, floor: float = FLOOR) -> Column:
    """gold, silver or null of an attempt with these attempt_reasons().

    No reason is gold, or silver with the mark of a repair. With one, only the allowed reasons, at most one fallback of the
    judge, full completion, no counted fault and a raw terminal reward of the floor are silver.
    """
    c, r = F.col, F.col("reward_breakdown")
    masked = F.exists(F.coalesce("messages", F.array().cast(MESSAGES)), lambda m: (m["role"] == "assistant") & is_true(m["loss_mask"]))
    marks = F.transform(F.coalesce(c("generation_diagnostics"), F.array().cast("array<struct<reason:string>>")), lambda d: d["reason"])
    marked = F.exists(marks, lambda x: F.coalesce(x.isin(*REPAIRS), F.lit(False))) | masked
    zero = lambda x: F.coalesce(x, F.lit(0)) == 0
    whole = r["completion_rate"].eqNullSafe(F.lit(1.0)) & is_true(r["correct_itinerary"]) & r["policy_penalty"].eqNullSafe(F.lit(0.0))
    for f in COUNTERS:
        whole = whole & zero(r[f])
    raw = F.coalesce(r["raw_terminal_reward"], F.lit(float("-inf")))
    silver = marked & (F.size(F.array_except(reasons, F.array(*[F.lit(x) for x in SILVER_ATTEMPT]))) == 0) & zero(c("simulator_fallbacks")) & zero(c("simulator_search_fallbacks")) & (F.coalesce(c("simulator_judgment_fallbacks"), F.lit(0)) <= 1) & whole & ~F.isnan(raw) & (raw >= floor)
    return F.when(F.size(reasons) == 0, F.when(marked, "silver").otherwise("gold")).when(silver, "silver")


def admission_reasons(gold: Column, attempt: Column, accepted: tuple[str, ...] = ("gold",)) -> Column:
    """Against admitting a stored record, whatever tier it says it has: judged anew from gold_reasons() and attempt_reasons()."""
    one = lambda name: F.array(F.lit(name))
    allowed = lambda name: F.array().cast(_NONE) if name in accepted else one("quality_tier_not_accepted")
    structural = F.array_except(gold, F.array(*[F.lit(x) for x in SILVER_RECORD]))
    masked = F.size(F.filter(F.coalesce("messages", F.array().cast(MESSAGES)), lambda m: (m["role"] == "assistant") & is_true(m["loss_mask"])))
    return (
        F.when(F.size(gold) == 0, allowed("gold")).when(F.size(structural) > 0, F.array_sort(structural)).when(~tier(attempt).eqNullSafe(F.lit("silver")), one("invalid_silver_admission"))
        .when(F.coalesce(F.col("simulator_judgment_fallbacks"), F.lit(0)) > masked, one("unmasked_silver_judgment_fallback")).otherwise(allowed("silver"))
    )


def prefix_reasons(tool: str, schema: str, official: str = "train") -> Column:
    """Against a prefix of a failed attempt: kept actions with positive evidence up to the search before the wrong answer.

    Columns: schema_version, task_id, composition, source_split, messages, prefix_action_count, retained_action_evidence
    array<struct<choice, aspect, reward>>, source_failure_reasons, failed_answer struct<aspect, content, environment_turn>.
    """
    c, m = F.col, F.coalesce("messages", F.array().cast(MESSAGES))
    assistants = F.filter(m, lambda x: x["role"] == "assistant")
    choice = lambda a: F.when(F.size(a["tool_calls"]) == 1, F.get_json_object(F.get(a["tool_calls"], 0)["function"]["arguments"], "$.choice"))
    choices = F.transform(assistants, choice)
    n = F.size(assistants)
    evidence = F.coalesce(c("retained_action_evidence"), F.array().cast("array<struct<choice:string,aspect:string,reward:double>>"))
    paired = (F.size(evidence) == n) & c("retained_action_evidence").isNotNull()
    places = F.when(F.size(evidence) > 0, F.sequence(F.lit(0), F.size(evidence) - 1)).otherwise(F.array().cast("array<int>"))
    unpaid = F.exists(evidence, lambda e: e["reward"].isNull() | F.isnan(e["reward"]) | (e["reward"] <= 0) | (e["reward"] == float("inf")))
    other = F.exists(places, lambda i: ~F.get(evidence, i)["choice"].eqNullSafe(F.get(choices, i)))
    begins = lambda x: F.coalesce(F.greatest(*[x.startswith(p) for p in FAILED_ANSWER]), F.lit(False))
    why, answer = c("source_failure_reasons"), c("failed_answer")
    last = F.try_element_at(evidence, F.lit(-1))["aspect"]
    own = _names(
        (~c("schema_version").eqNullSafe(F.lit(schema)), "legacy_or_unknown_prefix_schema"), *[(_blank(c(f)), f"missing_{f}") for f in ("task_id", "composition", "source_split")], (~c("source_split").eqNullSafe(F.lit(official)), "not_official_train"),
        (F.exists(assistants, lambda a: is_true(a["loss_mask"])), "prefix_contains_loss_masked_action"), (c("prefix_action_count").isNull() | (c("prefix_action_count") <= 0) | (c("prefix_action_count") != n), "prefix_action_count_mismatch"),
        (~F.try_element_at(choices, F.lit(-1)).eqNullSafe(F.lit("search")), "prefix_does_not_end_after_successful_search"),
        (~paired, "invalid_retained_action_evidence"), (paired & unpaid, "nonpositive_retained_action"), (paired & other, "retained_action_evidence_mismatch"),
        (why.isNull() | (F.size(why) <= 0) | F.exists(why, lambda x: ~begins(x)), "invalid_prefix_source_failure"), (answer.isNull(), "missing_removed_failed_answer"),
        (answer.isNotNull() & (F.coalesce(answer["aspect"], F.lit("")) == ""), "invalid_removed_failed_answer_aspect"), (answer.isNotNull() & (F.coalesce(answer["content"], F.lit("")) == ""), "invalid_removed_failed_answer_content"),
        (answer.isNotNull() & (F.coalesce(answer["environment_turn"], F.lit(0)) <= 0), "invalid_removed_failed_answer_turn"),
        (answer.isNotNull() & (~paired | (F.size(evidence) == 0) | ~last.eqNullSafe(answer["aspect"])), "prefix_search_aspect_mismatch"),
    )
    return _sorted(own, message_reasons(m, tool))


def recovery_reasons(tool: str, schema: str, source_schema: str) -> Column:
    """Against a record of one recovery step: a masked history, and the target as the last and only unmasked assistant.

    Columns: schema_version, source_schema_version, task_id, composition, boundary_type, project_split, policy_version,
    actor_policy_version, target_status, has_state, has_target (booleans), messages. Refusals in the history are no reason.
    """
    c, m = F.col, F.coalesce("messages", F.array().cast(MESSAGES))
    texts = ("task_id", "composition", "boundary_type", "project_split", "policy_version", "actor_policy_version")
    own = _names(
        (~c("schema_version").eqNullSafe(F.lit(schema)), "legacy_or_unknown_recovery_schema"), (~c("source_schema_version").eqNullSafe(F.lit(source_schema)), "wrong_recovery_source_schema"), *[(_blank(c(f)), f"missing_{f}") for f in texts],
        (c("project_split").eqNullSafe(F.lit("evaluation")), "evaluation_record_not_trainable"), (~c("target_status").eqNullSafe(F.lit("accepted")), "target_not_accepted"), (~is_true(c("has_state")), "missing_public_state"), (~is_true(c("has_target")), "missing_target_assistant"),
    )
    first = F.transform(F.slice(m, 1, 2), lambda x: x["role"])
    prefix = _names((~first.eqNullSafe(F.array(F.lit("system"), F.lit("user"))), "invalid_message_prefix"))
    last = F.try_element_at(m, F.lit(-1))
    assistants = F.filter(m, lambda x: x["role"] == "assistant")
    history = F.slice(assistants, F.lit(1), F.greatest(F.size(assistants) - 1, F.lit(0)))
    masks = _names(
        (F.exists(history, lambda x: ~is_true(x["loss_mask"])), "historical_assistant_must_be_loss_masked"), (is_true(last["loss_mask"]), "target_assistant_must_not_be_loss_masked"),
        (F.size(F.filter(assistants, lambda x: ~is_true(x["loss_mask"]))) != 1, "recovery_requires_one_unmasked_assistant"),
    )
    called = F.when(F.size(last["tool_calls"]) == 1, F.get(last["tool_calls"], 0)["id"])
    reply = F.struct(F.lit("tool").alias("role"), F.lit("").alias("content"), F.lit(tool).alias("name"), called.alias("tool_call_id"), F.lit(None).cast("boolean").alias("loss_mask"), F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"))
    structural = F.array_except(message_reasons(F.array_append(m, reply), tool), F.array(*[F.lit(x) for x in REFUSALS.values()]))
    ended = F.when(~last["role"].eqNullSafe(F.lit("assistant")), F.concat(prefix, F.array(F.lit("recovery_target_must_be_final_assistant")))).otherwise(F.concat(prefix, masks, structural))
    return _sorted(own, F.when(m.isNull() | (F.size(m) < 3), F.array(F.lit("invalid_messages"))).otherwise(ended))


_REWARD = "reward_version string, reward_valid boolean, terminal_reward double, completion_rate double, correct_itinerary boolean, gold_itinerary boolean, fully_grounded boolean, active_preference_coverage double, passive_preference_coverage double, policy_penalty double, infrastructure_errors array<string>, " + ", ".join(f"{k} bigint" for k in COUNTERS)
RECORD = (
    "schema_version string, task_id string, composition string, difficulty string, source_split string, teacher_model string, simulator_model string, messages " + MESSAGES + ", terminated boolean, truncated boolean, expected_aspects array<string>, answered_aspects array<string>, "
    "simulator_fallbacks bigint, simulator_judgment_fallbacks bigint, simulator_search_fallbacks bigint, generation_diagnostics array<struct<reason:string>>, " + _REWARD + ", reward_breakdown struct<" + ",".join(":".join(f.split()) for f in (_REWARD + ", raw_terminal_reward double").split(", ")) + ">"
)

# Metrics of a result, in order, and what a missing one counts.
METRICS = ("micro_avg", "micro_max", "number_of_1", "number_of_08", "terminal_reward", "gold_itinerary", "correct_itinerary", "user_aligned_success", "completion", "answer_submission_rate", "active_coverage", "passive_coverage", "efficiency", "policy_penalty", "actor_attempts", "environment_steps", "invalid_actions", "exact_repeats", "semantic_repeats", "answer_quality", "preference_coverage", "phase_transition_score", "guard_rejection_rate", "blocked_aspects")
RESULT = (
    "infrastructure_valid boolean, actor_attempts bigint, environment_steps bigint, reward struct<terminal_reward:double,quality_by_aspect:map<string,double>,gold_itinerary:boolean,correct_itinerary:boolean,user_aligned_success:boolean,completion_rate:double,answer_submission_rate:double,"
    "active_preference_coverage:double,passive_preference_coverage:double,efficiency:double,policy_penalty:double,invalid_actions:bigint,exact_repeats:bigint,semantic_repeats:bigint,answer_quality:double,preference_coverage:double,phase_transition_score:double,guard_rejection_rate:double,blocked_aspects:double>"
)


def result_metrics() -> Column:
    """A struct of METRICS of a result (columns of RESULT); null if the infrastructure was not valid or there is no reward."""
    r = F.col("reward")
    values = F.map_values(F.coalesce(r["quality_by_aspect"], F.create_map().cast("map<string,double>")))
    n = F.size(values)
    mean = F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    num = lambda x, d=0.0: F.coalesce(x.cast("double"), F.lit(d))
    flag = lambda x: is_true(x).cast("double")
    equal = lambda q: F.size(F.filter(values, lambda x: x == q)).cast("double")
    sent = F.coalesce(r["answer_submission_rate"], r["completion_rate"], F.lit(0.0))
    found = {
        "micro_avg": mean, "micro_max": F.when(n > 0, F.array_max(values)).otherwise(0.0), "number_of_1": equal(1.0), "number_of_08": equal(0.8), "terminal_reward": num(r["terminal_reward"]),
        "gold_itinerary": flag(r["gold_itinerary"]), "correct_itinerary": flag(r["correct_itinerary"]), "user_aligned_success": flag(r["user_aligned_success"]), "completion": num(r["completion_rate"]), "answer_submission_rate": sent,
        "active_coverage": num(r["active_preference_coverage"]), "passive_coverage": num(r["passive_preference_coverage"]), "efficiency": num(r["efficiency"]), "policy_penalty": num(r["policy_penalty"]),
        "actor_attempts": num(F.col("actor_attempts")), "environment_steps": num(F.col("environment_steps")), "invalid_actions": num(r["invalid_actions"]), "exact_repeats": num(r["exact_repeats"]), "semantic_repeats": num(r["semantic_repeats"]),
        "answer_quality": F.coalesce(r["answer_quality"], mean), "preference_coverage": F.coalesce(r["preference_coverage"], F.least(F.lit(1.0), num(r["active_preference_coverage"]) + num(r["passive_preference_coverage"]))),
        "phase_transition_score": num(r["phase_transition_score"], 1.0), "guard_rejection_rate": num(r["guard_rejection_rate"]), "blocked_aspects": num(r["blocked_aspects"]),
    }
    return F.when(is_true(F.col("infrastructure_valid")) & r.isNotNull(), F.struct(*[found[k].alias(k) for k in METRICS]))
