"""Stored results, notes, pools, subsets, run summaries: stated cases, nulls, empty tables, brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracksmith.operators import events, invariants, notes, pools, rollouts
from tracksmith.sources import tables

PHASE = "struct<successes:long,opportunities:long,rate:double>"
COUNTS = "guard_rejections invalid_actions exact_repeats semantic_repeats blocked_aspects ambiguous_actions unsearched_answers wrong_answers".split()
NUMBERS = "completion correct_rate submission active passive preference search phase_score effective_steps rejection_rate answer_quality efficiency policy_penalty raw_reward terminal_reward".split()
SCHEMA = ("id long, valid boolean, transcript_size long, termination string, inner_termination string, aspects array<string>, quality map<string,double>, correct_itinerary boolean, gold_itinerary boolean, "
          f"phases map<string,{PHASE}>, attempts long, steps long, inner_attempts long, inner_steps long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in NUMBERS))


def right():
    """A result of two aspects, one right; 10 attempts, 2 refused; worked out by hand."""
    penalty = 0.08 * 2 / 4 + 0.03 * 1 / 4 + 0.04 * 1 / 2
    raw = 3 * 0.5 + 0.2 * 0.75 + 0.08 * 0.5 + 0.06 * 1 + 0.04 * 0.4 + 0.02 * 0.9 - penalty
    return {
        "id": 1, "valid": True, "transcript_size": 0, "termination": "completed", "inner_termination": "completed", "aspects": ["hotel", "flight"], "quality": {"flight": 0.8, "hotel": 0.0}, "correct_itinerary": False, "gold_itinerary": False,
        "phases": {"a": (1, 2, 0.5), "b": (0, 0, 1.0)}, "attempts": 10, "steps": 8, "inner_attempts": None, "inner_steps": 8, **dict.fromkeys(COUNTS, 0), "guard_rejections": 2, "invalid_actions": 1, "wrong_answers": 1,
        "completion": 0.5, "correct_rate": 0.5, "submission": 1.0, "active": 0.5, "passive": 0.25, "preference": 0.75, "search": 1.0, "phase_score": 0.5, "effective_steps": 8.5, "rejection_rate": 0.2, "answer_quality": 0.4, "efficiency": 0.9,
        "policy_penalty": penalty, "raw_reward": raw, "terminal_reward": raw / 3.4}


def test_a_right_result_has_no_problem_and_each_change_has_its_own(spark):
    changes = {
        "valid": (None, {"invalid"}), "transcript_size": (None, {"transcript_kept"}), "quality": ({"flight": 0.8}, {"quality_keys", "quality_values"}), "correct_rate": (0.4, {"correct_rate"}), "submission": (0.4, {"submission"}),
        "correct_itinerary": (None, {"correct_itinerary"}), "gold_itinerary": (True, {"gold_itinerary"}), "passive": (0.3, {"preference"}), "active": (float("nan"), {"preference_range"}), "phases": (None, {"phase_counts", "phase_rates"}),
        "steps": (11, {"step_counts"}), "attempts": (None, {"step_counts"}), "inner_attempts": (9, {"inner_steps"}), "effective_steps": (None, {"effective_steps"}), "rejection_rate": (0.25, {"rejection_rate"}), "terminal_reward": (float("inf"), {"terminal_reward", "terminal_reward_not_finite"}),
        "efficiency": (None, {"efficiency_not_finite"}), "wrong_answers": (2, {"policy_penalty", "raw_reward", "terminal_reward"}), "inner_termination": (None, {"termination"}), "search": (0.0, {"raw_reward", "terminal_reward"}), "aspects": ([], {"aspects", "quality_keys", "completion", "policy_penalty", "raw_reward", "terminal_reward"})}
    cases = [right()] + [{**right(), "id": k, column: value} for k, (column, (value, _)) in enumerate(changes.items(), 2)]
    df = spark.createDataFrame([tuple(c[f.split()[0]] for f in re.split(r",\s(?![^<]*>)", SCHEMA)) for c in cases], SCHEMA)
    found = {}
    for r in invariants.result_problems(df, ["id"]).collect():
        found.setdefault(r["id"], set()).add(r["problem"])
    assert 1 not in found
    for k, (column, (_, expected)) in enumerate(changes.items(), 2):
        assert found.get(k, set()) == expected, column
    assert invariants.result_problems(df.limit(0), ["id"]).count() == 0


def test_notes_word_for_word(spark):
    df = spark.createDataFrame([("hotel", "ANSWER_REQUIRED", 1, ["H2", "H10"], False, False, "flight", "blocked"), (None, "ELICITING", 3, ["H1"], False, False, None, None), ("hotel", "SWITCH_ASPECT_REQUIRED", None, [], False, True, None, None), ("hotel", "ANSWERED", 0, None, True, False, None, None)],
                               "aspect string, phase string, f int, ids array<string>, done boolean, blocked boolean, old string, status string")
    got = [r[0] for r in df.select(notes.render(*[F.col(c) for c in df.columns])).collect()]
    assert got[0] == ("Public control | Current public aspect: hotel | Current control state: ANSWER_REQUIRED | Current aspect fallback count: 1 | Current visible option IDs: H10,H2 | Allowed next tool calls: answer (one visible option ID)\n"
                      "Transition: SWITCH_ASPECT_REQUIRED | Previous public aspect: flight is BLOCKED; do not call that aspect again. Continue only with current public aspect: hotel.\nConstraint: Answer with exactly one ID from the visible option list; do not search or call action.")
    assert got[1] == "Public control | Current public aspect: none | Current control state: ELICITING | Current aspect fallback count: 0 | Current visible option IDs: none | Allowed next tool calls: action"
    assert got[2].endswith("fallback count: 0 | Current visible option IDs: none | Allowed next tool calls: none for this aspect; next public aspect only\nConstraint: " + notes.BLOCKED)
    assert got[3].endswith("Allowed next tool calls: none\nConstraint: " + notes.DONE)


def by_hand(messages):
    """Phase metrics of one transcript by a loop."""
    phase, counts, blocked = "ELICITING", {k: [0, 0] for k in [*notes.EXPECTED, "aspect_switch"]}, set()
    for i, (role, choice, text) in enumerate(messages):
        text = text or ""
        for k, (p, wanted) in notes.EXPECTED.items():
            if role == "assistant" and phase == p:
                following = (messages[i + 1][2] or "") if i + 1 < len(messages) else ""
                counts[k][1] += 1
                counts[k][0] += choice == wanted and notes.REFUSED not in following.lower()
        if "Transition: SWITCH_ASPECT_REQUIRED" in text:
            counts["aspect_switch"][0] += 1
            counts["aspect_switch"][1] += 1
        named = re.findall(r"Current control state:\s*([A-Z_]+)", text)
        if named:
            phase = named[-1]
            if phase == "SWITCH_ASPECT_REQUIRED" and (int((re.findall(r"fallback count:\s*(\d+)", text) or [0])[-1]) >= 2 or "current aspect is blocked" in text.lower()):
                blocked.add((re.findall(r"Current public aspect:\s*([^|\n]+)", text) or ["unknown"])[-1].strip())
    return counts, len(blocked)


def test_replay_of_notes_equals_a_loop(spark):
    rng = random.Random(7)
    parts = [None, "", "hello", "Public control REJECTED this call. ", *[f"Current public aspect: {a} | Current control state: {p} | Current aspect fallback count: {f} | x\n" for a in ("hotel", "flight ") for p in ("ELICITING", "SEARCH_REQUIRED", "SEARCH_RETRY_REQUIRED", "ANSWER_REQUIRED", "SWITCH_ASPECT_REQUIRED") for f in (0, 2)],
             "Current control state: SWITCH_ASPECT_REQUIRED and the current aspect is blocked", "Transition: SWITCH_ASPECT_REQUIRED | x", "Current control state: ANSWERED"]
    rows, talks = [], {}
    for key in range(40):
        talks[key] = []
        for turn in range(rng.randrange(1, 30)):
            role = rng.choice(["assistant", "tool"])
            some = [p for p in rng.choices(parts, k=2) if p is not None] if role == "tool" else []
            m = (role, rng.choice(["search", "answer", None]) if role == "assistant" else None, "".join(some) if some else rng.choice([None, ""]))
            talks[key].append(m)
            rows.append((key, turn, *m))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key long, turn long, role string, choice string, text string")
    for r in notes.metrics(df, "key", "turn", "role", "choice", "text").collect():
        counts, blocked = by_hand(talks[r["key"]])
        assert {k: [r[f"{k}_successes"], r[f"{k}_opportunities"]] for k in counts} == counts and r["blocked_aspects"] == blocked
        asked = sum(v[1] for v in counts.values())
        assert r["score"] == pytest.approx(1.0 if not asked else sum(v[0] for v in counts.values()) / asked)
    assert notes.metrics(df.limit(0), "key", "turn", "role", "choice", "text").count() == 0


def test_list_literals(spark):
    cases = {"['H1', \"F2\"]": ["H1", "F2"], "[]": [], " [ 'a' , ] ": ["a"], "['it, ]']": ["it, ]"], "['a' 'b']": None, "[1, 'a']": None, "['a'": None, "'a'": None, "": None, None: None, "[None]": None, "['a\\'b']": ["a'b"]}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert [r[0] for r in df.select(pools.text_list(F.col("x"))).collect()] == list(cases.values())


def test_sources_and_pools_of_nothing(spark):
    message = "array<struct<role:string,content:string>>"
    known = pools.scenarios(spark.createDataFrame([("t", "hotel", "H1"), ("t", "flight", "F1"), ("u", None, None)], "s string, aspect string, best string"), "s", "aspect", "best").select(F.col("s").alias("task_id"), "aspects", "best_ids", F.lit("hard").alias("difficulty"))
    good = [("system", "a"), ("user", "")]
    rows = [(1, good, "t", "t", "train", "['F1', 'H1']", "x"), (2, good, "u", "u", "train", "[]", "x"), (3, None, None, None, None, None, None), (4, good, "t", "t", "train", "['F1', 'F1']", "x"), (5, good, "t", "t", "train", "['F1', 'H1', 'H1']", "x")]
    df = spark.createDataFrame(rows, f"k long, prompt {message}, task_id string, tool_task_id string, split string, ground_truth string, kind string")
    found = sorted(tuple(r) for r in pools.source_problems(df, known, "k", {"kind": "x"}, "train").collect())
    assert found == [(2, "no_aspects"), (3, "ground_truth_no_list"), (3, "no_task_id"), (3, "other_kind"), (3, "other_split"), (3, "roles"), (4, "ground_truth_differs"), (5, "ground_truth_differs")]
    pool = df.withColumnRenamed("task_id", "id")
    assert [tuple(r) for r in pools.pool_problems(pool.limit(0), "id", "prompt", ["kind"], "split", "train").collect()] == [(None, "empty", 0)]
    got = sorted((tuple(r) for r in pools.pool_problems(pool, "id", "prompt", ["kind"], "split", "train").collect()), key=repr)
    assert got == sorted([("t", "repeated_id", 3), (None, "no_id", 1), (None, "no_kind", 1), (None, "no_split", 1), (None, "roles", 1)], key=repr)


def test_subset_order_counts(spark):
    lists = spark.createDataFrame([(["a", "b", "c"], ["2", "2"])], "ids array<string>, strata array<string>")
    entries = pools.manifest_entries(lists, "ids", "strata")
    quotas = spark.createDataFrame([("2", 2), ("3", 1)], "stratum string, quota long")
    rows = lambda ids: spark.createDataFrame([(i, x, s) for i, (x, s) in enumerate(ids)], "ord long, id string, s string")
    judge = lambda df, header: sorted((tuple(r) for r in pools.subset_problems(df, entries, quotas, header, {"version": 1}, "ord", "id", "s").collect()), key=repr)
    assert judge(rows([("a", "2"), ("b", "2"), ("c", "3")]), {"version": 1, "selected_task_count": 3}) == [("stratum", "2", None, "3")]
    assert judge(rows([("b", "2"), ("a", "2"), ("c", None)]), {"version": 1, "selected_task_count": 3}) == sorted([("id", "0", "a", "b"), ("id", "1", "b", "a"), ("quota", "3", "1", None), ("quota", None, None, "1")], key=repr)
    assert ("version", None, "1", None) in judge(rows([("a", "2"), ("b", "2"), ("c", "3")]), {"selected_task_count": 3})


def test_run_of_the_teacher(spark):
    schema = "task string, accepted boolean, tier string, rejections array<string>, diagnostics array<string>, steps long, requests long, usage map<string,long>"
    df = spark.createDataFrame([("a", False, None, ["x", "y"], ["teacher_protocol_retry", None], 3, None, {"in": 5}), ("a", True, "silver", [], [], 4, 9, None), ("b", None, "gold", None, None, None, 0, {})], schema)
    got = {(r["kind"], r["name"]): r["n"] for r in rollouts.teacher_run(df, "task").collect()}
    assert got == {
        ("total", "tasks"): 2, ("total", "accepted"): 1, ("total", "gold"): 0, ("total", "silver"): 1, ("total", "rejected"): 1, ("total", "attempts"): 3, ("total", "environment_steps"): 7, ("total", "teacher_requests"): 14,
        ("rejection", "x"): 1, ("rejection", "y"): 1, ("generation", "teacher_protocol_retry"): 1, ("generation", "unknown"): 1, ("usage", "in"): 5}
    assert {r["n"] for r in rollouts.teacher_run(df.limit(0), "task").collect()} == {0}


def test_fallback_texts_and_endings(spark):
    df = spark.createDataFrame([(1, 0, "agent", rollouts.JUDGE_FAILED + ".", "ok"), (1, 1, "env", None, rollouts.SEARCH_FAILED), (1, 2, "agent", None, rollouts.REPLY_UNSURE), (1, 3, "agent", rollouts.REPLY_FAILED, None), (2, 0, "env", rollouts.JUDGE_FAILED, "")], "k long, t long, role string, note string, feedback string")
    assert sorted(tuple(r) for r in rollouts.step_fallbacks(df, "k", "t", "role", "note", "feedback").collect()) == [(1, 3, 2, 1, 1), (2, 1, 0, 0, 0)]
    out = spark.createDataFrame([("By default will return N/A\nBy default will return N/A",), (None,)], "x string").select(*rollouts.output_fallbacks(F.col("x")))
    assert [tuple(r) for r in out.collect()] == [(0, 2), (0, 0)]
    ends = spark.createDataFrame([(True, False, None, None), (None, True, ["a"], ["a"]), (False, True, [], []), (False, None, ["a"], ["a"]), (False, True, ["a", "b"], ["a"]), (False, True, ["a"], None)], "e boolean, o boolean, a array<string>, c array<string>")
    assert [r[0] for r in ends.select(rollouts.one_choice_terminated(*[F.col(c) for c in "eoac"])).collect()] == [True, True, False, False, False, False]


TURN = {"category": None, "reason": None, "choice": "search", "content": None, "aspect": "hotel", "no_preference": None, "normal_search": None, "shown": None, "visible": None, "correct_ids": None, "phase_before": None, "aspect_before": None, "aspect_after": None,
        "search_fallbacks": None, "preferences": None, "answers": None, "exact_repeats": None, "semantic_repeats": None, "infrastructure_errors": None, "wrong_answers": None}
TURN_SCHEMA = ("k long, t long, category string, reason string, choice string, content string, aspect string, no_preference boolean, normal_search boolean, shown array<string>, visible array<string>, correct_ids array<string>, phase_before string, aspect_before string, aspect_after string, "
               "search_fallbacks long, preferences long, answers long, exact_repeats long, semantic_repeats long, infrastructure_errors long, wrong_answers long")


def test_turn_events(spark):
    """Each turn with the flags that are true; a null counter has not grown, and the next is compared with the last known one."""
    told = [
        ({"choice": "action", "preferences": 2}, {"field_resolved"}, 2), ({"choice": "action", "preferences": None}, {"no_progress_action"}, 0), ({"choice": "action", "preferences": 2, "no_preference": True}, {"field_resolved"}, 0),
        ({"search_fallbacks": 1, "aspect_before": "hotel", "aspect_after": "hotel"}, {"first_fallback"}, 0), ({"aspect": "flight", "search_fallbacks": 1, "aspect_before": "flight"}, {"first_fallback", "switched_aspect"}, 0), ({"search_fallbacks": 2, "exact_repeats": 1}, {"second_fallback", "exact_query_repeat"}, 0),
        ({"normal_search": True, "shown": ["H1"], "phase_before": "search_retry_required", "search_fallbacks": 2, "exact_repeats": 1}, {"normal_candidates", "rewritten_retry"}, 0), ({"normal_search": True, "shown": []}, set(), 0),
        ({"choice": "answer", "content": " H1, ", "visible": ["H1"], "correct_ids": ["H1"], "answers": 1}, {"answer_visible", "correct_answer"}, 0), ({"choice": "answer", "content": "H1,H2", "visible": ["H1"], "correct_ids": ["H1"], "answers": 2, "wrong_answers": 1}, {"wrong_answer"}, 0),
        ({"category": "public_phase_guard", "reason": "The QUERY  would repeat", "preferences": 9, "search_fallbacks": 3}, {"guard_rejected", "exact_query_repeat"}, 0), ({"category": "unknown_tool", "reason": "already attempted", "choice": None}, {"malformed_tool_call"}, 0),
        ({"category": "guard_rejection", "choice": "answer", "reason": "unseen or already answered option; current public aspect only"}, {"guard_rejected", "wrong_aspect", "invisible_answer_id"}, 0), ({"category": "parallel_tool_calls"}, {"no_tool_output"}, 0)]
    df = spark.createDataFrame([(1, k, *{**TURN, **given}.values()) for k, (given, _, _) in enumerate(told)] + [(2, 0, *TURN.values())], TURN_SCHEMA)
    got = {(r["k"], r["t"]): r for r in events.turn_events(df, "k", "t").collect()}
    for k, (given, flags, fresh) in enumerate(told):
        assert {f for f in events.FLAGS if got[1, k][f]} == flags and got[1, k]["new_preferences"] == fresh, given
    assert not any(got[2, 0][f] for f in events.FLAGS)


def test_probe_flags(spark):
    cases = [
        (("normal_search_result", "answer", " H1 ,", None, None, None, ["H1"], []), {"answer_at_1", "visible_id_only"}), (("normal_search_result", "answer", "h1", None, None, None, ["h1"], None), {"answer_at_1"}), (("preference_complete", "search", "Rental_Cars in Oslo", "rental_car", None, None, [], []), {"search_at_1", "clean_search_at_1", "search_targets_current_aspect"}),
        (("preference_complete", "search", "hotelier", "hotel", None, None, [], []), {"search_at_1", "clean_search_at_1"}), (("first_fallback", "search", "Search hotels b", None, None, None, [], [("search", "hotels a"), ("action", "x"), ("search", "hotels a b")]), {"changed_query"}),
        (("first_fallback", "search", "a  Hotels", None, None, None, [], [("search", "A HOTELS"), ("search", "hotels a b")]), {"changed_query", "exact_query_repeat"}), (("first_fallback", "search", "a", None, None, None, [], [("action", "a")]), set()),
        (("second_fallback", "search", "flights", "hotel", None, "flight", [], []), {"switch_aspect"}), (("second_fallback", "search", "the hotel", "hotel", None, None, [], None), {"same_aspect_search"}), (("confused_history", "search", " a", None, None, None, [], [("search", "A")]), {"repeated_action", "repeated_search"}),
        (("confused_history", "action", "a", None, None, None, [], [("search", "a"), ("action", "A ")]), {"repeated_action"}), (("confused_history", None, "a", None, None, None, [], [("search", "a")]), None), ((None, "search", None, None, None, None, None, None), set())]
    df = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "k long, category string, choice string, content string, current string, failed string, following string, visible array<string>, earlier array<struct<choice:string,content:string>>")
    for r in events.probe_flags(df, ["k"]).collect():
        expected = cases[r["k"]][1]
        assert {c for c, v in r.asDict().items() if c != "k" and v} == (set() if expected is None else {"protocol_valid", *expected}), cases[r["k"]]


def test_manifest_counts(spark):
    schema = "task_id string, boundary_type string, c string, project_split string, composition string, training_eligible boolean, source_kinds array<string>"
    df = spark.createDataFrame([("a", "x", "1", "evaluation", "22", True, ["t", None]), ("a", "x", "1", "evaluation", "22", None, ["t"]), ("b", None, "1", None, None, False, None)], schema)
    got = {(r["section"], r["name"]): r["n"] for r in rollouts.boundary_manifest(df, ["task_id", "boundary_type", "c"], ["train", "evaluation"]).collect()}
    assert got == {
        ("total", "raw_candidates"): 3, ("total", "unique_contexts"): 2, ("total", "duplicates_removed"): 1, ("by_boundary_type", "x"): 1, ("by_boundary_type", "unknown"): 1, ("by_project_split", "evaluation"): 1, ("by_project_split", "unknown"): 1, ("by_composition", "22"): 1, ("by_composition", "unknown"): 1,
        ("by_source_kind", "t"): 2, ("by_source_kind", "unknown"): 1, ("checks", "evaluation_contexts"): 1, ("checks", "training_contexts"): 1, ("checks", "evaluation_marked_training"): 1, ("checks", "unresolved_tasks"): 1}
    assert {r["n"] for r in rollouts.boundary_manifest(df.limit(0), ["task_id", "boundary_type", "c"], ["train"]).collect()} <= {0}


def test_states_options_and_sinks(spark, tmp_path):
    schema = "k string, o long, d string, lists array<array<string>>, best string, correct array<string>"
    df = spark.createDataFrame([("t", 2, "flight", [["f", "s", "p", "i", "x"], ["f", "s", "p"]], "F1", ["F1", "F2"]), ("t", 1, "hotel", [["h", "s", "p", "i"]], None, None), ("u", 1, "hotel", None, None, [])], schema)
    got = {r["k"]: r for r in rollouts.initial_state(df, "k", "o", "d", "lists", "best", "correct").collect()}
    assert [(p["id"], p["dimension"], p["implicit_elicitation"], p["elicited"]) for p in got["t"]["preferences"]] == [("P1", "hotel", "i", False), ("P2", "flight", "i", False)]
    assert (got["t"]["search_arguments"], got["t"]["best_options"], got["t"]["correct_options"], got["u"]["preferences"]) == (["hotel", "flight"], ["F1"], ["F1", "F2"], [])
    options = spark.createDataFrame([("t", kind, f"{kind}{i % 7}", "x") for kind in ("correct", "wrong", "noise") for i in range(8)], "task string, kind string, option string, reason string")
    listed = tables.option_lists(options, ["task"], "kind", "option", "s", {"wrong": 3, "noise": 0})
    assert sorted(listed.columns) == ["option", "place", "task"]
    rows = sorted((r["place"], r["option"]) for r in listed.collect())
    assert [p for p, _ in rows] == list(range(11)) and sum(o.startswith("correct") for _, o in rows) == 8 and not any(o.startswith("noise") for _, o in rows)
    assert sorted(r["option"] for r in tables.option_lists(options.repartition(7), ["task"], "kind", "option", "s", {"wrong": 3, "noise": 0}).collect()) == sorted(o for _, o in rows)
    paths = {n: f"{tmp_path}/{n}" for n in ("gold", "silver", "rejected", "diagnostics")}
    outcomes = spark.createDataFrame([(1, "gold"), (2, None), (3, "odd"), (4, "silver")], "id long, tier string")
    with pytest.raises(ValueError):
        tables.write_collection(outcomes, outcomes, {**paths, "silver": paths["gold"] + "/"}, "tier")
    tables.write_collection(outcomes, outcomes, paths, "tier")
    assert {n: sorted(r["id"] for r in spark.read.json(p).collect()) for n, p in paths.items()} == {"gold": [1], "silver": [4], "rejected": [2, 3], "diagnostics": [1, 2, 3, 4]}
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        tables.write_collection(outcomes, outcomes, paths, "tier")


def test_zeros_have_the_sign_of_the_sql(spark, tmp_path):
    """A figure that rounds to zero from below is -0.0 in SQL; where a raw reward is zero, the order of its terms decides."""
    import math

    from tests.oracle import connect
    from tracksmith.plans import catalog

    keys = [22933, 24193, 13615, 6]
    spark.createDataFrame([(k, 1, 3.0) for k in keys], "l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["v_18_derived"]).fetchall()
    got = [tuple(r[c] for c in ("k", "problem", "stored", "derived")) for r in catalog.QUERIES["v_18_derived"](spark, str(tmp_path)).collect()]
    signs = lambda rows: sorted((k, p, *[None if v is None else (v, math.copysign(1, v)) for v in vs]) for k, p, *vs in rows)
    assert signs(got) == signs(want)
    assert any(v == 0 and math.copysign(1, v) < 0 for _, _, *vs in got for v in vs if v is not None)
