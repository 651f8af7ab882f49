"""Public control, gates of records, and operators whose SQL once repeated their mistakes."""

import pytest
from pyspark.sql import functions as F

from tracksmith.functions import expr
from tracksmith.operators import credit, evaluation, groups, public_control, records, rollouts, transcripts
from tracksmith.operators.public_control import ANSWER, ANSWERED, BLOCKED, ELICIT, OPEN, REFUSED, RETRY, SEARCH, SWITCH, Episode

DOWN = "The searching backend is experiencing some issues."


def test_normal_search_then_answer():
    e = Episode.begin("I need a hotel and a flight.")
    assert (e.at, e.phase) == ("hotel", ELICIT)
    e.turn("search", "hotel in Madrid", "Candidates: H1, H2, F9.")
    assert e.current.visible == {"H1", "H2"} and e.current.normal and e.phase == ANSWER and not e.ledgers["flight"].visible
    assert e.refusal("action", "more?") == REFUSED["answer_only"] and e.refusal("answer", "H1,H2") == REFUSED["one_option"] and e.refusal("answer", "H3") == REFUSED["not_visible"] and e.refusal("answer", "F9") == REFUSED["elsewhere"]
    e.turn("answer", "H9", "no")  # refused, but kept as submitted
    assert e.submitted == ["H9"] and e.phase == ANSWER
    e.turn("answer", "H2", "accepted")
    assert (e.current.status, e.current.answer, e.phase) == (ANSWERED, "H2", SWITCH)
    assert e.refusal("search", "hotel") == REFUSED["closed"].format("hotel") and e.refusal("search", "flight") == REFUSED["switch"]
    assert e.advance() and (e.at, e.phase, e.done) == ("flight", ELICIT, False)
    e.turn("search", "flight", "F1")
    e.turn("answer", "F1", "accepted")
    assert e.done and e.advance() and e.at is None and e.refusal("action", "x") == REFUSED["done"]


def test_unseen_answer_stays_open():
    e = Episode.begin("I need a hotel.")
    e.turn("answer", "H99", "not accepted")
    assert e.current.status == OPEN and e.submitted == ["H99"] and e.idle == 1


def test_two_fallbacks_block():
    e = Episode.begin("I need a hotel.")
    e.turn("search", "hotel in Madrid", DOWN)
    assert (e.current.attempts, e.current.fallbacks, e.current.status, e.phase) == (1, 1, OPEN, RETRY)
    assert e.refusal("search", "Madrid in HOTEL!") == REFUSED["same_query"] and e.refusal("search", "hotel in madrid") == REFUSED["tried"] and e.refusal("action", "x") == REFUSED["retry_only"]
    e.turn("search", "in madrid hotel", DOWN)
    assert e.current.attempts == 1
    e.turn("search", "hotel Madrid with revised query", DOWN)
    assert (e.current.status, e.current.attempts, e.current.fallbacks, e.mode, e.phase) == (BLOCKED, 2, 2, BLOCKED, SWITCH) and e.done


def test_no_progress():
    e = Episode.begin("Please help with my trip.", limit=1)
    e.turn("action", "ask for more details")
    assert e.at is None and e.mode == "none" and e.refusal("search", "x") == REFUSED["nameless"]
    e = Episode.begin("I need a hotel.", limit=2)
    e.turn("action", "hotel name")
    assert (e.idle, e.phase) == (1, ELICIT)
    e.turn("action", "hotel name")
    assert (e.idle, e.phase) == (2, SEARCH) and e.refusal("action", "hotel") == REFUSED["search_only"]
    e = Episode.begin("I need a hotel.", limit=2)
    e.turn("action", "stars?", "Three.")
    e.turn("action", "chain?", "three.")  # heard before
    e.turn("action", "chain?", "None.")  # the same call again
    assert (e.idle, e.most_idle, e.phase) == (2, 2, SEARCH)


def test_stored_states_are_rebuilt():
    e = Episode.begin("I need a hotel and a flight.")
    for turn in (("action", "hotel stars?", "Three."), ("search", "hotel", DOWN), ("search", "hotel three", "H1 and H2"), ("answer", "H1", "ok")):
        e.turn(*turn)
        assert Episode.rebuild(e.payload(), "I need a hotel and a flight.").payload() == e.payload()
    e.advance()
    e.complete()
    assert e.phase == SEARCH and Episode.rebuild(e.payload(), "I need a hotel and a flight.").payload() == e.payload()


def test_walk(spark):
    talk = [("action", "Which apartment size?", "I have no preference."), ("search", "apartment in Rome", "A1 and A2"), ("answer", "A2", "ok"), ("search", "rental car in Rome", DOWN), ("search", "cheap rental car Rome", DOWN)]
    rows = [(7, k, *t, "An apartment and a rental car, please") for k, t in enumerate(talk)] + [(8, 0, "action", "hello", None, None), (8, 1, "action", None, None, None)]
    walked = public_control.walk(spark.createDataFrame(rows, "id long, k int, choice string, content string, feedback string, message string").repartition(3), "id", "k")
    got = {(r["id"], r["k"], r["label"]) for r in public_control.boundaries(walked, "id", "k").collect()}
    assert got == {(7, 0, "explicit_no_preference"), (7, 1, "preference_complete_to_search"), (7, 2, "valid_search_to_answer"), (7, 3, "preference_complete_to_search"), (7, 3, "first_fallback"), (7, 4, "second_fallback"), (7, 4, "repeated_no_progress_action")}
    last = {r["id"]: r for r in public_control.replay(walked, "id", "k").collect()}
    assert (last[7]["answered"], last[7]["blocked"], last[7]["done"], last[7]["refused"]) == (["apartment"], ["rental_car"], True, 0) and (last[8]["current"], last[8]["idle"]) == (None, 2)
    counts = {r["id"]: r for r in public_control.phase_counts(walked, "id").collect()}
    assert (counts[7]["answer_chances"], counts[7]["answer_successes"], counts[7]["retry_chances"], counts[7]["retry_successes"], counts[7]["switches"]) == (1, 1, 1, 1, 1)


def test_only_gold(spark):
    from tracksmith.plans import record_queries as q

    gold, attempt = records.gold_reasons(q.TOOL, q.SCHEMA, [q.VERSION]), records.attempt_reasons([q.VERSION])
    table = spark.createDataFrame(q.made(q.record(), q.TIER_FAULTS), records.RECORD)
    got = [r["x"] for r in table.select(records.admission_reasons(gold, attempt).alias("x")).collect()]
    assert got[0] == [] and got[4] == ["quality_tier_not_accepted"] and got[8] == ["unmasked_silver_judgment_fallback"]
    blank = spark.createDataFrame([{}], records.RECORD).select(gold.alias("g"), attempt.alias("a"), records.tier(attempt).alias("t")).first()
    assert "invalid_messages" in blank["g"] and "missing_reward_evidence" in blank["a"] and blank["t"] is None


def test_groups_of_another_size_are_incomplete(spark):
    rows = [(u, float(k), False) for u, n in (("five", 5), ("six", 6), ("seven", 7)) for k in range(n)]
    got = {r["uid"]: r["status"] for r in groups.classify(spark.createDataFrame(rows, "uid string, reward double, invalid boolean"), "uid", 6).collect()}
    assert got == {"five": "incomplete", "six": "kept", "seven": "incomplete"}


def test_search_form(spark):
    texts = {"The 10th & 21ST of May": "the 10 and 21 of may", "tenth_first/2nd": "tenth first 2", "Straße-3rd": "strasse 3", "": ""}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", expr.search_form(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == texts


def test_field_matches(spark):
    hints = spark.createDataFrame([("flight", "time", "layover time"), ("flight", "path", "layover"), ("hotel", "rating", "star"), ("hotel", "room", "room"), ("restaurant", "rating", "star")], "aspect string, field string, hint string")
    names = spark.createDataFrame([("hotel", "hotel"), ("flight", "flight"), ("restaurant", "dining")], "aspect string, hint string")
    texts = [(1, "start of a restart"), (2, "layover time and another layover"), (3, "a layover time"), (4, "Hotel stars and rooms"), (5, "how many stars"), (6, "hotels or dining: stars"), (7, None)]
    df = spark.createDataFrame(texts, "id int, text string")
    got = sorted(tuple(r) for r in transcripts.field_matches(df, "id", "text", hints, names).collect())
    assert got == [(2, "flight", "path"), (2, "flight", "time"), (3, "flight", "time"), (4, "hotel", "rating"), (4, "hotel", "room"), (5, "hotel", "rating"), (5, "restaurant", "rating"), (6, "hotel", "rating"), (6, "restaurant", "rating")]


def test_null_metrics_count_zero(spark):
    rows = [(1, 0.99, None, 0.5, 0.5, 0.5), (2, 0.99, 0.5, 0.5, 0.5, 0.5), (3, None, 0.9, 0.9, 0.9, 0.9)]
    out = {r["step"]: r for r in evaluation.select_checkpoint(spark.createDataFrame(rows, "step int, valid_rate double, terminal double, correct double, aligned double, efficiency double"), {"terminal": 0.5}).collect()}
    assert out[1]["rejections"] == "terminal_regressed" and out[2]["selected"] and out[3]["rejections"] == "valid_rate"


def test_turns_without_an_aspect_have_no_chain(spark):
    flags = {k: False for k in credit.PENALTIES}
    def turn(k, aspect, choice, **more):
        return {"trajectory": 1, "turn": k, "aspect": aspect, "choice": choice, "field_resolved": True, "normal_candidates": True, "answer_visible": True, "correct_answer": True, "guard_rejected": False, "infrastructure_failure": False, "reward_valid": True, **flags, **more}

    kinds = "trajectory int, turn int, aspect string, choice string, field_resolved boolean, normal_candidates boolean, answer_visible boolean, correct_answer boolean, guard_rejected boolean, infrastructure_failure boolean, reward_valid boolean, " + ", ".join(f"{k} boolean" for k in flags)
    rows = [turn(k, a, c) for a, first in ((None, 0), ("hotel", 3)) for k, c in enumerate(("action", "search", "answer"), first)]
    got = [r["evidence"] for r in credit.evidence(spark.createDataFrame(rows, kinds)).orderBy("turn").collect()]
    assert got == pytest.approx([0, 0, 0, 0.2, 0.45, 0.35])


def test_training_rows_are_numbered_without_gaps(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("split"))
    out = groups.training_rows(df, "split", ["k"], "k", {"extra": ["k", "split"]}, width=100).orderBy("split", "k").collect()
    for split in "ab":
        mine = [r for r in out if r["split"] == split]
        assert [r["index"] for r in mine] == list(range(len(mine))) and all(r["extra"]["k"] == r["k"] for r in mine)


def test_masked_history(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "tool", "t")]
    df = spark.createDataFrame(rows, "id int, turn int, role string, text string")
    m = rollouts.masked_history(df, "id", "turn", "role", "text", F.lit("note"), F.lit("next")).first()["messages"]
    assert [(x["role"], x["text"], x["masked"]) for x in m] == [("system", "s", True), ("user", "u", True), ("assistant", "a", True), ("tool", "t\nnote", True), ("assistant", "next", False)]
    plain = rollouts.masked_history(df, "id", "turn", "role", "text").first()["messages"]
    assert [x["masked"] for x in plain] == [True, True, True, False]


def test_tagged_calls(spark):
    text = "<tool_call><function=f><parameter=choice> search </parameter><parameter=content>a</parameter></function></tool_call> x <tool_response> r1 </tool_response><tool_call><parameter=Choice>answer</parameter></tool_call><tool_call><parameter=content>b</parameter></tool_call><tool_response>r2</tool_response><tool_response>r3</tool_response>"
    got = [tuple(r) for r in transcripts.parse_tagged(spark.createDataFrame([(1, text), (2, None), (3, "none")], "id int, t string"), "id", "t").orderBy("key", "ord").collect()]
    assert got == [(1, 0, "search", "a", "r1"), (1, 1, "answer", None, None), (1, 2, None, "b", "r2")]


def test_alias_tokens(spark):
    rows = {1: ("Ｈｏｔｅｌｓ & Glass, bus", ["hotel", "glass", "bus"]), 2: ("STRASSE straße ﬁnes", ["strasse", "strasse", "fine"]), 3: (None, []), 4: ("Cars_cars", ["car", "car"])}
    got = {r["key"]: r["tokens"] for r in transcripts.alias_tokens(spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "id int, t string"), "id", "t").collect()}
    assert got == {k: want for k, (_, want) in rows.items()}


def test_hidden_paths(spark):
    from tracksmith.operators import contracts

    rows = [(1, '{"a":{"secret":1,"b":[{"secret":{"key":2}}]},"key":3}'), (2, "[1"), (3, None), (4, '["secret"]')]
    got = sorted(tuple(r) for r in contracts.hidden_paths(spark.createDataFrame(rows, "id int, j string"), "id", "j", ["secret", "key"]).collect())
    assert got == [(1, "$.a.b[0].secret"), (1, "$.a.b[0].secret.key"), (1, "$.a.secret"), (1, "$.key")]


def test_waves_equal_a_loop(spark):
    """Highest averages seat by seat, ties by the larger capacity, then the larger name."""
    from tracksmith.operators import splits

    start = [("a", 30, 0, 100), ("b", 10, 2, 9), ("c", 5, 5, 50), ("d", 40, 0, 12)]
    state = {s: [q, a, u] for s, q, a, u in start}
    number = 0
    while any(a < q and u > 0 for q, a, u in state.values()):
        number += 1
        capacity = {s: min(max(0, q - a), u) for s, (q, a, u) in state.items()}
        seats = dict.fromkeys(state, 0)
        for _ in range(8):
            open_ = [s for s in state if seats[s] < capacity[s]]
            if open_:
                best = max(open_, key=lambda s: (capacity[s] / (seats[s] + 1), capacity[s], s))
                seats[best] += 1
        for s, n in seats.items():
            state[s][1] += n - n // 3
            state[s][2] -= n
    got = {r["stratum"]: (r["accepted"], r["untried"], r["waves"], r["exhausted"]) for r in splits.waves(spark.createDataFrame(start, "stratum string, quota bigint, accepted bigint, untried bigint"), 8, F.expr("seats - seats DIV 3")).collect()}
    assert got == {s: (a, u, number, a < q) for s, (q, a, u) in state.items()}


def test_many_waves_take_few_jobs(spark, monkeypatch):
    """Against a loop, where what succeeds depends on the wave; jobs are counted, as a job a wave is too many for large strata."""
    from tracksmith.operators import splits

    start = [("a", 700, 0, 900), ("b", 90, 20, 80), ("c", 500, 5, 450)]
    state = {s: [q, a, u] for s, q, a, u in start}
    number = 0
    while any(a < q and u > 0 for q, a, u in state.values()):
        number += 1
        capacity = {s: min(max(0, q - a), u) for s, (q, a, u) in state.items()}
        offers = sorted(((capacity[s] / k, capacity[s], s) for s in state for k in range(1, capacity[s] + 1)), reverse=True)[:20]
        for s in state:
            n = sum(o[2] == s for o in offers)
            state[s][1] += n - n * (number % 3) // 4
            state[s][2] -= n
    assert number > 60
    frame = spark.createDataFrame(start, "stratum string, quota bigint, accepted bigint, untried bigint")
    monkeypatch.setattr(splits, "WAVE_ROWS", 21 * 25, raising=False)
    spark.sparkContext.setJobGroup("many-waves", "")
    try:
        got = {r["stratum"]: (r["accepted"], r["untried"], r["waves"], r["exhausted"]) for r in splits.waves(frame, 20, F.expr("seats - seats * (wave_no % 3) DIV 4")).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("many-waves"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {s: (a, u, number, a < q) for s, (q, a, u) in state.items()}
    assert jobs < number
    assert splits.waves(frame.limit(0), 20, F.col("seats")).count() == 0


def test_contract_names_what_differs(spark, tmp_path):
    from tracksmith.sources import tables

    (tmp_path / "c.json").write_text('{"a": 1, "b": [2]}')
    assert tables.contract(spark, str(tmp_path), {"b": [2], "a": 1}).count() == 2
    with pytest.raises(ValueError, match="a, c"):
        tables.contract(spark, str(tmp_path), {"b": [2], "a": 2, "c": 3})


def test_targets_are_judged_again(spark):
    from tracksmith.operators import targets
    from tracksmith.plans import recovery_queries as q

    rows = [dict(q.boundary(), boundary="second_fallback", phase="SWITCH_ASPECT_REQUIRED", blocked=["hotel"]), dict(q.boundary(), boundary="first_fallback", phase="SEARCH_RETRY_REQUIRED", last_search="hotel in Rome"), dict(q.boundary())]
    made = targets.construct(spark.createDataFrame(rows, q.SCHEMA), q.FIELDS)
    assert [r["problems"] for r in targets.validate(made).collect()] == [[], [], []]
    forged = made.withColumn("target_content", F.lit("hotel Rome in")).withColumn("target_choice", F.lit("search"))
    got = [r["problems"] for r in targets.validate(forged).collect()]
    assert got[0] == ["search_phase_mismatch", "target_reuses_blocked_aspect", "target_does_not_switch_aspect"] and got[1] == ["rewritten_query_not_substantive"] and got[2] == []


def test_probe_boundaries(spark):
    from tracksmith.operators import probes

    talk = [("action", "which hotel stars", "Three."), ("search", "flight to Rome", "F1"), ("search", "hotel in Rome", "H1 and H2"), ("answer", "H1", "ok")]
    failing = [("search", "hotel in Rome", "the search backend is unavailable"), ("action", "which hotel stars", "I have no preference"), ("search", "cheap hotel Rome", "the search backend is unavailable")]
    turns = spark.createDataFrame([(name, k, *x, "A hotel and a flight") for name, told in (("t", talk), ("u", failing)) for k, x in enumerate(told)], "trajectory string, turn long, choice string, content string, feedback string, message string")
    kinds = (probes.ANSWER_PROBE, probes.PREFERENCE_PROBE, probes.FALLBACK_PROBE)
    rows = [(1, "t", kinds[0], "x", 0, False, None, None), (2, None, kinds[0], "x", 1, False, None, None), (3, None, kinds[1], "x", 2, False, None, None), (4, None, kinds[2], "x", 3, False, "hotel in Rome", None), (5, None, kinds[2], "x", 3, True, "hotel in Rome", "cheap hotel Rome"), (6, None, kinds[2], "x", 3, False, None, None), (7, None, kinds[0], "x", 99, False, None, None)]
    rows.append((8, "u", kinds[2], "x", 0, False, None, None))
    given = spark.createDataFrame(rows, "probe long, transcript string, kind string, task string, context long, double boolean, original string, retry string")
    meta = [(kinds[0], "x", 1, 0, "t", 3, None, None), (kinds[0], "x", 1, 1, "t", None, "hotel", None), (kinds[1], "x", 2, 0, "t", 2, None, None), (kinds[2], "x", 3, 0, "t", 77, "hotel", "")]
    metadata = spark.createDataFrame(meta, "kind string, task string, context long, ord long, trajectory string, at long, named string, down string")
    got = {(r["probe"], r["turn"], r["label"], r["phase"]) for r in probes.boundaries(given, metadata, turns).collect()}
    walked = public_control.walk(turns, "trajectory", "turn", follow=True)
    after = ("first_fallback", "second_fallback", "explicit_no_preference")  # these show the state that the turn led to
    own = {({"t": 1, "u": 8}[r["trajectory"]], r["turn"], label, r["phase" if label in after else "phase_before"]) for r in walked.collect() for label in r["labels"]}
    assert {x for x in got if x[0] in (1, 8)} == own and len(own) >= 6
    assert {(8, 0, "first_fallback", RETRY), (8, 2, "second_fallback", SWITCH)} <= own and (8, 0, "first_fallback", ELICIT) not in own
    assert {x for x in got if x[0] not in (1, 8)} == {(2, 2, "valid_search_to_answer", ANSWER), (3, 2, "preference_complete_to_search", ELICIT), (4, 2, "first_fallback", RETRY), (5, 3, "second_fallback", SWITCH)}
