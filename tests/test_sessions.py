"""Sampler, ledger, stall cut and live sessions: cases, brute force, and streams against their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from tracksmith.operators import ledger, public_control, sampling
from tracksmith.streaming import sessions

ROLLS = "run long, update long, uid long, batch long, row long, reward double, invalid boolean, degraded boolean"


def random_rolls(seed, runs=4, updates=30):
    """Two prompts, three batches of two rows each; most runs hardly vary."""
    draw = random.Random(seed)
    rows = []
    for run in range(runs):
        for update in range(updates):
            for uid in range(2):
                for row in range(6):
                    reward = draw.choice([0.0, 0.25, 0.5]) if run == 0 or draw.random() < 0.06 else 0.0
                    rows.append((run, update, uid, row // 2, row, reward, draw.random() < 0.1, draw.random() < 0.2))
    return rows


def by_hand(rows, size, most_skips=10):
    """The sampler, update by update."""
    from itertools import combinations

    out = {}
    for run in sorted({r[0] for r in rows}):
        skips = 0
        for update in sorted({r[1] for r in rows if r[0] == run}):
            own = [r for r in rows if r[:2] == (run, update)]
            if skips > most_skips:
                out[run, update] = ("not_reached", None, None, None)
                continue
            chosen = {}
            for batch in range(3):
                chosen = {}
                for uid in (0, 1):
                    pool = [r for r in own if r[2] == uid and r[3] <= batch and not r[6]]
                    clean = [r for r in pool if not r[7]]
                    pool = clean if len(clean) >= size else pool
                    sets = sorted(combinations(pool, size), key=lambda c: (-(max(x[5] for x in c) - min(x[5] for x in c)), -len({x[5] for x in c}), [x[4] for x in c]))
                    if sets and max(x[5] for x in sets[0]) - min(x[5] for x in sets[0]) > 1e-6:
                        chosen[uid] = ",".join(str(x[4]) for x in sets[0])
                if len(chosen) == 2:
                    break
            trained = len(chosen) == 2
            skips = 0 if trained else skips + 1
            out[run, update] = ("trained" if trained else "exhausted" if skips > most_skips else "skipped", batch + 1, skips, chosen if trained else None)
    return out


def test_sampler_equals_a_loop(spark):
    rows = random_rolls(3)
    df = spark.createDataFrame(rows, ROLLS)
    want = by_hand(rows, 3)
    got = sampling.updates(df, size=3)
    found = {(r["run"], r["update"]): (r["status"], r["sampled_batches"], r["consecutive_skips"]) for r in got.collect()}
    assert found == {k: v[:3] for k, v in want.items()}
    assert {"trained", "skipped", "exhausted", "not_reached"} == {v[0] for v in want.values()}
    picked = {(r["run"], r["update"], r["uid"]): r["rows"] for r in sampling.selected(df, got, "row", 3).collect()}
    assert picked == {(*k, uid): rows for k, v in want.items() if v[3] for uid, rows in v[3].items()}


def test_an_update_of_another_number_of_prompts(spark):
    rows = [(0, 0, 0, 0, 0, 0.5, False, False), (0, 1, 0, 0, 0, 0.0, True, False), (0, 1, 1, 0, 1, 0.0, True, False)]
    got = {r["update"]: (r["status"], r["candidates"], r["consecutive_skips"]) for r in sampling.updates(spark.createDataFrame(rows, ROLLS)).collect()}
    assert got == {0: ("wrong_groups", 1, 0), 1: ("skipped", 0, 1)}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream(spark, path, schema, parts, make):
    """Results of a query that is started anew for each part, so that state is read back."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        make(spark.readStream.schema(schema).parquet(f"{path}/in")).writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").format("parquet").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").collect()


def test_streamed_sampler_equals_batch(spark, tmp_path, rocks):
    rows = random_rolls(5, runs=3, updates=20)
    parts = [[r for r in rows if (r[1] * 3 + r[3]) // 22 == k] for k in range(3)]
    got = stream(spark, tmp_path, ROLLS, parts, lambda df: sessions.updates(df, 4, size=3))
    want = sampling.updates(spark.createDataFrame(rows, ROLLS), size=3).where("status <> 'not_reached'").collect()
    assert sorted(map(tuple, got)) == sorted((r["run"], r["update"], r["status"], r["sampled_batches"], r["consecutive_skips"]) for r in want)
    assert any(r["status"] == "exhausted" for r in want)


EVENTS = "trajectory long, at long, kind string, choice string, content string, feedback string, aspect string, message string"


def random_events(seed):
    draw = random.Random(seed)
    rows = []
    for k in range(12):
        message = draw.choice(["A flight and a hotel, please", "I need a hotel.", "nothing named"])
        for at in range(14):
            kind = draw.choice(["call"] * 6 + ["observation", "no_progress", "complete"])
            choice = draw.choice(["action", "search", "answer"])
            content = {"search": draw.choice(["hotel in Rome", "cheap hotel", "flight offers"]), "answer": draw.choice(["H1", "F1", "H2"]), "action": draw.choice(["which hotel", "which flight"])}[choice]
            feedback = draw.choice([None, "found H1, H2, F1", "the search backend is unavailable", "nothing", "reply"])
            rows.append((k, at, kind, choice, content, feedback if kind != "observation" else feedback or "text", draw.choice([None, "hotel"]), message))
    return rows


def test_streamed_sessions_equal_batch(spark, tmp_path, rocks):
    rows = random_events(2)
    parts = [[r for r in rows if r[1] // 5 == k] for k in range(3)]
    got = stream(spark, tmp_path, EVENTS, parts, sessions.live)
    want = public_control.live(spark.createDataFrame(rows, EVENTS)).collect()
    assert sorted(map(repr, (r.asDict() for r in got))) == sorted(map(repr, (r.asDict() for r in want)))


def test_events_of_live_sessions(spark):
    """Thresholds, observations without a call, known preferences, and the order of aspects."""
    def after(*events, message="I need a hotel.", limit=2):
        episode = public_control.Episode.begin(message, limit)
        for kind, *rest in events:
            episode.event(kind, *(rest + [None] * (4 - len(rest))))
        return episode

    one = after(("call", "action", "hotel name"))
    assert (one.idle, one.phase) == (1, public_control.ELICIT)
    two = after(("call", "action", "hotel name"), ("call", "action", "hotel name"))
    assert (two.idle, two.phase) == (2, public_control.SEARCH)
    assert after(("no_progress",), ("no_progress",)).phase == public_control.SEARCH
    assert after(("no_progress",), ("observation", "search", None, "H1 and H2")).idle == 0
    assert after(("observation", "search", None, "nothing"), ("observation", "search", None, "the search backend is unavailable")).idle == 2
    assert after(("complete",)).phase == public_control.SEARCH
    assert after(("complete", None, None, None, "flight")).phase == public_control.ELICIT  # not one of its aspects
    done = after(("call", "search", "hotel", "H1"), ("call", "answer", "H1", "accepted"), ("call", "search", "flight", "F1"), ("call", "answer", "F1", "accepted"), ("no_progress",), message="a hotel and a flight")
    assert done.done and done.of(public_control.ANSWERED) == ["hotel", "flight"] and done.idle == 0


STEPS = "trajectory long, turn long, choice string, signature string, meaning string, meaning_aspect string, ambiguous boolean, options array<string>, known array<string>, aspects array<string>, remaining array<string>, to_search array<string>, chosen array<string>, active long, passive long, has_options boolean"
KNOWN, ASPECTS = ["p1", "p2", "p10", "p11"], ["A", "B"]


def step(turn, choice="action", remaining=KNOWN, to_search=ASPECTS, chosen=(), active=0, passive=0, options=(), aspect=None, signature=None):
    return (1, turn, choice, signature or f"s{turn}", aspect and f"{aspect}:x", aspect, False, list(options), KNOWN, ASPECTS, None if remaining is None else list(remaining), list(to_search), list(chosen), active, passive, True)


def aspect_of(p):
    return F.when(F.length(p) == 2, "A").otherwise("B")


def initial(o):
    return F.substr(o, F.lit(1), F.lit(1))


def test_every_violation_is_named(spark):
    rows = [
        step(0, remaining=["p1", "p2", "p10"], active=1), step(1, remaining=KNOWN, active=1), step(2, remaining=["p1"], active=1, passive=3), step(3, remaining=["p1"], active=0, passive=4),
        step(4, remaining=["p1"], active=0, passive=3, to_search=["A"]), step(5, remaining=["p1", "zz"], passive=3, to_search=["A", "B"], chosen=["A"]), step(6, remaining=["p1"], passive=5), step(7, remaining=None, passive=-1, to_search=["Q"])]
    got = {r["turn"]: r["violations"] for r in ledger.transitions(spark.createDataFrame(rows, STEPS)).collect()}
    assert got == {
        0: [], 1: ["preferences_grow"], 2: [], 3: ["active_falls"], 4: ["passive_falls"], 5: ["after_unknown_preference", "preferences_grow", "aspects_grow"],
        6: ["before_unknown_preference", "after_more_elicited_than_known", "choices_shrink", "counts_exceed_elicited"], 7: ["before_more_elicited_than_known", "after_missing", "after_unknown_aspect", "after_negative_count", "aspects_grow", "passive_falls"]}


def test_preferences_go_to_the_asked_aspect_first_and_first_answers_stay(spark):
    rows = [
        step(0, remaining=["p10"], active=1, passive=1, aspect="B"),  # p1 p2 p11 came to light: p11 is B's, then p1
        step(1, "search", remaining=["p10"], to_search=["B"], active=1, passive=1, signature="same"), step(2, "search", remaining=["p10"], to_search=["B"], active=1, passive=1, signature="same"),
        step(3, "answer", remaining=["p10"], to_search=["B"], chosen=["A", "B"], active=1, passive=1, options=["B7", "A3", "A4", "C1"]),
        step(4, "answer", remaining=["p10"], to_search=["B"], chosen=["A", "B"], active=1, passive=1, options=["A9"])]
    moved = ledger.attributed(ledger.transitions(spark.createDataFrame(rows, STEPS)), aspect_of, initial)
    by_turn = {r["turn"]: r for r in moved.collect()}
    assert (by_turn[0]["active_ids"], by_turn[0]["passive_ids"]) == (["p11"], ["p1"])
    assert [by_turn[t]["progress"] for t in range(5)] == [True, True, False, True, False]
    r = ledger.sessions(moved, initial, lambda o: o == "A4").first()
    assert (r["exact_repeats"], r["active"], r["passive"], r["searched"], r["answers"], r["unsearched_answers"], r["wrong_answers"], r["unsound_steps"]) == (1, "p11", "p1", "A", "A3,B7", 1, 2, 0)


def watch(spark, *flags, threshold=2):
    rows = [(1, k, choice, progress, answer, options, sound) for k, (choice, progress, answer, options, sound) in enumerate(flags)]
    df = spark.createDataFrame(rows, "trajectory long, turn long, choice string, progress boolean, answer_progress boolean, has_options boolean, sound boolean")
    return tuple(ledger.stall_cut(df, threshold).first())[1:]


IDLE, GOOD = ("action", False, False, True, True), ("action", True, False, True, True)
ANSWER, BLIND, BROKEN = ("answer", True, True, True, True), ("action", False, False, False, True), ("action", False, False, True, False)


@pytest.mark.parametrize(("flags", "want"), [
    ((IDLE, IDLE, ANSWER, GOOD), (2, 1, 2, None)),  # one answer-only step, used
    ((IDLE, IDLE, IDLE, GOOD), (2, 1, None, 2)),  # anything else stops
    ((IDLE, IDLE, ANSWER, IDLE, IDLE, ANSWER), (2, 1, 2, 4)),  # a second stall stops
    ((BLIND, BLIND, ANSWER), (2, None, None, 1)),  # no option is visible
    ((IDLE, GOOD, IDLE, GOOD), (1, None, None, None)),
    ((IDLE, BROKEN, IDLE, IDLE), (1, None, None, None)),  # the watch ends
])
def test_stall_is_cut(spark, flags, want):
    assert watch(spark, *flags) == want
