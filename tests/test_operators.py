"""Operators on small hand-built rows, with the edge cases that the tables do not hold."""

import random

import pytest
from pyspark.sql import functions as F

from tracksmith.functions import expr
from tracksmith.operators import control, credit, evaluation, groups, recovery, reward, splits, transcripts
from tracksmith.sources import tables
from tracksmith.streaming import control as stream


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_ratio_and_flags(spark):
    df = spark.createDataFrame([(1, 0, None), (5, 2, True), (1, 4, False)], "n long, d long, b boolean")
    assert [r[0] for r in rows(df.select(expr.ratio(F.col("n"), F.col("d"))))] == [0.0, 1.0, 0.25]
    assert [r[0] for r in rows(df.select(expr.is_true(F.col("b"))))] == [False, True, False]


def test_search_context(spark, tmp_path):
    """Each message is cut, none is lost; replies to calls on the aspect follow, others do not."""
    from tracksmith.plans import catalog

    said = [(1, 0, "user", "x" * 2000, None), (1, 1, "assistant", "call", "a"), (1, 2, "tool", "é" * 1700, None), (1, 3, "assistant", "call", "b"), (1, 4, "tool", "other", None), (1, 5, "tool", "late", None), (1, 6, "user", "last", None), (1, 7, "user", "", None), (2, 0, "assistant", "call", "a"), (2, 1, "tool", None, None)]
    m = spark.createDataFrame(said, "conv_id long, turn long, role string, text string, about string")
    got = rows(transcripts.search_context(m, "conv_id", "turn", "role", "text", F.col("about"), F.lit("a")), "conv_id")
    assert got == [(1, ["x" * 1600, "last", "é" * 1600]), (2, [])]
    m.drop("about").write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows(catalog.QUERIES["x_18"](spark, str(tmp_path)), "conv_id") == [(1, "x" * 1600 + "\nlast"), (2, None)]


def test_largest_remainder(spark):
    """400 of 716 by integer remainders; a target beyond the rows is an error."""
    train = {"22": 153, "2222": 27, "233": 92, "33": 133, "333": 81, "334": 71, "44": 101, "444": 58}
    strata = spark.createDataFrame(list(train.items()), "stratum string, n long")
    quotas = dict(rows(splits.largest_remainder(strata, 400)))
    total = sum(train.values())
    floors = {k: 400 * n // total for k, n in train.items()}
    left = 400 - sum(floors.values())
    for k in sorted(train, key=lambda k: (-(400 * train[k] % total), k))[:left]:
        floors[k] += 1
    assert quotas == floors and sum(quotas.values()) == 400
    with pytest.raises(Exception, match="exceeds"):
        splits.largest_remainder(strata, 10_000).collect()


def test_capped_remainder_goes_round(spark):
    strata = spark.createDataFrame([("a", 10, 1), ("b", 10, 10), ("c", 10, 3)], "stratum string, n long, capacity long")
    assert dict(rows(splits.capped_remainder(strata, 12))) == {"a": 1, "b": 8, "c": 3}


def test_next_wave_equals_greedy(spark):
    rng = random.Random(4)
    for wave in (1, 5, 17):
        state = [(f"s{k}", rng.randint(0, 12), rng.randint(0, 6), rng.randint(0, 12)) for k in range(6)]
        capacity = {s: min(max(0, q - a), u) for s, q, a, u in state}
        seats = dict.fromkeys(capacity, 0)
        for _ in range(min(wave, sum(capacity.values()))):
            s = max((s for s in capacity if seats[s] < capacity[s]), key=lambda s: (capacity[s] / (seats[s] + 1), capacity[s], s))
            seats[s] += 1
        assert dict(rows(splits.next_wave(spark.createDataFrame(state, "stratum string, quota long, accepted long, untried long"), wave))) == seats


def test_hash_rank_equals_window(spark):
    df = splits.keyed(spark.range(3000).select(F.col("id").cast("string").alias("t"), (F.col("id") % 3).alias("s")), "t", "seed")
    got = {r["t"]: r["rank"] for r in splits.hash_rank(df, ["s"], "key", "t").collect()}
    plain = sorted((r["s"], r["key"], r["t"]) for r in df.collect())
    want, before = {}, {}
    for s, _, t in plain:
        before[s] = want[t] = before.get(s, 0) + 1
    assert got == want


def test_summary_counts_missing_and_invalid_as_zero(spark):
    expected = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "t string, c string")
    results = spark.createDataFrame([("1", True, 0.5), ("2", False, 0.9), ("9", True, 1.0)], "t string, valid boolean, m double")
    got = {r[0]: tuple(r)[1:] for r in evaluation.summary(expected, results, "t", "c", ["m"]).collect()}
    assert got == {"a": (2, 2, 1, 0.25, 0.5), "b": (1, 0, 0, 0.0, 0.0), None: (3, 2, 1, pytest.approx(0.5 / 3), 0.5)}


def test_checkpoint_ties_take_the_lower_step(spark):
    c = spark.createDataFrame([(50, 1.0, 0.5, 0.5, 0.5, 0.5), (100, 1.0, 0.5, 0.5, 0.5, 0.5), (150, 0.9, 0.9, 0.9, 0.9, 0.9)], "step int, valid_rate double, terminal double, correct double, aligned double, efficiency double")
    got = {r["step"]: (r["rejections"], r["selected"]) for r in evaluation.select_checkpoint(c, {"terminal": 0.4}).collect()}
    assert got == {50: ("", True), 100: ("", False), 150: ("valid_rate", False)}


BASE = {"aspects": 2, "correct": 2, "searched": 2, "quality_sum": 2.0, "preferences": 4, "n_active": 4, "n_passive": 0, "successes": 0, "opportunities": 0, "steps": 8, "attempts": None, "guard_rejections": 0, "invalid_actions": 0, "exact_repeats": 0, "semantic_repeats": 0, "blocked_aspects": 0, "ambiguous_actions": 0, "unsearched_answers": 0, "wrong_answers": 0, "parallel_tool_calls": False, "no_tool_output": False, "max_steps_reached": False, "reward_valid": True}


@pytest.mark.parametrize(("change", "want"), [({}, 1.0), ({"reward_valid": False}, 0.0), ({"reward_valid": None}, 0.0), ({"guard_rejections": 4, "attempts": 12}, (3.4 - 0.08 - 0.02 * (1 - 11 / 12)) / 3.4), ({"invalid_actions": 400}, 3.37 / 3.4), ({"correct": 0, "quality_sum": 0.0}, 0.36 / 3.4)])
def test_reward(spark, change, want):
    given = BASE | change
    schema = ", ".join(f"{k} {'boolean' if k in ('parallel_tool_calls', 'no_tool_output', 'max_steps_reached', 'reward_valid') else 'double' if k == 'quality_sum' else 'long'}" for k in given)
    assert reward.reward(spark.createDataFrame([tuple(given.values())], schema)).first()["terminal_reward"] == pytest.approx(want)


FLAGS = "field_resolved normal_candidates answer_visible correct_answer wrong_answer exact_query_repeat wrong_aspect invisible_answer_id malformed_tool_call no_tool_output semantic_repeat no_progress_action guard_rejected infrastructure_failure".split()


def turn(n, choice, *flags, aspect="hotel", valid=True):
    return (1, n, aspect, choice, valid, *[f in flags for f in FLAGS])


def evidence_of(spark, *turns):
    df = spark.createDataFrame(list(turns), "trajectory long, turn long, aspect string, choice string, reward_valid boolean, " + ", ".join(f"{f} boolean" for f in FLAGS))
    return [r["evidence"] for r in credit.evidence(df).orderBy("turn").collect()]


def test_evidence_of_a_completed_chain(spark):
    got = evidence_of(spark, turn(0, "action", "field_resolved"), turn(1, "action", "field_resolved"), turn(2, "search", "normal_candidates"), turn(3, "answer", "answer_visible", "correct_answer"))
    assert got == pytest.approx([0.1, 0.1, 0.45, 0.35])


def test_evidence_blames_a_cause_once(spark):
    got = evidence_of(spark, turn(0, "action", "semantic_repeat", "guard_rejected"), turn(1, "action", "semantic_repeat"), turn(2, "action", "semantic_repeat", aspect="flight"), turn(3, "search", "infrastructure_failure", "wrong_aspect"), turn(4, "search", "wrong_aspect", "semantic_repeat"), turn(5, "action", "guard_rejected"))
    assert got == pytest.approx([-0.1, 0, -0.1, 0, -0.2, -0.15])


def test_partial_evidence_is_capped(spark):
    got = evidence_of(spark, *[turn(k, "action", "field_resolved") for k in range(4)], turn(4, "search", "normal_candidates"), turn(5, "answer", "answer_visible"))
    assert got == pytest.approx([0.05, 0.05, 0, 0, 0.2, 0.05])
    assert evidence_of(spark, turn(0, "search", "normal_candidates", valid=False)) == [0.0]


def test_reshape_conserves_the_mean(spark):
    df = spark.createDataFrame([(1, 0.6, 0.3, 5), (1, 0.6, -0.2, 3), (1, 0.6, 0.0, 2), (2, -0.4, -0.2, 1), (2, -0.4, 0.1, 4), (3, 0.0, 0.5, 1)], "t long, a double, e double, n long")
    out = credit.reshape(df, "t", "a", "e", "n")
    means = dict(rows(out.groupBy("t").agg(F.sum(F.col("turn_advantage") * F.col("n")) / F.sum("n"))))
    assert means == pytest.approx({1: 0.6, 2: -0.4, 3: 0.0})


def test_group_status_and_subset(spark):
    df = spark.createDataFrame([(1, k, r, i, g) for k, (r, i, g) in enumerate([(0.0, False, True), (0.5, False, False), (0.5, False, False), (1.0, False, False), (0.2, True, False)])] + [(2, 0, 1.0, False, False), (2, 1, 1.0, False, False)], "uid long, row long, reward double, invalid boolean, degraded boolean")
    # A group counts only with the expected number of rows, no more and no fewer.
    assert rows(groups.classify(df, "uid", 2), "uid") == [(1, 5, 1, "incomplete"), (2, 2, 0, "constant")]
    assert rows(groups.classify(df, "uid", 5), "uid") == [(1, 5, 1, "sampling_invalid"), (2, 2, 0, "incomplete")]
    assert rows(groups.best_subset(df.where("NOT invalid"), "uid", "row", 3), "uid") == [(1, 0.5, 2, "1,2,3")]


def random_turns(seed, n=400):
    rng = random.Random(seed)
    kinds = [("action", "none"), ("action", "progress"), ("search", "normal"), ("search", "fallback"), ("answer", "visible"), ("answer", "hidden")]
    return [(t, k, *rng.choice(kinds)) for t in range(20) for k in range(rng.randint(1, n // 20))]


def test_replay_equals_plain_fold(spark):
    turns = random_turns(3)
    got = {r["trajectory"]: tuple(r)[2:] for r in control.replay(spark.createDataFrame(turns, "trajectory long, turn long, choice string, outcome string"), "trajectory", "turn").collect()}
    want = {}
    for t, _, choice, outcome in turns:
        want[t] = stream.step(want.get(t, (control.ELICIT, 0, 0, 0, 0, 0, 0, 0, 0)), choice, outcome)
    assert got == {t: s[:-1] for t, s in want.items()}


def test_streaming_replay_equals_batch(spark, tmp_path):
    turns = random_turns(5)
    schema = "trajectory long, turn long, choice string, outcome string"
    for part in range(3):  # later turns come in later files
        spark.createDataFrame([x for x in turns if min(x[1] // 7, 2) == part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = stream.replay(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")).trigger(availableNow=True).start()
        query.awaitTermination()
    latest = {}
    for n in range(3):
        for r in spark.read.parquet(f"{tmp_path}/out/{n}").collect():
            latest[r["trajectory"]] = tuple(r)[1:-1]
    batch = control.replay(spark.createDataFrame(turns, schema), "trajectory", "turn").collect()
    assert latest == {r["trajectory"]: tuple(r)[2:] for r in batch}


def test_streaming_groups_come_out_once(spark, tmp_path):
    schema = "uid long, reward double, invalid boolean"
    for part in ([(1, 0.0, False), (2, 1.0, False), (3, 0.0, True)], [(1, 1.0, False), (2, 1.0, False), (3, 1.0, False)], [(1, 0.5, False)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.ready_groups(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 2).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.schema("uid long, n long, spread double").parquet(f"{tmp_path}/out")) == [(1, 2, 1.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nnot json\n[1]\n{"x": 2}\n')
    lines = tables.json_lines(spark, str(tmp_path / "a.jsonl"))
    got = [(r["line"], r["problem"], r["record"] and r["record"]["x"]) for r in tables.tolerant(lines, "x long").orderBy("line").collect()]
    assert got == [(1, None, 1), (3, "invalid_json", None), (4, "record_not_mapping", None), (5, None, 2)]
    df = spark.createDataFrame([(1, "gold", None), (2, "silver", "b")], "id long, tier string, note string")
    tables.write_tiers(df, str(tmp_path / "tiers"), "tier")
    assert rows(spark.read.parquet(str(tmp_path / "tiers")).select("id", "tier"), "id") == [(1, "gold"), (2, "silver")]
    tables.write_parquet(df, str(tmp_path / "p"))
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_parquet(df, str(tmp_path / "p"))
    with pytest.raises(ValueError, match="columns"):
        tables.parquet(spark, str(tmp_path / "p"), ["id"])
    tables.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"id":1,"tier":"gold","note":null}', '{"id":2,"tier":"silver","note":"b"}']
    assert tables.file_digests(spark, str(tmp_path), "a.jsonl").count() == 1
    assert "| 1 | gold | None |" in tables.markdown(df, "T")
    (tmp_path / "d").mkdir()
    for k in (1, 2):
        (tmp_path / "d" / f"{k}.json").write_text('{"id": %d,\n "v": "x"}' % k)
    assert tables.json_directory(spark, str(tmp_path / "d"), "id long, v string", "id").count() == 2
    (tmp_path / "d" / "3.json").write_text('{"id": 1}')
    with pytest.raises(ValueError, match="more than one"):
        tables.json_directory(spark, str(tmp_path / "d"), "id long, v string", "id")
    assert [r["kind"] for r in tables.discover(spark, str(tmp_path / "d"), "*.json", {"1%": "one"}).collect()] == ["one", "other", "other"]


def test_entry_works_without_the_llm_subpackage(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "a_1" in __spark_entry__.queries() and not any(k.startswith("op") for k in __spark_entry__.queries())


def test_aligned_replay_against_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(t, n, rng.choice([None, None, 0, 1, 2, 7]), rng.random() < 0.4, rng.random() < 0.95) for t in range(60) for n in range(rng.randint(1, 9))]
    expected = {}
    for t in range(60):
        current, closed, ok = 0, set(), True
        for _, _, named, closes, feedback in sorted((r for r in rows if r[0] == t), key=lambda r: r[1]):
            left = [a for a in range(3) if a not in closed]
            if current in closed and left:
                current = next((a for a in left if a > current), left[0])
            if named in left:
                current = named
            if not feedback:
                ok = False
            elif closes:
                closed.add(current)
        expected[t] = (current, ",".join(map(str, sorted(closed))), ok)
    frame = spark.createDataFrame(rows, "trajectory int, turn int, named int, closes boolean, feedback boolean").repartition(3)
    got = {r["trajectory"]: (r["current"], r["closed"], r["ok"]) for r in recovery.aligned_replay(frame, "trajectory", "turn", 3).collect()}
    assert got == expected


def test_partial_counts_against_all_choices():
    import itertools

    for sizes in ([2, 3], [4, 4, 3], [2, 3, 4, 6]):
        aspects = {f"t{i}": n for i, n in enumerate(sizes)}
        totals = {sum(k * 12 // n for k, n in zip(ks, sizes, strict=True)) for ks in itertools.product(*(range(1, n) for n in sizes))}
        for target in range(0, 50):
            best, counts = recovery.partial_counts(aspects, target)
            assert best == min(totals, key=lambda x: (abs(x - target), x))
            assert sum(counts[t] * 12 // n for t, n in aspects.items()) == best and all(0 < counts[t] < n for t, n in aspects.items())
    with pytest.raises(ValueError):
        recovery.partial_counts({"one": 1}, 3)


def test_messages_and_options(spark):
    rows = [("assistant", "x", None, None, "assistant", "x", None, None, True), ("assistant", "x", "f", "{", "assistant", "x", "f", "{", False), ("user", None, None, None, "user", "", "f", "{}", True), ("assistant", "x", "f", "{}", "assistant", "x", None, None, False)]
    df = spark.createDataFrame(rows, "r string, c string, n string, a string, s string, d string, m string, b string, want boolean")
    side = lambda *names: F.struct(*[F.col(x).alias(y) for x, y in zip(names, ("role", "content", "name", "arguments"), strict=True)])
    assert all(r["got"] == r["want"] for r in df.select("want", recovery.same_message(side("r", "c", "n", "a"), side("s", "d", "m", "b")).alias("got")).collect())
    texts = spark.createDataFrame([(1, None), (2, "{"), (3, '{"id": 5} [{"id": "H1", "in": {"id": "H2"}}] {"id": "H1", "z": 1}')], "k long, t string")
    found = [(r["key"], r["ord"], r["option"], r["detail"]) for r in recovery.option_details(texts, "k", "t", "H").collect()]
    assert found == [(3, 0, "H1", '{"id":"H1","in":{"id":"H2"}}'), (3, 1, "H2", '{"id":"H2"}')]
