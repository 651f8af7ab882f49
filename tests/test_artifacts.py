"""Canonical messages, prefix contexts, token examples, digests and manifests: cases and brute force."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tracksmith.operators import contexts, digests


def call(arguments, name="interact_with_env", **more):
    return {"function": {"name": name, "arguments": arguments}, **more}


GOOD = {"thought": "t", "choice": "action", "content": "say \"hé\"\n"}


def canonical(spark, messages):
    r = contexts.canonical(spark.createDataFrame([(1, json.dumps(messages, ensure_ascii=False))], "k long, m string"), "k", "m").first()
    return json.loads(r["messages"]), r["dropped"]


def test_canonical_messages(spark):
    given = [
        {"role": "system", "content": "s", "hidden": {"a": 1}}, {"role": "developer", "content": "no"}, {"content": "no role"},
        {"role": "assistant", "content": None, "tool_calls": [call(json.dumps(GOOD), id="c1", type="x"), call({**GOOD, "more": 1}), call("{", id="c2"), call(json.dumps({**GOOD, "choice": 3})), call(json.dumps([GOOD])), call({}, "other"), {"id": "c3"}]},
        {"role": "tool", "content": "r", "name": "n", "tool_call_id": "c1", "tool_calls": [call(GOOD)]}, {"role": "user", "content": "u", "name": "n"}]
    compact = json.dumps(GOOD, ensure_ascii=False, separators=(",", ":"))
    kept = [{"id": i, "type": "function", "function": {"name": "interact_with_env", "arguments": compact}} for i in ("c1", "offline-call")]
    messages, dropped = canonical(spark, given)
    assert messages == [{"role": "system", "content": "s"}, {"role": "assistant", "tool_calls": kept}, {"role": "tool", "content": "r", "name": "n", "tool_call_id": "c1"}, {"role": "user", "content": "u"}]
    assert dropped == "unknown_role,unknown_role,arguments_not_json,wrong_parameters,arguments_no_object,other_name,no_function"


TALK = "k long, turn long, role string, text string"


def talks(spark):
    draw = random.Random(4)
    rows = [(k, t, ("user", "assistant", "tool")[t % 3], "same" if t < 3 else draw.choice(["x", "y", None])) for k in range(8) for t in range(6 + k % 3)]
    return rows, spark.createDataFrame(rows, TALK).repartition(3)


def test_contexts_are_kept_once_and_rebuilt(spark):
    rows, df = talks(spark)
    chained = contexts.prefixes(df, "k", "turn", "role", "text")
    by = {(r["k"], r["turn"]): r for r in chained.collect()}
    for k, turn, role, text in rows:
        assert by[k, turn]["before"] == (by[k, turn - 1]["through"] if turn else "")
        assert by[k, turn]["through"] == hashlib.sha256(f"{by[k, turn]['before']}\0{role}\0{text or ''}".encode()).hexdigest()
    table = contexts.contexts(chained, "role", "text")
    whole = {tuple((r, x or "") for kk, t, r, x in rows if kk == k and t <= turn) for k, turn, *_ in rows}
    assert table.count() == len(whole) < len(rows)
    wanted = contexts.events(chained, "k", "turn", "role", "text").select("k", "turn", "feedback", F.col("through").alias("context"))
    found = {r["context"]: r["messages"] for r in contexts.rebuilt(table, wanted, "role", "text", 9).collect()}
    for r in wanted.collect():
        last = r["turn"] + (r["feedback"] is not None)
        assert found[r["context"]] == [f"{role}: {text or ''}" for k, t, role, text in rows if k == r["k"] and t <= last]


def test_token_examples(spark):
    rows, df = talks(spark)
    encode = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    made = contexts.token_examples(df, "k", "turn", "role", "text", encode, 150, F.col("turn") == 4)
    seen = {(r["k"], r["turn"]): r for r in made.collect()}
    for k in range(8):
        own = [r for r in rows if r[0] == k]
        whole = "".join(f"<|{r}|>{x or ''}<|end|>" for _, _, r, x in own)
        turns = [t for _, t, r, _ in own if r == "assistant" and t != 4]
        long = any(len("".join(f"<|{r}|>{x or ''}<|end|>" for _, u, r, x in own if u <= t)) > 150 for t in turns)
        for t in turns:
            r = seen.pop((k, t))
            if long:
                assert (r["problem"], r["input_ids"], r["labels"]) == ("trajectory_too_long", None, None)
                continue
            prompt = "".join(f"<|{x}|>{y or ''}<|end|>" for _, u, x, y in own if u < t) + "<|assistant|>"
            full = "".join(f"<|{x}|>{y or ''}<|end|>" for _, u, x, y in own if u <= t)
            assert whole.startswith(full) and r["input_ids"] == [ord(c) for c in full]
            assert r["labels"] == [-100] * len(prompt) + [ord(c) for c in full[len(prompt) :]]
    assert not seen


def test_examples_whose_prompt_is_no_prefix(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], TALK)
    merged = lambda c: F.transform(F.split(F.regexp_replace(c, r">b", "B"), ""), lambda x: F.ascii(x))
    nothing = lambda c: F.transform(F.split(F.substring_index(c, "|>b", 1), ""), lambda x: F.ascii(x))
    assert contexts.token_examples(df, "k", "turn", "role", "text", merged, 99).first()["problem"] == "prefix_mismatch"
    assert contexts.token_examples(df, "k", "turn", "role", "text", nothing, 99).first()["problem"] in ("prefix_mismatch", "no_supervised_tokens")
    same = lambda c: F.array(F.lit(1))
    assert contexts.token_examples(df, "k", "turn", "role", "text", same, 99).first()["problem"] == "no_supervised_tokens"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(texts, fanout, levels):
    nodes = [sha(t or "") for t in texts]
    for _ in range(levels):
        nodes = [sha("\n".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
    assert len(nodes) == 1
    return nodes[0]


def test_tree_digest_is_true_to_order_in_any_layout(spark):
    rows = [(g, k, None if k % 7 == 0 else f"{g}{k}") for g, n in (("a", 50), (None, 3)) for k in range(n)]
    want = {g: (n, tree([x for h, _, x in rows if h == g], 4, 3)) for g, n in (("a", 50), (None, 3))}
    for parts in (1, 5):
        df = spark.createDataFrame(rows[::-1], "g string, k long, x string").repartition(parts)
        found = {r["g"]: (r["rows"], r["digest"]) for r in digests.tree_digest(df, ["g"], ["k"], F.col("x"), fanout=4).collect()}
        assert found == want
    swapped = spark.createDataFrame([(g, 1 if k == 2 else 2 if k == 1 else k, x) for g, k, x in rows], "g string, k long, x string")
    assert {r["g"]: r["digest"] for r in digests.tree_digest(swapped, ["g"], ["k"], F.col("x"), fanout=4).collect()}["a"] != want["a"][1]
    assert digests.tree_digest(swapped.limit(0), ["g"], ["k"], F.col("x")).collect() == []


def test_artifacts_are_held_to_their_manifest(spark):
    df = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "k long, v string")
    manifest = digests.manifest_of(df, ["k"], "rows")
    checks = lambda m, other: {(r["artifact"], r["check"]): r["ok"] for r in digests.verify(m, {"copy": other}).collect()}
    assert all(checks(manifest, df.repartition(5)).values())
    assert checks(manifest, df.where("k < 19")) == {("manifest", "fields"): True, ("copy", "columns"): True, ("copy", "rows"): False, ("copy", "digest"): False}
    assert not checks(manifest, df.withColumn("v", F.upper("v")))["copy", "digest"]
    assert not checks({k: v for k, v in manifest.items() if k != "rows"}, df)["manifest", "fields"]


def test_a_changed_part_file_is_found(spark, tmp_path):
    df = spark.range(40).repartition(4, "id")
    for name in ("run", "other"):
        digests.write_run(df, str(tmp_path / name), {"finished": True})
    assert digests.read_run(spark, str(tmp_path / "run")).count() == 40
    files = sorted((tmp_path / "run" / "data").glob("part-*.parquet"))
    changed, gone = files[0], files[1]
    spark.range(100, 105).coalesce(1).write.parquet(str(tmp_path / "bad"))
    (bad,) = (tmp_path / "bad").glob("part-*.parquet")
    (added := changed.with_name("part-99999-new.parquet")).write_bytes(bad.read_bytes())
    for f, raw in ((changed, bad.read_bytes()),):
        f.write_bytes(raw)
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    gone.unlink()
    found = {r["file"]: r["status"] for r in digests.check_run(spark, str(tmp_path / "run")).collect()}
    assert (found[changed.name], found[gone.name], found[added.name]) == ("changed", "missing", "added") and sorted(found.values()).count("same") == 2
    with pytest.raises(ValueError, match="differ"):
        digests.read_run(spark, str(tmp_path / "run"))


def test_a_run_is_complete_if_all_expected_are_valid(spark, tmp_path):
    expected = spark.createDataFrame([("a",), ("b",)], "k string")
    def state(name, rows, flags):
        digests.write_run(spark.createDataFrame(rows, "k string, ok boolean").coalesce(1), str(tmp_path / name), flags)
        return digests.complete(spark, str(tmp_path / name), expected, "k", "ok").first()

    assert state("whole", [("a", True), ("b", True)], {"x": True})["complete"]
    assert state("no flags", [("a", True), ("b", True)], {})["complete"]
    for name, rows, flags in (("flag", [("a", True), ("b", True)], {"x": False}), ("less", [("a", True)], {}), ("invalid", [("a", True), ("b", None)], {}), ("unknown", [("a", True), ("b", True), ("c", True)], {}), ("twice", [("a", True), ("a", True), ("b", True)], {})):
        assert not state(name, rows, flags)["complete"]


def test_json_that_is_nested_deeper_than_the_parser_goes(spark):
    from tracksmith.operators import contracts, recovery

    deep = '{"a":' * 100_000 + "1" + "}" * 100_000
    rows = spark.createDataFrame([(1, deep), (2, '{"x":[{"secret":{"secret":1}}],"secret":2}'), (3, "[" * 3000 + '{"secret":1}' + "]" * 3000), (4, None)], "k long, j string")
    found = [tuple(r) for r in contracts.hidden_paths(rows, "k", "j", ["secret"]).where("key = 2").collect()]
    assert found == [(2, "$.x[0].secret"), (2, "$.x[0].secret.secret"), (2, "$.secret")]
    assert contracts.hidden_paths(rows, "k", "j", ["secret"]).where("key = 4").count() == 0
    text = spark.createDataFrame([(1, "[" * 5000 + ' {"id":"H1","cost":3}')], "k long, t string")
    assert [r["option"] for r in recovery.option_details(text, "k", "t", "H").collect()] == ["H1"]


def test_dumps_of_other_tasks_are_refused(spark):
    from tracksmith.operators import evaluation

    tasks = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "task_id string, composition string")
    dump = lambda *ids: spark.createDataFrame([(i, k == 0, None, 0.5) for k, i in enumerate(ids)], "task_id string, reward_valid boolean, terminal double, score double")
    problems = lambda *ids: sorted(tuple(r) for r in evaluation.dump_problems(tasks, dump(*ids), "task_id", 3).collect())
    assert problems("a", "b") == []
    assert problems("a", "a", "z", None) == [("repeated_result", "a", 2), ("unknown_task", "", 1), ("unknown_task", "z", 1)]
    assert [tuple(r) for r in evaluation.dump_problems(tasks, dump("a"), "task_id", 132).collect()] == [("wrong_size", None, 3)]
    with pytest.raises(ValueError, match="repeated_result"):
        evaluation.dump_results(tasks, dump("a", "a"), "task_id", "composition", {"terminal": "score"})
    got = {r["task_id"]: (r["composition"], r["valid"], r["terminal"], r["guard_rejections"]) for r in evaluation.dump_results(tasks, dump("a", "b"), "task_id", "composition", {"terminal": "score"}).collect()}
    assert got == {"a": ("x", True, 0.5, 0), "b": ("y", False, 0.5, 0)}


def test_stored_summaries_are_held_to_recomputed_ones(spark):
    from tracksmith.operators import evaluation

    schema = "k string, n long, m double, only_here long"
    old = spark.createDataFrame([("a", 1, 0.5, 1), (None, 2, None, 1), ("gone", 3, 1.0, 1)], schema)
    new = spark.createDataFrame([("a", 1, 0.5 + 1e-12), (None, 2, 0.1)], "k string, n long, m double")
    found = {(r["k"], r["metric"]): r["same"] for r in evaluation.consistency(old, new, ["k"]).collect()}
    assert found == {("a", "n"): True, ("a", "m"): True, (None, "n"): True, (None, "m"): False, ("gone", "n"): False, ("gone", "m"): False}


def test_visible_options_of_aspects_without_an_answer(spark):
    from tracksmith.operators import rollouts

    rows = [(1, 0, "search", "hotel", "H1, H2 xF9 and F3; F3"), (1, 1, "action", "ask", "R1"), (1, 2, "search", "flight", "F3 A4"), (1, 3, "answer", "H7", "ok"), (2, 0, "search", None, None)]
    found = rollouts.visible_options(spark.createDataFrame(rows, "k long, turn long, choice string, content string, feedback string"), "k", "turn", "choice", "content", "feedback")
    assert sorted(map(tuple, found.collect())) == [(1, "A4", "apartment", 2), (1, "F3", "flight", 0)]
