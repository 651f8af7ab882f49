"""Registered queries: canonical messages, prefix contexts, token examples, digests and manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracksmith.operators import contexts, control, digests, evaluation, public_control, rollouts
from tracksmith.plans.bind import RESULTS, TASKS, TURNS, read, results, tasks
from tracksmith.plans.splits_queries import query
from tracksmith.plans.trajectory_queries import SIGNED, signed, talk
from tracksmith.sources import tables

# Messages: an event is a conversation with one call, by its number whole, with an object, or with one of five faults.

_GOOD = '"arguments":"{\\"thought\\":\\"t\\",\\"choice\\":\\"search\\",\\"content\\":\\"q'
_CALL = f"""CASE event_id % 7 WHEN 0 THEN '{{"id":"c1","function":{{"name":"interact_with_env",{_GOOD}' || event_id || '\\",\\"more\\":1}}"}}}}' WHEN 1 THEN '{{"function":{{"name":"interact_with_env","arguments":{{"content":"q' || event_id || '","thought":"t","choice":"search"}}}}}}'
  WHEN 2 THEN '{{"function":{{"name":"other","arguments":"{{}}"}}}}' WHEN 3 THEN '{{"function":{{"name":"interact_with_env","arguments":"not json"}}}}' WHEN 4 THEN '{{"function":{{"name":"interact_with_env","arguments":"[1]"}}}}' WHEN 5 THEN '{{"function":{{"name":"interact_with_env","arguments":"{{\\"thought\\":1,\\"choice\\":\\"a\\",\\"content\\":\\"b\\"}}"}}}}' ELSE '{{"id":"c2"}}' END"""
_MESSAGES = f"""'[{{"role":"user","content":"u' || event_id || '","secret":1}},{{"role":"assistant","content":null,"loss":2,"tool_calls":[' || {_CALL} || ']}},{{"role":"tool","content":"t","name":"n","tool_call_id":"","x":{{"y":3}}}},{{"role":"critic","content":"no"}}]'"""
_KEPT = f"""'[{{"role":"user","content":"u' || event_id || '"}},{{"role":"assistant"' || CASE WHEN event_id % 7 < 2 THEN ',"tool_calls":[{{"id":"' || CASE event_id % 7 WHEN 0 THEN 'c1' ELSE 'offline-call' END || '","type":"function","function":{{"name":"interact_with_env",{_GOOD}' || event_id || '\\"}}"}}}}]' ELSE '' END || '}},{{"role":"tool","content":"t","name":"n"}}]'"""


def _spark(sql: str) -> str:
    """The same literals in Spark's SQL, which unescapes them."""
    return sql.replace("\\", "\\\\")


@query("t_1_calls", f"SELECT event_id, {_KEPT} AS messages, array_to_string(list_filter([CASE event_id % 7 WHEN 2 THEN 'other_name' WHEN 3 THEN 'arguments_not_json' WHEN 4 THEN 'arguments_no_object' WHEN 5 THEN 'wrong_parameters' WHEN 6 THEN 'no_function' END, 'unknown_role'], lambda x: x IS NOT NULL), ',') AS dropped FROM events")
def _(spark, d):
    return contexts.canonical(read(spark, d, "events").select("event_id", F.expr(_spark(_MESSAGES)).alias("messages")), "event_id", "messages")


_CHAIN = """m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
  h AS (SELECT conv_id, turn, role, text, k, '' AS before, sha256(chr(0) || role || chr(0) || text) AS through FROM m WHERE k = 1 UNION ALL SELECT m.conv_id, m.turn, m.role, m.text, m.k, h.through, sha256(h.through || chr(0) || m.role || chr(0) || m.text) FROM h JOIN m ON m.conv_id = h.conv_id AND m.k = h.k + 1)"""


def chained(spark, d):
    return contexts.prefixes(read(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("t_3_events", f"WITH RECURSIVE {_CHAIN} SELECT conv_id, turn, text AS action, CASE WHEN r = 'user' THEN t END AS feedback, before, CASE WHEN r = 'user' THEN x ELSE through END AS through FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS t, lead(through) OVER w AS x FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant'")
def _(spark, d):
    return contexts.events(chained(spark, d), "conv_id", "turn", "role", "text", answer="user")


@query("t_3_contexts", f"WITH RECURSIVE {_CHAIN} SELECT through AS context, any_value(before) AS parent, any_value(role) AS role, any_value(text) AS text, count(*) AS uses FROM h GROUP BY 1")
def _(spark, d):
    return contexts.contexts(chained(spark, d), "role", "text")


@query("f_5_contexts", f"""WITH RECURSIVE {SIGNED}, m AS (SELECT *, row_number() OVER (PARTITION BY trajectory, signature ORDER BY turn) > 1 AS seen, choice = 'search' AND outcome <> 'normal' AS failed, count(*) FILTER (choice = 'search' AND outcome <> 'normal') OVER w AS k, lag(choice = 'search' AND outcome = 'normal') OVER w AS b FROM signed WINDOW w AS (PARTITION BY trajectory ORDER BY turn)),
  l AS (SELECT *, 'repeated' AS label FROM m WHERE seen UNION ALL SELECT *, 'first_fallback' FROM m WHERE failed AND k = 1 UNION ALL SELECT *, 'second_fallback' FROM m WHERE failed AND k = 2 UNION ALL SELECT *, 'search_to_answer' FROM m WHERE b AND choice = 'answer'),
  h AS (SELECT trajectory, turn, '' AS before, sha256(chr(0) || choice || chr(0) || signature) AS through FROM m WHERE turn = 0 UNION ALL SELECT m.trajectory, m.turn, h.through, sha256(h.through || chr(0) || m.choice || chr(0) || m.signature) FROM h JOIN m ON m.trajectory = h.trajectory AND m.turn = h.turn + 1)
  SELECT trajectory, turn, label, CASE WHEN label LIKE '%fallback' THEN 'after' ELSE 'before' END AS side, CASE WHEN label LIKE '%fallback' THEN k ELSE k - failed::INT END AS failures, CASE WHEN label LIKE '%fallback' THEN through ELSE before END AS context, 'events' AS source FROM l JOIN h USING (trajectory, turn)""")
def _(spark, d):
    s = signed(spark, d)
    failed = (F.col("choice") == "search") & (F.col("outcome") != "normal")
    n = F.count_if(failed).over(Window.partitionBy("trajectory").orderBy("turn"))
    states = s.select("trajectory", "turn", n.alias("failures"), (n - failed.cast("int")).alias("failures_before"))
    chain = contexts.prefixes(s, "trajectory", "turn", "choice", "signature")
    labels = control.boundaries(s, "trajectory", "turn", "signature")
    return contexts.placed_labels(labels, chain, states, "trajectory", "turn", F.lit("events"), {"first_fallback": "after", "second_fallback": "after"})


@query("f_1_live")
def _(spark, d):
    k = F.col("turn") % 9
    kind = F.when(k == 3, "observation").when(k == 5, "no_progress").when(k == 7, "complete").otherwise("call")
    return public_control.live(talk(spark, d).select("trajectory", F.col("turn").alias("at"), kind.alias("kind"), "choice", "content", "feedback", F.lit(None).cast("string").alias("aspect"), "message"))


@query("x_11_options", f"""WITH {TURNS}, t AS (SELECT trajectory * 1000 + turn // 8 AS trajectory, turn, choice, outcome, bucket FROM turns), s AS (SELECT trajectory, unnest(['H1', 'H2', 'H3', 'F1', 'F2']) AS option, first_turn FROM (SELECT trajectory, min(turn) AS first_turn FROM t WHERE choice = 'search' AND outcome = 'normal' GROUP BY 1)), a AS (SELECT DISTINCT trajectory, CASE WHEN abs(bucket) % 2 = 0 THEN 'H' ELSE 'F' END AS l FROM t WHERE choice = 'answer' AND bucket >= 0)
  SELECT trajectory, option, CASE option[1] WHEN 'H' THEN 'hotel' ELSE 'flight' END AS aspect, first_turn FROM s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.trajectory = s.trajectory AND l = option[1])""")
def _(spark, d):
    eights = talk(spark, d).withColumn("trajectory", F.expr("trajectory * 1000 + turn DIV 8"))  # eight turns in a row are a session
    return rollouts.visible_options(eights, "trajectory", "turn", "choice", "content", "feedback")


# Token examples: a stand-in tokeniser, a number a word.

_IDS = "list_transform(list_filter(string_split({}, ' '), lambda x: x <> ''), lambda x: 1000 * unicode(x) + length(x))"


def words(text):
    return F.transform(F.filter(F.split(text, " "), lambda x: x != ""), lambda x: (1000 * F.ascii(x) + F.length(x)).cast("int"))


@query("g_6_tokens", f"""WITH m AS (SELECT conv_id, turn, role, '<|' || role || '|> ' || coalesce(text, '') || ' <|end|> ' AS one FROM conversations), p AS (SELECT *, coalesce(string_agg(one, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS c, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM m),
  e AS (SELECT conv_id, turn, number, {_IDS.format("c || '<|assistant|> '")} AS p, {_IDS.format("c || one")} AS w FROM p WHERE role = 'assistant' AND turn % 5 <> 3), x AS (SELECT *, max(len(w)) OVER (PARTITION BY conv_id) > 400 AS long FROM e)
  SELECT conv_id, turn, number, CASE WHEN NOT long THEN array_to_string(w, ' ') END AS input_ids, CASE WHEN NOT long THEN array_to_string(list_concat(list_transform(p, lambda x: -100), w[len(p) + 1:]), ' ') END AS labels, CASE WHEN long THEN 'trajectory_too_long' END AS problem FROM x""")
def _(spark, d):
    c = read(spark, d, "conversations")
    made = contexts.token_examples(c, "conv_id", "turn", "role", "text", words, 400, F.col("turn") % 5 == 3, "<|{}|> ", " <|end|> ")
    joined = lambda x: F.array_join(F.col(x).cast("array<string>"), " ").alias(x)
    return made.select("conv_id", "turn", "number", joined("input_ids"), joined("labels"), "problem")


# Digests and manifests

@query("a_24_tree", """WITH l AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, sha256(coalesce(text, '')) AS h FROM documents), a AS (SELECT lang, i // 1024 AS i, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY i)) AS h FROM l GROUP BY ALL)
  SELECT lang, sum(n)::BIGINT AS rows, sha256(string_agg(h, chr(10) ORDER BY i)) AS digest FROM a GROUP BY lang""")
def _(spark, d):
    return digests.tree_digest(read(spark, d, "documents").select("lang", "doc_id", "text"), ["lang"], ["doc_id"], F.col("text"))


@query("v_4_artifacts", """SELECT * FROM (VALUES ('manifest', 'fields', true), ('json', 'columns', true), ('json', 'rows', true), ('json', 'digest', true), ('parquet', 'columns', true), ('parquet', 'rows', true), ('parquet', 'digest', true), ('expected', 'columns', true), ('expected', 'rows', true), ('expected', 'digest', true),
  ('one changed', 'columns', true), ('one changed', 'rows', true), ('one changed', 'digest', false), ('one less', 'columns', true), ('one less', 'rows', false), ('one less', 'digest', false), ('column less', 'columns', false), ('column less', 'rows', true), ('column less', 'digest', false)) t(artifact, "check", ok)""")
def _(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = tables.scratch(spark, "artifacts")
    o.write.json(f"{path}/json")
    o.write.parquet(f"{path}/parquet")
    changed = F.when(F.col("o_orderkey") == o.agg(F.max("o_orderkey")).first()[0], "?").otherwise(F.col("o_orderstatus"))
    copies = {
        "json": spark.read.schema(o.schema).json(f"{path}/json"), "parquet": spark.read.parquet(f"{path}/parquet"), "one changed": o.withColumn("o_orderstatus", changed),
        "one less": o.where(changed != "?"), "column less": o.drop("o_custkey")}
    return digests.verify(digests.manifest_of(o, ["o_orderkey"], "orders"), copies, o)


@query("io_15_files", "SELECT 'same' AS status, 4::BIGINT AS files, (SELECT count(*) FROM customer) AS rows")
def _(spark, d):
    path, c = tables.scratch(spark, "run"), read(spark, d, "customer")
    digests.write_run(c.repartition(4, "c_custkey"), path, {"finished": True})
    n = digests.read_run(spark, path).agg(F.count("*").alias("rows"))
    return digests.check_run(spark, path).groupBy("status").agg(F.count("*").alias("files")).join(F.broadcast(n), F.lit(True))  # one row


@query("x_24_run", f"""WITH {TASKS}, {RESULTS}, e AS (SELECT task_id FROM tasks WHERE ord % 3 <> 0) SELECT (SELECT count(*) FROM e) AS expected, count(*) FILTER (e.task_id IS NOT NULL AND r.task_id IS NOT NULL) AS found, count(*) FILTER (e.task_id IS NOT NULL AND r.valid) AS valid, count(*) FILTER (e.task_id IS NOT NULL AND NOT r.valid) AS invalid, count(*) FILTER (e.task_id IS NULL) AS unknown, 0::BIGINT AS repeated, '{{"finished": true, "loaded": false}}' AS flags, true AS files_ok, false AS complete FROM e FULL JOIN results r USING (task_id)""")
def _(spark, d):
    path = tables.scratch(spark, "evaluation")
    digests.write_run(results(spark, d).select("task_id", "valid"), path, {"loaded": False, "finished": True})
    return digests.complete(spark, path, tasks(spark, d).where("ord % 3 <> 0"), "task_id", "valid")


# Validation dumps and stored summaries

def dump(spark, d):
    """Results as a dump: some tasks twice, some of no task."""
    r = results(spark, d).select("task_id", F.col("valid").alias("reward_valid"), F.when(F.col("steps") % 4 != 0, F.col("terminal")).alias("terminal"), F.col("completion").alias("score"))
    return r, r.unionByName(r.where("task_id % 50 = 0")).unionByName(r.where("task_id % 70 = 0").withColumn("task_id", F.concat(F.lit("x"), "task_id")))


@query("a_6_problems", f"WITH {TASKS}, {RESULTS} SELECT 'repeated_result' AS problem, task_id, 2::BIGINT AS n FROM results WHERE task_id::INT % 50 = 0 UNION ALL SELECT 'unknown_task', 'x' || task_id, 1 FROM results WHERE task_id::INT % 70 = 0 UNION ALL SELECT 'wrong_size', NULL, count(*) FROM tasks")
def _(spark, d):
    return evaluation.dump_problems(tasks(spark, d), dump(spark, d)[1], "task_id", 132)


@query("a_6_dump", f"WITH {TASKS}, {RESULTS}, r AS (SELECT task_id, valid, CASE WHEN steps % 4 <> 0 THEN terminal ELSE completion END AS t FROM results) SELECT composition, count(*) AS expected, count(valid) AS completed, count(*) FILTER (valid) AS valid_n, round(sum(CASE WHEN valid THEN t ELSE 0 END) / count(*), 9) AS mean_terminal, 0.0::DOUBLE AS mean_guard_rejections FROM tasks LEFT JOIN r USING (task_id) GROUP BY GROUPING SETS ((composition), ())")
def _(spark, d):
    t = tasks(spark, d)
    made = evaluation.dump_results(t, dump(spark, d)[0], "task_id", "composition", {"terminal": "score"}, t.count())
    out = evaluation.summary(t, made, "task_id", "composition", ["terminal", "guard_rejections"])
    return out.select("composition", "expected", "completed", "valid_n", F.round("mean_terminal", 9).alias("mean_terminal"), "mean_guard_rejections")


_SUMMARY = "SELECT composition, count(*) AS expected, count(valid) AS completed, count(*) FILTER (valid) AS valid_n, sum(CASE WHEN valid THEN terminal ELSE 0 END) / count(*) AS mean_terminal FROM {0} GROUP BY GROUPING SETS ((composition), ())"


@query("v_20_summary", f"""WITH {TASKS}, {RESULTS}, a AS (SELECT * FROM tasks LEFT JOIN results USING (task_id)), b AS (SELECT ord, composition, CASE WHEN composition <> 'BUILDING' OR ord % 9 <> 0 THEN valid END AS valid, terminal FROM a),
  old AS (UNPIVOT (SELECT composition, expected::DOUBLE AS expected, completed::DOUBLE AS completed, valid_n::DOUBLE AS valid_n, mean_terminal FROM ({_SUMMARY.format("b")})) ON expected, completed, valid_n, mean_terminal INTO NAME metric VALUE v), new AS (UNPIVOT (SELECT composition, expected::DOUBLE AS expected, completed::DOUBLE AS completed, valid_n::DOUBLE AS valid_n, mean_terminal FROM ({_SUMMARY.format("a")})) ON expected, completed, valid_n, mean_terminal INTO NAME metric VALUE v)
  SELECT old.composition, old.metric, round(old.v, 9) AS stored, round(new.v, 9) AS recomputed, abs(old.v - new.v) <= 1e-9 AS same FROM old JOIN new ON old.composition IS NOT DISTINCT FROM new.composition AND old.metric = new.metric""")
def _(spark, d):
    t, r, path = tasks(spark, d), results(spark, d), tables.scratch(spark, "summary")
    columns = ["composition", "expected", "completed", "valid_n", "mean_terminal"]
    stale = r.join(t.where("composition = 'BUILDING' AND ord % 9 = 0").select("task_id"), "task_id", "anti")
    evaluation.summary(t, stale, "task_id", "composition", ["terminal"]).select(*columns).write.parquet(path)
    found = evaluation.consistency(spark.read.parquet(path), evaluation.summary(t, r, "task_id", "composition", ["terminal"]).select(*columns), ["composition"])
    return found.withColumns({c: F.round(c, 9) for c in ("stored", "recomputed")})
