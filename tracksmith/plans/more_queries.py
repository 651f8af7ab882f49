"""Registered queries: transcripts, sources, further contracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracksmith.functions import expr
from tracksmith.operators import contracts, control, reward, rollouts, transcripts
from tracksmith.plans.bind import COUNTERS, RESULTS, TASKS, TURNS, counters, read, results, tasks, turns
from tracksmith.plans.splits_queries import query
from tracksmith.sources import tables


@query("io_1", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return tables.parquet(spark, f"{d}/region.parquet", ["r_regionkey", "r_name"], 5)


@query("io_14", "SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'new' END, n_name) AS n_name FROM nation")
def _(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    return tables.last_wins([n, n.where("n_nationkey % 3 = 0").withColumn("n_name", F.lit("new"))], "n_nationkey")


@query("io_9", f"WITH {RESULTS} SELECT CASE WHEN NOT valid THEN 'rejected' WHEN completion >= 0.7 THEN 'gold' WHEN completion >= 0.3 THEN 'silver' ELSE 'diagnostics' END AS tier, count(*) AS n FROM results GROUP BY 1")
def _(spark, d):
    tier = F.when(~F.col("valid"), "rejected").when(F.col("completion") >= 0.7, "gold").when(F.col("completion") >= 0.3, "silver").otherwise("diagnostics")
    return results(spark, d).withColumn("tier", tier).groupBy("tier").agg(F.count("*").alias("n"))


@query("io_10", "SELECT c_mktsegment, sum(CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS even, sum(CASE WHEN c_nationkey % 2 <> 0 THEN 1 ELSE 0 END)::BIGINT AS odd FROM customer GROUP BY 1")
def _(spark, d):
    c = read(spark, d, "customer").withColumn("k", F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd"))
    return c.groupBy("c_mktsegment").pivot("k", ["even", "odd"]).count().na.fill(0)


@query("v_1", """SELECT c_custkey, '{"name": "' || c_name || '", "key": ' || c_custkey || ', "none": null}' AS spaced, '{"key":' || c_custkey || ',"name":"' || c_name || '","none":null}' AS compact FROM customer""")
def _(spark, d):
    pairs = [("name", F.col("c_name")), ("key", F.col("c_custkey")), ("none", F.lit(None).cast("string"))]
    return read(spark, d, "customer").select("c_custkey", transcripts.canonical(*pairs, spaced=True).alias("spaced"), transcripts.canonical(*pairs, spaced=False).alias("compact"))


@query("v_3", "SELECT conv_id, CASE WHEN string_agg(role, ',' ORDER BY turn) FILTER (turn < 2) <> 'system,user' THEN 'wrong_roles' WHEN count(*) < 3 THEN 'too_short' END AS reason FROM conversations GROUP BY 1")
def _(spark, d):
    return rollouts.source_rejections(read(spark, d, "conversations"), "conv_id", "turn", "role")


@query("v_5", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'ground_truth' END, CASE WHEN o_orderkey % 7 = 0 THEN 'ids_differ' END, CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 THEN 'index_repeated' END, CASE WHEN o_orderkey % 3 <> 1 THEN 'policy_blocks' END], lambda x: x IS NOT NULL), ',') AS rejections FROM orders""")
def _(spark, d):
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").withColumn("truth", F.when(k % 11 == 0, "x").otherwise("")).withColumn("prompt", F.repeat(F.lit("<!-- policy v1 -->."), (k % 3).cast("int")))
    o = rollouts.derived_rejections(o, [k, k, F.when(k % 7 == 0, k + 1).otherwise(k)], ["o_custkey", "o_orderdate"], F.col("truth"), F.col("prompt"), "<!-- policy v1 -->")
    return o.select("o_orderkey", "rejections")


@query("v_13", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(*) - count(DISTINCT doc_id) AS n_repeated FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)")
def _(spark, d):
    return rollouts.unique_load([read(spark, d, "documents"), read(spark, d, "labels")], "doc_id")


@query("v_20", "SELECT c_mktsegment AS stratum, count(*) AS stored, count(o.k) AS recomputed, count(*) = count(o.k) AS same FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON k = c_custkey GROUP BY 1")
def _(spark, d):
    stored = tasks(spark, d).groupBy(F.col("composition").alias("stratum")).agg(F.count("*").alias("stored"))
    customers = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().join(read(spark, d, "customer"), "c_custkey")
    recomputed = customers.groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count("*").alias("recomputed"))
    return stored.join(recomputed, "stratum", "full").withColumn("same", F.col("stored").eqNullSafe(F.col("recomputed")))


@query("v_21", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, d):
    return rollouts.allowed_columns(read(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "not_there"])


@query("t_1", "SELECT conv_id, turn, role, length(trim(text)) AS n FROM conversations WHERE role IN ('user', 'assistant')")
def _(spark, d):
    c = transcripts.normalise(read(spark, d, "conversations"), "role", "text", ("user", "assistant"))
    return c.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


ARGUMENTS = """CASE event_id % 6 WHEN 0 THEN 'not json' WHEN 1 THEN '{"thought":"t","choice":"search"}' WHEN 2 THEN '{"thought":"t","choice":"Search","content":"[search] rooms ' || event_id || '"}' WHEN 3 THEN '{"thought":"t","choice":"answer","content":"[search] x"}' WHEN 4 THEN '{"thought":" ","choice":"answer","content":"x"}' ELSE '{"thought":"t","choice":"action","content":"  ask  "}' END"""


@query("t_2", "SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'search' WHEN 5 THEN 'action' END AS call_choice, CASE event_id % 6 WHEN 2 THEN 'rooms ' || event_id WHEN 5 THEN 'ask' END AS call_content, CASE event_id % 6 WHEN 0 THEN 'wrong_parameters' WHEN 1 THEN 'wrong_parameters' WHEN 3 THEN 'prefix_conflicts' WHEN 4 THEN 'empty_thought' END AS call_error FROM events")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", F.expr(ARGUMENTS).alias("arguments"))
    return transcripts.parse_call(e, "arguments").select("event_id", "call_choice", "call_content", "call_error")


@query("t_4", "SELECT event_id AS key, 0::BIGINT AS ord, 'search' AS choice, trim(event_type) AS content, trim(props) AS response FROM events")
def _(spark, d):
    text = F.concat(F.lit("<tool_call><function=f><parameter=choice>search</parameter><parameter=content>"), F.col("event_type"), F.lit("</parameter></function></tool_call> .. <tool_response>"), F.col("props"), F.lit("</tool_response>"))
    return transcripts.parse_tagged(read(spark, d, "events").select("event_id", text.alias("text")), "event_id", "text")


@query("t_11", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'route' WHEN 2 THEN 'glasses' ELSE 'bus' END AS word FROM part")
def _(spark, d):
    word = F.element_at(F.array(*[F.lit(w) for w in ("cities", "routes", "glasses", "bus")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", transcripts.deinflect(F.array(word), ["city", "route", "bus", "gla"])[0].alias("word"))


HINTS = [("flight", "time", "layover time"), ("flight", "path", "layover"), ("hotel", "rating", "star"), ("hotel", "company", "chain")]
PHRASE_SQL = "CASE c_custkey % 4 WHEN 0 THEN 'is the layover time fine' WHEN 1 THEN 'any layover' WHEN 2 THEN 'three Stars, chains' ELSE 'nothing here, start restart' END"


def matches(spark, d):
    texts = read(spark, d, "customer").select("c_custkey", F.expr(PHRASE_SQL).alias("text"))
    hints = spark.createDataFrame(HINTS, "aspect string, field string, hint string")
    return texts, transcripts.field_matches(texts, "c_custkey", "text", hints)


@query("t_12", "SELECT c_custkey AS key, a AS aspect, f AS field FROM customer JOIN (VALUES (0,'flight','time'),(1,'flight','path'),(2,'hotel','rating'),(2,'hotel','company')) v(k, a, f) ON c_custkey % 4 = k")
def _(spark, d):
    return matches(spark, d)[1]


@query("t_13", "SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN 'flight.time' WHEN 1 THEN 'flight.path' WHEN 2 THEN 'bundled' ELSE 'vague' END AS issue FROM customer")
def _(spark, d):
    texts, found = matches(spark, d)
    return transcripts.query_issue(texts, "c_custkey", found)


@query("t_14", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'hotel,flight' WHEN 1 THEN 'rental_car,restaurant' ELSE '' END AS aspects FROM customer")
def _(spark, d):
    text = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'A Hotel and then an airline' WHEN 1 THEN 'a car  rental, some dining' ELSE 'hotels flights' END")
    return read(spark, d, "customer").select("c_custkey", F.array_join(transcripts.public_aspects(text), ",").alias("aspects"))


@query("t_15", "SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_type = 'click' THEN 'search_fallback' WHEN event_id % 4 = 0 THEN 'fallback' WHEN event_type = 'click' AND event_id % 4 = 1 THEN 'search_normal' WHEN event_type = 'click' THEN 'search_empty' ELSE 'text' END AS kind FROM events")
def _(spark, d):
    feedback = F.expr("CASE event_id % 4 WHEN 0 THEN 'Sorry: search backend  is UNAVAILABLE, H12' WHEN 1 THEN 'found H12 and F3' ELSE 'nothing' END")
    choice = F.when(F.col("event_type") == "click", "search").otherwise("action")
    return read(spark, d, "events").select("event_id", transcripts.observation(choice, feedback).alias("kind"))


@query("t_16", r"WITH c AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')) || ' ' AS c FROM documents) SELECT doc_id, c LIKE '%_ the of _%' OR c LIKE '%general public%' AS found FROM c")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", transcripts.contains_any(F.col("text"), [" the of ", "general public"]).alias("found"))


@query("t_18", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'hotel' END AS aspect FROM customer")
def _(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.expr("CASE c_custkey % 3 WHEN 0 THEN 'A hotel: Rome on the 2nd & 3rd' WHEN 1 THEN 'hotel in Oslo' ELSE 'flight hotel rome 2' END").alias("text"))
    names = c.select("c_custkey", F.explode(F.array(F.struct(F.lit("hotel").alias("aspect"), F.lit("hotel").alias("alias"), F.array(F.lit("rome"), F.lit("2")).alias("arguments")), F.struct(F.lit("flight").alias("aspect"), F.lit("flight").alias("alias"), F.array(F.lit("Rome")).alias("arguments")))).alias("a")).select("c_custkey", "a.*")
    return transcripts.base_search(c, "c_custkey", "text", names)


@query("t_19", """SELECT n_regionkey, 'Options:' || chr(10) || string_agg('{"id":' || n_nationkey || ',"name":"' || n_name || '"}', chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1""")
def _(spark, d):
    options = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))
    return read(spark, d, "nation").groupBy("n_regionkey").agg(options.alias("o")).select("n_regionkey", transcripts.render_candidates("Options:", F.col("o")).alias("text"))


@query("t_20", r"SELECT item_id AS key, list_transform(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{L}\p{N}]+'), lambda w: CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN w[:-2] ELSE w END) AS tokens FROM benchmark")
def _(spark, d):
    return transcripts.alias_tokens(read(spark, d, "benchmark"), "item_id", "text")


@query("t_21", "SELECT c_custkey, c_name || chr(10) || '<!-- policy v1 -->be kind<!-- end policy -->' AS text FROM customer")
def _(spark, d):
    once = transcripts.ensure_policy(F.col("c_name"), "old rules")
    return read(spark, d, "customer").select("c_custkey", transcripts.ensure_policy(once, "be kind").alias("text"))


@query("t_23", f"WITH {TURNS} SELECT trajectory, count(*) FILTER (outcome IN ('fallback', 'empty')) AS fallbacks, count(*) FILTER (outcome = 'empty') AS search_fallbacks FROM turns GROUP BY 1")
def _(spark, d):
    return rollouts.fallback_counts(turns(spark, d), "trajectory", F.col("outcome").isin("fallback", "empty"), F.col("outcome") == "empty")


@query("t_25", f"WITH {TURNS} SELECT trajectory, aspect, 'control | aspect: ' || aspect || ' | phase: ' || arg_max(choice, turn) || ' | fallbacks: ' || count(*) FILTER (outcome = 'fallback') || ' | visible: ' || coalesce(string_agg(DISTINCT 'H' || bucket, ',' ORDER BY 'H' || bucket) FILTER (outcome = 'normal'), 'none') AS note FROM turns GROUP BY 1, 2")
def _(spark, d):
    t = turns(spark, d).groupBy("trajectory", "aspect").agg(F.max_by("choice", "turn").alias("phase"), F.count_if(F.col("outcome") == "fallback").alias("f"), F.collect_set(F.when(F.col("outcome") == "normal", F.concat(F.lit("H"), F.col("bucket").cast("string")))).alias("ids"))
    return t.select("trajectory", "aspect", transcripts.control_note(F.col("aspect"), F.col("phase"), F.col("f"), F.col("ids")).alias("note"))


@query("f_14", f"WITH {TURNS}, n AS (SELECT *, lag(choice) OVER (PARTITION BY trajectory ORDER BY turn) AS p FROM turns) SELECT trajectory, count(*) FILTER (p = 'search') AS opportunities, count(*) FILTER (p = 'search' AND choice = 'answer') AS successes FROM n GROUP BY 1")
def _(spark, d):
    w = Window.partitionBy("trajectory").orderBy("turn")
    note = F.concat(F.lit("phase was action, now "), F.lag("choice").over(w))
    phase = control.last_phase(F.col("note"), ["action", "search", "answer"])
    t = turns(spark, d).withColumn("note", note).withColumn("phase", phase)
    return t.groupBy("trajectory").agg(F.count_if(F.col("phase") == "search").alias("opportunities"), F.count_if((F.col("phase") == "search") & (F.col("choice") == "answer")).alias("successes"))


@query("f_9", "SELECT conv_id, max(turn) + 1 AS last_turn, count(*) AS masked, 'control note' AS note, 'target' AS target FROM conversations GROUP BY 1")
def _(spark, d):
    made = rollouts.masked_history(read(spark, d, "conversations"), "conv_id", "turn", "role", "text", F.lit("control note"), F.lit("target"))
    m = F.col("messages")
    return made.select("conv_id", F.element_at(m, -1)["turn"].alias("last_turn"), F.size(F.filter(m, lambda x: x["masked"])).cast("long").alias("masked"), F.substring_index(F.element_at(m, -2)["text"], "\n", -1).alias("note"), F.element_at(m, -1)["text"].alias("target"))


@query("f_13", f"WITH {TURNS} SELECT trajectory, turn, turn - lag(turn) OVER w AS step, outcome = 'fallback' AND coalesce(lag(outcome) OVER w, '') <> 'fallback' AS new_fallback FROM turns WINDOW w AS (PARTITION BY trajectory ORDER BY turn)")
def _(spark, d):
    return rollouts.turn_flags(turns(spark, d), "trajectory", "turn", "outcome", "fallback").withColumnRenamed("begins", "new_fallback")


@query("f_16", f"WITH {COUNTERS} SELECT trajectory, correct = aspects OR steps > 20 AS terminated FROM counters")
def _(spark, d):
    return counters(spark, d).select("trajectory", rollouts.terminated(F.col("correct"), F.col("aspects"), F.col("steps")).alias("terminated"))


@query("m_10", f"WITH {COUNTERS} SELECT trajectory, least(1.0, n_active * 0.3 + n_passive)::DOUBLE AS preference, searched::DOUBLE AS submitted, least(correct, aspects) / aspects::DOUBLE AS correct_rate FROM counters")
def _(spark, d):
    quality = F.transform(F.sequence(F.lit(1), F.col("aspects")), lambda i: F.when(i <= F.col("correct"), 0.8).otherwise(0.0))
    return counters(spark, d).select("trajectory", *rollouts.legacy_projection(F.col("n_active") * 0.3, F.col("n_passive"), quality, F.col("searched").cast("double")))


@query("m_15", f"WITH {TURNS}, p AS (SELECT *, lag(outcome) OVER w AS po, lag(choice) OVER w AS pc, lag(bucket) OVER w AS pb FROM turns WINDOW w AS (PARTITION BY trajectory ORDER BY turn)) SELECT trajectory, turn, choice = 'answer' AS answer_at_1, choice = 'search' AND outcome = 'normal' AS clean_search, bucket <> pb AS changed, choice = pc AND outcome = po AND bucket = pb AS exact_repeat FROM p WHERE pc = 'search'")
def _(spark, d):
    return rollouts.probe_flags(turns(spark, d), "trajectory", "turn", "choice", "outcome", "bucket")


@query("x_2", "SELECT l_orderkey, count(*) AS all_items, count(*) FILTER (l_partkey % 6 >= 4) AS counted FROM lineitem GROUP BY 1")
def _(spark, d):
    return rollouts.counted_lists(read(spark, d, "lineitem"), "l_orderkey", F.col("l_partkey") % 6)


@query("x_3", "SELECT source, arg_max(doc_id, doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY 1")
def _(spark, d):
    return rollouts.last_of_key(read(spark, d, "documents"), ["source"], "doc_id", ["lang"])


@query("x_9", f"WITH {TURNS} SELECT trajectory, turn, CASE WHEN choice = 'answer' THEN 'hotel' WHEN outcome = 'normal' THEN aspect ELSE 'current' END AS target FROM turns")
def _(spark, d):
    ids = F.when(F.col("choice") == "answer", F.lit("H7"))
    return turns(spark, d).select("trajectory", "turn", F.coalesce(expr.option_aspect(ids), F.when(F.col("outcome") == "normal", F.col("aspect")), F.lit("current")).alias("target"))


@query("x_10", f"WITH {TURNS}, f AS (SELECT trajectory, bucket, min(turn) AS t FROM turns WHERE choice = 'answer' GROUP BY 1, 2) SELECT trajectory, string_agg('H' || bucket, ',' ORDER BY t) AS submitted FROM f GROUP BY 1")
def _(spark, d):
    s = rollouts.submitted(turns(spark, d), "trajectory", "turn", "choice", F.concat(F.lit("H"), F.col("bucket").cast("string")))
    return s.select("trajectory", F.array_join("submitted", ",").alias("submitted"))


@query("x_11", f"WITH {TURNS}, s AS (SELECT trajectory, list_distinct(list(aspect) FILTER (outcome = 'normal')) AS v, list_distinct(list(aspect) FILTER (choice = 'answer')) AS a FROM turns GROUP BY 1) SELECT trajectory, array_to_string(list_sort(list_filter(coalesce(v, []), lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS options FROM s")
def _(spark, d):
    s = rollouts.open_options(turns(spark, d), "trajectory", "aspect", F.col("outcome") == "normal", F.col("choice") == "answer")
    return s.select("trajectory", F.array_join("options", ",").alias("options"))


@query("x_12", "SELECT count(*) AS n, count(*) - count(DISTINCT c_custkey) AS repeated, count(*) FILTER (trim(c_name) = '') AS blank FROM customer")
def _(spark, d):
    return rollouts.pool_contract(read(spark, d, "customer"), "c_custkey", ["c_name"])


@query("x_13", f"WITH {TASKS} SELECT count(*) FILTER (ord % 10 = 3) AS only_left, count(*) FILTER (ord % 10 = 4) AS only_right FROM tasks")
def _(spark, d):
    t = tasks(spark, d)
    return contracts.table_difference(t, t.where("ord % 10 <> 3").unionByName(t.where("ord % 10 = 4")))


@query("x_18", "SELECT conv_id, substr(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), 1, 1600) AS context FROM conversations GROUP BY 1")
def _(spark, d):
    none = F.lit(None).cast("string")
    c = transcripts.search_context(read(spark, d, "conversations"), "conv_id", "turn", "role", "text", none, none)
    return c.select("conv_id", F.when(F.size("context") > 0, F.array_join("context", "\n")).alias("context"))


@query("x_18_replies", """WITH m AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'tool' END AS role, 'a' || ((conv_id + turn) % 2) AS about FROM conversations), l AS (SELECT *, lag(CASE WHEN role = 'assistant' THEN about END) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM m)
  SELECT conv_id, string_agg(substr(text, 1, 1600), chr(10) ORDER BY role = 'tool', turn) FILTER (text <> '' AND (role = 'user' OR role = 'tool' AND before = 'a0')) AS context FROM l GROUP BY 1""")
def _(spark, d):
    role = F.when(F.col("turn") % 3 == 0, "user").when(F.col("turn") % 3 == 1, "assistant").otherwise("tool")
    m = read(spark, d, "conversations").withColumn("role", role)
    c = transcripts.search_context(m, "conv_id", "turn", "role", "text", F.concat(F.lit("a"), ((F.col("conv_id") + F.col("turn")) % 2).cast("string")), F.lit("a0"))
    return c.select("conv_id", F.when(F.size("context") > 0, F.array_join("context", "\n")).alias("context"))


@query("x_23", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'validation' WHEN 1 THEN 'training' ELSE 'error' END AS profile FROM nation")
def _(spark, d):
    k = F.col("n_nationkey") % 3
    temperature, top = F.when(k == 0, 0.0).when(k == 1, 0.7).otherwise(0.5), F.when(k == 0, 1.0).otherwise(0.9)
    return read(spark, d, "nation").select("n_nationkey", rollouts.profile(temperature, top).alias("profile"))


@query("x_24", f"WITH {TASKS}, {RESULTS} SELECT count(*) AS expected, count(*) FILTER (r.valid) AS valid, count(*) = count(*) FILTER (r.valid) AS complete FROM tasks LEFT JOIN results r USING (task_id)")
def _(spark, d):
    return rollouts.completeness(tasks(spark, d), results(spark, d), "task_id", "valid")


@query("x_26", "SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def _(spark, d):
    return rollouts.prompt(read(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "prompt")


@query("a_21", f"WITH {RESULTS} SELECT count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid FROM results")
def _(spark, d):
    from tracksmith.streaming.control import progress

    return progress(results(spark, d))


@query("m_3_quality", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 1.0 WHEN l_partkey % 2 = 0 THEN 0.8 ELSE 0.0 END::DOUBLE AS quality FROM lineitem")
def _(spark, d):
    x = F.col("l_partkey")
    best = F.when(F.col("l_returnflag") == "N", x).otherwise(-1)
    right = F.when(x % 2 == 0, F.array(x)).otherwise(F.array().cast("array<bigint>"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reward.answer_quality(x, best, right).alias("quality"))
