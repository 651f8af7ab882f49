"""Registered queries: sources and sinks, replay beyond the fold, recovery data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracksmith.operators import control, recovery, rollouts
from tracksmith.plans.bind import RESULTS, TURNS, read, results, turns
from tracksmith.plans.splits_queries import ORACLES, query
from tracksmith.plans.trajectory_queries import f_1
from tracksmith.sources import tables

NATION_LINES = """(SELECT row_number() OVER (ORDER BY n_nationkey) AS line, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","none":null}' AS text FROM nation)"""


def nation_lines(spark, d):
    """The 25 nations as one file of JSON lines."""
    path = tables.scratch(spark, "lines")
    n = read(spark, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none"))
    tables.write_json_lines(n.coalesce(1).sortWithinPartitions("n_nationkey"), path)
    return path


def region_files(spark, d):
    """A JSON file for each region."""
    path = tables.scratch(spark, "files")
    read(spark, d, "region").select("r_regionkey", "r_name").coalesce(1).write.option("maxRecordsPerFile", 1).json(path)
    return path


@query("io_2", f"SELECT line, text FROM {NATION_LINES}")
def _(spark, d):
    return tables.json_lines(spark, nation_lines(spark, d)).select("line", "text")


@query("io_3", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'record_not_mapping' END AS problem, CASE WHEN event_id % 3 = 2 THEN event_id END AS id FROM events""")
def _(spark, d):
    text = F.expr("""CASE event_id % 3 WHEN 0 THEN '{"id":' WHEN 1 THEN concat('[', event_id, ']') ELSE concat('{"id":', event_id, '}') END""")
    return tables.tolerant(read(spark, d, "events").select("event_id", text.alias("text")), "id long").select("event_id", "problem", F.col("record.id").alias("id"))


@query("io_4", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return tables.json_directory(spark, region_files(spark, d), "r_regionkey long, r_name string", "r_regionkey")


@query("io_5", "SELECT 'records' AS kind, false AS formal, count(*) AS n FROM region")
def _(spark, d):
    return tables.discover(spark, region_files(spark, d), "*.json", {"part-%": "records"}).groupBy("kind", "formal").agg(F.count("*").alias("n"))


@query("io_6", f"SELECT text AS value FROM {NATION_LINES}")
def _(spark, d):
    return spark.read.text(nation_lines(spark, d))


@query("io_7", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(spark, d):
    path = tables.scratch(spark, "zstd")
    tables.write_parquet(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path)
    return tables.parquet(spark, path, ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("io_8", "SELECT count(*) AS n, true AS refused FROM region")
def _(spark, d):
    path, r = tables.scratch(spark, "once"), read(spark, d, "region")
    tables.write_parquet(r, path)
    refused = tables.refuses_overwrite(r, path)
    return spark.read.parquet(path).agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query("io_11", """SELECT length(t) AS bytes, sha256(t) AS sha256 FROM (SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' || chr(10) AS t FROM region)""")
def _(spark, d):
    return tables.file_digests(spark, region_files(spark, d), "*.json").select("bytes", "sha256")


@query("io_12", """SELECT '# Segments' || chr(10) || chr(10) || '| segment | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || s || ' | ' || n || ' |' || chr(10), '' ORDER BY s) AS report
  FROM (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1)""")
def _(spark, d):
    counts = read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")).orderBy("segment")
    return spark.createDataFrame([(tables.markdown(counts, "Segments"),)], "report string")


@query("io_15", f"WITH {RESULTS}, c AS (SELECT steps % 5 AS step, count(*) AS n, round(avg(completion), 9) AS completion FROM results GROUP BY 1) SELECT *, step = (SELECT step FROM c ORDER BY completion DESC, step LIMIT 1) AS best FROM c")
def _(spark, d):
    path = tables.scratch(spark, "checkpoints")
    results(spark, d).select(F.expr("steps % 5").alias("step"), "completion").write.partitionBy("step").parquet(path)
    return tables.best_checkpoint(spark, path, "step", "completion")


def open_aspects():
    """Three aspects, the bits of an event id say which are open."""
    return F.array(*[F.struct(F.lit(f"a{k}").alias("aspect"), F.expr(f"event_id DIV {1 << k} % 2 = 1").alias("open")) for k in range(3)])


@query("f_3", "SELECT event_id, CASE WHEN event_id % 3 < 1 AND event_id // 2 % 2 = 1 THEN 'a1' WHEN event_id % 3 < 2 AND event_id // 4 % 2 = 1 THEN 'a2' END AS following FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", recovery.next_open(open_aspects(), (F.col("event_id") % 3).cast("int")).alias("following"))


@query("x_7", "SELECT event_id, CASE WHEN event_id % 2 = 1 AND event_id % 3 <> 0 THEN 'a0' WHEN event_id // 2 % 2 = 1 AND event_id % 3 <> 1 THEN 'a1' WHEN event_id // 4 % 2 = 1 AND event_id % 3 <> 2 THEN 'a2' END AS following FROM events")
def _(spark, d):
    name = F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string"))
    return read(spark, d, "events").select("event_id", recovery.other_open(open_aspects(), name).alias("following"))


@query("f_4")
def f_4(spark, d):
    t = turns(spark, d).withColumns({"named": F.when(F.col("bucket") < 2, F.expr("event_id % 5")), "closes": F.col("choice") == "answer", "feedback": F.col("event_id") % 29 != 0})
    return recovery.aligned_replay(t, "trajectory", "turn", 5)


F_1 = ORACLES["f_1"]
HINT = "CASE WHEN trajectory % 3 = 0 THEN 'answer_required' END"


@query("f_8", f"SELECT trajectory, coalesce({HINT}, phase) AS phase, aspect, fallbacks, answered, blocked FROM ({F_1})")
def _(spark, d):
    state = f_1(spark, d).select("trajectory", F.to_json(F.struct("phase", "aspect", "streak", "max_streak", "fallbacks", "answered", "blocked", "rejected")).alias("payload"))
    rebuilt = state.withColumn("s", F.from_json("payload", control.STATE.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")))
    return rebuilt.select("trajectory", F.coalesce(F.expr(HINT), "s.phase").alias("phase"), *[f"s.{c}" for c in ("aspect", "fallbacks", "answered", "blocked")])


@query("x_8", f"""SELECT trajectory, '{{"phase":"' || phase || '","aspect":' || aspect || ',"fallbacks":' || fallbacks || '}}' AS payload FROM ({F_1})""")
def _(spark, d):
    return f_1(spark, d).select("trajectory", F.to_json(F.struct("phase", "aspect", "fallbacks")).alias("payload"))


def _counts() -> str:
    one = "count(*) FILTER (b.phase = '{p}') AS {n}_chances, count(*) FILTER (b.phase = '{p}' AND a.rejected = b.rejected) AS {n}_successes"
    return ", ".join(one.format(n=n, p=p) for n, p in {"search": control.SEARCH, "retry": control.RETRY, "answer": control.ANSWER}.items())


FOLD = F_1[: F_1.rindex("SELECT trajectory, (turn + 1)")]


@query("f_12", f"{FOLD} SELECT a.trajectory, {_counts()}, count(*) FILTER (a.aspect > b.aspect) AS switches FROM fold a JOIN fold b ON a.trajectory = b.trajectory AND a.turn = b.turn + 1 GROUP BY 1")
def _(spark, d):
    return control.counted(turns(spark, d), "trajectory", "turn")


@query("t_26", f"""WITH {TURNS}, s AS (SELECT trajectory, turn, event_id, bucket, row_number() OVER (PARTITION BY trajectory ORDER BY turn) AS ord FROM turns
  WHERE outcome = 'normal' AND bucket < 5 AND event_id % 4 < 3 AND (bucket IN (0, 2) OR event_id % 4 IN (0, 2))) SELECT trajectory, turn, ord FROM s WHERE ord <= 2""")
def _(spark, d):
    option = lambda x: F.concat(F.lit("H"), x.cast("string"))
    names = lambda numbers: F.array(*[F.lit(f"H{k}") for k in numbers])
    t = turns(spark, d).where("outcome = 'normal'").withColumn("candidates", F.array(option(F.col("bucket")), F.when(F.col("event_id") % 4 == 3, "H9").otherwise(option(F.col("event_id") % 4))))
    return recovery.search_contexts(t, "trajectory", "turn", "candidates", names(range(-6, 5)), names((0, 2)), 2).select("trajectory", "turn", F.col("ord").cast("long").alias("ord"))


@query("x_5", "SELECT event_id, event_id % 6 IN (0, 1, 5) AS same FROM events")
def _(spark, d):
    message = lambda role, name, args: F.expr(f"named_struct('role', {role}, 'content', event_type, 'name', {name}, 'arguments', {args})")
    a = message("'assistant'", "'act'", """concat('{"x": ', event_id, ', "y": [1, null]}')""")
    b = message("if(event_id % 6 = 2, 'user', 'assistant')", "if(event_id % 6 = 3, 'other', 'act')", """if(event_id % 6 = 4, '{"x"', concat('{"y":[1,null],"x":', event_id, '}'))""")
    return read(spark, d, "events").select("event_id", recovery.same_message(a, b).alias("same"))


@query("x_6", f"""WITH {TURNS}, l AS (SELECT trajectory, count(*) AS n FROM turns GROUP BY 1) SELECT t.trajectory, CASE WHEN t.trajectory % 2 = 0 THEN 0 ELSE 1 END AS ord, CASE WHEN t.trajectory % 2 = 0 THEN 'first ' ELSE '' END || arg_min(choice, turn) AS action
  FROM turns t JOIN l USING (trajectory) WHERE turn >= n // 2 AND choice <> 'action' GROUP BY 1""")
def _(spark, d):
    rows = turns(spark, d).groupBy("trajectory").agg(F.array_sort(F.collect_list(F.struct("turn", "choice"))).alias("t"))
    said = F.transform("t", lambda x: F.concat(x["turn"].cast("string"), F.lit(" "), x["choice"]))
    acted = lambda prefix: F.transform("t", lambda x: F.when(x["choice"] != "action", F.concat(F.lit(prefix), x["choice"])))
    contexts = rows.select("trajectory", F.slice(said, F.lit(1), F.expr("size(t) DIV 2").cast("int")).alias("context"))
    other = F.when(F.col("trajectory") % 2 == 0, said).otherwise(F.transform(said, lambda x: F.concat(x, F.lit("?"))))
    # a context of no message begins every source, so the first source of short trajectories must be no match either
    first = rows.where("trajectory % 2 = 0 OR size(t) > 1").select("trajectory", F.lit(0).alias("ord"), other.alias("messages"), acted("first ").alias("actions"))
    return recovery.next_action(contexts, first.unionByName(rows.select("trajectory", F.lit(1).alias("ord"), said.alias("messages"), acted("").alias("actions"))), "trajectory")


@query("x_15", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'policy_marker' WHEN 1 THEN 'note' WHEN 2 THEN 'answer_not_visible' WHEN 3 THEN 'examples' WHEN 4 THEN 'mask' END AS reason FROM events")
def _(spark, d):
    text = F.expr("concat(repeat('[policy]', if(event_id % 6 = 0, 2, 1)), ' ', event_type, if(event_id % 6 = 1, '', ' {note.}'), if(event_id % 6 = 2, '', ' H12'))")
    k = F.col("event_id") % 6
    reason = recovery.audit_rendered(text, "[policy]", F.lit("{note.}"), F.lit("H12"), F.when(k == 3, 2).otherwise(1), F.when(k == 4, 0).otherwise(1))
    return read(spark, d, "events").select("event_id", reason.alias("reason"))


@query("x_17", """SELECT event_id AS key, o AS ord, 'H' || (event_id + o) AS option, CASE WHEN o = 0 THEN '{"cost":{"cost_a":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '5' END || '},"id":"H' || event_id || '"}' ELSE '{"id":"H' || (event_id + 1) || '","name":"b"}' END AS detail,
  (o = 0 AND event_id % 2 = 1) OR o = 1 AS satisfied FROM events, (VALUES (0), (1)) v(o)""")
def _(spark, d):
    text = F.expr("""concat('found {x ', '{"id": "H', event_id, '", "cost": {"cost_a": ', if(event_id % 2 = 0, 'null', '5'), '}} and {"name": "b", "id": "H', event_id + 1, '"} {"id":"H', event_id, '"} {"id": "R1"}')""")
    found = recovery.option_details(read(spark, d, "events").select("event_id", text.alias("text")), "event_id", "text", "H")
    return found.withColumn("satisfied", recovery.option_satisfies(F.col("detail"), ["cost_a", '"NAME":"b"']))


@query("x_20", "SELECT conv_id, 'system: rules' || chr(10) || string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) || chr(10) || 'user: next step?' AS prompt, count(*) + 2 AS n FROM conversations WHERE role <> 'system' GROUP BY 1")
def _(spark, d):
    c = read(spark, d, "conversations").where("role <> 'system'")
    return rollouts.prompt(c, "conv_id", "turn", "role", "text", [("system", "rules")], [("user", "next step?")])


@query("x_21", f"WITH {RESULTS} SELECT round(sum(CASE WHEN valid THEN completion ELSE 0 END) / count(*), 9) AS completion, round(avg(coalesce(CASE WHEN steps % 3 <> 0 THEN terminal END, 0)), 9) AS search_coverage, count(*) AS records FROM results")
def _(spark, d):
    made = rollouts.summary_pick(results(spark, d), F.col("valid"), "completion", F.when(F.col("steps") % 3 != 0, F.col("terminal")))
    return made.select(F.round("completion", 9).alias("completion"), F.round("search_coverage", 9).alias("search_coverage"), "records")


@query("g_9")
def g_9(spark, d):
    sizes = {r["n_name"]: 2 + r["n_nationkey"] % 3 for r in read(spark, d, "nation").orderBy("n_nationkey").collect()}  # the 25 nations
    total, counts = recovery.partial_counts(sizes, 157)
    return spark.createDataFrame([(name, sizes[name], k, total) for name, k in counts.items()], "name string, aspects int, chosen int, total int")
