"""Registered queries: credit, groups, contracts, transcripts, replay, extra relational categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracksmith.functions import expr
from tracksmith.operators import contracts, control, credit, groups, public_control
from tracksmith.operators import rollouts as runs
from tracksmith.plans.bind import CREDITED, ROLLOUTS, TURNS, credited, read, rollouts, turns
from tracksmith.plans.splits_queries import query

CHAINS = CREDITED + """, a AS (SELECT *, max(turn) FILTER (choice = 'answer' AND answer_visible AND correct_answer) OVER p AS answer_at FROM credited WINDOW p AS (PARTITION BY trajectory, aspect)),
  b AS (SELECT *, max(turn) FILTER (choice = 'search' AND normal_candidates AND (answer_at IS NULL OR turn < answer_at)) OVER p AS search_at FROM a WINDOW p AS (PARTITION BY trajectory, aspect)),
  chained AS (SELECT *, field_resolved AND (coalesce(search_at, answer_at) IS NULL OR turn < coalesce(search_at, answer_at)) AS in_chain, answer_at IS NOT NULL AND search_at IS NOT NULL AS completed FROM b)"""


@query("w_1", f"WITH {CHAINS} SELECT trajectory, aspect, max(answer_at) AS answer_at, max(search_at) AS search_at, count(*) FILTER (in_chain) AS chain_n, bool_or(completed) AS completed FROM chained GROUP BY 1, 2")
def _(spark, d):
    return credit.chains(credited(spark, d)).groupBy("trajectory", "aspect").agg(F.max("answer_at").alias("answer_at"), F.max("search_at").alias("search_at"), F.count_if("in_chain").alias("chain_n"), F.bool_or("completed").alias("completed"))


EVIDENCE = CHAINS + """, c AS (SELECT *, count(*) FILTER (in_chain) OVER (PARTITION BY trajectory, aspect) AS chain_n, coalesce(count(*) FILTER (field_resolved) OVER (PARTITION BY trajectory, aspect ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
   least(CASE WHEN exact_query_repeat OR wrong_aspect OR invisible_answer_id THEN -0.2 END, CASE WHEN wrong_answer OR malformed_tool_call OR no_tool_output THEN -0.15 END, CASE WHEN semantic_repeat OR no_progress_action THEN -0.1 END) AS specific,
   CASE WHEN exact_query_repeat THEN 'exact_query_repeat' WHEN wrong_aspect THEN 'wrong_aspect' WHEN invisible_answer_id THEN 'invisible_answer_id' WHEN wrong_answer THEN 'wrong_answer' WHEN malformed_tool_call THEN 'malformed_tool_call' WHEN no_tool_output THEN 'no_tool_output' WHEN semantic_repeat THEN 'semantic_repeat' WHEN no_progress_action THEN 'no_progress_action' WHEN guard_rejected THEN 'guard_rejected' ELSE 'none' END AS cause FROM chained),
  e AS (SELECT *, coalesce(specific, CASE WHEN guard_rejected THEN -0.15 ELSE 0 END)::DOUBLE AS penalty FROM c),
  f AS (SELECT *, row_number() OVER (PARTITION BY trajectory, aspect, cause, penalty < 0 AND NOT infrastructure_failure ORDER BY turn) AS nth,
   CASE WHEN completed THEN (CASE WHEN in_chain THEN 0.2::DOUBLE / chain_n ELSE 0 END) + (CASE WHEN turn = search_at THEN 0.45 ELSE 0 END) + (CASE WHEN turn = answer_at THEN 0.35 ELSE 0 END)
    ELSE greatest(CASE WHEN field_resolved AND before < 2 THEN 0.05 ELSE 0 END, CASE WHEN normal_candidates THEN 0.2 ELSE 0 END) + CASE WHEN choice = 'answer' AND answer_visible AND NOT correct_answer THEN 0.05 ELSE 0 END END AS gain FROM e),
  evidenced AS (SELECT *, CASE WHEN infrastructure_failure OR NOT reward_valid THEN 0.0 ELSE least(0.5, greatest(-0.5, gain + CASE WHEN penalty < 0 AND nth = 1 THEN penalty ELSE 0 END)) END::DOUBLE AS evidence FROM f)"""


@query("w_2", f"WITH {EVIDENCE} SELECT trajectory, turn, round(evidence, 6) AS evidence FROM evidenced")
def _(spark, d):
    return credit.evidence(credited(spark, d)).select("trajectory", "turn", F.round("evidence", 6).alias("evidence"))


@query("w_3", f"WITH {EVIDENCE} SELECT trajectory, turn, round(penalty, 6) AS penalty, cause FROM evidenced WHERE penalty < 0")
def _(spark, d):
    return credit.evidence(credited(spark, d)).where("penalty < 0").select("trajectory", "turn", F.round("penalty", 6).alias("penalty"), "cause")


@query("w_4", f"WITH {TURNS}, s AS (SELECT trajectory, turn, bucket, count(*) OVER p AS n, stddev_pop(bucket) OVER p AS sd, avg(bucket) OVER p AS m FROM turns WINDOW p AS (PARTITION BY trajectory)) SELECT trajectory, turn, round(CASE WHEN n <= 1 OR sd < 1e-6 THEN 0 ELSE (bucket - m) / (sd + 1e-6) END, 5) AS z FROM s")
def _(spark, d):
    return credit.normalised(turns(spark, d), ["trajectory"], "bucket").select("trajectory", "turn", F.round("z", 5).alias("z"))


ADVANTAGE = "((trajectory % 7) - 3) / 4.0::DOUBLE"


@query("w_5", f"""WITH {EVIDENCE}, r AS (SELECT trajectory, turn, tokens, {ADVANTAGE} AS adv, CASE WHEN {ADVANTAGE} > 0 THEN greatest(0, evidence) ELSE greatest(0, -evidence) END AS routed FROM evidenced),
  w AS (SELECT *, CASE WHEN max(routed) OVER (PARTITION BY trajectory) < 1e-6 THEN 1.0 ELSE 1 + 0.1 * routed / nullif(max(routed) OVER (PARTITION BY trajectory), 0) END AS weight FROM r)
  SELECT trajectory, turn, round(CASE WHEN abs(adv) < 1e-6 THEN 0 ELSE adv * weight / (sum(tokens * weight) OVER (PARTITION BY trajectory) / sum(tokens) OVER (PARTITION BY trajectory)) END, 6) AS turn_advantage FROM w""")
def _(spark, d):
    e = credit.evidence(credited(spark, d)).withColumn("adv", (F.col("trajectory") % 7 - 3) / 4.0)
    return credit.reshape(e, "trajectory", "adv", "evidence", "tokens").select("trajectory", "turn", F.round("turn_advantage", 6).alias("turn_advantage"))


SPANS = "SELECT conv_id, min(turn) AS start, max(turn) + 1 AS stop FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations WHERE role = 'assistant') GROUP BY conv_id, island"


@query("w_6", SPANS)
def _(spark, d):
    return credit.spans(read(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role = 'assistant'")


@query("w_7", f"WITH s AS ({SPANS}) SELECT c.conv_id, c.turn, s.start, (c.conv_id % 5) / 5.0::DOUBLE AS value FROM conversations c JOIN s ON s.conv_id = c.conv_id AND c.turn >= s.start AND c.turn < s.stop")
def _(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role")
    spans = credit.spans(c, ["conv_id"], "turn", "role = 'assistant'")
    return spans.select("conv_id", "start", F.explode(F.sequence("start", F.col("stop") - 1)).alias("turn")).withColumn("value", (F.col("conv_id") % 5) / 5.0)


@query("w_8", f"WITH {EVIDENCE} SELECT aspect, count(*) FILTER (evidence > 0) AS positive, count(*) FILTER (evidence < 0) AS negative, count(*) FILTER (evidence = 0) AS zero, round(min(evidence), 6) AS least, round(max(evidence), 6) AS most, round(avg(evidence), 6) AS mean FROM (SELECT aspect, round(evidence, 9) AS evidence FROM evidenced) GROUP BY 1")
def _(spark, d):
    e = credit.evidence(credited(spark, d)).withColumn("evidence", F.round("evidence", 9))
    return credit.credit_metrics(e, ["aspect"]).withColumns({c: F.round(c, 6) for c in ("least", "most", "mean")})


STATUS = "g AS (SELECT uid, count(*) AS n, count(*) FILTER (invalid) AS n_invalid, CASE WHEN count(*) <> 6 THEN 'incomplete' WHEN count(*) FILTER (invalid) > 0 THEN 'sampling_invalid' WHEN max(reward) - min(reward) <= 1e-12 THEN 'constant' ELSE 'kept' END AS status FROM rollouts GROUP BY 1)"


@query("g_1", f"WITH {ROLLOUTS}, {STATUS} SELECT * FROM g")
def _(spark, d):
    return groups.classify(rollouts(spark, d), "uid", 6)


@query("g_1_retained", f"WITH {ROLLOUTS}, {STATUS} SELECT uid, row, reward, status FROM rollouts JOIN g USING (uid) WHERE status = 'kept' OR status IN ('incomplete', 'sampling_invalid') AND NOT invalid")
def _(spark, d):
    return groups.retained(rollouts(spark, d), "uid", 6).select("uid", "row", "reward", "status")


@query("g_2", "SELECT o_orderkey, o_totalprice AS reward, (o_orderstatus = 'P') OR o_orderkey % 8 = 0 AS invalid, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 8 = 0 THEN coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, 'reward_invalid') END AS invalid_reason FROM orders")
def _(spark, d):
    o = read(spark, d, "orders")
    valid = F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("boolean")).otherwise(F.lit(True))
    return groups.signals(o, F.col("o_totalprice"), valid, F.col("o_orderkey") % 8 == 0, F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))).select("o_orderkey", "reward", "invalid", "invalid_reason")


@query("g_3", f"""WITH {ROLLOUTS}, u AS (SELECT *, count(*) FILTER (NOT degraded) OVER (PARTITION BY uid) AS clean FROM rollouts), c AS (SELECT uid, row, reward FROM u WHERE clean < 3 OR NOT degraded),
  s AS (SELECT a.uid, a.row || ',' || b.row || ',' || c.row AS rows, [a.row, b.row, c.row] AS l, round(greatest(a.reward, b.reward, c.reward) - least(a.reward, b.reward, c.reward), 12) AS spread, len(list_distinct([a.reward, b.reward, c.reward]))::INT AS n_different FROM c a JOIN c b ON a.uid = b.uid AND a.row < b.row JOIN c ON c.uid = b.uid AND b.row < c.row)
  SELECT uid, spread, n_different, rows FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY spread DESC, n_different DESC, l) AS k FROM s) WHERE k = 1""")
def _(spark, d):
    return groups.best_subset(rollouts(spark, d), "uid", "row", 3)


@query("g_4", f"""WITH {ROLLOUTS}, b AS (SELECT uid, batch, (SELECT count(*) FROM rollouts x WHERE x.uid = r.uid AND x.batch <= r.batch AND NOT x.invalid) AS n, (SELECT max(reward) - min(reward) FROM rollouts x WHERE x.uid = r.uid AND x.batch <= r.batch AND NOT x.invalid) AS spread FROM (SELECT DISTINCT uid, batch FROM rollouts) r)
  SELECT uid, min(batch) FILTER (n >= 3 AND spread > 1e-12) AS ready_batch FROM b GROUP BY 1""")
def _(spark, d):
    return groups.accumulate(rollouts(spark, d), "uid", "batch", 3)


@query("g_5", f"WITH {ROLLOUTS} SELECT uid, min(orderkey) AS first_at FROM rollouts GROUP BY 1")
def _(spark, d):
    return groups.first_seen(rollouts(spark, d), "uid", "orderkey")


@query("g_6", """WITH x AS (SELECT conv_id, turn, role, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM conversations), y AS (SELECT *, max(c + n) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS longest FROM x)
  SELECT conv_id, turn, CAST(c AS BIGINT) AS context_length, n AS target_length FROM y WHERE role = 'assistant' AND longest <= 2000""")
def _(spark, d):
    c = read(spark, d, "conversations")
    return groups.examples(c, "conv_id", "turn", "role", F.length("text").cast("long"), 2000)


@query("g_7", f"WITH {TURNS}, l AS (SELECT trajectory, list(bucket ORDER BY turn) AS v FROM turns GROUP BY 1), m AS (SELECT *, max(len(v)) OVER (PARTITION BY trajectory % 8) AS w FROM l) SELECT trajectory, array_to_string(list_concat(list_transform(range(w - len(v)), lambda x: 0), v), ',') AS padded, array_to_string(list_concat(list_transform(range(w - len(v)), lambda x: 0), list_transform(v, lambda x: 1)), ',') AS mask FROM m")
def _(spark, d):
    v = turns(spark, d).groupBy("trajectory").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "bucket"))), lambda x: x["bucket"]).alias("v")).withColumn("b", F.col("trajectory") % 8)
    return groups.pad(v, "v", ["b"], 0, left=True).select("trajectory", F.array_join(F.col("padded").cast("array<string>"), ",").alias("padded"), F.array_join(F.col("mask").cast("array<string>"), ",").alias("mask"))


@query("g_8", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS index FROM conversations")
def _(spark, d):
    return groups.training_rows(read(spark, d, "conversations"), "role", ["conv_id", "turn"], "conv_id").select("conv_id", "turn", "role", "index")


@query("g_8_all", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS index FROM conversations")
def _(spark, d):
    made = groups.training_rows(read(spark, d, "conversations"), "role", ["conv_id", "turn"], "conv_id", {"extra_info": ["conv_id", "turn", "role"]})
    return made.select("extra_info.conv_id", "extra_info.turn", "extra_info.role", "index")


# Replay

@query("f_1", f"""WITH RECURSIVE {TURNS}, fold(trajectory, turn, phase, aspect, streak, max_streak, fallbacks, answered, blocked, rejected) AS (
  SELECT trajectory, -1::BIGINT, 'eliciting', 0, 0, 0, 0, 0, 0, 0 FROM (SELECT DISTINCT trajectory FROM turns)
  UNION ALL
  SELECT n.trajectory, n.turn,
    CASE WHEN gone OR bad THEN phase WHEN closes AND aspect >= 2 THEN 'done' WHEN closes THEN 'eliciting' WHEN found THEN 'answer_required' WHEN failed THEN 'retry_required' WHEN idle AND run >= 4 THEN 'search_required' ELSE phase END,
    CASE WHEN NOT gone AND NOT bad AND closes THEN aspect + 1 ELSE aspect END,
    CASE WHEN gone OR bad THEN streak WHEN closes THEN 0 ELSE run END, CASE WHEN gone OR bad THEN max_streak ELSE greatest(max_streak, run) END,
    CASE WHEN gone OR bad THEN fallbacks WHEN closes THEN 0 WHEN failed THEN fallbacks + 1 ELSE fallbacks END,
    answered + (NOT gone AND NOT bad AND seen)::INT, blocked + (NOT gone AND NOT bad AND failed AND fallbacks >= 1)::INT, rejected + (NOT gone AND bad)::INT
  FROM (SELECT *, seen OR failed AND fallbacks >= 1 AS closes, CASE WHEN idle THEN streak + 1 WHEN found OR seen OR (choice = 'action' AND outcome = 'progress') THEN 0 ELSE streak END AS run FROM (
    SELECT t.trajectory, t.turn, t.choice, t.outcome, f.phase, f.aspect, f.streak, f.max_streak, f.fallbacks, f.answered, f.blocked, f.rejected, f.phase = 'done' AS gone,
      (f.phase IN ('search_required', 'retry_required') AND t.choice <> 'search') OR (f.phase = 'answer_required' AND (t.choice <> 'answer' OR t.outcome <> 'visible')) AS bad,
      t.choice = 'search' AND t.outcome = 'normal' AS found, t.choice = 'search' AND t.outcome <> 'normal' AS failed, t.choice = 'answer' AND t.outcome = 'visible' AS seen,
      f.phase = 'eliciting' AND ((t.choice = 'action' AND t.outcome <> 'progress') OR (t.choice = 'answer' AND t.outcome <> 'visible')) AS idle
    FROM fold f JOIN turns t ON t.trajectory = f.trajectory AND t.turn = f.turn + 1)) n)
  SELECT trajectory, (turn + 1)::INT AS turns, phase, aspect, streak, max_streak, fallbacks, answered, blocked, rejected FROM (SELECT *, max(turn) OVER (PARTITION BY trajectory) AS last FROM fold) WHERE turn = last""")
def f_1(spark, d):
    return control.replay(turns(spark, d), "trajectory", "turn")


def talk(spark, d):
    """turns() as calls, feedback and a first message: what public_control takes."""
    b, aspect = F.col("bucket").cast("string"), F.element_at(F.array(F.lit("hotel"), F.lit("flight")), (F.abs("bucket") % 2 + 1).cast("int"))
    content = F.when(F.col("choice") == "search", F.concat(aspect, F.lit(" offer "), b)).when(F.col("choice") == "answer", F.concat(F.upper(F.substr(aspect, F.lit(1), F.lit(1))), b)).otherwise(F.concat(F.lit("which "), aspect, F.lit(" suits "), b))
    heard = F.when(F.col("outcome") == "normal", "found H1, H2, H3, F1, F2").when(F.col("outcome") == "fallback", "the search backend is unavailable").when(F.col("outcome") == "progress", F.concat(F.lit("reply "), F.col("turn").cast("string"))).when(F.col("outcome") == "empty", "nothing").otherwise("no preference")
    return turns(spark, d).select("trajectory", "turn", "choice", content.alias("content"), heard.alias("feedback"), F.lit("A flight and a hotel, please").alias("message"))


@query("f_1_public")
def _(spark, d):
    return public_control.replay(public_control.walk(talk(spark, d), "trajectory", "turn"), "trajectory", "turn")


@query("f_2_public")
def _(spark, d):
    return public_control.walk(talk(spark, d), "trajectory", "turn").where("refusal IS NOT NULL").select("trajectory", "turn", "phase_before", "refusal")


@query("f_5_public")
def _(spark, d):
    return public_control.boundaries(public_control.walk(talk(spark, d), "trajectory", "turn", follow=True), "trajectory", "turn")


@query("f_12_public")
def _(spark, d):
    return public_control.phase_counts(public_control.walk(talk(spark, d), "trajectory", "turn"), "trajectory")


@query("f_2", f"WITH {TURNS}, p AS (SELECT trajectory, turn, choice, outcome, CASE bucket WHEN 0 THEN 'done' WHEN 1 THEN 'search_required' WHEN 2 THEN 'retry_required' WHEN 3 THEN 'answer_required' ELSE 'eliciting' END AS phase FROM turns) SELECT trajectory, turn, CASE WHEN phase = 'done' THEN 'episode is complete' WHEN phase = 'search_required' AND choice <> 'search' THEN 'a search is required' WHEN phase = 'retry_required' AND choice <> 'search' THEN 'a revised search is required' WHEN phase = 'answer_required' AND choice <> 'answer' THEN 'an answer is required' WHEN choice = 'answer' AND outcome <> 'visible' THEN 'the answer is not visible' END AS reason FROM p")
def _(spark, d):
    phase = F.element_at(F.array(*[F.lit(x) for x in (control.DONE, control.SEARCH, control.RETRY, control.ANSWER, control.ELICIT, control.ELICIT, control.ELICIT)]), (F.abs("bucket") + 1).cast("int"))
    t = turns(spark, d).withColumn("phase", F.when(F.col("bucket") < 0, control.ELICIT).otherwise(phase))
    return t.select("trajectory", "turn", control.guard(F.col("phase"), F.col("choice"), F.col("outcome")).alias("reason"))


SIGNED = TURNS + ", signed AS (SELECT *, choice || ':' || outcome || ':' || aspect || bucket AS signature, CASE WHEN choice = 'action' THEN aspect || bucket END AS meaning FROM turns)"


def signed(spark, d):
    t = turns(spark, d)
    ab = F.concat("aspect", F.col("bucket").cast("string"))
    return t.withColumn("signature", F.concat_ws(":", "choice", "outcome", ab)).withColumn("meaning", F.when(F.col("choice") == "action", ab))


@query("f_5", f"""WITH {SIGNED}, m AS (SELECT *, row_number() OVER (PARTITION BY trajectory, signature ORDER BY turn) > 1 AS seen, choice = 'search' AND outcome <> 'normal' AS failed, count(*) FILTER (choice = 'search' AND outcome <> 'normal') OVER (PARTITION BY trajectory ORDER BY turn) AS k, lag(choice = 'search' AND outcome = 'normal') OVER (PARTITION BY trajectory ORDER BY turn) AS b FROM signed)
  SELECT trajectory, turn, 'repeated' AS label FROM m WHERE seen UNION ALL SELECT trajectory, turn, 'first_fallback' FROM m WHERE failed AND k = 1 UNION ALL SELECT trajectory, turn, 'second_fallback' FROM m WHERE failed AND k = 2 UNION ALL SELECT trajectory, turn, 'search_to_answer' FROM m WHERE b AND choice = 'answer'""")
def _(spark, d):
    return control.boundaries(signed(spark, d), "trajectory", "turn", "signature")


@query("f_10", f"WITH {SIGNED}, m AS (SELECT *, row_number() OVER (PARTITION BY trajectory, signature ORDER BY turn) > 1 AS e, meaning IS NOT NULL AND row_number() OVER (PARTITION BY trajectory, meaning ORDER BY turn) > 1 AS s FROM signed) SELECT trajectory, count(*) FILTER (e) AS exact_repeats, count(*) FILTER (s AND NOT e) AS semantic_repeats FROM m GROUP BY 1")
def _(spark, d):
    return control.repeats(signed(spark, d), "trajectory", "turn", "signature", "meaning")


@query("f_11", f"WITH {TURNS}, s AS (SELECT trajectory, turn, bucket, list_filter([1, 2, 3], lambda x: x >= bucket % 4) AS l FROM turns), m AS (SELECT *, lag(l) OVER w AS b, lag(bucket) OVER w AS n FROM s WINDOW w AS (PARTITION BY trajectory ORDER BY turn)) SELECT trajectory, count(*) FILTER (len(list_filter(l, lambda x: NOT list_contains(b, x))) > 0 AND b IS NOT NULL OR bucket < n) AS violations FROM m GROUP BY 1")
def _(spark, d):
    s = turns(spark, d).withColumn("l", F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda x: x >= F.col("bucket") % 4))
    return control.monotone(s, "trajectory", "turn", "l", "bucket")


@query("f_18", f"WITH {TURNS}, r AS (SELECT *, sum((outcome = 'progress')::INT) OVER (PARTITION BY trajectory ORDER BY turn) AS run FROM turns), s AS (SELECT *, count(*) FILTER (outcome <> 'progress') OVER (PARTITION BY trajectory, run ORDER BY turn) AS nth FROM r) SELECT trajectory, max(nth) AS longest, min(turn) FILTER (nth = 5 AND outcome <> 'progress') AS stalled_at FROM s GROUP BY 1")
def _(spark, d):
    t = turns(spark, d).withColumn("ok", F.col("outcome") == "progress")
    return control.stall(t, "trajectory", "turn", "ok", 5)


@query("f_17", f"WITH {TURNS} SELECT trajectory, aspect, arg_min(CASE bucket % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.0 END, turn)::DOUBLE AS score FROM turns WHERE choice = 'answer' GROUP BY 1, 2")
def _(spark, d):
    t = turns(spark, d)
    k = F.col("bucket") % 3
    score = runs.answer_score(k, F.lit(0), F.array(F.lit(0), F.lit(1)))
    return runs.first_answers(t, "trajectory", "turn", "aspect", "choice", score)


# Contracts

@query("v_2", "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS content_hash FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def _(spark, d):
    return contracts.content_hash(read(spark, d, "conversations").where("text IS NOT NULL"), ["conv_id"], "turn", "text")


@query("v_4", "SELECT CAST(count(*) FILTER (o_orderkey % 10 = 0) AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right FROM orders")
def _(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return contracts.table_difference(o, o.where("o_orderkey % 10 <> 0"))


@query("v_11", """SELECT event_id, array_to_string(list_sort(list_filter(coalesce(json_keys(props), []), lambda k: k IN ('referrer', 'page', 'k', 'ref', 'ab'))), ',') AS hidden FROM events""")
def _(spark, d):
    return contracts.hidden_keys(read(spark, d, "events"), "props", ["referrer", "page", "k", "ref", "ab"]).select("event_id", "hidden")


@query("v_11_deep", "SELECT event_id AS key, t.fullkey AS path FROM events, json_tree(props) AS t WHERE t.key IN ('referrer', 'page', 'k', 'ref', 'ab')")
def _(spark, d):
    return contracts.hidden_paths(read(spark, d, "events"), "event_id", "props", ["referrer", "page", "k", "ref", "ab"])


@query("v_12", "SELECT doc_id, text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS copy FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    docs = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    return contracts.later_copies(docs, ["h"], "doc_id").select("doc_id", "copy")


@query("v_14", "SELECT sha256(text) AS h, min(doc_id) AS first_row, count(*) - 1 AS copies, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, bool_and(n_chars > 100) AS replay_ok, CASE WHEN count(DISTINCT lang) > 1 THEN 'mixed' ELSE min(lang) END AS policy FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(spark, d):
    docs = read(spark, d, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("h"), "doc_id", "source", "lang", (F.col("n_chars") > 100).alias("ok"))
    return contracts.merge_candidates(docs, ["h"], "doc_id", "lang", "source", "ok")


@query("v_15", "SELECT doc_id FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) = 1")
def _(spark, d):
    docs = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.concat_ws("\u0000", "text", "lang"), 256).alias("h"))
    return contracts.later_copies(docs, ["h"], "doc_id").where("NOT copy").select("doc_id")


@query("v_16", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS parts FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def _(spark, d):
    return runs.overlaps(read(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("v_17", f"WITH {TURNS}, x AS (SELECT trajectory, count(*) FILTER (outcome = 'visible') AS a, count(*) FILTER (outcome = 'fallback') AS f, arg_max(choice, turn) AS l FROM turns GROUP BY 1) SELECT trajectory, a = 0 OR f > 0 OR l <> 'answer' AS failed FROM x")
def _(spark, d):
    x = turns(spark, d).groupBy("trajectory").agg(F.count_if(F.col("outcome") == "visible").alias("a"), F.count_if(F.col("outcome") == "fallback").alias("f"), F.max_by("choice", "turn").alias("l"))
    ended = F.when(F.col("l") == "answer", "completed").otherwise("max_steps")
    return x.select("trajectory", runs.failed(F.col("a") > 0, F.col("a") / 1.0, F.col("f"), ended).alias("failed"))


@query("v_18", "SELECT l_orderkey, l_linenumber, e AS error FROM (SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_discount > 0.08 THEN 'discount_range' END, CASE WHEN l_quantity > 45 THEN 'quantity_range' END, CASE WHEN l_tax >= l_discount THEN 'tax_above_discount' END], lambda y: y IS NOT NULL)) AS e FROM lineitem)")
def _(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(expr.reasons((F.col("l_discount") > 0.08, "discount_range"), (F.col("l_quantity") > 45, "quantity_range"), (F.col("l_tax") >= F.col("l_discount"), "tax_above_discount"))).alias("error"))
    return rows


@query("v_19", "SELECT 'p' AS metric, count(*) AS compared, count(*) FILTER (o_orderkey % 50 = 0 AND o_totalprice <> 0) AS differing FROM orders UNION ALL SELECT 'q', count(*), 0 FROM orders")
def _(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), F.col("o_totalprice").alias("q"))
    return contracts.drift(o, o.withColumn("p", F.when(F.col("o_orderkey") % 50 == 0, F.col("p") * 1.001).otherwise(F.col("p"))), "o_orderkey", ["p", "q"], 1e-9)


# Text

@query("t_3", "SELECT conv_id, turn, text AS action, nxt AS reply FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND r = 'user'")
def _(spark, d):
    return runs.replies(read(spark, d, "conversations"), "conv_id", "turn", "role", "text", answer="user")


@query("t_5", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS choices FROM conversations GROUP BY 1")
def _(spark, d):
    return runs.sequence(read(spark, d, "conversations"), "conv_id", "turn", "role")


@query("t_6", r"SELECT doc_id, sha256(source || ':' || replace(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))), 'ß', 'ss')) AS h FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(expr.action_signature(F.col("source"), F.col("text")), 256).alias("h"))


FORM = "regexp_replace(array_to_string(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+'), ' '), '^search( |$)', '')"


@query("t_7", f"SELECT item_id, {FORM.format('text')} AS form FROM benchmark")
def _(spark, d):
    return read(spark, d, "benchmark").select("item_id", expr.query_form(F.col("text")).alias("form"))


@query("t_8", f"WITH x AS (SELECT conv_id, turn, {FORM.format('text')} AS f FROM conversations), y AS (SELECT *, lag(f) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM x) SELECT conv_id, turn, f <> '' AND b <> '' AND list_sort(string_split(f, ' ')) <> list_sort(string_split(b, ' ')) AS changed FROM y WHERE b IS NOT NULL")
def _(spark, d):
    from pyspark.sql import Window

    c = read(spark, d, "conversations").select("conv_id", "turn", expr.query_form(F.col("text")).alias("f")).withColumn("b", F.lag("f").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where("b IS NOT NULL").select("conv_id", "turn", expr.substantive_change(F.col("f"), F.col("b")).alias("changed"))


@query("t_9", r"SELECT c_custkey, array_to_string(list_distinct(list_concat(['x'], [])), '') || coalesce(nullif(regexp_extract('R' || c_custkey || ' ' || c_name, '\b[ACFHR][0-9]+\b'), ''), '') AS ids FROM customer")
def _(spark, d):
    c = read(spark, d, "customer")
    return c.select("c_custkey", F.concat(F.lit("x"), F.array_join(expr.option_ids(F.concat(F.lit("R"), F.col("c_custkey").cast("string"), F.lit(" "), F.col("c_name"))), ",")).alias("ids"))


@query("t_10", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'flight' WHEN 1 THEN 'hotel' WHEN 2 THEN 'apartment' WHEN 3 THEN 'rental_car' ELSE 'restaurant' END AS aspect FROM customer")
def _(spark, d):
    prefix = F.element_at(F.array(*[F.lit(p) for p in expr.PREFIXES]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return read(spark, d, "customer").select("c_custkey", expr.option_aspect(F.concat(prefix, F.col("c_custkey").cast("string"))).alias("aspect"))


@query("t_17", r"SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss') || ' on the ' || item_id || 'th & 1st_2nd tenth', '\b(\d+)(st|nd|rd|th)\b', '\1', 'g'), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS form FROM benchmark")
def _(spark, d):
    text = F.concat("text", F.lit(" on the "), F.col("item_id").cast("string"), F.lit("th & 1st_2nd tenth"))
    return read(spark, d, "benchmark").select("item_id", expr.search_form(text).alias("form"))


@query("t_22", "SELECT event_id, props AS object FROM events WHERE json_valid(props)")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", expr.json_salvage(F.concat(F.lit("noise ```json\n"), F.col("props"), F.lit("\n``` more"))).alias("object"))
    return e.where("object IS NOT NULL")


@query("t_24", "SELECT o_orderkey, 'flight,hotel' AS aspects, (2 + o_orderkey % 3) || '' || (2 + o_custkey % 3) AS composition FROM orders")
def _(spark, d):
    tid = F.concat(F.lit("flight:"), (2 + F.col("o_orderkey") % 3).cast("string"), F.lit("-100|hotel:"), (2 + F.col("o_custkey") % 3).cast("string"), F.lit("-104"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(expr.task_aspects(tid), ",").alias("aspects"), expr.task_composition(tid).alias("composition"))


@query("x_1", "SELECT l_orderkey, l_linenumber, 'P' || (before + 1) AS first_id, 'P' || (before + n) AS last_id FROM (SELECT l_orderkey, l_linenumber, n, CAST(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - n AS BIGINT) AS before FROM (SELECT l_orderkey, l_linenumber, 1 + l_partkey % 4 AS n FROM lineitem))")
def _(spark, d):
    x = runs.item_ids(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (1 + F.col("l_partkey") % 4).alias("n")), "l_orderkey", "l_linenumber", "n")
    return x.select("l_orderkey", "l_linenumber", F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@query("x_22", f"WITH {TURNS} SELECT trajectory, CASE WHEN arg_max(outcome, turn) = 'none' THEN 'no_tool_output' ELSE 'actor_stopped' END AS stop FROM turns GROUP BY 1")
def _(spark, d):
    return turns(spark, d).groupBy("trajectory").agg(F.max_by("outcome", "turn").alias("o")).select("trajectory", runs.stop_reason(F.col("o") != "none").alias("stop"))
