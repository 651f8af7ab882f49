"""Registered queries: the sampler over updates, session ledgers and the stall cut."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracksmith.operators import ledger, sampling
from tracksmith.plans.bind import TURNS, read, turns
from tracksmith.plans.splits_queries import query

# Sampler: every ten customers' orders are a run; twelve orders in a row are an update of two prompts with three batches of two.
# Rewards of three in four runs hardly vary, so that runs skip and end.

_KIND = "CASE WHEN run % 4 = 0 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) % 4 ELSE CAST(o_orderkey % 53 = 0 AS BIGINT) END"


def updates(spark, d):
    n = F.row_number().over(Window.partitionBy("run").orderBy("o_orderkey")) - 1
    o = read(spark, d, "orders").withColumn("run", F.expr("o_custkey % 16")).withColumn("n", n.cast("long"))
    rows = o.select("run", F.expr("n DIV 12").alias("update"), F.expr("n DIV 6 % 2").alias("uid"), F.expr("n % 6 DIV 2").alias("batch"), F.expr("n % 6").alias("row"), F.expr(f"({_KIND}) / 4.0D").alias("reward"), F.expr("o_orderkey % 9 = 0").alias("invalid"), F.expr("o_orderstatus = 'P' OR o_orderkey % 7 = 0").alias("degraded"))
    return rows


UPDATES = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY o_orderkey) - 1 AS n FROM (SELECT *, o_custkey % 16 AS run FROM orders)),
  rolls AS (SELECT run, n // 12 AS update, n // 6 % 2 AS uid, n % 6 // 2 AS batch, n % 6 AS row, ({_KIND}) / 4.0::DOUBLE AS reward, o_orderkey % 9 = 0 AS invalid, o_orderstatus = 'P' OR o_orderkey % 7 = 0 AS degraded FROM numbered),
  prompts AS (SELECT DISTINCT run, update, uid FROM rolls),
  pool AS (SELECT p.*, b.batch, count(r.row) AS n, count(r.row) FILTER (NOT degraded) AS k, max(reward) - min(reward) AS spread, max(reward) FILTER (NOT degraded) - min(reward) FILTER (NOT degraded) AS clean FROM prompts p CROSS JOIN (SELECT unnest([0, 1, 2]) AS batch) b LEFT JOIN rolls r ON r.run = p.run AND r.update = p.update AND r.uid = p.uid AND r.batch <= b.batch AND NOT r.invalid GROUP BY ALL),
  after AS (SELECT run, update, batch, count(*) AS prompts, count(*) FILTER (CASE WHEN k >= 3 THEN clean > 1e-6 ELSE n >= 3 AND spread > 1e-6 END) AS ready FROM pool GROUP BY ALL),
  ends AS (SELECT run, update, max(prompts) AS prompts, CASE WHEN max(prompts) = 2 THEN min(batch) FILTER (ready >= 2) END AS ready_at FROM after GROUP BY ALL),
  streaks AS (SELECT *, CASE WHEN ready_at IS NOT NULL THEN 0 ELSE count(*) FILTER (prompts = 2 AND ready_at IS NULL) OVER (PARTITION BY run, g ORDER BY update) END AS skips FROM (SELECT *, count(ready_at) OVER (PARTITION BY run ORDER BY update) AS g FROM ends)),
  limits AS (SELECT run, min(update) FILTER (prompts = 2 AND skips > 10) AS lim FROM streaks GROUP BY run),
  decided AS (SELECT s.*, CASE WHEN update > lim THEN 'not_reached' WHEN update = lim THEN 'exhausted' WHEN prompts <> 2 THEN 'wrong_groups' WHEN ready_at IS NOT NULL THEN 'trained' ELSE 'skipped' END AS status FROM streaks s JOIN limits USING (run))"""


@query("g_4_updates", f"""WITH {UPDATES}, c AS (SELECT run, update, sum(n) AS candidates, count(*) FILTER (b > 1) AS across FROM (SELECT r.run, r.update, r.uid, count(*) AS n, count(DISTINCT batch) AS b FROM rolls r JOIN decided e ON e.run = r.run AND e.update = r.update WHERE NOT invalid AND batch <= coalesce(ready_at, 2) GROUP BY ALL) GROUP BY ALL)
  SELECT run, update, status, CASE WHEN status <> 'not_reached' THEN coalesce(ready_at + 1, 3)::BIGINT END AS sampled_batches, CASE WHEN status = 'trained' THEN prompts ELSE 0 END AS accepted, CASE WHEN status <> 'not_reached' THEN coalesce(candidates, 0)::BIGINT END AS candidates, CASE WHEN status <> 'not_reached' THEN coalesce(across, 0) END AS across_batches, CASE WHEN status <> 'not_reached' THEN skips END AS consecutive_skips FROM decided LEFT JOIN c USING (run, update)""")
def _(spark, d):
    return sampling.updates(updates(spark, d), size=3)


@query("g_4_selected", f"""WITH {UPDATES}, e AS (SELECT r.* FROM rolls r JOIN decided x ON x.run = r.run AND x.update = r.update WHERE status = 'trained' AND NOT invalid AND batch <= ready_at),
  u AS (SELECT *, count(*) FILTER (NOT degraded) OVER (PARTITION BY run, update, uid) AS k FROM e), c AS (SELECT * FROM u WHERE k < 3 OR NOT degraded),
  s AS (SELECT a.run, a.update, a.uid, a.row || ',' || b.row || ',' || c.row AS rows, [a.row, b.row, c.row] AS l, round(greatest(a.reward, b.reward, c.reward) - least(a.reward, b.reward, c.reward), 12) AS spread, len(list_distinct([a.reward, b.reward, c.reward]))::INT AS n_different FROM c a JOIN c b ON a.run = b.run AND a.update = b.update AND a.uid = b.uid AND a.row < b.row JOIN c ON c.run = b.run AND c.update = b.update AND c.uid = b.uid AND b.row < c.row)
  SELECT run, update, uid, spread, n_different, rows FROM s QUALIFY row_number() OVER (PARTITION BY run, update, uid ORDER BY spread DESC, n_different DESC, l) = 1""")
def _(spark, d):
    rows = updates(spark, d)
    return sampling.selected(rows, sampling.updates(rows, size=3), "row", 3)


# Ledger: a user's events are a session. Progress brings two preferences to light by the bucket, so that a bucket's second time
# counts more than it elicits; some events have snapshots with another fault.

def steps(spark, d):
    t = turns(spark, d).withColumn("b", F.abs("bucket"))
    upto = Window.partitionBy("trajectory").orderBy("turn")
    gone = F.flatten(F.collect_list(F.when(F.col("outcome") == "progress", F.array(F.concat(F.lit("p"), "b"), F.concat(F.lit("p"), F.col("b") + 3))).otherwise(F.array().cast("array<string>"))).over(upto))
    of = lambda outcome: F.array_distinct(F.collect_list(F.when(F.col("outcome") == outcome, F.col("aspect"))).over(upto))
    known, aspects = F.array(*[F.lit(f"p{k}") for k in range(10)]), F.array(*[F.lit(f"a{k}") for k in range(3)])
    light = lambda r: F.count_if((F.col("outcome") == "progress") & (F.col("b") % 2 == r)).over(upto)
    i, ask = F.col("event_id"), F.concat("aspect", F.lit(":"), (F.col("b") % 2).cast("string"))
    options = F.array(F.concat("aspect", F.lit("-"), "b"))
    none = F.array().cast("array<string>")
    return t.select(
        "trajectory", "turn", "choice", F.concat_ws(":", "choice", "outcome", "b").alias("signature"), F.when(F.col("choice") == "action", ask).alias("meaning"), F.when(F.col("choice") == "action", F.col("aspect")).alias("meaning_aspect"), (i % 10 == 0).alias("ambiguous"),
        F.when(F.col("choice") != "answer", none).when(i % 2 == 0, F.concat(options, F.array(F.concat(F.lit("a"), ((i + 1) % 3).cast("string"), F.lit("-9"))))).otherwise(options).alias("options"),
        known.alias("known"), aspects.alias("aspects"), F.when(i % 29 == 0, known).otherwise(F.array_except(known, gone)).alias("remaining"),
        F.concat(F.array_except(aspects, of("normal")), F.when(i % 41 == 0, F.array(F.lit("a9"))).otherwise(none)).alias("to_search"), F.when(i % 43 == 0, none).otherwise(of("visible")).alias("chosen"),
        (light(0) - (i % 37 == 0).cast("int")).cast("long").alias("active"), F.when(i % 47 != 0, light(1)).alias("passive"), (F.count_if(F.col("outcome") == "normal").over(upto) > F.count_if(F.col("outcome") == "visible").over(upto)).alias("has_options"))


_W = "OVER (PARTITION BY trajectory ORDER BY turn)"
_KNOWN = "list_transform(range(10), lambda x: 'p' || x)"
_LESS = "list_filter({a}, lambda x: NOT list_contains({b}, x))"
STEPS = TURNS + f""", raw AS (SELECT *, abs(bucket) AS b, flatten(list(CASE WHEN outcome = 'progress' THEN ['p' || abs(bucket), 'p' || (abs(bucket) + 3)] ELSE [] END) {_W}) AS gone, list_distinct(coalesce(list(aspect) FILTER (outcome = 'normal') {_W}, [])) AS found, list_distinct(coalesce(list(aspect) FILTER (outcome = 'visible') {_W}, [])) AS shown,
    count(*) FILTER (outcome = 'progress' AND abs(bucket) % 2 = 0) {_W} AS n0, count(*) FILTER (outcome = 'progress' AND abs(bucket) % 2 = 1) {_W} AS n1, count(*) FILTER (outcome = 'normal') {_W} > count(*) FILTER (outcome = 'visible') {_W} AS has_options FROM turns),
  steps AS (SELECT trajectory, turn, choice, choice || ':' || outcome || ':' || b AS signature, CASE WHEN choice = 'action' THEN aspect || ':' || (b % 2) END AS meaning, CASE WHEN choice = 'action' THEN aspect END AS meaning_aspect, event_id % 10 = 0 AS ambiguous,
    CASE WHEN choice <> 'answer' THEN [] WHEN event_id % 2 = 0 THEN [aspect || '-' || b, 'a' || ((event_id + 1) % 3) || '-9'] ELSE [aspect || '-' || b] END AS options, {_KNOWN} AS known, ['a0', 'a1', 'a2'] AS aspects,
    CASE WHEN event_id % 29 = 0 THEN {_KNOWN} ELSE {_LESS.format(a=_KNOWN, b="gone")} END AS remaining, list_concat({_LESS.format(a="['a0', 'a1', 'a2']", b="found")}, CASE WHEN event_id % 41 = 0 THEN ['a9'] ELSE [] END) AS to_search, CASE WHEN event_id % 43 = 0 THEN [] ELSE shown END AS chosen,
    n0 - (event_id % 37 = 0)::INT AS active, CASE WHEN event_id % 47 <> 0 THEN n1 END AS passive, has_options FROM raw),
  moved AS (SELECT *, {_LESS.format(a="remaining0", b="remaining")} AS newly, list_filter([
      CASE WHEN passive0 IS NULL THEN 'before_missing' END, CASE WHEN len({_LESS.format(a="to_search0", b="aspects")}) > 0 THEN 'before_unknown_aspect' END, CASE WHEN active0 < 0 THEN 'before_negative_count' END, CASE WHEN active0 + passive0 > 10 THEN 'before_more_elicited_than_known' END,
      CASE WHEN passive IS NULL THEN 'after_missing' END, CASE WHEN len({_LESS.format(a="to_search", b="aspects")}) > 0 THEN 'after_unknown_aspect' END, CASE WHEN active < 0 THEN 'after_negative_count' END, CASE WHEN active + passive > 10 THEN 'after_more_elicited_than_known' END,
      CASE WHEN len({_LESS.format(a="remaining", b="remaining0")}) > 0 THEN 'preferences_grow' END, CASE WHEN len({_LESS.format(a="to_search", b="to_search0")}) > 0 THEN 'aspects_grow' END, CASE WHEN len({_LESS.format(a="chosen0", b="chosen")}) > 0 THEN 'choices_shrink' END,
      CASE WHEN active < active0 THEN 'active_falls' END, CASE WHEN passive < passive0 THEN 'passive_falls' END, CASE WHEN active - active0 + passive - passive0 > len({_LESS.format(a="remaining0", b="remaining")}) THEN 'counts_exceed_elicited' END], lambda x: x IS NOT NULL) AS violations
    FROM (SELECT *, CASE WHEN turn = 0 THEN known ELSE lag(remaining) {_W} END AS remaining0, CASE WHEN turn = 0 THEN aspects ELSE lag(to_search) {_W} END AS to_search0, CASE WHEN turn = 0 THEN [] ELSE lag(chosen) {_W} END AS chosen0, CASE WHEN turn = 0 THEN 0 ELSE lag(active) {_W} END AS active0, CASE WHEN turn = 0 THEN 0 ELSE lag(passive) {_W} END AS passive0 FROM steps)),
  sound AS (SELECT *, len(violations) = 0 AS sound, list_sort(list_transform(newly, lambda x: {{'away': CASE WHEN 'a' || (x[2:]::INT % 3) = meaning_aspect THEN 0 ELSE 1 END, 'n': x[2:]::INT}})) AS s FROM moved),
  part AS (SELECT *, CASE WHEN sound THEN list_transform(s[:greatest(active - active0, 0)], lambda x: x.n) ELSE [] END AS act, CASE WHEN sound THEN {_LESS.format(a="to_search0", b="to_search")} ELSE [] END AS searched, CASE WHEN sound AND choice = 'answer' THEN list_filter(options, lambda o: list_contains({_LESS.format(a="chosen", b="chosen0")}, o[:2])) ELSE [] END AS answered FROM sound),
  credited2 AS (SELECT *, CASE WHEN sound THEN list_sort(list_filter(list_transform(newly, lambda x: x[2:]::INT), lambda x: NOT list_contains(act, x)))[:greatest(passive - passive0, 0)] ELSE [] END AS pas, flatten(list(searched) {_W}) AS so_far, coalesce(flatten(list(list_transform(answered, lambda o: o[:2])) OVER (PARTITION BY trajectory ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []) AS earlier FROM part),
  ledger AS (SELECT *, sound AND len(list_filter(answered, lambda o: NOT list_contains(earlier, o[:2]))) > 0 AS answer_progress, sound AND (len(act) + len(pas) + len(searched) > 0 OR active > active0 OR passive > passive0 OR len(list_filter(answered, lambda o: NOT list_contains(earlier, o[:2]))) > 0) AS progress FROM credited2)"""


def attributed(spark, d):
    aspect = lambda p: F.concat(F.lit("a"), (F.substr(p, F.lit(2)).cast("int") % 3).cast("string"))
    return ledger.attributed(ledger.transitions(steps(spark, d)), aspect, lambda o: F.substr(o, F.lit(1), F.lit(2)))


@query("f_10_ledger", f"""WITH {STEPS}, e AS (SELECT *, row_number() OVER (PARTITION BY trajectory, signature ORDER BY turn) > 1 AS e FROM ledger), m AS (SELECT *, NOT e AND meaning IS NOT NULL AND row_number() OVER (PARTITION BY trajectory, meaning, e ORDER BY turn) > 1 AS again FROM e),
  o AS (SELECT trajectory, turn, so_far, unnest(answered) AS o, unnest(range(len(answered))) AS k FROM ledger), a AS (SELECT trajectory, o[:2] AS initial, arg_min(o, turn * 100 + k) AS first, count(*) FILTER (NOT list_contains(so_far, o[:2])) AS u, count(*) FILTER (o[4:]::INT % 2 <> 0) AS w FROM o GROUP BY ALL), b AS (SELECT trajectory, string_agg(first, ',' ORDER BY first) AS answers, sum(u)::BIGINT AS u, sum(w)::BIGINT AS w FROM a GROUP BY 1),
  t AS (SELECT trajectory, count(*) FILTER (e) AS exact_repeats, count(*) FILTER (again) AS semantic_repeats, count(*) FILTER (ambiguous) AS ambiguous_actions, list_distinct(flatten(list(act))) AS a, list_distinct(flatten(list(pas))) AS p, list_distinct(flatten(list(searched))) AS c, count(*) FILTER (progress) AS progress_steps, count(*) FILTER (NOT sound) AS unsound_steps FROM m GROUP BY 1)
  SELECT trajectory, exact_repeats, semantic_repeats, ambiguous_actions, coalesce(array_to_string(list_transform(list_sort(a), lambda x: 'p' || x), ','), '') AS active, coalesce(array_to_string(list_transform(list_sort(p), lambda x: 'p' || x), ','), '') AS passive, coalesce(array_to_string(list_sort(c), ','), '') AS searched, progress_steps, unsound_steps, coalesce(answers, '') AS answers, coalesce(u, 0) AS unsearched_answers, coalesce(w, 0) AS wrong_answers FROM t LEFT JOIN b USING (trajectory)""")
def _(spark, d):
    return ledger.sessions(attributed(spark, d), lambda o: F.substr(o, F.lit(1), F.lit(2)), lambda o: F.substr(o, F.lit(4)).cast("int") % 2 == 0)


@query("f_11_violations", f"WITH {STEPS} SELECT trajectory, violation, count(*) AS n, min(turn) AS first_turn FROM (SELECT trajectory, turn, unnest(violations) AS violation FROM moved) GROUP BY ALL")
def _(spark, d):
    return ledger.violation_counts(ledger.transitions(steps(spark, d)))


@query("f_18_cut", f"""WITH RECURSIVE {STEPS}, fold AS (SELECT trajectory, -1::BIGINT AS turn, 0::BIGINT AS idle, 0::BIGINT AS longest, false AS pending, NULL::BIGINT AS recovery_at, NULL::BIGINT AS recovered_at, NULL::BIGINT AS stopped_at, true AS watching FROM (SELECT DISTINCT trajectory FROM steps)
  UNION ALL SELECT trajectory, turn, CASE WHEN live THEN idle ELSE idle0 END, CASE WHEN live THEN greatest(longest, idle) ELSE longest END, CASE WHEN live THEN opens ELSE pending END, CASE WHEN live AND opens THEN turn ELSE recovery_at END, CASE WHEN live AND saved THEN turn ELSE recovered_at END, CASE WHEN live AND (pending AND NOT saved OR stalled AND (recovery_at IS NOT NULL OR NOT has_options)) THEN turn ELSE stopped_at END, watching AND present
    FROM (SELECT *, stalled AND recovery_at IS NULL AND has_options AS opens FROM (SELECT *, NOT pending AND idle >= 3 AS stalled FROM (SELECT f.trajectory, l.turn, f.idle AS idle0, f.longest, f.pending, f.recovery_at, f.recovered_at, f.stopped_at, f.watching, l.passive IS NOT NULL AS present, l.has_options, f.watching AND l.passive IS NOT NULL AND f.stopped_at IS NULL AS live, f.pending AND l.choice = 'answer' AND l.answer_progress AS saved,
      CASE WHEN f.pending AND l.choice = 'answer' AND l.answer_progress OR NOT f.pending AND l.progress THEN 0 WHEN f.pending THEN f.idle ELSE f.idle + 1 END AS idle FROM fold f JOIN ledger l ON l.trajectory = f.trajectory AND l.turn = f.turn + 1))))
  SELECT trajectory, longest, recovery_at, recovered_at, stopped_at FROM fold QUALIFY row_number() OVER (PARTITION BY trajectory ORDER BY turn DESC) = 1""")
def _(spark, d):
    return ledger.stall_cut(attributed(spark, d).withColumn("sound", F.col("passive").isNotNull()), 3)
