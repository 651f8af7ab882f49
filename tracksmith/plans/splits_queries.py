"""Registered queries: splits, apportionment, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracksmith.functions import expr
from tracksmith.operators import splits
from tracksmith.plans import bind
from tracksmith.plans.bind import TASKS, read, tasks

SEED = "20240101"
KEY = f"sha256('{SEED}' || chr(0) || task_id)"
RANKED = f"ranked AS (SELECT *, {KEY} AS key, row_number() OVER (PARTITION BY composition ORDER BY {KEY}, task_id) AS rank FROM tasks)"
SIZES = "sizes AS (SELECT composition AS stratum, count(*) AS n FROM tasks GROUP BY 1)"
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query("sp_1", f"WITH {TASKS} SELECT task_id, {KEY} AS key FROM tasks")
def _(spark, d):
    return splits.keyed(tasks(spark, d), "task_id", SEED).select("task_id", "key")


def quotas(spark, d):
    sizes = splits.sizes(tasks(spark, d), "composition").withColumnRenamed("stratum", "composition")
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(k).alias("place"), F.lit(p).alias("share")) for k, (s, p) in enumerate([("sft_train", 27), ("sft_validation", 3), ("rl_train", 65), ("rl_validation", 5)])])
    return sizes.select("composition", "n", F.explode(parts).alias("p")).select("composition", "p.split", "p.place", F.expr("n * p.share DIV 100").alias("n"))


QUOTAS = f"{TASKS}, {SIZES}, quotas AS (SELECT stratum AS composition, split, place, n * share // 100 AS n FROM sizes, (VALUES ('sft_train',0,27),('sft_validation',1,3),('rl_train',2,65),('rl_validation',3,5)) v(split, place, share))"
SLICED = f"{QUOTAS}, {RANKED}, ends AS (SELECT composition, split, sum(n) OVER (PARTITION BY composition ORDER BY place) AS high, n FROM quotas), sliced AS (SELECT r.task_id, r.composition, e.split, r.rank FROM ranked r JOIN ends e ON e.composition = r.composition AND r.rank > e.high - e.n AND r.rank <= e.high)"


def sliced(spark, d):
    return splits.quota_slices(tasks(spark, d), quotas(spark, d), "composition", "task_id", SEED).select("task_id", "composition", "split", "rank")


@query("sp_2", f"WITH {SLICED} SELECT * FROM sliced")
def _(spark, d):
    return sliced(spark, d)


@query("sp_3", f"WITH {SLICED}, names AS (SELECT DISTINCT split FROM sliced) SELECT a.split AS left_split, b.split AS right_split, (SELECT count(*) FROM sliced x JOIN sliced y USING (task_id) WHERE x.split = a.split AND y.split = b.split) AS overlap FROM names a JOIN names b ON a.split < b.split")
def _(spark, d):
    return splits.pairwise_overlaps(sliced(spark, d), "split", "task_id")


LARGEST = "largest AS (SELECT stratum, CAST(floor + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= 120 - sum(floor) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT stratum, 120 * n // sum(n) OVER () AS floor, 120 * n % sum(n) OVER () AS rest FROM sizes))"


@query("sp_4", f"WITH {TASKS}, {SIZES}, {LARGEST} SELECT * FROM largest")
def _(spark, d):
    return splits.largest_remainder(splits.sizes(tasks(spark, d), "composition"), 120)


SHARES = "shares AS (SELECT stratum, CAST(floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, stratum) <= 200 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT stratum, 200::DOUBLE * n / sum(n) OVER () AS exact FROM sizes))"


@query("sp_5", f"WITH {TASKS}, {SIZES}, {SHARES} SELECT * FROM shares")
def _(spark, d):
    return splits.largest_remainder_share(splits.sizes(tasks(spark, d), "composition"), 200)


def capacities(spark, d):
    return splits.sizes(tasks(spark, d), "composition").withColumn("capacity", F.when(F.length("stratum") % 2 == 0, F.expr("n DIV 6")).otherwise(F.col("n")))


def _capped_sql(source: str, target: str) -> str:
    return f"""shared AS (SELECT stratum, least(floor(exact), capacity)::BIGINT AS floor, exact - floor(exact) AS fraction, capacity FROM (SELECT *, ({target})::DOUBLE * n / sum(n) OVER () AS exact FROM {source})),
    leftover AS (SELECT ({target}) - sum(floor) AS k FROM shared),
    offers AS (SELECT stratum, row_number() OVER (ORDER BY pass, fraction DESC, stratum) AS place FROM (SELECT stratum, fraction, unnest(range(1, capacity - floor + 1)) AS pass FROM shared)),
    capped AS (SELECT stratum, CAST(floor + (SELECT count(*) FROM offers o WHERE o.stratum = s.stratum AND o.place <= (SELECT k FROM leftover)) AS BIGINT) AS quota FROM shared s)"""


CAPS = "caps AS (SELECT stratum, n, CASE WHEN length(stratum) % 2 = 0 THEN n // 6 ELSE n END AS capacity FROM sizes)"


@query("sp_6", f"WITH {TASKS}, {SIZES}, {CAPS}, {_capped_sql('caps', '300')} SELECT * FROM capped")
def _(spark, d):
    return splits.capped_remainder(capacities(spark, d), 300)


@query("sp_7", f"WITH {TASKS}, {SIZES}, less AS (SELECT stratum, n - 1 AS n, n - 1 AS capacity FROM sizes), {_capped_sql('less', '77 - (SELECT count(*) FROM sizes)')} SELECT stratum, quota + 1 AS quota FROM capped")
def _(spark, d):
    return splits.coverage_first(splits.sizes(tasks(spark, d), "composition"), 77)


def tiers(spark, d):
    t = tasks(spark, d).withColumn("tier", F.when(F.col("ord") % 3 == 0, "silver").otherwise("gold"))
    return t.groupBy(F.col("composition").alias("stratum")).agg(F.count_if(F.col("tier") == "gold").alias("gold"), F.count_if(F.col("tier") == "silver").alias("silver")).withColumn("quota", F.expr("(gold + silver) DIV 4 + length(stratum)"))


@query("sp_8", f"""WITH {TASKS}, tiers AS (SELECT *, (gold + silver) // 4 + length(stratum) AS quota FROM (SELECT composition AS stratum, count(*) FILTER (ord % 3 <> 0) AS gold, count(*) FILTER (ord % 3 = 0) AS silver FROM tasks GROUP BY 1)),
  bounded AS (SELECT stratum, greatest(0, quota - silver) AS low, least(quota, gold) AS high, 200::DOUBLE * quota / sum(quota) OVER () AS ideal FROM tiers),
  started AS (SELECT *, greatest(low, least(high, floor(ideal)))::BIGINT AS now FROM bounded), gap AS (SELECT 200 - sum(now) AS k FROM started),
  more AS (SELECT stratum, row_number() OVER (ORDER BY k - ideal, stratum) AS place FROM (SELECT stratum, ideal, unnest(range(now, high)) AS k FROM started)),
  fewer AS (SELECT stratum, row_number() OVER (ORDER BY k - ideal DESC, stratum DESC) AS place FROM (SELECT stratum, ideal, unnest(range(low + 1, now + 1)) AS k FROM started))
  SELECT stratum, CAST(now + (SELECT count(*) FROM more m WHERE m.stratum = s.stratum AND place <= (SELECT k FROM gap)) - (SELECT count(*) FROM fewer f WHERE f.stratum = s.stratum AND place <= -(SELECT k FROM gap)) AS BIGINT) AS gold_quota FROM started s""")
def _(spark, d):
    return splits.two_way(tiers(spark, d), 200)


HOLD = f"sha256('{SEED}' || chr(0) || tier || chr(0) || task_id)"


@query("sp_9", f"WITH {TASKS}, tiered AS (SELECT *, CASE WHEN ord % 3 = 0 THEN 'silver' ELSE 'gold' END AS tier FROM tasks) SELECT task_id, composition, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY composition, tier ORDER BY {HOLD}, task_id) AS rank, count(*) OVER (PARTITION BY composition, tier) AS n FROM tiered) WHERE rank <= n // 10")
def _(spark, d):
    t = tasks(spark, d).withColumn("tier", F.when(F.col("ord") % 3 == 0, "silver").otherwise("gold"))
    quota = t.groupBy("composition", "tier").agg(F.expr("count(*) DIV 10").alias("quota"))
    return splits.holdout(t, quota, ["composition", "tier"], "task_id", SEED).select("task_id", "composition", "tier", "rank")


@query("sp_10", f"WITH {SLICED} SELECT task_id, composition, CASE WHEN task_id IN (SELECT task_id FROM sliced WHERE split = 'sft_validation') THEN 'validation' ELSE 'train' END AS part FROM tasks")
def _(spark, d):
    return splits.mask_split(tasks(spark, d), sliced(spark, d).where("split = 'sft_validation'"), "task_id").select("task_id", "composition", "part")


@query("sp_11", f"WITH {TASKS}, {SIZES}, {LARGEST}, {RANKED} SELECT r.composition, r.task_id, r.rank FROM ranked r JOIN largest l ON l.stratum = r.composition WHERE r.rank <= l.quota")
def _(spark, d):
    return splits.stratified_plan(tasks(spark, d), "composition", "task_id", SEED, 120)


def wave_state(spark, d):
    sizes = splits.sizes(tasks(spark, d), "composition")
    return sizes.select("stratum", F.expr("n DIV 2").alias("quota"), F.expr("n DIV 5").alias("accepted"), F.expr("n DIV 3").alias("untried"))


@query("sp_12", f"""WITH {TASKS}, {SIZES}, caps AS (SELECT stratum, least(greatest(0, n // 2 - n // 5), n // 3) AS capacity FROM sizes),
  seats AS (SELECT stratum, row_number() OVER (ORDER BY capacity / seat::DOUBLE DESC, capacity DESC, stratum DESC) AS place FROM (SELECT stratum, capacity, unnest(range(1, capacity + 1)) AS seat FROM caps))
  SELECT stratum, (SELECT count(*) FROM seats x WHERE x.stratum = c.stratum AND place <= 64) AS seats FROM caps c""")
def _(spark, d):
    return splits.next_wave(wave_state(spark, d), 64)


@query("sp_13")
def _(spark, d):
    return splits.waves(wave_state(spark, d), 64, F.expr("seats - seats DIV 4"))


@query("sp_14", f"WITH {TASKS}, {SIZES}, {SHARES}, {RANKED} SELECT r.task_id, r.composition, r.ord FROM ranked r JOIN shares l ON l.stratum = r.composition WHERE r.rank <= l.quota")
def _(spark, d):
    return splits.proportional_subset(tasks(spark, d), "composition", "task_id", SEED, 200)


@query("sp_15", f"WITH {TASKS} SELECT task_id, composition, ord, turn FROM (SELECT *, row_number() OVER (PARTITION BY composition ORDER BY ord) AS turn, list_position(['BUILDING','MACHINERY','FURNITURE'], composition) AS nth FROM tasks WHERE composition IN ('BUILDING','MACHINERY','FURNITURE')) ORDER BY turn, nth LIMIT 50")
def _(spark, d):
    return splits.round_robin(tasks(spark, d), "composition", "ord", ["BUILDING", "MACHINERY", "FURNITURE"], 50)


@query("sp_16", f"""WITH probes AS (SELECT o_custkey, o_orderkey, sha256('{SEED}' || chr(0) || o_custkey || chr(0) || o_orderkey) AS key FROM orders WHERE o_orderstatus = 'P'),
  ranked AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY key, o_orderkey) > 1 THEN 1 ELSE 0 END AS again FROM probes) SELECT o_custkey, o_orderkey, again FROM ranked ORDER BY again, key, o_orderkey LIMIT 24""")
def _(spark, d):
    records = read(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return splits.probe_pick(records, "o_custkey", "o_orderkey", SEED, 24).select("o_custkey", "o_orderkey", "again")


@query("sp_17", "SELECT (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS overlap, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS outside")
def _(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id")
    return splits.overlap_count(docs, labels, "doc_id").join(splits.outside_count(docs, labels, "doc_id"))


@query("sp_18", f"WITH {SLICED}, mapped AS (SELECT task_id, min(split) AS split FROM sliced GROUP BY 1) SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS task_id, coalesce(m.split, 'unresolved') AS split FROM orders LEFT JOIN mapped m ON m.task_id = CAST(o_custkey AS VARCHAR)")
def _(spark, d):
    mapping = splits.split_map(sliced(spark, d).select("task_id", "split"), "task_id", "split")
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("task_id"))
    return splits.assign_split(orders, mapping, "task_id", "split").select("o_orderkey", "task_id", "split")


@query("sp_19", "SELECT l_orderkey, arg_max(l_partkey, (l_quantity, l_returnflag = 'N', -l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def _(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linenumber")
    return splits.best_by(lines, "l_orderkey", F.struct("l_quantity", (F.col("l_returnflag") == "N").alias("f"), (-F.col("l_linenumber")).alias("n"), "l_partkey"), "l_partkey")


@query("sp_20", "SELECT count(*) AS n_rows, (SELECT count(*) FROM (VALUES ('BUILDING'),('MACHINERY'),('SPACE')) v(s) WHERE s NOT IN (SELECT c_mktsegment FROM customer)) AS missing_strata, false AS ready FROM customer")
def _(spark, d):
    required = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("SPACE",)], "stratum string")
    return splits.readiness(tasks(spark, d), required, "composition", 100)


@query("g_10", f"WITH {TASKS} SELECT task_id, CAST(('0x' || substr(sha256('{SEED}|' || task_id || '|' || ord), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM tasks")
def _(spark, d):
    return tasks(spark, d).select("task_id", expr.uniform(SEED, F.col("task_id"), F.col("ord")).alias("u"))
