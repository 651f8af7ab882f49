"""Splits, apportionment and sampling that no layout or run changes.

Rows are ranked by a hash of their id. hash_rank() does so without sorting a stratum in one task: a row's rank is its
rank among the rows of its stratum with the same first hash digits, plus the number of rows with smaller ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions import expr

DIGITS = 2
#: Values of `accept` (a wave's seats by waves) that waves() works out in one job.
WAVE_ROWS = 100_000


def hash_rank(df: DataFrame, strata: list[str], key: str, tie: str, out: str = "rank") -> DataFrame:
    """df with each row's rank (from 1) by (key, tie) in its strata; key is a hex hash."""
    cut = df.withColumn("__prefix", F.substr(F.col(key), F.lit(1), F.lit(DIGITS)))
    sizes = cut.groupBy(*strata, "__prefix").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*strata).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*strata, "__prefix").orderBy(key, tie))
    return cut.withColumn("__own", own).join(sizes, [*strata, "__prefix"]).withColumn(out, F.col("__own") + F.col("__before")).drop("__prefix", "__own", "__before")


def keyed(df: DataFrame, task: str, seed: str, out: str = "key") -> DataFrame:
    return df.withColumn(out, expr.stable_key(seed, F.col(task)))


def quota_slices(df: DataFrame, quotas: DataFrame, stratum: str, task: str, seed: str) -> DataFrame:
    """Consecutive slices of each stratum's hash order; quotas: (stratum, split, place, n). Rows beyond the quotas go."""
    upto = Window.partitionBy(stratum).orderBy("place")
    ends = quotas.withColumn("__high", F.sum("n").over(upto)).withColumn("__low", F.col("__high") - F.col("n")).drop("n", "place")
    ranked = hash_rank(keyed(df, task, seed), [stratum], "key", task)
    return ranked.join(ends, stratum).where((F.col("rank") > F.col("__low")) & (F.col("rank") <= F.col("__high"))).drop("__low", "__high")


def pairwise_overlaps(df: DataFrame, split: str, task: str) -> DataFrame:
    """(left_split, right_split, overlap) of every pair of splits, zeros too."""
    members = df.select(F.col(split).alias("s"), F.col(task).alias("t")).distinct()
    names = members.select("s").distinct()
    pairs = names.select(F.col("s").alias("left_split")).join(names.select(F.col("s").alias("right_split")), F.expr("left_split < right_split"))
    found = members.alias("l").join(members.alias("r"), F.expr("l.t = r.t AND l.s < r.s")).groupBy(F.col("l.s").alias("left_split"), F.col("r.s").alias("right_split")).agg(F.count("*").alias("n"))
    return pairs.join(found, ["left_split", "right_split"], "left").select("left_split", "right_split", F.coalesce("n", F.lit(0)).alias("overlap"))


def sizes(df: DataFrame, stratum: str) -> DataFrame:
    return df.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"))


def largest_remainder(strata: DataFrame, target: int) -> DataFrame:
    """(stratum, quota) from (stratum, n): integer shares, then leftovers by remainder (desc), name (asc). A table of strata."""
    total = F.sum("n").over(Window.partitionBy())
    shares = strata.withColumn("total", total).withColumn("floor", F.expr(f"{target} * n DIV total")).withColumn("rest", F.expr(f"{target} * n % total"))
    left = F.lit(target) - F.sum("floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("rest"), "stratum"))
    checked = shares.withColumn("quota", F.when(F.col("total") < target, F.raise_error(F.lit("the target exceeds the rows"))).otherwise(F.col("floor") + F.when(place <= left, 1).otherwise(0)))
    return checked.select("stratum", F.col("quota").cast("long").alias("quota"))


def largest_remainder_share(strata: DataFrame, target: int) -> DataFrame:
    """The same with floating-point shares; (stratum, quota)."""
    exact = F.lit(float(target)) * F.col("n") / F.sum("n").over(Window.partitionBy())
    shares = strata.withColumn("exact", exact).withColumn("floor", F.floor("exact"))
    left = F.lit(target) - F.sum("floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("floor")), "stratum"))
    return shares.withColumn("quota", F.col("floor") + F.when(place <= left, 1).otherwise(0)).select("stratum", F.col("quota").cast("long").alias("quota"))


def capped_remainder(strata: DataFrame, target: int) -> DataFrame:
    """Largest remainder with capacities: (stratum, n, capacity) -> quota. Leftovers go round in order of fractions."""
    exact = F.lit(float(target)) * F.col("n") / F.sum("n").over(Window.partitionBy())
    shares = strata.withColumn("exact", exact).withColumn("floor", F.least(F.floor("exact"), F.col("capacity")))
    left = shares.withColumn("left", F.lit(target) - F.sum("floor").over(Window.partitionBy())).withColumn("fraction", F.col("exact") - F.floor("exact"))
    # One row for each unit that a stratum could still take: pass 1 offers each stratum one unit, pass 2 the next.
    offers = left.where("capacity > floor AND left > 0").select("stratum", "fraction", "left", F.explode(F.expr("sequence(1, least(capacity - floor, left))")).alias("pass"))
    taken = offers.withColumn("place", F.row_number().over(Window.orderBy("pass", F.desc("fraction"), "stratum"))).where("place <= left").groupBy("stratum").agg(F.count("*").alias("extra"))
    return left.join(taken, "stratum", "left").select("stratum", (F.col("floor") + F.coalesce("extra", F.lit(0))).cast("long").alias("quota"))


def coverage_first(strata: DataFrame, target: int) -> DataFrame:
    """One for each stratum if the target allows, the rest by capped_remainder on what is left."""
    covered = strata.withColumn("one", F.when(F.count("*").over(Window.partitionBy()) <= target, 1).otherwise(0))
    given = strata.count()
    first = 1 if given <= target else 0
    rest = capped_remainder(covered.select("stratum", (F.col("n") - F.col("one")).alias("n"), (F.col("n") - F.col("one")).alias("capacity")), target - first * given)
    return rest.select("stratum", (F.col("quota") + first).alias("quota"))


def two_way(strata: DataFrame, target: int) -> DataFrame:
    """(stratum, quota, gold, silver) -> gold quotas that add up to target within max(0, quota - silver) .. min(quota, gold).

    They start at the rounded ideal share, clipped; units are then added where (now - ideal, name) is least, or taken
    where it is greatest. Each unit changes that by one, so that all units can be ranked at once.
    """
    ideal = F.lit(float(target)) * F.col("quota") / F.sum("quota").over(Window.partitionBy())
    bounds = strata.withColumn("ideal", ideal).withColumn("low", F.greatest(F.lit(0), F.col("quota") - F.col("silver"))).withColumn("high", F.least("quota", "gold"))
    start = bounds.withColumn("now", F.greatest("low", F.least("high", F.floor("ideal")))).withColumn("missing", F.lit(target) - F.sum("now").over(Window.partitionBy()))
    more = start.where("missing > 0 AND high > now").select("stratum", "missing", "ideal", F.explode(F.expr("sequence(now, high - 1)")).alias("at"))
    more = more.withColumn("place", F.row_number().over(Window.orderBy(F.col("at") - F.col("ideal"), "stratum"))).where("place <= missing").groupBy("stratum").agg(F.count("*").alias("change"))
    less = start.where("missing < 0 AND now > low").select("stratum", "missing", "ideal", F.explode(F.expr("sequence(low + 1, now)")).alias("at"))
    less = less.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("at") - F.col("ideal")), F.desc("stratum")))).where("place <= -missing").groupBy("stratum").agg((-F.count("*")).alias("change"))
    return start.join(more.unionByName(less), "stratum", "left").select("stratum", (F.col("now") + F.coalesce("change", F.lit(0))).cast("long").alias("gold_quota"))


def holdout(df: DataFrame, quotas: DataFrame, strata: list[str], task: str, seed: str) -> DataFrame:
    """The first `quota` rows of each stratum by the hash of (stratum's last column, id)."""
    key = F.sha2(F.concat_ws("\u0000", F.lit(seed), F.col(strata[-1]), F.col(task)), 256)
    return hash_rank(df.withColumn("key", key), strata, "key", task).join(quotas, strata).where("rank <= quota").drop("quota")


def mask_split(df: DataFrame, chosen: DataFrame, task: str) -> DataFrame:
    """df with `part`: validation if the id is chosen, else train."""
    marks = chosen.select(task).distinct().withColumn("__in", F.lit(True))
    return df.join(marks, task, "left").withColumn("part", F.when(F.col("__in"), "validation").otherwise("train")).drop("__in")


def missing_ids(df: DataFrame, chosen: DataFrame, task: str) -> DataFrame:
    """Chosen ids that df lacks; must be empty."""
    return chosen.select(task).distinct().join(df.select(task), task, "left_anti")


def stratified_plan(df: DataFrame, stratum: str, task: str, seed: str, target: int) -> DataFrame:
    """Integer largest-remainder quotas, and their first rows in hash order: (stratum, task, rank)."""
    quotas = largest_remainder(sizes(df, stratum), target).withColumnRenamed("stratum", stratum)
    return hash_rank(keyed(df, task, seed), [stratum], "key", task).join(quotas, stratum).where("rank <= quota").select(stratum, task, "rank")


def next_wave(state: DataFrame, wave: int) -> DataFrame:
    """(stratum, quota, accepted, untried) -> seats of the next wave by highest averages.

    Capacity is the deficit, at most the untried; seat i of a stratum has the average capacity / i. Ties: the larger
    capacity, then the larger name.
    """
    capacity = F.least(F.greatest(F.lit(0), F.col("quota") - F.col("accepted")), F.col("untried"))
    offers = state.withColumn("capacity", capacity).where("capacity > 0").select("stratum", "capacity", F.explode(F.expr(f"sequence(1, least(capacity, {wave}))")).alias("seat"))
    ranked = offers.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("capacity") / F.col("seat")), F.desc("capacity"), F.desc("stratum"))))
    return state.select("stratum").join(ranked.where(f"place <= {wave}").groupBy("stratum").agg(F.count("*").alias("seats")), "stratum", "left").select("stratum", F.coalesce("seats", F.lit(0)).alias("seats"))


def _wave(state: Column, wave: int, accepts: Column) -> Column:
    """An array of strata (in order of their names) after one wave, by the rule of next_wave(); accepts: of 0, 1, ... seats."""
    capacity = F.transform(state, lambda s: F.least(F.greatest(F.lit(0), s["quota"] - s["accepted"]), s["untried"]))
    nothing = F.array().cast("array<struct<average:double,capacity:bigint,place:int>>")

    def offers(c: Column, place: Column) -> Column:
        seats = F.transform(F.sequence(F.lit(1), F.least(c, F.lit(wave))), lambda seat: F.struct((c / seat).alias("average"), c.cast("long").alias("capacity"), place.alias("place")))
        return F.when(c > 0, seats).otherwise(nothing)

    def seated(best: Column) -> Column:
        def moved(s: Column, place: Column) -> Column:
            own = F.size(F.filter(best, lambda o: o["place"] == place))
            return expr.let(own, lambda n: F.struct(s["stratum"].alias("stratum"), s["quota"].alias("quota"), (s["accepted"] + F.get(accepts, n)).cast("long").alias("accepted"), (s["untried"] - n).cast("long").alias("untried")))

        return F.transform(state, moved)

    return expr.let(F.slice(F.sort_array(F.flatten(F.transform(capacity, offers)), False), 1, wave), seated)


def waves(state: DataFrame, wave: int, accept: Column) -> DataFrame:
    """Waves until every quota is met or nothing is left to try: (stratum, accepted, untried, waves, exhausted).

    `accept` says how many of a wave's seats succeed, from columns seats and wave_no. State is a row a stratum. A wave needs
    the one before, so the strata are folded over as many waves at a time as WAVE_ROWS values of `accept` allow: a job each.
    """
    spark = state.sparkSession
    long = [F.col(c).cast("long").alias(c) for c in ("quota", "accepted", "untried")]
    now = state.select(F.sort_array(F.collect_list(F.struct("stratum", *long))).alias("strata"), F.lit(0).cast("long").alias("number"))
    waiting = lambda strata: F.exists(strata, lambda s: expr.is_true((s["accepted"] < s["quota"]) & (s["untried"] > 0)))
    size = max(1, WAVE_ROWS // (wave + 1))

    def step(acc: Column, accepts: Column) -> Column:
        return F.when(waiting(acc["strata"]), F.struct(_wave(acc["strata"], wave, accepts).alias("strata"), (acc["number"] + 1).alias("number"))).otherwise(acc)

    first = 1
    now = spark.createDataFrame(now.collect(), now.schema)  # one row, a struct a stratum
    while not now.where(waiting(F.col("strata"))).isEmpty():
        seats = spark.range(size * (wave + 1)).select((F.col("id") % (wave + 1)).alias("seats"), (F.floor(F.col("id") / (wave + 1)) + first).cast("int").alias("wave_no"))
        each = seats.select("wave_no", F.struct("seats", accept.alias("n")).alias("s")).groupBy("wave_no").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["n"]).alias("accepts"))
        table = each.agg(F.transform(F.sort_array(F.collect_list(F.struct("wave_no", "accepts"))), lambda w: w["accepts"]).alias("accepts"))
        now = now.crossJoin(table).select(F.aggregate("accepts", F.struct("strata", "number"), step).alias("s")).select("s.*")
        now = spark.createDataFrame(now.collect(), now.schema)
        first += size
    return now.select(F.explode("strata").alias("s"), F.col("number").alias("waves")).select("s.stratum", "s.accepted", "s.untried", "waves", (F.col("s.accepted") < F.col("s.quota")).alias("exhausted"))


def proportional_subset(df: DataFrame, stratum: str, task: str, seed: str, target: int) -> DataFrame:
    """Proportional quotas by floating-point shares, hash order inside a stratum (in place of a seeded shuffle)."""
    quotas = largest_remainder_share(sizes(df, stratum), target).withColumnRenamed("stratum", stratum)
    return hash_rank(keyed(df, task, seed), [stratum], "key", task).join(quotas, stratum).where("rank <= quota").drop("quota", "key", "rank")


def round_robin(df: DataFrame, stratum: str, order: str, preferred: list[str], size: int) -> DataFrame:
    """A batch that takes one row of each preferred stratum in turn, in row order: (.., turn, place)."""
    places = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(stratum))
    some = df.withColumn("__at", places).where("__at > 0")
    # No stratum gives more than `size` rows, so only those can matter.
    turn = some.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(f"turn <= {size}")
    return turn.orderBy("turn", "__at").limit(size).drop("__at")


def probe_pick(df: DataFrame, task: str, context: str, seed: str, size: int) -> DataFrame:
    """Records in hash order, one a task first, then more of the same tasks: the first `size`."""
    key = df.withColumn("key", F.sha2(F.concat_ws("\u0000", F.lit(seed), F.col(task).cast("string"), F.col(context).cast("string")), 256))
    own = key.withColumn("again", (F.row_number().over(Window.partitionBy(task).orderBy("key", context)) > 1).cast("int"))
    return own.orderBy("again", "key", context).limit(size)


def overlap_count(a: DataFrame, b: DataFrame, task: str) -> DataFrame:
    """One row: (overlap), the ids in both; 0 if the parts are disjoint."""
    return a.select(task).distinct().join(b.select(task).distinct(), task, "left_semi").agg(F.count("*").alias("overlap"))


def outside_count(a: DataFrame, frozen: DataFrame, task: str) -> DataFrame:
    """One row: (outside), ids of a that the frozen split lacks."""
    return a.select(task).distinct().join(frozen.select(task), task, "left_anti").agg(F.count("*").alias("outside"))


def split_map(parts: DataFrame, task: str, split: str) -> DataFrame:
    """(task, split, conflict): the split of each id; conflict if it is in two."""
    return parts.groupBy(task).agg(F.min(split).alias(split), (F.countDistinct(split) > 1).alias("conflict"))


def assign_split(df: DataFrame, mapping: DataFrame, task: str, split: str) -> DataFrame:
    return df.join(mapping.select(task, split), task, "left").withColumn(split, F.coalesce(split, F.lit("unresolved")))


def best_by(df: DataFrame, task: str, rank: Column, value: str) -> DataFrame:
    """Per task the value of the greatest rank (a struct compares field by field)."""
    return df.groupBy(task).agg(F.max_by(value, rank).alias(value))


def readiness(df: DataFrame, required: DataFrame, stratum: str, least: int) -> DataFrame:
    """One row: (n_rows, missing_strata, ready)."""
    missing = required.join(df.select(F.col(stratum).alias("stratum")), "stratum", "left_anti").agg(F.count("*").alias("missing_strata"))
    return df.agg(F.count("*").alias("n_rows")).join(missing).withColumn("ready", (F.col("n_rows") >= least) & (F.col("missing_strata") == 0))
