"""Contracts of task tables: source rows against their scenarios, pools of tasks, subsets against their manifests.

Each gives rows (key, problem), none for a table that is right. Repeated keys are found by an aggregation that is joined back,
scenarios by a join on their id; nothing is gathered but a scenario's own aspects. Defined results: a null breaks the rule that
asks for it; a null key is a problem of its own and counts as no other row's copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksmith.functions.expr import is_true, reasons

# Roles of a prompt's messages.
ROLES = ("system", "user")
_ITEM = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
_LIST = rf"(?s)^\s*\[\s*(?:{_ITEM}\s*(?:,\s*{_ITEM}\s*)*,?\s*)?\]\s*$"


def text_list(x: Column) -> Column:
    """The texts of a list literal in single or double quotes, as array<string>; null if it is anything else.

    Escapes are those of JSON; a comma may follow the last text.
    """
    plain = F.regexp_replace(x, r"(?s),\s*\]\s*$", "]")
    return F.when(x.rlike(_LIST), F.from_json(plain, "array<string>", {"allowSingleQuotes": "true"}))


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) == ""


def _roles_wrong(prompt: Column) -> Column:
    return ~is_true(F.transform(prompt, lambda m: m["role"]) == F.array(*[F.lit(r) for r in ROLES]))


def scenarios(rows: DataFrame, scenario: str, aspect: str, best: str) -> DataFrame:
    """(scenario, aspects, best_ids): how many aspects a scenario has, and the best ids that are known, repeats included."""
    return rows.groupBy(scenario).agg(F.count(aspect).alias("aspects"), F.collect_list(F.when(F.col(aspect).isNotNull(), F.col(best))).alias("best_ids"))


def source_problems(df: DataFrame, known: DataFrame, key: str, fixed: dict[str, str], split: str) -> DataFrame:
    """(key, problem) of source rows. known: scenarios() with a `difficulty`, by the column `task_id`.

    Columns of df: key, prompt (array of structs role, content), task_id, tool_task_id (where the tool's arguments name it), split,
    ground_truth (a list literal) and the columns of `fixed`, which must hold the named values. Problems that need a scenario
    are stated only if there is one: a row has no_scenario or those.
    """
    c = F.col
    rows = df.select(key, "prompt", "task_id", "tool_task_id", "split", "ground_truth", *fixed).join(known.select("task_id", "aspects", "best_ids", "difficulty", F.lit(True).alias("__known")), "task_id", "left").withColumn("__truth", text_list(c("ground_truth")))
    has = is_true(c("__known"))
    whole = c("aspects") == F.size("best_ids")
    same = (F.size("__truth") == F.size("best_ids")) & (F.array_sort(F.array_distinct("__truth")) == F.array_sort(F.array_distinct("best_ids")))
    why = reasons(
        *[(~c(name).eqNullSafe(F.lit(value)), f"other_{name}") for name, value in fixed.items()],
        (_roles_wrong(c("prompt")), "roles"), (F.exists("prompt", lambda m: m["content"].isNull()), "content_missing"), (_blank(c("task_id")), "no_task_id"), (~c("split").eqNullSafe(F.lit(split)), "other_split"),
        (~c("tool_task_id").eqNullSafe(c("task_id")), "tool_task_id"), (~has & ~_blank(c("task_id")), "no_scenario"), (has & (c("aspects") == 0), "no_aspects"), (has & ~whole, "best_id_missing"),
        (c("__truth").isNull(), "ground_truth_no_list"), (has & whole & (c("aspects") > 0) & ~F.coalesce(same, F.lit(True)), "ground_truth_differs"), (has & _blank(c("difficulty")), "no_difficulty"))
    return rows.select(key, F.explode(why).alias("problem"))


def pool_problems(df: DataFrame, key: str, prompt: str, texts: list[str], split: str, wanted: str) -> DataFrame:
    """(key, problem, n): n is the number of rows of a key that have the problem; an empty pool has one row, `empty` of a null key."""
    why = reasons((_blank(F.col(key)), "no_id"), (_roles_wrong(F.col(prompt)), "roles"), *[(_blank(F.col(t)), f"no_{t}") for t in dict.fromkeys([*texts, split])], (~_blank(F.col(split)) & (F.col(split) != wanted), "other_split"))
    found = df.select(key, F.explode(why).alias("problem")).groupBy(key, "problem").agg(F.count("*").alias("n"))
    copies = df.where(~_blank(F.col(key))).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated_id").alias("problem"), "n")
    empty = df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast(df.schema[key].dataType).alias(key), F.lit("empty").alias("problem"), "n")
    return found.unionByName(copies).unionByName(empty)


def manifest_entries(lines: DataFrame, ids: str, strata: str) -> DataFrame:
    """(ord, id, stratum) of a manifest's two lists, in a row each; a shorter list is filled with nulls."""
    return lines.select(F.posexplode(F.arrays_zip(F.col(ids).alias("id"), F.col(strata).alias("stratum"))).alias("ord", "e")).select(F.col("ord").cast("long").alias("ord"), "e.id", "e.stratum")


def subset_problems(dataset: DataFrame, entries: DataFrame, quotas: DataFrame, header: dict, expected: dict, ord: str, key: str, stratum: str) -> DataFrame:
    """(problem, place, stated, found) of a subset against its manifest; no rows if it is the manifest's.

    entries: (ord, id, stratum) as the manifest lists them; quotas: (stratum, quota); header: the manifest's own figures, of which
    those in `expected` must be equal and `selected_task_count` the number of rows. The order counts: a row is compared with the
    entry of its place, so the join is by place and no list is gathered.
    """
    rows = dataset.select(F.col(ord).cast("long").alias("ord"), F.col(key).cast("string").alias("d_id"), F.col(stratum).cast("string").alias("d_stratum"))
    text = lambda x: F.lit(None if x is None else str(x)).cast("string")
    said = lambda problem, place, stated, found: F.struct(F.lit(problem).alias("problem"), place.alias("place"), stated.alias("stated"), found.alias("found"))
    place = F.col("ord").cast("string")
    both = rows.join(entries.select("ord", F.col("id").cast("string").alias("id"), F.col("stratum").cast("string").alias("stratum")), "ord", "full")
    at = F.array_compact(F.array(F.when(~F.col("id").eqNullSafe(F.col("d_id")), said("id", place, F.col("id"), F.col("d_id"))), F.when(~F.col("stratum").eqNullSafe(F.col("d_stratum")), said("stratum", place, F.col("stratum"), F.col("d_stratum")))))
    out = both.select(F.explode(at).alias("p")).select("p.*")
    copies = rows.groupBy("d_id").agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(copies.select(F.lit("repeated_id").alias("problem"), F.col("d_id").alias("place"), F.lit("1").alias("stated"), F.col("n").cast("string").alias("found")))
    counts = rows.groupBy(F.col("d_stratum").alias("stratum")).agg(F.count("*").alias("n")).join(quotas.select(F.col("stratum").cast("string").alias("stratum"), F.col("quota").cast("long").alias("quota")), "stratum", "full")
    out = out.unionByName(counts.where("NOT quota <=> n").select(F.lit("quota").alias("problem"), F.col("stratum").alias("place"), F.col("quota").cast("string").alias("stated"), F.col("n").cast("string").alias("found")))
    total = rows.agg(F.count("*").alias("n"))
    own = [F.when(~F.col("n").cast("string").eqNullSafe(text(header.get("selected_task_count"))), said("selected_task_count", F.lit(None).cast("string"), text(header.get("selected_task_count")), F.col("n").cast("string")))]
    own += [F.when(F.lit(header.get(name) != value), said(name, F.lit(None).cast("string"), text(value), text(header.get(name)))) for name, value in expected.items()]
    return out.unionByName(total.select(F.explode(F.array_compact(F.array(*own))).alias("p")).select("p.*"))
