"""Recovery data: open aspects, replays that follow named aspects, equal messages, next actions, contexts, audits."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALIGNED = "struct<current:int,closed:array<int>,ok:boolean>"


def next_open(aspects: Column, current: Column) -> Column:
    """Name of the first open aspect after place `current` (from 0), or null; aspects: array of (aspect, open)."""
    later = F.slice(aspects, current + F.lit(2), F.size(aspects))
    return F.get(F.filter(later, lambda x: x["open"]), F.lit(0))["aspect"]


def other_open(aspects: Column, name: Column) -> Column:
    """Name of the first open aspect, in public order, that isn't `name`; or null."""
    return F.get(F.filter(aspects, lambda x: x["open"] & ~x["aspect"].eqNullSafe(name)), F.lit(0))["aspect"]


def aligned_replay(turns: DataFrame, trajectory: str, turn: str, aspects: int) -> DataFrame:
    """(trajectory, current, closed, ok) after rows (trajectory, turn, named int, closes boolean, feedback boolean).

    Before a turn a closed current aspect gives way to the next open one, or to the first open one if none follows. An
    open aspect that the turn names becomes current. A turn without feedback changes nothing more, and makes ok false.
    """
    def merge(s: Column, t: Column) -> Column:
        closed = s["closed"]
        is_open = lambda x: ~F.array_contains(closed, x)
        left = F.filter(F.sequence(F.lit(0), F.lit(aspects - 1)), is_open)
        after = F.get(F.filter(left, lambda x: x > s["current"]), F.lit(0))
        at = F.when(is_open(s["current"]), s["current"]).otherwise(F.coalesce(after, F.get(left, F.lit(0)), s["current"]))
        now = F.when(F.array_contains(left, t["named"]), t["named"]).otherwise(at)
        then = F.when(t["feedback"] & t["closes"], F.array_union(closed, F.array(now))).otherwise(closed)
        return F.struct(now.alias("current"), then.alias("closed"), (s["ok"] & t["feedback"]).alias("ok")).cast(ALIGNED)

    start = F.struct(F.lit(0).alias("current"), F.array().cast("array<int>").alias("closed"), F.lit(True).alias("ok")).cast(ALIGNED)
    gathered = turns.groupBy(trajectory).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col("named").cast("int").alias("named"), "closes", "feedback"))).alias("t"))
    return gathered.select(trajectory, F.aggregate("t", start, merge).alias("s")).select(trajectory, "s.current", F.array_join(F.array_sort("s.closed").cast("array<string>"), ",").alias("closed"), "s.ok")


def same_message(a: Column, b: Column) -> Column:
    """Equal role and content; of assistants also the call's name and its parsed arguments. Unparsable arguments differ.

    a, b: structs of role, content, name, arguments. Two messages without a call (null name and arguments) are equal.
    """
    parsed = lambda m: F.to_json(F.try_parse_json(m["arguments"]))
    no_call = a["name"].isNull() & b["name"].isNull() & a["arguments"].isNull() & b["arguments"].isNull()
    call = a["name"].eqNullSafe(b["name"]) & F.coalesce(parsed(a) == parsed(b), F.lit(False))
    return a["role"].eqNullSafe(b["role"]) & (F.coalesce(a["content"], F.lit("")) == F.coalesce(b["content"], F.lit(""))) & ((F.coalesce(a["role"], F.lit("")) != "assistant") | no_call | call)


def next_action(contexts: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, ord, action): the action at or after the context's end, of the first source that begins with the context.

    contexts: (key, context array<string>); sources: (key, ord, messages array<string>, actions array<string>, null where
    a message is no action). Contexts without a match are left out.
    """
    n = F.size("context")
    begun = F.slice("messages", F.lit(1), n) == F.col("context")
    following = F.get(F.filter(F.slice("actions", n + 1, F.size("actions")), lambda x: x.isNotNull()), F.lit(0))
    found = contexts.join(sources, key).where(begun).select(key, "ord", following.alias("action")).where("action is not null")
    return found.groupBy(key).agg(F.min(F.struct("ord", "action")).alias("f")).select(key, "f.*")


def search_contexts(searches: DataFrame, trajectory: str, turn: str, candidates: str, known: Column, correct: Column, most: int) -> DataFrame:
    """The first `most` searches of a trajectory whose candidates are all known, some of them correct."""
    good = searches.where((F.size(candidates) > 0) & (F.size(F.array_except(F.col(candidates), known)) == 0) & F.arrays_overlap(F.col(candidates), correct))
    return good.withColumn("ord", F.row_number().over(Window.partitionBy(trajectory).orderBy(turn))).where(F.col("ord") <= most)


def audit_rendered(text: Column, policy: str, note: Column, answer: Column, examples: Column, masked: Column) -> Column:
    """First reason why a rendered record is no good, or null: masked is the number of trained parts, the last one only."""
    times = lambda part: F.size(F.split(text, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)) - 1
    return (
        F.when(times(F.lit(policy)) != 1, "policy_marker").when(times(note) != 1, "note").when(answer.isNotNull() & ~F.contains(text, answer), "answer_not_visible")
        .when(examples != 1, "examples").when(masked != 1, "mask")
    )


def option_details(df: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    """(key, ord, option, detail): JSON objects in free text whose id begins with prefix, the first of each id, by place.

    Objects may stand anywhere, also inside one another; detail is compact JSON by sorted keys. Arrow batches: no
    built-in finds JSON inside text.
    """
    import pandas as pd

    def objects(raw: str):
        decode = json.JSONDecoder().raw_decode
        at = raw.find("{")
        while at >= 0:
            try:
                yield decode(raw, at)[0]
            except (ValueError, RecursionError):  # no object, or nested deeper than the parser goes
                pass
            at = raw.find("{", at + 1)

    def run(parts):
        for part in parts:
            out = []
            for k, raw in part.itertuples(index=False):
                firsts = {}
                for value in objects(raw or ""):
                    option = value.get("id")
                    if isinstance(option, str) and option.startswith(prefix):
                        firsts.setdefault(option, json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
                out.extend((k, n, option, detail) for n, (option, detail) in enumerate(firsts.items()))
            yield pd.DataFrame(out, columns=["key", "ord", "option", "detail"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, ord long, option string, detail string")


def option_satisfies(detail: Column, aliases: list[str]) -> Column:
    """Whether compact JSON names one of the aliases; one that begins with cost_ must be a key, at any depth, with a value."""
    plain = F.lower(detail)
    holds = [F.regexp_like(detail, F.lit(rf'[{{,]"{a}":(?!null[,}}])')) if a.startswith("cost_") else F.contains(plain, F.lit(a.lower())) for a in aliases]
    return F.try_parse_json(detail).isNotNull() & F.greatest(*holds, F.lit(False), F.lit(False))


def partial_counts(aspects: dict[str, int], target: int, unit: int = 12) -> tuple[int, dict[str, int]]:
    """Of each task some, but not all, of its aspects, so that the shares, in 1/unit, sum closest to target; smaller on a tie.

    Driver-side, for fixtures of a few hundred tasks; a count weighs count * unit / aspects, which must be whole.
    """
    reach = [{0: None}]
    for n in aspects.values():
        if unit % n:
            raise ValueError(f"{n} aspects do not divide {unit}")
        reach.append({total + k * unit // n: (total, k) for total in sorted(reach[-1], reverse=True) for k in range(n - 1, 0, -1)})
    if not reach[-1]:
        raise ValueError("a task of one aspect has no partial count")
    best = min(reach[-1], key=lambda total: (abs(total - target), total))
    out, at = {}, best
    for name, step in zip(reversed(aspects), reversed(reach), strict=False):
        at, out[name] = step[at]
    return best, out
