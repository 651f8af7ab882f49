"""Messages as a learner sees them: canonical form, prefixes by chained hash, labels with their context, token examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What may be in a message, and the one call that an actor may make.
ROLES = ("system", "user", "assistant", "tool")
CALL_NAME, CALL_KEYS = "interact_with_env", ("thought", "choice", "content")
NO_ID = "offline-call"
RAW = "array<struct<role:string,content:string,tool_calls:array<string>,name:string,tool_call_id:string>>"
_RAW_CALL = "struct<id:string,function:struct<name:string,arguments:string>>"
IGNORED = -100
#: Between the parts of what is hashed.
MARK = "\x00"


def _call(raw: Column) -> Column:
    """struct<call, dropped> of a call's JSON: its canonical form, or why there is none."""
    call = F.from_json(raw, _RAW_CALL)
    name, given = call["function"]["name"], call["function"]["arguments"]
    parts = F.try_parse_json(given)
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get(parts, f"$.{k}", "variant")) == "STRING", F.try_variant_get(parts, f"$.{k}", "string"))
    dropped = (
        F.when(call["function"].isNull(), "no_function").when(~name.eqNullSafe(F.lit(CALL_NAME)), "other_name").when(parts.isNull(), "arguments_not_json")
        .when(~F.schema_of_variant(parts).startswith("OBJECT"), "arguments_no_object").when(F.least(*[text(k).isNotNull() for k in CALL_KEYS]) == F.lit(False), "wrong_parameters")
    )
    arguments = F.to_json(F.struct(*[text(k).alias(k) for k in CALL_KEYS]))
    kept = F.struct(F.coalesce(call["id"], F.lit(NO_ID)).alias("id"), F.lit("function").alias("type"), F.struct(F.lit(CALL_NAME).alias("name"), arguments.alias("arguments")).alias("function"))
    return F.struct(F.when(dropped.isNull(), kept).alias("call"), dropped.alias("dropped"))


def canonical(conversations: DataFrame, key: str, messages: str) -> DataFrame:
    """(key, messages, dropped): messages as canonical JSON, and why messages and calls were left out, in order.

    messages: a JSON array. Kept are the four roles with their content; of assistants' calls those of the one name whose
    arguments (an object, or its text) have the three strings, in compact form and fixed order; of tools name and call id. A
    null or missing content is left out.
    """
    parsed = conversations.select(key, F.posexplode_outer(F.from_json(messages, RAW)).alias("at", "m")).where("at IS NOT NULL")
    known = F.coalesce(F.col("m.role").isin(*ROLES), F.lit(False))
    calls = F.when(F.col("m.role") == "assistant", F.transform("m.tool_calls", _call))
    judged = parsed.withColumn("calls", F.when(known, calls)).withColumn("known", known)
    good = F.transform(F.filter("calls", lambda c: c["dropped"].isNull()), lambda c: c["call"])
    only_tool = lambda c: F.when(F.col("m.role") == "tool", F.nullif(F.col(f"m.{c}"), F.lit("")))
    item = F.struct(F.col("m.role").alias("role"), F.col("m.content").alias("content"), F.when(F.size(good) > 0, good).alias("tool_calls"), only_tool("name").alias("name"), only_tool("tool_call_id").alias("tool_call_id"))
    why = F.when(~F.col("known"), F.array(F.lit("unknown_role"))).otherwise(F.coalesce(F.array_compact(F.transform("calls", lambda c: c["dropped"])), F.array().cast("array<string>")))
    rows = judged.select(key, "at", F.when(F.col("known"), item).alias("item"), why.alias("why"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "item", "why")))
    return rows.groupBy(key).agg(in_order.alias("t")).select(
        key, F.to_json(F.transform(F.filter("t", lambda x: x["item"].isNotNull()), lambda x: x["item"])).alias("messages"), F.array_join(F.flatten(F.transform("t", lambda x: x["why"])), ",").alias("dropped"))


def prefixes(messages: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """messages with `before` and `through`: hashes of the messages before a message, and of these with it.

    through = sha256(before, role, text), so equal beginnings have equal hashes whatever conversation they stand in; before
    the first message the hash is the empty string. A conversation is folded in one task; nothing of it is copied.
    """
    one = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))))
    start = F.array().cast("array<string>")
    chained = F.aggregate("m", start, lambda h, x: F.array_append(h, F.sha2(F.concat(F.coalesce(F.try_element_at(h, F.lit(-1)), F.lit("")), F.lit(MARK), x["role"], F.lit(MARK), x["text"]).cast("binary"), 256)))
    hashed = messages.groupBy(key).agg(one.alias("m")).withColumn("h", chained)
    rows = hashed.select(key, F.posexplode(F.arrays_zip("m", "h")).alias("at", "x"), "h")
    return rows.select(key, F.col("x.m.turn").alias(turn), F.col("x.m.role").alias(role), F.col("x.m.text").alias(text), F.when(F.col("at") == 0, "").otherwise(F.get("h", F.col("at") - 1)).alias("before"), F.col("x.h").alias("through"))


def contexts(chained: DataFrame, role: str, text: str) -> DataFrame:
    """(context, parent, role, text, uses): each beginning once, with the message that ends it and the one before it.

    Every context of any label is a path up this table; a beginning that a third of all conversations share is one row.
    """
    return chained.groupBy(F.col("through").alias("context")).agg(F.first("before").alias("parent"), F.first(role).alias(role), F.first(text).alias(text), F.count("*").alias("uses"))


def events(chained: DataFrame, key: str, turn: str, role: str, text: str, actor: str = "assistant", answer: str = "tool") -> DataFrame:
    """(key, turn, action, feedback, before, through): each message of the actor with its contexts before and through feedback.

    The feedback is the next message if it has the role `answer`; else it is null, and the second context ends with the action.
    """
    w = Window.partitionBy(key).orderBy(turn)
    next_ = lambda c: F.when(F.lead(role).over(w) == answer, F.lead(c).over(w))
    rows = chained.withColumn("feedback", next_(text)).withColumn("__through", F.coalesce(next_("through"), "through"))
    return rows.where(F.col(role) == actor).select(key, turn, F.col(text).alias("action"), "feedback", "before", F.col("__through").alias("through"))


def rebuilt(table: DataFrame, wanted: DataFrame, role: str, text: str, longest: int) -> DataFrame:
    """(context, messages): the messages of contexts, by joins up contexts(), one a message of the longest."""
    rows = wanted.select("context").distinct().withColumn("at", F.col("context")).withColumn("messages", F.array().cast("array<string>"))
    parents = table.select(F.col("context").alias("at"), "parent", F.concat_ws(": ", role, text).alias("__m"))
    for _ in range(longest):
        rows = rows.join(parents, "at", "left").select("context", F.coalesce("parent", F.lit("")).alias("at"), F.when(F.col("__m").isNotNull(), F.concat(F.array("__m"), "messages")).otherwise(F.col("messages")).alias("messages"))
    return rows.select("context", "messages")


def placed_labels(labels: DataFrame, chained: DataFrame, states: DataFrame, key: str, turn: str, source: Column, aligned: dict[str, str]) -> DataFrame:
    """labels (key, turn, label) with the context before them, the source that they come from and the state that they show.

    states: key, turn and for each state column the value before and after the turn (`x_before`, `x`). aligned: the side,
    before or after, that a label shows; others show the state before.
    """
    names = [c for c in states.columns if f"{c}_before" in states.columns]
    sides = F.lit("before")
    for label, side in aligned.items():
        sides = F.when(F.col("label") == label, side).otherwise(sides)
    met = labels.join(states, [key, turn]).join(chained.select(key, turn, "before", "through"), [key, turn]).withColumn("side", sides)
    return met.select(key, turn, "label", "side", *[F.when(F.col("side") == "after", F.col(c)).otherwise(F.col(f"{c}_before")).alias(c) for c in names], F.when(F.col("side") == "after", F.col("through")).otherwise(F.col("before")).alias("context"), source.alias("source"))


def token_examples(messages: DataFrame, key: str, turn: str, role: str, text: str, encode: Callable[[Column], Column], most: int, masked: Column | None = None, begin: str = "<|{}|>", end: str = "<|end|>", actor: str = "assistant") -> DataFrame:
    """(key, turn, number, input_ids, labels, problem): an example for each message of the actor that isn't masked.

    encode: a column function from rendered text to array<int>. The prompt is all before the message and the actor's opening;
    input_ids encode the prompt with the message, and labels are IGNORED over the prompt's ids. problem (ids are null then):
    prefix_mismatch if the prompt's ids don't begin the whole's, no_supervised_tokens, or trajectory_too_long for all
    examples of a conversation one of which has over `most` ids. Masked messages are context only.
    """
    w = Window.partitionBy(key).orderBy(turn)
    opening = lambda r: F.concat(*[F.lit(p) if k == 0 else F.concat(r, F.lit(p)) for k, p in enumerate(begin.split("{}"))])
    shown = messages.withColumn("__one", F.concat(opening(F.col(role)), F.coalesce(text, F.lit("")), F.lit(end)))
    so_far = F.array_join(F.collect_list("__one").over(w.rowsBetween(Window.unboundedPreceding, -1)), "")
    mine = F.col(role) == actor
    rows = shown.withColumn("__prompt", F.concat(so_far, opening(F.lit(actor)))).withColumn("__whole", F.concat(so_far, "__one")).withColumn("number", F.count_if(mine).over(w))
    rows = rows.where(mine & ~F.coalesce(masked if masked is not None else F.lit(False), F.lit(False)))
    rows = rows.withColumn("__p", encode(F.col("__prompt"))).withColumn("__w", encode(F.col("__whole")))
    n = F.size("__p")
    own = F.when(~(F.slice("__w", 1, F.greatest(n, F.lit(1))) == F.col("__p")) & (n > 0), "prefix_mismatch").when(F.size("__w") <= n, "no_supervised_tokens")
    too_long = F.max(F.size("__w")).over(Window.partitionBy(key)) > most
    rows = rows.withColumn("problem", F.coalesce(F.when(too_long, "trajectory_too_long"), own))
    good = F.col("problem").isNull()
    labels = F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice("__w", n + 1, F.greatest(F.size("__w") - n, F.lit(0))))
    return rows.select(key, turn, "number", F.when(good, F.col("__w")).alias("input_ids"), F.when(good, labels).alias("labels"), "problem")
