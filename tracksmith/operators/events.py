"""Turn events with flags from the ledger before and after each turn, and flags of single-call probes.

All stays in the JVM. Counters of a turn are cumulative, so what a turn added is their growth since the turn before: two windows,
by trajectory and by aspect. Defined results: a null counter counts as the one before it has not grown; null texts are empty; a
flag is never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions.expr import action_signature, casefold, is_true, query_form, substantive_change
from tracksmith.operators.transcripts import ASPECT_HINTS

# Kinds of refused calls.
GUARDED = ("guard_rejection", "public_phase_guard", "answer_only_violation")
MALFORMED = ("invalid_tool_call", "malformed_tool_call", "unknown_tool")
NO_OUTPUT = ("no_tool_output", "parallel_tool_calls")
# How a refusal says that a query repeats, that the aspect is another one, that an id is not visible.
REPEATS = ("already attempted", "materially change")
OTHER_ASPECT = ("different public aspect", "current public aspect only", "must target the current public aspect")
UNSEEN = ("answer id is not visible", "unseen or already answered option")
RETRY = "search_retry_required"
#: Counters that may only grow.
COUNTERS = ("preferences", "answers", "exact_repeats", "semantic_repeats", "infrastructure_errors", "wrong_answers")
FLAGS = (
    "field_resolved", "normal_candidates", "answer_visible", "first_fallback", "second_fallback", "rewritten_retry", "switched_aspect", "no_progress_action", "exact_query_repeat", "semantic_repeat",
    "infrastructure_failure", "correct_answer", "wrong_answer", "guard_rejected", "malformed_tool_call", "no_tool_output", "wrong_aspect", "invisible_answer_id")


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def answered_ids(content: Column) -> Column:
    """Options of an answer: parts between commas that are not blank, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def turn_events(turns: DataFrame, key: str, turn: str) -> DataFrame:
    """(key, turn, `FLAGS`, new_preferences): one row a turn.

    Columns: category (null for a call that was made, else why it was refused) and reason; choice, content, aspect (of the call);
    no_preference, normal_search (what the feedback says), shown (ids in it), visible (ids before the turn), correct_ids (of the aspect);
    phase_before, aspect_before, aspect_after (the current aspect around the turn); search_fallbacks (of the call's aspect, after) and
    the cumulative `COUNTERS` after the turn. A refused call is judged by its category and reason alone.
    """
    c = F.col
    w = Window.partitionBy(key).orderBy(turn)
    held = turns.withColumns({f"__{n}": F.coalesce(F.last(n, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n in COUNTERS})
    before = Window.partitionBy(key, "aspect").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__fallbacks", F.coalesce(F.last("search_fallbacks", ignorenulls=True).over(before), F.lit(0)))
    made, refused = c("category").isNull(), c("category").isNotNull()
    grown = lambda n: F.coalesce(c(n) > c(f"__{n}"), F.lit(False))
    is_ = lambda x: is_true(c("choice") == x)
    fresh = F.greatest(F.lit(0), F.coalesce(c("preferences"), c("__preferences")) - c("__preferences"))
    ids = answered_ids(c("content"))
    one = F.size(ids) == 1
    resolved = (fresh > 0) | (is_("action") & is_true(c("no_preference")))
    fell = F.coalesce(c("search_fallbacks") > c("__fallbacks"), F.lit(False))
    normal = is_true(c("normal_search")) & (F.size(F.coalesce("shown", F.array().cast("array<string>"))) > 0)
    why = F.array_join(F.filter(F.split(casefold(F.coalesce(c("reason"), F.lit(""))), r"\s+"), lambda x: x != ""), " ")
    repeat = _any(why, REPEATS) | (F.contains(why, F.lit("repeat")) & F.contains(why, F.lit("query")))
    flags = {
        "field_resolved": made & resolved, "normal_candidates": made & normal, "answer_visible": made & is_("answer") & one & is_true(F.array_contains("visible", F.get(ids, F.lit(0)))),
        "first_fallback": made & fell & (c("search_fallbacks") == 1), "second_fallback": made & fell & (c("search_fallbacks") >= 2), "rewritten_retry": made & normal & (c("phase_before") == RETRY),
        "switched_aspect": made & c("aspect_before").isNotNull() & ~c("aspect_after").eqNullSafe(c("aspect_before")), "no_progress_action": made & is_("action") & ~resolved,
        "exact_query_repeat": F.when(made, grown("exact_repeats")).otherwise(is_("search") & repeat), "semantic_repeat": made & grown("semantic_repeats"), "infrastructure_failure": made & grown("infrastructure_errors"),
        "correct_answer": made & grown("answers") & one & c("aspect").isNotNull() & is_true(F.array_contains("correct_ids", F.get(ids, F.lit(0)))), "wrong_answer": made & grown("wrong_answers"),
        "guard_rejected": refused & c("category").isin(*GUARDED), "malformed_tool_call": refused & c("category").isin(*MALFORMED), "no_tool_output": refused & c("category").isin(*NO_OUTPUT),
        "wrong_aspect": refused & (is_("search") | is_("answer")) & _any(why, OTHER_ASPECT), "invisible_answer_id": refused & is_("answer") & _any(why, UNSEEN)}
    return held.select(key, turn, *[is_true(flags[f]).alias(f) for f in FLAGS], F.when(made, fresh).otherwise(0).cast("long").alias("new_preferences"))


def mentions(content: Column, aspect: Column) -> Column:
    """Whether the text names the aspect by one of its words, in singular or plural."""
    words = F.array_join(F.regexp_extract_all(casefold(F.coalesce(content, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), " ")
    out = F.lit(False)
    for a, hints in ASPECT_HINTS.items():
        named = "|".join(" ".join(f"{w}(?:e?s)?" for w in h.split()) for h in hints)
        out = F.when(aspect == a, words.rlike(rf"(?<![a-z0-9])(?:{named})(?![a-z0-9])")).otherwise(out)
    return out


def probe_flags(probes: DataFrame, key: list[str]) -> DataFrame:
    """(key, flags) of one call an actor made at a probe's place, by the probe's category.

    Columns: category, choice and content (null choice: no call could be read), current, failed and following (aspects), visible (ids),
    earlier (array of structs choice, content: the calls before). A flag of another category is false.
    """
    c = F.col
    read = c("choice").isNotNull()
    is_ = lambda kind: is_true(c("category") == kind)
    search = read & (c("choice") == "search")
    ids = answered_ids(c("content"))
    queries = F.transform(F.filter("earlier", lambda x: x["choice"] == "search"), lambda x: F.coalesce(x["content"], F.lit("")))
    own = query_form(F.coalesce(c("content"), F.lit("")))
    signature = action_signature(c("choice"), F.coalesce(c("content"), F.lit("")))
    same = lambda x: action_signature(x["choice"], F.coalesce(x["content"], F.lit(""))) == signature
    retried = is_("first_fallback") & search & (F.size(queries) > 0)
    flags = {
        "protocol_valid": read, "answer_at_1": is_("normal_search_result") & (c("choice") == "answer"),
        "visible_id_only": is_("normal_search_result") & read & (F.size(ids) == 1) & F.get(ids, F.lit(0)).rlike("^[ACFHR][0-9]+$") & F.array_contains("visible", F.get(ids, F.lit(0))),
        "search_at_1": is_("preference_complete") & search, "clean_search_at_1": is_("preference_complete") & search, "search_targets_current_aspect": is_("preference_complete") & search & mentions(c("content"), c("current")),
        "changed_query": retried & substantive_change(query_form(F.element_at(queries, -1)), own), "exact_query_repeat": retried & F.exists(queries, lambda q: query_form(q) == own),
        "switch_aspect": is_("second_fallback") & read & mentions(c("content"), c("following")), "same_aspect_search": is_("second_fallback") & search & mentions(c("content"), F.coalesce(c("failed"), c("current"))),
        "repeated_action": is_("confused_history") & read & F.exists("earlier", same), "repeated_search": is_("confused_history") & search & F.exists("earlier", lambda x: (x["choice"] == "search") & same(x))}
    return probes.select(*key, *[is_true(v).alias(name) for name, v in flags.items()])
