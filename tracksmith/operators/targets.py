"""Targets of recovery boundaries: what the next call should be, whether it may be trained on, and where it goes.

Column expressions over one boundary a row: boundary, phase, aspect, public_aspects, answered, blocked, visible (arrays),
source_choice and source_content (of the recorded call that follows in a source with the same prefix, or null: see
recovery.next_action), last_search (content of the last search, or null) and asked (array of `aspect.field`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions import expr
from tracksmith.operators.transcripts import ASPECT_HINTS

# How an aspect is called in a query, words of generated calls.
SPOKEN = {"rental_car": "rental car"}
SEARCH_TEXT = "Search for {} options using the preferences stated by the user."
RETRY_TEXT = "Revised search for {}: {}"
ASK_TEXT = "What {} do you prefer for {} {}?"
REUSED, REWRITTEN, SWITCHED, SEARCHED, UNASKED, NO_WISH, QUARANTINE = "accepted_teacher_or_source_prefix", "deterministic_query_rewrite", "deterministic_aspect_switch", "deterministic_public_search", "deterministic_next_public_field", "deterministic_no_preference_search", "quarantine"


def _each(aspect: Column, value) -> Column:
    """value(name) of the aspect named in a column."""
    out = F.lit(None).cast("string")
    for name in ASPECT_HINTS:
        out = F.when(aspect == name, value(name)).otherwise(out)
    return out


def mentions(content: Column, aspect: Column) -> Column:
    """Whether the content names the aspect (a plural counts); false where either is null."""
    words = F.concat(F.lit(" "), F.array_join(F.transform(F.regexp_extract_all(expr.casefold(content), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.regexp_replace(w, "s$", "")), " "), F.lit(" "))
    out = F.lit(False)
    for name, hints in ASPECT_HINTS.items():
        found = F.lit(False)
        for h in hints:
            found = found | F.contains(words, F.lit(f" {h} "))
        out = out | ((aspect == name) & found)
    return F.coalesce(out, F.lit(False))


def next_open() -> Column:
    """The first public aspect that is neither the current one nor closed."""
    others = F.filter("public_aspects", lambda a: ~a.eqNullSafe(F.col("aspect")) & ~F.array_contains("answered", a) & ~F.array_contains("blocked", a))
    return F.get(others, F.lit(0))


def _field(aspect: Column, fields: dict[str, dict[str, str]]) -> Column:
    """The first field of the aspect that was not asked for, or null."""
    pairs = lambda name: F.get(F.filter(F.array(*[F.lit(f) for f in fields.get(name, {})]).cast("array<string>"), lambda f: ~F.array_contains("asked", F.concat(F.lit(f"{name}."), f))), F.lit(0))
    return _each(aspect, pairs)


def _spoken(aspect: Column) -> Column:
    return _each(aspect, lambda name: F.lit(SPOKEN.get(name, name)))


def _question(aspect: Column, field: Column, fields: dict[str, dict[str, str]]) -> Column:
    def of(name: str) -> Column:
        out = F.lit(None).cast("string")
        for f, phrase in fields.get(name, {}).items():
            out = F.when(field == f, ASK_TEXT.format(phrase, "an" if phrase[0] in "aeiou" else "a", SPOKEN.get(name, name))).otherwise(out)
        return out

    return _each(aspect, of)


def _answer_reasons(content: Column) -> list[tuple[Column, str]]:
    given = F.filter(F.transform(F.split(content, ","), lambda x: F.trim(x)), lambda x: x != "")
    one = F.coalesce((F.size(given) == 1) & F.get(given, F.lit(0)).rlike("^[ACFHR][0-9]+$"), F.lit(False))
    seen = F.coalesce(F.array_contains("visible", F.get(given, F.lit(0))), F.lit(False))
    own = F.coalesce(expr.option_aspect(F.get(given, F.lit(0))) == F.col("aspect"), F.lit(False))
    return [(~one, "answer_not_exactly_one_option_id"), (one & ~seen, "answer_id_not_visible"), (one & seen & ~own, "answer_aspect_mismatch"), (F.col("phase") != "ANSWER_REQUIRED", "answer_phase_mismatch")]


def _why(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in checks])).cast("array<string>")


def construct(df: DataFrame, fields: dict[str, dict[str, str]]) -> DataFrame:
    """df with target_choice, target_content, method and reasons (why there is no target; then choice and content are null).

    fields: aspect -> field -> how a question calls it, in the order in which fields are asked for.
    """
    c = F.col
    b, phase, aspect = c("boundary"), c("phase"), c("aspect")
    none = F.array().cast("array<string>")
    follows = next_open()
    nameless = _why((aspect.isNull(), "no_current_public_aspect"))
    sought = _spoken(aspect)
    revised = F.format_string(RETRY_TEXT.replace("{}", "%s"), sought, c("last_search"))
    substantive = expr.substantive_change(expr.query_form(c("last_search")), expr.query_form(revised))
    free = _field(aspect, fields)
    other = _field(follows, fields)
    search = F.format_string(SEARCH_TEXT.replace("{}", "%s"), sought)
    eliciting = phase.isin("ELICITING", "SEARCH_REQUIRED")
    at_search = _why((c("source_choice") != "search", "source_target_choice_not_search"), (~mentions(c("source_content"), aspect), "search_target_aspect_mismatch"), (~eliciting, "search_phase_mismatch"))
    at_answer = _why((c("source_choice") != "answer", "source_target_choice_not_answer"), *_answer_reasons(c("source_content")))
    found = lambda x: F.when(c("source_choice").isNull(), F.array(F.lit("source_target_not_found"))).otherwise(x)
    retry = F.when(c("last_search").isNull(), F.array(F.lit("original_search_not_found"))).otherwise(_why((phase != "SEARCH_RETRY_REQUIRED", "retry_phase_mismatch"), (~mentions(revised, aspect), "rewritten_query_aspect_mismatch"), (~substantive, "rewritten_query_not_substantive")))
    switch = _why((phase != "SWITCH_ASPECT_REQUIRED", "switch_phase_mismatch"), (~F.array_contains("blocked", aspect), "failed_aspect_not_publicly_blocked"), (follows.isNull(), "no_next_open_public_aspect"))
    switch = F.when((F.size(switch) == 0) & other.isNull(), F.array(F.lit("no_safe_field_for_next_aspect"))).otherwise(switch)
    no_wish = _why((~eliciting, "elicitation_phase_mismatch"))
    to_search = (phase == "SEARCH_REQUIRED") | free.isNull()
    # boundary: choice, content, method, reasons
    cases = {
        "visible_options_pending_answer": (F.lit(None), F.lit(None), F.lit(QUARANTINE), F.array(F.lit("answer_id_not_determinable_without_hidden_correctness"))),
        "preference_complete_to_search": (c("source_choice"), c("source_content"), F.lit(REUSED), found(at_search)),
        "valid_search_to_answer": (c("source_choice"), c("source_content"), F.lit(REUSED), found(at_answer)),
        "first_fallback": (F.lit("search"), revised, F.lit(REWRITTEN), F.when(F.size(nameless) > 0, nameless).otherwise(retry)),
        "second_fallback": (F.lit("action"), _question(follows, other, fields), F.lit(SWITCHED), F.when(F.size(nameless) > 0, nameless).otherwise(switch)),
        "repeated_no_progress_action": (F.lit("search"), search, F.lit(SEARCHED), F.when(F.size(nameless) > 0, nameless).otherwise(_why((~eliciting, "search_phase_mismatch")))),
        "explicit_no_preference": (F.when(to_search, "search").otherwise("action"), F.when(to_search, search).otherwise(_question(aspect, free, fields)), F.when(eliciting & to_search, NO_WISH).otherwise(UNASKED), F.when(F.size(nameless) > 0, nameless).otherwise(no_wish)),
    }

    def pick(place: int, default: Column) -> Column:
        out = default
        for name, values in cases.items():
            out = F.when(b == name, values[place]).otherwise(out)
        return out

    reasons = F.coalesce(pick(3, F.array(F.lit("unknown_boundary_type"))), none)
    good = F.size("reasons") == 0
    made = df.withColumn("reasons", reasons).withColumn("method", pick(2, F.lit("unknown_boundary")))
    return made.withColumn("target_choice", F.when(good, pick(0, F.lit(None).cast("string")))).withColumn("target_content", F.when(good, pick(1, F.lit(None).cast("string"))))


def validate(df: DataFrame) -> DataFrame:
    """df of construct() with `problems` of its targets, judged by the public state alone; empty where there is no target."""
    c = F.col
    choice, content, phase, aspect = c("target_choice"), c("target_content"), c("phase"), c("aspect")
    follows = next_open()
    act = (choice == "action") & ~mentions(content, aspect) & ~mentions(content, follows)
    answer = [((choice == "answer") & check, name) for check, name in _answer_reasons(content)]
    same = ~expr.substantive_change(expr.query_form(c("last_search")), expr.query_form(content))
    first, second = c("boundary") == "first_fallback", c("boundary") == "second_fallback"
    found = _why(
        (aspect.isNull(), "no_current_public_aspect"), *answer, ((choice == "search") & ~mentions(content, aspect), "search_target_aspect_mismatch"), ((choice == "search") & ~phase.isin("ELICITING", "SEARCH_REQUIRED", "SEARCH_RETRY_REQUIRED"), "search_phase_mismatch"),
        (act, "action_target_aspect_mismatch"), ((choice == "action") & ~phase.isin("ELICITING", "SWITCH_ASPECT_REQUIRED"), "action_phase_mismatch"), (first & (c("last_search").isNull() | (choice != "search")), "fallback_retry_missing_original_search"), (first & (choice == "search") & same, "rewritten_query_not_substantive"),
        (second & follows.isNull(), "no_next_open_public_aspect"), (second & mentions(content, aspect), "target_reuses_blocked_aspect"), (second & follows.isNotNull() & ~mentions(content, follows), "target_does_not_switch_aspect"),
    )
    return df.withColumn("problems", F.when(choice.isNull(), F.array().cast("array<string>")).otherwise(found))


def routed(df: DataFrame, split: str, validation: tuple[str, ...] = ("validation",), evaluation: str = "evaluation") -> DataFrame:
    """df of validate() with `part`: train, validation, rejected or excluded_evaluation (whatever its target is)."""
    good = F.col("target_choice").isNotNull() & (F.size("problems") == 0)
    return df.withColumn("part", F.when(F.col(split) == evaluation, "excluded_evaluation").when(~good, "rejected").when(F.col(split).isin(*validation), "validation").otherwise("train"))


def shares(df: DataFrame, label: str, part: str = "part") -> DataFrame:
    """(label, part, n, share): targets of each label by part, and the share of the label's."""
    n = df.groupBy(label, part).agg(F.count("*").alias("n"))  # a row a label and part
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))
