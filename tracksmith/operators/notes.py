"""Control notes in transcripts: rendered from a state's public columns, and read back into phase metrics.

All stays in the JVM; reading takes one sort by trajectory. Defined results: a note without a phase leaves the phase as it is;
a transcript without notes has no opportunity and a score of 1; a null text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions.expr import casefold

# Phases of a note.
ELICITING, SEARCH, RETRY, ANSWER, SWITCH, ANSWERED = "ELICITING", "SEARCH_REQUIRED", "SEARCH_RETRY_REQUIRED", "ANSWER_REQUIRED", "SWITCH_ASPECT_REQUIRED", "ANSWERED"
# The calls that a phase allows, where the episode goes on and has an aspect.
ALLOWED = {
    ELICITING: "action, search, answer (visible ID only)",
    SEARCH: "search",
    RETRY: "search (revised query)",
    ANSWER: "answer (one visible option ID)",
    SWITCH: "none for this aspect; next public aspect only",
    ANSWERED: "none for this aspect",
}
# What a phase forbids.
CONSTRAINTS = {
    ELICITING: "Ask only for a missing preference visible in the conversation; do not repeat an answered or declined preference.",
    SEARCH: "Do not call action; search using information already visible in the conversation.",
    RETRY: "Rewrite the query materially once; do not repeat the previous query.",
    ANSWER: "Answer with exactly one ID from the visible option list; do not search or call action.",
    SWITCH: "The current aspect is terminal; do not call it again; continue with the next public aspect.",
    ANSWERED: "This aspect is answered; do not call a tool for it again.",
}
# The same for an episode that is over, and for an aspect that is blocked; how a refused call is answered.
DONE = "Do not issue another tool call or fabricate completion."
BLOCKED = "The current aspect is blocked; do not search or answer it, and do not fabricate an answer."
REFUSED = "public control rejected this call"
#: What each phase asks of the next call, by the name under which it is counted.
EXPECTED = {"search_required": (SEARCH, "search"), "retry_search": (RETRY, "search"), "candidate_answer": (ANSWER, "answer")}
_PHASE, _ASPECT, _FALLBACKS = r"Current control state:\s*([A-Z_]+)", r"Current public aspect:\s*([^|\n]+)", r"Current aspect fallback count:\s*(\d+)"
_SWITCHED = "Transition: SWITCH_ASPECT_REQUIRED"


def _choose(phase: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), phase)


def render(aspect: Column, phase: Column, fallbacks: Column, ids: Column, done: Column, blocked: Column, left: Column | None = None, left_status: Column | None = None) -> Column:
    """A note: one line of fixed order, then a transition from the aspect that was left, then the phase's constraint, if there are such.

    aspect: null if none is current (no fallbacks and ids then; only a clarification is allowed); ids are sorted as texts.
    """
    has = aspect.isNotNull()
    shown = F.when(has & (F.size(ids) > 0), F.array_join(F.array_sort(ids), ",")).otherwise("none")
    allowed = F.when(done, "none").when(~has, "action").otherwise(_choose(phase, ALLOWED))
    named = F.coalesce(aspect, F.lit("none"))
    line = F.concat(
        F.lit("Public control | Current public aspect: "), named, F.lit(" | Current control state: "), phase, F.lit(" | Current aspect fallback count: "), F.when(has, F.coalesce(fallbacks, F.lit(0))).otherwise(0).cast("string"),
        F.lit(" | Current visible option IDs: "), shown, F.lit(" | Allowed next tool calls: "), allowed)
    moved = F.lit(None).cast("string")
    if left is not None:
        moved = F.concat(F.lit(_SWITCHED + " | Previous public aspect: "), left, F.lit(" is "), F.upper(left_status), F.lit("; do not call that aspect again. Continue only with current public aspect: "), named, F.lit("."))
    constraint = F.when(done, DONE).when((phase == SWITCH) & blocked, BLOCKED).when(has | (phase != ELICITING), _choose(phase, CONSTRAINTS))
    return F.concat_ws("\n", line, moved, F.concat(F.lit("Constraint: "), constraint))


def _last(text: Column, pattern: str) -> Column:
    return F.get(F.reverse(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), 0)


def read(messages: DataFrame, key: str, turn: str, role: str, choice: str, text: str, actor: str = "assistant") -> DataFrame:
    """messages with what their notes say and what they were asked: phase_before, kind, refused, success, switched, blocked.

    kind: the name in `EXPECTED` of the phase that the notes before set, for the actor's messages; a call that the next message
    refuses is no success; blocked: the aspect of a SWITCH note of two fallbacks or more, or that says it is blocked.
    """
    w = Window.partitionBy(key).orderBy(turn)
    said = F.coalesce(F.col(text), F.lit(""))
    rows = messages.withColumns({"__phase": _last(said, _PHASE), "__next": F.lead(said).over(w)})
    before = F.coalesce(F.last("__phase", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(ELICITING))
    kind, wanted = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (phase, call) in EXPECTED.items():
        kind, wanted = F.when(F.col("phase_before") == phase, name).otherwise(kind), F.when(F.col("phase_before") == phase, call).otherwise(wanted)
    at_switch = F.coalesce(F.col("__phase") == SWITCH, F.lit(False))
    stuck = (F.coalesce(_last(said, _FALLBACKS).try_cast("int"), F.lit(0)) >= 2) | F.contains(casefold(said), F.lit("current aspect is blocked"))
    rows = rows.withColumn("phase_before", before)
    rows = rows.withColumns({
        "kind": F.when(F.col(role) == actor, kind), "refused": F.contains(casefold(F.coalesce("__next", F.lit(""))), F.lit(REFUSED)), "switched": F.contains(said, F.lit(_SWITCHED)),
        "blocked": F.when(at_switch & stuck, F.coalesce(F.trim(_last(said, _ASPECT)), F.lit("unknown")))})
    return rows.withColumn("success", F.col("kind").isNotNull() & ~F.col("refused") & F.coalesce(F.col(choice) == wanted, F.lit(False))).drop("__phase", "__next")


def metrics(messages: DataFrame, key: str, turn: str, role: str, choice: str, text: str, actor: str = "assistant") -> DataFrame:
    """(key, successes and opportunities of each kind and of aspect_switch, score, blocked_aspects) of whole transcripts."""
    kinds = [*EXPECTED, "aspect_switch"]
    sums = []
    for k in EXPECTED:
        sums += [F.count_if((F.col("kind") == k) & F.col("success")).alias(f"{k}_successes"), F.count_if(F.col("kind") == k).alias(f"{k}_opportunities")]
    sums += [F.count_if("switched").alias("aspect_switch_successes"), F.count_if("switched").alias("aspect_switch_opportunities"), F.countDistinct("blocked").alias("blocked_aspects")]
    out = read(messages, key, turn, role, choice, text, actor).groupBy(key).agg(*sums)
    total = lambda what: sum((F.col(f"{k}_{what}") for k in kinds), F.lit(0))
    return out.withColumn("score", F.when(total("opportunities") == 0, 1.0).otherwise(F.try_divide(total("successes").cast("double"), total("opportunities"))))
