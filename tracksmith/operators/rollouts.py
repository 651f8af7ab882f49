"""Rollouts and their records: projections, counters, flags, contracts of tables. All stay in the JVM.

Functions of columns give columns; functions of tables take column names. A trajectory's or a conversation's rows are gathered
where an order matters; a trajectory must fit a task, trajectories need not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions import expr

# How an episode ends that counts as finished.
FINISHED = ("environment_terminated", "completed")
# Fixed values: (temperature, top p) of sampling profiles.
PROFILES = {"validation": (0.0, 1.0), "training": (0.7, 0.9)}
# Quality of the best, another correct and a wrong answer.
BEST, CORRECT, WRONG = 1.0, 0.8, 0.0

# How the environment says that its judge, its reply or its search fell back: in notes, in feedback, in printed output.
JUDGE_FAILED = "Judging of agent's latest utterance failed"
REPLY_FAILED = "Responding system met some issues"
REPLY_UNSURE = "not sure how to respond to your latest utterance"
SEARCH_FAILED = "searching backend is experiencing some issues"
PRINTED = {"judgment_fallbacks": "By default turn to normal conversation", "search_fallbacks": "By default will return N/A"}


def _in_order(turn: str, *columns: str) -> Column:
    """An aggregate: the rows' structs in order of turn."""
    return F.array_sort(F.collect_list(F.struct(turn, *columns)))


# Contracts

def source_rejections(messages: DataFrame, key: str, turn: str, role: str, first: tuple[str, ...] = ("system", "user"), least: int = 3) -> DataFrame:
    """(key, reason): wrong_roles if a row's first messages have other roles, too_short with fewer than `least`; else null."""
    rows = messages.groupBy(key).agg(F.transform(_in_order(turn, role), lambda x: x[role]).alias("r"))
    begins = F.slice("r", 1, len(first))
    return rows.select(key, F.when(begins != F.array(*[F.lit(x) for x in first]), "wrong_roles").when(F.size("r") < least, "too_short").alias("reason"))


def derived_rejections(df: DataFrame, ids: list[Column], index: list[str], ground_truth: Column, text: Column, marker: str, out: str = "rejections") -> DataFrame:
    """df with its reasons: ids of one row that differ, an index that another row has too, a ground truth, not just one policy block."""
    copies = df.groupBy(*index).agg(F.count("*").alias("__copies"))
    same = F.size(F.array_distinct(F.array(*ids))) == 1
    blocks = F.size(F.split(text, F.lit("\\Q" + marker + "\\E"))) - 1
    why = expr.reasons((~same, "ids_differ"), (F.col("__copies") > 1, "index_repeated"), (~ground_truth.eqNullSafe(F.lit("")), "ground_truth"), (blocks != 1, "policy_blocks"))
    return df.join(copies, index).withColumn(out, F.array_join(why, ",")).drop("__copies")


def unique_load(tables: list[DataFrame], key: str) -> DataFrame:
    """One row: rows of all tables, different keys, rows too many."""
    both = tables[0].select(key)
    for t in tables[1:]:
        both = both.unionByName(t.select(key))
    return both.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_ids")).withColumn("n_repeated", F.col("n_rows") - F.col("n_ids"))


def overlaps(df: DataFrame, key: str, part: str) -> DataFrame:
    """(key, parts): keys that stand in more than one part."""
    return df.groupBy(key).agg(F.countDistinct(part).alias("parts")).where("parts > 1")


def failed(correct: Column, completion: Column, repeats: Column, termination: Column) -> Column:
    """Whether a result is a failure; what is null fails."""
    good = expr.is_true(correct) & (F.coalesce(completion, F.lit(0.0)) >= 1) & (F.coalesce(repeats, F.lit(1)) == 0) & F.coalesce(termination.isin(*FINISHED), F.lit(False))
    return ~good


def allowed_columns(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns that df has, in the order of the list."""
    return df.select(*[c for c in allowed if c in df.columns])


def pool_contract(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """One row: rows, rows whose key another has, rows with a blank text."""
    blank = F.lit(False)
    for c in texts:
        blank = blank | (F.coalesce(F.trim(c), F.lit("")) == "")
    return df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("ids"), F.count_if(blank).alias("blank")).select("n", (F.col("n") - F.col("ids")).alias("repeated"), "blank")


def completeness(expected: DataFrame, results: DataFrame, key: str, valid: str) -> DataFrame:
    """One row: expected tasks, those with a valid result, and whether these are all."""
    joined = expected.select(key).join(results.select(key, valid), key, "left")
    counted = joined.agg(F.count("*").alias("expected"), F.count_if(expr.is_true(F.col(valid))).alias("valid"))
    return counted.withColumn("complete", F.col("expected") == F.col("valid"))


# Transcripts

def replies(messages: DataFrame, key: str, turn: str, role: str, text: str, actor: str = "assistant", answer: str = "tool") -> DataFrame:
    """(key, turn, action, reply): each message of the actor and the one that follows at once, if it has the role `answer`."""
    w = Window.partitionBy(key).orderBy(turn)
    following = messages.withColumn("reply", F.lead(text).over(w)).withColumn("__role", F.lead(role).over(w))
    return following.where((F.col(role) == actor) & (F.col("__role") == answer)).select(key, turn, F.col(text).alias("action"), "reply")


def sequence(rows: DataFrame, key: str, turn: str, what: str, separator: str = ">", out: str = "choices") -> DataFrame:
    """(key, out): the values in order of turn, joined."""
    return rows.groupBy(key).agg(F.array_join(F.transform(_in_order(turn, what), lambda x: x[what]), separator).alias(out))


def prompt(messages: DataFrame, key: str, turn: str, role: str, text: str, before: list[tuple[str, str]] = (), after: list[tuple[str, str]] = ()) -> DataFrame:
    """(key, prompt, n): `role: text` lines of the messages in order, between further (role, text); a null text is empty."""
    lines = lambda given: F.array(*[F.lit(f"{r}: {t}") for r, t in given]).cast("array<string>")
    said = F.transform(_in_order(turn, role, text), lambda x: F.concat(x[role], F.lit(": "), F.coalesce(x[text], F.lit(""))))
    made = messages.groupBy(key).agg(F.concat(lines(before), said, lines(after)).alias("m"))
    return made.select(key, F.array_join("m", "\n").alias("prompt"), F.size("m").cast("long").alias("n"))


def masked_history(messages: DataFrame, key: str, turn: str, role: str, text: str, note: Column | None = None, target: Column | None = None) -> DataFrame:
    """(key, messages): all masked; a note is put at the end of the last one, a target follows as the only unmasked assistant's.

    Without a target the last message is the one that is not masked. note, target: columns that are the same in all rows of a key.
    """
    rows = messages.withColumn("__note", note if note is not None else F.lit(None).cast("string")).withColumn("__target", target if target is not None else F.lit(None).cast("string"))
    held = rows.groupBy(key).agg(_in_order(turn, role, text).alias("m"), F.max("__note").alias("n"), F.max("__target").alias("t"))
    last = F.size("m") - 1
    one = lambda x, i: F.struct(x[turn].cast("long").alias("turn"), x[role].alias("role"), F.when((i == last) & F.col("n").isNotNull(), F.concat_ws("\n", x[text], "n")).otherwise(x[text]).alias("text"), ((i < last) | F.col("t").isNotNull()).alias("masked"))
    own = F.struct((F.element_at("m", -1)[turn] + 1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.col("t").alias("text"), F.lit(False).alias("masked"))
    return held.select(key, F.concat(F.transform("m", one), F.when(F.col("t").isNotNull(), F.array(own)).otherwise(F.array().cast("array<struct<turn:bigint,role:string,text:string,masked:boolean>>"))).alias("messages"))


def fallback_counts(rows: DataFrame, key: str, any_fallback: Column, in_search: Column) -> DataFrame:
    """(key, fallbacks, search_fallbacks): rows whose feedback is a fallback, and those of them in a search."""
    return rows.groupBy(key).agg(F.count_if(any_fallback).alias("fallbacks"), F.count_if(in_search).alias("search_fallbacks"))


def feedback_fallbacks(feedback: Column, note: Column) -> list[Column]:
    """Of a step: 1 if the judge, the reply or the search fell back, by the feedback and the note on the actor's last message.

    A null text is empty.
    """
    f, n = F.coalesce(feedback, F.lit("")), F.coalesce(note, F.lit(""))
    marks = {"judgment_fallbacks": n.startswith(JUDGE_FAILED), "response_fallbacks": n.startswith(REPLY_FAILED) | F.contains(f, F.lit(REPLY_UNSURE)), "search_fallbacks": F.contains(f, F.lit(SEARCH_FAILED))}
    return [c.cast("int").alias(name) for name, c in marks.items()]


def output_fallbacks(output: Column) -> list[Column]:
    """Of printed output: how often the judge and the search said that they fell back."""
    times = lambda phrase: F.coalesce(F.regexp_count(output, F.lit("\\Q" + phrase + "\\E")), F.lit(0))
    return [times(phrase).alias(name) for name, phrase in PRINTED.items()]


def step_fallbacks(messages: DataFrame, key: str, turn: str, role: str, note: str, feedback: str, actor: str = "agent") -> DataFrame:
    """(key, steps, judgment_fallbacks, response_fallbacks, search_fallbacks): sums over the rows with feedback.

    The note is that of the actor's latest message up to the row, also where it is null.
    """
    w = Window.partitionBy(key).orderBy(turn)
    latest = F.last(F.when(F.col(role) == actor, F.struct(F.col(note).alias("n"))), ignorenulls=True).over(w)
    steps = messages.withColumn("__note", latest["n"]).where(F.col(feedback).isNotNull()).select(key, *feedback_fallbacks(F.col(feedback), F.col("__note")))
    return steps.groupBy(key).agg(F.count("*").alias("steps"), *[F.sum(c).alias(c) for c in ("judgment_fallbacks", "response_fallbacks", "search_fallbacks")])


# Turns

def turn_flags(turns: DataFrame, key: str, turn: str, state: str, value: str) -> DataFrame:
    """(key, turn, step, begins): turns since the one before, and whether the state becomes `value` here."""
    w = Window.partitionBy(key).orderBy(turn)
    before = F.lag(state).over(w)
    return turns.select(key, turn, (F.col(turn) - F.lag(turn).over(w)).alias("step"), ((F.col(state) == value) & (~before.eqNullSafe(F.lit(value)))).alias("begins"))


def terminated(chosen: Column, aspects: Column, steps: Column, most: int = 20) -> Column:
    """Whether an episode is over: all aspects have a choice, or more steps than allowed were taken."""
    return (chosen == aspects) | (steps > most)


def one_choice_terminated(ended: Column, one_choice: Column, aspects: Column, chosen: Column) -> Column:
    """Whether an episode is over where a step may leave out the check of one choice an aspect: ended, or as many chosen as aspects.

    aspects, chosen: arrays; where one of them is null or no aspect is there, the step's own word holds.
    """
    full = (F.size(aspects) > 0) & (F.size(chosen) >= F.size(aspects)) & aspects.isNotNull() & chosen.isNotNull()
    return expr.is_true(ended) | (expr.is_true(one_choice) & expr.is_true(full))


def answer_score(answer: Column, best: Column, correct: Column) -> Column:
    """BEST, CORRECT or WRONG; correct: an array."""
    return F.when(answer == best, BEST).when(F.array_contains(correct, answer), CORRECT).otherwise(WRONG)


def first_answers(turns: DataFrame, key: str, turn: str, aspect: str, choice: str, score: Column) -> DataFrame:
    """(key, aspect, score): of the first answer on each aspect, clamped to [0, 1]; later ones find the option taken."""
    answers = turns.where(F.col(choice) == "answer")
    return answers.groupBy(key, aspect).agg(expr.clamp(F.min_by(score.cast("double"), turn), 0.0, 1.0).alias("score"))


def probe_flags(turns: DataFrame, key: str, turn: str, choice: str, outcome: str, query: str, probe: str = "search") -> DataFrame:
    """Of each turn right after a `probe` turn: answered at once, clean search, changed query, exact repeat."""
    w = Window.partitionBy(key).orderBy(turn)
    p = turns.withColumns({f"__{c}": F.lag(c).over(w) for c in (outcome, choice, query)}).where(F.col(f"__{choice}") == probe)
    c = F.col
    same = (c(choice) == c(f"__{choice}")) & (c(outcome) == c(f"__{outcome}")) & (c(query) == c(f"__{query}"))
    return p.select(key, turn, (c(choice) == "answer").alias("answer_at_1"), ((c(choice) == "search") & (c(outcome) == "normal")).alias("clean_search"), (c(query) != c(f"__{query}")).alias("changed"), same.alias("exact_repeat"))


def submitted(turns: DataFrame, key: str, turn: str, choice: str, option: Column) -> DataFrame:
    """(key, submitted): different options of answers in order of their first submission."""
    held = turns.where(F.col(choice) == "answer").withColumn("__option", option).groupBy(key).agg(_in_order(turn, "__option").alias("t"))
    return held.select(key, F.array_distinct(F.filter(F.transform("t", lambda x: x["__option"]), lambda x: x.isNotNull())).alias("submitted"))


def open_options(turns: DataFrame, key: str, aspect: str, visible: Column, answered: Column) -> DataFrame:
    """(key, options): aspects with something visible that are not answered, sorted."""
    s = turns.groupBy(key).agg(F.collect_set(F.when(visible, F.col(aspect))).alias("v"), F.collect_set(F.when(answered, F.col(aspect))).alias("a"))
    return s.select(key, F.array_sort(F.array_except("v", "a")).alias("options"))


def visible_options(turns: DataFrame, key: str, turn: str, choice: str, content: str, feedback: str) -> DataFrame:
    """(key, option, aspect, first_turn): option ids that searches have shown, of aspects that no answer named.

    The aspect of an option is its letter's; ids stand free of other letters and digits, and each counts once.
    """
    found = lambda c: expr.option_ids(F.coalesce(c, F.lit("")))
    shown = turns.where(F.col(choice) == "search").select(key, turn, F.explode(found(F.col(feedback))).alias("option"))
    shown = shown.groupBy(key, "option").agg(F.min(turn).alias("first_turn")).withColumn("aspect", expr.option_aspect(F.col("option")))
    answered = turns.where(F.col(choice) == "answer").select(key, F.explode(found(F.col(content))).alias("option")).select(key, expr.option_aspect(F.col("option")).alias("aspect")).distinct()
    return shown.join(answered, [key, "aspect"], "anti").select(key, "option", "aspect", "first_turn")


def stop_reason(called: Column) -> Column:
    """Why the actor stopped: its last message had no call, or it chose to."""
    return F.when(~expr.is_true(called), "no_tool_output").otherwise("actor_stopped")


# Tasks and labels

def preference_counts(items: DataFrame, key: str, size: Column) -> DataFrame:
    """(key, aspects, preferences): nested lists of a task and what they hold in all."""
    return items.groupBy(key).agg(F.count("*").alias("aspects"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("preferences"))


def request_estimate(recorded: Column, steps: Column, rejections: Column, retries: Column) -> Column:
    """Requests to the teacher: the recorded number, else steps, rejections and retries; a number that is null or 0 is not recorded."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.coalesce(F.nullif(recorded, F.lit(0)), zero(steps) + zero(rejections) + zero(retries))


def item_ids(items: DataFrame, key: str, order: str, n: str, prefix: str = "P", least: int = 0) -> DataFrame:
    """items with `ids`: prefixed numbers that run on over a task's items in order; items of under `least` get none."""
    counts = F.when(F.col(n) >= least, F.col(n)).otherwise(0)
    upto = F.sum(counts).over(Window.partitionBy(key).orderBy(order))
    numbers = F.transform(F.sequence(upto - counts + 1, upto), lambda k: F.concat(F.lit(prefix), k.cast("string")))
    return items.withColumn("ids", F.when(counts > 0, numbers).otherwise(F.array().cast("array<string>")))


def accepted_answers(best: Column, correct: Column) -> Column:
    """The correct options and the best one, each once, sorted."""
    return F.array_sort(F.array_distinct(F.array_append(correct, best)))


def counted_lists(rows: DataFrame, key: str, size: Column, least: int = 4) -> DataFrame:
    """(key, all_items, counted): lists of a task and those long enough to count."""
    return rows.groupBy(key).agg(F.count("*").alias("all_items"), F.count_if(size >= least).alias("counted"))


def initial_state(dimensions: DataFrame, key: str, order: str, dimension: str, lists: str, best: str, correct: str, least: int = 4) -> DataFrame:
    """(key, preferences, search_arguments, best_options, correct_options): a task's state before its first step.

    lists: of each dimension an array of preferences, each an array of texts (aspect, subcategory, preference, implicit elicitation, ...);
    only those of `least` or more get a number P1, P2, ... over the task's dimensions in order. A null list, best id or array is empty.
    """
    one = _in_order(order, dimension, lists, best, correct)
    held = dimensions.groupBy(key).agg(one.alias("d"))
    long = F.filter(F.flatten(F.transform("d", lambda x: F.transform(F.coalesce(x[lists], F.array().cast("array<array<string>>")), lambda p: F.struct(x[dimension].alias("dimension"), p.alias("p"))))), lambda y: F.size(y["p"]) >= least)
    names = ("aspect", "subcategory", "preference", "implicit_elicitation")
    made = F.transform(long, lambda y, i: F.struct(F.concat(F.lit("P"), (i + 1).cast("string")).alias("id"), *[y["p"][k].alias(n) for k, n in enumerate(names)], y["dimension"].alias("dimension"), F.lit(False).alias("elicited")))
    return held.select(
        key, made.alias("preferences"), F.transform("d", lambda x: x[dimension]).alias("search_arguments"), F.filter(F.transform("d", lambda x: x[best]), lambda b: b.isNotNull()).alias("best_options"),
        F.flatten(F.transform("d", lambda x: F.coalesce(x[correct], F.array().cast("array<string>")))).alias("correct_options"))


def last_of_key(rows: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row a key: the columns of its last row."""
    return rows.groupBy(*key).agg(F.max(F.struct(order, *columns)).alias("r")).select(*key, F.col(f"r.{order}").alias(order), *[F.col(f"r.{c}").alias(c) for c in columns])


# Summaries

def legacy_projection(active: Column, passive: Column, qualities: Column, completion: Column) -> list[Column]:
    """Of a report of the second version: preference coverage, submission rate, share of answers with any quality."""
    right = F.size(F.filter(qualities, lambda q: q > 0)).cast("double")
    return [F.least(F.lit(1.0), active + passive).alias("preference"), F.coalesce(completion, F.lit(0.0)).alias("submitted"), expr.ratio(right, F.size(qualities)).alias("correct_rate")]


def teacher_summary(rows: DataFrame, accepted: Column, gold: Column) -> DataFrame:
    """One row: attempted, accepted, gold, and the rate of accepted ones, 0 if none was attempted."""
    r = rows.agg(F.count("*").alias("attempted"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & gold).alias("gold"))
    return r.withColumn("rate", expr.ratio(F.col("accepted"), F.col("attempted")))


def teacher_run(attempts: DataFrame, task: str) -> DataFrame:
    """(kind, name, n) of a run of the teacher: `total` rows, and counters of `rejection` and `generation` reasons and of `usage`.

    Columns: accepted, tier (of the accepted attempt), rejections, diagnostics (arrays of reasons; a null reason is `unknown`), steps,
    requests, usage (map). A task is accepted if one of its attempts is, with the
    best tier of those (gold before silver); requests that were not recorded are estimated as
    steps and diagnostics. The rate is not here, as n counts: see teacher_summary(). Three small aggregations, one shuffle by task.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    said = F.coalesce(F.size("diagnostics"), F.lit(0))
    own = F.greatest(said, F.lit(0))
    asked = request_estimate(F.col("requests").cast("long"), known("steps"), own.cast("long"), F.lit(0).cast("long"))
    good = expr.is_true(F.col("accepted"))
    per = attempts.groupBy(task).agg(F.count("*").alias("attempts"), F.max(good).alias("ok"), F.min(F.when(good, F.col("tier"))).alias("tier"), F.sum(known("steps")).alias("steps"), F.sum(asked).alias("requests"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    totals = per.agg(
        F.count("*").alias("tasks"), F.count_if("ok").alias("accepted"), F.count_if(F.col("ok") & (F.col("tier") == "gold")).alias("gold"), F.count_if(F.col("ok") & (F.col("tier") == "silver")).alias("silver"), F.count_if(~F.col("ok")).alias("rejected"),
        zero(F.sum("attempts")).alias("attempts"), zero(F.sum("steps")).alias("environment_steps"), zero(F.sum("requests")).alias("teacher_requests"))
    rows = totals.unpivot([], totals.columns, "name", "n").select(F.lit("total").alias("kind"), "name", "n")
    for kind, column in (("rejection", "rejections"), ("generation", "diagnostics")):
        rows = rows.unionByName(attempts.select(F.explode(column).alias("x")).groupBy(F.coalesce("x", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n"))
    used = attempts.select(F.explode("usage").alias("name", "v")).groupBy("name").agg(zero(F.sum("v")).alias("n"))
    return rows.unionByName(used.select(F.lit("usage").alias("kind"), "name", "n"))


def counts_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by each of the columns alone, the others null: one pass over the rows."""
    return rows.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"))


def boundary_manifest(candidates: DataFrame, context: list[str], known_splits: list[str], evaluation: str = "evaluation") -> DataFrame:
    """(section, name, n) of boundary contexts, of which copies (equal in `context`) count once with all their provenance.

    Columns besides `context`, which holds task_id and boundary_type: project_split, composition, training_eligible, source_kinds (an entry
    a provenance). Sections: total, by_boundary_type, by_project_split, by_composition, by_source_kind (an entry each), checks. Null counts as
    unknown. Copies take split and composition that are first by name; one shuffle by context, then sums of a few rows.
    """
    kinds = F.flatten(F.collect_list(F.coalesce("source_kinds", F.array().cast("array<string>"))))
    unique = candidates.groupBy(*context).agg(F.count("*").alias("__n"), F.min("project_split").alias("project_split"), F.min("composition").alias("composition"), F.max(expr.is_true(F.col("training_eligible"))).alias("eligible"), kinds.alias("kinds"))
    cell = lambda section, name, n: F.struct(F.lit(section).alias("section"), F.coalesce(name, F.lit("unknown")).alias("name"), n.cast("long").alias("n"))
    one, extra = F.lit(1), F.col("__n") - 1
    held, trained, strange = F.col("project_split") == evaluation, F.col("eligible"), ~expr.is_true(F.col("project_split").isin(known_splits))
    cells = [cell("total", F.lit("raw_candidates"), F.col("__n")), cell("total", F.lit("unique_contexts"), one), cell("total", F.lit("duplicates_removed"), extra)]
    cells += [cell(f"by_{c}", F.col(c).cast("string"), one) for c in ("boundary_type", "project_split", "composition")]
    cells += [cell("checks", F.lit(name), expr.is_true(c).cast("long")) for name, c in (("evaluation_contexts", held), ("training_contexts", trained), ("evaluation_marked_training", held & trained))]
    many = F.transform("kinds", lambda k: cell("by_source_kind", k, one))
    sums = unique.select(F.explode(F.concat(F.array(*cells), many)).alias("c")).groupBy("c.section", "c.name").agg(F.sum("c.n").alias("n"))
    unresolved = unique.where(strange).agg(F.countDistinct("task_id").alias("n")).select(F.lit("checks").alias("section"), F.lit("unresolved_tasks").alias("name"), "n")
    return sums.unionByName(unresolved)


def source_inventory(files: DataFrame, kind: str, counts: list[str]) -> DataFrame:
    """(kind, files, sums of the counts) of source files; a null count is 0."""
    return files.groupBy(kind).agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts])


def last_scores(rows: DataFrame, key: str, turn: str, score: str, top: float) -> DataFrame:
    """(key, last_score, top): the last rollout's score, and how many of the key's scores equal `top`."""
    return rows.groupBy(key).agg(F.max_by(score, turn).alias("last_score"), F.count_if(F.col(score) == top).alias("top"))


def profile(temperature: Column, top_p: Column) -> Column:
    """The sampling profile that both numbers belong to, else `error`."""
    out = F.lit("error")
    for name, (t, p) in PROFILES.items():
        out = F.when((temperature == t) & (top_p == p), name).otherwise(out)
    return out


def summary_pick(rows: DataFrame, valid: Column, metric: str, coverage: Column) -> DataFrame:
    """One row: the metric over all records, invalid ones as 0, mean search coverage over all records, records."""
    return rows.agg((F.sum(F.when(valid, F.col(metric)).otherwise(0.0)) / F.count("*")).alias(metric), F.avg(F.coalesce(coverage, F.lit(0.0))).alias("search_coverage"), F.count("*").alias("records"))


def itinerary_flags(quality: Column, aspects: Column, searched: Column, valid: Column) -> list[Column]:
    """Gold (every aspect answered best), correct (every aspect right), fully grounded, user aligned. quality: map aspect -> quality."""
    values = F.map_values(quality)
    whole = (F.size(values) == aspects) & (aspects > 0)
    gold, right = whole & F.forall(values, lambda q: q == BEST), whole & F.forall(values, lambda q: q > WRONG)
    grounded = right & (searched == aspects)
    return [gold.alias("gold_itinerary"), right.alias("correct_itinerary"), grounded.alias("fully_grounded"), (expr.is_true(valid) & grounded).alias("aligned")]
