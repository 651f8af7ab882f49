"""Transcripts: calls and their arguments, public text, observations, targets of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions import expr

CHOICES = ("search", "action", "answer")
CALL = "struct<thought:string,choice:string,content:string>"

# Phrases of a failing search backend.
FALLBACKS = (
    "searching backend is experiencing some issues",
    "search backend is experiencing some issues",
    "by default will return n/a",
    "search backend is unavailable",
    "search is temporarily unavailable",
)
# Words by which an aspect is named.
ASPECT_HINTS = {
    "flight": ["flight", "airline", "carrier"],
    "hotel": ["hotel"],
    "apartment": ["apartment"],
    "rental_car": ["rental car", "car rental", "rental vehicle"],
    "restaurant": ["restaurant", "dining"],
}


def normalise(messages: DataFrame, role: str, text: str, roles: tuple[str, ...] = ("system", "user", "assistant", "tool")) -> DataFrame:
    """Messages of known roles, texts trimmed, other columns kept."""
    return messages.where(F.col(role).isin(*roles)).withColumn(text, F.trim(F.coalesce(F.col(text), F.lit(""))))


def call_parts(raw: Column) -> Column:
    """struct<choice, content, error, is_object> of a JSON object of thought, choice and content.

    A choice in brackets before the content must be the call's own; the error is null if the call is well formed.
    """
    names = F.json_object_keys(raw)
    call = F.from_json(raw, CALL, {"mode": "PERMISSIVE"})
    read = F.struct(names.alias("names"), F.trim(call["thought"]).alias("thought"), F.lower(F.trim(call["choice"])).alias("choice"), F.trim(call["content"]).alias("content"))
    blank = lambda x: F.coalesce(x, F.lit("")) == ""

    def split(c: Column) -> Column:
        prefix = F.lower(F.regexp_extract(c["content"], r"(?i)^\[(search|action|answer|finish)\]", 1))
        rest = F.trim(F.regexp_replace(c["content"], r"(?i)^\[(search|action|answer|finish)\]\s*", ""))
        return F.struct(c.alias("c"), prefix.alias("prefix"), rest.alias("rest"))

    def judged(x: Column) -> Column:
        c, prefix, rest = x["c"], x["prefix"], x["rest"]
        keys = F.array_join(F.array_sort(F.coalesce(c["names"], F.array().cast("array<string>"))), ",")
        error = (
            F.when(keys != "choice,content,thought", "wrong_parameters").when(blank(c["thought"]), "empty_thought").when(blank(c["content"]), "empty_content")
            .when(~F.coalesce(c["choice"].isin(*CHOICES), F.lit(False)), "unknown_choice").when(prefix == "finish", "finish_is_not_a_call")
            .when((prefix != "") & (prefix != c["choice"]), "prefix_conflicts").when(rest == "", "empty_content")
        )
        return F.struct(c["choice"].alias("choice"), rest.alias("content"), error.alias("error"), c["names"].isNotNull().alias("is_object"))

    return expr.let(expr.let(read, split), judged)


def parse_call(df: DataFrame, arguments: str) -> DataFrame:
    """df with call_choice, call_content and call_error of call_parts(); the first two are null if the call is malformed."""
    out = df.withColumn("__call", call_parts(F.col(arguments)))
    good = F.col("__call.error").isNull()
    return out.withColumns({"call_error": F.col("__call.error"), "call_choice": F.when(good, F.col("__call.choice")), "call_content": F.when(good, F.col("__call.content"))}).drop("__call")


def parse_tagged(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, choice, content, response) of calls written as tags in free text, each with the next response after it."""
    import re

    import pandas as pd

    call = re.compile(r"<tool_call>(.*?)</tool_call>|<tool_response>(.*?)</tool_response>", re.S | re.I)
    parameter = re.compile(r"<parameter=(\w+)>\s*(.*?)\s*</parameter>", re.S | re.I)

    def run(parts):
        for part in parts:
            out = []
            for k, raw in part.itertuples(index=False):
                open_call, n = None, 0
                for found in call.finditer(raw or ""):
                    if found[1] is not None:
                        if open_call:
                            out.append((k, n, *open_call, None))
                            n += 1
                        values = {a.lower(): b for a, b in parameter.findall(found[1])}
                        open_call = (values.get("choice"), values.get("content"))
                    elif open_call:
                        out.append((k, n, *open_call, found[2].strip()))
                        open_call, n = None, n + 1
                if open_call:
                    out.append((k, n, *open_call, None))
            yield pd.DataFrame(out, columns=["key", "ord", "choice", "content", "response"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, ord long, choice string, content string, response string")


def contains_any(text: Column, phrases: tuple[str, ...] | list[str]) -> Column:
    """Whether the collapsed lower-case text holds one of the phrases."""
    plain = expr.collapse(text)
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(plain, F.lit(p))
    return out


def observation(choice: Column, feedback: Column, phrases: tuple[str, ...] = FALLBACKS) -> Column:
    """Kind of an observation; a fallback phrase goes before visible ids."""
    failed = contains_any(feedback, phrases)
    return F.when(failed & (choice == "search"), "search_fallback").when(failed, "fallback").when((choice == "search") & (F.size(expr.option_ids(feedback)) > 0), "search_normal").when(choice == "search", "search_empty").otherwise("text")


def _hint(hint: str) -> str:
    return r"(?i)(?<![a-z0-9])" + r"\s+".join(hint.split()) + r"(?![a-z0-9])"


def public_aspects(text: Column, hints: dict[str, list[str]] | None = None) -> Column:
    """Aspects in order of their first mention, ties by name; a hint that is listed first sets an aspect's place."""
    found = []
    for aspect, words in (hints or ASPECT_HINTS).items():
        place = F.coalesce(*[F.when(F.regexp_instr(text, F.lit(_hint(w))) > 0, F.length(F.regexp_extract(text, r"(?s)^(.*?)" + _hint(w).replace("(?i)", "(?i:") + ")", 1))) for w in words])
        found.append(F.when(place.isNotNull(), F.struct(place.alias("p"), F.lit(aspect).alias("a"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda x: x["a"])


def deinflect(words: Column, known: list[str]) -> Column:
    """ies to y, es and s dropped: the first of these that is a known word, else the word itself."""
    table = F.array(*[F.lit(k) for k in known])

    def one(w: Column) -> Column:
        y, es, s = F.regexp_replace(w, "ies$", "y"), F.regexp_replace(w, "es$", ""), F.regexp_replace(w, "s$", "")
        has = lambda x, least: F.array_contains(table, x) & (x != w) & (F.length(w) > least)
        return F.when(has(y, 3), y).when(has(es, 2), es).when(has(s, 1), s).otherwise(w)

    return F.transform(words, one)


def hint_words(text: Column, known: list[str]) -> Column:
    """[a-z0-9]+ words of the case-folded text, known inflections undone."""
    return deinflect(F.regexp_extract_all(F.translate(expr.casefold(text), "_", " "), F.lit("([a-z0-9]+)"), F.lit(1)), known)


def field_matches(df: DataFrame, key: str, text: str, hints: DataFrame, names: DataFrame | None = None, dimensions: str | None = None) -> DataFrame:
    """(key, aspect, field) named in a text.

    hints: (aspect, field, hint) and names: (aspect, hint), small tables that are broadcast. Hints stand on whole words. Only
    aspects that a text names itself count, if there are any; else all of them. A place inside one of more words, of another
    field of the same aspect, doesn't count. dimensions: an array of the aspects that count at all, if given.
    """
    rows = hints.select("hint").unionByName(names.select("hint")) if names is not None else hints.select("hint")
    split = lambda x: F.regexp_extract_all(F.translate(expr.casefold(x), "_", " "), F.lit("([a-z0-9]+)"), F.lit(1))
    known = [r["w"] for r in rows.select(F.explode(split(F.col("hint"))).alias("w")).distinct().collect()]  # words of the hints
    texts = df.select(F.col(key).alias("key"), hint_words(F.col(text), known).alias("words"), (F.col(dimensions) if dimensions else F.lit(None).cast("array<string>")).alias("dimensions"))

    def spans(table: DataFrame) -> DataFrame:
        worded = table.withColumn("hint", hint_words(F.col("hint"), known)).withColumn("width", F.size("hint")).where("width > 0")
        met = texts.join(F.broadcast(worded), F.expr("forall(hint, w -> array_contains(words, w)) AND (dimensions IS NULL OR array_contains(dimensions, aspect))"))
        places = F.expr("filter(sequence(1, greatest(size(words) - width + 1, 1)), i -> slice(words, i, width) = hint)")
        return met.withColumn("start", F.explode(places)).withColumn("stop", F.col("start") + F.col("width"))

    found = spans(hints)
    if names is not None:
        named = spans(names).select("key", "aspect").distinct()
        some = named.select("key").distinct()
        found = found.join(named, ["key", "aspect"], "left_semi").unionByName(found.join(some, "key", "left_anti"))
    found = found.select("key", "aspect", "field", "width", "start", "stop")
    wider = found.select("key", "aspect", *[F.col(c).alias(f"__{c}") for c in ("field", "width", "start", "stop")])
    inside = [found["key"] == wider["key"], found["aspect"] == wider["aspect"], F.col("field") != F.col("__field"), F.col("__width") > F.col("width"), F.col("__start") <= F.col("start"), F.col("__stop") >= F.col("stop")]
    condition = inside[0]
    for c in inside[1:]:
        condition = condition & c
    return found.join(wider, condition, "left_anti").select("key", "aspect", "field").distinct()


def query_issue(df: DataFrame, key: str, matches: DataFrame) -> DataFrame:
    """(key, issue): vague without a match, bundled with several, else the single match."""
    n = matches.groupBy("key").agg(F.count("*").alias("n"), F.min(F.concat_ws(".", "aspect", "field")).alias("one"))
    return df.select(F.col(key).alias("key")).join(n, "key", "left").select("key", F.when(F.col("n").isNull(), "vague").when(F.col("n") > 1, "bundled").otherwise(F.col("one")).alias("issue"))


def base_search(df: DataFrame, key: str, text: str, aspects: DataFrame) -> DataFrame:
    """(key, aspect): the only aspect of the key that has an alias in the text and all its argument values; else null.

    aspects: (key, aspect, alias, arguments array<string>), a row an alias. An aspect without arguments doesn't count; an
    argument that is empty after normalising is in every text.
    """
    joined = df.select(key, expr.search_form(F.col(text)).alias("t")).join(aspects, key, "left")
    holds = F.contains("t", expr.search_form(F.col("alias"))) & (F.size("arguments") > 0) & F.forall("arguments", lambda v: F.contains(F.col("t"), expr.search_form(v)))
    some = F.collect_set(F.when(holds, F.col("aspect")))
    return joined.groupBy(key).agg(some.alias("a")).select(key, F.when(F.size("a") == 1, F.col("a")[0]).alias("aspect"))


def search_context(messages: DataFrame, key: str, turn: str, role: str, text: str, about: Column, aspect: Column, most: int = 1600) -> DataFrame:
    """(key, context): texts of all user messages in order, then those of tool replies to calls on the aspect; each is cut at `most`.

    about: the aspect that an assistant message's only call is about, or null. A reply is the next message. Empty texts are left out.
    """
    on = F.lag(F.when(F.col(role) == "assistant", about)).over(Window.partitionBy(key).orderBy(turn))
    cut = F.substring(F.col(text), 1, most)
    kind = F.when(F.col(role) == "user", 0).when((F.col(role) == "tool") & (F.col("__on") == F.col("__aspect")), 1)
    part = F.when(kind.isNotNull() & (F.col(text) != ""), F.struct(kind.alias("kind"), F.col(turn).alias("turn"), cut.alias("text")))
    found = messages.withColumn("__on", on).withColumn("__aspect", aspect).groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return found.select(key, F.transform("parts", lambda x: x["text"]).alias("context"))


def render_candidates(prefix: str, options: Column) -> Column:
    """A list of candidates as text: a head line, then a JSON object a line."""
    return F.concat(F.lit(prefix), F.lit("\n"), F.array_join(F.transform(options, lambda o: F.to_json(o)), "\n"))


def alias_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens): NFKC, case-folded alphanumeric tokens, plurals to singulars. No built-in has NFKC: Arrow batches."""
    import re
    import unicodedata

    import pandas as pd

    token = re.compile(r"[^\W_]+")

    def run(parts):
        for part in parts:
            texts = part["text"].fillna("")
            yield pd.DataFrame({"key": part["key"], "tokens": [[w[:-1] if w.endswith("s") and not w.endswith("ss") and len(w) > 3 else w for w in token.findall(unicodedata.normalize("NFKC", t).casefold())] for t in texts]})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, tokens array<string>")


POLICY_START, POLICY_END = "<!-- policy v1 -->", "<!-- end policy -->"


def strip_policy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)\s*<!-- policy v1 -->.*?<!-- end policy -->", ""))


def ensure_policy(text: Column, policy: str) -> Column:
    """Exactly one policy block, at the end."""
    return F.concat(strip_policy(text), F.lit(f"\n{POLICY_START}{policy}{POLICY_END}"))


def control_note(aspect: Column, phase: Column, fallbacks: Column, ids: Column) -> Column:
    """One line of fixed order about the control state."""
    shown = F.when(F.size(ids) > 0, F.array_join(F.array_sort(ids), ",")).otherwise("none")
    return F.concat_ws(" | ", F.lit("control"), F.concat(F.lit("aspect: "), F.coalesce(aspect, F.lit("none"))), F.concat(F.lit("phase: "), phase), F.concat(F.lit("fallbacks: "), fallbacks.cast("string")), F.concat(F.lit("visible: "), shown))


def canonical(*pairs: tuple[str, Column], spaced: bool) -> Column:
    """A flat JSON object: in the given order with blanks after separators, or by sorted keys and compact. Nulls stay."""
    colon, comma = (": ", ", ") if spaced else (":", ",")
    given = pairs if spaced else sorted(pairs)
    own = lambda c: F.coalesce(F.get(F.regexp_extract_all(F.to_json(F.struct(c.alias("v"))), F.lit(r'(?s)^\{"v":(.*)\}$'), F.lit(1)), 0), F.lit("null"))
    return F.concat(F.lit("{"), F.concat_ws(comma, *[F.concat(F.lit(f'"{k}"{colon}'), own(c)) for k, c in given]), F.lit("}"))
