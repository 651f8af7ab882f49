"""Column functions that operators share. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d clamped to [0, 1]; 0 where d <= 0."""
    return F.when(d <= 0, 0.0).otherwise(clamp(F.try_divide(n.cast("double"), d.cast("double")), 0.0, 1.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def signed_round(x: Column, digits: int) -> Column:
    """x rounded; a zero has the sign of x, as IEEE 754 and SQL's round have it (F.round gives a positive one)."""
    rounded = F.round(x, digits)
    return F.when(rounded == 0, x * F.lit(0.0)).otherwise(rounded)


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: within lambda functions nothing else keeps a repeated part from it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stable_key(seed: str, key: Column) -> Column:
    """Hex SHA-256 of seed, a zero byte and the key: an order that no run and no layout changes."""
    return F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), key), 256)


def uniform(*parts: Column | str) -> Column:
    """Deterministic uniform number in [0, 1): the first 64 bits of the SHA-256 of the parts (texts or columns) joined by |."""
    joined = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substr(F.sha2(joined, 256), F.lit(1), F.lit(16)), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def is_true(x: Column) -> Column:
    """True only for true; null and false are false."""
    return F.coalesce(x, F.lit(False))


def reasons(*checks: tuple[Column, str]) -> Column:
    """Sorted names of the checks that hold (a null check does not)."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks])))


def nearest_rank(x: Column | str, share: float) -> Column:
    """The value at place ceil(share * n), an aggregate."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {x})") if isinstance(x, str) else F.percentile_approx(x, share, 1 << 30)


def casefold(x: Column) -> Column:
    """Lower case for comparisons: sharp s as ss, final sigma as sigma."""
    return F.translate(F.replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), F.lit("ſ"), F.lit("s")), "ς", "σ")


def collapse(x: Column) -> Column:
    """White space runs to one blank, ends trimmed, case folded."""
    return casefold(F.trim(F.regexp_replace(x, r"\s+", " ")))


def action_signature(choice: Column, content: Column) -> Column:
    return F.concat(choice, F.lit(":"), collapse(content))


def query_form(x: Column) -> Column:
    """[a-z0-9]+ tokens of the lower-cased text joined by blanks, without a leading `search`."""
    joined = F.array_join(F.regexp_extract_all(casefold(x), F.lit("([a-z0-9]+)"), F.lit(1)), " ")
    return F.regexp_replace(joined, "^search( |$)", "")


def substantive_change(a: Column, b: Column) -> Column:
    """Both query forms have tokens, and not the same multiset of them."""
    tokens = lambda x: F.array_sort(F.split(x, " "))
    return (a != "") & (b != "") & (tokens(a) != tokens(b))


def search_form(x: Column) -> Column:
    """Case folded, 10th to 10, & to and, everything but letters and digits to blanks."""
    out = F.regexp_replace(casefold(x), r"\b(\d+)(?:st|nd|rd|th)\b", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "&", " and "), "[^a-z0-9]+", " "))


def option_ids(x: Column) -> Column:
    """Distinct option ids ([ACFHR] and digits, no word character beside), in order."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(OPTION_IDS), F.lit(1)))


# Option prefixes and what they stand for, and how an option id stands in a text.
PREFIXES = {"F": "flight", "H": "hotel", "A": "apartment", "C": "rental_car", "R": "restaurant"}
OPTION_IDS = r"(?<![A-Za-z0-9])([ACFHR][0-9]+)(?![A-Za-z0-9])"


def option_aspect(option: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    return F.when(option.rlike("^[ACFHR][0-9]+$"), F.try_element_at(table, F.substr(option, F.lit(1), F.lit(1))))


def task_aspects(task_id: Column) -> Column:
    """Aspects of an id such as apartment:2-100|restaurant:2-104."""
    return F.transform(F.split(task_id, r"\|"), lambda x: F.split_part(x, F.lit(":"), F.lit(1)))


def task_composition(task_id: Column) -> Column:
    """Digits between colon and hyphen of each part, joined."""
    return F.array_join(F.transform(F.split(task_id, r"\|"), lambda x: F.regexp_extract(x, r":(\d+)-", 1)), "")


def json_salvage(x: Column) -> Column:
    """The text itself if it is a JSON object, else a fenced block, else from the first to the last brace, else null."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    fenced = F.regexp_extract(x, r"(?s)```json\s*(.*?)```", 1)
    braces = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    good = lambda c: F.when(F.try_parse_json(c).isNotNull() & trim(c).startswith("{"), trim(c))
    return F.coalesce(good(x), good(fenced), good(braces))
