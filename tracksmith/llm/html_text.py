"""Operator 5: main text of web pages by differencing each page with the page of the nearest URL on its host.

A page becomes text lines, one a block, in page order, each with a zone: *article* (inside <article> or <main>), *chrome*
(inside elements that hold no main text: navigation, headers, footers, asides, forms, notices, adverts, comments) or
*other*. Pages are ordered by host, path and id over the whole table. A page's partner is the nearer, by common beginning
of the path, of two neighbours on its host: the nearest page before that is no copy (its lines outside chrome aren't just
the same), and the very next page if it is no copy; of two as near the one before. Where there is none before, it is the
nearest after that is no copy. Lines are aligned by longest common subsequence, and shared lines are deleted.
Two guards stand beside the difference: shared lines of an article zone stay (pages of one host may carry the same
sentences), and chrome goes whether shared or not, since adverts, comments and menus may be a page's own. The result is
the lines that are left, of both other zones: a page may have its body outside a short article zone.

Pages are dealt out by ranges of (host, path, id), so that one host may span many tasks. Ranges are cut at keys of a
bounded sample; a pass over keys and digests of lines finds the first two and the last two pages of each range that differ,
and each range is also sent the two nearest that differ before and after it, as partners only. Then one shuffle of lines
(no markup) brings each range together, and a task streams it in order, holding two pages (and copies at a host's start
until another page comes).

Markup is read in one pass from left to right, in time linear in the page, whatever is left open. A tag ends at the first
`>` outside of quoted values; once a page's quotes don't close, quotes count no longer. Subsequences are found by rows of
bits, split where a table of these is too large (Hirschberg), so that they are longest ones at every size.

Defined results: null or empty html gives an empty text; a null URL counts as the empty host and path; repeated rows
give repeated rows; ids stay whole numbers of 64 bits beside nulls; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm import common

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
CHROME = frozenset("nav header footer aside form menu button select option dialog head title fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice pagination popup promo promoted related reply replies share sharing sidebar skip social sponsor sponsored subscribe toc toolbar widget".split())
#: Parts of a class or id that say nothing about what an element holds: site-nav is navigation; market-share and has-sidebar are not.
PLAIN_NAMES = frozenset("area bar block body bottom box btn buttons col column container content desktop global group heading inner item items left link links list main mobile outer page post posts primary right row secondary section site slot text title top unit wrap wrapper".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg iframe textarea object annotation annotation-xml canvas audio video".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_TAG_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
_EMPTY_COMMENT = re.compile("<!---?>")
#: Cells of a pair's table that is held at a time.
TABLE_BITS = 200_000_000


def _is_chrome(name: str, attributes: str, zone: str = "other") -> bool:
    """Whether an element holds no main text, by its own name, class, id or role. In an article a header may hold the title."""
    if name in CHROME:
        return not (zone == "article" and name == "header")
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        key = key.lower()
        if key == "hidden" or key == "role" and value in CHROME_ROLES:
            return True
        if key in ("class", "id"):
            for word in value.split():
                parts = set(_NAME.findall(word))
                named = parts & CHROME_NAMES - ({"header"} if zone == "article" else set())
                if named and parts <= CHROME_NAMES | PLAIN_NAMES:
                    return True
    return False


def _tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name, whether it closes, attributes) of tags; the name is None for what holds no text, from start to end."""
    at, last, quoted = 0, page.rfind(">"), True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            empty = _EMPTY_COMMENT.match(page, start)
            at = empty.end() if empty else page.find("-->", start + 4) + 3
            at = at if at > 2 else len(page)
            yield start, at, None, False, "comment"
            continue
        if start > last:
            return
        tag = _TAG_NAME.match(page, start + 1)
        if tag is None:
            at = start + 1
            if page[at] in "!?":
                at = page.index(">", at) + 1
                yield start, at, None, False, "comment"
            continue
        end, look = -1, tag.end()
        while quoted and end < 0:
            stop = _STOP.search(page, look)
            if stop is not None and stop[1] is None:
                end = stop.start()
                break
            look = page.find(stop[1], stop.end()) + 1 if stop is not None else 0
            quoted = look > 0
        if end < 0:
            end = page.index(">", tag.end())
        name, attributes, at = tag[2].lower(), page[tag.end() : end], end + 1
        if name in RAW and not tag[1] and not (name == "svg" and attributes.endswith("/")):
            close = _RAW_END[name].search(page, at)
            at = close.end() if close else len(page)
            yield start, at, None, False, ""
        else:
            yield start, at, name, bool(tag[1]), attributes


def lines(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of every block with text, in page order."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # element, zone inside it
    inside: Counter[str] = Counter()  # open elements of each name
    held: list[str] = []
    zone = "other"

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((zone, text))
            held.clear()

    def pop() -> str:
        nonlocal zone
        name = stack.pop()[0]
        inside[name] -= 1
        zone = stack[-1][1] if stack else "other"
        return name

    at = 0
    page = page or ""
    for start, end, name, closes, attributes in _tokens(page):
        if start > at:
            held.append(page[at:start])
        at = end
        if name is None:
            if attributes != "comment":
                held.append(" ")
            continue
        block = name in BLOCKS
        if name == "br":
            held.append(" ")
        if block:
            flush()
        if closes:
            if inside[name]:
                while pop() != name:
                    pass
        elif name not in VOID and (block or _is_chrome(name, attributes, zone)) and not attributes.endswith("/"):
            if stack and stack[-1][0] == "p":
                pop()
            if name in ("li", "option", "dd", "dt", "td", "th", "tr") and stack and stack[-1][0] == name:
                pop()
            if name == "main":
                flush()
                zone = "article"
            elif zone != "chrome":
                flush()
                if _is_chrome(name, attributes, zone):
                    zone = "chrome"
                elif name == "article":
                    zone = "article"
            stack.append((name, zone))
            inside[name] += 1
    held.append(page[at:])
    flush()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    same = set(range(start)) | set(range(len(a) - end, len(a)))
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    both = set(a) & set(b)
    left = [i for i, x in enumerate(a) if x in both]
    return same | {start + left[k] for k in _subsequence([a[i] for i in left], [x for x in b if x in both])}


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """For each line of a: bit j is unset where the longest common subsequence of a so far with b[: j + 1] is longer than with b[:j]."""
    places: dict[str, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of a with b[:j], for j from 0 to all."""
    *_, row = _rows(a, b)
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def _subsequence(a: list[str], b: list[str]) -> list[int]:
    """Places in a of a longest common subsequence with b, a bit a cell; pairs of over TABLE_BITS cells are split (Hirschberg)."""
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        at = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _subsequence(a[:half], b[:at]) + [half + k for k in _subsequence(a[half:], b[at:])]
    rows = list(_rows(a, b))
    out = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> j - 1 & 1:
            out.append(i)
            j -= 1
    return out[::-1]


def main_text(own: list[tuple[str, str]], partner: list[tuple[str, str]] | None) -> str:
    same = shared([t for _, t in own], [t for _, t in partner]) if partner else set()
    return "\n".join(text for i, (zone, text) in enumerate(own) if zone == "article" or zone == "other" and i not in same)


def _url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


#: Keys of a bounded sample from which the ranges are cut, a range and at the most; ranges a shuffle partition.
SAMPLE_A_RANGE, SAMPLE, RANGES = 32, 200_000, 3
_KEY = "host string, path string, sort_id long, sort_url string"
_KEY_NAMES = [c.split()[0] for c in _KEY.split(", ")]


def _keyed(pages: DataFrame, *columns: str) -> DataFrame:
    host, path = _url_parts(F.col("url"))
    number = F.col("page_id").cast("long")
    return pages.select(host.alias("host"), path.alias("path"), F.coalesce(number, F.lit(-(1 << 63))).alias("sort_id"), F.coalesce("url", F.lit("")).alias("sort_url"), *[number.alias(c) if c == "page_id" else F.col(c) for c in columns])


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


_PAGE = [*_KEY_NAMES, "digest"]


def digest(own: list[tuple[str, str]]) -> str:
    """Of the lines outside chrome; pages of one digest are copies."""
    return xxhash.xxh128_hexdigest("\n".join(text for zone, text in own if zone != "chrome").encode("utf-8", "surrogatepass"))


def _differing(pages: list[tuple], last: bool = False) -> list[tuple]:
    """Of keys that end in a digest: the first, and the first that is on another host or no copy of it (or the last two)."""
    end = max if last else min
    one = end(pages)
    rest = [p for p in pages if (p[0], p[-1]) != (one[0], one[-1])]
    return [one, end(rest)] if rest else [one]


_ENDS = f"bucket int, {_KEY}, digest string"
_SENT = f"{_KEY}, page_id long, url string, text string, bucket int, digest string, place int"
_TEXTS = "page_id long, url string, text string"


def _packed(own: list[tuple[str, str]]) -> str:
    """Lines as one string; a line's text has no line end."""
    return "\n".join(zone[0] + text for zone, text in own)


def _unpacked(packed: str) -> list[tuple[str, str]]:
    return [({"a": "article", "c": "chrome", "o": "other"}[line[0]], line[1:]) for line in packed.split("\n")] if packed else []


def _bounds(keys: DataFrame, ranges: int) -> list[tuple]:
    """Keys that cut the table into ranges, from a sample by hash of about SAMPLE_A_RANGE keys a range, SAMPLE at the most."""
    target = min(SAMPLE, SAMPLE_A_RANGE * ranges)
    every = max(1, keys.count() // target)
    sample = sorted(tuple(r) for r in keys.where(F.pmod(F.xxhash64(*_KEY_NAMES), F.lit(every)) == 0).distinct().collect())
    return [sample[k * len(sample) // ranges] for k in range(1, ranges)] if sample else []


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    spark = pages.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(_keyed(pages), RANGES * partitions)

    def both_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for part in common.rows(batches, *_KEY_NAMES, "html"):
            for *key, page in part:
                bucket = bisect_right(bounds, tuple(key))
                one = (*key, digest(lines(page)))
                first, last = held.get(bucket, ((), ()))
                held[bucket] = _differing([*first, one]), _differing([*last, one], True)
        yield common.record_batch(_schema(_ENDS), [(bucket, *page) for bucket, ends in held.items() for page in {*ends[0], *ends[1]}])

    def joined_ends(part: pa.Table) -> pa.Table:
        pages = list(zip(*(part[c].to_pylist() for c in _PAGE), strict=True))
        rows = [(part["bucket"][0].as_py(), *page) for page in {*_differing(pages), *_differing(pages, True)}]
        return pa.Table.from_batches([common.record_batch(_schema(_ENDS), rows)])

    # Four pages a range at the most, without their html.
    ends: dict[int, list[tuple]] = {}
    for row in _keyed(pages, "html").mapInArrow(both_ends, _ENDS).groupBy("bucket").applyInArrow(joined_ends, _ENDS).collect():
        ends.setdefault(row["bucket"], []).append(tuple(row)[1:])
    also: dict[tuple, list[tuple[int, int]]] = {}
    for place, order in ((-1, sorted(ends)), (1, sorted(ends, reverse=True))):
        near: list[tuple] = []
        for bucket in order:
            for page in near:
                also.setdefault(page, []).append((bucket, place))
            near = _differing([*near, *ends[bucket]], place < 0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent_also = set()  # repeated rows are sent once a task
        for part in common.rows(batches, *_KEY_NAMES, "page_id", "url", "html"):
            out = []
            for *key, page_id, url, page in part:
                own = lines(page)
                one = (*key, digest(own))
                places = [(bisect_right(bounds, tuple(key)), 0)]
                if one in also and one not in sent_also:
                    sent_also.add(one)
                    places += also[one]
                packed = _packed(own)
                out += [(*key, page_id, url, packed, bucket, one[-1], place) for bucket, place in places]
            yield common.record_batch(_schema(_SENT), out)

    sent = _keyed(pages, "page_id", "url", "html").mapInArrow(send, _SENT)
    ordered = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket", "place", *_PAGE)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk()
        for part in common.rows(batches, "bucket", "host", "path", "digest", "place", "page_id", "url", "text"):
            yield common.record_batch(_schema(_TEXTS), [x for row in part for x in walk.step(*row)])
        yield common.record_batch(_schema(_TEXTS), list(walk.end()))

    return ordered.mapInArrow(stream, _TEXTS).withColumn("n_chars", F.length("text").cast("long"))


class _Walk:
    """A walk along ordered pages that gives each (place 0) the text left by its partner, one page late."""

    def __init__(self) -> None:
        self.at: tuple | None = None
        self._begin()

    def _begin(self) -> None:
        self.held: tuple | None = None  # (path, digest, own lines, id and URL or None if it is a partner only)
        self.other: tuple | None = None  # the nearest before it that is no copy of it
        self.waiting: list[tuple] = []  # a host's first page and its copies

    def step(self, bucket: int, host: str, path: str, digest: str, place: int, page_id: int | None, url: str | None, packed: str) -> Iterator[tuple]:
        if self.at != (bucket, host):
            yield from self.end()
            self.at = (bucket, host)
        new = (path, digest, _unpacked(packed), (page_id, url) if place == 0 else None)
        if self.held is not None:
            differs = self.held[1] != digest
            if self.other is not None:
                yield from self._give(self.held, self._nearer(new) if differs else self.other)
            else:
                self.waiting.append(self.held)
                if differs:
                    for page in self.waiting:
                        yield from self._give(page, new)
                    self.waiting = []
            if differs:
                self.other = self.held
        self.held = new

    def end(self) -> Iterator[tuple]:
        if self.held is not None:
            for page in [*self.waiting, self.held]:
                yield from self._give(page, self.other)
        self._begin()

    def _nearer(self, after: tuple) -> tuple:
        path = self.held[0]
        return after if len(commonprefix([path, after[0]])) > len(commonprefix([path, self.other[0]])) else self.other

    @staticmethod
    def _give(page: tuple, partner: tuple | None) -> Iterator[tuple]:
        if page[3] is not None:
            yield *page[3], main_text(page[2], partner[2] if partner else None)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages", "page_id", "url", "html"))
