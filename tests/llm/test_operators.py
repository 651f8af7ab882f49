"""Each operator against a brute-force version, on a fixture of awkward rows and on empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracksmith.llm import bpe, components, decontaminate, html_text, langid, license, pitman_yor, quality, repetition, simhash, warc

from .conftest import prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def held(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def paired(docs, result):
    """Texts and result rows, both in order of (id, text-free columns)."""
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in docs.collect()), key=lambda x: x[:2])
    rows = sorted(result.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(texts) == len(rows)
    return [(t[2], r) for t, r in zip(texts, rows, strict=True)]


# 1

def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def test_bpe_equals_tiktoken(docs, no_docs):
    import tiktoken

    path, pattern = tokenizer()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.Ranks(path).token_of, special_tokens={})
    for text, row in paired(docs, bpe.digests(docs, path, pattern)):
        ids = encoding.encode_ordinary(text or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(no_docs, path, pattern).count() == 0


def test_bpe_round_trip(docs):
    path, pattern = tokenizer()
    back = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    for text, row in paired(docs, back):
        assert bytes(row["bytes"]) == (text or "").encode()


def test_bpe_long_pieces():
    """Pieces over SHORT bytes are cut into blocks; random letters and runs of one letter."""
    import tiktoken

    path, pattern = tokenizer()
    ranks = bpe.Ranks(path)
    codec = bpe.Codec(ranks, pattern)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.token_of, special_tokens={})
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("etaoinshr"), 300)) for _ in range(20)] + ["a" * n for n in (41, 64, 1001)] + ["ab" * 99, "é" * 70, " " * 80 + "x"]
    for text, runs in zip(texts, codec.encode(texts), strict=True):
        assert b" ".join(runs).decode() == " ".join(map(str, encoding.encode_ordinary(text)))


def test_bpe_very_long_pieces():
    import time

    import tiktoken

    path, pattern = tokenizer()
    ranks = bpe.Ranks(path)
    codec = bpe.Codec(ranks, pattern)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.token_of, special_tokens={})
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list(letters), 60_000)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ACGT")] + ["a" * 20_001, "ab" * 9_000 + "a", " " * 7_001 + "x", "=" * 5_003, "日本語" * 3_000, "internationalization" * 700]
    began = time.perf_counter()
    found = codec.encode(texts)
    assert time.perf_counter() - began < 60
    for text, runs in zip(texts, found, strict=True):
        assert b" ".join(runs).decode() == " ".join(map(str, encoding.encode_ordinary(text)))
    assert codec.decode(found) == [t.encode() for t in texts]


def test_bpe_merges_new_pieces_of_many_texts_together(monkeypatch):
    """1,500 texts of a few new words each cost one query of merges and one of bytes, not two for every 256 texts."""
    import pyarrow as pa
    import tiktoken

    path, pattern = tokenizer()
    ranks = bpe.Ranks(path)
    codec = bpe.Codec(ranks, pattern)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.token_of, special_tokens={})
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("etaoinshr  .7é\n"), 60)) for _ in range(1_497)] + [None, "", "x" * 300 + " x"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(at, at + 300)), "text": pa.array(texts[at : at + 300], pa.string())}) for at in range(0, 1_500, 300)]

    class Counted:
        def __init__(self, db):
            self.db, self.asked = db, []

        def sql(self, text):
            self.asked.append(text)
            return self.db.sql(text)

        def __getattr__(self, name):
            return getattr(self.db, name)

    def run():
        return [(doc_id, *pair) for part in bpe._parts(iter(batches)) for (doc_id, _), pair in zip(part, codec.round_trip([t for _, t in part]), strict=True)]

    expected = [(k, " ".join(map(str, encoding.encode_ordinary(t or ""))).encode(), (t or "").encode()) for k, t in enumerate(texts)]
    assert len(list(bpe._parts(iter(batches)))) == 1
    short = [batch.slice(0, 298) for batch in batches]
    codec.db = Counted(codec.db)
    part = [row for batch in short for row in zip(*batch.to_pydict().values(), strict=True)]
    list(codec.round_trip([t for _, t in part]))
    assert codec.db.asked == [bpe.MERGE, bpe.DECODE]
    assert run() == expected
    monkeypatch.setattr(bpe, "PIECES_KEPT", 50)  # forgetting, and parts of few texts, change nothing
    monkeypatch.setattr(bpe, "PART_CHARS", 20_000)
    assert len(list(bpe._parts(iter(batches)))) > 5
    assert run() == expected


# 2

def test_bpe_shifted_runs():
    """A run that other letters shift by a byte, and many different long pieces: near linear, equal to tiktoken."""
    import string
    import time

    import tiktoken

    path, pattern = tokenizer()
    ranks = bpe.Ranks(path)
    codec = bpe.Codec(ranks, pattern)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.token_of, special_tokens={})
    rng = np.random.default_rng(8)
    texts = [head + run * 4_000 + tail for head in string.ascii_letters for run, tail in (("o", ""), ("e", "k"))]
    texts += [head + run * n for head, run, n in (("g", "o", 8_001), ("g", "o", 30_001), ("l", "o", 15_001), ("h", "e", 15_001), ("q", "ha", 100_000), ("", "o", 200_000), ("ab", "cab", 30_000))]
    texts += ["".join(rng.choice(list(string.ascii_lowercase), n)) for n in rng.integers(65, 600, 500)]
    began = time.perf_counter()
    found = codec.encode(texts)
    assert time.perf_counter() - began < 60
    for text, runs in zip(texts, found, strict=True):
        if len(text) < 100_000:  # tiktoken itself takes long
            assert b" ".join(runs).decode() == " ".join(map(str, encoding.encode_ordinary(text)))
    assert codec.decode(found) == [t.encode() for t in texts]
    for text in texts[:60:7]:  # the heap in small windows
        whole = codec.merge_heap(text.encode())
        bpe.WINDOW, kept = 100, bpe.WINDOW
        try:
            assert codec.merge_windows(text.encode()) == whole
        finally:
            bpe.WINDOW = kept


def test_quality_learns_held_out(spark, no_docs):
    good = [(i, prose(i), 1) for i in range(120)]
    bad = [(200 + i, " ".join(w + "%%%" for w in prose(i).split()), 0) for i in range(120)]
    rows = good + bad + [(500, None, None), (501, "", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, quality int")
    truth = {i: y for i, _, y in rows}
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["held_out"] == (held(r["doc_id"], 4) == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    judged = [r for r in out if r["held_out"] and truth[r["doc_id"]] is not None]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in judged) >= 0.95 * len(judged) > 0
    assert quality.classify(no_docs, labels).count() == 0
    assert [r["score"] for r in quality.classify(docs, labels.limit(0)).collect()] == [0.5] * len(rows)


def test_quality_keeps_columns(spark, docs):
    labels = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    assert quality.keep(docs, labels).columns == docs.columns


# 3

def brute_repeats(words, least):
    covered, longest = set(), 0
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            if i != j:
                n = 0
                while max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                    n += 1
                best = max(best, n)
        if best >= least:
            covered |= set(range(i, i + best))
            longest = max(longest, best)
    return len(covered), longest


def test_repeats_equal_brute_force():
    rng = np.random.default_rng(3)
    for n, letters in ((0, 2), (1, 2), (7, 1), (40, 2), (60, 3), (80, 6), (90, 40)):
        for least in (1, 2, 5, 8):
            words = [str(x) for x in rng.integers(0, letters, n)]
            code = repetition.codes([w.encode() for w in words])
            if n > least:
                order, common = repetition.suffix_array(code)
                assert [list(code[i:]) for i in order] == sorted(list(code[i:]) for i in range(n))
            assert repetition.repeats(code, least) == (brute_repeats(words, least) if n > least else (0, 0))


def test_rules(docs, no_docs):
    for text, row in paired(docs, repetition.rules(docs)):
        words = WORD.findall((text or "").encode())
        windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, copies = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line.encode()):
                copies += line in seen
                seen.add(line)
        assert row["n_words"] == len(words) and row["n_repeat_words"] == len(again) and row["n_dup_lines"] == copies
        assert row["word_chars"] == sum(len(w.decode()) for w in words) and row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert row["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (row["base_failed"] and row["kept"])
    assert repetition.rules(no_docs).count() == 0


# 4

def test_language(spark, no_docs):
    def text(k, letters):
        return " ".join("".join(letters[(k * 7 + i * j + j) % len(letters)] for j in range(3 + i % 4)) for i in range(40))

    rows = [(i, text(i, "aeiou"), "va") if i % 2 else (i, text(i, "bcdfg"), "cb") for i in range(60)]
    rows += [(90, None, "va"), (91, "12 34 !", "va"), (92, text(3, "aeiou"), None), (None, text(4, "bcdfg"), "cb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for doc_id, _, lang in rows:
        r = out[doc_id]
        assert r["held_out"] == (held(doc_id, 5) == 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == ("und" if doc_id in (90, 91) else "va" if doc_id == 92 else lang)
    assert langid.identify(no_docs).count() == 0
    assert langid.keep(docs).columns == docs.columns and langid.keep(docs).count() == len(rows) - 2


def test_language_rejects_gibberish(spark):
    """Random letters and an unlearnt language go, clean documents of the learnt ones stay."""
    rng = np.random.default_rng(12)
    common = {"en": "the of and to in is that for it with as was on be at by this have from or had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split(), "fi": "ja on ei se että oli hän joka mutta kun niin myös ovat kuin sen mitä tämä jos olla vain vielä minä nyt sitten kaikki hänen jälkeen ennen yli kanssa mukaan paljon hyvin täällä siellä yksi kaksi kolme vuotta päivä työ ihminen koulu yhtään mikään tänään huomenna eilen äiti isä lapsi talo metsä järvi".split()}

    def text(lang, n):
        return " ".join(rng.choice(common[lang], n))

    clean = [(i, text("en", 40 + i), "en") for i in range(100)]
    noise = [(200 + i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(60 + i)), None) for i in range(10)]
    other = [(300 + i, text("fi", 60 + i), None) for i in range(10)]
    kept = langid.keep(spark.createDataFrame(clean + noise + other, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"] for r in kept} == {i for i, *_ in clean}


def test_letters_of_all_planes():
    assert len(langid.letters("\U00030000" * 5)) == 7
    rows = [chr(c) for c in (0x41, 0x3A3, 0x4E00, 0x1F600, 0x20000, 0x31350, 0x10FFFF)]
    assert [len(langid.letters(ch)) > 0 for ch in rows] == [ch.isalpha() for ch in rows]


def test_nearest_profile_equals_brute_force():
    rng = np.random.default_rng(9)
    texts = {k: " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(300)) for k, letters in (("x", "abcde"), ("y", "defgh"), ("z", "ghijkl"))}

    def counted(text):
        folded = " " + " ".join(re.findall("[a-z]+", text.lower())) + " "
        found = collections.Counter(folded[i : i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1) if folded[i : i + n].strip())
        number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return sorted(found, key=lambda g: (-found[g], number(g)))[: langid.PROFILE]

    profiles = {k: counted(t) for k, t in texts.items()}
    made = langid.Profiles({k: langid.ranked(*langid.grams(t)) for k, t in texts.items()})
    for text in ("abc abd!", "Geh heg fed", "zzz", "a", "kjl " * 500, texts["y"][:100]):
        own = counted(text)
        distance = {k: sum(abs(p.index(g) - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(distance), key=distance.get)
        assert made.nearest(text) == (best, pytest.approx(1 - distance[best] / (langid.PROFILE * len(own))))


def test_grams_and_ranks():
    gram, count = langid.grams("Ab, ab!")
    shown = {"".join(chr((int(g) >> 21 * k) & 0x1FFFFF) for k in range(2, -1, -1)).strip("\0"): int(n) for g, n in zip(gram, count, strict=True)}
    assert shown == {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2, "b a": 1}
    many = np.arange(5000)
    counts = many % 7 + 1
    want = sorted(many, key=lambda g: (-counts[g], g))[:400]
    assert list(langid.ranked(many, counts)) == want


# 5

def lcs(a, b):
    length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            length[i + 1][j + 1] = length[i][j] + 1 if a[i] == b[j] else max(length[i][j + 1], length[i + 1][j])
    return length[-1][-1]


def test_shared_is_a_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 9))] for _ in range(2))
        same = sorted(html_text.shared(a, b))
        assert len(same) == lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in same)


def test_long_pages_have_a_longest_common_subsequence(monkeypatch):
    """With every limit in the way, and with repeated lines between pages of over 2,000 lines."""
    rng = np.random.default_rng(14)
    for bits in (10**6, 6):
        monkeypatch.setattr(html_text, "TABLE_BITS", bits)
        for _ in range(200):
            a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(2))
            same = sorted(html_text.shared(a, b))
            assert len(same) == lcs(a, b)
            rest = iter(b)
            assert all(a[i] in rest for i in same)
    monkeypatch.undo()
    a, b = (["start " + k] + [f"line {i // 2}" for i in range(3000)] + ["end " + k] for k in "ab")
    assert len(html_text.shared(a, b)) == 3000


def test_lines():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><!-- x --><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>one<br>two<p><b>th</b>ree  four<div class=\"comments\">no</div></article><footer>f</footer><script>var a='<p>x</p>';</script></body></html>"
    assert html_text.main_text(html_text.lines(page), None) == "A & B\none two\nthree four"
    page = "<body class='has-sidebar'><div class='with-comments'><header>Site</header><main><article><header class='post-header'><h1>T</h1></header><p>x</p><aside>a</aside><form><p>f</p></form></article><section id='comments'><p>c</p></section></main><div class='sidebar left'>s</div></div>"
    assert html_text.main_text(html_text.lines(page), None) == "T\nx"
    assert html_text.lines(None) == [] and html_text.lines("") == []
    assert html_text.main_text(html_text.lines("<p>menu</p><p>own</p><p>foot</p>"), html_text.lines("<p>menu</p><p>other</p><p>foot</p>")) == "own"


def test_words_of_classes_inside_an_article():
    """Only whole names of what holds no main text count; formulas and empty comments are read over."""
    page = "<article><h1>T</h1><div class='market-share'>a</div><p class='social-history'>b</p><section id='reply-to-critics'>c</section><div class='ad-banner'>x</div><div id='main-comments'>x</div><ul class='share-buttons'><li>x</li></ul><p>x is <math><mi>y</mi><annotation encoding='tex'>Y</annotation></math> so</p><!--><p>d</p><!---><p>e</p><!-- x --></article>"
    assert html_text.main_text(html_text.lines(page), None) == "T\na\nb\nc\nx is y so\nd\ne"


def test_difference_decides_beside_an_article():
    """The body in plain divs stays beside an article zone, what the partner shares of it goes."""
    def page(k):
        return html_text.lines(f"<div>menu</div><article>teaser {k}</article><div>body {k}</div><div>foot</div>")

    assert html_text.main_text(page(1), page(2)) == "teaser 1\nbody 1"


def plain_text(own, partner):
    """Lines of pages of <p> alone that are left when one longest common subsequence is taken out, by a table of lengths."""
    n, m = len(own), len(partner)
    length = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if own[i] == partner[j] else max(length[i + 1][j], length[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if own[i] == partner[j]:
            i, j = i + 1, j + 1
        elif length[i + 1][j] >= length[i][j + 1]:
            out.append(own[i])
            i += 1
        else:
            j += 1
    return out + own[i:]


def test_extract_pairs_nearest_urls(spark):
    """Against a brute-force version over lists of lines, on pages without any zone; repeated rows and copies too."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        own = ["menu " + str(rng.integers(0, 2)), f"own {i}" if rng.random() < 0.8 else "copy", str(rng.choice(list("xyz"))), "foot"]
        rows.append((i if i != 7 else None, f"http://h{rng.choice(list('aab'))}.org/{rng.choice(['p', 'pq', 'r/s'])}/{rng.integers(0, 30)}", own))
    rows += [(500, None, None), (501, "http://solo.org/", ["alone"]), rows[3], rows[3]]
    given = [(i, u, None if own is None else "".join(f"<p>{x}</p>" for x in own), "x") for i, u, own in rows]
    out = html_text.extract(spark.createDataFrame(given, "page_id long, url string, html string, text string").repartition(5)).collect()

    def key(r):
        host, path = ("", "") if r[1] is None else re.match(r"https?://([^/]*)(/.*)?", r[1]).groups()
        return host, path or "", -(1 << 63) if r[0] is None else r[0], r[1] or "", r[2] or []

    def common_start(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    ordered = sorted(rows, key=key)
    want = []
    changed = 0
    for k, r in enumerate(ordered):
        own, host = r[2] or [], key(r)[0]
        mine = [j for j in range(len(ordered)) if key(ordered[j])[0] == host]
        before = [j for j in mine if j < k and (ordered[j][2] or []) != own]
        after = [j for j in mine if j > k and (ordered[j][2] or []) != own]
        partner = None
        if before:
            partner = before[-1]
            if k + 1 in after and common_start(key(r)[1], key(ordered[k + 1])[1]) > common_start(key(r)[1], key(ordered[partner])[1]):
                partner = k + 1
        elif after:
            partner = after[0]
        text = "\n".join(plain_text(own, ordered[partner][2] or []) if partner is not None else own)
        changed += text != "\n".join(own)
        want.append((r[0], r[1], len(text)))
        if len(own) < 4:
            assert text == "\n".join(own)
    got = [(r["page_id"], r["url"], r["n_chars"]) for r in out]
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert changed > 150  # here the difference decides
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_markup_is_read_in_one_pass():
    import time

    for page in ("<a " * 350_000, "<a '\">" * 150_000, '<p title="' * 100_000, "<!--" * 250_000, "<script>" * 120_000, "<" * 1_000_000, "<div>" * 100_000 + "</x>" * 100_000, "</p " * 250_000 + ">"):
        began = time.perf_counter()
        html_text.lines(page)
        assert time.perf_counter() - began < 3
    assert html_text.lines("<p>a<b title='x>y'>b</b> 1 < 2 <p title=it's>c <i") == [("other", "ab 1 < 2"), ("other", "c <i")]


def test_ids_of_64_bits_beside_nulls(spark):
    rows = [(9007199254740993, "http://a.org/1", "<p>x</p>"), (None, "http://a.org/2", "<p>y</p>"), (-(1 << 63), "http://a.org/3", "<p>z</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert {r["page_id"] for r in html_text.extract(pages).collect()} == {i for i, *_ in rows}
    together = warc.derive(warc.responses(pages)).collect()
    assert {r["key"] for r in together} == {i for i, *_ in rows}
    alone = warc.derive(warc.responses(pages.where("page_id > 0"))).collect()
    assert {r["record_id"] for r in alone} <= {r["record_id"] for r in together}


def test_copies_are_no_partners(spark):
    """Copies in a row, at a host's start, in its midst and over many ranges, keep their text."""
    def page(own):
        return f"<div>menu</div><p>{own}</p><div>foot</div>"

    rows = [(i, f"http://a.org/{i:03}", page("first")) for i in range(40)] + [(100 + i, f"http://a.org/{100 + i}", page(f"own {i}")) for i in range(3)]
    rows += [(200 + i, f"http://a.org/{200 + i}", page("midst")) for i in range(80)] + [(300, "http://a.org/300", page("end")), (300, "http://a.org/300", page("end"))]
    rows += [(400, "http://b.org/", "<p>only</p>"), (401, "http://b.org/x", "<p>only</p>")]
    got = sorted(tuple(r)[:3] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).select("page_id", "url", "text").collect())
    assert got == sorted((i, u, re.search("<p>(.*)</p>", h)[1]) for i, u, h in rows)


# 6

def test_decontamination(spark, docs, no_docs):
    items = [(1, prose(1000, 30)), (2, prose(1001, 12)), (3, "three words only"), (4, None), (5, " ?! "), (6, prose(1000, 30))]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    words = prose(1000, 30).split()
    near = " ".join(words[:28] + ["changed", *words[29:]])
    far = " ".join(w if i % 4 else "changed" for i, w in enumerate(words))
    texts = [(100, prose(1) + " " + prose(1000, 30).upper() + ", " + prose(2)), (101, prose(3) + "\n" + near), (102, prose(4) + " " + far), (103, "so Three words: only!"), (104, prose(1001, 12)), (105, prose(1001, 11))]
    given = spark.createDataFrame(texts, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    found = collections.defaultdict(set)
    for r in decontaminate.find(given, benchmark).collect():
        found[r["doc_id"]].add(r["item_id"])
        assert r["similarity"] >= 0.8
    assert dict(found) == {100: {1, 6}, 101: {1, 6}, 103: {3}, 104: {2}, 105: {2}}
    assert {r["doc_id"] for r in given.select("doc_id").subtract(decontaminate.keep(given, benchmark).select("doc_id")).collect()} == set(found)
    assert decontaminate.find(no_docs, benchmark).count() == 0 and decontaminate.find(given, benchmark.limit(0)).count() == 0
    assert decontaminate.keep(docs, benchmark).columns == docs.columns


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(4)
    index = decontaminate.Benchmark([(i, prose(i, 20)) for i in range(50)])
    members, blocks, *_ = index.index[20]
    windows = []
    for k in range(400):
        bits = np.unpackbits(blocks[k % 50], bitorder="little")
        flip = rng.choice(128, rng.integers(0, 45), replace=False)
        bits[flip] ^= 1
        windows.append(np.packbits(bits, bitorder="little"))
    windows = np.stack(windows)
    want = {(w, m) for w in range(400) for m in range(50) if np.bitwise_count(windows[w] ^ blocks[m]).sum() <= decontaminate.WITHIN}
    assert {(w, list(members).index(m)) for w, m in index.candidates(20, windows)} == want


def test_windows_found_against_all_windows():
    """Items planted with replaced, cut and added words: every item whose best window reaches 0.8 by brute force is found."""
    rng = np.random.default_rng(11)
    vocabulary = [prose(k, 1) for k in range(400)]

    def some(n):
        return list(rng.choice(vocabulary, n))

    items = [(k, some(int(rng.integers(12, 60)))) for k in range(25)]
    index = decontaminate.Benchmark([(k, " ".join(w)) for k, w in items])
    wanted = missed = wrong = 0
    for _ in range(60):
        words = some(40)
        for k in rng.choice(25, 3, replace=False):
            own = list(items[k][1])
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(0, len(own)))] = "changed"
            words += own[: len(own) - int(rng.integers(0, 4))] + some(int(rng.integers(5, 30)))
        want = {}
        for k, own in items:
            def weighted(w):
                return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

            mine = weighted(own)
            best = 0
            for at in range(max(1, len(words) - len(own) + 1)):
                there = weighted(words[at : at + len(own)])
                best = max(best, (mine & there).total() / (mine | there).total())
            if best >= 0.8:
                want[k] = best
        got = {k: s for k, s, *_ in index.find(" ".join(words))}
        wanted += len(want)
        missed += len(want.keys() - got.keys())
        wrong += len(got.keys() - want.keys())
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got.keys() & want.keys())
    assert wanted > 60 and missed <= 0.01 * wanted and wrong == 0


# 7

def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<html lang='en'><title>T &amp; U</title><body><p>Hello</p><p>wörld</p></body></html>"), (2, None, None), (None, "http://a.org/y", "<p>z</p>")], "page_id long, url string, html string")
    sources = warc.responses(pages)
    out = warc.derive(sources).collect()
    assert len(out) == 6
    by = {(r["key"], r["kind"]): r for r in out}
    assert by[1, "conversion"]["block"] == "T & U\nHello\nwörld" and by[2, "conversion"]["block"] == ""
    meta = by[1, "metadata"]["block"]
    source = dict(next(warc.parse(bytes(next(r["record"] for r in sources.collect() if r["key"] == 1))))[0])
    assert f"source-record-id: {source['WARC-Record-ID']}" in meta and f"source-warc-payload-digest: {source['WARC-Payload-Digest']}" in meta and "title: T & U" in meta and "language: en" in meta
    for r in out:
        (headers, block), = warc.parse(bytes(r["record"]))
        assert warc.get(headers, "WARC-Refers-To") == r["refers_to"] and warc.digest(block) == r["block_digest"] and block.decode() == r["block"]
    import gzip

    raw = b"".join(gzip.compress(bytes(r["record"])) for r in sources.collect())
    (tmp_path / "a.warc.gz").write_bytes(raw)
    again = warc.read(spark, str(tmp_path)).select(F.lit(0).alias("key"), "record")
    assert sorted(r["record_id"] for r in warc.derive(again).collect()) == sorted(r["record_id"] for r in out)
    broken = spark.createDataFrame([(1, b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort"), (2, None), (3, b"")], "key long, record binary")
    assert warc.derive(broken).count() == 0
    good = [bytes(r["record"]) for r in sources.collect()]
    for bad in (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\nshort\r\n\r\n", b"WARC/1.1\r\nno length\r\n\r\nx\r\n\r\n", b"noise\r\n", b""):
        whole = [b for _, b in warc.parse(b"".join([good[0], bad, good[1], bad, good[2]]))]
        assert whole == [b for g in good for _, b in warc.parse(g)]
        assert [b for _, b in warc.parse(gzip.compress(good[0] + bad) + gzip.compress(bad + good[1] + good[2]))] == whole
    members = [gzip.compress(g) for g in good]
    torn = members[0] + members[1][: len(members[1]) // 2] + members[2]
    assert [b for _, b in warc.parse(torn)][0] == whole[0] and [b for _, b in warc.parse(torn)][-1] == whole[2]
    large = warc.serialise([("WARC-Type", "response"), ("X", "1"), ("X", "2")], b"a" * 5_000_000)
    assert [(h[1:3], len(b)) for h, b in warc.parse(gzip.compress(good[0] + large + good[1]))][1] == ([("X", "1"), ("X", "2")], 5_000_000)
    assert warc.derive(sources.limit(0)).count() == 0
    chunked = warc.http(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n3;x=1\r\n wo\r\n0\r\n\r\n")
    assert chunked[2] == b"hello wo"


# 8

def independent_records(raw):
    """WARC records of bytes by a reader of its own: version, named fields, block by its length, two line ends."""
    out = []
    while raw:
        head, raw = raw.split(b"\r\n\r\n", 1)
        version, *fields = head.decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(f.split(": ", 1) for f in fields)
        n = int(fields["Content-Length"])
        out.append((fields, raw[:n]))
        assert raw[n : n + 4] == b"\r\n\r\n"
        raw = raw[n + 4 :]
    return out


def test_warc_records_by_another_reader(spark):
    import base64
    import hashlib
    import zlib

    def sha1(block):
        return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()

    pages = [(1, "http://a.example/1", "<html><body><article><p>one &amp; two</p></article></body></html>"), (2, "http://a.example/2", "<p>é</p>"), (3, None, None)]
    made = warc.derive(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    assert len(made) == 6
    for r in made:
        ((fields, block),) = independent_records(bytes(r["record"]))
        assert fields["WARC-Type"] == r["kind"] and fields["WARC-Record-ID"] == r["record_id"] and fields["WARC-Refers-To"] == r["refers_to"]
        assert fields.get("WARC-Target-URI") == r["target_uri"] and block.decode() == r["block"] and len(block) == r["n_bytes"]
        assert fields["WARC-Block-Digest"] == r["block_digest"] and (not r["block_digest"].startswith("sha1:") or r["block_digest"] == sha1(block))
    assert {r["refers_to"] for r in made if r["kind"] == "metadata"} == {r["refers_to"] for r in made if r["kind"] == "conversion"}

    packed = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = packed.compress(b"plain words") + packed.flush()
    for kind, body in (("text/plain; charset=undefined", b"plain words"), ("text/plain; charset=idna", b"plain words"), ("text/plain; charset=rot13", b"plain words"), ("text/plain; charset=no-such", b"plain words"), ("text/plain\r\nContent-Encoding: deflate", raw), ("text/plain\r\nContent-Encoding: deflate", zlib.compress(b"plain words"))):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\n".encode() + body
        derived = warc.derivatives([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], block)
        assert derived[1][2] == b"plain words"


def test_license_base_equals_brute_force(docs, no_docs, spark):
    more = spark.createDataFrame([(200, "MIT license, mit-license. Apache License; GENERAL public\nlicense general public licenses"), (201, "mit mit license license apache"), (202, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction")], "doc_id long, text string")
    given = docs.select("doc_id", "text").unionByName(more)
    for text, row in paired(given, license.scan(given)):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        places = [(i, label) for phrase, label in license.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
        assert (row["n_words"], row["n_base"]) == (len(words), len(places))
        assert (row["first_word"], row["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert row["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1
        assert ("mit-text" in row["labels"]) == (row["doc_id"] == 202)
    assert license.scan(no_docs).count() == 0


def test_license_passages_with_changed_words():
    """A passage is found with its rarest words replaced while MATCH of its weight is left, and with a word put in."""
    index = license.Index()
    for k, (label, template, keys, exact) in enumerate(index.templates):
        if exact:
            continue
        words = [w.decode() for w in template]
        held = {w.decode() for key in keys for w in key}
        for at in range(1, len(words)):
            if not any(words[at - 1] in held and words[at] in held for _ in (0,)):
                assert label in license.findings(index, " ".join(["some", *words[:at], "inserted", *words[at:], "words"]))[5].split(",")
        order = sorted((w for w in set(words) if w not in held), key=lambda w: -index.idf[w.encode()])
        left = index.weight[k]
        changed = list(words)
        for w in order:
            if left - index.idf[w.encode()] * words.count(w) >= license.MATCH * index.weight[k]:
                left -= index.idf[w.encode()] * words.count(w)
                changed = ["else" if x == w else x for x in changed]
        assert label in license.findings(index, " ".join(["before", *changed, "after"]))[5].split(",")
    assert license.findings(index, "the of software license and this is any under " * 2000)[5] == ""


# 9

def brute_fingerprint(text):
    words = WORD.findall(lowered(text))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(ids, prints):
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                label[find(i)] = find(j)
    least = collections.defaultdict(lambda: 1 << 62)
    for i, x in enumerate(ids):
        least[find(i)] = min(least[find(i)], x)
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprints_and_classes(docs, no_docs):
    rows = simhash.classes(docs).collect()
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r["doc_id"]].add(brute_fingerprint(r["text"]))
    assert all({r["fp"] & (1 << 64) - 1} == texts[r["doc_id"]] for r in rows)
    known = [r for r in rows if r["doc_id"] is not None]
    assert [r["component_id"] for r in known] == brute_classes([r["doc_id"] for r in known], [r["fp"] & (1 << 64) - 1 for r in known])
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert simhash.classes(no_docs).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert groups.pop(None) is None and all(groups[c] == c <= i for i, c in groups.items())
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(groups.values()))
    assert simhash.similar(no_docs).count() == simhash.keep_one(no_docs).count() == 0


def test_one_row_of_each_group_stays(spark):
    """By row, not by id: an id may stand for several texts, and a row may be repeated."""
    a, b, c = prose(1), prose(2), prose(3)

    def kept(*rows):
        return sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, __id string, __hash int")).collect())

    assert kept((5, a), (5, b), (6, c)) == sorted([(5, a), (5, b), (6, c)])
    assert kept((1, a), (5, a), (5, b)) == sorted([(1, a), (5, b)])
    assert kept((7, a), (7, a), (8, a), (9, b), (9, b)) == sorted([(7, a), (9, b)])


def test_components_of_few_links_take_few_tasks(spark, monkeypatch):
    """As on check_h: many shuffle partitions that Spark doesn't merge. Stars, chains and random links, in one task and in several a step, against a search."""
    rng = np.random.default_rng(12)
    pairs = [(0, i) for i in range(1, 900)] + [(2000 + i, 2001 + i) for i in range(60)] + [tuple(map(int, rng.integers(3000, 3300, 2))) for _ in range(200)]
    label = {x: x for p in pairs for x in p}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in pairs:
        a, b = sorted((find(x), find(y)))
        label[b] = a
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    status = spark.sparkContext.statusTracker()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for part in (20_000, 400):
            monkeypatch.setattr(components, "PART", part, raising=False)
            spark.sparkContext.setJobGroup(group := f"components-{part}", "")
            found = components.components(spark.createDataFrame(pairs, "a long, b long"))
            rows = found.collect()
            assert len(rows) == len(linked) and {r["node"]: r["component"] for r in rows} == {x: find(x) for x in linked}
            stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
            tasks = sum(i.numCompletedTasks for s in stages if (i := status.getStageInfo(s)))
            assert 0 < tasks < 2500, tasks  # with 48 tasks on both sides of each shuffle it takes several times as many
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_with_heavy_nodes(spark, monkeypatch):
    """Against a search, where stars, chains and hot keys are joined by broadcast and by shuffle."""
    rng = np.random.default_rng(8)
    pairs = [(0, i) for i in range(1, 1500)] + [(2000 + i, 2001 + i) for i in range(40)] + [tuple(map(int, rng.integers(3000, 3400, 2))) for _ in range(150)]
    monkeypatch.setattr(components, "most", lambda rows: 20)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in range(2000):
        before = dict(label)
        for x, y in pairs:
            label[x] = label[y] = min(label[x], label[y])
        if before == label:
            break
    loops = {x for x, y in pairs if x == y} - {z for x, y in pairs if x != y for z in (x, y)}
    assert got == {k: v for k, v in label.items() if k not in loops}


def similarity(a, b):
    """Of the sets of five-word shingles."""
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(lowered(t)) for t in (a, b)))
    return len(a & b) / len(a | b)


def test_similar_texts_are_linked(spark):
    """Against all pairs: near copies, also in a large group; other texts of the same vocabulary stay apart."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(800)]
    texts = []
    for family in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(80, 400))))
        texts.append((family, " ".join(words)))
        for _ in range(200 if family == 7 else family % 4):
            copy = list(words)
            for at in rng.choice(len(copy), len(copy) // 100, replace=False):
                copy[at] = str(rng.choice(vocabulary))
            texts.append((family, " ".join(copy)))
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[k][1], "clash") for i, k in enumerate(order)]
    family = {int(i): texts[k][0] for i, k in enumerate(order)}
    frame = spark.createDataFrame(rows, "doc_id long, text string, w0 string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(frame).collect()}
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if family[i] == family[j] != 7 or (i + j) % 9 == 0]
    close = [(i, j) for i, j in pairs if similarity(rows[i][1], rows[j][1]) >= 0.8]
    assert len(close) > 1000 and sum(got[i] == got[j] for i, j in close) >= 0.99 * len(close)
    assert all(family[i] == family[c] for i, c in got.items())
    assert {r["doc_id"] for r in simhash.keep_one(frame).collect()} == set(got.values())


def test_copies_that_differ_in_a_passage_are_linked(spark):
    """Truncated and appended copies, texts of few shingles and a passage repeated many times, against all pairs."""
    rng = np.random.default_rng(13)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(3000)]

    def some(n):
        return [str(w) for w in rng.choice(vocabulary, n)]

    texts = []
    for _ in range(100):
        words = some(int(rng.integers(60, 400)))
        n = len(words)
        texts += [words, words[: int(n * 0.85)], words[n // 6 :], words + some(n // 6), some(n // 6) + words]
        texts.append(words + words[-12:] * 40)
        short = some(9)
        texts += [short, short[:8]]
    texts = [" ".join(t) for t in texts]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(frame).collect()}
    close = [(i, j) for i in range(len(texts)) for j in range(i - i % 8, i) if similarity(texts[i], texts[j]) >= 0.8]
    assert len(close) >= 500 and all(got[i] == got[j] for i, j in close)
    assert all(i // 8 == c // 8 for i, c in got.items())


def test_groups_have_the_links_of_fingerprints_and_of_similarity(spark):
    """Against all pairs: what the fingerprints link at 4 bits, by the anchors, is linked at any similarity; so are texts of 0.8."""
    rng = np.random.default_rng(21)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(3000)]

    def some(n):
        return [str(w) for w in rng.choice(vocabulary, n)]

    texts = []
    for family in range(12):
        passage = some(11)
        texts += [passage * 14 + some(40 + 12 * k) for k in range(3)]  # a repeated passage rules the fingerprint, not the set
        words = some(200)
        texts += [words, words[:170], words[:100] + some(1) + words[101:], some(150)]
    texts = [" ".join(t) for t in texts]
    prints = [brute_fingerprint(t) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    by_print = unlike = 0
    for i in range(len(texts)):
        for j in range(i):
            near, alike = bin(prints[i] ^ prints[j]).count("1") <= 4, similarity(texts[i], texts[j]) >= 0.8
            unlike += near and not alike and prints[i] != prints[j]
            by_print += near and not alike
            if near or alike:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    assert by_print > unlike > 0
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(frame).collect()} == {i: find(i) for i in range(len(texts))}
    assert {r["doc_id"] for r in simhash.keep_one(frame).collect()} == {find(i) for i in range(len(texts))}
    classes = collections.Counter(r["component_id"] for r in simhash.classes(frame).collect())
    assert len(classes) >= len({find(i) for i in range(len(texts))})


def test_links_connect_all_within_radius(spark):
    """Chains and dense groups of near fingerprints, among random ones."""
    rng = np.random.default_rng(9)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    for _ in range(6):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(40):  # a chain
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            prints.append(x)
    centre = int(rng.integers(0, 1 << 63))
    prints += [centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(400)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)).collect()
    index = {p: i for i, p in enumerate(signed)}
    label = list(range(len(signed)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in found:
        label[find(index[a])] = find(index[b])
    want = brute_classes(list(range(len(prints))), prints)
    groups = collections.defaultdict(set)
    for i, w in enumerate(want):
        groups[w].add(find(i))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[102] == got[101] == got[100] == 100 and all(got[201 + i] == 200 for i in range(30))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10

def test_pitman_yor(docs, no_docs):
    rows = paired(docs, pitman_yor.scores(docs, bucket_tokens=500))
    counts = collections.Counter()
    tokens = lambda t: WORD.findall(lowered(t)) + [b""]
    for text, row in rows:
        assert row["held_out"] == (held(row["doc_id"], 7) == 2)
        if not row["held_out"]:
            counts.update(tokens(text))
    total, different = sum(counts.values()), len(counts)
    for text, row in rows:
        own = tokens(text)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + different + 1)) for w in own), rel=1e-9)
        assert row["score"] < 0
    trained = [r for _, r in rows if not r["held_out"]]
    assert sum(r["score"] for r in trained) > sum(r["base_score"] for r in trained)
    assert pitman_yor.scores(no_docs).count() == 0


def seatings(c):
    """Numbers of seatings of c customers at t tables, discount 1/2, by the recursion of generalised Stirling numbers."""
    row = [0.0, 1.0]
    for n in range(1, c):
        row = [0.0] + [row[t - 1] + ((n - t / 2) * row[t] if t <= n else 0) for t in range(1, n + 2)]
    return row


def table_weights(c, x, p):
    """Of t = 1, 2, ..., c: seatings times the weight of each new table beside those of other dishes."""
    return [seatings(c)[t] * math.prod(0.5 * (x + i) * p for i in range(t)) for t in range(1, c + 1)]


def test_tables_are_drawn_from_the_conditional():
    rng = np.random.default_rng(0)
    for c, x, p in ((2, 3.0, 0.1), (3, 2.0, 0.9), (7, 40.0, 0.02), (30, 500.0, 0.01), (60, 2.0, 1e-6)):
        weights = np.array(table_weights(c, x, p))
        upto = np.cumsum(weights) / weights.sum()
        u = rng.random(2000)
        got = pitman_yor.draw_tables(np.full(2000, c), np.full(2000, x), np.full(2000, p), u)
        want = 1 + (u[:, None] >= upto).sum(1)
        assert (got != want).sum() <= 1  # a number at an edge may fall to either side
    # A dish of a million customers: by the same rule, the edges of its window don't count.
    c, x, p = 10**6, 3000.0, 0.3
    t = np.arange(1, c)
    log = np.concatenate(([0.0], np.cumsum(np.log(2 * p * (c - t) * (x + t) / (t * (2 * c - t - 1))))))
    upto = np.cumsum(np.exp(log - log.max()))
    u = rng.random(50)
    got = pitman_yor.draw_tables(np.full(50, c), np.full(50, x), np.full(50, p), u)
    assert np.abs(got - (1 + (u[:, None] * upto[-1] >= upto).sum(1))).max() <= 1
    assert list(pitman_yor.draw_tables(np.array([0, 1]), np.ones(2), np.ones(2), np.zeros(2))) == [0, 1]


def brute_scores(rows):
    """The model of (doc_id, text) over dictionaries: log10 probability of each text, and whether each leaf's sum is one."""
    leaf = lambda w: pitman_yor.code_of(w) >> 48
    above = lambda r: r >> 8
    texts = [(held(i, 7) != 2, WORD.findall(lowered(t)) + [b""]) for i, t in rows]
    count = collections.Counter()
    for trained, own in texts:
        for before, w in zip([b"", *own], own):
            count[leaf(before), w] += trained
    count = +count
    vocabulary = {w for _, w in count}
    base = 1 / (len(vocabulary) + 1)
    t = [{k: 1 for k in count}, {(above(r), w): 1 for r, w in count}, {w: 1 for w in vocabulary}]
    uniform = lambda w, r, level, sweep: float(pitman_yor.uniform(np.array([pitman_yor.code_of(w)], np.uint64), r, level, sweep)[0])

    def customers():
        c1, c2 = collections.Counter(), collections.Counter()
        for (r, w), n in t[0].items():
            c1[above(r), w] += n
        for (_, w), n in t[1].items():
            c2[w] += n
        return [count, c1, c2]

    def sums(values):
        out = collections.Counter()
        for (r, _), n in values.items():
            out[r] += n
        return out

    def model():
        c = customers()
        t0, t1, t2 = sums(t[0]), sums(t[1]), sum(t[2].values())
        c0, c1, c2 = sums(c[0]), sums(c[1]), sum(c[2].values())
        frozen = [dict(x) for x in t]

        def root(w):
            return (c[2][w] - 0.5 * frozen[2].get(w, 0) + (1 + 0.5 * t2) * base) / (1 + c2)

        def middle(r, w):
            return (c[1][r, w] - 0.5 * frozen[1].get((r, w), 0) + (1 + 0.5 * t1[r]) * root(w)) / (1 + c1[r])

        def lowest(r, w):
            return (c[0][r, w] - 0.5 * frozen[0].get((r, w), 0) + (1 + 0.5 * t0[r]) * middle(above(r), w)) / (1 + c0[r])

        return root, middle, lowest, (t0, t1, t2)

    def drawn(c, x, p, u):
        weights = np.cumsum(table_weights(c, x, p))
        return 1 + int((u * weights[-1] >= weights).sum())

    found = []
    for sweep in range(pitman_yor.SWEEPS + 1):
        root, middle, lowest, (t0, t1, t2) = model()
        if sweep > pitman_yor.SWEEPS - pitman_yor.SAMPLES:
            found.append(lowest)
            for r in {r for r, _ in count} | {77}:
                assert sum(lowest(r, w) for w in vocabulary) + lowest(r, b"no word of these") == pytest.approx(1)
        if sweep < pitman_yor.SWEEPS:
            t[0] = {(r, w): drawn(n, 2 + t0[r] - t[0][r, w], middle(above(r), w), uniform(w, r, 0, sweep + 1)) for (r, w), n in count.items()}
            t[1] = {(r, w): drawn(n, 2 + t1[r] - t[1][r, w], root(w), uniform(w, r, 1, sweep + 1)) for (r, w), n in customers()[1].items()}
            t[2] = {w: drawn(n, 2 + t2 - t[2][w], base, uniform(w, 0, 2, sweep + 1)) for w, n in customers()[2].items()}
    return [sum(math.log10(sum(p(leaf(b), w) for p in found) / len(found)) for b, w in zip([b"", *own], own)) for _, own in texts]


def test_scores_equal_brute_force(spark, monkeypatch):
    """In one bucket or many, in one chunk or many, with repeated rows, ties, null ids and words of one suffix."""
    rng = np.random.default_rng(21)
    vocabulary = [a + b for a in "abcdefg" for b in ("ing", "s", "tion", "")]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60)), p=np.arange(1, 29) / 406))) for i in range(60)]
    rows += [(5, rows[5][1]), (None, "aing bing"), (61, None), (62, ""), (63, "never seen words")]
    want = sorted(zip([-1 if i is None else i for i, _ in rows], brute_scores(rows)))
    frame = spark.createDataFrame([(*r, 3.0) for r in rows], "doc_id long, text string, score double")
    for size, chunk, parts in ((10**6, 10**6, 1), (20, 50, 3)):
        monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", chunk)
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in pitman_yor.scores(frame.repartition(parts), size).collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-5)


def test_probabilities_without_training_are_uniform(spark):
    """All texts held out: every token has the probability of one word out of one."""
    ids = [i for i in range(200) if held(i, 7) == 2][:5]
    out = pitman_yor.scores(spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")).collect()
    assert len(out) == 5 and all((r["score"], r["base_score"], r["n_known"], r["train_tokens"]) == (0, 0, 0, 0) for r in out)


# pipeline

def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(500)]

    def text(n=120):
        return " ".join(rng.choice(vocabulary, n))

    item = " ".join(rng.choice(vocabulary, 30))
    rows = [(i, text(), "en", "s", 1) for i in range(80)]
    rows += [(100 + i, " ".join(w + "%%%" for w in text().split()), "en", "s", 1) for i in range(80)]
    rows += [(300, rows[3][1], "en", "s", 1), (301, text() + " " + item + " " + text(), "en", "s", 1), (302, None, "en", "s", 1), (303, "123 456", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(80)] + [(100 + i, 0) for i in range(80)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(80))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_near_duplicate_classes_are_exact(spark):
    """Copies of every degree: classes are connected by pairs of similarity 0.8 or more, in one chunk as in many."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(900)]
    texts = []
    for family in range(24):
        words = list(rng.choice(vocabulary, int(rng.integers(60, 200))))
        for k in range(60 if family < 2 else 8):
            copy = list(words)
            for at in rng.choice(len(copy), len(copy) * (k % 8) // 100, replace=False):
                copy[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    whole, cut = ({r["doc_id"]: r["component_id"] for r in simhash.similar(frame, chunk).collect()} for chunk in (10**6, 900))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    close = []
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                close.append((i, j))
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert all(label[i] == label[c] for i, c in whole.items())
    assert sum(whole[i] == whole[j] for i, j in close) >= 0.99 * len(close)
    assert whole == cut
    assert len(set(label)) > 30


def test_candidates_of_every_length():
    """Pairs of similarity 0.8 or more, with words replaced, cut at either end, put in or added, share a key and lie within the radius."""
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(5000)]
    pairs = missed = 0
    for n in (5, 8, 9, 10, 12, 16, 20, 30, 60, 200):
        for _ in range(120):
            words, at, few = list(rng.choice(vocabulary, n)), int(rng.integers(0, n)), int(rng.integers(1, n // 5 + 2))
            more = list(rng.choice(vocabulary, few))
            for changed in (words[:at] + ["changed"] + words[at + 1 :], words[few:], words[:-few], words + more, words[:at] + more[:1] + words[at:]):
                a, b = " ".join(words), " ".join(changed)
                if similarity(a, b) < 0.8:
                    continue
                a, b = simhash.signature(a), simhash.signature(b)
                pairs += 1
                missed += not (np.isin(a[3], b[3]).any() and simhash._alike(a[2][None, :], b[2])[0])
    assert pairs > 2000 and missed <= 0.001 * pairs
