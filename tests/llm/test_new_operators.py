"""Phrases, centroids and mixes: brute force on small tables, defined results, other layouts."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tracksmith.llm import centroids, collocations, common, mixing, quality

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_of(rows, least, longest, top, share=50):
    """The contract, word by word."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for at in range(len(words) - k + 1):
                    f[lang][tuple(words[at : at + k])] += 1
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        explained = defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for at in range(len(p) - k + 1):
                    explained[p[at : at + k]] = max(explained[p[at : at + k]], a)
        found = []
        for p, a in candidates.items():
            if explained[p] and 100 * explained[p] >= share * a:
                continue
            cuts = [(1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, rank, phrase.decode(), -a, l, r, n[lang], -s) for rank, (s, a, phrase, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def some_texts(seed, n=60, words=40):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["Über", "naïve", "日本", "x.y", "a\x0bb", "don't"]
    out = []
    for k in range(n):
        text = "".join(draw.choice(vocabulary) + draw.choice([" ", " ", " ", "\t", ", ", "! ", "\n", "  "]) for _ in range(draw.randrange(words)))
        out.append((draw.choice(["en", "de", None]), None if k % 17 == 0 else text))
    return out


@pytest.mark.parametrize(("longest", "chunk", "bucket"), [(3, 1_000_000, 1_000_000), (3, 50, 20), (4, 200, 10), (2, 90, 1_000)])
def test_phrases_equal_brute_force_in_any_layout(spark, longest, chunk, bucket):
    rows = some_texts(longest * 7 + chunk)
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    found = collocations.collocations(docs, least=3, longest=longest, top=50, chunk_tokens=chunk, bucket_tokens=bucket).collect()
    assert sorted(map(tuple, found)) == phrases_of(rows, 3, longest, 50)


def test_phrases_far_apart_in_a_chunk(spark):
    """Gaps of over 16 bits, and scores whose products pass 64 bits."""
    filler = " ".join(f"v{k}" for k in range(90_000))
    docs = spark.createDataFrame([(1, f"red fox {filler} red fox", "en"), (2, "red fox " * 4, "en")], "doc_id long, text string, lang string").coalesce(1)
    found = [tuple(r) for r in collocations.collocations(docs, least=3).collect()]
    assert found == phrases_of([("en", f"red fox {filler} red fox"), ("en", "red fox " * 4)], 3, 3, 2000)


def test_phrases_of_the_edge_table(docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == phrases_of(rows, 10, 3, 2000)
    assert collocations.collocations(no_docs).collect() == []
    assert collocations.collocations(docs.where("text is null")).collect() == []


def clusters_of(rows, clusters=8, rounds=10):
    """The contract in Python's integers."""
    floor = lambda x: int(Fraction(x) * 1024 // 1)
    kept = [(i, [floor(x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and abs(x) < float("inf") for x in v)]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:clusters]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), k) for k, x in enumerate(c))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        c = [[sum(col) // len(members[k]) for col in zip(*members[k], strict=True)] if members[k] else c[k] for k in range(len(c))]
    last = [(i, *near(v)) for i, v in kept]
    total = Counter()
    for _, d, k in last:
        total[k] += d
    fits = lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, k, fits(d), fits(total[k]), fits(sum(total.values())), digest[k]) for i, d, k in last), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def test_centroids_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 7)
    draw = random.Random(5)
    rows = [(k, [draw.gauss(k % 5, 1) for _ in range(64)]) for k in range(90)]
    rows += [(None, [0.5] * 64), (3, [0.25] * 64), (3, [0.25] * 64), (91, None), (92, [1.0] * 63), (93, [None] + [1.0] * 63), (94, [float("nan")] + [1.0] * 63), (95, [float("-inf")] + [1.0] * 63), (96, [-0.0009765625] * 64), (97, [1e-300] * 64)]
    found, _ = centroids.cluster(vectors(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == clusters_of(rows)


@pytest.mark.parametrize("size", [5_000.0, 3e7, 1e18, 1.7e308])
def test_centroids_of_large_vectors(spark, size):
    """Beyond the product's bound, beyond 64 bits, and beyond the floats when multiplied."""
    draw = random.Random(7)
    rows = [(k, [draw.gauss(0, 1) + (size if k % 9 == 0 else 0) for _ in range(64)]) for k in range(40)]
    found, _ = centroids.cluster(vectors(spark, rows), rounds=3)
    assert sorted(map(tuple, found.collect()), key=repr) == clusters_of(rows, rounds=3)


def test_centroids_of_few_and_of_equal_vectors(spark):
    assert centroids.cluster(vectors(spark, []))[0].collect() == []
    rows = [(k, [1.0] * 64) for k in range(12)]  # ties go to centroid 0, the others stay empty
    assert sorted(map(tuple, centroids.cluster(vectors(spark, rows))[0].collect()), key=repr) == clusters_of(rows)
    assert len({r["cluster"] for r in centroids.cluster(vectors(spark, [(1, [0.0] * 64), (2, [9.0] * 64)]))[0].collect()}) == 2


def test_product_is_exact_at_its_bound():
    import numpy as np

    most = centroids.safe(64)
    draw = np.random.default_rng(3)
    x = draw.integers(-most, most, (50, 64), endpoint=True).astype(np.int32)
    c = draw.integers(-most, most, (8, 64), endpoint=True).tolist()
    x[0], c[3] = most, [-most] * 64
    found, exact, distance = centroids.nearest(x, {}, c)
    assert not exact
    assert [(int(d), int(k)) for d, k in zip(distance, found, strict=True)] == [centroids.exact_nearest(v, c) for v in x.tolist()]


def mix_of(rows):
    """The contract: targets by sharing the excess until none is above; takes by sorting hashes."""
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    own = Counter()
    for _, t, s in rows:
        own[s] += size(t)
    order = sorted((s for s in own if s is not None), key=lambda s: s.encode()) + [None] * (None in own)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = sum(own.values()) - sum(3 * own[s] for s in full)
        w = sum(weight[s] for s in own if s not in full)
        target = {s: 3.0 * own[s] if s in full else rest * weight[s] / w for s in own}
        over = {s for s in own if s not in full and target[s] > 3 * own[s]}
        if not over:
            return own, target
        full |= over


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def mixed_rows(seed, n=1500):
    draw = random.Random(seed)
    names = ["a", "b", "c", "é", "z", None, "empty", "zz"]
    rows = []
    for k in range(n):
        source = names[min(draw.randrange(16), 7)] if seed % 2 else names[draw.randrange(8)]
        rows.append((k, None if source == "empty" else " ".join(["w"] * draw.randrange(60)), source))
    return [*rows, rows[0], rows[0], (None, "null id", "a"), (None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, seed):
    rows = mixed_rows(seed)
    own, target = mix_of(rows)
    found = mixing.mix(docs_of(spark, rows)).collect()
    assert len(found) == len(rows)
    of = {k: s for k, _, s in rows if k is not None}
    taken, largest = Counter(), defaultdict(int)
    for r in found:
        source = of.get(r["doc_id"], "a" if r["size"] else None)
        assert r["source_size"] == own[source]
        assert r["target"] == pytest.approx(target[source], rel=1e-12)
        assert r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    for s in own:
        assert abs(taken[s] - target[s]) <= 3 * largest[s]  # of three equal rows at the most
    again = mixing.mix(docs_of(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_mix_takes_nested_sets(spark):
    """A document that is taken under a small target is taken under a larger one."""
    rows = [(k, "w " * (k % 9), "ab"[k % 2]) for k in range(600)]
    takes = [{r["doc_id"]: r["taken"] for r in mixing.mix(docs_of(spark, rows), weights=w).collect()} for w in ((1, 3), (1, 1), (3, 2), (5, 1))]
    for less, more in zip(takes, takes[1:], strict=False):
        assert all(less[k] <= more[k] for k in less if k % 2 == 0)


def test_mix_of_edges(spark, docs, no_docs):
    assert mixing.mix(no_docs).collect() == []
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    nothing = mixing.mix(spark.createDataFrame([(1, None, "a", 0), (2, " \n", None, 0)], "doc_id long, text string, source string, target int"))
    assert [(r["size"], r["target"], r["taken"]) for r in nothing.collect()] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_mix_stays_in_the_jvm(spark, docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    sized = mixing.sized(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", sized)


def test_places_of_sources(spark):
    names = [f"s{k:03d}" for k in range(250)]
    rows = spark.createDataFrame([(s,) for s in names], "source string").repartition(9)
    assert [r["place"] for r in mixing.numbered(rows).orderBy("source").collect()] == list(range(250))


def test_best_is_exact_with_few_slices(spark):
    rows = spark.range(3000).select(F.pmod("id", F.lit(2)).alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("s"), F.col("id").cast("string").alias("p"))
    found = collocations.best(rows, "g", [F.desc("s"), F.asc("p")], 40, 5).collect()
    want = sorted(rows.collect(), key=lambda r: (r["g"], -r["s"], r["p"]))
    assert sorted((r["g"], r["rank"], r["p"]) for r in found) == sorted((g, k, r["p"]) for g in (0, 1) for k, r in enumerate([r for r in want if r["g"] == g][:40], 1))


def test_quality_fits_on_so_many_rows_of_one_id(spark):
    """An id that many rows repeat gives no more than the sample to the fit, the same ones in every layout."""
    import numpy as np

    rows = [(1, f"good words number {i}") for i in range(60)] + [(2, f"BAD!! words {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    learnt = labels.where(common.remainder_column(F.col("doc_id"), quality.HELD_OUT[0]) != quality.HELD_OUT[1]).count()
    few = [quality.train(docs.repartition(n), labels, sample=10) for n in (1, 7)]
    assert learnt and np.array_equal(few[0][0], few[1][0]) and few[0][1] == few[1][1]
    whole, wider = quality.train(docs, labels), quality.train(docs, labels, sample=65)
    assert np.array_equal(whole[0], wider[0]) and not np.array_equal(whole[0], few[0][0])
