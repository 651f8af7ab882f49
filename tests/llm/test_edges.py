"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names of operators, and training by hand."""

import math

import numpy as np
import pytest

from tracksmith.llm import common, confirm, decontaminate, langid, license, quality, repetition, simhash, warc

from .conftest import LONG, prose


def test_ftrl_equals_a_loop_over_dictionaries():
    """Per coordinate: z and n, weight from z past L1, as in the published algorithm."""
    texts = [(prose(k, 30), k % 2) for k in range(40)] + [("same words", 1), ("same words", 0)]
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == "bias" else quality.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    def examples():
        for text, y in texts:
            bucket, value = quality.features(text)
            yield {**{int(b): float(v) for b, v in zip(bucket, value)}, "bias": 1.0}, y

    for _ in range(quality.EPOCHS):
        for x, y in examples():
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    weights, bias = quality.ftrl([(*quality.features(t), y) for t, y in texts])
    for text, _ in texts + [("never seen", 0), ("", 0), (None, 0)]:
        bucket, value = quality.features(text)
        margin = weight("bias") + sum((weight(int(b)) if int(b) in z else 0.0) * float(v) for b, v in zip(bucket, value))
        assert quality.score(weights, bias, text) == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-4)


def test_quality_labels_with_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(i, prose(i)) for i in range(40)] + [(40, None), (41, ""), (None, prose(1)), (5, prose(77))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(42)] + [(3, 1), (3, 0), (7, None), (None, 1), (999, 1)], "doc_id long, quality int").selectExpr("*", "'x' AS text", "1 AS score")
    out = quality.classify(docs.selectExpr("*", "'y' AS quality", "0.5 AS score", "true AS held_out"), labels)
    rows = out.collect()
    assert len(rows) == 44 and all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows if not r["text"]}) == 1
    assert [r["score"] for r in quality.classify(docs, labels.where("false")).collect()] == [0.5] * 44


def test_language_of_repeats_long_texts_and_clashing_names(spark):
    rows = [(i, " ".join(["ba", "be", "bi"] * 20), "x") for i in range(10)] + [(20 + i, " ".join(["xo", "xu", "xy"] * 20), "y") for i in range(10)]
    rows += [(50, "", "x"), (51, "ba be " * 100_000, None), (1, rows[1][1], "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame([(*r, "z", 1.0) for r in rows], "doc_id long, text string, lang string, __found string, score double")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got if r["doc_id"] == 50} == {"und"} and {r["lang_pred"] for r in got if r["doc_id"] == 51} == {"x"}
    kept = langid.keep(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1
    assert langid.keep(docs.limit(0)).count() == 0
    # Two languages with the same texts: the first name wins.
    tie = spark.createDataFrame([(i, "ba be bi bo", lang) for i, lang in enumerate(["q", "p"] * 6)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(tie).collect()} == {"p"}


def test_records_repeated_and_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.org", "<p>x</p>" * 50_000), (1, "http://a.org", "<p>x</p>" * 50_000)], "page_id long, url string, html string")
    given = warc.responses(pages).selectExpr("*", "'k' AS kind", "'b' AS block")
    got = warc.derive(given).collect()
    assert len(got) == 4 and len({r["record_id"] for r in got}) == 2 and max(r["n_bytes"] for r in got) > 90_000
    assert warc.responses(pages.limit(0)).count() == 0


def test_license_of_long_texts_and_ties():
    index = license.Index()
    passage = " ".join(w.decode() for w in index.templates[3][1])
    text = ("plain words here " * 3000 + passage + " ") * 20
    found = license.findings(index, text)
    assert index.templates[3][0] in found[5] and found[6] == 1.0
    both = license.findings(index, passage + " . " + " ".join(w.decode() for w in index.templates[4][1]))
    assert both[5].split(",") == sorted({index.templates[3][0], index.templates[4][0]}) and both[6] == 1.0


def test_sets_are_compared_with_ties_and_empty_ones():
    sets = confirm.Sets([np.array([1, 2, 3, 4, 5], np.uint64), np.array([1, 2, 3, 4], np.uint64), np.array([9], np.uint64), np.empty(0, np.uint64), np.array([1, 2, 3, 4, 5], np.uint64)])
    assert list(sets.alike(0, np.array([1, 2, 3, 4]), 0.8)) == [1, 4]
    assert list(sets.alike(3, np.array([0, 1, 2]), 0.8)) == []


@pytest.mark.parametrize("docs_of", ["empty", "clashing"])
def test_pipeline_stages(spark, tmp_path, docs_of):
    """Empty tables, and repeated rows with columns named like those that stages use."""
    import corpus_pipeline

    rows = [] if docs_of == "empty" else [(i, prose(i, 120), "en", "s", 1, 0.5, "x", 7) for i in range(30)] + [(3, prose(3, 120), "en", "s", 1, 0.5, "x", 7)] * 2
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, __found string, __hash int"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(30)] if rows else [], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no passage of these")] if rows else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = sorted(r["doc_id"] for r in out.collect())
    assert got == (list(range(30)) if rows else []) and set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).columns == [k.split()[0] for k in kinds.split(", ")], name


def test_folders_of_a_cluster(spark, monkeypatch):
    """Without a shared folder a cluster gets an error, not a folder of one machine."""
    class Context:
        master = "spark://host"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        common.folder(Session())
    assert common.folder(spark)


def test_repetition_of_a_very_long_text(spark):
    row = repetition.rules(spark.createDataFrame([(1, LONG * 5), (2, LONG * 5)], "doc_id long, text string")).collect()
    assert len(row) == 2 and not any(r["kept"] for r in row)


def test_empty_benchmark_keeps_all(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.keep(docs, none).count() == docs.count()
    assert simhash.keep_one(docs.limit(0)).columns == docs.columns


def test_base_columns_equal_sql(spark):
    from tests.oracle import connect, differences
    from tracksmith.llm import queries

    folder = "/root/testdata/sf0.001"
    con = connect(folder)
    for name, sql in queries.ORACLES.items():
        assert differences(spark, con, queries.QUERIES[name], sql, folder) is None, name
