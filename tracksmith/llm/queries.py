"""The queries of this subpackage, by the name under which they are registered."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracksmith.llm import bpe, centroids, collocations, decontaminate, html_text, langid, license, mixing, pitman_yor, quality, repetition, simhash, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_quality": quality.op2_quality,
    "op3_repetition": repetition.op3_repetition,
    "op4_langid": langid.op4_langid,
    "op5_html": html_text.op5_html,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_warc": warc.op7_warc,
    "op8_license": license.op8_license,
    "op9_simhash": simhash.op9_simhash,
    "op10_pitman_yor": pitman_yor.op10_pitman_yor,
    "op11_collocations": collocations.op11_collocations,
    "op12_centroids": centroids.op12_centroids,
    "op13_mixing": mixing.op13_mixing,
}

#: What SQL can say of the operators' results: base columns and held-out flags, taken from the same queries.
QUERIES |= {
    "base_op2": lambda spark, d: quality.op2_quality(spark, d).select("doc_id", "held_out"),
    "base_op3": lambda spark, d: repetition.op3_repetition(spark, d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "base_op4": lambda spark, d: langid.op4_langid(spark, d).select("doc_id", "held_out"),
    "base_op8": lambda spark, d: license.op8_license(spark, d).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "base_op10": lambda spark, d: pitman_yor.op10_pitman_yor(spark, d).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score")),
}

#: CRC-32 of an id's decimal text: a byte at a time, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "base_op2": f"SELECT doc_id, {_CRC} % 4 = 2 AS held_out FROM documents",
    "base_op4": f"SELECT doc_id, {_CRC} % 5 = 0 AS held_out FROM documents",
    "base_op3": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
  l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
  g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2), k AS (SELECT r, i, w[i:i+2] AS x FROM g), n AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM k),
  c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM n WHERE n > 1) GROUP BY r)
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed FROM d JOIN l USING (r) LEFT JOIN c USING (r)""",
    "base_op8": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  p AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS m, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g FROM d)
  SELECT doc_id, len(w) AS n_words, len(m) + len(a) + len(g) AS n_base, list_min(list_concat(m, a, g)) - 1 AS first_word, list_max(list_concat(m, a, g)) - 1 AS last_word, array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p""",
    "base_op10": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} % 7 = 2 AS held_out, list_append({_WORDS.format(_LOWER)}, '') AS w FROM documents), t AS (SELECT r, held_out, unnest(w) AS w FROM d),
  c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), s AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c), x AS (SELECT r, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 1) / (n + v + 1)::DOUBLE)) AS base FROM t LEFT JOIN c USING (w), s GROUP BY r)
  SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 4) AS base_score FROM d JOIN x USING (r), s""",
    "op11_collocations": rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
  g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
  f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
  c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
  h AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
  x AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c LEFT JOIN h USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
  y AS (SELECT x.lang, x.phrase, a, cut, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
  z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op12_centroids": """WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
  c AS (SELECT 0 AS round, row_number() OVER (ORDER BY h)::INT - 1 AS k, x AS c FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 8)
    UNION ALL SELECT o.round + 1, o.k, coalesce(m.c, o.c) FROM c o LEFT JOIN (
      SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (
        SELECT k, j, sum(e)::BIGINT AS s, count(*) AS n FROM (
          SELECT k, unnest(x) AS e, unnest(range(1, 65)) AS j FROM (
            SELECT v.i, any_value(x) AS x, arg_min(k, list_sum(list_transform(range(1, 65), lambda j: (x[j] - c[j]) * (x[j] - c[j])))::BIGINT * 8 + k) AS k FROM v, c GROUP BY v.i))
        GROUP BY k, j) GROUP BY k) m ON m.k = o.k WHERE o.round < 10),
  a AS (SELECT i, any_value(vec_id) AS vec_id, min(list_sum(list_transform(range(1, 65), lambda j: (x[j] - c[j]) * (x[j] - c[j])))::BIGINT * 8 + k) AS best FROM v, (SELECT * FROM c WHERE round = 10) GROUP BY i)
  SELECT vec_id, k AS cluster, best // 8 AS distance, (sum(best // 8) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(best // 8) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN c ON c.round = 10 AND c.k = best % 8""",
    "op13_mixing": rf"""WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source), t AS (SELECT sum(source_size) AS total FROM s),
  o AS (SELECT *, 3 * source_size / weight AS ratio, total - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free, sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM s, t WHERE source_size > 0),
  l AS (SELECT coalesce((SELECT free::DOUBLE / w::DOUBLE FROM o WHERE 3 * source_size * w > free * weight ORDER BY ratio, source LIMIT 1), 0) AS level),
  g AS (SELECT *, least((3 * source_size)::DOUBLE, level * weight) AS target FROM s, l), f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM g),
  b AS (SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS up_to FROM d GROUP BY source, h),
  e AS (SELECT source, arg_min(CASE WHEN up_to - rest < rest - (up_to - n) THEN h ELSE h - 1 END, h) AS threshold FROM (SELECT b.*, greatest(target - times * source_size, 0) AS rest FROM b JOIN f ON f.source IS NOT DISTINCT FROM b.source) WHERE up_to > rest GROUP BY source)
  SELECT d.doc_id, d.size, f.source_size, f.target, d.size * (times + CASE WHEN h <= coalesce(threshold, 1152921504606846975) THEN 1 ELSE 0 END) AS taken FROM d JOIN f ON f.source IS NOT DISTINCT FROM d.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM d.source""",
}
