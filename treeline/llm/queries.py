"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, embed_dedup, fim, html_extract, langid, mixing, ngram_join, spelling, sst, substring_dedup, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_token_shards": sst.op3_token_shards,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_mixing": mixing.op5_mixing,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_embedding_dedup": embed_dedup.op7_embedding_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_nearest": ann.op9_nearest,
    "op10_language_id": langid.op10_language_id,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

#: Every window of 35 words as one text, those that occur more than once, and the words that they cover.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i + 34], ' ')) END)) AS h FROM d),
r AS (SELECT h FROM k WHERE h IS NOT NULL GROUP BY h HAVING COUNT(*) > 1),
c AS (SELECT doc_id, i, word, COALESCE(MAX((r.h IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM k LEFT JOIN r USING (h)),
g AS (SELECT doc_id, COUNT(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_removed, 0)::BIGINT AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

#: All pairs that share a shingle, those at 0.8 or more, and the classes that they close to.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)),
c(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.other)
SELECT doc_id, MIN(other) AS class_id, (SELECT COUNT(*) FROM l WHERE l.a = c.doc_id) AS n_links FROM c GROUP BY doc_id
"""

#: All pairs of one label by cosine in double precision.
OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
f AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
c(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.vec_id, l.b FROM c JOIN l ON l.a = c.other)
SELECT vec_id, (SELECT COUNT(*) FROM l WHERE l.a = c.vec_id) AS n_links, MIN(other) AS component_id, MIN(other) = vec_id AS kept FROM c GROUP BY vec_id
"""

#: The CRC of doc_ids by bits, n-gram codes by character, profiles and out-of-place distances. It learns from all
#: rows that are not held out, as the operator does while a language has no more than its bound of documents.
OP10_SQL = r"""
WITH bits AS (SELECT doc_id, lang, text, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) AS crc FROM documents),
d AS (SELECT doc_id, lang, COALESCE(xor(crc, 4294967295::BIGINT) % 5 = 0, false) AS held_out, ' ' || trim(regexp_replace(lower(COALESCE(text, '')), '[^\p{L}]+', ' ', 'g')) || ' ' AS x, row_number() OVER () AS r FROM bits),
i AS (SELECT r, list_transform(string_split(x, ''), lambda ch: CASE ch WHEN ' ' THEN 1 ELSE unicode(ch) END::BIGINT) AS cs FROM d WHERE length(x) > 2),
ch AS (SELECT * FROM (SELECT r, unnest(cs) AS a, unnest(cs[2:]) AS b, unnest(cs[3:]) AS c FROM i) WHERE b IS NOT NULL),
g AS (SELECT r, a AS code FROM ch WHERE a > 1 UNION ALL SELECT r, a + (b << 21) FROM ch UNION ALL SELECT r, a + (b << 21) + (c << 42) FROM ch WHERE b > 1 AND c > 0),
n AS MATERIALIZED (SELECT r, code, COUNT(*) AS n FROM g GROUP BY r, code),
p AS MATERIALIZED (SELECT lang, code, place FROM (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY SUM(n) DESC, code) - 1 AS place FROM n JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, code) WHERE place < 400),
m AS MATERIALIZED (SELECT r, code, place, COUNT(*) OVER (PARTITION BY r) AS m FROM (SELECT r, code, row_number() OVER (PARTITION BY r ORDER BY n DESC, code) - 1 AS place FROM n) WHERE place < 400),
s AS (SELECT r, l.lang, any_value(m) AS m, SUM(COALESCE(least(abs(m.place - p.place), 400), 400))::BIGINT AS away FROM m CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.code = m.code GROUP BY r, l.lang),
b AS (SELECT r, lang, 1.0::DOUBLE - away::DOUBLE / (400 * m) AS score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY away, lang) AS k FROM s) WHERE k = 1)
SELECT doc_id, held_out, COALESCE(b.lang, 'und') AS lang_pred, COALESCE(score, 0.0) AS score FROM d LEFT JOIN b USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op6_ngram_join": OP6_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op10_language_id": OP10_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op11_suffix_dedup": suffix_dedup.OP11_SQL,
    "op12_fill_in_middle": fim.OP12_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
