"""The queries of this subpackage: one for each operator, on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import line_dedup, mixing, near_vectors, ngram_join, packing, pii, quality, quotes, resampling, spelling, substring_dedup, topk, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_documents(spark, docs, quality.fit(spark, docs, _table(spark, sf_dir, "labels")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(spark, _table(spark, sf_dir, "documents"))


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(spark, _table(spark, sf_dir, "conversations"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect_pii(spark, _table(spark, sf_dir, "documents")).drop("found", "masked")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_substrings(spark, _table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(spark, _table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, _table(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(spark, _table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vector_components(spark, _table(spark, sf_dir, "embeddings"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.lines_digest(spark, _table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampling_digest(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_mixing, op3_quotes, op4_pii, op5_packing, op6_substring_dedup, op7_topk, op8_url_filter,
                                    op9_ngram_join, op10_near_vectors, op11_line_dedup, op12_resampling, op13_spelling)}


_WORDS = "[^\\x20\\x09-\\x0D]+"

_OP6 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p+19], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, p + i AS at FROM later, range(0, 20) AS t(i)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.at) AS k, count(*) AS n
         FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.at = g.at WHERE g.at IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

_OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_REACH = """
reach AS (SELECT id AS node, id AS other FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)
"""

_OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT id, array_to_string(ws[p:p+2], ' ') AS g
      FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
nodes AS (SELECT w.id, coalesce(n, 0) AS n FROM w LEFT JOIN (SELECT id, count(*) AS n FROM s GROUP BY id) c ON c.id = w.id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN nodes p ON p.id = a JOIN nodes q ON q.id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
{_REACH}
SELECT nodes.id AS doc_id, CAST(n AS BIGINT) AS n_shingles, min(other) AS component_id FROM nodes JOIN reach ON node = nodes.id GROUP BY ALL
"""

_OP10 = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
                     WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id AND len(p.e) = len(q.e)
          WHERE list_dot_product(p.e, q.e) / (sqrt(list_dot_product(p.e, p.e)) * sqrt(list_dot_product(q.e, q.e))) >= 0.9),
{_REACH}
SELECT nodes.id AS vec_id, coalesce(n, 0) AS n_links, min(other) AS component_id, nodes.id = min(other) AS kept
FROM nodes JOIN reach ON node = nodes.id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = nodes.id GROUP BY nodes.id, n
"""


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = f"""
WITH l AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
common AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, common.k IS NOT NULL AND doc_id < last AS gone FROM l LEFT JOIN common ON common.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

# crc32 is linear: a byte contributes a value that depends on how many bytes follow it, the length another one.
_CRC = """
shifts AS (SELECT range AS b, range AS c, 0 AS r FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, r + 1 FROM shifts WHERE r < 8),
step AS (SELECT b, c FROM shifts WHERE r = 8),
longest AS (SELECT coalesce(max(octet_length(encode(k))), 0) AS n FROM keys),
follow AS (SELECT 0 AS j, b, c FROM step UNION ALL SELECT j + 1, f.b, xor(step.c, f.c >> 8) FROM follow f JOIN step ON step.b = f.c & 255 WHERE j < (SELECT n FROM longest)),
init AS (SELECT 0 AS n, 4294967295 AS z UNION ALL SELECT init.n + 1, xor(step.c, z >> 8) FROM init JOIN step ON step.b = z & 255 WHERE init.n < (SELECT n FROM longest)),
bytes AS (SELECT k, n, unnest(range(n)) AS j, unnest(list_transform(range(n), lambda i: substr(x, CAST(2 * (n - i) - 1 AS BIGINT), 2))) AS digits
          FROM (SELECT k, octet_length(encode(k)) AS n, upper(hex(encode(k))) AS x FROM keys)),
hexed AS (SELECT j, printf('%02X', b) AS digits, c FROM follow),
crc AS (SELECT k, xor(xor(bit_xor(hexed.c), any_value(z)), 4294967295) AS crc FROM bytes JOIN hexed USING (j, digits) JOIN init ON init.n = bytes.n GROUP BY k)
"""

_OP12 = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, TRUE AS own, text FROM documents UNION ALL SELECT item_id, FALSE, text FROM benchmark),
ws AS (SELECT id, own, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM w),
f AS (SELECT id, own, k AS n, array_to_string(ws[p:p + k - 1], ' ') AS k FROM (SELECT id, own, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM ws, range(1, 4) AS o(k) WHERE len(ws) >= k)),
keys AS (SELECT DISTINCT k FROM f),{_CRC},
fb AS (SELECT id, own, n, crc % 10000 AS b FROM f JOIN crc USING (k)),
c AS (SELECT b, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM fb GROUP BY b),
total AS (SELECT sum(s) AS s, sum(t) AS t FROM c),
gain AS (SELECT b, floor(1000 * ln((CAST(c.t + 1 AS DOUBLE) * CAST(total.s + 10000 AS DOUBLE)) / (CAST(c.s + 1 AS DOUBLE) * CAST(total.t + 10000 AS DOUBLE)))) AS g FROM c, total),
weighed AS (SELECT id, count(*) AS n_features, count(*) FILTER (n = 1) AS n_words, CAST(sum(g) AS BIGINT) AS weight FROM fb JOIN gain USING (b) WHERE own GROUP BY id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(n_words, 0) AS n_words, coalesce(weight, 0) AS weight, coalesce(weight, 0)
           + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
           FROM documents LEFT JOIN weighed ON id = doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= n * 5 // 100 THEN r END AS rank FROM scored s LEFT JOIN ranked ON ranked.doc_id = s.doc_id
"""

_OP13 = f"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_FOLDED}, '[a-zÀ-ÿ]+')) AS run FROM documents),
own AS (SELECT run, id || ':' || run AS k, count(*) AS times FROM runs GROUP BY ALL),
keys AS (SELECT DISTINCT k FROM own WHERE length(run) >= 6),{_CRC},
said AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, CAST(crc % length(run) AS BIGINT)) || substr(run, CAST(crc % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM own JOIN crc USING (k)),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
links AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM words a JOIN less b ON b.rest = a.word
          UNION SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
          UNION SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near FROM links GROUP BY word),
top AS (SELECT word, near, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS r FROM links) WHERE r = 1),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 5 * words.n THEN near END AS form, CASE WHEN top.n >= 5 * words.n THEN top.n END AS form_n
           FROM words LEFT JOIN best ON best.word = words.word LEFT JOIN top ON top.word = words.word),
chase AS (SELECT word, word AS at FROM formed UNION ALL SELECT chase.word, form FROM chase JOIN formed ON formed.word = chase.at WHERE form IS NOT NULL)
SELECT formed.word, formed.form, chase.at AS root, formed.n, formed.n_near, formed.form_n FROM formed JOIN chase ON chase.word = formed.word JOIN formed e ON e.word = chase.at AND e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express on whole tables; the others are tested by brute force."""
    return {"op6_substring_dedup": _OP6, "op7_topk": _OP7, "op9_ngram_join": _OP9, "op10_near_vectors": _OP10, "op11_line_dedup": _OP11,
            "op12_resampling": _OP12, "op13_spelling": _OP13}
