"""Registered queries of the training-data operators: thin applications to whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .bpe import round_trip
from .decontaminate import find_leaks
from .divergence import source_divergence
from .jaccard_join import jaccard_join
from .line_dedup import line_dedup
from .near_vectors import near_vectors
from .pii import pii_digest
from .prefix_trie import conversation_trie
from .quality import classify
from .secrets_scan import secrets_digest, vocabulary_words
from .sharding import shard_digest
from .token_store import new_store, read_store, write_store
from .top_products import top_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op10_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


#: All pairs of texts that share a shingle, counted exactly; components by repeated minima.
SQL["op10_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\t\n\v\f\r ]+'), lambda x: x <> '') AS t FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(list_slice(t, i, i + 4), ' '))
                                      WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
fp AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS f FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
r AS (SELECT a AS node, a AS seen FROM (SELECT DISTINCT a FROM l) UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT node, min(seen) AS class_id FROM r GROUP BY 1),
d AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
o AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS copy_of FROM fp)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(copy_of, w.doc_id) AS copy_of, coalesce(d.n, 0) AS n_links,
       coalesce(class_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN m ON m.node = w.doc_id LEFT JOIN d ON d.a = w.doc_id LEFT JOIN o ON o.doc_id = w.doc_id
"""


@_query
def op1_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op4_token_store(spark, sf_dir):
    path = new_store(spark)
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_store(spark, path, with_ids=False).drop("ids")


@_query
def op7_pii(spark, sf_dir):
    return pii_digest(table(spark, sf_dir, "documents"))


@_query
def op8_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


SQL["op8_line_dedup"] = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
k AS (SELECT DISTINCT source, text, trim(x, chr(9) || chr(13) || ' ') AS line FROM (SELECT source, text, unnest(l) AS x FROM d)),
p AS (SELECT source, count(DISTINCT text) AS pages FROM d GROUP BY 1),
b AS (SELECT source, line FROM k JOIN p USING (source) GROUP BY source, line, pages HAVING count(*) >= 3 AND count(*) > 0.08 * pages),
e AS (SELECT doc_id, source, unnest(l) AS x, unnest(range(len(l))) AS i FROM d),
g AS (SELECT doc_id, i, x, trim(x, chr(9) || chr(13) || ' ') <> '' AND b.line IS NOT NULL AS gone
      FROM e LEFT JOIN b ON b.source = e.source AND b.line = trim(x, chr(9) || chr(13) || ' '))
SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (gone) AS INT) AS n_dropped,
       coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
FROM g GROUP BY 1
"""


@_query
def op2_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op9_secrets(spark, sf_dir):
    return secrets_digest(table(spark, sf_dir, "documents"), more_words=vocabulary_words(public_tokenizers.path("word_bpe_49k.json")))


@_query
def op3_near_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Every pair of a label, cosines in double precision; components by repeated minima.
SQL["op3_near_vectors"] = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), r AS (SELECT a AS node, a AS seen FROM (SELECT DISTINCT a FROM l) UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT node, min(seen) AS c FROM r GROUP BY 1), n AS (SELECT a, count(*) AS k FROM l GROUP BY 1)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN m ON m.node = vec_id LEFT JOIN n ON n.a = vec_id
"""


@_query
def op5_sharding(spark, sf_dir):
    return shard_digest(table(spark, sf_dir, "documents"))


@_query
def op6_decontaminate(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op11_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


#: Every kept term in every group, in integers of 128 bits.
SQL["op11_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (coalesce(t.total, 0) + 5 * l.v) AS p, 1 + 1000000000 * (k.n + 5) // (l.total + 5 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM u QUALIFY part = 'pair' OR rank <= 50
"""


@_query
def op12_top_products(spark, sf_dir):
    return top_products(table(spark, sf_dir, "embeddings"))


#: Every query with every row.
SQL["op12_top_products"] = r"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY a.r ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) AS INT) AS rank, b.vec_id,
       CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 10
"""


@_query
def op13_prefix_trie(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: Paths as lists of digests; each node with all nodes below it. The checksum of a decimal goes bit by bit.
SQL["op13_prefix_trie"] = r"""
WITH o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (
  SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda z, j: xor(z >> 1, (z & 1) * 3988292384)))) % 4 AS h FROM (SELECT DISTINCT c FROM o)
), r AS (
  SELECT h.c, 0 AS own, o.i, o.turn, o.words FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.i <= h
  UNION ALL SELECT h.c, 1, o.i, o.turn, o.words FROM h JOIN o ON o.c = h.c AND o.i > h
), s AS (
  SELECT c, row_number() OVER w AS depth, list(turn) OVER w AS path, words FROM r WINDOW w AS (PARTITION BY c ORDER BY own, i ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, CAST([] AS VARCHAR[]), 0 FROM h
), x AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends FROM s),
n AS (SELECT path, depth, min(c) AS c, count(*) AS n, any_value(words) AS words, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS ids FROM x GROUP BY 1, 2),
k AS (SELECT list_slice(path, 1, depth - 1) AS path, depth - 1 AS depth, count(*) AS children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k USING (path, depth)),
b AS (SELECT list_slice(m.path, 1, a) AS path, a AS depth, sum((n - 1) * words) AS saved, count(*) FILTER (children = 0) AS leaves FROM m, unnest(range(m.depth + 1)) AS t(a) GROUP BY 1, 2)
SELECT m.c AS conv_id, m.depth, p.c AS parent_conv_id, m.n AS n_convs, m.children AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ids, '')) AS ends_sha256
FROM m JOIN b USING (path, depth) LEFT JOIN m p ON m.depth > 0 AND p.depth = m.depth - 1 AND p.path = list_slice(m.path, 1, m.depth - 1)
"""
