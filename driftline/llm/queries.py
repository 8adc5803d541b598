"""Registered queries of this folder, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, huffman, itq, licenses, packing, phrases, pii, simhash, spelling, topk, toxicity, warc
from .common import fold_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_ctw_score")
def op1_ctw_score(spark: SparkSession, sf: str) -> DataFrame:
    return ctw.scores(table(spark, sf, "documents"), F.coalesce(fold_of(F.col("doc_id"), 5) != 1, F.lit(True)))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf: str) -> toxicity.Model:
    """Fitted on the labelled rows outside the held-out fold."""
    labels = table(spark, sf, "labels")
    return toxicity.fit(docs, labels.filter(fold_of(F.col("doc_id"), 4) != 2))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity_model(spark, docs, sf)
    held = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    found = docs.select("doc_id", held.alias("held_out"), toxicity.scored(docs, model).alias("s"))
    return found.select("doc_id", "held_out", F.col("s.score").alias("score"), F.when(F.col("s.score") >= 0.3, 1).otherwise(0).alias("predicted"), F.col("s.hits").alias("n_hits"))


@query("op3_pii_tagger")
def op3_pii_tagger(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return pii.report(docs, pii.fit(docs))


def _op4_sql() -> str:
    quote = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    sets = ", ".join(f"{{'label': '{name}', 'words': {quote(sorted(set(text.split())))}}}" for name, text in licenses.TEMPLATES)
    phrases = ", ".join(f"{{'label': '{label}', 'words': {quote(phrase.split())}}}" for phrase, label in licenses.PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, i, u.x.label AS label FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d) a CROSS JOIN (SELECT unnest([{phrases}]) AS x) u
  WHERE w[i + 1] = u.x.words[1] AND w[i + 1:i + len(u.x.words)] = u.x.words),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM p GROUP BY doc_id),
k AS (SELECT doc_id, list_distinct(w[s + 1:s + 64]) AS block FROM (SELECT doc_id, w, unnest(range(0, len(w), 32)) AS s FROM d) a),
t AS (SELECT doc_id, u.x.label AS label, len(list_intersect(block, u.x.words))::DOUBLE / len(u.x.words) AS share FROM k CROSS JOIN (SELECT unnest([{sets}]) AS x) u),
m AS (SELECT doc_id, list_sort(list(DISTINCT label)) AS labels, max(share) AS best FROM t WHERE share >= 0.8 - 1e-9 GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1e0 ELSE coalesce(best, 0e0) END AS score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""


@query("op4_license_scan", _op4_sql())
def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


@query("op5_cost_packing")
def op5_cost_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json")).drop("cost")


@query("op6_huffman_ids")
def op6_huffman_ids(spark: SparkSession, sf: str) -> DataFrame:
    return huffman.round_trip(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), with_ids=False).drop("ids")


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""


@query("op7_warc_chain", OP7_SQL)
def op7_warc_chain(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) AS d FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND q.d = c.d),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op8_topk_histogram", OP8_SQL)
def op8_topk_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents")).drop("fp")


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


OP11_SQL = """
WITH RECURSIVE ok AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS v, len(embedding) AS d FROM embeddings WHERE len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b, b.vec_id AS id FROM ok a JOIN ok b ON a.k <> b.k AND a.d = b.d WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT a, b, id FROM l UNION SELECT r.a, l.b, l.id FROM r JOIN l ON l.a = r.b),
n AS (SELECT k, vec_id, (SELECT count(*) FROM l WHERE l.a = k) AS n_links, least(vec_id, (SELECT min(id) FROM r WHERE r.a = k)) AS component_id FROM ok
  UNION ALL SELECT NULL, vec_id, 0, vec_id FROM embeddings WHERE NOT coalesce(len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false))
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM n
"""


@query("op11_itq_vectors", OP11_SQL)
def op11_itq_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf, "embeddings"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, w[i + 1:i + k] AS p FROM (SELECT lang, w, k, unnest(range(len(w) - k + 1)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, p, len(p) AS k, count(*) AS c FROM g GROUP BY lang, p HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
s AS (SELECT c.lang, c.p, c.c AS a, l.c AS l, r.c AS r, ((2000000::HUGEINT * c.c) // (l.c + r.c))::BIGINT AS score, j
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f) c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:j] JOIN f r ON r.lang = c.lang AND r.p = c.p[j + 1:c.k]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
o AS (SELECT lang, p[i + 1:i + m] AS p, max(c) AS over FROM (SELECT *, unnest(range(k - m + 1)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f)) GROUP BY 1, 2),
t AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM b LEFT JOIN o ON o.lang = b.lang AND o.p = b.p WHERE coalesce(100 * over < 80 * a, true)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM t)
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


# crc32 half a byte at a time; its sixteen constants follow from the polynomial
OP13_SQL = r"""
WITH RECURSIVE z AS (SELECT list_transform(range(16), lambda n: list_reduce([n, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS z),
u AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
q AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM u WHERE len(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x)), lambda i: strpos('0123456789ABCDEF', substr(x, xor(i, 1) + 1, 1)) - 1)),
  lambda c, y: xor(c // 16, z[xor(c % 16, y) + 1])), 4294967295) AS h FROM q CROSS JOIN z),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM h)
  WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(len(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON w.word = v.rest UNION SELECT w.word, v.word, v.n FROM v JOIN w ON w.word = v.rest),
b AS (SELECT word, count(*) AS n_near FROM p GROUP BY word),
t AS (SELECT word, near, n FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, near) = 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN t.n >= 5 * w.n THEN near END AS form, CASE WHEN t.n >= 5 * w.n THEN t.n END AS form_n
  FROM w LEFT JOIN b ON b.word = w.word LEFT JOIN t ON t.word = w.word),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.at AND e.form IS NULL
"""


@query("op13_spelling", OP13_SQL)
def op13_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))
