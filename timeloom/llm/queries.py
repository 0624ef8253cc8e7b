"""The operators' queries over the whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, html_text, minhash, mixing, pieces, quality, rptree, secrets, token_counts, warc
from .common import shared_path, table

#: Tokens beyond this are over the limit of a training sequence.
TOKEN_LIMIT = 4096


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a cache of its own, so each call encodes every distinct text
    counts = token_counts.token_counts(docs, vocabulary(), shared_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(), shared_path(spark, "token-cache"), others=("source",))
    return mixing.copies(counted, max_repetition=2.0, tokens="n_tokens")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op6_rptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rptree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segment(table(spark, sf_dir, "documents"), vocabulary(), n=4)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_cover_tree": op2_cover_tree,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_html_text": op5_html_text,
    "op6_rptree": op6_rptree,
    "op7_quality": op7_quality,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_minhash": op9_minhash,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL = {
    "op9_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        t AS (SELECT s.doc_id, s.s, n.n FROM s JOIN n USING (doc_id)),
        e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
        c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.low AS component_id, c.low = d.doc_id AS kept
        FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op2_cover_tree": """
        WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings WHERE embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_rptree": """
        WITH RECURSIVE v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
              AND list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.95),
        reach AS (SELECT DISTINCT vec_id AS a, vec_id AS b FROM embeddings
                  UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
        c AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
        SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.low AS component_id, c.a = c.low AS kept
        FROM embeddings v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = c.a""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, html, octet_length(encode(html)) AS n FROM p),
        m AS (SELECT html, max(page_id) AS top FROM q WHERE n >= 1000 GROUP BY html)
        SELECT q.page_id, q.n AS payload_bytes, sha1(q.html) AS payload_digest,
               CASE WHEN m.top > q.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN m.top > q.page_id THEN m.top END AS refers_to
        FROM q LEFT JOIN m ON q.n >= 1000 AND m.html = q.html""",
}
