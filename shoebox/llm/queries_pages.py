"""Queries over web pages, media, labels, languages and embeddings."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from .langid import identify_language, train_languages
from .media import digests, media_features, read_media, write_images
from .partialpq import encode_vectors, with_label_errors
from .pqdedup import cosine_groups
from .storage import scratch
from .toxicity import held_out, score_toxicity, train_toxicity
from .urlfilter import filter_urls, parse_rules
from .warc import read_warc, write_warc

#: The rules of the URL query's contract.
URL_RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    records = read_warc(spark, manifest, with_payload=False).where("kind = 'record'")
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), parse_rules(URL_RULES))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "media")
    write_images(table(spark, sf_dir, "documents"), folder)
    return digests(media_features(read_media(spark, folder)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, machine).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_groups(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode_vectors(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(books.text().encode() if books else b"").hexdigest()
    one = coded.withColumn("code", F.lower(F.hex("code")))
    return with_label_errors(one).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, train_languages(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_url_filter": op2_url_filter,
    "op3_media": op3_media,
    "op6_toxicity": op6_toxicity,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op9_language": op9_language,
    "op12_vector_codes": op12_vector_codes,
}

_FITS = " UNION ALL ".join(
    f"SELECT '{r.verdict}' AS verdict, '{r.host}' AS rule_host, '{r.path}' AS rule_path" for r in parse_rules(URL_RULES)
)

_NEAREST = """
    SELECT vec_id, label, part, s, min({{'d': d, 'k': k}}) AS near FROM (
      SELECT vec_id, label, part, s, k, list_sum(list_transform(list_zip(s, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN c{0} USING (part)
    ) GROUP BY ALL"""
#: A round over codebook 0 gives codebook 1, and so on.
_ROUND = """
    a{0} AS MATERIALIZED ({near}),
    m{0} AS (SELECT part, k, list(CASE WHEN t >= 0 THEN t // n ELSE -((n - 1 - t) // n) END ORDER BY place) AS e
      FROM (SELECT part, near.k AS k, place, sum(s[place + 1])::BIGINT AS t, count(*) AS n FROM a{0}, width, range(width.step) r(place) GROUP BY ALL) GROUP BY ALL),
    c{1} AS MATERIALIZED (SELECT c{0}.part, c{0}.k, coalesce(m{0}.e, c{0}.e) AS e FROM c{0} LEFT JOIN m{0} ON m{0}.part = c{0}.part AND m{0}.k = c{0}.k)"""

ORACLES = {
    "op12_vector_codes": f"""
        WITH v AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), width AS (SELECT max(len(q)) // 8 AS step FROM v),
        parts AS MATERIALIZED (SELECT vec_id, label, part, q[part * step + 1:(part + 1) * step] AS s FROM v, width, range(8) r(part)),
        c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, s AS e FROM parts QUALIFY k < 16),
        {",".join(_ROUND.format(i, i + 1, near=_NEAREST.format(i)) for i in range(6))},
        a6 AS ({_NEAREST.format(6)}),
        coded AS (SELECT vec_id, label, string_agg(printf('%02x', near.k), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a6 GROUP BY ALL),
        book AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM c6)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, book
    """,
    "op1_warc": """
        WITH p AS (
          SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
          SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
        ), f AS (
          SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op2_url_filter": f"""
        WITH r AS ({_FITS}), u AS (
          SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), s AS (
          SELECT page_id,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
          FROM u
        ), m AS (
          SELECT s.page_id, r.rule_host || r.rule_path AS rule, r.verdict,
                 row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule_host) DESC, length(r.rule_path) DESC) AS k
          FROM s JOIN r ON ('.' || s.host) LIKE ('%.' || r.rule_host) AND starts_with(s.path, r.rule_path)
        )
        SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
        FROM s LEFT JOIN m ON m.page_id = s.page_id AND m.k = 1
    """,
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), n AS (
          SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v
          WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
            AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), l AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
          AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
        ), reach AS (
          SELECT vec_id AS node, vec_id AS other FROM v
          UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.other
        ), c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
        k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT v.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v LEFT JOIN k ON k.a = v.vec_id JOIN c ON c.node = v.vec_id
    """,
}
