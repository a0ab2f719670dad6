"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import load
from ..session import drop_scratch, scratch_path
from .archives import arc_to_warc, read_warc, write_arc
from .bpe import round_trip
from .chat_format import rotate_perspectives
from .decontamination import overlaps
from .divergence import audit_sources
from .hard_negatives import hard_negatives
from .html_text import extract_text
from .license_scan import license_labels, scan_licenses
from .packing import pack
from .quality_rules import quality_rules
from .secret_scan import scan_secrets
from .simhash import simhash_components
from .url_filter import judge_urls


def op1_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash_components(load(spark, sf, "documents"))


def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation from the perspective of each participant; masks as start+length."""
    rendered = rotate_perspectives(load(spark, sf, "conversations"))
    mask = F.array_join(F.transform("spans", lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return rendered.select("conv_id", "perspective", "segment", "n_turns", "text", mask.alias("mask"))


def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold passages of benchmark items."""
    return overlaps(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack(load(spark, sf, "documents"))


def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate secrets of all documents with the forest's verdict."""
    found = scan_secrets(load(spark, sf, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("at").alias("word_index"), F.char_length("candidate").alias("length"),
        F.concat(F.substring("candidate", 1, 4), F.lit("...")).alias("preview"), F.sha2("candidate", 256).alias("candidate_sha256"),
        "score", "secret")


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rule and template verdicts of all page URLs."""
    return judge_urls(load(spark, sf, "pages"))


def op7_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Licence phrases and covered licence templates of all documents."""
    return license_labels(scan_licenses(load(spark, sf, "documents"), ["doc_id"]), ["doc_id"])


def op8_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of all pages, laid out."""
    return extract_text(load(spark, sf, "pages"), ["page_id"])


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, line faults and verdicts of all documents."""
    return quality_rules(load(spark, sf, "documents"), ["doc_id"], with_text=False)


def op10_archives(spark: SparkSession, sf: str) -> DataFrame:
    """Pages put into ARC files, converted to WARC, and read back."""
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(load(spark, sf, "pages"), arc, "page_id", "url", "html")
    arc_to_warc(spark, arc, warc)
    drop_scratch(spark, arc)
    return read_warc(spark, warc).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of the sources of each language and the terms that mark them."""
    return audit_sources(load(spark, sf, "documents"))


def op12_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the tokens of all documents, and of the bytes decoded from them."""
    return round_trip(load(spark, sf, "documents"), ["doc_id"])


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of all anchors among all vectors, one vector in seven with another label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(load(spark, sf, "embeddings").withColumn("label", moved))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_url_filter": op6_url_filter,
    "op7_license_scan": op7_license_scan,
    "op8_html_text": op8_html_text,
    "op9_quality_rules": op9_quality_rules,
    "op10_archives": op10_archives,
    "op11_source_divergence": op11_source_divergence,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {
    "op2_chat_format": """
        WITH t AS (
          SELECT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '[\\s<|>]+', '_', 'g') AS speaker,
                 replace(coalesce(text, ''), '<|', '< |') AS words
          FROM conversations
        ), i AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, words) - 1 AS idx FROM t
        ), p AS (
          SELECT DISTINCT conv_id, speaker AS perspective FROM i WHERE speaker <> 'system'
        ), r AS (
          SELECT i.conv_id, perspective, idx // 256 AS segment, idx, speaker = perspective AS own,
                 '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker
                   ELSE 'user name=' || speaker END || chr(10) AS head,
                 words || '<|im_end|>' || chr(10) AS body
          FROM i JOIN p ON i.conv_id = p.conv_id
        ), s AS (
          SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, segment ORDER BY idx) - length(body)
                 AS start
          FROM r
        )
        SELECT conv_id, perspective, CAST(segment AS BIGINT) AS segment, CAST(count(*) AS INTEGER) AS n_turns,
               string_agg(head || body, '' ORDER BY idx) AS text,
               coalesce(string_agg(CAST(start AS BIGINT) || '+' || length(body), ',' ORDER BY idx) FILTER (WHERE own), '') AS mask
        FROM s GROUP BY conv_id, perspective, segment
    """,
    "op10_archives": """
        WITH p AS (
          SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
          FROM pages
        ), f AS (
          SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS least
          FROM p
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> least THEN least END AS refers_to, TRUE AS intact
        FROM f
    """,
    "op11_source_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents
        ), w AS (
          SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), c AS (
          SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs
          FROM (SELECT r, lang, source, term, count(*) AS n FROM w GROUP BY ALL) GROUP BY lang, source, term
        ), k AS (
          SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 30
        ), l AS (
          SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang
        ), g AS (
          SELECT DISTINCT lang, source FROM d
        ), u AS (
          SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total, l.v, l.lang_n
          FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), s AS (
          SELECT lang, source, term, n,
                 CAST(1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS BIGINT) AS p,
                 CAST(1 + (1000000000::HUGEINT * (total + 5)) // (lang_n + 5 * v) AS BIGINT) AS q
          FROM u
        ), f AS (
          SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
          FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), x AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM x QUALIFY part = 'pair' OR rank <= 50
    """,
    "op13_hard_negatives": """
        WITH e AS (
          SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                 [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
          FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3
    """,
}
