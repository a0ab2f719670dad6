"""Upload, log and naming queries over documents, pages and part, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import projects as J
from ..operators import uploads as U
from ..sources import readers
from . import tables as T

c = F.col

# Patterns that occur in the bound texts, in place of a tool's own log lines.
LOG_PATTERNS = {
    "registered": r"(?i)Copyright\D*(\d+)", "points": r"(\d\d+)", "frames": r"(?i)\b(\d+)\b", "num_images": r"\((\d+)\)",
    "too_few": r"(?i)license",
}


def uploads(spark, sf):
    """Documents with a label count as stored, the others as incoming."""
    docs = T.load(spark, sf, "documents").select(
        c("source").alias("project_id"), c("doc_id").alias("upload_id"), c("text").alias("content"), "lang")
    labelled = T.load(spark, sf, "labels").select(c("doc_id").alias("upload_id"))
    return docs.join(labelled, "upload_id", "left_anti"), docs.join(labelled, "upload_id", "left_semi")


UPLOADS_SQL = """
up AS (SELECT source AS project_id, doc_id AS upload_id, sha256(text) AS sha256, lang FROM documents),
incoming AS (SELECT * FROM up WHERE upload_id NOT IN (SELECT doc_id FROM labels)),
stored AS (SELECT * FROM up WHERE upload_id IN (SELECT doc_id FROM labels)),
added AS (SELECT * FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.project_id = i.project_id AND s.sha256 = i.sha256)
  QUALIFY row_number() OVER (PARTITION BY project_id, sha256 ORDER BY upload_id) = 1)"""


def dedup(spark, sf):
    return U.dedup_uploads(*uploads(spark, sf))


def upload_summary(spark, sf):
    incoming, stored = uploads(spark, sf)
    summary = U.upload_summary(incoming, U.dedup_uploads(incoming, stored), stored)
    return summary.withColumns({"action": J.upload_action(c("created")), "reset": c("skipped") > c("uploaded")})


def tool_logs(spark, sf):
    return readers.parse_tool_logs(T.load(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], **LOG_PATTERNS)


def log_tails(spark, sf):
    tail = J.log_tail(c("text"), 4000)
    return T.load(spark, sf, "documents").select("doc_id", F.length(tail).alias("kept"), F.sha2(tail, 256).alias("tail_sha"))


def names(spark, sf):
    parts = T.load(spark, sf, "part").select(
        c("p_partkey").alias("id"), F.when(c("p_partkey") % 4 == 0, "  Caja ").when(
            c("p_partkey") % 4 == 1, F.concat(F.lit("Proyecto-"), c("p_partkey").cast("string"))).when(
            c("p_partkey") % 4 == 2, "proyecto-cafebabe01").otherwise(F.concat(c("p_name"), F.lit("  X"))).alias("name"),
        F.when(c("p_size") % 3 == 0, F.concat(F.lit("out/"), F.translate("p_name", " ", "_"), F.lit("_canonical.glb"))).when(
            c("p_size") % 3 == 1, "final_Modelo").otherwise(F.upper("p_name")).alias("candidate"))
    pid = c("id").cast("string")
    return parts.select(
        "id", J.normalize_name(c("name")).alias("normalized"), J.is_generic_name(c("name"), pid).alias("generic"),
        J.infer_name(c("candidate")).alias("inferred"), J.resolved_name(c("name"), pid, c("candidate")).alias("resolved"))


_CAP = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')".format


def picked(spark, sf):
    pages = T.load(spark, sf, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("label"), "url", "page_id")
    return J.pick_artifact(pages, ["label"], "url", F.lit("en"), "page_id")


QUERIES = {
    "dedup_uploads": dedup,
    "upload_summary": upload_summary,
    "content_hash": lambda s, d: T.load(s, d, "documents").select("doc_id", U.content_hash(c("text")).alias("sha256")),
    "parse_tool_logs": tool_logs,
    "log_tail": log_tails,
    "project_names": names,
    "allowed_suffix": lambda s, d: T.load(s, d, "pages").groupBy(J.allowed_suffix(c("url")).alias("suffix")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(J.allowed_suffix(c("url")).isin(*readers.IMAGE_SUFFIXES)).alias("images")),
    "pick_artifact": picked,
}

ORACLES = {
    "dedup_uploads": f"WITH {UPLOADS_SQL} SELECT * FROM added",
    "upload_summary": f"""WITH {UPLOADS_SQL}, s AS (SELECT project_id, coalesce(a, 0) AS uploaded, i - coalesce(a, 0) AS skipped,
    coalesce(k, 0) + coalesce(a, 0) AS total, coalesce(k, 0) = 0 AS created
  FROM (SELECT project_id, count(*) AS i FROM incoming GROUP BY 1)
  LEFT JOIN (SELECT project_id, count(*) AS a FROM added GROUP BY 1) USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS k FROM stored GROUP BY 1) USING (project_id))
SELECT *, CASE WHEN created THEN 'created' ELSE 'updated' END AS action, skipped > uploaded AS reset FROM s""",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "parse_tool_logs": r"""SELECT doc_id, TRY_CAST(regexp_extract(text, '(?i)Copyright[^0-9]*([0-9]+)', 1) AS BIGINT) AS registered_images,
  TRY_CAST(regexp_extract(text, '([0-9][0-9]+)', 1) AS BIGINT) AS points,
  coalesce(TRY_CAST(regexp_extract(text, '\(([0-9]+)\)', 1) AS BIGINT),
    TRY_CAST(regexp_extract_all(text, '(?i)\b([0-9]+)\b', 1)[-1] AS BIGINT)) AS mapper_registered,
  regexp_matches(text, '(?i)license') AS too_few_registered FROM documents""",
    "log_tail": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, length(right(t, 4000))::INT AS kept, sha256(right(t, 4000)) AS tail_sha FROM t""",
    "project_names": rf"""WITH p AS (SELECT p_partkey AS id,
    CASE p_partkey % 4 WHEN 0 THEN '  Caja ' WHEN 1 THEN 'Proyecto-' || p_partkey WHEN 2 THEN 'proyecto-cafebabe01'
      ELSE p_name || '  X' END AS name,
    CASE p_size % 3 WHEN 0 THEN 'out/' || replace(p_name, ' ', '_') || '_canonical.glb' WHEN 1 THEN 'final_Modelo'
      ELSE upper(p_name) END AS candidate, p_name, p_size FROM part),
q AS (SELECT *, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS normalized, id % 4 <> 3 AS generic,
    CASE WHEN p_size % 3 <> 1 THEN {_CAP('p_name')} END AS inferred FROM p)
SELECT id, normalized, generic, inferred, CASE WHEN generic THEN coalesce(inferred, name) ELSE name END AS resolved FROM q""",
    "allowed_suffix": r"""SELECT lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS suffix, count(*) AS n,
  count(*) FILTER (lower(regexp_extract(url, '(\.[^./]+)$', 1)) IN ('.bmp', '.jpeg', '.jpg', '.png', '.tif', '.tiff', '.webp'))
    AS images FROM pages GROUP BY 1""",
    "pick_artifact": r"""WITH s AS (SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS label, url AS path, page_id AS modified,
    CASE WHEN contains(lower(url), 'en') THEN 100 ELSE 0 END + CASE WHEN contains(lower(url), 'pipeline') THEN 20 ELSE 0 END
    + CASE WHEN contains(lower(url), 'final') OR contains(lower(url), 'result') THEN 10 ELSE 0 END AS score FROM pages)
SELECT label, path, score, modified FROM s
QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, modified DESC, path DESC) = 1""",
}
