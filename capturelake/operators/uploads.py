"""Uploads: content digests and de-duplication against stored files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def dedup_uploads(incoming: DataFrame, stored: DataFrame, keys: Sequence[str] = ("project_id",),
                  content: str = "content", order: str = "upload_id") -> DataFrame:
    """First upload of every new content per project.

    The digest is the shuffle key, so copies collapse before the shuffle and
    the contents themselves stay out of the join.
    """
    keys = list(keys)
    own = [n for n in incoming.columns if n not in (*keys, content)]
    new = incoming.select(*incoming.columns, content_hash(F.col(content)).alias("sha256")).groupBy(*keys, "sha256").agg(
        F.min(F.struct(order, *[n for n in own if n != order])).alias("_f"))
    known = stored.select(*keys, content_hash(F.col(content)).alias("sha256"))
    return new.join(known, [*keys, "sha256"], "left_anti").select(*keys, "sha256", "_f.*")


def upload_summary(incoming: DataFrame, added: DataFrame, stored: DataFrame,
                   keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Uploaded, skipped and total files per project."""
    keys = list(keys)

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    zero = F.lit(0).cast("bigint")
    joined = count(incoming, "_in").join(count(added, "_added"), keys, "left").join(count(stored, "_stored"), keys, "left")
    up = F.coalesce("_added", zero)
    return joined.select(
        *keys, up.alias("uploaded"), (F.col("_in") - up).alias("skipped"),
        (F.coalesce("_stored", zero) + up).alias("total"), (F.coalesce("_stored", zero) == 0).alias("created"))
