"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rekeyed, staged

PREFIX_CHARS = 256


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays. Repeated rows
    (same id, same text) are counted in group_size and share the verdict; rows whose id is null are only kept when no row
    of their group has an id. An empty table gives no rows; other columns of ``docs`` are not looked at.

    Very long texts are read whole. One scan leaves (id, length, prefix hash, digest) per row, the digest since every row's is asked for.
    Rows are counted by length and prefix hash, in each task first; lengths that one row has drop out, then prefix hashes that one row of
    the length has, and only the rows of those that are left are grouped by their full hash. Both joins, that of the rows with what is
    left and the one back to all rows, are by keys of their own, so that Spark may split a hot group.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = staged(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.octet_length(text).cast("long").alias("n"),
            F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix"),
            F.sha2(text, 256).alias("digest"),
        )
    )
    both = F.concat_ws("/", "n", "prefix").alias("both")
    counted = staged(rows.groupBy("n", "prefix").agg(F.count("*").alias("c")))
    lengths = counted.groupBy("n").agg(F.sum("c").alias("c")).where("c > 1").select(F.bitwise_not("n").alias("length"))
    prefixes = counted.withColumn("length", F.bitwise_not("n")).join(lengths, "length", "left_semi").where("c > 1").select(both)
    left = rows.select("id", "digest", both).join(prefixes, "both", "left_semi")
    found = left.groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("size")).where("size > 1").select(rekeyed("digest").alias("digest"), "keep", "size")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return (
        rows.select("id", "digest")
        .join(found, "digest", "left")
        .select(
            F.col("id").alias(id_col),
            keep.alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            F.col("id").eqNullSafe(keep).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
