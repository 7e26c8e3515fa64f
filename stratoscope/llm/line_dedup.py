"""Boilerplate lines by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

RATIO = 0.05


def _line_key(line: Column) -> Column:
    """128 bits of a line or a text: two hashes with seeds of their own."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _host(docs: DataFrame, host_col: str) -> Column:
    return F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(""))


def boilerplate_lines(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = 1, copies: bool = True
) -> DataFrame:
    """(host, line key, pages, host_pages) of the lines on more than ``ratio`` of a host's pages, and at least ``min_pages``, if that is wanted.

    A line counts once per page, however often it is repeated there; blank lines never count. Without ``copies``, a host's pages with the
    same text are one page.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    pages = docs.select(_host(docs, host_col).alias("host"), text.alias("t"), _line_key(text).alias("page"))
    own = pages.select("host", "page")
    totals = (own if copies else own.distinct()).groupBy("host").agg(F.count("*").alias("host_pages"))
    lines = pages.select("host", "page", F.explode(F.array_distinct(F.split("t", "\n"))).alias("line")).where(F.trim("line") != "")
    keyed = lines.select("host", "page", _line_key(F.col("line")).alias("key"))
    counted = (keyed if copies else keyed.distinct()).groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return counted.join(totals, "host").where(F.col("pages") > ratio * F.col("host_pages"))


def drop_boilerplate(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = 1, copies: bool = True
) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, and n_lines, n_dropped as bigint.

    Hosts are compared as they are; a null host counts as the host ''. Null text stays null and counts as one empty line.
    Blank lines stay. Rows that repeat another count as pages of their own, unless ``copies`` is false. By the ratio alone, all lines of
    a host with fewer than 1 / ratio pages are boilerplate; ``min_pages`` of 2 leaves those alone that are on one page only.
    Other columns pass through, whatever their names; columns named n_lines or n_dropped are replaced. Very long texts are split like others.
    A host's list of boilerplate lines is at most its mean number of distinct lines a page divided by ``ratio``, whatever its number of pages,
    so it travels as one row per host: broadcast while Spark finds the table small, by a sort-merge join that Spark may
    split beyond that.
    """
    found = staged(
        boilerplate_lines(docs, host_col, text_col, ratio, min_pages, copies)
        .groupBy("host")
        .agg(F.collect_set("key").alias("boilerplate"))
        .select(F.concat("host", F.lit("")).alias("host"), "boilerplate")
    )  # written first, so that its size is known when the join is planned and texts aren't shuffled to meet a small table
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text.alias("t"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"),
        _host(docs, host_col).alias("host")
    )
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("boilerplate"), _line_key(x)))
    )
    cut = rows.join(found, "host", "left").withColumn("kept", kept)
    own = {text_col: F.when(F.col("t").isNotNull(), F.array_join("kept", "\n")).alias(text_col)}
    return cut.select(
        *[own.get(c, F.col(f"row.`{c}`")) for c in names],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_lines, n_dropped and the SHA-256 of the text that stays."""
    return drop_boilerplate(docs).select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Rows with equal (doc_id, source, text) would be one here; the tables have no such rows.
CLEANED = f"""
  pages AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(source, '') AS host, coalesce(text, '') AS t FROM {{docs}}),
  totals AS (SELECT host, count(*) AS host_pages FROM pages GROUP BY host),
  lines AS (SELECT r, doc_id, source, host, generate_subscripts(string_split(t, chr(10)), 1) AS i, unnest(string_split(t, chr(10))) AS line FROM pages),
  boiler AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT r) AS n FROM lines WHERE trim(line) <> '' GROUP BY host, line)
             JOIN totals USING (host) WHERE n > {RATIO} * host_pages),
  cleaned AS (SELECT r, any_value(doc_id) AS doc_id, any_value(source) AS source, count(*) AS n_lines,
                     count(*) FILTER (WHERE b.line IS NOT NULL) AS n_dropped,
                     coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '') AS kept
              FROM lines l LEFT JOIN boiler b ON l.host = b.host AND l.line = b.line GROUP BY r)"""
SQL = f"""WITH {CLEANED.format(docs="documents")}
SELECT doc_id, source, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM cleaned"""
