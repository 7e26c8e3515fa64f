"""A corpus pipeline of five stages: toxicity, line deduplication, near deduplication, decontamination, piece coding.

Each stage takes the rows that its predecessor kept and decides on them: toxic documents go, boilerplate lines are cut out of the text,
one document of each group of near duplicates stays, documents with a benchmark passage go, and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratoscope.llm import decontaminate, line_dedup, minhash_dedup, sentence_pieces, toxicity
from stratoscope.llm.common import staged, table

SHINGLE_WORDS = 5


def whole(docs: DataFrame, *names: str) -> DataFrame:
    """The rows as one column, ``row``, beside the columns that an operator reads: whatever other columns are called, none can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores below 0.5, null and empty texts among them. Rows that repeat another are scored alike; very long texts whole."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(whole(docs, "text"), model, ["row"]).where("score < 0.5").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines, for which copies of a page count once; n_chars follows the text.

    A line that is on one page only is no repetition, however few pages its source has. A null text stays null, with 0 characters; a null
    source is the source ''. Very long texts are cut into lines like others.
    """
    cut = line_dedup.drop_boilerplate(whole(docs, "source", "text"), copies=False, min_pages=2)
    own = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    return cut.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that with the smallest id; rows without words (null, empty and blank texts) stay. Of repeated rows one stays."""
    return minhash_dedup.one_of_each(docs, minhash_dedup.near_groups(docs, size=SHINGLE_WORDS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts have none. Very long texts are scanned whole."""
    return decontaminate.find_benchmark(whole(docs, "text"), table(spark, sf_dir, "benchmark"), ["row"]).where(F.size("found") == 0).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's pieces, and whether they decode to its text; null and empty texts have none. Very long texts are encoded whole."""
    coded = sentence_pieces.encode_pieces(docs.select("doc_id", "lang", "source", "n_chars", F.coalesce("text", F.lit("")).alias("text")))
    slim = coded.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"), "ids")
    back = sentence_pieces.decode_pieces(slim)
    lossless = (F.sha2("decoded", 256) == F.col("text_sha256")).alias("lossless")
    return back.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_ids"), "text_sha256", lossless)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentence pieces", encode),
]

#: Toxicity scores, signatures and pieces can't be had from SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs)
    return docs
