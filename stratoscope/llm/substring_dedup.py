"""Removal of repeated 100-byte strings, found through winnowed anchors that all copies of a string share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import discard, shared_path, ship
from .anchors import LENGTH, ByteHashes, runs
from .common import as_bytes, slices, staged

#: Anchors with more different surroundings than this are compared through a shuffle by string, others inside one bucket.
CROWD = 256
BUCKET_ROWS = 20_000
RUN = "id long, g long, p long, n int, h long, s long"
PIECE = "hot boolean, a long, b long, id long, g long, p long, span binary"


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2):
            made = [runs(x) for x in as_bytes(part.column(2))]
            counts = [len(r[0]) for r in made]
            ids, texts = (np.repeat(part.column(k).to_numpy(zero_copy_only=False), counts) for k in (0, 1))
            p, n, h, s = (np.concatenate([r[k] for r in made]) if made else np.zeros(0, np.uint64) for k in range(4))
            columns = [pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(p, pa.int64()), pa.array(n, pa.int32()), _long(h), _long(s)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "g", "p", "n", "h", "s"])


def _emit_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2):
            made = [runs(x)[2] for x in as_bytes(part.column(0))]
            values, counts = np.unique(np.concatenate(made) if made else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([_long(values), pa.array(counts, pa.int64())], names=["h", "c"])


def _strings(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every string of LENGTH bytes in the spans: which span, where in it, and two hashes."""
    whole = np.frombuffer(b"".join(spans), np.uint8)
    sizes = np.array([len(x) for x in spans])
    counts = sizes - LENGTH + 1
    which = np.repeat(np.arange(len(spans)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(sizes) - sizes)[which] + inside
    return which, inside, ByteHashes(whole, 0).of(at, LENGTH), ByteHashes(whole, 1).of(at, LENGTH)


def _emit_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, g, text, edges) to the edges' stretches of text, or to their strings' hashes where the anchor is crowded."""
    names = [x.split()[0] for x in PIECE.split(", ")]
    for batch in batches:
        for part in slices(batch, 2):
            hot, cold = [], []
            columns = (part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), part.column(3).to_pylist())
            for i, g, text, edges in zip(*columns, strict=True):
                for e in edges:
                    (hot if e["hot"] else cold).append((e["h"], i, g, e["p"], text[e["p"] : e["p"] + e["n"]]))
            if cold:
                n = len(cold)
                *longs, spans = zip(*cold, strict=True)
                a, *where = (pa.array(x, pa.int64()) for x in longs)
                yield pa.RecordBatch.from_arrays([pa.array([False] * n), a, pa.array([0] * n, pa.int64()), *where, pa.array(spans, pa.binary())], names=names)
            if hot:
                _, ids, texts, p, spans = zip(*hot, strict=True)
                which, inside, x, y = _strings(list(spans))
                n = len(which)
                where = [pa.array(np.array(v, np.int64)[which] + k) for v, k in ((ids, 0), (texts, 0), (p, inside))]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), _long(x), _long(y), *where, pa.nulls(n, pa.binary())], names=names)


def _joined(ids: np.ndarray, texts: np.ndarray, places: np.ndarray) -> pa.Table:
    """Stretches (id, g, p, n) of strings that begin at these places, neighbours in one."""
    order = np.lexsort((places, texts, ids))
    ids, texts, places = ids[order], texts[order], places[order]
    first = np.r_[True, (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]) | (places[1:] > places[:-1] + 1)] if len(ids) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    sizes = places[np.r_[starts[1:], len(ids)] - 1] - places[starts] + LENGTH if len(ids) else starts
    return pa.table(
        {
            "id": pa.array(ids[starts], pa.int64()), "g": pa.array(texts[starts], pa.int64()), "p": pa.array(places[starts], pa.int64()),
            "n": pa.array(sizes, pa.int64())
        }
    )


def _bucket(table: pa.Table) -> pa.Table:
    """All strings of a bucket's stretches but the first of each, by id, text and place. Rows that repeat an id with its text have one place."""
    which, inside, x, y = _strings(table.column("span").to_pylist())
    ids, texts, places = (table.column(c).to_numpy()[which] for c in ("id", "g", "p"))
    places = places + inside
    order = np.lexsort((places, texts, ids, y, x))
    x, y, ids, texts, places = x[order], y[order], ids[order], texts[order], places[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = (ids != ids[first]) | (texts != texts[first]) | (places != places[first])
    return _joined(ids[again], texts[again], places[again])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    for batch in batches:
        for part in slices(batch, 4):
            made = []
            for text, spans in zip(as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                out, at, removed, n = [], 0, 0, 0
                for p, size in sorted((s["p"], s["n"]) for s in spans or ()):
                    if p > at or not n:
                        out.append(text[at:p])
                        n += 1
                        at = p
                    removed += max(0, p + size - at)
                    at = max(at, p + size)
                kept = b"".join([*out, text[at:]])
                made.append((len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*made, strict=True)) if made else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["own", *names])


def _flipped(x: str) -> Column:
    """Another name for a bigint key, so that a join on it shuffles both sides and can be split where a key is hot."""
    return F.bitwise_not(F.col(x))


def _but_first(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows that are not the first of their group. Joined by place, which no two texts' rows share, so that a hot group is dealt over all tasks."""
    return rows.join(firsts.select("f.id", "f.g", "f.p"), ["id", "g", "p"], "left_anti")


def repeated_stretches(source: DataFrame) -> DataFrame:
    """(id, g, spans): byte stretches to remove, as _merged gives them. source: (id, g, t), of which (id, g) names a text.

    1. Each string of LENGTH bytes has one anchor, its smallest-hashed gram; consecutive strings with one anchor form a run.
       Hashes of anchors are counted, with a sum in each task first. A string whose anchor occurs once has no copy.
    2. Runs whose anchor recurs are compared whole, by hash: but for the first, equal runs go.
    3. Of the different runs around an anchor, the first of each is compared string by string: in buckets by anchor, or, where an
       anchor has more than CROWD surroundings, through an aggregate over the strings' hashes, which no hot anchor unbalances.

    Each step is staged by itself and what it no longer needs is discarded, so that one step's shuffle files are on disk at a time.
    """
    spark = source.sparkSession
    again_at, first_at, gone_at, pieces_at, spans_at = (shared_path(spark) for _ in range(5))
    counts = source.select("t").mapInArrow(_emit_hashes, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    often = counts.select(_flipped("h").alias("k"))
    runs_of = source.select("id", "g", "t").mapInArrow(_emit_runs, RUN).select("id", "g", "p", "n", _flipped("h").alias("k"), "s")
    again = staged(runs_of.join(often, "k", "left_semi").select("id", "g", "p", "n", _flipped("k").alias("h"), "s"), again_at)
    first = staged(again.groupBy("h", "s").agg(F.min(F.struct("id", "g", "p")).alias("f"), F.first("n").alias("n")), first_at)
    gone = staged(_but_first(again.select("id", "g", "p", F.col("n").cast("long").alias("n")), first), gone_at)
    discard(spark, again_at)

    around = first.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select(_flipped("h").alias("k"), (F.col("m") > CROWD).alias("hot"))
    edges = first.select("f", "n", _flipped("h").alias("k")).join(around, "k").select(
        "f.id", "f.g", F.struct("hot", _flipped("k").alias("h"), F.col("f.p").alias("p"), "n").alias("e")
    )
    per_doc = edges.groupBy("id", "g").agg(F.collect_list("e").alias("edges"))  # at most one for each run of the document
    pieces = staged(source.join(per_doc, ["id", "g"]).select("id", "g", "t", "edges").mapInArrow(_emit_pieces, PIECE), pieces_at)
    discard(spark, first_at)

    cold = pieces.where("not hot")
    buckets = cold.count() // BUCKET_ROWS + 1
    in_buckets = cold.select(
        F.pmod("a", F.lit(buckets)).alias("bucket"), "id", "g", "p", "span"
    ).groupBy("bucket").applyInArrow(_bucket, "id long, g long, p long, n long")
    hot = pieces.where("hot").select("a", "b", "id", "g", "p")
    seen = hot.groupBy("a", "b").agg(F.min(F.struct("id", "g", "p")).alias("f"))
    strings = _but_first(hot.select("id", "g", "p", F.lit(LENGTH).cast("long").alias("n")), seen)
    spans = staged(_merged(gone.union(in_buckets).union(strings)), spans_at)
    discard(spark, gone_at, pieces_at)
    return spans


def _merged(stretches: DataFrame) -> DataFrame:
    """(id, g, spans): each text's stretches, overlapping and touching ones in one, so that what is collected is what was removed and not a row per byte."""
    by_place = Window.partitionBy("id", "g").orderBy("p")
    before = F.max(F.col("p") + F.col("n")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    marked = stretches.withColumn("new", (before.isNull() | (F.col("p") > before)).cast("int")).withColumn(
        "k", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    )
    joined = marked.groupBy("id", "g", "k").agg(F.min("p").alias("p"), (F.max(F.col("p") + F.col("n")) - F.min("p")).alias("n"))
    return joined.groupBy("id", "g").agg(F.collect_list(F.struct("p", "n")).alias("spans"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text (binary; a cut may fall inside a character).

    Null counts as empty. A byte goes if a string of LENGTH bytes over it also begins earlier: at a smaller id, or at an earlier place
    of the same text. Rows that repeat an id with its text count as one document and lose the same bytes; rows that repeat an id
    with different texts are different documents, in the order of the texts' hashes; a null id comes before all others.
    Very long texts are hashed in parts and compared by runs, so no step holds more than a few copies of one text. Other columns are not looked at.
    """
    ship(docs.sparkSession)
    text, key = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`")
    source = docs.select(key.alias("own"), F.coalesce(key.cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("g"), text.alias("t"))
    spans = repeated_stretches(source)
    kind = source.schema["own"].dataType.simpleString()
    made = source.join(spans, ["id", "g"], "left").select("own", "t", "spans").mapInArrow(
        _cut, f"own {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"
    )
    return made.select(F.col("own").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def repeat_report(docs: DataFrame) -> DataFrame:
    return cut_repeats(docs).drop("kept_text")
