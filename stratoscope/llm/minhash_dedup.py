"""Near duplicates: MinHash signatures, joined through an inverted list of (coordinate, value) pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, blank_words, map_text, slices, staged
from .components import components, extended

COORDINATES = 64
#: Of 64 coordinates, pairs of a similarity of 0.8 agree on 51.2 in the mean, 3.2 being the standard deviation; fewer than 38 come about twice in 100,000 such pairs.
LEAST_EQUAL = 38
#: Rounds in which nodes of different components meet a few others of their list before all are tried, and how many sit together.
ROUNDS = 1
TABLE = 4
SHINGLE = 4
PERCENT = 80
#: A list with more nodes than this is not tried in pairs: its nodes meet by the rarest shingles of their full sets.
CROWD = 64
#: Places of the bitmap of a crowded node's shingles.
BITS = 1024
#: Classes of shingles, by hash, whose numbers bound what two sets can share.
CELLS = 128
#: How many of the lowest bits of each coordinate go with a posting.
PLANES = 3
MEMO = 1 << 16

_random = np.random.default_rng(20240229)
MULTIPLIERS = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _random.integers(0, 2**63, COORDINATES, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO:
            self[word] = value
        return value


def shingle_set(text: bytes, words: _WordHash, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words; a shorter text, unless empty, is one shingle."""
    found = blank_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(size, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = out * STEP + h[i : i + n]
    out ^= out >> np.uint64(30)
    out *= MIX[0]
    out ^= out >> np.uint64(27)
    out *= MIX[1]
    out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 64 minima, as 32-bit numbers."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[i : i + 2048, None] * MULTIPLIERS + ADDENDS).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def planes(signatures: np.ndarray) -> np.ndarray:
    """(rows, PLANES): the lowest bits of a signature's 64 numbers, a 64-bit number for each bit. Numbers that are equal are equal in all planes."""
    bits = (signatures.view(np.uint32)[:, None, :] >> np.arange(PLANES, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.int64)[:, :, 0]


def _signatures(size: int) -> Callable[[], Callable[[list[bytes]], list[pa.Array]]]:
    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        words = _WordHash()

        def work(texts: list[bytes]) -> list[pa.Array]:
            sets = [shingle_set(x, words, size) for x in texts]
            digests = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            signs = np.array([signature(s) for s in sets], np.int32).reshape(len(sets), COORDINATES)
            ends = pa.array(np.arange(0, COORDINATES * (len(sets) + 1), COORDINATES, dtype=np.int32))
            low = planes(signs)
            return [
                pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.string()),
                pa.ListArray.from_arrays(ends, pa.array(signs.ravel())), *(pa.array(low[:, k]) for k in range(PLANES))
            ]

        return work

    return make


def _sets(size: int) -> Callable[[], Callable[[list[bytes]], list[pa.Array]]]:
    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        words = _WordHash()

        def work(texts: list[bytes]) -> list[pa.Array]:
            sets = [shingle_set(x, words, size) for x in texts]
            cells = [np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) for s in sets]
            small = [x.astype(np.int8) if x.max() < 128 else None for x in cells]  # null bounds nothing
            return [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(small, pa.list_(pa.int8()))]

        return work

    return make


def _equal(a: Column | str, b: Column | str) -> Column:
    """The number of coordinates on which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _possible(x: str, y: str, percent: int, least_equal: int, cells: bool = True) -> Column:
    """Whether two postings' sets of n shingles, m of which others have too, can be similar enough; whether as many coordinates as
    are asked for can be equal: those whose lowest bits are; and, with ``cells``, whether the numbers of shingles in each allow the similarity."""
    enough = lambda most: F.lit(100) * most >= F.lit(percent) * (F.col(f"n{x}") + F.col(f"n{y}") - most)
    unlike = reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"p{k}{x}").bitwiseXOR(F.col(f"p{k}{y}")) for k in range(PLANES)])
    shared = F.aggregate(F.zip_with(f"cells{x}", f"cells{y}", lambda a, b: F.least(a, b)), F.lit(0), lambda n, v: n + v.cast("int"))
    plain = enough(F.least(f"m{x}", f"m{y}")) & (COORDINATES - F.bit_count(unlike) >= least_equal)
    return plain & F.coalesce(enough(shared), F.lit(True)) if cells else plain


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2):
            sets = [np.frombuffer(x, np.int64) for x in as_bytes(part.column(1))]
            nodes = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(nodes, pa.int64())], names=["x", "node"])


def _unshared(sets: DataFrame) -> DataFrame:
    """(node, alone): how many of a node's shingles no other node of the table has."""
    once = sets.select("node", "s").mapInArrow(_shingle_rows, "x long, node long").groupBy("x").agg(
        F.count("*").alias("c"), F.min("node").alias("node")
    ).where("c = 1")
    return once.groupBy("node").agg(F.count("*").alias("alone"))


def _crowd_pairs(crowd: DataFrame, sets: DataFrame, bounds: list[str], percent: int, least_equal: int) -> DataFrame:
    """Pairs (a, b) of crowd's nodes (node, component, bounds) that can be similar: prefixes of their full sets meet, the components differ.

    All sets are ordered alike, from the shingles that fewest of the crowd have to the commonest. Two sets that share as many as the
    similarity asks for must meet in the first few of the smaller one, n - ceil(2 p n / (100 + p)) + 1, and the first few of the larger one,
    n - ceil(p n / 100) + 1. Shingles that one node alone has come first and meet nothing, so nodes that differ enough in those, as
    texts made from one template do, form no pair at all. Where two meet, what is left of both after that shingle must be enough (which
    holds at the first shingle that similar sets share), and so must what a bitmap of BITS hashes leaves of the smaller set.
    """
    own = sets.join(crowd.select("node"), "node", "left_semi").select("node", "s")
    shingles = own.mapInArrow(_shingle_rows, "x long, node long")
    common = shingles.groupBy("x").agg(F.count("*").alias("df")).where("df > 1").select(F.bitwise_not("x").alias("k"), "df")
    shared = shingles.withColumn("k", F.bitwise_not("x")).join(common, "k").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("l"))
    # The prefix, n - ceil(n q / d) + 1 in whole numbers, less the n - size(l) shingles that no other node has.
    first, second = (F.expr(f"size(l) - (n * {q} + {d - 1}) div {d} + 1") for q, d in ((2 * percent, 100 + percent), (percent, 100)))
    known = staged(shared.join(crowd, "node").join(own.mapInArrow(_bitmaps, "node long, bits array<long>"), "node"))
    held = ["node", "component", *[b for b in bounds if b != "cells"], "bits"]  # the bitmap does for the cells, and compiles

    def post(size: Column) -> DataFrame:
        few = F.slice(F.col("l.x"), F.lit(1), F.least(size, F.size("l")).cast("int"))
        return known.where(size > 0).select(*held, F.col("n") - F.size("l") + 1, F.posexplode(few).alias("i", "x")).toDF(*held, "at", "i", "x").withColumn("at", F.col("at") + F.col("i")).drop("i")

    left, right = post(first), post(second)
    left = left.select("x", *[F.col(c).alias(f"{c}a") for c in (*held, "at")])
    order = (F.col("na") < F.col("n")) | ((F.col("na") == F.col("n")) & (F.col("nodea") < F.col("node")))
    enough = lambda most: F.lit(100 + percent) * most >= F.lit(percent) * (F.col("na") + F.col("n"))
    rest = F.least(F.col("na") - F.col("ata"), F.col("n") - F.col("at")) + 1
    missing = reduce(lambda a, b: a + b, [F.bit_count(F.col("bitsa")[i].bitwiseAND(F.bitwise_not(F.col("bits")[i]))) for i in range(BITS // 64)])
    possible = order & (F.col("componenta") != F.col("component")) & enough(rest) & enough(F.col("na") - missing) & _possible("", "a", percent, least_equal, False)
    met = left.join(right, "x").where(possible)
    return met.select(F.col("nodea").alias("a"), F.col("node").alias("b"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows = np.zeros((part.num_rows, BITS), np.uint8)
            for row, x in zip(rows, as_bytes(part.column(1)), strict=True):
                row[(np.frombuffer(x, np.uint64) >> np.uint64(32)) % np.uint64(BITS)] = 1
            words = np.packbits(rows, axis=1, bitorder="little").view(np.int64)
            ends = pa.array(np.arange(0, words.size + 1, BITS // 64, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(words.ravel()))], names=["node", "bits"])


def _signed(pairs: DataFrame, nodes: DataFrame, least_equal: int) -> DataFrame:
    """The pairs (a, b) of nodes, (node, sig), whose signatures agree on enough coordinates. Signatures travel once for each pair and not with each posting."""
    own = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig{x}"))
    return pairs.join(own("b"), "b").join(own("a"), "a").where(_equal("siga", "sigb") >= least_equal).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets, (node, s), are similar enough."""
    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keep = []
                for x, y in zip(as_bytes(part.column(2)), as_bytes(part.column(3)), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE, least_equal: int = LEAST_EQUAL
) -> DataFrame:
    """Per row: the id, n_shingles, component_id and kept, and text_hash (with the id it names the row's text). Texts are linked whose
    shingle sets have 100 * |both| >= percent * |either|.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows with equal sets, repeated rows among them,
    are one node, so no pair is formed among copies. Rows that repeat an id with different texts are nodes of their own, each with
    its own links. A component's id is its rows' smallest; a null id is one only where no row has another.
    Very long texts are shingled whole. Other columns are not looked at.

    1. One scan gives each row's set size, a 128-bit hash of the set, and its signature; equal sets become one numbered node.
    2. Signatures are posted under (coordinate, value). Values that occur once can't collide; a node must share at least
       ``least_equal`` of its values. Prefix: two nodes that agree on so many must meet in the rarest (shared - least_equal + 1) of
       either's shared values, so only these are posted, and the commonest values never form lists. A posting is
       (value, node, size, the lowest bits of its signature, a byte for each cell of shingles).
    3. Nodes that are posted get their full sets, and the number of shingles that any other posted node has, which bounds what two of
       them can share. Each list joins its smallest node to the others whose bounds and bits allow the similarity; a pair that meets in several
       lists is one pair. Pairs whose signatures agree on enough coordinates are confirmed on the full sets, and linked nodes form components.
    4. Skip: a list that now lies within one component is left out. In the rest, nodes of different components first meet in small
       tables of a list, dealt anew each round, which joins most of what belongs together. Then, in lists of up to CROWD nodes, each node
       outside of the smallest node's component meets every node of another component. Nodes of longer lists meet where prefixes of
       their full sets do (``_crowd_pairs``), which any two that are similar enough must. So no possible link between two components is left
       untried, while a list of near copies, or of texts that are alike but not enough, costs a few rows per node.
    """
    text, key = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`").cast("long")
    source = docs.select(key.alias("id"), F.coalesce(key, F.lit(-(2**63))).alias("i"), F.xxhash64(text).alias("g"), text.alias("t"))
    fields = [
        T.StructField("n", T.LongType()), T.StructField("h", T.StringType()), T.StructField("sig", T.ArrayType(T.IntegerType())),
        *(T.StructField(f"p{k}", T.LongType()) for k in range(PLANES))
    ]
    rows = staged(map_text(source, ["id", "i", "g"], "t", _signatures(size), fields))
    low = [f"p{k}" for k in range(PLANES)]
    first = rows.where("h is not null").groupBy("h").agg(
        F.min("id").alias("id"), F.min(F.struct("i", "g")).alias("own"), *[F.first(c).alias(c) for c in ("n", "sig", *low)]
    )
    nodes = staged(
        first.select("h", "id", "own.i", "own.g", "n", "sig", *low, F.monotonically_increasing_id().alias("node"))
    )  # numbered once: what is written stays

    posted = nodes.select("node", F.posexplode("sig").alias("c", "v")).select(
        "node", (F.shiftleft(F.col("c").cast("long"), 32) + (F.col("v").cast("long") + F.lit(2**31))).alias("token")
    )
    shared = posted.groupBy("token").agg(F.count("*").alias("n_token")).where("n_token > 1").select(F.bitwise_not("token").alias("k"), "n_token")
    own = posted.select("node", "token", F.bitwise_not("token").alias("k")).join(shared, "k")
    prefix = own.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n_token", "token"))).alias("x")).where(F.size("x") >= least_equal)
    chosen = staged(prefix.select("node", F.transform(F.slice("x", F.lit(1), F.size("x") - (least_equal - 1)), lambda y: y.token).alias("tokens")))
    texts = source.join(nodes.join(chosen.select("node"), "node").select("i", "g", "node"), ["i", "g"])
    own_sets = map_text(texts, ["node"], "t", _sets(size), [T.StructField("s", T.BinaryType()), T.StructField("cells", T.ArrayType(T.ByteType()))])
    sets = staged(own_sets.dropDuplicates(["node"]))
    known = staged(nodes.select("node", "sig").join(chosen.select("node"), "node", "left_semi"))
    fit = chosen.join(nodes.select("node", "n", *low), "node").join(_unshared(sets), "node", "left").join(sets.select("node", "cells"), "node")
    bounds = ["n", "m", *low, "cells"]
    post = staged(fit.withColumn("m", F.col("n") - F.coalesce("alone", F.lit(0))).select("node", *bounds, F.explode("tokens").alias("token")))

    heads = post.groupBy("token").agg(F.min_by(F.struct("node", *bounds), "node").alias("y"), F.count("*").alias("c")).where("c > 1")
    heads = heads.select(F.bitwise_not("token").alias("k"), F.col("y.node").alias("a"), *[F.col(f"y.{c}").alias(f"{c}a") for c in bounds])
    met = post.withColumn("k", F.bitwise_not("token")).join(heads, "k").where((F.col("a") < F.col("node")) & _possible("", "a", percent, least_equal))
    fit_pairs = staged(_signed(met.select("a", F.col("node").alias("b")).distinct(), known, least_equal))
    linked = components(_confirmed(fit_pairs, sets, percent))

    for turn in range(ROUNDS + 1):
        named = staged(post.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")))
        open_lists = named.groupBy("token").agg(
            F.min_by("component", "node").alias("head"), F.min("node").alias("first"), F.min("component").alias("low"),
            F.max("component").alias("high"), F.count("*").alias("c")
        )
        open_lists = open_lists.where("low <> high").select(F.bitwise_not("token").alias("k"), "head", "first", "c")
        members = named.withColumn("k", F.bitwise_not("token")).join(open_lists, "k")
        right = ["k", F.col("node").alias("a"), F.col("component").alias("ca"), *[F.col(c).alias(f"{c}a") for c in bounds]]
        other = (F.col("ca") != F.col("component")) & _possible("", "a", percent, least_equal)
        if turn < ROUNDS:
            seat = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("c") / TABLE))
            left = members.select("k", "node", *bounds, "component", seat.alias("seat"))
            more = left.join(left.select("seat", *right), ["k", "seat"]).where((F.col("a") < F.col("node")) & other)
        else:
            members = staged(members)
            few, crowd = members.where(F.col("c") <= CROWD), members.where(F.col("c") > CROWD)
            once = (F.col("component") == F.col("head")) | (F.col("a") < F.col("node"))
            more = few.join(few.where("component <> head").select(*right), "k").where(other & (F.col("node") != F.col("first")) & once)
            if not crowd.isEmpty():
                crowd = crowd.select("node", "component", *[b for b in bounds if b != "cells"]).dropDuplicates(["node"])
                more = more.select("a", "node").union(_crowd_pairs(crowd, sets, bounds, percent, least_equal))
        pairs = staged(_signed(more.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), known, least_equal))
        if pairs.isEmpty():
            continue
        linked = extended(linked, _confirmed(pairs, sets, percent))

    named = nodes.join(linked, "node", "left").select("h", "id", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    verdict = named.select(F.bitwise_not("component").alias("k"), "h").join(smallest.select(F.bitwise_not("component").alias("k"), "component_id"), "k").select(
        F.concat("h", F.lit("")).alias("h"), F.bitwise_not("k").alias("component"), "component_id"
    )
    return rows.select("id", "g", "n", "h").join(verdict, "h", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"),
        F.col("g").alias("text_hash"),
        "component",
    )


def one_of_each(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near_groups: that with the smallest id, a null one last, and the smallest text hash.

    Rows that repeat its id with its text are copies, of which one stays. Rows without words are in no component and all stay.
    """
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))
    found = verdict.where("component is not null").groupBy("component", id_col, "text_hash").agg(F.count("*").alias("times"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col(id_col).isNull().alias("last"), id_col, "text_hash", "times")).alias("x"))
    stays = staged(first.select(F.coalesce(F.col(f"x.{id_col}"), F.lit(-(2**63))).alias("__i"), F.col("x.text_hash").alias("__g"), "x.times"))
    wordless = verdict.where("component is null").select(F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("__i"), F.col("text_hash").alias("__g")).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), key.alias("__i"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("__g"))
    single = rows.join(stays.where("times = 1").select("__i", "__g").union(wordless), ["__i", "__g"], "left_semi")
    copied = rows.join(stays.where("times > 1"), ["__i", "__g"], "left_semi").dropDuplicates(["__i", "__g"])
    return single.union(copied).select("row.*")


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
  posts AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
  pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM posts a JOIN posts b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
             GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
  reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r FROM reach JOIN edges e ON e.a = reach.doc_id WHERE r < e.b)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM sets JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) USING (doc_id)
"""
