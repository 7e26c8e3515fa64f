"""A Merkle manifest of a table: a root for each group and one over all, and for each row a witness that leads from it to that root."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import slices, staged

HEIGHT = 8
#: A witness is a string of levels: 0 (alone), or 1 (sibling on the left) or 2 (on the right) and the sibling's 32 bytes.
ALONE, LEFT, RIGHT = b"\x00", b"\x01", b"\x02"


def joint(*digests: bytes) -> bytes:
    """The node over some nodes: SHA-256 of their digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class Witnesses:
    """Streaming append of nodes, which keeps a witness for each node under every open subtree.

    Open subtrees stand in a row of falling heights, as the ones of a binary counter. Two of one height become one, and then every witness
    under the left one is extended by the right one's digest, and the other way round.
    """

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, list[int]]] = []
        self.witnesses: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        self.witnesses.append(bytearray())
        right = (0, digest, [len(self.witnesses) - 1])
        while self.open and self.open[-1][0] == right[0]:
            right = self._merged(self.open.pop(), right)
        self.open.append(right)

    def _merged(self, left: tuple[int, bytes, list[int]], right: tuple[int, bytes, list[int]]) -> tuple[int, bytes, list[int]]:
        for i in left[2]:
            self.witnesses[i] += RIGHT + right[1]
        for i in right[2]:
            self.witnesses[i] += LEFT + left[1]
        return left[0] + 1, joint(left[1], right[1]), left[2] + right[2]

    def _lifted(self, tree: tuple[int, bytes, list[int]], height: int) -> tuple[int, bytes, list[int]]:
        for _ in range(height - tree[0]):
            for i in tree[2]:
                self.witnesses[i] += ALONE
            tree = (tree[0] + 1, joint(tree[1]), tree[2])
        return tree

    def close(self, height: int = 0) -> bytes:
        """The root: a last subtree without a sibling goes up alone to the height of the one before it, and the whole to ``height`` at the least."""
        tree = self.open.pop()
        while self.open:
            tree = self._merged(left := self.open.pop(), self._lifted(tree, left[0]))
        return self._lifted(tree, height)[1]


def siblings(witness: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(side, digest) of each level of a witness; a lone level has no digest."""
    at = 0
    while at < len(witness):
        side = witness[at : at + 1]
        yield side, b"" if side == ALONE else witness[at + 1 : at + 33]
        at += 1 if side == ALONE else 33


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness give."""
    for side, other in siblings(witness):
        leaf = joint(leaf) if side == ALONE else joint(other, leaf) if side == LEFT else joint(leaf, other)
    return leaf


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (hex) of fields one after the other: - for null, else length in bytes, a colon and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in text]), 256)


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, a row's place in its ``tree``, and n, the tree's size.

    Rows are dealt in ranges of (tree, order), so that a tree with most of the rows is spread over all tasks; a place is the rank in the
    row's range and the sizes of the tree's ranges before it. Ties keep the order of a number that every row gets first.
    """
    numbered = staged(nodes.withColumn("__row", F.monotonically_increasing_id()))
    by = ["tree", *order, "__row"]
    ranges = staged(numbered.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())).withColumn("__range", F.shiftright("__at", 33))
    sizes = ranges.groupBy("tree", "__range").agg(F.min("__at").alias("first"), F.count("*").alias("size"))
    told = sizes.selectExpr(
        "tree", "__range", "first - coalesce(sum(size) OVER (PARTITION BY tree ORDER BY __range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS zero", "sum(size) OVER (PARTITION BY tree) AS n"
    )
    return ranges.join(told, ["tree", "__range"]).select(*nodes.columns, (F.col("__at") - F.col("zero")).alias("pos"), "n")


def _block(keep: list[str], names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks().sort_by("pos")
        made = Witnesses()
        for digest in block.column("digest").to_pylist():
            made.append(digest)
        n = block.column("n")[0].as_py()
        root = made.close(HEIGHT if n > 1 << HEIGHT else 0)
        first = block.slice(0, 1)
        rows = [pa.concat_arrays([*block.column(c).chunks, pa.nulls(1, block.column(c).type)]) for c in keep]
        both = lambda name, own: pa.concat_arrays([*block.column(name).chunks, pa.array([own], block.column(name).type)])
        here = first.column("block")[0].as_py()
        rows += [both("tree", first.column("tree")[0].as_py()), both("block", here), both("pos", here), both("n", -(-n // (1 << HEIGHT))), both("digest", root)]
        rows.append(pa.array([*map(bytes, made.witnesses), None], pa.binary()))
        return pa.Table.from_arrays(rows, names=names)

    return run


def _appended(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Appends the nodes of each aligned block of 256; gives them back with their witnesses so far, and a row without one for each block's root."""
    kinds = [f for f in nodes.schema.fields if f.name in keep]
    fixed = "tree string, block bigint, pos bigint, n bigint, digest binary, witness binary"
    schema = T.StructType([*sorted(kinds, key=lambda f: keep.index(f.name)), *T._parse_datatype_string(fixed).fields])
    source = nodes.withColumn("block", F.shiftright("pos", HEIGHT)).select(*keep, "tree", "block", "pos", "n", "digest")
    return staged(source.groupBy("tree", "block").applyInArrow(_block(keep, schema.names), schema))


def witnessed(nodes: DataFrame, order: list[str], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keep, tree, block, witness) of each node and (tree, block, more, root) of each block; a node's whole witness is its own and its block's.

    ``nodes`` has tree (string), digest (binary) and the columns to keep and to order by. Tasks append the nodes of aligned blocks; the
    blocks' roots are appended in blocks in turn, until each tree has one. Then what a block's root has gained is handed down to its blocks.
    """
    ship(nodes.sparkSession)
    levels = [_appended(ranked(nodes, order), keep)]
    while (levels[-1].where("witness IS NULL").agg(F.max("n")).first()[0] or 1) > 1:
        levels.append(_appended(levels[-1].where("witness IS NULL").select("tree", "pos", "n", "digest"), []))
    above = levels[-1].where("witness IS NULL").select("tree", "block", F.lit(b"").alias("more"), F.col("digest").alias("root"))
    for level in levels[:0:-1]:
        own = level.where("witness IS NOT NULL").join(above, ["tree", "block"])
        above = staged(own.select("tree", F.col("pos").alias("block"), F.concat("witness", "more").alias("more"), "root"))
    return levels[0].where("witness IS NOT NULL").select(*keep, "tree", "block", "witness"), above


def manifest(leaves: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """(keep, witness, subroot, root): ``leaves`` has group (string), digest (binary), the columns to order by and to keep.

    Leaves of a group are in that order, ties in any; groups are ordered by name, null first. Null groups are one group. The witness leads
    through the group's tree and the tree of the groups' roots. An empty table gives no rows. Only rows of one block meet in a task, and
    what is joined by group alone has a row per block.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit("")).alias("tree")
    own, blocks = witnessed(leaves.select(tree, *dict.fromkeys(["digest", *order, *keep])), order, keep)
    tops = blocks.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest"))
    top, top_blocks = witnessed(tops, ["of"], ["of"])
    whole = top.join(top_blocks, ["tree", "block"]).select(F.col("of").alias("tree"), F.concat("witness", "more").alias("most"), F.col("root").alias("top"))
    above = blocks.join(whole, "tree").select("tree", "block", F.concat("more", "most").alias("more"), F.col("root").alias("subroot"), F.col("top").alias("root"))
    return own.join(above, ["tree", "block"]).select(*keep, F.concat("witness", "more").alias("witness"), "subroot", "root")


def verify(rows: DataFrame, keep: list[str], leaf: str) -> DataFrame:
    """Adds proof_sha256 (of a witness's digests, in hex, from the leaf upwards) and folded_root, from the digest (binary) in ``leaf``."""
    source = rows.select(*keep, leaf, "witness")
    schema = T.StructType([*source.schema.fields[: len(keep)], T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType())])
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                pairs = list(zip(part.column(k).to_pylist(), part.column(k + 1).to_pylist(), strict=True))
                proofs = [hashlib.sha256("".join(d.hex() for _, d in siblings(w)).encode()).hexdigest() for _, w in pairs]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(proofs), pa.array([fold(*p).hex() for p in pairs])], names=schema.names)

    return source.mapInArrow(run, schema)


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, one row per row of ``docs``.

    A leaf is doc_id, source, lang, n_chars and text; other columns are not looked at. Rows of one lang are ordered by doc_id, null first,
    equal ids by their leaf. Where 7 divides crc32(doc_id), the root is folded from a leaf with n_chars + 1; a null n_chars stays, and a
    null id is not tampered with. Repeated rows are leaves of their own; empty and very long texts are hashed whole, by Spark.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars").cast("decimal(20,0)") + 1, F.col("text")]
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    leaves = docs.select(
        F.col("lang").alias("group"), "doc_id", leaf_digest(*fields).alias("leaf"), F.when(chosen, leaf_digest(*more)).alias("other")
    ).select("group", "doc_id", F.unhex("leaf").alias("digest"), F.unhex("leaf").alias("leaf"), F.unhex("other").alias("other"))
    held = manifest(leaves, ["doc_id", "digest"], ["doc_id", "leaf", "other"])
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    told = held.select("doc_id", hexed("leaf"), hexed("subroot"), hexed("root"), F.coalesce("other", "leaf").alias("shown"), "witness")
    return verify(told, ["doc_id", "leaf", "subroot", "root"], "shown").withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE bits AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) AS r(i)),
  f AS (SELECT row_number() OVER () AS u, doc_id, lang, coalesce('=' || lang, '') AS g, n_chars,
               [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS v, CAST(n_chars AS HUGEINT) + 1 AS more,
               xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                               lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 7 = 0 AS chosen
        FROM documents, bits),
  e AS (SELECT *, list_transform(v, lambda x: coalesce(CAST(strlen(x) AS VARCHAR) || ':' || x, '-')) AS p FROM f),
  l AS (SELECT u, doc_id, g, sha256(array_to_string(p, '')) AS leaf,
               CASE WHEN chosen AND n_chars IS NOT NULL THEN sha256(p[1] || p[2] || p[3] || strlen(CAST(more AS VARCHAR)) || ':' || more || p[5]) END AS other FROM e),
  o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
  t AS (SELECT g, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM o
        UNION ALL
        SELECT g, level + 1, pos // 2, sha256(h || coalesce(right_h, '')), (n + 1) // 2
        FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY pos) AS right_h FROM t WHERE n > 1) WHERE pos % 2 = 0),
  s AS (SELECT g, level AS height, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM t WHERE n = 1),
  w AS (SELECT 0 AS level, place AS pos, subroot AS h, count(*) OVER () AS n FROM s
        UNION ALL
        SELECT level + 1, pos // 2, sha256(h || coalesce(right_h, '')), (n + 1) // 2 FROM (SELECT *, lead(h) OVER (ORDER BY pos) AS right_h FROM w WHERE n > 1) WHERE pos % 2 = 0),
  c AS (SELECT h AS root, level AS top FROM w WHERE n = 1),
  steps AS (SELECT u, g, k, (pos >> k) AS here FROM o JOIN s USING (g), LATERAL (SELECT unnest(range(height)) AS k)),
  paths AS (SELECT u, k, CASE WHEN t.h IS NULL THEN 'N' WHEN here % 2 = 1 THEN 'L' || t.h ELSE 'R' || t.h END AS x
            FROM steps LEFT JOIN t ON t.g = steps.g AND t.level = k AND t.pos = xor(here, 1)
            UNION ALL
            SELECT u, 1000 + k, CASE WHEN w.h IS NULL THEN 'N' WHEN (place >> k) % 2 = 1 THEN 'L' || w.h ELSE 'R' || w.h END
            FROM (SELECT u, place, unnest(range(top)) AS k FROM o JOIN s USING (g), c) q LEFT JOIN w ON w.level = k AND w.pos = xor(place >> k, 1)),
  held AS (SELECT o.u, list(x ORDER BY k) FILTER (WHERE x IS NOT NULL) AS path FROM o LEFT JOIN paths ON o.u = paths.u GROUP BY o.u)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x[2:]), '')) AS proof_sha256,
       list_reduce(list_prepend(coalesce(other, leaf), coalesce(path, [])),
                   lambda h, x: CASE x[1] WHEN 'N' THEN sha256(h) WHEN 'L' THEN sha256(x[2:] || h) ELSE sha256(h || x[2:]) END) AS folded_root,
       folded_root = root AS verified
FROM o JOIN s USING (g) JOIN held USING (u), c
"""
