"""Fill-in-middle: texts cut at two random units, their parts put in another order behind sentinels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import as_bytes, slices

BLOCK = 4096
#: Kinds of bytes: 0 goes on with a code point, 1 is a letter A-Z or a-z, 2 begins any other code point.
KIND = np.array([0 if b & 0xC0 == 0x80 else 1 if chr(b).isalpha() and b < 128 else 2 for b in range(256)], np.uint8)


class BlockIndex:
    """A text's units ([A-Za-z]+ or one other code point) and code points, counted by blocks of fixed bytes in a Fenwick tree.

    A unit belongs to the block in which it begins. The tree holds two sums, so that a descent by units also gives the code points before
    the block; what is left is found inside that block alone.
    """

    def __init__(self, text: bytes, block: int = BLOCK):
        self.data, self.block = np.frombuffer(text, np.uint8), block
        self.blocks = -(-len(text) // block)
        self.units, self.points = [0] * (self.blocks + 1), [0] * (self.blocks + 1)
        self.n = self.n_points = 0
        for i in range(1, self.blocks + 1):
            starts, kind = self._starts(i - 1)
            units, points = int(np.count_nonzero(starts)), int(np.count_nonzero(kind))
            self.n += units
            self.n_points += points
            self.units[i] += units
            self.points[i] += points
            above = i + (i & -i)
            if above <= self.blocks:
                self.units[above] += self.units[i]
                self.points[above] += self.points[i]

    def _starts(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes of a block begin a unit, and the bytes' kinds."""
        at = block * self.block
        kind = KIND[self.data[at : at + self.block]]
        before = np.empty_like(kind)
        before[1:] = kind[:-1]
        before[0] = KIND[self.data[at - 1]] if at else 0
        return (kind == 2) | ((kind == 1) & (before != 1)), kind

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points before unit k, 0 to n."""
        if k >= self.n:
            return len(self.data), self.n_points
        block = points = 0
        step = 1 << self.blocks.bit_length()
        while step := step >> 1:
            if block + step <= self.blocks and self.units[block + step] <= k:
                block += step
                k -= self.units[block]
                points += self.points[block]
        starts, kind = self._starts(block)
        inside = int(np.flatnonzero(starts)[k])
        return block * self.block + inside, points + int(np.count_nonzero(kind[:inside]))


@dataclass(frozen=True)
class FimFormat:
    """The sentinels, how many of a hundred texts are cut, and how many of these have the suffix first.

    A sentinel holds its first sign only once, and all begin with the same, so that none can arise where a part meets a sentinel.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 90
    spm_rate: int = 20
    seed: int = 1

    def __post_init__(self) -> None:
        first = self.prefix[:1]
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(not m.startswith(first) or m.count(first) != 1 or len(m) < 2 for m in marks):
            raise ValueError("sentinels must differ and begin with one sign that they hold only once")
        if any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("no sentinel may begin another")

    def draws(self, key: Column) -> Column:
        """Four draws of 32 bits from the seed and a row's key."""
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
        return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", fmt: FimFormat | None = None) -> DataFrame:
    """The columns in ``keep`` and n (units), form, prefix_chars, middle_chars and output, one row per row.

    The draws follow from the id alone, so a row that is computed again, or repeated, is cut at the same places. Null texts count as empty;
    an empty text, or one with a sentinel in it, stays plain, with null lengths. A null id draws as an empty one. Texts are whole, however
    long: a very long one costs two counters for each block of 4,096 bytes. An empty table gives no rows; other columns are not looked at.
    """
    f = fmt or FimFormat()
    source = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"), f.draws(F.col(f"`{id_col}`")).alias("__draws")
    )
    k = len(keep)
    schema = T.StructType([
        *source.schema.fields[:k],
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ])
    marks = tuple(m.encode() for m in (f.prefix, f.suffix, f.middle))
    ship(docs.sparkSession)

    def one(text: bytes, draws: list[int]) -> tuple:
        index = BlockIndex(text)
        if not text or any(m in text for m in marks) or draws[2] % 100 >= f.rate:
            return index.n, "plain", None, None, text
        a, b = sorted(d % (index.n + 1) for d in draws[:2])
        (at, before), (to, until) = index.cut(a), index.cut(b)
        start, mid, end = text[:at], text[at:to], text[to:]
        p, s, m = marks
        spm = draws[3] % 100 < f.spm_rate
        return index.n, "spm" if spm else "psm", before, until - before, b"".join((s, end, p, start, m, mid) if spm else (p, start, s, end, m, mid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = [one(t, d) for t, d in zip(as_bytes(part.column(k)), part.column(k + 1).to_pylist(), strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                own = [pa.array([x[i] for x in made], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *own[:4], own[4].cast(pa.string())], names=schema.names)
                pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


def restored(output: Column, form: Column, fmt: FimFormat | None = None) -> Column:
    """The text, from an output and its form alone."""
    f = fmt or FimFormat()

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one, three = F.substring_index(body, second, 1), F.substring_index(body, f.middle, -1)
        return one, F.substr(body, F.length(one) + len(second) + 1, F.length(body) - F.length(one) - F.length(three) - len(second) - len(f.middle)), three

    start, end, mid = parts(f.prefix, f.suffix)
    end_s, start_s, mid_s = parts(f.suffix, f.prefix)
    return F.when(form == "psm", F.concat(start, mid, end)).when(form == "spm", F.concat(start_s, mid_s, end_s)).otherwise(output)


def fim_report(docs: DataFrame) -> DataFrame:
    """Digests of the outputs and of the texts restored from them, one row per row of ``docs``; see ``fill_in_middle`` for odd input."""
    made = fill_in_middle(docs, ["doc_id"])
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
               CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
  c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM u),
  p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || x || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
