"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, each text scanned once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLDED, letter_words, map_text, staged

#: A word, as letter_words cuts it once A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WINDOW = 10
#: Nodes of one automaton at the most, in the mean of a hash; about 100 bytes each.
MAX_NODES = 2_000_000
#: Windows of an item that stay together when items are dealt into automata.
SECTION = 10_000
FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("item", T.StringType()),
            T.StructField("from_byte", T.IntegerType()), T.StructField("to_byte", T.IntegerType())
        ]
    )
)


def item_windows(items: list[tuple[str, bytes]], window: int = WINDOW) -> dict[tuple[bytes, ...], list[int]]:
    """From each window's words to the places of the items that have it."""
    found: dict[tuple[bytes, ...], list[int]] = {}
    for k, (_, text) in enumerate(items):
        words = letter_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            who = found.setdefault(tuple(words[i : i + window]), [])
            if not who or who[-1] != k:
                who.append(k)
    return found


class _Scanner:
    """An automaton over the items' windows, whose signs are numbers of words: a window is a node a word."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.names = [x for x, _ in items]
        self.number: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, who in item_windows(items, window).items():
            self.machine.add_word(tuple([self.number.setdefault(w, len(self.number) + 1) for w in words]), (len(words), who))
        self.machine.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str]]]:
        """The number of words, and (start, end, item) of the stretches of words that an item's windows cover."""
        words = letter_words(text)
        if not words or not self.number:
            return len(words), []
        number, hits = self.number, {}
        for end, (n, who) in self.machine.iter(tuple([number.get(w, 0) for w in words])):
            start = end - n + 1
            for k in who:  # windows of an item that follow one another make one stretch
                spans = hits.setdefault(k, [])
                if spans and spans[-1][0] <= start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end + 1)
                else:
                    spans.append([start, end + 1])
        return len(words), sorted((a, b, self.names[k]) for k, spans in hits.items() for a, b in spans)

    def work(self, texts: list[bytes]) -> list[pa.Array]:
        made = [self.scan(x) for x in texts]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string()), ("from_byte", pa.int32()), ("to_byte", pa.int32())]))
        spans = []
        for text, (_, found) in zip(texts, made, strict=True):
            at = original_offsets(text) if found else []
            spans.append([{"start": a, "end": b, "item": k, "from_byte": at[a][0], "to_byte": at[b - 1][1]} for a, b, k in found])
        return [pa.array([n for n, _ in made], pa.int64()), pa.array(spans, kind)]


_scanners: dict[str, _Scanner] = {}


def _scanner(items: list[tuple[str, bytes]], window: int) -> Callable[[], Callable[[list[bytes]], list[pa.Array]]]:
    """One automaton per worker process; that of an earlier part goes when the next is built."""
    digest = hashlib.sha256(repr((window, items)).encode()).hexdigest()

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        if digest not in _scanners:
            _scanners.clear()
            _scanners[digest] = _Scanner(items, window)
        return _scanners[digest].work

    return make


def _sections(items: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """(item, t, nodes): the items' words in stretches of SECTION windows, and how many nodes these are at the most. Items without words have none."""
    small = F.translate(F.coalesce(F.col(f"`{item_text}`"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(small, F.lit(WORD), F.lit(0))
    listed = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window), F.lit(SECTION))
    cut = listed.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, F.lit(SECTION + window - 1)).alias("w"))
    return cut.select(
        "item", F.array_join("w", " ").alias("t"),
        (F.greatest(F.lit(1), F.size("w") - (window - 1)) * F.least(F.size("w"), F.lit(window))).alias("nodes")
    )


def find_benchmark(
    docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, max_nodes: int = MAX_NODES
) -> DataFrame:
    """The columns in ``keep``, n_words, and found: array<struct<start,end,item,from_byte,to_byte>> of the word spans [start, end) that an item
    covers, with their place in the original text's UTF-8.

    A window is ``window`` consecutive words of an item, or the whole item when it has fewer, but not none. Null texts have no
    words; rows that repeat another are scanned each; very long texts are scanned whole. Items that share an id are one item.
    The automaton goes to every worker process, so its nodes are counted first: beyond ``max_nodes`` the items' stretches of windows are dealt by
    a hash into parts under that bound, and the documents are scanned once per part, each pass written before the next.
    """
    listed = _sections(items, item_id, item_text, window)
    size = listed.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("n")).first()["n"]
    parts = 1 if size <= max_nodes else int(2 * size // max_nodes) + 1
    names = [f"__k{i}" for i in range(len(keep))]
    current = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text_col}`").alias("__t"))
    held = list(names)
    for p in range(parts):
        part = listed if parts == 1 else listed.where(F.pmod(F.xxhash64("item", "t"), F.lit(parts)) == p)
        rows = sorted((r["item"], r["t"].encode()) for r in part.select("item", "t").collect())  # of about max_nodes nodes at the most, counted above
        fields = [T.StructField(f"__n{p}", T.LongType()), T.StructField(f"__f{p}", FOUND)]
        more = [*held, "__t"] if p + 1 < parts else held
        current = map_text(current, more, "__t", _scanner(rows, window), fields)
        if p + 1 < parts:
            current = staged(current)
        held += [f"__n{p}", f"__f{p}"]
    found = F.flatten(F.array(*[F.col(f"__f{p}") for p in range(parts)]))
    return current.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("__n0").alias("n_words"), found.alias("found"))


def original_offsets(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of each normalised word in the original UTF-8 text."""
    out, at = [], 0
    folded = text.translate(FOLDED)
    for word in folded.split():
        start = folded.index(word, at)
        at = start + len(word)
        out.append((start, at))
    return out


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_nodes: int = MAX_NODES
) -> DataFrame:
    """Per row of ``docs``: the id, n_words, n_hit, n_items, items_sha256, contaminated, by find_benchmark's rules; a null text has no words."""
    hits = find_benchmark(docs, items, [id_col], text_col, window=window, max_nodes=max_nodes)
    items_of = F.array_sort(F.array_distinct(F.col("found.item")))
    ordered = F.array_sort(F.transform("found", lambda x: F.struct(x.start.alias("a"), x.end.alias("b"))))
    covered = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0), x.b - F.greatest(x.a, acc.upto))).alias("n"), F.greatest(acc.upto, x.b).alias("upto")),
        lambda acc: acc.n.cast("long"),
    )
    return hits.select(
        id_col,
        "n_words",
        covered.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (F.size("found") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
  bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS win
         FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS r(i) WHERE len(w) > 0),
  sizes AS (SELECT DISTINCT n FROM bw),
  dw AS (SELECT doc_id, s.n, i, array_to_string(w[i : i + s.n - 1], ' ') AS win
         FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), sizes s WHERE i + s.n - 1 <= len(w)),
  hits AS (SELECT doc_id, i, bw.n AS n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
  words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
  found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
