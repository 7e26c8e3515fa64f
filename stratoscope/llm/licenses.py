"""License scans: winnowed fingerprints (of short templates, telling words) in an inverted index pick candidates, banded alignment measures them."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import letter_words, map_text
from .license_texts import TEMPLATES

SHINGLE = 3
WINDOW = 2
BAND = 0.15
COVERAGE = 0.8
#: Templates with fewer words than this are found by single words; and words that are too common to be chosen first for that.
SHORT = 20
COMMON = frozenset(b"the this that is are was of and or to in on by for with under work a an you may it not all any as be 0 1 2 3 4".split())
MATCH = T.ArrayType(
    T.StructType(
        [
            T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType())
        ]
    )
)


def winnow(words: list[bytes], size: int = SHINGLE, window: int = WINDOW) -> list[int]:
    """Places of the shingles with the smallest hash of some ``window`` consecutive ones, the last of equal ones."""
    n = len(words) - size + 1
    if n < 1:
        return [0] if words else []
    h = [xxhash.xxh3_64_intdigest(b" ".join(words[i : i + size])) for i in range(n)]
    return sorted({min(range(i, min(n, i + window)), key=lambda j: (h[j], -j)) for i in range(max(1, n - window + 1))})


def telling(words: list[bytes], coverage: float) -> list[int]:
    """Places of so many words that a match which lacks all of them is below the coverage, uncommon and long words first."""
    need = math.ceil(coverage * len(words) - 1e-9)
    return sorted(range(len(words)), key=lambda i: (words[i] in COMMON, -len(words[i]), i))[: len(words) - need + 1]


def align(template: list[bytes], words: list[bytes], shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, start, end) of the best common subsequence that keeps within ``band`` of the diagonal ``shift``.

    Cell (i, d) pairs template word i with text word i + shift + d - band; of as many matches the span that begins latest wins.
    """
    width = 2 * band + 1
    none = (0, 0, 0)
    row = [none] * width  # (matches, start, end) of the best alignment that ends there
    best = none
    better = lambda a, b: a if (a[0], a[1]) >= (b[0], b[1]) else b
    for i, word in enumerate(template):
        now = [none] * width
        for d in range(width):
            j = i + shift + d - band
            cell = row[d + 1] if d + 1 < width else none  # the template's word is skipped
            if d and now[d - 1][0]:
                cell = better(cell, now[d - 1])  # the text's word is skipped
            if 0 <= j < len(words) and words[j] == word:
                before = row[d]
                cell = better((before[0] + 1, before[1] if before[0] else j, j + 1), cell)
            now[d] = cell
            if (cell[0], cell[1] - cell[2]) > (best[0], best[1] - best[2]):
                best = cell
        row = now
    return best


@dataclass(frozen=True)
class LicenseIndex:
    """Templates by name, and the text patterns of their fingerprints with (template, place) postings."""

    templates: dict[str, str]
    coverage: float = COVERAGE
    band: float = BAND

    def machine(self) -> tuple[ahocorasick.Automaton, dict[str, list[bytes]]]:
        words = {k: letter_words(v.encode()) for k, v in self.templates.items()}
        postings: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for name, w in words.items():
            size = 1 if len(w) < SHORT else SHINGLE
            for i in telling(w, self.coverage) if len(w) < SHORT else winnow(w):
                postings[f" {b' '.join(w[i : i + size]).decode('latin-1')} "].append((name, i))
        found = ahocorasick.Automaton()
        for pattern, who in postings.items():
            found.add_word(pattern, (len(pattern), who))
        found.make_automaton()
        return found, words

    def enough(self, template: list[bytes], words: list[bytes]) -> bool:
        """Whether the template's words that are there could make a match."""
        there = set(words)
        return sum(w in there for w in template) >= self.coverage * len(template)

    def scan(self, text: bytes, machine: ahocorasick.Automaton, templates: dict[str, list[bytes]]) -> tuple[int, list[tuple[str, float, int, int]]]:
        """The number of words and the matches (license, coverage, first word, word after the last), spans of one license apart."""
        words = letter_words(text)
        if not words or not len(machine):
            return len(words), []
        line = f" {b' '.join(words).decode('latin-1')} "
        shifts: dict[str, list[int]] = defaultdict(list)
        at = count = 0
        for end, (size, who) in machine.iter(line):
            start = end - size + 1
            count += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
            at = start
            for name, i in who:
                shifts[name].append(count - i)
        found = {name: self.matches(templates[name], words, self.diagonals(templates[name], all_shifts)) for name, all_shifts in shifts.items()}
        return len(words), sorted(((name, n / len(templates[name]), a, b) for name, m in found.items() for n, a, b in m), key=lambda x: (x[2], x[0]))

    def reach(self, template: list[bytes]) -> int:
        return max(2, int(self.band * len(template)))

    def step(self, template: list[bytes]) -> int:
        """Alignments are tried on the multiples of this: every diagonal of short templates, a quarter of the band apart for others."""
        return 1 if len(template) < SHORT else max(1, self.reach(template) // 4)

    def diagonals(self, template: list[bytes], shifts: list[int]) -> list[int]:
        """Every diagonal to try that a match with one of the fingerprints can be around."""
        band, step = self.reach(template), self.step(template)
        return sorted({d * step for s in set(shifts) for d in range(-((band - s) // step), (s + band) // step + 1)})

    def matches(self, template: list[bytes], words: list[bytes], diagonals: list[int]) -> list[tuple[int, int, int]]:
        """(matched words, start, end) of alignments with enough coverage that don't overlap, the fullest and then the tightest first."""
        band, starts, taken = self.reach(template), [], []  # spans that are apart, in the order of their starts
        near = [s for s in diagonals if self.enough(template, words[max(0, s - band) : max(0, s + len(template) + band)])]
        for n, a, b in sorted((align(template, words, s, band) for s in near), key=lambda x: (-x[0], x[2] - x[1], x[1])):
            k = bisect_left(starts, a)
            if n >= self.coverage * len(template) and (not k or taken[k - 1][2] <= a) and (k == len(taken) or b <= starts[k]):
                starts.insert(k, a)
                taken.insert(k, (n, a, b))
        return taken


def scan_licenses(docs: DataFrame, keep: list[str], text_col: str = "text", index: LicenseIndex | None = None) -> DataFrame:
    """The columns in ``keep``, n_words, and matches array<struct<license, coverage, start, end>> with spans in words.

    Null and empty texts have no words and no matches; rows that repeat another are scanned each, and very long texts to their end.
    The index holds the templates that are given, a stated query set, and not data. Templates may be alike: a passage is reported for each that it covers.
    """
    own = index or LicenseIndex(TEMPLATES)

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        machine, templates = own.machine()

        def work(texts: list[bytes]) -> list[pa.Array]:
            made = [own.scan(x, machine, templates) for x in texts]
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
            rows = [[{"license": a, "coverage": b, "start": c, "end": d} for a, b, c, d in m] for _, m in made]
            return [pa.array([n for n, _ in made], pa.int64()), pa.array(rows, kind)]

        return work

    return map_text(docs, keep, text_col, make, [T.StructField("n_words", T.LongType()), T.StructField("matches", MATCH)])


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_matches, licenses (names, sorted, comma-joined), best_coverage, matched_words and the matches."""
    found = scan_licenses(docs, ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)), 6).alias("best_coverage"),
        F.aggregate("matches", F.lit(0).cast("long"), lambda n, m: n + (m.end - m.start).cast("long")).alias("matched_words"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m.license, m.start.cast("string"), m.end.cast("string"))), ";").alias("spans"),
    )
