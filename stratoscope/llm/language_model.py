"""Language-model scores: the marginal probability of a text over a lattice of words and their pieces."""

from __future__ import annotations

import ctypes
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..shipping import ship
from .common import as_bytes, blank_words, slices, staged
from .lattice import LITERAL, Block, PieceTrie, blocks, expected, forward
from .sentence_pieces import MODEL, SPACE, PieceCoder, coder, read_model

END = b""  # no word is empty
BLANK = re.compile(rb"[\x20\x09-\x0D]")
BLOCK_MB = 32
#: Distinct words at which a chunk ends before BLOCK_MB; 32 MB of running text have about 600,000.
MOST_WORDS = 1 << 20
#: Bytes of a text that are cut into words, and tokens of rows that are looked up, at a time.
STRETCH = 1 << 20
TOKENS = 1 << 18
#: Classes of texts (a power of 2), told apart by the hashed triples of bytes of their whole texts.
CLASSES = 8
CELLS = 128
MOST_ROUNDS = 20
#: Rounds that fit the pieces' weights; the share of a class's probability that always goes to what is shared, that of the shared
#: part which goes to the words of all classes, and the weight of the vocabulary's own scores.
ROUNDS = 3
BACK = 0.13
SHARED = 0.2
PRIOR = 0.05
LONGEST = 4096
LOG10 = math.log(10)


def spelling(word: bytes) -> str:
    return SPACE + word.decode().replace(SPACE, LITERAL)


def stretches(text: bytes) -> Iterator[bytes]:
    """The text in parts of about STRETCH bytes, cut at blanks only."""
    at = 0
    while len(text) - at > STRETCH:
        found = BLANK.search(text, at + STRETCH)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def runs(rows: list, sizes: list[int]) -> Iterator[list]:
    """The rows in runs of up to 1,000 that have about TOKENS tokens at the most; a longer row is a run of its own."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and (i - at == 1000 or total + n > TOKENS):
            yield rows[at:i]
            at, total = i, 0
        total += n
    if at < len(rows):
        yield rows[at:]


def give_back() -> None:
    """Workers outlive their tasks, and what they have freed counts as theirs until it goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def scores_as_weights(own: PieceCoder) -> np.ndarray:
    """The vocabulary's own scores as weights by id. They are ranks (the file is of the BPE kind), and a rank r is given a share that falls as 1 / r."""
    known = np.isfinite(own.scores)
    weights = np.where(known, 1 / (2.7 - np.maximum(np.where(known, own.scores, 0), -1e6)), 0.0)
    weights[[k for k in own.byte_ids if k is not None]] = 1e-6
    return weights


class PieceLattice:
    """P(word) as the sum over all its segmentations: one piece that begins with a blank, any number of pieces without, and a stop.

    The vocabulary's scores weigh the pieces; expected numbers of pieces, where they are known, sharpen these weights.
    """

    def __init__(
        self, trie: PieceTrie, scores: np.ndarray, heads: np.ndarray, byte_ids: list[int | None], seen: np.ndarray | None = None, words: float = 0.0
    ) -> None:
        self.trie = trie
        self.weights = np.full(len(scores), -np.inf)
        seen = np.zeros(len(scores)) if seen is None else seen
        for group, stops in ((heads, None), (~heads, words)):
            mass, total = scores[group].sum(), seen[group].sum() + (stops or 0.0)
            weight = 1.0 + PRIOR * total
            half = 1.0 if stops is None else 0.5
            with np.errstate(divide="ignore"):
                self.weights[group] = np.log((seen[group] + half * weight * scores[group] / (mass or 1.0)) / (total + weight))
            if stops is not None:
                self.stop = math.log((stops + 0.5 * weight) / (total + weight))
        self.byte_logs = np.array([-np.inf if k is None else self.weights[k] for k in byte_ids])

    def bare(self, block: Block) -> np.ndarray:
        """Log weights of the signs that are no piece: the products of their bytes' weights."""
        signs, where = np.unique(block.signs[block.bare], return_inverse=True)
        return np.array([self._bytes(chr(c)) for c in signs])[where]

    def _bytes(self, sign: str) -> float:
        return float(self.byte_logs[list(sign.replace(LITERAL, SPACE).encode())].sum())

    def logs(self, words: list[str]) -> np.ndarray:
        """Log probabilities of spelled words, by the forward recursion in log space."""
        out = np.empty(len(words))
        for block in blocks(self.trie, words, LONGEST):
            out[block.which] = block.ends(forward(block, block.weights(self.weights, self.bare(block))))
        for i, w in enumerate(words):
            if len(w) > LONGEST:
                out[i] = self.streamed(w)
        return out + self.stop

    def streamed(self, text: str) -> float:
        """The same sum for a very long word: of the places before, only as many as the longest piece has signs are kept."""
        alpha = [0.0]
        for e in range(1, len(text) + 1):
            terms = []
            for size in range(1, min(e, self.trie.longest) + 1):
                piece = self.trie.find(text[e - size : e])
                if piece >= 0:
                    terms.append(alpha[-size] + self.weights[piece])
                elif size == 1:
                    terms.append(alpha[-1] + self._bytes(text[e - 1]))
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            del alpha[: -self.trie.longest - 1]
        return alpha[-1]

    def expected(self, words: list[str]) -> np.ndarray:
        """Expected numbers of each piece over the segmentations of all words; very long words count by stretches."""
        cut = words
        if max(map(len, words), default=0) > LONGEST:
            cut = [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]
        out = np.zeros(len(self.weights))
        for block in blocks(self.trie, cut, LONGEST):
            out += expected(block, self.weights, block.weights(self.weights, self.bare(block)))
        return out


def _lattice(own: PieceCoder, seen: np.ndarray | None = None, words: float = 0.0) -> PieceLattice:
    heads = np.array([x[:1] == b" " for x in own.bytes_of])
    heads[[k for k in own.byte_ids if k is not None]] = False
    return PieceLattice(own.trie, scores_as_weights(own), heads, own.byte_ids, seen, words)


def byte_triples(text: bytes) -> np.ndarray:
    """Numbers of the text's byte triples in CELLS hash cells, A-Z lowered; of a long text, STRETCH triples at a time."""
    if len(text) > STRETCH + 2:
        return np.sum([byte_triples(text[k : k + STRETCH + 2]) for k in range(0, len(text) - 2, STRETCH)], axis=0, dtype=np.int32)
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(CELLS, np.int32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    return np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(25), minlength=CELLS).astype(np.int32)


@dataclass(frozen=True)
class TextClasses:
    """A mixture of multinomials over byte triples: the class that a text is most likely of."""

    prior: np.ndarray  # logs
    logs: np.ndarray  # by class, then cell

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.argmax(self.prior + counts @ self.logs.T, axis=1)


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            yield pa.RecordBatch.from_arrays([pa.array([byte_triples(x).tobytes() for x in as_bytes(part.column(0))], pa.binary())], names=["x"])


def _sums(measure: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sum of what is measured on the rows' counts, as (place, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                x = np.frombuffer(b"".join(batch.slice(k, 4096).column(0).to_pylist()), np.int32).reshape(-1, CELLS).astype(float)
                made = measure(x)
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "v"])

    return run


def find_classes(texts: DataFrame, classes: int = CLASSES) -> TextClasses:
    """Fits the classes to all training texts (t). The main axes of the roots of the cells' shares cut them into the first classes, and
    rounds of expectation and maximisation move them until less than 1 in 1,000 weights changes. Each round is a sum over all
    rows, made map-side; to the driver go CELLS numbers for each class, and once the products of the cells."""
    rows = staged(texts.mapInArrow(_triples, "x binary"))

    def total(measure: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        out = np.zeros(size)
        for r in rows.mapInArrow(_sums(measure), "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():
            out[r["place"]] = r["v"]
        return out

    def roots(x: np.ndarray) -> np.ndarray:
        return np.sqrt(x / np.maximum(1, x.sum(axis=1, keepdims=True)))

    def moments(x: np.ndarray) -> np.ndarray:
        h = roots(x[x.any(axis=1)])
        return np.concatenate([[len(h)], h.sum(axis=0), (h.T @ h).ravel()])

    found = total(moments, 1 + CELLS + CELLS**2)
    n = max(1.0, found[0])
    mean = found[1 : 1 + CELLS] / n
    _, axes = np.linalg.eigh(found[1 + CELLS :].reshape(CELLS, CELLS) / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, : int(math.log2(classes))]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])

    def sides(x: np.ndarray) -> np.ndarray:
        return np.eye(classes)[((roots(x) - mean) @ axes > 0) @ (1 << np.arange(axes.shape[1]))]

    def summed(posterior: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def measure(x: np.ndarray) -> np.ndarray:
            x = x[x.any(axis=1)]
            post = posterior(x)
            return np.hstack([post.sum(axis=0)[:, None], post.T @ x]).ravel()

        return total(measure, classes * (1 + CELLS)).reshape(classes, 1 + CELLS)

    now = summed(sides)
    for _ in range(MOST_ROUNDS):
        prior = np.log((now[:, 0] + 1) / (n + classes))
        logs = np.log((now[:, 1:] + 0.5) / (now[:, 1:] + 0.5).sum(axis=1, keepdims=True))

        def posterior(x: np.ndarray, prior: np.ndarray = prior, logs: np.ndarray = logs) -> np.ndarray:
            z = prior + x @ logs.T
            post = np.exp(z - z.max(axis=1, keepdims=True))
            return post / post.sum(axis=1, keepdims=True)

        before, now = now, summed(posterior)
        if np.abs(now[:, 0] - before[:, 0]).sum() < 0.001 * n:
            break
    return TextClasses(prior, logs)


PARTS = "chunk long, cls int, place int, word string, n long, id {id}, held boolean, tokens binary"


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _dictionary(classes: TextClasses, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, held, t) to each chunk's distinct words by class, with their numbers in its training rows, and to its rows as places in that list.

    A chunk is of one task's text: it ends after the row that brings it to BLOCK_MB or to MOST_WORDS distinct words, whichever is first.
    While it grows, its words are kept once for all classes, and its rows as numbers of these, four bytes a token; a place takes three bytes.
    """
    names = [x.split()[0] for x in PARTS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), kind, pa.bool_(), pa.binary()]
    k = len(classes.prior)

    def made(count: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(count, t)) for name, t in zip(names, kinds, strict=True)], names=names)

    def numbers(text: bytes, words: _Places) -> np.ndarray:
        if len(text) > STRETCH:
            made = [np.fromiter(map(words.__getitem__, x), np.uint32, len(x)) for x in map(blank_words, stretches(text))]
            return np.concatenate([*made, np.array([words[END]], np.uint32)])
        tokens = blank_words(text)
        tokens.append(END)
        return np.fromiter(map(words.__getitem__, tokens), np.uint32, len(tokens))

    def listed(chunk: int, words: _Places, rows: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        all_words = pa.array(list(words), pa.binary())
        for c, own in enumerate(rows):
            if not own:
                continue
            there, counts = np.zeros(len(words), bool), np.zeros(len(words), np.int64)
            for part in runs(own, [len(r[2]) for r in own]):
                there[np.concatenate([r[2] for r in part])] = True
                counts += np.bincount(np.concatenate([np.zeros(0, np.uint32), *(r[2] for r in part if not r[1])]), minlength=len(words))
            which = np.flatnonzero(there)
            for at in range(0, len(which), 100_000):
                some = which[at : at + 100_000]
                n = len(some)
                yield made(
                    n, chunk=pa.array([chunk] * n), cls=pa.array([c] * n, pa.int32()), place=pa.array(np.arange(at, at + n), pa.int32()),
                    word=all_words.take(pa.array(some)).cast(pa.string()), n=pa.array(counts[some])
                )
            place = np.zeros(len(words), "<u4")
            place[which] = np.arange(len(which))
            for part in runs(own, [len(r[2]) for r in own]):
                packed = place[np.concatenate([r[2] for r in part])].view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
                ends = np.cumsum([3 * len(r[2]) for r in part]).tolist()
                tokens = [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                n = len(part)
                yield made(
                    n, chunk=pa.array([chunk] * n), cls=pa.array([c] * n, pa.int32()), id=pa.array([r[0] for r in part], kind),
                    held=pa.array([r[1] for r in part]), tokens=pa.array(tokens, pa.binary())
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, words, rows = TaskContext.get().partitionId() << 32, 0, _Places(), [[] for _ in range(k)]
        for batch in batches:
            for part in slices(batch):
                texts = as_bytes(part.column(2))
                of = classes.of(np.array([byte_triples(x) for x in texts])).tolist() if texts else []
                for c, i, held, text in zip(of, part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                    rows[c].append((i, held, numbers(text, words)))
                    size += len(text)
                    if size > BLOCK_MB << 20 or len(words) > MOST_WORDS:
                        yield from listed(chunk, words, rows)
                        chunk, size, words, rows = chunk + 1, 0, _Places(), [[] for _ in range(k)]
                        give_back()
        yield from listed(chunk, words, rows)
        del words, rows
        give_back()

    return run


@dataclass(frozen=True)
class Totals:
    """Of the training tokens: all and distinct ones, the discount, the end's share of the back-off, and the first two and the share of rows by class."""

    tokens: int
    distinct: int
    discount: float
    end: float
    by_class: tuple[int, ...]
    distinct_by_class: tuple[int, ...]

    def logs(self, c: np.ndarray, own: np.ndarray, cls: int, piecewise: np.ndarray, is_end: np.ndarray) -> np.ndarray:
        """log10 of the tokens' probabilities in a class, from their numbers in all and in the class's training rows and their lattices' logs.

        Mixed in log space, so that a very unlikely word keeps its own size.
        """
        d, n, v = self.discount, self.by_class[cls], self.distinct_by_class[cls]
        back = np.where(is_end, math.log(self.end), math.log1p(-self.end) + piecewise)  # words and the end share the back-off
        new = d * self.distinct / self.tokens if self.tokens else 1.0
        with np.errstate(divide="ignore"):
            shared = np.logaddexp(np.log(SHARED * np.maximum(c - d, 0) / max(1, self.tokens)), math.log(1 - SHARED + SHARED * new) + back)
            if not n:
                return shared / LOG10
            found = np.log((1 - BACK) * np.maximum(own - d, 0) / n)
            return np.logaddexp(found, math.log((1 - BACK) * d * v / n + BACK) + shared) / LOG10


def _piece_sums(proto: bytes, seen: np.ndarray | None, words: tuple[float, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's expected numbers of the pieces in the distinct training words of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k = coder(proto), len(words)
        lattices = [_lattice(own, None if seen is None else seen[i], words[i]) for i in range(k)]
        total = np.zeros((k, len(own.bytes_of)))
        for batch in batches:
            spelled = [spelling(w) for w in as_bytes(batch.column(0))]
            for i in range(k):
                there = np.flatnonzero(batch.column(1 + i).to_numpy() > 0)
                if len(there):
                    total[i] += lattices[i].expected([spelled[j] for j in there])
        give_back()
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])], names=["cls", "piece", "v"])

    return run


def _word_logs(proto: bytes, seen: np.ndarray, totals: Totals) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per word and class that needs it: the number in all training rows and log10 of the probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k = coder(proto), len(totals.by_class)
        lattices = [_lattice(own, seen[i], float(max(0, totals.distinct_by_class[i] - 1))) for i in range(k)]
        for batch in batches:
            words = as_bytes(batch.column(0))
            spelled = [spelling(w) for w in words]
            is_end = np.array([w == END for w in words])
            n = np.array([batch.column(1 + i).to_numpy() for i in range(k)])
            c, need = n.sum(axis=0), batch.column(1 + k).to_numpy()
            for i in range(k):
                there = np.flatnonzero((need >> i) & 1)
                if len(there):
                    logs = totals.logs(c[there], n[i, there], i, lattices[i].logs([spelled[j] for j in there]), is_end[there])
                    names = ["word", "cls", "c", "lp"]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(there)), pa.array(np.full(len(there), i), pa.int32()), pa.array(c[there]), pa.array(logs)],
                        names=names
                    )
        give_back()

    return run


def _scorer(totals: Totals, prior: np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.sort_by("of")
        cls, place, counts, logs = (found.column(x).to_numpy() for x in ("cls", "place", "c", "lp"))
        out: list[np.ndarray] = [np.zeros((4, 0))]
        of = rows.column("of").to_numpy()
        sizes = pc.binary_length(rows.column("tokens")).to_numpy() // 3
        for i in np.unique(of).tolist():
            own = np.flatnonzero(cls == i)
            c, lp = np.zeros(len(own), np.int64), np.zeros(len(own))
            c[place[own]], lp[place[own]] = counts[own], logs[own]
            base, there = np.log10((c + 1) / (totals.tokens + totals.distinct + 1)), (c > 0).astype(float)
            at = np.flatnonzero(of == i)
            for part in runs(range(at[0], at[-1] + 1), sizes[at].tolist()):
                texts = rows.column("tokens").slice(part[0], len(part)).to_pylist()
                tokens = np.zeros((sum(map(len, texts)) // 3, 4), np.uint8)
                tokens[:, :3] = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, 3)
                tokens = tokens.view("<u4").ravel()
                n = sizes[part[0] : part[-1] + 1]
                starts = np.cumsum(n) - n  # each row has a token, its end
                sums = [np.add.reduceat(x[tokens], starts) for x in (there, base, lp)]
                out.append(np.array([n, sums[0], sums[1], sums[2] + prior[i] / LOG10]))
        n, known, base, score = np.hstack(out)
        del found, cls, place, counts, logs
        give_back()
        return pa.table(
            {
                "id": rows.column("id"), "held": rows.column("held"), "n_tokens": pa.array(n.astype(np.int64)),
                "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(score)
            }
        )

    return score


@dataclass(frozen=True)
class LanguageModel:
    classes: TextClasses
    totals: Totals
    seen: np.ndarray  # expected numbers of pieces, by class


def _learned(docs: DataFrame, id_col: str, text_col: str, fold: int, folds: int, proto: bytes) -> tuple[DataFrame, DataFrame, LanguageModel]:
    """The rows and words by chunk, the words' numbers by class, and the model."""
    key, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    held = F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    rows = docs.select(key.alias("id"), held.alias("held"), text.alias("t"))
    classes = find_classes(rows.where("not held").select("t"))
    k = len(classes.prior)
    id_type = rows.schema["id"].dataType
    kind = to_arrow_type(id_type)
    parts = staged(rows.mapInArrow(_dictionary(classes, kind), PARTS.format(id=id_type.simpleString())))
    by_class = [F.coalesce(F.sum(F.when(F.col("cls") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(k)]
    need = F.bit_or(F.expr("shiftleft(1L, cls)")).alias("need")
    counted = staged(parts.where("word is not null").groupBy("word").agg(*by_class, need))
    c = sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0"))
    row = counted.select(c.alias("c"), *[f"n{i}" for i in range(k)]).agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2),
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(k)], *[F.count_if(F.col(f"n{i}") > 0) for i in range(k)],
    ).first()
    tokens, distinct, once, twice = row[:4]
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    totals = Totals(tokens, distinct, discount, 1 / (distinct + 2), tuple(row[4 : 4 + k]), tuple(row[4 + k :]))
    words = tuple(float(max(0, v - 1)) for v in totals.distinct_by_class)
    source, seen = counted.where(c > 0).where("word <> ''").select("word", *[f"n{i}" for i in range(k)]), None
    for _ in range(ROUNDS):
        sums = source.mapInArrow(_piece_sums(proto, seen, words), "cls int, piece int, v double").groupBy("cls", "piece").agg(F.sum("v").alias("v")).collect()
        seen = np.zeros((k, len(coder(proto).bytes_of)))
        for r in sums:  # one row per piece of the vocabulary and class at the most
            seen[r["cls"], r["piece"]] = r["v"]
    return parts, counted, LanguageModel(classes, totals, seen)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7, model: str = MODEL) -> DataFrame:
    """Per row: the id, held_out, n_tokens, n_known, train_tokens, base_score and score; the rows with crc32(id as text) mod ``folds``
    equal to ``fold`` are held out and all others are learned from. Null and empty texts are one end token; a null id is never held out;
    rows that repeat an id are scored each by its own text; other columns are not looked at.

    Tokens are blank-cut words with A-Z lowered and one end. A word's lattice has the vocabulary's pieces as edges, weighted by their
    scores and by their expected numbers over all segmentations of the training words (ROUNDS rounds), and the forward recursion in log space sums
    over all segmentations. The words of the training texts are edges of their own beside it, weighted by their discounted numbers, and what the discount takes
    goes to the lattice; the end has a distinct word's share there. So the probabilities of all tokens sum up to no more than 1.
    A text is of one of CLASSES classes, found from its bytes without labels, with weights of its own each. Its score is the log10 probability of its most
    likely class and of its tokens in it: the largest term of the sum over classes, so the scores of all texts sum up to no more than 1 too.

    A chunk of about BLOCK_MB of text is read once, into its distinct words and its rows as places in that list; counts meet by word, with
    a map-side sum; each chunk gets back the numbers and logs of its own words only, so that no worker holds the vocabulary.
    To the driver go totals, the pieces' expected numbers by class, and the classes' weights.
    """
    ship(docs.sparkSession)
    proto = read_model(model)
    parts, counted, learned = _learned(docs, id_col, text_col, fold, folds, proto)
    logs = counted.mapInArrow(_word_logs(proto, learned.seen, learned.totals), "word string, cls int, c long, lp double")
    found = parts.where("word is not null").select("word", "cls", "chunk", "place").join(logs, ["word", "cls"]).select("chunk", "cls", "place", "c", "lp")
    rows = parts.where("tokens is not null").select(F.col("chunk").alias("own"), F.col("cls").alias("of"), "id", "held", "tokens")
    schema = rows.select("id", "held").schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    made = rows.groupBy("own").cogroup(found.groupBy("chunk")).applyInArrow(_scorer(learned.totals, learned.classes.prior), schema)
    return made.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(learned.totals.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
