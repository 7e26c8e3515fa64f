"""Text quality: random-indexing word vectors of all texts, pooled per document, and a small calibrated network over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import as_bytes, map_text, slices, staged

SAMPLE = 20_000
BITS = 14
DIMS = 64
NONZERO = 4
SLAB = 64
CHUNK = 1 << 19
HIDDEN = 16
#: Kinds of bytes: blank, letter (all beyond ASCII too), digit, sign.
BLANK, LETTER, DIGIT, SIGN = range(4)
KIND = np.array([BLANK if b <= 32 else LETTER if chr(b).isalpha() or b >= 128 else DIGIT if 48 <= b < 58 else SIGN for b in range(256)], np.uint8)
POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
AGAIN = 0


@dataclass
class Tokens:
    """Words of a stretch of joined texts: bucket and text number of each; the first ``old`` were given before and only stand beside the next."""

    bucket: np.ndarray
    doc: np.ndarray
    old: int


def tokens(texts: list[bytes], bits: int = BITS, chunk: int = CHUNK) -> Iterator[Tokens]:
    """The words of texts, in stretches of about ``chunk`` bytes that end at a blank.

    A word is a run of letters (A-Z, a-z and all beyond ASCII), of digits (each read as 0) or of other signs. Its bucket is a hash
    of it, of a word of letters that is also one of the two before it in its text ``AGAIN``.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    keys, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    buckets = np.zeros(0, np.int64)
    at = 0
    while at < len(data):
        end = min(at + chunk, len(data))
        while end < len(data) and not (blank := np.flatnonzero(data[end : end + chunk] <= 32)).size:
            end = min(end + chunk, len(data))
        if end < len(data):
            end += int(blank[0])
        part = data[at:end]
        kind = KIND[part]
        change = np.ones(len(part), bool)
        change[1:] = kind[1:] != kind[:-1]
        first = np.flatnonzero(change & (kind != BLANK))
        if first.size:
            place = np.arange(len(part), dtype=np.int32)
            place -= np.maximum.accumulate(np.where(change, place, 0))
            sign = np.where(kind == DIGIT, 48, part).astype(np.uint64) + np.uint64(1)
            sign *= POWERS[place & 4095]
            sign[kind == BLANK] = 0
            key = np.add.reduceat(sign, first)
            doc = np.searchsorted(starts, first + at, side="right") - 1
            letters = kind[first] == LETTER
            old = len(keys)
            key, doc = np.concatenate([keys, key]), np.concatenate([docs, doc])
            bucket = (((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)
            bucket = np.maximum(bucket, AGAIN + 1)
            same = np.zeros(len(key), bool)
            for d in (1, 2):
                same[d:] |= (key[d:] == key[:-d]) & (doc[d:] == doc[:-d])
            bucket[old:][same[old:] & letters] = AGAIN
            bucket[:old] = buckets
            yield Tokens(bucket, doc, old)
            keys, docs, buckets = key[-2:], doc[-2:], bucket[-2:]
        at = end


def index_vectors(bits: int = BITS, dims: int = DIMS, nonzero: int = NONZERO, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's sparse random vector."""
    rng = np.random.default_rng(seed)
    places = rng.random((1 << bits, dims)).argpartition(nonzero, axis=1)[:, :nonzero]
    return places.astype(np.int64), rng.choice(np.array([-1.0, 1.0]), (1 << bits, nonzero))


def contexts(stream: Iterator[Tokens], total: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds to each bucket's row the index vectors of the words one and two places from it in the same text."""
    flat, dims = total.reshape(-1), total.shape[1]
    for t in stream:
        pairs = []
        for d in (1, 2):
            a = np.arange(max(t.old, d), len(t.bucket)) - d
            a = a[t.doc[a] == t.doc[a + d]]
            left, right = t.bucket[a], t.bucket[a + d]
            pairs += [(left, right), (right, left)]
        word, near = (np.concatenate(x) for x in zip(*pairs, strict=True))
        spots = (word * dims)[:, None] + places[near]
        flat += np.bincount(spots.reshape(-1), signs[near].reshape(-1), len(flat)).astype(np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text", bits: int = BITS, dims: int = DIMS) -> np.ndarray:
    """The context vectors of 2 ** bits buckets, summed over all texts and brought to length 1 (float32).

    Each task sums its texts' vectors; the sums are dealt by slabs of 64 buckets and added up as they come. To the driver comes one table of
    2 ** bits x dims numbers, whatever the input's size.
    """
    n, per = 1 << bits, min(SLAB, 1 << bits)
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(bits, dims)
        total = np.zeros((n, dims), np.int64)
        for batch in batches:
            for part in slices(batch):
                contexts(tokens(as_bytes(part.column(0)), bits), total, places, signs)
        slabs = [i for i in range(n // per) if total[i * per : (i + 1) * per].any()]
        for i in range(0, len(slabs), 16):
            few = slabs[i : i + 16]
            yield pa.RecordBatch.from_arrays([pa.array(few, pa.int32()), pa.array([total[s * per : (s + 1) * per].tobytes() for s in few], pa.binary())], names=["slab", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(part, np.int64)
                if slab in sums:
                    sums[slab] += own
                else:
                    sums[slab] = own.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slab", "sums"])

    kinds = "slab int, sums binary"
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    found = np.zeros((n, dims))
    for row in texts.mapInArrow(count, kinds).repartition("slab").mapInArrow(add, kinds).collect():  # 2 ** bits x dims numbers
        found[row["slab"] * per : (row["slab"] + 1) * per] = np.frombuffer(row["sums"], np.int64).reshape(per, dims)
    length = np.linalg.norm(found, axis=1, keepdims=True)
    return (found / np.maximum(length, 1e-12)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """The mean of the words' vectors for each text; zeros for a text without words."""
    n = len(texts)
    sums, count = np.zeros((n, vectors.shape[1])), np.zeros(n)
    for t in tokens(texts, int(vectors.shape[0]).bit_length() - 1):
        bucket, doc = t.bucket[t.old :], t.doc[t.old :]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        sums[doc[first]] += np.add.reduceat(vectors[bucket], first, axis=0)
        count += np.bincount(doc, minlength=n)
    return sums / np.maximum(count, 1)[:, None]


@dataclass(frozen=True)
class Network:
    """Two layers over scaled features, with a temperature on the outcome."""

    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.first + self.first_bias) @ self.second + self.second_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, steps: int = 400, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> Network:
    """Full-batch training by Adam on cross-entropy with weight decay; rows in one order give one network."""
    rng = np.random.default_rng(seed)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(np.log(share / (1 - share)))]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, steps + 1):
        h = np.tanh(z @ w[0] + w[1])
        off = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y) / len(y)
        back = np.outer(off, w[2]) * (1 - h * h)
        grads = [z.T @ back + decay * w[0], back.sum(0), h.T @ off + decay * w[2], off.sum()]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(centre, scale, w[0], w[1], w[2], float(w[3]))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature, 0.25 to 20, with the least cross-entropy on rows that were not trained on."""
    tried = np.exp(np.linspace(np.log(0.25), np.log(20), 400))
    z = logits[None, :] / tried[:, None]
    return float(tried[(np.logaddexp(0, z) - z * y).mean(1).argmin()])


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray = field(repr=False)
    network: Network | None
    share: float  # the score of every text where there is no network

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share) if self.network is None else self.network.scores(pooled(texts, self.vectors))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, folds: int = 3) -> QualityModel:
    """Word vectors of all texts; the network from labelled rows whose crc32(id as text) mod ``folds`` is not 1, of which about ``most`` are taken.

    That bound holds for the labelled rows alone (by a hash of the id; all of them where there are fewer). Copies of a text count once, with
    the label of at least half of them. A fifth of the sample, by the text's digest, is kept from training and sets the temperature. Without
    labelled rows of both kinds the share of good rows, or 0.5, is every text's score. Null texts count as empty, null labels as none; of several
    labels of an id the highest counts; other columns are not looked at. To the driver come the vectors' table and DIMS numbers a row of the sample.
    """
    vectors = word_vectors(docs, text_col)
    own = labels.where(F.col("quality").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max("quality").cast("int").alias("y"))
    own = own.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds)) != 1)
    n = own.count()
    if n > most:
        own = own.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    rows = source.join(F.broadcast(own), "id").select("y", F.sha2("t", 256).alias("digest"), "t")  # about ``most`` rows of a bigint and an int

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        return lambda texts: [pa.array(list(pooled(texts, vectors)), pa.list_(pa.float64()))]

    made = staged(map_text(rows, ["y", "digest"], "t", make, [T.StructField("x", T.ArrayType(T.DoubleType()))]))
    found = made.groupBy("digest").agg((F.avg("y") >= 0.5).cast("int").alias("y"), F.first("x").alias("x")).collect()  # of the sample
    found.sort(key=lambda r: r["digest"])
    y = np.array([r["y"] for r in found], float)
    if not len(y) or y.min() == y.max():
        return QualityModel(vectors, None, float(y.mean()) if len(y) else 0.5)
    x = np.array([r["x"] for r in found])
    kept = np.array([int(r["digest"][:8], 16) % 5 == 0 for r in found])
    if not 0 < kept.sum() < len(y) or y[~kept].min() == y[~kept].max():
        kept[:] = False
    made_of = train(x[~kept], y[~kept])
    heat = temperature(made_of.logits(x[kept]), y[kept]) if kept.any() else 1.0
    return QualityModel(vectors, Network(**{**made_of.__dict__, "temperature": heat}), float(y.mean()))


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns in ``keep`` and each whole text's score, 0 to 1; null and empty texts have the score of a text without words."""

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        return lambda texts: [pa.array(model.score(texts), pa.float64())]

    return map_text(docs, keep, text_col, make, [T.StructField(score_col, T.DoubleType())])


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of ``docs``; rows without labels are scored alike, and rows that repeat another
    too. An empty table gives no rows. Very long texts are read in stretches, to their end; null ids are never held out."""
    scored = score_quality(docs, learn(docs, labels), ["doc_id"])
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
