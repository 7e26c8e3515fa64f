"""Toxicity by a weighted finite-state grammar over clauses, its lexicon and weights learned from labelled rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import as_bytes, letter_words, map_text, slices, staged

#: Word classes of English, German, French and Spanish.
TARGETS = frozenset(
    "you your yours yourself u ur he him his she her hers they them their this that these those people everyone everybody "
    "du dich dir dein deine ihr euch euer sie er ihn ihm ihnen alle leute "
    "tu toi te ton ta tes vous votre vos il elle lui ils elles eux leur tous gens "
    "tú ti tu usted ustedes vosotros él ella ellos ellas les todos gente".split()
)
NEGATIONS = frozenset(
    "not no never neither nor cannot without none nobody hardly isn aren wasn don doesn didn won wouldn "
    "nicht kein keine keinen keiner keinem nie niemals niemand ohne weder noch ne pas jamais aucun aucune sans ni personne "
    "nunca jamás ningún ninguna ninguno nadie sin tampoco".split()
)
REPORTS = frozenset(
    "said says say saying told tells telling called calls calling wrote writes written reported reports quoted quotes claimed claims asked replied shouted "
    "sagte sagt sagten nannte nennt nannten schrieb schreibt behauptete rief fragte dit disait disent appelé appelle écrit écrivait raconte cria "
    "dijo dice dijeron decía llamó llama escribió escribe gritó contó".split()
)
THREATS = frozenset(
    "kill kills hurt hurts destroy beat murder stab shoot burn strangle hang slap smash crush choke punch drown poison hunt break bury "
    "töten töte umbringen schlagen schlage verletzen verprügeln erschießen erwürgen verbrennen abstechen vernichten zerstören "
    "tuer tue frapper frappe brûler brûle étrangler égorger détruire cogner abattre noyer écraser "
    "matar mato golpear golpeo quemar quemo estrangular apuñalar destruir ahogar disparar pegar romper".split()
)

SAMPLE = 20_000
STEMS = (4, 5, 6)
SURE = 0.95
CONTEXTS = 3
SCOPE = 2
MEMO = 1 << 15
CLAUSE = re.compile(rb"[.!?;:|\n]+")
FEATURES = 7
#: Symbols of words, and of a clause's end.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END = range(7)
ASSERTED, NEGATED, REPORTED, AIMED = "asserted", "negated", "reported", "aimed"


def stems_of(word: bytes) -> list[bytes]:
    """A word as a whole (with $ at its end) and its beginnings of 4 to 6 characters."""
    text = word.decode()
    return [word + b"$", *(text[:n].encode() for n in STEMS if len(text) >= n)]


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, input) to (state, output). An input without an arc of its own stays in its state and is passed on."""

    start: Hashable
    arcs: dict[tuple, tuple]

    def step(self, state: Hashable, symbol: Hashable) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol))

    def composed(self, other: Transducer, inputs: Iterable[Hashable]) -> Transducer:
        """First this one, then the other on its outputs; only the states that the inputs reach."""
        start = (self.start, other.start)
        arcs, open_ = {}, [start]
        seen = {start}
        while open_:
            a, b = state = open_.pop()
            for symbol in inputs:
                c, between = self.step(a, symbol)
                d, out = other.step(b, between)
                arcs[state, symbol] = ((c, d), out)
                if (c, d) not in seen:
                    seen.add((c, d))
                    open_.append((c, d))
        return Transducer(start, arcs)


def negation() -> Transducer:
    """Of the SCOPE words after a negation, insults and threats come out negated. The states are the words that are left of it."""
    arcs: dict[tuple, tuple] = {}
    for left in range(SCOPE + 1):
        for symbol in (INSULT, THREAT):
            arcs[left, symbol] = (max(0, left - 1), (symbol, NEGATED if left else ASSERTED))
        for symbol in (TARGET, REPORT, OTHER):
            arcs[left, symbol] = (max(0, left - 1), symbol)
        arcs[left, NEGATION] = (SCOPE, NEGATION)
        arcs[left, END] = (0, END)
    return Transducer(0, arcs)


def reported_speech() -> Transducer:
    """After a word of saying, what is asserted in the rest of the clause comes out reported."""
    arcs: dict[tuple, tuple] = {("own", REPORT): ("quoting", REPORT), ("quoting", END): ("own", END)}
    for symbol in (INSULT, THREAT):
        arcs["quoting", (symbol, ASSERTED)] = ("quoting", (symbol, REPORTED))
    return Transducer("own", arcs)


def aim() -> Transducer:
    """A target anywhere in the clause aims it: its end comes out aimed."""
    return Transducer("open", {("open", TARGET): ("aimed", TARGET), ("aimed", END): ("open", AIMED)})


def clause_machine() -> dict[tuple, tuple]:
    """The composition, its states numbered from 0: (state, symbol) to (state, output)."""
    symbols = range(7)
    whole = negation().composed(reported_speech(), symbols).composed(aim(), symbols)
    number: dict = {whole.start: 0}
    for state, _ in whole.arcs:
        number.setdefault(state, len(number))
    return {(number[a], symbol): (number[b], out) for (a, symbol), (b, out) in whole.arcs.items()}


@dataclass(frozen=True)
class Grammar:
    """The lexicon's transducer, from words to symbols with a weight, and its composition with those of negation, reported speech and aim.

    Insults are learned stems with their weights, threats weigh 1, and a word is of the first class that has it: threat, insult, negation,
    report, target. A clause's features are sums of weights by what comes out of the composition.
    """

    weights: dict[bytes, float]

    def weigher(self) -> dict:
        """Words to (symbol, weight)."""
        weights = self.weights

        class Weigher(dict):
            def __missing__(self, word: bytes) -> tuple[int, float]:
                weight = max((weights.get(s, 0.0) for s in stems_of(word)), default=0.0)
                value = (INSULT, weight) if weight else (OTHER, 0.0)
                if len(self) < MEMO:
                    self[word] = value
                return value

        made = Weigher()
        for words, symbol in ((NEGATIONS, NEGATION), (REPORTS, REPORT), (TARGETS, TARGET)):
            for w in sorted(words):
                if made[w.encode()][0] == OTHER:
                    made[w.encode()] = (symbol, 0.0)
        made.update({w.encode(): (THREAT, 1.0) for w in THREATS})
        return made

    def features(self, text: bytes, weigh: dict) -> np.ndarray | None:
        """Asserted weight, heaviest clause, aimed, negated and reported weight, threats, matched clauses; None where nothing matches."""
        if not any(weigh[w][1] for w in set(letter_words(text))):
            return None
        out = np.zeros(FEATURES)
        for clause in CLAUSE.split(text):
            found = [weigh[w] for w in letter_words(clause)]
            if not any(weight for _, weight in found):
                continue
            sums, threats, state = {ASSERTED: 0.0, NEGATED: 0.0, REPORTED: 0.0}, 0, 0
            for symbol, weight in found:
                state, made = MACHINE[state, symbol]
                if weight:
                    threats += symbol == THREAT
                    sums[made[1]] += weight
            _, end = MACHINE[state, END]
            out += [sums[ASSERTED], 0, sums[ASSERTED] if end == AIMED else 0, sums[NEGATED], sums[REPORTED], threats, 1]
            out[1] = max(out[1], sums[ASSERTED])
        return np.log1p(out)


MACHINE = clause_machine()


@dataclass(frozen=True)
class ToxicityModel:
    grammar: Grammar
    coefficients: tuple[float, ...]  # the last is the constant

    def score(self, features: np.ndarray | None) -> float:
        c = np.array(self.coefficients)
        z = c[-1] + (0.0 if features is None else float(features @ c[:-1]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int, folds: int) -> DataFrame:
    """(y, t) of about ``most`` labelled rows outside of the held-out fold at the most, by a hash of the id; all of them where there are fewer.

    A text comes once, however many rows have it, with the label that at least half of them have (toxic where they are even).
    """
    own = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    own = own.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds)) != 0)
    n = own.count()
    if n > most:
        own = own.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    rows = source.join(F.broadcast(own), "id").select("y", "t")  # about ``most`` rows of a bigint and an int
    return rows.groupBy("t").agg((F.avg("y") >= 0.5).cast("int").alias("y")).select("y", "t")


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        keys = list({**counts[0], **counts[1]})
        made = pa.RecordBatch.from_arrays(
            [pa.array([k.decode() for k in keys], pa.string()), *(pa.array([counts[i][k] for k in keys], pa.int64()) for i in (1, 0))],
            names=["stem", "toxic", "clean"]
        )
        counts[0].clear()
        counts[1].clear()
        return made

    for batch in batches:
        for part in slices(batch):
            for y, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                counts[y > 0].update({s for w in set(letter_words(text)) for s in stems_of(w)})
                if len(counts[0]) + len(counts[1]) > 100_000:
                    yield flush()
    yield flush()


def _contexts(stems: set[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = set()
                for text in as_bytes(part.column(0)):
                    before = b""
                    for word in letter_words(text):
                        found.update((s, before) for s in stems_of(word) if s in stems)
                        before = word
                rows = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array([x[i].decode() for x in rows], pa.string()) for i in (0, 1)], names=["stem", "before"])

    return run


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton's method; a text without a match gets about the share of toxic texts among such."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([*[1.0] * (x.shape[1] - 1), 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, folds: int = 5) -> ToxicityModel:
    """Learns from labelled rows whose crc32(id as text) mod ``folds`` is not 0, of which about ``most`` (documented bound) are taken.

    A stem is in the lexicon if at least SURE of its weighed occurrences are in toxic rows, its counts would come up by chance for
    one stem in a hundred such lexicons at the most (a large-deviation bound over all stems), and it stands after CONTEXTS
    different words in toxic texts at least. Copies of a text count as one text. Its weight is its log odds. The clause features'
    coefficients are fitted by logistic regression. Without labelled rows of both kinds every text gets the score 0. Null texts count as
    empty, null labels as none; of several labels of an id the highest counts; other columns are not looked at. To the driver come the
    stems that pass, each of which is in several toxic rows of the sample, and FEATURES numbers for each of its rows.
    """
    ship(docs.sparkSession)
    sample = staged(_sample(docs, labels, id_col, text_col, most, folds))
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    n1, n0 = int(total["toxic"]), int(total["n"] - total["toxic"])
    if not n1 or not n0:
        return ToxicityModel(Grammar({}), (*[0.0] * FEATURES, -30.0))
    stems = staged(
        sample.mapInArrow(_count_stems, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    )
    bound = math.log(100 * max(1, stems.count()))
    p, n, share = n1 / (n1 + n0), F.col("a") + F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    kl = share * F.log(share / p) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0)
    sure = stems.where((F.col("a") > 0) & (F.col("a") / n1 >= SURE * (F.col("a") / n1 + F.col("b") / n0))).where(n * kl > bound)
    likely = {r["stem"].encode(): (r["a"], r["b"]) for r in sure.collect()}  # each in several toxic rows of the sample
    toxic = sample.where("y > 0").select("t")
    seen = toxic.mapInArrow(_contexts(set(likely)), "stem string, before string").groupBy("stem").agg(F.countDistinct("before").alias("n")).collect()
    varied = {r["stem"].encode(): r["n"] for r in seen if r["n"] >= CONTEXTS}
    grammar = Grammar({s: math.log((likely[s][0] + 0.5) / (n1 + 1)) - math.log((likely[s][1] + 0.5) / (n0 + 1)) for s in sorted(varied)})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = grammar.weigher()
        for batch in batches:
            for part in slices(batch):
                made = [grammar.features(x, weigh) for x in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([None if f is None else f.tolist() for f in made], pa.list_(pa.float64()))], names=["y", "f"]
                )

    rows = sample.mapInArrow(measure, "y int, f array<double>").collect()  # a few numbers for each row of the sample
    x = np.array([r["f"] or [0.0] * FEATURES for r in rows])
    return ToxicityModel(grammar, _fit(x, np.array([r["y"] for r in rows], float)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns in ``keep`` and each text's score, 0 to 1. Null and empty texts get the score of a text without a match."""

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        weigh = model.grammar.weigher()
        return lambda texts: [pa.array([model.score(model.grammar.features(x, weigh)) for x in texts], pa.float64())]

    return map_text(docs, keep, text_col, make, [T.StructField(score_col, T.DoubleType())])


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of ``docs``; rows without labels are scored alike, and rows that repeat
    another too. Very long texts are matched clause by clause, to their end; null ids are never held out."""
    scored = score_toxicity(docs, learn(docs, labels), ["doc_id"])
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
