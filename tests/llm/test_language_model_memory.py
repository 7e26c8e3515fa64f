"""What a worker of op6_lm_score holds while it numbers words."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stratoscope.llm import language_model
from stratoscope.llm.common import blank_words


class Dealt:
    """Classes that are dealt to the rows in turn."""

    def __init__(self, k):
        self.prior, self.at = np.zeros(k), 0

    def of(self, counts):
        self.at += len(counts)
        return np.arange(self.at - len(counts), self.at) % len(self.prior)


@pytest.fixture
def numbered(monkeypatch):
    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(language_model, "TaskContext", Context)

    def run(texts, held, k=8):
        batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([h]), pa.array([x])], names=["id", "held", "t"]) for i, (x, h) in enumerate(zip(texts, held, strict=True))]
        return language_model._dictionary(Dealt(k), pa.int64())(iter(batches))

    return run


def texts_back(batches):
    """The rows' tokens by id, the summed numbers of the words by class, and each chunk's distinct words."""
    rows = pa.Table.from_batches(batches).to_pylist()
    words = {(r["chunk"], r["cls"], r["place"]): r["word"] for r in rows if r["word"] is not None}
    counts, by_chunk = {}, {}
    for r in rows:
        if r["word"] is not None:
            counts[r["cls"], r["word"]] = counts.get((r["cls"], r["word"]), 0) + r["n"]
            by_chunk.setdefault(r["chunk"], set()).add(r["word"])
    found = {}
    for r in rows:
        if r["tokens"] is not None:
            places = [int.from_bytes(r["tokens"][k : k + 3], "little") for k in range(0, len(r["tokens"]), 3)]
            assert r["id"] not in found
            found[r["id"]] = [words[r["chunk"], r["cls"], p] for p in places]
    return found, counts, by_chunk


def holds(texts, held, batches, k):
    found, counts, by_chunk = texts_back(batches)
    tokens = [[*(w.decode() for w in blank_words(x.encode())), ""] for x in texts]
    assert found == dict(enumerate(tokens))
    want = {}
    for i, own in enumerate(tokens):
        for w in own:
            want[i % k, w] = want.get((i % k, w), 0) + (not held[i])
    assert counts == want
    return by_chunk


def test_words_are_held_once_for_all_classes(numbered):
    text = " ".join(f"w{i}" for i in range(60_000))
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in numbered([text] * 8, [False] * 8)) == 8 * (60_001 + 1)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < 40, peak  # 60,001 words and 480,008 numbers; with a list for each class it was 84 MB


def test_a_chunk_ends_at_a_number_of_distinct_words(numbered, monkeypatch):
    monkeypatch.setattr(language_model, "MOST_WORDS", 1000, raising=False)
    texts = [" ".join(f"x{i}_{j}" for j in range(300)) + " and the end" for i in range(40)]
    held = [i % 7 == 2 for i in range(40)]
    by_chunk = holds(texts, held, list(numbered(texts, held, 4)), 4)
    assert len(by_chunk) == 10 and max(map(len, by_chunk.values())) <= 1000 + 304


def test_long_texts_in_stretches(numbered, monkeypatch):
    texts = ["", "   ", "one", "A b\tc\x0bd " * 50 + "z" * 100, "x" * 200 + " y", " " * 90 + "q", "é▁ " * 60, "a" * 37]
    whole = [language_model.byte_triples(x.encode()) for x in texts]
    monkeypatch.setattr(language_model, "STRETCH", 16, raising=False)
    monkeypatch.setattr(language_model, "TOKENS", 20, raising=False)
    assert all((language_model.byte_triples(x.encode()) == y).all() and y.dtype == np.int32 for x, y in zip(texts, whole, strict=True))
    assert all(b"".join(language_model.stretches(x.encode())) == x.encode() for x in texts)
    assert max(len(x) for x in language_model.stretches(("ab " * 50).encode())) < 20
    held = [i == 3 for i in range(len(texts))]
    holds(texts, held, list(numbered(texts, held, 2)), 2)


def test_runs_have_a_bounded_number_of_tokens():
    sizes = [5, 1, language_model.TOKENS, 2, 2, *[1] * 2500]
    made = list(language_model.runs(list(range(len(sizes))), sizes))
    assert [i for x in made for i in x] == list(range(len(sizes))) and max(map(len, made)) == 1000
    assert all(len(x) == 1 or sum(sizes[i] for i in x) <= language_model.TOKENS for x in made)
    assert list(language_model.runs([], [])) == []
