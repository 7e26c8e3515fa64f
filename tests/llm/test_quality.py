import random
import re
import zlib

import numpy as np
from conftest import ODD, documents

from stratoscope.llm import quality


def read(text):
    """Words with their places, one sign at a time."""
    kinds = {"letter": "[A-Za-z\x80-\U0010ffff]+", "digit": "[0-9]+", "sign": "[^A-Za-z0-9\x80-\U0010ffff\x00-\x20]+"}
    found = [(m.lastgroup, m.group()) for m in re.finditer("|".join(f"(?P<{k}>{v})" for k, v in kinds.items()), text)]
    return [(k, re.sub("[0-9]", "0", w) if k == "digit" else w) for k, w in found]


def bucket(word, bits):
    key = 0
    for i, b in enumerate(word.encode()):
        key = (key + (b + 1) * int(quality.POWERS[i & 4095])) % 2**64
    key = (key ^ (key >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
    return max(key >> (64 - bits), 1)


def plain_buckets(text, bits):
    words = read(text)
    return [0 if k == "letter" and w in [x for _, x in words[max(0, i - 2) : i]] else bucket(w, bits) for i, (k, w) in enumerate(words)]


def texts():
    rng = random.Random(3)
    return ["", " \n", "a", "a a a b a", "x" * 3000, *("".join(rng.choice("abé🙂 \n1,.|") for _ in range(rng.randrange(200))) for _ in range(60))]


def test_words_equal_a_plain_reading_however_they_are_cut():
    own = texts()
    for chunk in (5, 64, 1 << 19):
        made = [[] for _ in own]
        for t in quality.tokens([x.encode() for x in own], 8, chunk):
            for b, d in zip(t.bucket[t.old :], t.doc[t.old :], strict=True):
                made[d].append(int(b))
        assert made == [plain_buckets(x, 8) for x in own]


def test_vectors_equal_plain_sums(spark):
    own = texts()
    places, signs = quality.index_vectors(8, 16)
    want = np.zeros((256, 16))
    for text in own:
        words = plain_buckets(text, 8)
        for i, a in enumerate(words):
            for b in words[max(0, i - 2) : i] + words[i + 1 : i + 3]:
                want[a, places[b]] += signs[b]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    docs = documents(spark, list(enumerate(own))).repartition(7)
    got = quality.word_vectors(docs, "text", 8, 16)
    assert np.allclose(got, want, atol=1e-6)
    means = [np.mean([want[b] for b in plain_buckets(x, 8)], axis=0) if read(x) else np.zeros(16) for x in own]
    assert np.allclose(quality.pooled([x.encode() for x in own], got), means, atol=1e-5)


def test_network_learns_what_a_line_cannot_divide():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.train(x, y)
    assert ((net.scores(x) >= 0.5) == y).mean() > 0.95


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(quality.temperature(3 * z, y) - 3) < 0.2


def test_held_out_rows_of_the_given_tables(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rng = random.Random(6)
    good, bad = ["the cat and the dog of a house"] * 2, ["| buy | now |", "!! WIN !! NOW"]
    docs = documents(spark, [(i, f"{rng.choice(good if i % 2 else bad)} {i}") for i in range(200)])
    rows = [(i, i % 2) for i in range(200)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in rows]
    scores = [sorted(map(tuple, quality.quality_report(docs, spark.createDataFrame(r, "doc_id long, quality int")).collect())) for r in (rows, turned)]
    assert scores[0] == scores[1]
    held = [r for r in scores[0] if r[1]]
    assert held and all(r[3] == r[0] % 2 for r in held) and {r[0] for r in held} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1}


def test_odd_input(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (5, 0), (5, None), (7, 1), (9, 0), (9, 0), (None, 1), (0, 0)], "doc_id long, quality int")
    rows = quality.quality_report(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r, (_, text) in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(ODD, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        by_text.setdefault(text or "", set()).add(r["score"]) if r["doc_id"] not in (6, None) else None
    assert all(len(x) == 1 for x in by_text.values())
    assert quality.quality_report(none, labels).count() == 0
    assert {r["score"] for r in quality.quality_report(odd, labels.where("quality is null")).collect()} == {0.5}
    assert {r["score"] for r in quality.quality_report(odd, labels.where("quality = 1")).collect()} == {1.0}
