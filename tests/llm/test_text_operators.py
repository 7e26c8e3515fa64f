import hashlib
import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from conftest import ODD, documents
from pyspark.sql import functions as F

from stratoscope.llm import chat, decontaminate, exact_dedup, language_model, licenses, line_dedup, minhash_dedup, sentence_pieces, toxicity
from stratoscope.llm.common import blank_words, letter_words
from stratoscope.llm.lattice import PieceTrie


@pytest.fixture(scope="module")
def own():
    return sentence_pieces.PieceCoder(sentence_pieces.read_model())


def full_viterbi(own, text):
    """Over the whole text at once."""
    pieces = {p: v for p, v in own.machine.items()}
    best = [(0.0, 0, -1)] + [(-math.inf, 0, -1)] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - own.longest), e):
            if (v := pieces.get(text[s:e])) and best[s][0] + v[1] > best[e][0]:
                best[e] = (best[s][0] + v[1], s, v[2])
        if text[e - 1] not in pieces and best[e - 1][0] + own.unknown_score > best[e][0]:
            best[e] = (best[e - 1][0] + own.unknown_score, e - 1, -1)
    ids, e = [], len(text)
    while e:
        _, s, k = best[e]
        ids += [k] if k >= 0 else [own.byte_ids[b] for b in text[s:e].replace("\ud800", "▁").encode()][::-1]
        e = s
    return ids[::-1]


def test_window_gives_the_whole_texts_best_path(own):
    rng = random.Random(2)
    for n in (1, 5, 60, 300, 3000):
        text = "".join(rng.choice("aethionsrdlu▁ñ🙂") for _ in range(n))
        assert own.best(text) == full_viterbi(own, text)


def test_encode_equals_a_full_search_over_whole_texts(own):
    """What the operator calls, with its cuts at places where all paths meet and its blocks of words, against one search over the text."""
    rng = random.Random(12)
    for n in (0, 1, 2, 7, 40, 90, 400, 2500):
        for signs in ("the ionslrd", "ab  \n▁é🙂\x00\t.Th\r-- i", "==== \n", "一龥🙂 a"):
            text = "".join(rng.choice(signs) for _ in range(n))
            assert own.encode(text) == (full_viterbi(own, "▁" + text.replace("▁", "\ud800").replace(" ", "▁")) if text else [])


def test_runs_of_one_sign(own):
    """Paths that never meet: equal to the full search, and in time linear in the run."""
    for sign in "-A_=x.":
        for n in (1, 63, 64, 65, 200, 1001):
            for text in (sign * n, f"ab {sign * n}cd e{sign * (n // 3)}"):
                assert own.encode(text) == full_viterbi(own, "▁" + text.replace(" ", "▁"))
        began = time.perf_counter()
        text = sign * 100_000
        assert own.decode(own.encode(text)) == text and time.perf_counter() - began < 10


def test_very_long_words_and_texts(own):
    rng = random.Random(13)
    text = "".join(rng.choice("aeiou nrst") for _ in range(300_000)) + " " + "".join(rng.choice("aeiounrst一") for _ in range(50_000))
    assert own.decode(own.encode(text)) == text


def test_ids_that_are_no_encoding_decode_too(own):
    assert own.decode([own.byte_ids[0xC3]]) == "\ufffd" and own.decode([1, *own.encode("a b"), 2]) == "a b"
    assert own.decode([]) == ""


def test_no_worse_than_the_unigram_library(own):
    """The library's path has a lower sum of scores for some texts with these scores (-68,035 against -68,030 for the second); ours may never have."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(sentence_pieces.read_model())
    proto.trainer_spec.model_type = 1  # the same pieces and scores as a unigram model
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in ("Hello world", "the thanedble, ereaou.\nLine two", "naïve façade", "a b c"):
        ours, theirs = own.encode(text), sp.encode(text)
        assert sum(map(sp.get_score, ours)) >= sum(map(sp.get_score, theirs)) and own.decode(ours) == text
    assert own.encode("Hello world") == sp.encode("Hello world")


def test_every_text_comes_back(own, spark, odd, none):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n▁é🙂\x00\t.Th") for _ in range(rng.randrange(40)))
        assert own.decode(own.encode(text)) == text
    made = sentence_pieces.piece_report(odd).collect()
    assert len(made) == len(ODD) and all(r.lossless for r in made)
    assert sentence_pieces.piece_report(none).count() == 0
    coded = sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(odd)).select("text", "decoded", "n").collect()
    assert all((r.text or "") == r.decoded and r.n == "a" for r in coded)


def test_licenses(spark, odd, none):
    mit = licenses.TEMPLATES["MIT"]
    words = mit.split()
    worn = " ".join(words[:20] + ["really"] + words[20:50] + words[52:])
    texts = [
        (1, "intro words here\n" + mit.upper() + "\nrest"), (2, worn), (3, " ".join(words[:40])),
        (4, "x Released under the MIT\nLicense. y. Released  under the MIT License"), (5, "released the license under mit"), (6, None)
    ]
    made = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, texts), ["doc_id"]).collect()}
    assert [(m.license, m.coverage) for m in made[1].matches] == [("MIT", 1.0)] and made[1].matches[0].start == 3
    assert made[2].matches[0].license == "MIT" and 0.9 < made[2].matches[0].coverage < 1
    assert made[3].matches == [] and made[5].matches == [] and made[6].n_words == 0
    assert [(m.start, m.end) for m in made[4].matches] == [(1, 6), (7, 12)]
    assert [r.n_matches for r in licenses.license_report(odd).collect()] == [0] * len(ODD)
    assert licenses.license_report(none).count() == 0


def test_scan_equals_brute_force_over_all_diagonals():
    """Whole texts with worn copies of templates: each is found wherever an alignment on any diagonal covers enough of it."""
    index = licenses.LicenseIndex(licenses.TEMPLATES)
    machine, templates = index.machine()
    rng = random.Random(21)
    missed = found_all = 0
    for _ in range(60):
        words = [f"w{rng.randrange(500)}".encode() for _ in range(rng.randrange(30))]
        for name in rng.sample(sorted(templates), 2):
            wear = rng.choice([0.0, 0.05, 0.15, 0.25])
            words += [x for w in templates[name] for x in ([w] if rng.random() >= wear else rng.choice([[], [b"worn"], [w, b"odd"]]))]
            words += [f"w{rng.randrange(500)}".encode() for _ in range(rng.randrange(10))]
        found = {m[0] for m in index.scan(b" ".join(words), machine, templates)[1]}
        for name, template in templates.items():
            wanted = bool(index.matches(template, words, [d for d in range(-len(template), len(words)) if d % index.step(template) == 0]))
            assert wanted or name not in found
            found_all += wanted
            missed += wanted and name not in found
    assert found_all > 100 and missed == 0


def test_alignment_equals_the_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(100):
        a = [rng.choice("abc").encode() for _ in range(rng.randrange(1, 15))]
        b = [rng.choice("abc").encode() for _ in range(rng.randrange(1, 15))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert licenses.align(a, b, 0, 20)[0] == t[-1][-1]


def toxic_table(spark, n=600):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    bad = ["grumble", "snarkish", "blorfed"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(30)]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w[:15]) + ". " + " ".join(w[15:])))
        labels.append((i, 1, int(toxic)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bad


def test_toxicity_on_held_out_rows(spark, odd, none):
    docs, labels, bad = toxic_table(spark)
    rows = toxicity.toxicity_report(documents(spark, docs), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and all(r.predicted == r.toxic for r in rows)
    model = toxicity.learn(documents(spark, docs), labels)
    score = lambda x: model.score(model.grammar.features(x.encode(), model.grammar.weigher()))
    assert score("you are a grumble") > 0.5 > score("you are nice")
    assert score("you are not grumble") < score("you are grumble") and score("he said grumble") < score("grumble")
    made = toxicity.toxicity_report(odd, labels).collect()
    assert len(made) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in made)
    assert toxicity.toxicity_report(none, labels).count() == 0
    assert {r.score < 0.5 for r in toxicity.toxicity_report(odd, labels.where("false")).collect()} == {True}


def test_composed_clauses_equal_a_walk_by_the_rules():
    """All sequences of up to five symbols."""
    machine = toxicity.MACHINE
    for n in range(6):
        for word in itertools.product(range(6), repeat=n):
            state, scope, quoting, aimed = 0, 0, False, False
            for symbol in word:
                state, out = machine[state, symbol]
                if symbol in (toxicity.INSULT, toxicity.THREAT):
                    assert out == (symbol, toxicity.NEGATED if scope else toxicity.REPORTED if quoting else toxicity.ASSERTED)
                aimed |= symbol == toxicity.TARGET
                quoting |= symbol == toxicity.REPORT
                scope = toxicity.SCOPE if symbol == toxicity.NEGATION else max(0, scope - 1)
            assert machine[state, toxicity.END] == (0, toxicity.AIMED if aimed else toxicity.END)


def test_toxicity_of_the_tables_held_out_rows(spark):
    """Precision and recall on labels that weren't learned from."""
    read = lambda x: spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet")
    rows = toxicity.toxicity_report(read("documents"), read("labels")).join(read("labels"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    hits, said, toxic = sum(r.predicted and r.toxic for r in rows), sum(r.predicted for r in rows), sum(r.toxic for r in rows)
    assert toxic > 20 and hits >= 0.9 * said and hits >= 0.6 * toxic


def crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


def lm_documents():
    rng = random.Random(6)
    common = ["the", "of", "and", "river", "stone"]
    docs = [
        (i, " ".join(rng.choice(common) if rng.random() < 0.8 else f"w{rng.randrange(200)}" for _ in range(80))) for i in range(120)
    ] + [(500, None), (501, "")]
    counts, total = {}, 0
    for i, x in docs:
        if crc(i) % 7 != 2:
            for w in [*blank_words((x or "").encode()), b"\0end"]:
                counts[w] = counts.get(w, 0) + 1
                total += 1
    return docs, counts, total


def test_model_beats_the_base_on_held_out_texts(spark, sf):
    """The table's texts, not only the learned ones."""
    made = language_model.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    ours, base = made.agg(F.avg("score"), F.avg("base_score")).first()
    assert ours > base


def test_base_scores(spark, odd, none):
    docs, counts, total = lm_documents()
    made = {r.doc_id: r for r in language_model.score_texts(documents(spark, docs)).collect()}
    for i, x in docs:
        tokens = [*blank_words((x or "").encode()), b"\0end"]
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in tokens)
        r = made[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(w in counts for w in tokens), total, crc(i) % 7 == 2)
        assert r.base_score == pytest.approx(base)
    rows = language_model.score_texts(odd).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert language_model.score_texts(none).count() == 0


def toy_lattice():
    """Pieces of two letters, their scores and expected numbers."""
    pieces = {"▁": 0, "▁a": 1, "a": 2, "b": 3, "ab": 4, "ba": 5}
    heads = np.array([True, True, False, False, False, False])
    return language_model.PieceLattice(PieceTrie(pieces), np.array([1.0, 2, 1, 1, 3, 0.5]), heads, [None] * 256, np.array([0.0, 4, 2, 7, 1, 0]), 5.0), pieces


def every_path(lattice, pieces, text):
    """The sum over all segmentations, one by one."""
    if not text:
        return 1.0
    return sum(math.exp(lattice.weights[pieces[text[:k]]]) * every_path(lattice, pieces, text[k:]) for k in range(1, len(text) + 1) if text[:k] in pieces)


def test_lattice_sums_over_all_segmentations(own):
    lattice, pieces = toy_lattice()
    words = ["▁" + "".join(w) for n in range(8) for w in itertools.product("ab", repeat=n)]
    for word, log in zip(words, lattice.logs(words), strict=True):
        assert math.exp(log) == pytest.approx(every_path(lattice, pieces, word) * math.exp(lattice.stop))
        assert lattice.streamed(word) + lattice.stop == pytest.approx(log)
    real = language_model._lattice(own)
    known = {p: v[2] for p, v in own.machine.items()}
    for word in ("the", "another", "thanedble", "é"):
        assert math.exp(real.logs(["▁" + word])[0]) == pytest.approx(every_path(real, known, "▁" + word) * math.exp(real.stop))


def test_words_of_a_toy_vocabulary_sum_to_one():
    lattice, _ = toy_lattice()
    logs = lattice.logs(["▁" + "".join(w) for n in range(15) for w in itertools.product("ab", repeat=n)])
    assert 0.99 < np.exp(logs).sum() <= 1 + 1e-9


def test_expected_numbers_of_pieces_equal_those_of_all_paths():
    lattice, pieces = toy_lattice()
    word, want = "▁abbab", np.zeros(len(pieces))

    def walk(text, p, used):
        if not text:
            for u in used:
                want[u] += p
        for k in range(1, len(text) + 1):
            if text[:k] in pieces:
                walk(text[k:], p * math.exp(lattice.weights[pieces[text[:k]]]), [*used, pieces[text[:k]]])

    walk(word, 1.0, [])
    assert lattice.expected([word]) == pytest.approx(want / every_path(lattice, pieces, word))


def test_tokens_with_known_words_sum_to_one():
    """All words of a toy vocabulary and the end, some of them counted."""
    lattice, _ = toy_lattice()
    words = ["".join(w) for n in range(15) for w in itertools.product("ab", repeat=n)]
    logs = lattice.logs(["▁" + w for w in words])
    own = np.array([3 if w in ("a", "ab") else 1 if w == "bb" else 0 for w in words] + [2])
    c = own + np.array([2 if w == "a" else 0 for w in words] + [1])
    totals = language_model.Totals(int(c.sum()), int((c > 0).sum()), 0.6, 0.1, (int(own.sum()), 0), (int((own > 0).sum()), 0))
    ends = np.array([False] * len(words) + [True])
    for cls, n in ((0, own), (1, own * 0)):
        assert 0.99 < (10 ** totals.logs(c, n, cls, np.append(logs, 0.0), ends)).sum() <= 1 + 1e-9


def test_scores_equal_a_plain_computation(spark, own):
    """The operator's classes and pieces' weights, and everything else from dictionaries of the whole table."""
    docs = [(i, x) for i, x in lm_documents()[0]]
    table = documents(spark, docs)
    _, _, model = language_model._learned(table, "doc_id", "text", 2, 7, sentence_pieces.read_model())
    rows = [
        (i, [*blank_words((x or "").encode()), b""], crc(i) % 7 == 2, int(model.classes.of(language_model.byte_triples((x or "").encode())[None])[0])) for i,
        x in docs
    ]
    c, own_c = Counter(), [Counter() for _ in range(language_model.CLASSES)]
    for _, tokens, held, k in rows:
        if not held:
            c.update(tokens)
            own_c[k].update(tokens)
    once, twice = (sum(v == n for v in c.values()) for n in (1, 2))
    d, n, v = min(0.95, max(0.05, once / (once + 2 * twice))), sum(c.values()), len(c)
    back, share = language_model.BACK, language_model.SHARED

    def token(w, k):
        lattice = language_model._lattice(own, model.seen[k], max(0, len(own_c[k]) - 1))
        p = 1 / (v + 2) if not w else (1 - 1 / (v + 2)) * math.exp(lattice.logs([language_model.spelling(w)])[0])
        shared = share * max(0, c[w] - d) / n + (1 - share + share * d * v / n) * p
        size = sum(own_c[k].values())
        return ((1 - back) * max(0, own_c[k][w] - d) + ((1 - back) * d * len(own_c[k]) + back * size) * shared) / size if size else shared

    made = {r.doc_id: r.score for r in language_model.score_texts(table).collect()}
    for i, tokens, _, k in rows[::7]:
        assert made[i] == pytest.approx(model.classes.prior[k] / math.log(10) + sum(math.log10(token(w, k)) for w in tokens))


def test_chat_reads_back_and_judges_turns(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", chat.MARKED), (1, 2, "assistant", "&amp;&lt;|x<|y&"), (2, 0, "assistant", "a"), (2, 1, "user", None),
        (3, 0, "user", "u"), (4, 0, "user", "a"), (4, 0, "user", "a"), (4, 1, "assistant", ""), (5, None, "us\ner<|", "x"), (None, 0, None, None)
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, segments string, x string")
    made = {r.conv_id: r for r in chat.format_chat(df).withColumn("back", chat.parse_chat(F.col("formatted"))).collect()}
    for c, r in made.items():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == c]
        assert [(t.role, t.text) for t in r.back] == want
        assert "".join(s.text for s in r.segments) == r.formatted
    assert {c: (r.valid, r.first_invalid) for c, r in made.items()} == {
        1: (True, None), 2: (False, 0), 3: (False, 1), 4: (False, 1), 5: (False, 0), None: (False, 0)
    }
    digest = {r.conv_id: r for r in chat.chat_digest(chat.format_chat(df)).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256(b"&amp;&lt;|x<|y&").hexdigest() and digest[1].loss_chars == 15
    assert chat.format_chat(df.where("false")).count() == 0


def test_chat_of_a_very_long_text(spark):
    text = "said <|im_end|> & <| &lt;| é🙂\n" * 40_000
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    made = chat.chat_digest(chat.format_chat(df)).first()
    assert (made.n_turns, made.loss_chars, made.loss_sha256) == (3, 2 * len(text), hashlib.sha256((2 * text).encode()).hexdigest())
    assert made.turns_sha256 == hashlib.sha256(f"user\na\n{f'assistant{chr(10)}{text}{chr(10)}' * 2}".encode()).hexdigest()


def test_benchmark_spans_point_into_the_text(spark, odd, none):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame(
        [(1, item, "q"), (2, "tiny é", "q"), (3, None, "q"), (4, "..", "q"), (5, item, "q")], "item_id long, text string, extra string"
    )
    text = "x, Beta-gamma delta; epsilon ZETA eta theta iota\nkappa lambda! y tiny É tiny é"
    docs = documents(spark, [(1, text), (2, "alpha beta gamma delta"), (3, None)])
    for bound in (1 << 20, 40):  # one automaton, or several
        made = {r.doc_id: r for r in decontaminate.find_benchmark(docs, items, ["doc_id"], max_nodes=bound).collect()}
        spans = {(s.item, text.encode()[s.from_byte : s.to_byte].decode()) for s in made[1].found}
        assert spans == {
            ("1", "Beta-gamma delta; epsilon ZETA eta theta iota\nkappa lambda"),
            ("5", "Beta-gamma delta; epsilon ZETA eta theta iota\nkappa lambda"), ("2", "tiny é")
        }
        assert made[2].found == [] and made[3].n_words == 0
        r = {r.doc_id: r for r in decontaminate.contamination(docs, items, max_nodes=bound).collect()}[1]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (16, 12, 3, True) and r.items_sha256 == hashlib.sha256(b"1,2,5").hexdigest()
    assert decontaminate.contamination(odd, items.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert letter_words("A-b É".encode()) == [b"a", b"b", "É".encode()]


def test_classes_are_found_from_all_texts(spark):
    """Texts of four alphabets, one of them rare, fall into classes of their own."""
    rng = random.Random(9)
    of = lambda k, n: "".join(rng.choice(("abcd", "efgh", "ijkl", "mnop")[k] + " ") for _ in range(n))
    texts = [(k, of(k, 300)) for k in [0] * 300 + [1] * 100 + [2] * 40 + [3] * 8]
    found = language_model.find_classes(spark.createDataFrame([(x,) for _, x in texts] + [("",)], "t string"))
    of_text = found.of(np.array([language_model.byte_triples(x.encode()) for _, x in texts]))
    seen = [{int(c) for (k, _), c in zip(texts, of_text, strict=True) if k == g} for g in range(4)]
    assert all(not a & b for a, b in itertools.combinations(seen, 2))
    assert np.exp(found.prior).sum() == pytest.approx(1)


def test_each_character_of_an_unseen_word_costs(spark):
    """Held out, 200, 400 and 800 characters outside of the vocabulary; and the words with the end have at most 1 together."""
    held = [i for i in range(1000, 2000) if crc(i) % 7 == 2][:3]
    docs = [(i, "the river") for i in range(60)] + [(i, "一龥" * n) for i, n in zip(held, (100, 200, 400), strict=True)]
    made = {r.doc_id: r.score for r in language_model.score_texts(documents(spark, docs)).collect()}
    a, b, c = (made[i] for i in held)
    assert c - b == pytest.approx(2 * (b - a), rel=0.01) and c < 3.5 * a < 0
    assert math.isfinite(c)


def test_copies_neither_push_words_out_of_the_lexicon_nor_into_it(spark):
    docs, labels, bad = toxic_table(spark)
    n = len(docs)
    copied = [(n + i, f"you {bad[0]} and nothing more") for i in range(400)] + [(n + 400 + i, f"they wrote {bad[1]} in a column") for i in range(400)]
    more = spark.createDataFrame([(i, 1, int(i < n + 400)) for i, _ in copied], "doc_id long, quality int, toxic int")
    model = toxicity.learn(documents(spark, docs + copied), labels.union(more))
    assert all(w.encode() + b"$" in model.grammar.weights for w in bad)
    assert b"nothing$" not in model.grammar.weights
    score = lambda x: model.score(model.grammar.features(x.encode(), model.grammar.weigher()))
    assert all(score(f"you are a {w}") > 0.5 for w in bad)


def test_short_licenses_are_found_wherever_brute_force_finds_them():
    index = licenses.LicenseIndex(licenses.TEMPLATES)
    machine, templates = index.machine()
    assert {m[0] for m in index.scan(b"x Distributed under the MIT License.", machine, templates)[1]} == {"MIT-short"}
    rng = random.Random(8)
    short = [k for k, w in templates.items() if len(w) < licenses.SHORT]
    for _ in range(150):
        name = rng.choice(short)
        kept = [w for w in templates[name] if rng.random() < 0.9]
        text = [w for x in kept for w in ([b"odd", x] if rng.random() < 0.2 else [x])]
        words = [b"a"] * rng.randrange(4) + text + [b"b"] * rng.randrange(4)
        found = {m[0] for m in index.scan(b" ".join(words), machine, templates)[1]}
        for k in short:
            band = max(2, int(index.band * len(templates[k])))
            best = max(licenses.align(templates[k], words, s, band)[0] for s in range(-25, len(words) + 25))
            assert (k in found) == (best >= licenses.COVERAGE * len(templates[k]))


def test_a_very_long_text_is_taken_whole(spark):
    """1.5 MB, with what each operator looks for at its end."""
    rng = random.Random(31)
    words = [f"w{rng.randrange(50_000)}" for _ in range(230_000)]
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = " ".join(words) + "\nhome\n" + item + "\nReleased under the MIT License."
    df = documents(spark, [(0, long), (2, long + " more"), (4, "home\nshort"), (6, "home")])
    first = lambda made: {r.doc_id: r for r in made.collect()}[0]
    assert [m.license for m in first(licenses.scan_licenses(df, ["doc_id"])).matches] == ["MIT-short"]
    assert first(decontaminate.contamination(df, spark.createDataFrame([(1, item)], "item_id long, text string"))).n_hit == 10
    near = {r.doc_id: r.component_id for r in minhash_dedup.near_groups(df).collect()}
    assert near == {0: 0, 2: 0, 4: 4, 6: 6}
    assert first(exact_dedup.exact_groups(df)).group_size == 1
    assert first(line_dedup.drop_boilerplate(df, ratio=0.9)).n_dropped == 1
    scored = first(language_model.score_texts(df))
    assert scored.n_tokens == len(blank_words(long.encode())) + 1 and math.isfinite(scored.score)
    model = toxicity.ToxicityModel(toxicity.Grammar({b"w1$": 1.0}), (1.0,) * 8)
    assert 0 <= first(toxicity.score_toxicity(df, model, ["doc_id"])).score <= 1
    assert first(sentence_pieces.piece_report(df)).lossless
