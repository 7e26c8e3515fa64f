import hashlib
import pathlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import ODD, documents

from stratoscope import shipping
from stratoscope.llm import exact_dedup, line_dedup, minhash_dedup, substring_dedup
from stratoscope.llm.components import components, extended


def test_exact_groups(spark, odd, none):
    made = exact_dedup.exact_groups(odd).collect()
    texts = [(i, x or "") for i, x in ODD]
    assert len(made) == len(ODD)
    for r in made:
        group = [i for i, x in texts if hashlib.sha256(x.encode()).hexdigest() == r.text_sha256]
        ids = [i for i in group if i is not None]
        assert r.group_size == len(group) and r.keep_id == max(ids) and r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup.exact_groups(none).count() == 0


def test_equal_lengths_and_prefixes_alone_are_no_duplicates(spark):
    base = "x" * 300
    made = exact_dedup.exact_groups(documents(spark, [(1, base + "a"), (2, base + "b"), (3, base + "a"), (4, "y" * 301)])).orderBy("doc_id").collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in made] == [(3, 2, False), (2, 1, True), (3, 2, True), (4, 1, True)]


def brute_boilerplate(rows, ratio, least):
    """(text that stays, dropped) of each (host, text)."""
    pages, seen = Counter(h for h, _ in rows), Counter()
    for h, x in rows:
        seen.update((h, line) for line in {y for y in (x or "").split("\n") if y.strip(" ")})
    gone = {k for k, n in seen.items() if n > ratio * pages[k[0]] and n >= least}
    kept = [[y for y in (x or "").split("\n") if (h, y) not in gone] for h, x in rows]
    return [(None if x is None else "\n".join(k), len((x or "").split("\n")) - len(k)) for (h, x), k in zip(rows, kept, strict=True)]


@pytest.mark.parametrize("least", [1, 2])
def test_boilerplate(spark, odd, none, least):
    pages = [(2 * i, f"home\n\nown {i}\nhome") for i in range(40)] + [(1, "home\nx"), (3, None)]
    for pairs in (pages, ODD):
        made = line_dedup.drop_boilerplate(documents(spark, pairs), min_pages=least).collect()
        want = brute_boilerplate([(f"src{(i or 0) % 2}", x) for i, x in pairs], line_dedup.RATIO, least)
        assert sorted((r.doc_id or -1, r.text or "", r.n_dropped) for r in made) == sorted(
            (i or -1, w[0] or "", w[1]) for (i, _), w in zip(pairs, want, strict=True)
        )
        assert {r.doc_id for r in made if r.text is None} == {i for i, x in pairs if x is None}
    assert line_dedup.line_report(none).count() == 0


def test_boilerplate_leaves_other_columns_alone(spark):
    names = "doc_id long, text string, source string, host string, lines string, boilerplate string, kept string, row string, __host string, `a.b` string"
    made = line_dedup.drop_boilerplate(spark.createDataFrame([(1, "x\ny", "s", *"abcdefg")], names), ratio=2)
    assert made.columns[:-2] == ["doc_id", "text", "source", "host", "lines", "boilerplate", "kept", "row", "__host", "a.b"]
    assert tuple(made.first()) == (1, "x\ny", "s", *"abcdefg", 2, 0)


def test_more_links_join_components(spark):
    rng = random.Random(11)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    for cut in (0, 5, 30, 45):
        first, more = (spark.createDataFrame(x, "a long, b long") for x in (links[:cut], links[cut:]))
        made = {r.node: r.component for r in extended(components(first), more).collect()}
        assert made == {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}


def shingles(text, size):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(pairs, size, percent=80):
    sets = {}
    for i, x in pairs:
        sets[i] = shingles(x, size)
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"m{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("size,crowd", [(4, 64), (5, 64), (4, 2), (5, 2)])
def test_near_groups_of_a_crowd(spark, size, crowd, monkeypatch):
    """A crowd of near copies around the threshold, chains, exact copies and strangers that share a passage; with a bound of 2 all lists are crowded."""
    monkeypatch.setattr(minhash_dedup, "CROWD", crowd)
    rng = random.Random(size)
    seed = [f"s{rng.randrange(500)}" for _ in range(120)]
    pairs = [(i, mutated(rng, seed, rng.randrange(1, 5))) for i in range(1, 90)]
    chain = [f"c{i}" for i in range(100)]
    for k in range(12):
        chain = [*chain[4:], *(f"n{k}_{i}" for i in range(4))]
        pairs.append((100 + k, " ".join(chain)))
    passage = [f"p{i}" for i in range(60)]
    pairs += [(200 + i, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(20 + i)])) for i in range(30)]
    pairs += [(300 + i, pairs[i % 3][1]) for i in range(9)]
    made = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_groups(documents(spark, pairs), size=size).collect()}
    assert made == brute_components(pairs, size)


def test_prefixes_of_full_sets_lose_no_pair(spark):
    """Sets of all sizes that overlap around the threshold: every pair that is similar enough meets, and hardly another one."""
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = [rng.randrange(2**62) for _ in range(rng.randrange(5, 120))]
        for _ in range(14):
            own = set(base[: len(base) - rng.randrange(0, len(base) // 4 + 1)]) | {rng.randrange(2**62) for _ in range(rng.randrange(0, len(base) // 4 + 1))}
            rows.append(np.array(sorted(own), np.uint64))
    cells = lambda x: np.bincount((x & np.uint64(minhash_dedup.CELLS - 1)).astype(int), minlength=minhash_dedup.CELLS).tolist()
    sets = spark.createDataFrame([(i, x.tobytes(), cells(x)) for i, x in enumerate(rows)], "node long, s binary, cells array<tinyint>")
    nodes = spark.createDataFrame([(i, i, len(x), len(x), *[0] * minhash_dedup.PLANES) for i, x in enumerate(rows)], "node long, component long, n long, m long, " + ", ".join(f"p{k} long" for k in range(minhash_dedup.PLANES)))
    bounds = ["n", "m", *[f"p{k}" for k in range(minhash_dedup.PLANES)], "cells"]
    for percent in (80, 50, 95):
        made = {tuple(sorted(r)) for r in minhash_dedup._crowd_pairs(nodes.join(sets.drop("s"), "node"), sets, bounds, percent, 38).select("a", "b").distinct().collect()}
        both = [[len(np.intersect1d(x, y)) for y in rows] for x in rows]
        want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if 100 * both[i][j] >= percent * (len(rows[i]) + len(rows[j]) - both[i][j])}
        assert want and want <= made


def test_a_crowd_that_is_not_similar_enough_forms_no_pairs(spark, monkeypatch):
    """Texts of one template, each with words of its own, just under the threshold: no task forms their pairs."""
    template = [f"t{i}" for i in range(300)]
    texts = []
    for k in range(220):
        words = list(template)
        for i in range(8, 296, 33):
            words[i] = f"own{k}_{i}"
        texts.append(" ".join(words))
    sets = [shingles(x, 4) for x in texts]
    assert 0.7 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8
    formed = []
    real = minhash_dedup._signed
    monkeypatch.setattr(minhash_dedup, "_signed", lambda pairs, *rest: real(formed.append(pairs) or pairs, *rest))
    pairs = list(enumerate(texts))
    made = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_groups(documents(spark, pairs)).collect()}
    assert made == brute_components(pairs, 4)
    assert sum(x.count() for x in formed) < 12 * len(texts)


def test_near_groups_of_odd_rows(spark, odd, none):
    rows = minhash_dedup.near_groups(odd).collect()
    assert len(rows) == len(ODD)
    want = brute_components([(i, x) for i, x in ODD if i is not None], 4)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert sorted(
        (r.n_shingles, r.component_id) for r in rows if r.doc_id is None
    ) == [(0, None), (1, 3)] or {(r.n_shingles, r.component_id) for r in rows if r.doc_id is None} == {(0, None), (1, 3)}
    assert minhash_dedup.near_groups(none).count() == 0


def test_rows_that_repeat_an_id_keep_their_own_links(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, a), (4, a), (None, b + " z"), (None, "own words of no one")]
    made = minhash_dedup.near_groups(documents(spark, rows))
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in made.collect()) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 1), (0, 1), (0, 0)])
    assert len({r.component for r in made.collect()}) == 3
    left = minhash_dedup.one_of_each(documents(spark, rows + [(5, ""), (5, None)]), minhash_dedup.near_groups(documents(spark, rows + [(5, ""), (5, None)])))
    assert sorted((r.doc_id or 0, r.text or "", r.h) for r in left.collect()) == [
        (0, "own words of no one", "b"), (1, a, "b"), (1, b, "b"), (5, "", "b"), (5, "", "b")
    ]


def test_copies_of_the_first_row_are_one(spark):
    rows = [(7, "one two three four five")] * 3 + [(8, "one two three four five")]
    left = minhash_dedup.one_of_each(documents(spark, rows), minhash_dedup.near_groups(documents(spark, rows))).collect()
    assert [(r.doc_id, r.text) for r in left] == [(7, "one two three four five")]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    made = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert made == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def brute_cut(pairs):
    seen, out = {}, {}
    for i, text in sorted(pairs):
        t = text.encode()
        hit = bytearray(len(t))
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            if w in seen:
                hit[p : p + 100] = b"\1" * 100
            else:
                seen[w] = (i, p)
        kept = bytes(c for c, h in zip(t, hit, strict=True) if not h)
        out[i] = (len(t), sum(hit), sum(h and (k == 0 or not hit[k - 1]) for k, h in enumerate(hit)), hashlib.sha256(kept).hexdigest())
    return out


def cut(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.cut_repeats(df).collect()}


@pytest.mark.parametrize("crowd", [256, 3])
def test_repeated_strings(spark, crowd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [word(n) for n in (99, 100, 101, 150, 400)]
    pairs = [(i, word(rng.randrange(40)) + rng.choice(passages)[rng.randrange(5) :] + word(rng.randrange(60)) + rng.choice(passages)) for i in range(40)]
    pairs += [(50, "ab" * 300), (51, "-" * 500), (52, "-" * 120 + "x"), (53, ""), (54, "short"), (55, pairs[3][1])]
    assert cut(documents(spark, pairs)) == brute_cut(pairs)


def test_repeated_strings_of_odd_rows(spark, odd, none):
    made = cut(odd)
    firsts = [(i, x or "") for i, x in dict((i, x) for i, x in ODD if i is not None).items()]
    assert {i: v for i, v in made.items() if i is not None} == brute_cut(firsts)
    assert cut(none) == {}


def signed(x):
    return xxhash.xxh64_intdigest(x.encode(), seed=42) - (1 << 64) * (xxhash.xxh64_intdigest(x.encode(), seed=42) >> 63)


def test_repeated_strings_of_rows_that_share_an_id(spark):
    """Different texts of one id, or of none, are different documents in the order of their hashes; equal ones are one."""
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [word(n) for n in (120, 200)]
    pairs = [(rng.choice([None, 1, 2, 3]), word(rng.randrange(30)) + rng.choice(passages) + word(rng.randrange(30))) for _ in range(40)]
    pairs += [(2, "short"), (2, word(300)), (None, "-" * 300), (None, "-" * 300), pairs[0], pairs[1]]
    made = sorted(tuple(r)[1:5] + (r.doc_id is None, r.doc_id or 0) for r in substring_dedup.cut_repeats(documents(spark, pairs)).collect())
    ranked = sorted(set(pairs), key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1])))
    want = brute_cut([(k, x) for k, (_, x) in enumerate(ranked)])
    place = {x: k for k, x in enumerate(ranked)}
    assert made == sorted(want[place[x]] + (x[0] is None, x[0] or 0) for x in pairs)


def test_very_long_repetitive_texts(spark):
    """A row per byte would be a million; one span is left."""
    made = {r.doc_id: r for r in substring_dedup.cut_repeats(documents(spark, [(1, "-" * 1_000_000), (2, "ab" * 400_000), (3, "x" + "-" * 150)])).collect()}
    assert (made[1].n_removed, made[1].n_spans) == (999_999, 1) and (made[2].n_removed, made[2].n_spans) == (799_998, 1) and made[3].n_removed == 150


def on_disk(spark):
    """Numbers of the shuffles that have files, and the names of staged tables."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    folder = pathlib.Path(shipping.shared_dir(spark).removeprefix("file://"))
    return set(re.findall(r"/shuffle_(\d+)_", files)), {x.name for x in folder.iterdir()} if folder.exists() else set()


def test_steps_of_repeated_strings_free_the_disk(spark):
    """Once the stretches are known, no shuffle but that of a count has files, and no table is left but theirs."""
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (150, 400)]
    pairs = [(i, "".join(rng.choice("abcdé ") for _ in range(60)) + passages[i % 2]) for i in range(20)]
    shuffles, tables = on_disk(spark)
    made = substring_dedup.cut_repeats(documents(spark, pairs))
    until = time.time() + 20
    while len(on_disk(spark)[0] - shuffles) > 1 and time.time() < until:  # Spark deletes them on the side
        time.sleep(0.2)
    found = on_disk(spark)
    assert len(found[0] - shuffles) <= 1 and len(found[1] - tables) == 1
    assert spark.conf.get(shipping.CLEANUP, "false") == "false"
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in made.collect()} == brute_cut(pairs)


def test_copies_of_a_page_count_once(spark):
    pages = [(i, f"home\nown {i}\nmore {i}") for i in range(0, 80, 2)] + [(2 * i, "home\nthe copied page\nits end") for i in range(100, 160)]
    made = {r.doc_id: r for r in line_dedup.drop_boilerplate(documents(spark, pages), copies=False).collect()}
    assert made[200].text == "the copied page\nits end" and made[318].n_dropped == 1
    assert made[4].text == "own 4\nmore 4"
    found = line_dedup.boilerplate_lines(documents(spark, pages), copies=False).collect()
    assert [(r.pages, r.host_pages) for r in found] == [(41, 41)]
