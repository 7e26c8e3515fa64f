import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stratoscope.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, digest string, block string, pos string, tree string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i % 2, level[i ^ 1] if i ^ 1 < len(level) else None))
        i //= 2
    return out


def plainly(rows):
    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, k)
            shown = (*r[:3], r[3] + 1, r[4]) if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r
            x = leaf(shown)
            for odd, other in steps:
                x = h(x) if other is None else h(other + x) if odd else h(x + other)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h("".join(o for _, o in steps if o)), x, x == top[-1][0]))
    return sorted(out, key=str)


def report(spark, rows):
    return sorted(map(tuple, merkle.manifest_report(spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA)).collect()), key=str)


def test_streaming_append_equals_whole_trees():
    for n in range(1, 70):
        digests = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        made = merkle.Witnesses()
        for d in digests:
            made.append(d)
        levels = tree([d.hex() for d in digests])
        root = made.close()
        assert root.hex() == levels[-1][0]
        for i, (d, w) in enumerate(zip(digests, made.witnesses, strict=True)):
            assert merkle.fold(d, bytes(w)) == root
            assert [x.hex() or None for _, x in merkle.siblings(bytes(w))] == [x for _, x in path(levels, i)]


@pytest.mark.parametrize("height", [1, 3, 8])
def test_report_equals_whole_trees(spark, monkeypatch, height):
    """Trees of several blocks and levels; null and empty fields, many groups, one group with most rows, repeated rows and ids."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rng = random.Random(height)
    rows = [(i, f"s{i % 3}", "en", i % 50, f"text {i} é") for i in range(150)] + [(i, None, f"l{i:02}", None, None) for i in range(200, 240)]
    rows += [(i, "", rng.choice(["de", "é", "", None]), None if i % 5 == 0 else 7, "") for i in range(300, 380)]
    rows += [(5, "s2", "en", 5, "text 5 é"), (5, "s2", "en", 5, "other"), (None, "s", "en", 2**63 - 1, "x"), (None, "s", None, 1, "x"), (-7, "s", "en", 2**63 - 1, "y" * 200_000)]
    rows += [(i, "s", "en", 2**63 - 1, "x") for i in range(400, 420)] + [(9, "s", "fr", 1, "same")] * 37
    rng.shuffle(rows)
    assert report(spark, rows) == plainly(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 256, 257])
def test_sizes_at_the_edge_of_a_block(spark, n):
    rows = [(i, "s", "en", 1, str(i)) for i in range(n)]
    assert report(spark, rows) == (plainly(rows) if n else [])


def test_a_changed_row_changes_every_root_above_it(spark):
    rows = [(i, "s", "en" if i % 2 else "de", 1, str(i)) for i in range(9)]
    a, b = report(spark, rows), report(spark, [*rows[:4], (4, "s", "de", 1, "?"), *rows[5:]])
    assert {x[3] for x in a} != {x[3] for x in b} and [x[2] for x in a if x[0] % 2] == [x[2] for x in b if x[0] % 2]


def test_leaves_of_any_columns(spark):
    made = spark.range(3).select(merkle.leaf_digest(F.col("id"), F.lit(None).cast("string"), F.lit("ü")).alias("d"))
    assert [r["d"] for r in made.collect()] == [h(f"1:{i}-2:ü") for i in range(3)]
