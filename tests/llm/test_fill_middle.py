import hashlib
import random
import re

import pytest
from conftest import ODD, documents
from pyspark.sql import functions as F

from stratoscope.llm import fill_middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def plainly(key, text):
    """The contract, over a list of units."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    x, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    return len(units), *(("spm", len(x), len(m), f"<S>{s}<P>{x}<M>{m}") if h4 % 100 < 20 else ("psm", len(x), len(m), f"<P>{x}<S>{s}<M>{m}"))


def test_every_cut_of_the_index_is_that_of_the_units():
    rng = random.Random(4)
    for block in (1, 2, 3, 7, 64):
        for n in (0, 1, 2, 5, 40, 300):
            text = "".join(rng.choice("abZé🙂 \n\x00<ß") for _ in range(n))
            units, index = UNIT.findall(text), fill_middle.BlockIndex(text.encode(), block)
            assert (index.n, index.n_points) == (len(units), n)
            for k in range(len(units) + 1):
                before = "".join(units[:k])
                assert index.cut(k) == (len(before.encode()), len(before))


def test_outputs_equal_plain_ones_and_go_back(spark, odd):
    rng = random.Random(5)
    extra = [(100 + i, "".join(rng.choice("ab <>PSMé🙂\n") for _ in range(rng.randrange(60)))) for i in range(300)]
    extra += [(500, "a<P>b"), (501, "<S>"), (502, "x<M>"), (503, "<<P"), (504, "S><M"), (505, "é" * 40_000), (506, "a" * 100_000), (507, "é" * 40_000)]
    docs = odd.unionByName(documents(spark, extra))
    made = fill_middle.fill_in_middle(docs, ["doc_id", "text", "n_chars"]).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    rows = made.collect()
    assert len(rows) == len(ODD) + len(extra) and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plainly(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")


def test_other_sentinels_and_rates(spark, odd):
    fmt = fill_middle.FimFormat("␂pre␃", "␂suf␃", "␂mid␃", rate=100, spm_rate=50, seed=9)
    rows = fill_middle.fill_in_middle(odd, ["text"], fmt=fmt).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), fmt)).collect()
    assert all(r["back"] == (r["text"] or "") for r in rows) and all((r["form"] == "plain") == (not r["text"]) for r in rows)
    for bad in (("<P>", "<P>", "<M>"), ("<P", "<PP", "<M"), ("aba", "ac", "ad"), ("<P>", "[S]", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.FimFormat(*bad)


def test_empty_table(none):
    assert fill_middle.fim_report(none).count() == 0
