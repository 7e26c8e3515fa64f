import sys

from conftest import documents

import corpus_pipeline
from stratoscope.shipping import clear_shared


def test_stages_take_effect_and_keep_clean_documents(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = corpus_pipeline.staged(stage(spark, seen[-1], sf))
        if i < 4:
            assert made.columns == docs.columns
        seen.append(made)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert ids[1] == ids[2] and ids[4] == ids[5] and len(ids[5]) > 0.5 * len(ids[0])
    bench = corpus_pipeline.decontaminate.contamination(seen[3], spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert ids[4] == {r.doc_id for r in bench.where("not contaminated").collect()}
    near = corpus_pipeline.minhash_dedup.near_groups(seen[2], size=5)
    assert ids[3] == {r.doc_id for r in near.where("kept").collect()}
    assert seen[5].where("not lossless").count() == 0
    final = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in final.select("doc_id").collect()} == ids[5]
    clear_shared(spark)


def test_odd_rows_and_empty_tables(spark, sf):
    """A row that repeats another is a copy, of which near dedup leaves one."""
    for pairs, left in (([(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (None, "x")], 4), ([], 0)):
        df = documents(spark, pairs)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = corpus_pipeline.staged(stage(spark, df, sf))
        assert df.count() == left


def test_columns_of_any_name_pass_through(spark, sf):
    """Names that operators use themselves, and one with a dot."""
    docs = documents(spark, [(i, f"a page of words numbered {i} " * 3) for i in range(8)])
    own = [c for c in docs.columns if c not in ("text", "n_chars")]
    want = {r["doc_id"]: tuple(r[c] for c in own) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, sf)
        assert made.columns == docs.columns, name
        rows = made.collect()
        assert rows and all(tuple(r[c] for c in own) == want[r["doc_id"]] for r in rows), name


def test_entry_names_the_pipeline():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "corpus_pipeline" in sys.modules


def test_a_page_in_many_copies_keeps_its_text(spark, sf):
    pages = [(2 * i, f"own line {i}\nand another {i}") for i in range(40)] + [(2 * i, "a copied page\nwith clean content") for i in range(100, 120)]
    cut = corpus_pipeline.staged(corpus_pipeline.drop_lines(spark, documents(spark, pages), sf))
    left = corpus_pipeline.drop_near_duplicates(spark, cut, sf).where("doc_id >= 200").collect()
    assert [(r.doc_id, r.text) for r in left] == [(200, "a copied page\nwith clean content")]
