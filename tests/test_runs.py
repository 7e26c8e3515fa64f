import json

import pytest
from pyspark.sql import functions as F

from stratoscope.operators import pupil, select
from stratoscope.plans import udf
from stratoscope.sources import runs


def test_records_discovery_and_fingerprints(spark, tmp_path):
    new = {
        "created_at": "2026-08-01T10:00:00", "run": {"name": "eta", "tag": "main", "script": "fig1"},
        "dataset": {"alias": "pilot", "path": "/d", "rows": 3}, "code": {"short": "abc"}
    }
    old = {"run_name": "eta", "tag": "", "git": {"script": "scripts/fig2.py", "short": "def"}, "dataset": {"absolute_path": "/old"}}
    for name, record in (("260801_100000_main", new), ("250525_191022_canonical", old)):
        (tmp_path / "pilot" / name).mkdir(parents=True)
        (tmp_path / "pilot" / name / "provenance.json").write_text(json.dumps(record, indent=1))
    found = runs.discover(spark, str(tmp_path)).collect()
    assert [(r.run_id, r.created, r.tag, r.script, r.dataset_path, r.git_short) for r in found] == [
        ("260801_100000_main", "2026-08-01T10:00:00", "main", "fig1", "/d", "abc"),
        ("250525_191022_canonical", "2025-05-25T19:10:22", "canonical", "fig2", "/old", "def"),
    ]
    table = runs.discover(spark, str(tmp_path))
    assert runs.select_runs(table, since="260101").count() == 1 and runs.select_runs(table, run="2505", script="fig").count() == 1
    assert runs.newest(table, "name").first().run_id == "260801_100000_main"
    one = runs.fingerprint(spark, str(tmp_path)).first()
    assert one.n_files == 2 and len(one.sha256) == 64
    (tmp_path / "pilot" / "250525_191022_canonical" / "provenance.json").write_text("{}")
    assert runs.fingerprint(spark, str(tmp_path)).first().sha256 != one.sha256


def test_run_record_appends(spark, tmp_path):
    record = runs.run_record(
        spark, created_at="2026-01-01", analyst="a", lab="l", run={"name": "n", "tag": "", "script": "s"},
        dataset={"alias": "d", "path": "p", "sha256": "", "rows": 1}, code=None, params={"k": "v"}, env={}
    )
    for _ in range(2):
        runs.append_run(record, str(tmp_path / "runs"))
    made = spark.read.parquet(str(tmp_path / "runs"))
    assert made.count() == 2 and made.first().params == {"k": "v"}


def test_impossible_stamps(spark):
    df = spark.createDataFrame([("269901_x",), ("260801",), ("notes",)], "n string")
    when, tag = runs.parse_stamp(runs.F.col("n"))
    assert [(r[0], r[1]) for r in df.select(when, tag).collect()] == [(None, ""), ("2026-08-01T00:00:00", ""), (None, "")]


def test_missing_sessions_are_named(spark):
    df = spark.createDataFrame([("A", "s1"), ("B", "s2")], "subject string, session string")
    pupil.require_session(df.where("subject = 'A'"), "s1")
    with pytest.raises(ValueError, match="B"):
        pupil.require_session(df, "s1")


def test_missing_sources_and_channels_are_named(spark):
    """Beyond a thousand names too."""
    df = spark.range(3000).select(F.lit("A").alias("subject"), F.concat(F.lit("src"), F.col("id")).alias("source"), F.lit("speed_mm").alias("channel"), F.col("id").alias("sample"), F.lit(0.0).alias("t"))
    assert select.signal(df, "src2999", "speed_mm", required=True).count() == 1
    assert select.time_vector(df, "src2999", ("subject",), required=True).count() == 1
    with pytest.raises(LookupError, match="'src2999'"):
        select.time_vector(df, "scr2999", ("subject",), required=True)
    with pytest.raises(LookupError, match="speed_mm"):
        select.signal(df, "src7", "sped_mm", required=True)


def test_user_functions_may_skip(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 5.0)], "subject string, y double")
    made = udf.to_frame(df, lambda part: None if len(part) < 2 else {"top": part["y"].max()}, "top double", ("subject",))
    assert [(r.subject, r.top) for r in made.collect()] == [("A", 3.0)]
