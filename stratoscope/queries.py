"""Registered queries over the given tables, each with the SQL that gives the same rows where SQL can.

The ``events`` table stands for recordings: a user is a subject and its events in time are samples; an event type is a channel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import event_samples, ordered, read_table
from .operators import asof, eta, events, intervals, locomotion, oscillation, preproc, pupil, reference, segments, select, spectral, summary
from .plans import udf
from .functions import filters, labels
from .shipping import shared_path
from .sources import runs, tables
from .streaming import online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
U = ("subject",)
UC = ("subject", "channel")
C = ("channel",)
HOUR = 3600.0
TYPES = ("click", "error", "purchase", "signup", "view")

EV = """ev AS (SELECT 'U' || user_id AS subject, 'ses-' || lpad(CAST(CAST(floor(t / 604800) + 1 AS BIGINT) AS VARCHAR), 2, '0') AS session,
  'task-spont' AS task, 'clicks' AS source, event_type AS channel, event_id AS sample, t, value AS y
  FROM (SELECT *, (epoch_us(ts) - 1704067200000000) / 1e6 AS t FROM events))"""


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def r6(*names: str) -> list[Column]:
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]


def q6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def epochs_sql(name: str, src: str = "ev", key: str = "subject", mask: str = "y > 30", merge: float = HOUR, least: float = 0.0, gap: float = 1e18) -> str:
    """CTEs that end in one of this name with the epochs of the mask."""
    w = f"PARTITION BY {key} ORDER BY"
    return f"""
  {name}_p AS (SELECT *, row_number() OVER ({w} t, sample) - 1 AS idx, t - lag(t) OVER ({w} t, sample) AS gap FROM {src}),
  {name}_m AS (SELECT *, CASE WHEN idx - lag(idx, 1, -2) OVER ({w} idx) > 1 OR coalesce(gap, 0) > {gap} THEN 1 ELSE 0 END AS new FROM {name}_p WHERE {mask}),
  {name}_r AS (SELECT {key}, run, min(idx) AS a, max(idx) AS b, min(t) AS s, max(t) AS e FROM (SELECT *, sum(new) OVER ({w} idx) AS run FROM {name}_m)
 GROUP BY {key}, run),
  {name}_g AS (SELECT *, CASE WHEN s - lag(e) OVER ({w} a) <= {merge} THEN 0 ELSE 1 END AS new FROM {name}_r),
  {name}_x AS (SELECT {key}, min(a) AS start_idx, max(b) AS end_idx, min(s) AS start_s, max(e) AS end_s FROM (SELECT *, sum(new) OVER ({w} a) AS grp
 FROM {name}_g) GROUP BY {key}, grp),
  {name}_d AS (SELECT {key}, coalesce(median(gap), 0) AS step FROM {name}_p GROUP BY {key}),
  {name} AS (SELECT x.*, end_s - start_s + step AS duration_s, row_number() OVER ({w} start_idx) - 1 AS epoch_id FROM {name}_x x JOIN {name}_d d USING ({key})
             WHERE end_s - start_s + step >= {least})"""


def bouts_of(samples: DataFrame, least: float = 0.0) -> DataFrame:
    return segments.detect_epochs(samples, F.col("y") > 30, "bout", least, HOUR, None, U)


# --- A: sources, tables and views -------------------------------------------------------------------------------------


@register("""SELECT 'V' || vec_id AS subject, 'ses-' || lpad(CAST(label AS VARCHAR), 2, '0') AS session, i - 1 AS sample, CAST(vec[i] AS DOUBLE) AS y
FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM (SELECT *, embedding AS vec FROM embeddings))""")
def a2_wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    wide = read_table(spark, sf, "embeddings").select(
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("subject"), F.concat(
            F.lit("ses-"), F.lpad(F.col("label").cast("string"), 2, "0")
        ).alias("session"), F.col("embedding").cast("array<double>").alias("trace__y")
    )
    return tables.wide_to_long(wide, "trace", {"y": "trace__y"}, ("subject", "session"))


@register(
    """SELECT 'C' || c_custkey AS subject, c_mktsegment AS session, c_name AS customer__name, CASE WHEN NOT isnan(c_acctbal) THEN c_acctbal END AS customer__acctbal FROM customer"""
)
def a4_recordings_table(spark: SparkSession, sf: str) -> DataFrame:
    wide = read_table(spark, sf, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("subject"), F.col("c_mktsegment").alias("session"),
        F.col("c_name").alias("customer__name"), F.col("c_acctbal").alias("customer__acctbal")
    )
    return tables.recordings_table(wide, ["customer__name", "customer__acctbal"], ("subject", "session"))


@register(f"""WITH {EV} SELECT subject, session, channel, y, CAST(NULL AS DOUBLE) AS t FROM ev WHERE channel = 'click'
UNION ALL SELECT subject, session, channel, CAST(NULL AS DOUBLE), t FROM ev WHERE channel = 'view'""")
def a5_append(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    return tables.append_rows(
        own.where("channel = 'click'").select("subject", "session", "channel", "y"),
        own.where("channel = 'view'").select("subject", "session", "channel", "t")
    )


@register("""SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS key_text, CAST(o_totalprice AS DOUBLE) AS price_text FROM orders""")
def a7_typed_columns(spark: SparkSession, sf: str) -> DataFrame:
    text = read_table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("key_text"), F.col("o_totalprice").cast("string").alias("price_text")
    )
    return tables.typed(text, "key_text", "price_text")


@register("""SELECT 'C' || c_custkey AS subject, c_mktsegment AS session, c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer""")
def a1_opened_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A wide table saved as CSV in the shared folder and opened again."""
    path = shared_path(spark) + ".csv"
    wide = read_table(spark, sf, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("subject"), F.col("c_mktsegment").alias("session"), "c_nationkey", "c_acctbal"
    )
    tables.save_table(wide, path)
    return tables.open_dataset(spark, path).select("subject", "session", F.col("c_nationkey").cast(wide.schema["c_nationkey"].dataType), "c_acctbal")


@register(
    """SELECT 'head' AS feature, bool_or(len(embedding) > 3) AS own_table FROM embeddings UNION ALL SELECT 'same', false UNION ALL SELECT 'lacking', false"""
)
def a3_split_features(spark: SparkSession, sf: str) -> DataFrame:
    """Which of three features fit the embedding as a time vector: itself, its first three numbers, and a column without any."""
    wide = read_table(spark, sf, "embeddings").select(
        F.col("embedding").alias("time"), F.slice("embedding", 1, 3).alias("head"), F.lit(None).cast("array<double>").alias("lacking")
    )
    fit, own = tables.split_features(wide, "time", {"same": "time", "head": "head", "lacking": "lacking"})
    named = lambda names, kind: wide.limit(1).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"), F.lit(kind).alias("own_table")
    )
    return named(fit, False).union(named(own, True))


@register("""SELECT 'C' || c_custkey AS subject, c_mktsegment AS session, c_name AS full_name, c_acctbal AS acct_bal__per_day FROM customer""")
def a6_sql_names(spark: SparkSession, sf: str) -> DataFrame:
    wide = read_table(spark, sf, "customer").select(
        F.concat(
            F.lit("C"), F.col("c_custkey").cast("string")
        ).alias("subject"), F.col("c_mktsegment").alias("session"), F.col("c_name").alias("full name"), F.col("c_acctbal").alias("acct-bal__per day")
    )
    return tables.recordings_table(wide, ["full name", "acct-bal__per day"], ("subject", "session"))


@register("""SELECT s_suppkey, s_name, s_nationkey FROM supplier""")
def a15_saved_table(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark) + ".json"
    own = read_table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    tables.save_table(own, path)
    return spark.read.schema(own.schema).json(path)


def _recordings(own: DataFrame) -> DataFrame:
    """One row per recording with all scalars of a session, made from its number of samples, its values and its first time."""
    n, day = F.count("*"), F.floor(F.min("t") / 86400)
    return own.groupBy("subject", "session", "task").agg(
        n.cast("string").alias("session_config__duration"),
        day.cast("string").alias("condition"),
        F.when(n % 2 == 0, "F").otherwise("M").alias("session_config__sex"),
        F.concat(F.lit("g"), (n % 3).cast("string")).alias("session_config__genotype"),
        (n % 10).alias("session_config__cage_id"),
        F.concat(F.lit("2023-10-1"), (n % 10).cast("string")).alias("session_config__DOB"),
        F.round(F.max("y"), 3).alias("session_config__weight_g"),
        F.round(F.min("y"), 3).alias("session_config__inj_vol_mL"),
        F.concat(F.lit("p"), (n % 4).cast("string")).alias("session_config__protocol"),
    )


RECORDINGS = """rec AS (SELECT subject, session, task, CAST(count(*) AS VARCHAR) AS session_config__duration,
 CAST(CAST(floor(min(t) / 86400) AS BIGINT) AS VARCHAR) AS condition, count(*) AS n, round(max(y), 3) AS w, round(min(y), 3) AS v FROM ev GROUP BY ALL)"""


@register(f"""WITH {EV}, {RECORDINGS} SELECT subject, session, task, condition, CAST(regexp_replace(session, '^[^0-9]*([0-9]+).*$', '\\1') AS INTEGER)
 AS ses_num,
 CAST(n AS INTEGER) AS duration_s, CASE WHEN n % 2 = 0 THEN 'F' ELSE 'M' END AS sex, 'g' || n % 3 AS genotype, n % 10 AS cage_id, '2023-10-1' || n % 10 AS dob,
 w AS weight_g, v AS inj_vol_ml, 'p' || n % 4 AS protocol FROM rec""")
def a8_sessions_view(spark: SparkSession, sf: str) -> DataFrame:
    return tables.sessions_view(_recordings(event_samples(spark, sf)))


@register(f"""WITH {EV}, k AS (SELECT subject, channel, t, row_number() OVER (PARTITION BY subject, channel ORDER BY sample) AS i FROM ev),
 d AS (SELECT a.subject, a.channel, quantile_cont(b.t - a.t, 0.5) AS step FROM k a JOIN k b ON b.subject = a.subject AND b.channel = a.channel AND b.i
 = a.i + 1 GROUP BY ALL),
 e AS (SELECT subject, channel, max(i) AS n_samples, min(t) AS t_start_s, max(t) AS t_stop_s FROM k GROUP BY ALL)
SELECT subject, channel AS source, n_samples, {q6("t_start_s", "t_stop_s")}, round(1e6 / step, 4) AS rate_uhz FROM e LEFT JOIN d USING (subject, channel)""")
def a9_coverage_view(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf).withColumn("source", F.col("channel"))
    made = tables.coverage(own, ("subject", "source"))
    return made.select("subject", "source", "n_samples", *r6("t_start_s", "t_stop_s"), F.round(F.col("rate_hz") * 1e6, 4).alias("rate_uhz"))


def _mesomap(own: DataFrame) -> DataFrame:
    side = lambda c: "L" if c < "f" else "R"
    return own.select("subject", "session", "task", "sample", "t", *[F.when(F.col("channel") == c, F.col("y")).alias(f"{side(c)}_{c}") for c in TYPES])


PARCELS = ("L_click", "L_error", "R_purchase", "R_signup", "R_view")
PARCEL_CASE = "CASE WHEN channel < 'f' THEN 'L_' ELSE 'R_' END || channel"


@register(f"""WITH {EV} SELECT {PARCEL_CASE} AS parcel, CASE WHEN channel < 'f' THEN 'L' ELSE 'R' END AS hemisphere, channel AS region, count(DISTINCT
 subject || session) AS n_recordings FROM ev GROUP BY channel""")
def a10_parcels_view(spark: SparkSession, sf: str) -> DataFrame:
    return tables.parcels_view(_mesomap(event_samples(spark, sf)), PARCELS)


@register(f"""WITH {EV}, {RECORDINGS} SELECT subject, session, task, condition, sample, t AS time_s, {PARCEL_CASE} AS parcel, CASE WHEN channel < 'f'
 THEN 'L' ELSE 'R' END AS hemisphere, channel AS region, y AS dff FROM ev JOIN rec USING (subject, session, task)""")
def a11_mesomap_long_view(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    return tables.mesomap_long_view(_mesomap(own), PARCELS, _recordings(own))


@register(f"""WITH {EV}, {RECORDINGS} SELECT subject, session, task, condition, sample, t AS time_s, y AS pupil_diameter_mm FROM ev JOIN rec USING
 (subject, session, task) WHERE channel = 'view'""")
def a12_pupil_view(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    return tables.labelled_view(own.where("channel = 'view'"), _recordings(own), {"pupil_diameter_mm": "y"})


@register(f"""WITH {EV}, {RECORDINGS}, k AS (SELECT *, row_number() OVER (PARTITION BY subject, session, task ORDER BY sample) AS i FROM ev WHERE
 channel = 'click')
SELECT k.subject, k.session, k.task, condition, k.sample, k.t AS time_s, k.y AS speed_mm_s, k.y * 2 AS distance_mm, round(k.t - before.t, 6) AS gap_s
FROM k JOIN rec USING (subject, session, task) LEFT JOIN k before ON before.subject = k.subject AND before.session = k.session AND before.task =
 k.task AND before.i = k.i - 1""")
def a13_locomotion_view(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    wheel = own.where("channel = 'click'").select(
        "subject", "session", "task", "sample", "t", F.col("y").alias("speed_mm"), (F.col("y") * 2).alias("distance_mm")
    )
    return tables.locomotion_view(wheel, _recordings(own)).withColumn("gap_s", F.round("gap_s", 6))


@register("""SELECT CAST(max(ts) AS VARCHAR) AS created_at, 'events' AS alias, count(*) AS rows, CAST(count(DISTINCT user_id) AS VARCHAR) AS users, 2 AS times
FROM events""")
def a16_run_record(spark: SparkSession, sf: str) -> DataFrame:
    """A record of a run over the events, appended twice and read back."""
    known = read_table(spark, sf, "events").agg(F.max("ts").cast("string").alias("at"), F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).first()
    record = runs.run_record(
        spark, created_at=known["at"], analyst="a", lab="l", run={"name": "count", "tag": "", "script": "s"},
        dataset={"alias": "events", "path": f"{sf}/events.parquet", "sha256": "", "rows": known["n"]}, code=None, params={"users": str(known["users"])}, env={}
    )
    path = shared_path(spark)
    for _ in range(2):
        runs.append_run(record, path)
    kept = spark.read.parquet(path)
    return kept.groupBy("created_at", "dataset.alias", "dataset.rows", kept["params"]["users"].alias("users")).agg(F.count("*").cast("int").alias("times"))


@register("""WITH m AS (SELECT concat_ws(':', o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT)) AS line, substr(sha256(CAST(o_orderkey
 AS VARCHAR)), 1, 3) AS part, o_custkey AS n FROM orders),
 p AS (SELECT part, sha256(string_agg(line, chr(10) ORDER BY line)) AS h, count(*) AS c, sum(n) AS n FROM m GROUP BY part)
SELECT sha256(string_agg(part || ':' || h, chr(10) ORDER BY part)) AS sha256, CAST(sum(c) AS BIGINT) AS n_files, CAST(sum(n) AS BIGINT) AS bytes FROM p""")
def a17_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return runs.fingerprint_of(
        o.select(
            F.col("o_orderkey").cast("string").alias("name"), F.col("o_custkey").cast("long").alias("length"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("crc")
        )
    )


def _run_table(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    stamp = F.concat_ws("_", F.date_format("o_orderdate", "yyMMdd"), F.lpad((F.col("o_orderkey") % 240000).cast("string"), 6, "0"), F.col("o_orderpriority"))
    when, tag = runs.parse_stamp(stamp)
    return o.select(
        stamp.alias("run_id"), F.col("o_orderstatus").alias("alias"),
        F.concat(F.lit("script"), (F.col("o_custkey") % 7).cast("string")).alias("script"), tag.alias("tag"), when.alias("created")
    )


RUNS = """ids AS (SELECT *, strftime(o_orderdate, '%y%m%d') || '_' || lpad(CAST(o_orderkey % 240000 AS VARCHAR), 6, '0') || '_' || o_orderpriority AS
 run_id FROM orders),
 made AS (SELECT *, try_strptime('20' || regexp_extract(run_id, '^(\\d{6})_(\\d{6})_(.+)$', 1) || regexp_extract(run_id, '^(\\d{6})_(\\d{6})_(.+)$',
 2), '%Y%m%d%H%M%S') AS w FROM ids),
 runs AS (SELECT run_id, o_orderstatus AS alias, 'script' || (o_custkey % 7) AS script, CASE WHEN w IS NULL THEN '' ELSE o_orderpriority END AS tag,
 strftime(w, '%Y-%m-%dT%H:%M:%S') AS created FROM made)"""


@register(f"WITH {RUNS} SELECT run_id, tag, created FROM runs")
def a19_run_stamps(spark: SparkSession, sf: str) -> DataFrame:
    return _run_table(spark, sf).select("run_id", "tag", "created")


@register("""SELECT 'r' || o_custkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'old ' || o_orderpriority END AS tag, CASE WHEN
 o_orderkey % 2 = 0 THEN 's' || o_custkey ELSE 'plot' || o_custkey END AS script,
 CASE WHEN o_orderkey % 2 = 0 THEN 'main' ELSE '' END AS alias, '/data/' || o_orderstatus AS dataset_path, CASE WHEN o_orderkey % 2 = 0 THEN
 o_orderkey ELSE -1 END AS rows FROM orders""")
def a20_normalised_records(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    name, status = F.concat(F.lit("r"), F.col("o_custkey").cast("string")), F.concat(F.lit("/data/"), F.col("o_orderstatus"))
    new = F.to_json(
        F.struct(
            F.struct(
                name.alias("name"), F.col("o_orderpriority").alias("tag"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("script")
            ).alias("run"),
            F.struct(F.lit("main").alias("alias"), status.alias("path"), F.col("o_orderkey").alias("rows")).alias("dataset")
        )
    )
    old = F.to_json(
        F.struct(
            name.alias("run_name"), F.concat(F.lit("old "), F.col("o_orderpriority")).alias("tag"),
            F.struct(F.concat(F.lit("scripts/plot"), F.col("o_custkey").cast("string"), F.lit(".py")).alias("script")).alias("git"),
            F.struct(status.alias("absolute_path")).alias("dataset")
        )
    )
    made = runs.normalise(o.select(F.when(F.col("o_orderkey") % 2 == 0, new).otherwise(old).alias("json")))
    return made.select("name", "tag", "script", "alias", "dataset_path", F.coalesce("rows", F.lit(-1)).cast("long").alias("rows"))


@register("""SELECT CAST(l_orderkey AS VARCHAR) AS run_id, count(DISTINCT l_partkey) FILTER (WHERE l_linenumber % 5 < 2) AS figure, count(*) FILTER
 (WHERE l_linenumber % 5 = 2) AS "table",
 count(*) FILTER (WHERE l_linenumber % 5 = 3) AS doc, count(*) FILTER (WHERE l_linenumber % 5 = 4) AS other FROM lineitem GROUP BY l_orderkey""")
def a21_file_counts(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("svg", "png", "csv", "md", "bin")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    files = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.lit("figs").alias("dir"),
        F.concat_ws(".", F.col("l_partkey").cast("string"), suffix).alias("name")
    )
    return runs.file_counts(files)


@register(f"""WITH {RUNS} SELECT run_id, alias, script, tag, created FROM runs WHERE alias = 'F' AND contains(script, 'script3') AND contains(tag,
 'HIGH') AND coalesce(created, '') >= '1996-08-01'""")
def a23_select_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.select_runs(
        _run_table(spark, sf), alias="F", script="script3", tag="HIGH", since="1996-08-01"
    ).select("run_id", "alias", "script", "tag", "created")


@register(f"""WITH {RUNS} SELECT alias, script, max(created) AS created, arg_max(run_id, {{'c': coalesce(created, ''), 'r': run_id}}) AS run_id FROM
 runs GROUP BY alias, script""")
def a23_newest_run(spark: SparkSession, sf: str) -> DataFrame:
    return runs.newest(_run_table(spark, sf), "alias", "script")


# --- B: selection and labels ------------------------------------------------------------------------------------------


@register(f"WITH {EV} SELECT subject, session, channel, y FROM ev WHERE subject IN ('U1', 'U2', 'U3') AND session = 'ses-02'")
def b4_include(spark: SparkSession, sf: str) -> DataFrame:
    return select.include(event_samples(spark, sf), Subject=["U1", "U2", "U3"], SESSION="ses-02", nothing="x").select("subject", "session", "channel", "y")


@register(f"WITH {EV} SELECT subject, session, channel, y FROM ev WHERE NOT (subject IN ('U1', 'U2', 'U3') OR session = 'ses-02')")
def b5_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return select.exclude(event_samples(spark, sf), subject=["U1", "U2", "U3"], session="ses-02").select("subject", "session", "channel", "y")


@register(f"""WITH {EV} SELECT subject, session, channel, y FROM ev WHERE NOT ((subject = 'U1' AND session = 'ses-01') OR (subject IN ('U4', 'U5') AND
 session = 'ses-03') OR session = 'ses-05')""")
def b6_drop_rows(spark: SparkSession, sf: str) -> DataFrame:
    spec = [("U1", "ses-01"), {"subject": ["U4", "U5"], "session": "ses-03"}, {"session": "ses-05"}]
    return select.drop_rows(event_samples(spark, sf), spec).select("subject", "session", "channel", "y")


@register(f"""WITH {EV} SELECT e.subject, e.session, e.channel, e.y FROM ev e WHERE NOT EXISTS (SELECT 1 FROM (SELECT subject, session FROM ev GROUP
 BY ALL HAVING count(*) < 10) s WHERE s.subject = e.subject AND s.session = e.session)""")
def b6_drop_listed(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    few = own.groupBy("subject", "session").count().where("count < 10").select("subject", "session")
    return select.drop_listed(own, few).select("subject", "session", "channel", "y")


@register(f"WITH {EV} SELECT DISTINCT session FROM ev")
def b8_listing(spark: SparkSession, sf: str) -> DataFrame:
    return select.listing(event_samples(spark, sf), "session")


@register(f"""WITH {EV} SELECT subject, session, source, channel, count(*) AS n, {q6('t_start_s', 't_stop_s')} FROM (SELECT *, min(t) OVER w AS
 t_start_s, max(t) OVER w AS t_stop_s FROM ev WINDOW w AS (PARTITION BY subject, session, channel)) GROUP BY ALL""")
def b9_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return select.inventory(event_samples(spark, sf)).select("subject", "session", "source", "channel", "n", *r6("t_start_s", "t_stop_s"))


@register(f"WITH {EV}, r AS (SELECT DISTINCT subject, session FROM ev) SELECT session, count(*) AS n_recordings FROM r GROUP BY session")
def b9_recordings_per_session(spark: SparkSession, sf: str) -> DataFrame:
    return select.recordings_per(event_samples(spark, sf), "session")


@register(f"""WITH {EV}, c AS (SELECT subject, channel, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT subject, max(n) AS n_t FROM c GROUP BY
 subject) SELECT subject, channel, n FROM c JOIN t USING (subject) WHERE n >= greatest(1, floor(0.5 * n_t))""")
def b10_signals(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    times = own.groupBy("subject", "source", "channel").count().groupBy("subject", "source").agg(F.max("count").alias("n_t"))
    return select.signals_of(own, times, U).select("subject", "channel", "n")


@register(f"WITH {EV} SELECT subject, session, task, sample, t FROM ev WHERE channel = 'view'")
def b12_time_vector(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf).withColumn("source", F.col("channel"))
    return select.time_vector(own, "view")


@register("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS source FROM orders""")
def b13_source_alias(spark: SparkSession, sf: str) -> DataFrame:
    aliases = spark.createDataFrame([("F", "finished"), ("O", "open")], "alias string, canonical string")
    return select.resolve_sources(
        read_table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("source")), aliases
    ).select("o_orderkey", "source")


@register(f"""WITH {EV} SELECT source, channel, CASE channel WHEN 'click' THEN 'timeseries' WHEN 'error' THEN 'event' END AS role, CASE channel WHEN
 'click' THEN 'mm' END AS unit, count(*) AS n FROM ev GROUP BY ALL""")
def b14_roles(spark: SparkSession, sf: str) -> DataFrame:
    specs = spark.createDataFrame(
        [("clicks", "click", "timeseries", "mm"), ("clicks", "error", "event", None)], "source string, channel string, role string, unit string"
    )
    return select.with_roles(event_samples(spark, sf).groupBy("source", "channel").agg(F.count("*").alias("n")), specs)


@register(
    """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'R' ELSE l_returnflag END AS task, CASE WHEN l_returnflag IN ('A', 'R') THEN 'Returned' ELSE l_returnflag END AS task_label FROM lineitem"""
)
def b15_canonical_tasks(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("A", "R", "Returned"), ("R", None, "Returned")], "alias string, canonical string, label string")
    return select.canonical_tasks(
        read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("task")), rules
    ).select("l_orderkey", "l_linenumber", "task", "task_label")


@register(f"""WITH {EV}, r AS (SELECT subject, session, CASE WHEN count(*) % 3 = 0 THEN ' NaN ' WHEN count(*) % 3 = 1 THEN ' saline' END AS recorded
 FROM ev GROUP BY ALL)
SELECT subject, session, CASE WHEN subject = 'U7' AND session = 'ses-01' THEN 'own' WHEN recorded = ' saline' THEN 'saline' WHEN session = 'ses-02'
 THEN 'Baseline' ELSE '' END AS condition FROM r""")
def b17_conditions(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*") % 3
    rec = event_samples(spark, sf).groupBy("subject", "session").agg(F.when(n == 0, " NaN ").when(n == 1, " saline").alias("recorded"))
    rules = spark.createDataFrame([("U7", "ses-01", "own"), (None, "ses-02", "Baseline")], "subject string, session string, condition string")
    return select.with_conditions(rec, rules).select("subject", "session", "condition")


@register(f"WITH {EV} SELECT DISTINCT subject, session, CASE WHEN subject = 'U3' AND session = 'ses-02' THEN 'drug' ELSE 'spont' END AS condition FROM ev")
def b19_condition_map(spark: SparkSession, sf: str) -> DataFrame:
    rec = select.recordings_of(event_samples(spark, sf))
    return rec.select("subject", "session", labels.condition_from_map({"U3,ses-02,task-spont": "drug", "task-spont": "spont"}).alias("condition"))


@register(f"""WITH {EV}, s AS (SELECT DISTINCT subject, session FROM ev) SELECT subject, session, TRY_CAST(regexp_extract(trim(session),
 '^ses-(\\d+)$', 1) AS INTEGER) AS day, TRY_CAST(regexp_extract(subject, '(\\d+)$', 1) AS DOUBLE) AS trailing,
 TRY_CAST(regexp_extract(session, '(\\d+)', 1) AS DOUBLE) AS session_n, CASE session WHEN 'ses-01' THEN 'first' END AS label, substr(session, 5) AS
 bare FROM s""")
def b21_session_labels(spark: SparkSession, sf: str) -> DataFrame:
    rec = event_samples(spark, sf).select("subject", "session").distinct()
    made = select.with_session_number(rec).withColumn("day", labels.session_day("session")).withColumn("trailing", labels.trailing_number("subject"))
    return made.withColumn("label", labels.mapped(F.col("session"), {"ses-01": "first"})).withColumn("bare", labels.strip_prefix(F.col("session"), "SES-"))


@register(f"WITH {EV} SELECT DISTINCT session, TRY_CAST(regexp_extract(session, '(\\d+)', 1) AS DOUBLE) AS session_n FROM ev")
def b24_sorted_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return select.sorted_sessions(event_samples(spark, sf))


@register(f"WITH {EV} SELECT subject, min(sample) AS first_sample, max(sample) AS last_sample FROM ev WHERE t BETWEEN 86400 AND 864000 GROUP BY subject")
def b29_time_window(spark: SparkSession, sf: str) -> DataFrame:
    return select.window_bounds(select.clean_xy(event_samples(spark, sf)), (864000.0, 86400.0), U)


@register("""SELECT p_partkey, acronym, CASE WHEN acronym IN ('VISp', 'VISl') THEN 'Vis' WHEN acronym IN ('MOs', 'MOp') THEN 'Mo' WHEN acronym = 'PL'
 THEN 'Front' ELSE 'Other' END AS grp,
 CASE WHEN acronym = 'VISp' THEN 'Visual primary' WHEN acronym = 'VISl' THEN 'Visual higher' WHEN acronym IN ('MOs', 'MOp') THEN 'Motor' END AS roi,
 CASE WHEN p_partkey % 2 = 0 THEN 'L' ELSE 'R' END AS hemisphere
 FROM (SELECT p_partkey, ['VISp', 'VISl', 'MOs', 'MOp', 'PL', 'XX'][1 + p_partkey % 6] AS acronym FROM part)""")
def b31_regions(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in ("VISp", "VISl", "MOs", "MOp", "PL", "XX")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    region = F.concat(F.when(F.col("p_partkey") % 2 == 0, "L_").otherwise("R_"), name)
    return read_table(spark, sf, "part").select(
        "p_partkey", labels.region_acronym(region).alias("acronym"), labels.region_group(region).alias("grp"), labels.roi_group(region).alias("roi"),
        labels.hemisphere(region).alias("hemisphere")
    )


@register(f"""WITH {EV} SELECT subject, arg_min(channel, r) AS feature FROM (SELECT DISTINCT subject, channel, CASE channel WHEN 'view' THEN 1 WHEN
 'click' THEN 5 END AS r FROM ev WHERE channel IN ('view', 'click')) GROUP BY subject""")
def b34_pick_feature(spark: SparkSession, sf: str) -> DataFrame:
    return select.pick_feature(event_samples(spark, sf), ["view", "CLICK", "zoom"], U)


@register(f"WITH {EV} SELECT subject, coalesce(max(CASE WHEN channel = 'signup' THEN channel END), min(channel)) AS default_column FROM ev GROUP BY subject")
def b35_default_column(spark: SparkSession, sf: str) -> DataFrame:
    specs = spark.createDataFrame([("clicks", "signup", "timeseries", None)], "source string, channel string, role string, unit string")
    return select.default_column(event_samples(spark, sf), specs, ("subject", "source")).select("subject", "default_column")


@register(f"""WITH {EV}, z AS (SELECT *, round(t - first_value(t) OVER (PARTITION BY subject ORDER BY sample), 6) AS t0 FROM ev) SELECT subject,
 sample, t0 FROM z WHERE sample % 4 = 0""")
def b37_zeroed_decimated(spark: SparkSession, sf: str) -> DataFrame:
    return select.decimate(asof.zeroed(event_samples(spark, sf), U), 4).select("subject", "sample", F.round("t", 6).alias("t0"))


# --- C: joins ---------------------------------------------------------------------------------------------------------

SIDES = "a AS (SELECT subject, sample, t FROM ev WHERE channel = 'click'), b AS (SELECT subject, t, y FROM ev WHERE channel = 'view')"
NEAR = f"""{SIDES}, p AS (SELECT a.*, b.t AS pt, b.y AS py FROM a ASOF LEFT JOIN b ON a.subject = b.subject AND a.t >= b.t),
 n AS (SELECT p.*, b.t AS nt, b.y AS ny FROM p ASOF LEFT JOIN b ON p.subject = b.subject AND p.t <= b.t)"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = event_samples(spark, sf)
    return own.where("channel = 'click'").select("subject", "sample", "t"), own.where("channel = 'view'").select("subject", "sample", "t", "y")


@register(f"""WITH {EV}, {NEAR}, c AS (SELECT *, CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN pt ELSE nt END AS ct, CASE WHEN pt
 IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN py ELSE ny END AS cy FROM n)
SELECT subject, sample, t, CASE WHEN abs(ct - t) <= 21600 THEN ct END AS source_t, CASE WHEN abs(ct - t) <= 21600 THEN cy END AS y FROM c""")
def c1_align_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return asof.align_nearest(*_sides(spark, sf), 21600.0, U)


@register(SQL["c1_align_nearest"])
def c1_align_in_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Each recording in slices of four days."""
    return asof.align_nearest(*_sides(spark, sf), 21600.0, U, slice_s=345600.0)


@register(f"""WITH {EV}, {NEAR.replace("a AS (SELECT subject, sample, t FROM", "a AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY sample) - 1 AS sample, t, y AS click FROM")}
SELECT subject, sample, t, click, CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN CASE WHEN t - pt <= 21600 THEN py END ELSE CASE
 WHEN nt - t <= 21600 THEN ny END END AS view FROM n""")
def c2_align_sources(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf).where("channel in ('click', 'view')").withColumn("source", F.col("channel"))
    own = own.withColumn("sample", (F.row_number().over(ordered(["subject", "source"], "sample")) - 1).cast("long"))
    return asof.align_sources(own, "click", 21600.0, U)


@register(f"""WITH {EV}, c AS (SELECT subject, channel, count(*) AS n, max(count(*)) OVER (PARTITION BY subject) AS longest FROM ev GROUP BY subject, channel)
SELECT subject, arg_min(channel, r) AS time_column FROM (SELECT *, CASE WHEN channel = 'view' THEN 1 ELSE 2 END * 10 + length(channel) AS r FROM c
 WHERE n <= 2 * longest) WHERE channel IN ('view', 'signup') GROUP BY subject""")
def c3_time_vector(spark: SparkSession, sf: str) -> DataFrame:
    n = event_samples(spark, sf).groupBy("subject", "source", "channel").agg(F.count("*").alias("n"))
    candidates = n.where("channel in ('view', 'signup')").select(
        "subject", "source", F.when(F.col("channel") == "view", 1).otherwise(2).alias("rank"), F.col("channel").alias("name"), "n"
    )
    return asof.choose_time(candidates, n, U).select("subject", "time_column")


@register(f"""WITH {EV}, k AS (SELECT *, row_number() OVER (PARTITION BY subject, channel ORDER BY sample) - 1 AS i FROM ev), m AS (SELECT subject,
 min(c) AS c FROM (SELECT subject, channel, count(*) AS c FROM ev GROUP BY ALL) GROUP BY subject)
SELECT subject, channel, i AS sample, y FROM k JOIN m USING (subject) WHERE i < c""")
def c4_truncate_common(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf).withColumn("sample", (F.row_number().over(ordered(UC, "sample")) - 1).cast("long"))
    return asof.truncate_common(own, U).select("subject", "channel", "sample", "y")


@register(f"WITH {EV}, {NEAR} SELECT subject, sample, coalesce(py, ny, 0.0) AS y FROM n")
def c5_hold_previous(spark: SparkSession, sf: str) -> DataFrame:
    return asof.hold_previous(*_sides(spark, sf), U).select("subject", "sample", "y")


LINEAR = "CASE WHEN pt IS NULL THEN coalesce(ny, 0.0) WHEN nt IS NULL THEN py WHEN nt = pt THEN py ELSE py + (ny - py) * (t - pt) / (nt - pt) END"


@register(f"WITH {EV}, {NEAR} SELECT subject, sample, round({LINEAR}, 6) AS y FROM n")
def c6_remap_linear(spark: SparkSession, sf: str) -> DataFrame:
    return asof.remap_linear(*_sides(spark, sf), U).select("subject", "sample", F.round("y", 6).alias("y"))


@register(f"WITH {EV}, {NEAR} SELECT subject, sample, round(CASE WHEN least(t - pt, nt - t) > 43200 THEN -1.0 ELSE {LINEAR} END, 6) AS y FROM n")
def c7_gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    return asof.remap_linear(*_sides(spark, sf), U, gap_s=43200.0, fill=-1.0).select("subject", "sample", F.round("y", 6).alias("y"))


@register(f"""WITH {EV}, a AS (SELECT subject, sample, t FROM ev), b AS (SELECT subject, t, y FROM ev WHERE channel = 'view'),
 p AS (SELECT a.*, b.t AS pt, b.y AS py FROM a ASOF LEFT JOIN b ON a.subject = b.subject AND a.t >= b.t), n AS (SELECT p.*, b.t AS nt, b.y AS ny FROM
 p ASOF LEFT JOIN b ON p.subject = b.subject AND p.t <= b.t)
SELECT subject, sample, round(CASE WHEN least(t - pt, nt - t) > 43200 THEN 0.0 ELSE {LINEAR} END, 6) AS y FROM n""")
def c8_sparse_trace(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf).select("subject", "sample", "t", F.when(F.col("channel") == "view", F.col("y")).alias("y"))
    return asof.sparse_trace(own, 43200.0, 0.0, U).select("subject", "sample", F.round("y", 6).alias("y"))


@register(f"""WITH {EV}, {epochs_sql('bout')} SELECT subject, sample FROM ev e WHERE EXISTS (SELECT 1 FROM bout b WHERE b.subject = e.subject AND e.t
 >= b.start_s AND e.t < b.end_s)""")
def c9_samples_in_epochs(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    return intervals.samples_in(own, bouts_of(own), U, how="left_semi").select("subject", "sample")


@register(f"""WITH {EV}, {epochs_sql('bout')} SELECT subject, event_type, event_time FROM (SELECT subject, channel AS event_type, t AS event_time FROM
 ev) e WHERE NOT EXISTS (SELECT 1 FROM bout b WHERE b.subject = e.subject AND event_time BETWEEN b.start_s AND b.end_s)""")
def c10_events_outside_bouts(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    return eta.drop_events_in_bouts(own.select("subject", F.col("channel").alias("event_type"), F.col("t").alias("event_time")), bouts_of(own), U)


WEEKS = "w AS (SELECT subject, session AS interval_id, min(t) AS start_s, max(t) AS end_s FROM ev GROUP BY ALL)"
OVERLAP = f"""o AS (SELECT w.subject, interval_id, w.start_s, w.end_s, count(b.start_s) AS n_overlapping, coalesce(sum(CASE WHEN b.start_s IS NOT NULL
 THEN least(w.end_s, b.end_s) - greatest(w.start_s, b.start_s) END), 0) AS overlap_s,
 coalesce(bool_or(b.start_s <= w.start_s AND w.start_s < b.end_s), false) AS open_at_start, min(CASE WHEN b.start_s > w.start_s THEN b.start_s END) AS
 first_start_s
 FROM w LEFT JOIN bout b ON b.subject = w.subject AND b.start_s < w.end_s AND b.end_s > w.start_s GROUP BY ALL)"""


@register(f"""WITH {EV}, {epochs_sql('bout')}, {WEEKS}, {OVERLAP} SELECT subject, interval_id, n_overlapping, open_at_start,
 {q6('overlap_s', 'first_start_s')} FROM o""")
def c11_epoch_overlap(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    weeks = own.groupBy("subject", F.col("session").alias("interval_id")).agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"))
    return intervals.epoch_overlap(weeks, bouts_of(own), U).select(
        "subject", "interval_id", "n_overlapping", "open_at_start", *r6("overlap_s", "first_start_s")
    )


@register(f"""WITH {EV}, {epochs_sql('bout')}, {WEEKS}, {OVERLAP} SELECT subject, interval_id, round(CASE WHEN open_at_start THEN 0.0 ELSE
 first_start_s - start_s END, 6) AS latency_s FROM o""")
def c12_epoch_latency(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    weeks = own.groupBy("subject", F.col("session").alias("interval_id")).agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"))
    return intervals.epoch_latency(weeks, bouts_of(own), U).select("subject", "interval_id", F.round("latency_s", 6).alias("latency_s"))


@register(
    """SELECT o_orderkey, count(*) AS n_lines, sum(CASE WHEN l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 60 DAY THEN 1 ELSE 0 END) AS n_inside FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def c9_ship_dates_in_span(spark: SparkSession, sf: str) -> DataFrame:
    secs = lambda c: (F.unix_timestamp(F.col(c).cast("timestamp"))).cast("double")
    line = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", secs("l_shipdate").alias("t"))
    spans = read_table(spark, sf, "orders").select("o_orderkey", secs("o_orderdate").alias("start_s"), (secs("o_orderdate") + 60 * 86400).alias("end_s"))
    inside = intervals.samples_in(line, spans, ("o_orderkey",)).groupBy("o_orderkey").agg(F.count("*").alias("n_inside"))
    n = line.join(spans.select("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderkey").agg(F.count("*").alias("n_lines"))
    return n.join(inside, "o_orderkey", "left").select(
        "o_orderkey", "n_lines", F.coalesce("n_inside", F.lit(0)).cast("decimal(38,0)").cast("double").alias("n_inside")
    )


SQL["c9_ship_dates_in_span"] = SQL["c9_ship_dates_in_span"].replace("sum(CASE", "CAST(sum(CASE").replace("END) AS n_inside", "END) AS DOUBLE) AS n_inside")


# --- D and E: segments and events -------------------------------------------------------------------------------------


@register(f"""WITH {EV}, {epochs_sql('bout', merge=-1e18)} SELECT subject, idx, run - 1 AS run FROM (SELECT *, sum(new) OVER (PARTITION BY subject
 ORDER BY idx) AS run FROM bout_m)""")
def d2_masked_samples(spark: SparkSession, sf: str) -> DataFrame:
    return segments.masked_samples(event_samples(spark, sf), F.col("y") > 30, U).select("subject", "idx", "run")


SQL["d2_masked_samples"] = SQL["d2_masked_samples"].replace("run - 1 AS run", "CAST(run - 1 AS BIGINT) AS run")


@register(f"WITH {EV}, {epochs_sql('bout', merge=-1e18, gap=86400)} SELECT subject, start_idx, end_idx FROM bout_x")
def d7_split_runs(spark: SparkSession, sf: str) -> DataFrame:
    return segments.mask_runs(event_samples(spark, sf), F.col("y") > 30, U, 86400.0).select("subject", "start_idx", "end_idx")


@register(f"""WITH {EV}, {epochs_sql('bout', merge=-1e18)}, g AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY subject ORDER BY a) - 1 <= 2 THEN
 0 ELSE 1 END AS n2 FROM bout_r),
 m AS (SELECT subject, min(a) AS start_idx, max(b) AS end_idx FROM (SELECT *, sum(n2) OVER (PARTITION BY subject ORDER BY a) AS grp FROM g) GROUP BY
 subject, grp) SELECT * FROM m WHERE end_idx - start_idx + 1 >= 3""")
def d3_merge_and_drop_by_samples(spark: SparkSession, sf: str) -> DataFrame:
    found = segments.mask_runs(event_samples(spark, sf), F.col("y") > 30, U)
    return segments.long_runs(segments.merge_runs(found, U, gap_samples=2), 3).select("subject", "start_idx", "end_idx")


@register(f"""WITH {EV}, {epochs_sql('bout', least=20000, gap=172800)} SELECT subject, epoch_id, start_idx, end_idx, {q6('start_s', 'end_s')},
 round(duration_s, 3) AS duration_s FROM bout""")
def d8_detect_epochs(spark: SparkSession, sf: str) -> DataFrame:
    made = segments.detect_epochs(event_samples(spark, sf), F.col("y") > 30, "bout", 20000.0, HOUR, 172800.0, U)
    return made.select("subject", "epoch_id", "start_idx", "end_idx", *r6("start_s", "end_s"), F.round("duration_s", 3).alias("duration_s"))


@register(SQL["d8_detect_epochs"])
def d8_epochs_in_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Each recording in slices of four days."""
    made = segments.detect_epochs(event_samples(spark, sf), F.col("y") > 30, "bout", 20000.0, HOUR, 172800.0, U, 345600.0)
    return made.select("subject", "epoch_id", "start_idx", "end_idx", *r6("start_s", "end_s"), F.round("duration_s", 3).alias("duration_s"))


@register(f"""WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t, sample) - 1 AS idx FROM ev), e AS (SELECT subject,
 row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS epoch_id, t - 3600 AS s, t + 86400 AS e FROM ev WHERE channel = 'purchase')
SELECT e.subject, epoch_id, round(s, 6) AS start_s, round(e, 6) AS end_s, min(idx) AS start_idx, max(idx) AS end_idx FROM e LEFT JOIN p ON p.subject =
 e.subject AND p.t BETWEEN s AND e GROUP BY ALL""")
def d9_epochs_around_events(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    points = own.where("channel = 'purchase'").select("subject", F.col("channel").alias("event_type"), F.col("t").alias("event_time"))
    made = segments.epochs_around(points, -3600.0, 86400.0, own, keys=U)
    return made.select("subject", "epoch_id", *r6("start_s", "end_s"), "start_idx", "end_idx")


@register(f"""WITH {EV}, g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY subject ORDER BY t, sample) > 86400, false) AS cut FROM ev)
SELECT subject, sample, 1 AS part, t, y FROM g UNION ALL SELECT subject, sample, 0, NULL, NULL FROM g WHERE cut""")
def d11_break_at_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return segments.break_at_gaps(event_samples(spark, sf), 86400.0, U)


@register(f"""WITH {EV}, x AS (SELECT subject, min(t) AS a, max(t) AS b FROM ev GROUP BY subject) SELECT subject, 'first' AS event_type, a AS
 event_time FROM x UNION ALL SELECT subject, 'last', b FROM x""")
def e1_make_events(spark: SparkSession, sf: str) -> DataFrame:
    spans = event_samples(spark, sf).groupBy("subject").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return events.make_events(spans, {"first": "a", "last": "b"}, U)


@register(f"""WITH {EV}, ok AS (SELECT * FROM ev WHERE subject IN (SELECT subject FROM ev GROUP BY subject HAVING count(*) >= 3)),
 {epochs_sql('bout', src='ok', mask='y >= 30')}
SELECT subject, 'locomotion_onset' AS event_type, start_s AS event_time FROM bout UNION ALL SELECT subject, 'locomotion_offset', end_s FROM bout""")
def e2_locomotion_events(spark: SparkSession, sf: str) -> DataFrame:
    return locomotion.locomotion_events(event_samples(spark, sf), 30.0, keys=U, merge_gap_s=HOUR)


@register(f"""WITH {EV}, {epochs_sql('bout')} SELECT subject, 'on' AS event_type, round(start_s, 6) AS event_time FROM bout UNION ALL SELECT subject,
 'off', round(end_s, 6) FROM bout""")
def e3_onsets_and_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return events.onsets_and_offsets(bouts_of(event_samples(spark, sf)), "on", "off", U).select("subject", "event_type", *r6("event_time"))


# --- F: event-triggered averages --------------------------------------------------------------------------------------

WINDOW, STEP, BASE = (-21600.0, 21600.0), 7200.0, (-21600.0, 0.0)
TRACES = """clean AS (SELECT subject, channel AS roi, t, arg_min(y, sample) AS y FROM ev GROUP BY ALL), ok AS (SELECT subject, roi FROM clean GROUP BY
 ALL HAVING count(*) >= 2),
 grid AS (SELECT points.*, roi, i AS rel_idx, -21600 + i * 7200.0 AS rel_time, event_time + (-21600 + i * 7200.0) AS t FROM points JOIN ok USING
 (subject), (SELECT unnest(range(0, 7)) AS i)),
 gp AS (SELECT g.*, p.t AS pt, p.y AS py FROM grid g ASOF LEFT JOIN clean p ON g.subject = p.subject AND g.roi = p.roi AND g.t >= p.t),
 gn AS (SELECT g.*, n.t AS nt, n.y AS ny FROM gp g ASOF LEFT JOIN clean n ON g.subject = n.subject AND g.roi = n.roi AND g.t <= n.t),
 raw AS (SELECT *, CASE WHEN pt IS NULL OR nt IS NULL THEN NULL WHEN pt = nt THEN py ELSE py + (ny - py) * (t - pt) / (nt - pt) END AS v FROM gn),
 traces AS (SELECT *, v - avg(CASE WHEN rel_time <= 0 THEN v END) OVER (PARTITION BY subject, event_type, event_id, roi) AS value FROM raw)"""
POINTS = "points AS (SELECT subject, channel AS event_type, t AS event_time, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS event_id FROM ev WHERE channel = 'purchase')"


def _points(own: DataFrame) -> DataFrame:
    return eta.number_events(own.where("channel = 'purchase'").select("subject", F.col("channel").alias("event_type"), F.col("t").alias("event_time")), U)


def _traces(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    return eta.epoch_traces(own, _points(own), WINDOW, STEP, U)


@register(f"WITH {EV}, {POINTS}, {TRACES} SELECT subject, event_id, roi, rel_idx, round(v, 6) AS value FROM raw")
def f1_epoch_traces(spark: SparkSession, sf: str) -> DataFrame:
    return _traces(spark, sf).select("subject", "event_id", "roi", "rel_idx", *r6("value"))


@register(f"WITH {EV}, {POINTS}, {TRACES} SELECT subject, event_id, roi, rel_idx, round(value, 6) + 0.0 AS value FROM traces")
def f2_baselined_traces(spark: SparkSession, sf: str) -> DataFrame:
    return eta.subtract_baseline(_traces(spark, sf), BASE, U).select("subject", "event_id", "roi", "rel_idx", *r6("value"))


@register(f"""WITH {EV}, {POINTS}, {TRACES}, {epochs_sql('bout')}, marked AS (SELECT raw.*, NOT EXISTS (SELECT 1 FROM bout b WHERE b.subject =
 raw.subject AND raw.t BETWEEN b.start_s AND b.end_s) AS clean FROM raw),
 base AS (SELECT subject, event_id, roi, CASE WHEN count(v) FILTER (WHERE clean AND rel_time <= 0) >= 2 THEN avg(v) FILTER (WHERE clean AND rel_time
 <= 0) ELSE avg(v) FILTER (WHERE rel_time <= 0) END AS b FROM marked GROUP BY ALL)
SELECT subject, event_id, roi, rel_idx, round(v - b, 6) + 0.0 AS value FROM marked JOIN base USING (subject, event_id, roi)""")
def f4_clean_baseline(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    marked = eta.flag_outside_bouts(_traces(spark, sf), bouts_of(own), U)
    return eta.subtract_baseline(marked, BASE, U, F.col("clean"), 2).select("subject", "event_id", "roi", "rel_idx", *r6("value"))


@register(f"""WITH {EV}, {POINTS}, {TRACES}, other AS (SELECT subject, event_id, roi, avg(v) AS b FROM (SELECT r.subject, r.event_id - 1 AS event_id,
 r.roi, v FROM raw r WHERE r.rel_time <= 0 AND r.event_id > 0) GROUP BY ALL)
SELECT raw.subject, raw.event_id, raw.roi, raw.rel_idx, round(v - b, 6) + 0.0 AS value FROM raw LEFT JOIN other USING (subject, event_id, roi)""")
def f3_paired_baseline(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    points = _points(own)
    later = points.where("event_id > 0").withColumn("event_id", F.col("event_id") - 1)
    return eta.paired_baseline(_traces(spark, sf), own, later, BASE, STEP, U).select("subject", "event_id", "roi", "rel_idx", *r6("value"))


ONSETS = f"""ok3 AS (SELECT * FROM ev WHERE subject IN (SELECT subject FROM ev GROUP BY subject HAVING count(*) >= 3)),
 {epochs_sql('bout', src='ok3', mask='y >= 30')},
 both_ends AS (SELECT subject, 'locomotion_onset' AS event_type, start_s AS event_time FROM bout UNION ALL SELECT subject, 'locomotion_offset', end_s
 FROM bout),
 points AS (SELECT *, row_number() OVER (PARTITION BY subject, event_type ORDER BY event_time) - 1 AS event_id FROM both_ends)"""
SUBJECTS = "subjects AS (SELECT subject, event_type, roi, rel_idx, rel_time, avg(value) AS mean FROM traces GROUP BY ALL)"


def _eta(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    own = event_samples(spark, sf)
    return eta.EtaAnalysis(WINDOW, STEP, BASE, (), U).run(own, locomotion.locomotion_events(own, 30.0, keys=U, merge_gap_s=HOUR))


@register(f"WITH {EV}, {ONSETS}, {TRACES}, {SUBJECTS} SELECT subject, 'all' AS condition, event_type, roi, rel_idx, round(mean, 6) + 0.0 AS mean FROM subjects")
def f7_subject_means(spark: SparkSession, sf: str) -> DataFrame:
    return _eta(spark, sf)["subject"].select("subject", "condition", "event_type", "roi", "rel_idx", *r6("mean"))


@register(f"""WITH {EV}, {ONSETS}, {TRACES}, {SUBJECTS} SELECT 'all' AS condition, event_type, roi, rel_idx, round(avg(mean), 6) + 0.0 AS mean,
 round(CASE WHEN count(mean) > 1 THEN stddev_samp(mean) / sqrt(count(mean)) ELSE 0.0 END, 6) + 0.0 AS sem FROM subjects GROUP BY event_type, roi, rel_idx""")
def f8_group_means(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Bouts of all recordings, their onsets and offsets, baselined traces, means over subjects with errors."""
    return _eta(spark, sf)["group"].select("condition", "event_type", "roi", "rel_idx", *r6("mean", "sem"))


@register(f"""WITH {EV}, {ONSETS}, {TRACES} SELECT subject, 'all' AS condition, event_type, event_id, roi, round(avg(value), 6) + 0.0 AS response FROM
 traces WHERE rel_time BETWEEN 0 AND 14400 GROUP BY ALL""")
def f9_window_mean(spark: SparkSession, sf: str) -> DataFrame:
    return eta.window_mean(_eta(spark, sf)["events"], (0.0, 14400.0), "response", U).select(
        "subject", "condition", "event_type", "event_id", "roi", *r6("response")
    )


# --- G: preprocessing -------------------------------------------------------------------------------------------------

SERIES = "ser AS (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY t, sample) - 1 AS sample, t, y FROM ev)"


def series_of(spark: SparkSession, sf: str) -> DataFrame:
    """One long series per event type, numbered 0, 1, ..."""
    own = event_samples(spark, sf)
    return own.withColumn("sample", (F.row_number().over(ordered(C, "t", "sample")) - 1).cast("long")).select("channel", "sample", "t", "y")


def _gaps(samples: DataFrame) -> DataFrame:
    return samples.withColumn("y", F.when(F.col("sample") % 11 != 5, F.col("y")))


#: Weights of a quadratic through 5 places: the first two rows and the middle one; the last two mirror the first.
SG5 = ((31 / 35, 9 / 35, -3 / 35, -5 / 35, 3 / 35), (9 / 35, 13 / 35, 12 / 35, 6 / 35, -5 / 35), (-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35))


def own_gaps_sql(source: str, out: str) -> str:
    """CTEs from (channel, i, t, y) to the same with v, whose gaps are interpolated in time."""
    return f"""{out}_k AS (SELECT * FROM {source} WHERE y IS NOT NULL), {out}_p AS (SELECT g.*, a.t AS pt, a.y AS py FROM {source} g ASOF LEFT JOIN
 {out}_k a ON g.channel = a.channel AND g.t >= a.t),
 {out}_n AS (SELECT p.*, b.t AS nt, b.y AS ny FROM {out}_p p ASOF LEFT JOIN {out}_k b ON p.channel = b.channel AND p.t <= b.t),
 {out} AS MATERIALIZED (SELECT channel, i, t, y, CASE WHEN y IS NOT NULL THEN y WHEN pt IS NULL THEN ny WHEN nt IS NULL OR nt = pt THEN py ELSE py + (ny - py) * (t
 - pt) / (nt - pt) END AS v FROM {out}_n)"""


def sg5_sql(source: str, out: str, weights=None) -> str:
    """CTEs that smooth (channel, i, v) with these weights; ``out`` has (channel, i, v)."""
    own = weights or SG5
    take = lambda k: f"nth_value(v, {k + 1}) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    last = lambda k: f"nth_value(v, {k + 1}) OVER (PARTITION BY channel ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    row = lambda ws, get: " + ".join(f"({w}) * {get(k)}" for k, w in enumerate(ws))
    mid = " + ".join(f"({w}) * " + (f"lag(v, {2 - k}) OVER w" if k < 2 else "v" if k == 2 else f"lead(v, {k - 2}) OVER w") for k, w in enumerate(own[2]))
    return f"""{out}_n AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM {source}),
 {out} AS (SELECT channel, i, CASE WHEN i = 0 THEN {row(own[0], take)} WHEN i = 1 THEN {row(own[1], take)} WHEN i = n - 1 THEN {row(own[0], last)}
 WHEN i = n - 2 THEN {row(own[1], last)} ELSE {mid} END AS v
  FROM {out}_n WINDOW w AS (PARTITION BY channel ORDER BY i))"""


@register(f"""WITH {EV}, {SERIES}, gap AS (SELECT channel, sample AS i, CASE WHEN sample % 11 <> 5 THEN y END AS y FROM ser),
 p AS (SELECT g.*, a.i AS pi, a.y AS py FROM gap g ASOF LEFT JOIN (SELECT * FROM gap WHERE y IS NOT NULL) a ON g.channel = a.channel AND g.i >= a.i),
 n AS (SELECT p.*, b.i AS ni, b.y AS ny FROM p ASOF LEFT JOIN (SELECT * FROM gap WHERE y IS NOT NULL) b ON p.channel = b.channel AND p.i <= b.i),
 filled AS (SELECT channel, i, y AS own, CASE WHEN y IS NOT NULL THEN y WHEN pi IS NULL THEN ny WHEN ni IS NULL THEN py ELSE py + (ny - py) * (i - pi)
 / (ni - pi) END AS v FROM n), {sg5_sql('filled', 'smooth')}
SELECT s.channel, s.i AS sample, CASE WHEN own IS NOT NULL THEN round(s.v, 5) + 0.0 END AS y FROM smooth s JOIN filled f ON s.channel = f.channel AND
 s.i = f.i""")
def g1_smooth_savgol(spark: SparkSession, sf: str) -> DataFrame:
    return preproc.smooth_savgol(_gaps(series_of(spark, sf)), 5.0, 1.0, 2, C).select("channel", "sample", (F.round("y", 5) + 0.0).alias("y"))


MEDIAN3 = """CASE WHEN sample = 0 THEN list_sort([y, y, lead(y) OVER w])[2] WHEN sample = n - 1 THEN list_sort([y, y, lag(y) OVER w])[2] ELSE list_sort([lag(y) OVER w, y, lead(y) OVER w])[2] END"""


@register(f"""WITH {EV}, {SERIES}, k AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM ser) SELECT channel, sample, {MEDIAN3} AS y FROM k
 WINDOW w AS (PARTITION BY channel ORDER BY sample)""")
def g2_smooth_median(spark: SparkSession, sf: str) -> DataFrame:
    return preproc.smooth_median(series_of(spark, sf), 3, C).select("channel", "sample", "y")


@register(f"""WITH {EV}, {SERIES}, k AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM ser), med AS (SELECT channel, sample AS i, {MEDIAN3}
 AS v FROM k WINDOW w AS (PARTITION BY channel ORDER BY sample)), {sg5_sql('med', 'smooth')} SELECT channel, i AS sample, round(v, 5) + 0.0 AS y FROM
 smooth""")
def g3_smooth_dense(spark: SparkSession, sf: str) -> DataFrame:
    return preproc.smooth_dense(series_of(spark, sf), 3, 5, 2, C).select("channel", "sample", (F.round("y", 5) + 0.0).alias("y"))


@register(f"""WITH {EV}, q AS (SELECT channel, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM ev GROUP BY channel) SELECT channel,
 sample, y BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) AS inlier, CASE WHEN y BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN y END AS y FROM
 ev JOIN q USING (channel)""")
def g4_remove_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return preproc.remove_outliers(event_samples(spark, sf), 1.5, C).select("channel", "sample", "inlier", "y")


@register(f"""WITH {EV} SELECT subject, sample, round(CASE WHEN stddev_pop(y) OVER w > 0 THEN (y - avg(y) OVER w) / stddev_pop(y) OVER w END, 6) + 0.0
 AS z FROM ev WINDOW w AS (PARTITION BY subject)""")
def g5_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return preproc.zscore(event_samples(spark, sf), U).select("subject", "sample", *r6("z"))


@register(f"""WITH {EV}, {SERIES}, f AS (SELECT channel, regr_slope(y, sample) AS a, regr_intercept(y, sample) AS b FROM ser GROUP BY channel), r AS
 (SELECT channel, sample, y - a * sample - b AS r FROM ser JOIN f USING (channel))
SELECT channel, sample, round((r - avg(r) OVER w) / stddev_samp(r) OVER w, 5) + 0.0 AS z FROM r WINDOW w AS (PARTITION BY channel)""")
def g6_detrend_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return preproc.detrend_zscore(series_of(spark, sf), C).select("channel", "sample", (F.round("z", 5) + 0.0).alias("z"))


@register(f"""WITH {EV}, {SERIES}, j AS (SELECT *, coalesce(abs(y - lag(y) OVER w) > 120, false) OR coalesce(abs(y - lead(y) OVER w) > 120, false) OR
 y <= 0.5 OR y > 250 AS flagged, lag(t) OVER w AS pt, lag(y) OVER w AS py, lead(t) OVER w AS nt, lead(y) OVER w AS ny FROM ser WINDOW w AS (PARTITION
 BY channel ORDER BY t, sample)),
 k AS (SELECT *, sum(CASE WHEN flagged IS DISTINCT FROM l THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY t, sample) AS run FROM (SELECT *,
 lag(flagged) OVER (PARTITION BY channel ORDER BY t, sample) AS l FROM j)),
 e AS (SELECT channel, run, arg_min(pt, t) AS t0, arg_min(py, t) AS y0, arg_max(nt, t) AS t1, arg_max(ny, t) AS y1, max(t) - min(t) AS span FROM k
 GROUP BY channel, run),
 ends AS (SELECT channel, run, min(sample) = 0 OR max(sample) = (SELECT max(sample) FROM ser s WHERE s.channel = k.channel) AS touches FROM k GROUP BY
 channel, run), d AS (SELECT channel, median(dt) AS step FROM (SELECT channel, t - lag(t) OVER (PARTITION BY channel ORDER BY t, sample) AS dt FROM
 ser) GROUP BY channel)
SELECT channel, sample, flagged, CASE WHEN NOT flagged THEN round(y, 5) WHEN NOT touches AND span + step <= 20000 THEN round(y0 + (y1 - y0) * (t - t0)
 / (t1 - t0), 5) END AS cleaned FROM k JOIN e USING (channel, run) JOIN ends USING (channel, run) JOIN d USING (channel)""")
def g7_clean_steps(spark: SparkSession, sf: str) -> DataFrame:
    return preproc.clean_steps(series_of(spark, sf), 120.0, (0.5, 250.0), 20000.0, C).select(
        "channel", "sample", "flagged", F.round("cleaned", 5).alias("cleaned")
    )


#: Values of every series on a clock that is ten minutes late, outliers beyond 4 quartile ranges as nulls, which medians of three see as missing.
REMAPPED = f"""ref AS (SELECT channel, sample, t + 600 AS t FROM ser), src AS (SELECT channel, t, arg_min(y, sample) AS y FROM ser WHERE y IS NOT NULL
 GROUP BY channel, t),
 pp AS (SELECT r.*, s.t AS pt, s.y AS py FROM ref r ASOF LEFT JOIN src s ON r.channel = s.channel AND r.t >= s.t),
 nn AS (SELECT pp.*, s.t AS nt, s.y AS ny FROM pp ASOF LEFT JOIN src s ON pp.channel = s.channel AND pp.t <= s.t), lin AS (SELECT channel, sample,
 {LINEAR} AS y FROM nn)"""


def _later(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = series_of(spark, sf)
    return own.select("channel", "sample", (F.col("t") + 600).alias("t")), own


@register(f"""WITH {EV}, {SERIES}, {REMAPPED}, k AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM lin), med AS (SELECT channel, sample AS
 i, {MEDIAN3} AS v FROM k WINDOW w AS (PARTITION BY channel ORDER BY sample)),
 {sg5_sql('med', 'smooth')} SELECT channel, i AS sample, round(v, 5) + 0.0 AS y FROM smooth""")
def g8_prepare_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Remapped, outliers far beyond any value away, smoothed by samples."""
    return preproc.prepare_trace(*_later(spark, sf), 1e6, None, None, (3, 5, 2), C).select("channel", "sample", (F.round("y", 5) + 0.0).alias("y"))


@register(f"""WITH {EV}, {SERIES}, {REMAPPED}, q AS (SELECT channel, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM lin GROUP BY channel)
SELECT channel, sample, round(CASE WHEN y BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN y END, 5) AS y FROM lin JOIN q USING (channel)""")
def g8_remapped_inliers(spark: SparkSession, sf: str) -> DataFrame:
    """The recipe's first two steps, with outliers."""
    return preproc.prepare_trace(*_later(spark, sf), 1.5, None, None, None, C).select("channel", "sample", F.round("y", 5).alias("y"))


@register(f"""WITH {EV}, {SERIES}, {REMAPPED}, q AS (SELECT channel, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM lin GROUP BY channel),
 cut AS (SELECT channel, sample AS i, CAST(sample AS DOUBLE) AS t, CASE WHEN y BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN y END AS y FROM lin JOIN q USING (channel)),
 {own_gaps_sql('cut', 'whole')}, {sg5_sql('whole', 'smooth', filters.savgol_matrix(5, 3).tolist())}
SELECT s.channel, s.i AS sample, CASE WHEN w.y IS NOT NULL THEN round(s.v, 5) + 0.0 END AS y FROM smooth s JOIN whole w ON w.channel = s.channel AND w.i = s.i""")
def g8_inliers_smoothed_by_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """Remapped, outliers away, their gaps bridged for the smoothing by seconds and put back. The last step is for series without gaps, as in g8_prepare_trace."""
    return preproc.prepare_trace(*_later(spark, sf), 1.5, 5.0, 1.0, None, C).select("channel", "sample", (F.round("y", 5) + F.lit(0.0)).alias("y"))


#: Weights of a quadratic through 7 places: the first three rows and the middle one.
SG7 = (
    (32 / 42, 15 / 42, 3 / 42, -4 / 42, -6 / 42, -3 / 42, 5 / 42), (15 / 42, 12 / 42, 9 / 42, 6 / 42, 3 / 42, 0.0, -3 / 42),
    (3 / 42, 9 / 42, 12 / 42, 12 / 42, 9 / 42, 3 / 42, -6 / 42), (-2 / 21, 3 / 21, 6 / 21, 7 / 21, 6 / 21, 3 / 21, -2 / 21)
)


def _variable_sql(k: float, weights: Sequence[Sequence[float]]) -> str:
    """Values within k quartile ranges, numbered anew, fitted by their place in the first, the last or the middle of a window."""
    size, half = len(weights[-1]), len(weights[-1]) // 2
    dot = lambda row, places: " + ".join(f"({w}) * l[{i}]" for w, i in zip(row, places, strict=True))
    head = " ".join(f"WHEN i = {j} THEN {dot(weights[j], range(1, size + 1))}" for j in range(half))
    tail = " ".join(f"WHEN i = n - {j + 1} THEN {dot(weights[j], range(size, 0, -1))}" for j in range(half))
    return f"""WITH {EV}, {SERIES}, q AS (SELECT channel, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM ser GROUP BY channel),
 v AS (SELECT channel, sample, y, coalesce(y BETWEEN a - {k} * (b - a) AND b + {k} * (b - a), false) AS valid FROM ser JOIN q USING (channel)),
 k AS (SELECT channel, sample, y, row_number() OVER (PARTITION BY channel ORDER BY sample) - 1 AS i, count(*) OVER (PARTITION BY channel) AS n FROM v
 WHERE valid),
 win AS (SELECT a.channel, a.sample, a.i, a.n, list(b.y ORDER BY b.i) AS l FROM k a JOIN k b ON b.channel = a.channel AND b.i BETWEEN greatest(0,
 least(a.n - {size}, a.i - {half})) AND greatest(0, least(a.n - {size}, a.i - {half})) + {size - 1} GROUP BY ALL),
 s AS (SELECT channel, sample, CASE {head} {tail} ELSE {dot(weights[half], range(1, size + 1))} END AS y FROM win)
SELECT v.channel, v.sample, valid, round(s.y, 5) + 0.0 AS y FROM v LEFT JOIN s ON s.channel = v.channel AND s.sample = v.sample"""


@register(_variable_sql(2.0, SG7))
def g9_process_variable(spark: SparkSession, sf: str) -> DataFrame:
    return preproc.process_variable(series_of(spark, sf), "speed_mm", C).select("channel", "sample", "valid", (F.round("y", 5) + 0.0).alias("y"))


@register(_variable_sql(1.5, filters.savgol_matrix(15, 3).tolist()))
def g9_process_pupil(spark: SparkSession, sf: str) -> DataFrame:
    return preproc.process_variable(series_of(spark, sf), "pupil_diameter_mm", C).select("channel", "sample", "valid", (F.round("y", 5) + F.lit(0.0)).alias("y"))


@register(f"""WITH {EV}, s AS (SELECT subject, session, min(t) + 3600 AS lo, max(t) - 3600 AS hi FROM ev GROUP BY ALL HAVING max(t) - 3600 >= min(t) +
 3600), o AS (SELECT *, coalesce(sum(hi - lo + 60) OVER (PARTITION BY subject ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
 AS off FROM s)
SELECT subject, sample, round(t - lo + off, 2) AS timeline_s FROM ev JOIN o USING (subject, session) WHERE t BETWEEN lo AND hi""")
def g10_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return preproc.timeline(event_samples(spark, sf), 3600.0, 3600.0, 60.0).select("subject", "sample", F.round("timeline_s", 2).alias("timeline_s"))


@register(f"""WITH {EV}, {SERIES}, n AS (SELECT channel, count(*) AS n FROM ser GROUP BY channel), w AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 *
 k * k)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS k)),
 j AS (SELECT channel, sample, w, CASE WHEN sample + k < 0 THEN -1 - sample - k WHEN sample + k >= n THEN 2 * n - 1 - sample - k ELSE sample + k END
 AS other FROM ser JOIN n USING (channel), w)
SELECT j.channel, j.sample, round(sum(w * s.y), 6) AS y FROM j JOIN ser s ON s.channel = j.channel AND s.sample = j.other GROUP BY ALL""")
def g11_smooth_gaussian(spark: SparkSession, sf: str) -> DataFrame:
    return preproc.smooth_gaussian(series_of(spark, sf), 1.0, C).select("channel", "sample", *r6("y"))


# --- H: spectra -------------------------------------------------------------------------------------------------------

N = 64
#: Frames of 64 with half overlap, their transforms, and Welch densities at a rate of 1.
FRAMES = f"""{SERIES}, ns AS (SELECT channel, count(*) AS n FROM ser GROUP BY channel), fr AS (SELECT channel, n, f FROM ns, (SELECT unnest(range(0, (SELECT max(n) FROM ns) // 32 + 1)) AS f) WHERE f * 32 + 64 <= n),
 smp AS (SELECT fr.channel, f, s.sample - f * 32 AS i, s.y - avg(s.y) OVER (PARTITION BY fr.channel, f) AS v FROM fr JOIN ser s ON s.channel =
 fr.channel AND s.sample BETWEEN f * 32 AND f * 32 + 63),
 win AS (SELECT channel, f, i, v * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS v FROM smp), ks AS (SELECT unnest(range(0, 33)) AS k),
 dft AS (SELECT channel, f, k, sum(v * cos(2 * pi() * k * i / 64)) AS re, -sum(v * sin(2 * pi() * k * i / 64)) AS im FROM win, ks GROUP BY channel, f, k),
 scale AS (SELECT k, CASE WHEN k IN (0, 32) THEN 1.0 ELSE 2.0 END / 24.0 AS d FROM ks),
 psd AS (SELECT channel, k AS freq_idx, k / 64.0 AS freq, avg((re * re + im * im) * d) AS power FROM dft JOIN scale USING (k) GROUP BY channel, k)"""


def _spectra(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.welch(series_of(spark, sf), None, 1.0, float(N), C, ())


@register(f"WITH {EV}, {FRAMES} SELECT channel, freq_idx, round(freq, 6) AS freq, round(power, 4) + 0.0 AS power FROM psd")
def h1_welch(spark: SparkSession, sf: str) -> DataFrame:
    return _spectra(spark, sf).select(
        "channel", F.col("freq_idx").cast("long").alias("freq_idx"), F.round("freq", 6).alias("freq"), F.round("power", 4).alias("power")
    )


@register(f"WITH {EV}, {FRAMES} SELECT freq_idx, round(exp(avg(ln(power))), 4) AS power FROM psd WHERE freq_idx > 0 GROUP BY freq_idx")
def h2_mean_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    made = spectral.mean_spectrum(_spectra(spark, sf).where("freq_idx > 0"), ())
    return made.select(F.col("freq_idx").cast("long").alias("freq_idx"), F.round("power", 4).alias("power"))


@register(f"""WITH {EV}, {FRAMES}, fit AS (SELECT channel, regr_slope(ln(power), ln(freq)) AS a, regr_intercept(ln(power), ln(freq)) AS b FROM psd
 WHERE freq BETWEEN 0.05 AND 0.45 AND NOT freq BETWEEN 0.15 AND 0.25 GROUP BY channel),
 g AS (SELECT channel, freq, power / exp(b + a * ln(freq)) AS gain FROM psd JOIN fit USING (channel) WHERE freq BETWEEN 0.15 AND 0.25) SELECT channel,
 round(arg_max(freq, gain), 6) AS peak_hz, round(max(gain), 5) AS peak_gain FROM g GROUP BY channel""")
def h3_aperiodic_peak(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.aperiodic_peak(_spectra(spark, sf), C, (0.15, 0.25), (0.05, 0.45)).select(
        "channel", F.round("peak_hz", 6).alias("peak_hz"), F.round("peak_gain", 5).alias("peak_gain")
    )


@register(f"""WITH {EV}, {SERIES}, kern AS (SELECT q, l, exp(-l * l / (2 * s * s)) / sqrt(sum(exp(-l * l / (s * s))) OVER (PARTITION BY q)) AS w, fq
 FROM (SELECT q, fq, s, -3.5 * s + unnest(range(0, CAST(ceil(7 * s + 0.5) AS BIGINT))) AS l FROM (SELECT q, fq, 6.0 / (2 * pi() * fq) AS s FROM
 (VALUES (0, 0.1), (1, 0.2)) AS v(q, fq)))),
 kk AS (SELECT q, fq, l, w, row_number() OVER (PARTITION BY q ORDER BY l) - 1 AS j, count(*) OVER (PARTITION BY q) AS m FROM kern), mean AS (SELECT
 channel, avg(y) AS mu, count(*) AS n FROM ser GROUP BY channel),
 x AS (SELECT channel, sample, y - mu AS v, n FROM ser JOIN mean USING (channel)), c AS (SELECT x.channel, q, sample + j - (m - 1) // 2 AS pos, v * w
 * cos(2 * pi() * fq * l) AS re, v * w * sin(2 * pi() * fq * l) AS im, n FROM x, kk)
SELECT channel, pos AS sample, CAST(q AS INTEGER) AS freq_idx, round(sum(re) * sum(re) + sum(im) * sum(im), 2) AS power FROM c WHERE pos >= 0 AND pos
 < n GROUP BY channel, pos, q""")
def h4_morlet_power(spark: SparkSession, sf: str) -> DataFrame:
    made = spectral.morlet_power(series_of(spark, sf), 1.0, [0.1, 0.2], chunk=512, series=C)
    return made.select("channel", "sample", "freq_idx", F.round("power", 2).alias("power"))


CROSS = f"""{FRAMES.replace("count(*) AS n FROM ser GROUP BY channel), fr", "(SELECT min(c) FROM (SELECT count(*) AS c FROM ser GROUP BY channel)) AS n FROM ser GROUP BY channel), fr")},
 csd AS (SELECT a.channel AS k, b.channel AS l, a.k AS freq_idx, a.k / 64.0 AS freq, avg((a.re * b.re + a.im * b.im) * d) AS re, avg((a.re * b.im -
 a.im * b.re) * d) AS im FROM dft a JOIN dft b ON a.f = b.f AND a.k = b.k AND a.channel <= b.channel JOIN scale s ON s.k = a.k GROUP BY ALL)"""


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    own = series_of(spark, sf).withColumn("subject", F.lit("all")).withColumn("t", F.col("sample").cast("double"))
    return spectral.epoch_matrix(own, None, 1.0, float(N), 0.5, U)


@register(f"WITH {EV}, {CROSS} SELECT k, l, freq_idx, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM csd")
def h6_cross_spectral_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(spark, sf).select(
        "k", "l", F.col("freq_idx").cast("long").alias("freq_idx"), (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im")
    )


def _cross(spark: SparkSession, sf: str) -> DataFrame:
    own = series_of(spark, sf).withColumn("subject", F.lit("all")).withColumn("t", F.col("sample").cast("double"))
    return spectral.cross_spectra(own.where("channel <> 'click'"), own.where("channel = 'click'").drop("channel"), None, 1.0, float(N), 0.5, U)


@register(f"""WITH {EV}, {CROSS} SELECT c.l AS channel, c.freq_idx, round(c.re, 3) + 0.0 AS re, round(c.im, 3) + 0.0 AS im, round(p.re, 3) AS power,
 round(r.re, 3) AS reference_power FROM csd c JOIN csd p ON p.k = c.l AND p.l = c.l AND p.freq_idx = c.freq_idx
 JOIN csd r ON r.k = 'click' AND r.l = 'click' AND r.freq_idx = c.freq_idx WHERE c.k = 'click' AND c.l <> 'click'""")
def h5_cross_spectra(spark: SparkSession, sf: str) -> DataFrame:
    made = _cross(spark, sf)
    return made.select(
        "channel", F.col("freq_idx").cast("long").alias("freq_idx"),
        *[(F.round(c, 3) + 0.0).alias(c) for c in ("re", "im", "power", "reference_power")]
    )


@register(f"""WITH {EV}, {CROSS}, b AS (SELECT c.l AS channel, sum(p.re) AS p, sum(r.re) AS r, sum(c.re) AS re, sum(c.im) AS im, sum(sqrt(c.re * c.re
 + c.im * c.im) * c.freq) / sum(sqrt(c.re * c.re + c.im * c.im)) AS centre FROM csd c JOIN csd p ON p.k = c.l AND p.l = c.l AND p.freq_idx =
 c.freq_idx
 JOIN csd r ON r.k = 'click' AND r.l = 'click' AND r.freq_idx = c.freq_idx WHERE c.k = 'click' AND c.l <> 'click' AND c.freq >= 0.1 AND c.freq < 0.3
 GROUP BY c.l)
SELECT channel, round(p / 64, 3) AS power, round((re * re + im * im) / (p * r), 6) AS coherence, round(-atan2(im, re) / (2 * pi() * centre), 5) AS
 lag_s FROM b""")
def h7_band_coupling(spark: SparkSession, sf: str) -> DataFrame:
    made = spectral.band_coupling(_cross(spark, sf), (0.1, 0.3), ("channel",))
    return made.select("channel", F.round("power", 3).alias("power"), F.round("coherence", 6).alias("coherence"), F.round("lag_s", 5).alias("lag_s"))


def _robust_sql() -> str:
    steps = [f"WITH {EV}, {FRAMES}, s0 AS (SELECT channel, log10(freq) AS x, log10(power) AS y, true AS u FROM psd WHERE freq BETWEEN 0.05 AND 0.45)"]
    for i in range(4):
        steps.append(f""" f{i} AS (SELECT channel, regr_slope(y, x) FILTER (WHERE u) AS a, regr_intercept(y, x) FILTER (WHERE u) AS b FROM s{i} GROUP
 BY channel), r{i} AS (SELECT s.channel, x, y, u, y - f.b - f.a * x AS r, f.a, f.b FROM s{i} s JOIN f{i} f ON f.channel = s.channel),
 d{i} AS (SELECT channel, stddev_samp(r) FILTER (WHERE u) AS sd, count(*) FILTER (WHERE u) AS m FROM r{i} GROUP BY channel), s{i + 1} AS (SELECT
 channel, x, y, CASE WHEN m > 2 THEN r <= sd ELSE u END AS u, r, a, b FROM r{i} JOIN d{i} USING (channel))""")
    return ",".join(steps) + " SELECT channel, round(any_value(b), 5) AS offset_, round(-any_value(a), 5) AS exponent, round(1 - var_pop(r) FILTER (WHERE u) / var_pop(y) FILTER (WHERE u), 5) AS r_squared FROM s4 GROUP BY channel"


@register(_robust_sql())
def h8_aperiodic_fit(spark: SparkSession, sf: str) -> DataFrame:
    made = spectral.aperiodic_fit(_spectra(spark, sf), C, (0.05, 0.45))
    return made.select("channel", F.round("offset", 5).alias("offset_"), F.round("exponent", 5).alias("exponent"), F.round("r_squared", 5).alias("r_squared"))


@register()
def h9_ssd(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.ssd(_matrix(spark, sf), (0.15, 0.2), [(0.05, 0.1), (0.25, 0.3)], keys=U)


def _residuals(spark: SparkSession, sf: str) -> DataFrame:
    """Per component of the decomposition: how far S w is from ratio R w, w' R w from 1, and the next one's ratio from being no larger.

    S and R are summed up from the cross-spectral matrix anew, R with its share of the trace on the diagonal."""
    half = _matrix(spark, sf).select("subject", "k", "l", "freq", "re")
    full = half.unionByName(half.where("k <> l").select("subject", F.col("l").alias("k"), F.col("k").alias("l"), "freq", "re"))
    inside, beside = F.col("freq").between(0.15, 0.2), F.col("freq").between(0.05, 0.1) | F.col("freq").between(0.25, 0.3)
    cov = full.groupBy("subject", "k", "l").agg(
        F.sum(F.when(inside, F.col("re"))).alias("s"), F.sum(F.when(beside, F.col("re"))).alias("r"), F.count_if(inside).alias("ns"), F.count_if(beside).alias("nr")
    )
    trace = cov.where("k = l").groupBy("subject").agg((0.01 * F.avg("r")).alias("more"))
    cov = cov.join(trace, "subject").withColumn("r", F.col("r") + F.when(F.col("k") == F.col("l"), F.col("more")).otherwise(0.0))
    found = spectral.ssd(_matrix(spark, sf), (0.15, 0.2), [(0.05, 0.1), (0.25, 0.3)], keys=U).select("component", "channel", "ratio", F.col("filter").alias("w"))
    other = found.select("component", F.col("channel").alias("l"), F.col("w").alias("wl"), "ratio")
    rows = cov.join(other, "l").groupBy("component", "k").agg(
        F.sum(F.col("s") * F.col("wl")).alias("sw"), F.sum(F.col("r") * F.col("wl")).alias("rw"), F.max(F.col("ratio") * F.col("ns") / F.col("nr")).alias("value"), F.max("ratio").alias("ratio")
    )
    told = rows.join(found.select("component", F.col("channel").alias("k"), "w"), ["component", "k"]).groupBy("component").agg(
        (F.sqrt(F.sum((F.col("sw") - F.col("value") * F.col("rw")) ** 2)) / F.sqrt(F.sum(F.col("sw") ** 2))).alias("residual"), F.sum(F.col("w") * F.col("rw")).alias("norm"), F.max("ratio").alias("ratio")
    )
    return told.withColumn("falling", F.coalesce(F.col("ratio") >= F.lead("ratio").over(Window.orderBy("component")), F.lit(True)))


#: A decomposition has as many components as there are channels with a value at every sample; each solves its equation.
@register(f"""WITH {EV}, c AS (SELECT count(DISTINCT channel) AS n FROM ev) SELECT CAST(unnest(range(0, n)) AS INTEGER) AS component, 0.0 AS residual, 1.0 AS norm, true AS falling FROM c""")
def h9_ssd_residuals(spark: SparkSession, sf: str) -> DataFrame:
    return _residuals(spark, sf).select("component", (F.round("residual", 6) + F.lit(0.0)).alias("residual"), F.round("norm", 6).alias("norm"), "falling")


@register()
def h10_ssd_scan(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.ssd_scan(_matrix(spark, sf), [0.15, 0.2, 0.25], 0.02, (0.04, 0.08), keys=U)


# --- I: oscillations --------------------------------------------------------------------------------------------------


def filtered_sql(order: int, low: float, high: float, fs: float) -> str:
    """CTEs (WITH RECURSIVE) from ser(channel, sample, y) to env(channel, sample, t, y, phase, f): the zero-phase filter as two recursions over the
    padded series, a row per channel and sample with the sections' states, and the envelope and phase by the transform's kernel over all pairs."""
    sos = filters.butter_bandpass(order, low, high, fs)
    steady, pad = filters.sos_steady(sos), 3 * (2 * len(sos) + 1)
    number = lambda x: f"CAST({float(x)!r} AS DOUBLE)"

    def run(name: str, source: str) -> str:
        rest, x = [], "p.x"
        for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            rest.append(f"w.z{i}a + {number(b0)} * {x} AS v{i}, w.z{i}b + {number(b1)} * {x} - {number(a1)} * v{i} AS s{i}, {number(b2)} * {x} - {number(a2)} * v{i} AS r{i}")
            x = f"v{i}"
        start = ", ".join(f"CAST(0 AS DOUBLE) AS o{i}, {number(a)} * x AS z{i}a, {number(b)} * x AS z{i}b" for i, (a, b) in enumerate(steady))
        return f"""{name} AS MATERIALIZED (SELECT channel, CAST(-1 AS BIGINT) AS k, {start} FROM {source} WHERE k = 0 UNION ALL
 SELECT w.channel, w.k + 1, {', '.join(rest)} FROM {name} w JOIN {source} p ON p.channel = w.channel AND p.k = w.k + 1)"""

    out = f"o{len(sos) - 1}"
    return f"""size AS MATERIALIZED (SELECT channel, count(*) AS n FROM ser GROUP BY channel),
 padded AS MATERIALIZED (SELECT s.channel, sample + {pad} AS k, y AS x FROM ser s UNION ALL
  SELECT s.channel, {pad} - s.sample, 2 * e.y - s.y FROM ser s JOIN ser e ON e.channel = s.channel AND e.sample = 0 WHERE s.sample BETWEEN 1 AND {pad} UNION ALL
  SELECT s.channel, 2 * (n - 1) - s.sample + {pad}, 2 * e.y - s.y FROM ser s JOIN size USING (channel) JOIN ser e ON e.channel = s.channel AND e.sample = n - 1 WHERE n - 1 - s.sample BETWEEN 1 AND {pad}),
 {run('forth', 'padded')}, turned AS MATERIALIZED (SELECT channel, n + {2 * pad} - 1 - k AS k, {out} AS x FROM forth JOIN size USING (channel) WHERE k >= 0), {run('back', 'turned')},
 flt AS MATERIALIZED (SELECT channel, n, n + {pad} - 1 - k AS sample, {out} AS f FROM back JOIN size USING (channel) WHERE n + {pad} - 1 - k BETWEEN 0 AND n - 1),
 kern AS MATERIALIZED (SELECT n, k, (1 / tan(pi() * k / n) - CASE WHEN n % 2 = 1 THEN (1 - 2 * (k % 2)) / sin(pi() * k / n) WHEN k % 2 = 1 THEN -1 / tan(pi() * k / n) ELSE 1 / tan(pi() * k / n) END) / n AS h
  FROM (SELECT n, unnest(range(1, n)) AS k FROM (SELECT DISTINCT n FROM size))),
 hil AS (SELECT a.channel, a.sample, any_value(a.f) AS f, sum(b.f * h) AS g FROM flt a JOIN flt b ON b.channel = a.channel JOIN kern ON kern.n = a.n AND k = (a.sample - b.sample + a.n) % a.n GROUP BY ALL),
 env AS MATERIALIZED (SELECT channel, sample, CAST(sample AS DOUBLE) AS t, f, sqrt(f * f + g * g) AS y, atan2(g, f) AS phase FROM hil)"""


FILTERED = f"{SERIES}, {filtered_sql(4, 0.1, 0.2, 1.0)}"


@register(f"WITH RECURSIVE {EV}, {FILTERED} SELECT channel, sample, round(f, 4) + 0.0 AS filtered, round(y, 4) + 0.0 AS envelope FROM env")
def i2_bandpass_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """In chunks, so that the transform of long series is held against the SQL."""
    own = series_of(spark, sf).withColumn("t", F.col("sample").cast("double"))
    made = oscillation.bandpass(own, 1.0, (0.1, 0.2), 4, 1024, series=C)
    return made.select("channel", "sample", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("filtered", "envelope")])


@register(f"""WITH {EV}, m AS (SELECT channel, median(y) AS med FROM ev GROUP BY channel) SELECT channel, round(any_value(med) + 4 * 1.4826 *
 median(abs(y - med)), 6) AS threshold, round(any_value(med), 6) AS median, round(1.4826 * median(abs(y - med)), 6) AS robust_std FROM ev JOIN m USING
 (channel) GROUP BY channel""")
def i3_robust_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return oscillation.robust_threshold(event_samples(spark, sf), 4.0, C, "y").select("channel", *r6("threshold", "median", "robust_std"))


def _enveloped(spark: SparkSession, sf: str) -> DataFrame:
    """Values as an envelope, and their remainder as a phase."""
    own = series_of(spark, sf).withColumn("t", F.col("sample").cast("double"))
    return own.select("channel", "sample", "t", F.col("y").alias("envelope"), (F.pmod(F.col("y"), F.lit(6.0)) - 3).alias("phase"))


ENVELOPED = f"{SERIES}, env AS (SELECT channel, sample, CAST(sample AS DOUBLE) AS t, y, y - 6 * floor(y / 6) - 3 AS phase FROM ser)"


def frequency_sql(fs: float) -> str:
    return f"""fq AS (SELECT *, (d - 2 * pi() * ceil((d - pi()) / (2 * pi()))) * {fs} / (2 * pi()) AS frequency
 FROM (SELECT *, lead(phase) OVER (PARTITION BY channel ORDER BY sample) - phase AS d FROM env))"""


FREQUENCY = frequency_sql(4)


@register(f"WITH {EV}, {ENVELOPED}, {FREQUENCY} SELECT channel, sample, round(frequency, 6) + 0.0 AS frequency FROM fq")
def i5_instantaneous_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return oscillation.instantaneous_frequency(_enveloped(spark, sf), 4.0, C).select("channel", "sample", *r6("frequency"))


def bursts_sql(k: float, least: float, merge: float) -> str:
    """CTEs from fq to bursts and what is told of each."""
    return f"""med AS (SELECT channel, quantile_cont(y, 0.5) AS m FROM env GROUP BY channel),
 lvl AS (SELECT channel, any_value(m) + {k} * 1.4826 * quantile_cont(abs(y - m), 0.5) AS lvl FROM env JOIN med USING (channel) GROUP BY channel),
 lev AS (SELECT fq.*, lvl FROM fq JOIN lvl USING (channel)), {epochs_sql('burst', 'lev', 'channel', 'y > lvl', merge, least)},
 ins AS (SELECT b.channel, b.epoch_id, max(p.y) AS peak_env, quantile_cont(p.frequency, 0.5) FILTER (WHERE p.idx < b.end_idx) AS frequency_hz,
  min(p.t) FILTER (WHERE p.y > p.lvl AND p.t - b.start_s + 1 >= {least}) AS c FROM burst b JOIN burst_p p ON p.channel = b.channel AND p.idx BETWEEN
 b.start_idx AND b.end_idx GROUP BY ALL)"""


BURSTS = f"{ENVELOPED}, {FREQUENCY}, {bursts_sql(0.5, 3.0, 1.0)}"
DETECTED = f"{FILTERED}, {frequency_sql(1)}, {bursts_sql(2.0, 5.0, 2.0)}"


def _detector(spark: SparkSession, sf: str) -> tuple[oscillation.OscillationDetector, DataFrame]:
    own = series_of(spark, sf).withColumn("t", F.col("sample").cast("double"))
    return oscillation.OscillationDetector(1.0, (0.1, 0.2), 4, None, 2.0, 5.0, 2.0), own


@register(f"""WITH RECURSIVE {EV}, {DETECTED} SELECT channel, epoch_id, start_idx, end_idx, {q6('start_s', 'end_s', 'duration_s')}, round(peak_env, 4) + 0.0 AS peak_env,
 round(frequency_hz, 5) + 0.0 AS frequency_hz, round(coalesce(c, end_s), 6) + 0.0 AS confirmed_s
FROM burst JOIN ins USING (channel, epoch_id)""")
def i4_burst_events(spark: SparkSession, sf: str) -> DataFrame:
    detector, own = _detector(spark, sf)
    rough = [(F.round("peak_env", 4) + F.lit(0.0)).alias("peak_env"), (F.round("frequency_hz", 5) + F.lit(0.0)).alias("frequency_hz")]
    return detector.run(own, C).select("channel", "epoch_id", "start_idx", "end_idx", *r6("start_s", "end_s", "duration_s"), *rough, *r6("confirmed_s"))


@register(f"""WITH RECURSIVE {EV}, {DETECTED} SELECT channel, 'burst_onset' AS event_type, start_s AS event_time FROM burst
 UNION ALL SELECT channel, 'burst_offset', end_s FROM burst""")
def i8_burst_onsets(spark: SparkSession, sf: str) -> DataFrame:
    detector, own = _detector(spark, sf)
    return detector.events(own, C)


@register(f"""WITH {EV}, {BURSTS} SELECT channel, epoch_id, start_idx, end_idx, {q6('start_s', 'end_s', 'duration_s', 'peak_env', 'frequency_hz')},
 round(coalesce(c, end_s), 6) + 0.0 AS confirmed_s
FROM burst JOIN ins USING (channel, epoch_id)""")
def i6_bursts_of_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    own = _enveloped(spark, sf)
    made = oscillation.burst_events(own, oscillation.robust_threshold(own, 0.5, C), 4.0, 3.0, 1.0, C)
    return made.select("channel", "epoch_id", "start_idx", "end_idx", *r6("start_s", "end_s", "duration_s", "peak_env", "frequency_hz", "confirmed_s"))


#: Wavelet power on 13 frequencies from 0.05 on, four an octave.
BOSC_POWER = f"""{SERIES}, wave AS (SELECT q, 0.05 * pow(2, q / 4.0) AS fq, 6.0 / (2 * pi() * 0.05 * pow(2, q / 4.0)) AS s FROM (SELECT
 unnest(range(0, 13)) AS q)),
 tap AS (SELECT q, fq, j, j - 3.5 * s AS l, exp(-(j - 3.5 * s) * (j - 3.5 * s) / (2 * s * s)) AS g, ceil(7 * s + 0.5) AS m FROM (SELECT *,
 unnest(range(0, CAST(ceil(7 * s + 0.5) AS BIGINT))) AS j FROM wave)),
 unit AS (SELECT q, sqrt(sum(g * g)) AS norm FROM tap GROUP BY q), mu AS (SELECT channel, avg(y) AS mu, count(*) AS n FROM ser GROUP BY channel),
 conv AS (SELECT ser.channel, q, sample + j - CAST(floor((m - 1) / 2) AS BIGINT) AS pos, (y - mu) * g / norm * cos(2 * pi() * fq * l) AS re, (y - mu)
 * g / norm * sin(2 * pi() * fq * l) AS im, n
  FROM ser JOIN mu USING (channel), tap JOIN unit USING (q)),
 pw AS (SELECT channel, q, pos AS sample, sum(re) * sum(re) + sum(im) * sum(im) AS power FROM conv WHERE pos >= 0 AND pos < n GROUP BY channel, q, pos),
 mean AS (SELECT channel, q, fq, avg(power) AS mp FROM pw JOIN wave USING (q) GROUP BY channel, q, fq)"""
LINE = """fit AS (SELECT channel, regr_slope(ln(mp), ln(fq)) AS a, regr_intercept(ln(mp), ln(fq)) AS b FROM mean WHERE NOT fq BETWEEN 0.1 AND 0.2
 GROUP BY channel),
 lev AS (SELECT channel, q, fq, exp(b + a * ln(fq)) AS bg FROM mean JOIN fit USING (channel))"""
GIVEN = "lev AS (SELECT channel, q, fq, 40000.0 / (1 + q) AS bg FROM mean)"


def _episodes_sql(levels: str) -> str:
    """Cycles over the background's bound of 0.95 that last for two periods, their union over the band, and its dominant frequency."""
    return f"""WITH {EV}, {BOSC_POWER}, {levels},
 det AS (SELECT channel, q, fq, bg, sample, power, power > bg * -ln(1 - 0.95) AS up FROM pw JOIN lev USING (channel, q) WHERE fq BETWEEN 0.1 AND 0.2),
 cyc AS (SELECT channel, q, fq, g, min(sample) AS a, max(sample) AS b FROM (SELECT *, sample - row_number() OVER (PARTITION BY channel, q ORDER BY
 sample) AS g FROM det WHERE up) GROUP BY channel, q, fq, g HAVING max(sample) - min(sample) + 1 >= 2.0 / fq),
 held AS (SELECT d.*, c.a IS NOT NULL AS detected FROM det d LEFT JOIN cyc c ON c.channel = d.channel AND c.q = d.q AND d.sample BETWEEN c.a AND c.b),
 flat AS (SELECT channel, sample FROM held GROUP BY channel, sample HAVING bool_or(detected)),
 ep AS (SELECT channel, min(sample) AS a, max(sample) AS b FROM (SELECT *, sample - row_number() OVER (PARTITION BY channel ORDER BY sample) AS g FROM
 flat) GROUP BY channel, g),
 wt AS (SELECT e.channel, e.a, h.fq, sum(CASE WHEN detected THEN power / bg ELSE 0 END) AS w FROM ep e JOIN held h ON h.channel = e.channel AND
 h.sample BETWEEN e.a AND e.b GROUP BY ALL),
 best AS (SELECT channel, a, arg_max(fq, {{'w': w, 'f': -fq}}) AS f FROM wt GROUP BY channel, a)
SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY a) - 1 AS epoch_id, a AS start_idx, b AS end_idx, round(f, 6) AS frequency_hz,
 round(least(a + 2.0 / f, b), 6) AS confirmed_s FROM ep JOIN best USING (channel, a)"""


def _bosc(spark: SparkSession, sf: str, background: DataFrame | None = None) -> DataFrame:
    own = series_of(spark, sf).withColumn("t", F.col("sample").cast("double"))
    made = oscillation.bosc_episodes(own, 1.0, (0.1, 0.2), (0.05, 0.4), 4, 0.95, 2.0, background=background, chunk=1024, series=C)["episodes"]
    return made.select("channel", "epoch_id", "start_idx", "end_idx", *r6("frequency_hz", "confirmed_s"))


@register(_episodes_sql(LINE))
def i9_bosc_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return _bosc(spark, sf)


@register(_episodes_sql(GIVEN))
def i10_bosc_background(spark: SparkSession, sf: str) -> DataFrame:
    """With a background in place of the fitted line."""
    return _bosc(spark, sf, spark.range(13).select(F.col("id").cast("int").alias("freq_idx"), (F.lit(40000.0) / (1 + F.col("id"))).alias("background")))


@register(f"""WITH {EV}, {epochs_sql('bout')} SELECT subject, epoch_id, rank, round(start_s - 60, 6) AS window_lo, round(end_s + 60, 6) AS window_hi
 FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY end_idx - start_idx DESC, start_idx) AS rank FROM bout) WHERE rank <= 3""")
def i11_top_bursts(spark: SparkSession, sf: str) -> DataFrame:
    made = oscillation.top_bursts(bouts_of(event_samples(spark, sf)), 3, 60.0, U)
    return made.select("subject", "epoch_id", F.col("rank").cast("long").alias("rank"), *r6("window_lo", "window_hi"))


# --- J: locomotion ----------------------------------------------------------------------------------------------------

BOUTS = f"""ok3 AS (SELECT * FROM ev WHERE subject IN (SELECT subject FROM ev GROUP BY subject HAVING count(*) >= 3)),
 {epochs_sql('bout', src='ok3', mask='y >= 30')}"""
STATS = """st AS (SELECT b.subject, b.epoch_id, avg(p.y) AS mean_speed_cms, max(p.y) AS peak_speed_cms, arg_max(p.t, {'v': p.y, 'i': -p.idx}) -
 any_value(b.start_s) AS time_to_peak_s,
 coalesce(sum(CASE WHEN p.idx > b.start_idx THEN p.y * p.gap END), 0) / 100 AS distance_m FROM bout b JOIN bout_p p ON p.subject = b.subject AND p.idx
 BETWEEN b.start_idx AND b.end_idx GROUP BY b.subject, b.epoch_id)"""


def _bouts(spark: SparkSession, sf: str) -> DataFrame:
    return locomotion.bout_events(event_samples(spark, sf), 30.0, merge_gap_s=HOUR, keys=U)


@register(f"""WITH {EV}, {BOUTS}, {STATS} SELECT subject, epoch_id, round(duration_s, 3) AS duration_s, {q6('mean_speed_cms', 'peak_speed_cms')},
 round(time_to_peak_s, 3) AS time_to_peak_s, round(distance_m, 3) AS distance_m FROM bout JOIN st USING (subject, epoch_id)""")
def j2_bout_table(spark: SparkSession, sf: str) -> DataFrame:
    return _bouts(spark, sf).select(
        "subject", "epoch_id", F.round("duration_s", 3).alias("duration_s"), *r6("mean_speed_cms", "peak_speed_cms"),
        F.round("time_to_peak_s", 3).alias("time_to_peak_s"), F.round("distance_m", 3).alias("distance_m")
    )


def _either_way_sql(name: str, speed: str, peak: str) -> str:
    return f"""SELECT '{name}' AS direction, b.subject, b.epoch_id, b.start_idx, b.end_idx, round(avg({speed}), 6) + 0.0 AS mean_speed_cms,
 round({peak}({speed}), 6) + 0.0 AS peak_speed_cms FROM {name} b JOIN {name}_p p ON p.subject = b.subject AND p.idx BETWEEN b.start_idx AND b.end_idx GROUP BY ALL"""


@register(f"""WITH {EV}, sh AS (SELECT subject, sample, t, y - 60 AS y FROM ev WHERE subject IN (SELECT subject FROM ev GROUP BY subject HAVING count(*) >= 3)),
 {epochs_sql('absolute', src='sh', mask='abs(y) >= 20')}, {epochs_sql('backward', src='sh', mask='y <= -20')}
 {_either_way_sql('absolute', 'abs(p.y)', 'max')} UNION ALL {_either_way_sql('backward', 'p.y', 'min')}""")
def j1_direction_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Bouts in either direction, and backwards, of values less 60."""
    own = event_samples(spark, sf).withColumn("y", F.col("y") - 60)
    made = [
        locomotion.bout_events(own, 20.0, d, merge_gap_s=HOUR, keys=U).select(
            F.lit(d).alias("direction"), "subject", "epoch_id", "start_idx", "end_idx", *r6("mean_speed_cms", "peak_speed_cms")
        )
        for d in ("absolute", "backward")
    ]
    return made[0].union(made[1])


QUIET = f"""{BOUTS}, lastp AS (SELECT subject, max(idx) AS n FROM bout_p GROUP BY subject), q AS (SELECT subject, coalesce(lag(end_idx) OVER
 (PARTITION BY subject ORDER BY start_idx) + 1, 0) AS s, start_idx - 1 AS e FROM bout
 UNION ALL SELECT subject, coalesce(m + 1, 0), n FROM lastp LEFT JOIN (SELECT subject, max(end_idx) AS m FROM bout GROUP BY subject) USING (subject)),
 quiet AS (SELECT q.subject, q.s AS start_idx, q.e AS end_idx, a.t AS start_s, b.t AS end_s FROM q JOIN bout_p a ON a.subject = q.subject AND a.idx =
 q.s JOIN bout_p b ON b.subject = q.subject AND b.idx = q.e JOIN bout_d d ON d.subject = q.subject WHERE q.e >= q.s AND b.t - a.t + step >= 40000)"""


@register(f"WITH {EV}, {QUIET} SELECT subject, start_idx, end_idx, {q6('start_s', 'end_s')} FROM quiet")
def j5_quiescent_runs(spark: SparkSession, sf: str) -> DataFrame:
    own = locomotion.prepare_speed(event_samples(spark, sf), keys=U)
    return locomotion.quiescent_runs(own, _bouts(spark, sf), 40000.0, U).select("subject", "start_idx", "end_idx", *r6("start_s", "end_s"))


@register(f"""WITH {EV}, {BOUTS}, span AS (SELECT subject, 100000.0 AS lo, 2000000.0 AS hi FROM ev GROUP BY subject), c AS (SELECT b.*, lo, hi,
 greatest(lo, coalesce(max(end_s) OVER (PARTITION BY subject ORDER BY start_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS c,
 row_number() OVER (PARTITION BY subject ORDER BY start_s) = 1 AS first FROM bout b JOIN span USING (subject)),
 i AS (SELECT subject, c AS s, least(start_s, hi) AS e, epoch_id AS next_bout, first AS opens FROM c WHERE start_s > c AND c < hi), m AS (SELECT
 span.subject, greatest(lo, coalesce(m, lo)) AS s, hi, m IS NULL AS opens FROM span LEFT JOIN (SELECT subject, max(end_s) AS m FROM bout GROUP BY
 subject) USING (subject)),
 a AS (SELECT * FROM i UNION ALL SELECT subject, s, hi, NULL, opens FROM m WHERE s < hi)
SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY s) - 1 AS epoch_id, round(s, 6) AS start_s, round(e, 6) AS end_s, coalesce(next_bout,
 -1) AS next_bout, next_bout IS NULL AS censored, opens AS opens_recording FROM a WHERE e - s >= 1000""")
def j6_quiescent_periods(spark: SparkSession, sf: str) -> DataFrame:
    spans = event_samples(spark, sf).select("subject").distinct().withColumn("lo", F.lit(100000.0)).withColumn("hi", F.lit(2000000.0))
    made = locomotion.quiescent_periods(_bouts(spark, sf), spans, 1000.0, U)
    return made.select(
        "subject", "epoch_id", *r6("start_s", "end_s"), F.coalesce("next_bout", F.lit(-1)).cast("long").alias("next_bout"), "censored",
        "opens_recording"
    )


@register(f"""WITH {EV}, {BOUTS}, {STATS} SELECT CASE WHEN duration_s >= 40000 AND abs(mean_speed_cms) >= 80 THEN 'Long & fast' WHEN
 abs(mean_speed_cms) >= 80 THEN 'Short & fast' WHEN duration_s >= 40000 THEN 'Long & slow' ELSE 'Short & slow' END AS bout_type, count(*) AS n FROM
 bout JOIN st USING (subject, epoch_id) GROUP BY bout_type""")
def j7_bout_types(spark: SparkSession, sf: str) -> DataFrame:
    return locomotion.classify_bouts(_bouts(spark, sf), 40000.0, 80.0).groupBy("bout_type").agg(F.count("*").alias("n"))


@register(f"""WITH {EV}, r AS (SELECT DISTINCT subject, session FROM ev), n AS (SELECT subject, session, count(*) AS n, avg(y / 10) AS m FROM ev WHERE
 channel = 'click' AND t BETWEEN 100000 AND 2000000 GROUP BY ALL), d AS (SELECT subject, session, bool_or(channel = 'error') AS alive FROM ev GROUP BY
 ALL)
SELECT subject, session, CASE WHEN n > 0 THEN 'ok' WHEN alive THEN 'still' ELSE 'missing' END AS status, coalesce(n, 0) AS n, round(m, 6) AS
 mean_speed_cms FROM r LEFT JOIN n USING (subject, session) LEFT JOIN d USING (subject, session)""")
def j8_treadmill_status(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    made = locomotion.treadmill_status(
        own.where("channel = 'click'"), own.withColumn("device_id", F.col("channel")), own, (100000.0, 2000000.0), "error", 10.0,
        ("subject", "session")
    )
    return made.select("subject", "session", "status", "n", *r6("mean_speed_cms"))


# --- K: pupil and peaks -----------------------------------------------------------------------------------------------


def peaks_sql(source: str, prominence: float, separation: float = 0.0) -> str:
    """CTEs from (channel, i, t, y, v) to peaks, every pair of runs of equal values compared. The distance is kept by a walk down a channel's
    maxima, highest first, with a list of those that are kept (WITH RECURSIVE)."""
    side = lambda name, pick, less, lo, hi: f"""{name}_h AS (SELECT p.channel, p.r, {pick}(o.r) AS h FROM pk p LEFT JOIN flat o ON o.channel =
 p.channel AND o.r {less} p.r AND o.v > p.v GROUP BY ALL),
 {name} AS (SELECT h.channel, h.r, min(o.v) AS low FROM {name}_h h JOIN flat o ON o.channel = h.channel AND o.r >= {lo} AND o.r <= {hi} GROUP BY
 ALL)"""  # noqa: E731
    return f"""mark AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY channel ORDER BY i) THEN 0 ELSE 1 END AS new FROM {source}), num AS (SELECT
 *, sum(new) OVER (PARTITION BY channel ORDER BY i) AS r FROM mark),
 flat AS MATERIALIZED (SELECT channel, r, any_value(v) AS v, min(i) AS a, max(i) AS b FROM num GROUP BY channel, r), nb AS (SELECT *, lag(v) OVER w AS pv, lead(v)
 OVER w AS nv FROM flat WINDOW w AS (PARTITION BY channel ORDER BY r)),
 top AS MATERIALIZED (SELECT channel, r, v, (a + b) // 2 AS i FROM nb WHERE pv < v AND nv < v),
 apart AS (SELECT channel, CASE WHEN median(gap) > 0 THEN greatest(1, round_even({separation} / median(gap), 0)) ELSE 1 END AS least FROM (SELECT channel, t - lag(t) OVER (PARTITION BY channel ORDER BY i) AS gap
 FROM {source}) GROUP BY channel),
 falling AS MATERIALIZED (SELECT top.*, row_number() OVER (PARTITION BY channel ORDER BY v DESC, i DESC) AS k, least FROM top JOIN apart USING (channel)),
 walk AS MATERIALIZED (SELECT DISTINCT channel, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM top UNION ALL
  SELECT w.channel, w.k + 1, CASE WHEN len(list_filter(kept, lambda x: abs(x - f.i) < least)) = 0 THEN list_append(kept, f.i) ELSE kept END FROM walk w JOIN falling f ON f.channel = w.channel AND f.k = w.k + 1),
 pk AS MATERIALIZED (SELECT t.* FROM top t JOIN (SELECT channel, unnest(arg_max(kept, k)) AS i FROM walk GROUP BY channel) USING (channel, i)), {side('left_', 'max', '<', 'coalesce(h.h + 1, 0)', 'h.r')},
 {side('right_', 'min', '>', 'h.r', 'coalesce(h.h - 1, 1000000000)')},
 good AS MATERIALIZED (SELECT *, lag(i, 1, 0) OVER w AS before, lead(i) OVER w AS after FROM (SELECT pk.*, pk.v - greatest(l.low, g.low) AS prominence FROM pk JOIN
 left_ l USING (channel, r) JOIN right_ g USING (channel, r)) WHERE prominence >= {prominence} WINDOW w AS (PARTITION BY channel ORDER BY i)),
 ends AS MATERIALIZED (SELECT g.channel, g.i, arg_min(s.i, {{'v': s.v, 'i': s.i}}) FILTER (WHERE s.i <= g.i) AS onset, arg_min(s.i, {{'v': s.v, 'i': s.i}}) FILTER
 (WHERE s.i >= g.i AND (after IS NULL OR s.i < after)) AS trough
  FROM good g JOIN {source} s ON s.channel = g.channel AND s.i >= before AND (after IS NULL OR s.i < after) GROUP BY g.channel, g.i),
 sound AS MATERIALIZED (SELECT e.channel, e.i, onset, trough FROM ends e JOIN {source} s ON s.channel = e.channel AND s.i BETWEEN onset AND trough GROUP BY ALL
 HAVING count(*) = count(s.y)),
 spot AS MATERIALIZED (SELECT channel || '/' || i AS key, t, v FROM {source}),
 peaks AS (SELECT g.channel, o.t AS onset_s, p.t AS peak_s, q.t AS trough_s, o.v AS onset_value, p.v AS peak_value, q.v AS trough_value, g.prominence,
 p.v - o.v AS amplitude, p.t - o.t AS rise_s, q.t - p.t AS constriction_s
  FROM sound e JOIN good g USING (channel, i) JOIN spot o ON o.key = e.channel || '/' || onset JOIN spot p ON p.key = e.channel || '/' || e.i JOIN spot q ON q.key = e.channel || '/' || trough)"""


PEAKS = ("onset_s", "peak_s", "trough_s", "onset_value", "peak_value", "trough_value", "prominence", "amplitude", "rise_s", "constriction_s")
GAPPED = f"{SERIES}, gapped AS (SELECT channel, sample AS i, t, CASE WHEN sample % 11 <> 5 THEN y END AS y FROM ser)"


@register(f"""WITH RECURSIVE {EV}, {GAPPED}, {own_gaps_sql('gapped', 'whole')}, {peaks_sql('whole', 60.0, 2000.0)} SELECT channel,
 {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in PEAKS)} FROM peaks""")
def k1_prominence_events(spark: SparkSession, sf: str) -> DataFrame:
    return pupil.prominence_events(_gaps(series_of(spark, sf)), 60.0, 2000.0, C).select("channel", *r6(*PEAKS))


@register(f"""WITH RECURSIVE {EV}, {GAPPED}, {own_gaps_sql('gapped', 'whole')}, {peaks_sql('whole', 20.0, 9000.0)} SELECT channel,
 {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in PEAKS)} FROM peaks""")
def k1_peaks_of_stretches(spark: SparkSession, sf: str) -> DataFrame:
    """A wide distance, and stretches of 128 samples, so that distances, prominences, onsets and troughs cross many borders."""
    return pupil.prominence_events(_gaps(series_of(spark, sf)), 20.0, 9000.0, C, 128).select("channel", *r6(*PEAKS))


@register(f"""WITH RECURSIVE {EV}, {GAPPED}, {own_gaps_sql('gapped', 'whole')}, {peaks_sql('whole', 60.0)} SELECT channel,
 {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in PEAKS)} FROM peaks""")
def k1_peaks_without_distance(spark: SparkSession, sf: str) -> DataFrame:
    return pupil.prominence_events(_gaps(series_of(spark, sf)), 60.0, 0.0, C).select("channel", *[(F.round(c, 6) + 0.0).alias(c) for c in PEAKS])


@register(f"""WITH {EV}, {GAPPED}, {own_gaps_sql('gapped', 'whole')}, k AS (SELECT channel, i AS sample, v AS y, count(*) OVER (PARTITION BY channel)
 AS n FROM whole),
 med AS (SELECT channel, sample AS i, {MEDIAN3} AS v FROM k WINDOW w AS (PARTITION BY channel ORDER BY sample)), {sg5_sql('med', 'smooth')}
SELECT s.channel, s.i AS sample, CASE WHEN g.y IS NOT NULL THEN round(s.v, 5) + 0.0 END AS smoothed FROM smooth s JOIN gapped g ON g.channel =
 s.channel AND g.i = s.i""")
def k2_smoothed_pupil(spark: SparkSession, sf: str) -> DataFrame:
    return pupil.smooth_pupil(_gaps(series_of(spark, sf)), 3, 5, 2, C).select("channel", "sample", (F.round("smoothed", 5) + 0.0).alias("smoothed"))


@register(f"""WITH RECURSIVE {EV}, {GAPPED}, {own_gaps_sql('gapped', 'first')}, k AS (SELECT channel, i AS sample, v AS y, count(*) OVER (PARTITION BY channel)
 AS n FROM first),
 med AS (SELECT channel, sample AS i, {MEDIAN3} AS v FROM k WINDOW w AS (PARTITION BY channel ORDER BY sample)), {sg5_sql('med', 'smooth')},
 again AS (SELECT s.channel, s.i, g.t, CASE WHEN g.y IS NOT NULL THEN s.v END AS y FROM smooth s JOIN gapped g ON g.channel = s.channel AND g.i = s.i),
 {own_gaps_sql('again', 'whole')}, {peaks_sql('whole', 10.0, 2000.0)} SELECT channel, {', '.join(f'round({c}, {6 if c.endswith("_s") else 5}) + 0.0 AS {c}' for c in PEAKS)} FROM peaks""")
def k3_dilation_events(spark: SparkSession, sf: str) -> DataFrame:
    made = pupil.dilation_events(pupil.smooth_pupil(_gaps(series_of(spark, sf)), 3, 5, 2, C), 10.0, 2000.0, C)
    return made.select("channel", *[(F.round(c, 6 if c.endswith("_s") else 5) + F.lit(0.0)).alias(c) for c in PEAKS])


@register(f"""WITH RECURSIVE {EV}, {GAPPED}, rough AS (SELECT channel, i, t, floor(y / 10) * 10 AS y FROM gapped), {own_gaps_sql('rough', 'whole')},
 {peaks_sql('whole', 40.0)} SELECT channel, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in PEAKS)} FROM peaks""")
def k3_dilations_of_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks of a given smoothed column, with plateaus: values in tens."""
    rough = _gaps(series_of(spark, sf)).withColumn("smoothed", F.floor(F.col("y") / 10) * 10.0)
    return pupil.dilation_events(rough, 40.0, 0.0, C).select("channel", *[(F.round(c, 6) + 0.0).alias(c) for c in PEAKS])


def _still(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = event_samples(spark, sf)
    return pupil.quiescent_samples(
        own.where("channel = 'view'"), own.where("channel <> 'view'"), 30.0, 43200.0, 1.0, HOUR, 0.0, ("subject", "session")
    )


#: Of the first session: other channels as a treadmill, views as a pupil on its clock, and the stretches between bouts.
STILL = f"""own AS (SELECT * FROM ev WHERE channel <> 'view' AND session = 'ses-01' AND y IS NOT NULL), pup AS (SELECT subject, t, y FROM ev WHERE
 channel = 'view' AND session = 'ses-01'),
 pa AS (SELECT a.subject, a.t, b.t AS pt, b.y AS py FROM own a ASOF LEFT JOIN pup b ON a.subject = b.subject AND a.t >= b.t), na AS (SELECT a.*, b.t
 AS nt, b.y AS ny FROM pa a ASOF LEFT JOIN pup b ON a.subject = b.subject AND a.t <= b.t),
 al AS (SELECT subject, t, CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN CASE WHEN t - pt <= 43200 THEN py END WHEN nt - t <=
 43200 THEN ny END AS pupil FROM na),
 ok3 AS (SELECT * FROM own WHERE subject IN (SELECT subject FROM own GROUP BY subject HAVING count(*) >= 3)),
 {epochs_sql('bout', src='ok3', mask='y >= 30', least=1.0)},
 pos AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t, sample) - 1 AS idx FROM own), lastp AS (SELECT subject, max(idx) AS n FROM pos
 GROUP BY subject),
 q AS (SELECT subject, coalesce(lag(end_idx) OVER (PARTITION BY subject ORDER BY start_idx) + 1, 0) AS s, start_idx - 1 AS e FROM bout
  UNION ALL SELECT subject, coalesce(m + 1, 0), n FROM lastp LEFT JOIN (SELECT subject, max(end_idx) AS m FROM bout GROUP BY subject) USING (subject)),
 quiet AS (SELECT q.subject, a.t AS start_s, b.t AS end_s FROM q JOIN pos a ON a.subject = q.subject AND a.idx = q.s JOIN pos b ON b.subject =
 q.subject AND b.idx = q.e WHERE q.e >= q.s),
 ins AS (SELECT al.subject, t, pupil FROM al JOIN quiet k ON k.subject = al.subject AND al.t BETWEEN start_s AND end_s WHERE pupil IS NOT NULL)"""


@register(f"WITH {EV}, {STILL} SELECT subject, round(t, 6) AS t, pupil FROM ins")
def k4_quiescent_samples(spark: SparkSession, sf: str) -> DataFrame:
    return _still(spark, sf)[0].where("session = 'ses-01'").select("subject", *r6("t"), "pupil")


@register(f"""WITH {EV}, {STILL}, ne AS (SELECT subject, count(*) AS e FROM quiet GROUP BY subject)
SELECT subject, round(quantile_cont(pupil, 0.5), 6) + 0.0 AS baseline_pupil, count(*) AS n_samples, any_value(e) AS n_quiescent_epochs_used, count(*)
 < 3 OR any_value(e) < 2 AS few FROM ins JOIN ne USING (subject) GROUP BY subject""")
def k5_session_baselines(spark: SparkSession, sf: str) -> DataFrame:
    return pupil.session_baselines(*_still(spark, sf), "ses-01", 3, 2).select("subject", *r6("baseline_pupil"), "n_samples", "n_quiescent_epochs_used", "few")


@register(f"""WITH {EV}, b AS (SELECT subject, median(y) AS b FROM ev WHERE channel = 'view' AND session = 'ses-01' GROUP BY subject) SELECT subject,
 session, round(y / b, 6) AS pupil_norm, y AS pupil_raw FROM ev JOIN b USING (subject) WHERE channel = 'view' AND b > 0""")
def k6_normalised_pupil(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf).where("channel = 'view'")
    base = own.where("session = 'ses-01'").groupBy("subject").agg(F.median("y").alias("baseline_pupil"))
    return pupil.normalise_pupil(own, base).select("subject", "session", *r6("pupil_norm"), "pupil_raw")


# --- L, M, N: references, summaries, users' functions -----------------------------------------------------------------


@register(f"""WITH {EV} SELECT subject, count(y) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd FROM ev WHERE session = 'ses-01' GROUP
 BY subject""")
def l1_subject_references(spark: SparkSession, sf: str) -> DataFrame:
    return reference.describe(udf.pooled(event_samples(spark, sf), lambda df: df.where("session = 'ses-01'"))).select("subject", "n", *r6("mean", "sd"))


@register(f"""WITH {EV}, r AS (SELECT subject, avg(y) AS m, stddev_samp(y) AS s FROM ev WHERE session = 'ses-01' GROUP BY subject) SELECT subject,
 sample, round(CASE WHEN s > 0 THEN (y - m) / s END, 6) + 0.0 AS z FROM ev JOIN r USING (subject) WHERE session = 'ses-02'""")
def l2_reference_zscores(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    return reference.zscores(own.where("session = 'ses-02'"), own.where("session = 'ses-01'")).select("subject", "sample", *r6("z"))


@register(f"""WITH {EV}, r AS (SELECT subject, y FROM ev WHERE session = 'ses-01') SELECT v.subject, v.sample, round(100.0 * (count(*) FILTER (WHERE
 r.y < v.y) + 0.5 * count(*) FILTER (WHERE r.y = v.y)) / nullif(count(r.y), 0), 6) AS percentile FROM ev v LEFT JOIN r USING (subject) WHERE session =
 'ses-02' GROUP BY ALL""")
def l3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf)
    return reference.percentiles(own.where("session = 'ses-02'"), own.where("session = 'ses-01'")).select("subject", "sample", *r6("percentile"))


@register(f"""WITH {EV}, q AS (SELECT unnest([0.1, 0.5, 0.9]) AS q) SELECT subject, CAST(q AS DOUBLE) AS q, round(CASE WHEN q < 0.2 THEN
 quantile_cont(y, 0.1) WHEN q < 0.6 THEN quantile_cont(y, 0.5) ELSE quantile_cont(y, 0.9) END, 6) AS value FROM ev, q GROUP BY subject, q""")
def l4_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return reference.quantiles(event_samples(spark, sf), [0.1, 0.5, 0.9]).select("subject", "q", *r6("value"))


@register(
    "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(l_quantity) / sqrt(count(*)) END, 8) AS sem FROM lineitem GROUP BY ALL"
)
def m1_group_mean_sem(spark: SparkSession, sf: str) -> DataFrame:
    made = summary.group_mean_sem(read_table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return made.select("l_returnflag", "l_linestatus", F.round("mean", 6).alias("mean"), F.round("sem", 8).alias("sem"))


@register(f"WITH {EV} SELECT session, " + ", ".join(f"round(avg(y) FILTER (WHERE channel = '{c}'), 6) AS {c}" for c in TYPES) + " FROM ev GROUP BY session")
def m2_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return summary.pivot_mean(event_samples(spark, sf), "session", "channel", TYPES, "y").select("session", *r6(*TYPES))


@register(f"""WITH {EV}, w AS (SELECT subject, session, avg(y) AS y FROM ev GROUP BY ALL), f AS (SELECT *, first_value(y) OVER (PARTITION BY subject
 ORDER BY session) AS f FROM w) SELECT subject, session, round(y - f, 6) + 0.0 AS d_y, round((y - f) / f, 6) + 0.0 AS pct_y FROM f""")
def m3_change_from_first(spark: SparkSession, sf: str) -> DataFrame:
    wide = event_samples(spark, sf).groupBy("subject", "session").agg(F.avg("y").alias("y"))
    return summary.change_from_first(wide, ["y"], order="session").select("subject", "session", *r6("d_y", "pct_y"))


@register(f"""WITH {EV}, w AS (SELECT subject, session, avg(y) AS y FROM ev GROUP BY ALL) SELECT session, round(avg(y), 6) AS mean,
 round(stddev_samp(y) / sqrt(count(y)), 6) AS sem, count(y) AS n FROM w GROUP BY session""")
def m4_mean_by_session(spark: SparkSession, sf: str) -> DataFrame:
    wide = event_samples(spark, sf).groupBy("subject", "session").agg(F.avg("y").alias("y"))
    return summary.mean_sem_n(wide, "session", "y").select("session", *r6("mean", "sem"), "n")


@register(f"""WITH {EV} SELECT subject, session, {q6('mean', 'median', 'max')} FROM (SELECT subject, session, avg(y) AS mean, median(y) AS median,
 max(y) AS max FROM ev GROUP BY ALL)""")
def m5_recording_reducers(spark: SparkSession, sf: str) -> DataFrame:
    return summary.recording_reducers(event_samples(spark, sf), ("subject", "session")).select("subject", "session", *r6("mean", "median", "max"))


def _box_sql(groups: str) -> str:
    using = f"USING ({groups})"
    return f"""WITH {EV}, q AS (SELECT {groups}, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.75) AS q3 FROM ev GROUP BY ALL)
SELECT {groups}, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3, coalesce(min(y) FILTER (WHERE y >=
 q1 - 1.5 * (q3 - q1) AND y <= q1), any_value(q1)) AS whisker_lo,
 coalesce(max(y) FILTER (WHERE y <= q3 + 1.5 * (q3 - q1) AND y >= q3), any_value(q3)) AS whisker_hi, round(avg(y), 6) AS mean, round(CASE WHEN
 count(y) > 1 THEN stddev_samp(y) / sqrt(count(y)) ELSE 0 END, 6) AS sem, count(y) AS n FROM ev JOIN q {using} GROUP BY {groups}"""


@register(_box_sql("channel"))
def m7_box_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary.box_summary(event_samples(spark, sf), ["channel"], "y").select(
        "channel", *r6("q1", "median", "q3"), "whisker_lo", "whisker_hi", *r6("mean", "sem"), "n"
    )


@register(_box_sql("session, channel"))
def m9_grouped_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return summary.box_summary(event_samples(spark, sf), ["session", "channel"], "y").select(
        "session", "channel", *r6("q1", "median", "q3"), "whisker_lo", "whisker_hi", *r6("mean", "sem"), "n"
    )


@register(f"""WITH {EV}, s AS (SELECT CASE WHEN length(subject) = 2 THEN 'short' ELSE 'long' END AS g, subject, session, avg(y) AS m FROM ev GROUP BY
 ALL), b AS (SELECT 'all' AS grp, * FROM s UNION ALL SELECT g, * FROM s)
SELECT grp, session, round(avg(m), 6) AS mean, round(CASE WHEN count(m) > 1 THEN stddev_samp(m) / sqrt(count(m)) END, 6) AS sem, count(DISTINCT
 subject) AS n_subjects FROM b GROUP BY grp, session""")
def m8_subjects_by_category(spark: SparkSession, sf: str) -> DataFrame:
    own = event_samples(spark, sf).withColumn("g", F.when(F.length("subject") == 2, "short").otherwise("long"))
    return summary.subjects_by_category(own, "subject", "session", "y", "g").select("grp", "session", *r6("mean", "sem"), "n_subjects")


@register(f"""WITH {EV}, {SERIES}, c AS (SELECT a.channel AS a, b.channel AS b, corr(a.y, b.y) AS r FROM ser a JOIN ser b ON a.sample = b.sample AND
 a.channel <= b.channel GROUP BY ALL) SELECT a, b, round(r, 6) AS r FROM c""")
def m10_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return summary.correlations(series_of(spark, sf), ()).select("a", "b", *r6("r"))


@register(f"""WITH {EV}, {SERIES}, c AS (SELECT a.channel AS a, b.channel AS b, corr(a.y, b.y) AS r FROM ser a JOIN ser b ON a.sample = b.sample AND
 a.channel < b.channel GROUP BY ALL), e AS (SELECT min(r) AS lo, max(r) AS hi FROM c)
SELECT round(CASE WHEN lo < 0 THEN -greatest(abs(lo), abs(hi)) ELSE 0 END, 6) AS vmin, round(CASE WHEN lo < 0 THEN greatest(abs(lo), abs(hi)) ELSE hi
 END, 6) AS vmax, CASE WHEN lo < 0 THEN 'diverging' ELSE 'sequential' END AS scale FROM e""")
def m10_correlation_scale(spark: SparkSession, sf: str) -> DataFrame:
    return summary.correlation_scale(summary.correlations(series_of(spark, sf), ())).select(*r6("vmin", "vmax"), "scale")


@register(f"WITH {EV} SELECT subject, count(*) AS n, round(max(y) - min(y), 6) AS spread FROM ev GROUP BY subject HAVING count(*) >= 3")
def n1_user_extractor(spark: SparkSession, sf: str) -> DataFrame:
    def spread(part):  # noqa: ANN001, ANN202
        return None if len(part) < 3 else {"n": len(part), "spread": round(float(part["y"].max() - part["y"].min()), 6)}

    return udf.to_frame(event_samples(spark, sf).select("subject", "y"), spread, "n long, spread double", U)


@register(f"""WITH {EV}, o AS (SELECT subject, sample, y, row_number() OVER (PARTITION BY subject ORDER BY t, sample) AS i, max(y) OVER (PARTITION BY subject ORDER BY t,
 sample ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM ev) SELECT subject, sample, i AS seen, round(top, 6) + 0.0 AS top FROM o""")
def n1_running_extractor(spark: SparkSession, sf: str) -> DataFrame:
    """A user's running maximum, fed with the samples in order of time, batch by batch."""

    def step(state, part):  # noqa: ANN001, ANN202
        seen, top = state
        tops = part["y"].cummax().clip(lower=top).round(6) + 0.0
        made = part[["sample"]].assign(seen=range(seen + 1, seen + len(part) + 1), top=tops)
        return (seen + len(part), float(max(top, part["y"].max()))), made

    own = event_samples(spark, sf).select("subject", "sample", "t", "y")
    return udf.stream_of(own, lambda: (0, float("-inf")), step, "sample long, seen long, top double", U)


# --- Smaller items ----------------------------------------------------------------------------------------------------


@register(f"WITH {EV} SELECT channel, sample, t, y FROM ev WHERE subject = 'U1' AND session = 'ses-01'")
def b1_one_recording(spark: SparkSession, sf: str) -> DataFrame:
    return select.one_recording(event_samples(spark, sf), "U1", "ses-01", "task-spont").select("channel", "sample", "t", "y")


@register(f"WITH {EV} SELECT subject, session, count(*) AS n FROM ev WHERE task = 'task-spont' AND session IN ('ses-01', 'ses-03') GROUP BY ALL")
def b2_many_recordings(spark: SparkSession, sf: str) -> DataFrame:
    return select.recordings(
        event_samples(spark, sf), task="task-spont", sessions=["ses-01", "ses-03"]
    ).groupBy("subject", "session").agg(F.count("*").alias("n"))


@register(f"WITH {EV} SELECT subject, session, task FROM ev ORDER BY subject, session, task LIMIT 1")
def b3_first_recording(spark: SparkSession, sf: str) -> DataFrame:
    return select.first_recording(event_samples(spark, sf))


@register(f"WITH {EV} SELECT subject, sample, t, y FROM ev WHERE source = 'clicks' AND channel = 'error'")
def b11_signal(spark: SparkSession, sf: str) -> DataFrame:
    return select.signal(event_samples(spark, sf), "clicks", "error").select("subject", "sample", "t", "y")


@register("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_name END, c_mktsegment, '') AS sex FROM customer")
def b20_first_non_null(spark: SparkSession, sf: str) -> DataFrame:
    rich = read_table(spark, sf, "customer").withColumn("a", F.when(F.col("c_acctbal") > 5000, F.col("c_name")))
    return rich.select("c_custkey", F.coalesce(labels.first_of("a", "c_mktsegment"), F.lit("")).alias("sex"))


@register("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def c13_label_join(spark: SparkSession, sf: str) -> DataFrame:
    own = read_table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nation = read_table(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return own.join(nation, "n_nationkey").join(
        read_table(spark, sf, "region").select("r_regionkey", "r_name"), "r_regionkey"
    ).select("c_custkey", "n_name", "r_name")


@register(f"WITH {EV} SELECT DISTINCT subject FROM ev WHERE subject NOT IN (SELECT subject FROM ev WHERE session = 'ses-05')")
def c15_subjects_without_session(spark: SparkSession, sf: str) -> DataFrame:
    return pupil.lacking_session(event_samples(spark, sf), "ses-05")


@register(f"""WITH {EV}, {ONSETS}, {TRACES} SELECT subject, event_id, rel_idx, round(value, 6) + 0.0 AS value FROM traces WHERE event_type =
 'locomotion_onset' AND roi = 'click'""")
def f11_selected_traces(spark: SparkSession, sf: str) -> DataFrame:
    return eta.select_traces(_eta(spark, sf)["events"], event_type="locomotion_onset", roi="click").select("subject", "event_id", "rel_idx", *r6("value"))


@register(f"WITH {EV}, {POINTS}, {TRACES} SELECT subject, event_id, roi, rel_idx, round(v, 6) AS value FROM raw")
def f5_no_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return eta.subtract_baseline(_traces(spark, sf), None, U).select("subject", "event_id", "roi", "rel_idx", *r6("value"))


@register(f"""WITH {EV}, m AS (SELECT subject, session, max(y) AS v FROM ev GROUP BY ALL) SELECT session, round(avg(v), 6) AS mean, round(CASE WHEN
 count(*) > 1 THEN stddev_samp(v) / sqrt(count(*)) END, 6) AS sem FROM m GROUP BY session""")
def m6_metric_by_session(spark: SparkSession, sf: str) -> DataFrame:
    per = summary.recording_reducers(event_samples(spark, sf), ("subject", "session"))
    return summary.group_mean_sem(per, ["session"], "max").select("session", *r6("mean", "sem"))


@register(f"WITH {EV}, {BOUTS} SELECT subject, start_idx, end_idx FROM bout")
def j4_bout_bounds(spark: SparkSession, sf: str) -> DataFrame:
    extract = locomotion.BoutExtractor(30.0, merge_gap_s=HOUR, keys=U)
    return event_samples(spark, sf).transform(extract).select("subject", "start_idx", "end_idx")


# --- Streams ----------------------------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = read_table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    t = (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(1e6)).cast("double")
    return rows.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("channel"),
        F.col("ts").cast("timestamp").alias("ts"), t.alias("t"), F.col("value").alias("y")
    )


@register("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS window_start, event_type AS channel, value FROM events)
SELECT CAST(epoch(window_start) AS BIGINT) AS window_start, channel, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM w
WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def s3_stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of a stream that the watermark has closed."""
    made = online.drain(online.stream_summary(_event_stream(spark, sf), "6 hours"), shared_path(spark))
    return made.select(F.unix_timestamp("window_start").alias("window_start"), "channel", "n", *r6("mean"), "max")


@register(f"""WITH {EV}, k AS (SELECT subject, t FROM ev WHERE y >= 30),
 m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY subject ORDER BY t) <= 86400 THEN 0 ELSE 1 END AS new FROM k),
 g AS (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY t) AS b FROM m), s AS (SELECT *, min(t) OVER (PARTITION BY subject, b) AS start_s FROM g)
SELECT subject, round(start_s, 6) + 0.0 AS start_s, round(min(t), 6) + 0.0 AS confirmed_s FROM s WHERE t - start_s >= 20000 GROUP BY subject, b, start_s""")
def s2_confirmed_bouts(spark: SparkSession, sf: str) -> DataFrame:
    """Bouts of a stream, told as soon as they have lasted."""
    made = online.drain(online.confirmed_bouts(_event_stream(spark, sf), 30.0, 20000.0, 86400.0, "1 hour"), shared_path(spark))
    return made.select("subject", *r6("start_s", "confirmed_s"))
