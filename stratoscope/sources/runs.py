"""The catalogue of runs: records, fingerprints, discovery, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "created_at string, analyst string, lab string, run struct<name:string,tag:string,script:string>, dataset struct<alias:string,path:string,sha256:string,rows:bigint>, "
    "code struct<hash:string,short:string,branch:string,dirty:boolean,permalink:string,script:string>, params map<string,string>, env map<string,string>"
)
#: What older records add to that.
LEGACY = RECORD.replace(
    "rows:bigint>", "rows:bigint,absolute_path:string>"
) + ", run_name string, tag string, script string, git struct<hash:string,short:string,branch:string,dirty:boolean,permalink:string,script:string>"
KINDS = {"figure": ("svg", "png", "pdf", "jpg", "jpeg"), "table": ("csv", "tsv", "parquet", "json", "xlsx"), "doc": ("md", "html", "txt")}
RESERVED = ("provenance.json", "report.md", "report.html")
STAMP = r"^(\d{6})(?:_(\d{6}))?(?:_(.+))?$"


def run_record(spark: SparkSession, **fields) -> DataFrame:
    """One row of the runs table from plain fields; maps are of text to text."""
    return spark.createDataFrame([fields], RECORD)


def append_run(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """One row (sha256, n_files, bytes): a hash over each file's name, size and CRC-32, in the order of names. Files are read where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return fingerprint_of(files.select(name.alias("name"), "length", F.crc32("content").alias("crc")))


def fingerprint_of(members: DataFrame) -> DataFrame:
    """The same from (name, length, crc). Members are hashed in 4,096 parts by their names' hashes, and the parts' hashes in order, so that
    no row holds more than a part's lines."""
    line = F.concat_ws(":", "name", F.col("length").cast("string"), F.col("crc").cast("string"))
    part = F.substring(F.sha2(F.col("name").cast("binary"), 256), 1, 3)
    parts = members.select(part.alias("part"), line.alias("line"), "length").groupBy("part").agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("h"), F.count("*").alias("c"), F.sum("length").alias("n")
    )
    whole = F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "part", "h"))), "\n"), 256)
    return parts.agg(whole.alias("sha256"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_files"), F.sum("n").alias("bytes"))


def parse_stamp(name: Column) -> tuple[Column, Column]:
    """(ISO time, tag) of a folder YYMMDD[_HHMMSS][_tag]; null and '' for other names and impossible dates."""
    day, clock = F.regexp_extract(name, STAMP, 1), F.regexp_extract(name, STAMP, 2)
    made = F.try_to_timestamp(F.concat(F.lit("20"), day, F.when(clock == "", F.lit("000000")).otherwise(clock)), F.lit("yyyyMMddHHmmss"))
    return F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss"), F.when(made.isNotNull(), F.regexp_extract(name, STAMP, 3)).otherwise(F.lit(""))


def normalise(records: DataFrame, column: str = "json") -> DataFrame:
    """Flat fields of current and older record layouts, given as JSON text."""
    p = F.from_json(column, LEGACY)
    c = lambda *names: F.coalesce(
        *[F.nullif(p.getField(n.split(".")[0]).getField(n.split(".")[1]) if "." in n else p.getField(n), F.lit("")) for n in names], F.lit("")
    )
    path = c("code.script", "git.script", "script")
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return records.withColumns(
        {
            "name": c("run.name", "run_name"),
            "tag": c("run.tag", "tag"),
            "script": F.coalesce(F.nullif(p.getField("run").getField("script"), F.lit("")), stem),
            "alias": c("dataset.alias"),
            "dataset_path": c("dataset.path", "dataset.absolute_path"),
            "rows": p.getField("dataset").getField("rows"),
            "git_short": c("code.short", "git.short"),
            "created_at": p.getField("created_at"),
        }
    )


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Runs below a folder, newest first: run_id, created (recorded, else from the folder's name), and the record's fields."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "provenance.json").load(root)
    folder = F.regexp_replace("path", "/provenance.json$", "")
    rows = normalise(files.select(folder.alias("folder"), F.decode("content", "UTF-8").alias("json")))
    name = F.element_at(F.split("folder", "/"), -1)
    when, tag = parse_stamp(name)
    rows = rows.withColumn("run_id", name).withColumn("created", F.coalesce("created_at", when)).withColumn("tag", F.coalesce(F.nullif("tag", F.lit("")), tag))
    return rows.drop("json").orderBy(F.desc("created"))


def file_kind(suffix: Column) -> Column:
    out = F.lit("other")
    for kind, suffixes in KINDS.items():
        out = F.when(F.lower(suffix).isin(*suffixes), kind).otherwise(out)
    return out


def file_counts(files: DataFrame) -> DataFrame:
    """(run_id, figure, table, doc, other) from (run_id, dir, name): one figure in several formats counts once; reserved files at the top don't count."""
    suffix, stem = F.regexp_extract("name", r"\.([^.]+)$", 1), F.regexp_replace("name", r"\.[^.]*$", "")
    kept = files.where(~(F.col("name").isin(*RESERVED) & (F.col("dir") == ""))).withColumn("kind", file_kind(suffix)).withColumn("stem", stem)
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return kept.groupBy("run_id").agg(
        F.countDistinct(F.when(F.col("kind") == "figure", F.struct("dir", "stem"))).alias("figure"), count("table"), count("doc"), count("other")
    )


def iso_day(stamp: str) -> str:
    """260801 or an ISO date to an ISO date."""
    s = stamp.strip()
    return f"20{s[:2]}-{s[2:4]}-{s[4:6]}" if len(s) == 6 and s.isdigit() else s


def select_runs(runs: DataFrame, alias: str = "", script: str = "", tag: str = "", since: str = "", run: str = "") -> DataFrame:
    """Alias equal, script and tag contained, run id's beginning, created since; empty ones don't filter."""
    out = runs
    if alias:
        out = out.where(F.col("alias") == alias)
    for name, part in (("script", script), ("tag", tag)):
        if part:
            out = out.where(F.contains(F.coalesce(name, F.lit("")), F.lit(part)))
    if run:
        out = out.where(F.startswith("run_id", F.lit(run)))
    if since:
        out = out.where(F.coalesce("created", F.lit("")) >= iso_day(since))
    return out


def newest(runs: DataFrame, *by: str) -> DataFrame:
    """The newest run id by name, tag or the like."""
    return runs.groupBy(*by).agg(F.max_by("run_id", F.struct("created", "run_id")).alias("run_id"), F.max("created").alias("created"))
