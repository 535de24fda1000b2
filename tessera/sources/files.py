"""Readers of JSON lines, JSON folders, shards and source trees. Schemas are given, never inferred."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.folders import exists
from tessera.functions import config, text
from tessera.functions.rust import package

BAD = "_malformed"
#: Records of the files that evaluations and promotions write.
CURVE = "tag string, model string, perplexity double, weights_fp string, ts double"
CHECKPOINT = "cycle long, base_model string, adapter_stack array<string>, data_manifest_hash string, solve_rate double, adapter_dir string, score double, second_solve double, created_at double, promoted boolean"
RESULT = "suite string, model string, seed long, solve_rate double, per_task array<struct<task_id:string,solved:boolean,reward:double,steps:long,tokens:long,latency_s:double,usd:double>>"


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False, recursive: bool = False) -> DataFrame:
    """Rows of JSON lines (also gzipped), fields outside the schema left out; malformed lines are in `_malformed`, or raise if strict.

    A missing path gives no rows. Blank lines are skipped.
    """
    fields = _schema(schema)
    full = T.StructType([*fields.fields, T.StructField(BAD, T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], fields if strict else full)
    reader = spark.read.option("recursiveFileLookup", recursive)
    if strict:
        return reader.schema(fields).option("mode", "FAILFAST").json(path)
    return reader.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def sound(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(BAD).isNull()).drop(BAD)


def malformed(rows: DataFrame) -> DataFrame:
    """One row: lines, malformed lines, and an order-free hash of all fields (Spark reads no malformed column without another one)."""
    return rows.agg(F.count("*").alias("n_lines"), F.count_if(F.col(BAD).isNotNull()).alias("n_malformed"), F.bit_xor(F.xxhash64(*[c for c in rows.columns if c != BAD])).alias("content_hash"))


def json_documents(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """One row for each JSON file of a folder or of several, with file_name; order by it."""
    return spark.read.schema(_schema(schema)).option("multiLine", True).json(path).withColumn("file_name", F.col("_metadata.file_name"))


def shard(spark: SparkSession, folder: str, name: str, schema: str | T.StructType) -> DataFrame:
    """Rows of folder/name.jsonl.gz, else of folder/name.jsonl, else none. A broken line is an error."""
    for path in (f"{folder}/{name}.jsonl.gz", f"{folder}/{name}.jsonl"):
        if exists(spark, path):
            return json_lines(spark, path, schema, strict=True)
    return spark.createDataFrame([], _schema(schema))


def recursive_ids(spark: SparkSession, folder: str, prefix: str = "pr-", pattern: str = "*.json*") -> DataFrame:
    """task_id of all JSON lines files below a folder whose names fit the pattern: their task_id, and prefix and number where there is a pr_number. Broken lines are skipped."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "task_id string")
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder).select(F.from_json("value", "task_id string, pr_number string").alias("r"))
    ids = F.array(F.nullif("r.task_id", F.lit("")), F.when(~F.coalesce("r.pr_number", F.lit("")).isin("", "0"), F.concat(F.lit(prefix), "r.pr_number")))
    return rows.select(F.explode(ids).alias("task_id")).where("task_id IS NOT NULL").distinct()


def learning_curve(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a learning curve; ord is the place in the file or, with several files, grows with it."""
    return sound(json_lines(spark, path, CURVE)).withColumn("ord", F.monotonically_increasing_id())


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a checkpoint registry, unknown fields left out, broken lines skipped."""
    return sound(json_lines(spark, path, CHECKPOINT)).withColumn("ord", F.monotonically_increasing_id())


def parquet_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table, from its footers."""
    return spark.read.parquet(path).count()


def evaluation_ids(documents: DataFrame) -> DataFrame:
    """task_id of evaluation files: the field, else the file's stem."""
    return documents.select(F.coalesce("task_id", F.regexp_extract("file_name", r"^(.*)\.json$", 1)).alias("task_id")).distinct()


def source_files(spark: SparkSession, root: str, include: list[str], exclude: list[str] = (), order: DataFrame | None = None) -> DataFrame:
    """path (under root), content and topo_rank of text files that the patterns choose; order has (name, topo_rank) of packages."""
    read = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    full: Column = F.col("_metadata.file_path")
    below = re.sub(r"^\w+:(//)?", "", root.rstrip("/"))  # schemes are written in more than one way
    rows = read.select(F.substring_index(full, f"{below}/", -1).alias("path"), F.col("value").alias("content"))
    rows = rows.where(text.in_scope(F.col("path")) & text.matches(F.col("path"), list(include), list(exclude))).withColumn("name", F.regexp_extract("path", text.CRATE, 1))
    if order is None:
        return rows.withColumn("topo_rank", F.lit(None).cast("long")).drop("name")
    return rows.join(order, "name", "left").select("path", "content", "topo_rank")


def _configuration(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        stem, suffix = batch["name"].str.rsplit(".", n=1, expand=True).reindex(columns=[0, 1]).to_numpy().T
        yield pd.DataFrame({"config": stem, "body": [json.dumps(config.parsed(value, f".{x}"), default=str) for value, x in zip(batch["value"], suffix, strict=True)]})


def configurations(spark: SparkSession, folder: str) -> DataFrame:
    """config (a file's stem), body (JSON text) of the configuration files of a folder; see config.settings_rows. A file that can't be parsed is an error; other files are not looked at."""
    pattern = "*.{" + ",".join(x[1:] for x in config.SUFFIXES) + "}"
    found = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return found.select(F.col("_metadata.file_name").alias("name"), "value").mapInPandas(_configuration, "config string, body string")


def _manifest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([x for value in batch["value"] for x in package(value)], columns=["name", "deps"])


def manifests(spark: SparkSession, glob: str) -> DataFrame:
    """name, deps of package manifests; deps are packages of the same workspace, without the package itself."""
    found = spark.read.text(glob, wholetext=True).mapInPandas(_manifest, "name string, deps array<string>")
    edges = found.select("name", F.explode("deps").alias("dep")).join(found.select(F.col("name").alias("dep")), "dep", "left_semi").where("name <> dep")
    return found.select("name").join(edges.groupBy("name").agg(F.array_sort(F.collect_set("dep")).alias("deps")), "name", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))


def test_events(lines: DataFrame) -> DataFrame:
    """event, name of finished tests in a test runner's JSON lines (value); other lines are skipped."""
    row = F.from_json("value", "type string, event string, name string")
    return lines.select(row.alias("e")).where("e.type = 'test' AND e.event IN ('ok', 'failed')").select("e.event", "e.name")


def test_runs(runs: DataFrame) -> DataFrame:
    """run, exit_code, passed, failed, error of runs (run, exit_code, stdout, stderr).

    stdout has JSON lines, of which finished tests count and others are skipped; a test without a name is '?'. A run that ended badly without one test broke down
    itself: its error is the last 500 characters of stderr, or of stdout where that is empty. A null exit code is a run that timed out: -1, without tests.
    """
    event = lambda line: F.from_json(line, "type string, event string, name string")
    events = F.filter(F.transform(F.split(F.coalesce("stdout", F.lit("")), "\r\n|\n|\r"), event), lambda e: (e["type"] == "test") & e["event"].isin("ok", "failed"))
    own = runs.withColumn("events_", F.when(F.col("exit_code").isNull(), F.slice(events, 1, 0)).otherwise(events))
    names = lambda which: F.transform(F.filter("events_", lambda e: e["event"] == which), lambda e: F.coalesce(e["name"], F.lit("?")))
    said = F.coalesce(F.nullif("stderr", F.lit("")), "stdout", F.lit(""))
    tail = F.when(F.char_length(said) > 500, F.expr("right(coalesce(nullif(stderr, ''), stdout, ''), 500)")).otherwise(said)
    broke = (F.col("exit_code") != 0) & (F.size("events_") == 0)
    error = F.when(F.col("exit_code").isNull(), F.lit("timed out")).when(broke, tail)
    return own.select("run", F.coalesce("exit_code", F.lit(-1)).alias("exit_code"), names("ok").alias("passed"), names("failed").alias("failed"), error.alias("error"))


def commits(log: DataFrame) -> DataFrame:
    """sha, subject of log lines (value) with fields divided by NUL; lines without NUL belong to bodies and go."""
    parts = F.split("value", "\\x00")
    return log.where(F.contains("value", F.lit("\0"))).select(F.element_at(parts, 1).alias("sha"), F.element_at(parts, 2).alias("subject"))
