"""Queries that write with a sink, read back with a source, and return the rows that came back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.folders import work_folder
from tessera.functions import config, rust
from tessera.operators import evaluation, graph, stages
from tessera.plans.corpus_queries import FILES, MODE, table
from tessera.plans.corpus_queries import files as source_rows
from tessera.plans.registry import register
from tessera.plans.result_queries import curve
from tessera.plans.selection_queries import registry as registry_rows
from tessera.sources import files, sinks

CUSTOMER = "task_id long, name string, balance double"


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


@register("json_lines_overwrite", "SELECT c_custkey AS task_id, c_name AS name, c_acctbal AS balance FROM customer")
def json_lines_overwrite(spark, sf_dir):
    path = f"{work_folder(spark, 'source')}/rows"
    sinks.json_lines(customers(spark, sf_dir).limit(3), path)
    sinks.json_lines(customers(spark, sf_dir), path)
    return files.json_lines(spark, path, CUSTOMER, strict=True)


@register("json_lines_append", "SELECT c_custkey AS task_id, c_name AS name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 = 0")
def json_lines_append(spark, sf_dir):
    path = f"{work_folder(spark, 'source')}/rows"
    sinks.json_lines(customers(spark, sf_dir), path)
    sinks.json_lines(customers(spark, sf_dir).where("task_id % 10 = 0"), path, append=True)
    return files.sound(files.json_lines(spark, path, "task_id long, name string"))


@register("json_lines_tolerant", "SELECT count(*) AS n_lines, count(*) FILTER (c_custkey % 7 = 0) AS n_malformed, true AS hashed FROM customer")
def json_lines_tolerant(spark, sf_dir):
    """Every seventh line is broken."""
    path = f"{work_folder(spark, 'source')}/rows"
    line = F.to_json(F.struct("task_id", "name"))
    sinks.text_blocks(customers(spark, sf_dir).select(F.when(F.col("task_id") % 7 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value")), path)
    return files.malformed(files.json_lines(spark, path, "task_id long, name string")).select("n_lines", "n_malformed", F.col("content_hash").isNotNull().alias("hashed"))


@register("gzip_shards", "SELECT event_id % 10 AS cycle, event_id, CASE WHEN event_id % 10 = 3 THEN 'again' ELSE event_type END AS kind FROM events")
def gzip_shards(spark, sf_dir):
    """Shards by cycle, of which one is written again."""
    path = f"{work_folder(spark, 'source')}/shards"
    own = table(spark, sf_dir, "events").select((F.col("event_id") % 10).alias("cycle"), "event_id", F.col("event_type").alias("kind"))
    sinks.shards(own, path)
    sinks.shards(own.where("cycle = 3").withColumn("kind", F.lit("again")), path)
    return files.json_lines(spark, path, "cycle long, event_id long, kind string", strict=True)


@register("shard_preference", "SELECT 'both' AS name, count(*) AS n FROM customer UNION ALL SELECT 'plain', count(*) FROM supplier UNION ALL SELECT 'none', 0")
def shard_preference(spark, sf_dir):
    """The gzipped shard before the plain one, the plain one before nothing."""
    folder = work_folder(spark, "source")
    sinks.json_lines(customers(spark, sf_dir), f"{folder}/both.jsonl.gz", compress=True)
    sinks.json_lines(customers(spark, sf_dir).limit(1), f"{folder}/both.jsonl")
    sinks.json_lines(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task_id")), f"{folder}/plain.jsonl")
    one = lambda name: files.shard(spark, folder, name, "task_id long").agg(F.lit(name).alias("name"), F.count("*").alias("n")).select("name", "n")
    return one("both").union(one("plain")).union(one("none"))


@register("parquet_readback", "SELECT count(*) AS n FROM orders")
def parquet_readback(spark, sf_dir):
    path = f"{work_folder(spark, 'source')}/rows"
    sinks.parquet(table(spark, sf_dir, "orders").select("o_orderkey"), path)
    return spark.range(1).select(F.lit(files.parquet_count(spark, path)).cast("long").alias("n"))


@register("origin_sink", "SELECT c_custkey AS task_id, 'real' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, 'synthetic' FROM supplier")
def origin_sink(spark, sf_dir):
    """Real tasks are replaced, synthetic ones stay."""
    path = f"{work_folder(spark, 'source')}/tasks"
    real = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"))
    sinks.replace_origin(real, path)
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task_id"), F.lit("synthetic").alias("origin")).write.mode("append").partitionBy("origin").parquet(path)
    sinks.replace_origin(real.where("task_id % 2 = 0"), path)
    return spark.read.schema("task_id long, origin string").parquet(path)


@register("text_log", "SELECT 'user ' || user_id || ' did ' || event_type AS line, count(*) AS n FROM events GROUP BY ALL")
def text_log(spark, sf_dir):
    path = f"{work_folder(spark, 'source')}/log"
    blocks = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type").alias("value"))
    for half in (0, 1):
        sinks.text_blocks(blocks.where(F.col("event_id") % 2 == half).select("value"), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@register("json_document", "SELECT c_mktsegment AS model, round(avg((o_orderstatus = 'F')::INT), 6) AS solve_rate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL")
def json_document(spark, sf_dir):
    path = f"{work_folder(spark, 'source')}/best"
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    sinks.document(own.groupBy(F.col("c_mktsegment").alias("model")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("solve_rate")), path)
    return files.json_documents(spark, path, "model string, solve_rate double").select("model", "solve_rate")


@register("split_sinks", "SELECT count(*) AS n FROM documents")
def split_sinks(spark, sf_dir):
    """Both sides of the split, written beside each other and counted together."""
    folder = work_folder(spark, "source")
    sinks.split_samples(source_rows(spark, sf_dir), f"{folder}/train", f"{folder}/held")
    kind = "path string, training_content string"
    both = files.json_lines(spark, f"{folder}/train", kind, strict=True).unionByName(files.json_lines(spark, f"{folder}/held", kind, strict=True))
    return both.agg(F.countDistinct("path").alias("n"))


@register("split_table", f"WITH {FILES} SELECT bucket % 100 < 15 AS held_out, path, ({MODE}) IS NOT NULL AS rewritten FROM files")
def split_table(spark, sf_dir):
    """Both sides, written in one pass, as they come back."""
    path = f"{work_folder(spark, 'source')}/split"
    sinks.split_table(source_rows(spark, sf_dir), path)
    back = spark.read.schema("path string, training_content string, held_out boolean").option("mode", "FAILFAST").json(path)
    return back.select("held_out", "path", F.col("training_content").rlike("^<.fim_(prefix|suffix).>").alias("rewritten"))


SETTINGS = """s AS (SELECT 's' || s_suppkey AS config, * FROM supplier)
SELECT config, 'name' AS key, s_name AS value FROM s UNION ALL SELECT config, 'train.steps', (s_suppkey * 10)::VARCHAR FROM s UNION ALL
SELECT config, 'train.optimizer.betas', '[' || s_nationkey || ',' || s_suppkey || ']' FROM s UNION ALL SELECT config, 'train.optimizer.fused', (s_suppkey % 2 = 0)::VARCHAR FROM s UNION ALL
SELECT config, 'train.resume', NULL FROM s UNION ALL SELECT config, 'stage-' || s_nationkey || '.on', 'true' FROM s WHERE s_suppkey % 3 = 0"""


@register("config_settings", f"WITH {SETTINGS}")
def config_settings(spark, sf_dir):
    """Configurations of different fields, written as JSON lines, as rows of settings."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    optimizer = F.concat(F.lit('{"betas":['), nation, F.lit(","), key.cast("string"), F.lit('],"fused":'), (key % 2 == 0).cast("string"), F.lit("}"))
    train = F.concat(F.lit('{"steps":'), (key * 10).cast("string"), F.lit(',"resume":null,"optimizer":'), optimizer, F.lit("}"))
    stage = F.when(key % 3 == 0, F.concat(F.lit(',"stage-'), nation, F.lit('":{"on":true}'))).otherwise(',"unused":{}')
    body = F.concat(F.lit('{"name":"'), "s_name", F.lit('","train":'), train, stage, F.lit("}"))
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key.cast("string")).alias("config"), body.alias("body"))
    path = f"{work_folder(spark, 'source')}/settings"
    sinks.json_lines(own, path)
    return config.settings_rows(files.json_lines(spark, path, "config string, body string", strict=True))


@register("eval_ids_recursive", "SELECT 't' || conv_id AS task_id FROM conversations WHERE conv_id % 2 = 0 UNION SELECT 'pr-' || conv_id FROM conversations WHERE conv_id % 2 = 1 AND conv_id > 0 UNION SELECT 'pr-' || s_suppkey FROM supplier WHERE s_suppkey > 0")
def eval_ids_recursive(spark, sf_dir):
    """Ids of two folders: by field or by number, with broken lines between them."""
    folder, i = work_folder(spark, "source"), F.col("conv_id")
    line = F.when(i % 2 == 0, F.to_json(F.struct(F.concat(F.lit("t"), i.cast("string")).alias("task_id")))).otherwise(F.to_json(F.struct(i.alias("pr_number"))))
    lines = table(spark, sf_dir, "conversations").select(F.explode(F.array(line, F.lit("{broken"))).alias("value"))
    lines.write.text(f"{folder}/ids/a/x.jsonl")
    sinks.json_lines(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("pr_number")), f"{folder}/ids/b/c/y.jsonl")
    return files.recursive_ids(spark, f"{folder}/ids", pattern="part-*")


@register("eval_result_scan", "SELECT doc_id AS task_id, quality = 1 AS solved FROM labels")
def eval_result_scan(spark, sf_dir):
    """Result documents written as JSON, read by schema and taken apart."""
    path = f"{work_folder(spark, 'source')}/results"
    task = F.struct(F.col("doc_id").cast("string").alias("task_id"), (F.col("quality") == 1).alias("solved"), F.lit(1.0).alias("reward"), F.lit("ignored").alias("extra"))
    table(spark, sf_dir, "labels").groupBy(F.expr("doc_id div 40").alias("suite")).agg(F.collect_list(task).alias("per_task")).write.json(path)
    return evaluation.solved(spark.read.schema(files.RESULT).json(path)).select(F.col("task_id").cast("long").alias("task_id"), "solved")


@register("learning_curve_scan", "SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'base' ELSE 't' || s_suppkey % 5 END AS tag, round(sum(s_suppkey / 4 + 1), 6) AS perplexity, count(*) AS n FROM supplier GROUP BY tag")
def learning_curve_scan(spark, sf_dir):
    path = f"{work_folder(spark, 'source')}/curve"
    sinks.json_lines(curve(spark, sf_dir), path)
    return files.learning_curve(spark, path).groupBy("tag").agg(F.round(F.sum("perplexity"), 6).alias("perplexity"), F.count("*").alias("n"))


@register("registry_scan", "SELECT s_suppkey AS cycle, s_acctbal AS solve_rate, s_nationkey % 2 = 0 AS promoted FROM supplier")
def registry_scan(spark, sf_dir):
    """Unknown fields are left out."""
    path = f"{work_folder(spark, 'source')}/registry"
    sinks.json_lines(registry_rows(spark, sf_dir).withColumn("unknown", F.lit(1)), path)
    return files.registry(spark, path).select("cycle", "solve_rate", "promoted")


@register("test_events_scan", "SELECT event_type AS name, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'failed' END AS event, count(*) AS n FROM events WHERE event_id % 5 < 2 GROUP BY ALL")
def test_events_scan(spark, sf_dir):
    i = F.col("event_id")
    event = F.to_json(F.struct(F.lit("test").alias("type"), F.when(i % 2 == 0, "ok").otherwise("failed").alias("event"), F.col("event_type").alias("name")))
    line = F.when(i % 5 < 2, event).when(i % 5 == 2, "   Compiling x").when(i % 5 == 3, '{"type":"suite","event":"ok"}').otherwise('{"type":"test","event":"started","name":"x"}')
    return files.test_events(table(spark, sf_dir, "events").select(line.alias("value"))).groupBy("event", "name").agg(F.count("*").alias("n"))


@register("commit_log_scan", "SELECT sha256(doc_id::VARCHAR) AS sha, source AS subject FROM documents")
def commit_log_scan(spark, sf_dir):
    """Lines of a log, of which bodies go on over several lines."""
    line = F.concat(F.sha2(F.col("doc_id").cast("string"), 256), F.lit("\0"), "source", F.lit("\0body"))
    return files.commits(table(spark, sf_dir, "documents").select(F.explode(F.array(line, F.lit("more of the body"))).alias("value")))


LINES = "string_agg(doc_id || ' ' || coalesce(source, '') || chr(10), '' ORDER BY doc_id)"


@register("source_tree", f"SELECT 'crates/c' || doc_id % 3 || '/src/a.rs' AS path, 2 - doc_id % 3 AS topo_rank, sha256({LINES}) AS digest FROM documents GROUP BY doc_id % 3 UNION ALL SELECT 'docs/a.md', NULL, sha256({LINES}) FROM documents WHERE doc_id % 4 = 0")
def source_tree(spark, sf_dir):
    """Source files of three packages in the order of their dependencies, and a document; a test's file is left out."""
    root = f"{work_folder(spark, 'source')}/tree"
    line = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("source", F.lit("")))
    own = table(spark, sf_dir, "documents").select("doc_id", line.alias("value"))
    text = lambda rows, path: sinks.text_file(rows.orderBy("doc_id").select("value"), f"{root}/{path}")
    for i in range(3):
        text(own.where(F.col("doc_id") % 3 == i), f"crates/c{i}/src/a.rs")
        needs = f'[package]\nname = "c{i}"\n[dependencies]\nserde = "1"\n' + (f'c{i + 1} = {{ path = "../c{i + 1}" }}\n' if i < 2 else "")
        sinks.text_file(spark.createDataFrame([(needs,)], "value string"), f"{root}/crates/c{i}/Cargo.toml")
    text(own.where("doc_id % 4 = 0"), "docs/a.md")
    text(own.where("doc_id % 5 = 0"), "crates/c0/tests/a.rs")
    order = graph.topological_ranks(files.manifests(spark, f"{root}/crates/*/Cargo.toml"))
    found = files.source_files(spark, root, ["crates/*.rs", "docs/*"], ["*/tests/*"], order)
    return found.select("path", "topo_rank", F.sha2("content", 256).alias("digest"))


@register("manifests_scan", "SELECT 'n' || n_nationkey AS name, 'r' || n_regionkey AS deps FROM nation UNION ALL SELECT 'r' || r_regionkey, '' FROM region")
def manifests_scan(spark, sf_dir):
    """A manifest for each nation and region; names outside of the workspace are no dependencies."""
    root = f"{work_folder(spark, 'source')}/manifests"
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = lambda name, rest: F.concat(F.lit('[package]\nname = "'), name, F.lit('"\n[dependencies]\nserde = "1"\n'), rest)
    n, r = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    dep = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(' = { path = "x" }\n[dev-dependencies]\n'), n, F.lit(' = "1"\n'))
    both = nation.select(n.alias("file"), named(n, dep).alias("value")).union(region.select(r, named(r, F.lit(""))))
    both.write.partitionBy("file").text(root)
    return files.manifests(spark, f"{root}/*/*").select("name", F.array_join("deps", ",").alias("deps"))


@register("eval_ids_folders", "SELECT 't' || count(*) || '-' || c_nationkey % 3 AS task_id FROM customer GROUP BY c_nationkey % 3 UNION SELECT 's' || c_nationkey % 3 FROM customer")
def eval_ids_folders(spark, sf_dir):
    """Three folders of result files, of which one has an id and one is known by its name."""
    root, own = work_folder(spark, "source"), table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 3).alias("i")).count()
    for i in range(3):
        one = own.where(F.col("i") == i)
        task = F.concat(F.lit("t"), F.col("count").cast("string"), F.lit(f"-{i}"))
        sinks.text_file(one.select(F.to_json(F.struct(task.alias("task_id"))).alias("value")), f"{root}/suite{i}/x.json")
        sinks.text_file(one.select(F.to_json(F.struct(F.col("count").alias("n"))).alias("value")), f"{root}/suite{i}/s{i}.json")
    return files.evaluation_ids(files.json_documents(spark, [f"{root}/suite{i}" for i in range(3)], "task_id string"))


@register(
    "test_runs",
    """
WITH r AS (SELECT user_id AS run, CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 101 ELSE 0 END AS code, user_id % 4 = 0 AS broken, count(*) FILTER (event_type = 'click') AS ok, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY user_id
), t AS (SELECT run, code, CASE WHEN broken OR code IS NULL THEN 0 ELSE ok END AS n_passed, CASE WHEN broken OR code IS NULL THEN 0 ELSE bad END AS n_failed FROM r)
SELECT run, coalesce(code, -1)::INTEGER AS exit_code, n_passed::INTEGER AS n_passed, n_failed::INTEGER AS n_failed, CASE WHEN code IS NULL THEN 'timed out' WHEN code <> 0 AND n_passed + n_failed = 0 THEN right('error ' || repeat('e' || run, 400), 500) END AS error FROM t
""",
)
def test_runs(spark, sf_dir):
    """Events as a test runner's lines, runs by user; some ended badly without a test, some timed out."""
    user, broken = F.col("user_id"), F.col("user_id") % 4 == 0
    event = lambda e: F.to_json(F.struct(F.lit("test").alias("type"), F.lit(e).alias("event"), F.col("event_id").cast("string").alias("name")))
    line = F.when(broken, "   Compiling x").when(F.col("event_type") == "click", event("ok")).when(F.col("event_type") == "error", event("failed")).otherwise("{broken")
    runs = table(spark, sf_dir, "events").groupBy(user.alias("run")).agg(F.array_join(F.collect_list(line), "\n").alias("stdout"))
    code = F.when(F.col("run") % 11 == 0, None).when(F.col("run") % 3 == 0, 101).otherwise(0)
    runs = runs.withColumn("exit_code", code).withColumn("stderr", F.concat(F.lit("error "), F.repeat(F.concat(F.lit("e"), F.col("run").cast("string")), 400)))
    return files.test_runs(runs).select("run", "exit_code", F.size("passed").alias("n_passed"), F.size("failed").alias("n_failed"), "error")


@register("rust_items_lateral", "SELECT doc_id, 'fn' AS kind, 'pub fn f' || doc_id || '() { \"}\"; }' AS source FROM documents UNION ALL SELECT doc_id, 'struct', 'struct S' || doc_id || ';' FROM documents")
def rust_items_lateral(spark, sf_dir):
    """Documents as sources, in the comments of which they stand; a table function gives a row for each item."""
    rust.register(spark)
    d = F.col("doc_id").cast("string")
    code = F.concat(F.lit("/* fn "), F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("")), F.lit("*/ #[x(y)]\npub fn f"), d, F.lit('() { "}"; }\n// struct\nuse a::b;\nstruct S'), d, F.lit(";\n"))
    table(spark, sf_dir, "documents").select("doc_id", F.replace(code, F.lit("/* fn /*"), F.lit("/* fn ")).alias("code")).createOrReplaceTempView("tessera_sources")
    return spark.sql("SELECT doc_id, i.kind, i.source FROM tessera_sources, LATERAL rust_items(code) i")


@register("package_needs_lateral", "SELECT DISTINCT 'p' || p_partkey AS name, 'p' || d AS dep FROM part, LATERAL (SELECT unnest([p_partkey // 2, p_partkey // 3]) AS d) WHERE d <> p_partkey")
def package_needs_lateral(spark, sf_dir):
    """Parts as manifests; a table function gives an edge for each dependency."""
    rust.register(spark)
    p = lambda c: F.concat(F.lit("p"), c.cast("string"))
    manifest = F.concat(F.lit('[package]\nname = "'), p(F.col("p_partkey")), F.lit('"\n[dependencies]\n'), p(F.expr("p_partkey div 2")), F.lit(' = "1"\n[dev-dependencies]\n'), p(F.expr("p_partkey div 3")), F.lit(' = "1"\n'))
    table(spark, sf_dir, "part").select(manifest.alias("manifest")).createOrReplaceTempView("tessera_manifests")
    return spark.sql("SELECT n.name, n.dep FROM tessera_manifests, LATERAL package_needs(manifest) n")


@register("stage_dispatch", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY event_type")
def stage_dispatch(spark, sf_dir):
    """Stages that fail on the way, and go on behind the last complete one; the first of them must not run again."""
    folder, own = work_folder(spark, "stages"), table(spark, sf_dir, "events").select("event_id", "event_type")

    def fails(rows):
        raise RuntimeError("stopped on the way")

    once = [("even", lambda rows: rows.where("event_id % 2 = 0")), ("count", fails)]
    try:
        stages.dispatched(own, once, folder)
    except RuntimeError:
        pass
    again = [("even", fails), ("count", lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n")))]
    return stages.dispatched(own, again, folder)
