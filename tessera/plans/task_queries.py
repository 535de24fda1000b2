"""Queries on tasks, chat records and quality gates. Orders with their parts' brands stand for tasks and their packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import chat, corpus, evaluation, tasks
from tessera.plans.corpus_queries import table
from tessera.plans.registry import register

#: Lines that a task gathers into lists at once.
LINES = 500_000
CHEAP = tuple(f"Brand#{i}" for i in range(1, 16))
CHEAP_SQL = "[" + ", ".join(f"'{c}'" for c in CHEAP) + "]"
TASKS = f"""tasks AS (SELECT o_orderkey AS task_id, crates, len(crates) = 1 AS single_crate, CASE WHEN len(list_filter(crates, lambda x: NOT list_contains({CHEAP_SQL}, x))) = 0 THEN 'execution' ELSE 'pattern' END AS verify_mode
FROM (SELECT l_orderkey AS o_orderkey, list_sort(list_distinct(list(p_brand))) AS crates FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey))"""


def order_tasks(spark, sf_dir) -> DataFrame:
    """task_id, ord, crates, single_crate, verify_mode of orders."""
    lines = table(spark, sf_dir, "lineitem")
    n = max(spark.sparkContext.defaultParallelism, lines.count() // LINES)  # lists are sorted by task to be merged: as many partitions as the lines need
    lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").repartition(n, "l_orderkey")
    own = lines.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.array_sort(F.collect_set("p_brand")).alias("crates"))
    return own.select("task_id", F.col("task_id").alias("ord"), "crates", (F.size("crates") == 1).alias("single_crate"), tasks.verify_mode(F.col("crates"), CHEAP).alias("verify_mode"))


@register("verify_routing", f"WITH {TASKS} SELECT task_id, array_to_string(crates, ',') AS crates, single_crate, verify_mode FROM tasks")
def verify_routing(spark, sf_dir):
    return order_tasks(spark, sf_dir).select("task_id", F.array_join("crates", ",").alias("crates"), "single_crate", "verify_mode")


@register(
    "census_summary",
    f"""WITH {TASKS}, c AS (SELECT count(*) AS n_tasks, count(*) FILTER (single_crate) AS single_crate, count(*) FILTER (NOT single_crate) AS multi_crate, count(*) FILTER (single_crate AND verify_mode = 'execution') AS execution_verifiable, count(*) FILTER (verify_mode = 'pattern') AS pattern_verifiable FROM tasks)
SELECT *, trunc(execution_verifiable * 0.9)::BIGINT AS estimated_total, trunc(execution_verifiable * 0.9)::BIGINT >= 150 AS passes_gate FROM c""",
)
def census_summary(spark, sf_dir):
    return tasks.census(order_tasks(spark, sf_dir), rate=0.9)


@register("crate_histogram", f"WITH {TASKS} SELECT crates[1] AS crate, count(*) AS n, min(task_id) AS first_ord FROM tasks WHERE single_crate AND verify_mode = 'execution' GROUP BY ALL")
def crate_histogram(spark, sf_dir):
    return tasks.histogram(order_tasks(spark, sf_dir))


@register("dup_ids", "SELECT l_partkey AS task_id, count(*) AS count FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    return tasks.duplicates(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("task_id")))


@register("leak_semi", "SELECT DISTINCT l_suppkey AS task_id FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def leak_semi(spark, sf_dir):
    held = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("task_id"))
    return tasks.leaked(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task_id")), held)


@register("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return tasks.fresh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@register("paired_inner", "SELECT doc_id AS task_id, n_chars > 500 AS cand, toxic = 0 AS inc FROM documents JOIN labels USING (doc_id)")
def paired_inner(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), (F.col("n_chars") > 500).alias("solved"))
    return evaluation.paired(own, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id"), (F.col("toxic") == 0).alias("solved")))


@register("preserve_union", "SELECT c_custkey AS task_id, 'real' AS origin, NULL::BIGINT AS pr FROM customer UNION ALL SELECT s_suppkey, 'synthetic', s_suppkey FROM supplier")
def preserve_union(spark, sf_dir):
    real = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.lit("real").alias("origin"))
    synthetic = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task_id"), F.lit("synthetic").alias("origin"), F.col("s_suppkey").alias("pr"))
    return real.unionByName(synthetic, allowMissingColumns=True)


@register("first_wins_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_wins_dedup(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return corpus.first_by(own, ["user_id", "event_type"], ["event_id"])


@register(
    "quality_gate",
    f"""WITH {TASKS}, t AS (SELECT *, CASE WHEN task_id % 7 = 0 THEN NULL ELSE 'p' END AS gold, task_id % 9 = 0 AS setup FROM tasks),
r AS (SELECT 'missing_fields' AS rule, 'warn' AS severity, 0 AS n UNION ALL SELECT 'leaked_ids', 'fatal', count(*) FROM t WHERE task_id IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'dead_reward', 'fatal', count(*) FROM t WHERE verify_mode = 'execution' AND NOT setup UNION ALL SELECT 'some_gold_patches_missing', 'warn', count(*) FROM t WHERE verify_mode = 'pattern' AND gold IS NULL UNION ALL SELECT 'stale_mirror', 'warn', 1)
SELECT rule, severity, n::BIGINT AS n FROM r WHERE n > 0""",
)
def quality_gate(spark, sf_dir):
    own = order_tasks(spark, sf_dir).select(F.col("task_id").cast("string").alias("task_id"), F.array(F.lit("t")).alias("test_files"), "verify_mode", F.when(F.col("task_id") % 9 == 0, "s").alias("setup_patch"), F.array().cast("array<string>").alias("fail_to_pass"), F.when(F.col("task_id") % 7 != 0, "p").alias("gold_patch"))
    return tasks.checks(own, table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("task_id")), n_mirror=-1).drop("examples")


@register(
    "quality_gate_examples",
    """
WITH t AS (SELECT CASE WHEN doc_id % 50 = 7 THEN 't7' WHEN doc_id % 90 <> 1 THEN 't' || doc_id END AS id, doc_id % 3 = 0 AS files, CASE WHEN doc_id % 2 = 0 THEN 'execution' ELSE 'pattern' END AS mode, doc_id % 8 = 0 AS setup FROM documents
), b AS (
  SELECT 'missing_fields' AS rule, 'warn' AS severity, id, 1 AS n FROM t WHERE id IS NULL OR NOT files UNION ALL SELECT 'duplicate_ids', 'fatal', id, 1 FROM t GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'leaked_ids', 'fatal', id, 1 FROM t WHERE id IN (SELECT 't' || c_custkey FROM customer) UNION ALL SELECT 'dead_reward', 'fatal', id, 1 FROM t WHERE mode = 'execution' AND NOT setup
  UNION ALL SELECT 'no_gold_patch_at_all', 'fatal', id, 1 FROM t WHERE mode = 'pattern'
), e AS (SELECT rule, string_agg(id, ',' ORDER BY id) AS examples FROM (SELECT rule, id, row_number() OVER (PARTITION BY rule ORDER BY id) AS r FROM (SELECT DISTINCT rule, id FROM b WHERE id IS NOT NULL)) WHERE r <= 3 GROUP BY rule)
SELECT rule, severity, count(*) AS n, coalesce(any_value(examples), '') AS examples FROM b LEFT JOIN e USING (rule) GROUP BY rule, severity
""",
)
def quality_gate_examples(spark, sf_dir):
    """Documents as tasks that break most rules; each names the first tasks that break it."""
    d = F.col("doc_id")
    own = table(spark, sf_dir, "documents").select(
        F.when(d % 50 == 7, "t7").when(d % 90 != 1, F.concat(F.lit("t"), d.cast("string"))).alias("task_id"), F.when(d % 3 == 0, F.array(F.lit("t"))).alias("test_files"), F.when(d % 2 == 0, "execution").otherwise("pattern").alias("verify_mode"),
        F.when(d % 8 == 0, "s").alias("setup_patch"), F.array().cast("array<string>").alias("fail_to_pass"), F.lit("").alias("gold_patch"),
    )
    found = tasks.checks(own, table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("task_id")))
    return found.withColumn("examples", F.array_join("examples", ","))


@register("mined_tasks", "SELECT 'pr-' || page_id AS task_id, 'c' || page_id % 3 AS crate, 'cargo nextest run -p c' || page_id % 3 AS verify_cmd, CASE WHEN length(html) <= 200000 THEN length(html) END AS n_patch FROM pages WHERE page_id % 2 = 0")
def mined_tasks(spark, sf_dir):
    crate = F.concat(F.lit("crates/c"), (F.col("page_id") % 3).cast("string"))
    paths = F.when(F.col("page_id") % 2 == 0, F.array(F.concat(crate, F.lit("/tests/a.rs")), F.lit("x.md"))).otherwise(F.array(F.concat(crate, F.lit("/src/a.rs"))))
    own = table(spark, sf_dir, "pages").select(F.col("page_id").alias("number"), F.col("url").alias("title"), F.col("html").alias("body"), F.lit("p").alias("parent_commit"), paths.alias("changed_files"), F.col("html").alias("gold_patch"))
    return tasks.mined_tasks(own).select("task_id", F.element_at("crates", 1).alias("crate"), "verify_cmd", F.char_length("gold_patch").cast("long").alias("n_patch"))


@register("trainer_rows", "SELECT page_id, sha256(url || chr(10) || chr(10) || 'Files to change:' || chr(10) || 'a' || chr(10) || 'b') AS prompt, 'rule' AS style FROM pages")
def trainer_rows(spark, sf_dir):
    no = F.lit(None).cast("string")
    own = table(spark, sf_dir, "pages").select(F.col("page_id").alias("task_id"), F.col("url").alias("issue_text"), F.array(F.lit("a"), F.lit("b")).alias("gold_files"), F.lit("p").alias("parent_commit"), F.array(F.lit("c")).alias("crates"), F.lit(True).alias("single_crate"), F.lit("pattern").alias("verify_mode"), F.array(F.lit("t")).alias("test_files"), F.array(F.lit("f")).alias("fail_to_pass"), no.alias("setup_patch"), no.alias("verify_cmd"), no.alias("gold_patch"))
    rows = tasks.trainer_rows(own, "system", "source")
    return rows.select(F.col("extra_info.task_id").alias("page_id"), F.sha2(F.element_at("prompt", 2)["content"], 256).alias("prompt"), F.col("reward_model.style").alias("style"))


@register("chat_messages", "SELECT conv_id, array_to_string(list(role || ':' || text ORDER BY turn), chr(10)) AS rendered, array_to_string(list((role = 'assistant')::INT ORDER BY turn), '') AS mask FROM conversations GROUP BY conv_id")
def chat_messages(spark, sf_dir):
    messages, mask = chat.to_chat(F.col("turns"))
    own = chat.dialogues(table(spark, sf_dir, "conversations")).select("conv_id", messages.alias("m"), mask.alias("k"))
    return own.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n").alias("rendered"), F.array_join(F.transform("k", lambda x: x.cast("int").cast("string")), "").alias("mask"))


@register("loss_mask_stats", "SELECT role, count(*) AS turns, count(*) FILTER (role = 'assistant') AS learnt, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY role")
def loss_mask_stats(spark, sf_dir):
    messages, mask = chat.to_chat(F.array(F.struct("role", F.col("text").alias("content"), (F.col("role") == "assistant").alias("loss"))))
    own = table(spark, sf_dir, "conversations").select(F.inline(F.arrays_zip(messages.alias("m"), mask.alias("k"))))
    return own.groupBy(F.col("m.role").alias("role")).agg(F.count("*").alias("turns"), F.count_if("k").alias("learnt"), F.sum(F.char_length("m.content")).alias("n_chars"))


@register("instruction_records", "SELECT conv_id, turn, sha256(role || chr(10) || chr(10) || 'Relevant code:' || chr(10) || '```rust' || chr(10) || text || chr(10) || '```') AS ask FROM conversations WHERE trim(text) <> '' AND conv_id % 3 > 0")
def instruction_records(spark, sf_dir):
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("problem"), F.when(F.col("conv_id") % 3 > 0, F.col("text")).otherwise(" ").alias("snippet"), F.lit("s").alias("solution"))
    turns = chat.instruction(F.col("problem"), F.col("snippet"), F.col("solution"), "system")
    return chat.complete(raw).select("conv_id", "turn", F.sha2(F.element_at(turns, 2)["content"], 256).alias("ask"))


@register("rejection_sample", "SELECT event_id, user_id FROM events WHERE coalesce(value / 100, 0) >= 1")
def rejection_sample(spark, sf_dir):
    return chat.accepted(table(spark, sf_dir, "events").withColumn("reward", F.col("value") / 100)).select("event_id", "user_id")


@register("rollout_fingerprints", "SELECT conv_id, substr(sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')), 1, 16) AS fingerprint FROM conversations GROUP BY conv_id")
def rollout_fingerprints(spark, sf_dir):
    return chat.dialogues(table(spark, sf_dir, "conversations")).select("conv_id", chat.rollout_fingerprint(F.col("turns")).alias("fingerprint"))


@register("trajectory_jobs", "SELECT s_suppkey AS task_id, sample::INT AS sample FROM supplier, range(1, 5) t(sample) WHERE NOT (sample = 1 AND s_suppkey % 2 = 0)")
def trajectory_jobs(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task_id"))
    return chat.trajectory_jobs(own, 4, own.where("task_id % 2 = 0").withColumn("sample", F.lit(1)))


@register("patch_similarity")
def patch_similarity(spark, sf_dir):
    """Likeness of each conversation's turns to its assistant turns that follow at once."""
    own = table(spark, sf_dir, "conversations")
    answer = own.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return own.join(answer, ["conv_id", "turn"]).select("conv_id", "turn", F.round(evaluation.similarity("text", "answer"), 6).alias("similarity"))


@register("sft_counts", "WITH r AS (SELECT count(*) AS n, count(*) FILTER (trim(text) <> '' AND conv_id % 3 > 0) AS kept FROM conversations), t AS (SELECT count(*) AS t, count(*) FILTER (value / 100 >= 1) AS a FROM events) SELECT kept, n - kept AS skipped, a AS accepted, t AS trajectories, round(1 - a / greatest(1, t), 9) AS rejected FROM r, t")
def sft_counts(spark, sf_dir):
    raw = table(spark, sf_dir, "conversations").select(F.col("role").alias("problem"), F.when(F.col("conv_id") % 3 > 0, F.col("text")).otherwise(" ").alias("snippet"), F.lit(None).cast("string").alias("solution"))
    chats = table(spark, sf_dir, "events").select((F.col("value") / 100).alias("reward"), F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content"))).alias("messages"), F.array(F.lit(True)).alias("loss_mask")).alias("chat"))
    return chat.sft(raw, chats, "system")[2].withColumn("rejected", F.round("rejected", 9))


@register("sft_records", "SELECT 'i' AS kind, sha256(text) AS digest, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY ALL UNION ALL SELECT 't', sha256(event_type), count(*) FROM events WHERE value / 100 >= 1 GROUP BY ALL")
def sft_records(spark, sf_dir):
    raw = table(spark, sf_dir, "conversations").select(F.col("role").alias("problem"), F.col("text").alias("snippet"), F.lit("invented").alias("solution"))
    chats = table(spark, sf_dir, "events").select((F.col("value") / 100).alias("reward"), F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content"))).alias("messages"), F.array(F.lit(True)).alias("loss_mask")).alias("chat"))
    records, trajectories, _ = chat.sft(raw, chats, "system")
    last = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.sha2(F.element_at("messages", -1)["content"], 256).alias("digest"))
    return last("i", records).unionByName(last("t", trajectories)).groupBy("kind", "digest").agg(F.count("*").alias("n"))


def turn_tokens() -> Column:
    """Words of a turn as tokens (token_id, logprob), some without one or the other."""
    return F.transform(F.split("text", " "), lambda w, i: F.struct(F.when((i + 1) % 3 > 0, F.char_length(w).cast("long")).alias("token_id"), F.when((i + 1) % 4 > 0, -F.char_length(w) / 8).alias("logprob")))


CAPTURED = "w AS (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations), t AS (SELECT *, CASE WHEN i % 3 > 0 THEN length(w) ELSE -1 END AS id, CASE WHEN i % 4 > 0 THEN -length(w) / 8 ELSE 0 END AS lp FROM w)"


@register("token_capture", f"WITH {CAPTURED} SELECT conv_id, turn, sum(id)::BIGINT AS ids, round(sum(lp), 6) AS logprobs, count(*) AS n FROM t GROUP BY ALL")
def token_capture(spark, sf_dir):
    ids, logprobs = chat.captured(turn_tokens())
    total = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", total(ids, F.lit(0).cast("long")).alias("ids"), F.round(total(logprobs, F.lit(0.0)), 6).alias("logprobs"), F.size(ids).cast("long").alias("n"))


@register("entropy_proxy", f"WITH {CAPTURED} SELECT conv_id, turn, round(-sum(lp) / count(*), 9) AS entropy FROM t GROUP BY ALL")
def entropy_proxy(spark, sf_dir):
    """Of each turn, its tokens as two lists."""
    logprobs = chat.captured(turn_tokens())[1]
    two = F.array(F.slice(logprobs, 1, 3), F.slice(logprobs, F.lit(4), F.greatest(F.size(logprobs), F.lit(1))))
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.round(stats.entropy_proxy(two), 9).alias("entropy"))


@register("steps_tokens", "SELECT conv_id, count(*) FILTER (role = 'assistant') AS steps, coalesce(sum(len(string_split(text, ' '))) FILTER (role = 'assistant'), 0)::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def steps_tokens(spark, sf_dir):
    ids = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.split(t["content"], " "))
    return chat.dialogues(table(spark, sf_dir, "conversations")).select("conv_id", chat.steps(F.col("turns")).alias("steps"), chat.n_tokens(ids).alias("tokens"))


@register("prompts", "SELECT doc_id, sha256('In ' || source || ':' || chr(10) || text) AS digest FROM documents")
def prompts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(chat.prompts(F.col("source"), F.col("text"), "In {path}:\n{snippet}"), 256).alias("digest"))


@register("teacher_shortfall", "WITH pool AS (SELECT doc_id, sha256(text) AS snippet FROM documents ORDER BY doc_id LIMIT 300), done AS (SELECT DISTINCT sha256(text) AS snippet FROM documents WHERE doc_id < 50) SELECT doc_id, snippet FROM pool WHERE snippet NOT IN (SELECT snippet FROM done) ORDER BY doc_id LIMIT 168")
def teacher_shortfall(spark, sf_dir):
    """50 of 150 are done: 100 are needed."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("snippet"))
    return chat.shortfall(own, own.where("doc_id < 50"), 150, 8).select("doc_id", "snippet")


@register("mutant_tasks", "SELECT 'mut-euclid-' || substr(sha256('euclid|src/' || page_id || '.rs|--- a/src/' || page_id || '.rs' || chr(10) || '+++ b/src/' || page_id || '.rs' || chr(10) || '@@ ' || url || chr(10)), 1, 8) AS task_id, 'src/' || page_id || '.rs' AS file, 'fn_' || page_id AS named FROM pages WHERE page_id % 2 = 0 AND page_id % 3 = 0")
def mutant_tasks(spark, sf_dir):
    """Outcomes nested in one document for each page, two outcomes each."""
    i = F.col("page_id")
    mutant = lambda package: F.struct(F.struct(F.lit(package).alias("package"), F.concat(F.lit("src/"), i.cast("string"), F.lit(".rs")).alias("file"), F.struct(F.concat(F.lit("fn_"), i.cast("string")).alias("function_name")).alias("function")).alias("Mutant"))
    outcome = lambda summary, package: F.struct(summary.alias("summary"), F.col("url").alias("diff_path"), mutant(package).alias("scenario"))
    caught = F.when(i % 2 == 0, "CaughtMutant").otherwise("MissedMutant")
    documents = table(spark, sf_dir, "pages").where(i % 3 == 0).select(F.to_json(F.struct(F.array(outcome(caught, "euclid"), outcome(F.lit("CaughtMutant"), "cards")).alias("outcomes"))).alias("j")).select(F.from_json("j", tasks.MUTANTS).alias("d")).select("d.*")
    diff = F.concat(F.lit("--- old\n+++ replace with\n@@ "), "diff_path")
    made = tasks.synthetic_tasks(tasks.mutants(documents).withColumn("diff", diff), "euclid", "sha", issue="{function} in {file}")
    return made.select("task_id", F.element_at("gold_files", 1).alias("file"), F.regexp_extract("issue_text", r"^(\S+) in ", 1).alias("named"))


@register("trivial_suite", "SELECT 'triv-' || s_suppkey AS task_id, s_nationkey FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS r, count(*) OVER () AS n FROM supplier) WHERE r <= greatest(1, n // 4)")
def trivial_suite(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task_id"), F.col("s_suppkey").alias("ord"), "s_nationkey")
    return tasks.trivial_suite(own).select("task_id", "s_nationkey")


@register("append_fresh", "SELECT c_custkey AS task_id FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def append_fresh(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"))
    return tasks.fresh(own, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task_id")), "task_id")
