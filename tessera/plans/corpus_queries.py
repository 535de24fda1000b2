"""Queries on texts: splits, rewriting, extraction, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing, rust, text
from tessera.operators import corpus, graph
from tessera.plans.registry import register

BUCKET = "list_reduce([('0x' || substr(sha256(path), i * 8 + 1, 8))::BIGINT for i in range(0, 8)], lambda a, x: (a * 4294967296 + x) % 10000, 0::BIGINT)"
FILES = f"files AS (SELECT *, {BUCKET} AS bucket FROM (SELECT doc_id, source, lang, text, source || '/' || doc_id || CASE WHEN doc_id % 3 > 0 THEN '.rs' ELSE '.md' END AS path FROM documents))"
MODE = "CASE WHEN bucket % 100 >= 15 AND suffix(path, '.rs') AND (bucket // 100) % 100 < 50 THEN CASE WHEN bucket % 2 = 0 THEN 'psm' ELSE 'spm' END END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source files: path, content, ord."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 > 0, ".rs").otherwise(".md"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"), F.col("doc_id").alias("ord"), "source")


@register(
    "heldout_split",
    f"""WITH {FILES}, s AS (SELECT text, bucket % 100 < 15 AS held_out, {MODE} AS fim_mode FROM files)
SELECT held_out, coalesce(fim_mode, 'none') AS fim_mode, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM s GROUP BY ALL""",
)
def heldout_split(spark, sf_dir):
    own = corpus.split(files(spark, sf_dir))
    return own.groupBy("held_out", F.coalesce("fim_mode", F.lit("none")).alias("fim_mode")).agg(F.count("*").alias("n"), F.sum(F.char_length("content")).alias("n_chars"))


@register("fim_assignment", f"WITH {FILES} SELECT path, bucket, bucket % 100 < 15 AS held_out, {MODE} AS fim_mode FROM files")
def fim_assignment(spark, sf_dir):
    return corpus.split(files(spark, sf_dir)).select("path", "bucket", "held_out", "fim_mode")


@register(
    "fim_samples",
    f"""WITH {FILES}, s AS (SELECT path, bucket, '// File: ' || path || chr(10) || text AS t FROM files WHERE bucket % 100 >= 15),
c AS (SELECT *, substr(t, 1, (length(t) // 3)::INT) AS a, substr(t, (length(t) // 3 + 1)::INT, (2 * length(t) // 3 - length(t) // 3)::INT) AS m, substr(t, (2 * length(t) // 3 + 1)::INT) AS z FROM s)
SELECT path, sha256(CASE WHEN ({MODE}) IS NULL THEN t WHEN bucket % 2 = 0 THEN '<|fim_prefix|>' || a || '<|fim_suffix|>' || z || '<|fim_middle|>' || m
ELSE '<|fim_suffix|>' || z || '<|fim_prefix|>' || a || '<|fim_middle|>' || m END) AS digest FROM c""",
)
def fim_samples(spark, sf_dir):
    return corpus.samples(files(spark, sf_dir)).select("path", F.sha2("training_content", 256).alias("digest"))


@register("heldout_samples", f"WITH {FILES} SELECT path, sha256('// File: ' || path || chr(10) || text) AS digest FROM files WHERE bucket % 100 < 15")
def heldout_samples(spark, sf_dir):
    return corpus.held_out_samples(files(spark, sf_dir)).select("path", F.sha2("training_content", 256).alias("digest"))


@register("fim_structured")
def fim_structured(spark, sf_dir):
    """Samples whose middle is the largest item of a source, made of the whole text as comments and two functions."""
    code = F.concat(F.lit("/*\n"), F.replace(F.replace("content", F.lit("*/"), F.lit("")), F.lit("/*"), F.lit("")), F.lit("\n*/\nfn a() {}\npub fn b() {\n    a(); // }\n}\n"))
    own = corpus.samples(files(spark, sf_dir).withColumn("content", code), structured=True)
    return own.select("path", F.sha2("training_content", 256).alias("digest"), F.substring_index("training_content", text.MIDDLE, -1).alias("tail")).select("path", "digest", F.when(F.col("tail").startswith("pub fn"), F.col("tail")).alias("middle"))


STRIPPED = r"""a AS (SELECT page_id, url, regexp_replace(html, '<!--.*?-->', '', 'gs') AS t FROM pages),
b AS (SELECT page_id, url, array_to_string(list_filter(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)), lambda x: NOT regexp_matches(x, '^\s*-\s*\[[ xX]\]')), chr(10)) AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g') AS t FROM b),
d AS (SELECT page_id, url, regexp_replace(t, '(?m)^#+\s*(Type of Change|Checklist|Motivation and Context)\s*$\n?', '', 'g') AS t FROM c),
stripped AS (SELECT page_id, url, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM d)"""


@register(
    "template_strip_pages",
    f"WITH {STRIPPED} SELECT page_id, sha256(t) AS digest FROM stripped",
)
def template_strip_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.strip_template(F.col("html")), 256).alias("digest"))


@register("closing_issue_extract", r"SELECT doc_id, nullif(regexp_extract(text || CASE doc_id % 4 WHEN 0 THEN ' Fixes #' || doc_id WHEN 1 THEN ' prefix #3 resolved  #' || doc_id || ' closes #9' WHEN 2 THEN ' fix: #4' ELSE '' END, '(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s+#(\d+)', 1), '')::BIGINT AS issue FROM documents")
def closing_issue_extract(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    tail = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" Fixes #"), d)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" prefix #3 resolved  #"), d, F.lit(" closes #9"))).when(F.col("doc_id") % 4 == 2, F.lit(" fix: #4")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", text.closing_issue(F.concat("text", tail)).alias("issue"))


GLOB_PATH = "CASE doc_id % 5 WHEN 0 THEN 'crates/' || source || '/src/' || doc_id || '.rs' WHEN 1 THEN 'README.md' WHEN 2 THEN 'docs/' || source || '/' || doc_id || '.md' WHEN 3 THEN 'crates/' || source || '/tests/' || doc_id || '.rs' ELSE 'docs/a.md' END"


def glob_path() -> Column:
    return F.expr(GLOB_PATH)


@register("glob_filter", rf"WITH p AS (SELECT doc_id, {GLOB_PATH} AS path FROM documents) SELECT doc_id, path FROM p WHERE (regexp_matches(path, '^crates/.*/.*\.rs$') OR regexp_matches(path, '^.*/README\.md$') OR regexp_matches(path, '^docs/.*/.*\.md$')) AND NOT regexp_matches(path, '^.*/tests/.*$')")
def glob_filter(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", glob_path().alias("path"))
    return own.where(text.matches(F.col("path"), ["crates/**/*.rs", "**/README.md", "docs/**/*.md"], ["**/tests/**"]))


SCOPE_PATH = "CASE doc_id % 6 WHEN 0 THEN 'crates/' || source || '/README.md' WHEN 1 THEN 'crates/' || source || '/src/a.rs' WHEN 2 THEN 'docs/crates/' || doc_id || '.md' WHEN 3 THEN 'docs/' || doc_id || '.md' WHEN 4 THEN 'x.rs' ELSE 'a/crates/b.rs' END"


@register("docs_branch", f"SELECT doc_id, path FROM (SELECT doc_id, {SCOPE_PATH} AS path FROM documents) WHERE (prefix(path, 'crates/') AND len(string_split(path, '/')) > 2 AND suffix(path, '.rs')) OR NOT contains(path, 'crates/')")
def docs_branch(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(SCOPE_PATH).alias("path")).where(text.in_scope(F.col("path")))


@register("test_file_filter", f"WITH p AS (SELECT source, {GLOB_PATH} AS path FROM documents) SELECT source, count(*) FILTER (contains(path, '/tests/') OR suffix(path, '_test.rs') OR prefix(path, 'tests/')) AS n_tests, count(*) AS n FROM p GROUP BY source")
def test_file_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(text.is_test_file(glob_path())).alias("n_tests"), F.count("*").alias("n"))


@register("crates_touched", f"WITH p AS (SELECT lang, {GLOB_PATH} AS path FROM documents), c AS (SELECT lang, list_sort(list_distinct(list_filter(list(regexp_extract(path, '^crates/([^/]+)/', 1)), lambda x: x <> ''))) AS c FROM p GROUP BY lang) SELECT lang, array_to_string(c, ',') AS crates, len(c) = 1 AS single_crate FROM c")
def crates_touched(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("lang", F.regexp_extract(glob_path(), text.CRATE, 1).alias("crate")).distinct()
    own = own.groupBy("lang").agg(F.array_sort(F.collect_set(F.nullif("crate", F.lit("")))).alias("c"))  # the packages of a language
    return own.select("lang", F.array_join("c", ",").alias("crates"), (F.size("c") == 1).alias("single_crate"))


FENCED = "CASE conv_id % 4 WHEN 0 THEN '```rust' || chr(10) || 'x' || chr(10) || '```' || chr(10) || '```diff' || chr(10) || text || chr(10) || '```' WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```' WHEN 2 THEN text || chr(10) || chr(10) ELSE CASE WHEN turn % 2 = 0 THEN '  ' ELSE text END END"


def fenced() -> Column:
    return F.expr(FENCED.replace("chr(10)", "'\\n'"))


@register(
    "patch_extract",
    rf"""WITH f AS (SELECT conv_id, turn, {FENCED} AS t FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?s)```(?:diff|patch)\n(.*?)\n```') THEN regexp_extract(t, '(?s)```(?:diff|patch)\n(.*?)\n```', 1) WHEN regexp_matches(t, '(?s)```[a-zA-Z]*\n(.*?)\n```') THEN regexp_extract(t, '(?s)```[a-zA-Z]*\n(.*?)\n```', 1) ELSE t END AS t FROM f)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '\S') THEN regexp_replace(t, '\n+$', '') || chr(10) ELSE '' END AS patch FROM b""",
)
def patch_extract(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.extract_patch(fenced()).alias("patch"))


@register("teacher_json_extract", "SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN text WHEN 1 THEN text || '!' END AS problem FROM conversations")
def teacher_json_extract(spark, sf_dir):
    """Replies that hold the whole text as a field, bare, within prose, not at all, or twice."""
    field = lambda c: F.to_json(F.struct(c.alias("problem")))
    case, said = F.col("conv_id") % 4, F.col("text")
    reply = F.when(case == 0, F.concat(F.lit("<think>a {x}</think>"), field(said))).when(case == 1, F.concat(F.lit("pre "), field(F.concat(said, F.lit("!"))), F.lit(" post"))).when(case == 2, "no").otherwise(F.concat(F.lit("a "), field(said), F.lit(" b "), field(said)))
    found = text.teacher_json(reply)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.from_json(found, "problem string")["problem"].alias("problem"))


CODE = "'use x;' || chr(10) || 'fn f' || doc_id || '(a: u8) {' || chr(10) || '  ' || text || chr(10) || '}' || chr(10) || 'fn g() {' || chr(10) || '}' || chr(10)"


@register("function_extract", rf"WITH c AS (SELECT doc_id, list_filter(regexp_extract_all({CODE}, '(?s)fn\s+\w+.*?\n\}}\n'), lambda x: length(x) >= 40) AS f FROM documents) SELECT doc_id, len(f)::INT AS n, sha256(array_to_string(f, '')) AS digest FROM c")
def function_extract(spark, sf_dir):
    code = F.expr(CODE.replace("chr(10)", "'\\n'"))
    return table(spark, sf_dir, "documents").select("doc_id", text.functions_in(code).alias("f")).select("doc_id", F.size("f").alias("n"), F.sha2(F.array_join("f", ""), 256).alias("digest"))


@register("function_extract_parsed")
def function_extract_parsed(spark, sf_dir):
    """Functions by the scanner, of sources that hold the whole text as a string."""
    quoted = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    code = F.concat(F.lit("use x;\nfn f() -> &'static str {\n  \""), quoted, F.lit("\"\n}\nfn g() {\n}\n"))
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code")).select("doc_id", F.size(rust.functions_in(F.col("code"))).alias("n"), F.sha2(F.array_join(rust.functions_in(F.col("code")), ""), 256).alias("digest"))


@register("commit_samples", "SELECT doc_id, sha256('# Commit intent' || chr(10) || source || chr(10) || chr(10) || '# Change' || chr(10) || substr(text, 1, 20000)) AS digest, greatest(1, length(text) // 4) AS n_tokens FROM documents")
def commit_samples(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.commit_sample(F.col("source"), F.col("text")), 256).alias("digest"), text.approximate_tokens(F.col("text")).alias("n_tokens"))


@register("pr_samples", f"WITH {STRIPPED} SELECT page_id, sha256('# PR #' || page_id || ': ' || url || chr(10) || chr(10) || t || chr(10) || chr(10) || '# Files changed' || chr(10) || 'a/' || page_id || chr(10) || 'b') AS digest FROM stripped WHERE length(t) >= 40")
def pr_samples(spark, sf_dir):
    paths = F.array(F.concat(F.lit("a/"), F.col("page_id").cast("string")), F.lit("b"))
    own = table(spark, sf_dir, "pages").select(F.col("page_id").alias("number"), F.col("url").alias("title"), F.col("html").alias("body"), paths.alias("changed_files"))
    return corpus.change_samples(own).select(F.col("number").alias("page_id"), F.sha2("training_content", 256).alias("digest"))


@register("template_only_filter", "SELECT page_id FROM pages WHERE page_id % 3 > 0 AND length(url) >= 28")
def template_only_filter(spark, sf_dir):
    """Descriptions that are a template and, for some, the page's address."""
    body = F.concat(F.lit("<!-- tell what\nyou did -->\n## Type of Change\n- [x] a fix\n  - [ ] more\n\n\n\n## Checklist\n"), F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("It changes: "), "url")).otherwise(""))
    own = table(spark, sf_dir, "pages").select(F.col("page_id").alias("number"), F.lit("t").alias("title"), body.alias("body"), F.array(F.lit("a")).alias("changed_files"))
    return corpus.change_samples(own).select(F.col("number").alias("page_id"))


@register("merged_filter", "SELECT page_id FROM pages WHERE page_id % 3 = 0")
def merged_filter(spark, sf_dir):
    at = F.when(F.col("page_id") % 3 == 0, "2024-01-01T00:00:00Z").when(F.col("page_id") % 3 == 1, "")
    return corpus.merged(table(spark, sf_dir, "pages").withColumn("merged_at", at)).select("page_id")


DIFF = "'--- x replaced' || chr(10) || '+++ replace it with' || chr(10) || '@@' || chr(10) || '--- ' || url || chr(10) || '+++ y' || chr(10) || ' ' || page_id"


@register("patch_headers", "SELECT page_id, '--- a/' || url || chr(10) || '+++ b/' || url || chr(10) || '@@' || chr(10) || '--- ' || url || chr(10) || '+++ y' || chr(10) || ' ' || page_id || chr(10) AS patch FROM pages")
def patch_headers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.appliable_patch(F.expr(DIFF.replace("chr(10)", "'\\n'")), F.col("url")).alias("patch"))


@register("fingerprints", "SELECT doc_id, substr(sha256(text), 1, 16) AS fingerprint, 'mut-' || lang || '-' || substr(sha256(lang || '|' || source || '|' || text), 1, 8) AS content_id FROM documents")
def fingerprints(spark, sf_dir):
    own = table(spark, sf_dir, "documents")
    parts = hashing.content_id("", F.col("lang"), F.col("source"), F.col("text"))
    one = F.concat(F.lit("mut-"), "lang", F.lit("-"), parts)
    return own.select("doc_id", hashing.fingerprint(F.col("text")).alias("fingerprint"), one.alias("content_id"))


@register("exact_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256(text)")
def exact_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("d")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("d")


@register("benchmark_containment", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_containment(spark, sf_dir):
    return corpus.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("greedy_neardup")
def greedy_neardup(spark, sf_dir):
    return corpus.near_duplicate_marks(files(spark, sf_dir))


@register("commit_decontam", f"WITH t AS (SELECT doc_id, 'src/' || (doc_id + i) || '.rs' AS path FROM documents, range(0, 6) r(i)), h AS (SELECT doc_id, {BUCKET} % 100 < 15 AS held FROM t) SELECT doc_id FROM h GROUP BY doc_id HAVING NOT bool_or(held)")
def commit_decontam(spark, sf_dir):
    """Documents as commits that touch six files each."""
    touched = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("src/"), (F.col("doc_id") + i).cast("string"), F.lit(".rs")))
    return corpus.decontaminated_commits(table(spark, sf_dir, "documents").select("doc_id", touched.alias("touched"))).select("doc_id")


@register("topo_levels", "WITH RECURSIVE l(name, lvl) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 0 UNION ALL SELECT p_partkey, lvl + 1 FROM part JOIN l ON p_partkey // 2 = name AND p_partkey > 0) SELECT name, lvl::INT AS topo_level FROM l")
def topo_levels(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"))
    return graph.topological_levels(own.where("name > 0").select("name", F.expr("name div 2").alias("dep")), own)


@register("topo_ranks", "SELECT (p_partkey + 10000000)::VARCHAR AS name, row_number() OVER (ORDER BY p_partkey) - 1 AS topo_rank FROM part")
def topo_ranks(spark, sf_dir):
    key = lambda c: (F.col(c) + 10_000_000).cast("string")
    own = table(spark, sf_dir, "part").withColumn("d", F.expr("p_partkey div 2"))
    return graph.topological_ranks(own.select(key("p_partkey").alias("name"), F.array(key("d")).alias("deps")))


WAYS = "WITH RECURSIVE l(name, lvl) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 0 UNION ALL SELECT p_partkey, lvl + 1 FROM part JOIN l ON p_partkey // 2 = name AND p_partkey > 0 AND p_partkey <> 5)"


@register("topo_cycle", f"{WAYS} SELECT p_partkey AS name, lvl::INT AS topo_level, row_number() OVER (ORDER BY lvl NULLS LAST, p_partkey) - 1 AS topo_rank FROM part LEFT JOIN l ON name = p_partkey")
def topo_cycle(spark, sf_dir):
    """Part 5 needs part 11, which needs part 5: these and all that need them come last."""
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"))
    needs = F.when(F.col("name") == 5, F.array(F.expr("name div 2"), F.lit(11).cast("long"))).otherwise(F.array(F.expr("name div 2")))
    return graph.topological_order(own.select("name", F.explode(needs).alias("dep")), own)


@register("topo_ranks_cycle", "WITH RECURSIVE b(name) AS (SELECT 5::BIGINT UNION SELECT p_partkey FROM part JOIN b ON p_partkey // 2 = name WHERE p_partkey > 0) SELECT (p_partkey + 10000000)::VARCHAR AS name, row_number() OVER (ORDER BY name IS NOT NULL, p_partkey) - 1 AS topo_rank FROM part LEFT JOIN b ON name = p_partkey")
def topo_ranks_cycle(spark, sf_dir):
    """The same graph in the order that always takes the smallest name."""
    key = lambda c: (c + 10_000_000).cast("string")
    half, p = F.expr("p_partkey div 2"), F.col("p_partkey")
    needs = F.when(p == 5, F.array(key(half), key(F.lit(11)))).otherwise(F.array(key(half)))
    return graph.topological_ranks(table(spark, sf_dir, "part").select(key(p).alias("name"), needs.alias("deps")))


@register("package_closure", "WITH RECURSIVE r(name, dep, distance) AS (SELECT p_partkey, p_partkey // 2, 1 FROM part WHERE p_partkey > 0 UNION ALL SELECT name, dep // 2, distance + 1 FROM r WHERE dep > 0) SELECT name, dep, distance::INTEGER AS distance FROM r")
def package_closure(spark, sf_dir):
    """All parts that a part needs, however far."""
    own = table(spark, sf_dir, "part").where("p_partkey > 0")
    return graph.reachable(own.select(F.col("p_partkey").alias("name"), F.expr("p_partkey div 2").alias("dep")))
