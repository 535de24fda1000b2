"""Tasks from change records, and the checks that a task pool must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import hashing, text

LONGEST_PATCH = 200_000


def verify_mode(crates: Column, cheap: tuple[str, ...]) -> Column:
    """'execution' if there are packages and all of them are among the cheap ones, whose tests run without services; else 'pattern'."""
    return F.when((F.size(crates) > 0) & (F.size(F.array_except(crates, F.array(*[F.lit(c) for c in cheap]))) == 0), "execution").otherwise("pattern")


def test_files(paths: Column) -> Column:
    return F.filter(paths, text.is_test_file)


def mined_tasks(changes: DataFrame, prefix: str = "pr-") -> DataFrame:
    """Tasks of merged changes (number, title, body, parent_commit, changed_files, gold_patch) that have test files; all verify by pattern."""
    own = changes.withColumn("test_files", test_files(F.col("changed_files"))).where(F.size("test_files") > 0)
    own = own.withColumn("crates", text.crates_touched(F.col("changed_files"))).withColumn("single_crate", F.size("crates") == 1)
    patch = F.when((F.char_length("gold_patch") > 0) & (F.char_length("gold_patch") <= LONGEST_PATCH), F.col("gold_patch"))
    command = F.when(F.col("single_crate"), F.concat(F.lit("cargo nextest run -p "), F.element_at("crates", 1))).otherwise("cargo nextest run")
    return own.select(
        F.concat(F.lit(prefix), F.col("number").cast("string")).alias("task_id"), F.col("number").alias("pr_number"), "parent_commit",
        F.concat("title", F.lit("\n\n"), text.strip_template(F.col("body"))).alias("issue_text"), F.col("changed_files").alias("gold_files"), "test_files", "crates", "single_crate",
        command.alias("verify_cmd"), F.lit("pattern").alias("verify_mode"), F.lit(None).cast("string").alias("setup_patch"), patch.alias("gold_patch"), F.array().cast("array<string>").alias("fail_to_pass"),
    )


#: What a task of an injected fault asks for.
ISSUE = "Since a recent change to `{function}` in {file}, tests of the package `{crate}` fail. Find the fault and repair it, so that `cargo test -p {crate}` succeeds; leave the tests as they are."
MUTANTS = "outcomes array<struct<summary:string,diff_path:string,scenario:struct<Mutant:struct<package:string,file:string,function:struct<function_name:string>>>>>"


def mutants(documents: DataFrame) -> DataFrame:
    """summary, package, file, function_name, diff_path of mutation runs' outcomes (schema MUTANTS), one row for each outcome with a mutant."""
    one = documents.select(F.explode("outcomes").alias("o")).where("o.scenario.Mutant IS NOT NULL")
    return one.select("o.summary", "o.scenario.Mutant.package", "o.scenario.Mutant.file", F.col("o.scenario.Mutant.function.function_name").alias("function_name"), "o.diff_path")


def synthetic_tasks(outcomes: DataFrame, crate: str, parent: str, prefix: str = "mut-", issue: str = ISSUE) -> DataFrame:
    """Tasks of caught mutants (summary, package, file, function_name, diff) of one package; ids come from the content.

    issue is a template with {function}, {file} and {crate}. An empty parent is an error: such tasks could never be scored.
    """
    if not parent:
        raise ValueError("tasks need a parent commit")
    own = outcomes.where((F.col("summary") == "CaughtMutant") & (F.col("package") == crate)).withColumn("patch", text.appliable_patch(F.col("diff"), F.col("file")))
    name = F.coalesce("function_name", F.lit("?"))
    asked = F.replace(F.replace(F.lit(issue.replace("{crate}", crate)), F.lit("{function}"), name), F.lit("{file}"), F.col("file"))
    return own.select(hashing.content_id(f"{prefix}{crate}-", F.lit(crate), F.col("file"), F.col("patch")).alias("task_id"), F.lit(0).cast("long").alias("pr_number"), F.lit(parent).alias("parent_commit"), asked.alias("issue_text"), F.array("file").alias("gold_files"), F.array(F.lit(f"crates/{crate}/ (cargo test -p {crate})")).alias("test_files"), F.array(F.lit(crate)).alias("crates"), F.lit(True).alias("single_crate"), F.lit(f"cargo test -p {crate}").alias("verify_cmd"), F.lit("execution").alias("verify_mode"), F.col("patch").alias("setup_patch"), F.lit(None).cast("string").alias("gold_patch"), F.array().cast("array<string>").alias("fail_to_pass"))


def trivial_suite(tasks: DataFrame, fraction: float = 0.25, order: str = "ord", prefix: str = "triv-") -> DataFrame:
    """The first share of tasks (task_id, ord, ...), at least one, under ids of their own."""
    n = tasks.count()
    return tasks.orderBy(order).limit(max(1, int(n * fraction)) if n else 0).withColumn("task_id", F.concat(F.lit(prefix), F.col("task_id").cast("string")))


def duplicates(tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """key, count of ids that occur more than once."""
    return tasks.groupBy(key).count().where("count > 1")


def leaked(tasks: DataFrame, held: DataFrame, key: str = "task_id") -> DataFrame:
    """Ids of tasks that are also in held."""
    return tasks.select(key).distinct().join(held.select(key).distinct(), key, "left_semi")


def fresh(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet: append and resume."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def trainer_rows(tasks: DataFrame, system: str, data_source: str) -> DataFrame:
    """Nested rows for a reinforcement-learning trainer."""
    ask = F.concat("issue_text", F.lit("\n\nFiles to change:\n"), F.array_join("gold_files", "\n"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    extra = ["task_id", "parent_commit", "crates", "single_crate", "verify_mode", "test_files", "fail_to_pass", "setup_patch", "verify_cmd", "gold_patch"]
    return tasks.select(F.lit(data_source).alias("data_source"), F.array(message("system", F.lit(system)), message("user", ask)).alias("prompt"), F.struct(F.lit("rule").alias("style"), F.lit("").alias("ground_truth")).alias("reward_model"), F.struct(*extra).alias("extra_info"))


def census(tasks: DataFrame, rate: float = 1.0, least: int = 150) -> DataFrame:
    """One row: counts of tasks (crates, single_crate, verify_mode), how many likely verify, and whether that is enough."""
    execution = F.col("single_crate") & (F.col("verify_mode") == "execution")
    out = tasks.agg(F.count("*").alias("n_tasks"), F.count_if("single_crate").alias("single_crate"), F.count_if(~F.col("single_crate")).alias("multi_crate"), F.count_if(execution).alias("execution_verifiable"), F.count_if(F.col("verify_mode") == "pattern").alias("pattern_verifiable"))
    return out.withColumn("estimated_total", (F.col("execution_verifiable") * F.lit(rate)).cast("long")).withColumn("passes_gate", F.col("estimated_total") >= least)


def histogram(tasks: DataFrame) -> DataFrame:
    """crate, n, first_ord of single-package execution tasks (with ord), the largest first, then the first seen."""
    own = tasks.where("single_crate AND verify_mode = 'execution'")
    return own.groupBy(F.element_at("crates", 1).alias("crate")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")).orderBy(F.col("n").desc(), "first_ord")


def checks(tasks: DataFrame, held: DataFrame, n_mirror: int | None = None, shown: int = 3) -> DataFrame:
    """rule, severity, n and examples (the first ids in order, `shown` at most) of every rule that tasks break. held has the task_ids of evaluation sets.

    A task without an id is counted and has no example. The examples come from one pass that gives each broken rule a row for each task, of which tasks of the job keep the
    smallest ids.
    """
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    none = lambda c: F.coalesce(F.size(c) == 0, F.lit(True))
    pattern = F.coalesce(F.col("verify_mode") == "pattern", F.lit(False))
    broken = {
        "missing_fields": blank("task_id") | none("test_files"), "dead_reward": F.coalesce(F.col("verify_mode") == "execution", F.lit(False)) & blank("setup_patch") & none("fail_to_pass"),
        "no_gold": pattern & blank("gold_patch"), "pattern": pattern, "any": F.lit(True),
    }
    one = tasks.select(F.col("task_id").cast("string").alias("id"), F.explode(F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in broken.items()]), lambda r: r.isNotNull())).alias("rule"))
    one = one.withColumn("n", F.lit(1).cast("long")).union(duplicates(tasks).select(F.col("task_id").cast("string"), F.lit("duplicate_ids"), F.lit(1).cast("long"))).union(leaked(tasks, held).select(F.col("task_id").cast("string"), F.lit("leaked_ids"), F.lit(1).cast("long")))
    first = F.row_number().over(Window.partitionBy("rule").orderBy(F.col("id").asc_nulls_last()))
    counts = one.groupBy("rule").agg(F.sum("n").alias("n"))
    ids = one.where("id IS NOT NULL AND rule NOT IN ('any', 'pattern')").distinct().withColumn("r_", first).where(F.col("r_") <= shown).groupBy("rule").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    found = counts.join(ids, "rule", "left")
    total = lambda rule: F.coalesce(F.max(F.when(F.col("rule") == rule, F.col("n"))), F.lit(0))
    sums = found.agg(total("any").alias("all"), total("pattern").alias("patterns"), total("no_gold").alias("no_golds"))  # one row
    marked = found.where("rule NOT IN ('any', 'pattern')").join(F.broadcast(sums), F.lit(True), "right")
    every = (F.col("patterns") > 0) & (F.col("no_golds") == F.col("patterns"))
    named = F.when(F.col("rule") != "no_gold", F.col("rule")).when(every, "no_gold_patch_at_all").otherwise("some_gold_patches_missing")
    severity = F.when(named.isin("missing_fields", "some_gold_patches_missing"), "warn").otherwise("fatal")
    nothing = F.array().cast("array<string>")
    rows = marked.where("rule IS NOT NULL").select(named.alias("rule"), severity.alias("severity"), "n", F.coalesce("examples", nothing).alias("examples"))
    stale = F.lit(n_mirror).isNotNull() & (F.col("all") != F.lit(n_mirror))
    whole = [F.when(F.col("all") == 0, F.struct(F.lit("no_tasks").alias("rule"))), F.when(stale, F.struct(F.lit("stale_mirror").alias("rule")))]
    more = sums.select(F.inline(F.filter(F.array(*whole), lambda x: x.isNotNull()))).select("rule", F.lit("warn").alias("severity"), F.lit(1).cast("long").alias("n"), nothing.alias("examples"))
    return rows.union(more)
