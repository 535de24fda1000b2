"""Operators against plain Python on small tables, empty ones included."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import chat, corpus, evaluation, graph, scan, selection, tasks


def greedy(rows):
    """Order-dependent near-duplicate removal over given edges."""
    nodes, edges = rows
    kept = []
    for n in sorted(nodes):
        if not any((k, n) in edges for k in kept):
            kept.append(n)
    return kept


def test_topological_order(spark):
    assert graph.smallest_first({"common_utils": set(), "diesel_models": {"common_utils"}, "router": {"common_utils", "diesel_models"}}) == ["common_utils", "diesel_models", "router"]
    assert graph.smallest_first({"a": set(), "b": {"a"}, "c": set()}) == ["a", "b", "c"]
    assert graph.smallest_first({"a": {"b"}, "b": {"a"}, "c": {"a"}, "d": set()}) == ["d", "a", "b", "c"]
    assert graph.smallest_first({}) == []
    frame = spark.createDataFrame([("b", ["a", "zz"]), ("a", None), ("c", [])], "name string, deps array<string>")
    assert [r.name for r in graph.topological_ranks(frame).orderBy("topo_rank").collect()] == ["a", "b", "c"]


def packages(seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in rng.sample(range(200), rng.randint(1, 50))]
    deps = {n: {d for d in rng.sample(names, min(len(names), rng.choice([0, 1, 1, 2]))) if n >= d or rng.random() < 0.1} for n in names}
    return deps


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_orders_of_graphs_with_cycles(spark, seed):
    deps = packages(seed)
    frame = spark.createDataFrame([(n, [*sorted(d), "zz"]) for n, d in deps.items()], "name string, deps array<string>").repartition(3)
    assert [r.name for r in graph.topological_ranks(frame).orderBy("topo_rank").collect()] == graph.smallest_first(deps)
    levels: dict = {}
    for n in graph.popped(deps):
        levels[n] = max([levels[d] + 1 for d in deps[n] if d != n], default=0)
    edges, nodes = frame.select("name", F.explode("deps").alias("dep")), frame.select("name")
    assert {r.name: r.topo_level for r in graph.topological_levels(edges, nodes).collect()} == {n: levels.get(n) for n in deps}
    order = [r.name for r in graph.topological_order(edges, nodes).orderBy("topo_rank").collect()]
    assert order == sorted(levels, key=lambda n: (levels[n], n)) + sorted(set(deps) - set(levels))


def test_orders_of_nothing_and_of_a_component_that_is_too_large(spark):
    none = spark.createDataFrame([], "name string, deps array<string>")
    assert graph.topological_ranks(none).collect() == [] == graph.topological_levels(none.selectExpr("name", "name AS dep"), none.select("name")).collect()
    chain = spark.createDataFrame([(f"n{i:03}", [f"n{i - 1:03}"]) for i in range(30)], "name string, deps array<string>")
    with pytest.raises(Exception, match="topological_levels"):
        graph.topological_ranks(chain, most=20).collect()


@pytest.mark.parametrize(("seed", "in_one"), [(1, 1), (2, 3), (3, 1), (5, 8), (8, 2)])
def test_order_of_components_beyond_a_task(spark, seed, in_one):
    deps = packages(seed)
    frame = spark.createDataFrame([(n, [*sorted(d), "zz"]) for n, d in deps.items()], "name string, deps array<string>").repartition(3)
    assert [(r.name, r.topo_rank) for r in graph.topological_ranks(frame, in_one=in_one).orderBy("topo_rank").collect()] == [(n, i) for i, n in enumerate(graph.smallest_first(deps))]


@pytest.mark.parametrize("in_one", [1000, 4])
def test_orders_do_not_depend_on_the_numbers_of_names(spark, monkeypatch, in_one):
    deps = packages(5) | {"z1": {"z2"}, "z2": {"z1"}, "z3": {"z1"}, "a1": set()}
    frame = spark.createDataFrame([(n, sorted(d)) for n, d in deps.items()], "name string, deps array<string>").repartition(3)
    kinds = []
    own = graph.components
    monkeypatch.setattr(graph, "components", lambda edges, *more: kinds.append(edges.dtypes) or own(edges, *more))
    for label in (graph._label, lambda name: F.length(name).cast("long"), lambda name: F.lit(7).cast("long")):  # few numbers, and one for all
        monkeypatch.setattr(graph, "_label", label)
        assert [r.name for r in graph.topological_ranks(frame, in_one=in_one).orderBy("topo_rank").collect()] == graph.smallest_first(deps)
    assert kinds == 3 * [[("a", "bigint"), ("b", "bigint")]]  # not names


def test_order_of_a_graph_without_cycles_beyond_a_task(spark):
    rng = random.Random(9)
    names = [f"n{i:02}" for i in range(40)]
    rng.shuffle(names)
    deps = {n: set(rng.sample(names[:i], min(i, rng.choice([0, 1, 1, 2, 3])))) for i, n in enumerate(names)}  # names that rise and fall along the edges
    frame = spark.createDataFrame([(n, sorted(d)) for n, d in deps.items()], "name string, deps array<string>").repartition(3)
    assert [r.name for r in graph.topological_ranks(frame, in_one=6).orderBy("topo_rank").collect()] == graph.smallest_first(deps)


@pytest.mark.parametrize("in_one", [graph.IN_ONE, 0])
def test_components(spark, in_one):
    rng = random.Random(4)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(40)] + [(200 + i, 201 + i) for i in range(20)] + [(300, 300), (7, 7)]
    root: dict = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    found = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4), in_one=in_one)
    assert {r.node: r.component for r in found.collect()} == {x: top(x) for x in root} and found.count() == len(root)
    assert graph.components(spark.createDataFrame([], "a long, b long"), in_one=in_one).collect() == []


def test_reachable_packages(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "c"), (None, "a")], "name string, dep string")
    found = {(r.name, r.dep): r.distance for r in graph.reachable(edges).collect()}
    ring = {(x, y): (j - i - 1) % 3 + 1 for i, x in enumerate("abc") for j, y in enumerate("abc")}
    assert found == {**ring, ("d", "a"): 1, ("d", "b"): 2, ("d", "c"): 1}
    chain = spark.createDataFrame([(i, i + 1) for i in range(10)], "name long, dep long")
    assert graph.reachable(chain).count() == 55
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        graph.reachable(chain, most=4).collect()


def test_reachable_packages_over_very_many_ways(spark):
    pairs = [(i, x, y) for i in range(24) for x in "ab" for y in "ab"]  # 2^24 ways from one end to the other
    edges = spark.createDataFrame([(f"{x}{i}", f"{y}{i + 1}") for i, x, y in pairs], "name string, dep string")
    found = graph.reachable(edges)
    assert {(r.name, r.dep): r.distance for r in found.collect()} == {(f"{x}{i}", f"{y}{j}"): j - i for i in range(25) for j in range(i + 1, 25) for x in "ab" for y in "ab"}
    assert found.dtypes == [("name", "string"), ("dep", "string"), ("distance", "int")]
    assert graph.reachable(edges, most=24).count() == found.count() and graph.reachable(edges.limit(0)).collect() == []
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        graph.reachable(edges, most=23).collect()


@pytest.mark.parametrize("run", [None, "run"])
def test_values_since_the_last_event(spark, run):
    rng = random.Random(6)
    rows = [(i, rng.choice([False] * 9 + [True, None]), rng.choice([0, 0, 0, 1, 2])) for i in range(400)]
    state: dict = {}
    expected = {}
    for cycle, promoted, own in rows:
        so_far, since = state.get(own if run else 0, (0, 0))
        state[own if run else 0] = expected[cycle] = (so_far + bool(promoted), 0 if promoted else since + 1)
    frame = spark.createDataFrame(rows, "cycle long, promoted boolean, run long").repartition(7)
    found = scan.since_last(frame, F.col("promoted"), "cycle", run)
    assert {r.cycle: (r.so_far, r.since) for r in found.collect()} == expected and found.columns == ["cycle", "promoted", "run", "so_far", "since"]
    assert scan.since_last(frame.limit(0), F.col("promoted"), "cycle", run).collect() == []


def test_no_task_sorts_or_numbers_a_whole_table(spark):
    frame = spark.createDataFrame([(i, i, i / 7, i % 3 == 0) for i in range(50)], "cycle long, ord long, solve_rate double, promoted boolean")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(selection.keepers(frame, 5)) and "TakeOrderedAndProject" in plan(selection.keepers(frame, 5))
    assert "SinglePartition" not in plan(selection.plateau(frame.select("cycle", "promoted"), 3))
    assert "Window" not in plan(selection.capped_batch(frame.withColumn("is_capped", F.col("promoted")), 10))


@pytest.mark.parametrize(("n", "giant"), [(5000, corpus.GIANT), (40, 3)])
def test_long_chains_of_near_duplicates(spark, monkeypatch, n, giant):
    """Each row shares a band with the next one, so every other row stays: in a few written tables, or by rounds if the component is too large."""
    import pandas as pd

    tables = []
    for module in (corpus, graph):
        monkeypatch.setattr(module, "written", lambda df, path, write=module.written: tables.append(path) or write(df, path))
    monkeypatch.setattr(corpus, "_bands", lambda stride: lambda batches: (pd.DataFrame({"ord": b["ord"], "bands": [[o // 2, -1 - (o + 1) // 2] for o in b["ord"]]}) for b in batches))
    found = corpus.near_duplicate_marks(spark.createDataFrame([(i, f"t{i}") for i in range(n)], "ord long, content string"), giant=giant)
    assert sorted(r.ord for r in found.where("keep").collect()) == list(range(0, n, 2))
    assert len(tables) < 10 or giant == 3


def test_rounds_that_do_not_end_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(corpus, "MOST_ROUNDS", 1)
    live = spark.createDataFrame([(i, b, v) for i in range(9) for b, v in ((0, i // 2), (1, -1 - (i + 1) // 2))], "ord long, band int, value long")
    with pytest.raises(RuntimeError, match="undecided"):
        corpus._by_rounds(live, corpus.work_folder(spark, "greedy"))


def test_near_duplicate_marks(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    rows = [(5, base), (3, base), (9, base[:1900] + "x" * 100), (4, other), (1, ""), (2, None), (8, "abc")]
    got = {r.ord: r.keep for r in corpus.near_duplicate_marks(spark.createDataFrame(rows, "ord long, content string")).collect()}
    assert got == {5: False, 3: True, 9: False, 4: True, 1: True, 2: False, 8: True}
    assert corpus.near_duplicate_marks(spark.createDataFrame([], "ord long, content string")).collect() == []


def test_near_duplicate_chains_are_greedy(spark, monkeypatch):
    import pandas as pd

    rng = random.Random(8)
    for edges in ({(i, i + 1) for i in range(9)}, {tuple(sorted(rng.sample(range(14), 2))) for _ in range(18)}):
        band = {e: i + 1 for i, e in enumerate(sorted(edges))}

        def bands(stride, band=band):
            def run(batches):
                for batch in batches:
                    yield pd.DataFrame({"ord": batch["ord"], "bands": [[band[e] if o in e else -1 - 1000 * o - i for i, e in enumerate(sorted(band))] for o in batch["ord"]]})

            return run

        monkeypatch.setattr(corpus, "_bands", bands)
        n = max(max(e) for e in edges) + 1
        got = corpus.near_duplicate_marks(spark.createDataFrame([(i, f"t{i}") for i in range(n)], "ord long, content string"))
        assert sorted(r.ord for r in got.where("keep").collect()) == greedy((range(n), edges))


@pytest.mark.parametrize(("length", "n"), [(0, 1), (5, 1), (6, 1), (10, 1), (11, 2), (15, 2), (16, 3), (100, 19)])
def test_shingle_counts(length, n):
    assert len(corpus.shingles("x" * length)) == n


def test_containment(spark):
    docs = spark.createDataFrame([(1, "aa one two three four five six seven eight nine ten eleven zz"), (2, "short bit here"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven"), (8, "bit"), (9, "absent words")], "item_id long, text string")
    assert sorted(map(tuple, corpus.contained(docs, items).collect())) == [(1, 7), (2, 8)]


def test_containment_of_short_items(spark):
    """Items of any length, also within words, against a search of every text."""
    rng = random.Random(4)
    words = ["ab", "cd", "abc", "d", "é"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None), (61, ""), (3, "ab cd"), (None, "x ab cd abc d y")]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 3, 3, 4, 5, 6, 7, 9, 10, 11, 14])] + [(90, None), (91, docs[5][1]), (92, docs[6][1][1:-1])]
    got = corpus.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i) for d, t in docs for i, x in items if t is not None and x is not None and x in t}
    assert {tuple(r) for r in got.collect()} == want
    assert corpus.contained(spark.createDataFrame(docs, "doc_id long, text string").limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_samples(spark):
    files = spark.createDataFrame([(f"src/{i}.rs", "fn a() {}\nfn longer_one() { a() }\n") for i in range(60)] + [(f"d/{i}.md", "fn text") for i in range(60)], "path string, content string")
    both = corpus.split(files).collect()
    assert {r.fim_mode for r in both if r.path.endswith(".md")} == {None} and {r.fim_mode for r in both} == {None, "psm", "spm"}
    held = {r.path for r in both if r.held_out}
    assert {r.path for r in corpus.held_out_samples(files).collect()} == held and held
    rows = {r.path: r.training_content for r in corpus.samples(files, structured=True).collect()}
    assert set(rows) == {r.path for r in both} - held
    modes = {r.path: r.fim_mode for r in both}
    for path, sample in rows.items():
        if modes[path]:
            assert sample.endswith("<|fim_middle|>fn longer_one() { a() }") and "fn a() {}" in sample
        else:
            assert "fim" not in sample and sample.startswith(f"// File: {path}\n")
    commits = spark.createDataFrame([(1, list(held)[:1] + ["x"]), (2, ["d/none"]), (3, []), (4, None)], "id long, touched array<string>")
    assert 1 not in {r.id for r in corpus.decontaminated_commits(commits).collect()}


def test_changes(spark):
    rows = [(1, "t", "<!-- x -->\n- [x] done\n## Checklist\nshort", ["a"], "2024"), (2, "t", "a description that is long enough to count as one", ["a", "b"], ""), (3, "t", None, [], None)]
    changes = spark.createDataFrame(rows, "number long, title string, body string, changed_files array<string>, merged_at string")
    assert [r.number for r in corpus.merged(changes).collect()] == [1]
    only = corpus.change_samples(changes).collect()
    assert [(r.number, r.training_content.split("\n")[0], r.training_content.split("\n")[-1]) for r in only] == [(2, "# PR #2: t", "b")]


def test_ranked_and_systematic(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(5)
    got = [r.rank_ for r in selection.ranked(rows, "x").orderBy("x").collect()]
    assert got == list(range(1000))
    assert selection.ranked(rows.limit(0), "x").collect() == []
    assert [r.x for r in selection.systematic(rows, 10, "x").orderBy("x").collect()] == sorted(r.x for r in rows.collect())[::100]
    assert [r.x for r in selection.head(rows, 3, "x").collect()] == sorted(r.x for r in rows.collect())[:3]
    assert sorted(r.x for r in selection.seeded(rows, 5, "x", 1).collect()) != sorted(r.x for r in selection.seeded(rows, 5, "x", 2).collect())
    assert selection.seeded(rows, 5, "x", 1).collect() == selection.seeded(rows.repartition(2), 5, "x", 1).collect()


def test_promotion_and_curve(spark):
    old = spark.createDataFrame([(1, True)], "cycle long, promoted boolean")
    new, gate = spark.createDataFrame([(2, None)], "cycle long, promoted boolean"), spark.createDataFrame([(False,)], "promote boolean")
    assert sorted(map(tuple, selection.promote(old, new, gate).collect())) == [(1, True), (2, False)]
    assert sorted(map(tuple, selection.promote(old.limit(0), new, None).collect())) == [(2, True)]
    curve = spark.createDataFrame([(1, "a", "m", 3.0, "f"), (2, "base", "m", 2.0, None), (3, "base", "m", 9.0, "g")], "ord long, tag string, model string, perplexity double, weights_fp string")
    assert {r.ord: r.delta_pct for r in evaluation.against_base(curve).collect()} == {1: 50.0, 2: None, 3: None}
    assert [r.delta_pct for r in evaluation.against_base(curve.where("tag = 'a'")).collect()] == [None]
    wanted = spark.createDataFrame([("a", "m", "f"), ("a", "m", "other"), ("base", "m", "any"), ("base", "n", "any")], "tag string, model string, weights_fp string")
    assert sorted(map(tuple, evaluation.pending(wanted, curve).collect())) == [("a", "m", "other"), ("base", "n", "any")]


def texts_to_compare(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(["ab", "abcd", "abcdefgh é中", "".join(map(chr, range(33, 160))), "".join(map(chr, range(33, 600)))])
        size = rng.choice([0, 1, 5, 30, 100, 199, 200, 201, 300, 600])
        some = lambda k: "".join(rng.choices(letters, k=rng.randint(0, k)))  # noqa: E731, B023
        a = some(size)
        b = a if rng.random() < 0.6 else some(size)
        for _ in range(rng.randint(0, 9)):
            at, to = sorted((rng.randint(0, len(b)), rng.randint(0, len(b))))
            b = rng.choice([b[:at] + some(20) + b[at:], b[:at] + b[at + 9 :], b[to:] + b[at:to]])[:1000]
        yield a, b


def test_matching_blocks_as_in_the_standard_library(monkeypatch):
    import difflib

    from tessera.functions import matching

    for small in (matching.SMALL, 0):
        monkeypatch.setattr(matching, "SMALL", small)
        for a, b in texts_to_compare(small + 1, 5000):
            assert matching.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)


def test_long_texts_are_matched_in_little_time():
    import time

    from tessera.functions import matching

    rng = random.Random(9)
    for letters in (range(33, 126), range(33, 2000)):
        a = "".join(map(chr, rng.choices(letters, k=100_000)))
        b = a[:30_000] + "new" + a[30_010:70_000] + a[80_000:] + a[70_000:80_000]
        began = time.perf_counter()
        assert 0.3 < matching.ratio(a, b) <= 1
        assert time.perf_counter() - began < 5  # a fraction of a second on a free machine


def test_similarity(spark):
    import difflib

    pairs = [("abc", "abd"), ("abc", "abc"), ("abc", ""), (None, "x"), ("x", None), ("abc", "abd")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").coalesce(1)
    evaluation.register(spark)
    rows.createOrReplaceTempView("pairs_of_texts")
    want = [difflib.SequenceMatcher(None, a or "", b).ratio() if b else 0.0 for a, b in pairs]
    assert [r.s for r in rows.orderBy("i").select(evaluation.similarity("a", "b").alias("s")).collect()] == want
    assert [r.s for r in spark.sql("SELECT patch_similarity(a, b) AS s FROM pairs_of_texts ORDER BY i").collect()] == want
    assert [r.r.total for r in rows.orderBy("i").select(evaluation.execution_free_reward(F.col("a"), F.col("b")).alias("r")).collect()] == want


def test_teacher_shortfall(spark):
    pool = spark.createDataFrame([(i, f"s{i}") for i in range(100)], "ord long, snippet string")
    done = spark.createDataFrame([(f"s{i}",) for i in range(5)], "snippet string")
    assert [r.ord for r in chat.shortfall(pool, done, 10, 2).collect()] == list(range(5, 15))
    assert chat.shortfall(pool, done, 5, 2).collect() == []


def test_verify_mode(spark):
    cases = {"euclid": "execution", "common_utils,euclid": "execution", "connectors": "pattern", "euclid,connectors": "pattern", "": "pattern"}
    rows = spark.createDataFrame([(k,) for k in cases], "k string").select("k", tasks.verify_mode(F.filter(F.split("k", ","), lambda x: x != ""), ("euclid", "common_utils")).alias("m")).collect()
    assert {r.k: r.m for r in rows} == cases


def test_synthetic_ids_resume(spark):
    rows = spark.createDataFrame([("CaughtMutant", "c", "a.rs", "f", "--- x\n+++ y\n"), ("Missed", "c", "a.rs", "f", ""), ("CaughtMutant", "d", "a.rs", None, "")], "summary string, package string, file string, function_name string, diff string")
    first = tasks.synthetic_tasks(rows, "c", "sha")
    assert "`f` in a.rs" in first.first()["issue_text"] and "package `c`" in first.first()["issue_text"]
    with pytest.raises(ValueError, match="parent"):
        tasks.synthetic_tasks(rows, "c", "")
    assert first.count() == 1 and first.first()["task_id"].startswith("mut-c-")
    assert tasks.fresh(tasks.synthetic_tasks(rows, "c", "sha"), first, "task_id").isEmpty()


def test_checks(spark):
    kind = "task_id string, test_files array<string>, verify_mode string, setup_patch string, fail_to_pass array<string>, gold_patch string"
    rows = [("a", ["t"], "execution", None, [], None), ("a", ["t"], "execution", "s", [], None), ("b", [], "pattern", None, None, None), (None, ["t"], "pattern", None, None, "")]
    held = spark.createDataFrame([("a",), ("q",)], "task_id string")
    got = {r.rule: (r.severity, r.n) for r in tasks.checks(spark.createDataFrame(rows, kind), held).collect()}
    assert got == {"missing_fields": ("warn", 2), "duplicate_ids": ("fatal", 1), "leaked_ids": ("fatal", 1), "dead_reward": ("fatal", 1), "no_gold_patch_at_all": ("fatal", 2)}
    assert [r.rule for r in tasks.checks(spark.createDataFrame([], kind), held).collect()] == ["no_tasks"]


def rewards(spark, **k):
    lit = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)
    return spark.range(1).select(evaluation.execution_reward(*[lit(k[n]) for n in ("tampered", "fmt", "clippy", "compiles", "expected", "passed", "failed")]).alias("r")).first()["r"]


def test_rewards(spark):
    good = {"tampered": False, "fmt": True, "clippy": True, "compiles": True, "expected": ["a", "b"], "passed": ["b", "a", "c"], "failed": []}
    assert rewards(spark, **good)["total"] == pytest.approx(1.45)
    assert rewards(spark, **good | {"tampered": True})["total"] == 0
    assert rewards(spark, **good | {"clippy": False, "expected": []})["total"] == pytest.approx(0.125)
    assert rewards(spark, **good | {"failed": ["z"]})["tests"] == 0
    yes, no = F.lit(True), F.lit(False)
    assert spark.range(1).select(evaluation.pattern_reward(no, yes, yes, yes, F.lit(0.8)).alias("x")).first()["x"] == pytest.approx(1.19)
    assert spark.range(1).select(evaluation.pattern_reward(yes, yes, yes, yes, F.lit(0.8)).alias("x")).first()["x"] == 0


def test_gate(spark):
    frame = lambda ids: spark.createDataFrame([(i, i in ids) for i in range(40)], "task_id long, solved boolean")
    row = evaluation.gate(frame(range(20)), frame([])).first()
    assert (row.n, row.b, row.c, row.promote) == (40, 20, 0, True) and row.p_value == pytest.approx(1.9073486e-06)
    none = evaluation.gate(frame([]), frame([]).where("task_id > 99")).first()
    assert (none.n, none.p_value, none.promote) == (0, 1.0, False)


def test_health(spark):
    rows = [("A", 1.0, 1.0)] * 4 + [("B", 0.0, 0.0)] * 4
    frame = spark.createDataFrame([(t, r, x, 0.0, 0.0, 1.0, 2.0) for t, r, x in rows], "task_id string, reward double, tests double, dense double, compile double, fmt_clippy double, entropy double")
    row = evaluation.health(frame).first()
    assert (row.n_groups, row.degenerate_group_rate, row.r_fmt_clippy, row.solve_rate) == (2, 1.0, 1.0, 0.5)
    bad = evaluation.alerts(evaluation.health(frame.where("task_id = 'B'")), F.lit(5.0)).first()
    assert bad.alerts == ["degenerate_groups", "entropy_collapse", "reward_hack"]
    empty = evaluation.health(frame.limit(0)).first()
    assert (empty.n_rollouts, empty.mean_reward) == (0, 0.0)


def outcomes(spark, by):
    return spark.createDataFrame([(t, i, s) for t, own in by.items() for i, s in enumerate(own)], "task_id string, ord long, solved boolean")


def test_curriculum(spark):
    by = {"hard": [False] * 10, "easy": [True] * 10, "mid": [True, False] * 5, "late": [False] * 5 + [True] * 10}
    rates = selection.recent_rates(outcomes(spark, by)).withColumn("c", selection.classify(F.col("solve_rate")))
    assert {r.task_id: r.c for r in rates.collect()} == {"hard": "sft_on_gold", "easy": "graduated", "mid": "rl_eligible", "late": "graduated"}
    assert spark.range(1).select(selection.classify(F.lit(None).cast("double")).alias("c")).first()["c"] == "sft_on_gold"


REGISTRY = "cycle long, ord long, solve_rate double, promoted boolean, score double, second double"


def test_registry(spark):
    rates = [0.10, 0.50, 0.30, 0.40, 0.05]
    frame = spark.createDataFrame([(i, i, r, False, None, None) for i, r in enumerate(rates)], REGISTRY)
    assert sorted(r.cycle for r in selection.keepers(frame, 2).collect()) == [1, 3, 4]
    assert sorted(r.cycle for r in selection.prunable(frame, 2).collect()) == [0, 2]
    tie = spark.createDataFrame([(i, i, 0.5, i > 2, None, None) for i in range(5)], REGISTRY)
    assert selection.champion(tie).first()["cycle"] == 3
    scored = spark.createDataFrame([(1, 1, 0.2, False, 0.55, 0.05), (2, 2, 0.1, True, 0.50, 0.40)], REGISTRY)
    assert [selection.select_best(scored, f).first()["cycle"] for f in (0.3, 0.0, 0.9)] == [2, 1, 2]
    assert selection.crown(scored, 0.9).first()["cycle"] == 1
    assert selection.champion(frame.limit(0)).collect() == [] and selection.select_best(frame.limit(0), 0.0).collect() == []


def test_harvest(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, "f"), ("a", 0, 0.5, "f"), ("a", 2, 1.2, "f"), ("b", 3, None, "g"), ("e", 4, 0.0, "h")], "task_id string, ord long, reward double, fingerprint string")
    held = spark.createDataFrame([("e",)], "task_id string")
    assert [(r.task_id, r.ord) for r in selection.harvest(rows, held).collect()] == [("a", 1)]
    with pytest.raises(Exception, match="held-out"):
        selection.harvest(rows, held, least=0.0).collect()


def test_plateau_and_samples(spark):
    ledger = spark.createDataFrame(list(enumerate([False, True, False, False, False, True])), "cycle long, promoted boolean")
    assert [r.since for r in selection.plateau(ledger, 3).orderBy("cycle").collect()] == [1, 0, 1, 2, 3, 0]
    rows = spark.range(23)
    assert [r.id for r in selection.systematic(rows, 10, "id").orderBy("id").collect()] == list(range(23))[::2][:10]
    assert selection.systematic(rows.limit(0), 10, "id").collect() == []


def test_chat(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r.turns for r in chat.dialogues(turns).collect()}
    assert [(t.role, t.content, t.loss) for t in rows[1]] == [("user", "a", False), ("assistant", "b", True)]
    raw = spark.createDataFrame([("p", "s", None), ("p", " ", "x"), (None, "s", "x"), ("p", "", "x")], "problem string, snippet string, solution string")
    assert [(r.problem, r.solution) for r in chat.complete(raw).collect()] == [("p", "s")]
    prompt = spark.range(1).select(chat.prompts(F.lit("a.rs"), F.lit("fn x"), "In {path}: {snippet}").alias("p")).first()["p"]
    assert prompt == "In a.rs: fn x"


def test_lessons(spark):
    kind = "array<struct<role:string,content:string>>"
    rows = spark.createDataFrame([([("tool", "ok"), ("tool", " error[E1]: x\nmore"), ("assistant", "error: no")],), ([("tool", "fine")],), ([],)], f"m {kind}")
    assert [r.e for r in rows.select(evaluation.last_error(F.col("m")).alias("e")).collect()] == ["error[E1]: x", "", ""]
    parts = F.struct(F.lit(1.0).alias("fmt_clippy"), F.lit(1.0).alias("compile"), F.lit(0.5).alias("dense"), F.lit(0.0).alias("tests"), F.lit("pattern").alias("mode"))
    said = evaluation.lesson(F.lit("tests_failed"), F.lit(4), F.array(*[F.lit(x) for x in "abcd"]), F.lit(""), F.lit(1.0), F.lit(1.0))
    block = spark.range(1).select(evaluation.insight(F.lit("t"), F.lit("m"), F.lit(3), F.lit(0.25), F.lit(4), parts, said).alias("b")).first()["b"]
    assert block == "=== cycle 3 | t | model=m ===\noutcome: FAILED | reward=0.25 | turns=4 | mode=pattern\ntiers: fmt/clippy=1.0 compile=1 dense=0.50 tests=0\nlesson: It builds, yet tests fail: the logic is off. Failing: a, b, c\n\n"
    error = evaluation.lesson(F.lit("compile_error"), F.lit(4), F.array().cast("array<string>"), F.lit("error[E1]: " + "x" * 200), F.lit(1.0), F.lit(0.0))
    assert spark.range(1).select(error.alias("e")).first()["e"] == "It does not build. First error: error[E1]: " + "x" * 149


def test_gate_names_the_first_tasks(spark):
    kind = "task_id string, test_files array<string>, verify_mode string, setup_patch string, fail_to_pass array<string>, gold_patch string"
    rows = [(f"t{i}", ["a"], "pattern", None, None, None if i < 5 else "g") for i in range(9)] + [("t8", ["a"], "execution", "", [], None), (None, ["a"], "pattern", None, None, "g"), ("x", None, "execution", "s", None, None)]
    frame, held = spark.createDataFrame(rows, kind), spark.createDataFrame([("t2",), ("t2",), ("none",)], "task_id string")
    found = {r.rule: (r.severity, r.n, r.examples) for r in tasks.checks(frame, held, n_mirror=12).collect()}
    assert found == {
        "missing_fields": ("warn", 2, ["x"]), "duplicate_ids": ("fatal", 1, ["t8"]), "leaked_ids": ("fatal", 1, ["t2"]), "dead_reward": ("fatal", 1, ["t8"]), "some_gold_patches_missing": ("warn", 5, ["t0", "t1", "t2"]),
    }
    empty = tasks.checks(frame.limit(0), held, n_mirror=1)
    assert sorted((r.rule, r.severity, r.n, r.examples) for r in empty.collect()) == [("no_tasks", "warn", 1, []), ("stale_mirror", "warn", 1, [])]


def test_stages_go_on_behind_the_last_complete_one(spark):
    from tessera import folders
    from tessera.operators import stages

    folder, ran = folders.work_folder(spark, "stages"), []

    def stage(name, fails=False):
        def run(rows):
            ran.append(name)
            if fails:
                raise RuntimeError(name)
            return rows.withColumn(name, F.lit(1))

        return name, run

    rows = spark.range(3)
    with pytest.raises(RuntimeError):
        stages.dispatched(rows, [stage("a"), stage("b", fails=True), stage("c")], folder)
    both = [stage("a"), stage("b"), stage("c")]
    assert stages.complete(spark, folder, both) == ["a"]
    assert stages.dispatched(rows, both, folder, last="b").columns == ["id", "a", "b"]
    assert stages.dispatched(rows, both, folder).columns == ["id", "a", "b", "c"] and ran == ["a", "b", "b", "c"]
    assert stages.dispatched(rows, both, folder).count() == 3 and len(ran) == 4
    stages.dispatched(rows, both, folder, first="b")
    assert ran[4:] == ["b", "c"]
    for wrong in ({"first": "z"}, {"last": "z"}):
        with pytest.raises(ValueError, match="no stage"):
            stages.dispatched(rows, both, folder, **wrong)
    with pytest.raises(ValueError, match="aren't complete"):
        stages.dispatched(rows, both, folders.work_folder(spark, "stages"), first="c")


def test_lists_of_tasks_are_gathered_in_as_many_partitions_as_the_lines_need(spark, monkeypatch):
    from tessera.plans import task_queries

    folder, rows = "/root/testdata/sf0.001", []
    for lines in (100, 10**9):
        monkeypatch.setattr(task_queries, "LINES", lines)
        own = task_queries.order_tasks(spark, folder)
        rows.append(sorted(map(str, own.collect())))
        n = max(spark.sparkContext.defaultParallelism, spark.read.parquet(f"{folder}/lineitem.parquet").count() // lines)
        assert f"hashpartitioning(l_orderkey, {n})" in re.sub(r"#\d+L?", "", own._jdf.queryExecution().executedPlan().toString())
    assert rows[0] == rows[1]
