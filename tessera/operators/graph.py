"""Graphs as tables of edges: components, dependency order, what can be reached."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.folders import work_folder, written
from tessera.operators.scan import ranked

#: Edges that one task joins into components at once; packages that one task orders at once, and rows of an order that it hands on at once.
IN_ONE, ORDERED, ROWS = 2_000_000, 1_000_000, 10_000


def smallest_members(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges, and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):  # the ends, and what they point to
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return nodes, nodes[label]


def _contracted(whole: bool):
    """Edges as (node, smallest node that this task knows of), a stretch of edges at a time; whole tells that there is but one stretch, and lists smallest nodes too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            kind = table.schema.field(0).type
            nodes, least = smallest_members(*(table[i].to_numpy() for i in range(2)))
            far = slice(None) if whole else nodes != least
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes[far], kind), pa.array(least[far], kind)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if not whole and sum(x.num_rows for x in held) >= IN_ONE:
                yield out()
        if sum(x.num_rows for x in held):
            yield out()

    return run


def components(edges: DataFrame, in_one: int = IN_ONE) -> DataFrame:
    """node, component (its smallest node) of all nodes of edges (a, b), in either direction.

    Tasks contract what they hold; while more than in_one edges are left, rounds of stars (each node's larger neighbours, then its smaller ones, are tied to the smallest) halve the
    distances, by partial minima; what is left then is joined in one task. Null ends are left out; a node tied to itself is a component.
    """
    folder = work_folder(edges.sparkSession, "components")
    kind = dict(edges.dtypes)["a"]
    pairs = f"a {kind}, b {kind}"
    loops = edges.where("a = b").select("a").distinct()
    now, before, i = edges.where("a <> b").select("a", "b"), None, 0
    while True:
        now = written(now.mapInArrow(_contracted(False), pairs).distinct(), f"{folder}/{i}")
        size = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("hash")).first()
        if size.n <= in_one:
            found = now.coalesce(1).mapInArrow(_contracted(True), pairs)
            break
        if size == before:  # stars: each node is tied to the smallest of its component
            found = now.union(now.select("b", "b").distinct())
            break
        before, i = size, i + 1
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), f"{folder}/{i}-large")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, f"{folder}/{i}-star")
        small = written(large.groupBy("a").agg(F.min("b").alias("m")), f"{folder}/{i}-small")
        now = large.join(small, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")
    found = found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    lone = loops.select(F.col("a").alias("node"), F.col("a").alias("component")).join(found, "node", "left_anti")
    return written(found.union(lone), f"{folder}/found")


def popped(nodes: dict[str, set[str]]) -> list[str]:
    """Nodes so that each follows its dependencies, the smallest name first among those ready, without those in or behind a cycle."""
    waits = {n: {d for d in deps if d in nodes and d != n} for n, deps in nodes.items()}
    users: dict[str, list[str]] = {}
    for n, deps in waits.items():
        for d in deps:
            users.setdefault(d, []).append(n)
    ready = sorted(n for n, deps in waits.items() if not deps)
    out = []
    while ready:
        out.append(heapq.heappop(ready))
        for user in users.get(out[-1], ()):
            waits[user].discard(out[-1])
            if not waits[user]:
                heapq.heappush(ready, user)
    return out


def smallest_first(nodes: dict[str, set[str]]) -> list[str]:
    """popped, and then by name the nodes in or behind a cycle."""
    out = popped(nodes)
    return out + sorted(set(nodes) - set(out))


def _ordered(most: int):
    """The own order of each group of packages, with the largest name so far. The rows come sorted by group."""
    names, kinds = ["name", "rest", "high", "i"], (pa.string(), pa.bool_(), pa.string(), pa.int64())

    def rows(group: dict[str, set[str]]) -> list[tuple]:
        order, high, out = popped(group), "", []
        for i, name in enumerate(order):
            high = max(high, name)
            out.append((name, False, high, i))
        return out + [(name, True, name, 0) for name in set(group) - set(order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(held), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held[at : at + ROWS], strict=True), kinds, strict=True)], names=names)
            held.clear()

        component, group, held = None, {}, []
        for batch in batches:
            for c, name, dep in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if group and c != component:
                    held += rows(group)
                    group = {}
                    if len(held) >= ROWS:
                        yield from out()
                component = c
                group.setdefault(name, set())
                if dep is not None:
                    group[name].add(dep)
                if len(group) > most:
                    raise ValueError("a component has too many packages for one task: use topological_levels")
        held += rows(group)
        yield from out()

    return run


def _highest(names: DataFrame, edges: DataFrame) -> DataFrame:
    """name, high of names (name) by edges (a, b) among them, distinct and without loops: the largest name of a node and all that it needs, directly or not. Nodes in or behind a cycle are left out.

    Nodes that need one other are ways to the next node that needs none or several; ways double in length each round. The nodes that need several are peeled off by counts of open needs.
    """
    folder = work_folder(names.sparkSession, "highest")
    needs = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("to"))
    known = written(names.join(needs, F.col("name") == F.col("a"), "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), "to"), f"{folder}/needs")
    ends = known.where("n <> 1").select(F.col("name").alias("to"), F.lit(True).alias("done"))
    way = known.where("n = 1").select("name", "to").join(ends, "to", "left").select("name", "to", F.col("name").alias("high"), F.coalesce("done", F.lit(False)).alias("done"))
    way, i, before = written(way, f"{folder}/way-0"), 0, None
    while (left := way.where("NOT done").count()) and left != before:  # as many as before: only those in or behind a cycle
        before, i = left, i + 1
        on = way.select(F.col("name").alias("to"), F.col("to").alias("next"), F.col("high").alias("far"), F.col("done").alias("over"))
        longer = way.where("NOT done").join(on, "to").select("name", F.col("next").alias("to"), F.greatest("high", "far").alias("high"), F.col("over").alias("done"))
        way = written(way.where("done").union(longer), f"{folder}/way-{i}")
    several, depth = known.where("n > 1").select("name", "n", F.col("name").alias("high")), 0
    ready = written(known.where("n = 0").select("name", F.col("name").alias("high")), f"{folder}/levels/level=0")
    if not several.isEmpty():
        asked = edges.join(several.select(F.col("name").alias("a")), "a", "left_semi").join(way.withColumnRenamed("to", "via"), F.col("b") == F.col("name"), "left").where("done IS NULL OR done")
        asked = written(asked.select("a", F.coalesce("via", "b").alias("via"), F.col("high").alias("top")), f"{folder}/asked")
        while not ready.isEmpty():
            met = asked.join(ready.select(F.col("name").alias("via"), F.col("high").alias("far")), "via").groupBy("a").agg(F.count("*").alias("met"), F.max(F.greatest("top", "far")).alias("far"))
            state = several.join(met, F.col("name") == F.col("a"), "left").select("name", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n"), F.greatest("high", "far").alias("high"))
            depth += 1
            state = written(state, f"{folder}/state-{depth}")
            ready, several = written(state.where("n = 0").select("name", "high"), f"{folder}/levels/level={depth}"), state.where("n > 0")
    done = names.sparkSession.read.schema("name string, high string, level int").option("basePath", f"{folder}/levels").parquet(f"{folder}/levels").select("name", "high")
    far = way.where("done").join(done.select(F.col("name").alias("to"), F.col("high").alias("far")), "to")
    return written(done.union(far.select("name", F.greatest("high", "far").alias("high"))), f"{folder}/highest")


def _by_highest(names: DataFrame, edges: DataFrame, in_one: int) -> DataFrame:
    """name, rest, high, more, i of a graph of any size: sorted by rest, high, more and i this is the order of smallest_first.

    A largest name comes only when nothing else can come, so it is followed by just those that need it: the order goes by the largest name that a package is or needs (high). Those that share it are a
    block, which begins with that name itself. A block that fits a task is ordered there; a larger one, without its first, is a graph that is divided in the same way (more: the largest names there).
    """
    folder, out, depth = work_folder(names.sparkSession, "blocks"), [], 0
    names = names.select("name", F.array().cast("array<string>").alias("keys"))
    while True:
        high = names.join(_highest(names.select("name"), edges), "name", "left")
        sizes = high.groupBy("high").agg(F.count("*").alias("size"))
        keyed = high.join(sizes, "high", "left").select("name", "size", F.col("high").alias("block"), F.array_append("keys", F.coalesce("high", "name")).alias("keys"))
        keyed = written(keyed, f"{folder}/{depth}-keyed")
        place = [F.col("block").isNull().alias("rest"), F.element_at("keys", 1).alias("high"), F.slice("keys", 2, 1_000_000_000).alias("more")]
        first = F.col("block").isNull() | (F.col("size") == 1) | (F.col("size") > in_one) & (F.col("name") == F.col("block"))
        out.append(keyed.where(first).select("name", *place, F.lit(0).cast("long").alias("i")))
        more = keyed.where(~first)
        if more.isEmpty():
            break
        a, b = more.select(F.col("name").alias("a"), F.col("block").alias("block_a")), more.select(F.col("name").alias("b"), F.col("block").alias("block_b"))
        edges = written(edges.join(a, "a").join(b, "b").where("block_a = block_b").select("a", "b"), f"{folder}/{depth}-edges")
        small = more.where(F.col("size") <= in_one)
        rows = small.join(edges, F.col("name") == F.col("a"), "left").select("block", "name", F.col("b").alias("dep")).repartition("block").sortWithinPartitions("block", "name")
        placed = rows.mapInArrow(_ordered(in_one), "name string, rest boolean, high string, i long").select("name", "i")
        out.append(small.join(placed, "name").select("name", *place, "i"))
        names, depth = more.where(F.col("size") > in_one).select("name", "keys"), depth + 1
        edges = edges.join(names.select(F.col("name").alias("a")), "a", "left_semi")
        if names.isEmpty():
            break
    return functools.reduce(DataFrame.union, out)


def _label(name: str) -> Column:
    """What stands for a name while components are found: a number of 64 bits. Names that share one fall into one component, which is ordered as it is with both apart."""
    return F.xxhash64(name)


def topological_ranks(packages: DataFrame, most: int | None = None, in_one: int = ORDERED) -> DataFrame:
    """name, topo_rank of packages (name, deps: array of names): each after its dependencies, always the smallest name of those that could be next; packages in or behind a cycle end the order, by name.

    That order is defined one pop at a time, but only within a component of the graph: a component's next package comes as soon as it is the smallest of all that could come, so a package
    comes right after the largest name before it in its own component. Tasks order the components, of `in_one` packages at most, and a sort by that name puts them together. Larger
    components are first divided into blocks by the largest name that a package is or needs (see _by_highest); with `most`, one of more packages than that is an error.
    Names that are no package, and a package's dependency on itself, don't count. Repeated names are one package with all their dependencies.
    """
    folder = work_folder(packages.sparkSession, "order")
    own = packages.where("name IS NOT NULL").select(F.col("name").cast("string").alias("name"), "deps")
    names = own.select("name").distinct()
    edges = own.select(F.col("name").alias("a"), F.explode("deps").alias("b")).where("a <> b").join(names.withColumnRenamed("name", "b"), "b", "left_semi").select("a", "b").distinct()
    edges = written(edges, f"{folder}/edges")
    tied = components(edges.select(_label("a").alias("a"), _label("b").alias("b")))
    names = names.withColumn("node", _label("name")).join(tied, "node", "left").select("name", F.coalesce("component", "node").alias("c"))
    names = written(names, f"{folder}/names")
    sizes = names.groupBy("c").agg(F.count("*").alias("size"))
    if most is not None and not sizes.where(F.col("size") > most).isEmpty():
        raise ValueError("a component has too many packages for one task: use topological_levels")
    large = written(sizes.where(F.col("size") > in_one), f"{folder}/large")  # a row for each in_one packages at most
    far = None
    if not large.isEmpty():
        inside = written(names.join(F.broadcast(large), "c", "left_semi").select("name"), f"{folder}/inside")
        far = _by_highest(inside, edges.join(inside, F.col("a") == F.col("name"), "left_semi"), in_one)
        names, edges = names.join(F.broadcast(large), "c", "left_anti"), edges.join(inside, F.col("a") == F.col("name"), "left_anti")
    rows = names.join(edges, F.col("name") == F.col("a"), "left").select("c", "name", F.col("b").alias("dep"))
    ordered = rows.repartition("c").sortWithinPartitions("c", "name").mapInArrow(_ordered(in_one), "name string, rest boolean, high string, i long")
    ordered = ordered.select("name", "rest", "high", F.array().cast("array<string>").alias("more"), "i")
    return ranked(ordered if far is None else ordered.union(far), "rest", "high", "more", "i").select("name", F.col("rank_").alias("topo_rank"))


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, topo_level of nodes (name) by edges (name, dep): the longest way to a node without dependencies, null in or behind a cycle.

    Nodes are peeled off by counts of the dependencies that are still open: a round joins the edges with the nodes of one level and lowers the counts of those that use them, so
    it ends with the deepest level, cycles or not. Edges of other nodes, repeated ones and those of a node to itself don't count. This is
    another order than topological_ranks: names of a level are not interleaved with later ones.
    """
    spark, folder = nodes.sparkSession, work_folder(nodes.sparkSession, "levels")
    names = nodes.select("name").where("name IS NOT NULL").distinct()
    known = edges.where("name <> dep").select("name", "dep").distinct().join(names, "name", "left_semi").join(names.withColumnRenamed("name", "dep"), "dep", "left_semi")
    known = written(known.select("name", "dep"), f"{folder}/edges")
    open_ = names.join(known.groupBy("name").agg(F.count("*").alias("n")), "name", "left").na.fill(0, ["n"])
    depth, kind = 0, nodes.schema["name"].dataType.simpleString()
    while True:
        state = written(open_, f"{folder}/state-{depth}")
        ready = written(state.where("n = 0").select("name"), f"{folder}/levels/topo_level={depth}")
        if ready.isEmpty():
            break
        met = known.join(ready.withColumnRenamed("name", "dep"), "dep").groupBy("name").agg(F.count("*").alias("met"))
        open_ = state.where("n > 0").join(met, "name", "left").select("name", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n"))
        depth += 1
    levels = spark.read.schema(f"name {kind}, topo_level int").option("basePath", f"{folder}/levels").parquet(f"{folder}/levels")
    return levels.union(state.where("n > 0").select("name", F.lit(None).cast("int")))


def topological_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, topo_level, topo_rank: by level and then by name; nodes in or behind a cycle have no level and end the order, by name."""
    placed = ranked(topological_levels(edges, nodes).withColumn("last_", F.col("topo_level").isNull()), "last_", "topo_level", "name")
    return placed.select("name", "topo_level", F.col("rank_").alias("topo_rank"))


def reachable(edges: DataFrame, most: int = 100) -> DataFrame:
    """name, dep, distance of all nodes that can be reached from each other one along edges (name, dep), in `most` steps at most.

    The reach doubles: a shortest way of more than n and at most 2n steps is one of exactly n steps and a shortest one behind it. So there are as many rounds as the longest distance has binary
    digits, and each pair is kept once, however many ways lead to it. Cycles end, since only new pairs go on; a node in a cycle reaches itself. More steps are an error (RECURSION_LEVEL_LIMIT_EXCEEDED).
    """
    folder, reach = work_folder(edges.sparkSession, "reach"), 1
    known = written(edges.select("name", "dep").where("name IS NOT NULL AND dep IS NOT NULL").distinct().withColumn("distance", F.lit(1)), f"{folder}/{reach}")
    while True:
        last = known.where(F.col("distance") == reach)
        if last.isEmpty():
            return known
        behind = known.select(F.col("name").alias("via"), F.col("dep").alias("to"), F.col("distance").alias("more"))
        longer = last.join(behind, F.col("dep") == F.col("via")).select("name", F.col("to").alias("dep"), (F.col("more") + reach).alias("distance"))
        new = known.union(longer).groupBy("name", "dep").agg(F.min("distance").alias("distance")).where(F.col("distance") > reach)
        reach *= 2
        new = written(new, f"{folder}/{reach}")
        if reach > most and not new.where(F.col("distance") > most).isEmpty():
            raise ValueError(f"RECURSION_LEVEL_LIMIT_EXCEEDED: a way has more than {most} steps")
        known = known.union(new)
