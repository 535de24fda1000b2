"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles. Rows with the same set form a class at once. Every class gets a MinHash sketch. Independent
trees then branch the classes recursively: at a node of a tree sketch places are drawn by the path that leads to it, more than
1 / similarity of them (two at 0.8), and the classes go to a child for each value at each place. Small nodes, and those whose children
would be as much work, are compared exhaustively, by sketches first; what may be similar is confirmed on the full sets. A pair at 0.8 has
the same root in a tree with 0.8 and stays together below it with 0.96, 0.95, 0.94, 0.94 for 1 to 4 levels and 0.938 at any depth; sixteen
trees, which draw from one sketch, miss it with less than 2 in 10^8. The sketch's estimate drops 2 in 10^7 more (SLACK).

A group of thousands of near copies can't be branched apart. Therefore a first, cheap round of a few trees links every class to the
smallest id of its nodes only ("stars", one pair for a class); confirmed stars give labels, and the second, complete round leaves out pairs
that share a label. A class that is too close to many classes of another label, yet not linked, is compared with all of that label by
full sets, block against block. Classes that are close to many others, of whatever labels, are gathered in cells (those of one node that hang
together, under the smallest id) and likewise compared in blocks. Only links that join something leave such a task: no task emits the pairs of a group.

Nodes of more than `node_limit` classes are branched by a shuffle, smaller ones within a task. Near copies beyond that number would stay
together at any depth, so such a node doesn't have to come apart: in the first round all its classes meet its smallest id and only those not
plainly near to it branch on, to a bounded depth; in the second round the classes outside its largest label, once they are few or the depth is
reached, are put against blocks of the node, a smaller node each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.folders import work_folder, written
from tessera.llm import words
from tessera.llm.common import binary_array, binary_parts, chunks, long_array, text_bytes

#: Bytes of text that a task works on at once; its arrays take some sixty times that.
SLICE_BYTES = 2 << 20
#: Places of a sketch; one byte each.
PLACES = 128
TREES, STAR_TREES = 16, 4
#: Classes of a node that are compared exhaustively.
LEAF = 256
#: Children's part of a node's comparisons beyond which it doesn't come apart and is compared exhaustively.
APART = 0.75
#: Levels by which nodes beyond the limit are branched, and those of them in the second round, where each may double a node's rows.
LEVELS, MIXED_LEVELS = 12, 4
#: Standard deviations of a sketch's estimate by which a pair may fall short before it is dropped: at 0.8 those of fewer than
#: 78 equal bytes, of which all trees together lose 1.8 in 10^7 links (a binomial tail).
SLACK = 5.5
#: Most pairs of one class with one other label that leave a leaf; beyond them the class meets all of that label.
CAP = 8
#: Most other pairs of one class that leave a leaf; beyond them it goes to a cell with all that it is close to.
DENSE = 16
#: Classes in a block of the exhaustive comparison of a class with a label.
BLOCK = 512
#: Rows without doc_id get ids from here on, by their text.
NO_ID = 1 << 62
_rng = np.random.default_rng(words.SEED + 2)
XORS = _rng.integers(0, 2**32, PLACES, dtype=np.uint64).astype(np.uint32)
ODDS = (_rng.integers(0, 2**31, PLACES, dtype=np.uint64) * 2 + 1).astype(np.uint32)

CLASS_TYPE = "doc_id long, n_shingles long, k1 long, k2 long, sketch binary, roots array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and offsets. A text of fewer than k words gives its whole sequence.

    A text longer than a slice is taken in pieces that share k - 1 words.
    """
    if len(offsets) == 2 and len(data) > SLICE_BYTES:
        runs: list[np.ndarray] = []
        for piece, _ in words.pieces(data, SLICE_BYTES, k - 1):
            starts, ends, _ = words.split(piece, np.array([0, len(piece)]))
            if len(starts) >= k:
                runs.append(np.unique(words.grams(words.hashes(piece, starts, ends, lower=True), k)[: len(starts) - k + 1]))
            while len(runs) > 1 and len(runs[-2]) < 2 * len(runs[-1]):  # runs of falling sizes, so that each item is merged a few times
                runs.append(np.union1d(runs.pop(), runs.pop()))
        if runs:
            found = np.unique(np.concatenate(runs))
            return found, np.array([0, len(found)])
    starts, ends, before = words.split(data, offsets)
    h = words.hashes(data, starts, ends, lower=True)
    n = np.diff(before)
    per_doc = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    rows = np.repeat(np.arange(len(n)), per_doc)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    full = words.grams(h, k)
    g = full[np.minimum(before[:-1][rows] + place, max(len(full) - 1, 0))] if len(rows) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = words.grams(h[before[i] : before[i + 1]], int(n[i]))[:1]
        g[np.searchsorted(rows, i)] = words.mix(own + np.uint64(n[i]))[0]
    order = np.lexsort((g, rows))
    g, rows = g[order], rows[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    g, rows = g[new], rows[new]
    return g, np.searchsorted(rows, np.arange(len(n) + 1))


def sketches(g: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the sketch of each set, and the full minima of the trees' first places. Empty sets get zeros."""
    n = len(offsets) - 1
    has = np.diff(offsets) > 0
    begins = offsets[:-1][has]
    low = (g ^ (g >> np.uint64(32))).astype(np.uint32)
    sketch, roots = np.zeros((n, PLACES), np.uint8), np.zeros((n, TREES), np.int64)
    if len(begins):
        for i in range(PLACES):
            least = np.minimum.reduceat((low ^ XORS[i]) * ODDS[i], begins)
            sketch[has, i] = (least ^ (least >> np.uint32(11))) & np.uint32(255)
            if i < TREES:
                roots[has, i] = words.mix(least.astype(np.uint64) + np.uint64(i << 40)).view(np.int64)
    return sketch, roots


def _classes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "raw", SLICE_BYTES):
                g, at = shingle_sets(data, offsets, k)
                sketch, roots = sketches(g, at)
                n = len(at) - 1
                sums = [np.zeros(n, np.uint64) for _ in range(2)]
                has = np.diff(at) > 0
                if has.any():
                    for j, out in enumerate(sums):
                        out[has] = np.add.reduceat(words.mix(g * np.uint64(2 * j + 3) + np.uint64(j + 1)), at[:-1][has])
                k1, k2 = (words.mix(s).view(np.int64) for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(k1), pa.array(k2), binary_array(sketch.ravel(), np.arange(n + 1) * PLACES), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * TREES, pa.array(roots.ravel()))],
                    names=["doc_id", "n_shingles", "k1", "k2", "sketch", "roots"],
                )

    return run


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with the same key, of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = long_array(batch.column(batch.schema.get_field_index(key)))
        cuts = np.flatnonzero(np.diff(keys)) + 1
        if held and long_array(held[-1].column(batch.schema.get_field_index(key)))[-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for begin, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            held.append(batch.slice(begin, end - begin))
            if end < len(keys):
                if end - begin > 1 or len(held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def draw(path: int, depth: int, places: float) -> np.ndarray:
    """The places by which a node branches: so many on average."""
    rng = np.random.default_rng([path & (2**63 - 1), depth])
    return rng.choice(PLACES, size=int(places) + int(rng.random() < places % 1), replace=False)


def agree(equal: np.ndarray) -> np.ndarray:
    """Similarity by the number of equal bytes, less those that agree by chance."""
    return (equal / PLACES - 1 / 256) / (1 - 1 / 256)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of sketches."""
    return agree((a == b).sum(-1))


def equal_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many places of each sketch of a agree with each of b."""
    if len(a) * len(b) <= 4096:
        eight = (a[:, None] == b[None]).view(np.uint64).sum(-1)
        return ((eight * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.uint8)
    out, same = np.zeros((len(a), len(b)), np.uint8), np.empty((len(a), len(b)), bool)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        np.equal(x[:, None], y, out=same)
        out += same.view(np.uint8)
    return out


def children(idx: np.ndarray, sketch: np.ndarray, path: int, depth: int, places: float) -> Iterator[tuple[np.ndarray, int]]:
    """The classes of each child and the path that leads to it."""
    for place in draw(path, depth, places):
        order = np.argsort(sketch[idx, place], kind="stable")
        values = sketch[idx[order], place]
        cuts = np.flatnonzero(np.diff(values)) + 1
        for begin, part in zip([0, *cuts], np.split(order, cuts), strict=True):
            if len(part) > 1:
                yield idx[part], (path * 0x9E3779B97F4A7C15 + (int(place) << 8 | int(values[begin])) + 1) & (2**63 - 1)


def _stars(similarity: float):
    """For every class of a node and its descendants: the smallest id of a node that it is likely similar to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "node"):
            ids = long_array(table["doc_id"].combine_chunks())
            order = np.argsort(ids, kind="stable")
            sketch = binary_parts(table["sketch"].combine_chunks())[0].reshape(-1, PLACES)[order]
            ids, node = ids[order], table["node"][0].as_py()
            best, leader = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            stack = [(np.arange(len(ids)), node, 0)]
            while stack:
                idx, path, depth = stack.pop()
                est = estimate(sketch[idx[1:]], sketch[idx[0]])
                better = (est > best[idx[1:]] + 1e-9) & (est >= similarity - 0.04)
                best[idx[1:][better]], leader[idx[1:][better]] = est[better], ids[idx[0]]
                if len(idx) > 2 and depth < 12 and (est < similarity + 0.1).any():
                    stack += [(c, p, depth + 1) for c, p in children(idx, sketch, path, depth, 1 / similarity)]
            found = np.flatnonzero((best > 0) & (leader != ids))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(leader[found]), pa.array(best[found])], names=["b", "a", "est"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the estimate of its similarity to its node's head."""
    for batch in batches:
        if batch.num_rows:
            own, head = (binary_parts(batch.column(i))[0].reshape(-1, PLACES) for i in (3, 4))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(estimate(own, head))], names=["node", "doc_id", "a", "sketch", "est"])


def least_estimate(similarity: float) -> float:
    """The estimate below which a pair is dropped."""
    return similarity - SLACK * (similarity * (1 - similarity) / PLACES) ** 0.5


def join(group: np.ndarray, places: np.ndarray) -> None:
    """Makes the groups of these places one."""
    own = np.unique(group[places])
    if len(own) > 1:
        group[np.isin(group, own)] = own[0]


def _pairs(similarity: float):
    """Pairs of different labels that may be similar: (b, a, kind 0). Where one class has too many with a label, (b, label, 1); where it has
    too many others, all that hang together with it as (b, smallest id, 2)."""
    least = least_estimate(similarity)
    places = int(1 / similarity) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "node"):
            ids, label = long_array(table["doc_id"].combine_chunks()), long_array(table["label"].combine_chunks())
            sketch = binary_parts(table["sketch"].combine_chunks())[0].reshape(-1, PLACES)
            node = table["node"][0].as_py()
            out: set[tuple[int, int, int]] = set()
            cell = np.arange(len(ids))

            def outside(idx: np.ndarray) -> np.ndarray:
                """Where the classes are that aren't of the largest label."""
                _, inverse, count = np.unique(label[idx], return_inverse=True, return_counts=True)
                return np.flatnonzero(inverse != count.argmax())

            whole = np.arange(len(ids))
            stack = [(whole, outside(whole), node, 0)]
            while stack:
                idx, small, path, depth = stack.pop()
                if len(idx) > LEAF and len(small) > LEAF and depth < 64:
                    parts = [(c, outside(c), p, depth + 1) for c, p in children(idx, sketch, path, depth, places)]
                    if sum(len(c) * len(s) for c, s, _, _ in parts) <= APART * len(idx) * len(small):
                        stack += [part for part in parts if len(part[1])]
                        continue
                step = max(1, (1 << 17) // len(idx))
                for at in range(0, len(small), step):  # the largest label's classes need not be compared with each other
                    block = idx[small[at : at + step]]
                    near = (agree(equal_places(sketch[block], sketch[idx])) >= least) & (label[block][:, None] != label[idx])
                    for i in np.flatnonzero(near.any(1)):
                        me, others = int(ids[block[i]]), idx[near[i]]
                        theirs, of, count = np.unique(label[others], return_inverse=True, return_counts=True)
                        out.update((me, x, 1) for x in theirs[count > CAP].tolist())
                        others = others[count[of] <= CAP]
                        if len(others) <= DENSE:
                            out.update((max(me, x), min(me, x), 0) for x in ids[others].tolist())
                        else:
                            join(cell, np.append(others, block[i]))
            _, first, inverse, count = np.unique(cell, return_index=True, return_inverse=True, return_counts=True)
            smallest = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(smallest, inverse, ids)
            out.update((x, y, 2) for x, y in zip(ids[count[inverse] > 1].tolist(), smallest[inverse][count[inverse] > 1].tolist(), strict=True))
            if out:
                b, a, kind = zip(*sorted(out), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(a, pa.int64()), pa.array(kind, pa.int32())], names=["b", "a", "kind"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "raw", SLICE_BYTES):
                g, at = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([part.column(0), binary_array(g.view(np.uint8), at * 8)], names=["doc_id", "items"])

    return run


def _linked(percent: int):
    """The pairs whose full sets share at least percent of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(*binary_parts(batch.column(i)),) for i in (2, 3)]
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (d[o[i] : o[i + 1]].view(np.uint64) for d, o in sides)
                keep[i] = similar(x, y, percent)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
        return False
    at = np.searchsorted(x, y)
    same = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def _block_links(percent: int, similarity: float):
    """Links between the classes of two blocks (low, high), by sketches and then by full sets; pairs that other links have joined are left out."""
    least = least_estimate(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "cell"):
            ids, label = (long_array(table[c].combine_chunks()) for c in ("doc_id", "label"))
            low, high = (np.flatnonzero(table[c].combine_chunks().to_numpy(zero_copy_only=False)) for c in ("low", "high"))
            sketch = binary_parts(table["sketch"].combine_chunks())[0].reshape(-1, PLACES)
            data, at = binary_parts(table["items"].combine_chunks())
            group, found = np.unique(label, return_inverse=True)[1], []
            step = max(1, (1 << 18) // max(1, len(high)))
            for begin in range(0, len(low), step):
                mine = low[begin : begin + step]
                near = agree(equal_places(sketch[mine], sketch[high])) >= least
                for x, y in zip(*np.nonzero(near), strict=True):
                    i, j = mine[x], high[y]
                    if group[i] != group[j] and ids[i] != ids[j] and similar(data[at[i] : at[i + 1]].view(np.uint64), data[at[j] : at[j + 1]].view(np.uint64), percent):
                        found.append((ids[i], ids[j]))
                        join(group, np.array([i, j]))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in edges (a, b).

    Labels sink along edges and then jump to their label's label, until none changes; each round is a written table.
    """
    both = written(edges.selectExpr("a AS u", "b AS v").unionAll(edges.selectExpr("b", "a")).where("u <> v").distinct(), f"{folder}/edges")
    state = written(both.groupBy(F.col("u").alias("id")).agg(F.least("id", F.min("v")).alias("label")), f"{folder}/labels-0")
    for i in range(1, 1000):
        sunk = both.join(state.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        low = state.join(sunk, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        over = state.select(F.col("id").alias("label"), F.col("label").alias("next"))
        jumped = low.join(over, "label", "left").select("id", "was", F.least("label", F.coalesce("next", "label")).alias("label"))
        step = written(jumped, f"{folder}/labels-{i}")
        state = step.select("id", "label")
        if step.where("was <> label").isEmpty():
            return state.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, node_limit: int = 20_000, trees: int = TREES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    The text's A-Z count as a-z; words are `[^\\x20\\x09-\\x0D]+`; a set holds the distinct shingles of k words, or the whole
    sequence where there are fewer; null, empty and blank texts have no set and are linked with nothing. Two documents are linked if their
    intersection has at least `similarity` of their union. component_id is the smallest doc_id reachable by links; kept tells that the
    row has it. Rows that share a doc_id count as one node; a row without doc_id gets its class's component_id and is never kept.
    Other columns of docs are not looked at.
    """
    spark, folder, percent = docs.sparkSession, work_folder(docs.sparkSession, "neardup"), round(100 * similarity)
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))
    rows = written(raw.mapInArrow(_classes(k), CLASS_TYPE), f"{folder}/rows")
    reps = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = written(reps, f"{folder}/reps")
    keys = [F.col(f"r.{c}") == F.col(f"c.{c}") for c in ("k1", "k2", "n_shingles")]
    classes = rows.alias("r").join(reps.alias("c"), [*keys, F.col("r.doc_id") == F.col("c.rep")], "left_semi").dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "sketch", "roots")
    classes = written(classes, f"{folder}/classes")

    def branched(level: DataFrame, depth: int, columns: list[str], places: float) -> DataFrame:
        """The children of the rows' nodes, by so many places on average."""
        place = lambda j: F.pmod(F.xxhash64("node", F.lit(depth), F.lit(j)), F.lit(PLACES)).cast("int")
        more = F.pmod(F.xxhash64("node", F.lit(depth), F.lit(-1)), F.lit(10_000)) < round(10_000 * (places % 1))
        child = lambda j: F.xxhash64("node", F.lit(depth), F.lit(j), F.substring("sketch", place(j) + 1, F.lit(1)))
        own = [child(j) for j in range(int(places))]
        return level.select(F.explode(F.when(more, F.array(*own, child(int(places)))).otherwise(F.array(*own))).alias("node"), *columns)

    def roots_of(of: DataFrame, n: int, columns: list[str]) -> DataFrame:
        return of.select(F.posexplode(F.slice("roots", 1, n)).alias("tree", "node"), *columns).drop("tree")

    def by_node(df: DataFrame) -> DataFrame:
        return df.repartition("node").sortWithinPartitions("node")

    def big_stars(of: DataFrame) -> DataFrame:
        """Stars (b, a, est) of all nodes; of nodes beyond node_limit, by their smallest id and then by their children."""
        columns, kind = ["doc_id", "sketch"], "b long, a long, est double"
        level, out = roots_of(of, STAR_TREES, columns), None
        for depth in range(LEVELS + 1):
            heads = level.groupBy("node").agg(F.count("*").alias("n"), F.min_by(F.struct(F.col("doc_id").alias("a"), F.col("sketch").alias("head")), "doc_id").alias("h"))
            heads = written(heads.where(F.col("n") > node_limit).select("node", "h.a", "h.head"), f"{folder}/heads-{depth}")
            small = by_node(level.join(heads, "node", "left_anti")).mapInArrow(_stars(similarity), kind)
            out = small if out is None else out.unionByName(small)
            if heads.isEmpty():
                break
            met = written(level.join(heads, "node").select("node", "doc_id", "a", "sketch", "head").mapInArrow(_met, "node long, doc_id long, a long, sketch binary, est double"), f"{folder}/met-{depth}")
            out = out.unionByName(met.where((F.col("est") >= similarity - 0.04) & (F.col("doc_id") != F.col("a"))).select(F.col("doc_id").alias("b"), "a", "est"))
            level = written(branched(met.where(F.col("est") < similarity + 0.1), depth, columns, 1 / similarity), f"{folder}/level-{depth}")
        return out

    def mixed_nodes(of: DataFrame) -> DataFrame:
        """Rows (node, doc_id, label, sketch) of nodes of at most node_limit rows in which any two of different labels that stay together meet."""
        columns, half = ["doc_id", "label", "sketch"], max(1, node_limit // 2)
        levels = min(LEVELS, MIXED_LEVELS)
        level, done = roots_of(of, trees, columns), None
        for depth in range(levels + 1):
            counts = level.groupBy("node", "label").agg(F.count("*").alias("m")).groupBy("node").agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("label", F.struct("m", "label")).alias("main"))
            large = written(counts.where(F.col("n") > node_limit), f"{folder}/large-{depth}")
            small = level.join(large.select("node"), "node", "left_anti")
            done = small if done is None else done.unionByName(small)
            if large.isEmpty():
                break
            rest = F.col("n") - F.col("most")
            ready = (rest > 0) if depth == levels else (rest > 0) & (rest <= half)
            done = done.unionByName(blocks(level.join(large.where(ready), "node"), half).select("node", *columns))
            level = written(branched(level.join(large.where((rest > 0) & ~ready).select("node"), "node", "left_semi"), depth, columns, int(1 / similarity) + 1), f"{folder}/mixed-{depth}")
        return done

    def blocks(rows: DataFrame, half: int) -> DataFrame:
        """Smaller nodes: each block of the rows outside the main label with each block of the others and of the main label."""
        inside, spot = F.col("label") == F.col("main"), F.xxhash64("doc_id", "node")
        outer, inner = F.ceil((F.col("n") - F.col("most")) / half), F.ceil(F.col("most") / half)
        own = F.pmod(spot, F.when(inside, inner).otherwise(outer))
        cell = lambda kind, i, j: F.xxhash64("node", F.lit(kind), i, j)
        to_main = F.transform(F.sequence(F.lit(0).cast("long"), inner - 1), lambda j: cell("main", own, j))
        to_rest = F.transform(F.sequence(F.lit(0).cast("long"), outer - 1), lambda j: cell("rest", F.least(own, j), F.greatest(own, j)))
        from_main = F.transform(F.sequence(F.lit(0).cast("long"), outer - 1), lambda i: cell("main", i, own))
        cells = F.when(inside, from_main).otherwise(F.when(outer > 1, F.concat(to_main, to_rest)).otherwise(to_main))
        return rows.withColumn("node", F.explode(cells))


    def full_sets(ids: DataFrame) -> DataFrame:
        return raw.join(ids, "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, items binary")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = written(full_sets(ids), f"{folder}/sets-{name}").dropDuplicates(["doc_id", "items"])
        both = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
        return written(both.select("a", "b", "x", "y").mapInArrow(_linked(percent), "a long, b long"), f"{folder}/links-{name}")

    stars = written(big_stars(classes).groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")), f"{folder}/stars")
    links = confirmed(stars, "stars")
    up = links.select(F.col("b").alias("doc_id"), F.col("a").alias("label")).groupBy("doc_id").agg(F.min("label").alias("label"))
    for _ in range(2):  # a valid merging will do here: it only saves work
        over = up.select(F.col("doc_id").alias("label"), F.col("label").alias("next"))
        up = up.join(over, "label", "left").select("doc_id", F.coalesce("next", "label").alias("label"))
    labelled = written(classes.join(up, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), f"{folder}/labelled")

    found = written(by_node(mixed_nodes(labelled)).mapInArrow(_pairs(similarity), "b long, a long, kind int").distinct(), f"{folder}/pairs")
    more = confirmed(found.where("kind = 0"), "pairs")
    links = links.unionByName(more)

    meets = written(found.where("kind > 0").select(F.col("b").alias("doc_id"), F.col("a").alias("label"), "kind"), f"{folder}/meets")
    if not meets.isEmpty():
        links = links.unionByName(written(_meet(labelled, meets, full_sets, folder, percent, similarity), f"{folder}/links-all"))

    found_components = written(components(links, f"{folder}/components"), f"{folder}/component")
    classed = reps.join(found_components.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep")).drop("component")
    out = rows.select("doc_id", "n_shingles", "k1", "k2").join(classed, ["k1", "k2", "n_shingles"], "left")
    component: Column = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of docs (all columns) of which one document of each group of near duplicates stays: the one of smallest doc_id.

    Rows without doc_id are grouped like others and come last; equal texts among them are one document. Of rows with one doc_id (or none) and one
    text a single one stays; rows with one doc_id and different texts stay or go together. Null, empty and blank texts are nothing's
    duplicate, so one row for each doc_id stays. Columns may have any names; empty tables give empty ones.
    """
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    t = F.coalesce(F.col(f"c{names.index(text)}").cast("string"), F.lit(""))
    own = own.withColumn("key", F.coalesce(F.col(f"c{names.index(doc_id)}").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(t), F.lit(NO_ID))))
    marks = near_duplicates(own.select("key", t.alias("text")), k, similarity, doc_id="key")
    gone = marks.where("NOT kept").select(F.col("doc_id").alias("key")).distinct()
    left, digest = own.join(gone, "key", "left_anti"), F.sha2(t, 256).alias("digest")
    again = own.select("key", digest).join(gone, "key", "left_anti").groupBy("key", "digest").count().where("count > 1").select("key", "digest")
    again = written(again, f"{work_folder(docs.sparkSession, 'deduplicated')}/again")
    if not again.isEmpty():  # only these rows are brought together
        left = left.select("*", digest)
        left = left.join(again, ["key", "digest"], "left_anti").unionByName(left.join(again, ["key", "digest"], "left_semi").dropDuplicates(["key", "digest"]))
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _meet(labelled: DataFrame, meets: DataFrame, full_sets, folder: str, percent: int, similarity: float) -> DataFrame:
    """Links of each class in meets with all classes of the label that it is put against, and of the classes of a cell with each other,
    block against block."""
    spot = lambda c: F.pmod(F.xxhash64("doc_id"), F.col(c))
    yes, no = F.lit(True), F.lit(False)
    # a class and a label: (block of classes, block of the label)
    outers = meets.where("kind = 1").select("doc_id", F.col("label").alias("main"))
    inners = labelled.select("doc_id", F.col("label").alias("main")).join(outers.select("main").distinct(), "main", "left_semi")
    n = outers.groupBy("main").agg(F.count("*").alias("o")).join(inners.groupBy("main").agg(F.count("*").alias("i")), "main")
    n = n.select("main", F.ceil(F.col("o") / BLOCK).alias("ob"), F.ceil(F.col("i") / BLOCK).alias("ib"))
    key = F.xxhash64(F.lit("label"), "main", "o", "i").alias("cell")
    outer = outers.join(n, "main").select("doc_id", yes.alias("low"), no.alias("high"), F.explode(F.expr("sequence(0L, ib - 1)")).alias("i"), spot("ob").alias("o"), "main").select("doc_id", "low", "high", key)
    inner = inners.join(n, "main").select("doc_id", no.alias("low"), yes.alias("high"), F.explode(F.expr("sequence(0L, ob - 1)")).alias("o"), spot("ib").alias("i"), "main").select("doc_id", "low", "high", key)
    # a cell: (block, block that isn't smaller)
    members = meets.where("kind = 2").select("doc_id", F.col("label").alias("main"))
    size = members.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))
    each = members.join(size, "main").select("doc_id", "main", spot("nb").alias("own"), F.explode(F.expr("sequence(0L, nb - 1)")).alias("other"))
    within = each.select("doc_id", (F.col("own") <= F.col("other")).alias("low"), (F.col("own") >= F.col("other")).alias("high"), F.xxhash64(F.lit("cell"), "main", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    rows = outer.unionByName(inner).unionByName(within)
    sets = written(full_sets(outers.select("doc_id").union(inners.select("doc_id")).union(members.select("doc_id")).distinct()), f"{folder}/sets-all").dropDuplicates(["doc_id", "items"])
    full = rows.join(labelled.select("doc_id", "label", "sketch"), "doc_id").join(sets, "doc_id").repartition("cell").sortWithinPartitions("cell")
    return full.select("cell", "doc_id", "label", "low", "high", "sketch", "items").mapInArrow(_block_links(percent, similarity), "a long, b long")
