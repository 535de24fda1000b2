"""Exact top-k search by inner product, with distributed histogram selection.

Vectors are integers. Queries are written as blocks of bounded size in the shared folder. In each round one job scores all queries: a task holds its
own part of the vectors and takes the blocks one after another. Histograms of the scores are summed over tasks, first over the range that norms
allow and then over the bin that holds the k-th score, until a bin is one value wide; every query's bounds are a written table, from round to
round. Then everything above the k-th score is taken, and of those equal to it the smallest ids, as many as are missing; a task sends no more than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.folders import work_folder, written
from tessera.llm.common import binary_parts, long_array

#: Queries of a block and its bytes at most; scores that a task makes at once; queries in a row of histograms; bytes of vectors that a task holds.
BINS, QUERY_BLOCK, BLOCK_BYTES, SCORED, SLICE, HELD = 1024, 4096, 16 << 20, 1 << 21, 128, 64 << 20
LOWEST = np.iinfo(np.int64).min
BOUNDS = "block int, q long, low long, high long, width long, missing long, fewer boolean"
FOUND = "query_rid long, query_id long, rid long, vec_id long, score long"


def _matrix(lists: pa.Array, dim: int, exact: bool) -> np.ndarray:
    """Rows of integer vectors; shorter ones end in zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim), np.float64 if exact else np.int64)
    rows = np.repeat(np.arange(len(lists)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _table(folder: str, block: int) -> pa.Table:
    """The rows of one block of a written table, by q."""
    store, path = fs.FileSystem.from_uri(folder)
    files = [x.path for x in store.get_file_info(fs.FileSelector(f"{path}/block={block}")) if x.base_name.startswith("part-")]
    parts = []
    for file in sorted(files):
        with store.open_input_file(file) as source:
            parts.append(pq.ParquetFile(source).read())
    return pa.concat_tables(parts).sort_by("q").combine_chunks()


def _numpy(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def _held(batches: Iterator[pa.RecordBatch], dim: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row ids, vector ids and vectors of a task."""
    rids, ids, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, dim), np.float64 if exact else np.int64)]
    for batch in batches:
        rids.append(long_array(batch.column(0)))
        ids.append(long_array(batch.column(1)))
        rows.append(_matrix(batch.column(2), dim, exact))
    return np.concatenate(rids), np.concatenate(ids), np.concatenate(rows)


def _scores(queries: pa.Table, rid: np.ndarray, vectors: np.ndarray, exact: bool) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores (queries x vectors) of one block, by stretches of vectors; a query's own row has the lowest score of all."""
    q, own = _matrix(queries["v"].combine_chunks(), vectors.shape[1], exact), _numpy(queries, "rid")
    order = np.argsort(own)
    step = max(1, SCORED // max(1, len(own)))
    for at in range(0, len(rid), step):
        part = slice(at, at + step)
        s = (q @ vectors[part].T).astype(np.int64)
        where = np.searchsorted(own, rid[part], sorter=order)
        query = order[np.minimum(where, len(own) - 1)]
        hit = (where < len(own)) & (own[query] == rid[part])
        s[query[hit], np.flatnonzero(hit)] = LOWEST
        yield part, s


def _histogram(folder: str, bounds: str, blocks: list[int], dim: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, _, vectors = _held(batches, dim, exact)
        for block in blocks if len(rid) else ():
            limits = _table(bounds, block)
            low, high, width = (_numpy(limits, c) for c in ("low", "high", "width"))
            total = np.zeros((len(low), BINS), np.int32)
            for _, s in _scores(_table(f"{folder}/queries", block), rid, vectors, exact):
                rows, columns = np.nonzero((s >= low[:, None]) & (s < high[:, None]))
                total += np.bincount(rows * BINS + (s[rows, columns] - low[rows]) // width[rows], minlength=total.size).reshape(total.shape)
            for at in range(0, len(low), SLICE):  # only bins that have scores are sent
                own = total[at : at + SLICE].ravel()
                hit = np.flatnonzero(own)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at], pa.int64()), pa.array([np.concatenate([hit.astype(np.int32), own[hit]]).tobytes()], pa.binary())], names=["block", "slice", "counts"])

    return run


def _narrowed(bounds: str):
    """The bounds of the bin that holds each query's k-th score, counted from the top; fewer tells that there aren't k scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            data, at = binary_parts(batch.column(2))
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                bins, counts = data[at[i] : at[i + 1]].view(np.int32).reshape(2, -1)
                if key not in sums:
                    sums[key] = np.zeros(SLICE * BINS, np.int64)
                sums[key][bins] += counts
        for (block, first), counts in sums.items():
            limits = _table(bounds, block).slice(first, SLICE)
            counts = counts.reshape(SLICE, BINS)[: len(limits)]
            low, high, width, missing = (_numpy(limits, c) for c in ("low", "high", "width", "missing"))
            above = np.cumsum(counts[:, ::-1], axis=1)
            fewer = _numpy(limits, "fewer") | (above[:, -1] < missing)
            k = np.argmax(above >= missing[:, None], axis=1)
            before = np.where(k > 0, above[np.arange(len(k)), np.maximum(k - 1, 0)], 0)
            begin = np.where(fewer, low, low + (BINS - 1 - k) * width)
            columns = [begin, np.where(fewer, begin, np.minimum(high, begin + width)), -(-width // BINS), np.where(fewer, missing, missing - before)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(k), pa.int32()), pa.array(first + np.arange(len(k))), *map(pa.array, columns), pa.array(fewer)], names=[x.split()[0] for x in BOUNDS.split(", ")])

    return run


def _select(folder: str, bounds: str, blocks: list[int], dim: int, exact: bool):
    def out(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=[x.split()[0] for x in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, vec, vectors = _held(batches, dim, exact)
        for block in blocks if len(rid) else ():
            limits, queries = _table(bounds, block), _table(f"{folder}/queries", block)
            own, ids, fewer = _numpy(queries, "rid"), _numpy(queries, "vec_id"), _numpy(limits, "fewer")
            kth, missing = np.where(fewer, LOWEST + 1, _numpy(limits, "low")), np.where(fewer, 0, _numpy(limits, "missing"))
            ties: dict[int, list] = {}
            for part, s in _scores(queries, rid, vectors, exact):
                rows, columns = np.nonzero((s > kth[:, None]) & (s > LOWEST))
                if len(rows):
                    yield out([own[rows], ids[rows], rid[part][columns], vec[part][columns], s[rows, columns]])
                rows, columns = np.nonzero((s == kth[:, None]) & (missing[:, None] > 0))
                for q in np.unique(rows):
                    mine = columns[rows == q]
                    ties[q] = sorted([*ties.get(q, []), *zip(vec[part][mine].tolist(), rid[part][mine].tolist(), strict=True)])[: missing[q]]
            rows = [(int(own[q]), int(ids[q]), r, v, int(kth[q])) for q, found in ties.items() for v, r in found]
            if rows:
                yield out(list(zip(*rows, strict=True)))

    return run


def top_k(vectors: DataFrame, k: int, scale: float, query_mod: int, vec_id: str = "vec_id", embedding: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: for each row whose id is divisible by query_mod, the k highest of all other rows.

    Components count as floor(scale * x). Rows without id, and vectors that are null or hold null or non-finite components, take no part;
    shorter vectors count as ended with zeros. Ties go to the smaller id. Rows that share an id are rows of their own. Scores
    must fit a long. Other columns are not looked at.
    """
    spark, folder = vectors.sparkSession, work_folder(vectors.sparkSession, "topk")
    x = F.col(embedding).cast("array<double>")
    sound = F.col(vec_id).isNotNull() & x.isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    whole = vectors.where(sound).select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v"))
    base = written(whole, f"{folder}/vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    asks = F.col("vec_id") % query_mod == 0
    facts = base.agg(F.max(F.size("v")).alias("dim"), F.max(squares).alias("norm"), F.max(F.when(asks, squares)).alias("most"), F.count_if(asks).alias("queries"), F.count("*").alias("n")).first()
    if not facts["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, norm = max(1, facts["dim"]), facts["norm"]
    exact, size = norm < 2**52, max(1, min(query_block, BLOCK_BYTES // (8 * dim)))
    blocks = -(-facts["queries"] // size)
    blocks = blocks if blocks == 1 else -(-5 * facts["queries"] // (4 * size))
    block = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")
    queries = base.where(asks).withColumn("block", block).withColumn("reach", F.ceil(F.sqrt(squares * norm) * (1 + 1e-9)).cast("long") + 1)
    queries = queries.withColumn("q", F.row_number().over(Window.partitionBy("block").orderBy("rid")).cast("long") - 1)  # some `size` rows a block
    queries.select("rid", "vec_id", "v", "q", "block", "reach").write.partitionBy("block").parquet(f"{folder}/queries")
    asked = spark.read.parquet(f"{folder}/queries").select("block", "q", "reach")
    sizes = sorted((r.block, r["count"]) for r in asked.groupBy("block").count().collect())  # two numbers for each block that has queries
    blocks = [block for block, _ in sizes]
    start = asked.select("block", "q", (-F.col("reach")).alias("low"), (F.col("reach") + 1).alias("high"), F.ceil((2 * F.col("reach") + 1) / BINS).cast("long").alias("width"), F.lit(k).cast("long").alias("missing"), F.lit(False).alias("fewer"))
    start.write.partitionBy("block").parquet(f"{folder}/bounds-0")
    none = spark.createDataFrame(sizes, "block int, n long").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLICE).cast("long"))).alias("slice"), F.lit(b"").alias("counts"))  # also queries without a score have bounds
    tasks = max(spark.sparkContext.defaultParallelism, -(-facts["n"] * dim * 8 // HELD))
    dealt = base.repartition(tasks, "rid").persist(StorageLevel.DISK_ONLY)
    span, rounds = 2 * (int((facts["most"] * norm) ** 0.5 * (1 + 1e-9)) + 3) + 1, 0
    while span > 1:
        bounds = f"{folder}/bounds-{rounds}"
        counts = dealt.mapInArrow(_histogram(folder, bounds, blocks, dim, exact), "block int, slice long, counts binary").union(none).repartition("block", "slice")
        counts.mapInArrow(_narrowed(bounds), BOUNDS).write.partitionBy("block").parquet(f"{folder}/bounds-{rounds + 1}")
        span, rounds = -(-span // BINS), rounds + 1
    found = written(dealt.mapInArrow(_select(folder, f"{folder}/bounds-{rounds}", blocks, dim, exact), FOUND), f"{folder}/found")
    dealt.unpersist()
    order = Window.partitionBy("query_rid").orderBy(F.col("score").desc(), "vec_id", "rid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
