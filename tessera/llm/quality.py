"""Document quality: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of every whole text are gathered once. Random Fourier features approximate a Gaussian kernel over the standardised statistics; each
partition of labelled rows sums its part of the normal equations by fold, the sums are added up, and one small system is solved for all folds
and one without each fold. Rows are calibrated by scores of the solution that has not seen their fold: positives and rows are counted in bins of
the raw score, and pooling adjacent violators over the bins gives the map from raw scores to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.folders import work_folder, written
from tessera.llm import words
from tessera.llm.common import chunks, text_bytes

#: Bytes of text that a task works on at once; its arrays take some sixty times that.
SLICE_BYTES = 2 << 20
FEATURES, RIDGE, BINS = 256, 1e-3, 1024
#: Raw scores in this range are told apart by the calibration.
RANGE = (-0.5, 1.5)
THRESHOLD = 0.3
#: Folds of doc_id; fold 0 is held out.
FOLDS = 5
#: Fixed sets of bytes whose shares are statistics.
BYTE_SETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "|", "#$%&*@^~=+<>\\_/", ";:!?'\"()[]{}-")
STATISTICS = len(BYTE_SETS) + 15


def tallies(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text what adds up over pieces: counts of bytes; words, their lengths and squares, odd ends, short and long ones, newlines; and
    the hash and the text of every word."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    starts, ends, before = words.split(data, offsets)
    owner, length = np.repeat(np.arange(n), np.diff(before)), (ends - starts).astype(np.float64)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd = ~np.isin(last, np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,", np.uint8)) & (last < 128)
    sums = [np.diff(before), *(np.bincount(owner, x, n) for x in (length, length**2, odd, length == 1, length >= 15)), counts[:, 10]]
    return counts, np.stack(sums, 1).astype(np.float64), words.hashes(data, starts, ends, lower=True), owner


def finished(counts: np.ndarray, sums: np.ndarray, distinct: np.ndarray, most: np.ndarray, once: np.ndarray) -> np.ndarray:
    """Statistics of each text from its tallies, its distinct words, how often the commonest occurs, and how many occur once."""
    size = counts.sum(1)
    share = counts / np.maximum(size, 1)[:, None]
    many, total, squares, odd, short, long, newlines = sums.T
    per = np.maximum(many, 1)
    mean, lines = total / per, newlines + 1
    out = [share[:, np.frombuffer(s.encode(), np.uint8)].sum(1) for s in BYTE_SETS]
    out += [share[:, 128:].sum(1), -(share * np.log2(np.maximum(share, 1e-12))).sum(1), share.max(1), np.log1p(size)]
    out += [np.log1p(many), mean, np.sqrt(np.maximum(squares / per - mean**2, 0)), distinct / per, most / per, once / per]
    out += [odd / per, short / per, long / per, np.log1p(size / lines), many / lines / 100]
    return np.stack(out, 1).astype(np.float32)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of each text, as rows of float32. A text longer than a slice is taken in pieces."""
    n = len(offsets) - 1
    if n == 1 and len(data) > SLICE_BYTES:
        return _long_statistics(data)
    counts, sums, h, owner = tallies(data, offsets)
    order = np.lexsort((h, owner))
    h, o = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    begins = np.flatnonzero(new)
    runs = np.diff(np.append(begins, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, o[begins], runs)
    return finished(counts, sums, np.bincount(o[begins], minlength=n), most, np.bincount(o[begins], runs == 1, n))


def _long_statistics(data: np.ndarray) -> np.ndarray:
    counts, sums, known, times = 0.0, 0.0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for piece, _ in words.pieces(data, SLICE_BYTES):
        c, s, h, _ = tallies(piece, np.array([0, len(piece)]))
        counts, sums = counts + c, sums + s
        own, n = np.unique(h, return_counts=True)
        known, place = np.unique(np.append(known, own), return_inverse=True)
        times = np.bincount(place, np.append(times, n), len(known)).astype(np.int64)
    return finished(counts, sums, np.array([len(known)]), np.array([times.max(initial=0)]), np.array([(times == 1).sum()]))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in chunks(batch, "raw", SLICE_BYTES):
            x = statistics(data, offsets)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], "stats"])


@dataclass(frozen=True)
class Model:
    """centre, scale, weights, phase, solution: the ridge scores; at, value: the calibration's points."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    solution: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        f = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weights + self.phase)
        return np.concatenate([f, np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.solution

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1), 6)


def pooled(positives: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: centre and value of each block, over bins that have rows."""
    blocks: list[list[float]] = []
    for p, n, x in zip(positives, rows, at, strict=True):
        if n:
            blocks.append([p, n, x * n])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                p2, n2, x2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + n2, blocks[-1][2] + x2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, STATISTICS)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sum and sum of squares of each statistic over a partition."""
    n, x, xx = 0, np.zeros(STATISTICS), np.zeros(STATISTICS)
    for batch in batches:
        own = _rows(batch.column(0))
        n, x, xx = n + len(own), x + own.sum(0), xx + (own**2).sum(0)
    columns = [np.arange(STATISTICS, dtype=np.int32), np.full(STATISTICS, n, np.int64), x, xx]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "n", "x", "xx"])


def fold():
    """crc32 of doc_id as text, by 5; rows without doc_id are in fold 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(1)).cast("long")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 11) -> Model:
    """Model from the labelled rows outside fold 0. Without any of them every score is 0.5."""
    rng = np.random.default_rng(seed)
    moments = stats.select("stats").mapInArrow(_moments, "i int, n long, x double, xx double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx"))
    centre, scale = np.zeros(STATISTICS), np.ones(STATISTICS)
    for r in moments.collect():  # a row for each statistic
        if r.n:
            centre[r.i] = r.x / r.n
            spread = max(0.0, r.xx / r.n - centre[r.i] ** 2) ** 0.5
            scale[r.i] = spread if spread > 1e-6 * (1 + abs(centre[r.i])) else 1.0
    weights, phase = rng.normal(0, (1 / STATISTICS) ** 0.5, (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    model = Model(centre, scale, weights, phase, np.append(np.zeros(FEATURES), 0.5), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    known = stats.join(known, "doc_id").select("doc_id", "stats", "y", fold().alias("fold")).where("fold <> 0")
    width = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                f, own = model.features(_rows(part.column(0))), part.column(2).to_numpy(zero_copy_only=False)
                y = part.column(1).to_numpy(zero_copy_only=False)
                for k in np.unique(own).tolist():
                    x = f[own == k]
                    a[k] = a.get(k, 0) + x.T @ np.concatenate([x, y[own == k, None]], 1)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(list(a), pa.int64()), pa.array([x.tobytes() for x in a.values()], pa.binary())], names=["fold", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a[k] = a.get(k, 0) + np.frombuffer(x.as_py())
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(list(a), pa.int64()), pa.array([x.tobytes() for x in a.values()], pa.binary())], names=["fold", "sums"])

    def solved(a: np.ndarray) -> np.ndarray:
        penalty = RIDGE * max(1.0, a[-1, width - 1]) * np.eye(width)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(a[:, :width] + penalty, a[:, width])

    parts = known.select("stats", "y", "fold").mapInArrow(sums, "fold long, sums binary")
    found = {r.fold: np.frombuffer(r.sums).reshape(width, width + 1) for r in parts.repartition(FOLDS, "fold").mapInArrow(total, "fold long, sums binary").collect()}  # a row for each fold
    if not found:
        return model
    a = sum(found.values())
    without = {k: Model(centre, scale, weights, phase, solved(a - x), model.at, model.value) for k, x in found.items()} if len(found) > 1 else {k: model for k in found}
    model = Model(centre, scale, weights, phase, solved(a), model.at, model.value)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own, raw = _rows(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows)
            for k in np.unique(own).tolist():
                raw[own == k] = without[k].raw(x[own == k])
            where = np.clip((raw - RANGE[0]) / (RANGE[1] - RANGE[0]) * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(where), batch.column(1)], names=["bin", "y"])

    bins = known.select("stats", "y", "fold").mapInArrow(scored, "bin long, y double")
    positives, rows = np.zeros(BINS), np.zeros(BINS)
    for r in bins.groupBy("bin").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect():  # BINS rows at most
        positives[r.bin], rows[r.bin] = r.p, r.n
    if not rows.sum():
        return model
    at, value = pooled(positives, rows, RANGE[0] + (np.arange(BINS) + 0.5) * (RANGE[1] - RANGE[0]) / BINS)
    return Model(centre, scale, weights, phase, model.solution, at, value)


def gather(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    kind = "doc_id long, stats array<float>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("raw")).mapInArrow(_gather, kind)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Only the whole text counts; null texts are empty ones and get a score too. labels has doc_id and the label, 0 or 1; other
    values, and documents without a label, don't take part in the fit. Rows without doc_id are scored, not held out. Other columns
    of docs are not looked at. A document that labels name twice counts twice in the fit.
    """
    stats = written(gather(docs, text, doc_id), f"{work_folder(docs.sparkSession, 'quality')}/stats")
    return predicted(stats, fit(stats, labels, label), threshold)


def predicted(stats: DataFrame, model: Model, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(_rows(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", (fold() == 0).alias("held_out"), "stats").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of docs (all columns) whose score is at least threshold, scored in place; the fit's pass reads texts only.

    Null and empty texts have a score like others, so they stay or go together; repeated rows too. Rows without doc_id are scored, but don't
    take part in the fit. A document that labels name twice counts twice in the fit. Without usable labels every score is 0.5 and all rows
    stay if the threshold is at most that. Columns may have any names; empty tables give empty ones.
    """
    stats = written(gather(docs, text, doc_id), f"{work_folder(docs.sparkSession, 'quality')}/stats")
    model, names = fit(stats, labels), docs.columns
    own = docs.select(text_bytes(text).alias("raw"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "raw", SLICE_BYTES):
                keep = model.score(statistics(data, offsets).astype(np.float64)) >= threshold
                yield part.select(range(1, part.num_columns)).filter(pa.array(keep))

    kept = own.mapInArrow(run, T.StructType(own.schema.fields[1:]))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
