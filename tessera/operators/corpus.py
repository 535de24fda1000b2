"""Corpus curation: splits, samples, decontamination, exact and near duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.folders import work_folder, written
from tessera.functions import hashing, rust, text
from tessera.operators import graph

PERMUTATIONS = 128
#: Bands and rows a band for a similarity of 0.7 with 128 permutations, false positives and negatives weighing the same.
BANDS, ROWS = 14, 9
PRIME = 2**31 - 1
#: Rows of a component that one task settles in order, and rounds in which larger ones must be settled.
GIANT, MOST_ROUNDS = 1_000_000, 100_000


def split(files: DataFrame, fraction: float = 0.15, rate: float = 0.5) -> DataFrame:
    """files (path, content) with bucket, held_out and fim_mode: null where a file stays as it is, as held-out files and all but .rs files do."""
    out = files.withColumn("bucket", hashing.path_hash(F.col("path")))
    out = out.withColumn("held_out", hashing.held_out(F.col("bucket"), fraction))
    chosen = ~F.col("held_out") & F.col("path").endswith(".rs") & hashing.fim_chosen(F.col("bucket"), rate)
    return out.withColumn("fim_mode", F.when(chosen, hashing.fim_mode(F.col("bucket"))))


def samples(files: DataFrame, fraction: float = 0.15, rate: float = 0.5, structured: bool = False) -> DataFrame:
    """Training samples of files that are not held out: path, training_content. With structured, the middle of a rewritten file is its largest
    top-level item, where it has one, instead of the middle third."""
    own = split(files, fraction, rate).where("NOT held_out")
    plain = text.file_sample(F.col("path"), F.col("content"))
    span = rust.middle(plain) if structured else None
    return own.select("path", F.when(F.col("fim_mode").isNull(), plain).otherwise(text.fim(plain, F.col("fim_mode"), span)).alias("training_content"))


def held_out_samples(files: DataFrame, fraction: float = 0.15) -> DataFrame:
    """The other side of samples: path, training_content of held-out files, never rewritten."""
    own = split(files, fraction, 0.0).where("held_out")
    return own.select("path", text.file_sample(F.col("path"), F.col("content")).alias("training_content"))


def both_sides(files: DataFrame, fraction: float = 0.15, rate: float = 0.5) -> DataFrame:
    """held_out, path, training_content of all files, from one look at each: what samples and held_out_samples give."""
    plain, mode = text.file_sample(F.col("path"), F.col("content")), F.col("fim_mode")
    return split(files, fraction, rate).select("held_out", "path", F.when(mode.isNull(), plain).otherwise(text.fim(plain, mode)).alias("training_content"))


def merged(changes: DataFrame) -> DataFrame:
    """Changes with a time of merging."""
    return changes.where(F.coalesce(F.col("merged_at").cast("string"), F.lit("")) != "")


def change_samples(changes: DataFrame, least: int = 40) -> DataFrame:
    """number, training_content of changes (number, title, body, changed_files) whose description, without what the template put there, has at
    least so many characters."""
    own = changes.withColumn("body", text.strip_template(F.coalesce("body", F.lit("")))).where(F.char_length("body") >= least)
    return own.select("number", text.pr_sample(F.col("number"), F.col("title"), F.col("body"), F.col("changed_files")).alias("training_content"))


def decontaminated_commits(commits: DataFrame, fraction: float = 0.15) -> DataFrame:
    """commits (touched: array of paths, ...) none of whose paths is held out."""
    return commits.where(~F.exists("touched", lambda p: hashing.held_out(hashing.path_hash(p), fraction)))


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; later ones go."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def shingles(content: str, size: int = 5, stride: int = 5) -> list[str]:
    return [content[i : i + size] for i in range(0, max(1, len(content) - size), stride)]


def _bands(stride: int):
    rng = np.random.default_rng(7)
    a, b = rng.integers(1, PRIME, PERMUTATIONS, dtype=np.int64), rng.integers(0, PRIME, PERMUTATIONS, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for batch in batches:
            out = []
            for content in batch["content"].fillna(""):
                codes = np.fromiter({zlib.crc32(s.encode("utf-8", "replace")) % PRIME for s in shingles(content, stride=stride)}, np.int64)
                least = np.full(PERMUTATIONS, PRIME)
                for i in range(0, len(codes), 4096):
                    least = np.minimum(least, ((codes[i : i + 4096, None] * a + b) % PRIME).min(0))
                out.append([int.from_bytes(least[j * ROWS : (j + 1) * ROWS].tobytes()[:72], "little") % (2**63 - 25) for j in range(BANDS)])
            yield pd.DataFrame({"ord": batch["ord"], "bands": out})

    return run


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that go, of components that come one after another, each by ord: a row goes if a kept one has one of its bands."""
    component, at, own, taken, gone = None, None, [], set(), []

    def settle() -> None:
        if own and taken.isdisjoint(own):
            taken.update(own)
        elif own:
            gone.append(at)
        own.clear()

    for batch in batches:
        for c, o, band, value in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if o != at or c != component:
                settle()
            if c != component:
                taken.clear()
            component, at = c, o
            own.append((band, value))
        yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], names=["ord"])
        gone.clear()
    settle()
    yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], names=["ord"])


def _by_rounds(live: DataFrame, folder: str) -> DataFrame:
    """ord of the rows that go: in each round a row that is the smallest undecided one of all its bands is kept, and the others of its bands go."""
    for i in range(MOST_ROUNDS):
        if live.isEmpty():
            return live.sparkSession.read.schema("ord long").option("recursiveFileLookup", True).parquet(f"{folder}/dropped") if i else live.select("ord")
        heads = written(live.groupBy("band", "value").agg(F.min("ord").alias("head")), f"{folder}/heads-{i}")
        marked = written(live.join(heads, ["band", "value"]), f"{folder}/marked-{i}")
        kept = marked.groupBy("ord").agg(F.bool_and(F.col("ord") == F.col("head")).alias("keep")).where("keep").select(F.col("ord").alias("head"))
        dropped = written(marked.where("ord <> head").join(kept, "head", "left_semi").select("ord").distinct(), f"{folder}/dropped/{i}")
        live = written(live.join(dropped.unionByName(kept.select(F.col("head").alias("ord"))), "ord", "left_anti"), f"{folder}/live-{i}")
    raise RuntimeError(f"rows are undecided after {MOST_ROUNDS} rounds")


def near_duplicate_marks(files: DataFrame, stride: int = 5, giant: int = GIANT) -> DataFrame:
    """ord and keep of each row of files (ord, content): in order, a row goes if it shares a MinHash band with an earlier row that is kept.

    Equal contents are settled first. Rows tied by bands form components (a row and the smallest one of its band are an edge, never all pairs); what happens in one doesn't
    depend on another, so a task settles a component in order, with the bands of the kept rows in memory. Components of more than `giant` rows are settled by
    rounds over the members of bands, which give the same: the first maximal independent set in order of ord. Rounds that don't end are an error.
    """
    folder = work_folder(files.sparkSession, "greedy")
    own = files.select("ord", F.coalesce("content", F.lit("")).alias("content"))
    twins = own.select("ord", F.sha2("content", 256).alias("digest"))
    firsts = written(twins.groupBy("digest").agg(F.min("ord").alias("ord")).select("ord"), f"{folder}/firsts")
    banded = own.join(firsts, "ord", "left_semi").mapInPandas(_bands(stride), "ord long, bands array<long>")
    banded = written(banded.select("ord", F.posexplode("bands").alias("band", "value")), f"{folder}/bands")
    several = written(banded.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("ord").alias("head")).where("n > 1").drop("n"), f"{folder}/several")
    live = written(banded.join(several, ["band", "value"]), f"{folder}/live")
    tied = graph.components(live.select(F.col("ord").alias("a"), F.col("head").alias("b")).where("a <> b"))
    sizes = tied.groupBy("component").agg(F.count("*").alias("n"))
    placed = written(live.join(tied.join(sizes, "component"), F.col("ord") == F.col("node")).select("component", "ord", "band", "value", (F.col("n") > giant).alias("large")), f"{folder}/placed")
    small = placed.where("NOT large").repartition("component").sortWithinPartitions("component", "ord").select("component", "ord", "band", "value")
    gone = written(small.mapInArrow(_in_order, "ord long"), f"{folder}/gone")
    large = placed.where("large").select("ord", "band", "value")
    if not large.isEmpty():
        gone = gone.union(_by_rounds(large, folder))
    state = firsts.join(gone.withColumn("gone", F.lit(True)), "ord", "left").select("ord", F.col("gone").isNull().alias("keep"))
    return twins.join(state, "ord", "left").select("ord", F.coalesce("keep", F.lit(False)).alias("keep"))


def contained(docs: DataFrame, items: DataFrame, words: int = 8) -> DataFrame:
    """doc_id, item_id of items (item_id, text) that docs (doc_id, text) contain verbatim.

    An item's words but for its outer ones are whole words of a text that contains it, so candidates meet by the hash of up to `words` of them;
    only ids and hashes are exploded and joined, and the texts of candidate pairs are looked at once. Items of one or two words have
    no such words: they are few and short by nature, and every text is searched for them.
    """
    tokens = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    hashed = lambda c: F.transform(tokens(c), lambda x: F.xxhash64(x))
    item = items.where(F.col("text").isNotNull()).select("item_id", F.col("text").alias("item"), hashed(F.col("text")).alias("t")).withColumn("inner", F.least(F.size("t") - 2, F.lit(words)))
    keyed = item.where("inner > 0").select("item_id", "item", "inner", F.xxhash64(F.lit("g"), F.slice("t", F.lit(2), F.col("inner"))).alias("key"))
    lengths = sorted(r.inner for r in keyed.select("inner").distinct().collect())  # at most `words` numbers
    own = docs.where(F.col("text").isNotNull()).select("doc_id", hashed(F.col("text")).alias("t"))
    grams = lambda n: F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.xxhash64(F.lit("g"), F.slice("t", i, n)))).otherwise(F.array().cast("array<bigint>"))
    found = docs.select("doc_id").limit(0).withColumn("item_id", F.lit(None).cast(dict(items.dtypes)["item_id"]))
    if lengths:
        keys = own.select("doc_id", F.explode(F.array_distinct(F.concat(*[grams(n) for n in lengths]))).alias("key"))
        pairs = keys.join(keyed.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
        texts = docs.select(F.col("doc_id").alias("d"), "text")
        met = pairs.join(keyed.select("item_id", "item"), "item_id").join(texts, F.col("doc_id").eqNullSafe(F.col("d")))
        found = met.where(F.contains("text", "item")).select("doc_id", "item_id")
    short = item.where("inner <= 0").select("item_id", "item")
    if not short.isEmpty():
        found = found.union(docs.join(short, F.contains(docs["text"], short["item"])).select("doc_id", "item_id"))
    return found.distinct()
