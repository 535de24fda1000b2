"""Writers. All are atomic by Spark's commit protocol; none deletes anything but what it replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.folders import moved, work_folder
from tessera.operators import corpus


def json_lines(rows: DataFrame, path: str, append: bool = False, compress: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("compression", "gzip" if compress else "none").json(path)


def shards(rollouts: DataFrame, path: str) -> None:
    """Gzipped JSON lines by cycle; a cycle that is written again is replaced, others stay."""
    rollouts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy("cycle").json(path)


def parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def document(row: DataFrame, path: str) -> None:
    """One row as a JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)


def text_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks of text (one string column), appended."""
    blocks.write.mode("append").option("lineSep", "\n").text(path)


def replace_origin(real: DataFrame, path: str) -> None:
    """Real tasks are replaced and synthetic ones stay, as partitions of one table."""
    real.withColumn("origin", F.lit("real")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin").parquet(path)


def text_file(lines: DataFrame, path: str) -> None:
    """Lines (one string column) as a single file of that name, in the order of the DataFrame; an older file is replaced. For files that a task can write."""
    place = f"{work_folder(lines.sparkSession, 'file')}/lines"
    lines.coalesce(1).write.text(place)
    moved(lines.sparkSession, f"{place}/part-*", path)


def split_samples(files: DataFrame, train: str, held: str, fraction: float = 0.15, rate: float = 0.5) -> None:
    """Training samples and, beside them, held-out ones, as JSON lines."""
    json_lines(corpus.samples(files, fraction, rate), train)
    json_lines(corpus.held_out_samples(files, fraction), held)


def split_table(files: DataFrame, path: str, fraction: float = 0.15, rate: float = 0.5) -> None:
    """Both sides of the split as JSON lines under path/held_out=false and path/held_out=true, in one pass and one commit; files without a path are on neither side."""
    both = corpus.both_sides(files, fraction, rate).where("held_out IS NOT NULL")
    both.write.mode("overwrite").partitionBy("held_out").json(path)
