"""Running values over a whole order, by parts of a range: each part runs on its own, and a carry from the parts before it is put in afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.folders import work_folder, written


def in_parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in parts of a range, written: p_ numbers the parts in order, i_ the rows of a part in order."""
    folder = work_folder(rows.sparkSession, "scan")
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("i_", F.monotonically_increasing_id())
    return written(sorted_, f"{folder}/parts").withColumn("p_", F.shiftright("i_", 33)).withColumn("i_", F.col("i_").bitwiseAND(F.lit((1 << 33) - 1)))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rank_, from 0, in order."""
    parts = in_parts(rows, list(order))
    before, at = [], 0
    for r in parts.groupBy("p_").count().orderBy("p_").collect():  # a row for each part
        before.append((r["p_"], at))
        at += r["count"]
    starts = rows.sparkSession.createDataFrame(before, "p_ long, before_ long")
    return parts.join(F.broadcast(starts), "p_").withColumn("rank_", F.col("before_") + F.col("i_")).drop("p_", "i_", "before_")


def since_last(rows: DataFrame, event: Column, order: str, by: str | None = None) -> DataFrame:
    """rows with so_far, the events up to each row, and since, the rows after the last event (all rows, before the first); by starts both anew.

    A segmented prefix scan. A part of the range ends with a carry: its last segment, and so_far and since there. Carries combine from left to right: one of another segment stands for
    itself; else events add up, and rows since the last event add up unless there was an event. The driver combines one row a part; then the rows of a part that
    continue the segment before it take the carry in. However long a segment is, no task holds more than its part. Rows of equal order come in any order.
    """
    segment = F.col(by) if by else F.lit(0)
    parts = in_parts(rows.withColumn("event_", F.coalesce(event, F.lit(False))).withColumn("by_", segment), ["by_", order])
    upto = Window.partitionBy("p_", "by_").orderBy("i_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("event_"), F.col("i_"))).over(upto)
    own = parts.withColumn("so_far", F.sum(F.col("event_").cast("long")).over(upto)).withColumn("since", F.coalesce(F.col("i_") - last, F.count("*").over(upto)))
    ends = own.groupBy("p_").agg(F.max_by(F.struct("by_", "so_far", "since"), "i_").alias("end")).orderBy("p_").select("p_", "end.*").collect()  # a row for each part
    carries, carry = [], None
    for r in ends:
        if carry is not None:
            carries.append((r.p_, *carry))
        goes_on = carry is not None and carry[0] == r.by_
        carry = (r.by_, carry[1] + r.so_far, r.since if r.so_far else carry[2] + r.since) if goes_on else (r.by_, r.so_far, r.since)
    kind = parts.schema["by_"].dataType.simpleString()
    known = rows.sparkSession.createDataFrame(carries, f"p_ long, seg_ {kind}, had_ long, tail_ long")
    joined = own.join(F.broadcast(known), "p_", "left")
    goes_on = F.col("had_").isNotNull() & F.col("by_").eqNullSafe(F.col("seg_"))
    joined = joined.withColumn("since", F.when(goes_on & (F.col("so_far") == 0), F.col("since") + F.col("tail_")).otherwise(F.col("since")))
    joined = joined.withColumn("so_far", F.when(goes_on, F.col("so_far") + F.col("had_")).otherwise(F.col("so_far")))
    return joined.select(*rows.columns, "so_far", "since")
