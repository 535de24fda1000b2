"""Multi-party perspective rotation of dialogues. DataFrame functions only.

For each participant the dialogue is rendered with that speaker as assistant and the others as named users; the mask has the assistant's
contents. A dialogue can be as long as the table, so it is returned as segments, one for each turn, with their places in the rendering; the
segments in order are the rendering, and the masked ones give the loss mask. Places come from sums over blocks of turns and then within
a block, so no task holds a whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a block.
BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, turn, speaker, chat_role, segment, start, end, mask_start, mask_end; one row for each perspective and turn.

    start and end are code points in the rendering, end exclusive; mask_start and mask_end bound what is learnt, null on others' turns.
    conversations has conv_id, turn, role, text. Null texts are empty; a null role speaks as "unknown" and null conv_ids are one dialogue.
    Turns are ordered by turn (null first), role and text; equal rows follow each other. Other columns are not looked at.
    """
    conv = lambda: F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv")
    cell = lambda: F.coalesce(F.concat(F.lit("v"), F.expr(f"CAST(turn div {block} AS string)")), F.lit("n")).alias("cell")
    speaker = F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker")
    said = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = ["conv", "perspective"]

    def head(own: Column, other: Column) -> Column:
        return F.when(own, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), other, F.lit("\n")))

    # what each block comes to in each perspective, from lengths alone
    light = conversations.select(conv(), cell(), F.expr(f"turn div {block}").alias("block"), speaker, F.char_length(said).alias("size"))
    light = light.groupBy("conv", "cell", "block", "speaker").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    speakers = light.select("conv", F.col("speaker").alias("perspective")).distinct()
    sized = light.join(speakers, "conv")
    per_turn = F.char_length(head(F.col("speaker") == F.col("perspective"), F.col("speaker"))) + len(CLOSE)
    blocks = sized.groupBy(*keys, "cell", "block").agg(F.sum(F.col("size") + F.col("n") * per_turn).alias("total"))
    over_blocks = Window.partitionBy(*keys).orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "cell", F.coalesce(F.sum("total").over(over_blocks), F.lit(0)).alias("base"))
    # the texts move once, to their block; all that follows keeps that partitioning
    turns = conversations.select("conv_id", "turn", speaker, said.alias("text"), conv(), cell()).repartition("conv", "cell")
    turns = turns.groupBy("conv", "cell", "conv_id", "turn", "speaker", "text").agg(F.count("*").alias("copies"))
    rows = turns.join(blocks, ["conv", "cell"]).withColumn("mine", F.col("speaker") == F.col("perspective"))
    rows = rows.withColumn("head", F.char_length(head(F.col("mine"), F.col("speaker")))).withColumn("size", F.col("head") + F.char_length("text") + len(CLOSE))
    within = Window.partitionBy("conv", "cell", "perspective").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0)))
    rows = rows.withColumn("segment", F.concat(head(F.col("mine"), F.col("speaker")), "text", F.lit(CLOSE)))
    rows = rows.select("*", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy")).withColumn("start", F.col("first") + F.col("copy") * F.col("size"))
    learnt = lambda c: F.when(F.col("mine"), c)
    return rows.select(
        "conv_id", "perspective", "turn", "speaker", F.when(F.col("mine"), "assistant").otherwise("user").alias("chat_role"), "segment", "start", (F.col("start") + F.col("size")).alias("end"),
        learnt(F.col("start") + F.col("head")).alias("mask_start"), learnt(F.col("start") + F.col("size") - len(CLOSE)).alias("mask_end"),
    )


def rendered(segments: DataFrame, longest: int = 4096) -> DataFrame:
    """conv_id, perspective, dialogue, mask spans of dialogues of at most so many turns; longer ones stay segments and raise an error here."""
    grouped = segments.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end"))).alias("s"))
    fits = F.when(F.size("s") <= longest, F.col("s")).otherwise(F.raise_error(F.lit("a dialogue is too long to be one row")))
    return grouped.withColumn("s", fits).select("conv_id", "perspective", F.array_join(F.col("s.segment"), "").alias("dialogue"), F.transform(F.filter("s", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"], x["mask_end"])).alias("masks"))
