"""Multi-party perspective rotation of dialogues.

For every participant of a conversation (a role other than `system`), the whole dialogue is
rendered with that participant as assistant and all others as named users; system turns stay
system messages. The result has one row for each perspective and turn: the rendered piece, its
place (start, end, in characters) in that perspective's text, and, on the participant's own
turns, the span that a loss covers (the message and its end mark). Joining the pieces by
position gives the text.

All of it is DataFrame operations. A conversation may hold a third of all rows, so no task orders
a whole one: equal rows are counted first, places are sums over spans of BLOCK * BLOCK turn
numbers, over the blocks of BLOCK turn numbers in a span, over the turns of a block (each dealt
to PARTS parts by a hash of the text), and at last over the few messages of one part.

Cases: rows whose conv_id is null form one conversation; a null role is the participant
`unknown`, a null text an empty message; a null turn comes first; messages of
equal turn numbers are ordered by a hash of the text, role and text; equal rows are all kept; a dialogue of system turns alone has no
perspective and gives no row; control marks within texts and names are broken up, so texts
cannot forge a turn; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import salted_join, stored

#: The marks of the rendered format.
START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM, UNKNOWN = "system", "unknown"
#: Turn numbers in a block, and parts of a turn number.
BLOCK, PARTS = 64, 256
#: Stands for a null turn while rows are joined.
FIRST = -(1 << 62)


def safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def rotate(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, perspective, turn, position, speaker, piece, start, end, loss_start, loss_end."""
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("v"), F.col(conv).cast("string")), F.lit("n")).alias("conv"),
        F.col(conv).alias("conv_id"),
        F.coalesce(F.col(turn).cast("long"), F.lit(FIRST)).alias("at"),
        F.coalesce(role, F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(text, F.lit("")).alias("body"),
    )
    head = (
        F.when(F.col("speaker") == SYSTEM, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), safe(F.col("speaker")), F.lit("\n")))
    )
    mine = F.lit(f"{START}assistant\n")
    counted = (
        rows.groupBy("conv", "conv_id", "at", "speaker", "body")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("part", F.pmod(F.xxhash64("body"), F.lit(PARTS)))
        .withColumn("rest", F.length(safe(F.col("body"))).cast("long") + len(END))
        .withColumn("other_head", F.length(head).cast("long"))
    )
    counted = stored(rows.sparkSession, counted, "turns")
    own = F.col("speaker") == F.col("perspective")
    size = F.col("rest") + F.when(own, F.length(mine)).otherwise(F.col("other_head"))
    # sums of lengths alone, so that texts don't move; one small row a speaker and part
    slim = counted.groupBy("conv", "at", "part", "speaker", "other_head").agg(F.sum(F.col("rest") * F.col("copies")).alias("rests"), F.sum("copies").alias("copies"))
    people = counted.filter(F.col("speaker") != SYSTEM).select("conv", F.col("speaker").alias("perspective")).distinct()
    keys = ["conv", "perspective", "span", "block", "at", "part"]
    each_size = F.col("rests") + F.col("copies") * F.when(own, F.length(mine)).otherwise(F.col("other_head"))
    parts = (
        salted_join(slim, people, ["conv"], "inner")
        .withColumn("span", F.floor(F.col("at") / (BLOCK * BLOCK)))
        .withColumn("block", F.floor(F.col("at") / BLOCK))
        .groupBy(*keys)
        .agg(F.sum(each_size).alias("size"), F.sum("copies").alias("copies"))
    )
    parts = stored(rows.sparkSession, parts, "parts")
    offsets = None
    for depth, order in ((2, ["span"]), (3, ["block"]), (4, ["at", "part"])):
        level = keys[:depth] + order
        sums = parts if depth == 4 else parts.groupBy(*level).agg(F.sum("size").alias("size"), F.sum("copies").alias("copies"))
        before = Window.partitionBy(*keys[:depth]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*level, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_{depth}") for c in ("size", "copies")))
        offsets = sums if offsets is None else sums.join(offsets, keys[:depth])
    start, place = (F.col(f"{c}_2") + F.col(f"{c}_3") + F.col(f"{c}_4") for c in ("size", "copies"))
    offsets = offsets.select("conv", "at", "part", "perspective", start.alias("start"), place.alias("place"))
    # the texts move once, to the few rows of their part; perspectives come after
    before = Window.partitionBy("conv", "at", "part", "perspective").orderBy("speaker", "body").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(offsets, ["conv", "at", "part"]).withColumn("size", size)
    placed = placed.withColumn("start", F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0)))
    placed = placed.withColumn("place", F.col("place") + F.coalesce(F.sum("copies").over(before), F.lit(0)))
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    each = each.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).withColumn("position", F.col("place") + F.col("copy"))
    head = F.when(own, mine).otherwise(head)
    each = each.withColumn("piece", F.concat(head, safe(F.col("body")), F.lit(END))).withColumn("head", head)
    return each.select(
        "conv_id",
        "perspective",
        F.when(F.col("at") != FIRST, F.col("at")).alias("turn"),
        "position",
        "speaker",
        "piece",
        "start",
        (F.col("start") + F.col("size")).alias("end"),
        F.when(own, F.col("start") + F.length("head")).alias("loss_start"),
        F.when(own, F.col("start") + F.col("size") - 1).alias("loss_end"),
    )
