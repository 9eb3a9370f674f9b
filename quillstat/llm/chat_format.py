"""Chat formatting by perspective rotation: every participant takes the assistant's part once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _header(speaker: Column, view: Column) -> Column:
    """The viewpoint's own turns are the assistant's; others are users by name."""
    return F.when(speaker == view, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), speaker, F.lit("\n")))


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    context_roles: tuple[str, ...] = ("system",),
) -> DataFrame:
    """Each dialogue from the side of each participant: one row per (conversation, perspective, turn).

    Participants are a conversation's distinct roles but for ``context_roles``, whose turns appear in every
    perspective as system turns. ``segment`` is the rendered turn; segments in turn order make the whole rendering,
    in which this one covers characters ``start`` (included) to ``stop``. ``mask_start`` to ``mask_stop`` is what
    trains (the text and closing mark of the assistant's turns) and null elsewhere. So no conversation, however
    long, has to fit in one row or task: turns are dealt by ranges and offsets are sums over ranges.

    Null roles count as ``unknown``, null texts as empty, a null turn comes first and a null conversation is one of
    its own, apart from one whose id is empty. Turns with the same number go by role, then text; turns equal in all
    three, and rows repeated in all columns, are all rendered, in any order. A text of any length is one segment.
    Other columns are ignored, whatever their names; an empty table gives no rows. A conversation with a large share
    of all turns is spread over the ranges that hold it. Column functions only.
    """
    who = F.coalesce(F.col(role_col), F.lit("unknown"))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), who.alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    rows = rows.withColumns({"lost": F.col("conv_id").isNull(), "conv": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))})
    conv = ["lost", "conv"]
    pieces, _ = common.ranged(rows, [*conv, "turn", "speaker", "text"], "turns")
    views = pieces.filter(~F.col("speaker").isin(*context_roles)).select(*conv, F.col("speaker").alias("perspective")).distinct()
    where = pieces.select(*conv, "__piece").distinct()
    shown = pieces.join(where.join(views, conv), [*conv, "__piece"])
    head = F.when(F.col("speaker").isin(*context_roles), F.concat(F.lit(f"{OPEN}system\n"))).otherwise(_header(F.col("speaker"), F.col("perspective")))
    shown = shown.withColumn("head", head)
    shown = shown.withColumn("segment", F.concat("head", "text", F.lit(CLOSE))).withColumn("size", F.length("segment").cast("bigint"))
    shown = common.bucketed_running(shown, [*conv, "perspective"], "__piece", ["turn", "speaker", "text"], {"start": "size"})
    train = (F.col("speaker") == F.col("perspective")) & ~F.col("speaker").isin(*context_roles)
    return shown.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "segment",
        "start",
        (F.col("start") + F.col("size")).alias("stop"),
        F.when(train, F.col("start") + F.length("head")).alias("mask_start"),
        F.when(train, F.col("start") + F.col("size") - 1).alias("mask_stop"),
    )


def op8_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    """All conversations from every participant's side: see rotate_perspectives."""
    return rotate_perspectives(common.table(spark, sf_dir, "conversations"))


OP8_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (
  SELECT t.*, perspective,
         CASE WHEN speaker = 'system' THEN concat('<|im_start|>system', chr(10)) WHEN speaker = perspective THEN concat('<|im_start|>assistant', chr(10))
              ELSE concat('<|im_start|>user name=', speaker, chr(10)) END AS head
  FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
g AS (SELECT *, concat(head, text, '<|im_end|>', chr(10)) AS segment FROM s),
o AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop FROM g)
SELECT conv_id, perspective, turn, speaker, segment, stop - length(segment) AS start, stop,
       CASE WHEN speaker = perspective THEN stop - length(segment) + length(head) END AS mask_start,
       CASE WHEN speaker = perspective THEN stop - 1 END AS mask_stop
FROM o
"""
