"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For each conversation and each of its participants, the whole dialogue is rendered once with
that participant as ``assistant`` and every other speaker as a ``user`` whose name is written
before the words.  Turns of the system role stay ``system`` and are nobody's perspective.
Only the assistant's own words carry loss: ``mask_start``/``mask_end`` bound them (code
points, end exclusive) in the rendered ``segment``; they are null in all other turns.

The result has one row for each perspective and turn, to be concatenated in order of ``turn``, then
``speaker``, then ``segment`` (turn numbers may repeat; rows equal in all three are alike).  A
dialogue of any length thus never has to fit into one task: turns join their conversation's
distinct participants, and a hot conversation's turns can be split by the skew join.

Edge cases: a null or empty role speaks as ``unknown``; a null text is empty; null conversation
or turn numbers are kept and form a conversation of their own; repeated rows are rendered as
often as they occur; a conversation of system turns only has no participant and no rows;
marker strings inside a text or a speaker's written name are defused by a space; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SYSTEM = "system"


def defused(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame) -> DataFrame:
    speaker = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown"))
    said = turns.select("conv_id", "turn", speaker.alias("speaker"), defused(F.coalesce("text", F.lit(""))).alias("content"))
    parts = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.when(F.col("role") == "user", F.concat(defused(F.col("speaker")), F.lit(": "))).otherwise(""))
    start = F.when(F.col("train"), F.length("head")).cast("long")
    return (
        said.join(parts, F.col("conv_id").eqNullSafe(F.col("of")))
        .select("conv_id", "perspective", "turn", "speaker", role.alias("role"), own.alias("train"), "content")
        .withColumn("head", head)
        .select(
            "conv_id", "perspective", "turn", "speaker", "role", "train",
            F.concat("head", "content", F.lit("<|end|>\n")).alias("segment"),
            start.alias("mask_start"),
            (start + F.length("content")).cast("long").alias("mask_end"),
        )
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations
), parts AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), both_ AS (
  SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.content, s.speaker = p.perspective AS train,
         CASE WHEN s.speaker = 'system' THEN 'system' WHEN s.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN parts p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), headed AS (
  SELECT *, '<|' || role || '|>' || chr(10) || CASE WHEN role = 'user' THEN replace(speaker, '<|', '< |') || ': ' ELSE '' END AS head FROM both_
)
SELECT conv_id, perspective, turn, speaker, role, train,
       head || content || '<|end|>' || chr(10) AS segment,
       CASE WHEN train THEN length(head) END::BIGINT AS mask_start,
       CASE WHEN train THEN length(head) + length(content) END::BIGINT AS mask_end
FROM headed
"""
