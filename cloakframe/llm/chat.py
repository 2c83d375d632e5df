"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant, the others as
named users, and a loss mask over the assistant's words. One row is one turn of one rendering, with its place in it, so
that a conversation of any length, even one with a third of all rows, is never gathered into one task.

A range sort over all turns numbers them; ties of equal rows are split by a row number, so no turn number, null or
speaker makes a hot key. Numbers are cut into blocks of BLOCK turns. A turn is as long in every rendering but its
speaker's own, where only the role's words differ; so a place is one prefix sum of lengths over the conversation and a
correction by the number of the participant's own turns before it. Both come from sums for each block, and texts move
twice: into order, and to the participants of their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..plans.tables import dense_index
from .common import load, materialize

# The marks of the chat markup, and the role that belongs to no participant.
START, END, SYSTEM = "<|im_start|>", "<|im_end|>", "system"
#: Turns of a conversation that meet their participants in one task.
BLOCK = 256


def _harmless(text: Column) -> Column:
    """Markup inside a turn's own words is made harmless: '<|' becomes '< |'."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(role: Column, name: Column) -> Column:
    """A turn's first line; a user's name keeps to it, so control characters are blanks. No name for a null role."""
    shown = _harmless(F.regexp_replace(name, r"[\x00-\x1F\x7F]", " "))
    return F.concat(F.lit(START), role, F.when((role == "user") & name.isNotNull(), F.concat(F.lit(" name="), shown)).otherwise(""), F.lit("\n"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, participant and turn.

    conv_id; perspective: the participant who speaks as assistant; position: the turn's rank in the conversation;
    turn; chat_role: system, assistant or user; name: the speaker's (null for system); rendered: the turn's markup;
    start, end: its code points in the whole rendering; mask_start, mask_end: those of the words to be learned, equal
    when there are none. Concatenating `rendered` by position gives the rendering.

    A null role is a participant of its own, whose name and perspective are null. Null texts are empty, null turns come
    first, and ties are broken by role (null first) and text. System turns belong to no participant; a conversation of
    system turns alone gives no rows. Rows without conversation id form one conversation. Repeated rows are repeated
    turns. Markup in texts and names, and control characters in names, are made harmless in `rendered`. Texts may be of
    any length that a row holds; other columns are ignored. An empty table gives no rows.
    """
    source = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("who"), _harmless(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("body"))
    user = F.length(_head(F.when(F.col("who") == SYSTEM, SYSTEM).otherwise("user"), F.col("who"))) + F.length("body") + F.length(F.lit(END + "\n"))
    source = source.withColumn("length", user.cast("long")).withColumn("uid", F.monotonically_increasing_id())
    placed = dense_index(source, "at", "conv_id", "turn", "who", "body", "uid").withColumn("block", F.floor(F.col("at") / BLOCK))
    same = lambda a, b, *names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]

    sums = placed.groupBy("conv_id", "block").agg(F.min("at").alias("first"), F.sum("length").alias("chars"))
    whole = W.Window.partitionBy("conv_id")
    earlier = whole.orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    blocks = materialize(sums.select("conv_id", "block", F.min("first").over(whole).alias("first"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("before")), "blocks")

    spoken = placed.filter(~F.col("who").eqNullSafe(F.lit(SYSTEM))).groupBy("conv_id", "who", "block").agg(F.array_sort(F.collect_list("at")).alias("own"))  # at most BLOCK
    spoken = materialize(spoken, "spoken")
    people = spoken.select("conv_id", "who").distinct()
    views = people.alias("p").join(blocks.alias("b"), same("p", "b", "conv_id")).select("b.*", F.col("p.who").alias("perspective"))
    views = views.withColumnRenamed("perspective", "who")
    own = views.alias("v").join(spoken.alias("s"), same("v", "s", "conv_id", "who", "block"), "left").select("v.*", F.coalesce("s.own", F.array().cast("array<long>")).alias("own"))
    mine = W.Window.partitionBy("conv_id", "who").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    own = own.withColumn("own_before", F.coalesce(F.sum(F.size("own")).over(mine), F.lit(0))).withColumnRenamed("who", "perspective")

    running = W.Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(W.Window.unboundedPreceding, -1)
    inside = placed.withColumn("within", F.coalesce(F.sum("length").over(running), F.lit(0)))
    full = inside.alias("t").join(own.alias("o"), same("t", "o", "conv_id", "block")).select("t.*", "o.perspective", "o.first", "o.before", "o.own", "o.own_before")
    speaks = F.col("who").eqNullSafe(F.col("perspective"))
    full = full.withColumn("chat_role", F.when(F.col("who") == SYSTEM, SYSTEM).when(speaks, "assistant").otherwise("user"))
    own_so_far = F.col("own_before") + F.size(F.filter("own", lambda x: x < F.col("at")))
    less = F.length(_head(F.lit("user"), F.col("perspective"))) - F.length(_head(F.lit("assistant"), F.lit(None).cast("string")))
    head = _head(F.col("chat_role"), F.col("who"))
    full = full.withColumn("start", F.col("before") + F.col("within") - own_so_far * less).withColumn("head", head)
    length = F.length("head") + F.length("body") + F.length(F.lit(END + "\n"))
    mask = F.col("start") + F.length("head")
    learned = F.when(F.col("chat_role") == "assistant", F.length("body") + F.length(F.lit(END))).otherwise(0)
    return full.select(
        "conv_id", "perspective", (F.col("at") - F.col("first")).cast("long").alias("position"), "turn", "chat_role", F.when(F.col("chat_role") != SYSTEM, F.col("who")).alias("name"),
        F.concat("head", "body", F.lit(END + "\n")).alias("rendered"), F.col("start").cast("long").alias("start"), (F.col("start") + length).cast("long").alias("end"),
        mask.cast("long").alias("mask_start"), (mask + learned).cast("long").alias("mask_end"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(load(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, role AS who, replace(coalesce(text, ''), '<|', '< |') AS body,
         coalesce(' name=' || replace(regexp_replace(role, '[\x00-\x1F\x7F]', ' ', 'g'), '<|', '< |'), '') AS shown FROM conversations
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who NULLS FIRST, body) - 1 AS position FROM t
), p AS (
  SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who IS DISTINCT FROM 'system'
), v AS (
  SELECT r.*, perspective,
         CASE WHEN who = 'system' THEN 'system' WHEN who IS NOT DISTINCT FROM perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id
), h AS (
  SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN shown ELSE '' END || chr(10) AS head FROM v
), w AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered FROM h
), s AS (
  SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY position
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM w
)
SELECT conv_id, perspective, position, turn, chat_role, CASE WHEN chat_role <> 'system' THEN who END AS name, rendered, start,
       CAST(start + length(rendered) AS BIGINT) AS "end", CAST(start + length(head) AS BIGINT) AS mask_start,
       CAST(start + length(head) + CASE WHEN chat_role = 'assistant' THEN length(body) + 10 ELSE 0 END AS BIGINT) AS mask_end
FROM s
"""
