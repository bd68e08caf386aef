r"""Chat formatting of reply trees (built-in functions only).

Messages (conv_id, msg_id, parent_id, role, text, score) form reply trees. Iterative self-joins enumerate the paths
from a root to each leaf: runs of messages with one reply each are first contracted by pointer doubling (as many joins as
the logarithm of the longest run), then the tree of runs is walked a branching level at a time. Branches are ranked by the
mean score of their messages, and each chosen path is formatted as one conversation.

The template writes a turn as ``### role: text</turn>\n``. Inside texts and roles ``\`` becomes ``\b``, ``###``
``\h`` and ``</turn>`` ``\t`` (in roles also ``:`` ``\c``), so no text can form a control string, and every text is read
back exactly. The loss mask covers the assistant's texts, as spans of code points of the formatted conversation.

* null text and null role are empty; a null conv_id is a conversation of its own; extra columns are ignored.
* messages that repeat an id in a conversation: the least (parent, role, text) stands. Turns that tie or repeat in
  ``linear_messages`` follow each other in the order of role and text.
* a parent that is null or missing makes a root; messages on a cycle of replies have no root and no path.
* an empty table gives no rows. A conversation is one row of the output, so its size is bounded by Spark's largest row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starweave.llm.common import NULL_ID, discard, keep, table

# What is escaped inside texts, in the order of escaping.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(c: Column, pairs: tuple = ESCAPES) -> Column:
    for plain, coded in pairs:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column, pairs: tuple = ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def linear_messages(turns: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as messages, each replying to the turn before it."""
    conv = F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = turns.select(conv, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv", F.row_number().over(order).cast("long").alias("msg"), "role", "text", F.lit(0.0).alias("score")).withColumn(
        "parent", F.when(F.col("msg") > 1, F.col("msg") - 1)
    )


def tree_messages(messages: DataFrame) -> DataFrame:
    """General messages with one row for each id, whatever repeats or is null."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = messages.where("msg_id is not null").select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv"), F.col("msg_id").cast("long").alias("msg"),
        F.struct(F.col("parent_id").cast("long").alias("parent"), text("role").alias("role"), text("text").alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")).alias("m"),
    )
    return rows.groupBy("conv", "msg").agg(F.min("m").alias("m")).select("conv", "msg", "m.role", "m.text", "m.score", "m.parent")


def runs(messages: DataFrame) -> DataFrame:
    """Each message's run: ``head`` (its first message), ``rank`` in it and ``above`` (the head's parent, null at a root)."""
    ids = keep(messages.select("conv", "msg", "parent"), "ids")
    replies = ids.where("parent is not null").groupBy("conv", F.col("parent").alias("msg")).agg(F.count(F.lit(1)).alias("replies"))
    known = ids.select("conv", F.col("msg").alias("parent")).join(replies.withColumnRenamed("msg", "parent"), ["conv", "parent"], "left")
    start = ids.join(known.withColumn("found", F.lit(True)), ["conv", "parent"], "left")
    parent = F.when(F.col("found"), F.col("parent"))
    begins = parent.isNull() | (F.col("replies") > 1)
    state = keep(
        start.select(
            "conv", "msg", parent.alias("parent"), F.when(begins, F.col("msg")).otherwise(parent).alias("head"),
            F.when(begins, 0).otherwise(1).cast("long").alias("rank"), begins.alias("done"),
        ),
        "runs",
    )
    longest = ids.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(longest + 1)) + 1):
        if not state.where("not done").limit(1).count():
            break
        to = state.select("conv", F.col("msg").alias("head"), F.col("head").alias("next"), F.col("rank").alias("more"), F.col("done").alias("ends"))
        todo = state.where("not done").join(to, ["conv", "head"]).select("conv", "msg", "parent", F.col("next").alias("head"), (F.col("rank") + F.col("more")).alias("rank"), F.col("ends").alias("done"))
        after = keep(state.where("done").unionByName(todo), "runs")
        discard(state)
        state = after
    state = state.where("done")  # what is left hangs on a cycle
    tops = state.where("msg = head").select("conv", "head", F.col("parent").alias("above"))
    return state.select("conv", "msg", "head", "rank").join(tops, ["conv", "head"])


def paths(messages: DataFrame, in_runs: DataFrame, per_conversation: int | None = None) -> DataFrame:
    """``conv``, ``leaf`` (the leaf run's head), ``branch`` (rank by score, from 1) and ``heads`` (runs from the root)."""
    own = in_runs.join(messages.select("conv", "msg", "score"), ["conv", "msg"])
    run = own.groupBy("conv", "head", "above").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("n"))
    by = in_runs.select("conv", F.col("msg").alias("above"), F.col("head").alias("up"))
    run = keep(run.join(by, ["conv", "above"], "left").select("conv", "head", "above", "up", "sum", "n"), "tree")
    inner = run.where("up is not null").select("conv", F.col("up").alias("head")).distinct().withColumn("inner", F.lit(True))
    run = keep(run.join(inner, ["conv", "head"], "left").withColumn("inner", F.coalesce("inner", F.lit(False))), "tree")
    front = run.where("above is null").select("conv", "head", F.array("head").alias("heads"), "sum", "n", "inner")
    ended = [front.where("not inner")]
    front = front.where("inner")
    while front.limit(1).count():
        child = run.where("up is not null").select("conv", F.col("up").alias("head"), F.col("head").alias("to"), F.col("sum").alias("s"), F.col("n").alias("k"), F.col("inner").alias("on"))
        front = front.join(child, ["conv", "head"]).select(
            "conv", F.col("to").alias("head"), F.concat("heads", F.array("to")).alias("heads"), (F.col("sum") + F.col("s")).alias("sum"), (F.col("n") + F.col("k")).alias("n"), F.col("on").alias("inner")
        )
        front = keep(front, "front")
        ended.append(front.where("not inner"))
        front = front.where("inner")
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc(F.col("sum") / F.col("n")), "head"))
    chosen = every.select("conv", F.col("head").alias("leaf"), "heads", rank.alias("branch"))
    return chosen if per_conversation is None else chosen.where(F.col("branch") <= per_conversation)


def format_paths(messages: DataFrame, per_conversation: int | None = None) -> DataFrame:
    """``conv``, ``leaf``, ``branch``, ``formatted`` and ``mask`` (spans from, length of the assistant's escaped texts)."""
    in_runs = keep(runs(messages), "inruns")
    ways = paths(messages, in_runs, per_conversation).select("conv", "leaf", "branch", F.posexplode("heads").alias("step", "head"))
    turns = messages.select("conv", "msg", "role", "text").join(in_runs.select("conv", "msg", "head", "rank"), ["conv", "msg"])
    lead = F.concat(F.lit("### "), escape(F.col("role"), ROLE_ESCAPES), F.lit(": "))
    body = escape(F.col("text"))
    written = ways.join(turns, ["conv", "head"]).select(
        "conv", "leaf", "branch", "step", "rank", F.concat(lead, body, F.lit("</turn>\n")).alias("turn"),
        F.char_length(lead).cast("long").alias("lead"), F.char_length(body).cast("long").alias("long"), (F.col("role") == "assistant").alias("learn"),
    )
    # branch is fixed by (conv, leaf), so the window and the grouping share one exchange
    before = Window.partitionBy("conv", "leaf", "branch").orderBy("step", "rank").rowsBetween(Window.unboundedPreceding, -1)
    written = written.withColumn("at", F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)))
    whole = written.groupBy("conv", "leaf", "branch").agg(F.sort_array(F.collect_list(F.struct("step", "rank", "turn", "at", "lead", "long", "learn"))).alias("t"))
    spans = F.transform(F.filter("t", lambda t: t["learn"]), lambda t: F.struct((t["at"] + t["lead"]).alias("from"), t["long"].alias("length")))
    return whole.select("conv", "leaf", "branch", F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"), spans.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(5))
        role = F.substring_index(body, ": ", 1)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substr(body, F.char_length(role) + 3)).alias("text"))

    return F.transform(F.filter(F.split(formatted, "</turn>\n"), lambda p: p != ""), turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    cut = lambda s: unescape(F.substr(formatted, (s["from"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(mask, cut), "")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = format_paths(keep(linear_messages(turns), "messages"))
    read = done.select("conv", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.when(F.col("conv") != NULL_ID, F.col("conv")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
