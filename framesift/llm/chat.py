"""Conversations from reply trees.

Messages are (tree, node, parent, role, text, score). Every message's root path is found by pointer doubling: after k
self-joins each message knows its ancestor 2^k steps up, the score sum and the length of the way there, so a tree of
depth d takes log2(d) joins whatever its shape. Leaves are ranked in their tree by the score of their whole path; the
chosen ones mark their ancestors by the same pointers, largest step first, and each path is formatted as one
conversation. Rounds are written to the shared folder.

The template marks a turn as ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. A control string inside a text gets a
backslash after its first character; one that has n backslashes there gets another, so unescaping takes one away and
every text comes back as it was. The loss mask is a list of (start, length) in characters of the formatted text, that
covers the assistants' texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.plans.staging import stage

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that mark turns in this template or in others in use.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
FIRSTS = r"[<\[]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({FIRSTS})(\\*)({TAILS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({FIRSTS})\\(\\*)({TAILS})", r"$1$2$3")


def escape_role(role: Column) -> Column:
    """Roles stand on a line of their own: line feeds are percent-encoded. Null roles are empty."""
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def unique_messages(messages: DataFrame) -> DataFrame:
    """One row for each (tree, node), nulls included: of several the one with the highest score, then the smallest parent, role
    and text, nulls last. For tables in which a node may come twice; the rest of this module takes each node to be one."""
    low = lambda c: F.struct(F.col(c).isNull(), F.col(c))
    first = F.min(F.struct(-F.coalesce("score", F.lit(0.0)), *[low(c) for c in ("parent", "role", "text")], F.struct("parent", "role", "text", "score").alias("row"))).alias("first")
    return messages.groupBy("tree", "node").agg(first).select("tree", "node", "first.row.*")


def root_paths(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, total, length) of each message with a path to a root, and the pointer table of each step size.

    A parent that isn't in the tree makes a message a root. Messages whose parents go round in a circle have no root
    and belong to no path; doubling ends when the steps are longer than any tree is large.
    """
    ids = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = ids.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    up = ids.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    now = stage(up.select("tree", "node", F.col("n").alias("up"), F.col("score").alias("total"), F.lit(1).cast("bigint").alias("length")), "up0")
    largest = now.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    pointers, step = [], 1
    while step < max(largest, 1) and not now.where("up IS NOT NULL").isEmpty():
        pointers.append(now.select("tree", "node", "up").where("up IS NOT NULL"))
        far = now.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("length").alias("further"))
        # messages that have reached their root wait; only the others look further up
        joined = now.where("up IS NOT NULL").join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")), "left")
        grown = joined.select(
            "tree", "node", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("length") + F.coalesce("further", F.lit(0))).alias("length")
        )
        now = stage(now.where("up IS NULL").unionByName(grown), "up")
        step *= 2
    return now.where("up IS NULL").drop("up"), pointers


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, node, place) of the messages on each tree's ``branches`` best root-to-leaf paths.

    Branches rank by path score, the highest first, then by the smallest leaf; place counts from 1 at the root.
    """
    paths, pointers = root_paths(messages)
    parents = messages.select(F.col("tree").alias("t"), F.col("parent").alias("n")).where("n IS NOT NULL").distinct()
    leaves = paths.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("total").desc(), "node"))
    marked = leaves.withColumn("branch", rank).where(F.col("branch") <= branches).select("tree", "branch", "node")
    for table in reversed(pointers):
        p = table.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        up = marked.join(p, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "branch", F.col("up").alias("node"))
        marked = stage(marked.unionByName(up), "marked")
    where = paths.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("length").alias("place"))
    return marked.join(where, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "branch", "node", "place")


def format_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, branch, formatted, and loss: array of (start, length), characters from 0, that cover assistants' texts.

    Null texts are empty. (tree, node) must be unique (see ``unique_messages``). A conversation is a row, so it is gathered in one task; all
    others of the table are dealt out by tree.
    """
    paths = chosen_paths(messages, branches).select(F.col("tree").alias("t"), F.col("node").alias("n"), "branch", "place")
    rows = messages.join(paths, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    turn = F.struct(F.col("place"), head.alias("head"), body.alias("body"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"))
    talks = rows.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    tail = END + "\n"
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "turns",
        start,
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(tail)).alias("at"),
            F.when(t["learn"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return talks.select("tree", "branch", formatted.alias("formatted"), spans.alias("loss"))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array of (role, text)."""
    parts = F.filter(F.split(formatted, re.escape(END + "\n"), -1), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape_role(F.regexp_extract(x, rf"(?s)^{re.escape(START)}([^\n]*)\n(.*)$", 1)).alias("role"),
            unescape(F.regexp_extract(x, rf"(?s)^{re.escape(START)}([^\n]*)\n(.*)$", 2)).alias("text"),
        ),
    )


def thread(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees: each row answers the one before it.

    Rows of a conversation are in order of turn (null first), then role, then text, so rows that repeat a turn have a
    place each. Other columns are not kept.
    """
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", node)
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Formats every conversation and reads from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Rows with a null conv_id are one conversation."""
    out = stage(format_paths(stage(thread(conversations), "threads")), "formatted")
    turns = parse_turns(F.col("formatted"))
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return out.select(F.col("tree").alias("conv_id"), turns.alias("turns"), learnt.alias("learnt"), "formatted").select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
