"""Reply trees to conversations, with DataFrame operations only.

Messages form trees (parent pointers).  Root-to-leaf paths are enumerated by
self-joins that double their reach: after k rounds every leaf knows its
2^k nearest ancestors, so a thread of 400 messages takes nine rounds, on
ids alone.  Branches are ranked by their mean score, and each chosen path
becomes one conversation: segments of text, each under the loss mask or not.

The template is ``<|im_start|>role\\n`` text ``<|im_end|>\\n``.  Inside texts
every ``<|`` (with any number of backslashes between) gains one backslash,
which ``unescape`` takes away again; roles are percent-encoded.  So no text can
hold a control string, and the output can be read back without loss.

Edge cases: null text and null role are empty; a null tree id is a tree of
its own; a message whose parent is absent or itself is a root; equal nodes
must not repeat (``from_turns`` numbers rows, so repeated turns stay, ordered
by role and text); a cycle raises; empty tables give no rows.  A path is one
row, so a single conversation, and with it any text, must fit in a task.  Extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.shared import written

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def from_turns(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row replies to the one before."""
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (conversations.select("conv_id", "role", "text", F.row_number().over(in_order).cast("long").alias("node"))
            .select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")))


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree_key, leaf, node, dist) for every ancestor of every leaf, itself at 0, from (tree_key, node, parent)."""
    nodes = written(nodes.select("tree_key", "node", "parent"), "chat-nodes")
    known = nodes.select("tree_key", F.col("node").alias("parent"))
    up = written(nodes.where("parent <> node").join(known, ["tree_key", "parent"], "left_semi").select("tree_key", "node", F.col("parent").alias("ancestor")), "chat-up")
    has_reply = up.select("tree_key", F.col("ancestor").alias("node"))
    paths = written(nodes.join(has_reply, ["tree_key", "node"], "left_anti").select("tree_key", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")), "chat-paths")
    reach, total = 1, None
    while not up.isEmpty():
        if reach > 1 and total is None:
            total = nodes.count()
        if total is not None and reach > total:
            raise ValueError("the parent pointers have a cycle")
        further = paths.join(up, ["tree_key", "node"]).select("tree_key", "leaf", F.col("ancestor").alias("node"), (F.col("dist") + reach).alias("dist"))
        paths = written(paths.union(further), "chat-paths")
        onward = up.select("tree_key", F.col("node").alias("ancestor"), F.col("ancestor").alias("further"))
        up = written(up.join(onward, ["tree_key", "ancestor"]).select("tree_key", "node", F.col("further").alias("ancestor")), "chat-up")
        reach *= 2
    return paths


def format_trees(messages: DataFrame, top_paths: int = 1) -> DataFrame:
    """The best ``top_paths`` branches of every tree as conversations: tree, leaf, path_score, segments.

    ``messages`` has tree, node, parent, role, text, score.  A branch's score is
    the mean of its messages' scores (null scores count as 0); ties go to the
    smaller leaf.  ``segments`` is an array of (text, loss); the formatted
    conversation is their texts joined, the loss mask is their flags.
    """
    keyed = messages.select(F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("tree_key"), "tree", "node", "parent", "role", "text",
                            F.coalesce("score", F.lit(0.0)).alias("score"))
    keyed = written(keyed, "chat-messages")
    paths = leaf_paths(keyed)
    scored = paths.join(keyed.select("tree_key", "node", "score"), ["tree_key", "node"]).groupBy("tree_key", "leaf").agg(F.avg("score").alias("path_score"))
    best = Window.partitionBy("tree_key").orderBy(F.desc("path_score"), "leaf")
    chosen = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top_paths).drop("place")
    role = F.coalesce("role", F.lit(""))
    turns = paths.join(chosen, ["tree_key", "leaf"]).join(keyed.drop("score", "parent"), ["tree_key", "node"]).select(
        "tree_key", "tree", "leaf", "path_score", (-F.col("dist")).alias("at"),
        F.concat(F.lit(START), F.url_encode(role), F.lit("\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"), (role == TRAINED_ROLE).alias("loss"))
    whole = turns.groupBy("tree_key", "leaf").agg(F.first("tree").alias("tree"), F.first("path_score").alias("path_score"),
                                                  F.sort_array(F.collect_list(F.struct("at", "head", "body", "loss"))).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    return whole.select("tree", "leaf", "path_score", F.flatten(F.transform("turns", lambda t: F.array(
        segment(t["head"], F.lit(False)), segment(t["body"], t["loss"]), segment(F.lit(END), F.lit(False))))).alias("segments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and masked text read from the formatted output alone.

    tree, leaf, formatted, turns (array of role, text), loss_text (the text of
    all segments under the mask, unescaped).
    """
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")
    cut = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(cut, 1, F.size(cut) - 1)  # nothing follows the last end mark

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        return F.struct(F.url_decode(F.substr(head, F.lit(len(START) + 1))).alias("role"), unescape(F.substr(piece, F.length(head) + 2)).alias("text"))

    loss_text = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return (formatted.select("tree", "leaf", whole, "segments")
            .select("tree", "leaf", "formatted", F.transform(pieces, turn).alias("turns"), loss_text.alias("loss_text")))


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
