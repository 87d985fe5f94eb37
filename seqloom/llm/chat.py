"""Reply trees to training conversations: paths by iterative self-joins, a reversible template, a loss mask.

DataFrame functions only. Ancestors are found by pointer doubling: table k maps a node to its ancestor 2^k steps
up and is joined with itself for k + 1, so a path of d messages takes log2(d) self-joins and not d. A second
sequence of joins spreads each leaf over its ancestors, one row per (leaf, ancestor), with ids only; texts are
joined once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize

#: The control strings of the template (fixed values).
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Backslash doubles, and ``<|`` becomes ``<\\|``: no control string is left in the result."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def leaf_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """``(tree, leaf, node, up)``: each root-to-leaf path, one row per message, ``up`` steps above its leaf.

    ``messages (tree, node, parent, score)``; (tree, node) identifies a row. A null parent, or one that is not
    in the tree, marks a root. Nodes on a cycle, or hanging below one, reach no root and are left out. ``best``
    keeps the leaves of highest mean score of each tree (null scores count 0, ties by leaf); None keeps all.
    """
    nodes = messages.select("tree", "node", "parent").where("tree is not null and node is not null")
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = materialize(nodes.join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up_node")), "jump0")
    leaves = nodes.select("tree", "node").join(nodes.select("tree", F.col("parent").alias("node")).where("node is not null"), ["tree", "node"], "left_anti")
    jumps, n = [], nodes.count()
    while not jump.isEmpty():
        if 2 ** len(jumps) > n:
            leaves = leaves.join(jump.select("tree", "node"), ["tree", "node"], "left_anti")
            break
        jumps.append(jump)
        far = jump.select("tree", F.col("node").alias("up_node"), F.col("up_node").alias("far"))
        jump = materialize(jump.join(far, ["tree", "up_node"]).select("tree", "node", F.col("far").alias("up_node")), f"jump{len(jumps)}")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    # Longest jumps first: the rows of short paths multiply only in the last, short ones.
    for k, jump in reversed(list(enumerate(jumps))):
        stay = F.struct("node", "up")
        move = F.when(F.col("up_node").isNotNull(), F.struct(F.col("up_node").alias("node"), (F.col("up") + 2**k).alias("up")))
        paths = paths.join(jump, ["tree", "node"], "left").select("tree", "leaf", F.explode(F.array_compact(F.array(stay, move))).alias("p"))
        paths = paths.select("tree", "leaf", "p.node", "p.up")
    if best is None:
        return paths
    scores = paths.join(messages.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")
    chosen = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return paths.join(chosen.select("tree", "leaf"), ["tree", "leaf"], "left_semi")


def format_paths(messages: DataFrame, best: int | None = None, trained_role: str = "assistant") -> DataFrame:
    """``(tree, leaf, formatted, loss_spans)``: one conversation per chosen path.

    ``messages (tree, node, parent, role, text, score)``. Null roles and texts are empty. ``loss_spans`` are the
    code-point spans (end exclusive) of the texts of ``trained_role`` inside ``formatted``. An empty table gives
    an empty result; further columns are not read. A conversation is one output row, so it must fit in a task.
    """
    content = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = leaf_paths(messages, best).join(content, ["tree", "node"])
    turns = turns.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    length = F.length("head") + F.length("body") + len(END) + 1
    above = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length.cast("long")).over(above), F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start).select("tree", "leaf", F.struct(
        (-F.col("up")).alias("at"),
        F.concat("head", "body", F.lit(END + "\n")).alias("piece"),
        F.when(F.col("role") == trained_role, F.struct("start", (F.col("start") + F.length("body")).alias("end"))).alias("span"),
    ).alias("turn"))
    whole = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select("tree", "leaf", F.array_join(F.col("turns.piece"), "").alias("formatted"), F.array_compact(F.col("turns.span")).alias("loss_spans"))


def parse_formatted(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` that a formatted conversation holds."""
    pieces = F.split(formatted, rf"\Q{END}\E\n")
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescape_role(F.substr(head(p), F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(p, F.length(head(p)) + 2)).alias("text"),
        ),
    )


def linear_trees(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` as trees in which each turn replies to the one before it.

    Rows are ordered by turn, then role and text (nulls first), so ties and repeated rows all stay. Rows without
    a conv_id form one conversation of their own, whose conv_id is null.
    """
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    rows = conversations.select(tree.alias("tree"), "turn", "role", "text")
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    rows = rows.withColumn("node", place.cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Format every conversation and read counts and digests back from what was written.

    Null texts and roles count as empty; turns of one number go by role and text; rows that repeat are turns of their
    own; rows without conv_id are one conversation of null; a conversation is one row, so it must fit in a task; an empty
    table gives an empty result; other columns are not read.
    """
    out = format_paths(linear_trees(conversations)).withColumn("turns", parse_formatted(F.col("formatted")))
    seen = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return out.withColumn("loss", under).select(
        F.expr("try_cast(tree as bigint)").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(seen, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
