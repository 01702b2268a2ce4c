"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees (a message answers its parent). Self-joins that double the reach of each ancestor pointer give
every message its path to the root with the path's score; a tree's leaves are ranked by that score, and the kept
leaves' paths are enumerated by going back down the same pointers, in as many joins as the depth has bits. Each
kept path becomes one formatted conversation.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. In roles and texts a backslash goes before
each backslash and inside each control string (`<|`, `[INST]`, `[/INST]`, `<s>`, `</s>`, `<<SYS>>`, `<</SYS>>`), and
before a line feed in a role; taking away one backslash before any character undoes it.

Cases: null texts and roles are empty; rows with a null conv_id are left out; equal turns are ordered by role and
text, and repeated rows are turns of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stage_table

START, END = "<|im_start|>", "<|im_end|>"
TURN = r"(?s)<\|im_start\|>((?:\\.|[^\\\n])*+)\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ("<|", "<\\|"), ("INST]", "\\INST]"), ("s>", "\\s>"), ("SYS>>", "\\SYS>>")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_tree(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as chains: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (
        rows.where("conv_id is not null")
        .select(
            "conv_id", F.row_number().over(order).cast("long").alias("node"),
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        )
        .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
        .withColumn("score", F.length("text").cast("double"))
    )


def best_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(conv_id, branch, depth, node): the messages of each tree's `keep` best root-to-leaf paths, depth from 1.
    nodes: (conv_id, node, parent, score); (conv_id, node) is unique and parents exist."""
    level = stage_table(
        nodes.select("conv_id", "node", F.col("parent").alias("anc"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).alias("depth")),
        "reach",
    )
    done, levels = level.where("anc is null"), []
    level = level.where("anc is not null")
    while not level.isEmpty():
        levels.append(level)
        # an ancestor with an ancestor of its own doubles the reach; one that reached its root ends the path
        up = level.select("conv_id", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("total").alias("t2"), F.col("depth").alias("d2"))
        up = up.unionByName(done.select("conv_id", F.col("node").alias("anc"), F.lit(None).cast("long").alias("anc2"), F.col("total").alias("t2"), F.col("depth").alias("d2")))
        moved = stage_table(
            level.join(up, ["conv_id", "anc"]).select("conv_id", "node", F.col("anc2").alias("anc"), (F.col("total") + F.col("t2")).alias("total"), (F.col("depth") + F.col("d2")).alias("depth")),
            "reach",
        )
        done = done.unionByName(moved.where("anc is null"))
        level = moved.where("anc is not null")
    parents = nodes.where("parent is not null").select("conv_id", F.col("parent").alias("node")).distinct()
    rank = Window.partitionBy("conv_id").orderBy(F.desc("total"), "node")
    paths = (
        done.join(parents, ["conv_id", "node"], "left_anti")
        .withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= keep)
        .select("conv_id", "branch", "depth", "node")
    )
    for k in reversed(range(len(levels))):
        jump = levels[k].select("conv_id", "node", "anc")
        both = F.array(F.struct("node", "depth"), F.struct(F.col("anc").alias("node"), (F.col("depth") - 2**k).alias("depth")))
        paths = (
            paths.join(jump, ["conv_id", "node"], "left")
            .select("conv_id", "branch", F.explode(F.filter(both, lambda x: x["node"].isNotNull())).alias("x"))
            .select("conv_id", "branch", F.col("x.depth").alias("depth"), F.col("x.node").alias("node"))
        )
    return paths


def format_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(conv_id, branch, formatted, loss): loss is an array of (start, len) code-point spans of assistant texts."""
    nodes = stage_table(nodes.select("conv_id", "node", "parent", "role", "text", "score"), "messages")
    turns = best_paths(nodes, keep).join(nodes.select("conv_id", "node", "role", "text"), ["conv_id", "node"])
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    turns = (
        turns.withColumn("head", F.concat(F.lit(START), role, F.lit("\n")))
        .withColumn("body", escape(F.col("text")))
        .withColumn("whole", F.concat("head", "body", F.lit(END + "\n")))
    )
    before = Window.partitionBy("conv_id", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("whole")).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("span", F.when(F.col("role") == "assistant", F.struct(at.cast("int").alias("start"), F.length("body").alias("len"))))
    in_order = F.array_sort(F.collect_list(F.struct("depth", "whole", "span")))
    return (
        turns.groupBy("conv_id", "branch").agg(in_order.alias("t"))
        .select(
            "conv_id", "branch", F.array_join(F.col("t.whole"), "").alias("formatted"),
            F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss"),
        )
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, branch, turns array<struct<role, text>>, loss_text, formatted) from the formatted text and its mask."""
    roles = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2))
    turns = F.transform(F.arrays_zip(roles.alias("role"), bodies.alias("text")), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    lost = F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["len"])))
    return chats.select("conv_id", "branch", turns.alias("turns"), F.array_join(lost, "").alias("loss_text"), "formatted")
