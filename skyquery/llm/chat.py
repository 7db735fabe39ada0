"""Chat formatting of reply trees, with DataFrame operations only.

Root-to-leaf paths come from iterative self-joins: every round joins the ancestor pairs with
themselves and doubles their distance, so that depth d needs about log2(d) rounds; the same
pairs then spell out each leaf's ancestors, linear in the length of the result. Branches of a
tree are ranked by score, and each chosen path becomes one conversation.

In the formatted text ``<|im_start|>`` and ``<|im_end|>`` mark turns. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|`` (a line break in a role gets a backslash before
it), so no text can close its turn, and reading back restores every character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def one_each(messages: DataFrame) -> DataFrame:
    """One message (tree, node, parent, role, text, score) for each tree and node: of rows that repeat them the smallest. Rows without a node are left out."""
    kept = F.min(F.struct("parent", "role", "text", F.col("score").cast("double").alias("score"))).alias("m")
    return messages.filter("node is not null").groupBy("tree", "node").agg(kept).select("tree", "node", "m.*")


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for each leaf of the messages (tree, node, parent) and each node from it to its root; ``up`` counts from the leaf.

    A message whose parent is null, itself or not in the tree is a root. Node ids must be
    unique in a tree, as ``one_each`` makes them. Circular replies raise ValueError. Null trees are one tree.
    """
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    step = cut(
        nodes.filter("parent is not null and parent <> node")
        .join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left_semi")
        .select("tree", "node", F.col("parent").alias("above"))
    )
    inner = step.select(F.col("tree").alias("t"), F.col("above").alias("n")).distinct()
    leaves = nodes.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    rounds, size = [], nodes.count()
    while not step.isEmpty():
        # no path is longer than the number of messages
        if 1 << len(rounds) > size:
            raise ValueError("replies are circular")
        rounds.append(step)
        far = step.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("above").alias("a"))
        step = cut(step.join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("above") == F.col("n"))).select("tree", "node", F.col("a").alias("above")))
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(rounds) - 1, -1, -1):
        far = rounds[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("above").alias("a"))
        both = found.join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left")
        here = F.struct(F.col("node").alias("node"), F.col("up").alias("up"))
        there = F.struct(F.col("a").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        each = F.when(F.col("a").isNull(), F.array(here)).otherwise(F.array(here, there))
        found = both.select("tree", "leaf", F.explode(each).alias("x")).select("tree", "leaf", "x.node", "x.up")
    return found


def format_trees(messages: DataFrame, *, top: int | None = None, learn_from: str = "assistant") -> DataFrame:
    """One conversation per chosen root-to-leaf path of the messages (tree, node, parent, role, text, score).

    Returns tree, leaf, rank (1: the branch of highest total score; ties go to the smaller
    leaf), score, formatted, turn_starts (code points) and loss_spans: for each turn of role
    ``learn_from`` its number, and where its escaped text begins and ends. ``top`` keeps so many branches of a tree.
    Null roles and texts are empty, null scores 0. Of rows that repeat a tree and node the smallest counts, and rows
    without a node do not. Other columns are ignored; no messages give no rows.
    """
    messages = cut(one_each(messages))
    m = messages.select(
        F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("s"),
    )
    steps = paths(messages)
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    turns = steps.join(m, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(
        "tree", "leaf", "up", "s", (F.col("role") == learn_from).alias("learn"),
        (F.lit(len(START) + 1) + F.length(role)).alias("head"), F.length(text).alias("body"),
        F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n")).alias("turn"),
    )
    earlier = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("turn").cast("long")).over(earlier), F.lit(0).cast("long")))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("o"), "start", "head", "body", "learn", "turn")))
    made = turns.groupBy("tree", "leaf").agg(F.sum("s").alias("score"), ordered.alias("turns"))
    ranked = made.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    span = lambda x, i: F.struct(
        i.alias("turn"), (x["start"] + x["head"]).alias("start"), (x["start"] + x["head"] + x["body"]).alias("end"), x["learn"].alias("learn")
    )
    spans = F.filter(F.transform("turns", span), lambda x: x["learn"])
    return ranked.select(
        "tree", "leaf", "rank", "score",
        F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"),
        F.transform("turns", lambda x: x["start"]).alias("turn_starts"),
        F.transform(spans, lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``roles``, ``texts`` (arrays, unescaped) and ``loss_texts``, taken from the formatted text and its spans alone."""
    cut_up = formatted.withColumn("_turns", F.split("formatted", r"(?=<\|im_start\|>)"))
    header = r"^<\|im_start\|>([^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+)\n"
    role = lambda x: F.regexp_extract(x, header, 1)
    parts = cut_up.withColumn("_roles", F.transform("_turns", role))
    fixed = len(START) + 1 + len(END) + 1
    text = lambda x, r: F.substring(x, F.length(r) + len(START) + 2, F.length(x) - F.length(r) - fixed)
    learned = lambda x: unescape(
        F.substring(F.element_at("_turns", x["turn"] + 1), (x["start"] - F.element_at("turn_starts", x["turn"] + 1) + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
    )
    return parts.select(
        *[F.col(c) for c in formatted.columns],
        F.transform("_roles", unescape).alias("roles"),
        F.transform(F.zip_with("_turns", "_roles", text), unescape).alias("texts"),
        F.transform("loss_spans", learned).alias("loss_texts"),
    )


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees without branches: each turn replies to the one before it. Ties are ordered by role and text."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", at)
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
