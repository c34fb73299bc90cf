"""Reply trees to chat text, with DataFrame operations only.

Every node knows its parent. Self-joins double the reach of "ancestor" until no node has one that far, so a tree of
depth D takes about log2(D) joins, over ever fewer nodes. The doubled tables in reverse enumerate the nodes of every
root-to-leaf path; paths are ranked by their summed scores, and each chosen one becomes one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside texts a backslash is doubled and ``<|`` becomes
``<\\|``, so no control string survives in a text and the text can be had back. In roles, ``%`` and line ends are
percent-encoded first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, forget, stored

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def branches(nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """Root-to-leaf paths: (tree, leaf, branch_rank, branch_score, node, dist), dist 0 at the leaf.

    ``nodes``: tree, node (unique in its tree), parent (null or unknown: a root), score. ``keep`` is the number of
    branches wanted of each tree, best summed score first, ties by leaf id; None keeps all. Nodes on a cycle have no
    leaf below a root and are left out.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    ups, n = [stored(nodes.join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("anc")), "reply-up")], nodes.count()
    looped = None
    while not ups[-1].isEmpty():
        if 2 ** (len(ups) - 1) > n:  # no path is that long: what still climbs runs in a circle
            looped = ups.pop()
            break
        far = ups[-1].select("tree", F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        ups.append(stored(ups[-1].join(far, ["tree", "anc"]).select("tree", "node", F.col("anc2").alias("anc")), "reply-up"))
    parents = ups[0].select("tree", F.col("anc").alias("node")).distinct()
    leaves = nodes.select("tree", "node").join(parents, ["tree", "node"], "left_anti")
    if looped is not None:
        leaves = leaves.join(looped.select("tree", "node"), ["tree", "node"], "left_anti")
    path = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist"))
    for k in reversed(range(len(ups))):  # a step of 2**k from every node that is on the path so far
        both = F.array(F.struct("node", "dist"), F.struct(F.col("anc").alias("node"), (F.col("dist") + 2**k).alias("dist")))
        path = path.join(ups[k], ["tree", "node"], "left").select("tree", "leaf", F.inline(both)).where("node is not null")
    path = stored(path, "reply-paths")
    forget(*ups, looped)
    scores = path.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("branch_score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
    chosen = scores.withColumn("branch_rank", rank)
    return path.join(chosen.where(F.col("branch_rank") <= keep) if keep is not None else chosen, ["tree", "leaf"])


def format_branches(nodes: DataFrame, path: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a branch: tree, leaf, branch_rank, formatted, loss_spans (start and length in code points).

    ``nodes``: tree, node, role, text; null roles and texts are empty. The spans cover each text of ``loss_role``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = path.join(nodes.select("tree", "node", role.alias("role"), escape(text).alias("body")), ["tree", "node"])
    turns = turns.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("dist")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    item = F.struct((-F.col("dist")).alias("o"), F.col("piece"), F.col("at").alias("start"), F.length("body").alias("len"), (F.col("role") == loss_role).alias("on"))
    rows = turns.groupBy("tree", "leaf", "branch_rank").agg(F.sort_array(F.collect_list(item)).alias("t"))
    return rows.select(
        "tree", "leaf", "branch_rank",
        F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["on"]), lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"))).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    raw = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    return F.transform(
        raw,
        lambda x: F.struct(
            unescape_role(F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["len"].cast("int")))), "")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by turn; ties by role, then text."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("tree"), "turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return rows.select("tree", node.alias("node"), "role", "text").withColumn("parent", F.col("node") - 1).withColumn("score", F.lit(0.0))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of every conversation.

    Null texts and roles are empty, a null turn comes first, repeated rows are turns of their own, rows without an id
    form one conversation with a null id, and an empty table gives an empty result.
    """
    nodes = stored(conversation_nodes(conversations), "reply-nodes")
    out = format_branches(nodes, branches(nodes))
    return out.select(F.when(F.col("tree") != NO_ID, F.col("tree")).alias("conv_id"), "formatted", "loss_spans")
