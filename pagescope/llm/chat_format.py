"""Chat formatting of reply trees. Built-in functions only.

Nodes name their parent. Self-joins double the distance that each node looks up
(1, 2, 4, ... ancestors), adding scores on the way, until every node knows the
root's distance and the score of its path. Leaves are ranked by path score in each
tree; the paths of the chosen leaves are enumerated by the same joins in reverse,
each of which splits a stretch of a path in two. Every chosen path becomes one
conversation.

Template: BEGIN role newline text FINISH for each turn. Inside roles and texts
ESCAPES replaces each backslash, `<` and `[` (and each newline of a role), so that
no control string, of this template or of another, can occur in them; `unescape`
undoes it exactly. Loss spans (code points, end exclusive) cover assistant texts.

Defined cases: a null role or text is empty; a parent that is not in the table
makes its child a root; nodes that reach no root (a cycle) are on no path; rows of
the same tree and node are the same node once, the smallest by role and text; ties
of score (to nine digits) go to the smaller node; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescope.llm import storage

BEGIN, FINISH = "<|im_start|>", "<|im_end|>\n"
#: What stands for a character inside a role or text.
ESCAPES = {"\\": "\\0", "<": "\\1", "[": "\\2"}
NEWLINE = "\\3"
#: Parts in which the leaves of a tree are ranked first.
PARTS = 64


def escape(value: Column) -> Column:
    for plain, code in ESCAPES.items():
        value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def unescape(value: Column) -> Column:
    """Every backslash of an escaped value begins a code, so the order matters only for the last."""
    value = F.replace(value, F.lit(NEWLINE), F.lit("\n"))
    for plain, code in reversed(ESCAPES.items()):
        value = F.replace(value, F.lit(code), F.lit(plain))
    return value


def turns_as_nodes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> a tree with one branch for each conversation; repeated turns follow one another."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """tree, leaf, place, node: the nodes of each root-to-leaf path; best: only so many leaves a tree, by mean score."""
    nodes = nodes.select("tree", "node", "parent", "score").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    known = nodes.select("tree", F.col("node").alias("up"), F.lit(True).alias("_known"))
    up = nodes.withColumnRenamed("parent", "up").join(known, ["tree", "up"], "left")
    up = up.select("tree", "node", F.when(F.col("_known"), F.col("up")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("length"))
    steps = [storage.materialise(up, "reply-tree")]
    limit = max(1, int(steps[0].count())).bit_length() + 1
    while len(steps) <= limit and not steps[-1].filter(F.col("up").isNotNull()).isEmpty():
        done, near = steps[-1].filter(F.col("up").isNull()), steps[-1].filter(F.col("up").isNotNull())
        far = steps[-1].select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("length").alias("_length"))
        both = near.join(far, ["tree", "up"])  # a round joins only nodes that have not reached their root
        both = both.select("tree", "node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("length") + F.col("_length")).alias("length"))
        steps.append(storage.materialise(done.unionByName(both), "reply-tree"))
    parents = nodes.select("tree", F.col("parent").alias("node")).filter(F.col("node").isNotNull()).distinct()
    leaves = steps[-1].filter(F.col("up").isNull()).join(parents, ["tree", "node"], "left_anti")
    if best is not None:
        leaves = leaves.withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
        for part in (["tree", "_part"], ["tree"]):  # the best of each part of a tree, then of those: no task gets all leaves of a large tree
            order = Window.partitionBy(*part).orderBy(F.round(F.col("total") / F.col("length"), 9).desc(), "node")
            leaves = leaves.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= best)
        leaves = storage.materialise(leaves.drop("_part", "_rank"), "reply-leaves")  # and the joins that follow are dealt by node, not by tree
    parts = leaves.select("tree", F.col("node").alias("leaf"), "node", F.col("length").alias("place"), "length")
    for j in reversed(range(len(steps) - 1)):
        size = 1 << j
        long = F.col("length") > size
        upper = parts.filter(long).join(steps[j].select("tree", "node", "up"), ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("place") - size).alias("place"), (F.col("length") - size).alias("length"))
        parts = storage.materialise(parts.withColumn("length", F.least("length", F.lit(size).cast("long"))).unionByName(upper), "reply-paths")
    return parts.select("tree", "leaf", "place", "node")


def format_paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """tree, leaf, formatted, loss (array of start, end): one conversation a chosen path."""
    found = paths(nodes, best)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = nodes.groupBy("tree", "node").agg(F.min(F.struct(role.alias("role"), text.alias("text"))).alias("t")).select("tree", "node", "t.role", "t.text")
    rows = found.join(said, ["tree", "node"])
    head = F.concat(F.lit(BEGIN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    rows = rows.select("tree", "leaf", "place", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    piece = F.concat("head", "body", F.lit(FINISH))
    upto = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length(piece)).over(upto) - len(FINISH)
    rows = rows.select("tree", "leaf", "place", piece.alias("piece"), F.when(F.col("role") == "assistant", F.struct((end - F.length("body")).alias("start"), end.alias("end"))).alias("span"))
    turns = F.array_sort(F.collect_list(F.struct("place", "piece", "span")))
    return rows.groupBy("tree", "leaf").agg(turns.alias("t")).select(
        "tree", "leaf", F.array_join("t.piece", "").alias("formatted"), F.filter("t.span", lambda s: s.isNotNull()).alias("loss")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, leaf, turns (array of role, text), loss_text, n chars: from the formatted strings and spans alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(BEGIN) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )
    under = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("tree", "leaf", turns.alias("turns"), F.array_join(under, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest_rows(turns: DataFrame) -> DataFrame:
    """Formats the best path of each conversation, which is a tree of one branch, and reads it back: counts and digests of each."""
    back = read_back(format_paths(turns_as_nodes(turns), best=1))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(spelled, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
