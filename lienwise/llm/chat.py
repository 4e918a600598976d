"""Chat formatting of reply trees, in DataFrame functions alone.

Messages name their parents. Pointer doubling finds the ancestors of every leaf
by self-joins: round r joins each message to its ancestor 2**r steps up, so a
thread of n turns takes about log2(n) rounds. The branches of a tree are ranked
by score, and each chosen root-to-leaf path becomes one conversation.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings
inside roles and texts get a backslash after their first character; where
backslashes stand there already, one more is added, so nothing is lost and no
text can hold a control string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings with a meaning in common chat templates.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _pattern(backslashes: str) -> str:
    heads = "".join(sorted({re.escape(c[0]) for c in CONTROL}))
    return f"([{heads}]){backslashes}(\\\\*(?:{'|'.join(re.escape(c[1:]) for c in CONTROL)}))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_pattern("")), F.lit(r"$1\\$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_pattern(r"\\")), F.lit("$1$2"))


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def reply_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """``(leaf, root, node, depth)``: the messages of the ``best`` branches (None:
    all) of each tree, depth 0 at the root.

    ``messages`` has msg_id, parent_id and score. A message whose parent is null
    or absent is a root. Branches rank by the sum of their scores (null: 0),
    ties by the smaller leaf id. Messages that no root reaches (a cycle) and
    rows without msg_id are on no path; of repeated ids the row with the
    smallest parent and score stays."""
    rows = messages.where("msg_id is not null").groupBy("msg_id").agg(F.min(F.struct("parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m"))
    rows = rows.select(F.col("msg_id").alias("node"), "m.parent_id", "m.score")
    known = rows.select(F.col("node").alias("parent_id"))
    parents = written(rows.join(known.withColumn("up", F.col("parent_id")), "parent_id", "left").select("node", "up", "score"), "messages")

    # jump: node, its ancestor 2**r up, the number of steps and the score on the way; it ends at the root
    step = F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")
    jump = parents.select("node", "up", step.alias("steps"), F.col("score").alias("total"), F.coalesce("up", "node").alias("top"))
    limit = max(1, parents.count()).bit_length() + 1
    leaves = parents.join(parents.select(F.col("up").alias("node")).where("node is not null").distinct(), "node", "left_anti").select(F.col("node").alias("leaf"))
    jumps = []
    for _ in range(limit):
        jump = written(jump, "jump")
        jumps.append(jump)
        if not jump.where("up is not null").head(1):
            break
        far = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"), F.col("top").alias("top2"))
        # only those that have not met their root yet move on
        moved = jump.where("up is not null").join(far, "up").select("node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("total") + F.col("total2")).alias("total"), F.col("top2").alias("top"))
        jump = moved.unionByName(jump.where("up is null"))
    # what still has an ancestor lies on a cycle or hangs from one
    settled = jumps[-1].where("up is null").select(F.col("node").alias("leaf"), F.col("top").alias("root"), F.col("steps").alias("length"), "total")
    chosen = leaves.join(settled, "leaf")
    if best is not None:
        ranks = Window.partitionBy("root").orderBy(F.desc("total"), "leaf")
        chosen = chosen.withColumn("_r", F.row_number().over(ranks)).where(F.col("_r") <= best).drop("_r")

    paths = chosen.select("leaf", "root", "length", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"))
    for r, jump in enumerate(jumps[:-1]):
        higher = paths.join(jump.where("up is not null").select("node", "up"), "node").select("leaf", "root", "length", F.col("up").alias("node"), (F.col("back") + (1 << r)).alias("back"))
        paths = written(paths.unionByName(higher), "paths")
    return paths.select("leaf", "root", "node", (F.col("length") - F.col("back")).alias("depth"))


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), _escape_role(F.coalesce(role, F.lit(""))), F.lit("\n"), escape(F.coalesce(text, F.lit(""))), F.lit(CLOSE + "\n"))


def format_paths(paths: DataFrame, messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """``(leaf, root, formatted, loss_spans)``, one row per path. loss_spans
    are the code-point ranges (start from 0, length) of the texts of role
    ``trained``, escaped as they stand. Null roles and texts are empty."""
    parts = messages.select(F.col("msg_id").alias("node"), F.struct("role", "text").alias("m")).groupBy("node").agg(F.min("m").alias("m"))
    turns = paths.join(parts, "node").select(
        "leaf",
        "root",
        F.struct(
            "depth",
            turn_text(F.col("m.role"), F.col("m.text")).alias("block"),
            F.char_length(escape(F.coalesce("m.text", F.lit("")))).alias("body"),
            (F.coalesce("m.role", F.lit("")) == trained).alias("loss"),
        ).alias("turn"),
    )
    rows = turns.groupBy("leaf", "root").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    tail = len(CLOSE) + 1
    walked = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["block"])).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.char_length(t["block"]) - tail - t["body"]).alias("start"), t["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return rows.select("leaf", "root", F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"), walked["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, that a formatted text holds."""
    blocks = F.filter(F.split(formatted, re.escape(OPEN)), lambda b: b != "")

    def turn(block: Column) -> Column:
        at = F.position(F.lit("\n"), block)
        body = F.substring(block, at + 1, F.char_length(block) - at - len(CLOSE) - 1)
        return F.struct(_unescape_role(F.substring(block, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(blocks, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages: each row replies to the one
    before it by turn (ties by role, then text; repeated rows are turns of their
    own). Rows without conv_id are left out; extra columns are ignored."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text").withColumn("_n", F.row_number().over(order).cast("long"))
    return rows.select(F.struct("conv_id", F.col("_n").alias("n")).alias("msg_id"), F.when(F.col("_n") > 1, F.struct("conv_id", (F.col("_n") - 1).alias("n"))).alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")
