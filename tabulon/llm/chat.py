"""Chat formatting of reply trees.

Messages point to the message that they answer.  Self-joins enumerate the
root-to-leaf paths: each round joins every message that has not come to a root
with the message it points to, so that pointers double and a chain of n replies
takes log2(n) rounds.  A message holds its pointer, the length and the sum of
scores only.  The paths of a tree are ranked by the mean score of their messages;
the best ``top_k`` are spelled out by the pointers of all rounds and formatted,
one conversation each.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control
strings inside a text (or role) are broken reversibly: the character U+0010
always comes with one letter that says what it stands for, so that no text can
open or close a turn.  The loss mask lists the code-point spans of assistant
texts.

Defined results: a null text or role is empty; a reply to a message that does
not exist starts a tree; messages of a cycle lie on no root-to-leaf path and
give no row; repeated (tree, id) rows are dropped but for the first by role and
text; ties in score go to the lesser leaf id; a long chain of replies is as many
rows, and a formatted conversation is one text; an empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates (fixed values).
CONTROL = (
    "<|im_start|>",
    "<|im_end|>",
    "<|startoftext|>",
    "<|endoftext|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "<|end|>",
    "<s>",
    "</s>",
    "<<SYS>>",
    "<</SYS>>",
    "<bos>",
    "<eos>",
    "<start_of_turn>",
    "<end_of_turn>",
    "[INST]",
    "[/INST]",
)
ESC = "\x10"


def _ahead(first: str) -> str:
    rest = "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first)
    return f"{re.escape(first)}(?={rest})"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESC), F.lit(ESC + "d"))
    return F.regexp_replace(F.regexp_replace(out, _ahead("<"), ESC + "l"), _ahead("["), ESC + "b")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: U+0010 itself, whose letter is d, comes last."""
    for letter, stands_for in (("l", "<"), ("b", "["), ("n", "\n"), ("d", ESC)):
        text = F.replace(text, F.lit(ESC + letter), F.lit(stands_for))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ESC + "n"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def leaves(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, id, n, total) of each leaf that hangs on a root, ``n`` messages and
    their scores counting from there; and for each round k the table of
    (tree, id, above), ``above`` being 2**k messages up.

    ``messages`` has tree, id, parent (null at a root) and score.
    """
    own = messages.select("tree", "id", "parent", "score")
    real = own.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there")).distinct()
    start = own.alias("o").join(real.alias("r"), _same("o", "r") & (F.col("o.parent") == F.col("r.parent")), "left")
    above = F.when(F.col("r.there"), F.col("o.parent")).alias("above")
    score = F.coalesce(F.col("o.score").cast("double"), F.lit(0.0)).alias("total")
    state = materialise(start.select("o.tree", "o.id", above, F.lit(1).cast("bigint").alias("n"), score), "messages")
    jumps = [state]
    most = state.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    # a path is no longer than its tree; who has not come to a root by then is on a cycle
    while 1 << (len(jumps) - 1) < most and not state.filter("above IS NOT NULL").isEmpty():
        a, b = state.filter("above IS NOT NULL").alias("a"), state.alias("b")
        longer = a.join(b, _same("a", "b") & (F.col("a.above") == F.col("b.id"))).select(
            "a.tree", "a.id", "b.above", (F.col("a.n") + F.col("b.n")).alias("n"), (F.col("a.total") + F.col("b.total")).alias("total")
        )
        state = materialise(state.filter("above IS NULL").unionByName(longer), "messages")
        jumps.append(state)
    parents = jumps[0].select("tree", F.col("above").alias("id")).filter("id IS NOT NULL").distinct()
    done = state.filter("above IS NULL").alias("s")
    ends = done.join(parents.alias("p"), _same("s", "p") & (F.col("s.id") == F.col("p.id")), "left_anti")
    return ends.select("tree", "id", "n", "total"), [j.filter("above IS NOT NULL").select("tree", "id", "above") for j in jumps]


def spell_out(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, k, id): a row a message of the chosen paths (tree, leaf, n);
    ``k`` counts from 0 at the root.  Each round looks up what lies 2**r messages
    above all found so far, so a path of n messages is n rows after log n joins."""
    rows = chosen.select("tree", "leaf", (F.col("n") - 1).alias("k"), F.col("leaf").alias("id"))
    for r in range(len(jumps) - 1, -1, -1):
        up = rows.filter(F.col("k") >= (1 << r)).alias("a").join(jumps[r].alias("b"), _same("a", "b") & (F.col("a.id") == F.col("b.id")))
        rows = materialise(rows.unionByName(up.select("a.tree", "a.leaf", (F.col("a.k") - (1 << r)).alias("k"), F.col("b.above").alias("id"))), "paths")
    return rows


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, path, total): message ids from a root to each leaf."""
    ends, jumps = leaves(messages)
    ends = materialise(ends.withColumnRenamed("id", "leaf"), "leaves")
    paths = spell_out(ends, jumps).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("k", "id"))).alias("x"))
    e, p = ends.alias("e"), paths.alias("p")
    return e.join(p, _same("e", "p") & (F.col("e.leaf") == F.col("p.leaf"))).select("e.tree", "e.leaf", F.transform("p.x", lambda x: x["id"]).alias("path"), "e.total")


def _turn_head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def parse_turns(text: Column) -> Column:
    """The array of (role, text) that ``format_turns`` was given."""
    pieces = F.filter(F.split(text, re.escape(CLOSE)), lambda p: p != "")

    def turn(p: Column) -> Column:
        return let(
            F.substring_index(p, "\n", 1),
            lambda head: F.struct(
                unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
                unescape(F.substr(p, F.char_length(head) + 2)).alias("text"),
            ),
        )

    return F.transform(pieces, turn)


def masked_text(text: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(text, m["start"] + 1, m["end"] - m["start"]))), "")


def format_trees(messages: DataFrame, top_k: int = 1, learn_from: str = "assistant") -> DataFrame:
    """(tree, rank, leaf, score, n_turns, formatted, loss_mask) of the best paths.

    ``messages`` has tree, id, parent, role, text and score.
    """
    one = Window.partitionBy("tree", "id").orderBy("role", "text")
    own = messages.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    own = materialise(own.select("tree", "id", "parent", "role", "text", "score"), "messages")
    ends, jumps = leaves(own)
    mean = F.col("total") / F.col("n")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ranked = ends.select("tree", F.col("id").alias("leaf"), "n", mean.alias("score")).withColumn("rank", F.row_number().over(order))
    chosen = materialise(ranked.filter(F.col("rank") <= top_k), "chosen")
    steps = spell_out(chosen, jumps).alias("s")
    m = own.select("tree", "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m")
    said = steps.join(m, _same("s", "m") & (F.col("s.id") == F.col("m.id"))).select("s.tree", "s.leaf", "s.k", "m.role", "m.text")
    head = _turn_head(_escape_role(F.col("role")))
    parts = said.select("tree", "leaf", "k", (F.col("role") == learn_from).alias("learn"), head.alias("head"), escape(F.col("text")).alias("safe"))
    ends_at = Window.partitionBy("tree", "leaf").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    piece = F.concat("head", "safe", F.lit(CLOSE))
    end = F.sum(F.char_length(piece)).over(ends_at).cast("int") - len(CLOSE)
    placed = parts.select("tree", "leaf", "k", "learn", piece.alias("piece"), end.alias("end"), F.char_length("safe").alias("size"))
    out = placed.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("k", "piece", "learn", "end", "size"))).alias("x"))
    span = lambda x: F.struct((x["end"] - x["size"]).alias("start"), x["end"].alias("end"))
    c, o = chosen.alias("c"), out.alias("o")
    return c.join(o, _same("c", "o") & (F.col("c.leaf") == F.col("o.leaf"))).select(
        "c.tree",
        "c.rank",
        "c.leaf",
        "c.score",
        F.size("o.x").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("o.x", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("o.x", lambda x: x["learn"]), span).alias("loss_mask"),
    )


def threads(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of linear conversations: each turn answers the one before it."""
    order = Window.partitionBy(conv).orderBy(turn, role, text)
    n = F.row_number().over(order).cast("bigint")
    return rows.select(F.col(conv).alias("tree"), F.col(role).alias("role"), F.col(text).alias("text"), n.alias("id")).select(
        "tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )
