"""Chat formatting over reply trees.

Messages form trees (a message answers its parent).  Root-to-leaf paths are
enumerated by iterative self-joins with doubled jumps: the ancestor table of
step 2^k is the self-join of the table of step 2^(k-1); from the leaves, one
join per step (largest first) then adds every distance exactly once.  A path
of n messages costs about 2 log2(n) joins and n rows, whatever the shape of
the tree, and every join is on a unique message key, so no key is hot.  Each
round writes its table to the shared checkpoint folder and the next one reads
it, so a round's plan is one join over two scans however deep the trees are,
and a lost executor repeats tasks of its round only.

Branches are ranked by the sum of their messages' scores and each chosen path
becomes one conversation.  One conversation is one output text, so its
messages meet in one row; nothing larger than one conversation does.

Template: every turn is ``<|turn|>role\\ntext<|end|>``.  Control strings inside
a role or text (the template's own and those of common chat models) are broken
by a backslash after their first character, and a backslash becomes two, so
unescaping gives back the exact input.  The loss mask lists the code point
spans of the assistant texts.

Defined results: null role or text count as empty; a null tree id is a tree of
its own; a message whose parent is absent is a root; rows that repeat a turn
stay separate turns, ordered by role and text; an empty table gives an empty
table; a cycle of parents raises an error.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketflow.session import materialize, scratch_dir

TURN, END = "<|turn|>", "<|end|>"
CONTROL = re.compile(r"\\|<(?=\||/?s>|/?unk>|/?pad>|</?SYS>>)|\[(?=/?INST\])")
ESCAPED = re.compile(r"([\\<\[])\\")
LINE, ROLE_LINE = "\n", "<|line|>"
SPECIAL = (-7, "</s>[INST] ok [/INST]")


def escape(text: str) -> str:
    """A backslash after the first character of a control string, and after a backslash."""
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """Exact inverse of ``escape``: drops the backslash after ``<``, ``[`` and backslash."""
    return ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, loss mask spans) of one conversation."""
    out, spans, at = [], [], 0
    for role, text in turns:
        # a line break would end the role; an escaped role holds no "<|"
        head = f"{TURN}{escape(role).replace(LINE, ROLE_LINE)}{LINE}"
        body = escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        if not part.endswith(END):
            raise ValueError("a turn without its end mark")
        role, text = part[:-len(END)].split(LINE, 1)
        turns.append((unescape(role.replace(ROLE_LINE, LINE)), unescape(text)))
    return turns


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` through a table in the shared checkpoint folder: its plan is one scan."""
    path = scratch_dir(df.sparkSession, f"replies-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, node, parent, score) -> (tree, branch, leaf, node, steps): the messages of
    each tree's ``branches`` best root-to-leaf paths, ``steps`` counted from the leaf.

    Branches are ranked by the sum of scores, ties by the smaller leaf.
    """
    nodes = _written(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")
    have = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
    same_tree = F.col("tree").eqNullSafe(F.col("t"))
    jump = _written(nodes.join(have, same_tree & (F.col("parent") == F.col("n")), "left_semi")
                    .select("tree", "node", F.col("parent").alias("up")), "jump")
    inner = jump.select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    path = nodes.join(inner, same_tree & (F.col("node") == F.col("n")), "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("steps"))
    limit = nodes.count()
    jumps = []
    while not jump.isEmpty():
        if 2 ** len(jumps) > limit:
            raise ValueError("the parents of some messages form a cycle")
        jumps.append(jump)
        further = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("far"))
        jump = _written(jump.join(further, same_tree & (F.col("up") == F.col("n"))).select(
            "tree", "node", F.col("far").alias("up")), "jump")
    for k in reversed(range(len(jumps))):
        step = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        moved = path.join(step, same_tree & (F.col("node") == F.col("n"))).select(
            "tree", "leaf", F.col("up").alias("node"), (F.col("steps") + 2 ** k).alias("steps"))
        # written at once: the union of two unwritten copies would double the plan
        path = _written(path.unionAll(moved), "path")
    scores = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
    total = path.join(scores, same_tree & (F.col("node") == F.col("n"))).groupBy("tree", "leaf").agg(
        F.sum("score").alias("score"))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    chosen = total.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches).select(
        F.col("tree").alias("t"), F.col("leaf").alias("l"), "branch")
    return path.join(chosen, same_tree & (F.col("leaf") == F.col("l"))).select("tree", "branch", "leaf", "node", "steps")


def format_trees(messages: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """(tree, node, parent, score, role, text) -> one row per chosen branch: tree, branch,
    ``formatted`` and ``loss`` (array of start, end)."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(span))])

    @F.pandas_udf(out)
    def formatted(turns: pd.Series) -> pd.DataFrame:
        rows = [format_turns([(t["role"], t["text"]) for t in x], learn) for x in turns]
        return pd.DataFrame({"formatted": [r[0] for r in rows],
                             "loss": [[{"start": s, "end": e} for s, e in r[1]] for r in rows]})

    paths = reply_paths(messages, branches)
    said = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"),
                           F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    chats = turns.groupBy("tree", "branch").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("at"), "role", "text"))).alias("turns"))
    return chats.select("tree", "branch", formatted("turns").alias("f")).select("tree", "branch", "f.*")


def conversation_messages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as chains: each row answers the row before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order)
    return rows.select(F.col("conv_id").alias("tree"), node.cast("long").alias("node"), "role", "text").withColumn(
        "parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def _read_back(formatted: pd.Series, loss: pd.Series) -> pd.DataFrame:
    rows = []
    for text, spans in zip(formatted, loss):
        turns = read_turns(text)
        learned = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned),
                     hashlib.sha256(learned.encode()).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    from ticketflow.llm.tables import table

    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(SPECIAL[0], i, r, SPECIAL[1]) for i, r in enumerate(("user", "assistant"))],
                                  "conv_id long, turn long, role string, text string")
    # numbered once: two evaluations could order equal rows differently
    messages = materialize(conversation_messages(rows.unionByName(extra)))
    chats = format_trees(messages)
    read = F.pandas_udf(_read_back, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                    "formatted_chars long")
    return chats.select(F.col("tree").alias("conv_id"), read("formatted", "loss").alias("r")).select("conv_id", "r.*")
