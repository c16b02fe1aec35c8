"""Chat formatting of reply trees (operator 10), in DataFrame operations only.

Messages form trees by parent links. Self-joins double the distance they reach in each round: jump tables
lead from a message to its ancestors 1, 2, 4, ... steps up, and the scores on the way add up alongside. Leaves
are ranked in their tree by the mean score of their path; the chosen paths are listed by walking the jump
tables from the longest to the shortest, and each becomes one conversation.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``; a line break in a role becomes ``\\n``. So no text can hold a control
string, and all is read back exactly. The loss mask is a list of spans in code points, one for each assistant
text.

Null text and null role count as empty, null scores as 0. A message whose parent is missing is a root; a path
that leads into a circle has no root and is left out. Tree and node name a message: of rows that share both, the
first by parent, role, text and score is the message, and rows without a node, which nothing can name, are left
out. Rows with a null conversation id form one conversation of that id. Without node columns every row is a turn,
repeated ones too; equal turns are ordered by role and text, nulls first. A conversation's turns are numbered, and
joined to one string, in one task: its output is one row that holds them all. An empty table gives no rows. Texts
may have any length that a string may. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, read_table

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """The reverse of both escapes: between doubled backslashes, each other one belongs to one sign."""
    plain = F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(plain, "\\")


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, node, back) of the ``top`` best paths of each tree: ``back`` steps lead from the leaf to ``node``.

    messages: (tree, node, parent, score); tree and node are never null and name a message together.
    """
    nodes = materialize(messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "chat-nodes")
    known = nodes.select("tree", F.col("node").alias("parent"))
    up = nodes.join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up"))
    level = materialize(nodes.join(up, ["tree", "node"], "left").select("tree", "node", "up", "score", F.lit(1).cast("long").alias("length")), "chat-jumps")
    jumps = []
    for _ in range(max(1, nodes.count().bit_length()) + 1):
        if level.where("up is not null").isEmpty():
            break
        jumps.append(level.where("up is not null").select("tree", "node", "up"))
        far = level.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("score").alias("_score"), F.col("length").alias("_length"))
        joined = level.where("up is not null").join(far, ["tree", "up"])
        grown = joined.select("tree", "node", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"), (F.col("length") + F.col("_length")).alias("length"))
        level = materialize(level.where("up is null").unionByName(grown), "chat-jumps")
    inner = up.select("tree", F.col("up").alias("node")).distinct()
    leaves = level.where("up is null").join(inner, ["tree", "node"], "left_anti")
    order = W.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("length")), "node")
    paths = leaves.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(jumps))):
        step = jumps[k]
        paths = materialize(paths, "chat-paths")
        paths = paths.unionByName(paths.join(step, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back")))
    return paths


def formatted(turns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, formatted, mask) from (keys, place, role, text): mask lists the spans (start, length) of assistant texts."""
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    cut = turns.select(*keys, "place", (F.col("role") == LOSS_ROLE).alias("loss"), role.alias("role"), text.alias("text"))
    cut = cut.withColumn("turn", F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END)))
    before = F.coalesce(F.sum(F.char_length("turn")).over(W.partitionBy(*keys).orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = cut.select(*keys, "place", "turn", F.when(F.col("loss"), F.struct((before + len(START) + F.char_length("role") + 1).cast("long").alias("start"), F.char_length("text").cast("long").alias("length"))).alias("span"))
    rows = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "turn", "span"))).alias("t"))
    return rows.select(*keys, F.array_join("t.turn", "").alias("formatted"), F.array_compact("t.span").alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """``turns``, an array of (role, text), and ``loss``, the unescaped text under the mask, from the formatted strings."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        size = F.char_length(part) - F.char_length(role) - 1 - len(END)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(part, F.char_length(role) + 2, size)).alias("text"))

    parts = F.split("formatted", r"<\|im_start\|>", -1)
    loss = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return chats.withColumns({"turns": F.transform(F.slice(parts, 2, F.size(parts)), turn), "loss": F.array_join(loss, "")})


def chat(conversations: DataFrame, top: int = 1) -> DataFrame:
    """(conv_id, leaf, formatted, mask) from (conv_id, turn, role, text), each turn a reply to the one before.

    With columns node, parent and score the replies form a tree, and ``top`` paths of each are formatted.
    """
    key = F.coalesce(F.concat(F.lit("k"), F.col("conv_id").cast("string")), F.lit("null"))
    if {"node", "parent"} <= set(conversations.columns):
        score = F.col("score") if "score" in conversations.columns else F.lit(0.0)
        rows = conversations.select("conv_id", key.alias("tree"), F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"), "role", "text", score.cast("double").alias("score")).where("node is not null")
        message = F.struct("parent", "role", "text", "score", "conv_id")
        rows = rows.groupBy("tree", "node").agg(F.min(message).alias("m")).select("tree", "node", "m.*")
    else:
        order = W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
        rows = conversations.select("conv_id", key.alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
        rows = rows.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})
    rows = materialize(rows.select("conv_id", "tree", "node", "parent", "role", "text", "score"), "chat-rows")
    paths = best_paths(rows, top)
    turns = rows.join(paths, ["tree", "node"]).select("conv_id", "tree", "leaf", (-F.col("back")).alias("place"), "role", "text")
    return formatted(turns, ["conv_id", "tree", "leaf"]).drop("tree")


def op10_reply_tree_chat(spark, sf_dir):
    own = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = read_back(chat(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "<|im_end|><|im_start|>assistant ok"

OP10_SQL = r"""
WITH a AS (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM a)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY rn)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN t ELSE '' END, '' ORDER BY rn)) AS loss_sha256,
    CAST(sum(12 + 1 + 11 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(t, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
