"""Chat formatting of reply trees, in DataFrame operations only.

A tree is a set of rows (tree, node, parent, role, text, score). Ancestors at
1, 2, 4, ... steps come from joining the table of steps with itself until no one
has an ancestor that far; with these, a leaf collects its whole path in as many
joins. Branches are ranked by mean score, and each chosen one is written as one
conversation:

    ### role: text</turn>

In texts and roles a backslash is doubled, `### ` becomes `\\h`, `</turn>` `\\t` and,
in roles, `:` `\\c`, so that no text can look like a mark, and all can be read back.
`spans` has start and length (code points) of every turn's text in the result, and
whether it counts in the loss (role `assistant`).

Null texts and roles are empty; a null tree id is a tree of its own. A parent that
does not exist makes a root. Nodes must be unique within a tree; parents in a ring
are refused. Equal scores rank by leaf, a branch without a score last. Texts of any
length are kept whole: a conversation is one string, so a path has to fit in a task.
Rows of conversations (`as_trees`) are numbered within theirs, repeated rows one after
the other; rows without conv_id are one conversation. An empty table gives no
conversation. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.common import scratch, stored

HEAD, END = "### ", "</turn>"
LEARNED = "assistant"
MOST_DOUBLINGS = 48


def escaped(text: Column, role: bool = False) -> Column:
    for plain, coded in (("\\", "\\\\"), (HEAD, "\\h"), (END, "\\t"), *([(":", "\\c")] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescaped(text: Column) -> Column:
    """Double backslashes first part the text, as every backslash begins a code."""

    def decoded(part: Column) -> Column:
        for plain, coded in ((HEAD, "\\h"), (END, "\\t"), (":", "\\c")):
            part = F.replace(part, F.lit(coded), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), decoded), "\\")


def steps(nodes: DataFrame, folder: str) -> list[DataFrame]:
    """Tables (tree, node, above): the ancestor 1, 2, 4, ... steps above, where there is one."""
    parents = nodes.where(F.col("parent").isNotNull()).select("tree", "node", F.col("parent").alias("above"))
    known = nodes.select("tree", F.col("node").alias("above"))
    tables = [stored(parents.join(known, ["tree", "above"], "left_semi").select("tree", "node", "above"), f"{folder}/steps0")]
    while not tables[-1].isEmpty():
        if len(tables) > MOST_DOUBLINGS:
            raise ValueError("parents form a ring")
        low, high = tables[-1], tables[-1].select("tree", F.col("node").alias("above"), F.col("above").alias("top"))
        joined = low.join(high, ["tree", "above"]).select("tree", "node", F.col("top").alias("above"))
        tables.append(stored(joined, f"{folder}/steps{len(tables)}"))
    return tables[:-1]


def paths(nodes: DataFrame, tables: list[DataFrame], folder: str) -> DataFrame:
    """(tree, leaf, node, back): every node on the way from a leaf to its root, `back` steps above the leaf.

    What each level adds is stored and the next level reads it, so plans do not grow with the levels.
    """
    has_child = tables[0].select("tree", F.col("above").alias("node")) if tables else nodes.select("tree", "node").limit(0)
    leaves = nodes.select("tree", "node").join(has_child.distinct(), ["tree", "node"], "left_anti")
    added = [f"{folder}/way{len(tables)}"]
    found = stored(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("back")), added[0])
    for k in reversed(range(len(tables))):
        higher = found.join(tables[k], ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        added.append(f"{folder}/way{k}")
        higher.write.parquet(added[-1])
        found = nodes.sparkSession.read.schema(found.schema).parquet(*added)
    return found


def conversations(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """tree, leaf, branch_rank, score, n_turns, formatted and spans of each chosen branch; all unless `top` are asked for."""
    folder = scratch(nodes.sparkSession, "chat")
    nodes = stored(nodes.select("tree", "node", "parent", "role", "text", "score"), f"{folder}/nodes")
    way = paths(nodes, steps(nodes, folder), folder)
    scores = way.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc_nulls_last(), "leaf"))
    chosen = scores.withColumn("branch_rank", rank)
    chosen = chosen.where(F.col("branch_rank") <= top) if top is not None else chosen
    said = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.select("tree", "node", F.concat(F.lit(HEAD), escaped(F.col("role"), True), F.lit(": ")).alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == LEARNED).alias("loss"))
    turns = way.join(said, ["tree", "node"]).groupBy("tree", "leaf")
    turns = turns.agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "head", "body", "loss"))).alias("turns"))
    return turns.join(chosen, ["tree", "leaf"]).select(
        "tree", "leaf", "branch_rank", "score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias("formatted"),
        spans("turns").alias("spans"),
    )


def spans(turns: str) -> Column:
    """Start and length of each turn's text, from running lengths."""
    kind = "struct<at: bigint, all: array<struct<start: bigint, length: int, loss: boolean>>>"
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start: bigint, length: int, loss: boolean>>)").alias("all")).cast(kind)

    def add(done: Column, t: Column) -> Column:
        start, length = done["at"] + F.length(t["head"]), F.length(t["body"])
        one = F.struct(start.alias("start"), length.alias("length"), t["loss"].alias("loss"))
        return F.struct((start + length + len(END) + 1).alias("at"), F.concat(done["all"], F.array(one)).alias("all")).cast(kind)

    return F.aggregate(turns, begin, add, lambda done: done["all"])


def parsed(output: DataFrame) -> DataFrame:
    """The output with `turns` (role, text, and the text under the loss mask or null), read from it."""
    parts = F.split("formatted", END + "\n")
    pairs = F.arrays_zip(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("part"), F.col("spans").alias("span"))

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substr(p["part"], F.lit(len(HEAD) + 1)), ": ", 1)
        text = F.substr(p["part"], F.instr(p["part"], F.lit(": ")) + 2)
        masked = F.when(p["span"]["loss"], unescaped(F.right(p["part"], p["span"]["length"])))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"), masked.alias("masked"))

    return output.withColumn("turns", F.transform(pairs, turn))


def as_trees(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees of one branch: each turn replies to the one before (equal turns by role and text)."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(output: DataFrame) -> DataFrame:
    """conv_id and what the contract asks for, of one branch a tree."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.filter("turns", lambda t: t["masked"].isNotNull()), lambda t: t["masked"]), "")
    frame = parsed(output).withColumns({"told": told, "masked": masked})
    return frame.select(
        F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("told", 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
