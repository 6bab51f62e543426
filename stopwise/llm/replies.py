"""Reply trees as conversations, in DataFrame operations only.

Messages that reply to one another make trees. Joins of the table of ancestors with itself double
their distance each round, and the pairs of a leaf and its ancestors double with them, so all
root-to-leaf paths are there after as many rounds as the depth has binary digits. Paths are ranked
by score within their tree, and each chosen one is formatted as a conversation: turns between marks,
control strings inside texts escaped, and a mask of the characters to learn from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.llm.common import HOT, cut, join_counted, measured
from stopwise.operators.ranks import numbered

#: Marks of the template: a turn is OPEN, role, BETWEEN, text, CLOSE.
OPEN, BETWEEN, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
END = "\n"
#: Control strings of common chat templates, which a text must not be taken for.
CONTROLS = [
    OPEN, BETWEEN, CLOSE, "<|endoftext|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>",
]
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without control strings: backslashes are doubled, then one goes in after the first letter of each control string.

    Only those put in stand alone, between letters that are no backslash, so ``unescaped`` finds
    exactly these; no control string is part of another.
    """
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    for c in CONTROLS:
        text = F.replace(text, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def ancestors(nodes: DataFrame, most_rounds: int = 40) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables ``(node, up)`` of the ancestor 1, 2, 4, ... replies above, and the nodes of no tree, those on a circle or below one.

    Every round joins the last table with itself. Rounds end when no node lies so deep, or when none
    was left out since the last round: what then remains has no root.
    """
    up = cut(nodes.where("parent is not null").join(nodes.select(F.col("node").alias("there")), F.col("parent") == F.col("there"), "left_semi").select("node", F.col("parent").alias("up")))
    tables, size = [], up.count()
    for _ in range(most_rounds):
        if not size:
            return tables, None
        tables.append(up)
        asked = cut(up.groupBy(F.col("up").alias("middle")).agg(F.count("*").alias("n")).join(up.select(F.col("node").alias("middle"), F.col("up").alias("further")), "middle"))
        up = cut(join_counted(up.withColumnRenamed("up", "middle"), asked, "middle").select("node", F.col("further").alias("up")))
        before, size = size, up.count()
        if size == before:
            return tables, up.select("node")
    raise RuntimeError("ancestors did not settle")


def branches(nodes: DataFrame) -> DataFrame:
    """``(tree, leaf, node, up)``: for every leaf all nodes of its path, ``up`` replies above it."""
    tables, lost = ancestors(nodes)
    parents = nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    leaves = nodes.join(parents, "node", "left_anti")
    if lost is not None:
        leaves = leaves.join(lost, "node", "left_anti")
    pairs = cut(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    for k, table in enumerate(tables):
        asked = cut(pairs.groupBy("node").agg(F.count("*").alias("n")).join(table.withColumnRenamed("up", "higher"), "node"))
        more = join_counted(pairs, asked, "node").select("tree", "leaf", F.col("higher").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        pairs = cut(pairs.union(more))
    return pairs


def ranked(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """``(tree, leaf, score, rank)``: the branches by the mean of ``scores(node, score)`` over their messages, best first; nulls count 0.

    Ties go to the longer branch, then to the smaller leaf. Ranks are places in one order of all
    branches less the first place of the tree, so a tree of any size is ranked by many tasks.
    """
    counted = cut(pairs.groupBy("node").agg(F.count("*").alias("n")).join(scores, "node"))
    each = join_counted(pairs, counted, "node").groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.count("*").alias("length"))
    placed = numbered(cut(each), [F.asc_nulls_first("tree"), F.desc("score"), F.desc("length"), F.col("leaf")], "place")
    first = cut(placed.groupBy(F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("name"), F.col("tree").isNull().alias("none")).agg(F.min("place").alias("first"), F.count("*").alias("n")))
    named = placed.withColumn("own", F.struct(F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("name"), F.col("tree").isNull().alias("none")))
    out = join_counted(named, first.select(F.struct("name", "none").alias("own"), "first", "n"), "own")
    return out.select("tree", "leaf", "score", (F.col("place") - F.col("first") + 1).alias("rank"))


def formatted(turns: DataFrame, by: list[str], order: str, role: str = "role", text: str = "text") -> DataFrame:
    """``(by, formatted, learn)``: the turns of each group in order, and where the learned texts stand, ``(start, end)`` in code points."""
    r, t = (escaped(F.coalesce(F.col(c), F.lit(""))) for c in (role, text))
    head, body = F.concat(F.lit(OPEN), r, F.lit(BETWEEN)), F.concat(F.lit(CLOSE), F.lit(END))
    rows = turns.select(*by, F.col(order).alias("_at"), head.alias("_head"), t.alias("_text"), (F.col(role) == LEARNED).alias("_learn"), *(["times"] if "times" in turns.columns else []))
    if "times" in turns.columns:
        rows = rows.where("times = 1").drop("times").unionByName(rows.where("times > 1").withColumn("_", F.explode(F.expr("sequence(1, times)"))).drop("times", "_"))
    # repeats of a turn are alike, so their order does not matter
    before = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("_head") + F.char_length("_text") + len(CLOSE + END)
    rows = rows.withColumn("_begin", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("_head"))
    span = F.when(F.coalesce("_learn", F.lit(False)), F.struct(F.col("_begin").alias("start"), (F.col("_begin") + F.char_length("_text")).alias("end")))
    rows = rows.select(*by, F.struct("_at", F.concat("_head", "_text", body).alias("turn"), span.alias("span")).alias("_turn"))
    turn = rows.groupBy(*by).agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return turn.select(*by, F.array_join(F.transform("_turns", lambda x: x["turn"]), "").alias("formatted"), F.filter(F.transform("_turns", lambda x: x["span"]), lambda s: s.isNotNull()).alias("learn"))


def read_back(formatted_: Column) -> Column:
    """The turns ``(role, text)`` of a formatted conversation."""
    pieces = F.split(formatted_, f"\\Q{OPEN}\\E")
    turns = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        at = F.locate(BETWEEN, piece)
        text = F.substring(piece, at + len(BETWEEN), F.char_length(piece) - at - (len(BETWEEN) - 1) - len(CLOSE + END))
        return F.struct(unescaped(F.substring(piece, F.lit(1), at - 1)).alias("role"), unescaped(text).alias("text"))

    return F.transform(turns, turn)


def reply_trees(
    messages: DataFrame, best: int = 1, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str = "score",
    links: DataFrame | None = None,
) -> DataFrame:
    """``(tree, leaf, score, rank, formatted, learn)``: the ``best`` branches of every tree as conversations.

    A message whose parent is null or not in the table is a root; a tree may have several roots and
    leaves. Messages on a circle of replies, or below one, are in no branch. Null roles and texts
    are empty, null scores 0; messages with a null node are left out, and rows that repeat a node
    must be told apart by the caller. Roles and texts hold anything, control strings too. A
    conversation is one value, so one that is longer than a row may be fails; trees of any number
    of branches are ranked by many tasks. An empty table gives none; other columns are ignored.

    Paths are found on ``links(tree, node, parent, score, times)`` alone, which are columns of the
    messages unless given; texts are shuffled to their branches at the end. ``times`` says how often
    a message stands in its place.
    """
    if links is None:
        links = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(score).cast("double").alias("score"), F.lit(1).cast("long").alias("times"))
        links = cut(links.where("node is not null"))
    pairs = branches(links.select("tree", "node", "parent"))
    chosen = cut(ranked(pairs, links.select("node", "score")).where(F.col("rank") <= best))
    times = links.select("node", "times").where("times > 1")
    kept = cut(pairs.drop("tree").join(chosen, "leaf").join(times, "node", "left").withColumn("times", F.coalesce("times", F.lit(1).cast("long"))))
    # messages of many chosen branches are broadcast, a thousand at most; the others meet theirs by shuffle
    total = kept.count()
    often = cut(kept.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") * HOT >= max(total, HOT * HOT)).select("node"))
    said = messages.select(F.col(node).alias("node"), F.col(role).alias("role"), F.col(text).alias("text"))
    shared = said.join(F.broadcast(often), "node", "left_semi")
    turns = kept.join(F.broadcast(often), "node", "left_anti").join(said, "node").unionByName(kept.join(measured(cut(shared)), "node"))
    return formatted(turns.withColumn("at", -F.col("up")), ["tree", "leaf", "score", "rank"], "at")


def chains(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``df`` as messages ``(tree, node, role, text)`` and their links: each row replies to the one before it in its conversation.

    Rows are taken by turn, nulls first, ties by role and text. A digest of a row names it; rows that
    repeat as a whole are one message that stands several times. The number of each in that order
    finds its parent: a join on the number before.
    """
    named = df.select(F.col(conversation).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    digest_ = F.md5(F.to_json(F.struct(*named.columns)).cast("binary"))
    m = named.select(digest_.alias("node"), *named.columns)
    order = [F.asc_nulls_first(c) for c in ("tree", "turn", "role", "text")]
    placed = numbered(m, order, "at", keep=["tree", "node"])
    ones = cut(placed.groupBy("tree", "node").agg(F.min("at").alias("at"), F.count("*").alias("times")))
    # the next message begins where the repeats of this one end
    before = ones.select((F.col("at") + F.col("times")).alias("at"), F.col("node").alias("parent"), F.struct("tree").alias("own"))
    linked = ones.withColumn("own", F.struct("tree")).join(before, ["at", "own"], "left")
    links = cut(linked.select("tree", "node", "parent", F.lit(0.0).alias("score"), "times"))
    again = links.where("times > 1").select("node")
    once = m if again.isEmpty() else m.join(again, "node", "left_anti").unionByName(m.join(again, "node", "left_semi").dropDuplicates(["node"]))
    return once.select("tree", "node", "role", "text"), links


def conversations(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conversation, formatted, learn)`` of every conversation: its one branch, formatted.

    Rows of a null conversation are one conversation. See ``chains`` and ``reply_trees``.
    """
    messages, links = chains(df, conversation, turn, role, text)
    out = reply_trees(messages, links=links)
    return out.select(F.col("tree").alias(conversation), "formatted", "learn")


def digest(df: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """``(conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, all read from formatted conversations."""
    turns = read_back(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.transform("learn", lambda s: unescaped(F.substring("formatted", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    read = df.select(conversation, turns.alias("turns"), F.array_join(masked, "").alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        conversation, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def oracle() -> str:
    """DuckDB SQL for the query; the formatted length is counted from what the escapes put in."""
    t = "coalesce(text, '')"
    grown = "replace({0}, '\\', '\\\\')"
    for c in CONTROLS:
        grown = f"replace({grown}, '{c}', '{c[0]}\\{c[1:]}')"
    marks = len(OPEN + BETWEEN + CLOSE + END)
    return f"""
with rows_ as (select conv_id, turn, role, text, 0 as extra from conversations
  union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]', 1), (-1, 1, 'assistant', '</s>[INST] ok [/INST]', 1)) v(conv_id, turn, role, text, extra)),
said as (select conv_id, count(*) as n_turns, string_agg(coalesce(role, '') || chr(10) || {t} || chr(10), '' order by turn nulls first, role nulls first, text nulls first) as turns,
  coalesce(string_agg({t}, '' order by turn nulls first, text nulls first) filter (where role = 'assistant'), '') as loss,
  sum({marks} + length({grown.format("coalesce(role, '')")}) + length({grown.format(t)})) as chars from rows_ group by conv_id)
select conv_id::BIGINT as conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::BIGINT as loss_chars, sha256(loss) as loss_sha256, chars::BIGINT as formatted_chars from said"""
