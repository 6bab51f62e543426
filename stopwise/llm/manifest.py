"""A Merkle manifest of a data set: a root over all rows, and a proof for each.

Leaves are hashed from whole rows and numbered by group and key. A block, an aligned run of
``FAN ** DEPTH`` nodes, keeps each of its levels as one string of hexadecimal digests laid end to
end. Substrings of a fixed width are hashed into the parents' string, and the substrings that flank
a node are its siblings. What blocks come to are nodes again, in blocks of their own, until a
group has one; the groups' roots are then the nodes of one last group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import cut, join_counted
from stopwise.operators.ranks import numbered

FAN, DIGEST = 16, 64
#: Levels that one block holds: 4096 nodes, in 256 runs.
DEPTH = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields one after the other: ``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _digest_at(level: Column, i: Column, n: Column | int = 1) -> Column:
    """The digests from the i-th on, n of them, or as many as there are."""
    return F.substring(level, (i * DIGEST + 1).cast("int"), (F.lit(n) * DIGEST).cast("int"))


def _flanks(level: Column, i: Column) -> Column:
    """The siblings on both sides of the i-th digest within its run of FAN."""
    head = F.floor(i / FAN) * FAN
    after = _digest_at(level, i + 1, head + FAN - 1 - i)
    return F.struct(_digest_at(level, head, i - head).alias("left"), after.alias("right"))


def _parents(level: Column) -> Column:
    """The level above: the hash of each run of FAN digests, laid end to end."""
    runs = F.ceil(F.length(level) / (FAN * DIGEST)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda r: F.sha2(_digest_at(level, r * FAN, FAN), 256)), "")


def _rounds(total: Column) -> Column:
    """How often a level of so many nodes is hashed until one is left, within one block."""
    size, out = F.lit(1), F.lit(0)
    for _ in range(DEPTH):
        out = out + (total > size).cast("int")
        size = size * FAN
    return out


def blocks(nodes: DataFrame) -> DataFrame:
    """``nodes(g, i, total, digest, own)`` as stored blocks ``(g, block, total, rounds, runs, levels, top)``.

    i numbers the ``total`` nodes of a group from 0. Runs hold up to FAN nodes in order and their
    string of digests; levels are the strings above, the first being the parents of all runs. top
    is the one digest that a block comes to. A block has no more nodes than ``FAN ** DEPTH``.
    """
    whole = FAN**DEPTH
    dealt = nodes.withColumn("block", F.floor(F.col("i") / whole)).withColumn("run", F.floor(F.col("i") % whole / FAN)).repartition("g", "block")
    runs = dealt.groupBy("g", "block", "total", "run").agg(F.sort_array(F.collect_list(F.struct("i", "digest", "own"))).alias("nodes"))
    runs = runs.withColumn("level", F.array_join(F.col("nodes.digest"), ""))
    held = runs.groupBy("g", "block", "total").agg(F.sort_array(F.collect_list(F.struct("run", "level", "nodes"))).alias("runs"))
    held = held.withColumn("rounds", _rounds(F.col("total")))
    # a group of one node is not hashed, and a run is what a single block of up to FAN nodes comes to
    first = F.array_join(F.transform("runs", lambda r: F.sha2(r["level"], 256)), "")
    out = held.withColumn("l1", F.when(F.col("rounds") > 0, first)).withColumn("l2", F.when(F.col("rounds") > 1, _parents(F.col("l1")))).withColumn("l3", F.when(F.col("rounds") > 2, _parents(F.col("l2"))))
    top = F.coalesce("l3", "l2", "l1", F.get("runs", F.lit(0))["level"])
    return cut(out.withColumn("top", top))


def paths(held: DataFrame, above: DataFrame | None) -> DataFrame:
    """``(g, i, digest, own, path)``: the siblings of each node of the blocks, level by level, up to the last level of ``above``.

    ``above(g, i, path)`` has the siblings that each block's top meets further up.
    """
    r = F.col("run.run")
    upper = F.array(F.when(F.col("rounds") > 1, _flanks(F.col("l1"), r)), F.when(F.col("rounds") > 2, _flanks(F.col("l2"), F.floor(r / FAN))))
    if above is not None:
        held = held.join(above.select("g", F.col("i").alias("block"), F.col("path").alias("above")), ["g", "block"])
    else:
        held = held.withColumn("above", F.array().cast("array<struct<left: string, right: string>>"))
    runs = held.select("g", "rounds", "l1", "l2", "above", F.explode("runs").alias("run"))
    runs = runs.select("g", "rounds", "run", F.concat(F.filter(upper, lambda x: x.isNotNull()), "above").alias("rest"))
    nodes = runs.select("g", "rounds", F.col("run.level").alias("level"), "rest", F.explode("run.nodes").alias("node"))
    own = F.when(F.col("rounds") > 0, F.array(_flanks(F.col("level"), F.col("node.i") % FAN))).otherwise(F.array())
    return nodes.select("g", "node.*", F.concat(own, "rest").alias("path"))


def trees(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The stored blocks of ``nodes`` step by step, and ``(g, root)``, one row a group.

    A step leaves one node in ``FAN ** DEPTH``; three steps serve 68 billion rows a group.
    """
    steps = [blocks(nodes)]
    while not steps[-1].where("block > 0").isEmpty():
        last = steps[-1]
        count = F.ceil(F.col("total") / FAN**DEPTH).cast("long")
        steps.append(blocks(last.select("g", F.col("block").alias("i"), count.alias("total"), F.col("top").alias("digest"), F.lit(None).cast("int").alias("own"))))
    return steps, steps[-1].select("g", F.col("top").alias("root"))


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf comes to with its siblings: each level hashes those on the left, itself, and those on the right."""
    return F.aggregate(path, digest, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def manifest(df: DataFrame, key: str, group: str, fields: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """``(key, group, leaf, subroot, root, path, proof_sha256, folded_root, verified)`` for every row.

    A leaf hashes ``fields``; of each ``group`` the leaves ascend by ``key`` (nulls first, rows that
    share a key by leaf), and subroots by group (null first, then by UTF-8 bytes). ``path`` holds the
    siblings ``(left, right)`` of each level from the leaf to the root, proof_sha256 hashes them all
    in order. folded_root is made anew from the original siblings and the leaf as it is now:
    ``changed`` gives other values for fields, as tampering would. verified says if it is the root.

    Null values hash as ``-``, unlike empty ones. Repeated rows are leaves of their own; a very long
    text is hashed whole where it is read, and nothing but digests is shuffled. A group of any size
    is dealt by ranges and blocks. An empty table gives no rows; other columns are ignored.
    """
    now = [(changed or {}).get(f, df[f]) for f in fields]
    grouped = F.when(df[group].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), df[group].cast("string")))
    leaves = cut(df.select(df[key].alias("key"), grouped.alias("g"), leaf_hash([df[f] for f in fields]).alias("digest"), leaf_hash(now).alias("now")))
    placed = numbered(leaves, [F.col("g"), F.asc_nulls_first("key"), F.col("digest")], "n_")
    sizes = cut(placed.groupBy("g").agg(F.count("*").alias("n"), F.min("n_").alias("base"), F.count("*").alias("total")))
    # a row's own values are kept where its digest is
    own = F.struct("key", "now").alias("own")
    nodes = join_counted(placed, sizes, "g").select("g", (F.col("n_") - F.col("base")).alias("i"), "total", "digest", own)
    steps, roots = trees(nodes)
    roots = cut(roots)
    count = roots.count()
    last = numbered(roots, [F.col("g")], "i").select(F.lit("").alias("g"), "i", F.lit(count).cast("long").alias("total"), F.col("root").alias("digest"), F.col("g").alias("own"))
    top_steps, top = trees(last)
    root = top.first()["root"] if count else ""
    above = None
    for step in reversed(top_steps):
        above = paths(step, above)
    # the last level of a group's own tree goes on where its root stands among the roots
    upward = cut(above.select(F.col("own").alias("g"), F.lit(0).cast("long").alias("i"), F.col("digest").alias("subroot"), "path"))
    found = upward
    for step in reversed(steps[1:]):
        found = cut(paths(step, found))
    rows = paths(steps[0], found)
    rows = rows.join(F.broadcast(upward.select("g", "subroot")), "g") if count <= 100_000 else join_counted(rows, cut(sizes.select("g", "n").join(upward.select("g", "subroot"), "g")), "g")
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    folded = fold(F.col("own.now"), F.col("path"))
    named = F.when(F.col("g") != "0", F.substring("g", 2, 1 << 30)).alias(group)
    out = rows.select(F.col("own.key").alias(key), named, F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 6) -> str:
    """DuckDB SQL for the query: each level a table of nodes, ``levels`` of them in a group and among the groups."""
    field = lambda f: f"coalesce(octet_length(encode({f}::varchar))::varchar || ':' || {f}::varchar, '-')"
    leaf = lambda t: "sha256(" + " || ".join(field(f) for f in ("doc_id", "source", "lang", "n_chars", t)) + ")"
    lowered = "if(k % 5 = 0, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), text)"
    step = "if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)"
    out = [
        f"bits as (select i, 0 as k, i::BIGINT as c from range(256) t(i) union all select i, k + 1, {step} from bits where k < 8)",
        "crc as (select list(c order by i) as t from bits where k = 8)",
        "docs as (select *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, i + 1, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as k from documents, crc)",
        f"a0 as (select doc_id, coalesce('1' || source, '0') as g, {leaf('text')} as d, {leaf(lowered)} as now from docs)",
        "l0 as (select *, row_number() over (partition by g order by doc_id nulls first, d) - 1 as i, count(*) over (partition by g) as m from a0)",
    ]

    def level(name: str, k: int, by: str) -> None:
        """Nodes of level k + 1, and of each node of level k the siblings on its left and right."""
        here = f"{name}{k}"
        out.append(f"{here}p as (select {by}, i // 16 as i, m, sha256(string_agg(d, '' order by i)) as d from {here} where m > 1 group by {by}, i // 16, m)")
        out.append(f"{name}{k + 1} as (select {by}, i, d, (m + 15) // 16 as m from {here}p union all select {by}, i, d, m from {here} where m = 1)")
        flank = lambda op: f"coalesce(string_agg(b.d, '' order by b.i) filter (where b.i {op} a.i), '')"
        out.append(f"{here}s as (select a.{by}, a.i, {flank('<')} as l, {flank('>')} as r from {here} a join {here} b on a.{by} = b.{by} and a.i // 16 = b.i // 16 where a.m > 1 group by all)")

    for k in range(levels):
        level("l", k, "g")
    out.append(f"u0 as (select g as own, 0 as z, d, row_number() over (order by g) - 1 as i, count(*) over () as m from l{levels})")
    for k in range(levels):
        level("u", k, "z")
    joins, proof, cols = "", [], []
    for name, by, at in (("l", "g", "i0"), ("u", "z", "j0")):
        for k in range(levels):
            s = f"{name}{k}s"
            joins += f" left join {s} on {s}.{by} = f.{by} and {s}.i = f.{at} // {16**k}"
            proof.append(f"coalesce({s}.l || {s}.r, '')")
            cols.append(f"{s}.l as {name}{k}l, {s}.r as {name}{k}r")
    out.append(
        f"f as (select a.doc_id, a.g, a.d, a.now, a.i as i0, u0.d as subroot, u0.i as j0, 0 as z, (select d from u{levels}) as root from l0 a join u0 on u0.own = a.g)"
    )
    out.append(f"h0 as (select f.doc_id, f.d as leaf, f.subroot, f.root, sha256({' || '.join(proof)}) as proof_sha256, f.now as x, {', '.join(cols)} from f{joins})")
    for n, at in enumerate(f"{name}{k}" for name in "lu" for k in range(levels)):
        out.append(f"h{n + 1} as (select * replace (if({at}l is null, x, sha256({at}l || x || {at}r)) as x) from h{n})")
    return f"with recursive {', '.join(out)} select doc_id, leaf, subroot, root, proof_sha256, x as folded_root, x = root as verified from h{2 * levels}"
