"""Balanced sharding of linked documents by label propagation, in DataFrame operations only.

Documents with equal texts are linked. Every document begins in a shard by a hash, and a group of
linked documents takes the label that most of its members have. In each round the groups ask for
the shard of their label; requests are granted, whole groups only and large ones first, while the
shard's quota lasts, and what is denied takes the label of another shard with room. Unlinked
documents fill the shards up at the end, so that they never stand in a group's way. Groups are
moved as counts; documents are placed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.llm.common import cut, join_counted

#: Pieces that a queue is dealt in, so that no task holds a whole one; more beyond a million rows a piece.
PIECES = 32


def running(df: DataFrame, by: list[str], order: list[Column], amount: Column, name: str, piece: Column | None = None, pieces: int = PIECES) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows before this one among those of equal ``by``.

    The order is by ``piece`` (a hash of ``order``, unless given), then ``order``. Only the sums by
    piece are brought together, so a group of any size is shared by many tasks.
    """
    piece = F.pmod(F.xxhash64(*order), F.lit(pieces)).cast("int") if piece is None else piece
    dealt = df.withColumn("_piece", piece).withColumn("_amount", amount)
    sums = dealt.groupBy(*by, "_piece").agg(F.sum("_amount").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select(*by, "_piece", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.sum("_amount").over(Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn("_within", F.coalesce(within, F.lit(0))).join(bases, [*by, "_piece"])
    return out.withColumn(name, F.col("_base") + F.col("_within")).drop("_piece", "_amount", "_base", "_within")


def propagate(units: DataFrame, aims: list[int]) -> tuple[DataFrame, DataFrame, list[int]]:
    """Units ``(g, part, n, s)`` with label s under quotas: those placed, those that fit nowhere whole, and the rows left free in each shard.

    Every round writes what it grants and what it denies; rounds end when nothing more is granted.
    """
    free, todo, placed = list(aims), cut(units), []
    spark = units.sparkSession
    for turn in range(1, 10_000):
        quotas = spark.createDataFrame(list(enumerate(free)), "s int, free long")
        # larger units first; among those of about one size by hash
        size = F.ceil(F.log2(F.col("n"))).cast("int")
        piece = (40 - size) * PIECES + F.pmod(F.xxhash64("g", "part"), F.lit(PIECES)).cast("int")
        queue = running(todo, ["s"], [F.desc("n"), F.col("g"), F.col("part")], F.col("n"), "before", piece).join(F.broadcast(quotas), "s")
        asked = cut(queue.withColumn("granted", F.col("before") + F.col("n") <= F.col("free")))
        taken = {r["s"]: r["n"] for r in asked.where("granted").groupBy("s").agg(F.sum("n").alias("n")).collect()}
        rest = asked.where("not granted").select("g", "part", "n")
        if not taken:
            return _union(placed, units), rest, free
        placed.append(asked.where("granted").select("g", "part", "n", "s"))
        free = [f - taken.get(s, 0) for s, f in enumerate(free)]
        rooms = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(f).cast("long").alias("free")) for s, f in enumerate(free)])
        fits = F.filter(rooms, lambda x: x["free"] >= F.col("n"))
        label = F.get(fits, F.pmod(F.xxhash64("g", "part", F.lit(turn)), F.greatest(F.size(fits), F.lit(1))).cast("int"))["s"]
        # without a shard that could take it a unit keeps asking the first, and is denied
        todo = cut(rest.withColumn("s", F.coalesce(label, F.lit(0))))
    raise RuntimeError("labels did not settle")


def _union(frames: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.select("g", "part", "n", "s").limit(0)
    for f in frames:
        out = out.union(f)
    return out


def fill(units: DataFrame, free: list[int], pieces: int) -> DataFrame:
    """``(g, s, n)``: units laid end to end over the free places of the shards; only those at a border, or larger than a gap, are split."""
    ends = [sum(free[: s + 1]) for s in range(len(free))]
    slots = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e - f).cast("long").alias("lo"), F.lit(e).cast("long").alias("hi")) for s, (e, f) in enumerate(zip(ends, free, strict=True))])
    # linked units first, so that a border splits as few of them as can be
    piece = F.when(F.col("n") > 1, 0).otherwise(pieces) + F.pmod(F.xxhash64("g", "part"), F.lit(pieces)).cast("int")
    lo, end = F.col("lo"), F.col("lo") + F.col("n")
    laid = running(units, [], [F.col("g"), F.col("part")], F.col("n"), "lo", piece)
    parts = laid.select("g", "lo", end.alias("end"), F.explode(F.filter(slots, lambda x: (x["lo"] < end) & (x["hi"] > lo))).alias("to"))
    return parts.select("g", F.col("to.s").alias("s"), (F.least("end", "to.hi") - F.greatest("lo", "to.lo")).alias("n"))


def shard_documents(df: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` for every row, under the law ``rows``.

    Shard sizes in rows differ by one at most; ``slot`` numbers a shard's rows without gaps from 0;
    grown_shard is null under this law. size is the text's UTF-8 bytes plus 16, text_crc32 that of
    its bytes (0 for null). Rows of equal text are linked and lie in one shard; a group larger than
    a shard lies in as few as hold it, and one is split otherwise only if no shard has room for it.
    Null texts are linked to none but those of an equal key. A group may hold any part of all rows:
    it moves as counts, and its rows are numbered in pieces. Very long texts are hashed whole;
    repeated rows stay, each with its own slot; an empty table gives none; other columns are ignored.
    """
    t = F.coalesce(df[text], F.lit(""))
    # a null text is a group by itself, named after its key
    group = F.when(df[text].isNull(), F.concat(F.lit("null "), F.coalesce(df[key].cast("string"), F.lit("")))).otherwise(F.substring(F.sha2(df[text], 256), 1, 32))
    rows = df.select(
        df[key].alias("key"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), group.alias("g"), F.pmod(F.xxhash64(df[key], df[text]), F.lit(shards)).cast("int").alias("s"),
    )
    rows = cut(rows)
    total = rows.count()
    aims = [total // shards + (s < total % shards) for s in range(shards)]
    pieces = max(PIECES, total // (shards * 1_000_000) + 1)
    votes = rows.groupBy("g", "s").agg(F.count("*").alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), F.xxhash64("g", "s").alias("tie"), "s")))
    groups = cut(votes.groupBy("g").agg(ranked.alias("votes"), F.sum("n").alias("size")))
    # a group beyond a shard's share is as many units as it fills, with the labels of its next votes
    k = F.ceil(F.col("size") / max(1, min(aims))).cast("int")
    units = groups.where("size > 1").select("g", "votes", "size", k.alias("k"), F.explode(F.sequence(F.lit(0), k - 1)).alias("part"))
    n = F.floor(F.col("size") / F.col("k")) + (F.col("part") < F.col("size") % F.col("k")).cast("long")
    units = units.select("g", "part", n.alias("n"), F.get("votes", F.pmod(F.col("part"), F.size("votes")))["s"].alias("s"))
    placed, rest, free = propagate(units, aims)
    single = groups.where("size = 1").select("g", F.lit(0).alias("part"), F.lit(1).cast("long").alias("n"))
    held = placed.select("g", "s", "n").union(fill(rest.select("g", "part", "n").union(single), free, pieces))
    held = held.groupBy("g", "s").agg(F.sum("n").alias("n"))
    # a group in one shard needs no ranks; the rows of the others go by rank to the intervals of their shards
    homes = held.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("parts"), F.sum("n").alias("n"))
    ends = F.expr("transform(parts, (x, i) -> aggregate(slice(parts, 1, i + 1), 0L, (a, y) -> a + y.n))")
    homes = cut(homes.select("g", "n", ends.alias("ends"), F.col("parts.s").alias("parts")))
    body = join_counted(rows.drop("s"), homes, "g")
    columns = ["key", "size", "text_crc32"]
    whole = body.where(F.size("parts") == 1).select(*columns, F.get("parts", F.lit(0)).alias("shard"))
    split = running(body.where(F.size("parts") > 1), ["g"], [F.col("key"), F.col("size")], F.lit(1), "rank", pieces=pieces)
    parted = split.select(*columns, F.get("parts", F.size(F.filter("ends", lambda e: e <= F.col("rank")))).alias("shard"))
    placed_rows = cut(whole.union(parted))
    numbered = running(placed_rows, ["shard"], [F.col("key"), F.col("text_crc32")], F.lit(1), "slot", pieces=pieces)
    return numbered.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
