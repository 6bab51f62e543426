"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The corpus becomes postings ``(term, row, position)`` of all terms that a test window has, and
these are stored. Of each window the terms are ranked by their number of postings. The list of the
rarest, shifted by its offset in the window, gives the places where the window could begin; it is
intersected with the shifted list of the second rarest, and then with those of all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import BROADCAST_BYTES, cut, join_counted, measured, written_size

#: Fixed value: words are runs of digits, letters and all that is not ASCII. These are the gaps, before A-Z are lowered.
WORD_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column, lowered: bool = True) -> Column:
    """The words of a text, A-Z in lower case unless their number alone matters; none for null."""
    if lowered:  # lower() is the fast way where it does the same
        text = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(text, WORD_GAPS), ""), F.array().cast("array<string>"))


def windows_of(items: DataFrame, item: str = "item_id", text: str = "text", width: int = 13) -> DataFrame:
    """``(window, words, items)``: all runs of ``width`` words of the items; a shorter item is one window. Items without id or words have none."""
    w = items.select(F.col(item).alias("item"), words_of(F.col(text)).alias("all")).where((F.size("all") > 0) & F.col("item").isNotNull())
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - width + 1))
    runs = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, width))).alias("words"))
    # a window that several items or places share is searched once
    return runs.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.xxhash64("words").alias("window"), "words", "items")


def postings(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, row, term, position)``, stored: every place, from 1, of each of ``terms(term, id)`` in the rows of ``docs``; term is the id.

    ``row`` is a hash of key and text, so that rows that share a key are told apart and repeated
    rows are one posting list each. The terms are broadcast if they fit; otherwise they are counted
    in the corpus first, and only those that are not hot are shuffled.
    """
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = d.select("key", F.xxhash64("key", "text").alias("row"), words_of(F.col("text")).alias("words"))
    places = rows.select("key", "row", F.posexplode("words").alias("place", "word"))
    if written_size(terms) <= BROADCAST_BYTES:
        found = places.join(F.broadcast(terms), places["word"] == terms["term"])
    else:
        counts = places.groupBy("word").agg(F.count("*").alias("n")).join(terms.withColumnRenamed("term", "word"), "word")
        found = join_counted(places, cut(counts), "word")
    return cut(found.select("key", "row", F.col("id").alias("term"), (F.col("place") + 1).alias("position")))


def term_ids(windows: DataFrame) -> DataFrame:
    """``(term, id)`` of all words of the windows."""
    return cut(windows.select(F.explode("words").alias("term")).distinct().withColumn("id", F.monotonically_increasing_id()))


def ranked(windows: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """``(window, n_words, parts)``: the words of each window as ``(n, offset, term)``, the rarest in the index first.

    Windows with a word that the corpus lacks occur nowhere and are left out.
    """
    counts = index.groupBy("term").agg(F.count("*").alias("n")).withColumnRenamed("term", "id")
    known = terms.join(counts, "id")
    placed = windows.select("window", F.size("words").alias("n_words"), F.posexplode("words").alias("offset", "term")).join(known, "term")
    parts = F.sort_array(F.collect_list(F.struct("n", "offset", F.col("id").alias("term"))))
    return cut(placed.groupBy("window", "n_words").agg(parts.alias("parts")).where(F.size("parts") == F.col("n_words")))


def phrase_matches(index: DataFrame, found: DataFrame) -> DataFrame:
    """``(key, row, window, start, n_words)``: every exact occurrence of the windows ``found`` (see ``ranked``) in the index; start counts from 1."""

    def part(i: int) -> DataFrame:
        at = F.get("parts", F.lit(i))
        return found.where(F.size("parts") > i).select("window", "n_words", at["term"].alias("term"), at["offset"].alias("offset"))

    # the rarest list of each window, shifted to where the window would begin
    first = index.join(measured(part(0)), "term").withColumn("start", F.col("position") - F.col("offset")).where("start > 0")
    first = cut(first.select("key", "row", "window", "start", "n_words"))
    # only the lists of rows that still have a candidate are read on
    some = cut(first.select("row").distinct())
    lists = index.join(measured(some), "row", "left_semi").select("row", "term", "position")
    sought = first.join(measured(part(1).select("window", "term", "offset")), "window").withColumn("position", F.col("start") + F.col("offset"))
    second = cut(sought.join(lists, ["row", "term", "position"], "left_semi").select(*first.columns))
    rest = found.select("window", F.explode(F.slice("parts", 3, F.greatest(F.lit(1), F.size("parts")))).alias("part"))
    rest = second.join(measured(cut(rest.select("window", "part.term", "part.offset"))), "window").withColumn("position", F.col("start") + F.col("offset"))
    met = rest.join(lists, ["row", "term", "position"], "left_semi").groupBy("key", "row", "window", "start", "n_words").agg(F.count("*").alias("met"))
    return (
        first.where("n_words = 1").union(second.where("n_words = 2")).union(met.where(F.col("met") == F.col("n_words") - 2).drop("met"))
    )


def proximity_matches(docs: DataFrame, windows: DataFrame, slack: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, window, start, span)``: places where all words of a window, repeats included, lie in its order within ``slack`` extra words.

    By the same index: each posting of a window's first word begins a search, and the later words
    are found one after the other, each at its first posting after the last. The postings that a
    search can reach lie within the window's length and the slack, and are gathered for it.
    """
    terms = term_ids(windows)
    index = postings(docs, terms, key, text)
    coded = windows.select("window", F.posexplode("words").alias("offset", "term")).join(terms, "term")
    coded = cut(coded.groupBy("window").agg(F.sort_array(F.collect_list(F.struct("offset", "id"))).alias("parts")).select("window", F.col("parts.id").alias("ids")))
    begin = index.join(measured(coded.select("window", "ids", F.get("ids", F.lit(0)).alias("term"))), "term").select("row", "window", "ids", F.col("position").alias("start"))
    reach = F.col("start") + F.size("ids") + slack - 1
    # a begin looks into the pieces of a row that it reaches; pieces are as long as the longest reach
    length = (windows.agg(F.max(F.size("words"))).first()[0] or 0) + slack + 1
    asked = begin.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor(reach / length))))
    others = index.select("row", F.floor(F.col("position") / length).alias("piece"), "position", "term")
    there = asked.join(others, ["row", "piece"]).where((F.col("position") >= F.col("start")) & (F.col("position") <= reach) & F.array_contains("ids", F.col("term")))
    lists = there.groupBy("row", "window", "start", "ids").agg(F.sort_array(F.collect_set(F.struct("position", "term"))).alias("near"))

    def step(at: Column, word: Column) -> Column:
        after = F.filter("near", lambda x: (x["position"] > at) & (x["term"] == word))
        return F.when(at < 0, at).otherwise(F.coalesce(F.get(after, F.lit(0))["position"], F.lit(-1)))

    last = F.aggregate("ids", F.col("start") - 1, step)
    out = lists.select("row", "window", "start", (last - F.col("start") + 1).alias("span"), F.size("ids").alias("n"))
    return out.where((F.col("span") > 0) & (F.col("span") <= F.col("n") + slack)).drop("n")


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", width: int = 13,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) and n_words, n_hit, n_items, items_sha256, contaminated, for every row.

    A word is hit if it lies inside an occurrence of a window of an item; a row is contaminated if
    at least a twentieth of its words, and at least one, are hit. items_sha256 is of the ids of the
    items that occur, sorted as text and joined by commas. Null texts and null items have no words;
    empty tables and texts work; repeated rows each get their result; very long texts are indexed
    whole. Columns of ``docs`` with one of the five names give way to the result, all others stay.
    """
    windows = cut(windows_of(items, item, item_text, width))
    terms = term_ids(windows)
    index = postings(docs, terms, key, text)
    matches = cut(phrase_matches(index, ranked(windows, terms, index)))
    # positions are bounded by a row's own length, and each is counted once
    covered = matches.select("key", "row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_words") - 1)).alias("at")).distinct()
    hit = covered.groupBy("key", "row").agg(F.count("*").alias("n_hit"))
    names = cut(windows.select("window", F.explode("items").alias("item")))
    named = matches.select("key", "row", "window").distinct().join(measured(names), "window").select("key", "row", "item").distinct()
    ids = named.groupBy("key", "row").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("ids"))
    same = (hit["row"] == ids["row"]) & hit["key"].eqNullSafe(ids["key"])
    found = cut(hit.join(ids, same).select(hit["key"], hit["row"], "n_hit", "n_items", "ids"))
    made = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated"}
    keep = [c for c in docs.columns if c not in made] if keep is None else keep
    # a struct holds the kept columns, so that no name can clash
    kept = F.struct(*[docs[c] for c in keep]).alias("own") if keep else F.lit(None).alias("own")
    rows = docs.select(kept, docs[key].alias("k"), F.xxhash64(docs[key], docs[text]).alias("r"), F.size(words_of(docs[text], lowered=False)).cast("long").alias("n_words"))
    joined = rows.join(measured(found), (F.col("r") == F.col("row")) & F.col("k").eqNullSafe(F.col("key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        *[F.col("own")[c].alias(c) for c in keep], "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "ids"), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def oracle(width: int = 13) -> str:
    """DuckDB SQL for ``contamination`` of documents by benchmark: every run of words is compared with every window of its length."""
    words = lambda t: f"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
with docs as (select row_number() over () as r, doc_id, {words("text")} as w from documents),
items as (select item_id, {words("text")} as w from benchmark where item_id is not null),
wins as (select item_id, list_slice(w, i, i + {width - 1}) as win from (select item_id, w, unnest(range(1, greatest(2, len(w) - {width - 2}))) as i from items where len(w) > 0)),
sizes as (select distinct len(win) as n from wins),
runs as (select r, n, i, list_slice(w, i, i + n - 1) as win from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)),
found as (select r, i, n, item_id from runs join wins using (win)),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from found) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item_id::varchar as item from found) group by r)
select doc_id, len(w)::BIGINT as n_words, coalesce(n_hit, 0)::BIGINT as n_hit, coalesce(n_items, 0)::BIGINT as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit using (r) left join named using (r)"""
