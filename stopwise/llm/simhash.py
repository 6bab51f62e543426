"""SimHash near-duplicate groups by a binary trie self-join of the fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import connected_components, cut, text_chunks

#: Node pairs that a task expands at once.
FRONTIER = 1 << 18
#: Fingerprints that begin alike are joined in one task; so many bits at least, more beyond 2**18 fingerprints a prefix.
PREFIX_BITS = 6


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64 bits of a text (UTF-8): each is 1 if set in over half the XXH64 of its word shingles.

    A-Z count as lower case; words are cut at ASCII white space. Fewer words than ``width`` are one
    shingle; no words give 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if n > 1 or len(words) == width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for part in range(0, n, 1 << 14):
        bits = np.unpackbits(h[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, seed: int = 42) -> DataFrame:
    """``(key, fp)`` for each row; fp is the fingerprint as a signed long, 0 for null or wordless texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            found = np.array([fingerprint(t, width, seed) if t else 0 for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found.view(np.int64))], ["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].cast("binary").alias("text")).mapInArrow(run, f"key {kind}, fp long")
    return rows.select(F.col("key").alias(key), "fp")


class _Trie:
    """The implicit binary trie of a sorted array: a node is a range of it, at a depth."""

    def __init__(self, sorted_values: np.ndarray):
        self.values, self.zeros = sorted_values, {}

    def split(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where in each range the values with a 1 at this depth begin."""
        if depth not in self.zeros:
            bit = (self.values >> np.uint64(63 - depth)) & np.uint64(1)
            self.zeros[depth] = np.r_[np.int64(0), np.cumsum(bit == 0)]
        zeros = self.zeros[depth]
        return lo + zeros[hi] - zeros[lo]


def trie_links(a: np.ndarray, b: np.ndarray | None, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``a`` and ``b`` (sorted, distinct uint64) that differ in ``budget`` bits or fewer.

    With ``b`` None the pairs lie within ``a``, each once. Both tries are descended together: a pair
    of nodes carries the bits that differ so far and goes no further beyond the budget. Small
    pairs of nodes are compared value by value. Deep work comes first, so that memory stays bounded.
    """
    own = b is None
    ta = _Trie(a)
    tb = ta if own else _Trie(b)
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero + len(a), zero, zero + len(tb.values), zero.astype(np.int8))] if len(a) and len(tb.values) else []
    while stack:
        depth, alo, ahi, blo, bhi, differ = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack.append((depth, alo[half:], ahi[half:], blo[half:], bhi[half:], differ[half:]))
            alo, ahi, blo, bhi, differ = alo[:half], ahi[:half], blo[:half], bhi[:half], differ[:half]
            stack.append((depth, alo, ahi, blo, bhi, differ))
            continue
        small = (ahi - alo) * (bhi - blo) <= 8
        if depth == 64:
            small[:] = True
        if small.any():
            n = (bhi - blo)[small]
            count = (ahi - alo)[small] * n
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            wide = np.repeat(n, count)
            i, j = np.repeat(alo[small], count) + at // wide, np.repeat(blo[small], count) + at % wide
            near = np.bitwise_count(ta.values[i] ^ tb.values[j]) <= budget
            if own:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            on = ~small
            alo, ahi, blo, bhi, differ = alo[on], ahi[on], blo[on], bhi[on], differ[on]
        if not len(alo):
            continue
        am, bm = ta.split(alo, ahi, depth), tb.split(blo, bhi, depth)
        parts = []
        for a0, a1, b0, b1, more in ((alo, am, blo, bm, 0), (am, ahi, bm, bhi, 0), (alo, am, bm, bhi, 1), (am, ahi, blo, bm, 1)):
            keep = (a0 < a1) & (b0 < b1) & (differ + more <= budget)
            if own:  # of two nodes the one further left comes first
                keep &= a0 <= b0
            parts.append((a0[keep], a1[keep], b0[keep], b1[keep], differ[keep] + np.int8(more)))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def _forest(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of ``n`` reaches over the links."""
    root = np.arange(n)
    if links:
        i, j = np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])
        while True:
            least = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
            np.minimum.at(root, before, root)
            root = root[root]
            if np.array_equal(before, root):
                break
    return root


def near_fingerprints(fps: DataFrame, budget: int = 2, every: bool = False) -> DataFrame:
    """Links ``(src, dst)`` of the distinct, non-null longs in ``fps.fp`` that differ in ``budget`` bits or fewer.

    Fingerprints that share a prefix meet in one task with those whose prefix differs from it in at
    most ``budget`` bits and is larger; the task descends both tries together. With ``every`` all
    links are given. Otherwise a task gives a spanning forest of its links, which joins exactly the
    same fingerprints and has fewer rows than the task has fingerprints.
    """
    count = fps.count()
    bits = max(PREFIX_BITS, math.ceil(math.log2(max(1, count) / (1 << 18))))
    masks = [m for m in range(1 << bits) if m.bit_count() <= budget]
    prefix = F.shiftrightunsigned("fp", 64 - bits)
    sent = fps.select("fp", prefix.alias("own"), F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    sent = sent.select("fp", F.col("own").bitwiseXOR(F.col("mask")).alias("task"), "own").where("task <= own")

    def join(table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().view(np.uint64)
        mine = table.column("own").to_numpy() == table.column("task").to_numpy()
        a, b = np.sort(values[mine]), np.sort(values[~mine])
        links = [*trie_links(a, None, budget), *((i, len(a) + j) for i, j in trie_links(a, b, budget))]
        both = np.r_[a, b].view(np.int64)
        if every:
            src = np.concatenate([both[i] for i, _ in links] or [both[:0]])
            dst = np.concatenate([both[j] for _, j in links] or [both[:0]])
        else:
            root = _forest(len(both), links)
            moved = np.flatnonzero(root != np.arange(len(both)))
            src, dst = both[moved], both[root[moved]]
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return sent.groupBy("task").applyInArrow(join, "src long, dst long")


def simhash_groups(df: DataFrame, text: str = "text", key: str = "doc_id", budget: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row of ``df``.

    Rows link whose fingerprints differ in ``budget`` bits or fewer; component_id is the smallest
    key that a row reaches. Rows of one fingerprint are one node, so a group of copies of any size
    costs one fingerprint; its rows meet only in minima, which are combined before the shuffle, and
    in one join that Spark may split.

    Null and wordless texts have fingerprint zero and link like any other. A null key is never a
    component_id unless no row of the group has a key. Repeated rows stay; an empty table gives
    none; other columns are ignored.
    """
    rows = cut(fingerprints(df, text, key, width, seed))
    nodes = cut(rows.groupBy("fp").agg(F.min(key).alias("least")))
    groups = connected_components(near_fingerprints(nodes.select("fp"), budget))
    linked = cut(nodes.join(groups, F.col("fp") == F.col("node")).select("fp", "component", "least"))
    least = linked.groupBy("component").agg(F.min("least").alias("group_least"))
    found = linked.join(least, "component").select("fp", "group_least")
    labels = nodes.join(found, "fp", "left").select("fp", F.coalesce("group_least", "least").alias("component_id"))
    out = rows.join(labels, "fp")
    return out.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
