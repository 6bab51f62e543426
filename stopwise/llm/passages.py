"""Repeated passages by MinHash banding of content-cut paragraphs.

A text is cut into overlapping paragraphs of 51 to 86 words. Each window of ``run`` words is known
by its anchor, the ``GRAM`` words in it with the least hash, and neighbouring windows with one
anchor make a paragraph. An anchor depends on its window's words alone, so texts that share a
window cut it alike, wherever sentences or lines begin.

Paragraphs meet in bands: the anchor, a MinHash of one row over 16-word shingles, in which equal
windows always collide, and ``BANDS`` bands of ``ROWS`` MinHashes over 5-word shingles for those
that are alike. Every paragraph is in all bands, also those that overlap. Collisions are verified:
windows of one anchor must be equal by the 64-bit hash of their words, and paragraphs of one band
must have the exact Jaccard similarity asked for. Verified links are clustered into components, of
which the first place stays.

Most buckets hold one row's paragraph alone. Tasks send each bucket they have met once, as sorted
numbers, to where those met twice are found, and only paragraphs of these go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.llm.common import connected_components, cut, join_counted, measured, text_chunks

SHINGLE = 5
SIMILARITY = 0.8
#: Words of a passage, at least: over 50.
RUN = 51
#: Words of an anchor.
GRAM = 16
#: Bands and MinHashes of each: of paragraphs with a similarity of 0.8 they bring together 95 in 100, of 0.9 all but one in 150.
BANDS, ROWS = 3, 2
#: Different paragraphs of a bucket that are all held against one another, in one task; larger buckets are dealt in parts, of which each two meet.
MOST = 1024
#: Paragraphs of such a part, at least.
LEADERS = 64
#: Paragraphs of a bucket up to which sets are faster than arrays.
FEW = 6
#: Buckets that a task sends at once, and that meet in one part, about.
SENT, PART = 1 << 20, 1 << 22
_draw = np.random.default_rng(11)
POWERS = _draw.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = _draw.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
#: Hashes of spans are sums of word hashes times powers of BASE; multiplying by powers of its inverse moves them to the origin.
BASE = int(_draw.integers(1, 2**60)) * 8 + 3


class _WordHashes(dict):
    """Hashes of words, each of up to 64 letters computed once; emptied when large."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode())
        if len(word) <= 64:
            self[word] = h
        return h


_words = _WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_words) > 100_000:
        _words.clear()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: No white space lies beyond U+3000; this code point stands for all from there on.
BEYOND = 0x3001
SPACE = np.array([chr(c).isspace() for c in range(BEYOND + 1)])


class Words:
    """The words of some texts, in arrays: hash, text number, and where each begins and ends in all texts laid end to end."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        whole = "\n".join(texts) + "\n"
        points = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
        points = np.minimum(points, BEYOND)
        self.length = len(points)
        gap = SPACE[points]
        self.begin = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
        self.words = whole.lower().split()
        if len(self.words) != len(self.begin):  # a letter whose lower form holds a space: none is known
            raise ValueError("words and letters disagree")
        self.hashes = word_hashes(self.words)
        self.heads = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text_of = np.searchsorted(self.heads, self.begin, "right") - 1
        self.first_word = np.searchsorted(self.text_of, np.arange(len(texts)))
        n = len(self.words)
        base = np.full(n + 1, BASE, np.uint64)
        base[0] = 1
        back = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.r_[np.uint64(0), np.cumsum(_mixed(self.hashes) * np.multiply.accumulate(base)[:n], dtype=np.uint64)]

    def span_hashes(self, first: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Hashes of the words from each first up to each to, that one not included."""
        return _mixed((self.sums[to] - self.sums[first]) * self.back[first] + (to - first).astype(np.uint64))

    def chars(self, first: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters of such spans within their texts; a span reaches up to the next word, or to the end of its text."""
        head = self.heads[self.text_of[first]]
        after = np.r_[self.begin, self.length][to]
        return self.begin[first] - head, np.minimum(after, self.heads[self.text_of[first] + 1] - 1) - head

    def shingles(self) -> np.ndarray:
        """The hash of the shingle that begins at each word, whatever text it ends in."""
        n = max(0, len(self.words) - SHINGLE + 1)
        total = np.zeros(n, np.uint64)
        for i, power in enumerate(POWERS):
            total += self.hashes[i : i + n] * power
        return _mixed(total)

    def minhashes(self, first: np.ndarray, to: np.ndarray) -> np.ndarray:
        """32 bits of each MinHash of the words from each first up to each to, a row for each such span."""
        h, out = self.shingles(), np.empty((len(first), len(SALTS)), np.uint32)
        bounds = np.stack([first, to - SHINGLE + 1], axis=1).ravel()
        for i, salt in enumerate(SALTS if len(first) else ()):
            least = np.minimum.reduceat(np.r_[_mixed(h ^ salt), np.uint64(0)], bounds)[::2]
            out[:, i] = least >> np.uint64(32)
        return out

    def blocks(self, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window (by their first words) of each block, and the hash of its anchor."""
        n, gram = len(self.words), min(GRAM, run)
        if n < run:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n - gram + 1)
        h = self.span_hashes(at, at + gram)
        width, size, windows = 1, run - gram + 1, n - run + 1
        best = at  # place of the leftmost least hash of so many grams
        while width < size:
            step = min(width, size - width)
            left, right = best[: len(best) - step], best[step:]
            best = np.where(h[right] < h[left], right, left)
            width += step
        valid = self.text_of[:windows] == self.text_of[run - 1 :]
        start = np.flatnonzero(valid & np.r_[True, (best[1:] != best[:-1]) | ~valid[:-1]])
        last = np.flatnonzero(valid & np.r_[(best[1:] != best[:-1]) | ~valid[1:], True])
        return start, last, h[best[start]]


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(df[key].alias("key"), F.xxhash64(df[key], df[text]).alias("row"), df[text].alias("text"))


def _blocks(df: DataFrame, key: str, text: str, run: int) -> DataFrame:
    """``(key, row, anchor, block, pos, n, start, end, sig)``: the paragraphs of each row, of n windows from word ``pos`` on, with their MinHashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text", 2 << 20):
            w = Words(part.column("text").to_pylist())
            first, last, anchor = w.blocks(run)
            block = w.span_hashes(first, last + run)
            at = w.text_of[first]
            ints = (first - w.first_word[at], last - first + 1, *w.chars(first, last + run))
            rows = [part.column(c).take(pa.array(at)) for c in ("key", "row")]
            offsets = pa.array((np.arange(len(first) + 1) * len(SALTS)).astype(np.int32))
            sig = pa.ListArray.from_arrays(offsets, pa.array(w.minhashes(first, last + run).view(np.int32).ravel()))
            longs, shorts = (pa.array(x.view(np.int64)) for x in (anchor, block)), (pa.array(x.astype(np.int32)) for x in ints)
            yield pa.RecordBatch.from_arrays([*rows, *longs, *shorts, sig], names)

    names = ["key", "row", "anchor", "block", "pos", "n", "start", "end", "sig"]
    kind = df.schema[key].dataType.simpleString()
    return _rows(df, key, text).mapInArrow(make, f"key {kind}, row long, anchor long, block long, pos int, n int, start int, end int, sig array<int>")


def _band_buckets() -> Column:
    """The bucket of a paragraph in each band."""
    return F.array(*[F.xxhash64(F.lit(b), *[F.get("sig", F.lit(b * ROWS + r)) for r in range(ROWS)]) for b in range(BANDS)])


def _spread(bucket: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each bucket once, in order, with the least and the greatest of each mark, a row of marks for each."""
    if not len(bucket):
        return bucket, low, high
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    return b[start], np.minimum.reduceat(low[:, order], start, axis=1), np.maximum.reduceat(high[:, order], start, axis=1)


def met_twice(places: DataFrame, marks: int, row_count: int) -> DataFrame:
    """``bucket``, stored: those of ``places(marks, buckets)`` whose places differ in each of the marks.

    Marks are ints by which places are told apart, such as hashes of their row and their words. A
    task sends the different buckets of about ``SENT`` places once, as sorted numbers with the least
    and greatest of each mark, in parts by their upper bits. A hot bucket is sent once by each such
    share, and a part, of which there are more as the rows grow, is searched by one task. Marks of
    32 bits take two that differ for one in four billion cases.
    """
    parts = max(16, row_count // PART)

    def send(bucket: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        b, low, high = _spread(bucket, mark, mark)
        part = (b.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        part, b, both = part[order], b[order], np.concatenate([low, low ^ high])[:, order]
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        pairs = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        blobs = ([b[x:y].tobytes() for x, y in pairs], [both[:, x:y].tobytes() for x, y in pairs])
        return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]].astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], ["part", "bucket", "marks"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            return send(np.concatenate([b for b, _ in held]), np.concatenate([m for _, m in held], axis=1))

        for batch in batches:
            lists = batch.column("buckets")
            own = batch.column("marks").flatten().to_numpy().reshape(-1, marks).T
            held.append((lists.flatten().to_numpy(), np.repeat(own, lists.value_lengths().to_numpy(), axis=1)))
            size += len(held[-1][0])
            if size >= SENT:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()

    def search(buckets: list[np.ndarray], both: list[np.ndarray]) -> pa.RecordBatch:
        m = np.concatenate(both, axis=1)
        b, low, high = _spread(np.concatenate(buckets), m[:marks], m[:marks] ^ m[marks:])
        return pa.RecordBatch.from_arrays([pa.array(b[(low < high).all(axis=0)])], ["bucket"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, buckets, both = None, [], []
        for batch in batches:
            for i, p in enumerate(batch.column("part").to_pylist()):
                if p != part and part is not None:
                    yield search(buckets, both)
                    buckets, both = [], []
                part = p
                buckets.append(np.frombuffer(batch.column("bucket")[i].as_py(), np.int64))
                both.append(np.frombuffer(batch.column("marks")[i].as_py(), np.int32).reshape(2 * marks, -1))
        if part is not None:
            yield search(buckets, both)

    sent = places.mapInArrow(shares, "part int, bucket binary, marks binary")
    return cut(sent.repartition("part").sortWithinPartitions("part").mapInArrow(find, "bucket long"))


def _mark(column: str) -> Column:
    """The upper half of a hash."""
    return F.shiftright(column, 32).cast("int")


def _wanted(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` with the list ``blocks`` of their ``wanted(row, pos, n)``. Only rows of which something is wanted are shuffled."""
    lists = cut(wanted.groupBy("row").agg(F.collect_set(F.struct(*[c for c in wanted.columns if c != "row"])).alias("blocks")))
    return _rows(df, key, text).join(measured(lists.select("row")), "row", "left_semi").join(measured(lists), "row")


def _places(w: Words, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word in the text and number of windows of each wanted paragraph."""
    pos, n = (part.column("blocks").flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "n"))
    return np.repeat(np.arange(part.num_rows), [len(x) for x in part.column("blocks")]), pos, n


def _windows(df: DataFrame, key: str, text: str, run: int, wanted: DataFrame) -> DataFrame:
    """``(key, row, window, pos, n, start, end)``: the single windows of the paragraphs ``wanted(row, pos, n)``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text", 2 << 20):
            w = Words(part.column("text").to_pylist())
            of, pos, n = _places(w, part)
            owner = np.repeat(of, n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(pos, n) + inner
            first = w.first_word[owner] + place
            rows = [part.column(c).take(pa.array(owner)) for c in ("key", "row")]
            ints = (place, np.ones(len(place)), *w.chars(first, first + run))
            window = w.span_hashes(first, first + run)
            yield pa.RecordBatch.from_arrays([*rows, pa.array(window.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in ints)], ["key", "row", "window", "pos", "n", "start", "end"])

    kind = df.schema[key].dataType.simpleString()
    return _wanted(df, key, text, wanted).mapInArrow(make, f"key {kind}, row long, window long, pos int, n int, start int, end int")


def _located(df: DataFrame, key: str, text: str, run: int, wanted: DataFrame) -> DataFrame:
    """``(key, row, pos, n, start, end, first_key, is_first)``: where the stretches ``wanted(row, pos, n, first_key, is_first)`` lie."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text", 2 << 20):
            w = Words(part.column("text").to_pylist())
            of, pos, n = _places(w, part)
            first = w.first_word[of] + pos
            rows = [part.column(c).take(pa.array(of)) for c in ("key", "row")]
            ints = (pos, n, *w.chars(first, first + n + run - 1))
            told = [part.column("blocks").flatten().field(c) for c in ("first_key", "is_first")]
            yield pa.RecordBatch.from_arrays([*rows, *(pa.array(x.astype(np.int32)) for x in ints), *told], names)

    names = ["key", "row", "pos", "n", "start", "end", "first_key", "is_first"]
    kind = df.schema[key].dataType.simpleString()
    return _wanted(df, key, text, wanted).mapInArrow(make, f"key {kind}, row long, pos int, n int, start int, end int, first_key {kind}, is_first boolean")


def _shingles_by_bucket(df: DataFrame, key: str, text: str, run: int, wanted: DataFrame) -> DataFrame:
    """``(bucket, block, row, pos, to, shingles)``: the shingle hashes, in order, of the paragraphs ``wanted(row, pos, n, block, buckets)``, once for each bucket."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text", 2 << 20):
            w = Words(part.column("text").to_pylist())
            of, pos, n = _places(w, part)
            lists, h = part.column("blocks").flatten(), (w.shingles() >> np.uint64(32)).astype(np.uint32).view(np.int32)
            times = lists.field("buckets").value_lengths().to_numpy()
            at = np.repeat(np.arange(len(of)), times)
            first, size = (w.first_word[of] + pos)[at], (n + run - SHINGLE)[at]
            for low in range(0, len(at), 20_000):  # a part of the paragraphs at a time
                some = slice(low, low + 20_000)
                ends = np.cumsum(size[some])
                inner = np.arange(ends[-1]) - np.repeat(ends - size[some], size[some])
                shingles = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(h[np.repeat(first[some], size[some]) + inner]))
                ints = (pa.array(x[at[some]].astype(np.int32)) for x in (pos, pos + n + run - 1))
                rows = part.column("row").take(pa.array(of[at[some]]))
                yield pa.RecordBatch.from_arrays(
                    [lists.field("buckets").flatten().slice(low, 20_000), lists.field("block").take(pa.array(at[some])), rows, *ints, shingles], ["bucket", "block", "row", "pos", "to", "shingles"]
                )

    return _wanted(df, key, text, wanted).mapInArrow(make, "bucket long, block long, row long, pos int, to int, shingles array<int>")


class _Forest:
    """Which members of a bucket are known to be linked."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def linked(shingles: list[np.ndarray], row: np.ndarray, pos: np.ndarray, to: np.ndarray, threshold: float) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """The links of a spanning forest of all alike pairs, and of each member the first and last shingle that it shares with any it is alike to.

    All pairs are compared, those that are linked already too; paragraphs of one row that overlap are no pair.
    """
    m, sizes = len(shingles), np.array([len(x) for x in shingles])
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    _, ids = np.unique(np.concatenate(shingles), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    place = np.arange(len(ids)) - begin[owner]
    # a shingle that a paragraph repeats counts once
    _, at = np.unique(owner * (ids.max() + 1) + ids, return_index=True)
    fresh = np.zeros(len(ids), bool)
    fresh[at] = True
    distinct = np.add.reduceat(fresh, begin, dtype=np.int64)
    low, high = np.full(m, 1 << 30), np.full(m, -1)
    first_at, last_at, mark = np.zeros(ids.max() + 1, np.int64), np.zeros(ids.max() + 1, np.int64), np.zeros(ids.max() + 1, bool)
    forest, links = _Forest(m), []
    for i in range(m - 1):
        mine, start = ids[begin[i] : begin[i] + sizes[i]], begin[i + 1]
        mark[mine] = True
        there = mark[ids[start:]]
        shared = np.add.reduceat(there & fresh[start:], begin[i + 1 :] - start, dtype=np.int64)
        alike_ = shared >= threshold * (distinct[i] + distinct[i + 1 :] - shared)
        alike_ &= (row[i + 1 :] != row[i]) | (pos[i + 1 :] >= to[i]) | (pos[i] >= to[i + 1 :])
        if alike_.any():
            first_at[mine[::-1]] = np.arange(sizes[i])[::-1]
            last_at[mine] = np.arange(sizes[i])
            hit = np.flatnonzero(there & alike_[owner[start:] - i - 1]) + start
            low[i], high[i] = min(low[i], first_at[ids[hit]].min()), max(high[i], last_at[ids[hit]].max())
            np.minimum.at(low, owner[hit], place[hit])
            np.maximum.at(high, owner[hit], place[hit])
            links += [(i, j) for j in (np.flatnonzero(alike_) + i + 1).tolist() if forest.join(i, j)]
        mark[mine] = False
    return links, low, high


def linked_few(shingles: list[list[int]], row: list[int], pos: list[int], to: list[int], threshold: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """``linked`` for a few paragraphs, by sets."""
    m, sets = len(shingles), [set(x) for x in shingles]
    low, high, forest, links = [1 << 30] * m, [-1] * m, _Forest(m), []
    for i in range(m - 1):
        for j in range(i + 1, m):
            if row[i] == row[j] and pos[j] < to[i] and pos[i] < to[j]:
                continue
            shared = sets[i] & sets[j]
            if len(shared) < threshold * (len(sets[i]) + len(sets[j]) - len(shared)):
                continue
            for k in (i, j):
                hits = [at for at, x in enumerate(shingles[k]) if x in shared]
                low[k], high[k] = min(low[k], hits[0]), max(high[k], hits[-1])
            if forest.join(i, j):
                links.append((i, j))
    return links, low, high


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links within the buckets of sorted rows; a bucket of no more than ``MOST`` paragraphs is held at a time."""
    names = ["block", "rep", "from", "to", "rep_from", "rep_to"]

    def found(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        bucket, block, row, pos, to = (table.column(c).to_numpy() for c in ("bucket", "block", "row", "pos", "to"))
        lists = table.column("shingles").combine_chunks()
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        out: list[list[int]] = [[] for _ in names]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            if b - a <= FEW:
                some = [values[offsets[k] : offsets[k + 1]].tolist() for k in range(a, b)]
                links, low, high = linked_few(some, row[a:b].tolist(), pos[a:b].tolist(), to[a:b].tolist(), threshold)
            else:
                links, low, high = linked([values[offsets[k] : offsets[k + 1]] for k in range(a, b)], row[a:b], pos[a:b], to[a:b], threshold)
            for i, j in links:
                for column, v in zip(out, (block[a + j], block[a + i], low[j], high[j] + SHINGLE, low[i], high[i] + SHINGLE), strict=True):
                    column.append(int(v))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(out)], names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # the last bucket may go on in the next batch
        bucket = batch.column("bucket").to_numpy()
        changes = np.flatnonzero(bucket[1:] != bucket[:-1])
        begin = int(changes[-1]) + 1 if len(changes) else 0
        if held and held[-1].column("bucket")[-1].as_py() != bucket[0]:
            yield found(pa.Table.from_batches(held))
            held = []
        if begin:
            yield found(pa.Table.from_batches([*held, batch.slice(0, begin)]))
            held = []
        held.append(batch.slice(begin))
    if held:
        yield found(pa.Table.from_batches(held))


def _dealt(todo: DataFrame, most: int) -> DataFrame:
    """Members of large buckets in parts, each part with every other in a bucket of about ``most``, so that all pairs meet.

    The work grows with the square of a bucket's different paragraphs, as that of holding all its
    pairs against one another does; no task holds more than two parts.
    """
    parts = F.ceil(F.col("size") / F.lit(max(most // 2, LEADERS)))
    dealt = todo.withColumn("parts", F.greatest(parts, F.lit(2))).withColumn("own", F.pmod(F.xxhash64("block"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("own <> other")
    return dealt.withColumn("bucket", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))


def _members(nodes: DataFrame, most: int = 0) -> DataFrame:
    """``(bucket, block, row, pos, n)``: in which buckets of two to about ``MOST`` different paragraphs the nodes meet.

    Buckets with the same members are one. A larger one is dealt in parts, of which each two make a
    bucket (see ``_dealt``), so that no pair of a bucket is lost whatever its size.
    """
    most = most or MOST
    # stored, as it is read for the sizes and for small, hot and other large buckets
    todo = cut(nodes.select("block", "row", "pos", "n", F.explode(_band_buckets()).alias("bucket")))
    columns = ["bucket", "block", "row", "pos", "n"]
    sizes = todo.groupBy("bucket").agg(F.count("*").alias("n_"), F.bit_xor(F.xxhash64("block")).alias("members"))
    sizes = cut(sizes.where("n_ > 1").groupBy("n_", "members").agg(F.min("bucket").alias("bucket")))
    # no bucket of these is hot
    ready = sizes.where(F.col("n_") <= most).select("bucket")
    out = todo.join(measured(ready), "bucket", "left_semi").select(columns)
    large = sizes.where(F.col("n_") > most).select("bucket", F.col("n_").alias("n"))
    if large.isEmpty():
        return out
    big = join_counted(todo.withColumnRenamed("n", "windows"), large.withColumn("size", F.col("n")), "bucket").withColumnRenamed("windows", "n")
    return out.union(_dealt(big, most).select(columns))


def alike(df: DataFrame, blocks: DataFrame, text: str = "text", key: str = "doc_id", run: int = RUN, threshold: float = SIMILARITY) -> list[DataFrame]:
    """Verified links ``(block, rep, part, rep_part)`` between different paragraphs of ``blocks`` that are alike.

    All paragraphs of a bucket are compared with one another, and of those that are alike a
    spanning forest of links is given, so that no link between them is lost and no list of pairs is
    made. The parts are words of each, from the first to the last shingle that it shares with any
    it is alike to in the bucket. Paragraphs of one row are linked only if they do not overlap.
    Similarity is exact on the upper 32 bits of the shingles' hashes.
    """
    # in two rows, and not with the same words in all: neighbours in one text are alike, too, and copies are found by their anchors
    twice = met_twice(blocks.select(F.array(_mark("row"), _mark("block")).alias("marks"), _band_buckets().alias("buckets")), 2, BANDS * blocks.count())
    each = blocks.select("block", "row", "pos", "n", "sig", F.explode(_band_buckets()).alias("bucket")).join(measured(twice), "bucket", "left_semi")
    # paragraphs of equal words are one node, at their first place
    nodes = cut(each.groupBy("block").agg(F.min(F.struct("row", "pos", "n", "sig")).alias("one"), F.count("*").alias("places")).select("block", "one.*", "places"))
    members = _members(nodes)
    wanted = cut(members.groupBy("block", "row", "pos", "n").agg(F.collect_set("bucket").alias("buckets")))
    if wanted.isEmpty():
        return []
    sets = _shingles_by_bucket(df, key, text, run, wanted).repartition("bucket").sortWithinPartitions("bucket")
    found = cut(sets.mapInArrow(lambda b: _verified(b, threshold), "block long, rep long, from int, to int, rep_from int, rep_to int"))
    part = lambda a, b: F.struct(F.col(a).alias("from"), F.col(b).alias("to"))
    return [found.select("block", "rep", part("from", "to").alias("part"), part("rep_from", "rep_to").alias("rep_part"))]


def repeated_spans(df: DataFrame, text: str = "text", key: str = "doc_id", run: int = RUN, threshold: float = SIMILARITY) -> DataFrame:
    """``(key, row, pos, n, start, end, first_key, is_first)``: spans of n windows from word ``pos`` on that stand in another row too, or are alike to a paragraph there.

    Anchors, paragraphs and windows are counted before the shuffle; of a hot one only the counts
    are sent to its rows, and no pairs of rows are made.
    """
    blocks = cut(_blocks(df, key, text, run))
    twice = met_twice(blocks.select(F.array(_mark("row")).alias("marks"), F.array("anchor").alias("buckets")), 1, blocks.count())
    shared = cut(blocks.drop("sig").join(measured(twice.withColumnRenamed("bucket", "anchor")), "anchor", "left_semi"))

    def with_first(spans: DataFrame, by: str) -> DataFrame:
        stats = spans.groupBy(by).agg(F.min(F.struct("key", "row", "pos")).alias("least"), F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("n"))
        stats = cut(stats.where("low < high").select(by, "n", F.col("least.key").alias("first_key"), F.col("least.row").alias("first_row"), F.col("least.pos").alias("first_pos")))
        joined = join_counted(spans.withColumnRenamed("n", "windows"), stats, by)
        # a later place in the first row goes as well, unless it overlaps the first
        is_first = (F.col("first_row") == F.col("row")) & (F.col("pos") < F.col("first_pos") + F.col("windows") + (run - 1))
        return joined.withColumn("is_first", is_first).withColumnRenamed("windows", "n").select(columns)

    columns = ["key", "row", "pos", "n", "start", "end", "first_key", "is_first"]
    anchors = shared.groupBy("anchor").agg(F.min("row").alias("low"), F.max("row").alias("high"), (F.min("block") < F.max("block")).alias("mixed"), F.count("*").alias("n"))
    anchors = cut(anchors.where("low < high").select("anchor", "mixed", "n"))
    met = cut(join_counted(shared.withColumnRenamed("n", "windows"), anchors, "anchor").withColumnRenamed("windows", "n"))
    # paragraphs of equal words have equal windows: one place of each stands for all
    ones = met.where("mixed").groupBy("block").agg(F.min(F.struct("key", "row", "pos", "n")).alias("one")).select("one.row", "one.pos", "one.n")
    single = cut(_windows(df, key, text, run, ones))
    out = with_first(met, "block").union(with_first(single, "window"))
    links = alike(df, blocks, text, key, run, threshold)
    if not links:
        return out
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    groups = cut(connected_components(every.select(F.col("block").alias("src"), F.col("rep").alias("dst"))))
    parts = every.select("block", "part.*").union(every.select("rep", "rep_part.*")).groupBy("block").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    # the first place of a component is that of one of its paragraphs, so it is sought among different paragraphs, and a place meets its own alone
    places = blocks.groupBy("block").agg(F.min(F.struct("key", "row", "pos")).alias("least"), F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("n"))
    named = places.join(parts.where(F.col("to") - F.col("from") >= run), "block")
    named = cut(named.join(groups, F.col("block") == F.col("node")).select("block", "n", "component", "from", "to", "least", "low", "high"))
    begins = F.struct(F.col("least.key").alias("key"), F.col("least.row").alias("row"), (F.col("least.pos") + F.col("from")).alias("pos"))
    firsts = named.groupBy("component").agg(F.min(begins).alias("first"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n"))
    firsts = cut(firsts.where("low < high").select("component", "first", "n"))
    named = cut(join_counted(named.drop("least", "low", "high").withColumnRenamed("n", "places"), firsts, "component").withColumnRenamed("places", "n"))
    members = join_counted(blocks.select("block", "row", "pos"), named, "block")
    members = members.select("row", (F.col("pos") + F.col("from")).alias("pos"), (F.col("to") - F.col("from") - run + 1).alias("n"), "first")
    is_first = (F.col("first.row") == F.col("row")) & (F.col("pos") < F.col("first.pos") + F.col("n") + (run - 1))
    return out.union(_located(df, key, text, run, members.select("row", "pos", "n", F.col("first.key").alias("first_key"), is_first.alias("is_first"))))


def repeated_passages(df: DataFrame, text: str = "text", key: str = "doc_id", run: int = RUN, threshold: float = SIMILARITY) -> DataFrame:
    """``(key, row, start, end, n_words, removed_words, first_keys, spans)``: a row for each passage that is repeated elsewhere.

    A passage is a stretch of one row made of overlapping windows of ``run`` words that stand word
    by word (in lower case, whatever the white space) in another row, and of paragraphs that are
    alike to one there. start and end count characters; spans are the parts that are not the first
    of their kind, which deduplication removes; first_keys are the rows that hold these first. The
    first is the place with the smallest key, row hash and word number of its component.

    Null and empty texts, and those of fewer than ``run`` words, have no passages. ``row`` is a
    hash of key and text: rows that share a key are told apart, and repeated rows are one. What is
    repeated within one text alone is no passage. Texts are read whole, a very long one by itself,
    with about 200 bytes of memory a word. An empty table gives none; other columns are ignored.
    """

    def merge(table: pa.Table) -> pa.RecordBatch:
        row, pos, n, start, end = (table.column(c).to_numpy() for c in ("row", "pos", "n", "start", "end"))
        later = ~table.column("is_first").to_numpy(zero_copy_only=False)
        new_row = np.r_[True, _changes(table)]
        to = pos.astype(np.int64) + n + (run - 1)
        # ends so far within a row: rows are lifted apart, so one running maximum serves all
        lift = np.cumsum(new_row) * (1 << 32)

        def joined(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            at = np.flatnonzero(mask)
            reach = np.maximum.accumulate(to[at] + lift[at])
            head = np.flatnonzero(np.r_[True, (pos[at] + lift[at])[1:] >= reach[:-1]]) if len(at) else at
            if not len(at):
                return at, at, at, at
            return at[head], np.maximum.reduceat(end[at], head), np.maximum.reduceat(to[at], head) - pos[at[head]], np.searchsorted(at[head], np.arange(len(row)), "right") - 1

        head, ends, words, passage = joined(np.ones(len(row), bool))
        at, span_ends, span_words, _ = joined(later)
        of = passage[at]
        count = np.bincount(of, minlength=len(head))
        removed = np.bincount(of, weights=span_words, minlength=len(head)).astype(np.int64)
        offsets = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
        spans = pa.StructArray.from_arrays([pa.array(start[at].astype(np.int32)), pa.array(span_ends.astype(np.int32))], ["start", "end"])
        keys_at = np.flatnonzero(later)
        key_offsets = pa.array(np.r_[0, np.cumsum(np.bincount(passage[keys_at], minlength=len(head)))].astype(np.int32))
        keys = table.column("first_key").combine_chunks().take(pa.array(keys_at))
        return pa.RecordBatch.from_arrays(
            [
                table.column("key").combine_chunks().take(pa.array(head)), pa.array(row[head]), pa.array(start[head].astype(np.int32)), pa.array(ends.astype(np.int32)), pa.array(words.astype(np.int64)),
                pa.array(removed), pa.ListArray.from_arrays(key_offsets, keys), pa.ListArray.from_arrays(offsets, spans),
            ],
            ["key", "row", "start", "end", "n_words", "removed_words", "first_keys", "spans"],
        )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last row may go on in the next batch
            changes = np.flatnonzero(_changes(pa.Table.from_batches([batch])))
            begin = int(changes[-1]) + 1 if len(changes) else 0
            if held and _changes(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]))[0]:
                yield merge(pa.Table.from_batches(held))
                held = []
            if begin:
                yield merge(pa.Table.from_batches([*held, batch.slice(0, begin)]))
                held = []
            held.append(batch.slice(begin))
        if held:
            yield merge(pa.Table.from_batches(held))

    kind = df.schema[key].dataType.simpleString()
    near = repeated_spans(df, text, key, run, threshold).repartition("row").sortWithinPartitions("row", "key", "pos")
    made = near.mapInArrow(make, f"key {kind}, row long, start int, end int, n_words long, removed_words long, first_keys array<{kind}>, spans array<struct<start: int, end: int>>")
    return made.withColumn("first_keys", F.array_sort(F.array_distinct("first_keys"))).withColumnRenamed("key", key)


def _changes(table: pa.Table) -> np.ndarray:
    """Whether each row but the first has another row hash or key than the one before."""
    row, keys = table.column("row").to_numpy(), table.column("key").combine_chunks()
    keys = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])


def remove_passages(df: DataFrame, text: str = "text", key: str = "doc_id", run: int = RUN, threshold: float = SIMILARITY) -> DataFrame:
    """``df`` without repeated passages: what of one is not the first of its kind goes.

    Rows that lose all their words go; rows that lose nothing stay as they are, null texts too.
    Columns keep their names and order, whatever they are called.
    """
    spans = repeated_passages(df, text, key, run, threshold).where("removed_words > 0").select(F.col(key).alias("key"), "row", "spans")
    spans = cut(spans.groupBy("key", "row").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")))
    # a struct holds the row's own columns, so that no name can clash
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("own"), df[key].alias("k"), F.xxhash64(df[key], df[text]).alias("r"), df[text].alias("t"))
    rows = rows.join(measured(spans), (F.col("r") == F.col("row")) & F.col("k").eqNullSafe(F.col("key")), "left")
    begins = F.concat(F.array(F.lit(0)), F.col("spans.end"))
    ends = F.concat(F.col("spans.start"), F.array(F.length("t")))
    kept = F.concat_ws("", F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.substring(F.col("t"), x["b"] + 1, x["e"] - x["b"])))
    out = rows.withColumn("left", F.when(F.col("spans").isNull(), F.col("t")).otherwise(kept))
    out = out.where(F.col("spans").isNull() | F.col("left").rlike(r"\S"))
    return out.select(*[F.col("left").alias(c) if c == text else F.col("own")[c].alias(c) for c in df.columns])
