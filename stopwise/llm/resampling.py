"""Importance resampling towards a target distribution by hashed word n-grams.

The tokenizers library's untrained ``Split`` cuts an ASCII-lowered text into words with offsets. Runs
of neighbouring words, named by the offsets of their first and last word, are features, and the
CRC-32 of each feature's words says which bucket counts it. The buckets of all documents and of all
target texts give each bucket a gain; a text weighs the mean gain of its features. Weight plus
Gumbel noise drawn from the key is the score, and the highest scores are the sample.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import cut, text_chunks
from stopwise.operators.ranks import numbered

#: Fixed value: words are runs of digits, small letters and all that is not ASCII, after A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a text that are split at once, up to the next gap: the splitter needs some hundred bytes a letter.
PART = 1 << 16
_gap = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


class Splitter:
    """Words of whole texts with the CRC of each; made once in a task."""

    def __init__(self) -> None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(WORD), "removed", invert=True).pre_tokenize_str
        self.known: dict[str, tuple[int, bytes]] = {}

    def words(self, text: str) -> Iterator[tuple[str, tuple[int, int]]]:
        """The words of a text and their offsets in it, by characters."""
        data = text.encode().lower()  # of bytes, so A-Z alone
        at = chars = 0
        while at < len(data):
            gap = _gap.search(data, at + PART)
            end = gap.start() if gap else len(data)
            part = data[at:end].decode()
            for word, (a, b) in self.split(part):
                yield word, (chars + a, chars + b)
            at, chars = end, chars + len(part)

    def coded(self, text: str) -> tuple[list[int], list[bytes]]:
        """Of each word its CRC, and its bytes after a space."""
        known = self.known
        if len(known) > 200_000:
            known.clear()
        crcs, spaced = [], []
        for word, _ in self.words(text):
            code = known.get(word)
            if code is None:
                b = word.encode()
                code = crc32(b), b" " + b
                if len(b) <= 64:
                    known[word] = code
            crcs.append(code[0])
            spaced.append(code[1])
        return crcs, spaced

    def features(self, text: str | None, most: int, buckets: int) -> tuple[int, np.ndarray]:
        """The number of words, and the buckets of all runs of 1 to ``most`` of them."""
        crcs, spaced = self.coded(text or "")
        n, runs, out = len(crcs), crcs, [crcs]
        for size in range(2, most + 1):
            # the CRC of a run goes on from that of the run without its last word
            runs = list(map(crc32, spaced[size - 1 :], runs[: n - size + 1]))
            out.append(runs)
        return n, np.fromiter((c for part in out for c in part), np.int64, sum(map(len, out))) % buckets


def _buckets(column: pa.Array, i: int, wide: bool) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), np.uint32 if wide else np.uint16)


def features(df: DataFrame, text: str = "text", key: str | None = "doc_id", most: int = 2, buckets: int = 10_000) -> DataFrame:
    """``(key, n_words, buckets)`` of every row, stored: the buckets of all its features, two bytes each (four, of more than 65,536 buckets).

    Texts are split this once; the histogram and the weights read what has been stored.
    """
    kind = df.schema[key].dataType.simpleString() if key else "int"
    cell = np.uint32 if buckets > 1 << 16 else np.uint16

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for part in text_chunks(batches, "text"):
            found = [splitter.features(t, most, buckets) for t in part.column("text").to_pylist()]
            words, cells = pa.array([n for n, _ in found], pa.int64()), pa.array([x.astype(cell).tobytes() for _, x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("key"), words, cells], ["key", "n_words", "buckets"])

    rows = df.select((df[key] if key else F.lit(0)).alias("key"), df[text].cast("string").alias("text"))
    return cut(rows.mapInArrow(code, f"key {kind}, n_words long, buckets binary"))


def histogram(coded: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features of all rows of ``features`` each bucket holds. Every task sends one row a bucket at most, and the driver receives ``buckets`` sums."""
    wide = buckets > 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total += np.bincount(_buckets(batch.column("buckets"), i, wide), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = coded.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """Of each bucket floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))): how much likelier the target is to use it, with one count added to each of the B buckets."""
    b = len(corpus)
    whole, wanted = int(corpus.sum()) + b, int(target.sum()) + b
    return [math.floor(1000 * math.log(float(t + 1) * float(whole) / (float(s + 1) * float(wanted)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]


def weights(coded: DataFrame, gain: list[int]) -> DataFrame:
    """``(key, n_words, n_features, weight)`` of the rows of ``features``: the floored mean gain, 0 where there are no features."""
    kind, wide = coded.schema["key"].dataType.simpleString(), len(gain) > 1 << 16

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.array(gain, np.int64)
        for batch in batches:
            cells = [_buckets(batch.column("buckets"), i, wide) for i in range(batch.num_rows)]
            means = [int(by[x].sum()) // len(x) if len(x) else 0 for x in cells]
            longs = (pa.array([len(x) for x in cells], pa.int64()), pa.array(means, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_words"), *longs], ["key", "n_words", "n_features", "weight"])

    return coded.mapInArrow(weigh, f"key {kind}, n_words long, n_features long, weight long")


def resample(
    df: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, text: str = "text", key: str = "doc_id", target_text: str = "text",
    most: int = 2, buckets: int = 10_000,
) -> DataFrame:
    """``(key, n_features, weight, score, rank)`` for every row; rank, from 1, is null for those that are not drawn.

    Of the N rows with ``least_words`` words or more the floor(percent * N / 100) highest scores
    are drawn, ties going to the smaller key. The noise of a row depends on seed and key alone, so
    the draw is without replacement and repeatable.

    Null and empty texts have no features and weigh 0; a null key counts as empty text in the
    noise and comes last among ties. Repeated rows tie, and each has its own rank. Very long texts
    are read whole, in parts of ``PART`` bytes that end at gaps. An empty table gives none, an empty
    target weighs the corpus's rare buckets alike; other columns are ignored.

    Ranks are found without a whole table in one task: scores are whole numbers, so their counts
    (as many as there are scores) give the least score that is drawn, and only rows that reach it
    are dealt by ranges and numbered.
    """
    coded = features(df, text, key, most, buckets)
    goal = features(target, target_text, None, most, buckets)
    weighed = weights(coded, gains(histogram(coded, buckets), histogram(goal, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))
    scored = cut(weighed.withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= least_words
    counts = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    # one row a score, of which there are some ten thousand at any size
    sums = sorted(((r["score"], r["n"]) for r in counts.collect()), reverse=True)
    wanted, floor, seen = percent * sum(n for _, n in sums) // 100, None, 0
    for score, n in sums:
        if seen >= wanted:
            break
        seen, floor = seen + n, score
    columns = [F.col("key").alias(key), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if floor is None:
        return scored.select(*columns, none)
    reach = able & (F.col("score") >= floor)
    top = numbered(scored.where(reach), [F.desc("score"), F.asc_nulls_last("key")], "_n")
    drawn = top.select(*columns, F.when(F.col("_n") < wanted, F.col("_n") + 1).alias("rank"))
    return drawn.unionByName(scored.where(~reach).select(*columns, none))


def oracle() -> str:
    """DuckDB SQL for the query: each distinct feature's CRC-32 byte by byte, from the table of the reflected polynomial."""
    words = lambda t: f"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    step = "if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)"
    return f"""
with recursive bits as (select i, 0 as k, i::BIGINT as c from range(256) t(i) union all select i, k + 1, {step} from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
docs as (select row_number() over () as r, doc_id, {words("text")} as w from documents),
goal as (select row_number() over () as r, {words("text")} as w from benchmark),
runs as (select r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from docs),
aims as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from goal),
parts as (select f, hex(encode(f)) as x from (select f from runs union select f from aims)),
coded as (select f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from parts, crc),
s as (select bucket, count(*) as s from runs join coded using (f) group by all),
t as (select bucket, count(*) as t from aims join coded using (f) group by all),
gain as (select b as bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((select count(*) from runs) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((select count(*) from aims) + 10000)::DOUBLE))) as g
  from range(10000) n(b) left join s on s.bucket = b left join t on t.bucket = b),
sums as (select r, count(*) as n, floor(sum(g) / count(*)) as weight from runs join coded using (f) join gain using (bucket) group by r),
noisy as (select r, doc_id, len(w) as words, coalesce(n, 0)::BIGINT as n_features, coalesce(weight, 0)::BIGINT as weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT as score from docs left join sums using (r)),
drawn as (select r, row_number() over (order by score desc, doc_id nulls last) as n, 25 * count(*) over () // 100 as wanted from noisy where words >= 20)
select doc_id, n_features, weight, score, if(n <= wanted, n, null)::BIGINT as rank from noisy left join drawn using (r)"""
