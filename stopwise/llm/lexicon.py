"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The frequent words of a corpus are compiled into an acyclic automaton whose equal suffixes are one
state. Each transition carries a number; their sum along a word is the word's place among the
sorted words, and a flat array holds the token ids of each place. The arrays lie in one file that
workers map into memory. Words that the automaton does not accept are merged exactly.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm import bpe
from stopwise.llm.common import cut, text_chunks, write_shared

#: Words that the lexicon holds at most; a bound on its size that no result depends on.
LEXICON_WORDS = 20_000
#: Distinct words that a worker counts before it hands them on.
COUNTED = 150_000


class Automaton:
    """A minimal acyclic automaton over bytes with additive outputs, in flat arrays.

    ``keys`` holds ``state * 256 + byte`` of all transitions in order, ``targets`` and ``outputs``
    belong to them; ``final`` marks accepting states; ``ids`` and ``starts`` hold the tokens.
    """

    FIELDS = ("keys", "targets", "outputs", "final", "starts", "ids")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__ |= arrays

    @classmethod
    def compile(cls, words: list[bytes], tokens: list[np.ndarray]) -> Automaton:
        """From distinct words in byte order, each with its token ids."""
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []  # finished ones: accepting, transitions
        known: dict = {}
        path: list[tuple[list, list[bool]]] = [([], [False])]  # open states along the last word

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                arcs, accepts = path.pop()
                form = (accepts[0], tuple(arcs))
                if form not in known:
                    known[form] = len(states)
                    states.append(form)
                parent = path[-1][0]
                parent[-1] = (parent[-1][0], known[form])

        last = b""
        for word in words:
            common = len(os.path.commonprefix([last, word]))
            close(common)
            for byte in word[common:]:
                path[-1][0].append((byte, -1))
                path.append(([], [False]))
            path[-1][1][0] = True
            last = word
        close(0)
        states.append((path[0][1][0], tuple(path[0][0])))
        below = [0] * len(states)  # words accepted from a state; a state comes after its targets
        keys, targets, outputs = [], [], []
        for s, (accepts, arcs) in enumerate(states):
            passed = int(accepts)
            for byte, to in arcs:
                keys.append(s << 8 | byte)
                targets.append(to)
                outputs.append(passed)
                passed += below[to]
            below[s] = passed
        return cls(
            keys=np.array(keys, np.int64), targets=np.array(targets, np.int64), outputs=np.array(outputs, np.int64),
            final=np.array([a for a, _ in states], np.int64),
            starts=np.cumsum([0, *map(len, tokens)]).astype(np.int64), ids=np.concatenate([*tokens, np.empty(0, np.int32)]).astype(np.int64),
        )

    def packed(self) -> np.ndarray:
        """All arrays in one, their lengths first."""
        arrays = [getattr(self, f) for f in self.FIELDS]
        return np.concatenate([np.array([len(a) for a in arrays], np.int64), *arrays])

    @classmethod
    def load(cls, path: str) -> Automaton:
        flat = np.memmap(path, np.int64, "r")
        n = len(cls.FIELDS)
        return cls(**dict(zip(cls.FIELDS, np.split(flat[n : n + int(flat[:n].sum())], np.cumsum(flat[: n - 1])), strict=True)))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, -1 if it is not accepted. All words advance together, a byte a step."""
        lengths = np.array([len(w) for w in words], np.int64)
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.keys):
            return out
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        on = np.flatnonzero(lengths)
        state, place = np.full(len(on), len(self.final) - 1), np.zeros(len(on), np.int64)
        for step in range(int(lengths.max())):
            key = state << 8 | flat[begin[on] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            on, arc = on[hit], arc[hit]
            state, place = self.targets[arc], place[hit] + self.outputs[arc]
            ended = lengths[on] == step + 1
            accepted = ended & (self.final[state] == 1)
            out[on[accepted]] = place[accepted]
            on, state, place = on[~ended], state[~ended], place[~ended]
            if not len(on):
                break
        return out


def word_counts(df: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """``(word, n)`` over all rows: how often each word of letters alone, up to 64 of them, stands between spaces.

    A word carries the space before it, as in the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(vocab_path)
        held: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            kept = [(w, n) for w, n in held.items() if w.removeprefix(" ").isalpha()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for part in text_chunks(batches, "text"):
            for t in part.column("text").to_pylist():
                if t:
                    held.update(w for w in bpe.pieces(vocab, t) if len(w) <= bpe.LETTERS)
            if len(held) > COUNTED:
                yield hand_on()
        if held:
            yield hand_on()

    return df.select(df[text].alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, vocab_path: str, text: str = "text", most: int = LEXICON_WORDS, least: int = 4) -> list[str]:
    """The most frequent words of all rows: at most ``most``, each at least ``least`` times.

    Words of about one frequency (within a twelfth) are taken all or none, so that no sort is needed.
    """
    counts = cut(word_counts(df, vocab_path, text).where(F.col("n") >= least).withColumn("level", F.floor(8 * F.log2("n")).cast("int")))
    lowest, held = 1 << 30, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        lowest = r["level"]
    return [r["word"] for r in counts.where(F.col("level") >= lowest).select("word").collect()]


def build_lexicon(words: list[str], vocab_path: str) -> Automaton:
    """The automaton of some words with their token ids."""
    words = sorted(set(words) - {""}, key=str.encode)
    return Automaton.compile([w.encode() for w in words], bpe.encode_pieces(bpe.vocabulary(vocab_path), words))


@lru_cache(maxsize=2)
def _mapped(name: str) -> Automaton:
    return Automaton.load(SparkFiles.get(name))


class Coder:
    """Encodes and decodes texts; remembers the words that this process has met.

    ``seen`` gives a word's place in the flat arrays of tokens: first those of the lexicon, then
    those of words merged here.
    """

    def __init__(self, vocab_path: str, lexicon: Automaton):
        self.vocab, self.lexicon = bpe.vocabulary(vocab_path), lexicon
        self.decimals = {i: str(i) for i in self.vocab.bytes_of}
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.starts, self.ids = np.array(self.lexicon.starts), np.array(self.lexicon.ids)

    def learn(self, new: list[str]) -> None:
        """Tokens of new words: from the lexicon, or by exact merging."""
        coded = [w.encode() for w in new]
        places = self.lexicon.find(coded)
        unseen = np.flatnonzero(places < 0)
        ids, counts = self.vocab.merge_flat([coded[i] for i in unseen])
        places[unseen] = np.arange(len(self.starts) - 1, len(self.starts) - 1 + len(unseen))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids])
        self.seen.update(zip(new, places.tolist(), strict=True))

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if any(mark in text for mark in self.vocab.special):
            return [w for p in self.vocab.split_special(text) for w in ([p] if p in self.vocab.special else bpe.pre_tokens(self.vocab, p))]
        return bpe.pre_tokens(self.vocab, text)

    def tokens(self, word: str) -> list[int]:
        """The ids of one word; a long one is merged each time, and not kept."""
        if word in self.vocab.special:
            return [self.vocab.special[word]]
        if word not in self.seen:
            return self.vocab.merge_flat([word.encode()])[0].tolist()
        place = self.seen[word]
        return self.ids[self.starts[place] : self.starts[place + 1]].tolist()

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The token ids of each text."""
        parts = [self.words(t) for t in texts]
        words = {w for w in set().union(*parts) if len(w) <= bpe.LETTERS}
        if len(self.seen) + len(words) > bpe.MEMORY:
            self.clear()
        new = words - self.seen.keys() - self.vocab.special.keys()
        self.learn(list(new))
        special = self.vocab.special
        for part in parts:
            if special.keys() & set(part) or max(map(len, part), default=0) > bpe.LETTERS:
                yield [i for w in part for i in self.tokens(w)]
                continue
            place = np.fromiter(map(self.seen.__getitem__, part), np.int64, len(part))
            count = self.starts[place + 1] - self.starts[place]
            ends = np.cumsum(count)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[place] - ends + count, count)
            yield self.ids[at].tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the tokens stand for, special ones included."""
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids))

    def run(self, texts: list[str | None]) -> Iterator[tuple[int, str, bytes]]:
        """For each text its token count, its ids as decimals with commas, and the bytes decoded from them."""
        for ids in self.encode(texts):
            yield len(ids), ",".join(map(self.decimals.__getitem__, ids)), self.decode(ids)


_coders: dict[tuple[str, str], Coder] = {}


def encode_and_decode(df: DataFrame, vocab_path: str, lexicon: Automaton, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` for every row; with ``ids`` also ``ids`` and ``decoded``.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the UTF-8 text that the ids
    decode to, where bytes that are no UTF-8 become U+FFFD. A null text counts as empty. Repeated
    rows each give a row; an empty table gives none; other columns are ignored. Nothing is shuffled.
    The lexicon goes to executors as a file that Spark hands to each, late ones too.
    """
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    df.sparkSession.sparkContext.addFile(write_shared(df.sparkSession, name, lexicon.packed().tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coders.get((vocab_path, name))
        if coder is None:
            _coders.clear()
            coder = _coders[vocab_path, name] = Coder(vocab_path, _mapped(name))
        for part in text_chunks(batches, "text", 4 << 20):
            rows = []
            for n, decimals, decoded in coder.run(part.column("text").to_pylist()):
                whole = decoded.decode(errors="replace")
                row = (n, hashlib.sha256(decimals.encode()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest())
                rows.append((*row, [int(x) for x in decimals.split(",") if x], whole) if ids else row)
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("key"), *columns], ["key", *names])

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])]
    kinds = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32()), pa.string()] if ids else [])]
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")
    out = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key) if key != "key" else out


def encode_corpus(df: DataFrame, vocab_path: str, text: str = "text", key: str = "doc_id", most: int = LEXICON_WORDS) -> DataFrame:
    """Count the words of all rows, compile the frequent ones, and encode and decode every row."""
    lexicon = build_lexicon(frequent_words(df, vocab_path, text, most), vocab_path)
    return encode_and_decode(df, vocab_path, lexicon, text, key)
