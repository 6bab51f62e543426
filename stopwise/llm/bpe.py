"""Byte-level BPE by rank-synchronous merging of ragged arrays.

The pre-tokens of many texts are merged together: all symbols lie in one flat array with the
number of the sequence that each belongs to. In every round each sequence finds its pair of lowest
rank, and all occurrences of that pair in it merge at once, left to right without overlap. This is
what the sequential rule does, since a merge never brings forth a pair of lower rank than its own
that existed before. Sequences without a mergeable pair leave the arrays.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the pre-token pattern that byte-level tokenizers of this kind are defined by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer pre-tokens are merged one by one with a heap, as rounds over them would cost their square.
LONG = 400
#: Entries of a worker's memory of pieces, and letters of each at most, so that it is bounded in bytes; a full memory is emptied, which changes no result.
MEMORY, LETTERS = 200_000, 64
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge ranks and token bytes of a tokenizer file, in arrays.

    Pairs are found in an open hash table of two arrays: ``keys`` and ``ranks``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.base = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.base[byte] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.rank_of = {int(k): r for r, k in enumerate(keys)}
        bits = 4 + max(4, int(len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        left = np.arange(len(keys))
        slots = self._slots(keys)
        while len(left):
            free = self.keys[slots[left]] < 0
            _, first = np.unique(slots[left[free]], return_index=True)
            put = left[free][first]
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], put
            left = np.setdiff1d(left, put, assume_unique=True)
            slots[left] = (slots[left] + 1) & self.mask
        marks = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.split_special = regex.compile(f"({marks})").split if marks else lambda text: [text]
        self.pre_tokens = regex.compile(PATTERN).findall

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it never merges."""
        keys = a.astype(np.int64) << 20 | b
        slots = self._slots(keys)
        out = np.full(len(keys), NONE, np.int32)
        at = np.arange(len(keys))
        while len(at):
            there = self.keys[slots[at]]
            hit = there == keys[at]
            out[at[hit]] = self.ranks[slots[at[hit]]]
            at = at[~hit & (there >= 0)]
            slots[at] = (slots[at] + 1) & self.mask
        return out

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each pre-token."""
        flat, counts = self.merge_flat(words)
        return np.split(flat, np.cumsum(counts)[:-1]) if words else []

    def merge_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pre-tokens in a row, and the number of tokens of each."""
        lengths = np.array([len(w) for w in words], np.int64)
        long = [(i, self.merge_long(words[i])) for i in np.flatnonzero(lengths > LONG)]
        short = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        ids = self.base[np.frombuffer(b"".join(words if not long else [words[i] for i in short]), np.uint8)]
        seq = np.repeat(short, lengths[short])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks = self._ranks(ids, seq)
        while len(ids):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(seq)])
            lowest = np.minimum.reduceat(ranks, starts)
            ended = np.repeat(lowest == NONE, sizes)
            if ended.any():
                done.append((seq[ended], ids[ended]))
                on = ~ended
                ids, seq, ranks, sizes, lowest = ids[on], seq[on], ranks[on], sizes[lowest != NONE], lowest[lowest != NONE]
                if not len(ids):
                    break
            hit = ranks == np.repeat(lowest, sizes)
            at = np.flatnonzero(hit)
            run = np.r_[True, at[1:] != at[:-1] + 1]
            offset = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[offset % 2 == 0]
            ids[at] = self.made[ranks[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            changed = np.zeros(len(ids), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            # the symbol before a merged one may itself have been merged away into an earlier one
            changed[np.maximum(at - 2, 0)] = True
            ids, seq, ranks, changed = ids[keep], seq[keep], ranks[keep], np.flatnonzero(changed[keep])
            last = np.r_[seq[1:] != seq[:-1], True]
            new = np.full(len(changed), NONE, np.int32)
            inner = ~last[changed]
            new[inner] = self.pair_ranks(ids[changed[inner]], ids[changed[inner] + 1])
            ranks[changed] = new
        done += [(np.full(len(x), i), x) for i, x in long]
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        seqs, flat = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        return flat[np.argsort(seqs, kind="stable")], np.bincount(seqs, minlength=len(words))

    def _ranks(self, ids: np.ndarray, seq: np.ndarray) -> np.ndarray:
        ranks = np.full(len(ids), NONE, np.int32)
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        ranks[inner] = self.pair_ranks(ids[inner], ids[inner + 1])
        return ranks

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long pre-token, by a heap over a linked list."""
        ids = self.base[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, made = self.rank_of, self.made
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = int(made[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank_of.get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (q := rank_of.get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (q, h, ids[h], ids[i]))
        return np.array([x for x in ids if x >= 0], np.int32)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each Python process."""
    return Vocabulary(path)


#: Letters and signs on which all versions of the Unicode tables agree; other texts go to the library's own splitter.
USUAL = regex.compile(r"[\x00-ɏͰ-ͷЀ-ԯ‐-⁯€]*+").fullmatch
#: A space before white space or the end: there no pre-token begins, for one begins just where a visible letter follows.
ODD_SPACE = regex.compile(r" (?:\s|\Z)").search
FIRST_SPACE = regex.compile(r" (?=\S)")


@lru_cache(maxsize=1)
def _library_splitter():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False).pre_tokenize_str


def pre_tokens(vocab: Vocabulary, text: str) -> list[str]:
    """The pre-tokens of a text without special tokens."""
    if text.isascii() or USUAL(text):
        return vocab.pre_tokens(text)
    return [text[a:b] for _, (a, b) in _library_splitter()(text)]


def pieces(vocab: Vocabulary, text: str) -> list[str]:
    """A text cut into pieces that can be encoded each by itself; joined they are the text.

    Special tokens are pieces. Elsewhere a pre-token always begins at a space that a visible letter
    follows, so the pieces are words with their leading space and what white space follows them.
    """
    if any(mark in text for mark in vocab.special):
        return [p for part in vocab.split_special(text) if part for p in ([part] if part in vocab.special else _cut(part))]
    return _cut(text)


def _cut(text: str) -> list[str]:
    if not text:
        return []
    if "\0" in text:
        at = [0, *(m.start() for m in FIRST_SPACE.finditer(text)), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:], strict=False) if a < b]
    spaced = FIRST_SPACE.sub("\0 ", text) if ODD_SPACE(text) else text.replace(" ", "\0 ")
    out = spaced.split("\0")
    return out if out[0] else out[1:]


def encode_pieces(vocab: Vocabulary, new: list[str]) -> list[np.ndarray]:
    """Token ids of each piece; all their pre-tokens are merged together."""
    parts = [[] if p in vocab.special else pre_tokens(vocab, p) for p in new]
    words = list(set().union(*parts)) if parts else []
    ids = dict(zip(words, vocab.merge([w.encode() for w in words]), strict=True))
    return [
        np.concatenate([ids[w] for w in part]) if part else np.array([vocab.special[p]] if p in vocab.special else [], np.int32)
        for p, part in zip(new, parts, strict=True)
    ]
