"""Byte-pair encoding in numpy: many words in one flat symbol array, merged in rounds.

In each round every word's lowest-rank adjacent pair is found by binary search over the sorted pair keys and all its
occurrences in that word are merged at once, left to right. That equals merging one at a time where no token is made by
two merges and each merge is learnt after those that make its parts; where a file breaks this, one occurrence is merged
a round.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: White space as the tokenizers library's expressions have it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The patterns of the two tokenizer files.
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = chain(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Merges:
    """Vocabulary and ranked merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.specials).items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        n = self.size = max(self.vocab.values()) + 1
        left, right = (np.array([self.vocab[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(left * n + right, kind="stable")
        self.keys, self.ranks, self.made = (left * n + right)[order], order.astype(np.int32), made[order].astype(np.int32)
        self.by_rank = made.astype(np.int32)
        born = np.full(n, -1)
        born[made] = np.arange(len(made))
        self.at_once = len(set(made.tolist())) == len(made) and bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())
        letters = byte_letters()
        self.of_byte = np.array([self.vocab[c] for c in letters], dtype=np.int32)
        self.of_last = np.array([self.vocab[c + self.suffix] for c in letters], dtype=np.int32)
        self.split = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that survive in all words, one after the other, and how many each word has."""
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.of_byte[raw]
        ends = np.cumsum(counts)
        full = counts > 0
        symbols[ends[full] - 1] = self.of_last[raw[ends[full] - 1]]
        word = np.repeat(np.arange(len(words)), counts)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = self._ranks(symbols, word)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(rank, starts)
            open_ = np.repeat(least != NONE, sizes)
            if not open_.all():  # words without a pair to merge are ready
                done.append((symbols[~open_], word[~open_]))
                symbols, word, rank = symbols[open_], word[open_], rank[open_]
                keep = least != NONE
                least, sizes = least[keep], sizes[keep]
                if not len(symbols):
                    break
            hit = rank == np.repeat(least, sizes)
            at = np.arange(len(hit))
            fresh = hit & ~np.r_[False, hit[:-1]]
            first = np.maximum.accumulate(np.where(fresh, at, 0))
            if self.at_once:
                hit &= (at - first) % 2 == 0  # of overlapping pairs every second one
            else:
                starts = np.cumsum(sizes) - sizes
                hit = np.zeros_like(hit)
                hit[np.minimum.reduceat(np.where(rank == np.repeat(least, sizes), at, len(at)), starts)] = True
            symbols = np.where(hit, self.by_rank[np.where(hit, rank, 0)], symbols)
            gone = np.r_[False, hit[:-1]]
            symbols, word = symbols[~gone], word[~gone]
        if not done:
            return np.zeros(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    def _ranks(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol."""
        rank = np.full(len(symbols), NONE, dtype=np.int32)
        if len(symbols) > 1:
            key = symbols[:-1].astype(np.int64) * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NONE)
        return rank


@lru_cache(4)
def merges(path: str) -> Merges:
    return Merges(path)


#: Letters and numbers of Latin texts, which need no Unicode tables.
_LATIN_LETTERS, _LATIN_NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
_BEYOND = re.compile("[^\x00-\x1b -\u017f]")
_LATIN_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN_LETTERS}]+|[{_LATIN_NUMBERS}]|[^{SPACE}{_LATIN_LETTERS}{_LATIN_NUMBERS}]+")
_LATIN_BYTE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN_LETTERS}]+| ?[{_LATIN_NUMBERS}]+| ?[^{SPACE}{_LATIN_LETTERS}{_LATIN_NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
_BYTE = regex.compile(BYTE_PATTERN)


def byte_words(text: str) -> list[str]:
    """Pre-tokens of byte-level files."""
    return (_BYTE if _BEYOND.search(text) else _LATIN_BYTE).findall(text)


def latin(text: str) -> bool:
    return not _BEYOND.search(text)


def latin_words(text: str) -> list[str]:
    """Lower-cased pre-tokens of a Latin text for files with word ends."""
    return _LATIN_WORD.findall(text.lower())


class Cache:
    """What a task knows of words it has met; `learn` makes the values of new ones. Of two generations the older is forgotten when the younger is full."""

    def __init__(self, learn, limit: int = 150_000):
        self.learn, self.limit, self.known, self.old = learn, limit, {}, {}

    def add(self, texts: list[list]) -> dict:
        """All words of the batch, known by now."""
        met = set(chain.from_iterable(texts))
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        new = met - self.known.keys()
        again = new & self.old.keys()
        self.known.update((k, self.old[k]) for k in again)
        new = list(new - again)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.known.update(zip(part, self.learn(part), strict=True))
        return self.known
