"""Words of many texts as 64-bit names, without a Python object per word.

Texts are UTF-8 bytes. A name depends on the bytes of the word alone, so every task of a job names equal words
alike. Names are 64 bits wide: two different words share one with a chance of 2**-64.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

WHITE = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# a word of the contamination rule: digits, letters and everything outside ASCII, A-Z lower-cased
ALPHANUMERIC = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
_PIECE = 1 << 19  # bytes of text whose words are named at once
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


class Words(NamedTuple):
    """``names[first[i]:first[i + 1]]`` are the words of text i, in order; ``tails`` are their last two bytes."""

    names: np.ndarray
    first: np.ndarray
    tails: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The number of the text of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """One of many independent scramblings."""
    return mix(x ^ np.uint64((seed + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


def join_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A name for an ordered pair of names."""
    return mix(left * _BASE + mix(right ^ _M2))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 2 * _PIECE)
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = (made[0], made[1])
    return _powers


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes that end in white space."""
    inside = np.empty(len(raw) + 1, dtype=bool)
    inside[0] = False
    np.logical_not(_IS_WHITE[raw], out=inside[1:])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[0::2], turns[1::2]


def name_words(texts: list[bytes], table: bytes | None = None) -> Words:
    """Split ``texts`` at white space after byte-wise translation by ``table`` and name the words."""
    names, counts, tails = [np.zeros(0, dtype=np.uint64)], [], [np.zeros(0, dtype=np.uint16)]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < _PIECE):
            size += len(texts[end]) + 1
            end += 1
        got, per_text, tail = _name_piece(texts[at:end], table)
        names.append(got)
        tails.append(tail)
        counts.append(per_text)
        at = end
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=first[1:])
    return Words(np.concatenate(names), first, np.concatenate(tails))


def _name_piece(texts: list[bytes], table: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined = b"\n".join(texts) + b"\n"
    if table:
        joined = joined.translate(table)
    raw = np.frombuffer(joined, dtype=np.uint8)
    start, end = spans(raw)
    edge = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(start, edge), prepend=0)
    up, down = _powers_to(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    names = (total[end] - total[start]) * down[start]
    tails = raw[end - 1].astype(np.uint16) | (raw[np.maximum(end - 2, start)].astype(np.uint16) << np.uint16(8))
    return mix(names + (end - start).astype(np.uint64) * _M2), per_text, tails


def sequences(words: Words, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Names of every ``size`` consecutive words within a text, and the text of each; with ``short``
    a text of fewer words, but not none, is one sequence."""
    names, counts = words.names, words.counts
    n = np.maximum(counts - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), n)
    start = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(len(owner))
    got = mix(names[start] + np.uint64(size)) if len(owner) else np.zeros(0, dtype=np.uint64)
    for k in range(1, size):
        got = join_names(got, names[start + k])
    if short:
        few = np.flatnonzero((counts > 0) & (counts < size))
        one = np.zeros(len(few), dtype=np.uint64)
        for k in range(size - 1):
            has = counts[few] > k
            at = names[words.first[few[has]] + k]
            one[has] = join_names(one[has] + np.uint64(k == 0), at)
        got = np.concatenate([got, mix(one + counts[few].astype(np.uint64))])
        owner = np.concatenate([owner, few])
    return got, owner
