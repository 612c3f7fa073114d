"""Hashed counts of byte n-grams and words, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tradewinds.llm.words import join_names, name_words

_PIECE = 1 << 19
_MIX = np.uint32(2654435761)


def pieces(texts: list[bytes], rows: int = 128) -> Iterator[list[bytes]]:
    """The texts in groups of at most ``rows`` and about half a megabyte, but one text at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < rows and (end == at or size + len(texts[end]) < _PIECE):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def gram_counts(texts: list[bytes], sizes: tuple[int, ...], bins: int, table: bytes | None = None) -> list[np.ndarray]:
    """For each size, the counts of hashed n-grams of each text (rows) after translation by ``table``. A text is
    taken to start after white space; no n-gram holds bytes of two texts."""
    most = max(sizes)
    lead = b"\n" * most
    joined = b"".join([lead + t for t in texts])
    if table:
        joined = joined.translate(table)
    raw = np.frombuffer(joined, dtype=np.uint8)
    size = np.array([len(t) + most for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) * bins, size)
    begin = np.cumsum(size) - size
    out, key, shift = [], raw.astype(np.uint32), np.uint32(32 - int(bins).bit_length() + 1)
    for n in range(1, most + 1):
        if n > 1:
            key[n - 1 :] = key[n - 1 :] * np.uint32(257) + raw[: len(raw) - n + 1]
        if n in sizes:
            at = owner + ((key * _MIX) >> shift).astype(np.int64)
            counts = np.bincount(at, minlength=len(texts) * bins)
            # those that end before the n-th byte of a text began in the text before
            np.subtract.at(counts, at[(begin[:, None] + np.arange(n - 1)).ravel()], 1)
            out.append(counts.reshape(len(texts), bins))
    return out


def word_counts(texts: list[bytes], bins: int, pair_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed words and of hashed pairs of neighbours of each text; all pairs of a word and itself are one."""
    words = name_words(texts)
    owner, names = words.owner, words.names
    single = np.bincount(owner * bins + (names % np.uint64(bins)).astype(np.int64), minlength=len(texts) * bins)
    pair = (join_names(names[:-1], names[1:]) % np.uint64(pair_bins - 1)).astype(np.int64) + 1
    pair[names[:-1] == names[1:]] = 0
    within = owner[:-1] == owner[1:]
    double = np.bincount((owner[:-1] * pair_bins + pair)[within], minlength=len(texts) * pair_bins)
    return single.reshape(len(texts), bins), double.reshape(len(texts), pair_bins)
