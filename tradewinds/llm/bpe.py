"""Byte-pair encoding and decoding by forced-boundary splitting.

A pair of bytes that stands side by side inside no token of the vocabulary can never be joined, so a text may be cut
between them. Cuts before white space divide a text into fragments of white space and one word, of which most are
met again and again; other cuts divide long fragments further. Every fragment is encoded on its own, all new ones of a
batch side by side, and remembered for a while; then the ids are strung together.

Only cuts that the splitting pattern of the tokenizer cannot notice are used: after a byte that is no white space
and before one that is, or after an ASCII letter or digit. The pattern looks ahead only past white space, and what it
does after a letter or digit does not depend on what went before.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tradewinds.llm.chunks import give_back, texts_of

_UNIT = re.compile(rb"[\x09-\x0d\x20]*[^\x09-\x0d\x20]+|[\x09-\x0d\x20]+\Z")
_WHITE = frozenset(b"\x09\x0a\x0b\x0c\x0d\x20")
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_REMEMBERED = 80_000  # fragments of a generation that a worker remembers; it keeps the last two
_SHORT = 32  # bytes of a fragment up to which no further cut is looked for
_TOGETHER = 64  # bytes of a piece up to which it is encoded together with others
_SLOT_BITS = 20


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: visible Latin-1 characters stand for
    themselves, the others take the code points from 256 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = {}, 256
    for b in range(256):
        letters[chr(b if b in shown else spare)] = b
        spare += b not in shown
    return letters


class ByteBpe:
    """A byte-level vocabulary: ids of token bytes, merges by rank, the pairs at which a text may be cut."""

    def __init__(self, described: dict, pattern: str):
        letters, model = byte_letters(), described["model"]
        self.ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        self.bytes = [b""] * (1 + max([*self.ids.values(), *(t["id"] for t in described["added_tokens"])]))
        for token, i in self.ids.items():
            self.bytes[i] = token
        self.special = {t["content"].encode(): t["id"] for t in described["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        self.single = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        for rank, merge in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in part) for part in (merge if isinstance(merge, list) else merge.split(" ")))
            self.ranks.setdefault(self.ids[a] << 32 | self.ids[b], rank)
            self.made.append(self.ids[a + b])
        self._rank_table()
        joined = np.zeros((256, 256), dtype=bool)
        for token in self.ids:
            own = np.frombuffer(token, dtype=np.uint8)
            joined[own[:-1], own[1:]] = True
        self.joined = joined
        # pairs of a byte and white space that a token holds are no certain cuts
        doubtful = [bytes((a, b)) for a in range(256) for b in _WHITE if a not in _WHITE and joined[a, b]]
        self.doubtful = re.compile(b"|".join(map(re.escape, doubtful))) if doubtful else None
        self.split = regex.compile(pattern)
        self.special_split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.units: dict[bytes, list[int]] = {}
        self.older: dict[bytes, list[int]] = {}

    def _rank_table(self) -> None:
        """The ranks by hashed pair: the entries of a slot stand side by side."""
        keys = np.array(list(self.ranks), dtype=np.int64)
        slots = self._slots(keys)
        order = np.argsort(slots, kind="stable")
        self.pairs, self.pair_ranks = keys[order], np.array(list(self.ranks.values()), dtype=np.int64)[order]
        self.slot_begin = np.searchsorted(slots[order], np.arange((1 << _SLOT_BITS) + 1)).astype(np.int32)
        self.slot_most = int(np.diff(self.slot_begin).max()) if len(keys) else 0
        self.made_ids = np.array(self.made, dtype=np.int64)

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _ranks_of(self, keys: np.ndarray) -> np.ndarray:
        """The rank of every pair; as many as there are merges if it is none."""
        out = np.full(len(keys), len(self.made), dtype=np.int64)
        slot = self._slots(keys)
        at, end = self.slot_begin[slot], self.slot_begin[slot + 1]
        look = np.flatnonzero(at < end)
        for _ in range(self.slot_most):
            here = at[look]
            same = self.pairs[here] == keys[look]
            out[look[same]] = self.pair_ranks[here[same]]
            look = look[~same]
            at[look] += 1
            look = look[at[look] < end[look]]
        return out

    def encode(self, text: bytes) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def encode_many(self, texts: list[bytes]) -> list[list[int]]:
        cut = [self._fragments(t) for t in texts]
        known = self._learn(set(chain.from_iterable(cut)))
        return [list(chain.from_iterable(map(known.__getitem__, fragments))) for fragments in cut]

    def _fragments(self, text: bytes) -> list[bytes]:
        if self.special_split and self.special_split.search(text):
            parts = self.special_split.split(text)
            return list(chain.from_iterable([p] if i % 2 else self._plain_fragments(p) for i, p in enumerate(parts)))
        return self._plain_fragments(text)

    def _plain_fragments(self, text: bytes) -> list[bytes]:
        fragments = _UNIT.findall(text)
        if self.doubtful and self.doubtful.search(text):
            fragments = self._rejoined(fragments)
        return fragments

    def _rejoined(self, fragments: list[bytes]) -> list[bytes]:
        whole: list[list[bytes]] = []
        for f in fragments:
            if whole and self.joined[whole[-1][-1][-1], f[0]]:
                whole[-1].append(f)
            else:
                whole.append([f])
        return [b"".join(w) for w in whole]

    def _learn(self, fragments: set[bytes]) -> dict[bytes, list[int]]:
        """Make sure that all ``fragments`` are remembered."""
        if len(self.units) > _REMEMBERED:
            self.units, self.older = {}, self.units
        units, older = self.units, self.older
        pieces: dict[bytes, list[bytes]] = {}
        for f in fragments - units.keys():
            if f in older:
                units[f] = older[f]
            elif f in self.special:
                units[f] = [self.special[f]]
            else:
                pieces[f] = self._pieces(f)
        new = list(set(chain.from_iterable(pieces.values())) - units.keys())
        short = [p for p in new if len(p) <= _TOGETHER]
        units.update(zip(short, self._merge_together(short), strict=True))
        units.update((p, self._merge_one(p)) for p in new if len(p) > _TOGETHER)
        for f, parts in pieces.items():
            if len(parts) > 1:
                units[f] = list(chain.from_iterable(units[p] for p in parts))
        return units

    def _pieces(self, fragment: bytes) -> list[bytes]:
        """Where the splitting pattern and further certain cuts divide a fragment."""
        core = fragment.rstrip(_MARKS)
        word = core[1:] if core[:1] == b" " else core
        if word.isalpha() or word.decode("utf-8", "surrogateescape").isalpha():
            # letters and then only marks are two pieces to the pattern
            pieces = [core, fragment[len(core) :]] if len(core) < len(fragment) else [fragment]
        else:
            pieces = [p.encode("utf-8", "surrogateescape") for p in self.split.findall(fragment.decode("utf-8", "surrogateescape"))]
        if max(map(len, pieces)) <= _SHORT:
            return pieces
        out = []
        for piece in pieces:
            at = 0
            for k in range(1, len(piece)):
                if piece[k - 1] in _PLAIN and not self.joined[piece[k - 1], piece[k]]:
                    out.append(piece[at:k])
                    at = k
            out.append(piece[at:])
        return out

    def _merge_together(self, pieces: list[bytes]) -> list[list[int]]:
        """Merge the leftmost pair of the best rank in every piece, again and again."""
        ids = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        none, done = len(self.made), []
        while len(ids):
            rank = np.full(len(ids), none, dtype=np.int64)
            inner = np.flatnonzero(piece[:-1] == piece[1:])
            rank[inner] = self._ranks_of(ids[inner] << 32 | ids[inner + 1])
            turn = np.flatnonzero(np.diff(piece, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, turn), np.diff(np.append(turn, len(ids))))
            over = best == none
            done.append((piece[over], ids[over]))
            at = np.flatnonzero((rank == best) & ~over)
            at = at[np.diff(piece[at], prepend=-1) != 0]
            ids[at] = self.made_ids[rank[at]]
            stay = ~over
            stay[at + 1] = False
            ids, piece = ids[stay], piece[stay]
        piece, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (piece, ids)
        order = np.argsort(piece, kind="stable")
        edge = np.cumsum(np.bincount(piece, minlength=len(pieces))).tolist()
        flat = ids[order].tolist()
        return [flat[a:b] for a, b in zip([0, *edge], edge, strict=False)]

    def _merge_one(self, piece: bytes) -> list[int]:
        return self._heap(self.single[np.frombuffer(piece, dtype=np.uint8)].tolist())

    def _heap(self, ids: list[int]) -> list[int]:
        get, n = self.ranks.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(todo)
        while todo:
            rank, k, a, b = heapq.heappop(todo)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = self.made[rank], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n and (r := get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(todo, (r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]


@cache
def load(path: str, pattern: str) -> ByteBpe:
    with open(path, encoding="utf-8") as file:
        made = ByteBpe(json.load(file), pattern)
    give_back()  # what the description took
    return made


def _coding(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # of earlier tasks
        bpe = load(path, pattern)
        gc.disable()  # nothing here refers to itself, and the collector would visit all that is remembered
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                batch = whole.slice(at, 400)
                ids, texts = [], []
                for got in bpe.encode_many(texts_of(pa.Table.from_batches([batch]))):
                    ids.append(np.array(got, dtype=np.int32))
                    texts.append(bpe.decode(got))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.binary())],
                    names=[*batch.schema.names[1:], "_ids", "_decoded"],
                )
        gc.enable()
        give_back()

    return run


def encode_and_decode(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Encode every text with the byte-level vocabulary at ``path`` (on every machine) and decode the ids again.

    Ids are those of the vocabulary's own library without added special tokens; the string of a special token in a
    text is that token. Returns per row: the id, the ``keep`` columns, ids, n_tokens and decoded. A null text is
    empty and has no ids. Rows are looked at one by one; rows without an id and repeated rows stay as they are.
    """
    rows = docs.select(
        F.col(text).cast("binary").alias("_text"), F.col(doc_id).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep]
    )
    kinds = rows.drop("_text").schema.add("_ids", ArrayType(IntegerType())).add("_decoded", "binary")
    done = rows.mapInArrow(_coding(path, pattern), kinds)
    return done.select(
        F.col("_id").alias(doc_id),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
        F.col("_ids").alias("ids"),
        F.size("_ids").cast("long").alias("n_tokens"),
        F.col("_decoded").cast("string").alias("decoded"),
    )
