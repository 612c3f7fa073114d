"""Lexical search, token counts and target resampling against brute-force versions and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F
from tradewinds.llm import lexical_search, target_resampling, token_counts
from tradewinds.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def ranked(docs, items, top=10):
    """(item, rank, doc, score) by the formula, for items and documents with ids of their own."""
    terms = [(k, Counter(words_of(t))) for k, t in docs]
    terms = [(k, c) for k, c in terms if c]
    n_docs, total = len(terms), sum(sum(c.values()) for _, c in terms)
    held = Counter(w for _, c in terms for w in c)
    out = []
    for item, text in items:
        scores = []
        for k, c in terms:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                for w in set(words_of(text))
                if w in c
            )
            if score > 0:
                scores.append((-score, k is None, k or 0, k))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1)]
    return sorted(out, key=str)


def uneven_texts(seed, n, most):
    """Texts in which some words are in almost every text and others in few."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "DÉ-jà", "the"] * 5
    return [" ".join(draw.choice(words[: draw.randint(1, len(words))]) for _ in range(draw.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("settings", [{}, {"_STEP": 3, "_LONG": 2, "_SEGMENT": 40, "_TOGETHER": 4}, {"BLOCK_BYTES": 150, "_PIECE": 90, "_ENTRIES": 50}])
def test_search_equals_brute_force(make, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(lexical_search, name, value)
    docs = list(enumerate(uneven_texts(1, 260, 60)))
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # ties
    items = list(enumerate(uneven_texts(2, 9, 12)))
    got = lexical_search.search(make(docs, "doc_id long, text string"), make(items, "item_id int, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items)


def test_segments_skip_and_lose_nothing():
    """One segment after the other: what the best so far lets through is the same whatever the order."""
    texts = [t.encode() for t in uneven_texts(3, 600, 40)]
    queries = lexical_search.build_queries([t.encode() for t in uneven_texts(4, 20, 15)])
    doc, term, tf = lexical_search.entries(lexical_search.name_words(texts, lexical_search.ALPHANUMERIC), queries.vocabulary)
    lengths = np.array([len(words_of(t.decode())) for t in texts])
    weights = np.random.default_rng(5).integers(0, 5000, len(queries.vocabulary))
    of = lexical_search.Statistics(int((lengths > 0).sum()), int(lengths.sum()), weights)

    def part(rows):
        inside = np.isin(doc, rows)
        order = np.lexsort((doc[inside], term[inside]))
        met, begin = np.unique(term[inside][order], return_index=True)
        place = np.searchsorted(rows, doc[inside][order])
        return lexical_search.Segment(rows, np.zeros(len(rows), bool), lengths[rows], met, np.append(begin, len(order)), place, tf[inside][order])

    whole = lexical_search.search_segment(part(np.arange(600)), queries, of, lexical_search.NOTHING)
    for parts in (np.split(np.arange(600), 5), np.split(np.arange(600), 5)[::-1]):
        best = lexical_search.NOTHING
        for rows in parts:
            best = lexical_search.search_segment(part(rows), queries, of, best)
        assert all((a == b).all() for a, b in zip(best, whole, strict=True))
    assert len(whole.query) == 10 * (np.diff(queries.first) > 0).sum()


def test_search_of_odd_documents(odd_documents, make):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    items = [(1, "two FOUR ñandú"), (2, None), (3, "--- !"), (None, "some 中文"), (5, "two FOUR ñandú"), (6, " ".join(f"w{i}" for i in range(977)))]
    asked = make([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = lexical_search.search(odd_documents, asked)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(rows, items)
    assert lexical_search.search(odd_documents.limit(0), asked).count() == 0
    assert lexical_search.search(odd_documents, asked.limit(0)).count() == 0
    twice = make([(1, "two"), (1, "two")], "item_id long, text string")
    assert sorted(tuple(r)[:3] for r in lexical_search.search(odd_documents, twice).collect()) == [(1, 1, 3), (1, 1, 3), (1, 2, 3), (1, 2, 3)]


def test_search_where_one_text_fills_a_third(make):
    docs = [(i, "common words here") for i in range(400)] + [(400 + i, f"common word{i % 50} other") for i in range(800)]
    items = [(1, "common words"), (2, "word7 other"), (3, "words here common other word3")]
    got = lexical_search.search(make(docs, "doc_id long, text string").repartition(7), make(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items)


def vocabulary():
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def library_counts(texts):
    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_equal_the_library(monkeypatch):
    monkeypatch.setattr(token_counts, "_REMEMBERED", 50)
    monkeypatch.setattr(token_counts, "_WHOLE", 200)
    known = token_counts.Vocabulary(vocabulary(), public_tokenizers.PATTERN)
    lengths = token_counts.Lengths(token_counts.length_table(["the", "re's", "ab", "12", "中文", "--"], known), known)
    draw = random.Random(6)
    letters = "ab'sSre tl  \n\t\r 　\x85\x1c\x0b é中文😀🏽01²½!?\"§…--__<|endoftext|>ñ́ا"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(4000)]
    texts += ["", "a  <|endoftext|> 's x", "<|endoftext|>" * 3, "th" * 3000, " " * 500 + "b", "the " * 300, "a" + "\n " * 40]
    assert [lengths.of_text(t) for t in texts] == library_counts(texts)
    assert len(known.young) <= 51 and len(known.old) <= 51


def test_every_character_is_split_as_the_library_does():
    """Texts of each character among letters, digits, marks and white space."""
    known = token_counts.Vocabulary(vocabulary(), public_tokenizers.PATTERN)
    lengths = token_counts.Lengths({}, known)
    some = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 37 == 0)]
    texts = [f"a{c}1{c}!{c} {c}{c}b  {c}\n" for c in some]
    assert [lengths.of_text(t) for t in texts] == library_counts(texts)


def test_token_counts_of_a_whole_table(spark):
    rows = QUERIES["op12_token_counts"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = dict(zip(texts, library_counts(list(texts.values())), strict=True))
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(texts)
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024) for r in rows)


def test_token_counts_of_odd_documents(odd_documents):
    got = token_counts.count_tokens(odd_documents, vocabulary(), public_tokenizers.PATTERN, keep=("kept_text", "_chunk"), limit=10, share=0.01)
    rows = got.collect()
    texts = [(r.doc_id, r.text or "") for r in odd_documents.collect()]
    want = Counter((k, len(t.encode()), n, n > 10) for (k, t), n in zip(texts, library_counts([t for _, t in texts]), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert got.columns == ["doc_id", "kept_text", "_chunk", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.count_tokens(odd_documents.limit(0), vocabulary(), public_tokenizers.PATTERN).count() == 0


def test_frequent_words_come_from_all_tasks(make, monkeypatch):
    monkeypatch.setattr(token_counts, "_COUNTED", 40)
    monkeypatch.setattr(token_counts, "_KEPT", 20)
    rows = [(" ".join(["often", "also", "often", f"rare{i}", f"x{i}"]),) for i in range(300)] + [(None,), ("y" * 100,) * 1]
    assert sorted(token_counts.frequent_words(make(rows, "text string").repartition(5), share=0.1)) == ["also", "often"]


def test_crc_of_joined_words():
    draw = random.Random(8)
    parts = [(bytes(draw.randrange(256) for _ in range(draw.randint(0, 40))), draw.randbytes(draw.choice([0, 1, 5, 70, 3000]))) for _ in range(200)]
    crc = [np.array([zlib.crc32(p[k]) for p in parts], dtype=np.uint32) for k in (0, 1)]
    got = target_resampling.crc_joined(*crc, np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def drawn(docs, target, longest, buckets, least_words, percent, seed):
    """(id, n_features, weight, score, rank) by the definitions."""

    def runs(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        made = [" ".join(w[a : a + k]) for k in range(1, longest + 1) for a in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(r.encode()) % buckets for r in made]

    have = [(k, *runs(t)) for k, t in docs]
    source, wanted = Counter(b for _, _, f in have for b in f), Counter(b for t in target for b in runs(t)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in source}
    rows = []
    for k, n, f in have:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = place
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(make, monkeypatch, longest):
    monkeypatch.setattr(target_resampling, "_PIECE", 700)
    monkeypatch.setattr(target_resampling, "_ENTRIES", 30)
    docs = list(enumerate(uneven_texts(9, 300, 60))) + [(500, "x" * 65 + " " + "y" * 300), (501, "x" * 64 + " b " + "y" * 300)]
    target = [*uneven_texts(10, 20, 9), None, "x" * 65 + " w1"]
    got = target_resampling.resample(
        make(docs, "doc_id long, text string").repartition(6), make([(t,) for t in target], "text string"),
        longest=longest, buckets=97, least_words=5, percent=30, seed=7,
    )
    assert Counter(map(tuple, got.collect())) == drawn(docs, target, longest, 97, 5, 30, 7)


def test_resampling_of_odd_documents(odd_documents, make):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    target = make([("four five ß",), ("",), (None,)], "text string")
    got = target_resampling.resample(odd_documents, target, keep=("kept_text", "_chunk"), buckets=50, least_words=1, percent=60)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == drawn(
        rows, ["four five ß"], 1, 50, 1, 60, 2024
    )
    nothing = make([], "text string")
    got = target_resampling.resample(odd_documents, nothing, percent=0)
    assert got.count() == 9 and got.filter("rank is not null").count() == 0
    assert target_resampling.resample(odd_documents.limit(0), target).count() == 0


def test_resampling_where_one_row_fills_a_third(make):
    docs = [(7, "one two three")] * 300 + [(i, f"one word{i}") for i in range(100, 700)]
    got = target_resampling.resample(make(docs, "doc_id long, text string").repartition(9), make([("one two",)], "text string"), buckets=100, least_words=1, percent=90)
    rows = got.collect()
    places = sorted(r["rank"] for r in rows if r["rank"])
    assert places == list(range(1, 811)) and len(rows) == 900
    by_rank = [(-r.score, r.doc_id) for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])]
    assert by_rank == sorted(by_rank)
    held = defaultdict(int)
    for r in rows:
        held[r.doc_id] += 1
    assert held[7] == 300
