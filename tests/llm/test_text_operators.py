"""Operators on texts against brute-force versions and on odd rows."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F
from tradewinds.llm import bpe, brown, chunks, decontamination, language_id, minhash, neighbours, quality, substring_dedup, words
from tradewinds.llm.grams import gram_counts
from tradewinds.llm.html_text import extract_main_text, main_text
from tradewinds.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return (text or "").encode().split()


def repeats(rows, size):
    least = {}
    for k, t in rows:
        w = split(t)
        for a in range(len(w) - size + 1):
            least[tuple(w[a : a + size])] = min(least.get(tuple(w[a : a + size]), k), k)
    out = []
    for k, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            if least[tuple(w[a : a + size])] < k:
                gone[a : a + size] = [True] * size
        out.append((k, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def random_texts(seed, n, letters="abc", most=60):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choice(letters) for _ in range(draw.randint(0, most)))) for i in range(n)]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_repeats_equal_brute_force(make, letters):
    rows = random_texts(1, 60, letters)
    got = substring_dedup.remove_repeats(make(rows, "doc_id long, text string"), size=5)
    assert sorted(map(tuple, got.collect())) == repeats(rows, 5)


def test_window_names_depend_on_the_words_alone():
    draw = np.random.default_rng(2)
    inner = draw.integers(1, 4, 13).astype(np.uint64)
    found = set()
    for _ in range(50):
        around = [draw.integers(1, 4, draw.integers(0, 9)).astype(np.uint64) for _ in range(2)]
        line = np.concatenate([around[0], inner, around[1]])
        found.add(int(substring_dedup.window_names(words.mix(line), np.array([len(around[0])]), 13)[0]))
    assert len(found) == 1


def test_repeats_of_odd_documents(odd_documents):
    got = {(r[0], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(odd_documents, keep=("lang",)).collect()}
    assert got == {(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 7, 0), (4, 30000, 0), (5, 30001, 30000), (None, 7, 0), (6, 6, 0)}
    assert substring_dedup.remove_repeats(odd_documents.limit(0)).count() == 0


def near_groups(rows, width, percent):
    sets = {}
    for k, t in rows:
        w = split((t or "").translate(LOWER))
        sets[k] = ({tuple(w[a : a + width]) for a in range(len(w) - width + 1)} or {tuple(w)}) if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((k, len(sets[k]), find(k), find(k) == k) for k in sets)


def test_near_duplicates_equal_brute_force(make):
    draw = random.Random(4)
    base = [[draw.choice("abcdefghijklmnop") * draw.randint(1, 3) for _ in range(draw.randint(3, 150))] for _ in range(6)]
    rows = []
    for i in range(160):
        w = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 4, 8])):
            w[draw.randrange(len(w))] = draw.choice("xyz") * draw.randint(1, 9)
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicate_groups(make(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == near_groups(rows, 4, 80)


def test_near_duplicates_of_odd_documents(odd_documents):
    got = sorted(map(tuple, minhash.near_duplicate_groups(odd_documents).collect()), key=str)
    by = {r[0]: r[2:] for r in got}
    assert len(got) == 9 and by[None] == (None, True) and by[0] == (0, True) and by[5] == (4, False) and by[3] == (3, True)
    assert minhash.near_duplicate_groups(odd_documents.limit(0)).count() == 0


def test_sketches_fill_every_coordinate_and_estimate_similarity():
    draw = np.random.default_rng(5)
    a = draw.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], draw.integers(0, 2**63, 100).astype(np.uint64)])
    one = draw.integers(0, 2**63, 1).astype(np.uint64)
    made = minhash.sketch([a, b, one], 640)
    assert (made != minhash._EMPTY).all()
    assert abs((made[0] == made[1]).mean() - 0.6) < 0.08


def contaminated(docs, items, size):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    held = defaultdict(set)
    for k, t in items:
        w = word.findall((t or "").translate(LOWER))
        m = min(size, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            held[tuple(w[a : a + m])].add(str(k))
    out = []
    for k, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, found = [0] * len(w), set()
        for m in {len(x) for x in held}:
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in held:
                    found |= held[tuple(w[a : a + m])]
                    hit[a : a + m] = [1] * m
        out.append((k, len(w), sum(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 200])
def test_contamination_equals_brute_force(make, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    docs = random_texts(7, 80, ["a", "b,", "C-", "dé"], 400)
    items = [(i, t) for i, t in random_texts(8, 25, ["a", "B", "c", "dé"], 9)] + [(99, None), (100, "!!")]
    got = decontamination.find_contamination(make(docs, "doc_id long, text string"), make(items, "item_id long, text string"), size=4)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()) == contaminated(docs, items, 4)
    assert all(sum(s["to"] - s["from"] for s in r.hit_spans) == r.n_hit for r in got.collect())


def test_contamination_of_odd_documents(odd_documents, make):
    none = make([], "item_id long, text string")
    got = decontamination.find_contamination(odd_documents, none, keep=("kept_text",))
    assert got.count() == 9 and got.filter("contaminated").count() == 0
    items = make([(1, "two three FOUR"), (None, "some words"), (2, None)], "item_id long, text string")
    got = decontamination.find_contamination(odd_documents, items)
    assert {(r.doc_id, r.n_hit, tuple(r["items"])) for r in got.filter("contaminated").collect()} == {(3, 3, ("1",))}


def test_blocks_of_the_benchmark_meet_in_odd_documents(odd_documents, make, monkeypatch):
    items = make([(1, "two three FOUR"), (2, "seven"), (3, "four five six"), (4, "id at all"), (5, "w7 w8 w9"), (6, "中文")], "item_id long, text string")
    rows = lambda: sorted(map(str, decontamination.find_contamination(odd_documents, items, keep=("kept_text",)).collect()))
    whole = rows()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 30)
    assert rows() == whole and len(whole) == 9 and sum("items=['1', '2', '3']" in r for r in whole) == 2
    assert sum("items=['5']" in r for r in whole) == 2 and sum("items=['4']" in r for r in whole) == sum("items=['6']" in r for r in whole) == 1


def vocabulary():
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library():
    mine, theirs = bpe.load(vocabulary(), public_tokenizers.PATTERN), Tokenizer.from_file(vocabulary())
    draw = random.Random(9)
    letters = "ab'sSre tl  \n\t\r 　\x85\x1c\x0b é中文😀🏽01²½!?\"§…--__<|endoftext|>ñ́ا"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(5000)]
    texts += ["a  <|endoftext|> 's x", "th" * 3000, " " * 500 + "b", "re" * 20 + "hxqzj" * 20 + ",,,"]
    assert mine.encode_many([t.encode() for t in texts]) == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert all(mine.decode(mine.encode(t.encode())).decode() == t for t in texts)


def test_bpe_of_odd_documents(odd_documents):
    got = bpe.encode_and_decode(odd_documents, vocabulary(), public_tokenizers.PATTERN, keep=("text",))
    assert got.count() == 9 and got.filter("decoded != coalesce(text, '')").count() == 0
    assert {r.n_tokens for r in got.filter("coalesce(text, '') = ''").collect()} == {0}


def test_base_scores_are_exact_and_classes_help(spark):
    got = {r.doc_id: r for r in QUERIES["op7_lm_scoring"](spark, FOLDER).collect()}
    texts = {r.doc_id: split((r.text or "").translate(LOWER)) + [None] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    count = Counter(w for k, t in texts.items() if not got[k].held_out for w in t)
    total, distinct = sum(count.values()), len(count)
    for k, t in texts.items():
        assert got[k].n_tokens == len(t) and got[k].n_known == sum(w in count for w in t) and got[k].train_tokens == total
        assert math.isclose(got[k].base_score, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t), abs_tol=1e-7)
    held = [r for r in got.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def scores_by_hand(texts, learn, frequent):
    """Every word's class and every text's log10 probability, word by word in dictionaries."""
    word_of = lambda w: brown.name_words([w.encode()])
    trained = [t for t, known in zip(texts, learn, strict=True) if known]
    count = Counter(w for t in trained for w in t)
    name = {w: word_of(w).names.view(np.int64)[0] for t in texts for w in t}
    shape = {w: int(brown.shapes_of(word_of(w))[0]) for w in name}
    top = sorted(count, key=lambda w: (-count[w], name[w]))[:frequent]
    symbol = {w: brown.SHAPES + k for k, w in enumerate(top)}
    end = brown.SHAPES + len(top)
    pairs = np.zeros((end + 1, end + 1))
    for t in trained:
        line = [end, *[symbol.get(w, shape[w]) for w in t], end]
        for a, b in zip(line[:-1], line[1:], strict=True):
            pairs[a, b] += 1
    seed = brown.seed_of(pairs, np.zeros(0), np.zeros(0), len(trained))
    first = {w: int(seed.home[symbol.get(w, shape[w])]) for w in count} | {None: 0}
    gain = {w: np.zeros(brown.CLASSES) for w in count}
    for t in trained:
        for before, w, after in zip([None, *t], t, [*t[1:], None]):
            gain[w] = gain[w] + seed.weigh[first[before]] + seed.weigh[brown.CLASSES + first[after]]
    best = {w: int(np.argmax(gain[w].round(9))) for w in count}
    home = {w: best[w] if w not in symbol and gain[w][best[w]] > gain[w][first[w]] + brown.MOVE else first[w] for w in count}
    size, total = Counter(home.values()), Counter()
    for w, n in count.items():
        total[home[w]] += n
    once = {w: home[w] for w in count if count[w] == 1}
    most = lambda some: min(Counter(some).items(), key=lambda e: (-e[1], e[0]))[0]
    unknown = lambda w: most([c for v, c in once.items() if shape[v] == shape[w]] or list(once.values()) or [1])
    for w in set(name) - set(count):
        home[w] = unknown(w)
    lines = [[0, *[home[w] for w in t], 0] for t in texts]
    steps = Counter(p for k, a in zip(learn, lines, strict=True) if k for p in zip(a[:-1], a[1:], strict=True))
    follow = [sum(n for p, n in steps.items() if p[1] == c) for c in range(brown.CLASSES)]
    leave = [sum(n for p, n in steps.items() if p[0] == c) for c in range(brown.CLASSES)]
    overall = [(n + 1) / (sum(follow) + brown.CLASSES) for n in follow]
    out = []
    for t, line in zip(texts, lines, strict=True):
        p = sum(math.log10((steps[a, b] + overall[b]) / (leave[a] + 1)) for a, b in zip(line[:-1], line[1:], strict=True))
        out.append(p + sum(math.log10((count[w] + 1) / (total[home[w]] + size[home[w]] + 1)) for w in t))
    return {w: c for w, c in home.items() if w in count}, out


def test_every_word_has_a_class_and_scores_equal_those_by_hand(make):
    draw = random.Random(77)
    # kinds of words take turns, and their last letters, thus their shapes, do not tell the kind
    kinds = [[f"{a}{b}" for b in ("an", "el", "os", "im", "ar", "un")] for a in ("ka", "mo", "ti", "ru")]
    texts = []
    for k in range(90):
        at = draw.randrange(4)
        text = [draw.choices(kinds[(at + i) % 4], [8, 5, 3, 2, 1, 1])[0] for i in range(draw.randint(0, 25))]
        texts.append(text + ([f"rare{k}xy"] if k % 3 == 0 else []))
    learn = [k % 5 != 2 for k in range(len(texts))]
    home, score = scores_by_hand(texts, learn, 4)
    docs = make([(k, " ".join(t), known) for k, (t, known) in enumerate(zip(texts, learn, strict=True))], "doc_id long, text string, known boolean")
    got = {r.doc_id: r for r in brown.score_texts(docs, F.col("known"), keep=("known",), frequent=4).collect()}
    assert len(home) == len({w for t, known in zip(texts, learn, strict=True) if known for w in t}) and min(home.values()) > 0
    assert len({c for w, c in home.items() if w.endswith("an")}) > 2 and len(got) == len(texts) and all(math.isclose(got[k].score, score[k], abs_tol=1e-6) for k in got)


def test_packed_numbers_and_names():
    for values in ([], [0], [254, 255, 256, 3, 2**40, 0], list(range(600))):
        assert brown._unpacked(brown._packed(np.array(values, dtype=np.int64))).tolist() == values
    for names in ([], [7], [2**64 - 1], [0, 1, 2**48, 2**63, 2**64 - 2, 2**64 - 1]):
        assert brown._thick(brown._thin(np.array(names, dtype=np.uint64))).tolist() == names


def test_a_word_joins_the_class_of_its_neighbours():
    weigh = np.zeros((brown._SIDES, brown.CLASSES))
    weigh[3, 5], weigh[brown.CLASSES + 4, 6] = 4.0, 6.0
    word, side, n = np.array([0, 0, 2, 0, 3, 4]), np.array([3, brown.CLASSES + 4, 3, 3, 9, 3]), np.array([1, 1, 4, 1, 1, 1])
    # two neighbours against one, no neighbour, one four times, one that speaks for no class, one that says too little
    assert brown.best_classes(word, side, n, weigh, np.array([7, 7, 7, 8, 9])).tolist() == [5, 0, 5, 8, 9]


def test_scores_of_odd_documents(odd_documents):
    got = brown.score_texts(odd_documents, F.col("doc_id") < 4, keep=("kept_text",))
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 9 and rows[0].n_tokens == 1 and rows[0].n_known == 1 and rows[3].n_known == 8 and rows[None].n_known == 1
    assert brown.score_texts(odd_documents, F.lit(False)).filter("n_known > 0").count() == 0
    assert brown.score_texts(odd_documents.limit(0), F.lit(True)).count() == 0


def test_exchange_finds_two_languages():
    pairs = np.zeros((9, 9))
    pairs[:4, :4], pairs[4:8, 4:8], pairs[8, :], pairs[:, 8] = 10, 10, 1, 1
    home = brown.exchange(pairs, classes=3)
    assert len(set(home[:4])) == 1 and len(set(home[4:8])) == 1 and home[0] != home[4]


def test_languages_of_unseen_documents(spark):
    got = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.filter("held_out").join(truth, "doc_id")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()


def test_languages_of_odd_documents(odd_documents):
    rows = language_id.identify_languages(odd_documents, F.lit(True), keep=("kept_text",)).collect()
    assert len(rows) == 9 and all((r.lang_pred == "und") == (r.doc_id in (0, 1, 2)) and 0 <= r.score <= 1 for r in rows)
    rows = language_id.identify_languages(odd_documents, F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def odd_texts():
    """Texts of no, one, two and more bytes of many kinds."""
    texts = ["", "a", "ab", "é", "z" * 5, "hello qz", "other kv", "xyz abc", "中文", " ", "\n\t", "😀", "de la", "x" * 3000]
    return [t.encode() for t in texts + [t for _, t in random_texts(12, 186, ["ab", "c", "é", "ñ,", "the"], 5)]]


def test_a_text_has_the_same_features_alone_and_in_company():
    texts = odd_texts()
    for count in (language_id.features, quality.shares):
        alone = np.vstack([count([t]) for t in texts])
        assert (alone == count(texts)).all() and (alone[::-1] == count(texts[::-1])).all()
        assert (alone == np.vstack([count(texts[a : a + 7]) for a in range(0, len(texts), 7)])).all()


def test_grams_equal_brute_force():
    for text, got in zip(odd_texts(), gram_counts(odd_texts(), (1, 2, 3), 1 << 12)[2], strict=True):
        padded = b"\n\n\n" + text
        assert sorted(Counter(padded[k : k + 3] for k in range(len(padded) - 2)).values()) == sorted(got[got > 0]) or len(text) > 1000


def test_decoding_equals_the_sum_of_losses():
    draw = np.random.default_rng(3)
    code = language_id.codewords(9)
    margins = draw.normal(size=(40, code.shape[1])) * 3
    loss = np.log1p(np.exp(-margins[:, None, :] * code[None])).sum(axis=2)
    best, share = language_id.decode(language_id.Coder(list("abcdefghi"), code, None, None), margins)
    assert (best == loss.argmin(axis=1)).all() and np.allclose(share, 1 / np.exp(loss.min(axis=1, keepdims=True) - loss).sum(axis=1))


def test_every_language_is_learned_and_repeated_rows_are_bounded(make, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 60)
    rows = [(i, f"word{i % 30:02d} text number {i}", f"l{i % 30:02d}") for i in range(600)] + [(7, "the same row", "l07")] * 400
    table = make(rows, "doc_id long, text string, lang string")
    coder = language_id.learn_languages(table, F.lit(True))
    assert coder.languages == [f"l{i:02d}" for i in range(30)]
    empty = table.limit(0)
    assert language_id.identify_languages(empty, F.lit(True)).count() == 0


def test_quality_where_one_document_fills_a_third(make, monkeypatch):
    monkeypatch.setattr(quality, "PER_LABEL", 20)
    rows = [(i, "good fine text" if i % 2 else "bad poor junk") for i in range(200)] + [(1, f"good other {i}") for i in range(300)]
    docs = make(rows, "doc_id long, text string")
    labels = make([(i, i % 2) for i in range(200)] + [(3, 1)] * 150, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, label, weight: seen.append(len(x)) or real(x, label, weight))
    got = quality.score_quality(docs, labels, F.lit(True))
    assert got.count() == 500 and seen[0] < 200
    assert quality.score_quality(docs.limit(0), labels, F.lit(True)).count() == 0


real = quality.fit


def test_repeats_decided_on_whole_ids(make):
    """Ids that floating point can't tell apart, beside a row without one."""
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(2**60 + 1, text), (2**60, text), (None, text), (2**60 + 2, "other words")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(make(rows, "doc_id long, text string")).collect()}
    assert got == {2**60: 0, 2**60 + 1: 20, None: 0, 2**60 + 2: 0}


def test_codewords_are_apart():
    for n in (2, 4, 6, 40):
        code = language_id.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= max(1, 0.25 * code.shape[1])


def test_quality_of_unseen_documents(spark):
    folder = "/root/testdata/sf0.1"
    held = QUERIES["op6_quality_classifier"](spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    assert held.filter("predicted = quality").count() >= 0.97 * held.count()


def test_quality_of_odd_documents(odd_documents, make):
    labels = make([(3, 1), (4, 0), (4, 7), (77, 1), (None, 1), (5, None)], "doc_id long, quality int")
    rows = quality.score_quality(odd_documents, labels, F.lit(True), keep=("kept_text",)).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score_quality(odd_documents, labels.limit(0), F.lit(True)).collect()} == {0.5}


PAGE = """<html><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav>
<div id="content"><p>First &amp; long paragraph of the text, with commas, and so on, and on.<p>Second <b>bold</b>one is here,
with<br>more text<script>if (a < b) { "</p>" }</script></div><div class="comments"><p>I disagree, and I say so at length, at great length.</p></div>
<div class="cookie-notice"><p>We use cookies, as everybody does, and this is a long notice.</p></div><footer>Imprint</footer></body>"""


def test_main_text():
    assert main_text(PAGE) == "First & long paragraph of the text, with commas, and so on, and on. Second boldone is here, with more text"
    assert main_text(None) == main_text("") == main_text("<nav>menu</nav>") == ""
    assert main_text("<article><h1>T</h1><p>Ti.</p></article><div class=ad>An advert, longer than all of the article, much longer.</div>") == "T Ti."
    assert main_text("<p>cut <b>off<br") == "cut off"
    assert main_text("<div>" * 20_000 + "deep") == "deep"


ARTICLE = "<p>" + "A sentence of the article, long enough, with commas and more words. " * 3 + "</p>"


@pytest.mark.parametrize(
    "around",
    [
        '<div id="page" class="nav-open"><article>{}</article></div>',
        '<div class="page-wrapper cookie-accepted"><div class="content">{}</div></div>',
        '<div class="layout two-column sidebar-left"><div>{}</div><nav>menu</nav></div>',
        '<form id="aspnetForm"><div><div>{}</div></div></form>',
        '<article class="post comment-open">{}</article>',
        '<div class="nav-open"><div class="cookie-accepted"><section>{}</section></div><div class="comments"><p>I say so, too, at length.</p></div></div>',
    ],
)
def test_names_of_wrappers_do_not_hide_the_article(around):
    whole = "<body><header>Site</header>" + around.format(ARTICLE * 2) + "<footer>Imprint</footer></body>"
    assert main_text(whole) == " ".join(re.sub("<.*?>", " ", ARTICLE * 2).split())


def test_names_count_where_something_is_left():
    notice = f'<div class="cookie-notice">{ARTICLE}</div>'
    assert main_text(f"<body><article><p>Short.</p></article>{notice}</body>") == "Short."
    assert main_text(f'<body><div class="text">{ARTICLE}</div><div class="sidebar">{ARTICLE * 9}</div></body>') == main_text(ARTICLE)
    assert main_text(f'<body><div class="comments"><div>{ARTICLE * 3}</div></div></body>') == ""


@pytest.mark.parametrize("n", [1, 5_000])
def test_main_text_after_long_attributes(n):
    inner = "<p>" + "x" * n + "</p>"
    text = "The article has a paragraph with enough words, and a comma."
    page = "<article>{}<p>" + text + "</p></article>"
    assert main_text(page.format(f'<div class="ad" data-x="{inner}">Advert</div>')) == text
    assert main_text(page.format(f"<div data-x='{inner}' class=ad>Advert</div>")) == text
    assert main_text(page.format("<div " + "a='<' " * n + "class=ad>Advert</div>")) == text
    assert main_text(page.format("<script>if (i<n) x = 1 // don't" + " " * n + "</script>") + "<!-- isn't -->") == text


def test_main_text_of_unclosed_quotes_takes_linear_time():
    for piece in ("<a \"", "<a '\"' \"'\"", "<a \"<b\" ", "<script x='", "</script x=\"<"):
        began = time.process_time()
        main_text(piece * 50_000)
        assert time.process_time() - began < 20


def test_odd_pages(make):
    rows = [(1, None, "a"), (1, None, "a"), (None, "", None), (2, "no markup", "b"), (3, "<p>" + "long text, " * 50_000, "c")]
    table = make(rows, "page_id long, html string, _html string")
    got = extract_main_text(table, keep=("page_id", "_html"))
    assert got.columns == ["page_id", "_html", "text", "n_chars"]
    found = Counter((r.page_id, r.text[:9], r.n_chars) for r in got.collect())
    assert found == Counter({(1, "", 0): 2, (None, "", 0): 1, (2, "no markup", 9): 1, (3, "long text", 549_999): 1})
    assert extract_main_text(table.limit(0), keep=("page_id",)).count() == 0


def test_pages(spark):
    rows = QUERIES["op3_html_extraction"](spark, FOLDER).collect()
    assert len(rows) == 50 and all(r.n_chars == len(r.text) for r in rows) and sum(r.n_chars > 0 for r in rows) >= 45


def test_recall_of_nearest_neighbours(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    got = defaultdict(list)
    for r in QUERIES["op1_nearest_neighbours"](spark, folder).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(far[ids == m[1]][0] == m[2] for m in mine)
        hits += len({m[1] for m in mine} & set(ids[np.lexsort((ids, far))[:10]]))
    assert hits >= 0.9 * 10 * len(got) and len(got) == (ids % 100 == 0).sum()


def test_shares_of_leaves_change_nothing(make, monkeypatch):
    draw = np.random.default_rng(11)
    table = make([(i, draw.normal(size=4).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, neighbours.nearest_neighbours(table, F.col("vec_id") % 4 == 0).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "PART", 5)
    assert sorted(map(tuple, neighbours.nearest_neighbours(table, F.col("vec_id") % 4 == 0).collect())) == whole


def test_neighbours_of_odd_vectors(make):
    rows = [(i, [1.0, 0.0]) for i in range(0, 40)] + [(40, [0.0, 1.0]), (41, None), (42, [0.0, 0.0]), (43, [float("nan"), 1.0])]
    rows += [(44, [float("inf"), 1.0]), (45, [None, 1.0]), (46, [1.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0])]
    table = make([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = neighbours.nearest_neighbours(table, F.col("vec_id").isin(0, 5, 40, 42, 46))
    by = defaultdict(list)
    for r in got.collect():
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert {q: [v for _, v, _ in sorted(g)] for q, g in by.items()} == {0: [*range(1, 11)], 5: [0, 1, 2, 3, 4, 6, 7, 8, 9, 10], 40: [*range(10)]}
    assert sorted(by[40])[0][2] == math.sqrt(2)
    assert neighbours.nearest_neighbours(table.limit(0), F.lit(True)).count() == 0


def test_chunks_follow_the_bytes(odd_documents):
    assert chunks.chunk_count(odd_documents, "text") == 16
