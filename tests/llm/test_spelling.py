"""Spelling variants against brute force, and the automata against plain sets."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from barlake.llm import spelling

from .test_odd_rows import SHAPE, frame


def one_error(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows, shortest=7, slip=31):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                out[run] += 1
    return {w: n for w, n in out.items() if n > 1}


def truth(vocab, ratio=10):
    form, near = {}, {}
    for w, n in vocab.items():
        near[w] = [x for x in vocab if one_error(w, x)]
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= ratio * n else None
    out = {}
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), vocab[form[w]] if form[w] else None)
    return out


def got(df):
    rows = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@given(st.lists(st.text("abÀé\U00010000", max_size=6), min_size=1, max_size=30), st.text("abÀé", min_size=2, max_size=6))
def test_automaton_numbers_and_finds_words(words, asked):
    words = sorted(set(words))
    automaton = spelling.Automaton(words)
    for held in (0, 1, len(asked) // 2, len(asked)):
        found = {words[k] for k in automaton.near(asked, held)}
        assert found == {w for w in words if w[:held] == asked[:held] and one_error(w[held:], asked[held:])}


def test_automaton_is_minimal():
    plain = spelling.Automaton(sorted(f"{a}{b}ending" for a in "abc" for b in "xyz"))
    assert len(plain.steps) == 9  # nine words, but one state for each letter that is left to read


def test_variants_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD", 40)  # many ranges
    rng, vocab = random.Random(5), Counter()
    for _ in range(60):
        word = "".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 12)))
        vocab[word] += rng.choice([2, 30, 400, 5000])
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(word) + 1)
            other = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abé") + word[k:], word[:k] + rng.choice("cdÿ") + word[k + 1 :]])
            vocab[other] += rng.choice([1, 3, 40])
    for depth in range(9):  # a chain of forms
        vocab["z" * (8 + depth)] += 10**depth
    vocab["hotprefix"] = 7
    vocab |= {f"hot{a}{b}{c}x": 5 for a in "abcd" for b in "efgh" for c in "ijkl"}
    vocab = dict(vocab)
    assert got(spelling.variants(spark.createDataFrame(list(vocab.items()), "word string, n long"))) == truth(vocab)


def test_words_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 50)
    monkeypatch.setattr(spelling, "GATHERED", 5)
    rng = random.Random(6)
    pool = ["".join(rng.choice("abcÉß×÷ÿ") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    texts = [(k, " ".join(rng.choice(pool).upper() if rng.random() < 0.2 else rng.choice(pool) for _ in range(rng.randint(0, 60)))) for k in range(40)]
    texts += [(1, "same words again, twice over"), (1, "same words again, twice over"), (None, "nameless nameless Nameless"), (50, None), (51, ""), (52, "1234567 中文" * 5), (53, "x" * 5000 + " " + "x" * 5000), (54, "x" * 4999 + "y")]
    docs = spark.createDataFrame(texts, SHAPE).selectExpr("*", "'clash' as word", "1 as n", "0 as shard", "'' as form").repartition(3)
    vocab = counted(texts)
    assert {r.word: r.n for r in spelling.count_words(docs).collect()} == vocab and "x" * 4999 + "y" not in vocab
    assert got(spelling.variants(spelling.count_words(docs))) == truth(vocab)
    assert {r.word: r.n for r in spelling.count_words(docs, slip=0).collect()} == counted(texts, slip=0)


def test_empty_and_no_neighbours(spark):
    assert got(spelling.variants(spelling.count_words(frame(spark, {})))) == {}
    assert got(spelling.variants(spark.createDataFrame([("alonealone", 3)], "word string, n long"))) == {"alonealone": (None, "alonealone", 3, 0, None)}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), ratio=1)
