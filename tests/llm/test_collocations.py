"""Phrases by fingerprints, against counting the phrases themselves."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallywright.llm import collocations as col

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    pieces = re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII_LOWER))
    return [re.findall("[^\x20\x09]+", p) for p in pieces]


def brute(rows, least, top):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        for piece in words_of(text):
            totals["und" if lang is None else lang] += len(piece)
            for n in range(1, 6):
                counts.update(("und" if lang is None else lang, tuple(piece[i : i + n])) for i in range(len(piece) - n + 1))
    phrases = [(lang, p, a) for (lang, p), a in counts.items() if len(p) > 1 and a >= least]
    inside = lambda short, long: any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))
    rows = []
    for lang, p, a in phrases:
        if any(m == lang and len(q) > len(p) and b >= a and inside(p, q) for m, q, b in phrases):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, out = Counter(), []
    for r in rows:
        ranks[r[0]] += 1
        if ranks[r[0]] <= top:
            out.append((r[0], ranks[r[0]], *r[1:]))
    return out


def made_rows(seed=5, n=60):
    draw = random.Random(seed)
    vocabulary = ["Of", "the", "course", "in", "ÉTÉ", "été", "naïve", "x1", "—", "a-b", "日本", "the"]
    rows = []
    for i in range(n):
        text = "".join(draw.choice(vocabulary) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " "]) for _ in range(draw.randrange(90)))
        rows.append((i, text, draw.choice(["en", "en", "en", "de", None, "und", ""])))
    rows += [(None, "of the course of the course", "en")] * 7 + [(1, None, "en"), (2, "", None), (3, " \t.,", "fr"), (4, "alone", "es")]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        [(i, t, g, "clash", 1) for i, t, g in made_rows()], "doc_id long, text string, lang string, pointer string, n int"
    )


@pytest.mark.parametrize(("least", "top", "bits"), [(4, 1000, 64), (2, 9, 64), (3, 1000, 7), (2, 50, 3)])
def test_phrases_equal_brute_force(frame, least, top, bits):
    """Short fingerprints make phrases collide, which must not change a thing."""
    found = col.collocations(frame, least=least, top=top, bits=bits).collect()
    assert sorted(map(tuple, found)) == sorted(brute(made_rows(), least, top))


def test_frequent_phrases_and_totals(frame):
    found = col.frequent_phrases(frame, 2).collect()
    totals = {r.lang: r.a for r in found if r.n == 0}
    wanted = Counter()
    for _, text, lang in made_rows():
        wanted[lang if lang is not None else "und"] += sum(map(len, words_of(text)))
    assert totals == {k: v for k, v in wanted.items() if v}


def test_scores_past_64_bits(spark):
    parts = spark.createDataFrame([("en", "a", 10**12), ("en", "b", 10**12 + 7), ("en", "a b", 10**12 - 3)], "lang string, phrase string, a long")
    totals = spark.createDataFrame([("en", 9 * 10**12 + 1)], "lang string, n long")
    row = col._cut_scores(parts.filter("phrase = 'a b'"), totals, parts).first()
    assert row.score == 1000 * (10**12 - 3) * (9 * 10**12 + 1) // (10**12 * (10**12 + 7))


def test_long_texts_are_cut_between_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(col, "_SLICE_BYTES", 64)
    texts = ["one two three. " * 40, None, "", "endless" * 40, "b c", "x" * 70 + ".y z"]
    rows, parts = [], []
    for r, p in col._sliced(pa.array(texts)):
        rows += r.tolist()
        parts += p
    for i, text in enumerate(texts):
        assert b"".join(p for r, p in zip(rows, parts, strict=True) if r == i) == (text or "").encode()
    cut = [w for p in parts for w in words_of(p.decode())]
    assert [w for w in cut if w] == [w for t in texts for w in words_of(t) if w]


def test_prefix_polynomials_tell_runs_apart():
    words = col.Words(["to be or not to be. To\tBE or".encode(), b"", "ü be".encode()], col.Powers())
    assert len(words) == 11 and words.run.tolist() == [6, 5, 4, 3, 2, 1, 3, 2, 1, 2, 1]
    assert words.first.tolist() == [0, 9, 9]
    pairs = words.polynomial(np.flatnonzero(words.run >= 2), 2)
    named = [words.phrase(i, 2) for i in np.flatnonzero(words.run >= 2)]
    for i, a in enumerate(named):
        for j, b in enumerate(named):
            assert (pairs[i] == pairs[j]) == (a == b)


def test_nothing_frequent_and_an_empty_table(spark, frame):
    assert col.collocations(frame, least=10**6).collect() == []
    assert col.collocations(frame.filter("false")).collect() == []
