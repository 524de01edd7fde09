"""The parts that learn toxicity against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tallywright.llm import toxic_segments as toxic


@pytest.mark.parametrize("seed", range(5))
def test_rate_solves_its_equation(seed):
    r = random.Random(seed)
    texts = [[r.choice([-0.5, -0.5, -0.75, -1.0, 0.25, 3.5]) - 0.5 for _ in range(r.randrange(1, 300))] for _ in range(20)]
    rate = toxic.growth_rate([toxic.spectrum(t) for t in texts])
    scores = np.array([s for t in texts for s in t])
    assert rate > 0 and abs(np.exp(rate * scores).mean() - 1) < 1e-9


def test_rates_beyond_any_grid():
    # One token in 10^9 gains a 128th of a nat: lambda is 128 * log(10^9 or so).
    rate = toxic.growth_rate([{1: 1, -128: 10**9}])
    assert rate == pytest.approx(128 * math.log(10**9 + 1), rel=1e-6)
    assert toxic.growth_rate([{-64: 5}]) == 1.0 and toxic.growth_rate([]) == 1.0
    assert toxic.growth_rate([{64: 5, -64: 5}]) == toxic.LEAST_RATE


def test_log_odds_are_those_of_two_multinomials():
    counts = {"abcd*": (30, 400), "efgh*": (5, 900), "ijkl*": (0, 700)}
    t, c = 1_000, 99_000
    scores = toxic.log_odds([(u, *n) for u, n in counts.items()], t, c)
    share, size = (t + 1) / (t + c + 2), 5_000
    for unit, (a, b) in counts.items():
        in_toxic = (a + toxic.PRIOR * share) / (t + size * toxic.PRIOR * share)
        in_clean = (b + toxic.PRIOR * (1 - share)) / (c + size * toxic.PRIOR * (1 - share))
        assert scores[unit] == pytest.approx(math.log(in_toxic / in_clean), abs=2e-3)


def test_a_word_is_pulled_towards_its_stem():
    scores = toxic.log_odds([("vile*", 400, 10), ("vilely", 1, 1), ("tree", 1, 1)], 1_000, 99_000)
    assert scores["vilely"] > scores["tree"] > 0


def test_tokens_are_counted_by_the_cut_of_scoring(spark):
    r = random.Random(3)
    words = ["été", "straße", "日本", "ab_c", "don't", "x", "İstanbul", "nächste"]
    texts = [" ".join(r.choices(words, k=r.randrange(0, 40))) for _ in range(60)]
    labels = [int(i % 3 == 0) for i in range(60)]
    rows = spark.createDataFrame([*zip(labels, texts, strict=True), (1, ""), (0, None)], "toxic int, text string").repartition(4)
    found, t, c = toxic.count_units(rows, least_docs=1, least_far=0.0)
    brute = [Counter(w for label, text in zip(labels, texts, strict=True) if label == k for w in toxic._tokens(text)) for k in (1, 0)]
    assert (t, c) == tuple(sum(b.values()) for b in brute)
    assert {u: n for u, *n in found if u[-1] != "*"} == {w: [b[w] for b in brute] for w in brute[0] | brute[1]}
    stems = [Counter(), Counter()]
    for k, b in enumerate(brute):
        for w, n in b.items():
            stems[k][toxic.stem(w)] += n
    assert {u: n for u, *n in found if u[-1] == "*"} == {u: [s[u] for s in stems] for u in stems[0] | stems[1]}
    assert toxic.count_units(rows.limit(0)) == ([], 0, 0)
