"""Language mixtures against EM in plain Python over all nested sets."""

import math
import random

import numpy as np
import pytest

from sqltally.llm import langid


def languages(rng, n):
    """Log likelihoods of trigrams, and a writer of words, for languages of own letters."""
    letters = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) for _ in range(n)]
    word = lambda k: "".join(rng.choices(letters[k], k=rng.randint(2, 7)))
    table = np.full((n, langid.BUCKETS), 0.5)
    for k in range(n):
        table[k] += np.bincount(langid.trigrams(" ".join(word(k) for _ in range(3000))), minlength=langid.BUCKETS)
    return np.log(table / table.sum(1, keepdims=True)).astype(np.float32), word


def plain_mixture(text, log):
    grams = langid.trigrams(text).tolist()
    rows = [[float(log[k, g]) for k in range(len(log))] for g in grams]
    top = [max(r) for r in rows]
    like = [[math.exp(x - t) for x in r] for r, t in zip(rows, top)]

    def fit(chosen):
        share = [1 / len(chosen)] * len(chosen)
        for _ in range(langid.ROUNDS):
            new = [0.0] * len(chosen)
            for r in like:
                parts = [s * r[c] for s, c in zip(share, chosen)]
                for i, p in enumerate(parts):
                    new[i] += p / sum(parts) / len(like)
            share = new
        return share, sum(math.log(sum(s * r[c] for s, c in zip(share, chosen))) for r in like)

    every, _ = fit(range(len(log)))
    ranked = sorted(range(len(log)), key=lambda k: -every[k])
    single = [sum(r[k] - t for r, t in zip(rows, top)) for k in range(len(log))]
    lead = max(range(len(log)), key=lambda k: single[k])
    ranked = [lead] + [k for k in ranked if k != lead] if single[ranked[0]] < single[lead] else ranked
    sets = [({ranked[0]}, single[ranked[0]])]
    for size in range(2, len(log) + 1):
        _, score = fit(ranked[:size])
        sets.append((set(ranked[:size]), score - 2 * math.log(len(like) + 1) * (size - 1)))
    return max(sets, key=lambda s: s[1])[0]


@pytest.mark.parametrize("seed", range(6))
def test_chosen_sets_equal_all_sizes(seed):
    rng = random.Random(seed)
    log, word = languages(rng, 6)
    for _ in range(6):
        chosen = rng.sample(range(6), rng.randint(1, 5))
        text = " ".join(word(rng.choice(chosen)) for _ in range(rng.randint(3, 90)))
        assert {k for k, _ in langid.mixture(text, log)} == plain_mixture(text, log)


def test_a_document_of_six_languages_keeps_six():
    rng = random.Random(9)
    log, word = languages(rng, 8)
    found = langid.mixture(" ".join(word(k % 6) for k in range(1800)), log)
    assert {k for k, _ in found} == set(range(6)) and abs(sum(s for _, s in found) - 1) < 1e-9
