"""The language set that the search finds against the penalised maximum over all sets."""

from itertools import combinations

import numpy as np

from lawmill.llm.language_mixture import mixture


def value(ll, n, use):
    """Log-likelihood of the best mixture of these languages, by many steps of EM."""
    p = np.exp(ll - ll.max(1, keepdims=True))[:, use]
    share = np.full(len(use), 1 / len(use))
    for _ in range(5000):
        share = share * ((n / (p @ share)) @ p) / n.sum()
    return float(n @ np.log(p @ share)), share


def best_set(ll, n):
    penalty = 0.5 * np.log(n.sum()) + 2.0
    sets = [list(c) for k in range(1, ll.shape[1] + 1) for c in combinations(range(ll.shape[1]), k)]
    return max(value(ll, n, c)[0] - penalty * len(c) for c in sets), penalty


def made(rng, weights, words, twin):
    """Words of languages drawn by weights; language 1 nearly equals language 0 if twin."""
    k = len(weights)
    owner = rng.choice(k, size=words, p=weights)
    ll = rng.normal(-9.0, 1.0, size=(words, k))
    ll[np.arange(words), owner] += 6.0
    if twin:
        ll[:, 1] = ll[:, 0] + rng.normal(0, 1e-4, size=words)
    return ll, np.ones(words)


def test_a_twin_does_not_hide_a_third_language():
    rng = np.random.default_rng(1)
    ll, n = made(rng, [0.9, 0.0, 0.1], 400, True)
    share = mixture(ll, n)
    assert (share > 0).sum() == 2 and abs(share[2] - 0.1) < 0.03 and abs(max(share[0], share[1]) - 0.9) < 0.03


def test_sets_of_four_reach_the_penalised_maximum():
    rng = np.random.default_rng(2)
    for turn in range(12):
        weights = rng.dirichlet([0.5] * 4)
        ll, n = made(rng, weights, 120, turn % 2 == 0)
        share = mixture(ll, n)
        use = np.flatnonzero(share).tolist()
        most, penalty = best_set(ll, n)
        assert value(ll, n, use)[0] - penalty * len(use) >= most - 1e-3
