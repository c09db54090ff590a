"""The block search in single precision against all distances."""

import numpy as np
import pandas as pd

from tabwise.operators.knn import _search_block


def _search(x, k, masked):
    n = len(x)
    fold = np.arange(n) % 3
    q = pd.DataFrame({"key": np.arange(n), "x": list(x), "fold": fold})
    t = pd.DataFrame({"t_key": np.arange(n), "t_x": list(x), "t_fold": fold, "t_label": np.zeros(n)})
    got = _search_block(k, masked)(q, t).sort_values(["q_key", "distance", "t_key"])
    for i in range(n):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        others = np.flatnonzero(fold != fold[i]) if masked else np.arange(n)
        want = others[np.lexsort((others, d[others]))][:k]
        mine = got[got["q_key"] == i]
        assert mine["t_key"].tolist() == want.tolist() and mine["distance"].tolist() == d[want].tolist()


def test_close_far_and_huge_values_are_ranked_exactly():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2600, 4))
    x[:40] = x[0]                         # ties
    x[40:80] = x[40] + rng.normal(size=(40, 4)) * 1e-6  # closer than single precision tells
    _search(x[:300], 5, False)
    _search(x[::2], 7, True)
    _search(x[:200] * 1e25, 5, True)      # squares above single precision
    _search(x[:4], 9, True)
