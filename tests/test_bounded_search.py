"""Vector search holds a bounded number of products at once."""

import numpy as np

from corpusmill.operators import vectors as V


def test_products_are_made_in_bounded_parts(monkeypatch):
    rng = np.random.default_rng(5)
    q, m = rng.normal(size=(50, 8)), np.round(rng.normal(size=(90, 8)), 1)
    m[60:] = m[:30]  # equal scores
    monkeypatch.setattr(V, "PRODUCTS", 1000)
    sizes, add = [], V.Best.add
    monkeypatch.setattr(V.Best, "add", lambda self, rows, scores, ids: (sizes.append(scores.size), add(self, rows, scores, ids)))
    for ids, whole in ((np.arange(90) * 3, True), (np.array([f"{i:03}" for i in range(90)], object), False)):
        best = V.Best(50, 7, 6, whole)
        for at in (range(0, 45), range(45, 90)):
            best.add_product(np.arange(50), q, m[at], ids[at])
        exact = np.round(q @ m.T, 6)
        want = [sorted(range(90), key=lambda j: (-exact[i, j], j))[:7] for i in range(50)]
        found = {i: [] for i in range(50)}
        for rows, named, _ in best.found():
            for r, n in zip(rows.tolist(), named.tolist()):
                found[r].append(n)
        assert [found[i] for i in range(50)] == [[ids[j] for j in w] for w in want]
    assert max(sizes) <= 1000
