"""The best rows of each query, against all scores."""

import numpy as np
import pytest

from fathom.operators import neighbours


@pytest.mark.parametrize("most", [16, 4096])
@pytest.mark.parametrize("some", [False, True])
def test_best_of_all_scores(most, some):
    r = np.random.default_rng(7)
    v = neighbours.unit(r.integers(-2, 3, size=(400, 4)).astype(float))  # many ties, some zero vectors
    ids, q = np.arange(0, 400, 8), v[::8]
    which = np.arange(0, len(ids), 3) if some else None
    best = neighbours.Best(ids, 5)
    for a in range(0, 400, 90):
        best.add(which, np.arange(a, min(400, a + 90)), q, v[a : a + 90], most)
    want = []
    for k in range(len(ids)) if which is None else which:
        rows = sorted((-round(float(s), 9), x) for x, s in enumerate(v @ q[k]) if x != ids[k])[:5]
        want += [(int(ids[k]), x) for _, x in rows]
    got = best.rows()
    assert sorted(zip(got["id"].to_pylist(), got["other"].to_pylist(), strict=True)) == sorted(want)


def test_merges_are_few(monkeypatch):
    """Rows wait: held rows are not sorted again for each slice of rows."""
    merged = []
    monkeypatch.setattr(neighbours.Best, "merge", lambda self, own=neighbours.Best.merge: (merged.append(self.many), own(self))[1])
    v = neighbours.unit(np.random.default_rng(1).normal(size=(3000, 8)))
    best = neighbours.Best(np.arange(500), 5)
    best.add(None, np.arange(3000), v[:500], v, most=5000)  # 300 slices
    best.rows()
    assert len(merged) < 40
