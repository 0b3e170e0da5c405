"""Pairs across components, against plain loops."""

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import jaccard


def table(r, groups, components):
    """Rows of random groups: near sketches, so that many pairs pass."""
    rows = []
    for low in range(groups):
        for _ in range(int(r.integers(1, 40))):
            s = np.zeros(8, dtype=np.uint64)
            s[int(r.integers(8))] = r.integers(1, 4)
            rows.append((low, int(r.integers(1 << 40)), int(r.integers(components)), int(r.integers(12, 20)), s))
    return rows


def plain(rows):
    out = set()
    for low, a, x, n, s in rows:
        for other, b, y, m, t in rows:
            if low == other and a < b and x != y and 4 * min(n, m) >= 3 * max(n, m) and 7 * sum(int(v).bit_count() for v in s ^ t) <= n + m:
                out.add((a, b))
    return out


@pytest.mark.parametrize("g, size, at_once", [(1, 1000, 200_000), (1, 7, 5), (3, 11, 1), (4, 1000, 50)])
def test_all_pairs_of_other_components(monkeypatch, g, size, at_once):
    monkeypatch.setattr(jaccard, "AT_ONCE", at_once)
    rows = table(np.random.default_rng(g), 9, 4)
    dealt = []
    for low, cls, component, n, s in rows:
        cell = cls % g
        dealt += [(low, min(cell, o), max(cell, o), component, cls, cell, n, s.view(np.int64).tolist()) for o in range(g)]
    dealt.sort(key=lambda x: x[:5])
    names = ["low", "p", "q", "component", "cls", "cell", "n", "s"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*dealt, strict=True), kinds, strict=True)], names)
    batches = [batch.slice(at, size) for at in range(0, batch.num_rows, size)]
    found = [(a, b) for out in jaccard._crossed(iter([batch.slice(0, 0), *batches]), False) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]
    assert len(found) == len(set(found))
    assert set(found) == plain(rows)
    likeliest = [(x, y) for out in jaccard._crossed(iter(batches), True) for x, y in zip(out["x"].to_pylist(), out["y"].to_pylist(), strict=True)]
    of = {cls: component for _, cls, component, _, _ in rows}
    assert len(likeliest) == len(set(likeliest))
    assert set(likeliest) == {tuple(sorted((of[a], of[b]))) for a, b in plain(rows)}


def test_no_rows():
    assert list(jaccard._crossed(iter([]), False)) == []
