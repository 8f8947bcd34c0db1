import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import mixing, packing
from lectern.llm.common import merge_labels
from tests.llm.test_copies import rooted


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12))
def test_pfair_meets_every_deadline(parts):
    share = {str(i): n for i, n in enumerate(parts)}
    period, done = sum(parts), dict.fromkeys(share, 0)
    owner = {s: k for k, slots in mixing.pfair(share).items() for s in slots}
    for t in range(period):
        done[owner[t]] += 1
        assert all(abs(done[k] - share[k] * (t + 1) / period) < 1 for k in share)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_windows_never_exceed_capacity(sizes):
    found, ways = packing.windows(sizes, 100)
    assert len(found) == len(sizes) and np.bincount(found, sizes, ways).max() <= 100


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_merged_labels_are_components(n, pairs):
    pairs = [(a % n, b % n) for a, b in pairs]
    left, right = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    labels = np.arange(n)
    half = len(pairs) // 2
    for part in (slice(0, half), slice(half, None)):
        labels = merge_labels(labels, left[part], right[part])
    roots = rooted(n, pairs)
    assert len({(a, b) for a, b in zip(labels.tolist(), roots)}) == len(set(roots)) == len(set(labels.tolist()))
