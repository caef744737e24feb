import numpy as np
import pytest

from chatloom.llm import kernel, lm


@pytest.mark.parametrize("key", [np.zeros(0, np.uint64), np.array([5], np.int64), np.array([2**64 - 1, 2**64 - 2, 2**64 - 1, 0, 2**64 - 2], np.uint64), np.arange(3000, dtype=np.int64) % 7, np.random.default_rng(2).integers(0, 2**64, 5000, np.uint64) // 3])
def test_ranked_is_unique_with_places(key):
    for got, want in zip(kernel.ranked(key), np.unique(key, return_inverse=True), strict=True):
        assert got.dtype == want.dtype and (got == want).all()


@pytest.mark.parametrize("step", [1, 2**50])
def test_pairs_and_documents(step):
    """Also where a pair and a document don't fit one number."""
    rng = np.random.default_rng(4)
    pair, doc = rng.integers(0, 50, 4000) * step, np.sort(rng.integers(0, 40_000, 4000))
    pairs, place = np.unique(pair, return_inverse=True)
    seen, times = np.unique(place * 40_000 + doc, return_counts=True)
    for got, want in zip(lm._by_pair(pair, doc, 40_000), (pairs, *np.divmod(seen, 40_000), times), strict=True):
        assert (got == want).all()
