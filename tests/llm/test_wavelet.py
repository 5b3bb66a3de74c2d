"""The wavelet matrix against plain lists."""
import numpy as np
import pytest

from dealflow.llm.wavelet import BLOCK, CHUNK, WaveletMatrix


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK, 5000])
@pytest.mark.parametrize("bits", [1, 2, 5, 17])
def test_against_lists(n, bits):
    rng = np.random.default_rng(n + bits)
    values = (rng.integers(0, 1 << bits, n) * (rng.random(n) < 0.7)).astype(np.uint32)
    w = WaveletMatrix.build(values, bits)
    assert (w.values() == values).all() and w.n == n
    at = np.arange(n)
    assert (w.access(at) == values).all()
    for v in {0, 1, (1 << bits) - 1, *values[:3].tolist()}:
        where = np.flatnonzero(values == v)
        before = np.concatenate([[0], np.cumsum(values == v)])
        assert (w.rank(v, np.arange(n + 1)) == before).all()
        assert (w.select(v, np.arange(len(where))) == where).all()
    assert (w.rank(1 << bits, np.arange(n + 1)) == 0).all()


def test_select_in_pieces_and_constant_planes():
    for values in (np.zeros(3 * CHUNK, np.uint16), np.full(3 * CHUNK, 3, np.uint16)):
        w = WaveletMatrix.build(values, 2)
        assert (w.select(int(values[0]), np.arange(len(values))) == np.arange(len(values))).all()
        assert w.zeros == [len(values) * (not values[0])] * 2
