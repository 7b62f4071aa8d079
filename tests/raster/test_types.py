import numpy as np
import pytest

from lumenframe.functions import bluenoise, types


@pytest.mark.parametrize(("a", "b", "want"), [("uint8", "uint8", "uint8"), ("uint8", "uint16", "uint16"), ("half", "uint8", "half"), ("int8", "uint8", "float"), ("float", "double", "double"), ("uint32", "uint16", "uint32"), ("uint16", "int16", "float"), ("", "half", "half")])
def test_merge(a, b, want):
    assert types.merge(a, b) == types.merge(b, a) == want


def test_blue_noise():
    t = bluenoise.tile(16, 1)
    assert sorted((t * 256 - 0.5).round().astype(int).ravel()) == list(range(256))
    low = np.abs(np.fft.fft2(t - t.mean()))[1:3, 1:3].mean()
    white = np.abs(np.fft.fft2(np.random.default_rng(0).permutation(t.ravel()).reshape(16, 16) - t.mean()))[1:3, 1:3].mean()
    assert low < white / 2
