import random

import numpy as np
import pytest

from millrace.operators import spectra

LENGTHS = [1, 2, 3, 5, 12, 16, 31, 64, 90, 100, 121]


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    own = {k: [rng.gauss(0, 1) + (k % 3) for _ in range(n)] for k, n in enumerate(LENGTHS)}
    own[90] = [2.5] * 40
    rows = [(k, i, v) for k, values in own.items() for i, v in enumerate(values)]
    rng.shuffle(rows)
    return own, spark.createDataFrame(rows, "key int, t int, v double")


def test_magnitudes(series):
    own, df = series
    for inverse in (False, True):
        found = {(r["key"], r["k"]): r["magnitude"] for r in spectra.magnitudes(df, "key", "t", "v", inverse).collect()}
        wanted = {(k, i): m for k, v in own.items() for i, m in enumerate(np.abs(np.fft.fft(v) if inverse else np.fft.rfft(v)))}
        assert found.keys() == wanted.keys()
        assert all(found[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)


def test_transform_has_phases(series):
    own, df = series
    found = {(r["key"], r["k"]): complex(r["re"], r["im"]) for r in spectra.transform(df, "key", "t", "v").collect()}
    assert all(abs(found[k, i] - z) < 1e-9 for k, v in own.items() for i, z in enumerate(np.fft.fft(v)))


@pytest.mark.parametrize(("width", "cut"), [(32, 4), (15, 3), (8, 1)])
def test_low_share(series, width, cut):
    own, df = series
    found = {(r["key"], r["window"]): r["ratio"] for r in spectra.low_share(df, "key", "t", "v", width, cut).collect()}
    wanted = {}
    for k, v in own.items():
        for w, s in enumerate(range(0, max(0, len(v) - width) + 1, width // 2)):
            power = np.abs(np.fft.rfft(v[s : s + width])) ** 2
            high = power[cut:].sum()
            wanted[k, w] = power[:cut].sum() / high if high > 1e-12 * power.sum() else 0.0
    assert found.keys() == wanted.keys()
    assert all(found[k] == pytest.approx(wanted[k], rel=1e-6) for k in wanted)


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "key int, t int, v double")
    assert spectra.magnitudes(none, "key", "t", "v").count() == 0 and spectra.low_share(none, "key", "t", "v", 8, 2).count() == 0
    odd = spark.createDataFrame([(None, 0, 1.0), (None, 1, None), (None, 2, 1.0)], "key int, t int, v double")
    assert sorted(r["magnitude"] for r in spectra.magnitudes(odd, "key", "t", "v").collect()) == pytest.approx(sorted(np.abs(np.fft.rfft([1, 0, 1]))))
