import numpy as np
import pytest

from rillwave.functions import filters, kernels as K
from rillwave.functions.statespace import averaging, noise_variance
from rillwave.model import GuardError, LiveConfig

FS = 128
T = np.arange(512) / FS


def feats(x, **kw):
    return {k: v[0] for k, v in K.spectral_features(np.atleast_2d(x), FS, **kw).items()}


def test_sine_power_lands_in_its_band():
    f = feats(10 * np.sin(2 * np.pi * 10 * T))
    assert f["alpha_power_uv2"] == pytest.approx(50, abs=1e-8) and f["alpha_relative_power"] == pytest.approx(1, abs=1e-8)
    assert feats(5 * np.sin(2 * np.pi * 35 * T))["gamma_power_uv2"] == pytest.approx(12.5, abs=1e-8)


def test_bands_partition_the_total():
    f = feats(np.random.default_rng(3).normal(size=512))
    assert sum(f[f"{b}_power_uv2"] for b in K.OFFLINE_BANDS) == pytest.approx(f["total_power_uv2"], abs=1e-12)
    assert sum(f[f"{b}_relative_power"] for b in K.OFFLINE_BANDS) == pytest.approx(1, abs=1e-12)


def test_delta_alpha_ratio_and_its_absence():
    assert feats(2 * np.sin(4 * np.pi * T) + 4 * np.sin(20 * np.pi * T))["delta_alpha_ratio"] == pytest.approx(0.25, abs=1e-6)
    silent = feats(np.zeros(512))
    assert np.isnan(silent["delta_alpha_ratio"]) and np.isnan(silent["sef95_hz"]) and silent["spectral_entropy"] == 0


@pytest.mark.parametrize("n, fs, line", [(512, 64, None), (10, 128, None), (512, 128, 64.0)])
def test_spectral_guards(n, fs, line):
    with pytest.raises(GuardError):
        K.spectral_features(np.ones((1, n)), fs, line)


def test_band_outside_range():
    with pytest.raises(GuardError):
        K.band_area(np.arange(4.0), np.ones(4), 0, 4)


def test_band_edges_between_bins_are_interpolated():
    f = np.arange(0, 20, 0.4)
    assert K.band_area(f, (2 * f)[None], 1.0, 7.0)[0] == pytest.approx(48.0)


def test_phase_locking():
    a, b = np.sin(20 * np.pi * T)[None], np.sin(20 * np.pi * T + 0.7)[None]
    assert K.phase_locking(a, b, FS)[0] > 0.995
    with pytest.raises(GuardError):
        K.phase_locking(np.ones((1, 512)), np.ones((1, 510)), FS)


def test_bicoherence_needs_an_ensemble():
    assert np.isnan(K.rolling_bicoherence(np.sin(20 * np.pi * T), FS, [512], 512)[0])
    assert np.isnan(K.rolling_bicoherence(np.zeros(7680), FS, [7680], 7680)[0])
    value = K.rolling_bicoherence(np.random.default_rng(7).normal(size=7680), FS, [7680], 7680)[0]
    assert 0 <= value < 0.2


def test_overlapping_histories_equal_separate_ones():
    x = np.random.default_rng(1).normal(size=7680 + 2048)
    ends = [7680, 7680 + 512, 7680 + 2048, 7680 + 37]
    together = K.rolling_bicoherence(x, FS, ends, 7680)
    alone = [K.rolling_bicoherence(x[e - 7680:e], FS, [7680], 7680)[0] for e in ends]
    np.testing.assert_allclose(together, alone, rtol=1e-10)


def test_filters_meet_their_design():
    for sos, edges, flat in ((filters.butter_sections(4, 8, 13, 128), (8, 13), 10.2),
                             (filters.butter_sections(2, 48, 52, 256, stop=True), (48, 52), 10)):
        fs = 128 if edges[0] == 8 else 256
        gain = lambda f: abs(np.prod([np.polyval(s[:3], z) / np.polyval(s[3:], z) for s in sos for z in [np.exp(2j * np.pi * f / fs)]]))  # noqa: E731,B023
        assert [gain(f) for f in edges] == pytest.approx([0.5 ** 0.5] * 2, abs=1e-9)
        assert gain(flat) == pytest.approx(1, abs=1e-3)


def test_long_filter_equals_short_one():
    x, sos = np.random.default_rng(1).normal(size=3000), filters.butter_sections(4, 14, 28, 256)
    np.testing.assert_allclose(filters.zero_phase_long(sos, x), filters.zero_phase(sos, x)[0], atol=1e-12)


def test_notch_removes_mains():
    x = 10 * np.sin(20 * np.pi * T) + 20 * np.sin(2 * np.pi * 50 * T)
    y = x[None] @ filters.notch_matrix(512, 128.0, 50.0)
    assert np.abs(np.fft.rfft(y[0])[200]) < 0.2 * np.abs(np.fft.rfft(x)[200])
    assert np.abs(np.fft.rfft(y[0])[40]) == pytest.approx(np.abs(np.fft.rfft(x)[40]), rel=0.02)


def test_live_quality_and_alpha_peak():
    cfg = LiveConfig()
    rng = np.random.default_rng(1)
    w = rng.normal(0, 5, (1, 4, 512))
    assert K.live_quality(w, cfg)[0]
    w[:, :, 100:150] += 500
    assert not K.live_quality(w, cfg)[0] and not K.live_quality(np.zeros((1, 4, 512)), cfg)[0]
    x = 20 * np.sin(2 * np.pi * 10 * np.arange(512) / 256) + np.random.default_rng(0).normal(0, 1, (1, 4, 512))
    bp = K.live_band_powers(x, cfg)
    assert (bp["alpha"] > 5 * bp["beta"]).all()


def test_estimation_noise_theory():
    segments, bins = averaging(LiveConfig())
    v = noise_variance(LiveConfig())
    assert segments == 3 and bins["beta"] > bins["alpha"] > 0
    assert v["frontal_asymmetry"] > v["beta_alpha_ratio"] > v["muscle_tension"]


def test_rolling_bicoherence_equals_each_history_alone():
    rng = np.random.default_rng(3)
    fs, n = 128.0, 500                                       # epochs off the segment grid: several phases
    span = round(60 * fs)
    x = rng.normal(0, 20, span + n * 60)
    x[9000:9200] *= 1e4                                      # a burst must not spoil histories after it
    x[30000] = np.nan
    ends = [n * k for k in range(1, len(x) // n + 1)] + [3, len(x) + 5]
    got = K.rolling_bicoherence(x, fs, ends, span)
    seg, hop, i, j = K.bicoherence_plan(fs)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(seg) / seg)
    for e, value in zip(ends, got):
        h = x[max(e - span, 0):e]
        if e < span or e > len(x) or not np.isfinite(h).all():
            assert np.isnan(value)
            continue
        z = [np.fft.rfft((h[a:a + seg] - h[a:a + seg].mean()) * window) for a in range(0, span - seg + 1, hop)]
        num = abs(sum(s[i] * s[j] * np.conj(s[i + j]) for s in z)) ** 2
        den = sum(abs(s[i] * s[j]) ** 2 for s in z) * sum(abs(s[i + j]) ** 2 for s in z)
        assert value == pytest.approx((num / den).mean(), rel=1e-9)
