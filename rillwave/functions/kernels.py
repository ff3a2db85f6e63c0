"""Small numeric kernels, each over a batch of rows (batch, samples); NaN means "no value"."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..model import LIVE_FEATURES, OFFLINE_BANDS, OFFLINE_RANGE, GuardError, LiveConfig
from .filters import analytic, bandpass_matrix, live_matrix, notch_matrix


@lru_cache(maxsize=32)
def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)


def welch_psd(x: np.ndarray, fs: float, seg: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density averaged over mean-removed Hann segments."""
    w = hann(seg)
    parts = np.lib.stride_tricks.sliding_window_view(x, seg, axis=1)[:, ::step]
    parts = (parts - parts.mean(axis=2, keepdims=True)) * w
    p = np.abs(np.fft.rfft(parts, axis=2)) ** 2 / (fs * (w * w).sum())
    if seg % 2:
        p[..., 1:] *= 2.0
    else:
        p[..., 1:-1] *= 2.0
    return np.arange(p.shape[2]) * fs / seg, p.mean(axis=1)


def offline_psd(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    seg = round(2 * fs)
    return welch_psd(x, fs, seg, seg - seg // 2)


def band_area(f: np.ndarray, p: np.ndarray, low: float, high: float) -> np.ndarray:
    """Trapezoid area with interpolated end points, so that adjacent bands add up."""
    p = np.atleast_2d(p)
    if low < f[0] or high > f[-1] or high <= low:
        raise GuardError("requested band lies outside the measured frequencies")
    weights = _area_weights(tuple(f), low, high)
    return p @ weights


@lru_cache(maxsize=64)
def _area_weights(f: tuple, low: float, high: float) -> np.ndarray:
    """The area is linear in the density: one weight per bin."""
    f = np.asarray(f)
    inner = np.flatnonzero((f > low) & (f < high))
    grid = np.concatenate([[low], f[inner], [high]])
    half = np.zeros(len(grid))
    gaps = np.diff(grid) / 2.0
    half[:-1] += gaps
    half[1:] += gaps
    out = np.zeros(len(f))
    out[inner] += half[1:-1]
    for edge, w in ((low, half[0]), (high, half[-1])):
        right = min(max(int(np.searchsorted(f, edge, side="right")), 1), len(f) - 1)
        frac = (edge - f[right - 1]) / (f[right] - f[right - 1])
        out[right - 1] += w * (1.0 - frac)
        out[right] += w * frac
    return out


SPECTRAL_COLUMNS = tuple([f"{b}_power_uv2" for b in OFFLINE_BANDS]
                         + [f"{b}_relative_power" for b in OFFLINE_BANDS]
                         + ["total_power_uv2", "delta_alpha_ratio", "sef95_hz", "spectral_entropy"])


def check_spectral_input(n: int, fs: float, line_hz: float | None = None) -> None:
    if n < round(2 * fs):
        raise GuardError("spectra need at least two seconds of signal")
    if fs / 2 <= 40:
        raise GuardError("the 0.5-40 Hz feature set needs a sampling rate above 80 Hz")
    if line_hz is not None and not 0 < line_hz < fs / 2:
        raise GuardError("notch frequency must be positive and below Nyquist")


def spectral_features(x: np.ndarray, fs: float, line_hz: float | None = None) -> dict[str, np.ndarray]:
    """The 14 spectral outputs of each complete row."""
    check_spectral_input(x.shape[1], fs, line_hz)
    if line_hz is not None:
        x = x @ notch_matrix(x.shape[1], fs, line_hz)
    f, p = offline_psd(x, fs)
    total = band_area(f, p, *OFFLINE_RANGE)
    out = {f"{b}_power_uv2": band_area(f, p, lo, hi) for b, (lo, hi) in OFFLINE_BANDS.items()}
    with np.errstate(divide="ignore", invalid="ignore"):
        for b in OFFLINE_BANDS:
            out[f"{b}_relative_power"] = np.where(total > 0, out[f"{b}_power_uv2"] / total, np.nan)
        out["total_power_uv2"] = total
        alpha = out["alpha_power_uv2"]
        out["delta_alpha_ratio"] = np.where(alpha > 1e-12, out["delta_power_uv2"] / alpha, np.nan)
    inside = (f >= OFFLINE_RANGE[0]) & (f <= OFFLINE_RANGE[1])
    ff, pp = f[inside], p[:, inside]
    mass = np.zeros_like(pp)
    np.cumsum((pp[:, 1:] + pp[:, :-1]) / 2.0 * np.diff(ff), axis=1, out=mass[:, 1:])
    out["sef95_hz"] = np.array([np.interp(0.95 * s, m, ff) if s > 0 else np.nan
                                for s, m in zip(total, mass)])
    weight = pp.sum(axis=1, keepdims=True)
    prob = np.divide(pp, weight, out=np.zeros_like(pp), where=weight > 0)
    logs = np.log(prob, out=np.zeros_like(prob), where=prob > 0)
    out["spectral_entropy"] = -(prob * logs).sum(axis=1) / np.log(pp.shape[1]) + 0.0
    return out


def phase_locking(x: np.ndarray, y: np.ndarray, fs: float, band=(8.0, 13.0)) -> np.ndarray:
    """Length of the mean phase-difference vector of each row pair inside the band."""
    if x.shape != y.shape or x.shape[1] < 4 * fs:
        raise GuardError("phase locking needs aligned rows of at least four seconds")
    if not 0 < band[0] < band[1] < fs / 2:
        raise GuardError("phase locking band must lie below Nyquist")
    op = bandpass_matrix(x.shape[1], fs, *band)
    cut = round(fs / 2)
    a, b = (analytic(v @ op)[:, cut:-cut] for v in (x, y))
    cross = a * np.conj(b)
    size = np.abs(cross)
    unit = np.divide(cross, size, out=np.ones_like(cross), where=size > 0)
    return np.abs(unit.mean(axis=1))


def bicoherence_plan(fs: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Segment length, hop and the frequency index pairs of the 5-15 Hz triangle."""
    seg = round(2 * fs)
    hz = np.fft.rfftfreq(seg, 1.0 / fs)
    low = [k for k in range(len(hz)) if 5 <= hz[k] <= 15]
    pairs = np.array([(i, j) for i in low for j in low if i <= j and hz[i] + hz[j] <= 30], dtype=int)
    return seg, seg // 2, pairs[:, 0], pairs[:, 1]


def rolling_bicoherence(x: np.ndarray, fs: float, ends: list[int], span: int,
                        min_segments: int = 20) -> np.ndarray:
    """Mean squared auto-bicoherence of the ``span`` samples before each end position of one signal.

    Segment spectra are shared by all histories on the same grid, and so are their sums: running sums from both ends of
    blocks as long as a history make each history the end of one block plus the beginning of the next. Nothing is
    subtracted, so long signals lose no accuracy.
    """
    out = np.full(len(ends), np.nan)
    seg, hop, i, j = bicoherence_plan(fs)
    count = (span - seg) // hop + 1
    if fs / 2 <= 30 or span < seg or count < min_segments or not len(ends):
        return out
    end = np.asarray(ends)
    begin = end - span
    gaps = np.append(0, np.cumsum(~np.isfinite(x)))
    inside = (begin >= 0) & (end <= len(x))
    inside[inside] = gaps[end[inside]] == gaps[begin[inside]]
    tiny = np.finfo(float).tiny
    for phase in np.unique(begin[inside] % hop):
        mine = np.flatnonzero(inside & (begin % hop == phase))
        first = begin[mine] // hop
        # only segments of whole histories; others may hold gaps
        used = np.unique((first[:, None] + np.arange(count)).ravel())
        grid = np.lib.stride_tricks.sliding_window_view(x[phase:], seg)[::hop][used]
        spec = np.fft.rfft((grid - grid.mean(axis=1, keepdims=True)) * hann(seg), axis=1)
        spec, power = spec[:, :i.max() + j.max() + 1], _squared(spec[:, :i.max() + j.max() + 1])
        at = np.searchsorted(used, first)
        num = _squared(_window_sums(spec[:, i] * spec[:, j] * np.conj(spec[:, i + j]), count, at))
        den = _window_sums(power[:, i] * power[:, j], count, at) * _window_sums(power, count, at)[:, i + j]
        use = den > tiny
        part = np.divide(num, den, out=np.zeros_like(den), where=use).clip(0.0, 1.0).sum(axis=1)
        some = use.any(axis=1)
        out[mine[some]] = part[some] / use[some].sum(axis=1)
    return out


def _squared(z: np.ndarray) -> np.ndarray:
    return z.real * z.real + z.imag * z.imag


def _window_sums(rows: np.ndarray, count: int, at: np.ndarray) -> np.ndarray:
    """Sums of `count` consecutive rows from each position in `at`."""
    blocks = -(-len(rows) // count)
    padded = np.zeros((blocks * count, *rows.shape[1:]), rows.dtype)
    padded[:len(rows)] = rows
    padded = padded.reshape(blocks, count, *rows.shape[1:])
    head = np.cumsum(padded, axis=1).reshape(-1, *rows.shape[1:])
    tail = np.cumsum(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1, *rows.shape[1:])
    whole = at % count == 0
    total = tail[at]
    total[~whole] += head[at[~whole] + count - 1]
    return total


# --- live windows ------------------------------------------------------------------------------

def live_quality(w: np.ndarray, cfg: LiveConfig) -> np.ndarray:
    """Usable flag of windows shaped (batch, channel, sample)."""
    finite = np.isfinite(w).all(axis=(1, 2))
    with np.errstate(invalid="ignore"):
        swing = (w.max(axis=2) - w.min(axis=2) > cfg.max_peak_to_peak_uv).any(axis=1)
        flat = (w.std(axis=2) < cfg.min_std_uv).any(axis=1)
    return finite & ~swing & ~flat


def live_band_powers(w: np.ndarray, cfg: LiveConfig) -> dict[str, np.ndarray]:
    """Rectangle band powers (batch, channel) after band-pass and mains band-stops."""
    b, c, n = w.shape
    x = w.reshape(b * c, n) @ live_matrix(n, cfg.fs)
    seg = int(min(n, cfg.fs))
    f, p = welch_psd(x, cfg.fs, seg, seg - seg // 2)
    df = f[1] - f[0]
    return {name: (p[:, (f >= lo) & (f < hi)].sum(axis=1) * df).reshape(b, c)
            for name, (lo, hi) in cfg.bands.items()}


def live_features(w: np.ndarray, cfg: LiveConfig) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Window features (batch,) and per-channel features (batch, channel) of clean windows."""
    eps = 1e-12
    bp = live_band_powers(w, cfg)
    total = bp["delta"] + bp["theta"] + bp["alpha"] + bp["beta"] + eps
    ln_alpha = np.log(bp["alpha"] + eps)
    per = {"alpha_rel": bp["alpha"] / total,
           "beta_alpha_ratio": np.log(bp["beta"] + eps) - ln_alpha,
           "muscle_tension": np.log(bp["high"] + eps)}
    feats = {"alpha_rel": per["alpha_rel"].mean(axis=1),
             "theta_rel": (bp["theta"] / total).mean(axis=1),
             "beta_alpha_ratio": per["beta_alpha_ratio"].mean(axis=1),
             "muscle_tension": per["muscle_tension"].mean(axis=1),
             "frontal_asymmetry": np.full(len(w), np.nan)}
    names = list(cfg.channels)
    if cfg.frontal_pair and all(s in names for s in cfg.frontal_pair):
        left, right = (names.index(s) for s in cfg.frontal_pair)
        feats["frontal_asymmetry"] = ln_alpha[:, right] - ln_alpha[:, left]
    assert tuple(feats) == LIVE_FEATURES or set(feats) == set(LIVE_FEATURES)
    return feats, per
