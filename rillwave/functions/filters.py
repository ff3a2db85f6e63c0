"""Zero-phase IIR filtering in NumPy, vectorised over a batch of equal-length rows.

A zero-phase filter with fixed padding is a linear map of the row, so for the short fixed
windows of the engine it is turned into one dense matrix (cached per worker) and a whole Arrow
batch is filtered with a single matrix product.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def butter_sections(order: int, low: float, high: float, fs: float, stop: bool = False) -> np.ndarray:
    """Butterworth band-pass or band-stop design as second-order sections (b0 b1 b2 1 a1 a2)."""
    k = 2.0 * fs
    w_lo, w_hi = (k * np.tan(np.pi * f / fs) for f in (low, high))
    width, centre = w_hi - w_lo, np.sqrt(w_lo * w_hi)
    angles = np.pi * (2 * np.arange(order) + order + 1) / (2 * order)
    proto = np.exp(1j * angles)                       # left half plane, unit circle
    half = (width / proto if stop else width * proto) / 2.0
    root = np.sqrt(half * half - centre * centre + 0j)
    poles = np.concatenate([half + root, half - root])
    zpoles = (k + poles) / (k - poles)
    upper = zpoles[zpoles.imag > 0]
    upper = upper[np.argsort(np.abs(upper))]
    if stop:
        theta = 2.0 * np.arctan(centre / k)
        nums = [np.array([1.0, -2.0 * np.cos(theta), 1.0])] * order
        at = 1.0 + 0j                                 # unit gain at zero frequency
    else:
        nums = [np.array([1.0, 0.0, -1.0])] * order   # zeros at z = 1 and z = -1
        at = np.exp(2j * np.arctan(centre / k))       # unit gain at the centre
    sections = []
    for num, p in zip(nums, upper):
        den = np.array([1.0, -2.0 * p.real, abs(p) ** 2])
        gain = abs(np.polyval(den, at)) / abs(np.polyval(num, at))
        sections.append(np.concatenate([num * gain, den]))
    sos = np.array(sections)
    total = np.prod([abs(np.polyval(s[:3], at) / np.polyval(s[3:], at)) for s in sos])
    sos[0, :3] /= total
    return sos


def notch_section(f0: float, q: float, fs: float) -> np.ndarray:
    """Second-order notch with -3 dB bandwidth f0 / q."""
    w0 = 2.0 * np.pi * f0 / fs
    gain = 1.0 / (1.0 + np.tan(w0 / q / 2.0))
    return np.array([[gain, -2.0 * gain * np.cos(w0), gain,
                      1.0, -2.0 * gain * np.cos(w0), 2.0 * gain - 1.0]])


def _steady_state(sos: np.ndarray) -> np.ndarray:
    """Per-section delay values of a unit constant input applied forever."""
    scale, out = 1.0, np.zeros((len(sos), 2))
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        dc = (b0 + b1 + b2) / (1.0 + a1 + a2)
        out[i] = scale * np.array([dc - b0, b2 - a2 * dc])
        scale *= dc
    return out


def _run(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter rows of x (batch, time) starting from the steady state of their first sample."""
    y = np.ascontiguousarray(x.T)
    for (b0, b1, b2, _, a1, a2), zi in zip(sos, _steady_state(sos)):
        first = x[:, 0]
        d1, d2 = zi[0] * first, zi[1] * first
        for n in range(len(y)):
            v = y[n]
            w = b0 * v + d1
            d1 = b1 * v - a1 * w + d2
            d2 = b2 * v - a2 * w
            y[n] = w
    return y.T


def _extend(x: np.ndarray, edge: int) -> np.ndarray:
    """Odd reflection about both end samples."""
    if x.shape[1] <= edge:
        raise ValueError("signal too short for zero-phase filtering")
    head = 2.0 * x[:, :1] - x[:, edge:0:-1]
    tail = 2.0 * x[:, -1:] - x[:, -2:-edge - 2:-1]
    return np.concatenate([head, x, tail], axis=1)


def pad_length(sos: np.ndarray) -> int:
    taps = 2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum()))
    return 3 * taps


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward-backward filtering of rows with odd extension."""
    x = np.atleast_2d(np.asarray(x, dtype=float))
    edge = pad_length(sos)
    y = _run(sos, _extend(x, edge))
    y = _run(sos, y[:, ::-1])[:, ::-1]
    return y[:, edge:-edge]


def zero_phase_long(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Same result for one long row, by FFT convolution with the decaying impulse response."""
    sos = np.asarray(sos)
    radius = max(np.abs(np.roots(s[3:])).max() for s in sos)
    taps = min(len(x) + 2 * pad_length(sos), int(np.ceil(np.log(1e-18) / np.log(radius))) + 200)
    impulse = np.zeros((1, taps))
    impulse[0, 0] = 1.0
    zero = sos.copy()
    h = impulse.T.copy()
    for b0, b1, b2, _, a1, a2 in zero:                # impulse response from rest
        d1 = d2 = np.zeros(1)
        for n in range(taps):
            v = h[n].copy()
            w = b0 * v + d1
            d1 = b1 * v - a1 * w + d2
            d2 = b2 * v - a2 * w
            h[n] = w
    h = h[:, 0]
    # constant history before the first sample: x0 * (dc gain - running sum of the response)
    dc = float(np.prod([s[:3].sum() / s[3:].sum() for s in sos]))
    carry = dc - np.cumsum(h)

    def forward(v):
        size = 1 << int(np.ceil(np.log2(len(v) + taps)))
        y = np.fft.irfft(np.fft.rfft(v, size) * np.fft.rfft(h, size), size)[:len(v)]
        m = min(len(v), taps)
        y[:m] += v[0] * carry[:m]
        return y

    edge = pad_length(sos)
    v = _extend(np.asarray(x, dtype=float)[None, :], edge)[0]
    return forward(forward(v)[::-1])[::-1][edge:-edge]


@lru_cache(maxsize=32)
def bandpass_matrix(n: int, fs: float, low: float, high: float) -> np.ndarray:
    return zero_phase(butter_sections(4, low, high, fs), np.eye(n))


@lru_cache(maxsize=32)
def notch_matrix(n: int, fs: float, f0: float) -> np.ndarray:
    return zero_phase(notch_section(f0, 30.0, fs), np.eye(n))


@lru_cache(maxsize=8)
def live_matrix(n: int, fs: float) -> np.ndarray:
    """1-45 Hz band-pass followed by the 50 and 60 Hz band-stops, as one row operator."""
    m = zero_phase(butter_sections(4, 1.0, 45.0, fs), np.eye(n))
    for mains in (50.0, 60.0):
        if mains < fs / 2:
            m = zero_phase(butter_sections(2, mains - 2, mains + 2, fs, stop=True), m)
    return m


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal of each row."""
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1.0
    gain[1:(n + 1) // 2] = 2.0
    if n % 2 == 0:
        gain[n // 2] = 1.0
    return np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1)
