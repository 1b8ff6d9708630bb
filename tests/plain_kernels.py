"""Plain versions, over one array at a time, that tests hold the distributed ones against."""

from __future__ import annotations

import math

import numpy as np

from tidemark.functions.kernels import Array, affine_scan, biquad, half_spectrum, pow2, sections, window


def fft(x: Array, rate: float, kind: str = "hann") -> dict:
    n, size = len(x), pow2(len(x))
    s, gain = half_spectrum(x, kind), window(kind, n).mean()
    scale = np.where(np.arange(len(s)) == 0, 1.0, 2.0) / (n * gain)
    mag = np.abs(s) * scale
    freq = np.arange(len(s)) * rate / size
    peak = 1 + int(np.argmax(mag[1:])) if len(mag) > 1 else 0
    return {"frequencies": freq, "magnitudes": mag, "phases": np.angle(s), "dominantFrequency": float(freq[peak]) if len(freq) else 0.0, "resolution": rate / size, "sampleCount": n, "fftSize": size}


def cepstrum(x: Array, rate: float) -> dict:
    n = len(x)
    size = pow2(n)
    log_mag = np.log(np.maximum(np.abs(np.fft.fft(x, size)), 1e-300))
    c = np.fft.fft(log_mag).real[: size // 2] / size
    peak = 4 + int(np.argmax(c[4:])) if len(c) > 4 else 0
    return {"quefrencies": np.arange(len(c)) / rate, "cepstrum": c, "peakQuefrency": peak / rate}


def harmonics(x: Array, rate: float, fundamental: float | None = None, count: int = 10) -> dict:
    """(order, frequency, amplitude, phase) of the strongest bin within one of each multiple, below Nyquist."""
    n, size = len(x), pow2(len(x))
    spectrum = half_spectrum(x, "rect")
    mag = np.abs(spectrum) * np.where(np.arange(size // 2) == 0, 1.0, 2.0) / n
    step = rate / size
    f0 = fundamental if fundamental is not None else (1 + int(np.argmax(mag[1:]))) * step
    rows = []
    for k in range(1, count + 1):
        if k * f0 >= rate / 2:
            break
        near = math.floor(k * f0 / step + 0.5)
        best = max((b for b in (near, near - 1, near + 1) if b == near or 0 < b < size // 2), key=lambda b: mag[min(b, len(mag) - 1)])
        best = min(best, len(mag) - 1)
        rows.append((k, best * step, float(mag[best]), float(np.angle(spectrum[best]))))
    first = rows[0][2] if rows else 0.0
    thd = math.sqrt(sum(r[2] ** 2 for r in rows[1:])) / first if first > 0 else 0.0
    return {"fundamental": f0, "harmonics": rows, "thd": thd, "thdPercent": 100 * thd}


def filtered(x: Array, parts: list[tuple[Array, Array]]) -> Array:
    """Cascade of biquads from rest (transposed direct form as an affine recurrence)."""
    for b, a in parts:
        m = np.array([[-a[1], 1.0], [-a[2], 0.0]])
        u = np.outer(x, [b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
        z = affine_scan(m, u)
        before = np.concatenate([[0.0], z[:-1, 0]]) if len(x) else np.zeros(0)
        x = b[0] * x + before
    return x


def digital_filter(x: Array, kind: str, rate: float, cutoff: float, q: float = 0.7071, order: int = 2, zero_phase: bool = False) -> Array:
    parts = sections(kind, rate, cutoff, q, order)
    y = filtered(x, parts)
    return filtered(y[::-1], parts)[::-1] if zero_phase else y


def ema(x: Array, alpha: float) -> Array:
    if not len(x):
        return x
    rest = affine_scan(np.array([[1 - alpha]]), alpha * x[1:, None], np.array([x[0]]))[:, 0]
    return np.concatenate([[x[0]], rest])


def lockin(x: Array, rate: float, reference: float, cutoff: float | None = None, settle: float = 0.5) -> dict:
    t = np.arange(len(x)) / rate
    cutoff = cutoff or reference / 10
    parts = [biquad("lowpass", rate, cutoff, 0.7071)] * 2
    i, q = (filtered(x * f(2 * np.pi * reference * t), parts) for f in (np.cos, np.sin))
    start = min(len(x) - 1, int(len(x) * settle)) if len(x) else 0
    im, qm = float(i[start:].mean()), float(q[start:].mean())
    return {"amplitude": 2 * math.hypot(im, qm), "phase": math.atan2(im, qm), "i": im, "q": qm, "amplitudeSeries": 2 * np.hypot(i, q)}


def kalman(x: Array, model: str = "trend", q: float = 1e-3, r: float = 1.0, horizon: int = 10) -> dict:
    """Random-walk level, or level and trend; starts from the first sample (and first step) with unit covariance."""
    move = np.array([[1.0]]) if model == "level" else np.array([[1.0, 1.0], [0.0, 1.0]])
    k = len(move)
    state, cov = np.array([x[0], x[1] - x[0] if len(x) > 1 else 0.0])[:k], np.eye(k)
    levels, squares = np.empty(len(x)), 0.0
    for i, v in enumerate(x):
        state, cov = move @ state, move @ cov @ move.T + q * np.eye(k)
        error, gain = v - state[0], cov[:, 0] / (cov[0, 0] + r)
        state, cov = state + gain * error, cov - np.outer(gain, cov[0])
        levels[i] = state[0]
        squares += error * error if i else 0.0
    trend = float(state[1]) if k > 1 else 0.0
    std = math.sqrt(squares / (len(x) - 1)) if len(x) > 1 else 0.0
    return {"filtered": levels, "forecast": state[0] + trend * np.arange(1, horizon + 1), "level": float(state[0]), "trend": trend, "innovationStd": std}


def holt_winters(x: Array, horizon: int = 10, period: int = 0, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1) -> dict:
    level, trend = float(x[0]), float(x[1] - x[0]) if len(x) > 1 else 0.0
    season = list(x[:period] - x[:period].mean()) if period > 0 else [0.0]
    cycle, fitted = max(1, period), level
    for i, v in enumerate(x.tolist()):
        s = season[i % cycle]
        fitted = level + trend + s
        before, level = level, alpha * (v - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        if period > 0:
            season[i % cycle] = gamma * (v - level) + (1 - gamma) * s
    ahead = np.array([level + h * trend + season[(len(x) + h - 1) % cycle] for h in range(1, horizon + 1)])
    return {"forecast": ahead, "fittedLast": fitted, "level": level, "trend": trend}


def peaks(x: Array, min_height: float | None = None, min_prominence: float = 0.0, min_distance: int = 1) -> Array:
    """Strict rise before, no rise after; gates by height, prominence, and greedily by height for distance."""
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1 if len(x) > 2 else np.zeros(0, np.int64)
    if min_height is not None:
        at = at[x[at] >= min_height]
    if min_prominence > 0:
        keep = []
        for p in at.tolist():
            above = np.flatnonzero(x[:p] > x[p])
            left = x[(above[-1] + 1 if len(above) else 0) : p + 1].min()
            above = np.flatnonzero(x[p + 1 :] > x[p])
            right = x[p : (p + 1 + above[0] if len(above) else len(x))].min()
            if x[p] - max(left, right) >= min_prominence:
                keep.append(p)
        at = np.array(keep, np.int64)
    if min_distance > 1 and len(at):
        chosen: list[int] = []
        for p in sorted(at.tolist(), key=lambda i: (-x[i], i)):
            if all(abs(p - c) >= min_distance for c in chosen):
                chosen.append(p)
        at = np.array(sorted(chosen), np.int64)
    return at


def natural_spline(x: Array, y: Array, at: Array) -> Array:
    """Natural cubic through (x, y), flat outside; linear below three points."""
    n = len(x)
    at_in = np.clip(at, x[0], x[-1])
    if n < 3:
        return np.interp(at_in, x, y)
    h = np.diff(x)
    m = np.zeros(n)
    lower, diag, upper = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    rhs = 6 * ((y[2:] - y[1:-1]) / h[1:] - (y[1:-1] - y[:-2]) / h[:-1])
    for i in range(1, n - 2):
        f = lower[i] / diag[i - 1]
        diag[i] -= f * upper[i - 1]
        rhs[i] -= f * rhs[i - 1]
    for i in range(n - 3, -1, -1):
        m[i + 1] = (rhs[i] - (upper[i] * m[i + 2] if i < n - 3 else 0.0)) / diag[i]
    k = np.clip(np.searchsorted(x, at_in, "right") - 1, 0, n - 2)
    a, b = x[k + 1] - at_in, at_in - x[k]
    return (m[k] * a**3 + m[k + 1] * b**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * a + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b
