"""Numeric kernels on numpy arrays; no Spark here."""

from __future__ import annotations

import math

import numpy as np

Array = np.ndarray


def window(kind: str, n: int) -> Array:
    """Symmetric window; unknown kinds count as hann."""
    if kind == "rect" or n < 2:
        return np.ones(n)
    a, b = (0.54, 0.46) if kind == "hamming" else (0.5, 0.5)
    return a - b * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def pow2(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(n, 1))))


def half_spectrum(x: Array, kind: str = "rect", size: int | None = None) -> Array:
    """Bins 0 .. N/2 - 1 of the windowed, zero-padded signal (last axis)."""
    n = x.shape[-1]
    size = size or pow2(n)
    return np.fft.rfft(x * window(kind, n), size, axis=-1)[..., : size // 2]


def biquad(kind: str, rate: float, cutoff: float, q: float) -> tuple[Array, Array]:
    """RBJ cookbook coefficients (b, a) with a[0] = 1; unknown kinds count as lowpass."""
    w = 2 * math.pi * cutoff / rate
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    b = {"highpass": [(1 + c) / 2, -(1 + c), (1 + c) / 2], "bandpass": [alpha, 0.0, -alpha], "notch": [1.0, -2 * c, 1.0]}.get(kind, [(1 - c) / 2, 1 - c, (1 - c) / 2])
    a0 = 1 + alpha
    return np.array(b) / a0, np.array([1.0, -2 * c / a0, (1 - alpha) / a0])


def sections(kind: str, rate: float, cutoff: float, q: float, order: int) -> list[tuple[Array, Array]]:
    """One biquad, or for lowpass and highpass a Butterworth cascade of an even order from 2 to 8."""
    order = min(8, max(2, order + order % 2))
    if kind not in ("lowpass", "highpass") or order == 2:
        return [biquad(kind, rate, cutoff, q)]
    return [biquad(kind, rate, cutoff, 1 / (2 * math.sin((2 * k + 1) * math.pi / (2 * order)))) for k in range(order // 2)]


def affine_scan(matrix: Array, inputs: Array, state: Array | None = None, block: int = 256) -> Array:
    """States of s' = A s + u_i after each input: blocks run side by side, then their starts are chained."""
    n, k = inputs.shape
    state = np.zeros(k) if state is None else state
    if not n:
        return np.zeros((0, k))
    m = -(-n // block)
    u = np.zeros((m * block, k))
    u[:n] = inputs
    u = u.reshape(m, block, k)
    local, s = np.empty((m, block, k)), np.zeros((m, k))
    for t in range(block):
        s = s @ matrix.T + u[:, t]
        local[:, t] = s
    powers = np.empty((block, k, k))
    p = np.eye(k)
    for t in range(block):
        p = matrix @ p
        powers[t] = p
    starts = np.empty((m, k))
    at = state
    for j in range(m):
        starts[j] = at
        at = powers[-1] @ at + local[j, -1]
    return (local + np.einsum("tij,mj->mti", powers, starts)).reshape(-1, k)[:n]


def cusum(x: Array, threshold: float = 5.0, drift: float = 0.5, baseline: int | None = None) -> Array:
    """Two-sided sums of standardised deviations; each hit starts a new baseline, which isn't watched."""
    size = max(8, baseline if baseline is not None else min(50, len(x) // 4))
    found: list[int] = []
    origin = 0
    while True:
        base = x[origin : origin + size]
        z = (x[origin + size :] - base.mean()) / math.sqrt(max(base.var(ddof=1) if len(base) > 1 else 0.0, 1e-12))
        # a sum that is reset at zero is the path less its running extreme
        up, down = np.cumsum(z - drift), np.cumsum(z + drift)
        high = up - np.minimum(np.minimum.accumulate(up), 0) if len(z) else z
        low = down - np.maximum(np.maximum.accumulate(down), 0) if len(z) else z
        hits = np.flatnonzero((high > threshold) | (low < -threshold))
        if not len(hits):
            return np.array(found, np.int64)
        origin = origin + size + int(hits[0])
        found.append(origin)


def savgol_weights(size: int, degree: int, derivative: int = 0) -> Array:
    half = size // 2
    basis = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    return np.linalg.pinv(basis)[derivative] * math.factorial(derivative)


def lti_steps(a: Array, b: Array, h: float) -> tuple[Array, Array]:
    """One classical Runge-Kutta step with held input, as x' = phi x + gamma u."""
    i, ha = np.eye(len(a)), h * a
    phi = i + ha + ha @ ha / 2 + ha @ ha @ ha / 6 + ha @ ha @ ha @ ha / 24
    return phi, h * (i + ha / 2 + ha @ ha / 6 + ha @ ha @ ha / 24) @ b


def companion(num: list[float], den: list[float]) -> tuple[Array, Array, Array, float]:
    """Controllable form (A, B, C, D) of num(s) / den(s), highest power first."""
    den_, n = np.array(den, float), len(den) - 1
    num_ = np.concatenate([np.zeros(len(den) - len(num)), num]) / den_[0]
    den_ = den_ / den_[0]
    a, b = np.zeros((n, n)), np.zeros(n)
    if n:
        a[:-1, 1:] = np.eye(n - 1)
        a[-1] = -den_[:0:-1]
        b[-1] = 1
    return a, b, (num_[1:] - num_[0] * den_[1:])[::-1], float(num_[0])
