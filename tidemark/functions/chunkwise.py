"""Recurrences, transforms and solves over one long series, by chunks of it.

A series is cut into chunks of ``series.CHUNK`` rows.  What a chunk does to the
state that enters it is found without knowing that state; those maps are chained
along the (short) list of chunks; then each chunk runs with its own start.

* ``scan``: linear recurrences, of which a chunk's map is s -> L s + e.
* ``spectrum``: the Fourier transform in two shuffles (columns, twiddles, rows).
* ``spline``: each chunk's unknowns as functions of the two at its ends, and a
  small system for those.
* ``segments``: overlapping windows of a chunk and of what follows it.
* ``prominence``, ``spaced``: peaks against what lies in other chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import series
from ..series import CHUNK_COL, INDEX, SeriesKey, chunked, materialised
from . import kernels as K

Array = np.ndarray


def _kinds(df: DataFrame, parts: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in parts)


def _with_keys(out: pd.DataFrame, group: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    for i, c in enumerate(keys):
        own = np.empty(len(out), object)
        own[:] = group[c].iloc[0]
        out.insert(i, c, own)
    return out


def _groups(df: DataFrame, keys: list[str]):
    return df.groupBy(*(keys or [F.lit(0).alias("_one")]))


def cut(rows: DataFrame, chunk: int) -> DataFrame:
    return rows.withColumn(CHUNK_COL, F.floor(F.col(INDEX) / chunk))


def with_starts(chunks: DataFrame, starts: DataFrame, keys: list[str], run: Callable[[pd.DataFrame, pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` on each chunk's rows in order and its row of ``starts``."""

    def both(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        out = run(rows.sort_values(INDEX), start.iloc[0] if len(start) else None)
        return _with_keys(out, rows, keys[:-1])

    return chunks.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(both, _kinds(chunks, keys[:-1]) + schema)


def scan(rows: DataFrame, key: SeriesKey, columns: list[str], end: Callable[..., Array], chain: Callable[[list[int], list[Array], list[Array]], list[Array]], run: Callable[..., pd.DataFrame], schema: str, head: int = 0, chunk: int | None = None) -> DataFrame:
    """A recurrence along each series.

    ``end(first index, *arrays)`` is the state a chunk leaves when it starts from zero; ``chain(sizes, ends, heads)`` the
    state that enters each chunk, given the first ``head`` values of the series; ``run(first index, state, *arrays)`` a
    chunk's rows.
    """
    size = max(chunk or series.CHUNK, head, 2)
    parts = list(key.partition_by)
    keys = [*parts, CHUNK_COL]
    work = cut(rows.select(*parts, INDEX, *columns), size)

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(INDEX)
        arrays = [pdf[c].to_numpy(np.float64) for c in columns]
        first = int(pdf[INDEX].iloc[0])
        return _with_keys(pd.DataFrame({"_n": [len(pdf)], "_e": [end(first, *arrays)], "_head": [arrays[0][:head] if first == 0 else np.zeros(0)]}), pdf, keys)

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK_COL)
        states = chain(pdf["_n"].tolist(), [np.asarray(e, float) for e in pdf["_e"]], np.asarray(pdf["_head"].iloc[0], float))
        return _with_keys(pd.DataFrame({CHUNK_COL: pdf[CHUNK_COL].to_numpy(), "_s": [np.asarray(s, float) for s in states]}), pdf, parts)

    kinds = _kinds(work, parts)
    left = work.groupBy(*keys).applyInPandas(ends, f"{kinds}{CHUNK_COL} long, _n long, _e array<double>, _head array<double>")
    starts = _groups(left, parts).applyInPandas(chained, f"{kinds}{CHUNK_COL} long, _s array<double>")
    return with_starts(work, starts, keys, lambda pdf, start: run(int(pdf[INDEX].iloc[0]), np.asarray(start["_s"], float), *(pdf[c].to_numpy(np.float64) for c in columns)), schema)


def chain_linear(matrix: Array, start: Callable[[Array], Array] | None = None) -> Callable:
    """States of s -> L^n s + e, from ``start`` of the series' first values (zero if not given)."""

    def chain(sizes: list[int], ends: list[Array], head: Array) -> list[Array]:
        state = start(head) if start else np.zeros(len(matrix))
        out, powers = [], {}
        for n, e in zip(sizes, ends):
            out.append(state)
            if n not in powers:
                powers[n] = np.linalg.matrix_power(matrix, n)
            state = powers[n] @ state + e
        return out

    return chain


# -- filters --------------------------------------------------------------------------------------------------------------


def cascade_matrix(parts: list[tuple[Array, Array]]) -> Array:
    """How the states of biquads in series move without input."""
    k = 2 * len(parts)
    out = np.zeros((k, k))
    for i, (b, a) in enumerate(parts):
        out[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = [[-a[1], 1.0], [-a[2], 0.0]]
        gain = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
        for j in range(i - 1, -1, -1):  # the first state of section j reaches i through the direct paths between
            out[2 * i : 2 * i + 2, 2 * j] += gain
            gain = gain * parts[j][0][0]
    return out


def run_cascade(x: Array, parts: list[tuple[Array, Array]], state: Array) -> tuple[Array, Array]:
    """(output, states left) of biquads in series that start from ``state``."""
    left = []
    for i, (b, a) in enumerate(parts):
        z0 = state[2 * i : 2 * i + 2]
        z = K.affine_scan(np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.outer(x, [b[1] - a[1] * b[0], b[2] - a[2] * b[0]]), z0)
        left.append(z[-1] if len(x) else z0)
        x = b[0] * x + np.concatenate([[z0[0]], z[:-1, 0]])[: len(x)]
    return x, np.concatenate(left)


def filtered(rows: DataFrame, key: SeriesKey, parts: list[tuple[Array, Array]], columns: list[str], chunk: int | None = None) -> DataFrame:
    """(parts, idx, columns): each column through the cascade, from rest."""
    k = 2 * len(parts)

    def end(first: int, *arrays: Array) -> Array:
        return np.concatenate([run_cascade(x, parts, np.zeros(k))[1] for x in arrays])

    def run(first: int, state: Array, *arrays: Array) -> pd.DataFrame:
        return pd.DataFrame({INDEX: first + np.arange(len(arrays[0])), **{c: run_cascade(x, parts, state[k * i : k * i + k])[0] for i, (c, x) in enumerate(zip(columns, arrays))}})

    matrix = np.kron(np.eye(len(columns)), cascade_matrix(parts))
    return scan(rows, key, columns, end, chain_linear(matrix), run, f"{INDEX} long, " + ", ".join(f"`{c}` double" for c in columns), chunk=chunk)


def turned(rows: DataFrame, key: SeriesKey) -> DataFrame:
    """The series backwards."""
    parts = list(key.partition_by)
    n = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    full = rows.join(n, parts) if parts else rows.crossJoin(F.broadcast(n))  # one row
    return full.withColumn(INDEX, F.col("_n") - 1 - F.col(INDEX)).drop("_n")


# -- state estimates ------------------------------------------------------------------------------------------------------


class Gains:
    """Kalman gains depend on no data: they are iterated until they stand still, which is then all there is to know."""

    def __init__(self, model: str, q: float, r: float):
        self.move = np.array([[1.0]]) if model == "level" else np.array([[1.0, 1.0], [0.0, 1.0]])
        self.k, self.q, self.r = len(self.move), q, r
        self.cov, self.rows, self.settled = np.eye(self.k), [], False

    def upto(self, n: int) -> Array:
        """The gains of the first ``n`` steps, or of fewer, after which they don't change."""
        while len(self.rows) < n and not self.settled:
            ahead = self.move @ self.cov @ self.move.T + self.q * np.eye(self.k)
            gain = ahead[:, 0] / (ahead[0, 0] + self.r)
            after = ahead - np.outer(gain, ahead[0])
            self.settled = bool(len(self.rows) and np.allclose(gain, self.rows[-1], rtol=1e-15, atol=0) and np.allclose(after, self.cov, rtol=1e-14, atol=0))
            self.cov = after
            self.rows.append(gain)
        return np.array(self.rows[:n])

    def step(self, gain: Array) -> Array:
        """The state's matrix for one step: s -> step @ s + gain * v."""
        return self.move - np.outer(gain, self.move[0])

    def states(self, first: int, x: Array, state: Array) -> Array:
        """States after each value of a stretch that begins at ``first``."""
        gains = self.upto(first + len(x))
        moving = min(len(x), max(0, len(gains) - first))
        out = np.empty((len(x), self.k))
        for i in range(moving):
            state = out[i] = self.step(gains[first + i]) @ state + gains[first + i] * x[i]
        if moving < len(x):
            out[moving:] = K.affine_scan(self.step(gains[-1]), np.outer(x[moving:], gains[-1]), state)
        return out

    def matrix(self, first: int, n: int) -> Array:
        gains = self.upto(first + n)
        moving = min(n, max(0, len(gains) - first))
        out = np.eye(self.k)
        for i in range(moving):
            out = self.step(gains[first + i]) @ out
        return np.linalg.matrix_power(self.step(gains[-1]), n - moving) @ out if moving < n else out


def kalman(rows: DataFrame, key: SeriesKey, model: str, q: float, r: float, chunk: int | None = None) -> DataFrame:
    """(parts, idx, value, slope, error): the filtered level, trend, and the innovation at each place."""

    def first_state(head: Array) -> Array:
        return np.array([head[0], head[1] - head[0] if len(head) > 1 else 0.0])[: 1 if model == "level" else 2]

    def end(first: int, x: Array) -> Array:
        g = Gains(model, q, r)
        return g.states(first, x, np.zeros(g.k))[-1]

    def chain(sizes: list[int], ends: list[Array], head: Array) -> list[Array]:
        g, state, first, out = Gains(model, q, r), first_state(head), 0, []
        for n, e in zip(sizes, ends):
            out.append(state)
            state, first = g.matrix(first, n) @ state + e, first + n
        return out

    def run(first: int, state: Array, x: Array) -> pd.DataFrame:
        g = Gains(model, q, r)
        after = g.states(first, x, state)
        before = np.concatenate([state[None], after[:-1]])
        return pd.DataFrame({INDEX: first + np.arange(len(x)), "value": after[:, 0], "slope": after[:, 1] if g.k > 1 else 0.0, "error": x - before @ g.move[0]})

    return scan(rows, key, ["x"], end, chain, run, f"{INDEX} long, value double, slope double, error double", head=2, chunk=chunk)


def smooth_season(x: Array, first: int, state: Array, period: int, alpha: float, beta: float, gamma: float) -> tuple[float, Array]:
    """(the last fitted value, state after): state is level, trend and, from the current place on, the seasonal terms."""
    level, trend = float(state[0]), float(state[1])
    season, cycle, fitted = state[2:].tolist(), max(1, len(state) - 2), float(state[0])
    for i, v in enumerate(x.tolist()):
        s = season[i % cycle]
        fitted = level + trend + s
        before, level = level, alpha * (v - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        if period > 0:
            season[i % cycle] = gamma * (v - level) + (1 - gamma) * s
    turn = len(x) % cycle
    return fitted, np.array([level, trend, *season[turn:], *season[:turn]])


def season_matrix(period: int, alpha: float, beta: float, gamma: float) -> Array:
    """One step of ``smooth_season`` without input."""
    k = 2 + max(1, period)
    out = np.zeros((k, k))
    level = out[0]
    level[0], level[1], level[2] = 1 - alpha, 1 - alpha, -alpha
    out[1] = beta * level
    out[1, 0] -= beta
    out[1, 1] += 1 - beta
    out[np.arange(2, k - 1), np.arange(3, k)] = 1.0  # the terms move up by one place
    last = np.zeros(k)
    last[2] = 1.0
    out[k - 1] = -gamma * level + (1 - gamma) * last if period > 0 else last
    return out


def holt_winters(rows: DataFrame, key: SeriesKey, period: int, alpha: float, beta: float, gamma: float, chunk: int | None = None) -> DataFrame:
    """(parts, idx, state, fitted) after the last place of each chunk."""
    width = 2 + max(1, period)

    def first_state(head: Array) -> Array:
        season = head[:period] - head[:period].mean() if period > 0 else np.zeros(1)
        return np.concatenate([[head[0], head[1] - head[0] if len(head) > 1 else 0.0], season, np.zeros(width - 2 - len(season))])

    def end(first: int, x: Array) -> Array:
        return smooth_season(x, first, np.zeros(width), period, alpha, beta, gamma)[1]

    def run(first: int, state: Array, x: Array) -> pd.DataFrame:
        fitted, after = smooth_season(x, first, state, period, alpha, beta, gamma)
        return pd.DataFrame({INDEX: [first + len(x) - 1], "state": [after], "fitted": [fitted]})

    return scan(rows, key, ["x"], end, chain_linear(season_matrix(period, alpha, beta, gamma), first_state), run, f"{INDEX} long, state array<double>, fitted double", head=max(2, period), chunk=chunk)


# -- spectra --------------------------------------------------------------------------------------------------------------


def spectrum(rows: DataFrame, key: SeriesKey, half: bool = True, lanes: int = 64) -> DataFrame:
    """(parts, idx, re, im, n, m): the transform of ``x``, padded with zeros to m, the next power of two of n.

    With m = a * b, place i = b * i1 + i2 and bin k = k1 + a * k2: columns i2 are transformed over i1, turned by
    exp(-2 pi i k1 i2 / m), dealt by k1, and rows k1 are transformed over i2.  A task holds ``lanes`` columns or rows.
    ``half``: bins below m / 2 only.
    """
    parts = list(key.partition_by)
    n = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
    log = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    n = n.withColumn("_la", F.shiftright(log, 1)).withColumn("_lb", log - F.shiftright(log, 1))
    full = rows.select(*parts, INDEX, "x").join(n, parts) if parts else rows.select(INDEX, "x").crossJoin(F.broadcast(n))  # one row
    b = F.expr("shiftleft(1L, _lb)")
    placed = full.withColumn("_i1", F.floor(F.col(INDEX) / b)).withColumn("_i2", F.col(INDEX) % b).withColumn("_block", F.floor(F.col("_i2") / lanes))
    kinds = _kinds(rows, parts)

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        la, lb, block = int(pdf["_la"].iloc[0]), int(pdf["_lb"].iloc[0]), int(pdf["_block"].iloc[0])
        a, lo, hi = 1 << la, block * lanes, min((block + 1) * lanes, 1 << lb)
        x = np.zeros((a, hi - lo))
        x[pdf["_i1"].to_numpy(), pdf["_i2"].to_numpy() - lo] = pdf["x"].to_numpy(np.float64)
        m = 1 << (la + lb)
        turn = np.outer(np.arange(a), np.arange(lo, hi)) % m
        y = np.fft.fft(x, axis=0) * np.exp(-2j * np.pi / m * turn)
        out = pd.DataFrame({"_group": np.arange(-(-a // lanes)), "_block": block, "n": int(pdf["n"].iloc[0]), "_la": la, "_lb": lb, "_packed": [y[g : g + lanes].astype(np.complex128).tobytes() for g in range(0, a, lanes)]})
        return _with_keys(out, pdf, parts)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        la, lb, group = int(pdf["_la"].iloc[0]), int(pdf["_lb"].iloc[0]), int(pdf["_group"].iloc[0])
        a, b = 1 << la, 1 << lb
        k1 = np.arange(group * lanes, min((group + 1) * lanes, a))
        y = np.zeros((len(k1), b), np.complex128)
        for block, packed in zip(pdf["_block"], pdf["_packed"]):
            lo, hi = block * lanes, min((block + 1) * lanes, b)
            y[:, lo:hi] = np.frombuffer(packed, np.complex128).reshape(len(k1), hi - lo)
        x = np.fft.fft(y, axis=1)
        k = k1[:, None] + a * np.arange(b)[None]
        keep = k < (a * b // 2 if half else a * b)
        got = x[keep]
        return _with_keys(pd.DataFrame({INDEX: k[keep], "re": got.real, "im": got.imag, "n": int(pdf["n"].iloc[0]), "m": a * b}), pdf, parts)

    packed = placed.select(*parts, "_block", "_i1", "_i2", "x", "n", "_la", "_lb").groupBy(*parts, "_block").applyInPandas(columns, f"{kinds}_group long, _block long, n long, _la int, _lb int, _packed binary")
    return packed.groupBy(*parts, "_group").applyInPandas(across, f"{kinds}{INDEX} long, re double, im double, n long, m long")


def segments(rows: DataFrame, key: SeriesKey, columns: list[str], size: int, hop: int, schema: str, run: Callable[..., pd.DataFrame], chunk: int | None = None) -> DataFrame:
    """``run(segment numbers, *(segments x size) views)`` on the whole segments that begin in each chunk, which holds what follows it as far as they reach."""
    parts = list(key.partition_by)
    width = max(1, (chunk or series.CHUNK) // hop) * hop
    width = max(width, -(-size // hop) * hop)
    spread = chunked(rows.select(*parts, INDEX, *columns), 0, size - 1, width)

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(INDEX)
        first = int(pdf[CHUNK_COL].iloc[0]) * width
        have = len(pdf) - size
        starts = np.arange(0, min(width - 1, have) + 1, hop) if have >= 0 else np.zeros(0, np.int64)
        views = [np.lib.stride_tricks.sliding_window_view(pdf[c].to_numpy(np.float64), size)[starts] if len(starts) else np.zeros((0, size)) for c in columns]
        return _with_keys(run((first + starts) // hop, *views), pdf, parts)

    return spread.groupBy(*parts, CHUNK_COL).applyInPandas(apply, _kinds(rows, parts) + schema)


# -- splines --------------------------------------------------------------------------------------------------------------


def tridiagonal(lower: Array, diag: Array, upper: Array, rhs: Array) -> Array:
    """Solutions (n, k) by cyclic reduction; the system is diagonally dominant."""
    n = len(diag)
    if n == 0:
        return rhs
    if n == 1:
        return rhs / diag[:, None]
    # even rows are left out of the next level
    odd = np.arange(1, n, 2)
    before, after = odd - 1, np.minimum(odd + 1, n - 1)
    has = (odd + 1 < n).astype(float)
    f, g = lower[odd] / diag[before], has * upper[odd] / diag[after]
    sub = tridiagonal(-f * lower[before], diag[odd] - f * upper[before] - g * lower[after], -g * upper[after], rhs[odd] - f[:, None] * rhs[before] - g[:, None] * rhs[after])
    out = np.empty_like(rhs)
    out[odd] = sub
    even = np.arange(0, n, 2)
    left = np.where((even > 0)[:, None], out[np.maximum(even - 1, 0)], 0.0)
    right = np.where((even + 1 < n)[:, None], out[np.minimum(even + 1, n - 1)], 0.0)
    out[even] = (rhs[even] - lower[even][:, None] * left - upper[even][:, None] * right) / diag[even][:, None]
    return out


def _inner(x: Array, y: Array) -> tuple[Array, Array]:
    """(widths, curvatures inside) of a stretch of knots: the three columns are for curvature 0 at both ends, 1 at the left, 1 at the right."""
    h = np.diff(x)
    if len(x) < 3:
        return h, np.zeros((0, 3))
    rhs = np.zeros((len(x) - 2, 3))
    rhs[:, 0] = 6 * ((y[2:] - y[1:-1]) / h[1:] - (y[1:-1] - y[:-2]) / h[:-1])
    rhs[0, 1] = -h[0]
    rhs[-1, 2] = -h[-1]
    lower, upper = h[:-1].copy(), h[1:].copy()
    lower[0] = upper[-1] = 0.0
    return h, tridiagonal(lower, 2 * (h[:-1] + h[1:]), upper, rhs)


def spline(rows: DataFrame, key: SeriesKey, points: list[float] | None, linear: bool = False, chunk: int | None = None) -> DataFrame:
    """(parts, idx, query, value): the natural cubic (or broken line) through (px, py) at ``points``, or at all midpoints; flat outside.

    A chunk has the knots from its first to the next chunk's first.  Its curvatures are functions of those at its two
    ends; the ends' equations make a tridiagonal system of one unknown a chunk.
    """
    parts = list(key.partition_by)
    size = max(2, chunk or series.CHUNK)
    keys = [*parts, CHUNK_COL]
    n = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    full = rows.select(*parts, INDEX, "px", "py").join(n, parts) if parts else rows.select(INDEX, "px", "py").crossJoin(F.broadcast(n))  # one row
    work = chunked(full, 0, 1, size).drop("_own")  # a chunk's last knot is the next one's first

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(INDEX)
        x, y = pdf["px"].to_numpy(np.float64), pdf["py"].to_numpy(np.float64)
        if len(x) < 2:  # the last knot alone: it belongs to the chunk before
            return _with_keys(pd.DataFrame({"_e": [np.zeros(0)]}), pdf, keys)
        h, m = _inner(x, y)
        slope = np.diff(y) / h
        near = m[0] if len(m) else np.array([0.0, 0.0, 1.0])
        far = m[-1] if len(m) else np.array([0.0, 1.0, 0.0])
        return _with_keys(pd.DataFrame({"_e": [np.concatenate([[h[0], 6 * slope[0]], near, [h[-1], 6 * slope[-1]], far])]}), pdf, keys)

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK_COL)
        e = [np.asarray(v, float) for v in pdf["_e"]]
        e = np.array([v for v in e if len(v)]).reshape(-1, 10)
        # at the knot between chunks c and c + 1: h m_before + 2 (h + g) m + g m_after = 6 (slope after - slope before)
        a, b = e[:-1], e[1:]
        hl, gl = a[:, 5], b[:, 0]
        diag = 2 * (hl + gl) + hl * a[:, 9] + gl * b[:, 3]
        lower, upper = hl * a[:, 8], gl * b[:, 4]
        rhs = b[:, 1] - a[:, 6] - hl * a[:, 7] - gl * b[:, 2]
        if len(diag):
            lower[0] = upper[-1] = 0.0
        m = np.concatenate([[0.0], tridiagonal(lower, diag, upper, rhs[:, None])[:, 0], [0.0]])
        m = m[: len(e) + 1]  # a lone knot has no chunk with two ends
        own = np.concatenate([np.stack([m[:-1], m[1:]], 1), np.zeros((len(pdf) - len(e), 2))])
        return _with_keys(pd.DataFrame({CHUNK_COL: pdf[CHUNK_COL].to_numpy(), "_s": list(own)}), pdf, parts)

    at = None if points is None else np.array(points, float)

    def run(pdf: pd.DataFrame, start: pd.Series) -> pd.DataFrame:
        i, x, y, last = (pdf[c].to_numpy() for c in (INDEX, "px", "py", "_n"))
        x, y, last = x.astype(float), y.astype(float), int(last[0]) - 1
        if at is None:
            q, place = (x[:-1] + x[1:]) / 2, i[:-1]
        else:
            clipped = np.clip(at, x[0] if i[0] == 0 else -np.inf, x[-1] if i[-1] == last else np.inf)
            inside = (clipped >= x[0]) & ((clipped < x[-1]) | ((i[-1] == last) & (clipped == x[-1]) & ((len(x) > 1) | (last == 0))))
            place, q = np.flatnonzero(inside), at[inside]
        c = np.clip(q, x[0], x[-1])
        if linear or last < 2:
            value = np.interp(c, x, y)
        else:
            h, inner = _inner(x, y)
            left, right = np.asarray(start["_s"], float)
            m = np.concatenate([[left], inner @ np.array([1.0, left, right]), [right]])[: len(x)]
            k = np.clip(np.searchsorted(x, c, "right") - 1, 0, max(0, len(x) - 2))
            value = np.zeros(0)
            if len(c):
                u, v = x[k + 1] - c, c - x[k]
                value = (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v
        return pd.DataFrame({INDEX: place.astype(np.int64), "query": q, "value": value})

    kinds = _kinds(rows, parts)
    left = work.groupBy(*keys).applyInPandas(ends, f"{kinds}{CHUNK_COL} long, _e array<double>")
    starts = _groups(left, parts).applyInPandas(chained, f"{kinds}{CHUNK_COL} long, _s array<double>")
    return with_starts(work, starts, keys, run, f"{INDEX} long, query double, value double")


# -- peaks ----------------------------------------------------------------------------------------------------------------


def nearest_higher(x: Array, at: Array) -> tuple[Array, Array]:
    """For each place of ``at``, in order: the nearest place before it with a higher value (-1: none), and the least value after that one up to the place."""
    where, least = np.empty(len(at), np.int64), np.empty(len(at))
    stack: list[tuple[float, float, int]] = []  # (value, least value since the one below, place): values fall from bottom to top
    j = 0
    for i, v in enumerate(x.tolist()):
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        if j < len(at) and at[j] == i:
            where[j], least[j] = stack[-1][2] if stack else -1, low
            j += 1
        stack.append((v, low, i))
    return where, least


def prominence(rows: DataFrame, key: SeriesKey, at: DataFrame, chunk: int | None = None) -> DataFrame:
    """``at`` (parts, idx, value: places of ``rows``) with ``prominence``: the height above the higher of the two lowest points on the way to higher ground.

    Most places meet higher ground in their chunk.  The others are the highest so far there; for them the chunks' extremes,
    walked with a stack along the list of chunks, name the chunk where higher ground is, which then answers.
    """
    size = chunk or series.CHUNK
    parts = list(key.partition_by)
    keys = [*parts, CHUNK_COL]
    kinds = _kinds(rows, parts)
    marked = rows.select(*parts, INDEX, "x").join(at.select(*parts, INDEX, F.lit(True).alias("is_peak")), [*parts, INDEX], "left").withColumn("is_peak", F.col("is_peak").isNotNull())
    work = cut(marked, size)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(INDEX)
        x, first = pdf["x"].to_numpy(np.float64), int(pdf[INDEX].iloc[0])
        here = np.flatnonzero(pdf["is_peak"].to_numpy(bool))
        left, low = nearest_higher(x, here)
        right, low_r = nearest_higher(x[::-1], (len(x) - 1 - here)[::-1])
        one = lambda side, open_, least: pd.DataFrame({INDEX: here + first, "value": x[here], "side": side, "open": open_, "least": least})
        ends = pd.DataFrame({INDEX: [first], "value": [x.max()], "side": [-1], "open": [False], "least": [x.min()]})
        out = pd.concat([ends, one(0, left < 0, low), one(1, right[::-1] < 0, low_r[::-1])], ignore_index=True)
        return _with_keys(out, pdf, keys)

    found = materialised(work.groupBy(*keys).applyInPandas(local, f"{kinds}{CHUNK_COL} long, {INDEX} long, value double, side int, open boolean, least double"), "peaks")
    summary = found.where("side = -1").select(*keys, F.col("value").alias("top"), F.col("least").alias("low"))

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per chunk and side: the chunks with ever higher tops on the way, until one tops the chunk itself, with the least value of the chunks passed."""
        pdf = pdf.sort_values(CHUNK_COL)
        number, top, low = pdf[CHUNK_COL].to_numpy(), pdf["top"].to_numpy(), pdf["low"].to_numpy()
        rows_: list[tuple] = []
        for side, order in ((0, range(len(number))), (1, range(len(number) - 1, -1, -1))):
            stack: list[tuple[float, float, int]] = []
            for c in order:
                passed = np.inf
                way = []
                while stack:
                    t, least, b = stack[-1]
                    way.append((int(number[b]), float(t), float(passed)))
                    if t > top[c]:
                        break
                    passed = min(passed, least)
                    stack.pop()
                rows_.append((int(number[c]), side, [w[0] for w in way], [w[1] for w in way], [w[2] for w in way], float(passed)))
                stack.append((float(top[c]), min(float(low[c]), passed), c))
        return _with_keys(pd.DataFrame(rows_, columns=[CHUNK_COL, "side", "to", "tops", "passed", "all_passed"]), pdf, parts)

    ways = _groups(summary, parts).applyInPandas(steps, f"{kinds}{CHUNK_COL} long, side int, to array<long>, tops array<double>, passed array<double>, all_passed double")
    asked = found.where("open").join(ways, [*keys, "side"])
    # the first chunk on the way that has higher ground; none: all that was passed counts
    place = F.array_position(F.transform("tops", lambda t: t > F.col("value")), True).cast("int")
    asked = asked.withColumn("k", place)
    beyond = asked.where("k = 0").select(*parts, INDEX, "value", "side", F.least("least", "all_passed").alias("least"))
    sent = asked.where("k > 0").select(*parts, F.element_at("to", F.col("k")).alias(CHUNK_COL), F.col(INDEX).alias("asker"), "value", "side", F.least("least", F.element_at("passed", F.col("k"))).alias("least"))

    def answer(held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(asks):
            return pd.DataFrame({c: np.empty(0, object) for c in (*parts, INDEX, "value", "side", "least")})
        x = held.sort_values(INDEX)["x"].to_numpy(np.float64)
        side, value, least = asks["side"].to_numpy(), asks["value"].to_numpy(), asks["least"].to_numpy()
        got = np.empty(len(asks))
        for s, y in ((0, x), (1, x[::-1])):  # from the end that faces the asker
            high, low = np.maximum.accumulate(y[::-1]), np.minimum.accumulate(y[::-1])
            mine = side == s
            k = np.searchsorted(high, value[mine], "right")  # places passed before the first higher one
            got[mine] = np.where(k > 0, low[np.maximum(k - 1, 0)], np.inf)
        out = pd.DataFrame({INDEX: asks["asker"].to_numpy(), "value": value, "side": side, "least": np.minimum(least, got)})
        return _with_keys(out, asks, parts)

    answered = work.select(*keys, INDEX, "x").groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(answer, f"{kinds}{INDEX} long, value double, side int, least double")
    sides = found.where("side >= 0 and not open").select(*parts, INDEX, "value", "side", "least").unionByName(beyond).unionByName(answered)
    return sides.groupBy(*parts, INDEX).agg(F.max("value").alias("value"), (F.max("value") - F.max("least")).alias("prominence"))


def spaced(at: DataFrame, key: SeriesKey, distance: int, chunk: int | None = None) -> DataFrame:
    """Of ``at`` (parts, idx, value) those that taking by height (then place) leaves, when each taken one bars all within less than ``distance``.

    A place is taken once all higher ones near it are barred, and barred once one of them is taken.  A round settles, in
    chunks with the places near them, all that does not hang on places further off; the highest open one always does.
    """
    parts = list(key.partition_by)
    keys = [*parts, CHUNK_COL]
    size = max(chunk or series.CHUNK, 4 * distance)
    halo = size // 2

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(INDEX)
        i, v, taken = pdf[INDEX].to_numpy(), pdf["value"].to_numpy(), pdf["taken"].to_numpy().copy()
        lo, hi = int(pdf[CHUNK_COL].iloc[0]) * size - halo, (int(pdf[CHUNK_COL].iloc[0]) + 1) * size + halo
        first, last = np.searchsorted(i, i - distance, "right"), np.searchsorted(i, i + distance, "left")
        for p in np.lexsort((i, -v)).tolist():
            if taken[p] >= 0:
                continue
            near = slice(first[p], last[p])
            higher = (v[near] > v[p]) | ((v[near] == v[p]) & (i[near] < i[p]))
            state = taken[near][higher]
            if (state == 1).any():
                taken[p] = 0
            elif not (state < 0).any() and (lo <= 0 or i[p] - distance >= lo - 1) and i[p] + distance <= hi:
                taken[p] = 1
        own = pdf["_own"].to_numpy(bool)
        return _with_keys(pd.DataFrame({INDEX: i[own], "value": v[own], "taken": taken[own]}), pdf, parts)

    now: Any = materialised(at.select(*parts, INDEX, "value", F.lit(-1).cast("int").alias("taken")), "spaced")
    while now.where("taken < 0").limit(1).count():
        now = materialised(chunked(now, halo, halo, size).groupBy(*keys).applyInPandas(settle, _kinds(at, parts) + f"{INDEX} long, value double, taken int"), "spaced")
    return now.where("taken = 1").select(*parts, INDEX, "value")


def steps_between(at: DataFrame, key: SeriesKey, chunk: int | None = None) -> DataFrame:
    """(parts, idx, interval): the distance of each place from the one before it."""
    parts = list(key.partition_by)
    keys = [*parts, CHUNK_COL]
    work = cut(at.select(*parts, INDEX), chunk or series.CHUNK)
    inside = work.withColumn("_p", F.lag(INDEX, 1).over(W.partitionBy(*keys).orderBy(INDEX)))
    ends = work.groupBy(*keys).agg(F.max(INDEX).alias("_e"))
    ends = ends.withColumn("_e", F.last("_e").over(W.partitionBy(*(parts or [F.lit(0)])).orderBy(CHUNK_COL).rowsBetween(W.unboundedPreceding, -1)))
    return inside.join(ends, keys).select(*parts, INDEX, (F.col(INDEX) - F.coalesce("_p", "_e")).alias("interval")).where("interval is not null")
