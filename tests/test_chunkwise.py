"""Long series by chunks: the rows of whole-series kernels, whatever the chunk, for one series and for many."""

import math

import numpy as np
import plain_kernels as plain
import pytest

from tidemark import series
from tidemark.functions import chunkwise as C
from tidemark.functions import kernels as K
from tidemark.functions.registry import Registry
from tidemark.series import SeriesKey

REG = Registry()


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(4)
    t = np.arange(700)
    return {"a": np.sin(2 * np.pi * t / 23) + 0.3 * np.cos(2 * np.pi * t / 7) + rng.normal(0, 0.2, 700) + t / 500, "b": np.cumsum(rng.normal(0, 1, 129)), "c": rng.normal(5, 2, 64), "d": np.round(rng.normal(0, 2, 333))}


@pytest.fixture(scope="module", params=["a", None])
def data(request, spark, signals):
    """(frame, key, {series: values}): one series without a key, or four."""
    picked = {request.param: signals[request.param]} if request.param else signals
    rows = [(k, i, float(v)) for k, x in picked.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "s string, i long, v double").repartition(3).cache()
    return df, SeriesKey.of("i", () if request.param else "s"), picked


@pytest.fixture(autouse=True, params=[64])
def chunk(request, monkeypatch):
    monkeypatch.setattr(series, "CHUNK", request.param)


def call(data, function, field=None, **params):
    df, key, picked = data
    got = REG.run(function, df, key, {"column": "v", **params})
    frame = got.scalars if field is None else got.series[field][0]
    rows = frame.collect()
    return {s: sorted((r for r in rows if not key.partition_by or r.s == s), key=lambda r: r.idx if field else 0) for s in picked}


def values(rows, name="value"):
    return np.array([r[name] for r in rows], float)


@pytest.mark.parametrize("kind,order,zero", [("lowpass", 2, False), ("highpass", 6, False), ("lowpass", 8, True), ("notch", 2, True)])
def test_filters(data, kind, order, zero):
    got = call(data, "digital_filter", "values", type=kind, sampleRate=10.0, cutoff=1.5, order=order, zeroPhase=zero)
    for s, x in data[2].items():
        assert np.allclose(values(got[s]), plain.digital_filter(x, kind, 10.0, 1.5, 0.7071, order, zero), atol=1e-9)


def test_cascade_matrix_moves_states_as_the_cascade_does():
    parts = K.sections("highpass", 10.0, 2.0, 0.7, 6)
    state = np.random.default_rng(0).normal(size=6)
    assert np.allclose(C.run_cascade(np.zeros(5), parts, state)[1], np.linalg.matrix_power(C.cascade_matrix(parts), 5) @ state)


@pytest.mark.parametrize("model,q", [("level", 1e-3), ("trend", 1e-3), ("trend", 1e-9)])
def test_kalman(data, model, q):
    one, filtered, ahead = (call(data, "kalman_filter", f, model=model, processNoise=q, horizon=3) for f in (None, "filtered", "forecast"))
    for s, x in data[2].items():
        want = plain.kalman(x, model, q, 1.0, 3)
        assert np.allclose(values(filtered[s]), want["filtered"]) and np.allclose(values(ahead[s]), want["forecast"])
        assert all(math.isclose(one[s][0][k], want[k], rel_tol=1e-8, abs_tol=1e-10) for k in ("level", "trend", "innovationStd"))


@pytest.mark.parametrize("period", [0, 7, 24])
def test_holt_winters(data, period):
    one, ahead = (call(data, "holt_winters", f, period=period, horizon=30) for f in (None, "forecast"))
    for s, x in data[2].items():
        want = plain.holt_winters(x, 30, period)
        assert np.allclose(values(ahead[s]), want["forecast"])
        assert all(math.isclose(one[s][0][k], want[k], rel_tol=1e-8, abs_tol=1e-10) for k in ("fittedLast", "level", "trend"))


def test_lockin(data):
    one, amplitude = (call(data, "lockin", f, sampleRate=23.0, referenceFrequency=1.0) for f in (None, "amplitudeSeries"))
    for s, x in data[2].items():
        want = plain.lockin(x, 23.0, 1.0)
        assert np.allclose(values(amplitude[s]), want["amplitudeSeries"], atol=1e-9)
        assert all(math.isclose(one[s][0][k], want[k], rel_tol=1e-8) for k in ("amplitude", "phase", "i", "q"))


@pytest.mark.parametrize("kind", ["hann", "hamming", "rect"])
def test_fft(data, kind):
    one, bins = (call(data, "fft", f, sampleRate=10.0, window=kind) for f in (None, "magnitudes"))
    for s, x in data[2].items():
        want = plain.fft(x, 10.0, kind)
        assert np.allclose(values(bins[s], "magnitude"), want["magnitudes"]) and np.allclose(values(bins[s], "frequency"), want["frequencies"])
        big = want["magnitudes"] > 1e-9
        turn = np.angle(np.exp(1j * (values(bins[s], "phase") - want["phases"])))[big]
        assert np.allclose(turn, 0, atol=1e-6)
        assert all(math.isclose(one[s][0][k], want[k]) for k in ("dominantFrequency", "resolution", "sampleCount", "fftSize"))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 1000])
def test_spectrum_of_few_lanes(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx long, x double")
    got = sorted(C.spectrum(df, SeriesKey.of("idx"), half=False, lanes=3).collect(), key=lambda r: r.idx)
    assert np.allclose([complex(r.re, r.im) for r in got], np.fft.fft(x, K.pow2(n))) and {(r.n, r.m) for r in got} == {(n, K.pow2(n))}


def test_spectrum_of_a_long_series(spark):
    """2**20 samples in 2**10 columns and rows."""
    n = 1 << 20
    df = spark.range(n).selectExpr("id AS idx", "sin(id * 0.37) + cos(id * id * 1e-6) AS x")
    x = df.orderBy("idx").toPandas()["x"].to_numpy()
    got = C.spectrum(df, SeriesKey.of("idx")).toPandas().sort_values("idx")
    assert np.allclose(got["re"] + 1j * got["im"], np.fft.rfft(x)[: n // 2], atol=1e-6)


def test_cepstrum_and_harmonics(data):
    cep, peak = (call(data, "cepstrum", f, sampleRate=10.0) for f in ("cepstrum", None))
    lines, one = (call(data, "harmonics", f, sampleRate=10.0, harmonicCount=12) for f in ("harmonics", None))
    for s, x in data[2].items():
        want = plain.cepstrum(x, 10.0)
        assert np.allclose(values(cep[s]), want["cepstrum"]) and math.isclose(peak[s][0].peakQuefrency, want["peakQuefrency"])
        want = plain.harmonics(x, 10.0, None, 12)
        assert np.allclose([(r.order, r.frequency, r.amplitude) for r in lines[s]], [h[:3] for h in want["harmonics"]])
        assert math.isclose(one[s][0].thd, want["thd"], rel_tol=1e-9) and math.isclose(one[s][0].fundamental, want["fundamental"])


def test_short_series_are_refused(spark):
    df = spark.createDataFrame([(0, 1.0)], "i long, v double")
    for function in ("fft", "cepstrum", "harmonics"):
        with pytest.raises(Exception, match="needs"):
            REG.run(function, df, SeriesKey.of("i"), {"column": "v", "sampleRate": 1.0}).scalars.collect()


@pytest.mark.parametrize("size,overlap", [(64, 0.5), (32, 0.0), (256, 0.9)])
def test_segments(data, size, overlap):
    hop = max(1, math.floor(size * (1 - overlap) + 0.5))
    psd = call(data, "psd_welch", "psd", sampleRate=10.0, segmentLength=size, overlap=overlap)
    magnitudes = call(data, "spectrogram", "magnitudes", sampleRate=10.0, segmentLength=size, overlap=overlap)
    w = K.window("hann", size)
    double = np.where(np.arange(size // 2) == 0, 1.0, 2.0)
    for s, x in data[2].items():
        starts = range(0, len(x) - size + 1, hop)
        spectra = np.array([K.half_spectrum(x[a : a + size], "hann") for a in starts]).reshape(-1, size // 2)
        assert {r.segments for r in psd[s]} == ({len(spectra)} if len(spectra) else set())
        if len(spectra):
            assert np.allclose(values(psd[s], "psd"), (np.abs(spectra) ** 2).mean(0) * double / (10.0 * (w * w).sum()))
        got = sorted((r.segment, r.idx, r.magnitude) for r in magnitudes[s])
        assert np.allclose([g[2] for g in got], (np.abs(spectra) * double / (size * w.mean())).ravel()) and len(got) == spectra.size


def test_cross_psd(spark, signals):
    a = signals["a"]
    b = np.roll(a, 3) + 0.1 * signals["a"][::-1]
    df = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b))], "i long, a double, b double")
    frame = sorted(REG.run("cross_psd", df, SeriesKey.of("i"), {"columns": ["a", "b"], "sampleRate": 10.0, "segmentLength": 64}).series["coherence"][0].collect(), key=lambda r: r.idx)
    x, y = (np.array([K.half_spectrum(v[k : k + 64], "hann") for k in range(0, 637, 32)]) for v in (a, b))
    cross, pa, pb = (np.conj(x) * y).sum(0), (np.abs(x) ** 2).sum(0), (np.abs(y) ** 2).sum(0)
    assert np.allclose([r.coherence for r in frame], np.abs(cross) ** 2 / (pa * pb)) and np.allclose([r.frfMagnitude for r in frame], np.abs(cross) / pa)
    assert np.allclose([r.frfPhase for r in frame], np.angle(cross)) and {r.segments for r in frame} == {len(x)}


@pytest.mark.parametrize("points", [None, [-5.0, 0.0, 0.25, 62.999, 63.0, 63.5, 64.0, 127.5, 128.0, 200.0, 698.999, 699.0, 1e6]])
@pytest.mark.parametrize("method", ["spline", "linear"])
def test_interpolation(data, points, method):
    got = call(data, "interpolate", "values", method=method, **({"queryPoints": points} if points else {}))
    for s, x in data[2].items():
        at = np.array(points) if points else np.arange(len(x) - 1) + 0.5
        want = plain.natural_spline(np.arange(len(x), dtype=float), x, at) if method == "spline" else np.interp(at, np.arange(len(x)), x)
        assert np.allclose(values(got[s], "query"), at) and np.allclose(values(got[s]), want)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 64, 65, 66])
def test_spline_of_uneven_knots(spark, n):
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.uniform(0.1, 3, n)), rng.normal(size=n)
    at = [*rng.uniform(x[0] - 1, x[-1] + 1, 40), *x]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i long, a double, b double")
    got = REG.run("interpolate", df, SeriesKey.of("i"), {"columns": ["a", "b"], "method": "spline", "queryPoints": [float(p) for p in at]}).series["values"][0].collect()
    assert np.allclose([r.value for r in sorted(got, key=lambda r: r.idx)], plain.natural_spline(x, y, np.array(at)))


def test_tridiagonal():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 50):
        lower, upper = rng.uniform(0, 1, n), rng.uniform(0, 1, n)
        lower[0] = upper[-1] = 0
        diag = 2.5 + lower + upper
        m = np.diag(diag) + np.diag(lower[1:], -1) + np.diag(upper[:-1], 1)
        rhs = rng.normal(size=(n, 2))
        assert np.allclose(C.tridiagonal(lower, diag, upper, rhs), np.linalg.solve(m, rhs))


@pytest.mark.parametrize("gates", [{"minProminence": 0.7}, {"minProminence": 2.0}, {"minDistance": 5}, {"minDistance": 40}, {"minHeight": 0.5, "minProminence": 0.5, "minDistance": 9}])
def test_gated_peaks(data, monkeypatch, gates):
    monkeypatch.setattr(series, "CHUNK", 16)
    got, gaps = (call(data, "peak_detect", f, **gates) for f in ("values", "intervals"))
    for s, x in data[2].items():
        want = plain.peaks(x, gates.get("minHeight"), gates.get("minProminence", 0.0), gates.get("minDistance", 1))
        assert [r.idx for r in got[s]] == want.tolist() and np.allclose(values(got[s]), x[want])
        assert [r.interval for r in gaps[s]] == np.diff(want).tolist()


@pytest.mark.parametrize("shape", ["rising", "falling", "tent", "valley", "flat"])
def test_prominence_of_shapes_that_cross_many_chunks(spark, shape):
    n = 300
    t = np.arange(n)
    trend = {"rising": t, "falling": -t, "tent": -np.abs(t - 150), "valley": np.abs(t - 150), "flat": t * 0}[shape] * 0.5
    x = trend + np.where(t % 3 == 1, 2.0, 0.0) + np.where(t % 50 == 1, 3.0, 0.0)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    for gate in (1.0, 2.5, 10.0):
        got = REG.run("peak_detect", df, SeriesKey.of("i"), {"column": "v", "minProminence": gate}).series["indices"][0].collect()
        assert sorted(r.idx for r in got) == plain.peaks(x, None, gate).tolist()


def test_no_whole_series_in_one_group(spark, signals):
    """The only groups over a whole series hold a row for each chunk."""
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(signals["a"])], "i long, v double")
    got = REG.run("kalman_filter", df, SeriesKey.of("i"), {"column": "v"}).series["filtered"][0]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 2 and plan.count("_one") and "_chunk" in plan
