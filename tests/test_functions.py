import math

import numpy as np
import plain_kernels as plain
import pytest

from tidemark.errors import EngineError
from tidemark.functions import kernels as K
from tidemark.functions.registry import FunctionInfo, Registry
from tidemark.series import SeriesKey

KEY = SeriesKey.of("i")
REG = Registry()


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(i, *(None if columns[c][i] is None else float(columns[c][i]) for c in columns)) for i in range(n)]
    return spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} double" for c in columns))


def run(name, df, field=None, **params):
    r = REG.run(name, df, KEY, params)
    if field is None:
        return r.scalars.first().asDict()
    f, c = r.series[field]
    return [x[0] for x in f.orderBy("idx" if "idx" in f.columns else f.columns[0]).select(c).collect()]


def tone(n=1024, f=125.0, rate=1000.0, a=3.0):
    return a * np.sin(2 * np.pi * f * np.arange(n) / rate)


def test_there_are_36_functions_with_declared_results():
    assert len(REG.by_name) == 36
    assert all(i.results for i in REG.by_name.values() if i.name != "descriptive_stats")
    assert [i.name for i in REG.search("psd")] == ["psd_welch", "cross_psd"]


def test_registry_errors(spark):
    df = frame(spark, v=[1, 2])
    for name, params, code in [("nope", {}, "analysis.unsupported_function"), ("fft", {}, "analysis.parameter_error"), ("fft", {"sampleRate": -1}, "analysis.execution_error"), ("seasonality_analysis", {"period": 1}, "analysis.execution_error")]:
        with pytest.raises(EngineError) as e:
            REG.run(name, df, KEY, params)
        assert e.value.code == code
    with pytest.raises(EngineError):
        REG.register(FunctionInfo("fft", None))


def test_fft_of_a_tone(spark):
    df = frame(spark, v=tone())
    mags = run("fft", df, "magnitudes", sampleRate=1000.0, window="rect")
    assert mags[128] == pytest.approx(3.0, abs=0.05)
    s = run("fft", df, sampleRate=1000.0)
    assert s["dominantFrequency"] == 125.0 and s["fftSize"] == 1024


def test_spectra(spark):
    x = tone(f=62.5) + tone(f=125.0, a=0.3)
    df = frame(spark, v=x, w=2 * x)
    s = run("psd_welch", df, column="v", sampleRate=1000.0, bands=[{"name": "b", "low": 50, "high": 80}])
    assert s["segments"] == 7 and s["b"] == pytest.approx(4.5, rel=0.02)
    assert run("harmonics", df, column="v", sampleRate=1000.0)["thd"] == pytest.approx(0.1, rel=0.01)
    c = run("cross_psd", df, "frfMagnitude", columns=["v", "w"], sampleRate=1000.0)
    assert c[16] == pytest.approx(2.0)
    li = run("lockin", df, column="v", sampleRate=1000.0, referenceFrequency=62.5)
    assert li["amplitude"] == pytest.approx(3.0, rel=0.02) and li["phase"] == pytest.approx(0, abs=0.05)


def test_cepstrum_finds_an_echo(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(1024)
    x[40:] += 0.8 * x[:-40]
    assert run("cepstrum", frame(spark, v=x), column="v", sampleRate=1.0)["peakQuefrency"] == 40


def test_recurrences_equal_plain_loops():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(1000)
    y, e = [], x[0]
    for v in x:
        e = 0.3 * v + 0.7 * e
        y.append(e)
    assert np.allclose(plain.ema(x, 0.3), y)
    b, a = K.biquad("bandpass", 100, 10, 0.7)
    z, x1, x2, y1, y2 = [], 0, 0, 0, 0
    for v in x:
        o = b[0] * v + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
        x2, x1, y2, y1 = x1, v, y1, o
        z.append(o)
    assert np.allclose(plain.filtered(x, [(b, a)]), z)
    size = 50
    hits, origin = [], 0
    m, s = x[:size].mean(), x[:size].std(ddof=1)
    x[400:] += 4
    hi = lo = 0.0
    i = size
    while i < len(x):
        q = (x[i] - m) / s
        hi, lo = max(0.0, hi + q - 0.5), min(0.0, lo + q + 0.5)
        if hi > 5 or lo < -5:
            hits.append(i)
            seg = x[i : i + size]
            m, s, hi, lo = seg.mean(), seg.std(ddof=1), 0.0, 0.0
            i += size
            continue
        i += 1
    del origin
    assert K.cusum(x).tolist() == hits and any(400 <= h < 410 for h in hits)


def test_ema_by_chunks(spark):
    from tidemark.functions.timeseries import ema_frame
    from tidemark.series import with_index

    x = np.random.default_rng(2).standard_normal(300)
    rows = with_index(frame(spark, x=x), KEY)
    got = [r.ema for r in ema_frame(rows, KEY, 0.2, chunk=17).orderBy("idx").collect()]
    assert np.allclose(got, plain.ema(x, 0.2))


def test_smoothing_and_filters(spark):
    x = np.random.default_rng(3).standard_normal(60)
    df = frame(spark, v=x)
    assert np.allclose(run("smoothing", df, "values", method="sma", window=4), [x[max(0, i - 3) : i + 1].mean() for i in range(60)])
    q = np.arange(60.0) ** 2
    assert np.allclose(run("smoothing", frame(spark, v=q), "values", method="savgol", window=7)[3:-3], q[3:-3])
    assert np.allclose(run("digital_filter", df, "values", type="median", taps=5), [np.median(x[max(0, i - 2) : i + 3]) for i in range(60)])
    assert np.allclose(run("differencing", df, "values", order=2, lag=3), [x[i] - 2 * x[i - 3] + x[i - 6] for i in range(6, 60)])


def test_peaks_gates():
    x = np.array([0, 3, 0, 1, 0, 5, 0, 2, 1.5, 4, 0])
    assert plain.peaks(x).tolist() == [1, 3, 5, 7, 9]
    assert plain.peaks(x, min_prominence=2).tolist() == [1, 5, 9]
    assert plain.peaks(x, min_distance=4).tolist() == [1, 5, 9]


def test_interpolation(spark):
    df = frame(spark, x=[0, 1, 3, 4], y=[0, 1, 9, 16])
    assert run("interpolate", df, "values", columns=["x", "y"], queryPoints=[-1, 2, 9]) == [0, 5, 16]
    at = np.linspace(0, 2 * math.pi, 30)
    assert np.allclose(plain.natural_spline(at, np.sin(at), at[:-1] + 0.05), np.sin(at[:-1] + 0.05), atol=2e-3)


def test_statistics(spark):
    df = frame(spark, value=[10, 20, 30, 40, 50, 100])
    s = run("descriptive_stats", df, columns=["value"])
    assert (s["count"], s["min"], s["max"], s["p50"]) == (6, 10, 100, 40)
    r = run("correlation_regression", frame(spark, x=[1, 2, 3, None], y=[2, 4, 6, 1]))
    assert (r["correlation"], r["slope"], r["intercept"]) == pytest.approx((1, 2, 0))
    assert run("correlation_regression", frame(spark, x=[1, 1], y=[2, 3]))["correlation"] == 0
    assert run("anomaly_detect", df, "anomalies", method="iqr") == [100]
    q = run("regression", frame(spark, x=range(9), y=[1 + 2 * i + 3 * i * i for i in range(9)]), columns=["x", "y"], degree=2)
    assert (q["c0"], q["c1"], q["c2"], q["rSquared"]) == pytest.approx((1, 2, 3, 1))


def test_forecasts(spark):
    x = 5 + 0.5 * np.arange(80)
    assert run("holt_winters", frame(spark, v=x), "forecast", horizon=2)[0] == pytest.approx(45, abs=0.1)
    k = run("kalman_filter", frame(spark, v=x))
    assert k["trend"] == pytest.approx(0.5, abs=0.01)


def test_period_found(spark):
    x = np.sin(2 * np.pi * np.arange(240) / 24)
    assert run("acf", frame(spark, v=x), column="v")["detectedPeriod"] == 24
    c = run("cross_correlation", frame(spark, a=x, b=np.roll(x, 3)), columns=["a", "b"], maxLag=10)
    assert c["bestLag"] == 3
    t = np.sort(np.random.default_rng(4).uniform(0, 200, 300))
    ls = run("lomb_scargle", frame(spark, t=t, y=np.sin(2 * np.pi * 0.11 * t)), columns=["t", "y"])
    assert ls["bestFrequency"] == pytest.approx(0.11, abs=0.005)
