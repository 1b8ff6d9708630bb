"""Spectra. One long series is many tasks: segments by chunk, whole transforms by columns and rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import INDEX, SeriesKey
from . import chunkwise as C
from . import kernels as K
from .base import number, one_series, Params, rate_of, Result
from .timeseries import _line, _pair


def fft(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    rows, c, _ = _line(df, key, params)
    rate, kind = rate_of(params, "fft"), params.get("window", "hann")

    frame = _transform(rows, key, rate, kind, 2, "fft")
    parts = list(key.partition_by)
    top = F.struct("magnitude", -F.col(INDEX))
    s = frame.groupBy(*parts).agg(F.coalesce(F.max_by("frequency", F.when(F.col(INDEX) > 0, top)), F.lit(0.0)).alias("dominantFrequency"), F.max("n").alias("sampleCount"), F.max("m").alias("fftSize"))
    s = s.withColumn("resolution", F.lit(rate) / F.col("fftSize"))
    frame = frame.drop("m")
    return Result(scalars=s, series={"frequencies": (frame, "frequency"), "magnitudes": (frame, "magnitude"), "phases": (frame, "phase")}, plain={"column": c})


def _least(n: Column, least: int, what: str) -> Column:
    """``n``, or an error where a series is too short."""
    return F.when(n >= least, n).otherwise(F.raise_error(F.lit(f"{what} needs {least} values")).cast("bigint"))


def _counted(rows: DataFrame, key: SeriesKey, least: int, what: str) -> DataFrame:
    parts = list(key.partition_by)
    n = rows.groupBy(*parts).agg(_least(F.count(F.lit(1)), least, what).alias("_n"))
    full = rows.join(n, parts) if parts else rows.crossJoin(F.broadcast(n))  # one row
    return full.where("_n is not null")


def _transform(rows: DataFrame, key: SeriesKey, rate: float, kind: str, least: int, what: str) -> DataFrame:
    """(parts, idx, frequency, magnitude, phase, n, m) of the windowed series' bins below half the transform's size."""
    parts = list(key.partition_by)
    full = _counted(rows, key, least, what)
    a, b = {"hamming": (0.54, 0.46), "rect": (1.0, 0.0)}.get(kind, (0.5, 0.5))
    w = F.lit(a) - F.lit(b) * F.cos(2 * np.pi * F.col(INDEX) / (F.col("_n") - 1))
    got = C.spectrum(full.select(*parts, INDEX, (F.col("x") * w).alias("x")), key)
    # the window's mean in closed form: its cosines sum to 1 over the whole series
    gain = F.lit(a) - F.lit(b) * F.when(F.col("n") > 2, 1 / F.col("n")).otherwise(1.0)
    scale = F.when(F.col(INDEX) == 0, 1.0).otherwise(2.0) / (F.col("n") * gain)
    return got.select(*parts, INDEX, (F.col(INDEX) * rate / F.col("m")).alias("frequency"), (F.hypot("re", "im") * scale).alias("magnitude"), F.atan2("im", "re").alias("phase"), "n", "m")


def _plan(params: Params) -> tuple[int, int, str]:
    size = K.pow2(int(params.get("segmentLength", 256)))
    overlap = min(0.9, max(0.0, number(params, "overlap", 0.5)))
    return size, max(1, math.floor(size * (1 - overlap) + 0.5)), params.get("window", "hann")


def _by_bin(names: list[str], sums: list[np.ndarray], n: int) -> pd.DataFrame:
    return pd.DataFrame({"bin": np.arange(len(sums[0]), dtype=np.int64), **dict(zip(names, sums)), "segments": n})


def _psd_frame(rows: DataFrame, key: SeriesKey, rate: float, size: int, hop: int, kind: str) -> DataFrame:
    w = K.window(kind, size)
    scale = np.where(np.arange(size // 2) == 0, 1.0, 2.0) / (rate * (w * w).sum())
    run = lambda numbers, x: _by_bin(["p"], [(np.abs(K.half_spectrum(x, kind)) ** 2).sum(0) * scale], len(numbers))
    each = C.segments(rows, key, ["x"], size, hop, "bin long, p double, segments long", run)
    out = each.groupBy(*key.partition_by, "bin").agg(F.sum("p").alias("p"), F.sum("segments").alias("segments")).where("segments > 0")
    return out.select(*key.partition_by, F.col("bin").alias(INDEX), (F.col("bin") * (rate / size)).alias("frequency"), (F.col("p") / F.col("segments")).alias("psd"), "segments")


def psd_welch(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Mean of one-sided segment densities, no detrending; ``bands``: power within [low, high)."""
    rows, c, _ = _line(df, key, params)
    rate = rate_of(params, "psd_welch")
    size, hop, kind = _plan(params)
    frame = _psd_frame(rows, key, rate, size, hop, kind)
    parts = list(key.partition_by)
    bands = [F.sum(F.when((F.col("frequency") >= float(b["low"])) & (F.col("frequency") < float(b["high"])), F.col("psd") * (rate / size)).otherwise(0.0)).alias(b.get("name", f"{b['low']}-{b['high']}")) for b in params.get("bands") or []]
    s = frame.groupBy(*parts).agg(F.max("segments").alias("segments"), *bands).withColumn("resolution", F.lit(rate / size))
    names = [b.get("name", f"{b['low']}-{b['high']}") for b in params.get("bands") or []]
    s = s.withColumn("bandPowers", F.struct(*names)) if names else s
    return Result(scalars=s, series={"frequencies": (frame, "frequency"), "psd": (frame, "psd")}, plain={"column": c} if names else {"column": c, "bandPowers": {}})


def spectrogram(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """(segment, time, frequency, magnitude); a segment's time is its middle."""
    rows, c, _ = _line(df, key, params)
    rate = rate_of(params, "spectrogram")
    size, hop, kind = _plan(params)
    gain = K.window(kind, size).mean()
    scale = np.where(np.arange(size // 2) == 0, 1.0, 2.0) / (size * gain)

    def run(numbers, x):
        return pd.DataFrame({"segment": np.repeat(numbers, size // 2), "bin": np.tile(np.arange(size // 2), len(numbers)), "magnitude": (np.abs(K.half_spectrum(x, kind)) * scale).ravel()})

    each = C.segments(rows, key, ["x"], size, hop, "segment long, bin long, magnitude double", run)
    frame = each.select(*key.partition_by, "segment", F.col("bin").alias(INDEX), ((F.col("segment") * hop + size / 2) / rate).alias("time"), (F.col("bin") * (rate / size)).alias("frequency"), "magnitude")
    return Result(scalars=frame.groupBy(*key.partition_by).agg(F.countDistinct("segment").alias("segmentCount")), series={"magnitudes": (frame, "magnitude"), "times": (frame, "time"), "frequencies": (frame, "frequency")}, plain={"column": c})


def cross_psd(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Coherence, |H1| and phase over segments."""
    rows, _, _ = _pair(df, key, params, "cross_psd")
    rate = rate_of(params, "cross_psd")
    size, hop, kind = _plan(params)

    def run(numbers, a, b):
        x, y = K.half_spectrum(a, kind), K.half_spectrum(b, kind)
        cross = (np.conj(x) * y).sum(0)
        return _by_bin(["aa", "bb", "re", "im"], [(np.abs(x) ** 2).sum(0), (np.abs(y) ** 2).sum(0), cross.real, cross.imag], len(numbers))

    parts = list(key.partition_by)
    each = C.segments(rows, key, ["a", "b"], size, hop, "bin long, aa double, bb double, re double, im double, segments long", run)
    s = each.groupBy(*parts, "bin").agg(*(F.sum(c).alias(c) for c in ("aa", "bb", "re", "im", "segments"))).where("segments > 0")
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    frame = s.select(
        *parts, F.col("bin").alias(INDEX), (F.col("bin") * (rate / size)).alias("frequency"), F.when((F.col("aa") > 0) & (F.col("bb") > 0), power / (F.col("aa") * F.col("bb"))).otherwise(0.0).alias("coherence"),
        F.when(F.col("aa") > 0, F.sqrt(power) / F.col("aa")).otherwise(0.0).alias("frfMagnitude"), F.atan2("im", "re").alias("frfPhase"), "segments",
    )
    best = frame.groupBy(*parts).agg(F.max_by("frequency", F.when(F.col(INDEX) > 0, F.struct("coherence", -F.col(INDEX)))).alias("peakCoherentFrequency"), F.max("segments").alias("segments"))
    return Result(scalars=best, series={k: (frame, c) for k, c in (("frequencies", "frequency"), ("coherence", "coherence"), ("frfMagnitude", "frfMagnitude"), ("frfPhase", "frfPhase"))})


def cepstrum(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Transform of the log magnitudes; the peak is the highest from the fourth place on."""
    rows, c, _ = _line(df, key, params)
    rate, parts = rate_of(params, "cepstrum"), list(key.partition_by)
    got = C.spectrum(_counted(rows, key, 8, "cepstrum").select(*parts, INDEX, "x"), key, half=False)
    logs = got.select(*parts, INDEX, F.log(F.greatest(F.hypot("re", "im"), F.lit(1e-300))).alias("x"))
    frame = C.spectrum(logs, key).select(*parts, INDEX, (F.col(INDEX) / rate).alias("quefrency"), (F.col("re") / F.col("m")).alias("value"))
    best = frame.groupBy(*parts).agg(F.coalesce(F.max_by("quefrency", F.when(F.col(INDEX) >= 4, F.struct("value", -F.col(INDEX)))), F.lit(0.0)).alias("peakQuefrency"))
    return Result(scalars=best, series={"cepstrum": (frame, "value"), "quefrencies": (frame, "quefrency")}, plain={"column": c})


def harmonics(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """(order, frequency, amplitude, phase) of the strongest bin within one of each multiple below half the rate."""
    rows, c, _ = _line(df, key, params)
    rate, f0, count = rate_of(params, "harmonics"), number(params, "fundamental"), max(1, int(params.get("harmonicCount", 10)))
    parts = list(key.partition_by)
    bins = _transform(rows, key, rate, "rect", 16, "harmonics")
    top = F.max_by("frequency", F.when(F.col(INDEX) > 0, F.struct("magnitude", -F.col(INDEX))))
    one = bins.groupBy(*parts).agg((F.lit(f0) if f0 is not None else top).alias("fundamental"), F.max("m").alias("m"))
    orders = one.withColumn("order", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(count).cast("long")))).where(F.col("order") * F.col("fundamental") < rate / 2)
    near = F.floor(F.col("order") * F.col("fundamental") * F.col("m") / rate + 0.5)
    # equal magnitudes: the nearest bin, then the lower one
    tries = orders.withColumn("t", F.explode(F.array(*(F.struct(F.lit(rank).alias("rank"), (near + d).alias("bin")) for rank, d in ((0, 0), (1, -1), (2, 1))))))
    tries = tries.where((F.col("t.rank") == 0) | ((F.col("t.bin") > 0) & (F.col("t.bin") < F.col("m") / 2))).select(*parts, "order", "fundamental", (-F.col("t.rank")).alias("rank"), F.least("t.bin", F.floor(F.col("m") / 2) - 1).alias(INDEX))
    met = tries.join(bins.drop("m", "n"), [*parts, INDEX])
    frame = met.groupBy(*parts, "order", "fundamental").agg(F.max_by(F.struct("frequency", "magnitude", "phase"), F.struct("magnitude", "rank")).alias("b"))
    frame = frame.select(*parts, (F.col("order") - 1).alias(INDEX), "order", "b.frequency", F.col("b.magnitude").alias("amplitude"), "b.phase")
    first, rest = F.max(F.when(F.col("order") == 1, F.col("amplitude"))), F.sum(F.when(F.col("order") > 1, F.col("amplitude") * F.col("amplitude")))
    thd = frame.groupBy(*parts).agg(F.when(first > 0, F.sqrt(F.coalesce(rest, F.lit(0.0))) / first).otherwise(0.0).alias("thd"))
    s = one.drop("m").join(thd, parts, "left") if parts else one.drop("m").crossJoin(F.broadcast(thd))  # one row
    s = s.withColumn("thd", F.coalesce("thd", F.lit(0.0)))
    return Result(scalars=s.withColumn("thdPercent", 100 * F.col("thd")), series={"harmonics": (frame, "amplitude")}, plain={"column": c})


#: Fixed values: (name, low, high) in Hz.
EEG_BANDS = (("delta", 0.5, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0), ("gamma", 30.0, 45.0))


def eeg_band_powers(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    rows, c, _ = _line(df, key, params)
    rate = rate_of(params, "eeg_band_powers")
    size = K.pow2(int(params.get("segmentLength", 256)))
    frame = _psd_frame(rows, key, rate, size, size // 2, "hann")
    parts = list(key.partition_by)
    inside = lambda lo, hi: F.sum(F.when((F.col("frequency") >= lo) & (F.col("frequency") < hi), F.col("psd") * (rate / size)).otherwise(0.0))
    one = frame.groupBy(*parts).agg(*(inside(lo, hi).alias(n) for n, lo, hi in EEG_BANDS))
    total = sum((F.col(n) for n, _, _ in EEG_BANDS), F.lit(0.0))
    bands = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("band"), F.col(n).alias("power")) for i, (n, _, _) in enumerate(EEG_BANDS)))
    long = one.select(*parts, total.alias("totalPower"), F.explode(bands).alias("b")).select(*parts, "b.band", "b.power", "b.i", "totalPower", F.when(F.col("totalPower") > 0, F.col("b.power") / F.col("totalPower")).otherwise(0.0).alias("relative"))
    best = long.groupBy(*parts).agg(F.max_by("band", F.struct("power", -F.col("i"))).alias("dominantBand"), F.max("totalPower").alias("totalPower"))
    return Result(scalars=best, series={"bandPowers": (long.drop("i", "totalPower"), "power"), "relativePowers": (long.drop("i", "totalPower"), "relative")}, plain={"column": c})


def lomb_scargle(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Classic normalised periodogram of uneven samples: sums per frequency, two passes, in chunks of samples.

    A task holds a chunk of samples against all frequencies (a stated number), and its sums are added up.
    """
    one_series(key, "lomb_scargle")
    columns = params.get("columns")
    if not columns or len(columns) != 2:
        raise ValueError("lomb_scargle needs [time, value]")
    rows = df.select(F.col(columns[0]).cast("double").alias("t"), F.col(columns[1]).cast("double").alias("y")).where("t is not null and y is not null")
    n, lo, hi, mean, var = rows.agg(F.count(F.lit(1)), F.min("t"), F.max("t"), F.avg("y"), F.var_samp("y")).first()
    if n < 8 or hi <= lo:
        raise ValueError("lomb_scargle needs 8 samples over some time")
    steps = max(10, int(params.get("frequencySteps", 500)))
    f_min, f_max = number(params, "minFrequency", 1 / (hi - lo)), number(params, "maxFrequency", n / (2 * (hi - lo)))
    freq = f_min + (f_max - f_min) * np.arange(steps) / (steps - 1)

    def sums(fn, names: list[str]) -> DataFrame:
        def run(batches):
            total = np.zeros((len(names), steps))
            for pdf in batches:
                for a in range(0, len(pdf), 2048):
                    part = pdf.iloc[a : a + 2048]
                    total += fn(part["t"].to_numpy(), part["y"].to_numpy() - mean)
            yield pd.DataFrame({"k": np.arange(steps, dtype=np.int64), **dict(zip(names, total))})

        return rows.mapInPandas(run, "k long, " + ", ".join(f"{c} double" for c in names)).groupBy("k").agg(*(F.sum(c).alias(c) for c in names))

    w = 2 * np.pi * freq
    first = sums(lambda t, y: np.stack([np.sin(2 * np.outer(t, w)).sum(0), np.cos(2 * np.outer(t, w)).sum(0)]), ["s2", "c2"]).toPandas().sort_values("k")
    tau = np.arctan2(first["s2"].to_numpy(), first["c2"].to_numpy()) / (2 * w)

    def second(t, y):
        arg = np.outer(t, w) - w * tau
        c, s = np.cos(arg), np.sin(arg)
        return np.stack([y @ c, (c * c).sum(0), y @ s, (s * s).sum(0)])

    got = sums(second, ["yc", "cc", "ys", "ss"])
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) * F.col(a) / F.col(b)).otherwise(0.0)
    power = (part("yc", "cc") + part("ys", "ss")) / (2 * var) if var > 0 else F.lit(0.0)
    frame = got.select(F.col("k").alias(INDEX), (F.lit(float(f_min)) + F.lit(float(f_max - f_min)) * F.col("k") / (steps - 1)).alias("frequency"), power.alias("power"))
    best = frame.agg(F.max_by(F.struct("frequency", "power"), F.struct("power", -F.col(INDEX))).alias("b")).select(F.col("b.frequency").alias("bestFrequency"), (1 / F.col("b.frequency")).alias("bestPeriod"), F.col("b.power").alias("bestPower"))
    return Result(scalars=best, series={"frequencies": (frame, "frequency"), "power": (frame, "power")})


