"""Series functions: windows per chunk with halo, two-level carries, scans by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..series import CHUNK, INDEX, SeriesKey, over_rows
from . import chunkwise as C
from . import kernels as K
from .base import Params, Result, column_of, number, one_series, per_series, sample


def _line(df: DataFrame, key: SeriesKey, params: Params) -> tuple[DataFrame, str, list[str]]:
    c = column_of(df, params, key)
    parts = list(key.partition_by)
    keep = [k for k in key.order_by if k not in parts]
    rows = sample(df, key, c)
    return rows.select(*parts, *keep, INDEX, F.col(c).alias("x")), c, [*parts, *keep, INDEX]


def _windowed(rows: DataFrame, key: SeriesKey, size: int, value, before: int | None = None, after: int = 0, name: str = "value") -> DataFrame:
    return over_rows(rows, key, size - 1 if before is None else before, after, {name: value})


def time_series_analysis(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """moving_avg: mean of the last windowSize values, null before there are so many. trend: least squares on the index."""
    rows, _, keep = _line(df, key, params)
    parts = list(key.partition_by)
    if params.get("method", "moving_avg") == "trend":
        i = F.col(INDEX).cast("double")
        s = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"), F.avg(i).alias("mi"), F.avg("x").alias("mx"), F.covar_pop(i, F.col("x")).alias("c"), F.var_pop(i).alias("v"))
        slope = F.when((F.col("n") >= 2) & (F.col("v") > 0), F.col("c") / F.col("v")).otherwise(0.0)
        return Result(scalars=s.select(*parts, slope.alias("slope"), F.coalesce(F.col("mx") - slope * F.col("mi"), F.lit(0.0)).alias("intercept")))
    size = max(1, int(params.get("windowSize", 3)))
    out = _windowed(rows, key, size, lambda w: F.when(F.col(INDEX) >= size - 1, F.avg("x").over(w.rowsBetween(-(size - 1), 0))))
    return Result(series={"moving_averages": (out.select(*keep, "value"), "value")})


def ema_frame(rows: DataFrame, key: SeriesKey, alpha: float, chunk: int = CHUNK) -> DataFrame:
    """Adds ``ema`` of ``x``: y0 = x0, y = alpha x + (1 - alpha) y.

    A chunk's end is an affine function of its start: chunks run apart, their starts are chained over the short
    series of chunks, and the start's share fades in closed form.
    """
    parts = list(key.partition_by)
    work = rows.withColumn("_chunk", F.floor(F.col(INDEX) / chunk)).withColumn("_at", F.col(INDEX) % chunk)
    out_schema = T.StructType([*work.schema.fields, T.StructField("_local", T.DoubleType())])

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(INDEX)
        x = pdf["x"].to_numpy(np.float64)
        u = alpha * x[:, None]
        if pdf[INDEX].iloc[0] == 0:
            u[0] = x[0]
        pdf["_local"] = K.affine_scan(np.array([[1 - alpha]]), u)[:, 0]
        return pdf

    done = work.groupBy(*parts, "_chunk").applyInPandas(local, out_schema)
    ends = done.groupBy(*parts, "_chunk").agg(F.max_by("_local", INDEX).alias("_end"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        fade = (1 - alpha) ** chunk
        start, at = [], 0.0
        for e in pdf["_end"]:
            start.append(at)
            at = e + fade * at
        pdf["_start"] = start
        return pdf.drop(columns=["_end"])

    part_kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in parts)
    starts = ends.groupBy(*(parts or [F.lit(0).alias("_one")])).applyInPandas(chain, part_kinds + "_chunk long, _start double")
    joined = done.join(starts, [*parts, "_chunk"])
    y = F.col("_local") + F.when(F.col("_chunk") > 0, F.col("_start") * F.pow(F.lit(1 - alpha), F.col("_at") + 1)).otherwise(0.0)
    return joined.select(*rows.columns, y.alias("ema"))


def smoothing(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """sma (causal, short at the start), ema, savgol (odd window from 5, edges repeat the end values)."""
    rows, _, keep = _line(df, key, params)
    method, size = params.get("method", "sma"), max(1, int(params.get("window", 5)))
    if method == "ema":
        alpha = number(params, "alpha", 2 / (size + 1))
        return Result(series={"values": (ema_frame(rows, key, alpha).withColumnRenamed("ema", "value").select(*keep, "value"), "value")})
    if method == "savgol":
        size = max(5, size + (size + 1) % 2)
        degree = min(int(params.get("polyOrder", 2)), size - 2)
        weights = K.savgol_weights(size, degree, min(int(params.get("derivative", 0)), degree))
        half, parts = size // 2, list(key.partition_by)
        ends = rows.groupBy(*parts).agg(F.min_by("x", INDEX).alias("_first"), F.max_by("x", INDEX).alias("_last"))
        full = rows.join(ends, parts) if parts else rows.crossJoin(F.broadcast(ends))  # one row

        def at(w, k: int) -> Column:
            c = F.lag("x", -k).over(w) if k < 0 else F.lead("x", k).over(w) if k > 0 else F.col("x")
            return F.coalesce(c, F.col("_first" if k < 0 else "_last"))

        out = over_rows(full, key, half, half, {"value": lambda w: sum((at(w, k) * float(weights[k + half]) for k in range(-half, half + 1)), F.lit(0.0))})
        return Result(series={"values": (out.select(*keep, "value"), "value")})
    out = _windowed(rows, key, size, lambda w: F.avg("x").over(w.rowsBetween(-(size - 1), 0)))
    return Result(series={"values": (out.select(*keep, "value"), "value")})


def differencing(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """x - x[lag], ``order`` times; the first order * lag rows go."""
    rows, _, keep = _line(df, key, params)
    order, lag = max(1, int(params.get("order", 1))), max(1, int(params.get("lag", 1)))
    signs = [(-1) ** k * _choose(order, k) for k in range(order + 1)]
    out = over_rows(rows, key, order * lag, 0, {"value": lambda w: sum((F.lag("x", k * lag).over(w) * float(s) if k else F.col("x") for k, s in enumerate(signs)), F.lit(0.0))})
    out = out.where(F.col(INDEX) >= order * lag).withColumn(INDEX, F.col(INDEX) - order * lag)
    return Result(series={"values": (out.select(*keep, "value"), "value")})


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def envelope(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Causal rms or peak of the last ``window`` values."""
    rows, _, keep = _line(df, key, params)
    size = max(1, int(params.get("window", 16)))
    frame = lambda w: w.rowsBetween(-(size - 1), 0)
    value = (lambda w: F.max(F.abs("x")).over(frame(w))) if params.get("mode", "rms") == "peak" else (lambda w: F.sqrt(F.avg(F.col("x") * F.col("x")).over(frame(w))))
    return Result(series={"values": (_windowed(rows, key, size, value).select(*keep, "value"), "value")})


def digital_filter(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """moving_average, median, or biquads (lowpass, highpass, bandpass, notch; even orders by Butterworth cascade)."""
    rows, _, keep = _line(df, key, params)
    kind, taps = params.get("type", "lowpass"), max(1, int(params.get("taps", 5)))
    if kind == "moving_average":
        return Result(series={"values": (_windowed(rows, key, taps, lambda w: F.avg("x").over(w.rowsBetween(-(taps - 1), 0))).select(*keep, "value"), "value")})
    if kind == "median":
        half = taps // 2
        out = over_rows(rows, key, half, half, {"value": lambda w: F.percentile("x", 0.5).over(w.rowsBetween(-half, half))})
        return Result(series={"values": (out.select(*keep, "value"), "value")})
    rate, cutoff = number(params, "sampleRate"), number(params, "cutoff")
    if not rate or not cutoff or rate <= 0 or cutoff <= 0:
        raise ValueError(f"digital_filter {kind} needs sampleRate and cutoff in Hz")
    if cutoff >= rate / 2:
        raise ValueError("the cutoff must be below half the sample rate")
    q, order, zero = number(params, "q", 0.7071), int(params.get("order", 2)), bool(params.get("zeroPhase", False))
    parts = K.sections(kind, rate, cutoff, q, order)
    out = C.filtered(rows, key, parts, ["x"])
    if zero:
        out = C.turned(C.filtered(C.turned(out, key), key, parts, ["x"]), key)
    return Result(series={"values": (out.withColumnRenamed("x", "value"), "value")})


def resample(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """decimate: mean of the last ``factor`` values at every factor-th. linear: between rates, by position."""
    rows, _, _ = _line(df, key, params)
    parts = list(key.partition_by)
    if params.get("mode", "decimate") == "linear":
        src, dst = number(params, "sourceRate"), number(params, "targetRate")
        if not src or not dst or src <= 0 or dst <= 0:
            raise ValueError("resample linear needs sourceRate and targetRate in Hz")
        n = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
        out_len = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * dst / src))
        # each input interval [i, i + 1) holds the outputs from ceil(i * dst / src) on
        nxt = over_rows(rows, key, 0, 1, {"x1": lambda w: F.coalesce(F.lead("x", 1).over(w), F.col("x"))})
        full = nxt.join(n, parts) if parts else nxt.crossJoin(F.broadcast(n))  # one row
        lo, hi = F.ceil(F.col(INDEX) * dst / src - 1e-9), F.least(F.ceil((F.col(INDEX) + 1) * dst / src - 1e-9), out_len) - 1
        spread = full.withColumn("j", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
        frac = F.col("j") * src / dst - F.col(INDEX)
        out = spread.select(*parts, F.col("j").alias(INDEX), (F.col("x") * (1 - frac) + F.col("x1") * frac).alias("value"))
        return Result(series={"values": (out, "value")}, plain={"outputRate": dst})
    factor = max(1, int(params.get("factor", 2)))
    out = _windowed(rows, key, factor, lambda w: F.avg("x").over(w.rowsBetween(-(factor - 1), 0)))
    out = out.where(F.col(INDEX) % factor == 0).select(*parts, F.floor(F.col(INDEX) / factor).alias(INDEX), "value")
    src = number(params, "sourceRate")
    return Result(series={"values": (out, "value")}, plain={"outputRate": src / factor} if src else {})


def interpolate(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """At ``queryPoints`` (midpoints by default), linear or natural cubic; flat outside. x ascends, or is the index."""
    columns = params.get("columns")
    method, points = params.get("method", "linear"), params.get("queryPoints")
    parts = list(key.partition_by)
    if columns and len(columns) == 2:
        rows = sample(df, key, *columns).select(*parts, INDEX, F.col(columns[0]).cast("double").alias("px"), F.col(columns[1]).cast("double").alias("py"))
    else:
        c = column_of(df, params, key)
        rows = sample(df, key, c).select(*parts, INDEX, F.col(INDEX).cast("double").alias("px"), F.col(c).alias("py"))
    if method == "linear" and points is None:
        w = {"x1": lambda w: F.lead("px", 1).over(w), "y1": lambda w: F.lead("py", 1).over(w)}
        out = over_rows(rows, key, 0, 1, w).where("x1 is not null")
        return Result(series={"values": (out.select(*parts, INDEX, ((F.col("px") + F.col("x1")) / 2).alias("query"), (F.col("py") * 0.5 + F.col("y1") * 0.5).alias("value")), "value")})

    return Result(series={"values": (C.spline(rows, key, points, linear=method != "spline"), "value")})


def seasonality_analysis(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Centred moving average (two passes if the period is even), mean-free seasonal indices, residual, strength."""
    period = int(params.get("period") or 0)
    if period < 2:
        raise ValueError(f"period must be 2 or more, not {period}")
    rows, _, keep = _line(df, key, params)
    parts, half = list(key.partition_by), period // 2
    n = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    full = rows.join(n, parts) if parts else rows.crossJoin(F.broadcast(n))  # one row
    if period % 2:
        trend = lambda w: F.avg("x").over(w.rowsBetween(-half, half))
    else:
        # at the last place the second window would run over the end: there the first one stands alone
        a, b = (lambda w: F.avg("x").over(w.rowsBetween(-half, half - 1))), (lambda w: F.avg("x").over(w.rowsBetween(-half + 1, half)))
        trend = lambda w: (a(w) + b(w)) / 2
    work = over_rows(full, key, half, half, {"trend": trend})
    work = work.withColumn("trend", F.when((F.col(INDEX) >= half) & (F.col(INDEX) < F.col("_n") - half), F.col("trend")))
    work = work.withColumn("detrended", F.col("x") - F.col("trend")).withColumn("phase", F.col(INDEX) % period)
    means = work.groupBy(*parts, "phase").agg(F.coalesce(F.avg("detrended"), F.lit(0.0)).alias("m"))
    indices = means.withColumn("seasonal", F.col("m") - F.sum("m").over(W.partitionBy(*(parts or [F.lit(0)]))) / period).drop("m")
    out = work.join(F.broadcast(indices) if not parts else indices, [*parts, "phase"]).withColumn("residual", F.col("detrended") - F.col("seasonal"))
    var = out.groupBy(*parts).agg(F.var_samp("residual").alias("r"), F.var_samp("detrended").alias("d"))
    strength = F.when(F.col("d") > 0, F.least(F.greatest(1 - F.col("r") / F.col("d"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    frame = out.select(*keep, "trend", "seasonal", "residual")
    return Result(scalars=var.select(*parts, strength.alias("strength")), series={k: (frame, k) for k in ("trend", "seasonal", "residual")} | {"seasonal_indices": (indices.withColumnRenamed("phase", INDEX), "seasonal")}, plain={"period": period})


def peak_detect(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Local maxima: strict rise before, no rise after; gates by height, prominence and distance, in that order."""
    rows, _, keep = _line(df, key, params)
    height, prominence, distance = number(params, "minHeight"), number(params, "minProminence", 0.0), int(params.get("minDistance", 1))
    parts = list(key.partition_by)
    near = over_rows(rows, key, 1, 1, {"_l": lambda w: F.lag("x", 1).over(w), "_r": lambda w: F.lead("x", 1).over(w)})
    out = near.where((F.col("x") > F.col("_l")) & (F.col("x") >= F.col("_r"))).select(*parts, INDEX, F.col("x").alias("value"))
    out = out.where(F.col("value") >= height) if height is not None else out
    if prominence > 0:
        out = C.prominence(rows, key, out).where(F.col("prominence") >= prominence).drop("prominence")
    if distance > 1:
        out = C.spaced(out, key, distance)
    return Result(scalars=out.groupBy(*parts).agg(F.count(F.lit(1)).alias("count")), series={"values": (out, "value"), "indices": (out, INDEX), "intervals": (C.steps_between(out, key), "interval")})


def zero_crossing(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Sign changes (zero counts as positive), each at the index before it."""
    rows, _, _ = _line(df, key, params)
    parts, direction, rate = list(key.partition_by), params.get("direction", "both"), number(params, "sampleRate")
    near = over_rows(rows, key, 1, 0, {"_p": lambda w: F.lag("x", 1).over(w)}).where("_p is not null and (_p < 0) <> (x < 0)")
    near = near.withColumn("rising", F.col("_p") < 0)
    if direction in ("rising", "falling"):
        near = near.where(F.col("rising") if direction == "rising" else ~F.col("rising"))
    out = near.select(*parts, (F.col(INDEX) - 1).alias(INDEX), "rising")
    total = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    up = F.when(F.col("rising"), F.col(INDEX))
    agg = out.groupBy(*parts).agg(F.count(F.lit(1)).alias("count"), F.count(up).alias("_u"), F.min(up).alias("_a"), F.max(up).alias("_b"))
    s = total.join(agg, parts, "left") if parts else total.crossJoin(F.broadcast(agg))  # one row
    count = F.coalesce("count", F.lit(0))
    cols = [count.alias("count")]
    if rate:
        # consecutive periods telescope: their mean is the span over their number
        span = (F.col("_b") - F.col("_a")) / (F.col("_u") - 1) / rate
        cols += [(count * rate / F.col("_n")).alias("crossingRate"), F.when(F.col("_u") >= 2, 1 / span).alias("estimatedFrequency")]
    return Result(scalars=s.select(*parts, *cols), series={"indices": (out, INDEX)})


def event_analysis(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """frequency, mtbf and mttr (minutes), transitions of an event column, in the key's order."""
    ev, ts = params.get("eventColumn", "event"), params.get("timestampColumn", "_timestamp")
    wanted = params.get("metrics") or ["frequency"]
    parts = list(key.partition_by)
    name = F.coalesce(F.col(ev).cast("string"), F.lit("null"))
    rows = df.select(*dict.fromkeys([*parts, *key.order_by]), name.alias("event"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms")) if any(w != "frequency" for w in wanted) else df.select(*parts, name.alias("event"))
    out = Result()
    low = F.lower("event")
    failed, mended = low.contains("error") | low.contains("fail"), low.contains("recover") | low.contains("resolve") | low.contains("fixed")
    if "frequency" in wanted:
        out.series["frequency"] = (rows.groupBy(*parts, "event").agg(F.count(F.lit(1)).alias("count")), "count")
    if "mtbf" in wanted:
        # mean of consecutive gaps = (last - first) / (n - 1) in row order
        o = F.struct(*key.order_by)
        s = rows.where(failed & F.col("ms").isNotNull()).groupBy(*parts).agg(F.count(F.lit(1)).alias("n"), F.min_by("ms", o).alias("a"), F.max_by("ms", o).alias("b"))
        out.scalars = s.select(*parts, F.when(F.col("n") >= 2, F.floor(F.floor((F.col("b") - F.col("a")) / (F.col("n") - 1)) / 60000)).otherwise(0).cast("long").alias("mtbf"))
    if "mttr" in wanted:
        from ..series import carried, with_index

        k = SeriesKey.of([*key.order_by], parts)
        idx = with_index(rows.where(failed | mended), k)
        nxt = carried(idx, k, {"next": F.when(mended, F.struct("ms", F.col(INDEX).alias("i")))}, backward=True)
        gap = nxt.where(failed & F.col("next").isNotNull() & (F.col("next.ms") > F.col("ms")))
        mttr = gap.groupBy(*parts).agg(F.floor(F.avg(F.col("next.ms") - F.col("ms")) / 60000).cast("long").alias("mttr"))
        out.scalars = mttr if out.scalars is None else (out.scalars.join(mttr, parts, "left") if parts else out.scalars.crossJoin(F.broadcast(mttr)))  # one row
    if "transitions" in wanted:
        from ..series import with_index

        idx = with_index(rows, key)
        steps = over_rows(idx, key, 1, 0, {"prev": lambda w: F.lag("event", 1).over(w)}).where("prev is not null")
        out.series["transitions"] = (steps.groupBy(*parts, F.concat_ws("->", "prev", "event").alias("transition")).agg(F.count(F.lit(1)).alias("count")), "count")
    return out


def hrv_metrics(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Heart-rate variability of RR intervals, in ms or s."""
    rows, _, _ = _line(df, key, params)
    parts = list(key.partition_by)
    x = F.col("x") * (1000.0 if params.get("unit", "ms") == "s" else 1.0)
    steps = over_rows(rows.withColumn("x", x), key, 1, 0, {"d": lambda w: F.col("x") - F.lag("x", 1).over(w)})
    s = steps.groupBy(*parts).agg(F.count(F.lit(1)).alias("count"), F.avg("x").alias("meanRR"), F.stddev_samp("x").alias("sdnn"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"), F.count_if(F.abs("d") > 50).alias("_n50"))
    return Result(scalars=s.select(*parts, "count", "meanRR", F.when(F.col("meanRR") > 0, 60000 / F.col("meanRR")).otherwise(0.0).alias("meanHeartRate"), F.coalesce("sdnn", F.lit(0.0)).alias("sdnn"), F.coalesce("rmssd", F.lit(0.0)).alias("rmssd"), F.when(F.col("count") > 1, 100.0 * F.col("_n50") / (F.col("count") - 1)).otherwise(0.0).alias("pnn50")))


def changepoint_cusum(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    rows, _, _ = _line(df, key, params)
    base = params.get("baselineWindow")
    out = per_series(rows, key, ["x"], lambda x: pd.DataFrame({INDEX: K.cusum(x, number(params, "threshold", 5.0), number(params, "drift", 0.5), int(base) if base else None)}), f"{INDEX} long")
    return Result(scalars=out.groupBy(*key.partition_by).agg(F.count(F.lit(1)).alias("count")), series={"changepoints": (out, INDEX)})


def _ahead(ends: DataFrame, parts: list[str], horizon: int, value: Column) -> DataFrame:
    """(parts, idx, value) of ``horizon`` steps; ``value`` is an expression over ``h``."""
    out = ends.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))) if horizon > 0 else ends.withColumn("h", F.lit(1)).limit(0)
    return out.select(*parts, (F.col("h") - 1).cast("long").alias(INDEX), value.alias("value"))


def _last(frame: DataFrame, parts: list[str], *columns: str) -> DataFrame:
    last = frame.groupBy(*parts).agg(F.max_by(F.struct(*columns, INDEX), INDEX).alias("z"))
    return (last if parts else last.where("z is not null")).select(*parts, "z.*")


def holt_winters(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Additive level, trend and season; ``horizon`` steps ahead."""
    rows, _, _ = _line(df, key, params)
    period, horizon = int(number(params, "period", 0)), int(number(params, "horizon", 10))
    ends = C.holt_winters(rows, key, period, *(number(params, n, d) for n, d in (("alpha", 0.3), ("beta", 0.1), ("gamma", 0.1))))
    parts = list(key.partition_by)
    one = _last(ends, parts, "state", "fitted").select(*parts, F.col("fitted").alias("fittedLast"), F.element_at("state", 1).alias("level"), F.element_at("state", 2).alias("trend"), "state")
    # the seasonal terms follow level and trend, the next place's first
    value = F.col("level") + F.col("h") * F.col("trend") + F.element_at("state", ((F.col("h") - 1) % max(1, period) + 3).cast("int"))
    return Result(scalars=one.drop("state"), series={"forecast": (_ahead(one, parts, horizon, value), "value")})


def kalman_filter(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Random-walk level, or level and trend, from the first sample (and first step) with unit covariance."""
    rows, _, _ = _line(df, key, params)
    parts = list(key.partition_by)
    frame = C.kalman(rows, key, params.get("model", "trend"), number(params, "processNoise", 1e-3), number(params, "measurementNoise", 1.0))
    last = _last(frame, parts, "value", "slope").select(*parts, F.col("value").alias("level"), F.col("slope").alias("trend"))
    error = frame.groupBy(*parts).agg(F.sqrt(F.sum(F.when(F.col(INDEX) > 0, F.col("error") * F.col("error")).otherwise(0.0)) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("innovationStd"))
    scalars = last.join(error, parts) if parts else last.crossJoin(F.broadcast(error))  # one row
    ahead = _ahead(last, parts, int(params.get("horizon", 10)), F.col("level") + F.col("h") * F.col("trend"))
    return Result(scalars=scalars, series={"filtered": (frame.select(*parts, INDEX, "value"), "value"), "forecast": (ahead, "value")})


def lockin(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Product with a reference and its quarter turn, each through two lowpass biquads; means after the settling share."""
    from .base import rate_of

    rows, _, _ = _line(df, key, params)
    parts = list(key.partition_by)
    rate, ref = rate_of(params, "lockin"), number(params, "referenceFrequency")
    if not ref or ref <= 0 or ref >= rate / 2:
        raise ValueError("lockin needs a referenceFrequency below half the sample rate")
    settle = min(0.9, max(0.0, number(params, "settle", 0.5)))
    angle = F.lit(2 * np.pi * ref) * (F.col(INDEX) / rate)
    mixed = rows.withColumn("i", F.col("x") * F.cos(angle)).withColumn("q", F.col("x") * F.sin(angle))
    out = C.filtered(mixed, key, [K.biquad("lowpass", rate, number(params, "lowpassCutoff") or ref / 10, 0.7071)] * 2, ["i", "q"])
    n = out.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    full = out.join(n, parts) if parts else out.crossJoin(F.broadcast(n))  # one row
    late = full.where(F.col(INDEX) >= F.least(F.col("_n") - 1, F.floor(F.col("_n") * settle))).groupBy(*parts).agg(F.avg("i").alias("i"), F.avg("q").alias("q"))
    scalars = late.select(*parts, (2 * F.hypot("i", "q")).alias("amplitude"), F.atan2("i", "q").alias("phase"), "i", "q")
    return Result(scalars=scalars, series={"amplitudeSeries": (out.select(*parts, INDEX, (2 * F.hypot("i", "q")).alias("value")), "value")})


def _pair(df: DataFrame, key: SeriesKey, params: Params, what: str) -> tuple[DataFrame, str, str]:
    columns = params.get("columns")
    if not columns or len(columns) != 2:
        raise ValueError(f"{what} needs two columns")
    rows = sample(df, key, *columns)
    return rows.select(*key.partition_by, INDEX, F.col(columns[0]).alias("a"), F.col(columns[1]).alias("b")), *columns


def _lag_sums(rows: DataFrame, key: SeriesKey, lags: int, both: bool) -> DataFrame:
    """(parts, lag, s): sums of a[i] * b[i + lag], per chunk with a halo of ``lags`` rows, then added."""
    from ..series import chunked

    parts = list(key.partition_by)
    part_kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in parts)
    spread = chunked(rows, 0, lags) if not both else chunked(rows, lags, lags)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(INDEX)
        own = pdf["_own"].to_numpy()
        a = np.where(own, pdf["a"].to_numpy(), 0.0)
        b = pdf["b"].to_numpy()
        n = len(a)
        ks = range(-lags if both else 0, lags + 1)
        s = [float(a[max(0, -k) : n - max(0, k)] @ b[max(0, k) : n - max(0, -k)]) if abs(k) < n else 0.0 for k in ks]
        out = pd.DataFrame({"lag": list(ks), "s": s})
        for i, c in enumerate(parts):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    return spread.groupBy(*parts, "_chunk").applyInPandas(run, part_kinds + "lag long, s double").groupBy(*parts, "lag").agg(F.sum("s").alias("s"))


def acf(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Biased autocorrelation to maxLag; the period is the highest local maximum above 2 / sqrt(n)."""
    rows, _, _ = _line(df, key, params)
    parts = list(key.partition_by)
    one_series(key, "acf")
    n, mean = rows.agg(F.count(F.lit(1)), F.avg("x")).first()
    if n < 4:
        raise ValueError("acf needs 4 values")
    lags = min(int(params.get("maxLag") or min(n // 2, 500)), n - 1)
    c = rows.select(INDEX, (F.col("x") - mean).alias("a"), (F.col("x") - mean).alias("b"))
    sums = _lag_sums(c, key, lags, both=False)
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(W.partitionBy(F.lit(0)))
    frame = sums.select(F.col("lag").alias(INDEX), F.when(zero > 0, F.col("s") / zero).otherwise(0.0).alias("value"))
    w = W.partitionBy(F.lit(0)).orderBy(INDEX)
    floor = 2 / float(np.sqrt(n))
    tops = frame.withColumn("l", F.lag("value", 1).over(w)).withColumn("r", F.lead("value", 1).over(w)).where(f"idx >= 2 and idx < {lags} and value > l and value >= r").where(F.col("value") > floor)
    best = tops.agg(F.coalesce(F.max_by(INDEX, F.struct("value", -F.col(INDEX))), F.lit(0)).alias("detectedPeriod"), F.coalesce(F.max("value"), F.lit(0.0)).alias("periodConfidence"), F.lit(floor).alias("significanceLevel"))
    return Result(scalars=best, series={"acf": (frame, "value")})


def cross_correlation(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    one_series(key, "cross_correlation")
    rows, _, _ = _pair(df, key, params, "cross_correlation")
    n, ma, mb, va, vb = rows.agg(F.count(F.lit(1)), F.avg("a"), F.avg("b"), F.var_pop("a"), F.var_pop("b")).first()
    if n < 4:
        raise ValueError("cross_correlation needs 4 values")
    lags = min(int(params.get("maxLag") or min(n // 2, 200)), n - 1)
    norm = n * float(np.sqrt(va * vb))
    sums = _lag_sums(rows.select(INDEX, (F.col("a") - ma).alias("a"), (F.col("b") - mb).alias("b")), key, lags, both=True)
    frame = sums.select((F.col("lag") + lags).alias(INDEX), "lag", (F.col("s") / norm if norm > 0 else F.lit(0.0)).alias("value"))
    best = frame.agg(F.max_by(F.struct("lag", "value"), F.struct(F.abs("value"), -F.col("lag"))).alias("x")).select(F.col("x.lag").alias("bestLag"), F.col("x.value").alias("bestCorrelation"))
    return Result(scalars=best, series={"correlations": (frame, "value"), "lags": (frame, "lag")})


