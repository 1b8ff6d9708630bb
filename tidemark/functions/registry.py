"""Functions by name, their declared parameters and results, and user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..series import SeriesKey
from . import spectral, stats, timeseries
from .base import Params, Result, column_of, numeric_columns

Function = Callable[[DataFrame, SeriesKey, Params], Result]


@dataclass(frozen=True)
class FunctionInfo:
    name: str
    run: Function
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    results: tuple[str, ...] = ()  # empty: not declared
    description: str = ""


def _info(name: str, run: Function, params: str, results: str) -> FunctionInfo:
    """``params``: names, a required one ends with "!"."""
    ps, rs = params.split(), results.split()
    return FunctionInfo(name, run, tuple(p[:-1] for p in ps if p[-1] == "!"), tuple(p for p in ps if p[-1] != "!"), tuple(rs), (run.__doc__ or "").strip().split("\n")[0])


BUILT_IN = [
    _info("descriptive_stats", stats.descriptive_stats, "columns percentiles", ""),
    _info("anomaly_detect", stats.anomaly_detect, "method column threshold sensitivity alpha", "anomalies count method"),
    _info("event_analysis", timeseries.event_analysis, "eventColumn timestampColumn metrics", "frequency mtbf mttr transitions"),
    _info("time_series_analysis", timeseries.time_series_analysis, "method column windowSize", "moving_averages windowSize slope intercept"),
    _info("correlation_regression", stats.correlation_regression, "method xColumn yColumn", "correlation slope intercept r_squared"),
    _info("rule_based_classification", stats.rule_based_classification, "rules defaultLabel outputColumn", "labeledRows distribution outputColumn totalRows"),
    _info("seasonality_analysis", timeseries.seasonality_analysis, "column timestampColumn period method", "trend seasonal residual seasonal_indices period strength"),
    _info("fft", spectral.fft, "column sampleRate! window", "column frequencies magnitudes phases dominantFrequency resolution sampleCount fftSize"),
    _info("psd_welch", spectral.psd_welch, "column sampleRate! segmentLength overlap window bands", "column frequencies psd resolution segments bandPowers"),
    _info("digital_filter", timeseries.digital_filter, "column type sampleRate cutoff q taps order zeroPhase", "column type values sampleCount"),
    _info("peak_detect", timeseries.peak_detect, "column minHeight minProminence minDistance", "column indices values count intervals"),
    _info("zero_crossing", timeseries.zero_crossing, "column sampleRate direction", "column indices count crossingRate estimatedFrequency"),
    _info("resample", timeseries.resample, "column mode factor sourceRate targetRate", "column mode values sampleCount outputRate"),
    _info("envelope", timeseries.envelope, "column mode window", "column mode values sampleCount"),
    _info("acf", timeseries.acf, "column maxLag", "column acf detectedPeriod periodConfidence significanceLevel"),
    _info("cross_correlation", timeseries.cross_correlation, "columns! maxLag", "columns lags correlations bestLag bestCorrelation"),
    _info("changepoint_cusum", timeseries.changepoint_cusum, "column threshold drift baselineWindow", "column changepoints count"),
    _info("holt_winters", timeseries.holt_winters, "column horizon period alpha beta gamma", "column forecast fittedLast level trend"),
    _info("smoothing", timeseries.smoothing, "column method window alpha polyOrder derivative", "column method values sampleCount"),
    _info("differencing", timeseries.differencing, "column order lag", "column values sampleCount"),
    _info("histogram", stats.histogram, "column bins min max", "column binEdges counts underflow overflow"),
    _info("covariance_matrix", stats.covariance_matrix, "columns", "columns covariance correlation rowCount"),
    _info("regression", stats.regression, "columns column degree", "coefficients rSquared predictions"),
    _info("hypothesis_test", stats.hypothesis_test, "columns! test", "statistic columns test degreesOfFreedom criticalValue significant"),
    _info("interpolate", timeseries.interpolate, "columns column method queryPoints", "method queryPoints values"),
    _info("spectrogram", spectral.spectrogram, "column sampleRate! segmentLength overlap window", "column times frequencies magnitudes segmentCount"),
    _info("cepstrum", spectral.cepstrum, "column sampleRate!", "column quefrencies cepstrum peakQuefrency"),
    _info("harmonics", spectral.harmonics, "column sampleRate! fundamental harmonicCount", "column fundamental harmonics thd thdPercent"),
    _info("cross_psd", spectral.cross_psd, "columns! sampleRate! segmentLength overlap window", "columns frequencies coherence frfMagnitude frfPhase peakCoherentFrequency segments"),
    _info("pca", stats.pca, "columns components standardize", "columns explainedVariance explainedVarianceRatio components scores"),
    _info("lomb_scargle", spectral.lomb_scargle, "columns! minFrequency maxFrequency frequencySteps", "columns frequencies power bestFrequency bestPeriod bestPower"),
    _info("kalman_filter", timeseries.kalman_filter, "column model processNoise measurementNoise horizon", "column model filtered forecast level trend innovationStd"),
    _info("lockin", timeseries.lockin, "column sampleRate! referenceFrequency! lowpassCutoff settle", "column referenceFrequency amplitude phase i q amplitudeSeries"),
    _info("vibration_indicators", stats.vibration_indicators, "column! machineClass", "column rms peak peakToPeak crestFactor kurtosis skewness isoZone isoLimits"),
    _info("hrv_metrics", timeseries.hrv_metrics, "column! unit", "column count meanRR meanHeartRate sdnn rmssd pnn50"),
    _info("eeg_band_powers", spectral.eeg_band_powers, "column! sampleRate! segmentLength", "column bandPowers relativePowers dominantBand totalPower"),
]


#: Parameters that a result repeats, with the values that functions take where they are not given.
_DEFAULTS = {
    ("anomaly_detect", "method"): "threshold", ("digital_filter", "type"): "lowpass", ("resample", "mode"): "decimate", ("envelope", "mode"): "rms", ("smoothing", "method"): "sma",
    ("interpolate", "method"): "linear", ("hypothesis_test", "test"): "ttest", ("kalman_filter", "model"): "trend", ("time_series_analysis", "windowSize"): 3,
}


def _complete(info: FunctionInfo, result: Result, df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """Adds declared fields that only repeat parameters, or count a series, where the function hasn't made them."""
    made = {*result.plain, *result.series, *(result.scalars.columns if result.scalars is not None else ())}
    for field in info.results:
        if field in made:
            continue
        if field == "sampleCount":
            frame = next(iter(result.series.values()))[0]
            result.series[field] = (frame.groupBy(*key.partition_by).agg(F.count(F.lit(1)).alias(field)), field)
        elif field == "queryPoints" and "values" in result.series:
            result.series[field] = (result.series["values"][0], "query")
        elif field == "column":
            result.plain[field] = params.get("column") or column_of(df, params, key)
        elif field == "columns":
            result.plain[field] = list(params.get("columns") or numeric_columns(df, key))
        elif field in params or (info.name, field) in _DEFAULTS:
            result.plain[field] = params.get(field, _DEFAULTS.get((info.name, field)))
    return result


class Registry:
    def __init__(self):
        self.by_name = {i.name: i for i in BUILT_IN}

    def register(self, info: FunctionInfo) -> None:
        if info.name in self.by_name:
            raise EngineError("analysis.duplicate_function", f'"{info.name}" is there already')
        self.by_name[info.name] = info

    def unregister(self, name: str) -> bool:
        return self.by_name.pop(name, None) is not None

    def search(self, text: str) -> list[FunctionInfo]:
        t = text.lower()
        return [i for i in self.by_name.values() if t in i.name.lower() or t in i.description.lower()]

    def run(self, name: str, df: DataFrame, key: SeriesKey, params: Params) -> Result:
        info = self.by_name.get(name)
        if info is None:
            raise EngineError("analysis.unsupported_function", f'no function "{name}"', step=f"function:{name}")
        missing = [p for p in info.required if params.get(p) is None]
        if missing:
            raise EngineError("analysis.parameter_error", f"{name} needs {', '.join(missing)}", step=f"function:{name}")
        try:
            return _complete(info, info.run(df, key, params), df, key, params)
        except EngineError:
            raise
        except Exception as e:
            raise EngineError("analysis.execution_error", f"{name}: {e}", step=f"function:{name}") from e
