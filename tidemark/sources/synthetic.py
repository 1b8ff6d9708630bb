"""Generated signals: column expressions over a range; linear systems by an affine scan.

Noise is a hash of (seed, component, index), so it doesn't depend on partitioning.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.kernels import affine_scan, companion, lti_steps
from ..series import INDEX

MODELS = ("state_space", "transfer_function", "rlc")
MAX_SAMPLES, MAX_RUNS, MAX_TOTAL = 10_000_000, 10_000, 50_000_000
EPOCH = "2026-01-01 00:00:00"


def _bad(message: str) -> EngineError:
    return EngineError("source.schema_mismatch", message)


def _get(c: Mapping[str, Any], name: str, default: float) -> float:
    v = c.get(name)
    return float(v) if v is not None else default


def _unit(seed: Column, part: int, salt: int) -> Column:
    """Uniform in (0, 1) from a hash."""
    h = F.xxhash64(seed, F.lit(part), F.lit(salt), F.col(INDEX))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def point(c: Mapping[str, Any], t: Column, part: int, seed: Column) -> Column:
    """A point-wise component as a column of index and time."""
    kind = c.get("kind", "constant")
    if kind == "trend":
        return F.lit(_get(c, "slope", 1.0)) * t
    if kind == "sine":
        return F.lit(_get(c, "amplitude", 1.0)) * F.sin(F.lit(2 * math.pi * _get(c, "frequency", 1.0)) * t + F.lit(_get(c, "phase", 0.0)))
    if kind == "noise":
        std = F.lit(_get(c, "std", 1.0))
        if c.get("distribution", "gaussian") == "uniform":
            return (_unit(seed, part, 1) * 2 - 1) * std * F.lit(math.sqrt(3))
        return std * F.sqrt(-2 * F.log(_unit(seed, part, 1))) * F.cos(2 * math.pi * _unit(seed, part, 2))
    if kind in ("step", "impulse"):
        at = int(_get(c, "at", 0 if kind == "step" else -1))
        hit = F.col(INDEX) >= at if kind == "step" else F.col(INDEX) == at
        return F.when(hit, F.lit(_get(c, "level", 1.0))).otherwise(0.0)
    return F.lit(_get(c, "level", 0.0))


def system(c: Mapping[str, Any]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """(A, B, C, D, x0) of a model component."""
    kind = c["kind"]
    if kind == "rlc":
        r, l, cap, out = _get(c, "r", 1.0), _get(c, "l", 1.0), _get(c, "c", 1.0), c.get("output", "vc")
        if l <= 0 or cap <= 0 or r < 0 or out not in ("vc", "il", "vr"):
            raise _bad("rlc needs l > 0, c > 0, r >= 0 and output vc, il or vr")
        return np.array([[-r / l, -1 / l], [1 / cap, 0.0]]), np.array([1 / l, 0.0]), np.array({"vc": [0.0, 1.0], "il": [1.0, 0.0], "vr": [r, 0.0]}[out]), 0.0, np.zeros(2)
    if kind == "transfer_function":
        num, den = c.get("num"), c.get("den")
        if not num or not den or not 2 <= len(den) <= 21 or len(num) > len(den) or den[0] == 0:
            raise _bad("transfer_function needs a proper num / den of order 20 at most")
        a, b, out, through = companion(num, den)
        return a, b, out, through, np.zeros(len(a))
    a, b, out = (np.array(c.get(k) or [], float) for k in "abc")
    n = len(a)
    x0 = np.array(c.get("x0") or np.zeros(n), float)
    if not 1 <= n <= 20 or a.shape != (n, n) or b.shape != (n,) or out.shape != (n,) or x0.shape != (n,):
        raise _bad("state_space needs a (n by n), b (n), c (n), x0 (n), n 20 at most")
    return a, b, out, _get(c, "d", 0.0), x0


def _parsed(spec: str | Mapping[str, Any]) -> Mapping[str, Any]:
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except ValueError as e:
            raise _bad(f"the query must be a JSON spec: {e}") from e
    if not isinstance(spec, Mapping):
        raise _bad("the spec must be an object")
    return spec


def _stamp(rate: float) -> Column:
    step = math.floor(1e6 / rate + 0.5)
    return F.timestamp_micros(F.unix_micros(F.lit(EPOCH).cast("timestamp")) + F.col(INDEX) * step).alias("_timestamp")


def stream(spark: SparkSession, spec: str | Mapping[str, Any]) -> DataFrame:
    """The rows of ``generate`` as a stream, ``batchSize`` samples (100 if not given) to a micro-batch.

    A sample depends on its index alone, so a restarted query gives the same rows. Models need what came before and
    ensembles all runs: they don't stream. After the last sample micro-batches are empty.
    """
    spec = _parsed(spec)
    n, rate = int(spec.get("samples", 1000)), _get(spec, "sampleRate", 1.0)
    if not 0 < n <= MAX_SAMPLES:
        raise _bad(f"samples must be 1 to {MAX_SAMPLES}")
    parts = spec.get("components") or [{"kind": "constant", "level": 0.0}]
    if spec.get("ensemble") or any(c.get("kind") in MODELS for c in parts):
        raise _bad("models and ensembles don't stream")
    numbers = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", int(spec.get("batchSize", 100))).load()
    rows = numbers.select(F.col("value").alias(INDEX)).where(F.col(INDEX) < n)
    t, seed = F.col(INDEX) / F.lit(rate), F.lit(int(spec.get("seed", 0))) + F.lit(0).cast("long")
    return rows.select(_stamp(rate), sum((point(c, t, i, seed) for i, c in enumerate(parts)), F.lit(0.0)).alias("value"))


def generate(spark: SparkSession, spec: str | Mapping[str, Any]) -> DataFrame:
    """``_timestamp``, ``value`` and, for an ensemble, ``value_p<k>``: the sum of the spec's components."""
    spec = _parsed(spec)
    n, rate, seed = int(spec.get("samples", 1000)), _get(spec, "sampleRate", 1.0), int(spec.get("seed", 0))
    if not 0 < n <= MAX_SAMPLES:
        raise _bad(f"samples must be 1 to {MAX_SAMPLES}")
    parts = spec.get("components") or [{"kind": "constant", "level": 0.0}]
    ensemble = spec.get("ensemble")
    runs = int(ensemble.get("runs", 100)) if ensemble else 1
    if ensemble and (not 2 <= runs <= MAX_RUNS or n * runs > MAX_TOTAL):
        raise _bad("an ensemble has 2 to 10000 runs and 50M values at most")
    base = spark.range(n * runs).select((F.col("id") % n).alias(INDEX), F.floor(F.col("id") / n).alias("run"))
    t, run_seed = F.col(INDEX) / F.lit(rate), F.lit(seed) + F.col("run")
    points = [point(c, t, i, run_seed) for i, c in enumerate(parts) if c.get("kind") not in MODELS]
    models = [(i, c) for i, c in enumerate(parts) if c.get("kind") in MODELS]
    inputs = {}
    for i, c in models:
        u = c.get("input") or {"kind": "step", "at": 0, "level": 1.0}
        if u.get("kind") in MODELS:
            raise _bad("a model's input must be point-wise")
        inputs[f"u{i}"] = point(u, t, 1000 + i, run_seed)
    rows = base.select("*", sum(points, F.lit(0.0)).alias("value"), *(u.alias(k) for k, u in inputs.items()))
    if models:
        plans = [(f"u{i}", *system(c)) for i, c in models]

        def simulate(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(INDEX)
            total = pdf["value"].to_numpy(np.float64)
            for name, a, b, out, through, x0 in plans:
                u = pdf[name].to_numpy(np.float64)
                phi, gamma = lti_steps(a, b, 1 / rate)
                after = affine_scan(phi, np.outer(u, gamma), x0)
                before = np.vstack([x0[None, :], after[:-1]])
                total = total + before @ out + through * u
            return pd.DataFrame({INDEX: pdf[INDEX], "run": pdf["run"], "value": total})

        rows = rows.groupBy("run").applyInPandas(simulate, f"{INDEX} long, run long, value double")
    stamp = _stamp(rate)
    if not ensemble:
        return rows.select(stamp, "value")
    shares = [float(p) for p in ensemble.get("percentiles", [5, 50, 95]) if 0 <= p <= 100]
    label = lambda p: str(int(p)) if p == int(p) else str(p)
    return rows.groupBy(INDEX).agg(F.avg("value").alias("value"), *(F.percentile("value", p / 100).alias(f"value_p{label(p)}") for p in shares)).select(stamp, "value", *(f"value_p{label(p)}" for p in shares))
