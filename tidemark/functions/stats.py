"""Statistics: aggregates in one pass, small linear algebra on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..series import INDEX, SeriesKey, joined, running_sums
from .base import Params, Result, column_of, number, numeric_columns, one_series


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def long_values(df: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    """(parts, column, v): non-null values, one row each."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns)))
    return df.select(*parts, pairs.alias("x")).select(*parts, "x.*").where("v is not null")


def at_ranks(values: DataFrame, groups: list[str], places: list[Callable[[Column], Column]]) -> DataFrame:
    """(groups, r, v): the values at sorted positions, each a function of a group's number of values.

    Values are grouped first; their counts are summed by ranges, so a group of very many values is many tasks.
    """
    counts = values.groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counts, groups, ["v"], {"_hi": "n"})
    total = ranked.groupBy(*groups).agg(F.max("_hi").alias("_total"))
    full = joined(ranked, total, groups) if groups else ranked.crossJoin(F.broadcast(total))  # one row
    at = F.array(*(F.struct(F.lit(i).alias("r"), p(F.col("_total")).cast("long").alias("at")) for i, p in enumerate(places)))
    return full.withColumn("w", F.explode(at)).where((F.col("w.at") >= F.col("_hi") - F.col("n")) & (F.col("w.at") < F.col("_hi"))).select(*groups, "w.r", "v")


def nearest_rank(values: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """(groups, r, v): the value at sorted position round(share * (n - 1))."""
    return at_ranks(values, groups, [lambda n, s=s: F.floor(s * (n - 1) + 0.5) for s in shares])


#: Half the width, as a share of the rows, of the bracket in which an order statistic is looked for.
BRACKET = 3e-4


def order_statistics(rows: DataFrame, columns: list[str], shares: list[float], place: Callable[[float, int], int]) -> dict[str, list[float | None]]:
    """Per column the values at the sorted positions ``place(share, n)``, nulls aside; no column is sorted whole.

    A sketch brackets each position; one pass counts what lies below the brackets and the values within.  Where a
    bracket misses its position it is the whole range.  Only brackets, counts and results reach the driver.
    """
    wide = [min(1.0, max(0.0, s + d)) for s in shares for d in (-BRACKET, BRACKET)]
    first = rows.agg(*(x for c in columns for x in (F.count(c), F.percentile_approx(c, wide, 10_000), F.min(c), F.max(c)))).first()
    found: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    open_ = []
    for i, c in enumerate(columns):
        n, at, low, high = first[4 * i : 4 * i + 4]
        for k, s in enumerate(shares if n else []):
            lo, hi = (low if wide[2 * k] == 0 else at[2 * k]), (high if wide[2 * k + 1] == 1 else at[2 * k + 1])
            open_.append((c, k, min(max(place(s, n), 0), n - 1), lo, hi, low, high))
    while open_:
        counted = rows.agg(*(F.count_if(F.col(c) < F.lit(lo)) for c, _, _, lo, _, _, _ in open_), *(F.count_if(F.col(c).between(lo, hi)) for c, _, _, lo, hi, _, _ in open_)).first()
        sound, missed = [], []
        for i, (c, k, at, lo, hi, low, high) in enumerate(open_):
            below, inside = counted[i], counted[len(open_) + i]
            if lo == hi and below <= at < below + inside:
                found[c][k] = lo
            elif below <= at < below + inside:
                sound.append((c, k, at - below, lo, hi))
            else:
                missed.append((c, k, at, low, high, low, high))
        if sound:
            cases = F.explode(F.array_compact(F.array(*(F.when(F.col(c).between(lo, hi), F.struct(F.lit(j).alias("j"), F.col(c).alias("v"))) for j, (c, _, _, lo, hi) in enumerate(sound)))))
            near = rows.select(cases.alias("x")).select("x.*").groupBy("j", "v").agg(F.count(F.lit(1)).alias("n"))
            upto = F.sum("n").over(W.partitionBy("j").orderBy("v"))
            want = F.element_at(F.array(*(F.lit(at) for _, _, at, _, _ in sound)), F.col("j") + 1)
            hit = near.withColumn("hi", upto).where((want < F.col("hi")) & (want >= F.col("hi") - F.col("n")))
            for r in hit.select("j", "v").collect():  # a row per position
                found[sound[r["j"]][0]][sound[r["j"]][1]] = r["v"]
        open_ = missed
    return found


def descriptive_stats(df: DataFrame, key: SeriesKey | None, params: Params) -> Result:
    """Per column: count, min, max, avg, std (n-1), skewness (population), kurtosis (3 for a normal), p<k> by nearest rank."""
    parts = list(key.partition_by) if key else []
    columns = list(params.get("columns") or numeric_columns(df, key))
    percentiles = [int(p) for p in params.get("percentiles", [25, 50, 75])]
    values = long_values(df, columns, parts)
    n = F.count("v")
    moments = n > 2
    spread = F.coalesce(F.stddev_samp("v"), F.lit(0.0))
    out = values.groupBy(*parts, "column").agg(
        n.alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("avg"), spread.alias("std"),
        F.when(moments & (spread > 0), F.skewness("v")).otherwise(0.0).alias("skewness"),
        F.when(moments & (spread > 0), F.kurtosis("v") + 3).otherwise(0.0).alias("kurtosis"),
    )
    if percentiles and not parts:
        at = order_statistics(df.select(*(F.col(c).cast("double").alias(c) for c in columns)), columns, [p / 100 for p in percentiles], lambda s, n: math.floor(s * (n - 1) + 0.5))
        ranks = df.sparkSession.createDataFrame([(c, *at[c]) for c in columns], "column string, " + ", ".join(f"p{p} double" for p in percentiles))
        out = out.join(F.broadcast(ranks), "column")  # a row per column
    elif percentiles:
        ranks = nearest_rank(values, [*parts, "column"], [p / 100 for p in percentiles])
        ranks = ranks.groupBy(*parts, "column").pivot("r", list(range(len(percentiles)))).agg(F.first("v"))
        for i, p in enumerate(percentiles):
            ranks = ranks.withColumnRenamed(str(i), f"p{p}")
        out = out.join(ranks, [*parts, "column"])
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    if not parts:  # a column without values has zeros
        out = every.join(out, "column", "left").fillna(0)
    return Result(scalars=out)


def _two(params: Params) -> tuple[str, str]:
    columns = params.get("columns")
    return (columns[0], columns[1]) if columns else (params.get("xColumn", "x"), params.get("yColumn", "y"))


def correlation_regression(df: DataFrame, key: SeriesKey | None, params: Params) -> Result:
    """Pairwise-complete correlation and least squares; zeros below two pairs or without variance."""
    x, y = (F.col(c).cast("double") for c in _two(params))
    parts = list(key.partition_by) if key else []
    rows = df.where(x.isNotNull() & y.isNotNull()).select(*parts, x.alias("x"), y.alias("y"))
    sums = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    zero = lambda c: F.when(F.col("n") >= 2, c).otherwise(F.lit(0.0))
    corr, slope = _div(F.col("c"), F.sqrt(F.col("vx") * F.col("vy"))), _div(F.col("c"), F.col("vx"))
    return Result(scalars=sums.select(*parts, zero(corr).alias("correlation"), zero(slope).alias("slope"), zero(F.col("my") - slope * F.col("mx")).alias("intercept"), zero(corr * corr).alias("r_squared")))


def covariance_matrix(df: DataFrame, key: SeriesKey | None, params: Params) -> Result:
    """(a, b, covariance, correlation) for all pairs of columns, over rows with no null in any of them; one aggregate."""
    columns = list(params.get("columns") or numeric_columns(df, key))
    parts = list(key.partition_by) if key else []
    rows = df.select(*parts, *(F.col(c).cast("double").alias(c) for c in columns)).dropna(subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("rowCount"), *(F.coalesce(F.covar_samp(columns[i], columns[j]), F.lit(0.0)).alias(f"c{i}_{j}") for i, j in pairs))
    cells = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            p, q = min(i, j), max(i, j)
            corr = _div(F.col(f"c{p}_{q}"), F.sqrt(F.col(f"c{i}_{i}") * F.col(f"c{j}_{j}")))
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{p}_{q}").alias("covariance"), corr.alias("correlation")))
    return Result(scalars=one.select(*parts, "rowCount", F.explode(F.array(*cells)).alias("m")).select(*parts, "m.*", "rowCount"))


def histogram(df: DataFrame, key: SeriesKey | None, params: Params) -> Result:
    """(bin, lo, hi, count) with under- and overflow; the last bin holds its upper edge."""
    one_series(key, "histogram")
    c = column_of(df, params, key)
    bins = max(1, int(params.get("bins", 10)))
    rows = df.select(F.col(c).cast("double").alias("v")).where("v is not null")
    lo, hi = number(params, "min"), number(params, "max")
    if lo is None or hi is None:
        found = rows.agg(F.min("v"), F.max("v")).first()
        lo, hi = (lo if lo is not None else found[0] or 0.0), (hi if hi is not None else found[1] or 0.0)
    width = (hi - lo) / bins if hi > lo else 1.0
    top = hi if hi > lo else lo + bins * width
    place = F.when(F.col("v") < lo, -1).when(F.col("v") > top, bins).otherwise(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))).cast("int")
    counts = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(-1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    full = every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))
    inner = full.where(f"bin between 0 and {bins - 1}").select("bin", (F.lit(lo) + F.col("bin") * width).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"), "count")
    flow = full.agg(F.sum(F.when(F.col("bin") == -1, F.col("count"))).alias("underflow"), F.sum(F.when(F.col("bin") == bins, F.col("count"))).alias("overflow"))
    frame = inner.withColumn(INDEX, F.col("bin").cast("long"))
    return Result(scalars=flow, series={"counts": (frame, "count"), "binEdges": (frame, "lo")})


def regression(df: DataFrame, key: SeriesKey | None, params: Params) -> Result:
    """Least-squares polynomial by power sums of the scaled x: one aggregate, a (degree + 1) square solve on the driver."""
    one_series(key, "regression")
    xc, yc = _two(params) if params.get("columns") else (None, column_of(df, params, key))
    degree = max(1, int(params.get("degree", 1)))
    if xc is None:
        from .base import sample

        rows = sample(df, key, yc).select(F.col(INDEX).cast("double").alias("x"), F.col(yc).alias("y"), INDEX)
    else:
        rows = df.select(F.col(xc).cast("double").alias("x"), F.col(yc).cast("double").alias("y")).where("x is not null and y is not null")
    c, s, n = rows.agg(F.coalesce(F.avg("x"), F.lit(0.0)), F.coalesce(F.stddev_pop("x"), F.lit(0.0)), F.count(F.lit(1))).first()
    if n <= degree:
        raise ValueError(f"regression of degree {degree} needs more than {degree} rows")
    s = s or 1.0
    z = (F.col("x") - c) / s
    got = rows.agg(*(F.sum(F.pow(z, F.lit(k))).alias(f"s{k}") for k in range(2 * degree + 1)), *(F.sum(F.pow(z, F.lit(k)) * F.col("y")).alias(f"t{k}") for k in range(degree + 1))).first()
    a = np.array([[got[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    if np.linalg.matrix_rank(a) <= degree:
        raise ValueError("regression: singular system")
    scaled = np.polynomial.Polynomial(np.linalg.solve(a, [got[f"t{k}"] for k in range(degree + 1)]))
    coef = scaled(np.polynomial.Polynomial([-c / s, 1 / s])).coef
    coef = np.concatenate([coef, np.zeros(degree + 1 - len(coef))])
    fit = F.lit(0.0)
    for b in scaled.coef[::-1]:
        fit = fit * z + F.lit(float(b))
    fitted = rows.withColumn("prediction", fit)
    res = fitted.agg(F.sum(F.pow(F.col("y") - F.col("prediction"), F.lit(2))).alias("e"), F.var_pop("y").alias("v"), F.count(F.lit(1)).alias("n"))
    r2 = res.select(F.when(F.col("v") > 0, 1 - F.col("e") / (F.col("v") * F.col("n"))).otherwise(F.lit(1.0)).alias("rSquared"), *(F.lit(float(b)).alias(f"c{k}") for k, b in enumerate(coef)))
    return Result(scalars=r2, series={"predictions": (fitted, "prediction")}, plain={"coefficients": coef.tolist()})


def hypothesis_test(df: DataFrame, key: SeriesKey | None, params: Params) -> Result:
    """Welch's t (significant beyond 1.96) or Kolmogorov-Smirnov, of two columns.

    KS walks both sorted samples; at equal values the first sample goes first, so ties widen the distance.
    """
    one_series(key, "hypothesis_test")
    a, b = params["columns"]
    if params.get("test", "ttest") == "ks":
        sides = [df.select(F.col(c).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias(n)) for c, n in ((a, "na"), (b, "nb"))]
        both = sides[0].join(sides[1], "v", "full").select("v", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
        walked = running_sums(both, [], ["v"], {"ca": "na", "cb": "nb"})
        steps = walked.crossJoin(F.broadcast(both.agg(F.sum("na").alias("n"), F.sum("nb").alias("m"))))  # one row
        after_a = F.abs(F.col("ca") / F.col("n") - (F.col("cb") - F.col("nb")) / F.col("m"))
        after_b = F.abs(F.col("ca") / F.col("n") - F.col("cb") / F.col("m"))
        d = steps.agg(F.max(F.greatest(after_a, after_b)).alias("statistic"), F.max("n").alias("n"), F.max("m").alias("m"))
        critical = F.lit(1.358) * F.sqrt((F.col("n") + F.col("m")) / (F.col("n") * F.col("m")))
        return Result(scalars=d.select("statistic", critical.alias("criticalValue"), (F.col("statistic") > critical).alias("significant")))
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = df.agg(F.count(x).alias("n"), F.count(y).alias("m"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"))
    p, q = F.col("vx") / F.col("n"), F.col("vy") / F.col("m")
    t = _div(F.col("mx") - F.col("my"), F.sqrt(p + q))
    dof = _div((p + q) * (p + q), p * p / (F.col("n") - 1) + q * q / (F.col("m") - 1))
    return Result(scalars=s.where("n >= 3 and m >= 3").select(t.alias("statistic"), dof.alias("degreesOfFreedom"), (F.abs(t) > 1.96).alias("significant")))


def pca(df: DataFrame, key: SeriesKey | None, params: Params) -> Result:
    """Principal components: covariance in Spark, eigenvectors on the driver, scores as column expressions.

    Of each component the loading of largest size is positive.
    """
    one_series(key, "pca")
    columns = list(params.get("columns") or numeric_columns(df, key))
    rows = df.select(*(key.order_by if key else ()), *(F.col(c).cast("double").alias(c) for c in columns)).dropna(subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.array([[got[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(columns))] for i in range(len(columns))], float)
    scale = np.sqrt(np.diag(cov)) if params.get("standardize", True) else np.ones(len(columns))
    scale[scale == 0] = 1
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-values)[: int(params.get("components") or len(columns))]
    total = max(values.sum(), 1e-300)
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(axis=0), order])
    score = [sum(((F.col(c) - got[f"m{i}"]) * float(vectors[i, k] / scale[i]) for i, c in enumerate(columns)), F.lit(0.0)) for k in range(len(order))]
    frame = df.sparkSession.createDataFrame([(k, float(values[o]), float(values[o] / total)) for k, o in enumerate(order)], "component int, explainedVariance double, explainedVarianceRatio double")
    return Result(scalars=frame, series={"scores": (rows.select(*(key.order_by if key else ()), *(s.alias(f"pc{k}") for k, s in enumerate(score)), F.array(*score).alias("scores")), "scores")}, plain={"components": vectors.T.tolist(), "columns": columns})


_COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def rule_based_classification(df: DataFrame, key: SeriesKey | None, params: Params) -> Result:
    """The label of the first rule that holds; null never matches."""
    label = F.lit(None).cast("string")
    chain = None
    for r in params.get("rules") or []:
        if r["column"] not in df.columns:
            raise ValueError(f'unknown column "{r["column"]}"')
        test = F.coalesce(_COMPARE[r.get("operator", ">")](F.col(r["column"]), F.lit(r["value"])), F.lit(False))
        chain = F.when(test, r["label"]) if chain is None else chain.when(test, r["label"])
    default = params.get("defaultLabel", "unclassified")
    label = chain.otherwise(default) if chain is not None else F.lit(default)
    name = params.get("outputColumn", "_label")
    rows = df.withColumn(name, label)
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("count"))
    return Result(scalars=counts, series={"labeledRows": (rows, name), "distribution": (counts, "count"), "totalRows": (counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("totalRows")), "totalRows")}, plain={"outputColumn": name})


def anomaly_detect(df: DataFrame, key: SeriesKey, params: Params) -> Result:
    """(idx, value, score) of outliers: threshold, zscore, iqr, mad or ewma."""
    from .base import sample

    c, method = column_of(df, params, key), params.get("method", "threshold")
    parts = list(key.partition_by)
    rows = sample(df, key, c).select(*parts, INDEX, F.col(c).alias("value"))
    on = lambda stats: rows.join(stats, parts) if parts else rows.crossJoin(F.broadcast(stats))  # noqa: E731  one row of statistics
    v = F.col("value")
    if method == "zscore":
        limit = number(params, "sensitivity", 2.0)
        found = on(rows.groupBy(*parts).agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s")))
        score = F.when(F.col("s") > 0, F.abs(v - F.col("m")) / F.col("s"))
        found = found.withColumn("score", score).where(F.col("score") > limit)
    elif method == "iqr":
        k = number(params, "sensitivity", 1.5)
        if parts:
            ranks = at_ranks(rows.select(*parts, F.col("value").alias("v")), parts, [lambda n: F.floor(0.25 * n), lambda n: F.floor(0.75 * n)])
            found = on(ranks.groupBy(*parts).agg(F.max(F.when(F.col("r") == 0, F.col("v"))).alias("q1"), F.max(F.when(F.col("r") == 1, F.col("v"))).alias("q3")))
        else:
            q1, q3 = order_statistics(rows, ["value"], [0.25, 0.75], lambda s, n: math.floor(s * n))["value"]
            found = rows.withColumns({"q1": F.lit(q1).cast("double"), "q3": F.lit(q3).cast("double")})
        lo, hi = F.col("q1") - k * (F.col("q3") - F.col("q1")), F.col("q3") + k * (F.col("q3") - F.col("q1"))
        found = found.where((v < lo) | (v > hi)).withColumn("score", F.when(v < lo, lo - v).otherwise(v - hi))
    elif method == "mad":
        limit = number(params, "sensitivity", 3.5)
        if parts:
            med = joined(rows, _medians(rows, parts, "value", "med"), parts).withColumn("dev", F.abs(v - F.col("med")))
            found = joined(med, _medians(med, parts, "dev", "mad"), parts)
        else:
            med = rows.withColumn("dev", F.abs(v - F.lit(_median(rows, "value"))))
            found = med.withColumn("mad", F.lit(_median(med, "dev")).cast("double"))
        found = found.withColumn("score", F.when(F.col("mad") > 0, 0.6745 * F.col("dev") / F.col("mad"))).where(F.col("score") > limit)
    elif method == "ewma":
        from .timeseries import ema_frame

        limit = number(params, "sensitivity", 2.0)
        base = ema_frame(rows.withColumnRenamed("value", "x"), key, number(params, "alpha", 0.3)).withColumnRenamed("x", "value")
        dev = base.withColumn("dev", F.abs(F.col("value") - F.col("ema")))
        spread = dev.groupBy(*parts).agg(F.stddev_pop("dev").alias("s"))
        found = (dev.join(spread, parts) if parts else dev.crossJoin(F.broadcast(spread))).withColumn("score", F.when(F.col("s") > 0, F.col("dev") / F.col("s"))).where((F.col("s") > 0) & (F.col("dev") > limit * F.col("s")))
    else:
        threshold = number(params, "threshold")
        if threshold is None:
            raise ValueError("anomaly_detect threshold needs a threshold")
        found = rows.where(v > threshold).withColumn("score", v - threshold)
    found = found.select(*parts, INDEX, "value", "score")
    return Result(scalars=found.groupBy(*parts).agg(F.count(F.lit(1)).alias("count")), series={"anomalies": (found, "value")})


def _median(rows: DataFrame, column: str) -> float | None:
    a, b = order_statistics(rows, [column], [0.5, 0.5 + 1e-12], lambda s, n: (n - 1) // 2 if s == 0.5 else n // 2)[column]
    return None if a is None else (a + b) / 2


def _medians(rows: DataFrame, parts: list[str], column: str, name: str) -> DataFrame:
    """(parts, name): the mean of the two middle values of each series."""
    middle = at_ranks(rows.select(*parts, F.col(column).alias("v")), parts, [lambda n: F.floor((n - 1) / 2), lambda n: F.floor(n / 2)])
    return middle.groupBy(*parts).agg(F.avg("v").alias(name))


#: Upper bounds of zones A, B, C (rms, mm/s) by machine class.
ISO_LIMITS = {1: (0.71, 1.8, 4.5), 2: (1.12, 2.8, 7.1), 3: (1.8, 4.5, 11.2), 4: (2.8, 7.1, 18.0)}


def vibration_indicators(df: DataFrame, key: SeriesKey | None, params: Params) -> Result:
    c = F.col(params["column"]).cast("double")
    parts = list(key.partition_by) if key else []
    a, b, z = ISO_LIMITS.get(int(params.get("machineClass", 2)), ISO_LIMITS[2])
    s = df.where(c.isNotNull()).groupBy(*parts).agg(
        F.count(c).alias("n"), F.sqrt(F.avg(c * c)).alias("rms"), F.max(F.abs(c)).alias("peak"), (F.max(c) - F.min(c)).alias("peakToPeak"),
        F.when(F.var_pop(c) > 0, F.kurtosis(c) + 3).otherwise(0.0).alias("kurtosis"), F.when(F.var_pop(c) > 0, F.skewness(c)).otherwise(0.0).alias("skewness"),
    )
    zone = F.when(F.col("rms") <= a, "A").when(F.col("rms") <= b, "B").when(F.col("rms") <= z, "C").otherwise("D")
    return Result(scalars=s.where("n >= 4").select(*parts, "rms", "peak", "peakToPeak", _div(F.col("peak"), F.col("rms")).alias("crestFactor"), "kurtosis", "skewness", zone.alias("isoZone")), plain={"isoLimits": {"A": a, "B": b, "C": z}})


