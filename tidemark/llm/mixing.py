"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target in words (capped shares, ``targets``).  Whole epochs
of a source come first; the fraction that is left is drawn without
replacement: a document's key is an exponential variable divided by its
quality weight, documents are taken by ascending key while the running sum of
sizes is nearest to the rest.

A source may hold a third of all rows, so its order is made in two steps: keys
fall into slices of equal ratio, of which none holds more than about a third of
an octave's share whatever the weights are (a weight only moves the logarithm of
a key), slices are summed and those sums prefix-summed per source in two levels
(bands of slices, then the slices of a band), then rows are sorted within their
slice only.

Edge cases: null or empty texts have size 0 and weight 1.  A null source is a
source of its own, last in the order.  Null ids are drawn as the empty id; rows
with equal ids get equal keys, the tie goes by size.  Empty table: empty result.
``mix`` carries the columns of ``keep``, whose names mustn't start with ``mix_``;
``mixed_rows`` carries all, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Rows of a slice, about, at most (but for rows with one id, which share a key); one slice is sorted in one task.
SLICE_ROWS = 2048
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Words over words plus marks that running prose seldom has, in (0, 1]."""
    t = F.coalesce(text, F.lit(""))
    marks = F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>!", ""))
    return F.when(size > 0, size / (size + marks)).otherwise(F.lit(1.0))


def sample_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1] from 52 bits of an MD5 digest of seed and id: the same in every run and layout."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
    return -F.log(u) / weight


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``mix_target`` to (mix_none, mix_source, mix_source_size), one row per source.

    min(cap * size, level * weight) with the level at which all targets sum to ``share`` of all sizes: what
    repeated resharing of the excess comes to.  Sources ascend by cap * size / weight; the level is the first at
    which the next source isn't full.  Only per-source sums meet in one task.
    """
    everything = W.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy("mix_none", "mix_source")) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (place % len(weights) + 1).cast("int"))
    full = F.lit(float(cap)) * F.col("mix_source_size")
    by = everything.orderBy("mix_ratio", "mix_none", "mix_source")
    rows = sources.withColumn("mix_w", w).withColumn("mix_ratio", full / F.col("mix_w"))
    total = F.lit(float(share)) * F.sum("mix_source_size").over(everything)
    filled = F.coalesce(F.sum(full).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("mix_w").over(everything) - F.coalesce(F.sum("mix_w").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("mix_level", (total - filled) / rest)
    level = F.min(F.when(F.col("mix_ratio") >= F.col("mix_level"), F.struct("mix_ratio", "mix_none", "mix_source", "mix_level"))).over(everything)["mix_level"]
    return rows.withColumn("mix_target", F.when(level.isNull(), full).otherwise(F.least(full, level * F.col("mix_w")))).select("mix_none", "mix_source", "mix_source_size", "mix_target")


def mix(docs: DataFrame, keep: Sequence[str], seed: int = 17, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slim: bool = False) -> DataFrame:
    """The columns ``keep`` with mix_size, mix_source_size, mix_target and mix_times (how often the mix holds the row).

    ``slim``: the kept columns are small, so rows are written without their texts, which are then read once; else texts
    are read twice, for the sums of slices (which are written) and for the rows.
    """
    per_octave = max(1, docs.select(F.lit(1)).count() // (4 * SLICE_ROWS))
    size = size_of(F.col(text_col))
    sized = docs.select(
        *keep,
        F.col(source_col).isNull().alias("mix_none"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"),
        size.alias("mix_size"),
        sample_key(F.col(id_col), quality_weight(F.col(text_col), size), seed).alias("mix_key"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("mix_id"),
    ).withColumn("mix_slice", F.coalesce(F.floor(F.log2("mix_key") * per_octave), F.lit(-(1 << 62))).cast("long"))
    sized = written(sized, "mix-rows") if slim else sized
    source = ["mix_none", "mix_source"]
    slices = sized.groupBy(*source, "mix_slice").agg(F.sum("mix_size").alias("mix_sum"))
    slices = (slices if slim else written(slices, "mix-slices")).withColumn("mix_band", F.floor(F.col("mix_slice") / max(1, math.isqrt(per_octave))))
    bands = slices.groupBy(*source, "mix_band").agg(F.sum("mix_sum").alias("mix_total"))
    aims = targets(bands.groupBy(*source).agg(F.sum("mix_total").alias("mix_source_size")), weights, share, cap)
    before = lambda column, by, *parts: F.coalesce(F.sum(column).over(W.partitionBy(*source, *parts).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bands = bands.withColumn("mix_below", before("mix_total", "mix_band")).drop("mix_total").join(aims, source)
    slices = slices.withColumn("mix_within", before("mix_sum", "mix_slice", "mix_band")).drop("mix_sum").join(bands, [*source, "mix_band"])
    slices = slices.withColumn("mix_before", F.col("mix_below") + F.col("mix_within")).drop("mix_band", "mix_below", "mix_within")
    rows = sized.join(slices, [*source, "mix_slice"])
    within = W.partitionBy(*source, "mix_slice").orderBy("mix_key", "mix_id", "mix_size").rowsBetween(W.unboundedPreceding, W.currentRow)
    epochs = F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("mix_target") - F.col("mix_epochs") * F.col("mix_source_size")
    middle = 2 * (F.col("mix_before") + F.sum("mix_size").over(within)) - F.col("mix_size")
    return (
        rows.withColumn("mix_epochs", epochs)
        .withColumn("mix_times", F.col("mix_epochs") + F.when(middle <= 2 * left, F.lit(1)).otherwise(F.lit(0)))
        .select(*keep, "mix_size", "mix_source_size", "mix_target", "mix_times")
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns whatever their names, as often as it is taken."""
    columns = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("mix_row")
    whole = docs.select(row, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    out = mix(whole, ["mix_row"], **options)
    taken = out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("mix_times"), F.lit(1)).cast("int")))).where("mix_times > 0")
    return taken.select(*(F.col("mix_row").getField(c).alias(c) for c in columns))
