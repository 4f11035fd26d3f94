"""Train-only scalers and array-valued series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def robust_fit(train: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and interquartile range by floor index per group of training rows; a range of 0 becomes 1.

    Ranks come from counts of equal values, so that a group is never gathered in one task: values are counted, running
    counts are taken per group over distinct values.
    """
    from pyspark.sql.window import Window

    c = train.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*by).orderBy("_v")
    c = c.withColumn("_upto", F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_k").over(Window.partitionBy(*by)))
    at = lambda q: F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * q), F.col("_v")))
    g = c.groupBy(*by).agg(at(0.25).alias("q25"), at(0.5).alias("center"), at(0.75).alias("q75"), F.max("_n").alias("n"))
    iqr = F.col("q75") - F.col("q25")
    return g.select(*by, "n", "center", F.when(iqr == 0, 1.0).otherwise(iqr).alias("scale"))


def robust_scale(df: DataFrame, fitted: DataFrame, by: list[str], value: str, clamp: float = 20.0) -> DataFrame:
    """clip((x - center) / scale); groups that were not fitted give null."""
    x = (F.col(value) - F.col("center")) / F.col("scale")
    return df.join(fitted.select(*by, "center", "scale"), by, "left").withColumn("scaled", F.when(x.isNotNull(), F.greatest(F.lit(-clamp), F.least(F.lit(clamp), x)))).drop("center", "scale")


def standard_fit(train: DataFrame, value: str, weight: str) -> DataFrame:
    """Mean and sample deviation with repeats as weights, from three sums; a variance below 0 is 0."""
    w, x = F.col(weight).cast("double"), F.col(value).cast("double")
    s = train.where(x.isNotNull()).agg(F.sum(w).alias("n"), F.sum(w * x).alias("s"), F.sum(w * x * x).alias("ss"))
    var = F.greatest(F.lit(0.0), F.try_divide(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1))
    return s.select("n", (F.col("s") / F.col("n")).alias("center"), F.sqrt(var).alias("scale"))


def zscore(a: Column) -> Column:
    """(x - mean) / max(population deviation, 1e-8) of an array.

    Mean and deviation are bound once, as lambda variables of one-element arrays; inside the element lambda they would
    be computed again for every element.
    """
    n = F.nullif(F.size(a), F.lit(0))
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    centred = F.element_at(F.transform(F.array(mean), lambda m: F.transform(a, lambda x: x.cast("double") - m)), 1)
    sd = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) / n)
    both = F.transform(F.array(centred), lambda c: F.struct(c.alias("c"), F.greatest(sd(c), F.lit(1e-8)).alias("d")))
    return F.element_at(F.transform(both, lambda e: F.transform(e["c"], lambda x: x / e["d"])), 1)


def crop_query(a: Column, k: int) -> Column:
    return F.slice(a, k + 1, F.greatest(F.lit(0), F.size(a) - k))


def crop_target(a: Column, k: int) -> Column:
    return F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - k))


def geometry(kernels: list[int], strides: list[int]) -> list[Column]:
    """Total stride and receptive field of a stack of convolutions, folded over its layers."""
    layers = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(s).cast("long").alias("s")) for k, s in zip(kernels, strides)])
    start = F.struct(F.lit(1).cast("long").alias("stride"), F.lit(1).cast("long").alias("field"))
    out = F.aggregate(layers, start, lambda a, x: F.struct((a["stride"] * x["s"]).alias("stride"), (a["field"] + (x["k"] - 1) * a["stride"]).alias("field")))
    return [out["stride"].alias("stride"), out["field"].alias("field")]


def frame_offsets(start: Column, stop: Column, n: Column, rate: Column, stride: int, field: int) -> Column:
    """Array of (start_sec, stop_sec) of frames, the last clipped to the end of the block."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((start + i * stride / rate).alias("start_sec"), F.least(stop, start + (i * stride + field) / rate).alias("stop_sec")))


def interpolate(a: Column, n: int, align_corners: bool = False) -> Column:
    """Linear interpolation of an array to n points; with ``align_corners`` the end points are kept, else centres are matched."""
    size = F.size(a)

    def point(i: Column) -> Column:
        x = i * (size - 1) / F.lit(float(max(1, n - 1))) if align_corners else F.greatest(F.lit(0.0), (i + 0.5) * size / F.lit(float(n)) - 0.5)
        lo = F.least(F.floor(x).cast("int"), size - 1)
        hi = F.least(lo + 1, size - 1)
        f = x - lo
        return F.element_at(a, lo + 1) * (1 - f) + F.element_at(a, hi + 1) * f

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point))


def envelope(a: Column, width: int) -> Column:
    """Square, box filter of full width with zero edges, square root."""
    size = F.size(a)
    back = (width - 1) // 2  # the centred part of the full convolution
    # running sums of squares, bound once: each point is a difference of two, whatever the width
    empty = F.array(F.lit(0.0))
    sums = F.aggregate(a, empty, lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x.cast("double") * x.cast("double"))))
    at = lambda s, i: F.element_at(s, i + 1)
    total = lambda s, i: at(s, F.least(size, i + back + 1)) - at(s, F.greatest(F.lit(0), i - (width - 1 - back)))
    points = F.transform(F.array(sums), lambda s: F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.sqrt(F.greatest(F.lit(0.0), total(s, i)) / width)))
    return F.when(size > 0, F.element_at(points, 1))


def standardize(a: Column) -> Column:
    """Values minus their mean, divided by the population deviation where that is above 1e-8."""
    n = F.nullif(F.size(a), F.lit(0))
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    centred = F.element_at(F.transform(F.array(mean), lambda m: F.transform(a, lambda x: x.cast("double") - m)), 1)
    both = F.transform(F.array(centred), lambda c: F.struct(c.alias("c"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) / n).alias("d")))
    return F.element_at(F.transform(both, lambda e: F.transform(e["c"], lambda x: F.when(e["d"] > 1e-8, x / e["d"]).otherwise(x))), 1)


def centred(a: Column) -> Column:
    """Values minus their mean."""
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.nullif(F.size(a), F.lit(0))
    return F.element_at(F.transform(F.array(mean), lambda m: F.transform(a, lambda x: x.cast("double") - m)), 1)


def time_pool(matrix: Column) -> Column:
    """Mean over time of each channel of an array of channels."""
    return F.transform(matrix, lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.nullif(F.size(c), F.lit(0)))


def layer_mean(layers: Column, selected: list[int]) -> Column:
    """Element-wise mean of the selected layers of an array of arrays; a negative index counts from the end."""
    at = [F.element_at(layers, i + 1 if i >= 0 else i) for i in selected]
    total = at[0]
    for x in at[1:]:
        total = F.zip_with(total, x, lambda a, b: a + b)
    return F.transform(total, lambda v: v / F.lit(float(len(selected))))


def overlap_mean(spans: DataFrame, frames: DataFrame, key: str, cell: float, strict: bool = False) -> DataFrame:
    """(key, span, n, vector): mean, dimension by dimension, of the frames of the same key that overlap each span.

    ``spans``: key, span (its id), a, z; ``frames``: key, start, stop, vector. A frame overlaps if it starts before ``z`` and stops
    after ``a``. A span without a frame is left out, or raises if ``strict``. Spans and frames meet in cells of ``cell``; a
    pair counts in the first cell that both are in. Characters and tokens are spans and frames of unit steps.
    """
    first = lambda c: F.floor(F.col(c) / cell)
    a = spans.select(key, "span", "a", "z").withColumn("_cell", F.explode(F.sequence(first("a"), first("z"))))
    b = frames.select(key, "start", "stop", "vector").withColumn("_cell", F.explode(F.sequence(first("start"), first("stop"))))
    x = a.join(b, [key, "_cell"]).where((F.col("start") < F.col("z")) & (F.col("stop") > F.col("a")) & (F.col("_cell") == F.greatest(first("a"), first("start"))))
    if strict:
        bare = spans.select(key, "span").join(x.select(key, "span"), [key, "span"], "left_anti").orderBy(key, "span").first()
        if bare:
            raise ValueError(f"no frame overlaps span {bare['span']} of {bare[key]}")
    per = x.select(key, "span", F.posexplode("vector").alias("_d", "_v")).groupBy(key, "span", "_d").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_v").cast("double")).alias("_m"))
    return per.groupBy(key, "span").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda e: e["_m"]).alias("vector"))  # as many as dimensions
