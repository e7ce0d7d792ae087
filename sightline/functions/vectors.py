"""Vectors and histograms as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column, width: int | None = None) -> Column:
    """With a known width the sum is unrolled and stays in generated code."""
    if width is None:
        return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    out = F.lit(0.0)
    for i in range(width):
        out = out + a[i].cast("double") * b[i].cast("double")
    return out


def cosine(a: Column, b: Column, width: int | None = None) -> Column:
    """Dot product of unit vectors, clamped; 0 when empty or of different lengths."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(same, F.least(F.greatest(dot(a, b, width), F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def normalise(v: Column) -> Column:
    return F.element_at(F.transform(F.array(v), lambda a: F.transform(a, lambda x: x / F.greatest(F.sqrt(total(F.transform(a, lambda y: y * y))), F.lit(1e-8)))), 1)


def chi_square(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: F.when(x + y > 1e-6, (x - y) * (x - y) / (x + y)).otherwise(0.0))
    return F.least(F.greatest(0.5 * total(terms), F.lit(0.0)), F.lit(1.0))


def intersection(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.least(x, y)))


def ssim(a: Column, b: Column) -> Column:
    """Global structural similarity of two signals, clamped to 0..1."""
    n = F.size(a).cast("double")
    m1, m2 = total(a) / n, total(b) / n
    v1 = total(F.transform(a, lambda x: x * x)) / n - m1 * m1
    v2 = total(F.transform(b, lambda x: x * x)) / n - m2 * m2
    cov = total(F.zip_with(a, b, lambda x, y: x * y)) / n - m1 * m2
    value = ((2 * m1 * m2 + 0.0001) * (2 * cov + 0.0009)) / ((m1 * m1 + m2 * m2 + 0.0001) * (v1 + v2 + 0.0009))
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def mean_absolute_difference(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def relative_change(a: Column, b: Column) -> Column:
    return F.abs(b - a) / F.greatest(F.lit(0.01), a, b)


def long_form(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, i, x: a row for each component."""
    return vectors.select(*keys, F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def weighted_centroids(vectors: DataFrame, key: str, vector: str, quality: str, floor: float = 0.05) -> DataFrame:
    """key, i, x: unit centroids of each key's vectors, weighted by quality but by floor at least; in long form, so that sums are partial."""
    q = F.greatest(F.lit(floor), F.coalesce(F.col(quality), F.lit(1.0)))
    parts = vectors.select(key, q.alias("q"), F.posexplode(vector).alias("i", "x"))
    sums = parts.groupBy(key, "i").agg(F.sum(F.col("x").cast("double") * F.col("q")).alias("s"))
    norms = sums.groupBy(key).agg(F.greatest(F.sqrt(F.sum(F.col("s") * F.col("s"))), F.lit(1e-8)).alias("norm"))
    return sums.join(norms, key).select(key, "i", (F.col("s") / F.col("norm")).alias("x"))


def profiles(vectors: DataFrame, key: str, vector: str, quality: str, order: str) -> DataFrame:
    """key, members, mean_quality, best, average, weighted, variance of each key's vectors. best is the first of highest quality by order;
    the variance is the population's around the unit average."""
    base = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("members"), F.avg(quality).alias("mean_quality"), F.max_by(doubles(F.col(vector)), F.struct(F.col(quality), -F.col(order))).alias("best"))
    plain = weighted_centroids(vectors.withColumn("_one", F.lit(1.0)), key, vector, "_one")
    pack = lambda df, name: df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(name))
    parts = long_form(vectors, [key], vector).join(plain.withColumnRenamed("x", "mean"), [key, "i"])
    variance = parts.groupBy(key, "i").agg(F.avg((F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))).alias("x"))
    return base.join(pack(plain, "average"), key).join(pack(weighted_centroids(vectors, key, vector, quality), "weighted"), key).join(pack(variance, "variance"), key)


def profile_similarity(best_a: Column, weighted_a: Column, best_b: Column, weighted_b: Column) -> Column:
    value = 0.6 * cosine(weighted_a, weighted_b) + 0.2 * cosine(best_a, best_b) + 0.1 * cosine(best_a, weighted_b) + 0.1 * cosine(best_b, weighted_a)
    return F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0))
