"""Vector arithmetic on array columns, and media windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2_normalize(a: Column) -> Column:
    """A zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n)).otherwise(a.cast("array<double>"))


def truncate(a: Column, dimensions: int) -> Column:
    """The first dimensions, padded with zeros, normalised again."""
    head = F.slice(a.cast("array<double>"), 1, dimensions)
    return l2_normalize(F.concat(head, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(dimensions) - F.size(head)))))


def similarity_from_distance(distance: Column) -> Column:
    """Cosine of unit vectors at an L2 distance."""
    return 1 - distance * distance / 2


def media_windows(duration: Column, window: float = 30.0, overlap: float = 5.0, most: int = 400) -> Column:
    """Overlapping windows (start, end) that cover a duration; none for a duration of nothing."""
    window = max(1.0, window)
    stride = window - min(max(0.0, overlap), window - 1.0)
    count = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil((duration - window) / stride).cast("int") + 1))
    spans = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * stride).alias("start"), F.least(duration, i * stride + window).alias("end")))
    return F.when(duration > 0, spans).otherwise(F.array().cast("array<struct<start:double,end:double>>"))


def video_samples(duration: Column, samples: int = 8) -> Column:
    """Equal parts of a duration."""
    step = duration / samples
    spans = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.struct((i * step).alias("start"), F.least(duration, (i + 1) * step).alias("end")))
    return F.when(duration > 0, spans).otherwise(F.array().cast("array<struct<start:double,end:double>>"))
