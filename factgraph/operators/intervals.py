"""Points in ranges as an equi-join: ranges lie in buckets as wide as they are long, about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bucket widths: each range takes the first that leaves it in few buckets, so it never lies in more than SPAN + 1.
WIDTHS, SPAN = [64 * 8**level for level in range(12)], 8


def points_in_ranges(points: DataFrame, ranges: DataFrame, on: list[str], point: str, low: str, high: str) -> DataFrame:
    """Each point with each range of equal `on` columns that holds it, low <= point <= high; both sides keep all their columns.

    A range lies in at most SPAN + 1 buckets of its own width, a point in one
    bucket of each width that occurs (at most len(WIDTHS)), and a pair meets in
    exactly one: rows grow with the input and the result, however many ranges
    one file has. Empty and null ranges hold nothing.
    """
    first, *rest = WIDTHS
    width = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        width = F.when(F.col(high) - F.col(low) < w * SPAN, F.lit(w)).otherwise(width)
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("_width", width.cast("long"))
    used = sorted(x[0] for x in r.select("_width").distinct().collect())
    bucket = lambda c: F.floor(F.col(c) / F.col("_width"))
    r = r.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    p = points.withColumn("_width", F.explode(F.array(*map(F.lit, used or [first])).cast("array<long>"))).withColumn("_bucket", bucket(point))
    return p.join(r, [*on, "_width", "_bucket"]).where(F.col(point).between(F.col(low), F.col(high))).drop("_width", "_bucket")
