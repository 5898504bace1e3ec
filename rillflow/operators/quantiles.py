"""Exact quantiles by selection, without sorting a group or holding its values.

A rank is narrowed down: the values of a range fall into buckets of equal width, buckets are
counted with their least and greatest values (combined before they are shuffled, so that a
group sends at most ``BUCKETS`` rows from each task), and the bucket that holds the rank is
the next range. Once a range has at most ``FEW`` rows, or one value only, it is sorted. So
memory is bounded however many rows a group has and however they are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, settled

BUCKETS = 1024
#: Rows of a range that are sorted by one task.
FEW = 20_000


def quantiles(rows: DataFrame, keys: Sequence[str], value: Column, at: Sequence[float], few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(*keys, q0, q1, ...): for each of ``at`` the quantile of a group's values, between two of them by linear interpolation.

    Nulls and NaN count for nothing; a group without values has no row. Null keys are a group.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    held = settled(rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), value.cast("double").alias("_v")).where("_v is not null and not isnan(_v)"))
    whole = held.groupBy(*names).agg(F.count("*").alias("n"), F.min("_v").alias("a"), F.max("_v").alias("z"))
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    wanted = F.array(*(F.struct(F.lit(i).alias("nth"), F.lit(up).alias("up"), (F.floor(place(q)) + (F.ceil(place(q)) - F.floor(place(q))) * up).cast("long").alias("rank")) for i, q in enumerate(at) for up in (0, 1)))
    ranks = whole.select(*names, "n", "a", "z", F.explode(wanted).alias("r"))
    # ranks of one group that lie in one range are narrowed together; ``rank`` counts from the range's first row
    state = settled(ranks.select(*names, "n", "a", "z", F.col("n").alias("inside"), "r.nth", "r.up", "r.rank", F.lit(0).cast("long").alias("below")))
    wide = (F.col("inside") > few) & (F.col("a") < F.col("z"))
    while state.where(wide).limit(1).count():
        ranges = state.where(wide).select(*names, "a", "z").distinct()
        met = held.alias("h").join(ranges.alias("r"), [*(F.col(f"h.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names), F.col("_v") >= F.col("a"), F.col("_v") <= F.col("z")])
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("_v") / 2 - F.col("a") / 2) / (F.col("z") / 2 - F.col("a") / 2) * buckets)).cast("int")
        counted = met.groupBy(*(F.col(f"r.{n}").alias(n) for n in names), "a", "z", bucket.alias("bucket")).agg(F.count("*").alias("m"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.sum("m").over(W.partitionBy(*names, "a", "z").orderBy("bucket"))
        edges = counted.withColumn("first", upto - F.col("m")).withColumn("next", upto)
        old = state.where(wide)
        found = old.alias("s").join(edges.alias("e"), [*(F.col(f"s.{n}").eqNullSafe(F.col(f"e.{n}")) for n in names), F.col("s.a") == F.col("e.a"), F.col("s.z") == F.col("e.z"), F.col("rank") - F.col("below") >= F.col("first"), F.col("rank") - F.col("below") < F.col("next")])
        narrowed = found.select(*(F.col(f"s.{n}").alias(n) for n in names), "s.n", F.col("low").alias("a"), F.col("high").alias("z"), F.col("m").alias("inside"), "s.nth", "s.up", "s.rank", (F.col("below") + F.col("first")).alias("below"))
        before, state = state, settled(state.where(~wide).unionByName(narrowed))
        discard(before)
    ranges = state.select(*names, "a", "z").distinct()
    met = held.alias("h").join(ranges.where("a < z").alias("r"), [*(F.col(f"h.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names), F.col("_v") >= F.col("a"), F.col("_v") <= F.col("z")])
    ordered = met.select(*(F.col(f"r.{n}").alias(n) for n in names), "a", "z", "_v").withColumn("at", F.row_number().over(W.partitionBy(*names, "a", "z").orderBy("_v")) - 1)
    picked = state.alias("s").join(ordered.alias("o"), [*(F.col(f"s.{n}").eqNullSafe(F.col(f"o.{n}")) for n in names), F.col("s.a") == F.col("o.a"), F.col("s.z") == F.col("o.z"), F.col("rank") - F.col("below") == F.col("at")], "left")
    values = picked.select(*(F.col(f"s.{n}").alias(n) for n in names), "s.n", "s.nth", "s.up", F.coalesce("_v", "s.a").alias("v"))
    one = lambda i, up: F.max(F.when((F.col("nth") == i) & (F.col("up") == up), F.col("v")))
    part = lambda q: F.max(place(q)) - F.floor(F.max(place(q)))
    between = [(one(i, 0) * (1 - part(q)) + one(i, 1) * part(q)).alias(f"q{i}") for i, q in enumerate(at)]
    return values.groupBy(*names).agg(*between).select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), *(f"q{i}" for i in range(len(at))))
