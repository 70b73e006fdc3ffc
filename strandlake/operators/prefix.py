"""Running sums and maxima in parallel.

A window over a whole key puts a hot key in one task. Here a key's rows are cut into buckets that follow the
order: a window within (key, bucket), a window over one row a bucket, and an equi-join of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def score_buckets(df: DataFrame, column: str, buckets: int = 64) -> Column:
    """Bucket number by splits of about equal rows; equal values share a bucket. Order follows the column."""
    cuts = sorted(set(df.approxQuantile(column, [i / buckets for i in range(1, buckets)], 0.25 / buckets))) if buckets > 1 else []
    return sum((F.when(F.col(column) >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("long")


def running(df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column, values: dict[str, Column], how: str = "sum") -> DataFrame:
    """Adds, for each name in ``values``, the sum (0 at first) or maximum (null at first) over the rows strictly before.

    ``bucket`` must not decrease along ``order``.
    """
    out = df.withColumn(BUCKET, bucket)
    whole = {"sum": F.sum, "max": F.max}[how]
    names = list(values)
    held = out.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    parts = held.groupBy(*keys, BUCKET).agg(*[whole(f"_v_{n}").alias(f"_t_{n}") for n in names])
    over = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*keys, BUCKET, *[whole(f"_t_{n}").over(over).alias(f"_c_{n}") for n in names])
    here = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = held.select("*", *[whole(f"_v_{n}").over(here).alias(f"_l_{n}") for n in names])
    joined = local.join(carry, [*keys, BUCKET])
    zero = F.lit(0)
    add = (lambda n: F.coalesce(f"_l_{n}", zero) + F.coalesce(f"_c_{n}", zero)) if how == "sum" else (lambda n: F.greatest(f"_l_{n}", f"_c_{n}"))
    return joined.select(*df.columns, *[add(n).alias(n) for n in names])


def exact_quantiles(df: DataFrame, keys: list[str], column: str, fraction: Column | float, weight: str | None = None) -> DataFrame:
    """keys, n, value: the exact quantile of ``column`` by key, interpolated between the two values round the rank (n - 1) * fraction.

    Values are counted first and their counts run up bucket by bucket, so that no buffer or task holds a key's values. ``fraction`` may depend on
    the keys. Null and NaN are left out; a key without values has no row. ``weight``: a column of whole numbers, how often a row's value counts.
    """
    x = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).withColumn("_all", F.lit(0))
    by = [*keys, "_all"]
    counts = x.groupBy(*by, column).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("n"))
    ranked = running(counts, by, [column], score_buckets(counts, column), {"_before": F.col("_n")}).join(total, by)
    rank = (fraction if isinstance(fraction, Column) else F.lit(float(fraction))) * (F.col("n") - 1)
    low, high = F.floor(rank), F.ceil(rank)
    holds = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_n"))
    near = ranked.where(holds(low) | holds(high)).withColumn("_part", rank - low)
    found = near.groupBy(*by, "n").agg(F.max(F.when(holds(low), F.col(column))).alias("_low"), F.max(F.when(holds(high), F.col(column))).alias("_high"), F.max("_part").alias("_part"))
    return found.select(*keys, "n", (F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))).alias("value"))


def with_previous(df: DataFrame, keys: list[str], order: str, column: str, name: str) -> DataFrame:
    """Adds the value of ``column`` in the row before, by key and ``order``; null in a key's first row. Rows are looked at bucket by bucket of the order."""
    held = df.withColumn(BUCKET, score_buckets(df, order))
    last = held.groupBy(*keys, BUCKET).agg(F.max_by(F.struct(column), order).alias("_last"))
    carried = last.select(*keys, BUCKET, F.lag("_last").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("_carried"))
    here = Window.partitionBy(*keys, BUCKET).orderBy(order)
    local = held.withColumn("_row", F.row_number().over(here)).withColumn("_own", F.lag(column).over(here))
    same = [local[k].eqNullSafe(carried[k]) for k in [*keys, BUCKET]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = local.join(carried.withColumnRenamed("_carried", "_carried_value"), on)
    previous = F.when(F.col("_row") == 1, F.col("_carried_value")[column]).otherwise(F.col("_own"))
    return joined.select(*[local[c] for c in df.columns], previous.alias(name))
