"""Order statistics of a few huge groups, and of all groups but one: by places in a sort over the cluster.

No state grows with a group: rows are sorted by range and numbered, and a quantile is a lookup of one or two places.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def placed(rows: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds place, from 0 in the order within ``by``, and size, the rows of the group. Equal rows stand in some order, the same on each reading.

    Rows are written once, sorted by range over the cluster; what is counted of each part and group is a few rows.
    """
    spark, keys = rows.sparkSession, [*by, *order]
    # ids count up within a part of the sort, so they are places there
    path = f"{shared_folder(spark)}/placed-{uuid.uuid4().hex}"
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else rows
    sorted_rows.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    dealt = spark.read.schema(sorted_rows.withColumn("_at", F.lit(0).cast("long")).schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    counts = dealt.groupBy("_part", *by).agg(F.min("_at").alias("_least"), F.count("*").alias("_c"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], (before - F.col("_least")).alias("_shift"), F.sum("_c").over(whole).alias("size"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return dealt.join(shifts, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"), "size")


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column a share): exact quantiles, interpolated linearly, of the non-null values of each group."""
    at = placed(rows.where(F.col(value).isNotNull()).select(by, value), [value], [by])

    def pick(share: float) -> Column:
        exact = F.lit(float(share)) * (F.col("size") - 1)
        low, part = F.floor(exact), exact - F.floor(exact)
        one, two = F.max(F.when(F.col("place") == low, F.col(value))), F.max(F.when(F.col("place") == low + 1, F.col(value)))
        rest = F.max(part)
        return F.when((rest > 0) & two.isNotNull(), one + (two - one) * rest).otherwise(one)

    return at.groupBy(by).agg(*[pick(share).alias(name) for name, share in shares.items()])


def others_median(items: DataFrame, group: str, value: str = "value") -> DataFrame:
    """(group, others): the exact median of all values outside each group, for any number of groups; null where there are none.

    The k-th of the others stands k places further for each value of the group that comes before it, and those are the values
    with no more than k others before them; so one sort of all values and one numbering a group serve all groups.
    """
    rows = placed(items.where(F.col(value).isNotNull()).select(group, value), [value])
    own = Window.partitionBy(group)
    ahead = F.col("place") - (F.row_number().over(own.orderBy("place")) - 1)
    rest = F.col("size") - F.count("*").over(own)
    found = rows.withColumns({"ahead": ahead, "rest": rest})
    names = items.select(group).distinct()
    per = found.groupBy(group).agg(
        F.max("rest").alias("rest"), *[F.sum((F.col("ahead") <= k).cast("long")).alias(n) for n, k in (("a", F.floor((F.col("rest") - 1) / 2)), ("b", F.floor(F.col("rest") / 2)))]
    )
    size = rows.agg(F.max("size").alias("every"))
    # a group without a value has all others
    both = names.join(per.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "rest", "a", "b").join(size, F.lit(True))
    both = both.select(group, F.coalesce("rest", "every").alias("rest"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    wanted = both.select(group, F.explode(F.array(F.floor((F.col("rest") - 1) / 2) + F.col("a"), F.floor(F.col("rest") / 2) + F.col("b"))).alias("place"), "rest").where("rest > 0")
    picked = wanted.join(rows.select("place", value), "place").groupBy(group).agg(F.avg(value).alias("others"))
    return names.join(picked.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "others")


__all__ = ["others_median", "placed", "quantiles"]
