"""Sets whose elements are there under conditions: tables (key ..., cond) with one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismflow.functions import cond as C


def keys_of(s: DataFrame) -> list[str]:
    return [c for c in s.columns if c != "cond"]


def normal(s: DataFrame) -> DataFrame:
    return s.groupBy(*keys_of(s)).agg(F.bit_or("cond").alias("cond")).where("cond <> 0")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return normal(a.unionByName(b))


def restricted(s: DataFrame, cond: Column) -> DataFrame:
    """The set in configurations of ``cond`` only."""
    return s.withColumn("cond", F.col("cond").bitwiseAND(cond)).where("cond <> 0")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elements of a where b doesn't have them."""
    other = b.select(*keys_of(a), F.col("cond").alias("other"))
    return a.join(other, keys_of(a), "left").withColumn("cond", F.col("cond").bitwiseAND(C.no(F.coalesce("other", F.lit(0).cast("bigint"))))).drop("other").where("cond <> 0")


def partition(s: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    return s.where(test), s.where(~F.coalesce(test, F.lit(False)))


def get(s: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` keys with their conditions; False for those the set doesn't have."""
    return wanted.join(s, keys_of(s), "left").withColumn("cond", F.coalesce("cond", F.lit(0).cast("bigint")))


def contains(s: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(s, keys_of(s), "left_semi")


def plain(s: DataFrame) -> DataFrame:
    """The elements, whatever their conditions."""
    return s.select(*keys_of(s)).distinct()


def options(s: DataFrame) -> DataFrame:
    """All elements as one row of options, in order of their keys."""
    return s.agg(F.array_sort(F.collect_list(F.struct(*keys_of(s), "cond"))).alias("options"))


def product(s: DataFrame, config: Column | int) -> DataFrame:
    """What one configuration has of the set."""
    return s.where(C.holds_in(F.col("cond"), config)).select(*keys_of(s))
