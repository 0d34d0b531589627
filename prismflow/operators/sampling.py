"""Sampling of configurations that cover conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.functions import cond as C


def condition_coverage(conds: DataFrame, model: int = C.TRUE) -> DataFrame:
    """cond, config: for each distinct condition that the model allows one configuration in which it holds."""
    return conds.select("cond").distinct().withColumn("config", C.lowest(F.col("cond"), model)).where("config IS NOT NULL")


def code_coverage(conds: DataFrame, model: int = C.TRUE, existing: tuple[int, ...] = ()) -> list[int]:
    """Configurations that cover all conditions, ``existing`` ones counted: conditions in ascending order, each of which, if no
    chosen configuration covers it, adds the least that does. Conditions without a configuration are left out.

    The loop is on the driver, but over no more than the configurations: each turn asks Spark for the least condition that is not covered.
    """
    distinct = conds.select(F.col("cond").bitwiseAND(C.lit(model)).alias("allowed"), "cond").where("allowed <> 0").distinct().persist()
    chosen: list[int] = []
    try:
        while len(chosen) < C.CONFIGS:
            taken = sum(1 << c for c in {*chosen, *existing})
            first = distinct.where(F.col("cond").bitwiseAND(C.lit(taken)) == 0).agg(F.min(F.struct("cond", "allowed")).alias("m")).first()["m"]
            if first is None:
                break
            chosen.append((first["allowed"] & -first["allowed"]).bit_length() - 1)
    finally:
        distinct.unpersist()
    return chosen


def feature_names(conds: DataFrame) -> DataFrame:
    """feature: the features that any condition depends on, in falling order."""
    return conds.select("cond").distinct().select(F.explode(C.features_of(F.col("cond"))).alias("feature")).distinct().orderBy(F.desc("feature"))


def config_table(spark: SparkSession, configs: list[int] | None = None) -> DataFrame:
    """config, enabled, cond: configurations with the features they enable; all of them by default."""
    chosen = spark.range(C.CONFIGS).select(F.col("id").cast("int").alias("config"))
    if configs is not None:
        chosen = chosen.where(F.col("config").isin(*configs)) if configs else chosen.where(F.lit(False))
    return chosen.select("config", C.enabled(F.col("config")).alias("enabled"), C.of_config(F.col("config")).alias("cond"))
