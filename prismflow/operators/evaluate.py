"""Comparison of lifted results with those of single configurations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow.functions import cond as C
from prismflow.operators.fixpoint import saved


def per_configuration(configs: DataFrame, solve: Callable[[int], DataFrame]) -> DataFrame:
    """The results of all ``configs`` (config), each solved alone, with its number. At most one run per configuration."""
    out = None
    for row in configs.select("config").distinct().orderBy("config").toLocalIterator():
        own = solve(row["config"]).withColumn("config", F.lit(row["config"]))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no configurations")
    return out


def compare(lifted: DataFrame, sampled: DataFrame, configs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facts of single configurations that the lifted result lacks there, and lifted facts with n_matches, the number of configurations that have them.

    lifted: keys, cond. sampled: keys, config. A lifted fact that no configuration has gets 0. Facts match by ``keys``.
    """
    # One row for each fact, with all its configurations as bits: what moves are facts, not facts times configurations.
    bits = F.bit_or(C.of_config(F.col("config")))
    asked = configs.select("config").distinct().agg(F.coalesce(bits, C.lit(0)).alias("asked"))
    held = lifted.groupBy(*keys).agg(F.bit_or("cond").alias("held"))
    alone = sampled.groupBy(*keys).agg(bits.alias("alone"))
    gone = alone.join(held, keys, "left").join(F.broadcast(asked), F.lit(True)).withColumn("gone", F.col("alone").bitwiseAND(F.bitwise_not(F.coalesce("held", C.lit(0)).bitwiseAND(F.col("asked")))))
    missing = gone.select(*keys, F.explode(F.expr(f"filter(sequence(0, {C.CONFIGS - 1}), c -> (shiftright(gone, c) & 1) = 1)")).alias("config")).withColumn("config", F.col("config").cast(sampled.schema["config"].dataType))
    both = F.coalesce("alone", C.lit(0)).bitwiseAND(F.col("cond")).bitwiseAND(F.col("asked"))
    counted = lifted.select(*keys, "cond").join(alone, keys, "left").join(F.broadcast(asked), F.lit(True))
    return missing, counted.select(*keys, "cond", F.bit_count(both).cast("bigint").alias("n_matches"))


def sampled_against_lifted(lifted: DataFrame, solve: Callable[[int], DataFrame], configs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole comparison: solve each product of ``configs`` (config) for itself, and give what compare() gives and its summary() with the
    number of missing facts. ``configs`` come from sampling.code_coverage, sampling.condition_coverage or a stored table."""
    configs = saved(configs.select("config").distinct())
    missing, counted = compare(lifted, saved(per_configuration(configs, solve).select(*keys, "config")), configs, keys)
    lacking = missing.agg(F.count(F.lit(1)).alias("missing")).withColumn("k", F.lit(1))
    return missing, counted, summary(counted).withColumn("k", F.lit(1)).join(lacking, "k").drop("k")


def summary(counted: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """One row: total facts, how many any configuration has, integer percent, matches in total, most and least; and of ``times`` (seconds) sum, max, min."""
    out = counted.agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("n_matches") > 0).alias("covered"), F.coalesce(F.sum("n_matches"), F.lit(0)).alias("matches"), F.max("n_matches").alias("most"), F.min("n_matches").alias("least"))
    out = out.withColumn("percent", F.when(F.col("facts") > 0, F.expr("100 * covered DIV facts")))
    if times is not None:
        # Two tables of one row each.
        t = times.agg(F.sum("seconds").alias("seconds"), F.max("seconds").alias("slowest"), F.min("seconds").alias("fastest"))
        out = out.withColumn("k", F.lit(1)).join(t.withColumn("k", F.lit(1)), "k").drop("k")
    return out
