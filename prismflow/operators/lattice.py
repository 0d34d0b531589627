"""Least fixpoints over rows with values of a lattice of one's own, for problems whose facts carry more than a condition.

A problem brings the lattice (how values meet) and edge functions (what an edge makes of a value); conditions
with AND and OR are one such pair, and ``fixpoint`` is made for them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismflow.functions import cubes
from prismflow.operators.fixpoint import NotReached, dealt, saved


@dataclass(frozen=True)
class Lattice:
    """How values meet: ``all`` as an aggregate that ignores nulls, ``two`` of two columns. Both have to agree, whatever the order and repeats of values,
    and values may only get finitely better. A null value says nothing, and its row is left out."""

    all: Callable[[Column], Column]
    two: Callable[[Column, Column], Column]


LEAST = Lattice(F.min, F.least)
GREATEST = Lattice(F.max, F.greatest)
ANY = Lattice(F.bit_or, lambda a, b: a.bitwiseOR(b))
#: Conditions over any number of features (functions/cubes.py).
COVER = Lattice(cubes.any_of, cubes.either)


def fixpoint(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], lattice: Lattice, value: str = "value", most: int | None = None) -> DataFrame:
    """Rows ``keys`` with the meet ``value`` of all that ``step`` makes of ``seeds``, round after round.

    ``step(delta)`` gets the rows whose values have changed, with their new values. What changed is appended and checkpointed each
    round; the older rows are dealt by the keys and only moved again when twelve rounds have been appended.
    """
    base, parts, rounds = None, [], 0

    def changed(found: DataFrame) -> DataFrame:
        rows = found.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("now"), F.lit(None).cast(found.schema[value].dataType).alias("was"))
        for part in parts:
            rows = rows.unionByName(part.select(*keys, F.lit(None).cast(part.schema[value].dataType).alias("now"), F.col(value).alias("was")))
        rows = rows.groupBy(*keys).agg(lattice.all(F.col("now")).alias("now"), lattice.all(F.col("was")).alias("was")).where("now IS NOT NULL")
        if base is not None:
            rows = rows.join(base.withColumnRenamed(value, "old"), keys, "left")
            rows = rows.withColumn("was", F.when(F.col("was").isNull(), F.col("old")).when(F.col("old").isNull(), F.col("was")).otherwise(lattice.two(F.col("was"), F.col("old"))))
        best = F.when(F.col("was").isNull(), F.col("now")).otherwise(lattice.two(F.col("now"), F.col("was")))
        return rows.select(*keys, best.alias(value), "was").where(F.col("was").isNull() | (F.col(value) != F.col("was"))).drop("was")

    def every() -> DataFrame:
        rows = reduce(DataFrame.unionByName, parts) if base is None else reduce(DataFrame.unionByName, parts, base)
        return rows.groupBy(*keys).agg(lattice.all(F.col(value)).alias(value))

    delta = saved(changed(seeds))
    while not delta.isEmpty():
        if most is not None and rounds >= most:
            raise NotReached(f"no fixpoint after {most} rounds")
        rounds += 1
        parts.append(delta)
        if len(parts) > 12:
            base, parts = dealt(every(), *keys), []
        delta = saved(changed(step(delta)))
    return every() if parts or base is not None else delta


def reach(start: DataFrame, edges: DataFrame, lattice: Lattice, along: Callable[[Column, Column], Column]) -> DataFrame:
    """node, value: the meet over all paths from ``start`` (node, value); ``along`` gives the value behind an edge from the one before it
    and the edge's own. edges: src, dst, weight. ``along`` has to keep the order of values, so that the better one may stand for both."""
    edges = dealt(edges.groupBy("src", "dst").agg(lattice.all(F.col("weight")).alias("weight")), "src")

    def step(delta: DataFrame) -> DataFrame:
        met = delta.withColumnRenamed("node", "src").join(edges, "src")
        return met.select(F.col("dst").alias("node"), along(F.col("value"), F.col("weight")).alias("value"))

    return fixpoint(start.select("node", "value"), step, ["node"], lattice)
