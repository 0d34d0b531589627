"""Flow functions as transforms of a table with a fact column ``d``, and ways to combine them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Flow = Callable[[DataFrame], DataFrame]


def _same(steps: DataFrame) -> DataFrame:
    return steps


def identity() -> Flow:
    return _same


def kill(value: Column) -> Flow:
    """The fact goes; all others stay."""
    return lambda steps: steps.where(~F.col("d").eqNullSafe(value))


def kill_all() -> Flow:
    return lambda steps: steps.where(F.lit(False))


def gen(value: Column, zero: Column) -> Flow:
    """Zero makes a fact beside itself."""
    return lambda steps: steps.unionByName(steps.where(F.col("d").eqNullSafe(zero)).withColumn("d", value))


def transfer(to: Column, source: Column) -> Flow:
    """A fact makes another one, which no longer holds by itself."""
    return lambda steps: steps.where(~F.col("d").eqNullSafe(to)).unionByName(steps.where(F.col("d").eqNullSafe(source)).withColumn("d", to))


def compose(*flows: Flow) -> Flow:
    """One after another."""
    return lambda steps: reduce(lambda df, flow: flow(df), flows, steps)


def union(*flows: Flow) -> Flow:
    """All of what any gives. Identities among them are left out, so that a fact which another flow kills is gone; with nothing else, identity."""
    others = [flow for flow in flows if flow is not _same]
    return (lambda steps: reduce(DataFrame.unionByName, [flow(steps) for flow in others]).distinct()) if others else _same


def with_zero(flow: Flow, zero: Column) -> Flow:
    """Zero stays, whatever the flow does to it."""
    return lambda steps: flow(steps).where(~F.col("d").eqNullSafe(zero)).unionByName(steps.where(F.col("d").eqNullSafe(zero)))


def by_kind(kind: Column, flows: dict[str, Flow]) -> Flow:
    """A flow for each kind of fact; facts of other kinds go."""
    return lambda steps: reduce(DataFrame.unionByName, [flow(steps.where(kind == k)) for k, flow in flows.items()])
