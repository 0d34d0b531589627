"""Presence conditions over any number of features, as covers: a column of cubes of which one has to hold.

A cube is a sorted array of literals as in DIMACS: k stands for feature k (from 1), -k for its negation; all of them have to hold. The cover without cubes is False, that of the empty cube
True. Truth tables (``cond``) grow with 2^features; covers grow with the number of ways in which a condition can come about. All functions are column expressions;
only a feature model's clauses need a search (``allowed``).

Covers are kept sorted and without cubes that another one implies, so that equal covers are equal values. Conditions may be equivalent without that: see ``equivalent``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismflow.functions.sat import Formula

TYPE = "array<array<int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def lit(*cubes: list[int]) -> Column:
    """A cover of these cubes."""
    return F.array(*(F.array(*(F.lit(x) for x in sorted(set(c)))).cast("array<int>") for c in cubes)).cast(TYPE)


def true() -> Column:
    return lit([])


def false() -> Column:
    return lit()


def literal(x: Column) -> Column:
    """The cover of one literal, given as a number."""
    return F.array(F.array(x.cast("int")))


def negated(cube: Column) -> Column:
    return F.transform(cube, lambda x: -x)


def meet(a: Column, b: Column) -> Column:
    """The cube in which both cubes hold; null if they contradict each other."""
    return F.when(~F.arrays_overlap(a, negated(b)), F.array_sort(F.array_union(a, b)))


def implied(a: Column, b: Column) -> Column:
    """Whether cube a holds wherever cube b does."""
    return F.size(F.array_except(a, b)) == 0


def absorbed(cover: Column) -> Column:
    """The cover sorted, without the cubes that others imply. Only a smaller cube can imply another one, so that cubes of one size are only made distinct."""
    sizes = lambda own: F.transform(own, F.size)
    mixed = lambda own: F.filter(own, lambda x: ~F.exists(own, lambda y: (F.size(y) < F.size(x)) & implied(y, x)))
    return let(F.sort_array(F.array_distinct(cover)), lambda own: F.when(F.array_min(sizes(own)) < F.array_max(sizes(own)), mixed(own)).otherwise(own))


def both(a: Column, b: Column) -> Column:
    met = let(b, lambda own: F.flatten(F.transform(a, lambda x: F.transform(own, lambda y: meet(x, y)))))
    return absorbed(F.filter(met, lambda x: x.isNotNull()))


def either(a: Column, b: Column) -> Column:
    return absorbed(F.concat(a, b))


def any_of(cover: Column) -> Column:
    """Aggregate: where any row's cover holds. A group is as large as its number of distinct covers."""
    return absorbed(F.flatten(F.collect_set(cover)))


def outside(cube: Column, other: Column) -> Column:
    """Disjoint cubes that hold where ``cube`` does and ``other`` doesn't: one for each literal of ``other`` that is the first to fail."""
    def each(more: Column) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.size(more)), lambda i: F.array_sort(F.concat(cube, F.slice(more, F.lit(1), i - 1), F.array(-F.element_at(more, i)))))
        return F.when(F.size(more) == 0, false()).otherwise(own)

    return F.when(F.arrays_overlap(cube, negated(other)), F.array(cube)).otherwise(let(F.array_except(other, cube), each))


def minus(a: Column, b: Column) -> Column:
    """Where a holds and b doesn't."""
    return absorbed(F.aggregate(b, a, lambda out, y: F.flatten(F.transform(out, lambda x: outside(x, y)))))


def no(a: Column) -> Column:
    return minus(true(), a)


def disjoint(a: Column) -> Column:
    """The cover as cubes of which no two hold together."""
    return F.aggregate(a, false(), lambda out, x: F.concat(out, F.aggregate(out, F.array(x), lambda left, y: F.flatten(F.transform(left, lambda z: outside(z, y))))))


def satisfiable(a: Column) -> Column:
    return F.size(a) > 0


def implies(a: Column, b: Column) -> Column:
    return F.size(minus(a, b)) == 0


def tautology(a: Column) -> Column:
    return implies(true(), a)


def equivalent(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: implies(x["a"], x["b"]) & implies(x["b"], x["a"]))


def holds_in(a: Column, enabled: Column) -> Column:
    """Whether the condition holds in the configuration that enables exactly the features ``enabled`` (array of numbers)."""
    return F.exists(a, lambda cube: F.forall(cube, lambda x: F.array_contains(enabled, F.abs(x)) == (x > 0)))


def held_in(a: Column, configs: list[set[int]]) -> Column:
    """A mask of up to 64 configurations, each given as the features that it enables: bit i says whether the condition holds in the i-th. Each literal is looked up once, for all configurations."""
    if len(configs) > 64:
        raise ValueError("a mask has 64 bits")
    every, most = (1 << len(configs)) - 1, max((f for c in configs for f in c), default=0)
    signed = lambda mask: F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")
    on = [sum(1 << i for i, c in enumerate(configs) if f in c) for f in range(most + 1)]
    enabled, all_ = F.array(*map(signed, on)), signed(every)
    # A feature that no configuration enables is off.
    one = lambda x: let(F.coalesce(F.get(enabled, F.abs(x)), signed(0)), lambda m: F.when(x > 0, m).otherwise(all_.bitwiseAND(F.bitwise_not(m))))
    cube = lambda c: F.aggregate(c, all_, lambda m, x: m.bitwiseAND(one(x)))
    return F.aggregate(a, signed(0), lambda m, c: m.bitwiseOR(cube(c)))


def features_of(a: Column) -> Column:
    """The numbers of the features that the cover mentions."""
    return F.array_sort(F.array_distinct(F.transform(F.flatten(a), lambda x: F.abs(x))))


def allowed(rows: DataFrame, cover: str, clauses: list[list[int]]) -> DataFrame:
    """The rows with those cubes of column ``cover`` that some model of ``clauses`` (the feature model) has; rows that keep none go.

    Each distinct cube is looked at once.
    """
    cubes = rows.select(F.explode(cover).alias("cube")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Formula(clauses)
        for batch in batches:
            yield batch[[model.satisfiable(int(x) for x in c) for c in batch["cube"]]]

    good = cubes.mapInPandas(run, "cube array<int>")
    (row, own, kept) = (next(n for n in (f"{x}{'_' * k}" for k in range(99)) if n not in rows.columns) for x in ("row", "cube", "kept"))
    marked = rows.withColumn(row, F.struct(*rows.columns))
    met = marked.select(row, F.explode(cover).alias(own)).join(good.withColumnRenamed("cube", own), own)
    out = met.groupBy(row).agg(absorbed(F.collect_set(own)).alias(kept))
    return out.select(*(F.col(kept).alias(c) if c == cover else F.col(f"{row}.{c}").alias(c) for c in rows.columns))
