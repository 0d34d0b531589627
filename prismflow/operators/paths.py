"""Shortest valid paths of a solved problem: how few steps lead from an entry to a fact at a statement, calls matched with their returns.

A step goes to a successor, into a called method, or from an exit to what follows the call that is open. Within a method, steps are counted
from its start and the fact that holds there, as jump functions ``x + k`` over path edges; a call that comes back adds what its method
takes, by the same counts. Then calls hand on how far their methods' starts are from the entries.

Configurations that no condition of the program tells apart have the same paths. Rows are per class of such configurations (``alike``), of which there
are as many as the program needs and not one for each configuration.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow.functions import cond as C
from prismflow.operators import lattice
from prismflow.operators.fixpoint import dealt, saved
from prismflow.operators.solver import Solver

#: Configurations of a mask.
CONFIGS = 32


def alike(masks: DataFrame, model: int = C.TRUE) -> list[int]:
    """Classes of configurations that none of ``masks`` (cond) tells apart, as disjoint masks whose union is ``model``; 32 at most. Null masks say nothing."""
    side = lambda c: F.bit_and(F.when(C.holds_in(F.col("cond"), c), F.col("cond")).otherwise(C.no(F.col("cond"))))
    row = masks.where("cond IS NOT NULL").select("cond").distinct().agg(*(side(c).alias(f"c{c}") for c in range(CONFIGS))).first()
    return sorted({(C.TRUE if row[c] is None else row[c]) & model for c in range(CONFIGS) if model >> c & 1})


class Paths:
    """Lengths of valid paths over the path edges (d1, n, d2, cond) that ``solver`` has found. Entries have to be starts of methods."""

    def __init__(self, solver: Solver, edges: DataFrame):
        self.solver, self.edges = solver, edges
        stmt = solver.stmt
        masks = solver.node.select(F.col("pc").alias("cond")).unionByName(stmt.select(F.explode("succs.e").alias("cond")))
        self.classes = alike(masks.unionByName(stmt.select(F.explode("callees.k").alias("cond"))), solver.options.model)
        steps = saved(solver.exploded_edges(edges))
        own = lambda kind: steps.where(F.col("kind") == kind).select("n", "d", "m", F.col("d2").alias("to"), F.col("cond").alias("k"))
        #: n, d, m, to, k: within a method, and into a called one's start.
        self.intra, self.inter = dealt(own("intra"), "n", "d"), saved(own("inter"))
        #: n, d, f, x, dx, m, to, k: a call at n with d passes f to a start, from where dx at exit x comes back as ``to`` at m.
        self.returns = dealt(self._returns(), "n", "d") if solver.has_calls else None

    def _returns(self) -> DataFrame:
        solver, zero = self.solver, self.solver.problem.zero()
        held = self.edges.groupBy("n", "d2").agg(F.bit_or("cond").alias("cond")).select(zero.alias("d1"), "n", "d2", "cond")
        called = saved(solver._called(held).select("n", F.col("d4").alias("d"), "start", "d1", "cond"))
        met = called.join(solver.ends(self.edges), ["start", "d1"]).withColumn("back", F.col("cond").bitwiseAND(F.col("end_cond"))).where("back <> 0")
        met = met.select("n", "d", F.col("d1").alias("f"), "x", "x_s", "d2", "back").join(solver.sites.select("n", "s", "succs"), "n").where("succs IS NOT NULL")
        flat = met.select("n", "d", "f", "x", F.col("d2").alias("dx"), F.explode("succs").alias("e"), solver._given_back.alias("targets"), "back")
        flat = flat.select("n", "d", "f", "x", "dx", F.col("e.m").alias("m"), F.explode("targets").alias("to"), F.col("back").bitwiseAND(F.col("e.e")).alias("k"))
        return saved(flat).where("k <> 0").groupBy("n", "d", "f", "x", "dx", "m", "to").agg(F.bit_or("k").alias("k"))

    def _by_class(self, df: DataFrame) -> DataFrame:
        """A row for each class of configurations in ``cond``, with the class as ``cond``."""
        every = F.array(*map(C.lit, self.classes))
        return df.withColumn("cond", F.explode(F.filter(every, lambda k: k.bitwiseAND(F.col("cond")) != 0)))

    def lengths(self) -> DataFrame:
        """cond, d1, n, d2, value: steps from d1 at the start of n's method to d2 at n, the fewest."""
        node, zero = self.solver.node, self.solver.problem.zero()
        starts = self.edges.where(F.col("d1") == F.col("d2")).join(node.where("is_start").select("n"), "n", "left_semi").select("cond", "d1", "n", "d2")
        given = self.solver.seeds.join(node.select("n", F.col("pc").bitwiseAND(C.lit(self.solver.options.model)).alias("cond")), "n").select("cond", zero.alias("d1"), "n", F.col("d").alias("d2"))
        seeds = self._by_class(starts.unionByName(given)).withColumn("value", F.lit(0).cast("bigint"))
        turns = node.where("is_call OR is_exit").select("n")
        earlier: list[DataFrame] = []
        both = F.col("cond").bitwiseAND(F.col("k")) != 0

        def over_calls(outer: DataFrame, inner: DataFrame) -> DataFrame:
            before = outer.select("cond", F.col("d1").alias("d0"), "n", F.col("d2").alias("d"), F.col("value").alias("before"))
            inside = inner.select("cond", F.col("d1").alias("f"), F.col("n").alias("x"), F.col("d2").alias("dx"), F.col("value").alias("inside"))
            met = before.join(self.returns, ["n", "d"]).where(both).join(inside, ["cond", "f", "x", "dx"])
            return met.select("cond", F.col("d0").alias("d1"), F.col("m").alias("n"), F.col("to").alias("d2"), (F.col("before") + F.col("inside") + 2).alias("value"))

        def step(delta: DataFrame) -> DataFrame:
            out = delta.withColumnRenamed("d2", "d").join(self.intra, ["n", "d"]).where(both).select("cond", "d1", F.col("m").alias("n"), F.col("to").alias("d2"), (F.col("value") + 1).alias("value"))
            if self.returns is None:
                return out
            new = saved(delta.join(turns, "n", "left_semi").select("cond", "d1", "n", "d2", "value"))
            # New callers meet all lengths of methods, earlier callers the new ones; a length that has got shorter since only gives longer ways.
            before = reduce(DataFrame.unionByName, earlier) if earlier else None
            out = out.unionByName(over_calls(new, new if before is None else before.unionByName(new)))
            if before is not None:
                out = out.unionByName(over_calls(before, new))
            earlier.append(new)
            if len(earlier) > 4:
                earlier[:] = [saved(reduce(DataFrame.unionByName, earlier).groupBy("cond", "d1", "n", "d2").agg(F.min("value").alias("value")))]
            return out

        return lattice.fixpoint(seeds, step, ["cond", "d1", "n", "d2"], lattice.LEAST)

    def entered(self, lengths: DataFrame) -> DataFrame:
        """cond, method, d1, value: steps from an entry to the start of a method with d1, the fewest, whatever calls are open."""
        owner = self.solver.node.select("n", "method")
        seeds = self.solver.seeds.select("n").distinct().join(self.solver.node.select("n", "method", F.col("pc").bitwiseAND(C.lit(self.solver.options.model)).alias("cond")), "n")
        seeds = self._by_class(seeds.select("cond", "method", self.solver.problem.zero().alias("d1"))).withColumn("value", F.lit(0).cast("bigint"))
        calls = self.inter.join(owner.select(F.col("n").alias("m"), F.col("method").alias("callee")), "m").select("n", F.col("d").alias("d2"), "callee", F.col("to").alias("f"), "k")
        jumps = lengths.join(calls, ["n", "d2"]).where(F.col("cond").bitwiseAND(F.col("k")) != 0).join(owner, "n")
        jumps = dealt(jumps.groupBy("cond", "method", "d1", "callee", "f").agg((F.min("value") + 1).alias("more")), "method", "d1")

        def step(delta: DataFrame) -> DataFrame:
            return delta.join(jumps, ["cond", "method", "d1"]).select("cond", F.col("callee").alias("method"), F.col("f").alias("d1"), (F.col("value") + F.col("more")).alias("value"))

        return lattice.fixpoint(seeds, step, ["cond", "method", "d1"], lattice.LEAST)

    def shortest(self) -> DataFrame:
        """n, d, steps, cond: the fewest steps from an entry to d at n, and the configurations in which it is that many. A fact that holds nowhere has no row."""
        own = saved(self.lengths())
        starts = self.entered(own).withColumnRenamed("value", "before")
        met = own.join(self.solver.node.select("n", "method"), "n").join(starts, ["cond", "method", "d1"])
        least = met.groupBy("cond", "n", F.col("d2").alias("d")).agg(F.min(F.col("value") + F.col("before")).alias("steps"))
        return least.groupBy("n", "d", "steps").agg(F.bit_or("cond").alias("cond"))
