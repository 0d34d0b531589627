"""Rewrites of a program's tables before it is solved.

node: n, method, kind, text, pc, is_start, is_exit, is_call. Each rewrite takes and returns tables, and new statements get numbers that follow from
those of the old ones, so that rewriting again gives the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismflow.functions import cond as C
from prismflow.plans.information_flow import TEMPORARY

#: Statement numbers are spread by this factor, so that new ones fit between: alternatives and returns after a statement, calls that are taken out before it.
#: Programs with more of them need more (``room_for``); what doesn't fit is an error.
ROOM = 64


def room_for(*extra: DataFrame) -> int:
    """The factor that the alternatives or nested calls (n, k) of a program need."""
    most = max((df.agg(F.max("k")).first()[0] or 0 for df in extra), default=0)
    return max(ROOM, 2 * (most + 4))


def fitting(k: Column, room: int) -> Column:
    """``k``, or an error if there is no number for it."""
    return F.when(k < room // 2 - 2, k).otherwise(F.raise_error(F.concat(F.lit("no room for number "), k.cast("string"), F.lit(f" of a statement with a factor of {room}; see room_for"))).cast("int"))


def spread(node: DataFrame, cfg: DataFrame, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """The tables with room for new statement numbers."""
    return node.withColumn("n", F.col("n") * room), cfg.withColumn("src", F.col("src") * room).withColumn("dst", F.col("dst") * room)


def split_alternatives(node: DataFrame, cfg: DataFrame, alternatives: DataFrame, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """Statements with alternatives inside as one statement for each (disciplined variability).

    alternatives: n, k (from 0), text, cond. Each copy exists where its alternative does; edges lead to and from each.
    """
    copies = alternatives.select("n", fitting(F.col("k"), room).alias("copy"), F.col("text").alias("new_text"), F.col("cond").alias("alt"))
    met = node.join(copies, "n", "left")
    node = met.withColumn("pc", F.col("pc").bitwiseAND(F.coalesce("alt", C.lit(C.TRUE)))).withColumn("text", F.coalesce("new_text", "text")).withColumn("n", F.col("n") + F.coalesce("copy", F.lit(0))).where("pc <> 0").select(*node.columns)
    a = copies.select(F.col("n").alias("src"), F.col("copy").alias("src_copy"), F.col("alt").alias("src_alt"))
    b = copies.select(F.col("n").alias("dst"), F.col("copy").alias("dst_copy"), F.col("alt").alias("dst_alt"))
    edges = cfg.join(a, "src", "left").join(b, "dst", "left")
    cond = F.col("cond").bitwiseAND(F.coalesce("src_alt", C.lit(C.TRUE))).bitwiseAND(F.coalesce("dst_alt", C.lit(C.TRUE)))
    return node, edges.select((F.col("src") + F.coalesce("src_copy", F.lit(0))).alias("src"), (F.col("dst") + F.coalesce("dst_copy", F.lit(0))).alias("dst"), cond.alias("cond")).where("cond <> 0")


def covers(alternatives: DataFrame) -> DataFrame:
    """n, k (from 0), text, cond: disjoint alternatives of each statement from overlapping pieces, as split_alternatives needs them.

    alternatives: n, piece (place in the statement), text, cond; the pieces that a configuration has make up its statement, in order. Configurations whose pieces read the same share one alternative; those with none have
    none. So each statement's conditions are refined into atoms: as few disjoint conditions as tell its variants apart, whose union is where any piece is.
    """
    # A statement's pieces meet once; variants are told apart within its row, by the texts that each configuration reads.
    pieces = F.array_sort(F.collect_list(F.struct("piece", "text", "cond")))
    configs = f"sequence(0, {C.CONFIGS - 1})"
    read = f"transform({configs}, c -> transform(filter(pieces, p -> (shiftright(p.cond, c) & 1) = 1), p -> p.text))"
    variants = alternatives.where("cond <> 0").groupBy("n").agg(pieces.alias("pieces")).select("n", F.expr(read).alias("variants"))
    # The first configuration of each stands first.
    atoms = variants.select("n", "variants", F.posexplode(F.expr("filter(array_distinct(variants), x -> size(x) > 0)")).alias("k", "texts"))
    cond = F.expr(f"aggregate({configs}, 0L, (out, c) -> if(variants[c] <=> texts, out | shiftleft(1L, c), out))")
    return atoms.select("n", "k", F.array_join("texts", " ").alias("text"), cond.alias("cond"))


def single_entry(node: DataFrame, cfg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty statement before the starts of each method, which becomes its only start."""
    starts = node.where("is_start")
    new = starts.groupBy("method").agg((F.min("n") - 1).alias("n"), F.bit_or("pc").alias("pc")).select("n", "method", F.lit("empty").alias("kind"), F.lit(";").alias("text"), "pc", F.lit(True).alias("is_start"), F.lit(False).alias("is_exit"), F.lit(False).alias("is_call"))
    edges = starts.join(new.select("method", F.col("n").alias("src")), "method").select("src", F.col("n").alias("dst"), F.col("pc").alias("cond"))
    return node.withColumn("is_start", F.lit(False)).unionByName(new), cfg.unionByName(edges)


def add_returns(node: DataFrame, cfg: DataFrame, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """A return statement after each exit that isn't one, which becomes the exit."""
    ends = node.where("is_exit AND kind <> 'return'")
    new = ends.select((F.col("n") + room - 2).alias("n"), "method", F.lit("return").alias("kind"), F.lit("return;").alias("text"), "pc", F.lit(False).alias("is_start"), F.lit(True).alias("is_exit"), F.lit(False).alias("is_call"))
    edges = ends.select(F.col("n").alias("src"), (F.col("n") + room - 2).alias("dst"), F.col("pc").alias("cond"))
    node = node.withColumn("is_exit", F.col("is_exit") & (F.col("kind") == "return"))
    return node.unionByName(new), cfg.unionByName(edges)


def hoist_calls(node: DataFrame, cfg: DataFrame, nested: DataFrame, room: int = ROOM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls within other statements, returns included, as statements before them that assign to temporaries.

    nested: n, k (inner ones first, from 0), call (its text). Also returns n, at, var: which temporary each statement reads. Each statement's calls
    run in order, after what came before the statement.
    """
    new = nested.join(node.select("n", "method", "pc"), "n").withColumn("at", F.col("n") - room // 2 + fitting(F.col("k"), room))
    var = F.concat(F.lit(TEMPORARY), F.col("at").cast("string"))
    rows = new.select(F.col("at").alias("n"), "method", F.lit("call").alias("kind"), F.concat(var, F.lit(" = "), F.col("call")).alias("text"), "pc", F.lit(False).alias("is_start"), F.lit(False).alias("is_exit"), F.lit(True).alias("is_call"))
    ends = new.groupBy("n").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.first("pc").alias("pc"))
    into = cfg.join(ends.select(F.col("n").alias("dst"), "first"), "dst", "left").select("src", F.coalesce("first", "dst").alias("dst"), "cond")
    chain = new.join(ends.select("n", "last"), "n").select(F.col("at").alias("src"), F.when(F.col("at") < F.col("last"), F.col("at") + 1).otherwise(F.col("n")).alias("dst"), F.col("pc").alias("cond"))
    node = node.join(ends.select("n", F.lit(True).alias("hoisted")), "n", "left").withColumn("is_call", F.col("is_call") & F.col("hoisted").isNull()).drop("hoisted")
    return node.unionByName(rows), into.unionByName(chain), new.select("n", "at", var.alias("var"))


def project(rows: DataFrame, config: int, cond: str = "pc") -> DataFrame:
    """What one configuration has of a table (product derivation)."""
    return rows.where(C.holds_in(F.col(cond), config)).withColumn(cond, C.lit(C.TRUE))


def apply(node: DataFrame, cfg: DataFrame, rewrites: tuple[Callable, ...] = (single_entry, add_returns)) -> tuple[DataFrame, DataFrame]:
    """Room for new statements, then rewrites of two tables in order."""
    node, cfg = spread(node, cfg)
    for rewrite in rewrites:
        node, cfg = rewrite(node, cfg)
    return node, cfg
