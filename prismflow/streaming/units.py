"""Streams of translation units: edges come and go in micro-batches, and what they make reachable is brought up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismflow.functions import cond as C
from prismflow.operators.fixpoint import fixpoint, reach_without, saved, without


def over(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, cond: where ``nodes`` get to by one edge."""
    own = edges.select("src", F.col("dst").alias("to"), F.col("cond").alias("e"))
    return nodes.join(own, nodes["node"] == own["src"]).select(F.col("to").alias("node"), F.col("cond").bitwiseAND(F.col("e")).alias("cond"))


class ReachableNodes:
    """Lifted reachability over a table of edges that changes. All is kept in ``path``: edges as they came, and the state of each batch.

    A row of a batch adds an edge under a condition, or, with ``gone``, takes it back under one; within a batch, what is taken back goes first. The last state is where the next batch starts from: what rested
    on edges that have gone is deleted and, where it can be, derived again another way; then new edges are followed. A batch that runs again, after a failure, writes the same files once more.
    """

    def __init__(self, spark: SparkSession, path: str, start: DataFrame):
        self.spark, self.path, self.start = spark, path, start
        self.listeners: list[Callable[[DataFrame, int], None]] = []

    def register(self, listener: Callable[[DataFrame, int], None]) -> None:
        """``listener`` gets the state after each batch, and the batch's number."""
        self.listeners.append(listener)

    def unregister(self, listener: Callable[[DataFrame, int], None]) -> None:
        self.listeners.remove(listener)

    def state(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/state/{batch}")

    def edges(self, batch: int) -> DataFrame:
        """src, dst, cond: the edges that are there after a batch."""
        rows = self.spark.read.parquet(f"{self.path}/edges").where(F.col("batch") <= batch)
        # What has only ever been added needs no order; the others are gone through batch by batch.
        each = rows.groupBy("src", "dst", "batch").agg(F.bit_or(F.when(~F.col("gone"), F.col("cond")).otherwise(0)).alias("more"), F.bit_or(F.when(F.col("gone"), F.col("cond")).otherwise(0)).alias("less"))
        turns = F.array_sort(F.collect_list(F.struct("batch", "more", "less")))
        left = F.aggregate(turns, C.lit(0), lambda held, t: held.bitwiseAND(F.bitwise_not(t["less"])).bitwiseOR(t["more"]))
        return each.groupBy("src", "dst").agg(left.alias("cond")).where("cond <> 0")

    def update(self, edges: DataFrame, batch: int) -> None:
        gone = F.col("gone") if "gone" in edges.columns else F.lit(False)
        edges.select("src", "dst", "cond", gone.alias("gone")).write.mode("overwrite").parquet(f"{self.path}/edges/batch={batch}")
        now, start = saved(self.edges(batch)), self.start.select("node", "cond")
        if not batch:
            reached = fixpoint(start, lambda delta: over(delta, now), ["node"])
        else:
            # Only edges of this batch can differ from the batch before.
            touched = edges.select("src", "dst").distinct()
            before = saved(self.edges(batch - 1).join(touched, ["src", "dst"], "left_semi"))
            after = now.join(touched, ["src", "dst"], "left_semi")
            less = lambda x, y: saved(without(x.join(y.withColumnRenamed("cond", "other"), ["src", "dst"], "left"), F.col("cond"), F.col("other")).select("src", "dst", "cond"))
            removed, added = less(before, after), less(after, before)
            known = self.state(batch - 1)
            if not removed.isEmpty():
                left = without(now.join(added.withColumnRenamed("cond", "other"), ["src", "dst"], "left"), F.col("cond"), F.col("other")).select("src", "dst", "cond")
                known = saved(reach_without(known, start, left, removed))
            reached = fixpoint(over(known, added), lambda delta: over(delta, now), ["node"], known=known)
        reached.write.mode("overwrite").parquet(f"{self.path}/state/{batch}")
        for listener in self.listeners:
            listener(self.state(batch), batch)

    def follow(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Run update() for each micro-batch of ``stream`` (src, dst, cond, and gone if edges are taken back too)."""
        writer = stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
