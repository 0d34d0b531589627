"""Least fixpoints of monotone rules over rows with conditions."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismflow.functions import cond as C


def shared_folder(spark: SparkSession) -> None:
    """Make sure that checkpoints go to a folder all executors share: the cluster's, or a temporary one on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if where is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = os.path.join(tempfile.gettempdir(), "prismflow-checkpoints")
        sc.setCheckpointDir(where)


#: Estimated bytes above which a checkpoint's estimate is dropped: no table is as large.
BELIEVED = 1 << 256


@contextmanager
def configured(spark: SparkSession, **own: str) -> Iterator[None]:
    """Settings of the session for what is planned and run inside; names have __ for a dot."""
    own = {k.replace("__", "."): v for k, v in own.items()}
    was = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame) -> DataFrame:
    """``df``, checkpointed. A checkpoint keeps the size that its plan was estimated at, joins multiply such sizes, and after some rounds Spark spends its time on multiplying
    numbers of many thousand digits. Where the estimate has grown beyond ``BELIEVED``, the rows are taken up as a table of unknown size.

    The shuffles behind it go from disk as soon as it is written (otherwise when the driver happens to collect its garbage); it goes itself by ``dropped``."""
    spark = df.sparkSession
    shared_folder(spark)
    with configured(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        out = df.select("*").checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    try:
        known = out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= BELIEVED
    except ValueError:  # more digits than Python reads
        known = False
    out = out if known else DataFrame(spark._jsparkSession.createDataFrame(out._jdf.javaRDD(), out._jdf.schema()), spark)
    out.written = (file,)
    return out


def dropped(*tables: DataFrame) -> None:
    """Take the files of ``saved`` tables away, which nothing reads any more, plans that have not run yet included. Other tables have none and stay as they are."""
    for df in tables:
        for file in getattr(df, "written", ()):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a static table that make one partition, as long as all cores have one and the session's shuffle partitions allow it.
ROWS = 50_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df``, written once, dealt and sorted by ``keys``: joins by them, round after round, move the other side only.

    ``rows``: about how many there are, where that is known. Otherwise ``df`` is written before, to be counted."""
    once = None
    if rows is None:
        df = once = saved(df)
        rows = df.count()
    out = _as_planned(df.sparkSession, rows, ROWS, lambda parts: df.repartition(parts, *keys).sortWithinPartitions(*keys))
    if once is not None:
        dropped(once)
    return out


def _as_planned(spark: SparkSession, rows: int, each: int, plan: Callable[[int], DataFrame]) -> DataFrame:
    """What ``plan`` makes for so many partitions as ``rows`` need, ``each`` in one, written. Adaptive plans hide how their rows are dealt, so that this one is written without.
    Joins and groups by the same keys then deal rows as they are wanted."""
    most, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    parts = max(1, min(most, max(cores, rows // each)))
    with configured(spark, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions=str(parts)):
        return saved(plan(parts))


#: Neighbours that one row of a table of lists has at most, and edges that make one partition of it.
NEIGHBOURS, EDGES = 1024, 4 * ROWS


def laid(edges: DataFrame, *masks: str, rows: int | None = None) -> DataFrame:
    """Edges (src, dst, ``masks``, and block, if there is one) as lists of neighbours: src, and dst and ``masks`` as arrays, dealt and sorted by src once for any number of fixpoints.

    Rows move once, as they are, and equal edges become one where they lie. Rounds read a checkpoint row by row, which takes longer than to follow an edge, so that a row has up to
    ``NEIGHBOURS`` edges; a node with more has several. ``rows``: about how many edges there are, where that is known."""
    by = ["src", *(c for c in edges.columns if c == "block")]
    edges, once = edges.select(*by, "dst", *masks), None
    if rows is None:
        edges = once = saved(edges)
        rows = edges.count()

    def plan(parts: int) -> DataFrame:
        one = edges.repartition(parts, *by).groupBy(*by, "dst").agg(*(F.bit_or(c).alias(c) for c in masks))
        place = F.row_number().over(Window.partitionBy(*by).orderBy("dst"))
        lists = one.withColumn("piece", F.floor((place - 1) / NEIGHBOURS)).groupBy(*by, "piece").agg(F.collect_list(F.struct("dst", *masks)).alias("to"))
        return lists.select(*by, *(F.col(f"to.{c}").alias(c) for c in ("dst", *masks))).sortWithinPartitions(*by)

    out = _as_planned(edges.sparkSession, rows, EDGES, plan)
    if once is not None:
        dropped(once)
    return out


def along(lists: DataFrame, conds: tuple[str, ...] = ("cond",), mask: Callable[[Column, str], Column] = lambda to, c: to[c]) -> Callable[[DataFrame], DataFrame]:
    """A step from rows (node, block, ``conds``) along laid edges; ``mask`` gives, of an edge with its masks, what it leaves of each condition."""
    by = [c for c in ("src", "block") if c in lists.columns]
    to = F.explode(F.arrays_zip(*(c for c in lists.columns if c not in by))).alias("to")

    def step(delta: DataFrame) -> DataFrame:
        own = delta.select(F.col("node").alias("src"), *by[1:], *(F.col(c).alias(f"own_{c}") for c in conds))
        met = own.join(lists, by).select(*by[1:], *(f"own_{c}" for c in conds), to)
        return met.select(F.col("to.dst").alias("node"), *by[1:], *(F.col(f"own_{c}").bitwiseAND(mask(F.col("to"), c)).alias(c) for c in conds))

    return step


@dataclass
class Rounds:
    """What a fixpoint's rounds did: rows and bits that were new in each."""

    rows: list[int] = field(default_factory=list)
    bits: list[int] = field(default_factory=list)


class NotReached(RuntimeError):
    """A fixpoint took more rounds than its caller allows."""


class State:
    """All rows that a fixpoint knows: what each round found, appended, and an older part dealt by the keys.

    A round's part is only moved again when the parts have outgrown the older part, or there are many, so that
    rows are rewritten a logarithmic number of times and not once a round.
    """

    PARTS, SMALL = 12, 1_000_000

    def __init__(self, keys: list[str], conds: tuple[str, ...]):
        self.keys, self.conds = keys, conds
        self.base: DataFrame | None = None
        self.parts: list[DataFrame] = []
        self.size = self.more = 0
        #: What has been dealt anew; the last part may still be followed.
        self.past: list[DataFrame] = []

    def append(self, part: DataFrame, rows: int) -> None:
        dropped(*self.past)
        self.past = []
        self.parts.append(part)
        self.more += rows
        if self.more > max(self.SMALL, 2 * self.size) or len(self.parts) > self.PARTS:
            self.past = self.parts if self.base is None else [self.base, *self.parts]
            self.base = dealt(self.all(), *self.keys)
            self.size, self.more, self.parts = self.size + self.more, 0, []

    def all(self) -> DataFrame:
        """All rows; ``dropped`` takes what they are made of."""
        every = reduce(DataFrame.unionByName, self.parts, self.base) if self.base else reduce(DataFrame.unionByName, self.parts)
        out = every.groupBy(*self.keys).agg(*(F.bit_or(c).alias(c) for c in self.conds))
        out.written = tuple(file for df in (self.base, *self.parts) for file in getattr(df, "written", ()))
        return out

    def unknown(self, found: DataFrame) -> DataFrame:
        """The bits of ``found`` that no row has yet."""
        none = F.lit(0).cast("bigint")
        some = lambda prefix: reduce(lambda a, b: a | b, (F.col(f"{prefix}{c}") != 0 for c in self.conds))
        left = lambda was: [F.col(f"now_{c}").bitwiseAND(F.bitwise_not(was(c))).alias(f"now_{c}") for c in self.conds]
        rows = found.where(some("")).select(*self.keys, *(F.col(c).alias(f"now_{c}") for c in self.conds), *(none.alias(f"was_{c}") for c in self.conds))
        for part in self.parts:
            rows = rows.unionByName(part.select(*self.keys, *(none.alias(f"now_{c}") for c in self.conds), *(F.col(c).alias(f"was_{c}") for c in self.conds)))
        rows = rows.groupBy(*self.keys).agg(*(F.bit_or(f"{x}_{c}").alias(f"{x}_{c}") for x in ("now", "was") for c in self.conds))
        rows = rows.select(*self.keys, *left(lambda c: F.col(f"was_{c}"))).where(some("now_"))
        if self.base is not None:
            known = self.base.select(*self.keys, *(F.col(c).alias(f"was_{c}") for c in self.conds))
            rows = rows.join(known, self.keys, "left").select(*self.keys, *left(lambda c: F.coalesce(f"was_{c}", none))).where(some("now_"))
        return rows.select(*self.keys, *(F.col(f"now_{c}").alias(c) for c in self.conds))


def fixpoint(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], cond: str | tuple[str, ...] = "cond", most: int | None = None, rounds: Rounds | None = None, known: DataFrame | None = None) -> DataFrame:
    """Rows ``keys`` with the condition ``cond`` (or several such columns) under which they follow from ``seeds`` by ``step``.

    ``step(delta)`` returns candidates from what is new in this round. Only new configurations of a row are in ``delta``, so
    each row's bit is followed once. A round is one shuffle of candidates by the keys, aggregated per task first; what is new is checkpointed,
    so that lineage stays short and lost executors cost one round. ``most``: rounds after which to give up (None: never). ``known``: rows that
    are there already and have been followed.
    """
    rounds = Rounds() if rounds is None else rounds
    conds = (cond,) if isinstance(cond, str) else tuple(cond)
    state = State(keys, conds)
    if known is not None:
        state.parts.append(known.select(*keys, *conds))
    delta = saved(state.unknown(seeds))
    while True:
        n, bits = delta.agg(F.count(F.lit(1)), F.sum(reduce(lambda a, b: a + b, (F.bit_count(c) for c in conds)))).first()
        if not n:
            dropped(*state.past)
            if not state.parts and state.base is None:
                return delta
            dropped(delta)
            return state.all()
        if most is not None and len(rounds.rows) >= most:
            raise NotReached(f"no fixpoint after {most} rounds")
        rounds.rows.append(n)
        rounds.bits.append(bits)
        state.append(delta, n)
        delta = saved(state.unknown(step(delta)))


def reach(start: DataFrame, edges: DataFrame, model: int | None = None, rounds: Rounds | None = None, rows: int | None = None) -> DataFrame:
    """node, cond: under which conditions the nodes of ``start`` (node, cond) reach each node along ``edges`` (src, dst, cond).

    With a column ``block`` in both, conditions have as many blocks as there are in it, and so has the result. ``rows``: about how many edges there are, where that is known."""
    if model is not None:
        start = start.withColumn("cond", F.col("cond").bitwiseAND(F.lit(model).cast("bigint")))
    lists = laid(edges, "cond", rows=rows)
    return fixpoint(start, along(lists), ["node", *(c for c in lists.columns if c == "block")], rounds=rounds)


def plain_reach(start: DataFrame, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node: the nodes that ``start`` reaches, whatever the configuration."""
    one = F.lit(1).cast("bigint").alias("cond")
    return reach(start.select("node", one), edges.select("src", "dst", one), rows=rows).select("node")


def least_by_config(rows: DataFrame, by: list[str], value: str, cond: str = "cond") -> DataFrame:
    """by, ``value``, ``cond``: of the rows of each group the least ``value`` (bigint) in each configuration, once with all configurations in which it is that.

    One minimum for each configuration, aggregated per task first, so that no group is ever collected: a row of 32 numbers stands for it.
    """
    # As one text each: building hundreds of columns one by one takes longer than a round.
    mins = F.expr(f"array({', '.join(f'min(CASE WHEN (`{cond}` & {1 << k}L) <> 0 THEN `{value}` END)' for k in range(C.CONFIGS))})")
    found = rows.groupBy(*by).agg(mins.alias("mins"))
    where = f"aggregate(sequence(0, {C.CONFIGS - 1}), 0L, (out, k) -> if(mins[k] = x, out | shiftleft(1L, k), out))"
    each = F.expr(f"transform(filter(array_distinct(mins), x -> x IS NOT NULL), x -> named_struct('{value}', x, '{cond}', {where}))")
    return found.select(*by, F.explode(each).alias("l")).select(*by, f"l.{value}", f"l.{cond}")


def without(rows: DataFrame, cond: Column, gone: Column) -> DataFrame:
    """The rows under what is left of ``cond`` where ``gone`` (null: nowhere) doesn't hold."""
    return rows.withColumn("cond", cond.bitwiseAND(F.bitwise_not(F.coalesce(gone, C.lit(0))))).where("cond <> 0")


def hung(rows: DataFrame, column: str, trees: DataFrame) -> DataFrame:
    """``rows`` (with cond) with ``column`` replaced by what it hangs on in ``trees`` (node, class, cond), split by conditions; where it hangs on nothing it stays.

    A node's row of ``trees`` is made of at most one class for each configuration, so that it is one row of a few masks in the join."""
    packed = trees.groupBy(F.col("node").alias(column)).agg(F.collect_list(F.struct("class", "cond")).alias("ways"), F.bit_or("cond").alias("gone"))
    more = [c for c in rows.columns if c not in (column, "cond")]
    stays = F.struct(F.col(column).alias("class"), F.col("cond").bitwiseAND(F.bitwise_not("gone")).alias("cond"))
    moves = F.transform("ways", lambda w: F.struct(w["class"].alias("class"), w["cond"].bitwiseAND(F.col("cond")).alias("cond")))
    own = F.when(F.col("ways").isNull(), F.array(F.struct(F.col(column).alias("class"), F.col("cond")))).otherwise(F.filter(F.concat(moves, F.array(stays)), lambda w: w["cond"] != 0))
    met = rows.join(packed, column, "left").select(*more, F.explode(own).alias("w"))
    return met.select(*(F.col("w.class").alias(c) if c == column else F.col("w.cond") if c == "cond" else c for c in rows.columns))


def classes(nodes: DataFrame | None, links: DataFrame, model: int, rounds: Rounds | None = None, once: bool = False) -> DataFrame:
    """node, class, cond: the smallest node that each node is linked to, itself included, and in which configurations; ``links`` (a, b, cond) count both ways.

    By contraction, in all configurations at once: each node hangs on its smallest neighbour, if that is smaller, these trees are cut down to stars by pointer doubling, and links
    between the stars' centres are what is left. In each configuration at least half of the nodes that still have links are gone after a round, so that the number of rounds grows with
    the logarithm of a class's size, and later rounds only see what is left. Nodes learn their class at the end, last round first.
    A round is some aggregations and joins by node. Links of nodes that aren't in ``nodes`` are left out; None: the nodes are the links' ends. ``dropped`` takes what the result is made of.
    ``once``: each pair is in one row, nearly always, so that links needn't be grouped before the first round.
    """
    rounds = Rounds() if rounds is None else rounds
    turned = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cond")
    put = lambda df: turned(df).groupBy("a", "b").agg(F.bit_or("cond").alias("cond"))
    left = lambda df: df.where("a <> b AND cond <> 0")
    links, trees = links.withColumn("cond", F.col("cond").bitwiseAND(C.lit(model))), []
    if nodes is None:
        first = saved(turned(links) if once else put(links))
        every = saved(first.select(F.col("a").alias("node")).distinct().unionByName(first.select(F.col("b").alias("node")).distinct()).distinct())
        links = left(first)
        links.written = first.written
    else:
        every = saved(nodes.select("node").distinct())
        known = lambda df, c: df.join(every.withColumnRenamed("node", c), c, "left_semi")
        links = saved(put(left(known(known(links, "a"), "b"))))
    while True:
        n, bits = links.agg(F.count(F.lit(1)), F.sum(F.bit_count("cond"))).first()
        if not n:
            dropped(links)
            break
        rounds.rows.append(n)
        rounds.bits.append(bits)
        past, links = links, dealt(links, "b", rows=n)
        dropped(past)
        trees.append(stars(least_by_config(links.select(F.col("b").alias("node"), F.col("a").alias("class"), "cond"), ["node"], "class")))
        half = left(hung(links, "b", trees[-1])).groupBy("a", "b").agg(F.bit_or("cond").alias("cond"))
        past, links = links, saved(put(left(hung(half, "a", trees[-1]))))
        dropped(past)
    found = every.select("node", F.col("node").alias("class"), C.lit(model).alias("cond"))
    if not trees:
        found.written = every.written
        return found
    label = trees.pop()
    while trees:
        lower = trees.pop()
        # Nodes of different rounds are different in each configuration: what hung on something earlier has no links later.
        once, label = label, saved(hung(lower, "class", label).groupBy("node", "class").agg(F.bit_or("cond").alias("cond")).unionByName(label))
        dropped(once, lower)
    own = label.groupBy("node", "class").agg(F.bit_or("cond").alias("cond"))
    alone = without(every.join(own.groupBy("node").agg(F.bit_or("cond").alias("gone")), "node", "left"), C.lit(model), F.col("gone"))
    out = own.unionByName(alone.select("node", F.col("node").alias("class"), "cond"))
    out.written = (*label.written, *every.written)
    return out


def stars(trees: DataFrame) -> DataFrame:
    """node, class, cond: the root of each node's tree in each configuration; ``trees`` (node, class, cond) leads from each node that isn't a root to a smaller one."""
    trees, before = saved(trees), None
    while True:
        # Only what is hung upon leads on.
        upper = saved(trees.join(trees.select(F.col("class").alias("node")).distinct(), "node", "left_semi"))
        now = upper.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "class", "cond").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:
            dropped(upper)
            return trees
        once, trees, before = trees, saved(hung(trees, "class", upper).groupBy("node", "class").agg(F.bit_or("cond").alias("cond"))), now
        dropped(once, upper)


def classes_without(before: DataFrame, links: DataFrame, removed: DataFrame, model: int) -> DataFrame:
    """classes() after links have been taken back: node, class, cond.

    before: the classes with all links. removed: a, b, cond that have gone (each (a, b) under what it no longer has). links: a, b, cond that are left. A class can only have come
    apart in configurations in which it has lost a link, so that those classes are made anew from their nodes and links, in those configurations; all others stay as they are.
    """
    own = saved(before.select("node", "class", F.col("cond").alias("c")))
    lost = removed.select(F.col("a").alias("node"), "cond").join(own, "node").select("class", F.col("cond").bitwiseAND(F.col("c")).alias("lost")).where("lost <> 0")
    lost = saved(lost.groupBy("class").agg(F.bit_or("lost").alias("lost")))
    hit = saved(own.join(lost, "class").select("node", F.col("c").bitwiseAND(F.col("lost")).alias("open")).where("open <> 0").groupBy("node").agg(F.bit_or("open").alias("open")))
    # Both ends of a link are in one class, so that one end says where it counts.
    inner = links.join(hit.withColumnRenamed("node", "a"), "a").select("a", "b", F.col("cond").bitwiseAND(F.col("open")).alias("cond")).where("cond <> 0")
    # Each node's link to itself says that it is there, so that no end has to be looked up.
    inner = inner.unionByName(hit.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("open").alias("cond")))
    anew = classes(None, inner, model, once=True).join(hit, "node").select("node", "class", F.col("cond").bitwiseAND(F.col("open")).alias("cond")).where("cond <> 0")
    stay = without(own.join(hit, "node", "left"), F.col("c"), F.col("open")).select("node", "class", "cond")
    return stay.unionByName(anew).groupBy("node", "class").agg(F.bit_or("cond").alias("cond"))


def reach_without(before: DataFrame, start: DataFrame, edges: DataFrame, removed: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """reach() after edges have been taken back: node, cond.

    before: what ``start`` (node, cond) reached with all edges. removed: src, dst, cond that have gone (each (src, dst) under what it no longer has). edges: src, dst, cond that are left.
    Everything that followed from a removed edge is deleted, in the configurations in which it may have; what still follows from the rest, by another way, is derived again.
    Only configurations of nodes behind removed edges are touched.
    """
    every = edges.select("src", "dst", "cond", F.col("cond").alias("left")).unionByName(removed.select("src", "dst", "cond", C.lit(0).alias("left")))
    return left_reach(before, start, laid(every, "cond", "left"), rounds)


def left_reach(before: DataFrame, start: DataFrame, lists: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """reach_without() over laid edges with two masks: ``cond`` as it was and ``left`` as it is."""
    start, before = (df.select("node", "cond").groupBy("node").agg(F.bit_or("cond").alias("cond")) for df in (start, before))
    keep = along(lists, mask=lambda to, _: to["left"])
    gone = along(lists, mask=lambda to, _: to["cond"].bitwiseAND(F.bitwise_not(to["left"])))
    before = saved(before)
    doubtful = saved(fixpoint(gone(before), along(lists), ["node"], rounds=rounds))
    left = saved(without(before.join(doubtful.withColumnRenamed("cond", "gone"), "node", "left"), F.col("cond"), F.col("gone")).select("node", "cond"))
    again = start.unionByName(keep(left)).join(doubtful.withColumnRenamed("cond", "gone"), "node").select("node", F.col("cond").bitwiseAND(F.col("gone")).alias("cond")).where("cond <> 0")
    return fixpoint(again, keep, ["node"], rounds=rounds, known=left)
