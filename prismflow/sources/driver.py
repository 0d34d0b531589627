"""Programs made of the driver's tables: events as traces of statements, orders as methods that call each other, parts and suppliers as a graph.

The SQL expressions run in Spark and DuckDB alike, so that both sides of a comparison start from the same conditions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.functions import cond as C
from prismflow.operators.fixpoint import saved
from prismflow.operators.solver import Program
from prismflow.plans.information_flow import Statements

F0, F1, F2, F3, F4 = (C.feature(k) for k in range(5))
N3 = C.negated(F3)

#: The number in an event's properties.
EVENT_K = r"CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_POSITIVE = f"CASE k % 6 WHEN 0 THEN {F0} WHEN 1 THEN {F1} WHEN 2 THEN {F2} WHEN 3 THEN {F3} WHEN 4 THEN {F4} ELSE {C.TRUE} END"
#: The presence condition of an event with number k: a feature, or its negation from 50 on; each sixth is always there.
EVENT_PC = f"CAST(CASE WHEN k >= 50 AND k % 6 < 5 THEN {C.TRUE} - ({_POSITIVE}) ELSE {_POSITIVE} END AS BIGINT)"
#: The condition of a line item, by its return flag and status.
LINE_MASK = f"CAST((CASE l_returnflag WHEN 'A' THEN {F0} WHEN 'N' THEN {F1} ELSE {F2} END) & (CASE l_linestatus WHEN 'F' THEN {F3} ELSE {N3} END) AS BIGINT)"
#: An order's condition, by its status.
ORDER_MASK = f"CAST(CASE o_orderstatus WHEN 'F' THEN {F0} WHEN 'O' THEN {F1} ELSE {C.TRUE} END AS BIGINT)"
#: Events as statements of their user's trace.
EVENT_SQL = f"SELECT event_id, user_id, ts, event_type, value, k, {EVENT_PC} AS pc FROM (SELECT *, {EVENT_K} AS k FROM events)"
#: Which variable an event is about.
EVENT_VAR = "'v' || CAST(k % 4 AS STRING)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, ts, event_type, value, k, pc."""
    own = table(spark, sf_dir, "events").withColumn("k", F.expr(EVENT_K))
    return own.select("event_id", "user_id", "ts", "event_type", "value", "k", F.expr(EVENT_PC).alias("pc"))


def lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """l_orderkey, l_linenumber, l_partkey, l_suppkey, cond, and more columns."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(LINE_MASK).alias("cond"), *more)


def supply_edges(own: DataFrame, *masks: str) -> DataFrame:
    """src, dst, ``masks`` of lines: suppliers (even numbers) and parts (odd ones) that deal with each other, both ways, once for each line."""
    s, p = 2 * F.col("l_suppkey"), 2 * F.col("l_partkey") + 1
    ways = F.array(F.struct(s.alias("src"), p.alias("dst")), F.struct(p.alias("src"), s.alias("dst")))
    return own.select(F.explode(ways).alias("way"), *masks).select("way.src", "way.dst", *masks)


def order_program(spark: SparkSession, sf_dir: str, calls_from: int = 45, narrowed: str = "false") -> tuple[Program, Statements, DataFrame]:
    """Orders as methods, their lines as statements in order. A line of ``calls_from`` pieces calls its customer's next order.

    A line assigns variable ``p<part % 5>`` from ``s<supplier % 3>`` and ``p<supplier % 5>``, each first line defines ``s`` variables; calls pass and return them.
    Entries are customers' first orders. Within methods that ``narrowed`` holds for, a statement leads to the next only where its line is there.
    """
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("method"), "o_custkey", F.expr(ORDER_MASK).alias("o_mask"))
    turn = Window.partitionBy("o_custkey").orderBy("method")
    orders = orders.withColumn("next", F.lead("method").over(turn)).withColumn("first", F.row_number().over(turn) == 1)
    own = lines(spark, sf_dir, "l_quantity", "l_extendedprice").withColumnRenamed("l_orderkey", "method").join(orders, "method")
    # Line numbers repeat within an order, so statements are numbered by their place.
    at = Window.partitionBy("method").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    own = own.withColumn("k", F.row_number().over(at)).withColumn("k", F.when(F.col("k") < 1024, F.col("k")).otherwise(F.raise_error(F.lit("an order has more lines than there are numbers for")).cast("int"))).withColumn("n", F.col("method") * 1024 + F.col("k")).withColumn("after", F.lead("n").over(at))
    own = own.withColumn("is_call", (F.col("l_quantity") >= calls_from) & F.col("next").isNotNull() & F.col("after").isNotNull())
    own = saved(own.drop("l_linenumber", "l_extendedprice", "l_quantity"))
    node = own.select("n", "method", F.lit("line").alias("kind"), F.concat(F.lit("line "), F.col("n").cast("string")).alias("text"), F.col("o_mask").alias("pc"), (F.col("k") == 1).alias("is_start"), F.col("after").isNull().alias("is_exit"), "is_call")
    cfg = own.where("after IS NOT NULL").select(F.col("n").alias("src"), F.col("after").alias("dst"), F.when(F.expr(narrowed), F.col("cond")).otherwise(F.col("cond").bitwiseOR(C.lit(F4))).alias("cond"))
    calls = own.where("is_call").select(F.col("n").alias("call"), F.col("next").alias("method"), F.col("cond").bitwiseOR(C.lit(F2)).alias("cond"))
    var = lambda a, c, m: F.concat(F.lit(a), (F.col(c) % m).cast("string"))
    target, source, other = var("p", "l_partkey", 5), var("s", "l_suppkey", 3), var("p", "l_suppkey", 5)
    plain = own.where("NOT is_call AND k > 1")
    assigns = plain.select("n", target.alias("assignee"), source.alias("assignor"), F.lit(1).alias("scope")).unionByName(plain.select("n", target.alias("assignee"), other.alias("assignor"), F.lit(1).alias("scope")))
    defs = own.where("k > 1").select("n", target.alias("var"), F.lit(1).alias("scope")).unionByName(own.where("k = 1").select("n", source.alias("var"), F.lit(1).alias("scope")))
    uses = own.select("n", source.alias("var"), F.lit(False).alias("in_array")).unionByName(own.where("after IS NULL").select("n", target.alias("var"), F.lit(False).alias("in_array")))
    params = own.where("is_call").select(F.col("n").alias("call"), F.col("next").alias("method"), source.alias("actual"), other.alias("formal"), C.lit(C.TRUE).alias("cond"))
    entries = own.where("first AND k = 1").select("n")
    return Program(node, cfg, calls), Statements(defs, uses.distinct(), assigns.distinct(), params), entries
