"""Queries over the driver's tables, one or more for each operator, and SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismflow.functions import cond as C
from prismflow.functions import cubes as Q
from prismflow.functions import text as X
from prismflow.operators import alias, callgraph, conditional, evaluate, fixpoint, flows, lattice, sampling
from prismflow.operators.solver import Program, Solver
from prismflow.plans import information_flow as IF
from prismflow.plans import rewrite
from prismflow.sinks import graphs
from prismflow.sources import driver as D
from prismflow.sources.driver import EVENT_SQL, EVENT_VAR, F3, F4, LINE_MASK, ORDER_MASK, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
T = C.TRUE


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Conditions.


@query(f"""SELECT event_id, pc, (pc = {T}) AS tautology, bit_count(pc)::BIGINT AS n_configs, ({T} - pc) AS negated FROM ({EVENT_SQL})""")
def presence_condition(spark: SparkSession, d: str) -> DataFrame:
    pc = F.col("pc")
    return D.events(spark, d).select("event_id", "pc", C.tautology(pc).alias("tautology"), C.size(pc).cast("bigint").alias("n_configs"), C.no(pc).alias("negated"))


@query(f"""SELECT l_returnflag, l_linestatus, bit_or(c)::BIGINT AS any_of, bit_and(c | {F4})::BIGINT AS narrowed,
  bool_and((({T} - c) | (c | {F4})) = {T}) AS implies_wider, bool_or((c & {T - F3}) <> 0) AS without_f3, count(*) FILTER (WHERE ((c >> 9) & 1) = 1)::BIGINT AS in_config_9
  FROM (SELECT *, {LINE_MASK} AS c FROM lineitem) GROUP BY 1, 2""")
def formula_algebra(spark: SparkSession, d: str) -> DataFrame:
    c, wide = F.col("c"), C.either(F.col("c"), C.lit(F4))
    own = table(spark, d, "lineitem").withColumn("c", F.expr(LINE_MASK))
    return own.groupBy("l_returnflag", "l_linestatus").agg(C.any_of(c).alias("any_of"), F.bit_and(wide).alias("narrowed"), F.bool_and(C.tautology(C.implies(c, wide))).alias("implies_wider"), F.bool_or(C.satisfiable(c, T - F3)).alias("without_f3"), F.count_if(C.holds_in(c, 9)).alias("in_config_9"))


@query(f"""SELECT o_orderkey, l_linenumber, ({ORDER_MASK} & {LINE_MASK}) AS composed FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE ({ORDER_MASK} & {LINE_MASK}) <> 0""")
def edge_compose(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr(ORDER_MASK).alias("o"))
    met = D.lines(spark, d).join(orders, "l_orderkey").withColumn("composed", C.both(F.col("o"), F.col("cond")))
    return met.where(C.satisfiable(F.col("composed"))).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "composed")


@query(f"""SELECT l_orderkey, bit_or({LINE_MASK})::BIGINT AS joined FROM lineitem GROUP BY 1""")
def edge_join(spark: SparkSession, d: str) -> DataFrame:
    return D.lines(spark, d).groupBy("l_orderkey").agg(C.any_of(F.col("cond")).alias("joined"))


@query(f"""SELECT DISTINCT 'F' || f AS feature FROM ({EVENT_SQL}), (SELECT unnest(range(5)) AS f) WHERE ((pc & (CASE f WHEN 0 THEN 2863311530 WHEN 1 THEN 3435973836 WHEN 2 THEN 4042322160 WHEN 3 THEN 4278255360 ELSE 4294901760 END)) >> (1 << f)::INT) <> (pc & (4294967295 - CASE f WHEN 0 THEN 2863311530 WHEN 1 THEN 3435973836 WHEN 2 THEN 4042322160 WHEN 3 THEN 4278255360 ELSE 4294901760 END))""")
def feature_collect(spark: SparkSession, d: str) -> DataFrame:
    return sampling.feature_names(D.events(spark, d).select(F.col("pc").alias("cond")))


# Statements and flows of one method.

_NEXT = f"SELECT *, lead(event_id) OVER w AS dst, lead(pc) OVER w AS dst_pc, lag(event_id) OVER w AS prev FROM ({EVENT_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def traces(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return D.events(spark, d).select("*", F.lead("event_id").over(w).alias("dst"), F.lead("pc").over(w).alias("dst_pc"), F.lag("event_id").over(w).alias("prev"))


@query(f"SELECT event_id AS src, dst, (pc & dst_pc) AS cond FROM ({_NEXT}) WHERE dst IS NOT NULL AND (pc & dst_pc & {T - F4}) <> 0")
def satisfiable_edges(spark: SparkSession, d: str) -> DataFrame:
    cond = C.both(F.col("pc"), F.col("dst_pc"))
    return traces(spark, d).where(F.col("dst").isNotNull() & C.satisfiable(cond, T - F4)).select(F.col("event_id").alias("src"), "dst", cond.alias("cond"))


@query(f"""SELECT user_id, count(*) FILTER (WHERE prev IS NULL)::BIGINT AS starts, count(*) FILTER (WHERE dst IS NULL OR event_type = 'error')::BIGINT AS exits, count(*) FILTER (WHERE event_type = 'purchase' AND dst IS NOT NULL)::BIGINT AS calls FROM ({_NEXT}) GROUP BY 1""")
def statement_kinds(spark: SparkSession, d: str) -> DataFrame:
    return traces(spark, d).groupBy("user_id").agg(F.count_if(F.col("prev").isNull()).alias("starts"), F.count_if(F.col("dst").isNull() | (F.col("event_type") == "error")).alias("exits"), F.count_if((F.col("event_type") == "purchase") & F.col("dst").isNotNull()).alias("calls"))


@query(f"""WITH e AS (SELECT event_id AS src, dst, (pc & dst_pc) AS cond FROM ({_NEXT}) WHERE dst IS NOT NULL UNION ALL SELECT a.event_id, b.event_id, (a.pc & b.pc) FROM ({EVENT_SQL}) a JOIN ({EVENT_SQL}) b ON b.event_id = a.event_id + 7 AND a.event_type = 'click')
SELECT src, count(*)::BIGINT AS successors, bit_or(cond)::BIGINT AS cond FROM e WHERE cond <> 0 GROUP BY src HAVING count(*) >= 2""")
def branches(spark: SparkSession, d: str) -> DataFrame:
    own = D.events(spark, d)
    far = own.where("event_type = 'click'").select(F.col("event_id").alias("src"), (F.col("event_id") + 7).alias("dst"), F.col("pc").alias("a")).join(own.select(F.col("event_id").alias("dst"), F.col("pc").alias("b")), "dst").select("src", "dst", C.both(F.col("a"), F.col("b")).alias("cond"))
    near = traces(spark, d).where("dst IS NOT NULL").select(F.col("event_id").alias("src"), "dst", C.both(F.col("pc"), F.col("dst_pc")).alias("cond"))
    return near.unionByName(far).where(C.satisfiable(F.col("cond"))).groupBy("src").agg(F.count(F.lit(1)).alias("successors"), F.bit_or("cond").alias("cond")).where("successors >= 2")


@query(f"""WITH t AS (SELECT *, {EVENT_VAR} AS var FROM ({EVENT_SQL})), r AS (SELECT *, max(CASE WHEN event_type = 'click' THEN struct_pack(ts, event_id, pc) END) OVER (PARTITION BY user_id, var ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def FROM t)
SELECT event_id, var, def.event_id AS def_id, (pc & def.pc) AS cond FROM r WHERE event_type = 'view' AND def IS NOT NULL""")
def def_use_chain(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "var").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    own = D.events(spark, d).withColumn("var", F.expr(EVENT_VAR))
    own = own.withColumn("def", F.last(F.when(F.col("event_type") == "click", F.struct("event_id", "pc")), ignorenulls=True).over(w))
    return own.where("event_type = 'view' AND def IS NOT NULL").select("event_id", "var", F.col("def.event_id").alias("def_id"), C.both(F.col("pc"), F.col("def.pc")).alias("cond"))


@query(f"""WITH t AS (SELECT *, {EVENT_VAR} AS var FROM ({EVENT_SQL})), r AS (SELECT *, count(*) FILTER (WHERE event_type IN ('click', 'signup')) OVER (PARTITION BY user_id, var ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM t)
SELECT event_id, var, pc AS cond FROM r WHERE event_type = 'view' AND earlier = 0""")
def uninitialised_use(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "var").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    own = D.events(spark, d).withColumn("var", F.expr(EVENT_VAR)).withColumn("earlier", F.count_if(F.col("event_type").isin("click", "signup")).over(w))
    return own.where("event_type = 'view' AND earlier = 0").select("event_id", "var", F.col("pc").alias("cond"))


@query(f"""WITH t AS (SELECT event_id, CASE event_type WHEN 'signup' THEN '0' ELSE {EVENT_VAR} END AS d FROM ({EVENT_SQL})),
z AS (SELECT * FROM t UNION ALL SELECT event_id, 'new' FROM t WHERE d = '0'), k AS (SELECT * FROM z WHERE d <> 'v1'), m AS (SELECT * FROM k WHERE d <> 'v3' UNION ALL SELECT event_id, 'v3' FROM k WHERE d = 'v2')
SELECT d, count(*)::BIGINT AS n FROM m GROUP BY 1""")
def gen_kill_transfer(spark: SparkSession, d: str) -> DataFrame:
    own = D.events(spark, d).select("event_id", F.when(F.col("event_type") == "signup", "0").otherwise(F.expr(EVENT_VAR)).alias("d"))
    flow = flows.compose(flows.gen(F.lit("new"), F.lit("0")), flows.with_zero(flows.kill(F.lit("v1")), F.lit("0")), flows.transfer(F.lit("v3"), F.lit("v2")), flows.identity())
    return flow(own).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT user_id, {EVENT_VAR} AS d FROM ({EVENT_SQL})) SELECT d, count(*)::BIGINT AS n FROM (SELECT DISTINCT * FROM t WHERE d <> 'v0') GROUP BY 1""")
def flow_union(spark: SparkSession, d: str) -> DataFrame:
    """The identity among them is left out."""
    own = D.events(spark, d).select("user_id", F.expr(EVENT_VAR).alias("d"))
    return flows.union(flows.identity(), flows.kill(F.lit("v0")), flows.kill_all())(own).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT event_type, {EVENT_VAR} AS d FROM ({EVENT_SQL})) SELECT d, count(*)::BIGINT AS n FROM (SELECT d FROM t WHERE event_type = 'view' AND d <> 'v0' UNION ALL SELECT d FROM t WHERE event_type = 'click' UNION ALL SELECT 'new' FROM t WHERE event_type = 'click' AND d = 'v1') GROUP BY 1""")
def flow_by_kind(spark: SparkSession, d: str) -> DataFrame:
    own = D.events(spark, d).select("event_type", F.expr(EVENT_VAR).alias("d"))
    flow = flows.by_kind(F.col("event_type"), {"view": flows.kill(F.lit("v0")), "click": flows.gen(F.lit("new"), F.lit("v1"))})
    return flow(own).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT event_id, ((pc & {F4}) = ({F3} & {F4})) AS as_f3, CASE WHEN (pc & {D.F1}) <> 0 THEN pc ELSE 0 END AS inside FROM ({EVENT_SQL})""")
def under_a_model(spark: SparkSession, d: str) -> DataFrame:
    """Equivalence with feature 3 where feature 4 is on, and conditions that a model of feature 1 allows."""
    pc = F.col("pc")
    return D.events(spark, d).select("event_id", C.equivalent(pc, C.lit(F3), F4).alias("as_f3"), C.within(pc, D.F1).alias("inside"))


@query("""SELECT p_partkey, (a = b) AS full_match, (a = b OR starts_with(a, b || '.')) AS part_match FROM (SELECT p_partkey, replace(p_type, ' ', '.') AS a, regexp_extract(replace(p_type, ' ', '.'), '^[^.]*(\\.[^.]*)?') AS b FROM part)""")
def field_match(spark: SparkSession, d: str) -> DataFrame:
    path = F.replace("p_type", F.lit(" "), F.lit("."))
    own = table(spark, d, "part").select("p_partkey", path.alias("a"), F.regexp_extract(path, r"^[^.]*(\.[^.]*)?", 0).alias("b"))
    return own.select("p_partkey", IF.full_match(F.col("a"), F.col("b")).alias("full_match"), IF.part_match(F.col("a"), F.col("b")).alias("part_match"))


# Call graph and linking.

@query(f"""SELECT l_partkey AS name, l_suppkey AS file, count(*)::BIGINT AS n, bit_or(i & e)::BIGINT AS cond FROM (SELECT l_partkey, l_suppkey, {LINE_MASK} AS i FROM lineitem) JOIN (SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN {F3} WHEN 1 THEN {T - F3} ELSE {T} END AS BIGINT) AS e FROM part) ON l_partkey = p_partkey WHERE (i & e) <> 0 GROUP BY 1, 2""")
def link_imports_exports(spark: SparkSession, d: str) -> DataFrame:
    imports = D.lines(spark, d).select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("file"), "cond")
    exports = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.expr(f"CAST(CASE p_size % 3 WHEN 0 THEN {F3} WHEN 1 THEN {T - F3} ELSE {T} END AS BIGINT)").alias("cond"))
    return callgraph.link(imports, exports).groupBy("name", "file").agg(F.count(F.lit(1)).alias("n"), F.bit_or("cond").alias("cond"))


_CALLS = f"SELECT l_orderkey * 8 + l_linenumber AS call, l_partkey % 50 AS name, l_suppkey % 7 AS file, {LINE_MASK} AS cond FROM lineitem"
_METHODS = f"SELECT s_suppkey AS method, s_suppkey % 50 AS name, s_nationkey % 7 AS file, CAST(CASE WHEN s_acctbal < 3000 THEN {F4} ELSE {T} END AS BIGINT) AS cond FROM supplier"


def _call_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    calls = D.lines(spark, d).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("call"), (F.col("l_partkey") % 50).alias("name"), (F.col("l_suppkey") % 7).alias("file"), "cond")
    methods = table(spark, d, "supplier").select(F.col("s_suppkey").alias("method"), (F.col("s_suppkey") % 50).alias("name"), (F.col("s_nationkey") % 7).cast("bigint").alias("file"), F.when(F.col("s_acctbal") < 3000, C.lit(F4)).otherwise(C.lit(T)).alias("cond"))
    return calls, methods


@query(f"""WITH c AS ({_CALLS}), m AS ({_METHODS}), local AS (SELECT call, method, c.cond & m.cond AS cond FROM c JOIN m USING (name, file)),
linked AS (SELECT call, method, c.cond & m.cond AS cond FROM (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.name = c.name AND m.file = c.file)) c JOIN m USING (name))
SELECT call, method, bit_or(cond)::BIGINT AS cond FROM (SELECT * FROM local UNION ALL SELECT * FROM linked) WHERE cond <> 0 GROUP BY 1, 2""")
def prefer_local_callee(spark: SparkSession, d: str) -> DataFrame:
    calls, methods = _call_tables(spark, d)
    return callgraph.callees(calls, methods, methods.select("name", "file", "cond"))


@query(f"""WITH c AS ({_CALLS}), m AS ({_METHODS}) SELECT name, file, method, bit_or(c.cond & m.cond)::BIGINT AS cond FROM c JOIN m USING (name, file) GROUP BY ALL HAVING bit_or(c.cond & m.cond) <> 0""")
def callees_reduced(spark: SparkSession, d: str) -> DataFrame:
    calls, methods = _call_tables(spark, d)
    # Calls of one name and file as one, before they meet its methods.
    met = callgraph.grouped(calls, "name", "file").join(methods.withColumnRenamed("cond", "m"), ["name", "file"]).withColumn("cond", C.both(F.col("cond"), F.col("m")))
    return callgraph.grouped(met, "name", "file", "method").where("cond <> 0")


@query(f"""WITH f AS (SELECT l_orderkey AS call, l_suppkey % 7 AS file, bit_or({LINE_MASK}) AS fc FROM lineitem GROUP BY 1, 2), n AS (SELECT l_orderkey AS call, l_partkey % 50 AS name, bit_or({LINE_MASK}) AS nc FROM lineitem GROUP BY 1, 2), m AS ({_METHODS})
SELECT call, method, bit_or(fc & nc & cond)::BIGINT AS cond FROM f JOIN n USING (call) JOIN m USING (name, file) WHERE (fc & nc & cond & {T - F4}) <> 0 GROUP BY 1, 2""")
def callees_by_position(spark: SparkSession, d: str) -> DataFrame:
    """An order calls by any of its parts' names into any of its suppliers' files, where a model without feature 4 allows it."""
    own, (_, methods) = D.lines(spark, d).withColumnRenamed("l_orderkey", "call"), _call_tables(spark, d)
    return callgraph.callees_at(own.select("call", (F.col("l_suppkey") % 7).alias("file"), "cond"), own.select("call", (F.col("l_partkey") % 50).alias("name"), "cond"), methods, T - F4)


@query(f"""WITH c AS (SELECT l_orderkey * 8 + l_linenumber AS call, l_partkey AS object, {LINE_MASK} AS c0 FROM lineitem), k AS (SELECT p_partkey AS object, p_partkey // 10 AS class, CAST(CASE p_partkey % 3 WHEN 0 THEN {F3} WHEN 1 THEN {T - F3} ELSE {T} END AS BIGINT) AS kc FROM part),
f AS (SELECT p_partkey AS object, p_partkey % 50 AS name, p_partkey % 7 AS file FROM part WHERE p_partkey % 2 = 0), m AS ({_METHODS}),
t AS (SELECT class, method, kc & cond AS tc FROM k JOIN f USING (object) JOIN m USING (name, file)) SELECT call, method, bit_or(c0 & kc & tc)::BIGINT AS cond FROM c JOIN k USING (object) JOIN t USING (class) WHERE (c0 & kc & tc) <> 0 GROUP BY 1, 2""")
def pointer_callees(spark: SparkSession, d: str) -> DataFrame:
    """Lines call through their part; ten parts each may point to the same, and every other one names a function."""
    own, (_, methods) = D.lines(spark, d), _call_tables(spark, d)
    calls = own.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("call"), F.col("l_partkey").alias("object"), "cond")
    part, key = table(spark, d, "part"), F.col("p_partkey")
    classes = part.select(key.alias("object"), F.floor(key / 10).alias("class"), F.when(key % 3 == 0, C.lit(F3)).when(key % 3 == 1, C.lit(T - F3)).otherwise(C.lit(T)).alias("cond"))
    functions = part.where(key % 2 == 0).select(key.alias("object"), (key % 50).alias("name"), (key % 7).alias("file"))
    return callgraph.pointer_callees(calls, classes, functions, methods)


@query(f"""WITH c AS ({_CALLS}), m AS (SELECT name, bit_or(cond) AS have FROM ({_METHODS}) GROUP BY 1) SELECT call, bool_and(coalesce((c.cond & have) <> 0, FALSE)) AS known FROM c LEFT JOIN m USING (name) GROUP BY 1""")
def known_targets(spark: SparkSession, d: str) -> DataFrame:
    calls, methods = _call_tables(spark, d)
    return callgraph.known_targets(calls.select("call", "name", "cond"), methods.select("name", "cond"))


@query("""SELECT s_suppkey AS call, s_name AS name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey = 1) AND NOT starts_with(s_name, '__builtin')""")
def user_functions(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "supplier").select(F.col("s_suppkey").alias("call"), F.col("s_name").alias("name"))
    system = table(spark, d, "supplier").join(table(spark, d, "nation").where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"))
    return callgraph.user_functions(calls, system).select("call", "name")


#: Places of parameters by a walk along each call's options: one that the group's condition implies begins a new place.
_PLACES = f"""own AS (SELECT l_orderkey AS call, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, l_partkey AS actual, {LINE_MASK} AS c FROM lineitem),
a(call, k, actual, c, pos, so) AS (SELECT call, k, actual, c, 0, c FROM own WHERE k = 1 UNION ALL SELECT o.call, o.k, o.actual, o.c, CASE WHEN so <> 0 AND (so & o.c) = so THEN pos + 1 ELSE pos END, CASE WHEN so <> 0 AND (so & o.c) = so THEN o.c ELSE so | o.c END FROM a JOIN own o ON o.call = a.call AND o.k = a.k + 1)"""


def _options(spark: SparkSession, d: str) -> DataFrame:
    return D.lines(spark, d, "l_extendedprice").select(F.col("l_orderkey").alias("call"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), F.col("l_partkey").alias("actual"), "cond")


@query(f"""WITH RECURSIVE {_PLACES} SELECT call, pos::INT AS pos, actual, c AS cond FROM a""")
def option_lists(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.positions(_options(spark, d))


@query(f"""WITH RECURSIVE {_PLACES},
f AS (SELECT DISTINCT l_suppkey AS method, pos, 'f' || pos AS formal FROM (SELECT l_suppkey, unnest(range(1 + l_suppkey % 4)) AS pos FROM lineitem)),
e AS (SELECT l_orderkey AS call, l_suppkey AS method, bit_or({LINE_MASK}) AS cond FROM lineitem GROUP BY 1, 2)
SELECT call, method, actual, formal, (cond & c)::BIGINT AS cond FROM e JOIN a USING (call) JOIN f USING (method) WHERE (a.pos = f.pos OR (f.pos = method % 4 AND method % 2 = 0 AND a.pos > f.pos)) AND (cond & c) <> 0""")
def param_zip(spark: SparkSession, d: str) -> DataFrame:
    own = D.lines(spark, d)
    formals = own.select(F.col("l_suppkey").alias("method")).distinct().select("method", F.explode(F.sequence(F.lit(0), (F.col("method") % 4).cast("int"))).alias("pos"))
    formals = formals.select("method", "pos", F.concat(F.lit("f"), F.col("pos").cast("string")).alias("formal"), C.lit(T).alias("cond"), ((F.col("pos") == F.col("method") % 4) & (F.col("method") % 2 == 0)).alias("variadic"))
    edges = own.groupBy(F.col("l_orderkey").alias("call"), F.col("l_suppkey").alias("method")).agg(F.bit_or("cond").alias("cond"))
    return callgraph.zip_parameters(callgraph.positions(_options(spark, d)), formals, edges)


@query("""WITH f AS (SELECT p_partkey % 100 AS s, p_brand, row_number() OVER (PARTITION BY p_partkey % 100 ORDER BY p_partkey) AS k FROM part), v AS (SELECT o_orderkey % 100 AS s, o_orderstatus, row_number() OVER (PARTITION BY o_orderkey % 100 ORDER BY o_orderkey) AS k FROM orders)
SELECT s::BIGINT AS struct, p_brand AS field, o_orderstatus AS value FROM f JOIN v USING (s, k)""")
def zip_initialisers(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "part").select((F.col("p_partkey") % 100).alias("struct"), F.col("p_brand").alias("field"), F.col("p_partkey").alias("place"))
    values = table(spark, d, "orders").select((F.col("o_orderkey") % 100).alias("struct"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("place"))
    return callgraph.zip_initialisers(fields, values)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS f, ps.l2 AS t FROM lineitem JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS l2 FROM lineitem) ps ON l_partkey = p), r(f) AS (SELECT 1::BIGINT UNION SELECT t FROM r JOIN e ON r.f = e.f) SELECT f AS file FROM r""")
def import_closure(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("name"))
    return callgraph.import_closure(spark.createDataFrame([(1,)], "file long"), own, own)


# Conditional sets.


@query(f"""WITH a AS (SELECT l_partkey AS k, bit_or({LINE_MASK}) AS c FROM lineitem WHERE l_quantity < 10 GROUP BY 1), b AS (SELECT l_partkey AS k, bit_or({LINE_MASK}) AS c FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT k, (coalesce(a.c, 0) | coalesce(b.c, 0))::BIGINT AS united, (coalesce(a.c, 0) & ({T} - coalesce(b.c, 0)))::BIGINT AS a_only FROM a FULL JOIN b USING (k)""")
def conditional_sets(spark: SparkSession, d: str) -> DataFrame:
    own = D.lines(spark, d, "l_quantity").withColumnRenamed("l_partkey", "k")
    a, b = conditional.normal(own.where("l_quantity < 10").select("k", "cond")), conditional.normal(own.where("l_quantity > 45").select("k", "cond"))
    both = conditional.union(a, b)
    return both.select("k", F.col("cond").alias("united")).join(conditional.get(conditional.minus(a, b), conditional.plain(both)).withColumnRenamed("cond", "a_only"), "k")


@query(f"""SELECT k, cond, (k % 2 = 0) AS even FROM (SELECT l_partkey AS k, bit_or({LINE_MASK})::BIGINT AS cond FROM lineitem GROUP BY 1)""")
def set_partition(spark: SparkSession, d: str) -> DataFrame:
    parts = conditional.normal(D.lines(spark, d).select(F.col("l_partkey").alias("k"), "cond"))
    even, odd = conditional.partition(parts, F.col("k") % 2 == 0)
    return even.withColumn("even", F.lit(True)).unionByName(odd.withColumn("even", F.lit(False)))


@query(f"""SELECT l.l_orderkey AS n, l.l_partkey AS "left", r.l_suppkey AS "right", (l.c & r.c) AS cond FROM (SELECT l_orderkey, l_partkey, {LINE_MASK} AS c FROM lineitem WHERE l_linenumber % 2 = 1) l JOIN (SELECT l_orderkey, l_suppkey, {LINE_MASK} AS c FROM lineitem WHERE l_linenumber % 2 = 0) r USING (l_orderkey) WHERE (l.c & r.c) <> 0""")
def pair_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Alternatives of two sides: an order's lines of odd and of even number."""
    own = D.lines(spark, d).withColumnRenamed("l_orderkey", "n")
    return alias.pair_assignments(own.where("l_linenumber % 2 = 1").select("n", F.col("l_partkey").alias("left"), "cond"), own.where("l_linenumber % 2 = 0").select("n", F.col("l_suppkey").alias("right"), "cond"))


@query(f"""SELECT "left", "right", bit_or(cond)::BIGINT AS cond FROM (SELECT 's' || l_suppkey AS "left", 'p' || l_partkey AS "right", {LINE_MASK} AS cond FROM lineitem UNION ALL SELECT 't' || l_orderkey, 's' || l_suppkey, {LINE_MASK} FROM lineitem) GROUP BY 1, 2""")
def call_assignments(spark: SparkSession, d: str) -> DataFrame:
    """What calls assign: each line passes its part to its supplier, and gets back the supplier."""
    own, name = D.lines(spark, d), lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    params = own.select(F.col("l_orderkey").alias("call"), F.col("l_suppkey").alias("method"), name("p", "l_partkey").alias("actual"), name("s", "l_suppkey").alias("formal"), "cond")
    returns = own.select(F.col("l_orderkey").alias("call"), name("t", "l_orderkey").alias("target"), name("s", "l_suppkey").alias("returned"), "cond")
    return callgraph.grouped(alias.call_assignments(params, returns), "left", "right")


@query("""WITH o AS (SELECT DISTINCT string_split(regexp_replace(url, '[?#].*$', ''), '/') AS o FROM pages), n AS (SELECT DISTINCT o[:k] AS o FROM o, LATERAL (SELECT unnest(range(1, len(o) + 1)) AS k) x) SELECT array_to_string(o[:-2], '.') AS node, o[-1] AS label, array_to_string(o, '.') AS part FROM n WHERE len(o) > 1""")
def name_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Names that are parts of other ones, by the paths of pages."""
    names = alias.with_parts(table(spark, d, "pages").select(F.split(F.regexp_replace("url", "[?#].*$", ""), "/").alias("object"), C.lit(T).alias("cond"))).withColumn("id", F.array_join("object", "."))
    return alias.prefixes(names).select("node", "label", "part")


@query(f"SELECT event_id, user_id, event_type FROM ({EVENT_SQL}) WHERE ((pc >> 21) & 1) = 1")
def product_projection(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.project(D.events(spark, d), 21).select("event_id", "user_id", "event_type")


@query(f"""SELECT user_id, event_id * 64 + copy AS n, (pc & alt) AS pc FROM ({EVENT_SQL}), (VALUES (0, {F4}::BIGINT), (1, {T - F4}::BIGINT)) v(copy, alt) WHERE event_type = 'view' AND (pc & alt) <> 0 UNION ALL SELECT user_id, event_id * 64, pc FROM ({EVENT_SQL}) WHERE event_type <> 'view'""")
def split_alternatives(spark: SparkSession, d: str) -> DataFrame:
    own = traces(spark, d)
    node = own.select(F.col("event_id").alias("n"), F.col("user_id").alias("method"), F.col("event_type").alias("kind"), F.col("event_type").alias("text"), "pc", F.col("prev").isNull().alias("is_start"), F.col("dst").isNull().alias("is_exit"), F.lit(False).alias("is_call"))
    cfg = own.where("dst IS NOT NULL").select(F.col("event_id").alias("src"), "dst", F.col("pc").alias("cond"))
    node, cfg = rewrite.spread(node, cfg)
    halves = F.array(F.struct(F.lit(0).alias("k"), C.lit(F4).alias("cond")), F.struct(F.lit(1).alias("k"), C.lit(T - F4).alias("cond")))
    alternatives = node.where("kind = 'view'").select("n", F.explode(halves).alias("x")).select("n", "x.k", F.lit("x").alias("text"), "x.cond")
    return rewrite.split_alternatives(node, cfg, alternatives)[0].select(F.col("method").alias("user_id"), "n", "pc")


@query(f"""WITH t AS (SELECT * FROM ({_NEXT})), s AS (SELECT user_id, event_id * 64 AS n, pc, event_type, prev IS NULL AS first, dst IS NULL AS last FROM t)
SELECT user_id, n, FALSE AS is_start, (last AND event_type = 'error') AS is_exit FROM s UNION ALL SELECT user_id, n - 1, TRUE, FALSE FROM s WHERE first UNION ALL SELECT user_id, n + 62, FALSE, TRUE FROM s WHERE last AND event_type <> 'error'""")
def single_entry_and_returns(spark: SparkSession, d: str) -> DataFrame:
    own = traces(spark, d)
    kind = F.when(F.col("event_type") == "error", "return").otherwise(F.col("event_type"))
    node = own.select(F.col("event_id").alias("n"), F.col("user_id").alias("method"), kind.alias("kind"), F.lit("").alias("text"), "pc", F.col("prev").isNull().alias("is_start"), F.col("dst").isNull().alias("is_exit"), F.lit(False).alias("is_call"))
    cfg = own.where("dst IS NOT NULL").select(F.col("event_id").alias("src"), "dst", F.col("pc").alias("cond"))
    node, _ = rewrite.apply(node, cfg)
    return node.select(F.col("method").alias("user_id"), "n", "is_start", "is_exit")


@query(f"""WITH t AS (SELECT event_id * 64 AS n, dst * 64 AS m, pc, event_type = 'purchase' AS nests, lead(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_nests FROM ({_NEXT}))
SELECT n AS src, m - CASE WHEN next_nests THEN 32 ELSE 0 END AS dst, pc AS cond FROM t WHERE m IS NOT NULL UNION ALL SELECT n - 32 + k, CASE k WHEN 0 THEN n - 31 ELSE n END, pc FROM t, (SELECT unnest([0, 1]) AS k) WHERE nests""")
def nested_calls(spark: SparkSession, d: str) -> DataFrame:
    """Edges of traces in which each purchase has two calls inside, which come before it."""
    own = traces(spark, d)
    node = own.select(F.col("event_id").alias("n"), F.col("user_id").alias("method"), F.col("event_type").alias("kind"), F.col("event_type").alias("text"), "pc", F.col("prev").isNull().alias("is_start"), F.col("dst").isNull().alias("is_exit"), (F.col("event_type") == "purchase").alias("is_call"))
    node, cfg = rewrite.spread(node, own.where("dst IS NOT NULL").select(F.col("event_id").alias("src"), "dst", F.col("pc").alias("cond")))
    nested = node.where("kind = 'purchase'").select("n", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.lit("f()").alias("call"))
    return rewrite.hoist_calls(node, cfg, nested)[1]


@query(f"""WITH c AS (SELECT unnest(range(32))::INT AS config), v AS (SELECT l_orderkey AS n, config, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey::VARCHAR) AS text FROM lineitem, c WHERE (({LINE_MASK} >> config) & 1) = 1 GROUP BY 1, 2),
a AS (SELECT n, text, bit_or(1::BIGINT << config)::BIGINT AS cond, min(config) AS first FROM v GROUP BY 1, 2) SELECT n, row_number() OVER (PARTITION BY n ORDER BY first)::INT - 1 AS k, text, cond FROM a""")
def refined_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Orders as statements whose lines are pieces with overlapping conditions: the disjoint variants of each."""
    return rewrite.covers(D.lines(spark, d).select(F.col("l_orderkey").alias("n"), F.col("l_linenumber").alias("piece"), F.col("l_partkey").cast("string").alias("text"), "cond"))


@query(f"""WITH t AS (SELECT *, {EVENT_VAR} AS var, row_number() OVER w AS place, first_value(pc) OVER w & coalesce(bit_and(pc | {F4} | {D.F2}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {T}) AS held FROM ({EVENT_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT event_id, place, held, v, count(*) FILTER (WHERE event_type IN ('click', 'signup') AND place > 1 AND var = v) OVER (PARTITION BY user_id, v ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM t, (SELECT 'v' || unnest(range(4)) AS v))
SELECT event_id AS n, v AS var, held::BIGINT AS cond FROM r WHERE place > 1 AND earlier = 0 AND held <> 0""")
def uninitialised_memory(spark: SparkSession, d: str) -> DataFrame:
    """The problem of uninitialised variables over users' traces: all are declared by the first statement, clicks and signups assign them."""
    # Events move once to their users; the program's tables are made of what is written then.
    own = fixpoint.saved(traces(spark, d).select("event_id", "user_id", "event_type", "pc", "dst", F.col("prev").isNull().alias("first"), F.expr(EVENT_VAR).alias("var")))
    node = own.select(F.col("event_id").alias("n"), F.col("user_id").alias("method"), F.col("event_type").alias("kind"), F.col("event_type").alias("text"), "pc", F.col("first").alias("is_start"), F.col("dst").isNull().alias("is_exit"), F.lit(False).alias("is_call"))
    cfg = own.where("dst IS NOT NULL").select(F.col("event_id").alias("src"), "dst", F.col("pc").bitwiseOR(C.lit(F4 | D.F2)).alias("cond"))
    calls = node.where("is_call").select(F.col("n").alias("call"), "method", F.col("pc").alias("cond"))
    starts, program = node.where("is_start").select("n"), Program(node, cfg, calls)
    declared = starts.select("n", F.explode(F.array(*(F.lit(f"v{k}") for k in range(4)))).alias("var"))
    solver = Solver(program, IF.UninitialisedUse(program, declared, own.where("event_type IN ('click', 'signup')").select(F.col("event_id").alias("n"), "var"), starts))
    return solver.values(solver.path_edges()).where("d <> ''").select("n", F.col("d").alias("var"), "cond")


# Fixpoints.


def _reached(start: str, edges: str) -> str:
    """Brute force: each configuration for itself."""
    return f"""WITH RECURSIVE e AS ({edges}), c AS (SELECT unnest(range(32)) AS cfg), x AS MATERIALIZED (SELECT src, dst, cfg FROM e, c WHERE ((cond >> cfg::INT) & 1) = 1),
s(node, cfg) AS ({start}), r(node, cfg) AS (SELECT node, cfg FROM s UNION SELECT x.dst, r.cfg FROM r JOIN x ON x.src = r.node AND x.cfg = r.cfg)"""


_SUPPLY = f"""SELECT src, dst, bit_or(cond) AS cond FROM (SELECT 2 * l_suppkey AS src, 2 * l_partkey + 1 AS dst, {LINE_MASK} AS cond FROM lineitem UNION ALL SELECT 2 * l_partkey + 1, 2 * l_suppkey, {LINE_MASK} FROM lineitem) GROUP BY 1, 2"""
_START = "SELECT 2::BIGINT, cfg FROM c"


@query(_reached(_START, _SUPPLY) + " SELECT node, sum(1::BIGINT << cfg::INT)::BIGINT AS cond FROM r GROUP BY 1")
def lifted_reach_cyclic(spark: SparkSession, d: str) -> DataFrame:
    own = D.lines(spark, d)
    return fixpoint.reach(spark.createDataFrame([(2, T)], "node long, cond long"), D.supply_edges(own, "cond"), rows=2 * own.count())


@query("""WITH RECURSIVE c AS (SELECT unnest(range(256)) AS cfg),
l AS (SELECT DISTINCT 2 * l_suppkey AS s, 2 * l_partkey + 1 AS p, l_returnflag AS f, l_linestatus AS t, l_linenumber % 3 AS k FROM lineitem),
h AS (SELECT DISTINCT s, p, cfg FROM l, c WHERE ((cfg >> CASE f WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) & 1) = 1 AND ((cfg >> 3) & 1) = CASE t WHEN 'F' THEN 1 ELSE 0 END AND ((cfg >> (5 + k)::INT) & 1) = 1),
x AS MATERIALIZED (SELECT s AS src, p AS dst, cfg FROM h UNION ALL SELECT p, s, cfg FROM h),
r(node, cfg) AS (SELECT 2::BIGINT, cfg FROM c UNION SELECT x.dst, r.cfg FROM r JOIN x ON x.src = r.node AND x.cfg = r.cfg)
SELECT node, (cfg // 32)::INT AS block, sum(1::BIGINT << (cfg % 32)::INT)::BIGINT AS cond FROM r GROUP BY 1, 2""")
def lifted_reach_wide(spark: SparkSession, d: str) -> DataFrame:
    """Eight features: features 5, 6 and 7 say which lines of an order are there. A condition's eight blocks are in four words."""
    own = D.lines(spark, d, "l_linenumber")
    more = lambda b: F.when(F.col("l_linenumber") % 3 == 0, C.wide_feature(5, F.lit(b))).when(F.col("l_linenumber") % 3 == 1, C.wide_feature(6, F.lit(b))).otherwise(C.wide_feature(7, F.lit(b)))
    words = [f"w{k}" for k in range(4)]
    edges = own.select("l_suppkey", "l_partkey", *(w.alias(n) for w, n in zip(C.words(8, lambda b: C.both(F.col("cond"), more(b))), words, strict=True)))
    start = spark.createDataFrame([(2,)], "node long").select("node", *(w.alias(n) for w, n in zip(C.words(8, lambda b: C.lit(T)), words, strict=True)))
    lists = fixpoint.laid(D.supply_edges(edges, *words), *words, rows=2 * own.count())
    reached = fixpoint.fixpoint(start, fixpoint.along(lists, tuple(words)), ["node"], tuple(words))
    return reached.select("node", F.explode(C.of_words(8, words)).alias("at")).select("node", "at.block", "at.cond")


#: Whether feature f is enabled in sampled configuration s, for features of any number.
_ENABLED = "(f * 37 + s * 101 + f * s) % 7 < 4"


def _enabled(f: int, s: int) -> bool:
    """_ENABLED in Python."""
    return (f * 37 + s * 101 + f * s) % 7 < 4


@query(f"""WITH c AS (SELECT s, f, {_ENABLED} AS v FROM (SELECT unnest(range(32)) AS s), (SELECT unnest(range(1, 41)) AS f)),
n AS (SELECT n_nationkey, s FROM nation JOIN c ON f = 1 + n_nationkey AND v),
k AS (SELECT c_custkey, s FROM n JOIN customer ON c_nationkey = n_nationkey JOIN c USING (s) WHERE f = 26 + ascii(c_mktsegment) % 5 AND v = (c_custkey % 3 <> 0)),
o AS (SELECT o_orderkey, s FROM k JOIN orders ON o_custkey = c_custkey JOIN c USING (s) WHERE f = CASE o_orderstatus WHEN 'F' THEN 31 WHEN 'O' THEN 32 ELSE 33 END AND v = (o_orderkey % 2 = 0)),
p AS (SELECT DISTINCT l_partkey, s FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN c USING (s) WHERE f = 34 + l_linenumber % 7 AND v)
SELECT l_partkey AS part, sum(1::BIGINT << s::INT)::BIGINT AS sampled FROM p GROUP BY 1""")
def reach_forty_features(spark: SparkSession, d: str) -> DataFrame:
    """Parts that nations reach by way of customers, orders and lines under conditions over forty features, lifted, and then asked in 32 sampled configurations."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    signed = lambda f, on: Q.literal(F.when(on, f).otherwise(-f))
    segment, status = F.lit(26) + F.ascii("c_mktsegment") % 5, F.when(F.col("o_orderstatus") == "F", 31).when(F.col("o_orderstatus") == "O", 32).otherwise(33)
    start = table(spark, d, "nation").select(name("n", "n_nationkey").alias("node"), Q.literal(1 + F.col("n_nationkey")).alias("value"))
    edges = table(spark, d, "customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"), signed(segment, F.col("c_custkey") % 3 != 0).alias("weight"))
    edges = edges.unionByName(table(spark, d, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), signed(status, F.col("o_orderkey") % 2 == 0).alias("weight")))
    edges = edges.unionByName(table(spark, d, "lineitem").select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst"), Q.literal(F.lit(34) + F.col("l_linenumber") % 7).alias("weight")))
    reached = lattice.reach(start, edges, lattice.COVER, Q.both).where("node LIKE 'p%'")
    configs = [{f for f in range(1, 41) if _enabled(f, s)} for s in range(32)]
    return reached.select(F.substr("node", F.lit(2)).cast("bigint").alias("part"), Q.held_in(F.col("value"), configs).alias("sampled")).where("sampled <> 0")


_LEFT = _SUPPLY.replace("FROM lineitem", "FROM lineitem WHERE l_orderkey % 10 <> 3")


@query(_reached(_START, _LEFT) + " SELECT node, sum(1::BIGINT << cfg::INT)::BIGINT AS cond FROM r GROUP BY 1")
def reach_after_removal(spark: SparkSession, d: str) -> DataFrame:
    """The supply graph's reachability, finished, after a tenth of the orders has been taken back."""
    start = spark.createDataFrame([(2, T)], "node long, cond long")
    own = D.lines(spark, d).withColumn("left", F.when(F.col("l_orderkey") % 10 != 3, F.col("cond")).otherwise(C.lit(0)))
    lists = fixpoint.laid(D.supply_edges(own, "cond", "left"), "cond", "left", rows=2 * own.count())
    return fixpoint.left_reach(fixpoint.fixpoint(start, fixpoint.along(lists), ["node"]), start, lists)


@query(f"""WITH RECURSIVE e AS ({_SUPPLY}), r(node) AS (SELECT 2::BIGINT UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r""")
def ifds_reach(spark: SparkSession, d: str) -> DataFrame:
    own = D.lines(spark, d)
    return fixpoint.plain_reach(spark.createDataFrame([(2,)], "node long"), D.supply_edges(own), rows=2 * own.count())


@query("""WITH RECURSIVE l AS (SELECT 2 * l_suppkey AS s, 2 * l_partkey + 1 AS p, min(l_quantity::INT) AS q FROM lineitem GROUP BY 1, 2), e AS MATERIALIZED (SELECT s AS src, p AS dst, q FROM l UNION ALL SELECT p, s, q FROM l),
r(node, t) AS (SELECT 2::BIGINT, unnest(range(51))::INT UNION SELECT e.dst, r.t FROM r JOIN e ON e.src = r.node AND e.q <= r.t) SELECT node, min(t) AS peak FROM r GROUP BY 1""")
def least_peaks(spark: SparkSession, d: str) -> DataFrame:
    """A lattice of numbers: for each supplier and part the least quantity that some way to it never exceeds."""
    own = D.lines(spark, d, "l_quantity").select((2 * F.col("l_suppkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst"), F.col("l_quantity").cast("int").alias("weight"))
    both = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return lattice.reach(spark.createDataFrame([(2, 0)], "node long, value int"), both, lattice.LEAST, F.greatest).withColumnRenamed("value", "peak")


@query(f"""WITH s AS (SELECT r_regionkey, {T}::BIGINT AS c FROM region), n AS (SELECT n_nationkey, c & CASE WHEN n_nationkey % 2 = 0 THEN {F4} ELSE {T} END AS c FROM s JOIN nation ON n_regionkey = r_regionkey),
k AS (SELECT c_custkey, c & CASE c_mktsegment WHEN 'BUILDING' THEN {F3} ELSE {T} END AS c FROM n JOIN customer ON c_nationkey = n_nationkey), o AS (SELECT o_orderkey, c & {ORDER_MASK} AS c FROM k JOIN orders ON o_custkey = c_custkey),
p AS (SELECT l_partkey, bit_or(c & {LINE_MASK})::BIGINT AS cond FROM o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT l_partkey AS part, cond FROM p WHERE cond <> 0""")
def lifted_reach_dag(spark: SparkSession, d: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nation, customer, orders = (table(spark, d, x) for x in ("nation", "customer", "orders"))
    edges = nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), F.when(F.col("n_nationkey") % 2 == 0, C.lit(F4)).otherwise(C.lit(T)).alias("cond"))
    edges = edges.unionByName(customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"), F.when(F.col("c_mktsegment") == "BUILDING", C.lit(F3)).otherwise(C.lit(T)).alias("cond")))
    edges = edges.unionByName(orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.expr(ORDER_MASK).alias("cond")))
    edges = edges.unionByName(D.lines(spark, d).select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst"), "cond"))
    start = table(spark, d, "region").select(name("r", "r_regionkey").alias("node"), C.lit(T).alias("cond"))
    return fixpoint.reach(start, edges).where("node LIKE 'p%'").select(F.substr("node", F.lit(2)).cast("bigint").alias("part"), "cond")


_LINKS_LEFT = f"""SELECT 2 * l_suppkey AS src, 2 * l_partkey + 1 AS dst, bit_or({LINE_MASK}) AS cond FROM lineitem WHERE l_orderkey % 10 <> 3 GROUP BY 1, 2"""
_LINKS = f"""SELECT 2 * l_suppkey AS src, 2 * l_partkey + 1 AS dst, bit_or({LINE_MASK}) AS cond FROM lineitem GROUP BY 1, 2"""


@query(f"""WITH RECURSIVE l AS ({_LINKS}), b AS (SELECT src, dst, cond FROM l UNION ALL SELECT dst, src, cond FROM l), c AS (SELECT unnest(range(32))::INT AS config), n AS (SELECT DISTINCT src AS node FROM b), x AS MATERIALIZED (SELECT src, dst, config FROM b, c WHERE ((cond >> config) & 1) = 1),
r(config, node, label) USING KEY (config, node) AS (SELECT config, node, node FROM n, c UNION SELECT s.config, s.node, s.label FROM (SELECT x.config, x.dst AS node, min(r.label) AS label FROM r JOIN x ON x.src = r.node AND x.config = r.config GROUP BY 1, 2) s JOIN recurring.r k ON k.config = s.config AND k.node = s.node WHERE s.label < k.label) SELECT node, label AS class, sum(1::BIGINT << config)::BIGINT AS cond FROM r GROUP BY 1, 2""")
def alias_classes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts that lines connect, in each configuration."""
    own = D.lines(spark, d).select((2 * F.col("l_suppkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b"), "cond")
    return fixpoint.classes(None, own, T)


@query(f"""WITH RECURSIVE l AS ({_LINKS_LEFT}), b AS (SELECT src, dst, cond FROM l UNION ALL SELECT dst, src, cond FROM l), c AS (SELECT unnest(range(32))::INT AS config), n AS (SELECT DISTINCT unnest([2 * l_suppkey, 2 * l_partkey + 1]) AS node FROM lineitem), x AS MATERIALIZED (SELECT src, dst, config FROM b, c WHERE ((cond >> config) & 1) = 1),
r(config, node, label) USING KEY (config, node) AS (SELECT config, node, node FROM n, c UNION SELECT s.config, s.node, s.label FROM (SELECT x.config, x.dst AS node, min(r.label) AS label FROM r JOIN x ON x.src = r.node AND x.config = r.config GROUP BY 1, 2) s JOIN recurring.r k ON k.config = s.config AND k.node = s.node WHERE s.label < k.label) SELECT node, label AS class, sum(1::BIGINT << config)::BIGINT AS cond FROM r GROUP BY 1, 2""")
def classes_after_removal(spark: SparkSession, d: str) -> DataFrame:
    """The same classes after a tenth of the orders has been taken back: only classes that lost a link are made anew."""
    left = F.bit_or(F.when(F.col("l_orderkey") % 10 != 3, F.col("cond")).otherwise(C.lit(0))).alias("left")
    own = D.lines(spark, d).groupBy((2 * F.col("l_suppkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b")).agg(F.bit_or("cond").alias("cond"), left)
    own = fixpoint.saved(own)
    removed = fixpoint.without(own, F.col("cond"), F.col("left")).select("a", "b", "cond")
    before = fixpoint.classes(None, own.select("a", "b", "cond"), T, once=True)
    found = fixpoint.classes_without(before, own.select("a", "b", F.col("left").alias("cond")).where("cond <> 0"), removed, T)
    fixpoint.dropped(before, own)
    return found


@query()
def alias_congruence(spark: SparkSession, d: str) -> DataFrame:
    """Each line assigns its supplier's pointer to its part's and reads the field of its place through both; all lines, all configurations.

    node (name in dotted form), class (number of its least name), cond. No SQL: recursion over equal prefixes is beyond it.
    """
    own = D.lines(spark, d)
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    p, s, f = name("p", "l_partkey"), name("s", "l_suppkey"), name("f", "l_linenumber")
    # Few of the names differ, so that lines are grouped by their numbers before names are made.
    read = lambda kind, c: own.groupBy(c, "l_linenumber").agg(F.bit_or("cond").alias("cond")).select(F.array(name(kind, c), F.lit("*"), f).alias("object"), "cond")
    names = read("p", "l_partkey").unionByName(read("s", "l_suppkey"))
    assignments = fixpoint.saved(own.groupBy("l_partkey", "l_suppkey").agg(F.bit_or("cond").alias("cond")).select(F.array(p).alias("left"), F.array(s).alias("right"), "cond"))
    found = alias.alias_classes(names, assignments).select(F.array_join("object", ".").alias("node"), "class", "cond")
    fixpoint.dropped(assignments)
    return found


@query(f"""WITH c AS (SELECT unnest(range(32))::INT AS config), m AS (SELECT c_custkey AS k, bit_or({ORDER_MASK} & {LINE_MASK}) AS cond FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT config, count(*) FILTER (WHERE ((cond >> config) & 1) = 1)::BIGINT AS lifted, 0::BIGINT AS missing FROM c, m GROUP BY 1""")
def differential_eval(spark: SparkSession, d: str) -> DataFrame:
    """Customers that reach a line, in each configuration: lifted, and as one product after another has it."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k"), F.expr(ORDER_MASK).alias("o"))
    met = D.lines(spark, d).join(orders, "l_orderkey").withColumn("cond", C.both(F.col("cond"), F.col("o")))
    lifted = met.groupBy("k").agg(F.bit_or("cond").alias("cond"))
    configs = sampling.config_table(spark).select("config")
    # Each product for itself: its lines and orders only, with nothing conditional. Lines meet their order once and then are told apart by product, so that no product moves its lines.
    own = D.lines(spark, d).join(orders, "l_orderkey").join(F.broadcast(configs), C.holds_in(F.col("cond"), F.col("config")) & C.holds_in(F.col("o"), F.col("config")))
    sampled = own.select("k", "config")
    missing, _ = evaluate.compare(lifted, sampled, configs, ["k"])
    n = lifted.join(F.broadcast(configs), C.holds_in(F.col("cond"), F.col("config"))).groupBy("config").agg(F.count(F.lit(1)).alias("lifted"))
    out = configs.join(n, "config", "left").join(missing.groupBy("config").agg(F.count(F.lit(1)).alias("missing")), "config", "left")
    return out.select("config", F.coalesce("lifted", F.lit(0)).alias("lifted"), F.coalesce("missing", F.lit(0)).alias("missing"))


@query(_reached(_START, _SUPPLY) + f""", q AS MATERIALIZED (SELECT DISTINCT {LINE_MASK} AS pc FROM lineitem), z(taken, config) AS (SELECT 0::BIGINT, -1 UNION ALL SELECT taken | (1::BIGINT << bit_count((m & -m) - 1)::INT), bit_count((m & -m) - 1)::INT FROM (SELECT taken, (SELECT min(pc) FROM q WHERE (pc & taken) = 0) AS m FROM z) WHERE m IS NOT NULL),
n AS (SELECT node, count(*) FILTER (WHERE cfg IN (SELECT config FROM z WHERE config >= 0))::BIGINT AS n FROM r GROUP BY 1)
SELECT count(*)::BIGINT AS facts, count(*) FILTER (WHERE n > 0)::BIGINT AS covered, sum(n)::BIGINT AS matches, max(n) AS most, min(n) AS least, (100 * count(*) FILTER (WHERE n > 0)) // count(*) AS percent, 0::BIGINT AS missing FROM n""")
def sampled_reach(spark: SparkSession, d: str) -> DataFrame:
    """Lifted reachability held against each product that covers the lines' conditions, solved for itself."""
    own = D.lines(spark, d)
    lists = fixpoint.laid(D.supply_edges(own, "cond"), "cond", rows=2 * own.count())
    configs = sampling.config_table(spark, sampling.code_coverage(own.select("cond")))
    start, one = spark.createDataFrame([(2, T)], "node long, cond long"), C.lit(1)
    # A product has its own edges and nothing conditional; these are the lifted problem's, left out where they aren't in it.
    product = lambda config: fixpoint.along(lists, mask=lambda to, _: F.when(C.holds_in(to["cond"], config), one).otherwise(C.lit(0)))
    alone = lambda config: fixpoint.fixpoint(start.select("node", one.alias("cond")), product(config), ["node"]).select("node")
    return evaluate.sampled_against_lifted(fixpoint.fixpoint(start, fixpoint.along(lists), ["node"]), alone, configs, ["node"])[2]


@query(f"""WITH m AS (SELECT l_partkey AS k, bit_or({LINE_MASK}) AS cond FROM lineitem GROUP BY 1), n AS (SELECT k, bit_count(cond)::BIGINT AS n FROM m)
SELECT count(*)::BIGINT AS facts, count(*) FILTER (WHERE n > 0)::BIGINT AS covered, sum(n)::BIGINT AS matches, max(n) AS most, min(n) AS least, (100 * count(*) FILTER (WHERE n > 0)) // count(*) AS percent FROM n""")
def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    own = D.lines(spark, d).select(F.col("l_partkey").alias("k"), "cond")
    lifted = own.groupBy("k").agg(F.bit_or("cond").alias("cond"))
    configs = sampling.config_table(spark).select("config")
    sampled = own.join(F.broadcast(configs), C.holds_in(F.col("cond"), F.col("config"))).select("k", "config")
    return evaluate.summary(evaluate.compare(lifted, sampled, configs, ["k"])[1])


# Sampling.


@query(f"""SELECT DISTINCT pc AS cond, bit_count((pc & -pc) - 1)::INT AS config FROM ({EVENT_SQL})""")
def condition_coverage(spark: SparkSession, d: str) -> DataFrame:
    return sampling.condition_coverage(D.events(spark, d).select(F.col("pc").alias("cond")))


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT pc FROM ({EVENT_SQL})), s(taken, config) AS (SELECT 0::BIGINT, -1 UNION ALL SELECT taken | (1::BIGINT << bit_count((m & -m) - 1)::INT), bit_count((m & -m) - 1)::INT FROM (SELECT taken, (SELECT min(pc) FROM p WHERE (pc & taken) = 0) AS m FROM s) WHERE m IS NOT NULL)
SELECT config::INT AS config FROM s WHERE config >= 0""")
def code_coverage(spark: SparkSession, d: str) -> DataFrame:
    chosen = sampling.code_coverage(D.events(spark, d).select(F.col("pc").alias("cond")))
    return sampling.config_table(spark, chosen).select("config")


# Results and reports.


@query(f"""SELECT user_id, count(DISTINCT (event_type, k))::BIGINT AS n_sinks, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS origins, bit_or(pc)::BIGINT AS cond FROM ({EVENT_SQL}) WHERE event_type IN ('view', 'error') GROUP BY 1""")
def sinks_by_node(spark: SparkSession, d: str) -> DataFrame:
    found = D.events(spark, d).where(F.col("event_type").isin("view", "error")).select(F.col("user_id").alias("n"), F.col("event_type").alias("o_var"), "k", "pc")
    found = found.groupBy("n", "o_var", "k").agg(F.bit_or("pc").alias("cond"))
    return IF.by_statement(found).withColumnRenamed("n", "user_id")


@query(f"""SELECT event_id, pc AS cond FROM ({EVENT_SQL}) WHERE lower(event_type) = 'purchase'""")
def tainted_sinks(spark: SparkSession, d: str) -> DataFrame:
    return IF.of_origin(D.events(spark, d).select("event_id", F.col("event_type").alias("o_var"), F.col("pc").alias("cond")), "PURCHASE").select("event_id", "cond")


@query("""SELECT p_brand AS var, p_partkey AS at FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_size, p_partkey) AS k FROM part WHERE p_size % 2 = 1) WHERE k = 1""")
def dedupe_seeds_first(spark: SparkSession, d: str) -> DataFrame:
    decls = table(spark, d, "part").select(F.col("p_brand").alias("var"), F.col("p_partkey").alias("at"), F.col("p_type").alias("file"), F.col("p_size").alias("line"), F.when(F.col("p_size") % 2 == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("assignors"))
    files = decls.select("file").distinct()
    return IF.global_sources(files, decls, files)


@query("""SELECT base, array_to_string(o, '.') AS object FROM (SELECT split_part(p_type, ' ', 1) AS base, string_split(p_type || CASE WHEN p_size > 40 THEN ' *' ELSE '' END, ' ') AS o FROM part) QUALIFY row_number() OVER (PARTITION BY base ORDER BY len(o) DESC, o) = 1""")
def longest_name_per_base(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.split(F.concat("p_type", F.when(F.col("p_size") > 40, " *").otherwise("")), " ").alias("object"))
    return alias.longest_per_base(names).select("base", F.array_join("object", ".").alias("object"))


@query(f"""WITH e AS (SELECT o_custkey AS caller, l_suppkey AS callee, bit_or({ORDER_MASK} & {LINE_MASK})::BIGINT AS cond FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT * FROM e WHERE cond <> 0""")
def call_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    node = table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("method"), F.expr(ORDER_MASK).alias("o"))
    calls = D.lines(spark, d).join(node, F.col("l_orderkey") == F.col("n")).select(F.col("l_orderkey").alias("call"), F.col("l_suppkey").alias("method"), C.both(F.col("cond"), F.col("o")).alias("cond"))
    return graphs.call_graph(calls, node.select("n", "method"))


@query(f"""WITH e AS (SELECT s_suppkey, s_nationkey, s_name, CAST(CASE s_suppkey % 3 WHEN 0 THEN {T} WHEN 1 THEN {F3} ELSE {T - F3} END AS BIGINT) AS c FROM supplier), t AS (SELECT *, CASE c WHEN {T} THEN 'True' WHEN {F3} THEN 'F3' ELSE '!F3' END AS x FROM e)
SELECT 0 AS place, 'digraph "" {{' AS line UNION ALL SELECT 1, 'node [shape=record];' UNION ALL SELECT 4, '}}' UNION ALL
SELECT 2, '"n' || s_suppkey || '"[label="{{{{' || replace(s_name, ' ', '\\ ') || '}}|{{No Position available}}|' || x || '}}", color="black", fontname="Calibri", style="filled", fillcolor="' || CASE c WHEN {T} THEN 'white' ELSE '#CD5200' END || '"];' FROM t UNION ALL
SELECT 3, '"r' || s_nationkey || '" -> "n' || s_suppkey || '"[label="' || x || '", color="' || CASE c WHEN {T} THEN 'black' ELSE 'red' END || '", style="setlinewidth(1)"];' FROM t""")
def graph_dot_lines(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name", F.when(F.col("s_suppkey") % 3 == 0, C.lit(T)).when(F.col("s_suppkey") % 3 == 1, C.lit(F3)).otherwise(C.lit(T - F3)).alias("cond"))
    name = F.concat(F.lit("n"), F.col("s_suppkey").cast("string"))
    nodes = own.select(name.alias("node"), F.col("s_name").alias("text"), F.lit(None).cast("string").alias("position"), "cond", F.lit(False).alias("is_function"))
    return graphs.dot_lines(nodes, own.select(F.concat(F.lit("r"), F.col("s_nationkey").cast("string")).alias("src"), name.alias("dst"), "cond"))


@query("""SELECT s_nationkey AS nation, '{"nation":' || s_nationkey || ',"items":[' || string_agg('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}', ',' ORDER BY s_suppkey) || ']}' AS document FROM supplier GROUP BY 1""")
def json_report(spark: SparkSession, d: str) -> DataFrame:
    return graphs.json_documents(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_name"), "nation")


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', '') AS name, regexp_replace(url, '\.[^./]*$', '') || '.ast' AS ast FROM pages""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.plain_name(F.col("url")).alias("name"), X.with_extension(F.col("url"), ".ast").alias("ast"))


# The whole solver.


_ORDER_PROGRAM = f"""
o AS (SELECT o_orderkey AS m, o_custkey, {ORDER_MASK} AS o_mask, lead(o_orderkey) OVER w AS nxt, row_number() OVER w = 1 AS entry FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
l0 AS (SELECT m, o_mask, nxt, entry, l_quantity, l_partkey % 5 AS t, l_suppkey % 3 AS s, l_suppkey % 5 AS u, {LINE_MASK} AS c, row_number() OVER w AS k, lead(1) OVER w IS NULL AS last
       FROM lineitem JOIN o ON l_orderkey = m WINDOW w AS (PARTITION BY m ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
l AS (SELECT m, m * 1024 + k AS n, k, last, o_mask AS pc, entry, nxt, 'p' || t AS target, 's' || s AS source, 'p' || u AS other, c | {F4} AS step, c | {D.F2} AS goes, l_quantity >= 45 AND nxt IS NOT NULL AND NOT last AS is_call FROM l0)"""
#: Orders call each other without recursion, so that walks of single facts, with the calls that are open, are the whole truth. A walk: place, fact at the
#: start of the method, fact, condition, open calls with their own first facts.
_WALKS = f"""
WITH RECURSIVE {_ORDER_PROGRAM},
walk(n, f, d, cond, open) AS (
  SELECT n, {{'v': '', 'a': -1, 'o': '', 'b': -1}}, {{'v': '', 'a': -1, 'o': '', 'b': -1}}, pc, []::STRUCT(n BIGINT, f STRUCT(v VARCHAR, a BIGINT, o VARCHAR, b BIGINT))[] FROM l WHERE k = 1 AND entry
  UNION
  SELECT * FROM (
  -- on to the next statement
  SELECT w.n + 1 AS n, w.f, x.d, w.cond & l.step AS cond, w.open FROM walk w JOIN l USING (n), LATERAL (SELECT unnest(
    CASE WHEN w.d.v = '' THEN CASE WHEN l.is_call THEN [w.d] WHEN l.k = 1 THEN [w.d, {{'v': l.source, 'a': w.n, 'o': l.source, 'b': w.n}}] ELSE [w.d, {{'v': l.target, 'a': w.n, 'o': l.target, 'b': w.n}}] END
         WHEN l.is_call THEN CASE WHEN w.d.v = CASE WHEN l.k = 1 THEN l.source ELSE l.target END THEN [] ELSE [w.d] END
         WHEN l.k = 1 THEN CASE WHEN w.d.v = l.source THEN [] ELSE [w.d] END
         ELSE list_distinct(CASE WHEN w.d.v = l.target THEN [] ELSE [w.d] END || CASE WHEN w.d.v IN (l.source, l.other) THEN [{{'v': l.target, 'a': w.n, 'o': w.d.o, 'b': w.d.b}}] ELSE [] END) END) AS d) x
  WHERE NOT l.last
  UNION ALL
  -- into the next order
  SELECT l.nxt * 1024 + 1, x.d, x.d, w.cond & l.goes & c.pc, list_append(w.open, {{'n': w.n, 'f': w.f}}) FROM walk w JOIN l USING (n) JOIN l c ON c.n = l.nxt * 1024 + 1, LATERAL (SELECT unnest(
    CASE WHEN w.d.v = '' THEN [w.d] WHEN w.d.v = l.source THEN [{{'v': l.other, 'a': w.n, 'o': l.other, 'b': w.n}}, {{'v': l.other, 'a': w.n, 'o': w.d.o, 'b': w.d.b}}] ELSE [] END) AS d) x
  WHERE l.is_call
  UNION ALL
  -- back over the call that is open
  SELECT r.n + 1, w.open[-1].f, x.d, w.cond & r.step, w.open[:-2] FROM walk w JOIN l USING (n) JOIN l r ON r.n = w.open[-1].n, LATERAL (SELECT unnest(
    CASE WHEN w.d.v = '' THEN [w.d] WHEN w.d.v IN (l.source, l.target) THEN
      [{{'v': CASE WHEN r.k = 1 THEN r.source ELSE r.target END, 'a': r.n, 'o': CASE WHEN r.k = 1 THEN r.source ELSE r.target END, 'b': r.n}}, {{'v': CASE WHEN r.k = 1 THEN r.source ELSE r.target END, 'a': r.n, 'o': w.d.o, 'b': w.d.b}}] ELSE [] END) AS d) x
  WHERE l.last AND len(w.open) > 0) WHERE cond <> 0)
"""


_SINKS = """SELECT n, 'assign' AS kind, o AS o_var, b AS o_at, assignee, bit_or(cond)::BIGINT AS cond FROM (
  SELECT n, w.d.o AS o, w.d.b AS b, l.target AS assignee, w.cond & l.step AS cond FROM walk w JOIN l USING (n) WHERE NOT l.is_call AND NOT l.last AND l.k > 1 AND w.d.v IN (l.source, l.other)
  UNION ALL SELECT w.n, w.d.o, w.d.b, l.other, w.cond & l.goes & c.pc FROM walk w JOIN l USING (n) JOIN l c ON c.n = l.nxt * 1024 + 1 WHERE l.is_call AND w.d.v = l.source
  UNION ALL SELECT r.n, w.d.o, w.d.b, CASE WHEN r.k = 1 THEN r.source ELSE r.target END, w.cond & r.step FROM walk w JOIN l USING (n) JOIN l r ON r.n = w.open[-1].n WHERE l.last AND len(w.open) > 0 AND w.d.v IN (l.source, l.target)
) WHERE cond <> 0 GROUP BY ALL"""


@query(_WALKS + _SINKS)
def information_flow(spark: SparkSession, d: str) -> DataFrame:
    """Sinks of all orders' programs."""
    solver, problem, edges = IF.solve(*D.order_program(spark, d))
    return IF.sinks(solver, problem, edges)


@query(_WALKS.replace(f"c | {F4} AS step", f"c | CASE WHEN m % 100 = 7 THEN 0 ELSE {F4} END AS step") + _SINKS)
def information_flow_again(spark: SparkSession, d: str) -> DataFrame:
    """The sinks after a hundredth of the orders has changed: only these, what calls them, and what those call are solved again."""
    solver, _, before = IF.solve(*D.order_program(spark, d))
    changed = fixpoint.saved(solver.node.where("method % 100 = 7").select("method").distinct())
    # Only the edges are needed of the first solver.
    solver.drop()
    solver, problem, edges = IF.solve_again(*D.order_program(spark, d, narrowed="method % 100 = 7"), before, changed)
    fixpoint.dropped(before)
    return IF.sinks(solver, problem, edges)


@query(_WALKS + """SELECT (n // 1024) * 1024 + 1 AS start, f.v AS var_in, f.a AS at_in, f.o AS name_in, f.b AS origin_in, n AS x, d.v AS var_out, d.a AS at_out, d.o AS name_out, d.b AS origin_out, bit_or(cond)::BIGINT AS cond FROM walk JOIN l USING (n) WHERE l.last GROUP BY ALL""")
def end_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What facts at the start of an order lead to at its end."""
    solver, _, edges = IF.solve(*D.order_program(spark, d))
    out = solver.ends(edges).groupBy("start", "d1", "x", "d2").agg(F.bit_or("end_cond").alias("cond"))
    return out.select("start", F.col("d1.var").alias("var_in"), F.col("d1.at").alias("at_in"), F.col("d1.o_var").alias("name_in"), F.col("d1.o_at").alias("origin_in"), "x", F.col("d2.var").alias("var_out"), F.col("d2.at").alias("at_out"), F.col("d2.o_var").alias("name_out"), F.col("d2.o_at").alias("origin_out"), "cond")


@query(_WALKS + f"""SELECT n, d.v AS var, d.a AS "at", d.o AS o_var, d.b AS o_at, bit_or(CASE WHEN k = 1 AND entry THEN {T} ELSE cond END)::BIGINT AS cond FROM walk JOIN l USING (n) GROUP BY ALL""")
def statement_values(spark: SparkSession, d: str) -> DataFrame:
    """The second phase: which facts hold at each statement, at starts and calls by values handed on, at the others by path edges."""
    solver, _, edges = IF.solve(*D.order_program(spark, d))
    every = solver.values(edges).unionByName(solver.values_at_calls(edges))
    return every.select("n", "d.var", "d.at", "d.o_var", "d.o_at", "cond")
