"""What queries move between tasks, in rows: in proportion to their tables, also where the result is larger than these."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from prismflow import queries
from prismflow.functions import cond as C
from prismflow.operators import alias, callgraph, evaluate, fixpoint
from prismflow.operators.solver import RUN, Program, Solver
from prismflow.plans import information_flow as IF
from prismflow.plans import rewrite
from prismflow.sources import driver as D

T = C.TRUE


def moved(spark, run):
    """Rows that all shuffles of ``run`` wrote, and what it returned."""
    store = spark._jsc.sc().statusStore()

    def written():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    out = run()
    return written() - before, out


def call_tables(spark):
    calls = spark.range(4000).repartition(4).select(F.col("id").alias("call"), (F.col("id") % 4).alias("name"), (F.col("id") % 2).alias("file"), C.lit(T).alias("cond"))
    methods = spark.range(400).select((F.col("id") + 10_000).alias("method"), (F.col("id") % 4).alias("name"), (F.col("id") % 2).alias("file"), C.lit(T).alias("cond"))
    return calls, methods


def test_positions_move_no_definitions(spark):
    calls, methods = call_tables(spark)
    rows, n = moved(spark, lambda: callgraph.callees_at(calls.select("call", "file", "cond"), calls.select("call", "name", "cond"), methods).count())
    assert n == 400_000 and rows < 40_000


def test_methods_of_several_rows_are_grouped(spark):
    a, b = C.feature(0), C.feature(1)
    positions = spark.createDataFrame([(1, "x.c", T), (1, "y.c", a)], "call long, file string, cond long")
    names = spark.createDataFrame([(1, "f", T)], "call long, name string, cond long")
    methods = spark.createDataFrame([(10, "f", "x.c", a & b), (10, "f", "y.c", T), (11, "f", "x.c", b)], "method long, name string, file string, cond long")
    assert sorted(map(tuple, callgraph.callees_at(positions, names, methods).collect())) == [(1, 10, a), (1, 11, b)]
    # A row that the model excludes adds nothing to the others of its method.
    twice = spark.createDataFrame([(10, "f", "x.c", a), (10, "f", "x.c", T - a)], "method long, name string, file string, cond long")
    assert [tuple(r) for r in callgraph.callees_at(positions, names, twice, a).collect()] == [(1, 10, a)]


def test_targets_of_many_calls_are_written_small(spark, tmp_path):
    """Calls of one name follow each other, with the methods of that name in one order: a written row takes far less than a number."""
    calls = spark.range(0, 4000, 1, 4).select(F.col("id").alias("call"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("name"), F.lit(0).cast("bigint").alias("file"), F.when(F.xxhash64("id", F.lit(1)) % 3 == 0, C.lit(C.feature(0))).otherwise(C.lit(T)).alias("cond"))
    methods = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("method"), (F.col("id") % 50).alias("name"), F.lit(0).cast("bigint").alias("file"), F.when(F.col("id") % 4 == 0, C.lit(C.feature(1))).otherwise(C.lit(T)).alias("cond"))
    callgraph.at_targets(calls, methods).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    plain = calls.join(methods.withColumnRenamed("cond", "m"), ["name", "file"]).select("call", "method", F.col("cond").bitwiseAND(F.col("m")).alias("cond"))
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < got.count() // 2, (size, got.count())


def test_pointers_move_no_definitions(spark):
    calls, methods = call_tables(spark)
    classes = spark.range(4).select(F.col("id").alias("object"), F.col("id").alias("class"), C.lit(T).alias("cond"))
    functions = spark.range(4).select(F.col("id").alias("object"), F.col("id").alias("name"), (F.col("id") % 2).alias("file"))
    rows, n = moved(spark, lambda: callgraph.pointer_callees(calls.select("call", F.col("name").alias("object"), "cond"), classes, functions, methods).count())
    assert n == 400_000 and rows < 40_000


def test_local_and_linked_definitions_stay_where_calls_are(spark):
    calls, methods = call_tables(spark)
    rows, n = moved(spark, lambda: callgraph.callees(calls, methods, methods.select("name", "file", "cond")).count())
    assert n == 400_000 and rows < 40_000
    # None of the names is in a call's own file, so that all are linked.
    rows, n = moved(spark, lambda: callgraph.callees(calls.withColumn("file", F.lit(7).cast("long")), methods, methods.select("name", "file", "cond")).count())
    assert n == 400_000 and rows < 40_000


def test_imports_follow_names_not_pairs_of_files(spark):
    own = spark.range(3000).repartition(4).select(F.col("id").alias("file"), F.lit("common").alias("name"))
    rows, n = moved(spark, lambda: callgraph.import_closure(spark.createDataFrame([(1,)], "file long"), own, own).count())
    assert n == 3000 and rows < 60_000


def test_comparison_moves_facts_not_configurations(spark):
    lifted = spark.range(2000).repartition(4).select(F.col("id").alias("k"), C.lit(T).alias("cond"))
    sampled = lifted.select("k", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("config"))
    configs = spark.range(32).select(F.col("id").cast("int").alias("config"))
    rows, row = moved(spark, lambda: [evaluate.compare(lifted, sampled, configs, ["k"])[1].agg(F.sum("n_matches")).first()[0], evaluate.compare(lifted, sampled, configs, ["k"])[0].count()])
    assert row == [64_000, 0] and rows < 30_000


def test_variants_move_pieces_not_configurations(spark):
    lines = spark.range(4000).repartition(4).select((F.col("id") % 1000).alias("n"), F.col("id").alias("piece"), F.col("id").cast("string").alias("text"), C.lit(T).alias("cond"))
    rows, n = moved(spark, lambda: rewrite.covers(lines).count())
    assert n == 1000 and rows < 12_000
    a = C.feature(0)
    odd = spark.createDataFrame([(1, 1, "x", a), (1, 2, None, T), (1, 3, "y", 0), (2, 1, "z", 0)], "n long, piece int, text string, cond long")
    assert sorted(map(tuple, rewrite.covers(odd).collect())) == [(1, 0, "", T - a), (1, 1, "x", a)]


def test_statements_move_once_to_their_runs(spark):
    """Methods of 100 statements in a row, longer than a run: each statement is in one run, and few of the rows that the solver's tables take move."""
    node = spark.range(2000).repartition(4).select(F.col("id").alias("n"), F.expr("id div 100").alias("method"), C.lit(T).alias("pc"), (F.col("id") % 100 == 0).alias("is_start"), (F.col("id") % 100 == 99).alias("is_exit"), F.lit(False).alias("is_call"))
    cfg = node.where("NOT is_exit").select(F.col("n").alias("src"), (F.col("n") + 1).alias("dst"), C.lit(T).alias("cond"))
    calls = node.where("is_call").select(F.col("n").alias("call"), "method", F.col("pc").alias("cond"))
    starts, program = node.where("is_start").select("n"), Program(node, cfg, calls)
    problem = IF.UninitialisedUse(program, starts.select("n", F.lit("v").alias("var")), node.where("n % 100 = 70").select("n", F.lit("v").alias("var")), starts)
    solver = Solver(program, problem)
    runs = solver.runs.select("head", "n", F.expr("transform(body, x -> x.n)").alias("body")).collect()
    assert sorted(n for r in runs for n in [*r["body"], r["n"]]) == list(range(2000))
    assert all(len(r["body"]) < RUN and [*r["body"], r["n"]] == list(range(r["head"], r["n"] + 1)) for r in runs)
    held = solver.values(solver.path_edges()).where("d = 'v'").select("n").collect()
    assert sorted(r["n"] for r in held) == [m * 100 + k for m in range(20) for k in range(1, 71)]


def test_rows_of_a_known_number_are_dealt_as_they_are_grouped(spark):
    counts = spark.range(4000).repartition(4).select((F.col("id") % 2000).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    rows, out = moved(spark, lambda: fixpoint.dealt(counts, "k", rows=2000))
    # The rows themselves, and what the first grouping leaves of them: not once more to be dealt.
    assert out.count() == 2000 and rows <= 8000


def test_links_move_to_classes_and_are_gone(spark):
    """A few common nodes: what the first round leaves of the links is the links of these, so that links move about three times in all."""
    links = spark.range(40_000).repartition(4).select((F.col("id") % 40).alias("a"), (100 + F.col("id") % 1999).alias("b"), F.when(F.col("id") % 3 == 0, C.lit(C.feature(0))).otherwise(C.lit(T)).alias("cond"))
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    rows, n = moved(spark, lambda: fixpoint.classes(nodes, links, T).count())
    assert n == 2039 and rows < 420_000
    rounds = fixpoint.Rounds()
    assert fixpoint.classes(nodes, links, T, rounds).count() == fixpoint.classes(None, links, T).count() == 2039
    assert rounds.rows[0] == 40_000 and sum(rounds.rows[1:]) < 4000


def test_names_of_classes_are_not_connected_again(spark):
    """Assignments move once, whatever the rounds over equal parts: later rounds only connect the classes that these have found."""
    lines = spark.range(20_000).repartition(4).select(F.concat(F.lit("p"), F.col("id") % 1999).alias("p"), F.concat(F.lit("s"), F.col("id") % 20).alias("s"))
    assignments = lines.select(F.array("p").alias("left"), F.array("s").alias("right"), C.lit(T).alias("cond"))
    names = lines.select(F.array("p", F.lit("*"), F.lit("f")).alias("object"), C.lit(T).alias("cond")).distinct()
    rows, got = moved(spark, lambda: alias.alias_classes(names, assignments).groupBy("class").count().collect())
    assert sorted(r["count"] for r in got) == [1999, 1999, 2019] and rows < 500_000


def test_edges_move_once_and_are_read_as_lists(spark):
    """Reaching moves each edge once to its list, and what is found; a round reads a row for each node, not one for each edge."""
    edges = spark.range(0, 40_000, 1, 4).select((F.col("id") % 100).alias("src"), F.expr("id div 100").alias("dst"), C.lit(T).alias("cond"))
    lists = fixpoint.laid(edges, "cond", rows=40_000)
    assert lists.count() == 100 and lists.unionByName(fixpoint.laid(edges.unionByName(edges), "cond", rows=80_000)).agg(F.sum(F.size("dst"))).first()[0] == 80_000
    rows, n = moved(spark, lambda: fixpoint.reach(spark.createDataFrame([(0, T)], "node long, cond long"), edges, rows=40_000).count())
    assert n == 400 and rows < 50_000


def test_hubs_have_several_lists(spark):
    a, b = C.feature(0), C.feature(1)
    edges = spark.range(5000).select(F.lit(-1).cast("bigint").alias("src"), F.col("id").alias("dst"), C.lit(a).alias("cond"))
    edges = edges.unionByName(spark.createDataFrame([(-1, 7, b), (7, 9000, T), (7, 7, T)], "src long, dst long, cond long"))
    assert fixpoint.laid(edges, "cond").select(F.size("dst").alias("n")).agg(F.max("n"), F.sum("n"), F.count("n")).first()[:] == (fixpoint.NEIGHBOURS, 5002, 6)
    got = dict(map(tuple, fixpoint.reach(spark.createDataFrame([(-1, T)], "node long, cond long"), edges).collect()))
    assert got == {-1: T, 9000: a | b} | {k: a | b if k == 7 else a for k in range(5000)}


def test_wide_conditions_follow_an_edge_once(spark):
    """Eight blocks of a condition lie side by side in four words: an edge is one row, whatever the blocks."""
    words = [f"w{k}" for k in range(4)]
    frame = spark.range(1).select(*(w.alias(n) for w, n in zip(C.words(8, lambda k: C.wide_feature(7, F.lit(k)).bitwiseOR(C.lit(k))), words)))
    got = {r["block"]: r["cond"] for r in frame.select(F.explode(C.of_words(8, words)).alias("at")).select("at.block", "at.cond").collect()}
    assert got == {k: T if k >= 4 else k for k in range(1, 8)}
    mask = [C.lit(T), C.lit(-1), C.lit(0), C.lit(-(1 << 63))]
    edges = spark.range(0, 8000, 1, 4).select((F.col("id") % 100).alias("src"), (F.col("id") % 700).alias("dst"), *(m.alias(n) for m, n in zip(mask, words)))
    start = spark.createDataFrame([(0,)], "node long").select("node", *(C.lit(-1).alias(n) for n in words))

    def run():
        return fixpoint.fixpoint(start, fixpoint.along(fixpoint.laid(edges, *words, rows=8000), tuple(words)), ["node"], tuple(words)).where("node <> 0").distinct().collect()

    rows, got = moved(spark, run)
    assert len(got) == 6 and {tuple(r[1:]) for r in got} == {(T, -1, 0, -(1 << 63))} and rows < 10_000


def test_traces_are_made_once(spark, sf_dir):
    """The tables of the uninitialised problem are made of one written trace: events move to their users once, not once for each table."""
    n = D.events(spark, sf_dir).count()
    rows, _ = moved(spark, lambda: queries.uninitialised_memory(spark, sf_dir))
    # With a trace for each table it was more than 31 times the events.
    assert rows < 30 * n


def on_disk(spark):
    """Files of shuffles, and tables in the checkpoints' folder."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    folder = spark.sparkContext.getCheckpointDir()
    return sum("shuffle_" in files.apply(k).getName() for k in range(files.size())), {f.name for f in os.scandir(folder.removeprefix("file:"))} if folder else set()


def test_a_written_table_leaves_no_shuffles(spark):
    fixpoint.shared_folder(spark)
    shuffles, tables = on_disk(spark)
    out = fixpoint.saved(spark.range(20_000).groupBy((F.col("id") % 700).alias("k")).agg(F.count(F.lit(1)).alias("n")).repartition(4, "n"))
    dealt = fixpoint.dealt(out, "k")
    now, more = on_disk(spark)
    assert now == shuffles and len(more - tables) == 2 and out.count() == dealt.count() == 700
    fixpoint.dropped(out, dealt, spark.range(1))
    assert on_disk(spark)[1] == tables


def test_a_solver_keeps_what_it_reads(spark):
    """Node, seeds, runs, calls and the result: rounds and steps towards these leave nothing. Statements are written once, in their runs."""
    node = spark.range(20).repartition(4).select(F.col("id").alias("n"), F.expr("id div 10").alias("method"), C.lit(T).alias("pc"), (F.col("id") % 10 == 0).alias("is_start"), (F.col("id") % 10 == 9).alias("is_exit"), (F.col("id") % 10 == 5).alias("is_call"))
    cfg = node.where("NOT is_exit").select(F.col("n").alias("src"), (F.col("n") + 1).alias("dst"), C.lit(T).alias("cond"))
    calls = node.where("is_call AND method < 1").select(F.col("n").alias("call"), (F.col("method") + 1).alias("method"), F.col("pc").alias("cond"))
    starts = node.where("is_start").select("n")
    fixpoint.shared_folder(spark)
    shuffles, tables = on_disk(spark)
    problem = IF.UninitialisedUse(Program(node, cfg, calls), starts.select("n", F.lit("v").alias("var")), node.where("n % 10 = 7").select("n", F.lit("v").alias("var")), starts.where("n = 0"))
    solver = Solver(problem.program, problem)
    edges = solver.path_edges()
    assert len(on_disk(spark)[1] - tables) == 5
    stmt = {r["n"]: r for r in solver.stmt.collect()}
    assert sorted(stmt) == list(range(20)) and all([s["m"] for s in r["succs"] or []] == ([] if n % 10 == 9 else [n + 1]) and r["is_call"] == (n % 10 == 5) and r["is_exit"] == (n % 10 == 9) for n, r in stmt.items())
    assert {r["n"] for r in solver.values(edges).where("d = 'v'").collect()} == {n for n in range(20) if n % 10 in (1, 2, 3, 4, 6, 7)}
    solver.drop()
    fixpoint.dropped(edges)
    assert on_disk(spark)[1] == tables


def test_links_of_one_row_each_move_less_and_leave_what_is_read(spark):
    links = fixpoint.saved(spark.range(0, 6000, 1, 4).select((2 * (F.col("id") % 60)).alias("a"), (2 * F.col("id") + 1).alias("b"), C.lit(T).alias("cond")))
    shuffles, tables = on_disk(spark)
    rows, made = moved(spark, lambda: fixpoint.classes(None, links, T, once=True))
    assert made.groupBy("class").count().where("count = 101").count() == 60
    assert len(on_disk(spark)[1] - tables) == 2 and {f.rsplit("/", 1)[1] for f in made.written} == on_disk(spark)[1] - tables
    # Links move to be dealt, in the first round, and nodes; grouped, they would move once more before.
    more, _ = moved(spark, lambda: fixpoint.dropped(fixpoint.classes(None, links, T)))
    assert more >= rows + 5000
    fixpoint.dropped(links, made)
