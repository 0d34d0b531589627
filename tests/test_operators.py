from __future__ import annotations

import random

import pytest

from prismflow.functions import cond as C
from prismflow.functions import text as X
from prismflow.operators import alias, callgraph, conditional, evaluate, fixpoint, flows, lattice, sampling
from prismflow.plans import rewrite
from prismflow.sinks import graphs, metrics
from prismflow.sources import tables
from prismflow.streaming.units import ReachableNodes

T = C.TRUE
A, B = C.feature(0), C.feature(1)


def test_algebra_laws(spark):
    rng = random.Random(1)
    rows = [tuple(rng.choice([0, T, A, B, rng.getrandbits(32)]) for _ in range(3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    a, b, c = df["a"], df["b"], df["c"]
    laws = [
        C.both(a, C.either(b, c)) == C.either(C.both(a, b), C.both(a, c)), C.either(a, C.both(b, c)) == C.both(C.either(a, b), C.either(a, c)), C.no(C.both(a, b)) == C.either(C.no(a), C.no(b)),
        C.both(a, a) == a, C.either(a, C.lit(0)) == a, C.both(a, C.lit(T)) == a, C.tautology(C.either(a, C.no(a))), C.contradiction(C.both(a, C.no(a))), C.tautology(C.implies(C.both(a, b), a)), C.equivalent(a, C.no(C.no(a))),
        C.satisfiable(a, B) == (C.within(a, B) != 0),
    ]
    assert all(all(r) for r in df.select(*(law.alias(f"l{i}") for i, law in enumerate(laws))).collect())
    got = df.select("a", C.lowest(a).alias("low"), C.features_of(a).alias("f"), C.size(a).alias("n"), *(C.holds_in(a, k).alias(f"h{k}") for k in range(32))).collect()
    for r in got:
        m = r["a"]
        assert [r[f"h{k}"] for k in range(32)] == [bool(m >> k & 1) for k in range(32)] and r["n"] == m.bit_count()
        assert r["low"] == ((m & -m).bit_length() - 1 if m else None)
        assert r["f"] == [f"F{k}" for k in range(4, -1, -1) if any((m >> i & 1) != (m >> (i ^ 1 << k) & 1) for i in range(32))]
    assert [r[0] for r in spark.createDataFrame([(T,), (0,), (A,), (T - B,), (7,)], "m long").select(C.text(C.F.col("m"))).collect()] == ["True", "False", "F0", "!F1", "0x7"]
    cfg = spark.range(32).select(C.F.col("id").cast("int").alias("c"))
    c = C.F.col("c")
    assert [tuple(r) for r in cfg.select(C.all_enabled(c, [0, 2]), C.any_enabled(c, [0, 2]), C.all_disabled(c, [0, 2]), C.any_disabled(c, [0, 2]), C.of_config(c), C.enabled(c)).collect()] == [(i & 5 == 5, i & 5 != 0, i & 5 == 0, i & 5 != 5, 1 << i, ",".join(f"F{k}" for k in range(5) if i >> k & 1)) for i in range(32)]


def test_fixpoint_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2, 7), (2, 3, 5), (3, 1, T), (3, 4, 4)], "src long, dst long, cond long")
    rounds = fixpoint.Rounds()
    got = fixpoint.reach(spark.createDataFrame([(1, 7)], "node long, cond long"), edges, rounds=rounds)
    assert sorted(map(tuple, got.collect())) == [(1, 7), (2, 7), (3, 5), (4, 4)] and sum(rounds.bits) == 9
    assert fixpoint.plain_reach(spark.createDataFrame([(2,)], "node long"), edges).count() == 4
    with pytest.raises(fixpoint.NotReached):
        fixpoint.fixpoint(spark.createDataFrame([(1, 7)], "node long, cond long"), lambda d: d.selectExpr("node + 1 AS node", "cond"), ["node"], most=3)


def brute_classes(nodes, links, config):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, c in links:
        if c >> config & 1:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {n: root(n) for n in nodes}


def test_classes(spark):
    rng = random.Random(2)
    nodes, links = list(range(40)), [(rng.randrange(40), rng.randrange(40), rng.getrandbits(32)) for _ in range(45)]
    got = fixpoint.classes(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long, cond long"), T).collect()
    for config in (0, 5, 31):
        assert {r["node"]: r["class"] for r in got if r["cond"] >> config & 1} == brute_classes(nodes, links, config)


def test_alias_classes_after_a_change(spark):
    """What came later, on top of the earlier result, gives what all at once gives."""
    rng = random.Random(8)
    name = lambda: [rng.choice("abcdef"), *rng.choice([[], ["*"], ["*", "f"], ["*", "g"]])]
    assigns = [(name(), name(), rng.choice([T, A, B, A & B])) for _ in range(14)]
    names = [(name(), rng.choice([T, A, B])) for _ in range(10)]
    table = lambda rows: spark.createDataFrame(rows, "left array<string>, right array<string>, cond long")
    named = lambda rows: spark.createDataFrame(rows, "object array<string>, cond long")
    rows = lambda df: sorted((tuple(r["object"]), r["class"], r["cond"]) for r in df.collect())
    first = alias.alias_classes(named(names[:6]), table(assigns[:9]))
    assert rows(alias.alias_classes(named(names[6:]), table(assigns[9:]), before=first)) == rows(alias.alias_classes(named(names), table(assigns))) != rows(first)


def test_lattices(spark):
    """Least sums over paths, greatest bottlenecks, and sets of bits, with a cycle and more than twelve rounds."""
    edges = spark.createDataFrame([(k, k + 1, 1) for k in range(15)] + [(0, 9, 20), (15, 3, 2), (20, 21, 4)], "src long, dst long, weight int")
    start = spark.createDataFrame([(0, 0), (20, None)], "node long, value int")
    got = {r["node"]: r["value"] for r in lattice.reach(start, edges, lattice.LEAST, lambda v, w: v + w).collect()}
    assert got == {k: k for k in range(16)}  # a null value says nothing
    got = {r["node"]: r["value"] for r in lattice.reach(spark.createDataFrame([(0, 99)], "node long, value int"), edges, lattice.GREATEST, C.F.least).collect()}
    assert got[0] == 99 and got[9] == 20 and got[3] == 1 and got[8] == 1 and 20 not in got
    got = {r["node"]: r["value"] for r in lattice.reach(spark.createDataFrame([(0, 1), (9, 4)], "node long, value int"), edges, lattice.ANY, lambda v, w: v.bitwiseOR(w)).collect()}
    assert got[0] == 1 and got[1] == 1 and got[9] == 21 | 2 | 1 and got[3] == 23
    with pytest.raises(fixpoint.NotReached):
        lattice.fixpoint(start, lambda d: d.selectExpr("node + 1 AS node", "value"), ["node"], lattice.LEAST, most=2)
    assert lattice.fixpoint(start.where("false"), lambda d: d, ["node"], lattice.LEAST).count() == 0


def test_callees_at_positions(spark):
    positions = spark.createDataFrame([(1, "x.c", T), (1, "y.c", A), (2, "x.c", B), (3, None, T)], "call long, file string, cond long")
    names = spark.createDataFrame([(1, "f", T), (1, "g", B), (2, "f", T - B), (3, "f", T)], "call long, name string, cond long")
    methods = spark.createDataFrame([(10, "f", "x.c", T), (11, "f", "y.c", T), (12, "g", "y.c", T), (13, "g", "z.c", T)], "method long, name string, file string, cond long")
    assert sorted(map(tuple, callgraph.callees_at(positions, names, methods).collect())) == [(1, 10, T), (1, 11, A), (1, 12, A & B)]
    assert sorted(map(tuple, callgraph.callees_at(positions, names, methods, T - A).collect())) == [(1, 10, T)]
    assert callgraph.callees_at(positions.where("false"), names, methods).count() == 0


def test_alias_classes_are_closed_under_equal_parts(spark):
    names = [(["p", "*"], T), (["q", "*"], T), (["p", "*", "f"], T), (["q", "*", "f"], T), (["x"], T), (["y"], T), (["z"], B)]
    assigns = [(["p"], ["q"], A), (["x"], ["p", "*", "f"], T), (["y"], ["q", "*", "f"], T), (["y"], ["z"], T)]
    got = alias.alias_classes(spark.createDataFrame(names, "object array<string>, cond long"), spark.createDataFrame(assigns, "left array<string>, right array<string>, cond long")).collect()
    same = lambda a, b: [c for c in range(32) if len({r["class"] for r in got if tuple(r["object"]) in (a, b) and r["cond"] >> c & 1}) == 1]
    on = [c for c in range(32) if A >> c & 1]
    assert same(("p",), ("q",)) == on and same(("p", "*"), ("q", "*")) == on and same(("x",), ("y",)) == on
    lines = graphs.class_lines(spark.createDataFrame([(["a", "*"], 1, T), (["b"], 1, A)], "object array<string>, class long, cond long"))
    assert lines.first()["line"] == "a.* @ True, b @ F0"
    pairs = alias.pair_assignments(spark.createDataFrame([(1, "l", A)], "n int, left string, cond long"), spark.createDataFrame([(1, "r", B), (1, "s", T - A)], "n int, right string, cond long"))
    assert [tuple(r) for r in pairs.collect()] == [(1, "l", "r", A & B)]


def test_flows(spark):
    df = spark.createDataFrame([("0",), ("a",), ("b",)], "d string")
    lit = C.F.lit
    run = lambda flow: sorted(r["d"] for r in flow(df).collect())
    assert run(flows.identity()) == ["0", "a", "b"] and run(flows.kill(lit("a"))) == ["0", "b"] and run(flows.kill_all()) == []
    assert run(flows.gen(lit("x"), lit("0"))) == ["0", "a", "b", "x"] and run(flows.transfer(lit("b"), lit("a"))) == ["0", "a", "b"]
    assert run(flows.compose(flows.kill(lit("b")), flows.transfer(lit("b"), lit("a")))) == ["0", "a", "b"]
    assert run(flows.union(flows.kill(lit("a")), flows.kill_all())) == ["0", "b"] and run(flows.with_zero(flows.kill_all(), lit("0"))) == ["0"]
    assert run(flows.by_kind(C.F.col("d"), {"a": flows.identity(), "b": flows.kill_all()})) == ["a"]


def test_call_graph(spark):
    edges = spark.createDataFrame([(1, 10, T), (2, 20, A)], "call long, method long, cond long")
    methods = spark.createDataFrame([(10, "Main", T), (20, "f", T)], "method long, name string, cond long")
    calls = spark.createDataFrame([(1, 20), (2, 20)], "call long, caller long")
    assert [r["call"] for r in callgraph.without_recursion(edges, calls, methods).collect()] == [1]
    assert [r["method"] for r in callgraph.entry_functions(methods, ("Main",)).collect()] == [10]
    pointers = callgraph.pointer_callees(spark.createDataFrame([(1, 5, T)], "call long, object long, cond long"), spark.createDataFrame([(5, 1, A), (6, 1, T), (7, 2, T)], "object long, class long, cond long"), spark.createDataFrame([(6, "f", "x.c"), (7, "g", "x.c")], "object long, name string, file string"), spark.createDataFrame([(20, "f", "x.c", B)], "method long, name string, file string, cond long"))
    assert [tuple(r) for r in pointers.collect()] == [(1, 20, A & B)]
    # In order: alternatives share a group, what a group's condition implies begins a new one.
    options = spark.createDataFrame([([("a", A), ("b", T - A), ("c", T), ("d", B)],)], "o array<struct<value:string,cond:long>>")
    assert [tuple(x) for x in options.select(callgraph.variational_groups(options["o"])).first()[0]] == [(0, "a", A), (0, "b", T - A), (1, "c", T), (1, "d", B)]


def test_conditional_sets(spark):
    a = spark.createDataFrame([(1, A), (2, B), (1, B)], "k int, cond long")
    own = conditional.normal(a)
    assert sorted(map(tuple, own.collect())) == [(1, A | B), (2, B)]
    yes, no = conditional.partition(own, C.F.col("k") == 1)
    assert (yes.count(), no.count()) == (1, 1) and conditional.restricted(own, C.lit(T - B)).count() == 1
    assert conditional.contains(own, spark.createDataFrame([(2,), (9,)], "k int")).count() == 1
    assert [tuple(x) for x in conditional.options(own).first()[0]] == [(1, A | B), (2, B)] and conditional.product(own, 1).count() == 1


def test_rewrites(spark):
    node = spark.createDataFrame([(1, 1, "call", "f(g(x))", T, True, False, True), (2, 1, "stmt", "y", T, False, True, False)], tables.SCHEMAS["node"])
    cfg = spark.createDataFrame([(1, 2, T)], tables.SCHEMAS["cfg"])
    node, cfg = rewrite.spread(node, cfg)
    n2, c2, read = rewrite.hoist_calls(node, cfg, spark.createDataFrame([(64, 0, "g(x)"), (64, 1, "h(x)")], "n long, k int, call string"))
    assert sorted(r["n"] for r in n2.where("is_call").collect()) == [32, 33] and sorted((r["src"], r["dst"]) for r in c2.collect()) == [(32, 33), (33, 64), (64, 128)]
    assert sorted(r["var"] for r in read.collect()) == ["__PRISM_TMP32", "__PRISM_TMP33"]
    n3, c3 = rewrite.single_entry(*rewrite.add_returns(n2, c2))
    assert [r["n"] for r in n3.where("is_start").collect()] == [63] and [r["n"] for r in n3.where("is_exit").collect()] == [190] and c3.count() == 5
    assert rewrite.project(spark.createDataFrame([(1, A), (2, T)], "n int, pc long"), 0).count() == 1


def test_evaluation_and_sampling(spark):
    conds = spark.createDataFrame([(A,), (T - A,), (A & B,), (0,), (T,)], "cond long")
    chosen = sampling.code_coverage(conds)
    assert all(any(m >> c & 1 for c in chosen) for m in (A, T - A, A & B, T)) and len(chosen) <= 3
    assert sampling.code_coverage(conds, existing=(3,)) and sampling.code_coverage(conds.limit(0)) == []
    assert sampling.condition_coverage(conds).count() == 4
    lifted = spark.createDataFrame([("x", A), ("y", 0)], "k string, cond long")
    sampled = spark.createDataFrame([("x", 1), ("x", 2)], "k string, config int")
    missing, counted = evaluate.compare(lifted, sampled, spark.createDataFrame([(1,), (2,)], "config int"), ["k"])
    assert [tuple(r) for r in missing.collect()] == [("x", 2)] and sorted(map(tuple, counted.collect())) == [("x", A, 1), ("y", 0, 0)]
    watch = metrics.Stopwatch()
    with watch.measured("a"):
        metrics.warmed_up(lambda: None)
    row = evaluate.summary(counted, watch.table(spark)).first()
    assert (row["facts"], row["covered"], row["percent"]) == (2, 1, 50) and row["seconds"] >= row["fastest"] and watch.csv().startswith("a\n")


def test_storage_and_graph_files(spark, tmp_path):
    node = spark.createDataFrame([(1, 1, "stmt", "a < b | \"c\"", A, True, True, False)], tables.SCHEMAS["node"])
    empty = {k: spark.createDataFrame([], tables.SCHEMAS[k]) for k in ("cfg", "calls", "defs", "uses", "assigns", "params")}
    tables.save({"node": node, **empty}, str(tmp_path / "p"))
    assert tables.program(spark, str(tmp_path / "p")).node.collect() == node.collect() and tables.statements(spark, str(tmp_path / "p")).defs.count() == 0
    lines = graphs.dot_lines(node.selectExpr("n AS node", "text", "string(null) AS position", "pc AS cond", "true AS is_function"), spark.createDataFrame([(1, 1, T)], "src long, dst long, cond long"))
    graphs.write_dot(lines, str(tmp_path / "g"))
    got = [r[0] for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert got[0] == 'digraph "" {' and got[-1] == "}" and 'a\\ \\<\\ b\\ \\|\\ \\"c\\"' in got[2] and "#CD5200" in got[2] and "black" in got[3]
    graphs.write_variants(spark.createDataFrame([(1, "f", 2, "b"), (1, "f", 1, "a")], "config int, file string, line int, text string"), str(tmp_path / "v"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "v")).select("value").collect()] == ["a", "b"]
    graphs.reaching_graphs(spark.createDataFrame([(1, 2, T), (3, 2, A)], "n long, o_at long, cond long"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 2
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "deep" / "a.c").write_text("int a;\nint b;")
    (tmp_path / "src" / "b.h").write_text("x")
    assert [(r["line"], r["text"]) for r in tables.source_files(spark, str(tmp_path / "src")).orderBy("line").collect()] == [(1, "int a;"), (2, "int b;")]
    maps = spark.createDataFrame([("f", "fdef", "a.c", 1, 1, "int", A)], tables.SCHEMAS["exports"])
    merged = graphs.merged_links([maps, maps.withColumn("cond", C.lit(B))])
    merged.write.json(str(tmp_path / "links"))
    assert tables.link_map(spark, str(tmp_path / "links")).first()["cond"] == A | B
    assert tables.add_unit({"node": node}, {"node": node})["node"].count() == 2 and tables.files_present(maps, T - A).count() == 0
    sinks = spark.createDataFrame([(1, "assign", "s", 7, "x", A), (1, "use", "t", 8, "", T)], "n long, kind string, o_var string, o_at long, assignee string, cond long")
    assert graphs.sink_texts(sinks, node).first()["report"].split("\n")[1:] == ["use of t defined at 8 if True", "x := s defined at 7 if F0"]


def test_feature_models():
    assert tables.dimacs_mask("p cnf 2 1\n1 -2 0") == T & ~(C.negated(A) & B)
    assert tables.dimacs_mask("c x\n6 0\n-6 1 0") == A and tables.model_mask(A, B) == A & B


def test_stream_of_units(spark, tmp_path):
    batches = [[(1, 2, 7)], [(2, 3, 5), (4, 5, T)], [(3, 4, 4)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "src long, dst long, cond long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"unit={k}"))
    nodes = ReachableNodes(spark, str(tmp_path / "state"), spark.createDataFrame([(1, 7)], "node long, cond long"))
    seen = []
    nodes.register(lambda state, batch: seen.append((batch, state.count())))
    stream = spark.readStream.schema("src long, dst long, cond long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    nodes.follow(stream, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(map(tuple, nodes.state(seen[-1][0]).collect())) == [(1, 7), (2, 7), (3, 5), (4, 4), (5, 4)] and len(seen) == 3


def test_names(spark):
    df = spark.createDataFrame([("file /a/b.x/c.tar.c",)], "p string")
    assert tuple(df.select(X.plain_name(df["p"]), X.plain_path(df["p"]), X.with_extension(df["p"], ".ast")).first()) == ("c.tar", "/a/b.x/c.tar.c", "file /a/b.x/c.tar.ast")
