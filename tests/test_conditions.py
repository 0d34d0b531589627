"""Conditions over many features, classes in few rounds, and results after rows have been taken back, against brute force."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prismflow.functions import cond as C
from prismflow.functions import cubes as Q
from prismflow.functions.sat import Formula, dimacs
from prismflow.operators import alias, fixpoint, lattice
from prismflow.plans import rewrite
from prismflow.sources import tables
from prismflow.streaming.units import ReachableNodes

T = C.TRUE


def holds(cover, config):
    """config: the features that are enabled."""
    return any(all((abs(x) in config) == (x > 0) for x in cube) for cube in cover)


def covers(rng, n, features):
    cube = lambda: sorted({abs(x): x for x in (rng.choice([1, -1]) * rng.randint(1, features) for _ in range(rng.randint(0, 4)))}.values())
    return [[cube() for _ in range(rng.choice([0, 1, 1, 2, 4]))] for _ in range(n)]


def test_algebra_of_covers(spark):
    rng = random.Random(1)
    rows = list(zip(covers(rng, 150, 7), covers(rng, 150, 7), strict=True))
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, f"a {Q.TYPE}, b {Q.TYPE}")
    got = df.select("a", "b", Q.both(a, b).alias("both"), Q.either(a, b).alias("either"), Q.minus(a, b).alias("minus"), Q.no(a).alias("no"), Q.disjoint(a).alias("apart"), Q.implies(a, b).alias("implies"), Q.equivalent(a, b).alias("same"), Q.tautology(a).alias("true"), Q.satisfiable(a).alias("sat"), Q.features_of(a).alias("features"), Q.holds_in(a, F.array(F.lit(2), F.lit(5))).alias("in25"), Q.equivalent(a, Q.no(Q.no(a))).alias("twice")).collect()
    configs = [{f for f in range(1, 8) if i >> f - 1 & 1} for i in range(128)]
    for r in got:
        own, other = ([holds(r[c], x) for x in configs] for c in ("a", "b"))
        assert [holds(r["both"], x) for x in configs] == [x and y for x, y in zip(own, other, strict=True)]
        assert [holds(r["either"], x) for x in configs] == [x or y for x, y in zip(own, other, strict=True)]
        assert [holds(r["minus"], x) for x in configs] == [x and not y for x, y in zip(own, other, strict=True)]
        assert [holds(r["no"], x) for x in configs] == [not x for x in own] and r["twice"]
        assert [sum(holds([c], x) for c in r["apart"]) for x in configs] == [int(x) for x in own]
        assert r["implies"] == all(y or not x for x, y in zip(own, other, strict=True)) and r["same"] == (own == other)
        assert r["true"] == all(own) and r["sat"] == any(own) and r["in25"] == holds(r["a"], {2, 5})
        assert r["features"] == sorted({abs(x) for c in r["a"] for x in c})
        assert all(not set(x) <= set(y) for x in r["either"] for y in r["either"] if x != y)


def clauses(rng, features, n):
    return [[rng.choice([1, -1]) * x for x in rng.sample(range(1, features + 1), rng.randint(1, 3))] for _ in range(n)]


def test_models_of_clauses():
    rng = random.Random(2)
    for k in range(120):
        own = clauses(rng, 8, k // 4)
        models = [i for i in range(256) if all(any((i >> abs(x) - 1 & 1) == (x > 0) for x in c) for c in own)]
        given = [rng.choice([1, -1]) * x for x in rng.sample(range(1, 9), rng.randint(0, 3))]
        formula = Formula(own)
        assert formula.satisfiable() == bool(models)
        assert formula.satisfiable(given) == any(all((i >> abs(x) - 1 & 1) == (x > 0) for x in given) for i in models)
    assert not Formula([[]]).satisfiable() and Formula([]).satisfiable() and not Formula([]).satisfiable([1, -1])
    assert dimacs("c 1 A\np cnf 3 2\n1 -2 0\n2\n 3 0\n") == [[1, -2], [2, 3]]


def test_feature_models_of_real_size(spark):
    """Chains of implications over 300 variables: the first implies the last."""
    chain = "p cnf 300 299\n" + "\n".join(f"-{k} {k + 1} 0" for k in range(1, 300))
    assert tables.dimacs_mask(chain) == sum(1 << i for i in range(32) if all(i >> k + 1 & 1 or not i >> k & 1 for k in range(4)))
    assert tables.dimacs_mask(chain + "\n-300 0") == 1
    rng = random.Random(3)
    own = clauses(rng, 7, 9)
    text = "\n".join(" ".join(map(str, [*c, 0])) for c in own)
    want = [0] * 4
    for i in range(128):
        if all(any((i >> abs(x) - 1 & 1) == (x > 0) for x in c) for c in own):
            want[i // 32] |= 1 << i % 32
    assert tables.dimacs_blocks(text, 7) == want
    df = spark.createDataFrame([(1, [[1, 250], [1, -300]]), (2, [[7, -9]]), (3, [[]]), (4, [])], f"n int, cond {Q.TYPE}")
    assert sorted((r["n"], r["cond"]) for r in Q.allowed(df, "cond", dimacs(chain)).collect()) == [(1, [[1, 250]]), (3, [[]])]


def test_reachability_over_covers(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 11), rng.randint(0, 11), covers(rng, 1, 14)[0]) for _ in range(26)]
    got = lattice.reach(spark.createDataFrame([(0, [[]])], f"node int, value {Q.TYPE}"), spark.createDataFrame(edges, f"src int, dst int, weight {Q.TYPE}"), lattice.COVER, Q.both)
    got = {r["node"]: r["value"] for r in got.collect()}
    for _ in range(200):
        config = {f for f in range(1, 15) if rng.random() < 0.5}
        reached, todo = {0}, [0]
        while todo:
            at = todo.pop()
            for a, b, c in edges:
                if a == at and b not in reached and holds(c, config):
                    reached.add(b)
                    todo.append(b)
        assert {n for n, c in got.items() if holds(c, config)} == reached


def parts(nodes, links, config):
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


def check_classes(got, nodes, links, model):
    of = {}
    for r in got:
        for k in range(32):
            if r["cond"] >> k & 1:
                assert (k, r["node"]) not in of
                of[k, r["node"]] = r["class"]
    assert of == {(k, n): c for k in range(32) if model >> k & 1 for n, c in parts(nodes, links, k).items()}


def random_links(rng, n, k):
    return [(rng.randrange(n), rng.randrange(n), rng.choice([T, C.feature(0), C.feature(1) & C.feature(2), rng.getrandbits(32)])) for _ in range(k)]


def test_classes_in_few_rounds(spark):
    chain = spark.range(10_000).selectExpr("id AS a", "id + 1 AS b", f"CASE WHEN id = 5000 THEN {C.feature(2)}L ELSE {T}L END AS cond")
    rounds = fixpoint.Rounds()
    got = fixpoint.classes(spark.range(10_001).selectExpr("id AS node"), chain, T, rounds)
    assert got.groupBy("class").agg(F.count("*"), F.bit_or("cond")).orderBy("class").collect() == [(0, 10_001, T), (5001, 5000, T - C.feature(2))]
    assert len(rounds.rows) <= 20
    rng = random.Random(5)
    for n, k, model in ((30, 25, T), (12, 40, C.feature(3)), (5, 0, T)):
        links = random_links(rng, n, k)
        got = fixpoint.classes(spark.range(n).selectExpr("id AS node"), spark.createDataFrame(links, "a long, b long, cond long"), model)
        check_classes(got.collect(), range(n), links, model)


@pytest.mark.parametrize("seed", [2])
def test_links_taken_back(spark, seed):
    rng = random.Random(seed)
    links = {(a, b): c for a, b, c in random_links(rng, 40, 45)}
    gone = {k: c & rng.choice([T, rng.getrandbits(32)]) for k, c in rng.sample(sorted(links.items()), 8)}
    left = [(*k, c & ~gone.get(k, 0)) for k, c in links.items()]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long, cond long")
    before = fixpoint.classes(spark.range(40).selectExpr("id AS node"), frame([(*k, c) for k, c in links.items()]), T)
    got = fixpoint.classes_without(before, frame(left), frame([(*k, c) for k, c in gone.items()]), T)
    check_classes(got.collect(), range(40), left, T)


@pytest.mark.parametrize("seed", [2])
def test_edges_taken_back(spark, seed):
    rng = random.Random(seed)
    edges = {(a, b): c for a, b, c in random_links(rng, 25, 60)}
    gone = {k: c & rng.choice([T, rng.getrandbits(32)]) for k, c in rng.sample(sorted(edges.items()), 9)}
    frame = lambda rows: spark.createDataFrame(rows, "src long, dst long, cond long").where("cond <> 0")
    start = spark.createDataFrame([(0, T), (1, C.feature(4))], "node long, cond long")
    left = frame([(*k, c & ~gone.get(k, 0)) for k, c in edges.items()])
    before = fixpoint.reach(start, frame([(*k, c) for k, c in edges.items()]))
    got = fixpoint.reach_without(before, start, left, frame([(*k, c) for k, c in gone.items()]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fixpoint.reach(start, left).collect()))


def test_names_with_one_hash(spark, monkeypatch):
    real = alias.hashed
    monkeypatch.setattr(alias, "hashed", lambda name, turn: F.size(name).cast("bigint") if not turn else real(name, turn))
    names = spark.createDataFrame([(["a"], T), (["b"], T), (["c"], T), (["d", "*"], T)], "object array<string>, cond long")
    assert alias.numbered(names).select("id").distinct().count() == 4
    got = alias.alias_classes(names, spark.createDataFrame([(["a"], ["c"], T)], "left array<string>, right array<string>, cond long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["class"], set()).add(tuple(r["object"]))
    assert sorted(map(sorted, groups.values())) == [[("a",), ("c",)], [("b",)], [("d",)], [("d", "*")]]


def test_many_nested_calls(spark):
    """As many as there is room for have numbers of their own, more are an error, and room_for says what they need."""
    node = spark.createDataFrame([(1, 1, "x", "x", T, True, False, False), (2, 1, "x", "x", T, False, True, False)], "n long, method long, kind string, text string, pc long, is_start boolean, is_exit boolean, is_call boolean")
    cfg = spark.createDataFrame([(1, 2, T)], "src long, dst long, cond long")
    calls = spark.range(70).selectExpr("2L AS n", "CAST(id AS INT) AS k", "concat('f', id, '()') AS call")
    n2, c2 = rewrite.spread(node, cfg)
    with pytest.raises(PySparkException, match="room"):
        rewrite.hoist_calls(n2, c2, calls.withColumn("n", F.lit(128).cast("long")))[0].collect()
    room = rewrite.room_for(calls)
    n2, c2 = rewrite.spread(node, cfg, room)
    n3, c3, _ = rewrite.hoist_calls(n2, c2, calls.withColumn("n", F.lit(2 * room).cast("long")), room)
    n3, c3 = rewrite.add_returns(*rewrite.single_entry(n3, c3), room)
    assert n3.count() == n3.select("n").distinct().count() == 2 + 70 + 2
    assert c3.where("src = dst").isEmpty() and c3.count() == c3.select("src", "dst").distinct().count() == 70 + 1 + 2


def test_batches_that_take_edges_back(spark, tmp_path):
    rng = random.Random(7)
    units = ReachableNodes(spark, str(tmp_path), spark.createDataFrame([(0, T)], "node long, cond long"))
    held: dict[tuple[int, int], int] = {}
    for batch in range(3):
        rows = [(*x, False) for x in random_links(rng, 9, 12)]
        rows += [(*k, rng.choice([T, C.feature(1), rng.getrandbits(32)]), True) for k in rng.sample(sorted(held), min(5, len(held)))]
        for a, b, c, gone in sorted(rows, key=lambda r: not r[3]):
            held[a, b] = held.get((a, b), 0) & ~c if gone else held.get((a, b), 0) | c
        units.update(spark.createDataFrame(rows, "src long, dst long, cond long, gone boolean"), batch)
    fresh = fixpoint.reach(units.start, spark.createDataFrame([(*k, c) for k, c in held.items() if c], "src long, dst long, cond long"))
    assert sorted(map(tuple, units.state(2).select("node", "cond").collect())) == sorted(map(tuple, fresh.collect()))


def test_units_are_stored_by_content(spark, tmp_path):
    path = str(tmp_path / "units")
    files = lambda: sorted(str(f) for f in tmp_path.rglob("content=*/*.parquet"))
    rows = [(f"u{k}", k * 10 + i, i) for k in range(6) for i in range(4)]
    frame = lambda rows: {"a": spark.createDataFrame(rows, "unit string, x long, y long"), "b": spark.createDataFrame([(u, y) for u, _, y in rows if y == 1], "unit string, y long")}
    assert tables.store_units(frame(rows), path) == {"new": 6, "known": 0}
    first = files()
    assert tables.store_units(frame(rows[::-1][:16] + rows[:8]), path) == {"new": 0, "known": 6} and files() == first
    changed = [("u3", -1, -1) if r == ("u3", 31, 1) else r for r in rows] + [("copy", x, y) for u, x, y in rows if u == "u5"]
    assert tables.store_units(frame(changed), path)["new"] == 1
    assert set(first) < set(files()) and len(files()) == len(first) + 1
    got = tables.load_units(spark, path, "a")
    assert sorted((r["unit"], r["x"], r["y"]) for r in got.collect()) == sorted(changed)
    only = tables.load_units(spark, path, "a", spark.createDataFrame([("copy",)], "unit string"))
    assert sorted(r["x"] for r in only.collect()) == [50, 51, 52, 53]
    assert tables.prune_units(spark, path, "a", "b") == 1 and len(files()) == len(first) - 1
    assert sorted((r["unit"], r["x"], r["y"]) for r in tables.load_units(spark, path, "a").collect()) == sorted(changed)


def test_covers_of_cubes_of_one_size_meet_no_pairs(spark):
    """As those of paths of one length: only smaller cubes can imply others, and all sampled configurations are asked at once."""
    plain = lambda v: Q.let(F.array_sort(F.array_distinct(v)), lambda own: F.filter(own, lambda x: ~F.exists(own, lambda y: (y != x) & Q.implied(y, x))))
    one = F.transform(F.sequence(F.lit(1), F.lit(1200)), lambda k: F.array_sort(F.array(k, k + F.col("id").cast("int") + 1, -(k + 7))))
    df = spark.range(8).repartition(1).select(one.alias("v")).cache()
    assert df.count() == 8

    def timed(value):
        began = time.perf_counter()
        return [r[0] for r in df.select(value).collect()], time.perf_counter() - began

    timed(Q.absorbed(F.slice("v", 1, 3))), timed(plain(F.slice("v", 1, 3)))
    (want, slow), (got, fast) = timed(plain(F.col("v"))), timed(Q.absorbed(F.col("v")))
    assert got == want and fast < slow / 2


def test_masks_of_sampled_configurations(spark):
    rng, configs = random.Random(3), [set(), {1, 2, 9}, {3}] + [{f for f in range(1, 12) if (f * k) % 3} for k in range(61)]
    rows = [*covers(rng, 60, 12), [], [[]], [[40]], [[-40, 1]]]
    got = spark.createDataFrame([(c,) for c in rows], f"a {Q.TYPE}").select("a", Q.held_in(F.col("a"), configs).alias("m"), Q.held_in(F.col("a"), configs[:3]).alias("few")).collect()
    for r in got:
        want = sum(1 << i for i, c in enumerate(configs) if holds(r["a"], c))
        assert (r["m"] % 2**64, r["few"]) == (want, want & 7)
    # A cube that names a feature twice doesn't take the one that it says the same as with it.
    assert [r[0] for r in spark.range(1).select(Q.either(Q.literal(F.lit(1)), Q.lit([1, 1]))).collect()] == [[[1]]]
