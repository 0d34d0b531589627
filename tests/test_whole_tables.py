"""Queries over all rows of small lineitem tables, most of them of few pieces, against brute force per configuration."""

from __future__ import annotations

import random

import duckdb
import pytest

from prismflow import registry
from prismflow.operators.alias import numbered
from prismflow.sources import driver as D

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(5)
    where = str(tmp_path_factory.mktemp("whole"))
    rows = [(rng.randint(1, 12), rng.randint(1, 3), rng.randint(1, 14), rng.randint(1, 9), rng.choice([1, 5, 20, 39, 44, 48, 49, 50]), float(k), rng.choice("ANR"), rng.choice("FO")) for k in range(26)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity int, l_extendedprice double, l_returnflag string, l_linestatus string")
    df.coalesce(1).write.parquet(f"{where}/lineitem.parquet")
    return where


def lines(spark, where):
    return [tuple(r) for r in D.lines(spark, where, "l_quantity").select("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "cond").collect()]


def brute_aliases(rows, config):
    """Classes of all names in one configuration: assignments of that configuration, closed under equal parts that are there in it."""
    there = {n[:k] for f, p, s, _, c in rows if c >> config & 1 for n in ((f"p{p}", "*", f"f{f}"), (f"s{s}", "*", f"f{f}")) for k in (1, 2, 3)}
    up = {n: n for n in there}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for _, p, s, _, c in rows:
        if c >> config & 1:
            up[root((f"p{p}",))] = root((f"s{s}",))
    changed = True
    while changed:
        changed = False
        for x in there:
            for y in there:
                if len(x) > 1 and len(y) > 1 and x[-1] == y[-1] and root(x[:-1]) == root(y[:-1]) and root(x) != root(y):
                    up[root(x)] = root(y)
                    changed = True
    out = {}
    for n in there:
        out.setdefault(root(n), set()).add(".".join(n))
    return {frozenset(x) for x in out.values()}


def test_aliases_of_all_lines_and_configurations(spark, small):
    rows = lines(spark, small)
    got = QUERIES["alias_congruence"](spark, small).collect()
    number = {r["node"]: r["id"] for r in numbered(spark.createDataFrame([(r["node"], r["node"].split(".")) for r in got], "node string, object array<string>")).collect()}
    for config in range(32):
        mine = {}
        for r in got:
            if r["cond"] >> config & 1:
                mine.setdefault(r["class"], set()).add(r["node"])
        assert {frozenset(x) for x in mine.values()} == brute_aliases(rows, config)
        assert all(min(number[n] for n in x) == k for k, x in mine.items())
    assert any(q < 40 for *_, q, _ in rows) and any(len(x) > 2 and any("*" in n for n in x) for x in brute_aliases(rows, 9))


SUPPLY = f"""WITH RECURSIVE l AS (SELECT 2 * l_suppkey AS s, 2 * l_partkey + 1 AS p, {D.LINE_MASK} AS cond FROM lineitem), e AS (SELECT s AS src, p AS dst, cond FROM l UNION ALL SELECT p, s, cond FROM l),
x AS (SELECT src, dst, cfg FROM e, (SELECT unnest(range(32)) AS cfg) WHERE ((cond >> cfg::INT) & 1) = 1), r(node, cfg) AS (SELECT 2::BIGINT, unnest(range(32)) UNION SELECT x.dst, r.cfg FROM r JOIN x ON x.src = r.node AND x.cfg = r.cfg)"""
WHOLE = {
    "lifted_reach_cyclic": SUPPLY + " SELECT node, sum(1::BIGINT << cfg::INT)::BIGINT AS cond FROM r GROUP BY 1",
    "ifds_reach": SUPPLY.replace("r(node, cfg)", "u(node) AS (SELECT 2::BIGINT UNION SELECT e.dst FROM u JOIN e ON e.src = u.node), r(node, cfg)") + " SELECT node FROM u",
    "import_closure": "WITH RECURSIVE r(file) AS (SELECT 1::BIGINT UNION SELECT b.l_suppkey FROM r JOIN lineitem a ON a.l_suppkey = r.file JOIN lineitem b ON a.l_partkey = b.l_partkey) SELECT file FROM r",
    "summary_metrics": f"""WITH n AS (SELECT bit_count(bit_or({D.LINE_MASK}))::BIGINT AS n FROM lineitem GROUP BY l_partkey)
SELECT count(*)::BIGINT AS facts, count(*) FILTER (WHERE n > 0)::BIGINT AS covered, sum(n)::BIGINT AS matches, max(n) AS most, min(n) AS least, (100 * count(*) FILTER (WHERE n > 0)) // count(*) AS percent FROM n""",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_all_lines_and_configurations(spark, small, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{small}/lineitem.parquet/*.parquet'")
    got, want = QUERIES[name](spark, small), duck.sql(WHOLE[name])
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, spark.createDataFrame(want.fetchall(), got.select(*want.columns).schema).collect()))


def test_parameters_by_place(spark, sf_dir):
    """Options of a call one after another: one that the options of the place imply begins the next place."""
    rows = sorted(tuple(r) for r in D.lines(spark, sf_dir, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "cond").collect())
    calls, edges, want = {}, {}, set()
    for call, _, part, supplier, _, c in rows:
        pos, so, out = calls.setdefault(call, [0, 0, []])
        begins = so and so & c == so
        calls[call][:2] = [pos + 1, c] if begins else [pos, so | c]
        out.append((calls[call][0], part, c))
        edges[call, supplier] = edges.get((call, supplier), 0) | c
    for (call, method), e in edges.items():
        for pos, part, c in calls[call][2]:
            for place in range(method % 4 + 1):
                if (pos == place or (place == method % 4 and method % 2 == 0 and pos > place)) and e & c:
                    want.add((call, method, part, f"f{place}", e & c))
    got = [tuple(r) for r in QUERIES["param_zip"](spark, sf_dir).select("call", "method", "actual", "formal", "cond").collect()]
    assert set(got) == want and any(len(x[2]) > 1 and x[0] > 0 for x in calls.values())
