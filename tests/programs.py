"""Small programs as tables, and a solver that follows one configuration at a time in plain Python."""

from __future__ import annotations

from prismflow.functions import cond as C
from prismflow.operators.solver import Program
from prismflow.plans.information_flow import Statements
from prismflow.sources.tables import SCHEMAS

A, B, CC, D, E = (C.feature(k) for k in range(5))
T, N = C.TRUE, C.negated


def tables(spark, nodes, cfg, calls=(), defs=(), uses=(), assigns=(), params=()):
    make = lambda rows, name: spark.createDataFrame(list(rows), SCHEMAS[name])
    program = Program(make(nodes, "node"), make(cfg, "cfg"), make(calls, "calls"))
    statements = Statements(make(defs, "defs"), make(uses, "uses"), make(assigns, "assigns"), make(params, "params"))
    return program, statements, program.node.where("n = 0").select("n")


def straight(text_rows, method, starts, exits, calls=()):
    return [(n, method, "stmt", text, pc, n in starts, n in exits, n in calls) for n, text, pc in text_rows]


def if1():
    """A definition under B and an operand under C: the last statement gets `secret` under B and C."""
    rows = [(0, "", T), (1, "int secret = 30", T), (2, "int i = 20", T), (3, "int j = 1000", T), (4, "int value = 0", T), (5, "int id = 0", T), (6, "int res = value", T), (7, "int sink", T), (8, "id = secret", B), (9, "if (i < 10)", T), (10, "res = i + j + id", CC), (11, "res = i + j", N(CC)), (12, "sink = res", T), (13, "return sink", T)]
    cfg = [(i, i + 1, T) for i in range(7)] + [(7, 8, B), (7, 9, N(B)), (8, 9, B), (9, 10, CC), (9, 11, N(CC)), (9, 12, T), (10, 12, CC), (11, 12, N(CC)), (12, 13, T)]
    defs = [(n, v, 1) for n, v in enumerate(["", "secret", "i", "j", "value", "id", "res", "sink", "id", "", "res", "res", "sink"]) if v]
    assigned = {6: ("res", ["value"]), 8: ("id", ["secret"]), 10: ("res", ["i", "j", "id"]), 11: ("res", ["i", "j"]), 12: ("sink", ["res"])}
    uses = [(n, v, False) for n, (_, vs) in assigned.items() for v in vs] + [(9, "i", False), (13, "sink", False)]
    assigns = [(n, a, v, 1) for n, (a, vs) in assigned.items() for v in vs]
    return {"nodes": straight(rows, 1, {0}, {13}), "cfg": cfg, "defs": defs, "uses": uses, "assigns": assigns}


def return_flow():
    """A call with two exits: `sink = y` gets `secret` where B, C and E hold and A doesn't."""
    main = [(0, "", T), (1, "defaultValue = 0", T), (2, "secret = 666", T), (3, "int x, y, sink", T), (4, "x = defaultValue", T), (5, "y = defaultValue", T), (6, "x = secret", E), (7, "y = foo(x)", CC), (8, "", T), (9, "sink = y", T), (10, "return", T)]
    foo = [(20, "", T), (21, "p = 0", A), (22, "printf(p)", T), (23, "return p", B), (24, "return 0", N(B))]
    cfg = [(i, i + 1, T) for i in range(5)] + [(5, 6, E), (5, 7, N(E) & CC), (5, 8, N(E) & N(CC)), (6, 7, E & CC), (6, 8, E & N(CC)), (7, 8, CC), (8, 9, T), (9, 10, T), (20, 21, A), (20, 22, N(A)), (21, 22, A), (22, 23, B), (22, 24, N(B))]
    assigned = {4: ("x", "defaultValue"), 5: ("y", "defaultValue"), 6: ("x", "secret"), 9: ("sink", "y")}
    defs = [(1, "defaultValue", 1), (2, "secret", 1), (3, "x", 1), (3, "y", 1), (3, "sink", 1), (7, "y", 1), (21, "p", 1)] + [(n, a, 1) for n, (a, _) in assigned.items()]
    uses = [(n, v, False) for n, (_, v) in assigned.items()] + [(7, "x", False), (22, "p", False), (23, "p", False)]
    return {"nodes": straight(main, 1, {0}, {10}, {7}) + straight(foo, 2, {20}, {23, 24}), "cfg": cfg, "calls": [(7, 2, CC)], "defs": defs, "uses": uses, "assigns": [(n, a, v, 1) for n, (a, v) in assigned.items()], "params": [(7, 2, "x", "p", T)]}


def loop():
    """A loop whose body calls a function under A, with a global."""
    main = [(0, "", T), (1, "g = 1", T), (2, "a = g", T), (3, "while (a)", T), (4, "a = f(a)", A), (5, "return a", T)]
    f = [(30, "", T), (31, "r = p", D), (32, "return r", T)]
    cfg = [(0, 1, T), (1, 2, T), (2, 3, T), (3, 4, A), (3, 5, B), (4, 3, A), (30, 31, D), (30, 32, N(D)), (31, 32, D)]
    defs = [(1, "g", 0), (2, "a", 1), (4, "a", 1), (31, "r", 1)]
    uses = [(2, "g", False), (3, "a", False), (4, "a", False), (5, "a", False), (31, "p", False), (32, "r", False)]
    nodes = straight(main, 1, {0}, {5}, {4}) + straight(f, 2, {30}, {32})
    return {"nodes": nodes, "cfg": cfg, "calls": [(4, 2, T)], "defs": defs, "uses": uses, "assigns": [(2, "a", "g", 1), (31, "r", "p", 1)], "params": [(4, 2, "a", "p", T)]}


Z = ("", -1, -1, "", -1)


def base(v):
    return v.split(".")[0]


def part(path, assigned):
    return path == assigned or path.startswith(assigned + ".")


def rules(p, config):
    """What is there in one configuration (statements, successors, callees, starts), and the flows of facts (normal, into, back, over)."""
    on = lambda m: m >> config & 1
    nodes = {x[0]: x for x in p["nodes"] if on(x[4])}
    succ, callees = {}, {}
    for a, b, c in p["cfg"]:
        if on(c) and a in nodes:
            succ.setdefault(a, set()).add(b)
    starts = {x[1]: x[0] for x in nodes.values() if x[5]}
    for n, m, c in p.get("calls", ()):
        if on(c) and n in nodes and m in starts:
            callees.setdefault(n, set()).add(m)
    at = lambda rows, n: [r[1:] for r in rows if r[0] == n]

    def normal(n, d):
        assigned, defs = at(p["assigns"], n), at(p["defs"], n)
        if d == Z:
            new = {(a, s) for a, _, s in assigned} or set(defs)
            return {Z} | {(v, n, s, v, n) for v, s in new}
        out = {(a + d[0][len(v):], n, s, *d[3:]) for a, v, s in assigned if part(d[0], v) and not array_only(n, v)}
        kills = any(part(d[0], a) for a, _, _ in assigned) or any(part(d[0], v) and (s <= d[2] or d[2] == -1) for v, s in defs)
        return out if kills else out | {d}

    def array_only(n, v):
        own = [x[1] for x in at(p["uses"], n) if x[0] == v]
        return bool(own) and all(own)

    def passed(n, m, d):
        if d == Z:
            return {Z}
        out = {d} if d[2] == 0 else set()
        for r in p.get("params", ()):
            if r[:2] == (n, m) and part(d[0], r[2]):
                v = r[3] + d[0][len(r[2]):]
                out |= {(v, n, 1, v, n), (v, n, 1, *d[3:])}
        return out

    def given_back(n, x, d):
        if d == Z:
            return {Z}
        out = {d} if d[2] == 0 else set()
        for u, _ in at(p["uses"], x):
            if part(d[0], u):
                for f, s in at(p["defs"], n):
                    v = f + d[0][len(u):]
                    out |= {(v, n, s, v, n), (v, n, s, *d[3:])}
        return out

    def over(n, d):
        return set() if d != Z and (d[2] == 0 or any(part(d[0], v) for v, _ in at(p["defs"], n))) else {d}

    return nodes, succ, callees, starts, normal, passed, given_back, over


def brute_steps(p, config):
    """(n, d): fewest steps of one configuration, by walks with the calls that are open; for programs without recursion."""
    nodes, succ, callees, starts, normal, passed, given_back, over = rules(p, config)
    first = (0, Z, ())
    seen, now = ({first: 0}, [first]) if 0 in nodes else ({}, [])
    while now:
        new = []
        for n, d, open_ in now:
            nexts = [(m, e, open_) for m in succ.get(n, ()) for e in (over if nodes[n][7] else normal)(n, d)]
            nexts += [(starts[q], e, (*open_, n)) for q in callees.get(n, ()) for e in passed(n, q, d)]
            if nodes[n][6] and open_:
                nexts += [(m, e, open_[:-1]) for m in succ.get(open_[-1], ()) for e in given_back(open_[-1], n, d)]
            for w in nexts:
                if w[0] in nodes and w not in seen:
                    seen[w] = seen[n, d, open_] + 1
                    new.append(w)
        now = new
    best = {}
    for (n, d, _), k in seen.items():
        best[n, d] = min(k, best.get((n, d), k))
    return best


def brute(p, config):
    """Path edges of one configuration: a work list over (d1, n, d2)."""
    nodes, succ, callees, starts, normal, passed, given_back, over = rules(p, config)
    edges, todo = set(), []

    def put(e):
        if e[1] in nodes and e not in edges:
            edges.add(e)
            todo.append(e)

    put((Z, 0, Z))
    changed = True
    while changed:
        changed = False
        while todo:
            d1, n, d2 = todo.pop()
            changed = True
            for m in succ.get(n, ()):
                for d3 in (over if nodes[n][7] else normal)(n, d2):
                    put((d1, m, d3))
            for q in callees.get(n, ()):
                for d3 in passed(n, q, d2):
                    put((d3, starts[q], d3))
        for d0, n, d4 in list(edges):
            for q in callees.get(n, ()):
                for d1 in passed(n, q, d4):
                    for e1, x, d2 in list(edges):
                        if e1 == d1 and nodes[x][6] and nodes[x][1] == q:
                            for r in succ.get(n, ()):
                                for d5 in given_back(n, x, d2):
                                    put((d0, r, d5))
        changed = changed and bool(todo)
    return edges
