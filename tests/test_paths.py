from __future__ import annotations

import pytest
from programs import A, B, CC, N, brute_steps, if1, loop, return_flow, tables

from prismflow.functions import cond as C
from prismflow.operators.paths import Paths, alike
from prismflow.plans import information_flow as IF


def test_classes_of_configurations(spark):
    masks = [A, B & CC, N(A), 0, None]
    got = alike(spark.createDataFrame([(m,) for m in masks], "cond long"))
    assert sum(got) == C.TRUE and len(got) == 4
    assert all(k & m in (0, k) for k in got for m in masks if m is not None)
    assert alike(spark.createDataFrame([], "cond long")) == [C.TRUE]
    assert sum(alike(spark.createDataFrame([(A,)], "cond long"), model=B)) == B


@pytest.mark.parametrize("make", [if1, return_flow, loop])
def test_fewest_steps_of_every_configuration(spark, make):
    program = make()
    solver, _, edges = IF.solve(*tables(spark, **program))
    found = Paths(solver, edges).shortest().collect()
    for config in range(32):
        got = {(r["n"], tuple(r["d"])): r["steps"] for r in found if r["cond"] >> config & 1}
        assert got == brute_steps(program, config)
