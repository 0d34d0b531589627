from __future__ import annotations

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(before: str) -> set[str]:
    code = f"{before}\nimport __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    return set(subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout.split())


def test_the_rest_works_without_the_corpus_operators():
    without = names("import sys; sys.modules['corpus_pipeline'] = None; sys.modules['prismflow.llm'] = None")
    assert "lifted_reach_cyclic" in without and not any(n.startswith("op") and n[2].isdigit() for n in without) and "pipeline" not in without


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
