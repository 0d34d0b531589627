"""The whole pipeline against plain Python, and the queries that have SQL against DuckDB."""

from __future__ import annotations

import glob
import os
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from prismflow.llm import langid, registry
from test_contracts import brute_components, brute_fingerprint, brute_search


def test_pipeline(spark, sf_dir, tmp_path):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text", "lang", "source"])
    rows = list(zip(*(t[c].to_pylist() for c in t.column_names), strict=True))
    items = pq.read_table(f"{sf_dir}/benchmark.parquet")
    passage = items["text"][3].as_py()
    long = max((r for r in rows if r[2] == "en"), key=lambda r: len(r[1]))[1][:6000]
    rows += [(5000, None, None, None), (5001, "", "en", "s"), (5002, "1 2 3 !", None, "s"), (5003, long, "en", "s"), (5004, long.replace(" ", "  "), "en", "s"), (5005, long + " indeed", "en", "s"), (5005, long + " indeed", "en", "s"), (5006, long[:900] + " " + passage + " " + long[900:], "en", "s"), (5007, "The of and in the of to and. " * 30, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars", "1 AS n_tokens", "'x' AS score")
    df.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    os.symlink(f"{sf_dir}/benchmark.parquet", tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    model = langid.train(docs.where(~langid.held_out()))

    def accepted(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return bool(model.predict(raw, np.array([0, len(raw)]))[2][0])

    left = [r for r in rows if accepted(r[1])]
    assert {5000, 5001, 5002}.isdisjoint(r[0] for r in left) and len(left) > 0.95 * len(rows)
    best = {}
    for r in left:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        if key not in best or (-len(r[1]), r[0]) < (-len(best[key][1]), best[key][0]):
            best[key] = r
    left = list(best.values())
    fp = {r[0]: brute_fingerprint(r[1]) for r in left}
    distinct = sorted(set(fp.values()))
    part = brute_components([(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 4], distinct)
    stay = {}
    for r in sorted(left):
        stay.setdefault(part[fp[r[0]]], r)
    left = list(stay.values())
    hits = {x[0]: x[3] for x in brute_search([r[:2] for r in left], list(zip(items["item_id"].to_pylist(), items["text"].to_pylist(), strict=True)))}
    assert 5006 not in {k for k, v in hits.items() if not v}
    left = [r for r in left if not hits[r[0]]]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r[0], r[2] or "", np.array(library.encode(r[1], add_special_tokens=False).ids, "<u4").tobytes(), r[1]) for r in left)
    got = sorted((r["doc_id"], r["lang"] or "", bytes(r["ids_le"]), r["decoded"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want

    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
        step.write.parquet(str(tmp_path / name))
        step = spark.read.parquet(str(tmp_path / name))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_what_sql_gives(spark, sf_dir, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, rel = registry.queries()[name](spark, sf_dir), duck.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    bag = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert bag(tuple(r) for r in got.select(*cols).collect()) == bag(tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall())
