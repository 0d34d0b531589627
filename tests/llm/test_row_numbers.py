"""Rows keep their numbers when a later pass splits its input otherwise."""

from __future__ import annotations

from collections import Counter

import pytest

from prismflow.llm import common, exact, repeats, simhash

KEY = "spark.sql.files.maxPartitionBytes"
N = 60


@pytest.fixture
def docs(spark, tmp_path):
    words = lambda k: " ".join(f"w{k * 977 + i * i * 31}" for i in range(40))
    rows = [(k, words(k // 2 if k % 3 else k + 1000)) for k in range(N)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(f"{tmp_path}/docs")
    before = spark.conf.get(KEY)
    yield spark.read.parquet(f"{tmp_path}/docs")
    spark.conf.set(KEY, before)


def other_splits(spark, docs):
    before = docs.rdd.getNumPartitions()
    spark.conf.set(KEY, "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.parquet(*docs.inputFiles()).rdd.getNumPartitions() != before
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_stay(spark, docs):
    own = common.numbered(docs.where("doc_id > 3").select("doc_id"), "n")
    first = sorted(map(tuple, own.collect()))
    other_splits(spark, docs)
    assert sorted(map(tuple, own.collect())) == first and len({n for _, n in first}) == N - 4
    twice = docs.selectExpr("doc_id", "explode(array(1, 2)) AS k")
    assert not common.of_one_scan(twice) and not common.of_one_scan(docs.where("rand() < 0.5")) and len({r["n"] for r in common.numbered(twice, "n").collect()}) == 2 * N


@pytest.mark.parametrize("drop", [exact.drop_copies, simhash.drop_near_copies])
def test_the_right_copies_go(spark, docs, drop):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = drop(docs)
    other_splits(spark, docs)
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == sorted({t: k for k, t in sorted(texts.items(), reverse=True)}.values()) and len(got) < N


def test_the_right_repeats_go(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    count = Counter(texts.values())
    out = repeats.remove_repeats(docs, depth=100)
    other_splits(spark, docs)
    assert {r["doc_id"]: r["kept"].decode() for r in out.collect()} == {k: "" if count[t] > 1 else t for k, t in texts.items()}
