"""SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprints within four bits of each other share at least four of their eight bytes, position by position.
The index lists fingerprints by their bytes at three positions: 20 triples are enough for every choice of
four of the eight positions to hold one, so no pair that reaches the guaranteed four matches is missed,
and a list has a part of about 2^-24 of all fingerprints instead of the 2^-8 of a list for a single byte.
A pair that meets in lists has its shared positional bytes tallied, goes on with four or more, and is verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismflow.llm import common, graph

SHINGLE, BITS, SEED = 4, 4, 42
#: A-Z in lower case, white space as a space.
FORM = np.arange(256, dtype=np.uint8)
FORM[0x41:0x5B] += 32
FORM[0x09:0x0E] = 32
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 14


def triples() -> list[tuple[int, int, int]]:
    """Triples of positions 0 to 7 such that any four positions hold one.

    The positions fall into three groups. Any four of them have two in one group, so that three of them lie
    within that group or in it and the next one: these are Turan's triples.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]

    def chosen(t: tuple[int, ...]) -> bool:
        g = [group[i] for i in t]
        one = [x for x in range(3) if g.count(x) == 3]
        two = [x for x in range(3) if g.count(x) == 2 and g.count((x + 1) % 3) == 1]
        return bool(one or two)

    return [t for t in combinations(range(8), 3) if chosen(t)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of one text; words are runs of other bytes than white space."""
    own = FORM[np.frombuffer(text, np.uint8)].tobytes().split()
    if not own:
        return 0
    line = b" ".join(own)
    length = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    n = max(1, len(own) - size + 1)
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(size, len(own)) - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        ones += np.unpackbits(hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """row_id, doc columns but the text, and fp (the 64-bit SimHash as a signed number) for each row of ``docs``.

    A null text has no words, as an empty one; no words: fingerprint zero. Fewer than ``size`` words are one shingle. ``row_col`` has
    the rows' numbers if there are any.
    """
    common.arrow_rows(docs.sparkSession)
    rows = docs.select((F.col(row_col) if row_col else common.row_id()).alias("row_id"), *(c for c in docs.columns if c != row_col))
    kept = [c for c in rows.columns if c != text_col]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            raw, offs = common.utf8(batch.column(names.index(text_col)))
            data, offs = memoryview(raw), offs.tolist()
            fp = np.array([fingerprint(data[a:b], size) for a, b in zip(offs, offs[1:], strict=False)], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(fp.view(np.int64))], names=[*kept, "fp"])

    return rows.mapInArrow(run, schema)


def byte_at(fp: F.Column, i: int) -> F.Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (x, y), x < y, of distinct fingerprints ``fp`` of ``prints`` that differ in ``bits`` bits at most (4 or fewer).

    A pair comes from the first list that it shares, so that it comes once.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees matches for up to 4 bits")
    chosen = triples()
    key = lambda k, t: F.shiftleft(F.lit(k).cast("bigint"), 24) + F.shiftleft(byte_at(F.col("fp"), t[0]), 16) + F.shiftleft(byte_at(F.col("fp"), t[1]), 8) + byte_at(F.col("fp"), t[2])
    index = prints.select("fp", F.explode(F.array(*(key(k, t) for k, t in enumerate(chosen)))).alias("list"))
    x, y = index.select("list", F.col("fp").alias("x")), index.select("list", F.col("fp").alias("y"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    tally = sum(((byte_at(differ, i) == 0).cast("int") for i in range(8)), F.lit(0))
    earlier = F.lit(-1)
    for k, t in reversed(list(enumerate(chosen))):
        mask = sum(255 << (8 * i) for i in t)
        mask -= (mask >> 63) << 64
        earlier = F.when(differ.bitwiseAND(F.lit(mask)) == 0, F.lit(k)).otherwise(earlier)
    meet = x.join(y, "list").where(F.col("x") < F.col("y"))
    return meet.where((tally >= 8 - bits) & (F.bit_count(differ) <= bits) & (earlier == F.shiftright("list", 24))).select("x", "y")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, row_col: str | None = None) -> DataFrame:
    """row_id, doc_id, fp, component_id (smallest id reachable over links, itself included), first_row (row that stands for the
    component) for each row of ``docs``; equal fingerprints are one class, which links once for all its rows.

    Null ids count as the largest; a component of null ids only has a null component_id. Rows that
    repeat are rows of their own with one fingerprint. An empty table gives an empty result.
    """
    own = [F.col(row_col).alias("row_id")] if row_col else []
    prints = common.checkpoint(fingerprints(docs.select(*own, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), row_col="row_id" if row_col else None))
    classes = common.checkpoint(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row_id").alias("row"))).alias("best")))
    found = graph.components(links(classes.select("fp"), bits).select(F.col("x").alias("a"), F.col("y").alias("b")))
    label = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = label.groupBy("component").agg(F.min("best").alias("first"))
    named = label.select("fp", "component").join(best, "component").select("fp", F.col("first.id").alias("component_id"), F.col("first.row").alias("first_row"))
    return prints.join(named, "fp").select("row_id", "doc_id", "fp", "component_id", "first_row")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, but one row of each component only: that of the smallest id."""
    (row,) = common.fresh(docs, "row_id")
    docs = common.numbered(docs, row)
    gone = near_groups(docs, id_col, text_col, bits, row).where("row_id <> first_row").select(F.col("row_id").alias(row))
    return docs.join(gone, row, "left_anti").drop(row)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
