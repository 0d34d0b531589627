"""Hard-negative mining with angular triangle filtering.

Each vector keeps its angles to a few reference directions. For vectors at angles p and q to one reference, the angle between them lies between |p - q| and p + q; the narrowest
of these intervals gives an interval of cosines, and norms make it one of scores, rounded outwards. Vectors are sorted by nearest reference and angle to it and
cut into windows; an anchor is scored, in integers, against the windows whose interval of scores overlaps what it still looks for.

Anchors meet all rows in blocks: every pair of an anchor block and a row block is one row of a join, and is worked on by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.llm import common

#: Reference directions, rows of a block, anchors of a block, rows of a window. All change cost only.
REFERENCES, ROWS, ANCHORS, WINDOW = 12, 8192, 1024, 256
#: Pairs of blocks in one batch: some megabytes each.
BATCH = 4
#: Scores below this are exact in doubles.
EXACT = 2.0**52
SLACK = 1e-6


def usable(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """row_id, id, label, v (whole numbers) of the rows that take part, written once."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(fine, whole).alias("v"))
    return common.checkpoint(rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").withColumn("row_id", common.row_id()))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows; shorter ones end in zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy()
    return out


def angles(v: np.ndarray, directions: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    norm = np.linalg.norm(v, axis=1)
    return np.arccos(np.clip(v @ directions.T / np.where(norm > 0, norm, 1)[:, None], -1, 1))


def placed(rows: DataFrame, directions: np.ndarray, width: int, kind: str) -> DataFrame:
    """``rows`` with v as bytes, the stored angles to the reference directions, the nearest one's number, and the angle to that."""
    keep = [c for c in rows.columns if c != "v"]
    schema = f"{', '.join(f'{c} {rows.schema[c].dataType.simpleString()}' for c in keep)}, v binary, angles binary, cell int, angle double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(batch.schema.names.index("v")), width)
            a = angles(v, directions)
            cell = a.argmin(axis=1).astype(np.int32)
            own = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (v.astype(kind), a)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in keep), *own, pa.array(cell), pa.array(a[np.arange(len(a)), cell])], names=[*keep, "v", "angles", "cell", "angle"])

    return rows.mapInArrow(run, schema)


def packed(rows: DataFrame, parts: int, most: int) -> DataFrame:
    """Blocks of at most ``most`` rows that are near each other: part (0 to ``parts`` - 1), n, and each column of ``rows`` as bytes one after another."""
    numbers = [c for c in rows.columns if c not in ("v", "angles", "cell", "angle")]
    dealt = rows.repartitionByRange(parts, "cell", "angle", "row_id").sortWithinPartitions("cell", "angle", "row_id").select(*numbers, "v", "angles")
    schema = f"part int, n int, {', '.join(f'{c} binary' for c in (*numbers, 'v', 'angles'))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId() % parts, [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            data = [b"".join(t[c].to_pylist()) if c in ("v", "angles") else t[c].to_numpy().astype(np.int64).tobytes() for c in t.column_names]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([t.num_rows], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["part", "n", *t.column_names])

        for batch in batches:
            while size + batch.num_rows >= most:
                head = most - size
                held.append(batch.slice(0, head))
                yield block()
                held, size, batch = [], 0, batch.slice(head)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield block()

    return dealt.mapInArrow(run, schema)


def bounds(a: np.ndarray, norm: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor (angles ``a`` to the references, ``norm``) with vectors whose angles lie between ``lo`` and ``hi``, norms between ``least`` and ``most``."""
    near = np.maximum(np.maximum(a - hi, lo - a).max(axis=1, initial=0.0) - SLACK, 0)
    far = np.minimum(np.minimum(a + hi, 2 * np.pi - a - lo).min(axis=1, initial=np.pi) + SLACK, np.pi)
    top, low = np.cos(near), np.cos(far)
    upper, lower = norm * np.where(top > 0, most, least) * top, norm * np.where(low < 0, most, least) * low
    return lower - np.abs(lower) * 1e-9 - 1, upper + np.abs(upper) * 1e-9 + 1


def products(x: np.ndarray, y: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products in whole numbers; those beyond 64 bits are an error."""
    if exact:
        return np.rint(x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    out = x.astype(object) @ y.astype(object).T
    if out.size and max(abs(out.max()), abs(out.min())) >= 1 << 63:
        raise OverflowError("a score needs more than 64 bits")
    return out.astype(np.int64)


class Block:
    """A packed block's arrays."""

    def __init__(self, n: int, columns: dict[str, bytes], kind: str):
        self.n = n
        self.v = np.frombuffer(columns.pop("v"), kind).reshape(n, -1)
        self.angles = np.frombuffer(columns.pop("angles"), np.float64).reshape(n, -1)
        self.norm = np.linalg.norm(self.v.astype(np.float64), axis=1)
        self.of = {c: np.frombuffer(x, np.int64) for c, x in columns.items()}


def best(anchors: Block, rows: Block, wants: list[tuple[np.ndarray, np.ndarray]], k: int, same: bool, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each anchor and want (least and greatest score by anchor), the ``k`` best rows of the block, of the same label or of another: anchor, want, score, place of the row.

    ``counts`` gets the number of windows scored, and of windows, added."""
    nothing = np.zeros(0, np.int64)
    found = (nothing, nothing, nothing, nothing)
    lo, hi = (np.array([w[i] for w in wants]) for i in (0, 1))
    need = lo.copy()
    cuts = range(0, rows.n, WINDOW)
    spans = []
    for s in cuts:
        own = slice(s, min(s + WINDOW, rows.n))
        spans.append((own, *bounds(anchors.angles, anchors.norm, rows.angles[own].min(axis=0), rows.angles[own].max(axis=0), rows.norm[own].min(), rows.norm[own].max())))
    exact = float(anchors.norm.max(initial=0) * rows.norm.max(initial=0)) < EXACT
    for own, lower, upper in sorted(spans, key=lambda x: -float(x[2].max(initial=0))):
        open_ = ((upper >= need) & (lower <= hi)).any(axis=0)
        if counts is not None:
            counts += (int(open_.sum()), anchors.n)
        chosen = np.flatnonzero(open_)
        if not len(chosen):
            continue
        score = products(anchors.v[chosen], rows.v[own], exact)
        alike = anchors.of["label"][chosen][:, None] == rows.of["label"][own]
        fit = (alike & (anchors.of["row_id"][chosen][:, None] != rows.of["row_id"][own])) if same else ~alike
        new = [found]
        for w in range(len(wants)):
            i, j = np.nonzero(fit & (score >= need[w][chosen][:, None]) & (score <= hi[w][chosen][:, None]))
            new.append((chosen[i], np.full(len(i), w), score[i, j], own.start + j))
        if sum(len(x[0]) for x in new[1:]) == 0:
            continue
        a, w, s, j = (np.concatenate(x) for x in zip(*new, strict=True))
        order = np.lexsort((rows.of["row_id"][j], rows.of["id"][j], -s, w, a))
        a, w, s, j = a[order], w[order], s[order], j[order]
        group = a * len(wants) + w
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.concatenate([first, [len(group)]])))
        last = rank == k - 1
        need[w[last], a[last]] = s[last]
        found = tuple(x[rank < k] for x in (a, w, s, j))
    return found


def searched(blocks: DataFrame, anchors: DataFrame, parts: int, kind: str, wants: int, k: int, same: bool) -> DataFrame:
    """anchor_row, want, score, id, row_id: the best rows of every block for every anchor. ``anchors`` have columns lo_0, hi_0 and so on if ``wants`` is over 0."""
    left, right = (df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns)) for p, df in (("r", blocks), ("a", anchors)))
    met = left.join(right.withColumn("r_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), "r_part").drop("r_part", "a_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                side = {p: Block(r[f"{p}_n"], {c[2:]: x for c, x in r.items() if c[:2] == f"{p}_" and c[2:] != "n"}, kind) for p in ("r", "a")}
                rows, own = side["r"], side["a"]
                every = np.iinfo(np.int64)
                ranges = [(own.of[f"lo_{w}"], own.of[f"hi_{w}"]) for w in range(wants)] or [(np.full(own.n, every.min), np.full(own.n, every.max))]
                a, w, s, j = best(own, rows, ranges, k, same)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own.of["row_id"][a], w, s, rows.of["id"][j], rows.of["row_id"][j])], names=["anchor_row", "want", "score", "id", "row_id"])

    out = met.mapInArrow(run, "anchor_row long, want long, score long, id long, row_id long")
    place = F.expr("row_number() OVER (PARTITION BY anchor_row, want ORDER BY score DESC, id, row_id)")
    return out.withColumn("rank", place).where(F.col("rank") <= k)


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor``: a condition on the id column, named ``id``, that says which rows are anchors. Components count as floor(scale * x); a score is an inner product. An anchor's positives are the ``positives`` best other
    rows of its label; for each, the ``negatives`` best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores first, ties by smaller id.
    Rows without id, label or vector, or with a null or non-finite component, take no part. Rows that repeat are rows of their own. Vectors of different lengths are compared as if the shorter ended in zeros;
    an empty vector scores 0 with all. Scores beyond 64 bits are an error. Other columns aren't read; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col, F.col(label) if isinstance(label, str) else label, scale)
    n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    width, kind = max(1, width or 0), "i2" if (most or 0) < 1 << 15 else "i4" if most < 1 << 31 else "i8"
    # A bounded sample of directions, the same in every run; only cost depends on it.
    sample = [r[0] for r in rows.orderBy(F.xxhash64("id"), "row_id").limit(REFERENCES).select("v").collect()]
    directions = np.array([[*x, *[0] * (width - len(x))] for x in sample], np.float64).reshape(-1, width)
    directions = directions[np.linalg.norm(directions, axis=1) > 0]
    directions = directions / np.linalg.norm(directions, axis=1, keepdims=True) if len(directions) else np.eye(1, width)
    parts = max(spark.sparkContext.defaultParallelism, n // ROWS + 1)
    blocks = common.checkpoint(packed(placed(rows, directions, width, kind), parts, ROWS))
    anchors = rows.where(anchor)
    few = max(1, n // (100 * ANCHORS))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    # The size of a batch is part of the plan only when it runs, so that both searches are written while it holds.
    spark.conf.set(batch, str(BATCH))
    try:
        good = common.checkpoint(searched(blocks, common.checkpoint(packed(placed(anchors, directions, width, kind), few, ANCHORS)), parts, kind, 0, positives, True).select("anchor_row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
        lo, hi = F.expr(f"ceil(CAST({low} AS decimal(4,0)) * positive_score / 100)").cast("long"), F.expr(f"floor(CAST({high} AS decimal(4,0)) * positive_score / 100)").cast("long")
        nothing = {"lo": F.lit(1).cast("long"), "hi": F.lit(0).cast("long")}
        at = lambda w, c, x: F.coalesce(F.max(F.when(F.col("rank") == w + 1, x)), nothing[c]).alias(f"{c}_{w}")
        ranges = good.groupBy("anchor_row").agg(*(at(w, c, x) for w in range(positives) for c, x in (("lo", lo), ("hi", hi))))
        wanting = placed(anchors.join(ranges, anchors["row_id"] == ranges["anchor_row"]).drop("anchor_row"), directions, width, kind)
        bad = common.checkpoint(searched(blocks, common.checkpoint(packed(wanting, few, ANCHORS)), parts, kind, positives, negatives, False))
    finally:
        spark.conf.set(batch, before)
    out = bad.select("anchor_row", "want", F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(good.select("anchor_row", (F.col("rank") - 1).cast("long").alias("want"), "positive_id", "positive_score"), ["anchor_row", "want"])
    named = anchors.select(F.col("row_id").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return out.join(named, "anchor_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(common.documents(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


OP11_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
