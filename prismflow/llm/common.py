"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch: 500 texts of 100 KB are 50 MB, which a Python worker can hold.
BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` where it is higher."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder; a cluster without it is an error.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if where is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "prismflow-checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, replicated as that folder is, and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_id() -> F.Column:
    """A number for each row: partition and place in it. It holds for one pass only, since another pass may split a scan otherwise;
    what takes rows up again needs ``numbered``."""
    return F.monotonically_increasing_id()


def of_one_scan(df: DataFrame) -> bool:
    """Whether the rows of ``df`` are rows of one Parquet scan, each once at most."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic() or "_metadata" in (c.lower() for c in df.columns):
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and "Parquet" in plan.relation().fileFormat().getClass().getSimpleName()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number ``name`` for each row that stays the same in every later pass, however a pass splits its input.

    Rows of a Parquet scan are numbered by file and place in the file; only the list of files goes to the driver. Any other table is written
    once to the shared folder, and the result reads it from there.
    """
    if not of_one_scan(df):
        return checkpoint(df.withColumn(name, row_id()))
    path, at = fresh(df, "file_path", "file_number")
    files = sorted(r[0] for r in df.select(F.col("_metadata.file_path").alias(path)).distinct().collect())
    known = df.sparkSession.createDataFrame([(f, k << 40) for k, f in enumerate(files)], f"`{path}` string, `{at}` long")
    own = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(name))
    return own.join(F.broadcast(known), path).withColumn(name, F.col(name) + F.col(at)).drop(path, at)


def extended(df: DataFrame, *more: T.StructField) -> tuple[list[str], T.StructType]:
    """The columns of ``df`` that go on and the schema with ``more``; a column of a new one's name is replaced."""
    new = {f.name.lower() for f in more}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    return [f.name for f in kept], T.StructType([*kept, *more])


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns of these names renamed, and what gives a result the columns of ``df`` alone again."""
    taken = {n.lower() for n in names}
    new = {c: x for c, x in zip(df.columns, fresh_like(df, names), strict=True) if c.lower() in taken}
    own = df.select(*(F.col(f"`{c}`").alias(new.get(c, c)) for c in df.columns))
    return own, lambda out: out.select(*(F.col(f"`{new.get(c, c)}`").alias(c) for c in df.columns))


def fresh_like(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    taken = {c.lower() for c in (*df.columns, *names)}
    return [next(x for k in range(1, 99) if (x := f"{c}{'_' * k}").lower() not in taken) for c in df.columns]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column one after another, and the offsets of the texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offs.astype(np.int64)


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer text is a piece of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def spaced(raw: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array, each byte as ``form`` has it: a space before and after each text, runs of spaces as one, a zero
    after each text and eight more at the end. Also the places of the zeros after the texts."""
    n, size = len(offsets) - 1, np.diff(offsets)
    long = np.full(int(size.sum()) + 3 * n, 32, np.uint8)
    begin = np.cumsum(size + 3) - (size + 3)
    inside = np.arange(int(size.sum())) + np.repeat(begin + 1 - (np.cumsum(size) - size), size)
    long[inside] = form[raw[offsets[0] : offsets[-1]]]
    long[begin + size + 2] = 0
    keep = np.ones(len(long), bool)
    keep[1:] = (long[1:] != 32) | (long[:-1] != 32)
    data = np.concatenate([long[keep], np.zeros(8, np.uint8)])
    return data, np.flatnonzero(data[:-8] == 0)
