"""Program tables from and to storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.functions import cond as C
from prismflow.functions.sat import Formula, dimacs
from prismflow.operators.fixpoint import saved
from prismflow.operators.solver import Program

SCHEMAS = {
    "node": "n long, method long, kind string, text string, pc long, is_start boolean, is_exit boolean, is_call boolean",
    "cfg": "src long, dst long, cond long",
    "calls": "call long, method long, cond long",
    "defs": "n long, var string, scope int",
    "uses": "n long, var string, in_array boolean",
    "assigns": "n long, assignee string, assignor string, scope int",
    "params": "call long, method long, actual string, formal string, cond long",
    "exports": "name string, kind string, file string, line int, col int, type string, cond long",
    "object_names": "object array<string>, cond long",
    "pointer_assignments": "left array<string>, right array<string>, cond long",
    "configs": "config int, enabled string, cond long",
}


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """Tables that save() has written, with the schemas they have to have."""
    return {name: spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}") for name in names}


def store_units(tables: dict[str, DataFrame], path: str, unit: str = "unit") -> dict[str, int]:
    """Tables of translation units (column ``unit``) as Parquet below ``path``, in a folder for each content: a unit whose rows are there already is not written again.

    A unit's digest is taken over the rows of all its tables, whatever their order. Returns how many units were new and how many were there. ``path``/units says which content each unit has now; contents that no unit has any more
    stay until ``prune_units``.
    """
    spark = next(iter(tables.values())).sparkSession
    digest = None
    for name, df in sorted(tables.items()):
        row = F.xxhash64(F.lit(name), *(c for c in sorted(df.columns) if c != unit))
        again = F.hash(F.lit(name), *(c for c in sorted(df.columns) if c != unit)).cast("bigint")
        # Sums don't depend on the order of rows, and count repeats.
        own = df.select(unit, row.cast("decimal(38,0)").alias("x"), again.cast("decimal(38,0)").alias("y"))
        digest = own if digest is None else digest.unionByName(own)
    digest = digest.groupBy(unit).agg(F.sha2(F.concat_ws(",", F.sum("x").cast("string"), F.sum("y").cast("string"), F.count(F.lit(1)).cast("string")), 256).alias("content"))
    digest = saved(digest)
    contents = digest.select("content").distinct()
    known = stored(spark, f"{path}/contents", "content string")
    new = saved(contents.join(known, "content", "left_anti"))
    fresh = new.count()
    if fresh:
        for name, df in tables.items():
            # Units with one content are written once.
            first = digest.join(new, "content").groupBy("content").agg(F.min(unit).alias(unit))
            rows = df.join(first, unit).drop(unit).repartition("content")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("content").parquet(f"{path}/{name}")
        new.write.mode("append").parquet(f"{path}/contents")
    digest.write.mode("overwrite").parquet(f"{path}/units")
    return {"new": fresh, "known": digest.count() - digest.join(new, "content", "left_semi").count()}


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one if nothing has been stored yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def load_units(spark: SparkSession, path: str, name: str, units: DataFrame | None = None, unit: str = "unit") -> DataFrame:
    """The table ``name`` of all stored units, or of those in ``units``, with a column ``unit``; only folders of their contents are read."""
    wanted = spark.read.parquet(f"{path}/units")
    wanted = wanted if units is None else wanted.join(units.select(unit).distinct(), unit, "left_semi")
    return spark.read.parquet(f"{path}/{name}").join(wanted, "content").drop("content")


def prune_units(spark: SparkSession, path: str, *names: str) -> int:
    """Delete the folders of contents that no unit has any more; how many."""
    old = spark.read.parquet(f"{path}/contents").join(spark.read.parquet(f"{path}/units").select("content"), "content", "left_anti").distinct()
    left = saved(spark.read.parquet(f"{path}/units").select("content").distinct())
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for row in old.toLocalIterator():
        gone += 1
        for name in names:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/content={row['content']}"), True)
    left.write.mode("overwrite").parquet(f"{path}/contents")
    return gone


def program(spark: SparkSession, path: str) -> Program:
    t = load(spark, path, "node", "cfg", "calls")
    return Program(t["node"], t["cfg"], t["calls"])


def source_files(spark: SparkSession, path: str, suffix: str = "*.c") -> DataFrame:
    """file, line, text: lines of all files of a folder tree with this ending, numbered from 1."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("line"), "text")


def link_map(spark: SparkSession, path: str) -> DataFrame:
    """Exports of a link map folder: JSON lines with the columns of SCHEMAS["exports"]."""
    return spark.read.schema(SCHEMAS["exports"]).json(path)


def add_unit(tables: dict[str, DataFrame], unit: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with those of one more translation unit."""
    return {k: tables[k].unionByName(v) if k in tables else v for k, v in ({k: None for k in tables} | unit).items() if v is not None} | {k: v for k, v in tables.items() if k not in unit}


def files_present(files: DataFrame, model: int = C.TRUE) -> DataFrame:
    """Files whose presence condition the feature model allows. files: file, cond."""
    return files.where(C.satisfiable(F.col("cond"), model))


def model_mask(*constraints: int) -> int:
    """The feature model of constraints that all have to hold."""
    out = C.TRUE
    for c in constraints:
        out &= c
    return out


def dimacs_mask(text: str) -> int:
    """The feature model of a DIMACS formula over the first five variables: variable k + 1 is feature k. A configuration is allowed if some values of all other variables, however many, go with it."""
    return dimacs_blocks(text, C.FEATURES)[0]


def dimacs_blocks(text: str, features: int) -> list[int]:
    """The feature model of a DIMACS formula over its first ``features`` variables, one mask for each block (functions/cond.py). For more features than some twelve use conditions as cubes
    (functions/cubes.py), for which the clauses stay as they are."""
    model = Formula(dimacs(text))
    out = [0] * C.blocks(features)
    for i in range(C.CONFIGS * len(out)):
        # With fewer than five features, those that aren't there make no difference.
        if model.satisfiable(k + 1 if i >> k & 1 else -k - 1 for k in range(features)):
            out[i // C.CONFIGS] |= 1 << i % C.CONFIGS
    return out


def statements(spark: SparkSession, path: str):
    from prismflow.plans.information_flow import Statements

    t = load(spark, path, "defs", "uses", "assigns", "params")
    return Statements(t["defs"], t["uses"], t["assigns"], t["params"])
