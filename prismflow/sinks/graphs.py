"""Graphs and documents of results, as tables of text lines and as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismflow.functions import cond as C
from prismflow.functions.text import label

#: Colours, styles and texts of the graph format (fixed values).
PLAIN, FEATURE, FUNCTION = "white", "#CD5200", "blue"
EDGE, FEATURE_EDGE = "black", "red"
NODE_STYLE, EDGE_STYLE = 'fontname="Calibri", style="filled"', 'style="setlinewidth(1)"'
NO_POSITION = "No Position available"


def node_line(node: Column, text: Column, position: Column, cond: Column, is_function: Column) -> Column:
    return F.concat(
        F.lit('"'), node.cast("string"), F.lit('"[label="{{'), label(text), F.lit("}|{"), F.coalesce(position, F.lit(NO_POSITION)), F.lit("}|"), label(C.text(cond)), F.lit('}", color="'),
        F.when(is_function, FUNCTION).otherwise("black"), F.lit(f'", {NODE_STYLE}, fillcolor="'), F.when(C.tautology(cond), PLAIN).otherwise(FEATURE), F.lit('"];'),
    )


def edge_line(src: Column, dst: Column, cond: Column) -> Column:
    return F.concat(F.lit('"'), src.cast("string"), F.lit('" -> "'), dst.cast("string"), F.lit('"[label="'), C.text(cond), F.lit('", color="'), F.when(C.tautology(cond), EDGE).otherwise(FEATURE_EDGE), F.lit(f'", {EDGE_STYLE}];'))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """place, line: a graph in DOT form. nodes: node, text, position, cond, is_function. edges: src, dst, cond. Lines of one place come in any order."""
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, 'digraph "" {'), (1, "node [shape=record];"), (4, "}")], "place int, line string")
    n = nodes.distinct().select(F.lit(2).alias("place"), node_line(F.col("node"), F.col("text"), F.col("position"), F.col("cond"), F.col("is_function")).alias("line"))
    e = edges.distinct().select(F.lit(3).alias("place"), edge_line(F.col("src"), F.col("dst"), F.col("cond")).alias("line"))
    return frame.unionByName(n).unionByName(e)


def write_dot(lines: DataFrame, path: str) -> None:
    """One file in order of places: for graphs that someone looks at. Large results stay tables."""
    lines.repartitionByRange(1, "place").sortWithinPartitions("place", "line").select("line").write.mode("overwrite").text(path)


def reaching_graphs(sinks: DataFrame, path: str) -> None:
    """A folder of lines for each sink statement: sinks: n, o_at, cond."""
    lines = sinks.select(F.col("n").alias("sink"), edge_line(F.col("o_at"), F.col("n"), F.col("cond")).alias("line")).distinct()
    lines.repartition("sink").write.mode("overwrite").partitionBy("sink").text(path)


def call_graph(calls: DataFrame, node: DataFrame) -> DataFrame:
    """caller, callee, cond: methods that call each other. calls: call, method, cond; node: n, method."""
    own = node.select(F.col("n").alias("call"), F.col("method").alias("caller"))
    return calls.join(own, "call").groupBy("caller", F.col("method").alias("callee")).agg(F.bit_or("cond").alias("cond")).where("cond <> 0")


def exploded_clusters(edges: DataFrame, node: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """method, lines: of each method (all, or those of ``only``) a cluster of the exploded graph. edges: n, d, m, d2, kind (of Solver.exploded_edges()).

    Edges to other methods are dotted. A method's lines are one row, as its statements are few; the graph of all is a table.
    """
    own = node.select("n", "method")
    own = own.join(only.select("method").distinct(), "method", "left_semi") if only is not None else own
    style = F.when(F.col("kind") == "inter", " [style=dotted]").otherwise("")
    name = lambda n, d: F.concat(F.lit('"'), F.col(n).cast("string"), F.lit("_"), F.hex(F.xxhash64(d)), F.lit('"'))
    lines = edges.join(own, "n").select("method", F.concat(name("n", "d"), F.lit(" -> "), name("m", "d2"), style, F.lit(";")).alias("line"))
    return lines.groupBy("method").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def sink_texts(sinks: DataFrame, node: DataFrame) -> DataFrame:
    """n, report: each sink statement with what reaches it, one line for each sink in order. sinks: n, kind, o_var, o_at, assignee, cond."""
    line = F.concat_ws(" ", F.when(F.col("kind") == "assign", F.concat(F.col("assignee"), F.lit(" :="))).otherwise("use of"), F.col("o_var"), F.lit("defined at"), F.col("o_at").cast("string"), F.lit("if"), C.text(F.col("cond")))
    rows = sinks.groupBy("n").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("lines"))
    return rows.join(node.select("n", "text", "pc"), "n").select("n", F.concat_ws("\n", F.concat(F.col("text"), F.lit(" @ "), C.text(F.col("pc"))), "lines").alias("report"))


def json_documents(rows: DataFrame, key: str, name: str = "items") -> DataFrame:
    """key, document: the rows of each key as a JSON array in a document."""
    rest = [c for c in rows.columns if c != key]
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
    return grouped.select(key, F.to_json(F.struct(key, name)).alias("document"))


def write_variants(files: DataFrame, path: str) -> None:
    """The text of each file of each variant, compressed. files: config, file, line, text."""
    whole = files.groupBy("config", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    whole.write.mode("overwrite").partitionBy("config", "file").option("compression", "gzip").text(path)


def merged_links(maps: list[DataFrame]) -> DataFrame:
    """Link maps of single files as one: name, kind, file, line, col, type, cond."""
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    keys = [c for c in out.columns if c != "cond"]
    return out.groupBy(*keys).agg(F.bit_or("cond").alias("cond"))


def class_lines(classes: DataFrame) -> DataFrame:
    """class, line: alias classes as text, objects in order. classes: object (path), class, cond."""
    name = F.concat(F.array_join("object", "."), F.lit(" @ "), C.text(F.col("cond")))
    return classes.groupBy("class").agg(F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("line"))
