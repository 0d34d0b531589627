"""Exact dedup by heavy-hitter split, with DataFrame functions only.

A frequent-items summary (Misra-Gries kind, bounded number of counters) finds digests that many rows share. Their
exact counts and winners are at most ``heavy`` rows, so they are broadcast and the rows of those groups
never shuffle. All other digests are grouped and joined by an ordinary shuffle: there, no group holds
more than about a ``1/heavy`` part of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.llm import common

#: The white space that doesn't count: [\x20\x09-\x0D].
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: F.Column) -> F.Column:
    text = F.coalesce(text, F.lit(""))
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 64, tracked: int = 4096, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space. Of equal texts the one with the most code
    points stays, then the one with the smallest id (null ids last), then the first row, so that exactly one row
    of each group has kept = true even if whole rows repeat. Null text counts as empty, and all empty texts are
    equal. Other columns of ``docs`` are not read. ``row_col`` has the rows' numbers if there are any. An empty table gives an empty result.
    """
    digests = common.checkpoint(
        docs.select(
            (F.col(row_col) if row_col else common.row_id()).alias("row_id"),
            F.col(id_col).alias("doc_id"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("length"),
            F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
        )
    )
    best = F.min(F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row_id").alias("row"))).alias("best")
    frequent = (
        digests.agg(F.expr(f"approx_top_k(hex(digest), {heavy}, {tracked})").alias("top"))
        .select(F.explode("top").alias("top"))
        .where("top.count > 1")
        .select(F.unhex("top.item").alias("digest"))
    )
    frequent = common.checkpoint(frequent)
    # At most `heavy` rows, whatever the input: the summary's candidates, counted exactly.
    winners = common.checkpoint(digests.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")))
    hot = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")), "digest")
    return hot.unionByName(cold).select(
        "row_id",
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that exact_groups() keeps."""
    (row,) = common.fresh(docs, "row_id")
    docs = common.numbered(docs, row)
    gone = exact_groups(docs, id_col, text_col, row_col=row).where(~F.col("kept")).select(F.col("row_id").alias(row))
    return docs.join(gone, row, "left_anti").drop(row)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.documents(spark, sf_dir)).drop("row_id")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER g AS keep_id, row_number() OVER g AS place
  FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w
"""
