"""Exact duplicates by full content, safe against one text with a third of all rows.

Three combining steps, each keyed by the digest AND the whole normalised text, so rows meet only if
their contents are identical: (1) within a map task, (2) within (digest, salt), (3) among the salt
winners of a digest. A hot text reaches step 2 as one row per map task and salt, and step 3 as one
row per salt. Only digests travel when the decision goes back to the rows; adaptive execution splits the
rows of a hot digest there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellwise.llm.base import fresh, quoted, settled, text_or_empty

#: Characters that do not count when texts are compared.
BLANKS = r"[\x20\x09-\x0D]"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), BLANKS, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, text_sha256, keep_id, group_size, kept.

    Of equal texts the longest original stays, then the smallest id. A null text counts as empty; a
    null id loses against any other. Rows that repeat whole, id included, all count in group_size
    and are all marked kept if they hold the winning id and length. Other columns are not read. An
    empty table gives an empty result. If two contents ever had one SHA-256 the job fails instead
    of merging them.
    """
    rows = docs.select(
        quoted(id_col).alias("doc_id"), F.length(text_or_empty(quoted(text_col))).cast("long").alias("n_chars"),
        normalised(quoted(text_col)).alias("body"),
    ).withColumn("text_sha256", F.sha2("body", 256))
    best = F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"))
    salt = F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(salts))
    by_salt = (rows.groupBy("text_sha256", "body", salt.alias("salt"))
               .agg(F.min(best).alias("best"), F.count("*").alias("n")))
    winners = (by_salt.repartition("text_sha256").groupBy("text_sha256", "body")
               .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
               .select("text_sha256", "best", "n", F.count("*").over(Window.partitionBy("text_sha256")).alias("contents")))
    # In a table of its own, so that the join below deals both sides out by itself and can split a hot text.
    winners = settled(winners.select(
        "text_sha256", F.col("best.id").alias("keep_id"), F.col("best.short").alias("short"),
        F.when(F.col("contents") == 1, F.col("n"))
        .otherwise(F.raise_error(F.lit("two different texts have one SHA-256")).cast("long")).alias("group_size")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == -F.col("short"))
    return (rows.drop("body").join(winners, "text_sha256")
            .select("doc_id", "n_chars", "text_sha256", "keep_id", "group_size", kept.alias("kept")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that another row with the same content outranks. Null texts
    count as empty; of rows with null ids and equal texts those of the greatest length stay if no other
    row of their group has an id; rows that repeat whole stay or go together; columns may have any
    names; an empty table gives no rows."""
    own, chars, sha = fresh(docs, "keep_id", "keep_chars", "keep_sha")
    groups = (exact_groups(docs, id_col, text_col).where("kept")
              .select(F.col("doc_id").alias(own), F.col("n_chars").alias(chars), F.col("text_sha256").alias(sha)).distinct())
    text = quoted(text_col)
    same = (quoted(id_col).eqNullSafe(F.col(own)) & (F.sha2(normalised(text), 256) == F.col(sha))
            & (F.length(text_or_empty(text)) == F.col(chars)))
    return docs.join(groups, same, "left_semi")
