"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Only built-in functions run here. The first scan keeps a length and the hash of a 64-character prefix
of each text; a length, and then a (length, prefix hash) pair, that one row alone has ends that row's
part. Only for the rows that are left does a second scan read whole texts and compute SHA-256; what is
shuffled are those few numbers, never texts.

Texts are equal when they are identical after every x20 and x09-x0D is deleted. Null counts as empty,
and all empty texts form one group. Of a group the row with most code points in its original text,
then with the smallest doc_id, stays; a null doc_id comes after all others. Rows that repeat both text
and doc_id count one by one in ``group_size``; the report marks all rows of the winning (length,
doc_id) as kept, and ``keep_first`` returns one of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, settle, small

PREFIX = 64


def normalised(text: Column) -> Column:
    """The text without x20 and x09-x0D; null is empty."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), (" ", "\n", "\t", "\r", "\x0b", "\x0c"), F.coalesce(text, F.lit("")))


def _light(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    norm = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"), F.length(norm).alias("n_norm"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix"), *more)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Groups of two or more equal texts: sha, group_size, keep (struct n_cp, not_id) and n_same, how
    many rows have exactly the winning (length, doc_id). ``not_id`` is the bitwise complement of doc_id."""
    first = settle(_light(docs, id_col, text_col).select("n_norm", "prefix"), "exact-light")
    by_length = first.groupBy("n_norm").count().filter("count > 1").select("n_norm")
    by_length = settle(by_length, "exact-length")
    alive = first.join(small(by_length, broadcast_rows), "n_norm", "left_semi")
    by_prefix = settle(alive.groupBy("n_norm", "prefix").count().filter("count > 1").select("n_norm", "prefix"), "exact-prefix")
    full = F.sha2(normalised(F.col(text_col)), 256).alias("sha")
    few = by_prefix.count() <= broadcast_rows
    if few:  # whole texts are hashed behind the join, for surviving rows only
        rest = docs.select(F.col(id_col), F.col(text_col))
        keyed = _light(rest, id_col, text_col, F.col(text_col))
        rows = keyed.join(F.broadcast(by_prefix), ["n_norm", "prefix"], "left_semi").select("doc_id", "n_cp", full)
    else:  # too many to broadcast: the hash, not the text, goes through the shuffle
        rows = _light(docs, id_col, text_col, full).join(by_prefix, ["n_norm", "prefix"], "left_semi").select("doc_id", "n_cp", "sha")
    key = F.struct("n_cp", F.bitwise_not("doc_id").alias("not_id"))
    per_key = rows.groupBy("sha", key.alias("keep")).agg(F.count("*").alias("n_same"))
    return per_key.groupBy("sha").agg(F.sum("n_same").alias("group_size"), F.max(F.struct("keep", "n_same")).alias("top")).filter("group_size > 1").select("sha", "group_size", "top.keep", "top.n_same")


def exact_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = settle(duplicate_groups(docs, id_col, text_col), "exact-groups")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    out = rows.join(small(groups), rows.text_sha256 == groups.sha, "left")
    keep_id = F.bitwise_not("keep.not_id")
    alone = F.col("sha").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(keep_id).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("keep").eqNullSafe(F.struct("n_cp", F.bitwise_not("doc_id").alias("not_id"))))).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Texts are not shuffled while the table of
    groups fits its broadcast bound."""
    groups = settle(duplicate_groups(docs, id_col, text_col), "exact-groups").select("sha", "keep", "n_same")
    names = docs.columns
    # own names, so that columns of docs may be called anything
    groups = groups.toDF("__sha", "__keep", "__n_same")
    keyed = docs.withColumns({"__of": F.sha2(normalised(F.col(text_col)), 256), "__me": F.struct(F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"), F.bitwise_not(F.col(id_col)).alias("not_id"))})
    won = keyed.join(small(groups), F.col("__of") == F.col("__sha"), "left").filter(F.col("__sha").isNull() | F.col("__keep").eqNullSafe(F.col("__me")))
    kept = won.filter(F.coalesce("__n_same", F.lit(1)) == 1).select(*names)
    if groups.filter("__n_same > 1").isEmpty():
        return kept
    tied = won.filter("__n_same > 1").dropDuplicates(["__of"]).select(*names)
    return kept.unionByName(tied)
