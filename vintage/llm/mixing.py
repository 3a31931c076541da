"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a fixed 60-bit hash of its id. Words are summed by source and leading hash bits; the
bucket in which a source's budget ends is found from the running sum of at most 4096 buckets and only
that bucket is split by the next 12 bits, down to one hash value. A document is taken when its hash lies
under its source's threshold: one small aggregation a level and a filter, no sort of documents.

Sources are ranked by code point, null last, and weigh 5, 2, 1, repeating. They share ``epochs`` times
all words; a target stops at ``most`` times its source's words and the excess is shared again by weight.
A target of r times a source's words takes every document floor(r) times and one more time those under
the threshold. The document at the threshold goes in when that brings the sum nearer to the budget.
Null or empty texts have size 0 and are taken with 0 words, as often as others of their source with
their hash. No row is taken more than ``most`` times. Rows with equal doc_id share a hash and go in
together. A source without words has target 0, and none of its rows is taken. Reruns give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, small

WEIGHTS = (5, 2, 1)
EPOCHS = 1.5
MOST = 2
BITS, LEVELS = 12, 5  # 60 bits


def size_of(text: Column) -> Column:
    """Number of words: runs of anything but x20 and x09-x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """The leading 60 bits of the id's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, epochs: float = EPOCHS, most: int = MOST) -> DataFrame:
    """(source, source_size) with targets added. One row per source: the windows without partitions
    below run over the list of sources, not over documents."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumns({"w": weight, "cap": F.col("source_size") * F.lit(float(most))})
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full_first = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, after = full_first.rowsBetween(Window.unboundedPreceding, -1), full_first.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(epochs) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    # the common level of water filling is the greatest of these
    filled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """sources plus reps (whole times), rest (words of the partial time) and bound, the hash under which
    documents go in once more. rows: source_key, size, h."""
    got = sources.withColumn("reps", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    got = settle(got.withColumns({"rest": F.col("target") - F.col("reps") * F.col("source_size"), "lo": F.lit(0).cast("long"), "under": F.lit(0).cast("long"), "mass": F.lit(0).cast("long")}).withColumn("open", F.col("rest") > 0), "mix-sources")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        edge = got.filter("open").select("source_key", "lo", "under", "rest")
        # only rows of the boundary bucket
        inside = rows.join(small(edge), "source_key").filter((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + (1 << (shift + BITS))))
        bucket = F.shiftright(F.col("h"), shift).alias("bucket")
        sums = inside.groupBy("source_key", "under", "rest", bucket).agg(F.sum("size").alias("mass"))
        upto = F.sum("mass").over(Window.partitionBy("source_key").orderBy("bucket"))
        cross = sums.withColumn("upto", F.col("under") + upto).filter(F.col("upto") > F.col("rest"))
        first = cross.groupBy("source_key").agg(F.min(F.struct("bucket", "upto", "mass")).alias("at"))
        first = first.select("source_key", (F.col("at.bucket") * (1 << shift)).alias("lo2"), (F.col("at.upto") - F.col("at.mass")).alias("under2"), F.col("at.mass").alias("mass2"))
        got = got.join(first, "source_key", "left")
        found = F.col("open") & F.col("lo2").isNotNull()
        # a source whose whole mass stays within its budget has no boundary: all of it goes in
        got = settle(got.select("source_key", "source_size", "target", "reps", "rest", F.when(found, F.col("lo2")).otherwise(F.when(F.col("open"), F.lit(1 << 60)).otherwise(F.col("lo"))).alias("lo"), F.when(found, F.col("under2")).otherwise(F.col("under")).alias("under"), F.when(found, F.col("mass2")).otherwise(F.col("mass")).alias("mass"), found.alias("open")), f"mix-level{level}")
    nearer = F.col("open") & (F.col("under") < F.col("rest")) & (F.col("under") + F.col("mass") - F.col("rest") < F.col("rest") - F.col("under"))
    return settle(got.select("source_key", "source_size", "target", "reps", (F.col("lo") + nearer.cast("long")).alias("bound")), "mix-bounds")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    # null gets a key that no source has
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("source_key"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col)).alias("h"), *more)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, epochs: float = EPOCHS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(rows, bounds): rows has doc_id, source_key, size and h of every document, bounds what each
    source takes."""
    rows = settle(_keyed(docs, id_col, text_col, source_col), "mix-rows")
    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size")).withColumn("source", F.when(F.col("source_key") != "n", F.expr("substring(source_key, 2)")))
    want = targets(sizes, weights, epochs, most).withColumn("source_key", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))
    return rows, thresholds(rows, want.select("source_key", "source_size", "target"))


def times() -> Column:
    return F.col("reps") + (F.col("h") < F.col("bound")).cast("long")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    rows, bounds = mix(docs, **how)
    return rows.join(small(bounds), "source_key").select("doc_id", "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, with all their columns."""
    _, bounds = mix(docs, id_col, text_col, source_col, **how)
    bounds = bounds.select(F.col("source_key").alias("__key"), F.col("reps").alias("__reps"), F.col("bound").alias("__bound"))
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    keyed = docs.withColumns({"__key": key, "__h": hash_of(F.col(id_col))})
    n = (F.col("__reps") + (F.col("__h") < F.col("__bound")).cast("long")).cast("int")
    return keyed.join(small(bounds), "__key").withColumn("__n", F.explode(F.array_repeat(F.lit(1), n))).select(*docs.columns)
