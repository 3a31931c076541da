"""Canonical writes: version hashes, insert-only merges, compaction, gaps and commits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NORMALIZATION_VERSION = 1


def version_hash(df: DataFrame) -> DataFrame:
    """version_hash: SHA-256 over the compact JSON of the other columns by name, nulls included, doubles
    rounded to ten places, dates and times as text. Doubles are in Spark's notation, so hashes of other
    engines differ in rows that hold one of 10^7 or more, or of less than 10^-3. normalization_version
    is added behind it."""
    cols = [_hashable(df, c) for c in sorted(df.columns) if c not in ("version_hash", "normalization_version")]
    df = df.withColumn("normalization_version", F.lit(NORMALIZATION_VERSION).cast("long"))
    return df.withColumn("version_hash", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))


def _hashable(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, T.DoubleType):
        return F.round(c, 10).alias(c)
    return F.col(c).cast("string").alias(c) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(c)


def insert_only(staged: DataFrame, existing: DataFrame | None, natural_keys: list[str], null_safe: bool = False) -> DataFrame:
    """The staged rows to append: those whose (natural keys, available_at, version_hash) isn't there yet,
    each once. Null keys never match, so such rows are always new, unless ``null_safe``: then a null key
    equals a null key."""
    keys = [*natural_keys, "available_at", "version_hash"]
    new = staged.dropDuplicates(keys)
    if existing is None:
        return new
    if not null_safe:
        return new.join(existing.select(*keys), keys, "left_anti")
    had = existing.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return new.join(had, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti")


def append(rows: DataFrame, path: str, commit_seq: int) -> None:
    """Append rows as one commit."""
    rows.withColumn("commit_seq", F.lit(commit_seq).cast("long")).write.mode("append").parquet(path)


def pinned(table: DataFrame, commit_seq: int) -> DataFrame:
    """The table as it was after a commit."""
    return table.filter(F.col("commit_seq") <= commit_seq)


def commits(table: DataFrame) -> DataFrame:
    return table.groupBy("commit_seq").agg(F.count("*").alias("n_rows"), F.min("available_at").alias("first_available_at"), F.max("available_at").alias("last_available_at"))


def compact(table: DataFrame, natural_keys: list[str], files: int | None = None) -> DataFrame:
    """One row per version, dealt by security and sorted, ready to be rewritten elsewhere."""
    once = table.dropDuplicates([*natural_keys, "available_at", "version_hash"])
    by = [c for c in ("security_id", "effective_date", "available_at") if c in table.columns]
    lead = by[:1] or natural_keys[:1]
    dealt = once.repartition(files, *lead) if files else once.repartition(*lead)
    return dealt.sortWithinPartitions(*by) if by else dealt


def reparse(facts: DataFrame, archive: DataFrame, normalize: Callable[[DataFrame], DataFrame], available_at: Column) -> DataFrame:
    """Normalize again, in one job, the archived bodies behind all facts. ``normalize`` takes the archive's
    rows with available_at set anew."""
    wanted = facts.select("content_hash").distinct()
    return normalize(archive.join(wanted, "content_hash", "left_semi").withColumn("available_at", available_at))


def backfill_missing(bulk: DataFrame, bars: DataFrame, as_of, years: int, key: str = "security_id") -> DataFrame:
    """Bulk rows of the last years on dates that a security doesn't have yet."""
    recent = bulk.filter(F.col("effective_date") >= F.add_months(F.lit(as_of).cast("date"), -12 * years))
    return recent.join(bars.select(key, "effective_date").distinct(), [key, "effective_date"], "left_anti")


def missing_dates(bars: DataFrame, start=None, end=None, ids: DataFrame | None = None, key: str = "security_id") -> DataFrame:
    """Calendar dates of [start, end] that a security has no row for; an open side is its own first or
    last date, and a security without rows then has no range."""
    spans = bars.groupBy(key).agg(F.min("effective_date").alias("lo"), F.max("effective_date").alias("hi"))
    if ids is not None:
        spans = ids.select(key).distinct().join(spans, key, "left")
    lo = F.lit(start).cast("date") if start is not None else F.col("lo")
    hi = F.lit(end).cast("date") if end is not None else F.col("hi")
    days = spans.filter(lo.isNotNull() & hi.isNotNull() & (lo <= hi)).select(key, F.explode(F.sequence(lo, hi)).alias("effective_date"))
    return days.join(bars.select(key, "effective_date").distinct(), [key, "effective_date"], "left_anti")


def missing_sessions(bars: DataFrame, sessions: DataFrame, key: str = "security_id") -> DataFrame:
    """Sessions between a security's first and last row that it has no row for. sessions: (session), a
    calendar, broadcast: a few hundred rows a year."""
    spans = bars.groupBy(key).agg(F.min("effective_date").alias("lo"), F.max("effective_date").alias("hi"))
    days = spans.join(F.broadcast(sessions.select(F.col("session").alias("effective_date")).distinct()), F.col("effective_date").between(F.col("lo"), F.col("hi"))).select(key, "effective_date")
    return days.join(bars.select(key, "effective_date").distinct(), [key, "effective_date"], "left_anti")


def covered(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Requests (security_id, source_id, start, end) with ``covered``: any row of that id and source in
    the range. Rows are reduced to one per id, source and date; dates and starts are then swept from the
    newest on, with the earliest date so far, so that many requests of one id cost a sort."""
    keys = ["__id", "__source"]
    have = table.select(F.col("security_id").alias("__id"), F.col("source_id").alias("__source"), F.col("effective_date").alias("__day")).dropna().distinct()
    asked = requests.select(F.col("security_id").alias("__id"), F.col("source_id").alias("__source"), F.col("start").cast("date").alias("__day"), F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("__request"))
    swept = have.withColumn("__date", F.col("__day")).withColumn("__request", F.lit(None).cast(asked.schema["__request"].dataType)).unionByName(asked.withColumn("__date", F.lit(None).cast(have.schema["__day"].dataType)))
    # a date on a request's start comes before it
    next_date = F.min("__date").over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("__day"), F.col("__request").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    told = swept.withColumn("__next", next_date).filter("__request IS NOT NULL")
    hit = F.coalesce(F.col("__day").isNotNull() & (F.col("__next") <= F.col("__request")["end"]), F.lit(False))
    return told.select("__request.*", hit.alias("covered"))


def first_chunk_wins(rows: DataFrame, keys: list[str], chunk: str = "chunk_start") -> DataFrame:
    """Across fetched chunks one row per key, of the first chunk; rows with a null key are all kept."""
    null = F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull().cast("int")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(chunk))
    whole = rows.filter(null == 0).withColumn("__n", n).filter("__n = 1").drop("__n")
    return whole.unionByName(rows.filter(null == 1))


def replay_hash(df: DataFrame) -> DataFrame:
    """One row (n_rows, digest) that does not depend on the rows' order: counts, sums and xors of row
    hashes, so that partial results are a few numbers."""
    cols = [_hashable(df, c) for c in sorted(df.columns)]
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(4)]
    got = df.select(*[p.alias(f"h{k}") for k, p in enumerate(parts)]).agg(F.count("*").alias("n_rows"), *[F.bit_xor(f"h{k}").alias(f"x{k}") for k in range(4)], *[F.sum((F.col(f"h{k}") % 2147483647)).alias(f"s{k}") for k in range(4)])
    return got.select("n_rows", F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256).alias("digest"))
