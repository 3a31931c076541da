"""Point-in-time reads: what was knowable at ``as_of``.

Facts are append-only versions with a valid time (``effective_date``) and a knowledge time
(``available_at``). No read returns a version with ``available_at > as_of``, and every read but
``bars_latest`` needs an ``as_of``. Of several versions of one key the source with the lowest priority
number wins, then the newest version; ties end with ``source_id`` and ``version_hash`` where present.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNKNOWN_PRIORITY = 999
#: Ids up to which a membership test is an expression; longer lists become a broadcast semi join.
INLINE_IDS = 200


def _instant(as_of) -> Column:
    if as_of is None:
        raise ValueError("as_of is required")
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def source_priorities(spark: SparkSession, precedence: dict[str, list[str]]) -> DataFrame:
    """(dataset, source_id, priority) from ordered lists of sources."""
    rows = [(d, s, i) for d, sources in precedence.items() for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "dataset string, source_id string, priority int")


def preferred_source(priorities: DataFrame, enabled: DataFrame) -> DataFrame:
    """The first enabled source of each dataset, or any enabled one (the first by name) that no list
    names. enabled: (dataset, source_id)."""
    ranked = enabled.join(F.broadcast(priorities), ["dataset", "source_id"], "left")
    best = F.min(F.struct(F.coalesce("priority", F.lit(UNKNOWN_PRIORITY)).alias("priority"), "source_id"))
    return ranked.groupBy("dataset").agg(best.alias("b")).select("dataset", F.col("b.source_id").alias("source_id"))


def among(df: DataFrame, id_col: str, ids: Iterable[str] | DataFrame | None) -> DataFrame:
    """Rows whose id is in a list or a table of ids; None is no restriction."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    ids = list(ids)
    if len(ids) <= INLINE_IDS:
        return df.filter(F.col(id_col).isin(ids))
    table = df.sparkSession.createDataFrame([(i,) for i in ids], f"{id_col} string")
    return df.join(F.broadcast(table), id_col, "left_semi")


def in_range(df: DataFrame, start=None, end=None, col: str = "effective_date") -> DataFrame:
    """Inclusive valid-time range; None is open."""
    if start is not None:
        df = df.filter(F.col(col) >= F.lit(start).cast("date"))
    return df if end is None else df.filter(F.col(col) <= F.lit(end).cast("date"))


def in_ranges(df: DataFrame, requests: DataFrame, id_col: str = "security_id", col: str = "effective_date") -> DataFrame:
    """Rows in the range (id, start, end; null is open) of any request of their id, each once. Rows and starts
    of an id are swept in order with the latest end so far, so that many requests of one id cost a sort and
    not their product with its rows."""
    kind = df.schema[col].dataType
    start = F.coalesce(F.col("start").cast("date"), F.lit("0001-01-01").cast("date")).cast(kind)
    end = F.coalesce(F.col("end").cast("date"), F.lit("9999-12-31").cast("date")).cast(kind)
    payload = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    r = requests.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), start.alias("__day"), end.alias("__until")).filter("__day <= __until")
    rows = df.join(r.select("__id").distinct(), F.col(id_col) == F.col("__id"), "left_semi").select(F.col(id_col).alias("__id"), F.col(col).alias("__day"), payload.alias("__row"))
    swept = rows.withColumn("__until", F.lit(None).cast(kind)).unionByName(r.withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType)))
    # a range that starts on a row's day comes before it
    so_far = Window.partitionBy("__id").orderBy("__day", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return swept.withColumn("__until", F.max("__until").over(so_far)).filter("__row IS NOT NULL AND __day <= __until").select("__row.*")


def known(df: DataFrame, as_of) -> DataFrame:
    """Versions available at ``as_of``, inclusive."""
    return df.filter(F.col("available_at") <= _instant(as_of))


def _with_priority(df: DataFrame, priorities: DataFrame | None, dataset: str | None) -> DataFrame:
    if priorities is None:
        return df.withColumn("__priority", F.lit(UNKNOWN_PRIORITY))
    p = priorities.filter(F.col("dataset") == dataset) if dataset else priorities
    p = p.select(F.col("source_id").alias("__source"), F.col("priority").alias("__p"))
    joined = df.join(F.broadcast(p), df.source_id == F.col("__source"), "left")
    return joined.withColumn("__priority", F.coalesce("__p", F.lit(UNKNOWN_PRIORITY))).drop("__p", "__source")


def _ties(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("source_id", "version_hash") if c in df.columns]


def pit_read(table: DataFrame, as_of, keys: tuple[str, ...] = ("security_id", "effective_date"), ids=None, start=None, end=None, priorities: DataFrame | None = None, dataset: str | None = None, valid_by: str | None = None, exclude_quarantined: bool = False, order_first: tuple[Column, ...] = ()) -> DataFrame:
    """The winning version of each key. ``keys[0]`` is the id column. ``valid_by``: a date column that may
    not lie after ``as_of``'s date; without it known future events are returned too. All filters are
    below the window, so the scan gets them."""
    df = in_range(among(known(table, as_of), keys[0], ids), start, end) if "effective_date" in table.columns else among(known(table, as_of), keys[0], ids)
    if valid_by:
        df = df.filter(F.col(valid_by) <= _instant(as_of).cast("date"))
    if exclude_quarantined:
        df = df.filter(F.col("quality_status") != "quarantined")
    df = _with_priority(df, priorities, dataset)
    order = [*order_first, F.col("__priority"), F.desc("available_at"), *_ties(table)]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n", "__priority")


def bars_asof(bars: DataFrame, as_of, priorities: DataFrame | None = None, ids=None, start=None, end=None, **how) -> DataFrame:
    """One bar for each security and date."""
    return pit_read(bars, as_of, ids=ids, start=start, end=end, priorities=priorities, dataset="bars_daily", valid_by="effective_date", **how)


def bars_latest(bars: DataFrame, now, **how) -> DataFrame:
    """As ``bars_asof`` at the present; not safe for research, as it changes from day to day."""
    return bars_asof(bars, now, **how)


def macro_series_asof(series: DataFrame, as_of, **how) -> DataFrame:
    """The newest vintage of each observation."""
    return pit_read(series, as_of, keys=("series_id", "effective_date"), **how)


def fundamental_metrics_asof(metrics: DataFrame, as_of, priorities: DataFrame | None = None, ids=None, categories=None, metric_ids=None) -> DataFrame:
    """The newest period of each security and metric."""
    df = metrics
    if categories is not None:
        df = df.filter(F.col("category").isin(list(categories)))
    if metric_ids is not None:
        df = df.filter(F.col("metric_id").isin(list(metric_ids)))
    return pit_read(df, as_of, keys=("security_id", "metric_id"), ids=ids, priorities=priorities, dataset="fundamental_metrics", valid_by="period_end", order_first=(F.desc("period_end"),))


def read_panel(bars: DataFrame, spine: DataFrame, as_of, priorities: DataFrame | None = None) -> DataFrame:
    """For each (security_id, effective_date) of the spine the newest bar up to that date, as an inner
    as-of join: one union, one shuffle on the security, one running ``last``. The bar's own date is
    ``bar_date``."""
    best = bars_asof(bars, as_of, priorities)
    payload = [c for c in best.columns if c not in ("security_id", "effective_date")]
    facts = best.select("security_id", "effective_date", F.struct(F.col("effective_date").alias("bar_date"), *payload).alias("bar"), F.lit(0).alias("asked"))
    asked = spine.select("security_id", F.col("effective_date").cast("date").alias("effective_date")).distinct().select("*", F.lit(None).cast(facts.schema["bar"].dataType).alias("bar"), F.lit(1).alias("asked"))
    w = Window.partitionBy("security_id").orderBy("effective_date", "asked").rowsBetween(Window.unboundedPreceding, 0)
    rows = facts.unionByName(asked).withColumn("bar", F.last("bar", ignorenulls=True).over(w))
    return rows.filter((F.col("asked") == 1) & F.col("bar").isNotNull()).select("security_id", "effective_date", "bar.*")


def _dominated(asked: DataFrame, late: DataFrame) -> DataFrame:
    """For each (security_id, effective_date, as_of) the best b of the bars (security_id, __date, __known, b)
    of no later date and no later known time, if there is one.

    Times of a security are numbered. The times up to one are a disjoint union of dyadic ranges, one for each
    bit of its number, and a bar belongs to one range of every size; in each range a running best by date
    answers. So n rows cost n log n however many bars came late, and no two of them are paired."""
    none = F.lit(None).cast(late.schema["b"].dataType)
    rows = late.select("security_id", F.col("__date").alias("day"), F.col("__known").alias("at"), "b", F.lit(None).cast("date").alias("effective_date"), F.lit(None).cast("timestamp").alias("as_of"), F.lit(0).alias("asks"))
    rows = rows.unionByName(asked.join(late.select("security_id").distinct(), "security_id", "left_semi").select("security_id", F.col("effective_date").alias("day"), F.col("as_of").alias("at"), none.alias("b"), "effective_date", "as_of", F.lit(1).alias("asks")))
    rows = rows.filter("day IS NOT NULL AND at IS NOT NULL")
    own = Window.partitionBy("security_id")
    rows = rows.withColumn("number", F.dense_rank().over(own.orderBy("at")).cast("long") - 1).withColumn("most", F.max("number").over(own))
    size = F.explode(F.expr("filter(sequence(0, cast(ceil(log2(most + 2)) as int)), l -> asks = 0 OR shiftright(number + 1, l) & 1 = 1)")).alias("size")
    spread = rows.select("*", size).withColumn("range", F.expr("CASE WHEN asks = 0 THEN shiftright(number, size) ELSE shiftright(number + 1, size) - 1 END"))
    so_far = Window.partitionBy("security_id", "size", "range").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0)
    best = spread.withColumn("b", F.max("b").over(so_far)).filter("asks = 1 AND b IS NOT NULL")
    return best.select("security_id", "effective_date", "as_of", "b")


def read_asof_join(bars: DataFrame, spine: DataFrame, priorities: DataFrame | None = None, lag_days: int = 30) -> DataFrame:
    """Each spine row has its own ``as_of``: of all bars up to its date that were known then, the one of
    the best source, then the newest version, then the newest date. Spine rows without one are kept.

    Spine rows and bars of a security aren't paired. Of bars that were known within ``lag_days`` of their
    date, all those up to ``as_of`` less the lag (or the spine's date, if earlier) were known: a running
    best answers for them. Those after that meet the spine in buckets of ``lag_days``. Bars that came later
    than the lag, restatements of old dates, are swept by ``_dominated``. The lag steers the work and not the
    result. All columns of bars travel with them through every step, so a caller selects what it needs."""
    keys = ["security_id", "effective_date", "as_of"]
    asked = spine.select("security_id", F.col("effective_date").cast("date").alias("effective_date"), F.col("as_of").cast("timestamp").alias("as_of")).distinct()
    b = _with_priority(bars, priorities, "bars_daily")
    # columns that rank a bar are part of it and are carried once
    ranks = ["available_at", "bar_date", *[c for c in ("source_id", "version_hash") if c in bars.columns]]
    payload = [c for c in bars.columns if c not in ("security_id", "effective_date", *ranks)]
    shown = ["bar_date", *[c for c in bars.columns if c not in ("security_id", "effective_date")]]
    carried = F.struct((-F.col("__priority")).alias("__rank"), *[F.col("effective_date").alias(c) if c == "bar_date" else F.col(c) for c in ranks], *payload)
    b = b.select("security_id", F.col("effective_date").alias("__date"), F.col("available_at").alias("__known"), carried.alias("b"))
    in_time = F.col("__known") <= F.date_add("__date", lag_days).cast("timestamp")
    prompt, late = b.filter(in_time), b.filter(~in_time)
    fits = (F.col("__date") <= F.col("effective_date")) & (F.col("__known") <= F.col("as_of"))
    given = F.col("effective_date").isNotNull() & F.col("as_of").isNotNull()  # else no bar
    asked = asked.withColumn("__cut", F.when(given, F.least("effective_date", F.date_sub(F.to_date("as_of"), lag_days))))
    none = F.lit(None).cast(b.schema["b"].dataType)
    rows = prompt.select("security_id", F.col("__date").alias("__day"), "b", F.lit(None).cast("date").alias("effective_date"), F.lit(None).cast("timestamp").alias("as_of"), F.lit(0).alias("__asks")).unionByName(asked.select("security_id", F.col("__cut").alias("__day"), none.alias("b"), "effective_date", "as_of", F.lit(1).alias("__asks")))
    # a bar of the cut's own day counts and comes first
    so_far = F.max("b").over(Window.partitionBy("security_id").orderBy("__day", "__asks").rowsBetween(Window.unboundedPreceding, 0))
    old = rows.withColumn("b", F.when(F.col("__day").isNotNull(), so_far)).filter("__asks = 1").select(*keys, "b")
    bucket = lambda c: F.floor(F.unix_date(c) / lag_days)
    near = asked.filter("effective_date > __cut").withColumn("__bucket", F.explode(F.sequence(bucket(F.date_add("__cut", 1)), bucket("effective_date"))))
    recent = near.join(prompt.withColumn("__bucket", bucket("__date")), ["security_id", "__bucket"]).filter(fits & (F.col("__date") > F.col("__cut"))).select(*keys, "b")
    restated = _dominated(asked.select(*keys), late)
    return old.unionByName(recent).unionByName(restated).groupBy(*keys).agg(F.max("b").alias("b")).select(*keys, *[F.col("b")[c].alias(c) for c in shown])


def read_spine_join(table: DataFrame, spine: DataFrame, id_col: str = "security_id") -> DataFrame:
    """All versions known at each spine row's ``as_of`` for its id and date; unmatched rows are kept."""
    asked = spine.select(F.col(id_col), F.col("effective_date").cast("date").alias("effective_date"), F.col("as_of").cast("timestamp").alias("as_of"))
    payload = [c for c in table.columns if c not in (id_col, "effective_date")]
    t = table.select(F.col(id_col).alias("__id"), F.col("effective_date").alias("__date"), *payload)
    return asked.join(t, (asked[id_col] == t["__id"]) & (asked.effective_date == t["__date"]) & (t.available_at <= asked.as_of), "left").drop("__id", "__date")


def project(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The fields that exist; all columns when none does."""
    found = [c for c in fields or () if c in df.columns]
    return df.select(*found) if found else df


#: Columns that tell where a row comes from.
AUDIT_COLUMNS = ("source_fetch_id", "raw_payload_hash", "ingestion_run_id", "content_hash", "version_hash", "schema_version", "parser_version", "normalization_version")


def without_audit(df: DataFrame, provenance: bool = False) -> DataFrame:
    return df if provenance else df.drop(*AUDIT_COLUMNS)
