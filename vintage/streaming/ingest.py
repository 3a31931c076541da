"""Structured Streaming: incremental ingest, bounded dedupe and daily bars from an event stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.versions import append, insert_only, version_hash
from ..sources.archive import content_hash


def ingest(payloads: DataFrame, normalize: Callable[[DataFrame], DataFrame], table_path: str, natural_keys: list[str], checkpoint: str) -> StreamingQuery:
    """Normalize each micro-batch of a payload stream and append the versions that the table lacks. A batch
    that is run again after a failure adds nothing, since the merge knows its rows. Only the part of the
    table with the batch's knowledge times is read: a version's available_at is one of its keys."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = version_hash(normalize(batch)).persist()  # read twice: for its times, and to be appended
        try:
            existing = spark.read.parquet(table_path)
        except AnalysisException as e:  # the first batch creates the table
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            existing = None
        try:
            if existing is not None:
                lo, hi = staged.agg(F.min("available_at"), F.max("available_at")).first()
                existing = existing.filter(F.col("available_at").between(F.lit(lo), F.lit(hi))) if lo is not None else existing
            append(insert_only(staged, existing, natural_keys, null_safe=True), table_path, batch_id)
        finally:
            staged.unpersist()

    return payloads.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def payload_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON payload files as they arrive; body and lineage columns by ``schema``."""
    return spark.readStream.schema(schema).json(path)


def deduplicated(payloads: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Each content once within a horizon of available_at; the state is bounded by it."""
    return payloads.withColumn("content_hash", content_hash(F.col("body"))).withWatermark("available_at", horizon).dropDuplicatesWithinWatermark(["content_hash"])


def daily_bars(ticks: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Open, high, low, close and volume of each id and day from (security_id, ts, tick_id, price, size); the
    same plan over a batch gives the same rows. In a stream a day is told once the watermark has passed it;
    ticks later than that make new versions by ``late_versions``."""
    marked = ticks.withWatermark("ts", lateness) if ticks.isStreaming else ticks
    order = F.struct("ts", "tick_id")
    g = marked.groupBy("security_id", F.window("ts", "1 day").alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").cast("long").alias("volume"))
    return g.select("security_id", F.to_date("w.start").alias("effective_date"), "open", "high", "low", "close", "volume")


def late_versions(ticks: DataFrame, told: DataFrame, available_at) -> DataFrame:
    """New versions of the told bars whose day has got ticks since: the day's bar from all its ticks,
    available at a later time, where it differs from every version told. One batch over the days at hand."""
    days = told.select(F.col("security_id").alias("__id"), F.col("effective_date").alias("__day")).distinct()
    now = daily_bars(ticks.join(days, (F.col("security_id") == F.col("__id")) & (F.to_date("ts") == F.col("__day")), "left_semi"))
    keys, values = ["security_id", "effective_date"], ["open", "high", "low", "close", "volume"]
    had = told.select(*[F.col(c).alias(f"__{c}") for c in keys + values])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys + values])
    return now.join(had, on, "left_anti").withColumn("available_at", F.lit(available_at).cast("timestamp"))


_BAR = ("open", "high", "low", "close", "volume")
_TICK_BAR = "open double, high double, low double, close double, volume long"


class _Day:
    """One day's bar while its ticks come in: the bar, the places of its first and last tick, and how many
    versions of it have been told."""

    def __init__(self, state: tuple | None):
        self.first, self.last, self.bar, self.version = (tuple(state[0:2]), tuple(state[2:4]), tuple(state[4:9]), state[9]) if state else (None, None, None, 0)

    def state(self) -> tuple:
        return (*self.first, *self.last, *self.bar, self.version)

    def add(self, ticks: list[tuple]) -> bool:
        """Take in ticks (at, tick_id, price, size), sorted; whether the bar changes."""
        first, last, prices = ticks[0][:2], ticks[-1][:2], [t[2] for t in ticks]
        was = self.bar
        open_, high, low, close, volume = was or (None, float("-inf"), float("inf"), None, 0)
        if self.first is None or first < self.first:
            self.first, open_ = first, prices[0]
        if self.last is None or last > self.last:
            self.last, close = last, prices[-1]
        self.bar = (open_, max(high, *prices), min(low, *prices), close, volume + sum(t[3] for t in ticks))
        return self.bar != was

    def told(self, available: int) -> tuple:
        self.version += 1
        return (available, self.version, *self.bar)


def bar_versions(ticks: DataFrame, lateness: str = "2 days", disorder: str = "0 seconds", keep: str = "400 days") -> DataFrame:
    """Daily bars and their later versions, from a stream alone: (security_id, effective_date, available_at,
    version, open, high, low, close, volume) of ticks (security_id, ts, tick_id, price, size, available_at).

    The stream's watermark is that of ``available_at``, when a tick got known, and not of ``ts``, so that no
    late tick is dropped. A day's version 1 holds what was known ``lateness`` after its end and is available
    then; a timer tells it when the watermark has passed. Each later time at which ticks of that day get known
    makes a version, available at that time, if they change the bar; so does the first time, where none was
    known before. Times count in microseconds, and what is known at one time counts as one. Which rows come
    in which batch changes nothing, as long as times come in order within ``disorder``.

    The state is a bar for each id and day, the days of an id together, since a call for each of them costs more
    than its ticks. A day is let go ``keep`` after its end; ticks that get known later than that are left out.
    Ticks without id, ts, tick_id, price or available_at are left out, a size that is null counts 0."""
    end = F.date_add(F.col("effective_date"), 1).cast("timestamp")
    known = ticks.dropna(subset=["security_id", "ts", "tick_id", "price", "available_at"]).withColumn("effective_date", F.to_date("ts"))
    known = known.withColumns({"deadline": F.unix_micros(end + F.expr(f"INTERVAL '{lateness}'")), "expiry": F.unix_micros(end + F.expr(f"INTERVAL '{keep}'"))})
    known = known.withWatermark("available_at", disorder)
    rows = known.select("security_id", F.unix_date("effective_date").alias("day"), "deadline", "expiry", F.unix_micros("available_at").alias("known"), F.unix_micros("ts").alias("at"), F.col("tick_id").cast("long").alias("tick_id"), F.col("price").cast("double").alias("price"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), "available_at")
    columns = ["day", "deadline", "expiry", "known", "at", "tick_id", "price", "size"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, watermark = [], state.getCurrentWatermarkMs()
        days = {day: (deadline, expiry, _Day(tuple(had))) for day, deadline, expiry, had in json.loads(state.get[0])} if state.exists else {}
        if not state.hasTimedOut:
            new = sorted(row for some in batches for row in zip(*[some[c].tolist() for c in columns], strict=True) if row[3] <= row[2])
            for (date, deadline, expiry, known_at), ticks in groupby(new, key=itemgetter(0, 1, 2, 3)):
                day = days.setdefault(date, (deadline, expiry, _Day(None)))[2]
                if known_at > deadline and day.bar and not day.version:
                    out.append((date, *day.told(deadline)))
                if day.add([t[4:] for t in ticks]) and known_at > deadline:
                    out.append((date, *day.told(known_at)))
        for date, (deadline, expiry, day) in list(days.items()):
            if not day.version and deadline // 1000 + 1 < watermark:
                out.append((date, *day.told(deadline)))
            if day.version and expiry // 1000 + 1 < watermark:
                del days[date]
        if days:
            state.update((json.dumps([(date, deadline, expiry, day.state()) for date, (deadline, expiry, day) in days.items()]),))
            state.setTimeoutTimestamp(max(min(expiry if day.version else deadline for deadline, expiry, day in days.values()) // 1000 + 1, watermark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([(*key, *row) for row in out], columns=["security_id", "day", "known", "version", *_BAR])

    told = rows.groupBy("security_id").applyInPandasWithState(update, f"security_id string, day int, known long, version int, {_TICK_BAR}", "days string", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("security_id", F.date_from_unix_date("day").alias("effective_date"), F.timestamp_micros("known").alias("available_at"), "version", *_BAR)
