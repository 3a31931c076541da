"""Security identity: minted ids, symbol intervals, search, universe and the symbol registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mint_security_id(figi: Column, cik: Column, isin: Column, composite: Column) -> Column:
    """An id from the first identifier that isn't empty."""
    key = F.coalesce(*[F.nullif(c, F.lit("")) for c in (figi, cik, isin, composite)], F.lit(""))
    return F.concat(F.lit("sec_"), F.substring(F.sha2(F.concat(F.lit('{"source_key":"'), key, F.lit('"}')), 256), 1, 24))


def _at(date: Column, inclusive_end: bool = False) -> Column:
    end = F.col("effective_end")
    return (F.col("effective_start") <= date) & (end.isNull() | ((end >= date) if inclusive_end else (end > date)))


def resolve(requests: DataFrame, master: DataFrame, bars: DataFrame | None = None, knowledge_as_of: bool = False) -> DataFrame:
    """security_id of each (symbol, date[, as_of]) request: the mapping whose interval holds the date (its
    end excluded), the newest version on overlap; a symbol that is itself an id with bars is its own
    fallback. ``knowledge_as_of`` hides mappings not available at the request's as_of."""
    m = master.select(F.col("symbol").alias("__symbol"), F.col("security_id").alias("__id"), "effective_start", "effective_end", F.col("available_at").alias("__known"))
    on = (requests.symbol == m["__symbol"]) & _at(requests.date)
    if knowledge_as_of:
        on = on & (F.col("__known") <= requests.as_of)
    keys = requests.columns
    best = F.max(F.struct("__known", "effective_start", "__id")).alias("b")
    found = requests.join(m, on, "left").groupBy(*keys).agg(best).select(*keys, F.col("b.__id").alias("security_id"))
    if bars is None:
        return found
    own = bars.select(F.col("security_id").alias("__own")).distinct()
    return found.join(own, found.symbol == own["__own"], "left").select(*keys, F.coalesce("security_id", "__own").alias("security_id"))


def reverse_resolve(requests: DataFrame, master: DataFrame) -> DataFrame:
    """(symbol, name) of each (security_id, date): the mapping with the latest start up to the date."""
    m = master.select(F.col("security_id").alias("__id"), F.struct("effective_start", "available_at", "symbol", "name").alias("m"))
    joined = requests.join(m, (requests.security_id == m["__id"]) & (F.col("m.effective_start") <= requests.date), "left")
    return joined.groupBy("security_id", "date").agg(F.max("m").alias("m")).select("security_id", "date", "m.symbol", "m.name")


def search(master: DataFrame, text: str, date, limit: int = 20) -> DataFrame:
    """Symbols that start with the text, then those whose symbol or name holds it; the interval's end
    counts as inside."""
    at, q = F.lit(date).cast("date"), F.lit(text.upper())
    symbol, name = F.upper("symbol"), F.upper(F.coalesce("name", F.lit("")))
    rank = F.when(symbol.startswith(q), 0).when(symbol.contains(q) | name.contains(q), 1)
    hits = master.filter(_at(at, True)).withColumn("rank", rank).filter("rank IS NOT NULL")
    return hits.groupBy("symbol", "security_id").agg(F.min("rank").alias("rank"), F.max("name").alias("name")).orderBy("rank", "symbol", "security_id").limit(limit)


def universe(master: DataFrame, date) -> DataFrame:
    return master.filter(_at(F.lit(date).cast("date"), True)).select("symbol", "security_id", "name").distinct()


def with_cik(tickers: DataFrame, companies: DataFrame) -> DataFrame:
    """cik, padded to ten digits, of each ticker in any case. companies: (ticker, cik)."""
    c = companies.select(F.upper("ticker").alias("__ticker"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik")).dropDuplicates(["__ticker"])
    return tickers.join(c, F.upper(tickers.ticker) == c["__ticker"], "left").drop("__ticker")


def registry(events: DataFrame) -> DataFrame:
    """Symbols active now. events: versions (symbol, at, removed_at); a later version restores a symbol."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("at"), F.desc_nulls_last("removed_at")))
    return events.withColumn("__n", newest).filter("__n = 1 AND removed_at IS NULL").select("symbol", "at")
