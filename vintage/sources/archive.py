"""Content-addressed archive of raw payloads, fetch manifests, and bulk bar files."""

from __future__ import annotations

import uuid
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import replay_hash


def content_hash(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def new_payloads(payloads: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """Payloads (body and any other columns) whose content isn't archived yet, each content once, with
    content_hash and the folder prefix of the archive. What is archived leaves first, so only new bodies
    are shuffled to find repeats among them. Of the archive only hashes are read, and those only in the
    folders that the payloads would go to: a small batch reads few of them."""
    hashed = payloads.withColumn("content_hash", content_hash(F.col("body"))).withColumn("prefix", F.substring("content_hash", 1, 2))
    if archive is None:
        return hashed.dropDuplicates(["content_hash"])
    folders = [r.prefix for r in hashed.select("prefix").distinct().collect()]  # 256 at most
    known = archive.filter(F.col("prefix").isin(folders)).select("prefix", "content_hash")
    return hashed.join(known, ["prefix", "content_hash"], "left_anti").dropDuplicates(["content_hash"])


def write_archive(payloads: DataFrame, path: str) -> None:
    payloads.repartition("prefix").write.mode("append").option("compression", "zstd").partitionBy("prefix").parquet(path)


def read_raw(archive: DataFrame, wanted: DataFrame) -> DataFrame:
    """Archived rows by content hash; the prefix prunes folders."""
    w = wanted.select("content_hash").distinct().withColumn("prefix", F.substring("content_hash", 1, 2))
    return archive.join(w, ["prefix", "content_hash"], "left_semi")


def manifest(fetches: DataFrame) -> DataFrame:
    """fetches: source_id, endpoint, params (map), status, body, fetched_at. Adds what identifies the
    request and its answer."""
    request = F.sha2(F.to_json(F.struct("source_id", "endpoint", F.array_sort(F.map_entries("params")).alias("params"))), 256)
    return fetches.select("source_id", "endpoint", "fetched_at", request.alias("request_hash"), "status", F.octet_length("body").cast("long").alias("byte_size"), content_hash(F.col("body")).alias("content_hash"), F.lit(1).cast("long").alias("parser_version"))


def read_bulk_bars(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("stocks", "etfs")) -> DataFrame:
    """Daily bars from a tree of text files <geo>/<exchange> <kind>/.../<symbol>.us.txt with the columns
    <DATE>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>; what a row is about comes from its file's path. Rows that
    don't parse, and other kinds, are left out."""
    schema = "`<DATE>` string, `<OPEN>` double, `<HIGH>` double, `<LOW>` double, `<CLOSE>` double, `<VOL>` double"
    raw = spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.us.txt").option("recursiveFileLookup", True).csv(path)
    # every row carries its file's path, so what is taken from it is short: a search that begins anew at each
    # character of the path cost more than reading the row
    file = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    at = raw.select("*", file.alias("file")).select("*", F.regexp_extract("file", r"^.*/([^/]+(?:stocks|etfs|indices|bonds|currencies|funds)[^/]*)/", 1).alias("folder"))
    rows = at.select(
        F.upper(F.regexp_replace(F.substring_index("file", "/", -1), r"\.us\.txt$", "")).alias("symbol"),
        F.substring_index("folder", " ", 1).alias("exchange"),
        F.substring_index("folder", " ", -1).alias("kind"),
        F.lit("us").alias("geo"),
        F.try_to_date("`<DATE>`", "yyyyMMdd").alias("effective_date"),
        *[F.col(f"`<{c.upper()}>`").alias(c) for c in ("open", "high", "low", "close")],
        F.col("`<VOL>`").cast("long").alias("volume"),
    )
    return rows.filter(F.col("kind").isin(*kinds) & F.col("effective_date").isNotNull() & F.col("close").isNotNull())


def write_bulk_text(bars: DataFrame, path: str, geo: str = "us") -> None:
    """The tree of text files that ``read_bulk_bars`` reads: <geo>/<exchange> <kind>/<symbol>.us.txt. bars: symbol,
    exchange, kind, effective_date, prices and volume; bars without a symbol have no file. Tasks write one file a
    symbol, row batch by row batch, and rename it when it is whole, so a task that runs again does no harm and the
    driver touches none of them. path: one that pyarrow can open (local, hdfs, s3, gs, abfs)."""
    fields = [F.date_format("effective_date", "yyyyMMdd"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")]]
    lines = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in fields])
    rows = bars.filter("symbol IS NOT NULL").select(F.concat_ws(" ", "exchange", "kind").alias("folder"), F.lower("symbol").alias("file"), lines.alias("line"))
    dealt = rows.repartition("folder", "file").sortWithinPartitions("folder", "file", "line")
    top = f"{path.rstrip('/')}/{geo}"

    def write(batches):
        fs, root = pa_fs.FileSystem.from_uri(top)
        at, out, part, made = None, None, f".{uuid.uuid4().hex}", set()

        def close():
            if out:
                out.close()
                target = f"{root}/{at[0]}/{at[1]}.us.txt"
                if fs.get_file_info(target).type != pa_fs.FileType.NotFound:  # not every store renames over a file
                    fs.delete_file(target)
                fs.move(f"{root}/{at[0]}/{part}", target)

        for batch in batches:
            folders, files, text = (batch.column(c).to_pylist() for c in ("folder", "file", "line"))
            for key, run in groupby(range(len(text)), lambda i: (folders[i], files[i])):
                if key != at:
                    close()
                    if key[0] not in made:
                        fs.create_dir(f"{root}/{key[0]}", recursive=True)
                        made.add(key[0])
                    at, out = key, fs.open_output_stream(f"{root}/{key[0]}/{part}")
                    out.write(b"<DATE>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>\n")
                out.write(("\n".join([text[i] for i in run]) + "\n").encode())
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())})

    dealt.mapInArrow(write, "n long").count()


def write_bulk_bars(bars: DataFrame, path: str) -> None:
    """Sorted by symbol and date, one folder a kind."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "effective_date").write.mode("overwrite").partitionBy("kind").parquet(path)


def synthetic_bars(symbols: DataFrame, end, days: int = 252) -> DataFrame:
    """Deterministic bars for the days up to ``end`` of each security_id, from the MD5 of id and day: a
    price of 50 to 250 that moves by at most 2 % a day around a slow wave."""
    i = F.col("i")
    drawn = lambda *what: F.conv(F.substring(F.md5(F.concat_ws(":", *what).cast("binary")), 1, 7), 16, 10).cast("long")
    unit = lambda k: drawn("security_id", i, F.lit(k)) % 10_000 / 10_000.0
    base = 50 + drawn("security_id") % 200
    # a list of symbols is one small file, so its rows are dealt before each makes many
    dealt = symbols.repartition(symbols.sparkSession.sparkContext.defaultParallelism * 4, "security_id")
    rows = dealt.select("security_id", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("i"))
    rows = rows.withColumn("effective_date", F.date_sub(F.lit(end).cast("date"), F.lit(days - 1) - i))
    close = base * (1 + 0.1 * F.sin(i / 20.0)) * (1 + 0.02 * (unit(0) - 0.5))
    rows = rows.withColumn("close", F.round(close, 4)).withColumn("open", F.round(F.col("close") * (1 + 0.01 * (unit(1) - 0.5)), 4))
    return rows.select("security_id", "effective_date", "open", F.round(F.greatest("open", "close") * (1 + 0.01 * unit(2)), 4).alias("high"), F.round(F.least("open", "close") * (1 - 0.01 * unit(3)), 4).alias("low"), "close", (1_000_000 + drawn("security_id", i, F.lit(4)) % 1_000_000).alias("volume"))


def freeze_output(df: DataFrame, path: str) -> DataFrame:
    """Write a golden copy and return its (n_rows, digest)."""
    df.write.mode("overwrite").parquet(path)
    return replay_hash(df.sparkSession.read.parquet(path))
