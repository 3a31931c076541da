"""Things every operator of this subpackage needs: lineage cuts, size-checked broadcasts and
vectorised access to the bytes of an Arrow text column."""

from __future__ import annotations

import ctypes
import string
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a settled table of small rows (ids, hashes, counts) may be broadcast: at about 150
#: bytes a row in memory that is under 60 MB. Above it the same join runs as a shuffle join.
BROADCAST_ROWS = 400_000
#: Bytes of text and binary values that such a table may hold besides.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` or the context's checkpoint folder.
    With neither set there is none to guess: a folder of one machine would lose files on a cluster."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = known.get()
    return got


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. Cuts the lineage: a lost executor
    costs the reread of a file, not the work that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint on a settled table of short rows, if its row count (from the Parquet footers)
    is at most ``rows`` and its text and binary values hold ``BROADCAST_BYTES`` at most; else the table as
    it is, for a shuffle join that adaptive execution may split."""
    return F.broadcast(df) if fits(df, rows) else df


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a settled table is small enough to be broadcast."""
    if df.count() > rows:
        return False
    wide = [F.sum(F.octet_length(name)) for name, kind in df.dtypes if kind in ("string", "binary")]
    return not wide or sum(x or 0 for x in df.agg(*wide).first()) <= BROADCAST_BYTES


def dropped(*settled: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more, such as an earlier round's."""
    for df in settled:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def halves(*columns: Column) -> Column:
    """128 bits, as binary, that are equal for equal values: two hashes of 64 bits with different seeds."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(k), *columns)), 16, "0")) for k in (1, 2)])


def meetings(rows: DataFrame, key: str, group: Column, blocks: Column) -> DataFrame:
    """``rows`` once for each block of their binary group that their own block meets, its own too:
    meeting (binary, one for each two blocks) and block. Blocks are dealt by a hash of ``key``."""
    own = F.pmod(F.xxhash64(key), blocks)
    told = rows.withColumn("block", own).withColumn("__with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    place = [F.unhex(F.lpad(F.hex(f("block", "__with")), 8, "0")) for f in (F.least, F.greatest)]
    return told.withColumn("meeting", F.concat(group, *place)).drop("__with")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; null is empty. ``lower`` does it for texts of ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n+1 offsets of its values; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and bufs[2] and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of a batch with about ``most`` bytes of text each (one row at least), so that temporary
    arrays stay bounded; a longer row makes a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield batch.slice(lo, hi - lo)
        lo = hi
    released()


def released() -> None:
    """Give memory that a task no longer uses back to the system. Workers go on to other stages, idle ones
    stay as long as there is work, and C libraries keep what was freed: some 170 MB a worker after counting
    chunks. Where the C library has no ``malloc_trim`` only Arrow's pool is emptied."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64) over an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_u64(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values, the same on every machine."""
    return mix64((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = random_u64(11, 256)
LONG = 200
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words (runs of bytes outside ``space``, by default x20 and
    x09-x0D) of the concatenated values; a word never crosses a value's end."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    word = ~space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    first[cut] |= word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = offsets[1:-1]
    before = before[(before > 0) & (before <= n)] - 1
    last[before] |= word[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, range_hashes(data, starts, ends)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges. Short ones: a polynomial over random byte values modulo 2^64,
    from one running sum, so that all cost the same; length and finalizer go in last. Such polynomials
    are equal for some pairs of long texts of a regular build, so ranges of ``LONG`` bytes or more,
    which are few, get a hash of their bytes."""
    n, size = len(data), ends - starts
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_P_INV, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_P, n + 1)[starts]
    h = mix64(h + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    long = np.flatnonzero(size >= LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def group_cuts(batch: pa.RecordBatch, keys: int = 1) -> np.ndarray:
    """Rows of a batch at which one of its first columns, ``keys`` of them, differs from the row before."""
    n = batch.num_rows
    other = [pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False) for key in batch.columns[:keys]]
    return np.flatnonzero(np.logical_or.reduce(other)) + 1


def whole_groups(batches, keys: int = 1):
    """From batches sorted by their first columns, ``keys`` of them, (batch, bounds of its groups): a group
    that spans batches is put together first, once however many they are, so each comes out whole."""
    open_ = []  # parts of the group that the last batch ended with
    for batch in batches:
        if not batch.num_rows:
            continue
        if open_:
            # one row of the open group before the batch tells whether it goes on
            tail = open_[-1].slice(open_[-1].num_rows - 1)
            cuts = group_cuts(pa.concat_batches([tail, batch]), keys) - 1
        else:
            cuts = group_cuts(batch, keys)
        if not len(cuts):
            open_.append(batch)
            continue
        stop = int(cuts[-1])
        first = pa.concat_batches([*open_, batch.slice(0, stop)]) if open_ else batch.slice(0, stop)
        before = first.num_rows - stop
        inner = cuts[:-1] + before
        yield first, np.array([0, *inner[inner > 0], first.num_rows])
        open_ = [batch.slice(stop)]
    if open_:
        whole = pa.concat_batches(open_)
        open_ = []
        yield whole, np.array([0, whole.num_rows])
    released()
