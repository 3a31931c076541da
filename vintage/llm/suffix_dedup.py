"""Removal of repeated byte strings by a sparse suffix array with bucket-pointer refinement.

Every byte that is covered by a string of ``LENGTH`` bytes that also starts earlier (smaller doc_id, or the
same document and an earlier start) goes. A bucket is a set of suffixes with one prefix, and its
identifier is a hash of that prefix, so that equal prefixes get equal identifiers on all machines without
a global sort. Identifiers of depth 1, 2, 4 ... are made from those of half the depth at a later offset,
and each update is reused for the next: depth 32 is the initial q-gram, depth 100 the final string.

Holding all suffixes as rows would take many times the input. Every string of ``LENGTH`` bytes has one
anchor, the q-gram in it with the smallest identifier (the first of equal ones); equal strings have equal
anchors, so only suffixes at anchors, about one in 35, are rows, each standing for the run of strings
that it anchors. The rows are refined within their buckets:

1. sorted by q-gram identifier, buckets with a single suffix end there;
2. in the others, suffixes are sorted by the identifier of the whole stretch that their strings cover:
   of equal stretches all but the first go entirely, at once;
3. the first of each stretch, where a bucket holds several, is refined to the identifiers at depth 100
   of each of its strings, and all but the first of equal ones go.

Buckets are named by hashes rather than by ranks since a later offset of an anchored suffix is mostly no
anchor: its bucket has no row that a rank could be read from, but its name can be made where the text is.

A bucket with many suffixes is dealt over as many tasks as its size asks for; what is earliest in one of
them then goes on to step 3, and the strings that remain of such buckets are refined once more by their
own identifier. Which buckets these are comes from a sample and only steers the work: the result is the same
without it. The sample is a thousandth of the documents at least, so that a bucket that it misses has few
suffixes however many documents there are. Identifiers are always compared in pairs of 64 bits (bucket and
stretch, or bucket and string).

Null text counts as empty; a null doc_id comes after all others. Ids are read as long integers, which is
what gives them their order; others are an error of the cast. Every row is a document. Of rows with one
doc_id, or with none, neither comes before the other: what they share stays in all of them, unless an
earlier document has it too. Their ranges are told apart by 64 bits of id and text; rows that are equal in
both get equal results. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _BYTE, as_long, mix64, pieces, random_u64, range_hashes, settle, small, text_buffers, whole_groups

LENGTH = 100
Q = 32
SPAN = LENGTH - Q + 1  # q-grams in a string
SAMPLE_DOCS = 20_000  # documents of the sample that finds large buckets, if that is more than ...
SAMPLE_SHARE = 0.001  # ... this share
HOT = 16  # times in the sample from which a bucket is dealt over tasks
SHARE = 1024  # suffixes of such a bucket for each of them
_M = random_u64(41, 8) | np.uint64(1)


def _later(x: np.ndarray, k: int) -> np.ndarray:
    """x at offset k, as long as x: what lies behind the end is a constant."""
    out = np.empty_like(x)
    out[: max(len(x) - k, 0)] = x[k:]
    out[max(len(x) - k, 0) :] = 0
    return out


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of depth Q and LENGTH at every offset (those that run over the end mean nothing)."""
    x, depth, level = _BYTE[data], 1, 0
    q = x
    while depth * 2 <= LENGTH:
        x = x * _M[level] + _later(x, depth)
        depth, level = depth * 2, level + 1
        if depth == Q:
            q = mix64(x)
    return q, mix64(x * _M[7] + _later(x, LENGTH - depth))


def _anchors(q: np.ndarray) -> np.ndarray:
    """Offset of the first smallest q-gram among the SPAN from each offset on."""
    low, at, width = q.copy(), np.arange(len(q), dtype=np.int64), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        n = len(low) - step
        if n <= 0:
            break
        less = low[step:] < low[:n]
        low[:n] = np.where(less, low[step:], low[:n])
        at[:n] = np.where(less, at[step:], at[:n])
        width += step
    return at


def suffixes(data: np.ndarray, offsets: np.ndarray):
    """(document, bucket, stretch, first string's start in its document, number of strings) of each
    anchored suffix, for the concatenated texts."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    q, _ = identifiers(data)
    at = _anchors(q)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begins = np.flatnonzero(np.arange(len(data)) + LENGTH <= offsets[1:][doc])
    if not len(begins):
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    own = at[begins]
    new = np.ones(len(begins), bool)
    new[1:] = (own[1:] != own[:-1]) | (begins[1:] != begins[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(np.concatenate([head, [len(begins)]]))
    first, anchor = begins[head], own[head]
    stretch = range_hashes(data, first, first + n - 1 + LENGTH)
    stretch = mix64(stretch + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return doc[first], q[anchor], stretch, first - offsets[doc[first]], n


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (what orders documents), row (what tells rows of one doc apart) and text."""
    doc, text = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), F.col(text_col).cast("string")
    return docs.select(doc.alias("doc"), F.xxhash64(F.col(id_col).isNull(), text).alias("row"), text.alias("text"))


def _suffix_rows(source: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                doc, bucket, stretch, first, n = suffixes(*text_buffers(part.column(2)))
                if len(doc):
                    doc = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([as_long(bucket), as_long(stretch), part.column(0).take(doc), part.column(1).take(doc), pa.array(first * 128 + n)], ["bucket", "stretch", "doc", "row", "code"])

    return source.mapInArrow(run, "bucket long, stretch long, doc long, row long, code long")


def hot_buckets(source: DataFrame, docs: int) -> DataFrame:
    """(bucket, salts) of buckets with many suffixes, by a sample of documents: over how many tasks they are
    dealt; at most one row for each HOT suffixes of the sample."""
    share = min(1.0, max(SAMPLE_DOCS / max(docs, 1), SAMPLE_SHARE))
    often = _suffix_rows(source.sample(False, share, 7)).groupBy("bucket").count().filter(F.col("count") >= HOT)
    return often.select("bucket", (F.ceil(F.col("count") / (share * SHARE)) + 1).alias("salts"))


def _salt(*place: str):
    return F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(*place), F.col("salts"))).otherwise(F.lit(0).cast("long"))


def _not_first(new: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted runs (``new`` marks their starts; by doc, row and place inside): which members an earlier one
    goes before, that is one of a smaller doc, or of the same row at an earlier place; and which repeat the
    member before them."""
    other = new.copy()
    other[1:] |= (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    lead, own = np.flatnonzero(new)[np.cumsum(new) - 1], np.flatnonzero(other)[np.cumsum(other) - 1]
    again = ~other
    again[1:] &= place[1:] == place[:-1]
    return (doc != doc[lead]) | (place != place[own]), again


def _refine(rows: DataFrame) -> DataFrame:
    """Steps 1 and 2. rows: bucket, stretch, doc, row, code, salts -> doc, row, code, whole (all strings go,
    or the suffix needs step 3)."""

    def run(batches):
        for batch, bounds in whole_groups(batches, 2):
            stretch, doc, row, code = (batch.column(i).to_numpy() for i in (2, 3, 4, 5))
            hot = batch.column(6).to_numpy(zero_copy_only=False)
            size = np.diff(bounds)
            group = np.repeat(np.arange(len(size)), size)
            new = np.ones(len(doc), bool)
            new[1:] = (group[1:] != group[:-1]) | (stretch[1:] != stretch[:-1])
            kinds = np.add.reduceat(new.astype(np.int64), bounds[:-1])[group]
            whole, again = _not_first(new, doc, row, code)
            keep = np.flatnonzero(~again & (whole | (kinds > 1) | hot))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, row, code, whole)], ["doc", "row", "code", "whole"])

    dealt = rows.withColumn("salt", _salt("doc", "code")).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "stretch", "doc", "row", "code")
    return dealt.select("bucket", "salt", "stretch", "doc", "row", "code", F.col("salts").isNotNull().alias("hot")).mapInArrow(run, "doc long, row long, code long, whole boolean")


def _packed(source: DataFrame) -> DataFrame:
    """Texts as compressed bytes: half of what the shuffle would move."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([squeeze.compress((t or "").encode()) for t in part.column(2).to_pylist()], pa.binary())], ["doc", "row", "packed"])

    return source.mapInArrow(run, "doc long, row long, packed binary")


def _strings(texts: DataFrame) -> DataFrame:
    """Step 3's input: the depth-100 identifiers of the strings of each suffix. texts: doc, row, packed, codes."""

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            bucket, doc, row, first, names = [], [], [], [], []
            for d, r, packed, codes in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                data = np.frombuffer(open_.decompress(packed), np.uint8)
                q, full = identifiers(data)
                for code in sorted(codes):
                    lo, n = code >> 7, code & 127
                    bucket.append(q[lo + int(np.argmin(q[lo : lo + SPAN]))])
                    doc.append(d)
                    row.append(r)
                    first.append(lo)
                    names.append(full[lo : lo + n].tobytes())
            if doc:
                yield pa.RecordBatch.from_arrays([as_long(np.array(bucket, np.uint64)), *[pa.array(x, pa.int64()) for x in (doc, row, first)], pa.array(names, pa.binary())], ["bucket", "doc", "row", "first", "names"])

    return texts.select("doc", "row", "packed", "codes").mapInArrow(run, "bucket long, doc long, row long, first long, names binary")


def _later_ones(bucket: np.ndarray, name: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of those of each bucket and name that none goes before, indices of the others)."""
    order = np.lexsort((start, row, doc, name, bucket))
    b, k, d, r, s = bucket[order], name[order], doc[order], row[order], start[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    later, again = _not_first(new, d, r, s)
    return order[~later & ~again], order[later & ~again]


def _runs(doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts put together: (document, row, first start, end in bytes)."""
    order = np.lexsort((start, row, doc))
    doc, row, start = doc[order], row[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(doc)]]) - 1
    return doc[head], row[head], start[head], start[tail] + LENGTH


RANGES = "bucket long, name long, doc long, row long, lo long, hi long"


def _out(bucket, name, doc, row, lo, hi):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (bucket, name, doc, row, lo, hi)], ["bucket", "name", "doc", "row", "lo", "hi"])


def _gone(doc, row, start):
    doc, row, lo, hi = _runs(doc, row, start)
    return _out(pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.int64()), doc, row, lo, hi)


def _refine_strings(rows: DataFrame) -> DataFrame:
    """Step 3. rows: bucket, doc, row, first, names, salts -> ranges of bytes that go (name null), and of
    buckets dealt over tasks the strings that are earliest in theirs (bucket, name, doc, row, lo)."""

    def run(batches):
        for batch, _ in whole_groups(batches, 2):
            names = batch.column(5)
            n = np.diff(np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1]) // 8
            name = np.frombuffer(b"".join(names.to_pylist()), np.int64)
            of = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(name)) - np.repeat(np.cumsum(n) - n, n)
            bucket, doc, row, start = batch.column(0).to_numpy()[of], batch.column(2).to_numpy()[of], batch.column(3).to_numpy()[of], batch.column(4).to_numpy()[of] + within
            first, later = _later_ones(bucket, name, doc, row, start)
            if len(later):
                yield _gone(doc[later], row[later], start[later])
            on = first[batch.column(6).to_numpy(zero_copy_only=False)[of[first]]]
            if len(on):
                yield _out(bucket[on], name[on], doc[on], row[on], start[on], start[on])

    dealt = rows.withColumn("salt", _salt("doc", "first")).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "doc", "row", "first")
    return dealt.select("bucket", "salt", "doc", "row", "first", "names", F.col("salts").isNotNull().alias("hot")).mapInArrow(run, RANGES)


def _refine_rest(rows: DataFrame) -> DataFrame:
    """The strings that are left of dealt buckets, by bucket and identifier. rows: bucket, name, doc, row, lo."""

    def run(batches):
        for batch, _ in whole_groups(batches, 2):
            bucket, name, doc, row, start = (batch.column(i).to_numpy() for i in range(5))
            _, later = _later_ones(bucket, name, doc, row, start)
            if len(later):
                yield _gone(doc[later], row[later], start[later])

    return rows.repartition("bucket", "name").sortWithinPartitions("bucket", "name").select("bucket", "name", "doc", "row", "lo").mapInArrow(run, RANGES)


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, lo, hi): ranges of bytes that go, overlapping ones too; doc and row as ``_source`` has them."""
    source = _source(docs, id_col, text_col)
    hot = settle(hot_buckets(source, docs.count()), "suffix-hot")
    told = lambda rows: rows.join(small(hot), "bucket", "left")
    kept = settle(_refine(told(_suffix_rows(source))), "suffix-kept")
    ask = kept.filter("NOT whole").groupBy("doc", "row").agg(F.collect_list("code").alias("codes"))
    strings = _strings(_packed(source).join(ask, ["doc", "row"]))
    found = settle(_refine_strings(told(strings)), "suffix-strings")
    rest = _refine_rest(found.filter("name IS NOT NULL"))
    whole = kept.filter("whole").select("doc", "row", F.shiftright("code", 7).alias("lo"), (F.shiftright("code", 7) + F.col("code").bitwiseAND(127) - 1 + LENGTH).alias("hi"))
    return whole.unionByName(found.filter("name IS NULL").select("doc", "row", "lo", "hi")).unionByName(rest.select("doc", "row", "lo", "hi"))


def kept_ranges(n: int, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(bytes removed, maximal removed runs, mask of bytes kept) of a text of n bytes."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(lo, n), 1)
    np.add.at(step, np.minimum(hi, n), -1)
    keep = np.cumsum(step[:-1]) == 0
    gone = ~keep
    return int(gone.sum()), int(gone[:1].sum() + (gone[1:] & keep[:-1]).sum()), keep


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("kept",)) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans and, as asked for, kept (binary) and
    kept_sha256."""
    ranges = repeated_ranges(docs, id_col, text_col)
    per_row = ranges.groupBy("doc", "row").agg(F.collect_list(F.col("lo") * (1 << 31) + (F.col("hi") - F.col("lo"))).alias("ranges"))
    texts = _packed(_source(docs, id_col, text_col)).join(per_row, ["doc", "row"], "left")
    kinds = {"kept": ("binary", pa.binary()), "kept_sha256": ("string", pa.string())}

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", *outputs)}
            for packed, ranges in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = open_.decompress(packed)
                removed, spans = 0, 0
                if ranges.is_valid and data:
                    r = ranges.values.to_numpy()
                    lo = r >> 31
                    removed, spans, keep = kept_ranges(len(data), lo, lo + (r & ((1 << 31) - 1)))
                    left = np.frombuffer(data, np.uint8)[keep].tobytes()
                else:
                    left = data
                out["n_bytes"].append(len(data))
                out["n_removed"].append(removed)
                out["n_spans"].append(spans)
                if "kept" in out:
                    out["kept"].append(left)
                if "kept_sha256" in out:
                    out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[k], kinds[k][1] if k in kinds else pa.int64()) for k in out]], ["doc", *out])

    schema = ", ".join(["doc long", "n_bytes long", "n_removed long", "n_spans long", *[f"{k} {kinds[k][0]}" for k in outputs]])
    got = texts.select("doc", "packed", "ranges").mapInArrow(run, schema)
    return got.select(F.when(F.col("doc") < 2**63 - 1, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", *outputs)
