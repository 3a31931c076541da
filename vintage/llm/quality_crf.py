"""Line quality by a linear-chain conditional random field, document quality by its marginals.

Every line of a text is good or bad. A line's features are character and word statistics of the line
itself and of the lines before and after it; a two-state chain links neighbouring lines. Forward and
backward passes give each line's probability of being good, and a document's score is their mean
weighted by line length in bytes (1 at least). An empty or null text is one empty line.

Training takes a documented, bounded sample: at most ``sample_docs`` labelled documents in the order of a
hash of their id, and of those, in that order, each whole one that still fits into ``sample_lines`` lines
in all. Each line has its document's label. An id counts once with each label it has, however often it is
repeated, by one of its texts. Documents with ``crc32(doc_id) mod 4 = 2`` are held out of it. Labels that
are null, or without a document, are left out; without any usable label every score is 0.5. Scoring reads
whole texts, needs no shuffle, and its inputs are texts alone. Rows that repeat an id are scored one by
one, each by its own text; other columns, whatever their names, are carried along unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mix64, pieces, range_hashes, settle, text_buffers, words_of

SAMPLE_DOCS = 6000
SAMPLE_LINES = 200_000
THRESHOLD = 0.7


def _class(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


CLASSES = {
    "upper": _class(range(65, 91)),
    "lower": _class(range(97, 123)),
    "digit": _class(range(48, 58)),
    "stop": _class(b".?"),
    "comma": _class(b",;:"),
    "bang": _class(b"!"),
    "pipe": _class(b"|"),
    "symbol": _class(b"#$%&*@^~+=<>{}[]\\/_"),
    "other": _class(range(128, 192)),  # continuation bytes, one or more per letter outside ASCII
}
N_FEATURES = len(CLASSES) + 8


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, length by line in bytes, number of lines by text)."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    per_doc = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=n_docs)[:n_docs] + 1 if n_docs else np.zeros(0, np.int64)
    n = int(per_doc.sum())
    heads = np.cumsum(per_doc) - per_doc
    is_head = np.zeros(n, bool)
    is_head[heads] = True
    starts, ends = np.empty(n, np.int64), np.empty(n, np.int64)
    starts[is_head], starts[~is_head] = offsets[:-1], breaks + 1
    is_tail = np.roll(is_head, -1)
    ends[is_tail], ends[~is_tail] = offsets[1:], breaks
    doc = np.repeat(np.arange(n_docs), per_doc)
    length = ends - starts
    full = np.flatnonzero(length > 0)
    counts = np.zeros((len(CLASSES), n))
    if len(full):
        at = np.stack([starts[full], ends[full]], 1).ravel()
        at = at[:-1] if at[-1] == len(data) else at
        for k, table in enumerate(CLASSES.values()):
            counts[k, full] = np.add.reduceat(table[data], at, dtype=np.int64)[::2]
    w_starts, w_ends, w_hash = words_of(data, offsets)
    line = np.searchsorted(starts, w_starts, "right") - 1
    words = np.bincount(line, minlength=n).astype(float)
    twice = np.zeros(n)
    if len(line) > 1:
        same = (w_hash[1:] == w_hash[:-1]) & (line[1:] == line[:-1])
        twice = np.bincount(line[1:][same], minlength=n).astype(float)
    _, once = np.unique(mix64(w_hash + line.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True)
    distinct = np.bincount(line[once], minlength=n)
    letters = np.bincount(line, weights=(w_ends - w_starts), minlength=n)
    key = mix64(range_hashes(data, starts, ends) + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) if len(data) else doc.astype(np.uint64)
    _, back, often = np.unique(key, return_inverse=True, return_counts=True)
    size, n_words = np.maximum(length, 1), np.maximum(words, 1)
    rows = [c / size for c in counts]
    rows += [np.log1p(length) / 8, np.log1p(words) / 6, letters / n_words / 10, twice / n_words, distinct / n_words, (often[back] > 1) & (length > 0), length == 0, counts[0] / np.maximum(counts[0] + counts[1], 1)]
    return np.stack(rows, 1).astype(np.float32), length, per_doc


def with_neighbours(x: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Own features, those of the previous and of the next line (zero beyond the ends), and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    heads = np.cumsum(per_doc) - per_doc
    before[heads] = 0
    after[heads + per_doc - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1), x.dtype)], 1)


def _grid(per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest first: order of texts, and first lines in that order."""
    order = np.argsort(-per_doc, kind="stable")
    return order, (np.cumsum(per_doc) - per_doc)[order]


def forward_backward(u: np.ndarray, t: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of good against bad from the lines up to each one (itself included), and from the lines
    after it. u: log-odds of each line alone; t: 2 x 2 transition scores."""
    order, first = _grid(per_doc)
    sorted_n = per_doc[order]
    d, e = u.copy(), np.zeros_like(u)
    longest = int(sorted_n[0]) if len(sorted_n) else 0
    live = np.searchsorted(-sorted_n, -np.arange(1, longest + 1), "right")  # texts with at least so many lines
    for k in range(1, longest):
        at = first[: live[k]] + k
        p = d[at - 1]
        d[at] += np.logaddexp(t[0, 1], t[1, 1] + p) - np.logaddexp(t[0, 0], t[1, 0] + p)
    for k in range(longest - 2, -1, -1):
        at = first[: live[k + 1]] + k
        g = u[at + 1] + e[at + 1]
        e[at] = np.logaddexp(t[1, 0], t[1, 1] + g) - np.logaddexp(t[0, 0], t[0, 1] + g)
    return d, e


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(x: np.ndarray, per_doc: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.05, l2: float = 1e-5) -> dict:
    """Weights that maximise the conditional likelihood of the sample's line labels (Adam over
    standardised features; the weights returned apply to the raw ones)."""
    n = 3 * N_FEATURES + 1
    if not len(y):
        return {"w": np.zeros(n), "t": np.zeros((2, 2))}
    x = with_neighbours(x, per_doc).astype(np.float64)
    shift, scale = x.mean(0), x.std(0) + 1e-6
    shift[-1], scale[-1] = 0, 1
    x = (x - shift) / scale
    label = np.repeat(y, per_doc).astype(float)
    weight = np.repeat(1 / np.sqrt(per_doc), per_doc)
    weight /= weight.sum()
    head = np.zeros(len(x), bool)
    head[np.cumsum(per_doc) - per_doc] = True
    inner = np.flatnonzero(~head)
    theta, m, v = np.zeros(n + 3), np.zeros(n + 3), np.zeros(n + 3)
    for k in range(1, rounds + 1):
        w, t = theta[:n], np.array([[0, theta[n]], [theta[n + 1], theta[n + 2]]])
        u = x @ w
        d, e = forward_backward(u, t, per_doc)
        grad = np.zeros(n + 3)
        grad[:n] = x.T @ (weight * (label - _sigmoid(d + e)))
        if len(inner):
            g, p = u[inner] + e[inner], d[inner - 1]
            scores = np.stack([np.zeros_like(g), t[0, 1] + g, p + t[1, 0], p + t[1, 1] + g])
            pairs = np.exp(scores - scores.max(0))
            pairs /= pairs.sum(0)
            want = label[inner]  # both lines of a pair have one label
            grad[n:] = [-(weight[inner] * pairs[1]).sum(), -(weight[inner] * pairs[2]).sum(), (weight[inner] * (want - pairs[3])).sum()]
        grad -= l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    w = theta[:n] / scale
    w[-1] -= w[:-1] @ shift[:-1]
    return {"w": w, "t": np.array([[0, theta[n]], [theta[n + 1], theta[n + 2]]])}


def scores(data: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    """One score from 0 to 1 for each text."""
    x, length, per_doc = line_features(data, offsets)
    u = with_neighbours(x, per_doc).astype(np.float64) @ model["w"]
    d, e = forward_backward(u, model["t"], per_doc)
    weight = np.maximum(length, 1)
    heads = np.cumsum(per_doc) - per_doc
    return np.add.reduceat(weight * _sigmoid(d + e), heads) / np.add.reduceat(weight, heads)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> dict:
    """Fit on at most ``sample_docs`` whole labelled documents with ``sample_lines`` lines in all that aren't
    held out; only the line features of these come to the driver."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("y", "text", "doc_id")

    def features(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                x, _, per_doc = line_features(*text_buffers(part.column(1)))
                heads = np.cumsum(per_doc) - per_doc
                blobs = [x[h : h + n].tobytes() for h, n in zip(heads, per_doc, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary()), part.column(2)], ["y", "x", "doc_id"])

    made = texts.mapInArrow(features, f"y int, x binary, doc_id {texts.schema['doc_id'].dataType.simpleString()}")
    # one text of each id, the choice and the order not depending on partitions
    made = settle(made.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("x"), "x")).alias("least")).select("doc_id", "y", "least.x"), "crf-sample")
    taken, left = [], sample_lines
    for r in made.select("doc_id", "y", (F.length("x") / (4 * N_FEATURES)).cast("long").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").collect():
        if r.n <= left:
            taken.append((r.doc_id, r.y))
            left -= r.n
    chosen = docs.sparkSession.createDataFrame(taken, made.select("doc_id", "y").schema)
    got = made.join(F.broadcast(chosen), ["doc_id", "y"], "left_semi").select("y", "x").toArrow()
    rows = sorted(zip(got["y"].to_pylist(), got["x"].to_pylist(), strict=True))
    x = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for _, b in rows]
    return fit(np.concatenate(x) if x else np.zeros((0, N_FEATURES)), np.array([len(v) for v in x], np.int64), np.array([y for y, _ in rows]))


def with_score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in a new column."""

    def score(batches):
        for batch in batches:
            for part in pieces(batch, text_col):
                s = scores(*text_buffers(part.column(part.schema.get_field_index(text_col))), model)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], [*part.schema.names, score_col])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
