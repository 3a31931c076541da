"""SentencePiece encoding and decoding by a table of distinct chunks.

With a vocabulary whose pieces hold whitespace markers only at their start, no merge crosses from one
marked word into the next, so a text is the concatenation of its chunks (one or more markers and what
follows up to the next marker). A first pass makes the table of distinct chunks and their counts, partially
in each task (``chunk_table``); its at most ``TABLE`` most frequent entries are segmented by the library once
and broadcast, a size that is bounded by that number of chunks of up to ``LONGEST`` characters. Ids are joined
back by position: the second pass looks the chunks of each text up, in order.

A chunk beyond the broadcast, rare or long, is segmented by the task that meets it, once while it stays in
the task's own table; that table is started anew at ``CHUNKS`` entries or ``HELD`` characters, so memory is
bounded whatever the corpus holds, and the ids are the same either way. A shuffle join of just these
occurrences, a tenth of all, would move over twice the input (see README).

If the model doesn't allow chunks (a piece crosses a marker, a normaliser other than identity, suffix
markers, whitespace removal, user-defined symbols), whole texts go through the library instead. Null
and empty texts have no ids and decode to an empty text. Rows that repeat an id are encoded one by one;
columns other than the text and those to carry, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import pieces, released, settle

MARK = "▁"
TABLE = 100_000  # entries of the broadcast part of the table
LONGEST = 64  # characters of a chunk in it
CHUNKS = 50_000  # entries of a task's own table
COUNTED = 500_000  # rows of counts that a task holds
PIECE = 1 << 20  # bytes of text whose chunks are looked up at once
HELD = 32 << 20  # characters of its chunks


def load(model: bytes):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor()
    sp.LoadFromSerializedProto(model)
    return sp


def chunkable(model: bytes) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(model)
    norm, plain = m.normalizer_spec, m.trainer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or plain.treat_whitespace_as_suffix or m.denormalizer_spec.precompiled_charsmap:
        return False
    return all(p.type in (2, 3, 6) or (p.type == 1 and MARK not in p.piece.lstrip(MARK)) for p in m.pieces)


class ChunkTable:
    """Distinct chunks and what the library makes of them. A chunk's key is the string that, after the
    library's dummy prefix, gives the chunk: its markers but one, as spaces, and the rest."""

    def __init__(self, model: bytes, most: int = CHUNKS, known: tuple = ((), (), (), ())):
        self.sp, self.most, self.known = load(model), most, known
        self.whole = not chunkable(model)
        self.lead = self.sp.encode("a")
        self.lead_len = len(self.sp.decode(self.lead))
        #: ids whose decoding isn't the piece's own text
        self.odd = {k for k in range(self.sp.get_piece_size()) if self.sp.is_unknown(k) or self.sp.is_control(k) or self.sp.is_byte(k) or self.sp.is_unused(k)}
        self.clear()

    def clear(self) -> None:
        """Back to the known entries: chunks, ids, digits and inner texts."""
        chunks, ids, digits, inner = self.known
        self.at: dict[str, int] = {c: k for k, c in enumerate(chunks)}
        self.ids: list[list[int]] = list(ids)
        self.digits: list[str] = list(digits)
        self.inner: list[str] = list(inner)  # decoded, as it reads behind other chunks
        self.held = 0

    def keys(self, text: str) -> list[str]:
        if not text:
            return []
        if self.whole:
            return [text]
        return [c[1:].replace(MARK, " ") for c in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All keys of ``texts`` in a row, how many each text has, and the order of the texts in both:
        first those that one split at single spaces does, then the others."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = np.ones(len(texts), bool)
        if not self.whole:
            found = [pc.equal(texts, ""), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)]
            odd = np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in found])
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        others = [self.keys(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        flat = pa.concat_arrays([plain.flatten(), pa.array([k for keys in others for k in keys], pa.large_string())])
        sizes = np.concatenate([pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64), np.array([len(k) for k in others], np.int64)])
        return flat, sizes, np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])

    def add(self, keys: list[str]) -> None:
        """Segment new keys, which must be distinct."""
        mark = [self.sp.piece_to_id(MARK)]
        many = [ids if key else mark for key, ids in zip(keys, self.sp.encode(keys, num_threads=1))]
        self.at.update(zip(keys, range(len(self.ids), len(self.ids) + len(keys))))
        self.ids += many
        self.digits += [",".join(map(str, ids)) for ids in many]
        if self.whole:
            self.inner += [""] * len(keys)
        else:
            plain = self.odd.isdisjoint
            read = iter(self.decoded([self.lead + ids for ids in many if not plain(ids)]))
            self.inner += [" " + key if plain(ids) else next(read)[self.lead_len :] for key, ids in zip(keys, many)]
        self.held += sum(map(len, keys))

    def decoded(self, many: list[list[int]]) -> list[str]:
        return self.sp.decode(many, num_threads=1) if many else []

    def places(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the table of the distinct keys in ``flat``, and for each key of ``flat`` which of
        them it is. Starts the table anew first when it has grown too large."""
        if len(self.at) >= len(self.known[0]) + self.most or self.held >= HELD:
            self.clear()
        coded = flat.dictionary_encode()
        distinct, at = coded.dictionary.to_pylist(), self.at
        self.add([k for k in distinct if k not in at])
        return np.array([at[k] for k in distinct], np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


    def outputs(self, texts: pa.Array, wanted: tuple[str, ...]) -> dict[str, pa.Array]:
        """The ``wanted`` columns for ``texts``: ids, digits and decoded chunks are looked up once for each
        distinct key and put in place by position."""
        flat, sizes, order = self.split(texts)
        distinct, which = self.places(flat)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids, out = [self.ids[k] for k in distinct], {}
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))[which])])[bounds]
        out["n_tokens"] = pa.array(np.diff(upto))
        if "ids" in wanted:
            in_place = pa.array(ids, pa.large_list(pa.int32())).take(pa.array(which)).flatten()
            out["ids"] = pa.LargeListArray.from_arrays(pa.array(upto), in_place)
        if "ids_sha256" in wanted:
            out["ids_sha256"] = hashed(joined([self.digits[k] for k in distinct], which, bounds, ","))
        if "decoded" in wanted or "decoded_sha256" in wanted:
            opens = np.diff(bounds) > 0
            first = bounds[:-1][opens]
            heads = np.full(len(opens), "", object)
            heads[opens] = self.decoded([ids[k] for k in which[first]])
            tails = joined([self.inner[k] for k in distinct], np.delete(which, first), bounds - np.concatenate([[0], np.cumsum(opens)]), "")
            out["decoded"] = pc.binary_join_element_wise(pa.array(heads, pa.large_string()), tails, pa.scalar("", pa.large_string()))
            if "decoded_sha256" in wanted:
                out["decoded_sha256"] = hashed(out["decoded"])
        back = pa.array(np.argsort(order))
        return {k: out[k].take(back) for k in wanted}

    def encode(self, text: str) -> list[int]:
        """Positions in the table, chunk by chunk."""
        distinct, which = self.places(self.split(pa.array([text], pa.string()))[0])
        return distinct[which].tolist()

    def decode(self, chunks: list[int]) -> str:
        if not chunks:
            return ""
        return self.sp.decode(self.ids[chunks[0]]) + "".join([self.inner[c] for c in chunks[1:]])


def joined(values: list[str], which: np.ndarray, bounds: np.ndarray, by: str) -> pa.Array:
    """``values[which]``, joined between each two ``bounds``."""
    flat = pa.array(values, pa.large_string()).take(pa.array(which))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), flat), pa.scalar(by, pa.large_string()))


def hashed(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts.cast(pa.large_binary())], pa.string())


def chunk_table(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """Every distinct chunk of up to LONGEST characters in ``docs``: chunk and n, its occurrences. model: a
    broadcast of the model's bytes. Empty if the model doesn't allow chunks."""

    def count(batches):
        table, seen, rows = ChunkTable(model.value), [], 0
        for batch in batches:
            for part in pieces(batch, "text"):
                if table.whole:
                    continue
                flat = table.split(part.column(0))[0]
                n = flat.filter(pc.less_equal(pc.utf8_length(flat), LONGEST)).value_counts()
                seen.append(pa.table([n.field(0), n.field(1)], ["chunk", "n"]))
                rows += len(n)
                if rows >= COUNTED:
                    seen = [summed(seen)]
                    rows = seen[0].num_rows
                    if 2 * rows >= COUNTED:
                        yield from told(seen)
                        seen, rows = [], 0
        if seen:
            yield from told([summed(seen)])
        del table, seen
        released()

    def summed(seen):
        return pa.concat_tables(seen).group_by("chunk", use_threads=False).aggregate([("n", "sum")]).rename_columns(["chunk", "n"])

    def told(seen):
        return seen[0].cast(pa.schema([("chunk", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=10_000)

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "chunk string, n long")
    return counts.groupBy("chunk").agg(F.sum("n").alias("n"))


def segmented(chunks: DataFrame, model) -> DataFrame:
    """Distinct chunks, each segmented once: chunk, ids, digits (ids as text) and inner (how it reads behind
    other chunks)."""

    def segment(batches):
        table = ChunkTable(model.value)
        for batch in batches:
            table.clear()
            table.add(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(table.ids, pa.list_(pa.int32())), pa.array(table.digits, pa.string()), pa.array(table.inner, pa.string())], ["chunk", "ids", "digits", "inner"])

    return chunks.select("chunk").mapInArrow(segment, "chunk string, ids array<int>, digits string, inner string")


def frequent(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """The most frequent entries of a settled chunk table, ``most`` (TABLE) at most: those above a count
    that a histogram of counts gives (16 bins an octave, so some thousand rows whatever the corpus holds).
    No sort, and no task reads more than its part of the table."""
    most = TABLE if most is None else most
    bin_of = F.floor(F.log2("n") * 16)
    taken, least = 0, None
    for r in sorted(chunks.groupBy(bin_of.alias("bin")).count().collect(), key=lambda r: -r.bin):
        taken += r["count"]
        if taken > most:
            break
        least = r.bin
    return chunks.filter(F.lit(False) if least is None else bin_of >= least)


def encoded(docs: DataFrame, model_file: str, text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids"), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of ``docs`` and, as asked for, n_tokens, ids (array<int>), decoded,
    ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256, from every whole text."""
    with open(model_file, "rb") as f:  # on the driver; tasks get the bytes
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = {"n_tokens": (T.LongType(), pa.int64()), "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "decoded": (T.StringType(), pa.string()), "ids_sha256": (T.StringType(), pa.string()), "decoded_sha256": (T.StringType(), pa.string())}
    source = docs.select(*carry, *[text_col] * (text_col not in carry))
    chunks = settle(chunk_table(docs, model, text_col), "piece-chunks")
    often = segmented(frequent(chunks), model).toArrow()
    known = docs.sparkSession.sparkContext.broadcast(tuple(often[c].to_pylist() for c in ("chunk", "ids", "digits", "inner")))

    def run(batches):
        table = ChunkTable(model.value, known=known.value)
        for batch in batches:
            for part in pieces(batch, text_col, PIECE):
                got = table.outputs(part.column(part.schema.get_field_index(text_col)), outputs)
                cols = [part.column(part.schema.get_field_index(c)) for c in carry]
                yield pa.RecordBatch.from_arrays([*cols, *[got[k].cast(kinds[k][1]) for k in outputs]], [*carry, *outputs])
        del table
        released()

    return source.mapInArrow(run, T.StructType([*[source.schema[c] for c in carry], *[T.StructField(k, kinds[k][0]) for k in outputs]]))


def decoded(rows: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with the library's decoding of an id array in ``out_col``; null ids decode to an empty text."""
    with open(model_file, "rb") as f:
        model = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        sp = load(model.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sp.decode(x) if x else "" for x in ids], pa.string())], [*batch.schema.names, out_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))
