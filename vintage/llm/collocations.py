"""Phrase collocation mining with an FM-index per shard over word ids.

Texts are lower-cased (A-Z), cut into pieces at ``BREAKS`` and those into words at blanks. A shard is the word
sequence of some texts of one language, with a 0 between pieces, and the dictionary of its words. Shards are
stored once; each step reads them as they are and sums over them:

1. words are counted, and those that occur ``LEAST`` times are frequent;
2. every shard indexes its frequent words and extends each by one to the left; the pairs' counts are summed
   by a hash of 64 bits;
3. every shard keeps the stretches of frequent pairs, indexes them in both directions and extends its
   intervals: pairs to the left, those phrases to the right. Counts are summed by language and phrase.

The index of a direction is its Burrows-Wheeler transform, with rows sorted by as many words as a phrase
may have (``WordIndex``). Extending an interval by a word is a step of the transform; all intervals of
one length are extended at once. The interval in the other direction moves along (``TwoWayIndex``).

What shards are told between steps is a bit filter of the frequent hashes, of 32 MB at most whatever the
corpus. It only passes by what cannot be frequent: a false positive is counted and then dropped, so counts are
exact.

A candidate is a phrase of 2 to ``MOST`` words that occurs ``LEAST`` times. Its score is that of its weakest
cut; it is dropped if an extension by one word, left or right, has ``ABSORBED`` percent of its count. (An
extension by more words that has them implies one by one word that has.) The first ``TOP`` of each language
are taken in rounds over ever fewer hash groups, so that no task ranks a whole language.

Null texts are empty; a null language is ``und``. Rows that repeat an id count like any others; no id is
read, nor any other column. A text is held whole by one task, and a piece of more than ``SHARD`` words makes a
shard of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_long, mix64, pieces, settle, small, text_buffers, words_of

BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
MOST = 4
LEAST = 30
ABSORBED = 80
TOP = 2000
FACTOR = 2_000_000
SHARD = 1 << 20  # words of a shard, about
TEXT = 4 << 20  # bytes of text that a task gathers for one
FILTER_BITS = 28  # a filter has at most 2 ** FILTER_BITS bits
RANKED = 16_000  # rows that a task ranks, on average

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_APART = _BREAK.copy()
_APART[list(BLANKS)] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32
_FIRST = np.uint64(0xD6E8FEB86659FD93)


class WordIndex:
    """FM-index of a cyclic sequence of word ids (0: a gap): its transform, with rows sorted by ``depth``
    words from each place. Intervals of rows are right for phrases of up to ``depth`` words."""

    def __init__(self, ids: np.ndarray, depth: int):
        rank, known = ids.astype(np.int64), 1
        while True:
            step = min(known, depth - known)
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
            order = np.argsort(key)
            known += step
            if known == depth:
                break
            ranked = key[order]
            new = np.empty(len(ids), np.int64)
            new[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
            rank = new
        del key, rank
        # rows in the order of the word before them, then of the row: a step of the transform
        steps = np.roll(ids, 1)[order].astype(np.int64)
        del order
        steps *= len(ids)
        steps += np.arange(len(ids))
        steps.sort()
        self.word, self.row = (steps // len(ids)).astype(np.int32), (steps % len(ids)).astype(np.int32)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, first row, end row) of every word and of the gap."""
        head = np.flatnonzero(np.diff(self.word, prepend=-1))
        return self.word[head], head, np.append(head[1:], len(self.word))

    def extended(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions of disjoint intervals: (which interval, word, first row, end row)."""
        edge = np.zeros(len(self.row) + 1, np.int32)
        edge[lo] += np.arange(1, len(lo) + 1, dtype=np.int32)
        edge[hi] -= np.arange(1, len(lo) + 1, dtype=np.int32)
        of = np.cumsum(edge[:-1], dtype=np.int32)[self.row]
        head = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(self.word, prepend=-1) != 0))
        end = np.append(head[1:], len(of))
        inside = of[head] > 0
        head, end = head[inside], end[inside]
        return of[head] - 1, self.word[head], head, end


class TwoWayIndex:
    """Phrases of one length with their intervals in an index and in that of the reversed sequence."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.left, self.right = WordIndex(ids, depth), WordIndex(ids[::-1], depth)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrases, counts, first rows in both indices) of all words."""
        word, lo, hi = self.left.words()
        some = word > 0
        return word[some, None], (hi - lo)[some], lo[some], lo[some]

    def extended(self, phrases, counts, lo, rlo, to_left: bool):
        """The same for all extensions by one word to the left or to the right."""
        index, own, other = (self.left, lo, rlo) if to_left else (self.right, rlo, lo)
        order = np.argsort(own)
        of, word, head, end = index.extended(own[order], own[order] + counts[order])
        of = order[of]
        # in the other direction the extensions of a phrase lie side by side, by word, gaps first
        by = np.lexsort((word, of))
        size = (end - head)[by]
        ahead = np.cumsum(size) - size
        first = np.flatnonzero(np.diff(of[by], prepend=-1))
        ahead -= np.repeat(ahead[first], np.diff(np.append(first, len(by))))
        beside = np.empty(len(by), np.int64)
        beside[by] = other[of[by]] + ahead
        some = word > 0
        of, word, head, end, beside = of[some], word[some], head[some], end[some], beside[some]
        longer = [word[:, None], phrases[of]] if to_left else [phrases[of], word[:, None]]
        return np.concatenate(longer, 1), end - head, *((head, beside) if to_left else (beside, head))


def spaced(ids: np.ndarray, gap_before: np.ndarray) -> np.ndarray:
    """Word ids with a 0 before each word that ``gap_before`` marks; the first one has one in any case."""
    gap = gap_before.copy()
    gap[:1] = True
    out = np.zeros(len(ids) + int(gap.sum()), np.int32)
    out[np.arange(len(ids)) + np.cumsum(gap)] = ids
    return out


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges as an Arrow column of strings."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())).cast(pa.string())


def sequences(lang: str, texts: pa.Array):
    """Shards (n_words, ids, words, keys) of some texts of one language: ids as a spaced sequence of 1, 2 ...
    for the words; keys: 64 bits of language and word."""
    data, offsets = text_buffers(texts)
    data = _LOW[data]
    starts, ends, hashes = words_of(data, offsets, _APART)
    if not len(starts):
        return
    breaks = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
    text = np.searchsorted(offsets, starts, "right")
    gap = np.ones(len(starts), bool)
    gap[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
    keys = mix64(hashes + np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
    heads, lo = np.flatnonzero(gap), 0
    while lo < len(starts):
        at = np.searchsorted(heads, lo + SHARD)
        hi = int(heads[at]) if at < len(heads) else len(starts)
        own, first, ids = np.unique(keys[lo:hi], return_index=True, return_inverse=True)
        yield hi - lo, spaced(ids.astype(np.int32) + 1, gap[lo:hi]), _gathered(data, starts[lo + first], ends[lo + first]), own
        lo = hi


SHARDS = "lang string, n_words long, ids binary, words array<string>, keys binary"


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The stored shards."""
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))

    def rows(lang, texts):
        for n, ids, words, keys in sequences(lang, pa.concat_arrays(texts)):
            listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n]), pa.array([ids.tobytes()], pa.binary()), listed, pa.array([keys.tobytes()], pa.binary())], ["lang", "n_words", "ids", "words", "keys"])

    def run(batches):
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column(1).fill_null("")
                for lang in pc.unique(part.column(0)).to_pylist():
                    own = texts.filter(pc.equal(part.column(0), lang))
                    held.setdefault(lang, []).append(own)
                    size[lang] = size.get(lang, 0) + own.nbytes
                while sum(size.values()) > TEXT:  # the language with most text makes a shard
                    most = max(size, key=size.get)
                    size.pop(most)
                    yield from rows(most, held.pop(most))
        for lang, texts in held.items():
            yield from rows(lang, texts)

    return settle(source.mapInArrow(run, SHARDS), "phrase-shards")


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A bit set of the keys (one column of 64-bit hashes), by their top bits: 16 bits a key, within bounds.
    It is made by an aggregation; the driver gets at most 2 ** (FILTER_BITS - 6) rows."""
    bits = min(max(math.ceil(math.log2(16 * keys.count() + 1)), 16), FILTER_BITS)
    name = keys.columns[0]
    place = keys.select(F.shiftrightunsigned(name, 64 - bits).alias("at"))
    set_ = place.groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    if set_.num_rows:
        out[set_["word"].to_numpy()] = set_["bits"].to_numpy().view(np.uint64)
    return out


def passes(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    at = keys >> np.uint64(64 - (len(filter_).bit_length() - 1 + 6))
    return (filter_[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _pair_keys(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(keys[a - 1] * _FIRST + keys[b - 1])


def _compact(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids renumbered to those that occur, the old id of each new one; 0 stays)."""
    used = np.bincount(ids) > 0
    used[:1] = True
    return (np.cumsum(used, dtype=np.int32) - 1)[ids], np.flatnonzero(used)


def _stretches(ids: np.ndarray, keys: np.ndarray, words: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """The spaced sequence of frequent words that stand beside another one, in one piece; with ``pairs``,
    of frequent pairs."""
    fine = np.concatenate([[False], passes(words, keys)])[ids]
    joined = fine[:-1] & fine[1:]
    if pairs is not None:
        at = np.flatnonzero(joined)
        joined[at] = passes(pairs, _pair_keys(keys, ids[at], ids[at + 1]))
    keep = np.zeros(len(ids), bool)
    keep[:-1] |= joined
    keep[1:] |= joined
    at = np.flatnonzero(keep)
    return spaced(ids[at], ~np.concatenate([[False], joined])[at])


def word_counts(stored: DataFrame) -> DataFrame:
    """lang, word, key and count of all words of a shard."""

    def run(batches):
        for batch in batches:
            for lang, ids, words, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                count = np.bincount(np.frombuffer(ids, np.int32), minlength=len(words.values) + 1)[1:]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(count)), words.values, as_long(np.frombuffer(keys, np.uint64)), pa.array(count)], ["lang", "word", "key", "count"])

    return stored.select("lang", "ids", "words", "keys").mapInArrow(run, "lang string, word string, key long, count long")


def pair_counts(stored: DataFrame, words: np.ndarray) -> DataFrame:
    """key and count of the pairs of frequent words of a shard, by a step to the left from each word."""
    told = stored.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for batch in batches:
            for raw, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = np.frombuffer(keys, np.uint64)
                ids, old = _compact(_stretches(np.frombuffer(raw, np.int32), keys, told.value))
                if len(ids):
                    index = WordIndex(ids, 2)
                    word, lo, hi = index.words()
                    of, before, head, end = index.extended(lo[word > 0], hi[word > 0])
                    some = before > 0
                    pair = _pair_keys(keys, old[before[some]], old[word[word > 0][of[some]]])
                    yield pa.RecordBatch.from_arrays([as_long(pair), pa.array((end - head)[some])], ["key", "count"])

    return stored.select("ids", "keys").mapInArrow(run, "key long, count long")


def phrase_counts(stored: DataFrame, words: np.ndarray, pairs: np.ndarray, most: int = MOST) -> DataFrame:
    """lang, phrase, size and count of a shard's phrases of 2 to ``most`` words, all of whose pairs may be
    frequent."""
    told = stored.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches):
        for batch in batches:
            for lang, raw, names, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                ids, old = _compact(_stretches(np.frombuffer(raw, np.int32), np.frombuffer(keys, np.uint64), *told.value))
                if not len(ids):
                    continue
                index = TwoWayIndex(ids, most)
                found = index.words()
                for size in range(2, most + 1):
                    found = index.extended(*found, to_left=size < most or most == 2)
                    phrases, counts = found[:2]
                    if not len(counts):
                        break
                    for lo in range(0, len(counts), 1 << 16):
                        part = phrases[lo : lo + (1 << 16)]
                        text = pc.binary_join_element_wise(*[names.values.take(pa.array(old[part[:, j]] - 1)) for j in range(size)], " ")
                        n = len(part)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * n), text, pa.array(np.full(n, size, np.int32)), pa.array(counts[lo : lo + n])], ["lang", "phrase", "size", "count"])
        pa.default_memory_pool().release_unused()

    return stored.select("lang", "ids", "words", "keys").mapInArrow(run, "lang string, phrase string, size int, count long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, most: int = MOST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size and a, the count, of all phrases of 1 to ``most`` words that occur ``least`` times;
    lang and n, all words), settled."""
    stored = shards(docs, text_col, lang_col)
    totals = settle(stored.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase-totals")
    single = word_counts(stored).groupBy("lang", F.col("word").alias("phrase")).agg(F.first("key").alias("key"), F.sum("count").alias("a"))
    single = settle(single.filter(F.col("a") >= least), "phrase-words")
    words = bit_filter(single.select("key"))
    pairs = settle(pair_counts(stored, words).groupBy("key").agg(F.sum("count").alias("a")).filter(F.col("a") >= least).select("key"), "phrase-pairs")
    longer = phrase_counts(stored, words, bit_filter(pairs), most).groupBy("lang", "phrase", "size").agg(F.sum("count").alias("a"))
    every = single.select("lang", "phrase", F.lit(1).alias("size"), "a").unionByName(longer.filter(F.col("a") >= least))
    return settle(every, "phrase-frequent"), totals


def _words(first, n) -> Column:
    """``n`` words of a phrase from the ``first``, both counted from 1."""
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def scored(grams: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Candidates (lang, phrase, a) with the l, r and score of their weakest cut, of equally weak ones the
    earliest. grams: as of ``frequent_phrases``."""
    cut = grams.filter("size > 1").select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = F.array(F.struct(F.lit(0).alias("side"), _words(1, F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), _words(F.col("k") + 1, F.col("size")).alias("part")))
    asked = cut.select("lang", F.col("phrase").alias("whole"), "a", "k", F.explode(parts).alias("p")).select("lang", "whole", "a", "k", "p.side", F.col("p.part").alias("phrase"))
    told = asked.join(grams.select("lang", "phrase", F.col("a").alias("f")), ["lang", "phrase"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    cuts = told.groupBy("lang", "whole", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    # decimals: the product may pass 64 bits
    score = F.expr(f"(cast(a as decimal(19, 0)) * {factor}) div (cast(l as decimal(19, 0)) + r)").cast("long")
    weakest = cuts.groupBy("lang", F.col("whole").alias("phrase"), "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def extensions(grams: DataFrame) -> DataFrame:
    """(lang, phrase, extended): of phrases with a frequent extension by a word, the largest count of one."""
    both = F.explode(F.array(_words(1, F.col("size") - 1), _words(2, F.col("size"))))
    return grams.filter("size > 2").select("lang", both.alias("shorter"), "a").groupBy("lang", F.col("shorter").alias("phrase")).agg(F.max("a").alias("extended"))


def first_of_each(rows: DataFrame, group: str, spread: str, order: list, top: int, ranked: int = RANKED) -> DataFrame:
    """The first ``top`` rows of each group and their rank. rows: settled. A large table is ranked in groups
    by a hash of ``spread`` first, in rounds, so that a task ranks some ``ranked`` rows and not a group."""
    salts, turn = math.ceil(rows.count() / ranked), 0
    while salts > 1:
        part = Window.partitionBy(group, F.pmod(F.xxhash64(spread, F.lit(turn)), F.lit(salts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top).drop("rank")
        salts, turn = math.ceil(salts * top / ranked), turn + 1
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, absorbed: int = ABSORBED, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n and score."""
    grams, totals = frequent_phrases(docs, least, most, text_col, lang_col)
    free = scored(grams).join(extensions(grams), ["lang", "phrase"], "left").filter(F.col("extended").isNull() | (100 * F.col("extended") < absorbed * F.col("a")))
    free = settle(free.select("lang", "phrase", "a", "l", "r", "score"), "phrase-scored")
    best = first_of_each(free, "lang", "phrase", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return best.join(small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
