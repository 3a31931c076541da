"""Token counts of sections from one encoding of the whole document.

Encoding sections one by one gives other tokens than encoding the document does. Here each whole text is
encoded once with a byte-level vocabulary, tokens get their character spans from the lengths of their
bytes, and an interval join of token spans with section spans (a merge of two sorted lists of ends)
attributes every token. A token that crosses a boundary goes by an explicit rule:

* ``start``: to the section that holds its first character;
* ``most``: to the section that holds most of its characters, the earlier one on a tie;
* ``share``: to each section in proportion to its characters.

Sections tile the text: each starts where the previous one ends, so no token is lost or counted twice
and a document's sections sum to its tokens. A character that several tokens split belongs to the token
in which it begins; a token without a first byte of a character goes where its character began. Without
a section column, sections are paragraphs: a line break followed by an empty line ends one, and the
break belongs to the section before it. Null and empty texts have no tokens and one empty section. Rows that
repeat an id are counted one by one. Other columns than those named, whatever their names, are not read.
Whole texts are read, nothing is shuffled.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import pieces

RULES = ("start", "most", "share")


def load(ranks_file: bytes, pattern: str):
    """(encoding, bytes of each token) from a file of base64 tokens and ranks."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
    sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_ends(text: str, encoding, sizes: np.ndarray) -> np.ndarray:
    """Character offset at which each token ends: characters that have begun up to there."""
    ids = np.asarray(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(sizes[ids])
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(text):
        return ends
    begun = np.cumsum((raw & 0xC0) != 0x80)
    return begun[ends - 1]


def paragraph_ends(text: str) -> np.ndarray:
    """Character offsets at which the paragraphs end, the text's end last."""
    out, at = [], text.find("\n\n")
    while at >= 0:
        stop = at + 2
        while stop < len(text) and text[stop] == "\n":
            stop += 1
        if stop < len(text):
            out.append(stop)
        at = text.find("\n\n", stop)
    return np.array([*out, len(text)], np.int64)


def line_ends(text: str) -> np.ndarray:
    """Character offsets at which the lines end, their break included, the text's end last."""
    out, at = [], text.find("\n")
    while at >= 0:
        if at + 1 < len(text):
            out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array([*out, len(text)], np.int64)


SECTIONS = {"paragraphs": paragraph_ends, "lines": line_ends}


def attribute(tokens: np.ndarray, sections: np.ndarray, rule: str = "start") -> tuple[np.ndarray, int]:
    """(tokens by section, tokens that cross a boundary). tokens and sections: sorted ends."""
    n = len(sections)
    if not len(tokens):
        return np.zeros(n), 0
    starts = np.concatenate([[0], tokens[:-1]])
    last = np.maximum(tokens - 1, starts)
    at, to = (np.minimum(np.searchsorted(sections, x, "right"), n - 1) for x in (starts, last))
    # a token that only continues a character has no character of its own: it goes with that character
    empty = tokens == starts
    at[empty] = np.minimum(np.searchsorted(sections, np.maximum(starts[empty] - 1, 0), "right"), n - 1)
    to[empty] = at[empty]
    cross = np.flatnonzero(to > at)
    if rule == "start" or not len(cross):
        return np.bincount(at, minlength=n).astype(float), len(cross)
    whole = np.ones(len(tokens), bool)
    whole[cross] = False
    out = np.bincount(at[whole], minlength=n).astype(float)
    for i in cross:  # few: one at most for each boundary
        cuts = np.clip(sections[at[i] : to[i] + 1], starts[i], tokens[i])
        parts = np.diff(np.concatenate([[starts[i]], cuts]))
        if rule == "most":
            out[at[i] + int(np.argmax(parts))] += 1
        else:
            out[at[i] : to[i] + 1] += parts / parts.sum()
    return out, len(cross)


def counted(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", sections: str = "paragraphs", ends_col: str | None = None, rule: str = "start", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, n_tokens, n_crossing and section_tokens (array of double, in the sections'
    order). ``ends_col``: an array of the sections' ends instead of a named division; ends are sorted,
    clipped to the text and closed by its end."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    divide = SECTIONS[sections]
    with open(ranks_path, "rb") as f:  # on the driver; tasks get the bytes
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = list(dict.fromkeys([*carry, text_col, *([ends_col] if ends_col else [])]))
    source = docs.select(*columns)

    def run(batches):
        encoding, sizes = load(ranks.value, pattern)
        for batch in batches:
            for part in pieces(batch, text_col):
                col = lambda name: part.column(part.schema.get_field_index(name))  # noqa: B023, E731
                own = col(ends_col).to_pylist() if ends_col else [None] * part.num_rows
                n, crossing, by_section = [], [], []
                for text, ends in zip(col(text_col).to_pylist(), own, strict=True):
                    text = text or ""
                    tokens = token_ends(text, encoding, sizes)
                    limits = divide(text) if ends is None else np.array([*sorted(min(max(e or 0, 0), len(text)) for e in ends), len(text)], np.int64)
                    got, cross = attribute(tokens, limits, rule)
                    n.append(len(tokens))
                    crossing.append(cross)
                    by_section.append(got)
                yield pa.RecordBatch.from_arrays([*[col(c) for c in carry], pa.array(n, pa.int64()), pa.array(crossing, pa.int64()), pa.array(by_section, pa.list_(pa.float64()))], [*carry, "n_tokens", "n_crossing", "section_tokens"])

    return source.mapInArrow(run, T.StructType([*[source.schema[c] for c in carry], T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType()), T.StructField("section_tokens", T.ArrayType(T.DoubleType()))]))


def long_form(counts: DataFrame, *keys: str) -> DataFrame:
    """One row per section: keys, section (from 0) and tokens."""
    return counts.select(*keys, F.posexplode("section_tokens").alias("section", "tokens"))
