"""Secret scan with multipart credential linking.

Three base kinds are found in every whole text, each leftmost and non-overlapping: ``assign`` (a
password-like name, a sign and a value of 6 characters or more), ``access`` (AKIA..., 20 or more) and
``hex`` (24 or more). They are always reported.

Weak candidates are too common to report alone: ``opaque`` (a run of 32 or more key characters with
upper case, lower case and a digit), ``login`` (a user-like name with a value) and ``endpoint`` (a URL or
a host with a port). Every span plays one or more parts of a credential: an identifier (access, login),
a secret (assign, hex, opaque) or an endpoint. A weak span is reported when any code
point of a span of another part is within ``SCOPE`` code points of it in the same document: an interval
join on (document, block of ``SCOPE`` code points), each span being in every block that it covers, and
each weak span probing the blocks that its interval touches. It is a semi join, so that no pairs are made;
spans of a kind don't overlap, so a block holds at most ``SCOPE`` of each kind.

Offsets are code points, the end exclusive. Null and empty texts have no spans. Rows that repeat a
doc_id, or have none, are scanned as documents of their own: spans are linked by an own row key, 128 bits
of the id and the text, so copies with one id share links, which are equal anyway. Other columns,
whatever their names, are not read. Whole texts are scanned once; only spans are shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import halves, pieces, settle

SCOPE = 200
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "opaque", "login", "endpoint")
BASE = KINDS[:3]
PARTS = {"assign": "secret", "access": "identifier", "hex": "secret", "opaque": "secret", "login": "identifier", "endpoint": "endpoint"}

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}")
_LOGIN = re.compile(r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""", re.ASCII)
# a host starts where its run of characters does and is never given back, so that long runs cost what they are long
_ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]{3,}|(?<![\w.-])[a-z0-9-]++(?:\.[a-z0-9-]++)++:\d{2,5}\b")
_SIGN = re.compile(r"[:=]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the kinds that need a complement; those inside a base kind's text too."""
    out = [("opaque", m.start(), m.end()) for m in _OPAQUE.finditer(text) if (s := m[0]) and any(c.isdigit() for c in s) and s.lower() != s and s.upper() != s]
    if _SIGN.search(text):
        low = text.lower()
        if any(name in low for name in ("user", "login", "client", "account")):
            out += [("login", m.start(), m.end()) for m in _LOGIN.finditer(text)]
        out += [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, row_key, n_assign, n_access, n_hex and spans, all candidates as
    an array of (kind, start, end)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.select("doc_id", halves(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                base = [base_spans(t or "") for t in part.column(2).to_pylist()]
                weak = [weak_spans(t or "") for t in part.column(2).to_pylist()]
                counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in BASE]
                rows = [[{"kind": rank[k], "start": s, "end": e} for k, s, e in sorted(b + w, key=lambda x: (x[1], rank[x[0]], x[2]))] for b, w in zip(base, weak, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *counts, pa.array(rows, pa.list_(span))], ["doc_id", "row_key", "n_assign", "n_access", "n_hex", "spans"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, row_key binary, n_assign long, n_access long, n_hex long, spans array<struct<kind:int,start:long,end:long>>")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row_key, kind, start, end) of the weak spans that a span of another part is near."""
    part = F.element_at(F.array(*[F.lit(PARTS[k]) for k in KINDS]), F.col("s.kind") + 1)
    # documents with weak spans and two parts at least: only there a link can be
    weak = F.exists("spans", lambda s: s.kind >= len(BASE))
    rows = found.filter(weak & (F.size("spans") > 1)).dropDuplicates(["row_key"]).select("row_key", F.explode("spans").alias("s")).select("row_key", "s.*", part.alias("part"))
    rows = settle(rows, "secret-spans")
    covered = F.sequence((F.col("start") / scope).cast("long"), ((F.col("end") - 1) / scope).cast("long"))
    anchors = rows.select(F.col("row_key").alias("of"), F.explode(covered).alias("block"), F.col("start").alias("at"), F.col("end").alias("until"), F.col("part").alias("has"))
    low = F.greatest(F.col("start") - scope, F.lit(0))
    probes = rows.filter(F.col("kind") >= len(BASE)).withColumn("block", F.explode(F.sequence((low / scope).cast("long"), ((F.col("end") + scope) / scope).cast("long"))))
    near = (probes.row_key == anchors.of) & (probes.block == anchors.block) & (F.col("until") > probes.start - scope) & (F.col("at") < probes.end + scope) & (F.col("has") != probes.part)
    return probes.join(anchors, near, "left_semi").select("row_key", "kind", "start", "end").distinct()


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined; the array is in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s.kind + 1), s.start, s.end)), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base (array of spans) and all_spans
    (base spans and the linked weak ones)."""
    found = settle(find(docs, id_col, text_col), "secret-found")
    links = linked(found, scope).groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("links"))
    both = found.join(links, "row_key", "left")
    base = F.filter("spans", lambda s: s.kind < len(BASE))
    ordered = F.sort_array(F.concat(F.transform(base, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"))), F.coalesce("links", F.array().cast("array<struct<start:long,kind:int,end:long>>"))))
    return both.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base"), ordered.alias("all_spans"))


def report(docs: DataFrame, **how) -> DataFrame:
    """The scan with its spans written out: base_sha256 and spans."""
    got = scan(docs, **how)
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"))
