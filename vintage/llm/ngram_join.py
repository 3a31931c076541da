"""N-gram Jaccard self-join by chosen paths.

A text is the set of its five-word shingles (words are runs of anything but x20 and x09-x0D, compared
as they are; a text of one to four words has one shingle; one without words never links). Texts with
equal sets form one class and go through the join once. Each set is embedded as 64 min-hash tokens.

A run starts with all sets in one node. A node chooses one or two of its tokens' coordinates at random,
by a hash of the node, so that all its sets choose alike; sets with equal tokens there share a child
node. A node of at most ``LEAF`` sets is compared by brute force. A larger one is split again, unless it is
dense: when its sets are about as similar as the threshold asks, on average, most of its pairs are links or
nearly so, and splitting would only copy it. A dense node, and what is still large after ``DEPTH`` levels,
is dealt into blocks of about ``WIDE`` sets, and each two blocks meet. A crowd of texts that share a long
passage, but not enough of it to link, is no dense node: it is split until it is small, several levels at
once where its size and similarity tell that it would be large at all of them.

In a leaf, tokens estimate the similarity. An estimate within five standard deviations of the threshold
is promising; sets that promising pairs connect are candidates of one another. Of a component of more than
``SETS`` candidates the leaves are then compared exactly, and only what is linked there stays together. Last,
all pairs of a component are checked exactly, on the shingles of whole texts: it is dealt into blocks of
about ``SETS`` sets or ``BYTES`` of shingles, and each two blocks meet in a task, which returns the links of
each set by number and a forest that connects what is linked. So no pair is a row, ``n_links`` counts all
links of a text within its component, and a crowd without links costs its leaves only.
Shingles are compared as hashes of 64 bits, so no link is false but by a collision of those.

Recall is audited after ``RUNS`` independent runs: the exact partners of a bounded sample of sets are found by
comparing it with all texts, and of each one's partners the share that the runs have made candidates is
taken. While the mean of these shares is under ``RECALL``, more runs follow. The sample is taken from sets
that agree with another one on three tokens, as three in four sets with a partner at the threshold do, so
that it finds partners where they are rare. If it has none, a larger one is taken, and if that has none
either, ``MORE`` further runs end the search.

Rows with a null id take no part: class_id null, n_links 0. Rows that repeat an id are copies or
different texts like any other rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components, forest
from .shared import as_long, dropped, meetings, mix64, pieces, random_u64, settle, small, text_buffers, whole_groups, words_of

SHINGLE = 5
THRESHOLD = 0.8
TOKENS = 64
RUNS = 8
MORE = 4  # runs that follow at a time
AUDIT = 300  # sets of the audit ...
AUDIT_SHINGLES = 1 << 22  # ... and of shingles in them, if more than one set
AGAIN = 8  # times as many sets where those have no partner
RECALL = 0.995
LEAF = 256
WIDE = 1024  # sets in a block of a node that stays large, on average
SETS = 256  # sets in a block of the exact check, on average
BYTES = 4 << 20  # shingles in such a block
DEPTH = 4  # times that nodes are split after the first ...
LEVELS = 8  # ... by so many levels at most
DENSE = 0.9 * THRESHOLD  # mean similarity of a node that is compared rather than split
GLANCE = 24  # sets of a node by which it is estimated
SECOND = 0.25  # share of nodes that choose two coordinates: 1 / threshold choices on average
MARGIN = 5 * (THRESHOLD * (1 - THRESHOLD) / TOKENS) ** 0.5

_MUL = (random_u64(21, TOKENS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (random_u64(22, TOKENS) >> np.uint64(32)).astype(np.uint32)
_PLACE = random_u64(23, SHINGLE) | np.uint64(1)


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data, offsets = text_buffers(column)
    starts, _, words = words_of(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    rolled = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        rolled += words[k : k + len(rolled)] * _PLACE[k]
    rolled = mix64(rolled)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(rolled[lo : hi - n + 1]))
        elif hi > lo:
            out.append(mix64(np.array([(words[lo:hi] * _PLACE[: hi - lo]).sum() + np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    return np.array([mix64(shingles + np.uint64(1)).sum(), mix64(shingles ^ np.uint64(0x5BF03635)).sum() + np.uint64(len(shingles))], np.uint64).byteswap().tobytes()


def tokens(shingles: np.ndarray) -> np.ndarray:
    """The min-hash tokens of a set, 32 bits each."""
    low = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(h), 4096):
        np.minimum(low, (h[k : k + 4096, None] * _MUL + _ADD).min(0), out=low)
    return low


def embed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (null without words) and sig of each row with an id."""
    source = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.array([tokens(s).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "fp", "sig"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp binary, sig binary")


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """A column of equally long binary values as a matrix."""
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _children(path: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for the coordinates that each row's node chooses."""
    draw = mix64(path ^ np.uint64(0x51ED270B))
    one = (draw % np.uint64(TOKENS)).astype(np.int64)
    two = (one + 1 + (mix64(draw) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
    also = np.flatnonzero((draw >> np.uint64(40)).astype(float) / (1 << 24) < SECOND)
    row = np.concatenate([np.arange(len(path)), also])
    at = np.concatenate([one, two[also]])
    return row, mix64(mix64(path[row] + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ sig[row, at].astype(np.uint64))


def _split(nodes: DataFrame) -> DataFrame:
    """path, fp, sig, levels -> path and fp of the descendants at that many levels."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                path, levels, sig = batch.column(0).to_numpy().view(np.uint64), batch.column(3).to_numpy(), _matrix(batch.column(2), np.uint32)
                of, level = np.arange(len(path)), 0
                while len(of):
                    done = levels[of] <= level
                    if done.any():
                        yield pa.RecordBatch.from_arrays([as_long(path[done]), batch.column(1).take(pa.array(of[done]))], ["path", "fp"])
                    of, path, level = of[~done], path[~done], level + 1
                    row, path = _children(path, sig[of])
                    of = of[row]

    return nodes.select("path", "fp", "sig", "levels").mapInArrow(run, "path long, fp binary")


def _in_leaf(rows: DataFrame) -> DataFrame:
    """leaf, block, fp, sig -> pairs a, b that connect all sets with promising pairs between them; of two
    blocks, pairs of sets in different ones (those within a block meet in a leaf of its own)."""
    least = int(np.ceil(TOKENS * (THRESHOLD - MARGIN)))

    def pairs(fp, block, sig):
        same = np.zeros((len(fp), len(fp)), np.uint8)
        for column in sig.T:
            same += column[:, None] == column
        near = same >= least
        if block[0] != block[-1]:
            near &= block[:, None] != block
        np.fill_diagonal(near, False)
        for i, j in forest(near):
            yield fp[i], fp[j]

    def run(batches):
        for batch, bounds in whole_groups(batches):
            sig = _matrix(batch.column(3), np.uint32).astype(np.uint8)
            fps, block = batch.column(2).to_pylist(), batch.column(1).to_numpy()
            out = [p for lo, hi in zip(bounds[:-1], bounds[1:], strict=True) if hi - lo > 1 for p in pairs(fps[lo:hi], block[lo:hi], sig[lo:hi])]
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    dealt = rows.repartition("leaf").sortWithinPartitions("leaf", "block", "fp")
    return dealt.select("leaf", "block", "fp", "sig").mapInArrow(run, "a binary, b binary")


def _likeness(big: DataFrame, sets: DataFrame) -> DataFrame:
    """(path, likeness) of large nodes: the mean similarity of some of their sets, by the coordinates in which
    they don't all agree, since they do in those that led to the node. big: path, fp, n."""
    some = big.filter(F.pmod(F.xxhash64("path", "fp"), F.col("n")) < GLANCE).select("path", "fp").join(sets, "fp")

    def run(batches):
        for batch, bounds in whole_groups(batches):
            sig = _matrix(batch.column(1), np.uint32)
            mean = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                own, m = sig[lo:hi], hi - lo
                open_ = own.T[(own != own[0]).any(0)]
                same = sum(int((column[:, None] == column).sum()) - m for column in open_)
                mean.append(same / (len(open_) * m * (m - 1)) if len(open_) else float(m > 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(bounds[:-1])), pa.array(mean, pa.float64())], ["path", "likeness"])

    return some.select("path", "sig").repartition("path").sortWithinPartitions("path").mapInArrow(run, "path long, likeness double")


def leaves(sets: DataFrame, runs: int = RUNS, done: int = 0) -> DataFrame:
    """(leaf, block, fp), settled: the groups in which the sets of ``runs`` runs, those after the first
    ``done``, are compared; sets: fp, sig, one row per set."""
    roots = F.explode(F.array(*[F.lit(int(x)) for x in random_u64(31, done + runs)[done:].view(np.int64)])).alias("path")
    nodes = settle(_split(sets.select(roots, "fp", "sig", F.lit(1).alias("levels"))), "path-0")
    found = None
    for depth in range(1, DEPTH + 1):
        many = settle(nodes.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), f"path-many{depth}")
        shared = nodes.join(small(many), "path")
        path = F.unhex(F.lpad(F.hex("path"), 16, "0"))
        got = shared.filter(F.col("n") <= LEAF).select(path.alias("leaf"), F.lit(0).cast("long").alias("block"), "fp")
        found = got if found is None else found.unionByName(got)
        if many.filter(F.col("n") > LEAF).isEmpty():
            break
        big = settle(shared.filter(F.col("n") > LEAF), f"path-big{depth}")
        big = big.join(small(settle(_likeness(big, sets), f"path-like{depth}")), "path", "left")
        like = F.coalesce("likeness", F.lit(0.0))
        dense = F.lit(True) if depth == DEPTH else like >= DENSE
        # every block with every other and with itself
        wide = meetings(big.filter(dense), "fp", path, F.ceil(F.col("n") / WIDE))
        found = found.unionByName(wide.select(F.col("meeting").alias("leaf"), "block", "fp"))
        rest = big.filter(~dense)
        if rest.isEmpty():
            break
        # of sets that share a part, each with others of its own, this share has one token at a coordinate
        most = F.least(F.greatest(2 * like / (1 + like), F.lit(0.3)), F.lit(0.9))
        levels = F.least(F.greatest(F.floor(F.ln(F.col("n") / LEAF) / -F.ln(most)), F.lit(1)), F.lit(LEVELS)).cast("int")
        nodes = settle(_split(rest.select("path", "fp", levels.alias("levels")).join(sets, "fp")), f"path-{depth}")
    return settle(found, "path-leaves")


def candidates(sets: DataFrame, placed: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of set fingerprints that connect the candidates of some leaves."""
    return _in_leaf(placed.join(sets.select("fp", "sig"), "fp")).distinct()


def audit_sample(sets: DataFrame, sample: int) -> DataFrame:
    """doc_id, fp and sig of some sets, of those first that agree with another one on three tokens."""
    band = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.substring("sig", 12 * k + 1, 12).alias("band")) for k in (0, 1)])).alias("b")
    bands = sets.select("fp", band).select("fp", "b.*")
    shared = settle(bands.groupBy("k", "band").count().filter("count > 1").select("k", "band"), "path-bands")
    alike = bands.join(small(shared), ["k", "band"], "left_semi").select("fp").distinct().orderBy(F.xxhash64("fp"), "fp").limit(sample)
    return sets.join(F.broadcast(settle(alike, "path-alike")), "fp", "left_semi").select("doc_id", "fp", "sig")


def exact_partners(docs: DataFrame, sets: DataFrame, sample: int, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b), settled: the other sets b at the threshold of each set a of a sample, found by comparing it with
    all texts. sets: doc_id, fp, sig."""
    picked = {bytes(r.fp): (r.doc_id, bytes(r.sig)) for r in audit_sample(sets, sample).collect()}
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i, _ in picked.values()], f"__id {sets.schema['doc_id'].dataType.simpleString()}")
    some = settle(_shingled(docs, F.broadcast(ids), id_col, text_col).dropDuplicates(["fp"]), "path-picked")  # at most some thousand
    before = F.sum(F.length("shingles") / 8).over(Window.orderBy(F.xxhash64("fp"), "fp").rowsBetween(Window.unboundedPreceding, -1))
    sized = some.select("fp", "shingles", F.coalesce(before, F.lit(0)).alias("before"))
    own = {bytes(r.fp): np.frombuffer(bytes(r.shingles), np.uint64) for r in sized.filter(F.col("before") + F.when(F.col("before") > 0, F.length("shingles") / 8).otherwise(0) <= AUDIT_SHINGLES).collect()}
    fps = [fp for fp in own if fp in picked]
    sigs = np.array([np.frombuffer(picked[f][1], np.uint32) for f in fps], np.uint32).reshape(len(fps), TOKENS)
    flat = np.concatenate([own[f] for f in fps]) if fps else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(fps)), [len(own[f]) for f in fps])
    order = np.argsort(flat)
    asked = spark.sparkContext.broadcast((fps, sigs, flat[order], of[order], np.array([len(own[f]) for f in fps])))
    least = int(np.ceil(TOKENS * (threshold - MARGIN)))

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                sig, near = _matrix(batch.column(1), np.uint32), np.zeros(batch.num_rows, bool)
                for q in asked.value[1]:
                    near |= (sig == q).sum(1) >= least
                if near.any():
                    yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near))], ["__id"])

    def compared(batches):
        fps, _, flat, of, size = asked.value
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                lo, hi = np.searchsorted(flat, x), np.searchsorted(flat, x, "right")
                n = hi - lo
                hits = of[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                common = np.bincount(hits, minlength=len(fps))
                near = [a for a in np.flatnonzero(common >= threshold * (size + len(x) - common)) if fps[a] != b]
                if near:
                    yield pa.RecordBatch.from_arrays([pa.array([fps[a] for a in near], pa.binary()), pa.array([b] * len(near), pa.binary())], ["a", "b"])

    kind = sets.schema["doc_id"].dataType.simpleString()
    wanted = settle(sets.select("doc_id", "sig").mapInArrow(likely, f"__id {kind}"), "path-likely")
    return settle(_shingled(docs, small(wanted.distinct()), id_col, text_col).mapInArrow(compared, "a binary, b binary").distinct(), "path-partners")


def audited(partners: DataFrame, of: DataFrame) -> float | None:
    """Mean share of a set's exact partners that are its candidates; None without partners. partners: a, b;
    of: fp, component of candidates."""
    own = partners.join(small(of).select(F.col("fp").alias("a"), F.col("component").alias("x")), "a", "left").join(small(of).select(F.col("fp").alias("b"), F.col("component").alias("y")), "b", "left")
    share = own.groupBy("a").agg(F.avg(F.coalesce((F.col("x") == F.col("y")).cast("int"), F.lit(0))).alias("share"))
    return share.agg(F.avg("share")).first()[0]


def candidate_components(sets: DataFrame, partners: DataFrame, runs: int = RUNS, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """((fp, component) of all candidates, the leaves (leaf, block, fp) that they met in), settled, after as
    many runs as the audited recall needs."""
    placed, done = leaves(sets, runs), runs
    pairs = settle(candidates(sets, placed), "path-pairs")
    while True:
        of = settle(components(pairs).select(F.col("node").alias("fp"), "component"), "path-candidates")
        share = audited(partners, of)
        if share >= recall if share is not None else done > runs:
            return of, placed
        more = leaves(sets, MORE, done)
        old, pairs = pairs, settle(pairs.unionByName(candidates(sets, more)).distinct(), "path-pairs")
        placed = placed.unionByName(more)
        dropped(old, of)
        done += MORE


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, by exact counts."""
    if len(x) * len(y) <= 9:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in y] for a in x])
    flat = [np.concatenate(z) for z in (x, y)]
    row = [np.repeat(np.arange(len(z)), [len(v) for v in z]) for z in (x, y)]
    both = np.intersect1d(*flat)
    out, wide = np.zeros((len(x), len(y)), np.int64), 8192
    if len(both):
        at = [np.minimum(np.searchsorted(both, f), len(both) - 1) for f in flat]
        keep = [both[a] == f for a, f in zip(at, flat, strict=True)]
        order = [np.flatnonzero(k)[np.argsort(a[k], kind="stable")] for a, k in zip(at, keep, strict=True)]
        at, row = [a[o] for a, o in zip(at, order, strict=True)], [r[o] for r, o in zip(row, order, strict=True)]
        for lo in range(0, len(both), wide):
            m = []
            for a, r, z in zip(at, row, (x, y), strict=True):
                part = slice(*np.searchsorted(a, [lo, lo + wide]))
                m.append(np.zeros((len(z), min(wide, len(both) - lo)), np.float32))
                m[-1][r[part], a[part] - lo] = 1
            out += np.rint(m[0] @ m[1].T).astype(np.int64)
    return out


def _shingled(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, shingles) of the texts with words among the rows with given ids (__id)."""
    source = docs.join(ids, F.col(id_col) == F.col("__id"), "left_semi").select(F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                got = [s for s in shingle_sets(part.column(0)) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in got], pa.binary()), pa.array([s.tobytes() for s in got], pa.binary())], ["fp", "shingles"])

    return source.mapInArrow(run, "fp binary, shingles binary")


def exact_links(met: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All sets of each meeting against one another, or of two blocks those of one against those of the
    other, by exact Jaccard similarity. Rows (a, b, n): with b, sets that links connect; without b, n links
    of a there. met: meeting, block, fp, shingles."""

    def links(batches):
        for batch, bounds in whole_groups(batches):
            fps, block = batch.column(2).to_pylist(), batch.column(1).to_numpy()
            a, b, n = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1:
                    got = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(3).slice(lo, hi - lo)]
                    cut = int(np.searchsorted(block[lo:hi], block[lo], "right"))
                    x, y = (slice(0, cut), slice(cut, hi - lo)) if cut < hi - lo else (slice(0, cut),) * 2
                    size = np.array([len(v) for v in got])
                    common = _common(got[x], got[y])
                    near = np.zeros((hi - lo, hi - lo), bool)
                    near[x, y] = common / (size[x, None] + size[None, y] - common) >= threshold
                    near |= near.T
                    np.fill_diagonal(near, False)
                    degree = near.sum(1)
                    some, tree = np.flatnonzero(degree), forest(near)
                    a += [fps[lo + i] for i in some] + [fps[lo + i] for i, _ in tree]
                    b += [None] * len(some) + [fps[lo + j] for _, j in tree]
                    n += [*degree[some].tolist(), *[0] * len(tree)]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])

    dealt = met.select("meeting", "block", "fp", "shingles").repartition("meeting").sortWithinPartitions("meeting", "block", "fp")
    return dealt.mapInArrow(links, "a binary, b binary, n long")


def linked_in_leaves(whole: DataFrame, placed: DataFrame, large: DataFrame) -> DataFrame:
    """(fp, component) of what exact links connect in the leaves of the sets of large components of
    candidates. whole: fp, shingles, component; placed: leaf, block, fp; large: component."""
    members = settle(whole.join(small(large), "component", "left_semi").select("fp", "shingles"), "path-large")
    own = small(settle(members.select("fp"), "path-members"))
    met = placed.join(own, "fp", "left_semi").join(members, "fp").withColumnRenamed("leaf", "meeting")
    return components(settle(exact_links(met).filter("b IS NOT NULL").select("a", "b"), "path-exact")).select(F.col("node").alias("fp"), "component")


def verified(docs: DataFrame, sets: DataFrame, of: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All candidates of one component against one another, as ``exact_links`` returns them, links counted
    once for each two blocks that have some. sets: fp, doc_id of one of its rows; of: fp, component of
    candidates; placed: leaf, block, fp."""
    ids = settle(sets.join(of, "fp", "left_semi").select(F.col("doc_id").alias("__id")), "path-wanted").distinct()
    whole = settle(_shingled(docs, small(ids), id_col, text_col).dropDuplicates(["fp"]).join(of, "fp"), "path-sets")
    large = settle(whole.groupBy("component").count().filter(F.col("count") > SETS).select("component"), "path-crowds")
    if not large.isEmpty():
        linked = settle(linked_in_leaves(whole, placed, large), "path-inleaves")
        rest = whole.join(small(large), "component", "left_anti").select("fp", "shingles", "component")
        whole = settle(rest.unionByName(whole.drop("component").join(linked, "fp").select("fp", "shingles", "component")), "path-whole")
    sizes = whole.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum(F.length("shingles")) / BYTES)).alias("blocks"))
    sizes = settle(sizes.filter("blocks > 1"), "path-sizes")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    return exact_links(meetings(whole.join(small(sizes), "component", "left"), "fp", F.col("component"), blocks))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest doc_id of its class), n_links
    (links of its text with different texts) and copies (rows with its set of shingles)."""
    rows = settle(embed(docs, id_col, text_col), "path-rows")
    worded = rows.filter("fp IS NOT NULL")
    sets = settle(worded.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.count("*").alias("copies")), "path-unique")
    partners = exact_partners(docs, sets, AUDIT, id_col, text_col)
    if partners.isEmpty():
        partners = exact_partners(docs, sets, AGAIN * AUDIT, id_col, text_col)
    met, placed = candidate_components(sets.select("fp", "sig"), partners, runs)
    links = settle(verified(docs, sets.select("fp", "doc_id"), met, placed, id_col, text_col), "path-links")
    of = components(links.filter("b IS NOT NULL").select("a", "b"))
    degree = links.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    linked = settle(of.join(degree, "node").select(F.col("node").alias("fp"), "component", "n_links"), "path-linked")
    per_set = sets.select("fp", "doc_id", "copies").join(small(linked), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    per_set = settle(per_set, "path-persets")
    # only classes of two sets or more need their smallest id looked up
    heads = settle(per_set.filter("n_links > 0").groupBy("component").agg(F.min("doc_id").alias("class_id")), "path-heads")
    classes = settle(per_set.join(small(heads), "component", "left").select("fp", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "copies"), "path-classes")
    out = rows.select("doc_id", "fp").join(small(classes), "fp", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
    lost = docs.filter(F.col(id_col).isNull()).select(F.col(id_col).alias("doc_id"), F.col(id_col).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    return out.unionByName(lost)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose class has no smaller doc_id, with all their columns; rows with a null
    id stay. Of rows that repeat a class's smallest id all stay (exact dedup takes those)."""
    gone = settle(join(docs, id_col, text_col, **how).filter("doc_id != class_id").select(F.col("doc_id").alias("__gone")), "path-gone")
    return docs.join(small(gone), F.col(id_col) == F.col("__gone"), "left_anti")
