"""Embedding near-dedup by NN-descent.

A neighbour graph over the distinct vectors is refined until it holds the pairs with a cosine of
``THRESHOLD`` or more among vectors of one label. A round starts from random-hyperplane buckets, in which
each vector takes its ``K`` best; buckets that are larger than a leaf are split at medians of further
projections. Every iteration then joins, around each vector, its neighbours and those that have it as a
neighbour with one another, leaves out pairs that have met before, and keeps what improves a list. A list
holds ``K`` neighbours; one that is saturated, with all of them at the threshold, is enlarged up to
``WIDE``. What a dense family has beyond that is not searched as pairs: edges at the threshold are kept,
they connect vectors to components, and all vectors of a component are compared with one another, blocks
against blocks inside tasks, which return numbers of links. So ``n_links`` counts every link within a
component, no pair of a family is a row, and no link is false.

When an iteration adds hardly any edge at the threshold, components that meet at the threshold in a bucket
are joined, so that a link that stands in no list, between two dense families, isn't lost. Then recall is
audited: a bounded sample of vectors is compared with all rows in blocks, and the share of its true links
that was counted is averaged over the vectors that have some, so that a dense family doesn't stand for
all. Half of the sample are vectors that agree with another one on many projections, made for the audit
alone, so that it finds links where they are rare. Under ``RECALL`` another round starts with other
hyperplanes. If the sample has no link at all, a second round must find as few as the first. After
``TURNS`` rounds all vectors of a label are compared, blocks against blocks: the search always ends with the
recall that was asked for.

Cosines are computed in double precision. Equal vectors of one label are collapsed first and count as
links of one another (cosine 1). Vectors that are null, empty, zero, or hold a null or non-finite
component, and rows with a null label or id, link with nothing; vectors of unequal length are not
compared. Rows that repeat a vec_id stay separate rows; a component's id is the smallest vec_id in it.
Other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, forest
from .shared import dropped, halves, meetings, settle, small, whole_groups

THRESHOLD = 0.98
K = 6
WIDE = 12  # neighbours of a saturated list; its component is compared exactly
TABLES = 4
BUCKET = 64  # vectors in a bucket, on average
LEAF = 256  # larger buckets are split; a label that is no larger is one bucket
LOCAL = 32  # neighbours that meet around one vector at once; longer lists are dealt anew each iteration
ITERATIONS = 8
FEW = 0.01  # new edges, as a share of those at the threshold, under which a round ends
BLOCK = 1024  # vectors in a block of the exact count, on average
AUDIT = 1000
RECALL = 0.98
TURNS = 5  # rounds before all vectors of a label are compared
TILE = 512  # rows compared at once


def distinct_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(all rows as vec_id, key; distinct vectors as n, key, part, vec, weight, vec_id). key is null for
    rows that link with nothing; n numbers the vectors; part: label and length, within which vectors are
    compared."""
    vector = F.col(vector_col).cast("array<double>")
    good = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    part = F.concat_ws(":", F.col(label_col).cast("string"), F.size(vector))
    # 0.0 and -0.0 are one value
    flat = F.transform(vector, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    keyed = rows.select(F.col(id_col).alias("vec_id"), F.when(good, halves(part, flat)).alias("key"), part.alias("part"), flat.alias("vec"))
    unique = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.first("part").alias("part"), F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("vec_id").alias("vec_id"))
    # numbers are fixed once the table is written
    return keyed.select("vec_id", "key"), settle(unique.withColumn("n", F.monotonically_increasing_id()), "nn-vectors")


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of equally long double arrays, as a matrix."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(column: pa.Array):
    """(rows, unit vectors) for each length of vector in a column."""
    ends = column.offsets.to_numpy()
    length = np.diff(ends)
    for d in np.unique(length):
        rows = np.flatnonzero(length == d)
        yield rows, _units(column if len(rows) == len(column) else column.take(pa.array(rows)))


def _planes(d: int, n: int, *seed: int) -> np.ndarray:
    return np.random.default_rng([d, *seed]).standard_normal((n, d))


EDGE = "v long, u long, sim double"


def _edges(v: np.ndarray, u: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(sim, pa.float64())], ["v", "u", "sim"])


def _best(ids: np.ndarray, x: np.ndarray, fresh: np.ndarray, floor: np.ndarray, k: int):
    """Edges (v, u, sim) from each vector to its k best others above its floor, for stacks of groups:
    ids, fresh and floor have one row per group, x its vectors. Of each pair one must be fresh."""
    m = ids.shape[1]
    for lo in range(0, m, TILE):
        hi = min(lo + TILE, m)
        sim = x[:, lo:hi] @ x.transpose(0, 2, 1)
        sim[~(fresh[:, lo:hi, None] | fresh[:, None, :]) | (ids[:, lo:hi, None] == ids[:, None, :]) | (sim <= floor[:, lo:hi, None])] = -2
        top = np.argpartition(sim, m - k, axis=2)[:, :, -k:] if m > k else np.broadcast_to(np.arange(m), sim.shape)
        best = np.take_along_axis(sim, top, 2)
        g, i, j = np.nonzero(best > -2)
        yield ids[g, lo + i], ids[g, top[g, i, j]], best[g, i, j]


def _joined(k: int, keys: int):
    """Groups (their ``keys``, n, vec, fresh, floor) -> edges; groups of one size are compared in stacks."""

    def run(batches):
        for batch, bounds in whole_groups(batches, keys):
            size = np.diff(bounds)
            ids, fresh, floor = batch.column(keys).to_numpy(), batch.column(keys + 2).to_numpy(zero_copy_only=False), batch.column(keys + 3).to_numpy()
            for rows, x in _by_length(batch.column(keys + 1)):
                at = np.full(batch.num_rows, -1)
                at[rows] = np.arange(len(rows))
                for m in np.unique(size[size > 1]):
                    heads = bounds[:-1][(size == m) & (at[bounds[:-1]] >= 0)]
                    step = max((16 << 20) // (8 * m * max(x.shape[1], min(m, TILE))), 1)
                    for lo in range(0, len(heads), step):
                        take = heads[lo : lo + step, None] + np.arange(m)
                        for found in _best(ids[take], x[at[take]], fresh[take], floor[take], k):
                            yield _edges(*found)

    return run


def _signs(unique: DataFrame, bits: DataFrame, seeds: list[tuple[int, ...]]) -> DataFrame:
    """n, part and signs: for each seed the signs of a vector's random projections, of its part's first
    ``bits``, as a number. bits: part, bits."""

    def run(batches):
        for batch in batches:
            out, own = np.zeros((batch.num_rows, len(seeds)), np.int64), batch.column(1).to_numpy()
            for rows, x in _by_length(batch.column(2)):
                for t, seed in enumerate(seeds):
                    up = x @ _planes(x.shape[1], 62, *seed).T > 0
                    up &= np.arange(62) < own[rows, None]
                    out[rows, t] = up @ (1 << np.arange(62))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(seeds)).cast(pa.list_(pa.int64())), batch.column(3)], ["n", "signs", "part"])

    return unique.join(small(bits), "part").select("n", "bits", "vec", "part").mapInArrow(run, "n long, signs array<long>, part string")


def _bits(unique: DataFrame, bucket: int, whole: int, times: int = 1) -> DataFrame:
    """(part, bits): ``times`` as many projections as make buckets of about ``bucket`` vectors; none for parts
    of up to ``whole``."""
    bits = F.least(times * F.greatest(F.ceil(F.log2(F.col("count") / bucket)), F.lit(0)), F.lit(62)).cast("int")
    return settle(unique.groupBy("part").count().select("part", F.when(F.col("count") <= whole, 0).otherwise(bits).alias("bits")), "nn-parts")


def leaves(unique: DataFrame, turn: int) -> DataFrame:
    """(bucket, n), settled: vectors that agree on the signs of random projections. A bucket that is larger
    than a leaf is halved at the median of one more projection until it isn't."""
    signed = _signs(unique, _bits(unique, BUCKET, LEAF), [(turn, t) for t in range(TABLES)])
    placed = settle(signed.select("n", F.posexplode("signs").alias("t", "s"), "part").select("n", halves(F.col("part"), F.col("t"), F.col("s")).alias("bucket")), "nn-buckets")
    found, level = None, 0
    while True:
        sizes = settle(placed.groupBy("bucket").count().filter("count > 1"), "nn-sizes")
        sized = placed.join(small(sizes), "bucket")
        got = sized.filter(F.col("count") <= LEAF).select("bucket", "n")
        found = got if found is None else found.unionByName(got)
        if sizes.filter(F.col("count") > LEAF).isEmpty():
            return settle(found, "nn-leaves")

        def project(batches, level=level):
            for batch in batches:
                p = np.zeros(batch.num_rows)
                for rows, x in _by_length(batch.column(2)):
                    p[rows] = x @ _planes(x.shape[1], 1, turn, TABLES + level)[0]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], ["bucket", "n", "p"])

        large = settle(sized.filter(F.col("count") > LEAF).join(unique.select("n", "vec"), "n").select("bucket", "n", "vec").mapInArrow(project, "bucket binary, n long, p double"), "nn-large")
        middle = small(settle(large.groupBy("bucket").agg(F.percentile_approx("p", 0.5).alias("middle")), "nn-middle"))
        # equal projections, as of vectors that differ in length only, are dealt by number
        half = F.when(F.col("p") == F.col("middle"), F.pmod(F.xxhash64("n", F.lit(level)), F.lit(2)) == 0).otherwise(F.col("p") > F.col("middle"))
        placed = settle(large.join(middle, "bucket").select("n", halves(F.col("bucket"), half, F.lit(level)).alias("bucket")), "nn-halved")
        level += 1


def buckets(unique: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """Edges (v, u, sim) from each vector to its best others in the leaves (bucket, n)."""
    full = placed.join(unique.select("n", "vec"), "n").select("bucket", "n", "vec", F.lit(True).alias("fresh"), F.lit(-2.0).alias("floor"))
    return full.repartition("bucket").sortWithinPartitions("bucket", "n").mapInArrow(_joined(k, 1), EDGE)


def borders(unique: DataFrame, placed: DataFrame, of: DataFrame, threshold: float) -> DataFrame:
    """(a, b): components, or vectors that are in none, that meet at the threshold in a leaf. placed: bucket,
    n; of: n, component."""
    full = placed.join(unique.select("n", "vec"), "n").join(small(of), "n", "left").select("bucket", "n", "vec", F.coalesce("component", "n").alias("component"))

    def run(batches):
        for batch, bounds in whole_groups(batches):
            component = batch.column(3).to_numpy()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1 and len(np.unique(component[lo:hi])) > 1:
                    for rows, x in _by_length(batch.column(2).slice(lo, hi - lo)):
                        own = component[lo:hi][rows]
                        i, j = np.nonzero((x @ x.T >= threshold) & (own[:, None] < own[None, :]))
                        if len(i):
                            a, b = np.unique(np.stack([own[i], own[j]]), axis=1)
                            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return full.repartition("bucket").sortWithinPartitions("bucket", "n").mapInArrow(run, "a long, b long").distinct()


def all_links(unique: DataFrame, threshold: float) -> DataFrame:
    """(a, b) that connect all vectors of a part with links between them: blocks of the part against blocks."""
    sizes = settle(unique.groupBy("part").count().select("part", F.ceil(F.col("count") / BLOCK).alias("blocks")), "nn-all")
    met = meetings(unique.select("n", "part", "vec").join(small(sizes), "part"), "n", halves(F.col("part")), F.col("blocks"))

    def run(batches):
        for batch, bounds in whole_groups(batches):
            ids = batch.column(1).to_numpy()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1:
                    x = _units(batch.column(2).slice(lo, hi - lo))
                    near = np.concatenate([x[r : r + TILE] @ x.T >= threshold for r in range(0, hi - lo, TILE)])
                    near |= near.T
                    np.fill_diagonal(near, False)
                    tree = forest(near)
                    if tree:
                        a, b = np.array(tree).T
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo + a]), pa.array(ids[lo + b])], ["a", "b"])

    dealt = met.select("meeting", "n", "vec").repartition("meeting").sortWithinPartitions("meeting", "n")
    return dealt.mapInArrow(run, "a long, b long")


def _lists(edges: DataFrame, k: int, wide: int, threshold: float) -> DataFrame:
    """The graph: of each vector's distinct edges the k best, and up to ``wide`` at the threshold. fresh:
    the edge is new."""
    once = edges.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    kept = once.withColumn("rank", rank).filter(F.col("rank") <= wide)
    return kept.filter((F.col("rank") <= k) | (F.col("sim") >= threshold)).select("v", "u", "sim", "fresh")


def local_joins(graph: DataFrame, unique: DataFrame, turn: int, k: int, wide: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(the settled ways that meet, new edges among the neighbours, in either direction, of each vector,
    itself among them)."""
    full = (F.count("*") >= wide) & (F.min("sim") >= threshold)
    # a full list takes no more: its component is compared exactly
    floors = graph.groupBy("v").agg(F.when(full, F.lit(2.0)).when(F.count("*") < k, F.lit(-2.0)).when(F.min("sim") >= threshold, F.lit(threshold)).otherwise(F.min("sim")).alias("floor"))
    floors = floors.withColumnRenamed("v", "n")
    ways = graph.select("v", "u", "fresh").unionByName(graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "fresh")).groupBy("v", "u").agg(F.bool_or("fresh").alias("fresh"))
    around = settle(ways, "nn-around")
    degree = around.groupBy("v").agg(F.ceil(F.count("*") / LOCAL).alias("blocks"), F.bool_or("fresh").alias("any")).filter("any").select("v", "blocks")
    # a longer list, a hub's too, is dealt into groups, others in each iteration; the vector itself is in all
    dealt = around.join(degree, "v").select("v", F.col("u").alias("n"), "fresh", F.pmod(F.xxhash64("u", "v", F.lit(turn)), F.col("blocks")).alias("block"))
    own = degree.select("v", F.col("v").alias("n"), F.lit(False).alias("fresh"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    vectors = unique.select("n", "vec").join(floors, "n", "left").select("n", "vec", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    groups = dealt.unionByName(own).join(vectors, "n").select("v", "block", "n", "vec", "fresh", "floor")
    return around, groups.repartition("v", "block").sortWithinPartitions("v", "block", "n").mapInArrow(_joined(k, 2), EDGE)


def audit(unique: DataFrame, sample: int, threshold: float) -> DataFrame:
    """(n, true_links): links with other distinct vectors of a bounded sample of vectors that has some,
    found by comparing it with every vector in blocks. Half of the sample agree with another vector on some
    projections of the audit's own."""
    # so many that vectors which are far apart hardly ever agree on all
    alike = _signs(unique, _bits(unique, 1, 2, 2), [(1 << 20,)]).select("n", halves(F.col("part"), F.col("signs")[0]).alias("bucket"))
    alike = settle(alike, "nn-alike")
    shared = alike.join(small(settle(alike.groupBy("bucket").count().filter("count > 1"), "nn-shared")), "bucket", "left_semi")
    one = shared.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("n"), "n")).getField("n").alias("n"))
    some = one.orderBy(F.xxhash64("n"), "n").limit(sample // 2).unionByName(unique.select("n", "key").orderBy(F.xxhash64("key"), "key").limit(sample).select(F.lit(None).cast("binary").alias("bucket"), "n"))
    numbers = list(dict.fromkeys(r.n for r in some.collect()))[:sample]
    asked = F.broadcast(unique.sparkSession.createDataFrame([(n,) for n in numbers], "n long"))
    picked = [(r.n, r.part, r.vec) for r in unique.join(asked, "n", "left_semi").select("n", "part", "vec").collect()]
    by_part: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for part in {p for _, p, _ in picked}:
        own = [(n, v) for n, p, v in picked if p == part]
        by_part[part] = np.array([n for n, _ in own]), _units(pa.array([v for _, v in own], pa.list_(pa.float64())))
    asked = unique.sparkSession.sparkContext.broadcast(by_part)

    def run(batches):
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            for rows, x in _by_length(batch.column(2)):
                for part in set(parts[rows]) & asked.value.keys():
                    mine = np.flatnonzero(parts[rows] == part)
                    names, q = asked.value[part]
                    near = (q @ x[mine].T >= threshold) & (names[:, None] != ids[rows[mine]])
                    some = near.any(1)
                    if some.any():
                        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(near[some].sum(1))], ["n", "true_links"])

    return unique.select("n", "part", "vec").mapInArrow(run, "n long, true_links long").groupBy("n").agg(F.sum("true_links").alias("true_links"))


def counted(unique: DataFrame, of: DataFrame, threshold: float) -> DataFrame:
    """(n, others, n_links) of the vectors in ``of`` (n, component): other distinct vectors of the
    component at the threshold, and how many rows they stand for. Blocks of a component meet in tasks."""
    sizes = settle(of.groupBy("component").count().select("component", F.ceil(F.col("count") / BLOCK).alias("blocks")).filter("blocks > 1"), "nn-dense")
    members = of.join(small(sizes), "component", "left").join(unique.select("n", "vec", "weight"), "n")
    met = meetings(members, "n", F.unhex(F.lpad(F.hex("component"), 16, "0")), F.coalesce("blocks", F.lit(1).cast("long")))

    def run(batches):
        for batch, bounds in whole_groups(batches):
            block, ids, weight = (batch.column(i).to_numpy() for i in (1, 2, 4))
            n, others, links = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1:
                    x = _units(batch.column(3).slice(lo, hi - lo))
                    cut = int(np.searchsorted(block[lo:hi], block[lo], "right"))
                    both = [(0, cut, cut, hi - lo), (cut, hi - lo, 0, cut)] if cut < hi - lo else [(0, cut, 0, cut)]
                    for a, b, c, d in both:
                        for r in range(a, b, TILE):
                            s = min(r + TILE, b)
                            near = (x[r:s] @ x[c:d].T >= threshold) & (ids[lo + r : lo + s, None] != ids[None, lo + c : lo + d])
                            n.append(ids[lo + r : lo + s])
                            others.append(near.sum(1))
                            links.append(near @ weight[lo + c : lo + d])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (n, others, links)], ["n", "others", "n_links"])

    dealt = met.select("meeting", "block", "n", "vec", "weight").repartition("meeting").sortWithinPartitions("meeting", "block", "n")
    return dealt.mapInArrow(run, "n long, others long, n_links long").groupBy("n").agg(F.sum("others").alias("others"), F.sum("n_links").alias("n_links"))


def links(unique: DataFrame, threshold: float = THRESHOLD, k: int = K, wide: int = WIDE, recall: float = RECALL) -> DataFrame:
    """(n, component, n_links) of every vector that links with another one. unique: a settled table of n,
    key, part, vec and weight."""
    truth = settle(audit(unique, AUDIT, threshold), "nn-audit")
    graph, before = None, None
    named = lambda found: settle(components(found).select(F.col("node").alias("n"), "component"), "nn-components")
    for turn in range(TURNS):
        placed = leaves(unique, turn)
        start = buckets(unique, placed, k).withColumn("fresh", F.lit(True))
        old, graph = graph, settle(_lists(start if graph is None else graph.unionByName(start), k, wide, threshold), "nn-graph")
        for step in range(ITERATIONS):
            around, more = local_joins(graph, unique, ITERATIONS * turn + step, k, wide, threshold)
            old, graph = graph, settle(_lists(graph.withColumn("fresh", F.lit(False)).unionByName(more.withColumn("fresh", F.lit(True))), k, wide, threshold), "nn-graph")
            dropped(old, around)
            strong, new = graph.filter(F.col("sim") >= threshold).agg(F.count("*"), F.count_if("fresh")).first()
            if new <= FEW * strong:
                break
        edges = graph.filter(F.col("sim") >= threshold).select(F.col("v").alias("a"), F.col("u").alias("b"))
        of = named(edges)
        joined = settle(borders(unique, placed, of, threshold), "nn-borders")
        if not joined.isEmpty():
            of = named(edges.unionByName(joined))
        found = settle(counted(unique, of, threshold), "nn-found")
        share = truth.join(found, "n", "left").agg(F.avg(F.coalesce("others", F.lit(0)) / F.col("true_links"))).first()[0]
        if share >= recall if share is not None else strong == before:
            return of.join(found, "n").select("n", "component", "n_links")
        before = strong
    of = named(all_links(unique, threshold))
    return of.join(settle(counted(unique, of, threshold), "nn-found"), "n").select("n", "component", "n_links")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept."""
    keyed, unique = distinct_vectors(rows, id_col, vector_col, label_col)
    linked = settle(links(unique.select("n", "key", "part", "vec", "weight"), threshold), "nn-linked")
    per = settle(unique.select("n", "key", "weight", "vec_id").join(small(linked), "n", "left").withColumn("component", F.coalesce("component", "n")), "nn-pervector")
    heads = settle(per.filter("n_links IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("component_id")), "nn-heads")
    told = per.join(small(heads), "component", "left").select("key", (F.col("weight") - 1 + F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    # rows that neither link nor repeat need no lookup
    told = settle(told.filter("n_links > 0"), "nn-told")
    out = keyed.join(small(told), "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))
