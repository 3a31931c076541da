"""Edge cases of the document and graph operators: regular words, dense families, random links, bounds,
repeated rows and columns named as the operators name theirs."""

import math
import random
import time
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_documents import corpus, degrees, shingles, words
from tests.llm.test_graphs import roots
from vintage.llm import exact_dedup, mixing, ngram_join, nn_descent, quality_crf, secret_scan, shared, suffix_dedup, token_counts, url_filter
from vintage.llm.queries import byte_ranks


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_regular_words_have_hashes_of_their_own(spark):
    swap = str.maketrans("ab", "ba")
    for n in (128, 1024, 2048, 4096):
        t = thue_morse(n)
        data, offsets = shared.text_buffers(pa.array([t, t.translate(swap)]))
        assert len(set(shared.words_of(data, offsets)[2].tolist())) == 2
    t = thue_morse(2048)
    docs = spark.createDataFrame([(1, f"{t} one two three four"), (2, f"{t.translate(swap)} one two three four"), (3, f"{t} one  two three four")], "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(docs).collect()} == {1: (1, 0), 2: (2, 0), 3: (1, 0)}


def test_a_shared_folder_is_required():
    none = types.SimpleNamespace(isEmpty=lambda: True)
    bare = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(_jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: none))))
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(bare)


def test_ngram_join_runs_until_its_recall(spark, monkeypatch):
    rng = random.Random(12)
    texts = []
    for _ in range(30):
        base = words(rng, 120).split()
        texts += [" ".join(base), " ".join([*base[:-4], "w", "x", "y", "z"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = ngram_join.embed(docs).filter("fp IS NOT NULL").select("doc_id", "fp", "sig").cache()
    nothing = spark.createDataFrame([], "fp binary, component binary")
    partners = ngram_join.exact_partners(docs, sets, ngram_join.AUDIT, "doc_id", "text")
    assert partners.count() >= sum(degrees(texts)) * 0.6
    assert ngram_join.audited(partners, nothing) == 0 and ngram_join.audited(partners.filter("1 = 0"), nothing) is None
    done, real = [], ngram_join.leaves
    monkeypatch.setattr(ngram_join, "leaves", lambda s, runs, first=0: done.append((runs, first)) or real(s, runs, first))
    of, _ = ngram_join.candidate_components(sets.select("fp", "sig"), partners, runs=1)
    assert ngram_join.audited(partners, of) >= ngram_join.RECALL
    assert done == [(1, 0), *[(ngram_join.MORE, 1 + ngram_join.MORE * k) for k in range(len(done) - 1)]]
    done.clear()
    ngram_join.candidate_components(sets.select("fp", "sig"), partners.filter("1 = 0"), runs=1)
    assert done == [(1, 0), (ngram_join.MORE, 1)]  # without partners in the sample, one batch more
    assert [r.n_links for r in sorted(ngram_join.join(docs).collect())] == degrees(texts)


def test_embedding_family_of_a_thousand(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=24)
    rows = [(i, (centre + rng.normal(size=24) * 0.12).tolist(), 0) for i in range(1000)] + [(1000 + i, rng.normal(size=24).tolist(), i % 2) for i in range(500)]
    rows += [(3, rows[3][1], 0), (2000, rows[1200][1], rows[1200][2]), (2001, [2 * x for x in rows[1200][1]], rows[1200][2])]
    monkeypatch.setattr(nn_descent, "BLOCK", 200)  # several blocks of one component
    frame = spark.createDataFrame([(i, v, lab, 1, "x", 2) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, n int, key string, component int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(frame.repartition(5)).collect())
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([lab for *_, lab in rows])
    near = (x @ x.T >= nn_descent.THRESHOLD) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    of = roots([(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(near), strict=True)])
    want = sorted((i, int(n), of.get(i, i), of.get(i, i) == i) for (i, *_), n in zip(rows, near.sum(1), strict=True))
    assert near.sum() > 100_000 and got == want


def test_audit_finds_partners_where_they_are_rare(spark):
    rng = random.Random(81)
    texts = [words(rng, 60) for _ in range(3000)]
    for k in range(20):
        base = words(rng, 120).split()
        texts += [" ".join(base), " ".join([*base[:-4], f"w{k}", "x", "y", "z"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = ngram_join.embed(docs).filter("fp IS NOT NULL").select("doc_id", "fp", "sig").cache()
    found = ngram_join.exact_partners(docs, sets, 30, "doc_id", "text")
    assert found.select("a").distinct().count() >= 20  # of 40 in 3040
    assert ngram_join.audited(found, spark.createDataFrame([], "fp binary, component binary")) == 0


def test_a_crowd_that_does_not_link_is_not_compared_all_with_all(spark, monkeypatch):
    rng = random.Random(82)
    monkeypatch.setattr(ngram_join, "LEAF", 16)
    shared = words(rng, 100)
    tail = lambda: words(rng, 21)
    texts = [f"{shared} {tail()}" for _ in range(1200)]
    texts += [f"{t} and some more" for t in texts[:40]]  # links inside the crowd
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [shingles(t) for t in texts]
    index = {g: k for k, g in enumerate(set().union(*sets))}
    x = np.zeros((len(texts), len(index)), np.float32)
    for row, s in zip(x, sets, strict=True):
        row[[index[g] for g in s]] = 1
    common, size = x @ x.T, x.sum(1)
    likeness = common / (size[:, None] + size[None, :] - common)
    assert 0.6 < np.median(likeness) < 0.72
    near = likeness >= 0.8
    np.fill_diagonal(near, False)
    compared = []
    real = ngram_join.leaves

    def counted(*args):
        out = real(*args)
        compared.append(sum(r.n * (r.n - 1) // 2 for r in out.groupBy("leaf").agg(F.count("*").alias("n")).collect()))
        return out

    monkeypatch.setattr(ngram_join, "leaves", counted)
    checked = []
    exact = ngram_join.exact_links
    monkeypatch.setattr(ngram_join, "exact_links", lambda met, *a: checked.append(met.groupBy("meeting").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]) or exact(met, *a))
    got = {r.doc_id: r.n_links for r in ngram_join.join(docs).collect()}
    assert sum(got.values()) >= 0.98 * near.sum() > 0 and all(n <= near[i].sum() for i, n in got.items())
    runs = ngram_join.RUNS + ngram_join.MORE * (len(compared) - 1)
    assert sum(compared) < 0.4 * runs * len(texts) ** 2 / 2  # as many for a text however large the crowd
    assert checked[0] < len(texts) / 4 and checked[-1] < 64  # exact: leaves, then what links


def family_rows(rng, families, size, spread, labels=1, d=24):
    rows = []
    for f in range(families):
        centre = rng.normal(size=d)
        rows += [(len(rows) + k, (centre + rng.normal(size=d) * spread).tolist(), f % labels) for k in range(size)]
    return rows


def embedding_truth(rows):
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([lab for *_, lab in rows])
    near = (x @ x.T >= nn_descent.THRESHOLD) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("exhausted", [False, True])
def test_embedding_recall_is_enforced_on_small_labels(spark, monkeypatch, exhausted):
    rows = family_rows(np.random.default_rng(71), 60, 4, 0.06)
    monkeypatch.setattr(nn_descent, "TABLES", 1)
    monkeypatch.setattr(nn_descent, "LEAF", 16)  # a round misses some
    monkeypatch.setattr(nn_descent, "BUCKET", 4)
    monkeypatch.setattr(nn_descent, "K", 1)
    if exhausted:  # rounds that find nothing: all vectors of a label are compared
        monkeypatch.setattr(nn_descent, "TURNS", 0)
        monkeypatch.setattr(nn_descent, "BLOCK", 50)
    got = nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    near = embedding_truth(rows)
    assert near.sum() > 500
    found = {r.vec_id: r.n_links for r in got}
    some = near.sum(1) > 0
    assert np.mean([found[i] / near[i].sum() for i in np.flatnonzero(some)]) >= (1 if exhausted else nn_descent.RECALL)
    assert all(found[i] <= near[i].sum() for i in found)


def test_embedding_audit_finds_rare_links_and_none(spark):
    rng = np.random.default_rng(72)
    rows = [(i, rng.normal(size=24).tolist(), 0) for i in range(3000)]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>, label int").repartition(4)
    _, unique = nn_descent.distinct_vectors(frame(rows))
    assert nn_descent.audit(unique, 100, 0.98).count() == 0
    assert nn_descent.links(unique).count() == 0
    pairs = [(3000 + i, (np.array(rows[i][1]) + rng.normal(size=24) * 0.05).tolist(), 0) for i in range(60)]
    _, unique = nn_descent.distinct_vectors(frame(rows + pairs))
    assert nn_descent.audit(unique, 200, 0.98).count() >= 15  # of 120 among 3060, a random sample has 8


def test_families_with_one_link_between_them(spark):
    rng = np.random.default_rng(73)
    a = np.eye(24)[0]
    b = np.cos(0.3) * a + np.sin(0.3) * np.eye(24)[1]  # cosine 0.955
    rows = [(i, (a + rng.normal(size=24) * 0.002).tolist(), 0) for i in range(60)] + [(60 + i, (b + rng.normal(size=24) * 0.002).tolist(), 0) for i in range(60)]
    for angle in (0.1, 0.2):  # each within reach of one family, and of one another
        rows.append((len(rows), (np.cos(angle) * a + np.sin(angle) * np.eye(24)[1]).tolist(), 0))
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    near = embedding_truth(rows)
    assert got == {i: (int(near[i].sum()), 0) for i in range(len(rows))}


def brute_links(text, scope=secret_scan.SCOPE):
    spans = secret_scan.base_spans(text) + secret_scan.weak_spans(text)
    near = lambda a, b: b[1] < a[2] + scope and b[2] > a[1] - scope and secret_scan.PARTS[a[0]] != secret_scan.PARTS[b[0]]
    kept = [a for a in spans if a[0] in secret_scan.BASE or any(near(a, b) for b in spans)]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(set(kept), key=lambda a: (a[1], secret_scan.KINDS.index(a[0]), a[2])))


def test_secret_links_equal_brute_force(spark):
    rng = random.Random(13)
    parts = ["token = abcdef12", "AKIA" + "Q" * 16, "0123456789abcdef" * 2, "aB3" * 12, "user=alice", "https://db.example.org/x", "é日", "http://h.example.com/" + "p" * 250]
    rows = [(i, "".join(rng.choice(parts) + " " + "x" * rng.choice([0, 5, 190, 199, 200, 240]) + " " for _ in range(rng.randint(0, 7)))) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), (900, (rows[3][1] + "y" * 5000) * 40)]
    frame = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, row_key string, kind int, start int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.spans) for r in secret_scan.report(frame.repartition(3)).collect())
    assert got == sorted((-1 if i is None else i, brute_links(t)) for i, t in rows)


def test_no_row_is_mixed_more_than_twice(spark):
    rows = [(i, "" if i % 3 else "some words here", "a") for i in range(60)] + [(100 + i, "w " * 400, "b") for i in range(30)] + [(200, None, "c"), (201, " ", "c")]
    frame = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size long, bound long")
    times = {}
    for r in mixing.mixed(frame).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix_report(frame).collect()}
    assert max(times.values()) == 2 and all(times.get(i, 0) * taken[i][0] == taken[i][1] for i, _, _ in rows)
    assert 200 not in times and 201 not in times  # a source without words


def brute_attribution(tokens, sections, rule):
    out, start = np.zeros(len(sections)), 0
    of = lambda c: min(int(np.searchsorted(sections, c, "right")), len(sections) - 1)
    for end in tokens:
        chars = [of(c) for c in range(start, end)] or [of(max(start - 1, 0))]
        share = np.bincount(chars, minlength=len(sections)) / len(chars)
        out += np.eye(len(sections))[chars[0]] if rule == "start" else np.eye(len(sections))[int(np.argmax(share))] if rule == "most" else share
        start = end
    return out


def test_attribution_equals_brute_force():
    rng = np.random.default_rng(14)
    for _ in range(500):
        n = int(rng.integers(1, 40))
        tokens = np.append(np.sort(rng.integers(0, n + 1, int(rng.integers(0, 12)))), n)  # some end where they start: parts of a character
        sections = np.append(np.sort(rng.integers(0, n + 1, int(rng.integers(0, 5)))), n)
        for rule in token_counts.RULES:
            assert np.allclose(token_counts.attribute(tokens, sections, rule)[0], brute_attribution(tokens, sections, rule))


def test_token_counts_of_given_sections(spark):
    texts = ["one two three", "日本語 😀😀 text", "", None, "one two three", "x" * 20_000]
    ends = [[4, 8], [2, 900, None], None, [3], [4, 8], [-5, 10_000]]
    rows = [(i % 5, t, e, 7, [1.0]) for i, (t, e) in enumerate(zip(texts, ends, strict=True))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ends array<int>, n_tokens int, section_tokens array<double>")
    with open(byte_ranks()[0], "rb") as f:
        encoding, sizes = token_counts.load(f.read(), byte_ranks()[1])
    got = token_counts.counted(frame, *byte_ranks(), ends_col="ends", rule="most").collect()
    want = []
    for i, t, e, *_ in rows:
        t = t or ""
        limits = np.array([len(t)] if e is None else [*sorted(min(max(x or 0, 0), len(t)) for x in e), len(t)])
        tokens = token_counts.token_ends(t, encoding, sizes)
        want.append((i, len(tokens), [len(t)] and brute_attribution(tokens, limits, "most").tolist()))
    assert sorted((r.doc_id, r.n_tokens, r.section_tokens) for r in got) == sorted((i, n, s if n else [0.0] * len(s)) for i, n, s in want)
    assert token_counts.long_form(token_counts.counted(frame, *byte_ranks(), ends_col="ends"), "doc_id").count() == sum(len(s) for *_, s in want)


def test_url_verdicts_equal_brute_force(spark):
    rng = random.Random(15)
    hosts = ["a.example.net", "b.example.com", "c.org", "d.net", "e.info", "f.info", "g.dev", "www.g.dev"]
    urls = [f"https://{h}/{p}{k}" for h in hosts for p in ("en/", "fr/", "de/", "") for k in range(6)]
    pages, pairs = [], []
    for i, u in enumerate(urls):
        html, v = "<p>", rng.choice(urls)
        if rng.random() < 0.4:
            relative = v.split("/", 3)[3] if v.split("/", 3)[2] == u.split("/", 3)[2] else None
            target = rng.choice([f"/{relative}", v.removeprefix("https:")]) if relative is not None else rng.choice([v, v.removeprefix("https:")])
            html = rng.choice(['<link href="%s" rel="canonical">', "<meta http-equiv=refresh content='0; URL=%s'>"]) % target
            pairs.append((u, v))
        pages.append((i, u, html))
    pages += [(0, urls[0], None), (500, "https://g.dev/" + "x" * 300_000, ""), (501, None, "<link rel=canonical href=/x>"), (502, "no scheme", "")]
    log = [(urls[1], "https://z.org/fr/"), (urls[2], None), (urls[3], urls[3])]

    def rule(u):
        host, path = (u.split("://", 1)[1].split("/", 1) + [""])[:2]
        fits = [(len(h), len(p), v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[2] if fits else None

    of = roots([(a, b) for a, b in [*pairs, log[0]] if a != b])
    said = {}
    for u in of:
        if rule(u):
            said.setdefault(of[u], set()).add(rule(u))
    want = {}
    for _, u, _ in pages:
        if u and "://" in u:
            got = said.get(of.get(u), set())
            want[u] = rule(u) or ("allow" if "allow" in got or not got else "block")
    frame = spark.createDataFrame([(*p, "v", 1) for p in pages], "page_id long, url string, html string, verdict string, node int")
    judged = url_filter.judge(frame.repartition(3), edges=spark.createDataFrame(log, "src string, dst string"), common=False).collect()
    url = {i: u for i, u, _ in pages}
    assert len(judged) == len(pages) and len(set(want.values())) == 2
    assert all(r.verdict == want.get(url[r.page_id], "allow") for r in judged)
    changed = sum(want[u] == "block" for u in want if rule(u) is None)
    assert changed > 3  # aliases do decide


def test_quality_training_reads_no_held_out_label_and_bounds_lines(spark):
    rng = random.Random(16)
    docs = [(i, words(rng, 30) if i % 2 else "JUNK!! x | y\n" * 10) for i in range(200)] + [(777, "one long text\n" * 5000)]
    frame = spark.createDataFrame([(i, t, 1, "m") for i, t in docs], "doc_id long, text string, y int, least string")
    rows = [(i, i % 2) for i, _ in docs]
    held = {r.doc_id for r in frame.filter(quality_crf.held_out(frame.doc_id)).collect()}
    assert 30 < len(held) < 80
    flipped = [(i, 1 - y if i in held else y) for i, y in rows]
    one, two = (quality_crf.train(frame, spark.createDataFrame(r, "doc_id long, quality int"), sample_lines=2000) for r in (rows, flipped))
    assert np.array_equal(one["w"], two["w"]) and np.array_equal(one["t"], two["t"])
    without = quality_crf.train(frame.filter("doc_id <> 777"), spark.createDataFrame(rows, "doc_id long, quality int"), sample_lines=2000)
    assert np.array_equal(one["w"], without["w"])  # a text beyond the bound is left out whole
    again = quality_crf.with_score(frame.unionByName(frame), one).collect()
    by = {}
    for r in again:
        by.setdefault((r.doc_id, r.text), set()).add(r.score)
    assert len(again) == 2 * len(docs) and all(len(s) == 1 for s in by.values())


def test_equal_names_in_different_buckets_stay_apart():
    u = lambda *x: np.array(x, np.int64)
    first, later = suffix_dedup._later_ones(u(1, 2, 1, 1), u(5, 5, 5, 6), u(0, 1, 2, 3), u(0, 0, 0, 0), u(0, 0, 0, 0))
    assert sorted(first.tolist()) == [0, 1, 3] and later.tolist() == [2]


def brute_removed(rows, length=100):
    """(bytes, removed bytes) of each row: a string goes where a smaller id, or its own row, had it before."""
    at = {}
    for r, (i, t) in enumerate(rows):
        t = t.encode()
        for k in range(len(t) - length + 1):
            at.setdefault(t[k : k + length], []).append((math.inf if i is None else i, r, k))
    out = []
    for r, (i, t) in enumerate(rows):
        t, i = t.encode(), math.inf if i is None else i
        keep = np.ones(len(t), bool)
        for k in range(len(t) - length + 1):
            if any(j < i or (q == r and m < k) for j, q, m in at[t[k : k + length]]):
                keep[k : k + length] = False
        out.append((-1 if i == math.inf else i, len(t), int((~keep).sum())))
    return sorted(out)


@pytest.mark.parametrize("hot", [16, 2])
def test_suffix_dedup_of_repeated_and_null_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SHARE", 4)
    rng = random.Random(61)
    block = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [block(150), block(230), block(400)]
    rows = [(1, shared[0] + block(90)), (7, block(300)), (7, block(20) + shared[0]), (7, shared[1] + block(30)), (7, block(10) + shared[1] + shared[1])]
    rows += [(None, block(250)), (None, shared[2] + block(40)), (None, block(15) + shared[2]), (None, shared[1]), (9, shared[2][:180]), (3, shared[2][-120:]), (1, shared[0] + "x")]
    rows += [(rng.choice([2, 5, 5, 8, None]), "".join(rng.choice([*shared, block(60)])[rng.randint(0, 30) :] for _ in range(rng.randint(1, 4)))) for _ in range(40)]
    rows += [(7, rows[1][1]), (None, rows[5][1])]  # equal rows are one
    want = brute_removed([r for k, r in enumerate(rows) if r not in rows[:k]])
    got = suffix_dedup.deduplicated(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, doc int").repartition(3)).collect()
    seen = sorted({(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got})
    assert len(got) == len(rows) and sorted(r[:3] for r in seen) == want and sum(n for *_, n in want) > 3000


@pytest.mark.parametrize("part", ["a-", "1.", "a.", "user ", "token ", "AKIA", "http:", "0a", "aB3", "a:", "::"])
def test_secret_scan_of_a_long_run_is_linear(part):
    text = part * ((1 << 20) // len(part))
    began = time.monotonic()
    secret_scan.base_spans(text), secret_scan.weak_spans(text)
    assert time.monotonic() - began < 10


def test_group_over_many_batches_comes_whole():
    rng = random.Random(62)
    keys = sorted(rng.choice([1, 1, 1, 2, 3, 4, 5, 9, 9]) for _ in range(500))
    column = pa.array(keys, pa.int64())
    for size in (1, 2, 7, 100, 600):
        batches = [pa.RecordBatch.from_arrays([column.slice(k, size), pa.array(range(k, min(k + size, 500)))], ["k", "v"]) for k in range(0, 500, size)]
        batches.insert(1, batches[0].slice(0, 0))
        groups, values = [], []
        for batch, bounds in shared.whole_groups(iter(batches)):
            values += batch.column(1).to_pylist()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                own = set(batch.column(0).slice(lo, hi - lo).to_pylist())
                assert len(own) == 1 and hi > lo
                groups += own
        assert values == list(range(500)) and groups == sorted(set(keys))
    assert list(shared.whole_groups(iter([]))) == []


def test_suffix_dedup_of_one_long_periodic_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    monkeypatch.setattr(suffix_dedup, "SHARE", 8)
    line = "the same line of text again and again, " * 3
    rows = [(1, line * 60, 1, 2), (2, "start " + line * 20, 1, 2), (3, "é" * 70, 1, 2)]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id int, text string, bucket int, salt int")).collect()}
    from tests.llm.test_documents import brute_ranges

    want = brute_ranges([(i, t, None) for i, t, *_ in rows])
    assert got == {i: w[:2] for i, w in want.items()}


def test_pipeline_stages_equal_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in corpus()] + [(None, "no id here at all", "en", "s0", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    stages = dict(corpus_pipeline.STAGES)
    exact = stages["exact dedup"](spark, docs, folder).cache()
    best = {}
    for i, t, *_ in rows:
        key = exact_key(t)
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), (i is None, i)))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in exact.collect()) == sorted((a, i or 0) for _, (a, i) in best.values())
    near = stages["n-gram Jaccard join"](spark, exact, folder).cache()
    left = [(r.doc_id, shingles(r.text)) for r in exact.collect() if r.doc_id is not None]
    of = roots([(a, b) for k, (a, x) in enumerate(left) for b, y in left[:k] if x and y and len(x & y) >= 0.8 * len(x | y)])
    assert sorted(r.doc_id for r in near.collect() if r.doc_id is not None) == sorted(i for i, _ in left if of.get(i, i) == i)
    mix = stages["mixing sources"](spark, near, folder).cache()
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix_report(near).collect()}
    times = {}
    for r in mix.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert mix.columns == docs.columns and all(times.get(i, 0) * n == t for i, (n, t) in taken.items())
    out = stages["SentencePiece encoding"](spark, mix, folder).collect()
    assert len(out) == mix.count()
    scored = stages["quality classifier"](spark, docs, folder)
    assert scored.columns == docs.columns and scored.count() <= len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("1 = 0"), folder).count() == 0, name
    assert exact_dedup.keep_first(near).count() == near.count()


def exact_key(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
