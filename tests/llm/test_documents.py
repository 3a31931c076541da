"""Document operators against brute force on small fixtures with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vintage.llm import exact_dedup, mixing, ngram_join, quality_crf, secret_scan, sentencepiece_codec, suffix_dedup, token_counts
from vintage.llm.queries import byte_ranks, piece_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, size long, h long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randint(0, 60)) for _ in range(n))


def corpus():
    """Rows (doc_id, text, source): plain texts, copies, near copies, a shared passage and edge cases."""
    rng = random.Random(5)
    rows, passage = [], words(rng, 60)
    for i in range(60):
        rows.append((i, words(rng, rng.randint(1, 120)), f"s{i % 4}" if i % 7 else None))
    base = words(rng, 150)
    for i in range(60, 120):  # one large family of near copies
        w = base.split()
        w[rng.randrange(150)] = "changed"
        rows.append((i, " ".join(w), "s0"))
    for i in range(120, 140):  # exact copies, some with other white space
        rows.append((i, base if i % 2 else base.replace(" ", "\n", 3) + "  ", "s0"))
    for i in range(140, 150):
        rows.append((i, words(rng, 20) + "\n" + passage + "\n" + words(rng, 20), "s1"))
    rows += [(150, None, None), (151, "", "s2"), (152, " \n\t ", "s2"), (153, "ééé 日本語 " * 40, "s3"), (154, "a" * 30_000, "s3"), (155, base, "s0"), (155, base, "s0"), (156, "one two", "s1"), (157, "one two", "s1")]
    return rows


def frame(spark, rows):
    """Documents with other columns, some named as the operators name theirs."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 7, None) for i, t, s in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_exact_groups(spark, docs, rows, broadcast_rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[hashlib.sha256(strip(t).encode()).hexdigest()].append((-len(t or ""), i))
    want = {k: (len(v), min(v)[1]) for k, v in groups.items() if len(v) > 1}
    got = exact_dedup.duplicate_groups(docs, broadcast_rows=broadcast_rows).selectExpr("sha", "group_size", "~keep.not_id AS keep").collect()
    assert {r.sha: (r.group_size, r.keep) for r in got} == want


def test_exact_report_and_filter(docs, rows, empty):
    report = exact_dedup.exact_report(docs).collect()
    assert len(report) == len(rows)
    best = {}
    for i, t, _ in rows:
        best[strip(t)] = min(best.get(strip(t), (1, 0)), (-len(t or ""), i))
    texts = {i: t for i, t, _ in rows}
    assert all(r.keep_id == best[strip(texts[r.doc_id])][1] and r.kept == (r.keep_id == r.doc_id) for r in report)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for _, i in best.values())
    assert exact_dedup.exact_report(empty).count() == exact_dedup.keep_first(empty).count() == 0


def test_exact_is_native(docs, capsys):
    exact_dedup.exact_report(docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_mixing(docs, rows, empty):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    source, size = {i: s for i, _, s in rows}, {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for i, t, s in rows:
        total[s] += size[i]
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    order = sorted([s for s in total if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, open_, left = {}, set(order), 1.5 * sum(total.values())
    while open_:  # the plain way: whoever is above stops at its cap
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            want |= share
            break
        want |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ -= over
    assert all(abs(want[s] - target[s]) < 1e-6 for s in order)
    assert all(abs(taken[s] - target[s]) <= 150 for s in order)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
    twice = {i for i, n in ((i, sum(x == i for x, _, _ in rows)) for i, _, _ in rows) if n > 1}
    assert all(times[r.doc_id] * r.size == r.taken for r in got if r.doc_id not in twice)
    assert mixing.mix_report(empty).count() == mixing.mixed(empty).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_join_loses_no_link(docs, rows, empty, spark):
    sets = [(i, shingles(t)) for i, t, _ in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and len(a & b) >= 0.8 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    got = ngram_join.join(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == {i: root(i) for i, _ in sets}
    assert all((r.n_links == 0) == (sum(root(i) == root(r.doc_id) and s != dict(sets)[r.doc_id] for i, s in sets) == 0) for r in got)
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {root(i) for i, _ in sets}
    assert ngram_join.join(empty).count() == 0
    nameless = ngram_join.join(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in nameless) == [(0, 0, 0), (1, 1, 0)]


def degrees(texts):
    """Links of each text by brute force."""
    sets = [shingles(t) for t in texts]
    return [sum(i != j and a != b and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


def test_ngram_join_counts_all_links_of_a_family(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for n in (20, 70):
        base = words(rng, 200).split()
        for _ in range(n):
            w = list(base)
            for k in rng.sample(range(200), 2):
                w[k] = f"changed{rng.random()}"
            texts.append(" ".join(w))
    want = degrees(texts)
    assert sum(want) > 4000
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sets in (256, 15):  # in one block, and in several
        monkeypatch.setattr(ngram_join, "SETS", sets, raising=False)
        got = {r.doc_id: r.n_links for r in ngram_join.join(frame).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_ngram_join_compares_all_sets_of_a_large_node(spark, monkeypatch):
    rng = random.Random(3)
    shared, texts = " ".join(f"p{k}" for k in range(140)), []
    for _ in range(600):  # pairs of near copies among texts that share a passage, at about 0.75
        own = [f"w{rng.random()}" for _ in range(20)]
        texts += [" ".join([shared, *own]), " ".join([shared, *own[:12], *(f"v{rng.random()}" for _ in range(8))])]
    sets = [shingles(t) for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in (sets[:2], sets[1:3])]
    assert alike[0] > 0.8 > 0.79 > alike[1]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for wide in (1024, 100):
        monkeypatch.setattr(ngram_join, "WIDE", wide, raising=False)
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(frame).collect()}
        assert sum(got[i] != (i - i % 2, 1) for i in range(len(texts))) == 0


def test_ngram_tokens_estimate_similarity():
    rng = np.random.default_rng(1)
    close = []
    for _ in range(100):
        u = rng.integers(0, 2**63, 360).astype(np.uint64)
        close.append((ngram_join.tokens(u[:320]) == ngram_join.tokens(u[40:])).mean())
    assert abs(np.mean(close) - 280 / 360) < 0.02


def brute_ranges(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t, _ in rows):
        keep = np.ones(len(t), bool)
        for k in range(len(t) - length + 1):
            if t[k : k + length] in seen:
                keep[k : k + length] = False
            seen.add(t[k : k + length])
        out[i] = (len(t), int((~keep).sum()), int((~keep[:1]).sum() + (~keep[1:] & keep[:-1]).sum()), np.frombuffer(t, np.uint8)[keep].tobytes())
    return out


@pytest.mark.parametrize("hot", [16, 2])
def test_suffix_dedup_is_exact(spark, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 2: nearly every repeated bucket is dealt over tasks
    own = [r for r in rows if r[0] != 155] + [(155, rows[60][1], "s0"), (200, "ab" * 500, None), (201, "x" + "ab" * 200, None), (202, "z" * 99, None), (203, "z" * 100, None)]
    got = suffix_dedup.deduplicated(frame(spark, own), outputs=("kept", "kept_sha256")).collect()
    want = brute_ranges(own)
    assert len(got) == len(own)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
        assert r.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest()
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_suffix_dedup_of_repeated_ids(spark):
    same = spark.createDataFrame([(None, "q" * 50 + "w" * 80), (1, "q" * 50 + "w" * 80)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicated(same).collect()}
    assert got == {1: 0, None: 130}


def test_secrets(spark, empty):
    key, hexa = "AKIA" + "Z" * 16, "0123456789abcdef01234567"
    opaque = "aB3" * 12
    texts = {
        1: f"password = 'hunter22' and {hexa} é {key}",
        2: f"id {key}\nthe value {opaque}\nhttps://db.example.org/x",
        3: f"alone {opaque} here",
        4: None,
        5: "",
        6: "token: abc, secret:short, API-KEY = nope, apiKey=longenough",
        7: f"日本 {key} " + "x " * 400 + opaque,
        8: "paſſword = longenough",
    }
    got = {r.doc_id: r for r in secret_scan.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [(got[i].n_assign, got[i].n_access, got[i].n_hex) for i in texts] == [(1, 1, 1), (0, 1, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 0)]
    at = texts[1].index(hexa)
    spans = got[1].spans.split(",")
    assert spans[0] == f"assign:0:{len('password = ') + 9}" and spans[1] == f"hex:{at}:{at + 24}" and spans[2] == f"access:{len(texts[1]) - 20}:{len(texts[1])}"
    assert got[1].base_sha256 == hashlib.sha256(got[1].spans.encode()).hexdigest()
    assert [s.split(":")[0] for s in got[2].spans.split(",")] == ["access", "opaque", "endpoint"]
    assert got[3].spans == got[4].spans == "" and got[7].spans.startswith("access:3:")
    assert got[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "," not in got[7].spans  # too far away
    assert secret_scan.report(empty).count() == 0


def test_long_secrets_link_what_follows_or_lies_within(spark):
    long = "aB3" * 200
    texts = {
        1: f"token={long} user=alice",
        2: f"token={long}" + " " * 199 + "user=alice",
        3: f"token={long}" + " " * 200 + "user=alice",
        4: f"token={'x' * 900}login={'y' * 900}",  # one value holds the name of another
        5: f"token={'=' * 900}login=abc={'y' * 900}",
    }
    got = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",")] for r in secret_scan.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1] == got[2] == ["assign", "opaque", "login"]
    assert got[3] == ["assign"] and got[4] == got[5] == ["assign", "login"]


def test_base_spans_are_leftmost_matches():
    rng = random.Random(3)
    patterns = {"assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6), "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)}
    parts = ["password", "TOKEN", "secret", "api_key", "apikey", "=", ":", " ", '"', "AKIA", "AKIAA" * 5, "deadbeef0123", "Z9" * 9, "é", "\n", "abcdef"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        want = [(k, m.start(), m.end()) for k, (p, ok) in patterns.items() for m in re.finditer(p, t) if ok(m)]
        assert sorted(secret_scan.base_spans(t)) == sorted(want)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, rows, rule, empty):
    got = token_counts.counted(docs, *byte_ranks(), sections="lines", rule=rule).collect()
    with open(byte_ranks()[0], "rb") as f:
        encoding, _ = token_counts.load(f.read(), byte_ranks()[1])
    texts = dict((i, t or "") for i, t, _ in rows)
    for r in got:
        assert r.n_tokens == len(encoding.encode_ordinary(texts[r.doc_id]))
        assert len(r.section_tokens) == max(1, len(texts[r.doc_id].splitlines(keepends=False)) if "\n" in texts[r.doc_id] else 1)
        assert abs(sum(r.section_tokens) - r.n_tokens) < 1e-6
    assert token_counts.counted(empty, *byte_ranks()).count() == 0


def test_token_attribution_rules():
    ends, sections = np.array([2, 5, 9]), np.array([3, 9])
    assert token_counts.attribute(ends, sections, "start")[0].tolist() == [2, 1]
    assert token_counts.attribute(ends, sections, "most")[0].tolist() == [1, 2]
    assert np.allclose(token_counts.attribute(ends, sections, "share")[0], [1 + 1 / 3, 1 + 2 / 3])
    assert token_counts.attribute(ends, sections, "share")[1] == 1
    assert token_counts.paragraph_ends("a\n\nb\nc\n\n\nd").tolist() == [3, 9, 10]


def test_sentencepiece_round_trip(docs, rows, empty, monkeypatch):
    with open(piece_model(), "rb") as f:
        sp = sentencepiece_codec.load(f.read())
    got = sentencepiece_codec.encoded(docs, piece_model(), outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"))
    texts = dict((i, t or "") for i, t, _ in rows)
    for r in got.collect():
        ids = sp.encode(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    again = sentencepiece_codec.decoded(got.select("doc_id", "ids"), piece_model()).collect()
    assert all(r.text == texts[r.doc_id] for r in again if not texts[r.doc_id].startswith(" "))
    assert sentencepiece_codec.encoded(empty, piece_model()).count() == 0
    # most chunks beyond the broadcast: the same ids
    monkeypatch.setattr(sentencepiece_codec, "TABLE", 3)
    few = sentencepiece_codec.encoded(docs, piece_model(), outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"))
    assert sorted(map(str, few.collect())) == sorted(map(str, got.collect()))


def test_distinct_chunks_are_counted_once(spark):
    docs = spark.createDataFrame([("a b a",), ("b  b",), (None,), ("",), ("x" * 100 + " a",)], "text string")
    with open(piece_model(), "rb") as f:
        model = f.read()
    shared = spark.sparkContext.broadcast(model)
    chunks = sentencepiece_codec.chunk_table(docs.repartition(3), shared)
    for most, want in ((0, []), (1, ["a"]), (2, ["a", "b"]), (9, [" b", "a", "b"])):
        assert sorted(r.chunk for r in sentencepiece_codec.frequent(chunks, most).collect()) == want
    sp = sentencepiece_codec.load(model)
    assert sorted((r.chunk, r.n) for r in chunks.collect()) == [(" b", 1), ("a", 3), ("b", 2)]
    table = sentencepiece_codec.segmented(chunks, shared).collect()
    assert len(table) == 3 and all(r.ids == sp.encode(r.chunk) and r.digits == ",".join(map(str, r.ids)) for r in table)


def test_chunks_equal_the_library():
    with open(piece_model(), "rb") as f:
        table = sentencepiece_codec.ChunkTable(f.read(), most=50)
    rng = random.Random(2)
    parts = [" ", "▁", "  ", "a", "the", "é", "\n", "\t", "　", "😀", "<s>", "</s>", "<0x0A>", "ing", "日本", " a"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        chunks = table.encode(t)
        ids = table.sp.encode(t)
        assert [i for c in chunks for i in table.ids[c]] == ids and table.decode(chunks) == table.sp.decode(ids)


def test_crf_marginals_are_exact():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        u, t = rng.normal(size=n), rng.normal(size=(2, 2))
        d, e = quality_crf.forward_backward(u, t, np.array([n]))
        score = {}
        for k in range(2**n):
            y = [k >> i & 1 for i in range(n)]
            score[k] = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
        z = sum(score.values())
        for i in range(n):
            want = sum(s for k, s in score.items() if k >> i & 1) / z
            assert abs(1 / (1 + np.exp(-(d[i] + e[i]))) - want) < 1e-9


def test_quality_learns_and_scores_every_text(spark, docs, rows, empty):
    rng = random.Random(9)
    train = [(i, words(rng, 40) if i % 2 else ("JUNK!! " * 30) + "\n" + "x | y | z", None) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _, _ in train] + [(None, 1, 0), (5000, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.train(frame(spark, train), labels)
    scored = quality_crf.with_score(frame(spark, train), model).collect()
    assert sum((r.score >= 0.7) == bool(r.doc_id % 2) for r in scored) >= 297
    every = quality_crf.with_score(docs, model)
    assert every.columns == [*docs.columns, "score"]
    got = every.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    plain = quality_crf.train(empty, labels)
    assert {r.score for r in quality_crf.with_score(docs, plain).collect()} == {0.5}
    assert quality_crf.with_score(empty, model).count() == 0


def test_quality_sample_with_a_repeated_id(spark):
    rng = random.Random(10)
    train = [(i, words(rng, 40) if i % 2 else ("JUNK!! " * 30) + "\n" + "x | y | z", None) for i in range(100)]
    again = [(0, f"{'JUNK!! ' * (i % 50)}\nx | {i}", None) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in train] + [(0, 0)] * 300, "doc_id long, quality int")
    scored = quality_crf.with_score(frame(spark, train), quality_crf.train(frame(spark, train + again), labels, sample_docs=100)).collect()
    assert sum((r.score >= 0.7) == bool(r.doc_id % 2) for r in scored) >= 98


def test_columns_of_texts_equal_the_library():
    with open(piece_model(), "rb") as f:
        table = sentencepiece_codec.ChunkTable(f.read(), most=50)
    rng = random.Random(3)
    parts = [" ", "▁", "  ", "a", "the", "é", "\n", "\0", "　", "😀", "<s>", "<unk>", "<0x0A>", "ing", "日本", " a"]
    texts = [None, "", "a", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000))]
    for lo in range(0, len(texts), 400):
        some = texts[lo : lo + 400]
        got = table.outputs(pa.array(some, pa.string()), ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"))
        for k, t in enumerate(some):
            ids = table.sp.encode(t or "")
            back = table.sp.decode(ids)
            assert got["ids"][k].as_py() == ids and got["n_tokens"][k].as_py() == len(ids) and got["decoded"][k].as_py() == back
            assert got["ids_sha256"][k].as_py() == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got["decoded_sha256"][k].as_py() == hashlib.sha256(back.encode()).hexdigest()
    assert all(not len(v) for v in table.outputs(pa.array([], pa.string()), ("n_tokens", "ids", "decoded")).values())
