"""Benchmark decontamination against brute force: exact windows, proximity and edge cases."""

import hashlib
import random
import re

from vintage.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, size=10):
    tests = []
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        if n:
            tests.append(("" if item is None else str(item), {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, n))
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, grams, n in tests:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    # columns named as the operator names its own
    docs = spark.createDataFrame([(i, t, 1, "w", [2]) for i, t in docs], "doc_id long, text string, row int, w string, words array<int>").repartition(5)
    return docs, spark.createDataFrame([(i, t, 3, "x") for i, t in items], "item_id long, text string, row int, item string")


def corpus(rng):
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "ÉTÉ", "naïve", "日本", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 10, 11, 25, 40]))) for k in range(20)]
    items += [(20, "the"), (21, "the the"), (22, None), (23, ""), (24, " .,"), (None, text(15)), (5, text(12)), (25, items[4][1]), (26, "absent nowhere " + text(12))]
    docs = []
    for k in range(80):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            _, t = rng.choice(items)
            w = (t or "").split()
            lo = rng.randint(0, len(w))
            parts += [", ".join(w[lo : lo + rng.choice([5, 10, 30])]).upper().replace("É", "é").replace("ÏV", "ïv"), text(rng.randint(0, 5))]
        docs.append((k, " ".join(parts)))
    docs += [(7, "other text with that id the"), (None, items[3][1]), (None, items[5][1]), (100, None), (101, ""), (102, "the " * 3000 + items[2][1])]
    docs += [(103, docs[3][1]), (103, docs[3][1])]
    return docs, items


def test_windows_equal_brute_force(spark):
    docs, items = corpus(random.Random(31))
    got = decontaminate.report(*frames(spark, docs, items)).collect()
    want = brute(docs, items)
    assert sorted([tuple(r) for r in got], key=repr) == want
    assert sum(r[5] for r in want) > 15 and sum(not r[5] for r in want) > 5


def test_tables_too_large_to_broadcast_are_shuffled(spark, monkeypatch):
    docs, items = corpus(random.Random(32))
    monkeypatch.setattr(decontaminate, "fits", lambda df: False)
    monkeypatch.setattr(decontaminate, "small", lambda df: df)
    assert sorted([tuple(r) for r in decontaminate.report(*frames(spark, docs, items)).collect()], key=repr) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = [(1, "some words of a text")], [(1, "some words")]
    for d, i in (([], items), (docs, []), ([], [])):
        assert sorted(tuple(r) for r in decontaminate.report(*frames(spark, d, i)).collect()) == brute(d, i)


def test_proximity_equals_brute_force(spark):
    docs, items = corpus(random.Random(33))
    items = [(k, t) for k, t in items if k not in (None, 5)]
    count = {}
    for _, t in docs:
        for w in words(t):
            count[w] = count.get(w, 0) + 1
    want = set()
    for row, (_, t) in enumerate(docs):
        w = words(t)
        for item, u in items:
            terms = set(words(u))
            if terms and all(x in count for x in terms):
                rare = set(sorted(terms, key=lambda x: (count[x], x.encode()))[:3])
                if any(rare <= set(w[k : k + 6]) for k in range(len(w))):
                    want.add((row, str(item)))
    frame, tests = frames(spark, [(k, t) for k, (_, t) in enumerate(docs)], items)
    tokens = decontaminate.tokenised(frame)
    names = {r.row: r.doc_id for r in tokens.collect()}
    got = decontaminate.near_matches(tokens, decontaminate.item_words(tests), within=6).collect()
    assert {(names[r.row], r.item) for r in got} == want and len(want) > 30


def test_no_python_in_the_plan(spark):
    frame, tests = frames(spark, [(1, "a b c")], [(1, "b c")])
    plan = decontaminate.report(frame, tests)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan
