"""Collocations and the word index against plain counting."""

import random
import re
from collections import Counter

import numpy as np

from vintage.llm import collocations

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(docs, least, top=2000, most=4):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most + 1):
                for k in range(len(words) - size + 1):
                    f[lang, tuple(words[k : k + size])] += 1
    some = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = Counter()
    for (lang, p), a in some.items():
        for size in range(2, len(p)):
            for k in range(len(p) - size + 1):
                inside[lang, p[k : k + size]] = max(inside[lang, p[k : k + size]], a)
    out = {}
    for (lang, p), a in some.items():
        if 100 * inside[lang, p] < 80 * a or not inside[lang, p]:
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def corpus(rng, n=300):
    vocabulary = ["the", "of", "Été", "été", "日本", "a", "b", "x-1", "'q'", "New", "York", "city"]
    phrases = ["New York city hall", "of the", "a b a b a b a", "日本 été", "x-1\t'q'  of"]
    docs = []
    for _ in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        docs.append((rng.choice(["en", "en", "en", "fr", None]), "".join(p + rng.choice([" ", " ", " ", ", ", "\n", ".", "\t"]) for p in parts)))
    return docs + [("de", None), ("de", ""), ("fr", " ,. "), ("en", "a " * 4000), ("en", docs[0][1])]


def frame(spark, docs):
    # columns named as the operator names its own
    return spark.createDataFrame([(lang, t, 1, "k", [3]) for lang, t in docs], "lang string, text string, n_words int, phrase string, ids array<int>").repartition(4)


def test_equal_to_plain_counting(spark, monkeypatch):
    docs = corpus(random.Random(51))
    want = brute(docs, 8)
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, docs), least=8).collect())
    assert got == want and len(want) > 100
    # small shards, rounds of ranking, and filters that let everything through
    monkeypatch.setattr(collocations, "SHARD", 50)
    monkeypatch.setattr(collocations, "TEXT", 500)
    monkeypatch.setattr(collocations, "passes", lambda bits, keys: np.ones(len(keys), bool))
    monkeypatch.setattr(collocations.first_of_each, "__defaults__", (20,))  # rows that a task ranks
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, docs), least=8, top=9).collect())
    assert got == brute(docs, 8, top=9)


def test_empty_and_rare(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [("en", "a b c"), ("en", None)])).count() == 0


def test_index_counts_phrases_and_extensions():
    rng = np.random.default_rng(52)
    for _ in range(30):
        words = rng.integers(1, 5, int(rng.integers(1, 60))).astype(np.int32)
        ids = collocations.spaced(words, rng.random(len(words)) < 0.2)
        text = ids.tolist()
        count = lambda size: Counter(p for k in range(len(text) - size + 1) if 0 not in (p := tuple(text[k : k + size])))
        index = collocations.TwoWayIndex(ids, 4)
        for ways in ((True, True, True), (False, False, False), (True, False, True), (False, True, False)):
            found = index.words()
            assert {tuple(p): c for p, c in zip(found[0].tolist(), found[1].tolist(), strict=True)} == count(1)
            for size, to_left in enumerate(ways, 2):
                found = index.extended(*found, to_left=to_left)
                assert {tuple(p): c for p, c in zip(found[0].tolist(), found[1].tolist(), strict=True)} == count(size)


def test_products_beyond_64_bits(spark):
    big = 6 * 10**12
    rows = [("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 7)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, a long")).collect()
    assert [(r.l, r.r, r.score) for r in got] == [(big, big + 1, 2000000 * (big - 7) // (2 * big + 1))]


def test_filters_hold_all_their_keys(spark):
    keys = np.random.default_rng(53).integers(-(2**63), 2**63, 5000)
    bits = collocations.bit_filter(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert collocations.passes(bits, keys.view(np.uint64)).all()
    assert collocations.passes(bits, np.random.default_rng(54).integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.2
