import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import search
from ledgerloom.llm.search import ImpactLists, oracle, ranked_search, terms_of

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import rows_of_spark, rows_of_sql, same  # noqa: E402


def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]


def brute(docs, items, k):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c, c.total()) for d, c in own if c]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in own:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_terms():
    texts = ["Ab-C9_\x00Äß x É{}~ [a]`b` \x7f字A z", "", " ", "İKK"]
    assert [[t.decode() for t in terms_of(x.encode())] for x in texts] == [terms(x) for x in texts]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables_equal_sql(spark, sf):
    tables = [spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "benchmark")]
    names, got = rows_of_spark(ranked_search(*tables))
    sql_names, want = rows_of_sql(oracle(), f"/root/testdata/{sf}")
    assert names == sql_names and got and same(got, want)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_equal_brute_force(spark, monkeypatch, seed):
    """Skewed terms, ties, copies, nulls and clashing columns, in many blocks, passes and tasks."""
    monkeypatch.setattr(search, "POSTINGS", 60)
    monkeypatch.setattr(search, "QUERIES", 4)
    monkeypatch.setattr(search, "STEP", 2)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([3, 10, 40])]) for _ in range(n))
    docs = [(rng.choice([i, i, 5, None]), text(rng.choice([1, 5, 30]))) for i in range(250)]
    docs += [(1000 + i, "w1 w2 W3") for i in range(60)] + [(1, None), (2, ""), (3, " ,.")] + docs[:5]
    items = [(i, text(rng.choice([1, 4, 12]))) for i in range(12)] + [(50, None), (51, "absent"), (None, "w1 w1 w2"), (0, "w1 w2 w3"), (0, "w1 w2 w3")]
    a = spark.createDataFrame([(*d, 1, 1) for d in docs], "doc_id bigint, text string, item int, score int").repartition(5)
    b = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, rank int")
    got = sorted(map(tuple, ranked_search(a, b, 7).collect()), key=str)
    assert got == brute(docs, items, 7)


def test_search_stops_early_and_never_too_early():
    rng = np.random.default_rng(3)
    n, vocabulary = 4000, 50
    held = [np.sort(rng.choice(vocabulary, rng.integers(1, 12), replace=False)) for _ in range(n)]
    starts = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    of, tf = np.concatenate(held).astype(np.int32), rng.zipf(1.8, starts[-1]).clip(1, 500).astype(np.int32)
    lists = ImpactLists(75 + rng.integers(0, 200, n), starts, of, tf, vocabulary)
    assert all((np.diff(lists.impact_at[a:b]) <= 0).all() for a, b in zip(lists.bounds, lists.bounds[1:], strict=False))
    for stamp in range(30):
        own = rng.choice(vocabulary, 2, replace=False)
        weights = rng.integers(1, 5000, 2)
        every = np.zeros(n, np.int64)
        for t, w in zip(own, weights, strict=True):
            every[lists.doc_at[lists.bounds[t] : lists.bounds[t + 1]]] += w * lists.impact_at[lists.bounds[t] : lists.bounds[t + 1]]
        docs, scores = lists.search(stamp, own, weights, 10, np.zeros(0, np.int64))
        assert (every[docs] == scores).all()
        kth = np.sort(every)[-10]
        assert set(np.flatnonzero(every >= kth)) <= set(docs.tolist())  # with all ties of the last
    assert lists.reads < 30 * 400


def test_empty_tables_and_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a b " * 200_000), (2, "a c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "b c c")], "item_id bigint, text string")
    assert sorted(map(tuple, ranked_search(docs, items).collect())) == brute([(1, "a b " * 200_000), (2, "a c")], [(9, "b c c")], 20)
    assert ranked_search(docs.limit(0), items).collect() == [] and ranked_search(docs, items.limit(0)).collect() == []
