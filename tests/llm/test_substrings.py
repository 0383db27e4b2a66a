import hashlib
import os
import sys
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import substrings
from ledgerloom.llm.automaton import SuffixAutomaton

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import rows_of_spark, rows_of_sql, same  # noqa: E402


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=5), st.integers(1, 4))
def test_automaton_counts(sequences, window):
    automaton, counts = SuffixAutomaton(), Counter()
    for i, s in enumerate(sequences):
        automaton.add(s, i + 1)
        for k in range(len(s) - window + 1):
            counts[tuple(s[k : k + window])] += i + 1
    automaton.finish()
    for s in [*sequences, [0, 1, 2, 2, 1, 0, 0, 0, 1]]:
        assert automaton.occurrences(s, window) == [counts[tuple(s[k : k + window])] for k in range(len(s) - window + 1)]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    numbers = rng.integers(0, 6, 4000).astype(np.uint64)
    anchors, starts, counts, _ = substrings.fragments(numbers, 10)
    assert counts.sum() == 4000 - 9 and starts[0] == 0 and (starts[1:] == np.cumsum(counts)[:-1]).all()
    of = {}
    for anchor, start, n in zip(anchors, starts, counts, strict=True):
        for i in range(start, start + n):
            of.setdefault(tuple(numbers[i : i + 10]), set()).add(anchor)
    assert all(len(a) == 1 for a in of.values())


def brute(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    counts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = {k + j for k in range(len(w) - window + 1) if counts[tuple(w[k : k + window])] > 1 for j in range(window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out)


@pytest.mark.parametrize("variants", [512, 3])
def test_against_brute_force(spark, monkeypatch, variants):
    monkeypatch.setattr(substrings, "VARIANTS", variants)
    monkeypatch.setattr(substrings, "STRETCH", 500)
    rng = np.random.default_rng(5)
    vocabulary = [f"wé{i}" for i in range(400)]
    passage = rng.choice(vocabulary, 90).tolist()
    rows = []
    for i in range(60):
        own = rng.choice(vocabulary, int(rng.integers(1, 300))).tolist()
        cut = int(rng.integers(0, len(own) + 1))
        a = int(rng.integers(0, 30))
        rows.append((i, "\n".join(own[:cut] + passage[a : a + int(rng.integers(20, 60))] + own[cut:])))
    rows += [(100, rows[3][1]), (101, "a b " * 60), (102, "z " * 2000), (103, None), (104, ""), (105, "\x1c\xa0x  y\x0b"), (3, rows[3][1]), (None, rows[7][1]), (None, "short")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, k string").repartition(3)
    out = substrings.remove_repeats(docs)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in out.collect()) == brute(rows, 35)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_whole_table_equals_sql(spark):
    out = substrings.remove_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), with_text=False)
    names, got = rows_of_spark(out)
    sql_names, want = rows_of_sql(substrings.oracle(35), "/root/testdata/sf0.001")
    assert names == sql_names and same(got, want)
    assert sum(r[names.index("n_removed")] for r in got) > 0
