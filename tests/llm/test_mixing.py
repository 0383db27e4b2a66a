import os
import random
import sys

import pytest

from ledgerloom.llm import mixing
from ledgerloom.llm.mixing import mix_sources, mixed, oracle, placed

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import rows_of_spark, rows_of_sql, same  # noqa: E402

SCHEMA = "doc_id bigint, text string, source string, target int"


def waterfill(sizes, weights, budget, most):
    """Targets of {source: size} by adding shares of what is left, time and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    while open_:
        level = (budget - sum(target[s] for s in names if s not in open_)) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        for s in full:
            target[s] = float(most * sizes[s])
        if not full:
            return target | {s: level * weight[s] for s in open_}
        open_ -= full
    return target


def random_rows(rng, n):
    # one source holds a third of the rows, others little or nothing; ids and texts repeat
    sources = ["hot"] * 5 + ["b", "Ä", "a", None, "", "z", "empty", "tiny"]
    rows = []
    for i in range(n):
        source = rng.choice(sources)
        words = 0 if source == "empty" else 1 if source == "tiny" else rng.choice([0, 1, 3, 20, 400])
        text = None if rng.random() < 0.05 else " \t".join(rng.choice(["ä", "x", "yz q"]) for _ in range(words))
        rows.append((rng.choice([i, i, 7, None]), text, source, 1))
    return rows + rows[:5]


@pytest.mark.parametrize(("sf", "ranges"), [("sf0.001", 60), ("sf0.01", 1 << 17)])
def test_whole_table_equals_sql(spark, monkeypatch, sf, ranges):
    monkeypatch.setattr(mixing, "RANGE", ranges)
    out = mix_sources(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    names, got = rows_of_spark(out)
    sql_names, want = rows_of_sql(oracle(), f"/root/testdata/{sf}")
    assert names == sql_names and same(got, want)
    assert "Python" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize(("seed", "share", "most"), [(1, 1.5, 2), (3, 9.0, 3), (4, 2.2, 3)])
def test_targets_and_limits(spark, monkeypatch, seed, share, most):
    monkeypatch.setattr(mixing, "RANGE", 40)
    docs = spark.createDataFrame(random_rows(random.Random(seed), 300), SCHEMA).repartition(5)
    rows = placed(docs, share=share, most=most)
    out = mix_sources(docs, share=share, most=most).collect()
    held = rows.collect()
    assert len(out) == len(held) == docs.count()
    sizes, target, taken, total = {}, {}, {}, sum(r["size"] for r in held)
    for r in held:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        target[r.source] = r.target
    want = waterfill(sizes, (3, 1, 2), share * total, most)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in want)
    assert all(0 <= r.taken <= most * r["size"] and r.source_size in sizes.values() for r in out)
    mix = sorted(mixed(rows, share, most).collect(), key=lambda r: r["at"])
    for r in mix:
        taken[r.source] = taken.get(r.source, 0) + r.words
    assert all(abs(taken.get(s, 0) - want[s]) <= len(want) + 1 for s in want)
    assert sum(r.taken for r in out) == sum(taken.values()) == min(int(share * total), most * total)
    # in the order of virtual time, without gaps, and fair all along
    at = 0
    for a, b in zip(mix, mix[1:], strict=False):
        assert a["at"] == at and a.finish <= b.finish
        at += a.words
    half = {}
    for r in mix:
        if r.finish <= 0.5:
            half[r.source] = half.get(r.source, 0) + r.words
    assert all(want[s] * 0.5 - 400 <= half.get(s, 0) <= want[s] * 0.5 for s in want)


def test_reruns_agree(spark):
    rows = random_rows(random.Random(9), 200)
    runs = [sorted(map(tuple, mix_sources(spark.createDataFrame(r, SCHEMA).repartition(n)).collect()), key=str) for r, n in ((rows, 1), (rows[::-1], 7))]
    assert runs[0] == runs[1]


def test_empty_tables_and_no_words(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", None, 1), (None, " ", "a", 1)], SCHEMA)
    assert mix_sources(docs.limit(0)).collect() == []
    assert {(r["size"], r.source_size, r.target, r.taken) for r in mix_sources(docs).collect()} == {(0, 0, 0.0, 0)}


def test_very_long_text_is_cut_at_its_source_target(spark):
    docs = spark.createDataFrame([(1, "w " * 200_000, "long", 1), (2, "w " * 50_000, "short", 1)], SCHEMA)
    out = {r.doc_id: r for r in mix_sources(docs).collect()}
    assert out[2].taken == out[2].target == 93_750 and out[1].taken == out[1].target == 281_250
