import numpy as np
import pandas as pd
import pytest

from ledgerloom.llm import neighbours
from ledgerloom.llm.neighbours import Quantiser, nearest


def brute(ids, x, every, k):
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (x @ x[i]) / (norm * norm[i])
        keep = ids != ids[i]
        order = np.lexsort((ids[keep], -np.round(score[keep], 12)))[:k]
        out[int(ids[i])] = [(int(a), float(b)) for a, b in zip(ids[keep][order], score[keep][order], strict=True)]
    return out


def recall(got, want):
    hits = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("cells", [(1 << 14, 1 << 9), (40, 3)])
def test_recall_on_a_table(spark, monkeypatch, cells):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cells[0])
    monkeypatch.setattr(neighbours, "CELL_QUERIES", cells[1])
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas()
    want = brute(pdf.vec_id.to_numpy(), np.stack(pdf.embedding), 50, 5)
    got = found(nearest(df))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.95
    exact = {(q, v): s for q, w in want.items() for v, s in w}
    assert all(abs(s - exact[q, v]) < 1e-12 for q, w in got.items() for v, s in w if (q, v) in exact)


def test_very_large_and_small_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6))
    scale = rng.choice([1e-200, 1e-3, 1.0, 1e170, 1e300], size=(200, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x * scale)], "vec_id bigint, embedding array<double>")
    want, got = brute(np.arange(200), x, 50, 5), found(nearest(df))
    assert recall(got, want) == 1 and all(abs(s - t) < 1e-9 for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))


def test_copies_and_unusable_rows(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 8))
    rows = [(i, base[i % 300].tolist(), 1) for i in range(300)]
    rows += [(1000 + i, base[7].tolist(), 1) for i in range(400)]  # many copies of one vector
    rows += [(5000, None, 1), (5050, [0.0] * 8, 1), (5100, [1.0] * 7 + [None], 1), (5150, [float("nan")] * 8, 1), (5200, [float("inf")] * 8, 1), (5250, [1.0] * 3, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int").repartition(3)
    good = [(i, np.array(v, np.float32)) for i, v, _ in rows if i is not None and i < 5000]
    want = brute(np.array([i for i, _ in good]), np.stack([v for _, v in good]), 50, 5)
    got = found(nearest(df))
    assert got.keys() == want.keys()
    assert [v for v, _ in got[1050]] == [7, 1000, 1001, 1002, 1003]
    assert recall(got, want) >= 0.95
    short = [(6000 + i, rng.normal(size=3).tolist(), 1) for i in range(120)]  # another length is searched for itself
    both = found(nearest(df.union(spark.createDataFrame(short, df.schema))))
    assert {q: w for q, w in both.items() if q < 5000} == got
    mine = [(i, np.array(v, np.float32)) for i, v, _ in [*short, *[r for r in rows if r[0] == 5250]]]
    assert recall(both, brute(np.array([i for i, _ in mine]), np.stack([v for _, v in mine]), 50, 5)) >= 0.95 and {5250, 6000, 6050, 6100} <= both.keys()
    few = found(nearest(df.where("vec_id in (0, 3, 5)")))
    assert len(few[0]) == 2
    assert nearest(df.limit(0)).count() == 0 and nearest(df.where("vec_id >= 5000")).count() == 0


def test_table_scores_follow_the_products():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 32)).astype(np.float32)
    quantiser = Quantiser.fit(x, 16, 8, 256)
    of, codes = quantiser.encode(x)
    q = x[0]
    assert np.corrcoef(quantiser.scores(q, of, codes), x @ q)[0, 1] > 0.9


@pytest.mark.parametrize("cells", [(1 << 14, 1 << 9), (900, 20)])
def test_near_copies_are_told_apart(spark, monkeypatch, cells):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cells[0])
    monkeypatch.setattr(neighbours, "CELL_QUERIES", cells[1])
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    near = np.arange(6000) % 3 == 0  # a third of the rows: one vector with jitter and other lengths
    x[near] = (x[0] + 1e-4 * rng.normal(size=(2000, 32))) * rng.uniform(0.5, 2, size=(2000, 1))
    x, ids = x.astype(np.float32), np.arange(6000)
    df = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "vec_id bigint, embedding array<float>").repartition(3)
    want, got = brute(ids, x, 50, 5), found(nearest(df, lists=16, probes=16))
    assert got.keys() == want.keys()
    inside = {q: w for q, w in want.items() if near[q]}
    assert recall(got, inside) == 1 and recall(got, want) >= 0.99


@pytest.mark.parametrize("n", [3000, 9000, 27000])
@pytest.mark.parametrize("clusters", [0, 60])
def test_recall_does_not_fall_with_size(spark, n, clusters):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32))
    if clusters:
        x = x + 4 * rng.normal(size=(clusters, 32))[rng.integers(0, clusters, n)]
    x, ids = x.astype(np.float32), np.arange(n)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}), "vec_id bigint, embedding array<float>").repartition(4)
    got = recall(found(nearest(df, every=100)), brute(ids, x, 100, 5))
    print(n, clusters, got)
    assert got >= 0.95
