import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import quality
from ledgerloom.llm.quality import DIMS, ROWS, Network, Pooler, Rows, crc_fold, fit_contexts, fit_quality, fold, gradients, index_vectors, score_quality, terms, units, word_vectors


def test_terms_and_vectors():
    assert terms("The,") == ["the", "\\shape:C", "\\marks:,:1"] and terms("AB!!12") == ["ab", "\\shape:U", "\\marks:!:2", "\\digits"] and terms("") == ["\\other"]
    x = index_vectors(["a", "b", "a"])
    assert (x[0] == x[2]).all() and (x[0] != x[1]).any() and (np.count_nonzero(x, axis=1) <= 8).all()
    long = "é" * 1000
    assert b"".join(units(f"a {long} b".encode())) == f"a{long}b".encode() and max(len(u.decode()) for u in units(long.encode())) == 64


def plain_contexts(texts):
    """Neighbours' index vectors summed word by word."""
    places, signs = quality._near_vectors()
    rows, out = Rows(), np.zeros((ROWS, DIMS))
    for t in texts:
        at = [rows[w] for w in t.encode().split()]
        for i in range(len(at)):
            for j in range(max(0, i - 2), min(len(at), i + 3)):
                if i != j:
                    for p, s in zip(places[:, at[j]], signs[:, at[j]], strict=True):
                        out[at[i], p] += s
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def test_contexts_and_scores_equal_plain_version(spark):
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").limit(60).collect())]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string").repartition(5)
    context = fit_contexts(docs)
    assert np.allclose(context, plain_contexts([t for _, t in rows]), atol=1e-6)
    model = fit_quality(docs, spark.createDataFrame([(i, i % 2, "x") for i in range(60)], "doc_id bigint, quality int, text string"))
    net = model.network
    got = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    for i, t in rows:
        v = {w: word_vectors([w], context)[0] for w in t.split()}
        x = np.concatenate([np.mean([v[w] for w in t.split()], axis=0), np.mean(list(v.values()), axis=0), [np.log1p(len(t.split())) / 8, len(v) / len(t.split()), np.log1p(len(v)) / 8]])
        hidden = np.maximum((x - net.mean) / net.scale @ net.w1 + net.b1, 0)
        assert np.isclose(got[i], 1 / (1 + np.exp(-(hidden @ net.w2 + net.b2) / net.temperature)), atol=1e-3)


def test_pooling_is_the_mean():
    context = plain_contexts(["red fish blue fish", "red red bird"]).astype(np.float32)
    texts = [b"red fish red", b"", b"  ", b"bird\nnew"]
    got = Pooler(context).features(texts)
    for row, t in zip(got, texts, strict=True):
        words = t.decode().split()
        if not words:
            assert not row.any()
            continue
        assert np.allclose(row[:64], np.mean([word_vectors([w], context)[0] for w in words], axis=0), atol=1e-6)
        assert np.allclose(row[64:128], np.mean([word_vectors([w], context)[0] for w in set(words)], axis=0), atol=1e-6)
        assert np.isclose(row[129], len(set(words)) / len(words))


def test_every_byte_counts(spark):
    """Tails of unspaced words and of long fitting texts change the outcome."""
    context = plain_contexts(["a b"]).astype(np.float32)
    a, b = Pooler(context).features([b"x" * 5000, b"x" * 4900 + b"y!" * 50])
    assert not np.allclose(a, b)
    tail = ["good fine " * 40, "bad poor " * 40]
    docs = spark.createDataFrame([(i, "same words here " * 3000 + tail[i % 2]) for i in range(40)], "doc_id bigint, text string")
    model = fit_quality(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int"))
    scores = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)


def test_gradient():
    rng = np.random.default_rng(1)
    values, x, y = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)], rng.normal(size=(7, 5)), rng.integers(0, 2, 7).astype(float)

    def loss():
        logits = np.maximum(x @ values[0] + values[1], 0) @ values[2] + values[3]
        return np.mean(np.logaddexp(0, logits) - y * logits) + 0.05 * ((values[0] ** 2).sum() + (values[2] ** 2).sum())

    for p, g in zip(values, gradients(values, x, y, 0.1), strict=True):
        for at in np.ndindex(p.shape):
            p[at] += 1e-6
            up = loss()
            p[at] -= 2e-6
            down = loss()
            p[at] += 1e-6
            assert np.isclose((up - down) / 2e-6, g[at], atol=1e-6)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 10))
    p = 1 / (1 + np.exp(-2 * x[:, 0] * np.sign(x[:, 1])))
    y = (rng.random(2000) < p).astype(float)
    s = Network.fit(x[:1500], y[:1500], epochs=60).scores(x[1500:])
    assert np.mean((s > 0.5) == (p[1500:] > 0.5)) > 0.85
    assert abs(s.mean() - y[1500:].mean()) < 0.06


def tables(spark, sf="0.1"):
    return (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    rows = score_quality(docs, fit_quality(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    right = (rows.predicted == rows.quality).mean()
    assert right > 0.97 and right > max(rows.quality.mean(), 1 - rows.quality.mean()) + 0.05
    assert all(crc_fold(i, 5) == 0 for i in rows.doc_id)
    # labels outside the fold only: other values inside it change nothing
    turned = labels.withColumn("quality", F.when(fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = score_quality(docs, fit_quality(docs, turned)).select("doc_id", F.col("score").alias("other")).toPandas().merge(rows)
    assert np.allclose(again.score, again.other)


def test_odd_rows(spark):
    docs, labels = tables(spark, "0.01")
    model = fit_quality(docs, labels)
    rows = [(1, None, "c"), (2, "", "c"), (3, "x" * 100_000, None), (3, "word " * 30_000, "c"), (None, "no id", "c")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    out = score_quality(odd, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert score_quality(odd.limit(0), model).count() == 0
    assert {r.score for r in score_quality(odd, fit_quality(odd, labels.limit(0))).collect()} == {0.5}
