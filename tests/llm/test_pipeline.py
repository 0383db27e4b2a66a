import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpus_pipeline import STAGES

SF = "/root/testdata/sf0.001"
WORDS = {"en": "the of and to in that with for are this from have been which".split(), "fr": "le la de que une dans pour avec sont cette depuis être".split()}


def text_of(rng, lang, n):
    return " ".join(w + "".join(rng.choice(list("abcdefghij"), 4)) if rng.random() < 0.6 else w for w in rng.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with planted cases; returns (folder, what each case should come to)."""
    rng = np.random.default_rng(4)
    d = str(tmp_path_factory.mktemp("tables"))
    rows, n = [], 0
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        rows.append([i, text_of(rng, lang, 120), lang, "s", 0])
    item = text_of(rng, "en", 30)
    passage = text_of(rng, "en", 60)
    rows.append([200, rows[1][1], "en", "s", 0])  # exact copy of 1
    edited = rows[2][1].split()
    edited[60] = "changed"
    rows.append([201, " ".join(edited), "en", "s", 0])  # near copy of 2
    rows.append([202, text_of(rng, "en", 100) + " " + item + " " + text_of(rng, "en", 50), "en", "s", 0])
    for k in range(2):
        rows.append([203 + k, text_of(rng, "en", 90) + " " + passage + " " + text_of(rng, "en", 90), None, "s", 0])
    rows += [[205, None, "en", "s", 0], [206, "12 34 !!", "en", None, 0], [207, "", "fr", "s", 0], [None, text_of(rng, "fr", 80), "fr", "s", 0], [4, rows[4][1], "en", "s", 0]]
    for r in rows:
        r[4] = len(r[1] or "")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, passage


def test_stages_on_planted_cases(spark, tables):
    d, rows, passage = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
        seen[name, "n"] = docs.count()
    clean = {r[0] for r in rows} - {205, 206, 207}
    assert set(seen["language"]) == clean and seen["language", "n"] == len(rows) - 3
    assert seen["language"][203].lang == "en"
    assert set(seen["near_duplicates"]) == clean - {200, 201} and seen["near_duplicates", "n"] == len(clean) - 2
    left = seen["substrings"]
    assert set(left) == clean - {200, 201}
    for i in (203, 204):
        assert passage not in left[i].text and len(left[i].text.split()) == 180
    assert all(r.n_chars == len(r.text) for r in left.values())
    for i in set(left) - {203, 204}:
        assert left[i].text == " ".join(seen["near_duplicates"][i].text.split())
    assert set(seen["decontamination"]) == clean - {200, 201, 202}
    pieces = STAGES[-1][1](spark, docs, d).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by = {}
    for r in sorted(pieces, key=lambda r: r.start):
        by.setdefault(r.doc_id, []).extend(r.ids)
    assert by == {i: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for i, r in seen["decontamination"].items()}


def test_other_columns_and_long_texts(spark, tables, tmp_path):
    """Columns whose names the stages might use pass unchanged; a very long text passes; the session keeps its settings."""
    d, rows, _ = tables
    rng = np.random.default_rng(9)
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id between 10 and 60 or doc_id in (200, 202)")
    long = spark.createDataFrame([(500, text_of(rng, "en", 60_000), "en", "s", 0), (501, "é" * 50_000, None, "s", 0)], docs.schema)
    docs = docs.unionByName(long).selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in ("__row", "__id", "row", "doc", "kept", "text_", "lang_pred", "score", "n")])
    before = dict(spark.sparkContext.getConf().getAll()) | {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch",)}
    left = docs
    for name, stage in STAGES[:-1]:
        left = stage(spark, left, d)
        left.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        assert left.columns == docs.columns
    got = left.collect()
    assert {r.doc_id for r in got} >= {*range(10, 61), 500} and 202 not in {r.doc_id for r in got}
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in docs.columns[5:])
    assert before == dict(spark.sparkContext.getConf().getAll()) | {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch",)}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in STAGES] == ["language", "near_duplicates", "substrings", "decontamination", "packing"]


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
