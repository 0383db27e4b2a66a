import os
import sys

import pytest

from ledgerloom.llm.sharding import extendible_shards, oracle, write_shards

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import rows_of_spark, rows_of_sql, same  # noqa: E402


def check(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # no shard inside another
    for own in by.values():
        assert len({r.depth for r in own}) == 1
        if own[0].over_limit:
            assert len(own) == 1
        else:
            assert sum(r.n_bytes for r in own) == own[0].shard_bytes <= limit
    return by


@pytest.mark.parametrize("limit", [1 << 20, 50_000, 9_000])
def test_whole_table(spark, limit):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = extendible_shards(docs, limit)
    rows = out.collect()
    assert len(rows) == docs.count()
    check(rows, limit)
    if max(r.n_bytes for r in rows) <= limit:
        names, got = rows_of_spark(out)
        sql_names, want = rows_of_sql(oracle(limit), "/root/testdata/sf0.001")
        assert names == sql_names and same(got, want)


def test_heavy_key_nulls_and_repeats(spark):
    rows = [(7, "x" * 100, "c")] * 400 + [(None, "n" * 10, None)] * 3 + [(i, "y" * 50, "c") for i in range(300)] + [(9000, "z" * 3000, "c"), (9001, None, "c"), (9002, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string").repartition(3)
    out = extendible_shards(docs, 1000).collect()
    assert len(out) == len(rows)
    by = check(out, 1000)
    assert len(by) > 60 and [r.doc_id for r in out if r.over_limit] == [9000]


def test_empty_and_write(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 40) for i in range(50)], "doc_id bigint, text string")
    assert extendible_shards(docs.limit(0), 10).count() == 0
    shards = extendible_shards(docs, 400)
    write_shards(docs, shards, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    assert "Python" not in shards._jdf.queryExecution().toString()
