import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import token_counts as counting
from ledgerloom.llm.packing import WordIds, cut, differencing, fill, pack
from ledgerloom.llm.token_counts import _Library, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.lists(st.sampled_from([*"abA\u00c9\u00df\u00e9'st.,!1 \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u0301\u200d\u0130\u0399\u03a3\uff12<|>_\x00", "<|endoftext|>", "  ", "don't ", "<|startoftext|>"]), max_size=30).map("".join)
SAMPLES = ["", " ", "Hello,  world!!\n\n x", "Éréaux.%%% $$$", "a  b  <|endoftext|>  c<|endoftext|><|endoftext|>", "'s 'll don't", "x" * 3000, "字符和𝒳中文,12标点。don't" * 40, "İΣΑΣ ǅ é ́a"]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_ids_are_the_librarys(text):
    assert np.frombuffer(W.of([text.encode()])[0], "<u4").tolist() == T.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=20))
def test_word_ids_of_many_texts(found):
    assert [np.frombuffer(x, "<u4").tolist() for x in W.of([t.encode() for t in found])] == [T.encode(t, add_special_tokens=False).ids for t in found]


def test_spellings_share_their_parts():
    """Case and trailing marks of a word cost no entry of their own, so more words are kept and fewer go to the library again."""
    words, text = WordIds(WORD, 1 << 20), "\u00c9tat \u00e9tat, \u00c9TAT. \u00e9Tat.,\n\u00e9tat;\u00e9tat \u00e9t\u00d7at"
    assert np.frombuffer(words.of([text.encode()])[0], "<u4").tolist() == T.encode(text, add_special_tokens=False).ids
    assert {w.decode() for w in words.known} == {"\u00e9tat", ",", ".", ".,", ";", "\u00e9t\u00d7at"}


W, T = WordIds(WORD, 5000), Tokenizer.from_file(WORD)
L = _Library(BYTE)
B = L.tokenizer


@pytest.mark.parametrize("long", [0, 64])
@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_units_add_up(long, text):
    counting.LONG = long
    found = L.units(text)
    counting.LONG = 64
    assert "".join(found) == text
    assert sum(len(B.encode(u, add_special_tokens=False).ids) for u in found) == len(B.encode(text, add_special_tokens=False).ids)


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(0).integers(1, 1500, 200).tolist()
    window = differencing(sizes, 16)
    assert sorted(set(window.tolist())) == list(range(16))
    sums = np.bincount(window, sizes)
    assert sums.max() - sums.min() < 0.02 * sums.mean()
    assert differencing([], 3).tolist() == [] and differencing([5, 5], 1).tolist() == [0, 0] and sorted(differencing([5, 5], 2).tolist()) == [0, 1]
    assert sorted(np.bincount(differencing([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4]).tolist()) == [14, 16]  # as worked out by hand


def tokens_of(items):
    return sorted((d, s + k) for x in items for d, s, n in x for k in range(n))


@pytest.mark.parametrize("cuts", [True, False])
def test_fill(cuts):
    items = [[(i, 0, n)] for i, n in enumerate([60, 60, 60, 5, 5, 90, 100])]
    windows = fill(items, 100, cuts)
    assert all(0 < sum(p[2] for p in w) <= 100 for w in windows) and tokens_of(windows) == tokens_of(items)
    assert len(windows) == (4 if cuts else 5)  # four windows hold the total, but only if something is cut
    for seed in range(20):
        rng = np.random.default_rng(seed)
        items = [[(i, 0, int(n))] for i, n in enumerate(rng.integers(1, 400, rng.integers(1, 60)))]
        windows = fill(items, 400, cuts)
        assert all(0 < sum(p[2] for p in w) <= 400 for w in windows) and tokens_of(windows) == tokens_of(items)
        assert not cuts or len(windows) <= sum(x[0][2] for x in items) / 400 * (1 + 1 / 80) + 1


def test_cut():
    assert cut([(1, 5, 3), (2, 0, 4)], 4) == ([(1, 5, 3), (2, 0, 1)], [(2, 1, 3)]) and cut([(1, 0, 2)], 0) == ([], [(1, 0, 2)])


def docs_of(spark, extra=()):
    rows = [(i, t, "clash") for i, t in enumerate([*SAMPLES, *extra, None])] + [(0, "again", "clash"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, length string")


def test_pack_round_trip(spark):
    docs = docs_of(spark, ["word " * 9000, "Ünder the, sea. " * 700]).repartition(2)
    out = pack(docs, WORD, with_ids=True).collect()
    by_doc, by_window = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
    for rows in by_window.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for key, own in texts.items():
        want = [[*T.encode(t, add_special_tokens=False).ids, 2] for t in own]
        assert sum(r.length for r in by_doc[key]) == sum(map(len, want))
        if len(own) == 1:
            got = [i for r in sorted(by_doc[key], key=lambda r: r.start) for i in r.ids]
            assert got == want[0] and {r.doc_tokens for r in by_doc[key]} == {len(got)}
    assert pack(docs.limit(0), WORD).count() == 0


@pytest.mark.parametrize("partitions", [1, 16, 64, 211])
def test_pack_wastes_little(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    df = pack(docs.repartition(partitions, "doc_id"), WORD, with_ids=False)
    lengths = [r[0] for r in df.groupBy("sequence_id").sum("length").select("sum(length)").collect()]
    assert 0 < max(lengths) <= 4096 and sum(4096 - n for n in lengths) < 0.02 * 4096 * len(lengths)


def test_pack_many_empty_texts(spark):
    """One-token documents are put together first, so a group stays small."""
    out = pack(spark.range(0, 40_000, 1, 2).selectExpr("id as doc_id", "cast(null as string) as text"), WORD, with_ids=False)
    sizes = [r[0] for r in out.groupBy("sequence_id").sum("length").select("sum(length)").collect()]
    assert out.select("doc_id").distinct().count() == out.count() == sum(sizes) == 40_000 and len(sizes) == 10


def test_token_counts(spark):
    docs = docs_of(spark).repartition(3)
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(B.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    for hot in (0, 5, 1000):
        out = token_counts(docs, BYTE, limit=5, hot=hot).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out) == want
        assert all(r.over_limit == (r.n_tokens > 5) for r in out)
    assert token_counts(docs.limit(0), BYTE).count() == 0


def test_token_counts_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, BYTE, hot=2000).collect()}
    assert got == {r.doc_id: len(B.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


UNSPACED = """
import glob, random, sys
import public_tokenizers
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from ledgerloom.llm.decontamination import contaminated
from ledgerloom.llm.packing import pack
from ledgerloom.llm.substrings import remove_repeats
from ledgerloom.llm.token_counts import token_counts

spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).config("spark.driver.memory", "3g").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
# 10 kB of letters, signs and digits without a space, no two alike
line = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(156)), lambda i: F.translate(F.sha2(F.concat_ws(":", "id", i).cast("string"), 256), "0369cf", "中,文xé7")))
spark.range(0, 5000, 1, 8).select(F.col("id").alias("doc_id"), line.alias("text")).write.parquet(sys.argv[1] + "/docs")
docs = spark.read.parquet(sys.argv[1] + "/docs")
items = spark.createDataFrame([(1, "six words that are never there")], "item_id bigint, text string")
word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
assert contaminated(docs, items).count() == 0
assert {r.n_removed for r in remove_repeats(docs, with_text=False).collect()} == {0}
packed = {r.doc_id: r.doc_tokens for r in pack(docs, word, with_ids=False).collect()}
counted = {r.doc_id: r.n_tokens for r in token_counts(docs, byte).collect()}
for r in docs.where("doc_id % 500 = 0").collect():
    assert packed[r.doc_id] == len(Tokenizer.from_file(word).encode(r.text, add_special_tokens=False).ids) + 1
    assert counted[r.doc_id] == len(Tokenizer.from_file(byte).encode(r.text, add_special_tokens=False).ids)
peaks = []
for path in glob.glob("/proc/[0-9]*"):
    try:
        if "pyspark/daemon" in (said := open(path + "/cmdline").read()) or "pyspark.daemon" in said:
            own = open(path + "/status").read()
            peaks.append(int(own.split("VmHWM:")[1].split()[0]) // 1024)
    except OSError:
        pass
print("peak MB", max(peaks))
"""


def test_workers_stay_small_on_unspaced_texts(tmp_path):
    import os
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", UNSPACED, str(tmp_path)], capture_output=True, text=True, timeout=900, env=os.environ)
    assert done.returncode == 0, done.stderr[-3000:]
    assert int(done.stdout.rsplit("peak MB", 1)[1]) < 400, done.stdout
