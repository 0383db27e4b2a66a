"""Token counts from distinct pre-tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import LONG, blocks, frugal, kept, stored, tokenizer_of

#: The white space of Unicode.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the one space before it, or white space that no word takes.
_UNIT = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class _Library:
    """The tokenizer of a file, and where it always cuts a text."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple(sorted((a.content for a in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True))

    def units(self, text: str) -> list[str]:
        """Cuts a text where byte-level BPE always cuts it; the parts' token counts add up to the text's.

        Parts are words with the space before; one of over LONG signs, as all are in
        unspaced scripts, is cut into its pre-tokens, which come again elsewhere.
        Strings of special tokens are parts of their own, as the library takes them
        out of a text before anything else.
        """
        if any(s in text for s in self.special):
            return [u for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) for u in ([part] if part in self.special else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        found = _UNIT.findall(text)
        if max(map(len, found), default=0) > LONG:
            found = [p for u in found for p in ([u[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(u)] if len(u) > LONG else (u,))]
        return found


def _key(path: str) -> tuple:
    return "token counts", path


def _library(path: str) -> _Library:
    return kept(_key(path), lambda: _Library(path))


def distinct_units(docs: DataFrame, path: str, text_col: str = "text", most: int = 1 << 26) -> DataFrame:
    """(unit, n): every distinct pre-token of the corpus and how often it occurs; a task holds ``most`` bytes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, counts, held, large = _library(path), Counter(), 0, 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["unit", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                if (text := text.as_py()) is not None:
                    before, found = len(counts), library.units(text)
                    counts.update(found)
                    held += 150 * (len(counts) - before)
                    large += sum(len(u) for u in found if len(u) > LONG)  # repeats counted: at most the bytes that are held
                    if held + large > most:
                        yield out()
                        held = large = 0
        yield out()

    return docs.select(F.col(text_col)).mapInArrow(frugal(run, _key(path)), "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def piece_counts(distinct: DataFrame, path: str) -> DataFrame:
    """Adds ``pieces``, the number of tokens of each unit; no ids leave the library call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _library(path).tokenizer
        for batch in batches:
            values = batch.column(0).to_pylist()
            for a, b in blocks(values, 1 << 16):  # the library's results take many times the text
                pieces = [len(e) for e in tokenizer.encode_batch_fast(values[a:b], add_special_tokens=False)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pieces, pa.int32())], names=["unit", "n", "pieces"])

    return distinct.mapInArrow(frugal(run, _key(path)), "unit string, n bigint, pieces int")


def frequent(counted: DataFrame, most: int) -> DataFrame:
    """The most frequent units of up to LONG bytes, ``most`` of them at the utmost.

    Counts are put in at most a few hundred classes, eight to each power of
    two; whole classes are taken from the top as long as they fit.
    """
    level = F.floor(F.log2("n") * 8)
    left, least = most, None
    counted = counted.where(F.octet_length("unit") <= LONG)
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["level"]
    return counted.where(level >= least if least is not None else F.lit(False))


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, hot: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Pieces are counted once per distinct pre-token of the corpus. The most
    frequent pre-tokens, at most ``hot``, are joined where documents are read;
    the frequencies of all others are shuffled to their counts and summed per
    document, so no key of that shuffle is a frequent one. Nothing but the hot
    list passes the driver: at most ``hot`` pre-tokens of LONG bytes each (8 MB),
    at any size of input. Longer ones always go through the shuffle.

    Null text counts as empty (0 bytes, 0 tokens). Each row keeps its own
    result, so ids may repeat or be null. A very long text takes memory in
    proportion to its pre-tokens in the task that reads it. Other columns are
    ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    counted = stored(piece_counts(distinct_units(docs, tokenizer_path, text_col), tokenizer_path), "pieces")
    top = frequent(counted, hot).select("unit", "pieces").toArrow()
    known = spark.sparkContext.broadcast((top.column(0).to_pylist(), top.column(1).to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, get = _library(tokenizer_path), dict(zip(*known.value, strict=True)).get
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            written = batch.column(1).to_pylist()
            for a, b in blocks([t or "" for t in written], 1 << 20):
                part = batch.slice(a, b - a)
                sums, n_bytes, rare, rare_rows, times = [], [], [], [], []
                for text in written[a:b]:
                    values = list(map(get, found := library.units(text or "")))
                    if None in values:
                        for u, n in Counter(u for u, v in zip(found, values, strict=True) if v is None).items():
                            rare_rows.append(row)
                            rare.append(u)
                            times.append(n)
                        values = [v for v in values if v is not None]
                    n_bytes.append(len((text or "").encode()))
                    sums.append(sum(values))
                    row += 1
                n, k = len(sums), len(rare)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*range(row - n, row), *rare_rows], pa.int64()),
                        pa.concat_arrays([part.column(0), pa.nulls(k, part.column(0).type)]),
                        pa.array([True] * n + [False] * k),
                        pa.array(n_bytes + [0] * k, pa.int64()),
                        pa.array([str(i) for i in range(row - n, row)] + rare, pa.string()),
                        pa.array(sums + times, pa.int64()),
                    ],
                    names=["row", "id", "own", "n_bytes", "unit", "n"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(
        frugal(run, _key(tokenizer_path)), f"row bigint, id {id_type}, own boolean, n_bytes bigint, unit string, n bigint"
    )
    # a document's own row joins nothing; its key only spreads such rows over the partitions
    pieces = counted.select(F.lit(False).alias("own"), "unit", "pieces")
    joined = rows.join(pieces, ["own", "unit"], "left")
    tokens = F.when(F.col("own"), F.col("n")).otherwise(F.col("n") * F.col("pieces"))
    out = joined.groupBy("row").agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
