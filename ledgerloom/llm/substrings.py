"""Removal of word sequences that occur more than once in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.automaton import SuffixAutomaton
from ledgerloom.llm.shared import LONG, frugal, pieces, stored

#: Words of the grams from which a window's anchor is chosen.
GRAM = 8
#: Longest stretch of a document that is looked at in one go.
STRETCH = 1 << 20
#: Variants of one anchor that one automaton takes; windows of the others meet by their digests.
VARIANTS = 128
#: Words of the fragments in one automaton (whole anchors).
SHARD_WORDS = 30_000


class _Numbers(dict):
    """64-bit hashes of words, each worked out once; forgets all at a bound, and long words at once."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def fragments(numbers: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, count, place): runs of windows that share one anchor, and where its gram begins.

    A window's anchor is its least gram by hash (the leftmost of equals): equal
    windows choose equal anchors at the same place, whatever surrounds them.
    Neighbouring windows mostly share theirs, at most ``window - gram + 1``.
    """
    gram = min(gram, window)
    n = len(numbers) - gram + 1
    value = np.zeros(n, np.uint64)
    for j in range(gram):
        value = value * np.uint64(0x9E3779B97F4A7C15) + numbers[j : j + n]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    low = np.uint64((1 << 21) - 1)
    least = (value & ~low) | np.arange(n, dtype=np.uint64)
    span, width = window - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least & low).astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    return value[place[starts]].view(np.int64), starts, np.diff(np.concatenate([starts, [len(place)]])), place[starts]


def _key(docs: DataFrame, id_col: str) -> Column:
    plain = isinstance(docs.schema[id_col].dataType, T.LongType)
    return F.coalesce(F.col(id_col) if plain else F.xxhash64(id_col), F.lit(-1).cast("bigint"))


def _occurrences(keyed: DataFrame, window: int) -> DataFrame:
    """(k, t, start, n, anchor, digest): every fragment of every document; digest stands for its words."""
    names = ["k", "t", "start", "n", "anchor", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Numbers()
        for batch in batches:
            ks, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, values in pieces(batch, "text", 2 << 20):
                out = []
                for i in range(a, b):
                    words = values[i - a].split()
                    for at in range(0, max(0, len(words) - window + 1), STRETCH):
                        part = words[at : at + STRETCH + window - 1]
                        anchors, starts, counts, _ = fragments(hashed.of(part), window)
                        joined, lengths = b" ".join(part), np.fromiter(map(len, part), np.int64, len(part))
                        ends = np.cumsum(lengths + 1) - 1
                        begins = (ends - lengths)[starts].tolist()
                        finals = ends[starts + counts + window - 2].tolist()
                        digests = np.array([xxhash.xxh3_64_intdigest(joined[x:y]) for x, y in zip(begins, finals, strict=True)], np.uint64)
                        m = len(starts)
                        out.append((np.full(m, ks[i]), np.full(m, ts[i]), starts + at, counts, anchors, digests.view(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return keyed.select("k", "t", "text").mapInArrow(frugal(run), "k bigint, t bigint, start bigint, n bigint, anchor bigint, digest bigint")


def _fragment_words(keyed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(anchor, digest, weight, n, many, words): the wanted fragments with their words."""
    lists = wanted.groupBy("k", "t").agg(F.collect_list(F.struct("start", "n", "anchor", "digest", "weight", "many")).alias("w"))
    both = keyed.select("k", "t", "text").join(stored(lists, "wanted"), ["k", "t"]).dropDuplicates(["k", "t"]).select("text", *[F.col(f"w.{c}").alias(c) for c in ("start", "n", "anchor", "digest", "weight", "many")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values in pieces(batch, "text", 1 << 20):
                out = []
                for i in range(a, b):
                    words = values[i - a].split()
                    lists = [batch.column(c)[i].as_py() for c in range(1, 7)]
                    for start, n, anchor, digest, weight, many in zip(*lists, strict=True):
                        out.append((anchor, digest, weight, n, many, b" ".join(words[start : start + n + window - 1])))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "digest", "weight", "n", "many", "words"]
                    )

    return both.mapInArrow(frugal(run), "anchor bigint, digest bigint, weight bigint, n bigint, many boolean, words binary")


def repeated_in_shard(rows: list[tuple[int, int, int, bytes]], window: int) -> list[tuple[int, int, int]]:
    """(anchor, digest, mask) for fragments (anchor, digest, weight, words) of one shard; bit i of mask: window i occurs again."""
    automaton, numbers, sequences = SuffixAutomaton(), {}, []
    for _, _, weight, words in rows:
        sequence = [numbers.setdefault(w, len(numbers)) for w in words.split(b" ")]
        automaton.add(sequence, weight)
        sequences.append(sequence)
    automaton.finish()
    out = []
    for (anchor, digest, weight, _), sequence in zip(rows, sequences, strict=True):
        if weight == 1:
            mask = sum(1 << i for i, c in enumerate(automaton.occurrences(sequence, window)) if c > 1)
            if mask:
                out.append((anchor, digest, mask))
    return out


def _by_automata(words: DataFrame, window: int) -> DataFrame:
    """Masks of the fragments of anchors with few variants: shards of whole anchors, an automaton for each."""
    names = ["anchor", "digest", "mask"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def judged() -> pa.RecordBatch:
            found = repeated_in_shard(rows, window)
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in range(3)], names=names)

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                if held > SHARD_WORDS and rows[-1][0] != row[0]:
                    yield judged()
                    rows, held = [], 0
                rows.append(row)
                held += row[3].count(b" ") + 1
        if rows:
            yield judged()

    few = words.where(~F.col("many")).select("anchor", "digest", "weight", "words")
    return few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(frugal(run), "anchor bigint, digest bigint, mask bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _by_digests(words: DataFrame, window: int) -> DataFrame:
    """The same for anchors with many variants, without gathering a group.

    Each window holds at least half of its other words on one side of the gram,
    so it can only recur where the gram with that half does. Halves are counted
    first; the windows of those that recur are then counted by their digests.
    """
    half = (window - GRAM + 1) // 2
    many = words.where("many").select("anchor", "digest", "weight", "words")

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Numbers()
        for batch in batches:
            out = []
            for anchor, digest, weight, joined in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                part = joined.split(b" ")
                at = int(fragments(hashed.of(part), window)[3][0])
                n, turn = len(part) - window + 1, at + GRAM + half - window  # windows from ``turn`` on lean to the right
                if turn > 0:
                    own = part[at - (window - GRAM - half + 1) : at + GRAM]
                    out.append((anchor, digest, weight, 0, min(turn, n), _signed(xxhash.xxh3_64_intdigest(b" ".join(own)))))
                if turn < n:
                    own = part[at : at + GRAM + half]
                    out.append((anchor, digest, weight, max(turn, 0), n, _signed(xxhash.xxh3_64_intdigest(b"\n" + b" ".join(own)))))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(6)], names=["anchor", "digest", "weight", "a", "b", "own"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, digest, weight, a, b, joined in zip(*[batch.column(c).to_pylist() for c in range(6)], strict=True):
                part = joined.split(b" ")
                out += [(anchor, digest, weight, i, _signed(xxhash.xxh3_64_intdigest(b" ".join(part[i : i + window])))) for i in range(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], names=["anchor", "digest", "weight", "place", "own"])

    sides = stored(many.mapInArrow(frugal(halves), "anchor bigint, digest bigint, weight bigint, a bigint, b bigint, own bigint"), "halves")
    again = stored(sides.groupBy("anchor", "own").agg(F.sum("weight").alias("times")).where("times > 1").drop("times"), "again")
    wanted = sides.join(again, ["anchor", "own"]).select("anchor", "digest", "weight", "a", "b")
    wanted = wanted.join(many.select("anchor", "digest", "words"), ["anchor", "digest"]).select("anchor", "digest", "weight", "a", "b", "words")
    windows = stored(wanted.mapInArrow(frugal(each), "anchor bigint, digest bigint, weight bigint, place bigint, own bigint"), "windows")
    often = stored(windows.groupBy("anchor", "own").agg(F.sum("weight").alias("times")).where("times > 1").drop("times"), "often")
    hit = windows.where("weight = 1").join(often, ["anchor", "own"])
    return hit.groupBy("anchor", "digest").agg(F.bit_or(F.expr("shiftleft(1L, cast(place as int))")).alias("mask"))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, ``with_text``, kept.

    Removes every word covered by a window of ``window`` words that starts
    anywhere else too, in the same or another document. Words are what lies
    between ASCII white space; kept words are joined by single spaces. All
    copies of a repeated window go, judged on the input.

    A corpus cannot be broadcast to itself, so the reference is cut into shards
    that only meet the stretches which can match. Each window has an anchor, a
    gram chosen by its content; runs of windows with one anchor form fragments.
    Fragments whose anchor occurs once are unique. Equal fragments are counted
    before they meet others, so groups of copies are one row. The differing
    fragments of an anchor go to one shard, whose suffix automaton, with counts,
    is streamed over with them: it gives how often each window occurs. Anchors
    with over VARIANTS different fragments are not gathered: their windows are
    counted by digest, with the same result. Digests are 128 bits in effect.

    Null text has no words. A very long text takes memory in proportion to its
    words. Each row is judged for itself and rows that repeat count as elsewhere; null ids are allowed. Documents shorter than a window
    keep all. Other columns are ignored. An empty table gives no rows.
    """
    if not GRAM <= window <= GRAM + 61:
        raise ValueError("the masks of a fragment hold windows of 8 to 69 words")
    keyed = docs.select(F.col(id_col).alias("id"), _key(docs, id_col).alias("k"), F.coalesce(text_col, F.lit("")).alias("text"))
    keyed = keyed.select("id", "k", F.xxhash64("text").alias("t"), "text")
    found = stored(_occurrences(keyed, window), "fragments")
    # sums are stored before they are joined: only a join of two plain shuffles can split a hot key
    again = stored(found.groupBy("anchor").count().where("count > 1").select("anchor"), "again")
    found = stored(found.join(again, "anchor", "left_semi"), "candidates")

    kinds = found.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("k", "t", "start", "n")).alias("at"))
    kinds = stored(kinds.select("anchor", "digest", "weight", "at.*"), "kinds")
    variants = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1"), "variants")
    wanted = kinds.join(variants, "anchor").withColumn("many", F.col("variants") > VARIANTS).drop("variants")
    words = stored(_fragment_words(keyed, wanted, window), "words")
    masks = _by_automata(words, window).unionByName(_by_digests(words, window))
    masks = masks.unionByName(kinds.where("weight > 1").select("anchor", "digest", F.expr("shiftleft(1L, cast(n as int)) - 1").alias("mask")))

    spans = found.join(masks, ["anchor", "digest"]).groupBy("k", "t").agg(F.collect_set(F.struct("start", "mask")).alias("s"))
    both = keyed.join(stored(spans, "spans"), ["k", "t"], "left").select("id", "text", F.col("s.start").alias("start"), F.col("s.mask").alias("mask"))
    names = [id_col, "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values in pieces(batch, "text", 4 << 20):
                rows = []
                for i in range(a, b):
                    words = values[i - a].split()
                    total = len(words)
                    if (starts := batch.column(2)[i].as_py()) is not None:
                        masks = np.array(batch.column(3)[i].as_py(), np.int64)
                        at, bit = np.nonzero((masks[:, None] >> np.arange(62)[None, :]) & 1)
                        begins = np.array(starts, np.int64)[at] + bit
                        change = np.zeros(total + 1, np.int64)
                        np.add.at(change, begins, 1)
                        np.add.at(change, begins + window, -1)
                        covered = np.cumsum(change[:total]) > 0
                        words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    kept = b" ".join(words)
                    rows.append((total, total - len(words), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
                cols = list(zip(*rows, strict=True))
                arrays = [batch.column(0).slice(a, b - a), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(cols[3], pa.binary()).cast(pa.string())] if with_text else []), names=names)

    id_type = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(frugal(run), f"`{id_col}` {id_type}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if with_text else ""))


def oracle(window: int) -> str:
    """The result over ``documents`` as DuckDB SQL (ids must be unique)."""
    return rf"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
 l as (select doc_id, list_transform(generate_series(1, len(ws) - {window - 1}), lambda i: sha256(array_to_string(ws[i:i + {window - 1}], ' '))) as hs
  from w where len(ws) >= {window}),
 s as (select doc_id, unnest(generate_series(1, len(hs))) as i, unnest(hs) as h from l),
 g as (select doc_id, i, count(*) over (partition by h) as c from s),
 p as (select doc_id, unnest(generate_series(1, len(ws))) as i, unnest(ws) as word from w),
 m as (select p.doc_id, p.i, word, max(case when c > 1 then p.i end) over (partition by p.doc_id order by p.i rows between {window - 1} preceding and current row) as hit
  from p left join g on p.doc_id = g.doc_id and p.i = g.i),
 k as (select doc_id, count(hit) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (hit is null), '') as kept from m group by 1)
 select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
 from w left join k on w.doc_id = k.doc_id"""
