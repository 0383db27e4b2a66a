"""Spelling variants: pairs of words one edit apart, by finite-state composition."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import small_or_stored, stored, texts

#: Most words, and bytes of them, of a cell that a task composes at once.
CELL, CELL_BYTES = 1 << 14, 1 << 23
#: Bytes of the words that a task counts before it hands them on.
COUNTED = 1 << 25


class Acceptor:
    """The minimal acyclic automaton of sorted words; state 0 is initial.

    ``arcs`` has the arcs of each state in order of their letters; with the
    number of words that each state accepts, a path tells the number of its word.
    """

    def __init__(self, words: Sequence[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""
        for w in [*words, None]:
            n = 0
            if w is not None:
                while n < len(last) and n < len(w) and last[n] == w[n]:
                    n += 1
            # states below the shared prefix are complete: each becomes the known state that equals it
            for i in range(len(last), n if w is not None else 0, -1):
                state = path.pop()
                form = (self.final[state], *self.arcs[state].items())
                self.arcs[path[-1]][last[i - 1]] = known.setdefault(form, state)
            for c in (w or "")[n:]:
                self.arcs[path[-1]][c] = len(self.arcs)
                path.append(len(self.arcs))
                self.arcs.append({})
                self.final.append(False)
            if w is not None:
                self.final[path[-1]] = True
                last = w
        self.words = [0] * len(self.arcs)
        ahead = [(0, False)]
        while ahead:
            state, ready = ahead.pop()
            if ready:
                self.words[state] = self.final[state] + sum(self.words[s] for s in self.arcs[state].values())
            elif not self.words[state]:
                ahead.append((state, True))
                ahead += [(s, False) for s in self.arcs[state].values() if not self.words[s]]

        self.known_steps: dict[int, list[tuple[str, int, int]]] = {}

    def steps(self, state: int) -> list[tuple[str, int, int]]:
        """(letter, next state, number of the state's words that come before those of the arc)."""
        if (out := self.known_steps.get(state)) is None:
            out, n = [], int(self.final[state])
            for c, s in self.arcs[state].items():
                out.append((c, s, n))
                n += self.words[s]
            self.known_steps[state] = out
        return out


def composed(a: Acceptor) -> Iterator[tuple[int, int]]:
    """Numbers of all two accepted words that one edit turns into each other, each two once at least.

    The composition of the acceptor, the transducer of one edit and the acceptor
    again: before the edit both sides are in one state, the edit moves one or
    both of them on by an arc, and after it they move by equal letters. States
    of the minimal acceptor that are the same accept the same rests, so pairs
    that meet in one state are read off without walking on.
    """
    before = [(0, 0)]
    while before:
        state, n = before.pop()
        arcs = a.steps(state)
        before += [(s, n + i) for _, s, i in arcs if a.words[s] > 1]  # one word has no partner below
        after = [(s, state, n + i, n) for _, s, i in arcs]  # a letter deleted on one side
        after += [(s, t, n + i, n + j) for x, (_, s, i) in enumerate(arcs) for _, t, j in arcs[:x]]  # a letter replaced
        while after:
            p, q, i, j = after.pop()
            if p == q:
                yield from ((i + k, j + k) for k in range(a.words[p]))
                continue
            if a.final[p] and a.final[q]:
                yield i, j
            if a.arcs[p] and a.arcs[q]:
                other = {c: (t, k) for c, t, k in a.steps(q)}
                after += [(s, other[c][0], i + k, j + other[c][1]) for c, s, k in a.steps(p) if c in other]


def near_pairs(words: Sequence[str]) -> set[tuple[int, int]]:
    """(i, j) with i < j: all two of the distinct words that are one insertion, deletion or replacement apart."""
    order = sorted(range(len(words)), key=words.__getitem__)
    return {tuple(sorted((order[i], order[j]))) for i, j in composed(Acceptor([words[k] for k in order]))}


def corpus_words(docs: DataFrame, shortest: int, every: int, id_col: str, text_col: str) -> DataFrame:
    """(word, n) with a letter left out of one run in ``every``, as ``spelling_variants`` says."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, texts(batch, text_col), strict=True):
                key = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for w, n in Counter(runs.findall(text.lower().decode())).items():  # bytes: only A to Z change
                    h = zlib.crc32(w.encode(), key)
                    if h % every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < shortest:
                            continue
                    if w not in counts:
                        held += len(w) + 100
                    counts[w] += n
                if held > COUNTED:
                    yield out()
                    counts.clear()
                    held = 0
        yield out()

    return docs.select(id_col, text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _cells(words: DataFrame) -> DataFrame:
    """(word, n, least, low, high, key) of (word, n, least, low, high).

    least is the length of the shorter word of a pair in question, and the edit
    lies at one of its places from low to high; all else is equal in the two
    and makes the key, in 128 bits. The middle of a word is what lies between.
    """
    rest = F.col("least") - F.col("high")
    outside = F.concat(F.expr("left(word, low)"), F.lit("|"), F.expr("right(word, least - high)"))
    parts = [F.xxhash64(F.lit(seed), "least", "low", "high", outside) for seed in (0, 1)]
    middle = F.expr("substring(word, low + 1, length(word) - low - (least - high))")
    return words.where(rest >= 0).withColumns({"middle": middle, "key": F.struct(parts[0].alias("a"), parts[1].alias("b"))})


def pairs_of_cells(cells: DataFrame) -> DataFrame:
    """(word, near, near_n): the near words of each word of a cell, both ways, for edits that belong to the cell's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[tuple] = []

        def close() -> None:
            if len(held) < 2:
                return
            words, n, middles, low, high, least = zip(*held, strict=True)
            place, end = low[0], least[0] == high[0]
            for i, j in near_pairs(middles):
                a, b = sorted((middles[i], middles[j]), key=len)
                if min(len(words[i]), len(words[j])) != least[0]:
                    continue  # both are the longer ones of other pairs
                same = 0
                while same < len(a) and a[same] == b[same]:
                    same += 1
                # the edit counts at its first possible place, so that one cell has it
                if place + same < high[0] or end:
                    out.append((words[i], words[j], n[j]))
                    out.append((words[j], words[i], n[i]))

        def batch_of() -> pa.RecordBatch:
            word, near, n = zip(*out, strict=True) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

        for batch in batches:
            a, b = (batch.column(0).field(i).to_pylist() for i in range(2))
            for here, *row in zip(zip(a, b, strict=True), *[batch.column(c).to_pylist() for c in range(1, 7)], strict=True):
                if here != key:
                    close()
                    key, held = here, []
                held.append(row)
            if len(out) > 10_000:
                yield batch_of()
        close()
        yield batch_of()

    dealt = cells.repartition("key").sortWithinPartitions("key").select("key", "word", "n", "middle", "low", "high", "least")
    return dealt.mapInArrow(run, "word string, near string, near_n bigint")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): for each of (word, n) all words that are one edit away.

    Words meet in cells of those that are equal but for a stretch, in which the
    edit of a pair lies: first the front or the back half. The cells are the
    partitions of the composition by its state ahead of the stretch. A cell of
    more than CELL words or CELL_BYTES bytes is parted again by halves of its
    stretch, down to stretches of one letter, in which the alphabet bounds it.
    """
    length = F.length("word")
    least = F.explode(F.array(length, length - 1)).alias("least")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("low"), F.floor(F.col("least") / 2).cast("int").alias("high")), F.struct(F.floor(F.col("least") / 2).cast("int").alias("low"), F.col("least").alias("high"))))
    cells = _cells(words.select("word", "n", least).select("word", "n", "least", halves.alias("at")).select("word", "n", "least", "at.low", "at.high"))
    done: list[DataFrame] = []
    while True:
        cells = stored(cells, "cells")
        crowd = cells.groupBy("key").agg(F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word")).alias("bytes"), F.max(F.col("high") - F.col("low")).alias("width"))
        crowd = small_or_stored(crowd.where(((F.col("words") > CELL) | (F.col("bytes") > CELL_BYTES)) & (F.col("width") > 1)).select("key"), "crowded-cells")
        if crowd.isEmpty():
            done.append(cells)
            break
        done.append(cells.join(crowd, "key", "left_anti"))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        split = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        again = cells.join(crowd, "key", "left_semi").withColumn("at", F.explode(split))
        cells = _cells(again.select("word", "n", "least", "at.low", "at.high"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return pairs_of_cells(out)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to; each step doubles the way gone."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("via"), F.col("root").alias("end"))
        at = stored(at.join(ahead, F.col("root") == F.col("via"), "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "roots")
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.drop("moved")


def spelling_variants(
    docs: DataFrame, shortest: int = 5, least: int = 3, ratio: int = 2, every: int = 97, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are the runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A to Z
    lower-cased, of at least ``shortest`` letters and ``least`` occurrences (n). If ``every``
    divides the crc32 h of ``<doc_id>:<run>``, the run's letter number h modulo its
    length is left out first. Two words are near if one inserted, deleted or
    replaced letter makes them equal. The form is the near word of the largest
    n, the first by code point among equals, if its n is at least ``ratio``
    times (at least 2) that of the word; else null. The root is where forms
    lead in the end, the word itself if it has none.

    See ``near_words`` for how near words meet. The number of a word's near
    words is bounded by its length and the alphabet.

    Null and empty texts have no words; a null id is written as an empty string
    before the colon. Repeated rows count each. A very long text takes memory in
    proportion to its words. Other columns are ignored. An empty table gives no
    rows.
    """
    if ratio < 2:
        raise ValueError("forms could lead in circles")
    words = stored(corpus_words(docs, shortest, every, id_col, text_col).where(F.col("n") >= least), "words")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    form: Column = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best.near"))
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast(T.LongType()).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.n")).alias("form_n"))
    out = stored(out, "forms")
    root = roots(out.where(F.col("form").isNotNull()).select("word", "form"))
    return out.join(root, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
