"""Ranked lexical search by the Best Position Algorithm."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.shared import stored, texts

#: A term is a run of ASCII letters and digits and of whatever is not ASCII, as a pattern for SQL.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))
_FOLDED = _PLAIN.lower()
#: Most queries, and bytes of them, that are looked for in one pass over the documents.
QUERIES, QUERY_BYTES = 4096, 1 << 24
#: Postings of the documents that a task searches at once, some 24 bytes each.
POSTINGS = 1 << 21
#: Entries of each list that the first round of a search reads; each further round reads twice as many.
STEP = 32
#: Tasks whose best documents meet before all do.
TASKS = 64


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, only A to Z lower-cased."""
    return text.translate(_FOLDED).split()


def queries_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, n_bytes, terms, times) of each row; item numbers the rows."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [Counter(terms_of(t)) for t in texts(batch, text_col)]
            cols = [
                pa.array(range(row, row + len(found)), pa.int64()), batch.column(0), pa.array([sum(map(len, c)) for c in found], pa.int64()),
                pa.array([[t.decode() for t in c] for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64())),
            ]
            row += len(found)
            yield pa.RecordBatch.from_arrays(cols, names=["item", "item_id", "n_bytes", "terms", "times"])

    return items.select(id_col, text_col).mapInArrow(run, f"item bigint, item_id {kind}, n_bytes bigint, terms array<string>, times array<bigint>")


def term_counts(docs: DataFrame, known, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tf) of each document with terms; ``known`` broadcasts the numbers of the terms wanted."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, n, ends, terms, tf = [], [], [0], [], []
                for i, text in enumerate(texts(part, text_col)):
                    if found := terms_of(text):
                        own = [(t, c) for w, c in Counter(found).items() if (t := get(w)) is not None]
                        own.sort()
                        terms += [t for t, _ in own]
                        tf += [c for _, c in own]
                        rows.append(i)
                        n.append(len(found))
                        ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tf array<int>")


class ImpactLists:
    """The documents of a block as a list for each term, in descending order of impact, and row by row for direct access."""

    def __init__(self, m: np.ndarray, starts: np.ndarray, terms: np.ndarray, tf: np.ndarray, n_terms: int):
        self.starts, self.terms = starts, terms
        doc = np.repeat(np.arange(len(m), dtype=np.int32), np.diff(starts))
        tf = tf.astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        order = np.argsort(terms.astype(np.int64) * (1 << 20) + (1_000_000 - self.impact), kind="stable")
        self.place = np.empty(len(order), np.int32)  # of each entry among the lists
        self.place[order] = np.arange(len(order), dtype=np.int32)
        self.doc_at, self.impact_at = doc[order], self.impact[order]
        self.bounds = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.seen_at, self.seen_doc = np.full(len(order), -1, np.int32), np.full(len(m), -1, np.int32)
        self.weight = np.zeros(n_terms, np.int64)
        self.reads = 0

    def search(self, stamp: int, terms: np.ndarray, weights: np.ndarray, k: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) among which are all that belong to the best ``k`` with those of the scores ``held``.

        Lists are read in turn from their tops. Each document met is scored at
        once by direct access to its other entries, and its places in all the
        lists count as seen. No other document can score more than the sum of
        the impacts at the lists' first places that are not seen; the search
        stops where that is strictly below the k-th score.
        """
        full = self.bounds[terms] < self.bounds[terms + 1]
        terms, weights = terms[full], weights[full]
        best, ends = self.bounds[terms].copy(), self.bounds[terms + 1]
        read, step = best.copy(), STEP
        self.weight[terms] = weights
        docs, scores, top = [], [], np.sort(held)[::-1][:k]
        while True:
            threshold = int(sum(w * self.impact_at[b] for w, b, e in zip(weights.tolist(), best.tolist(), ends.tolist(), strict=True) if b < e))
            if threshold <= 0 or (len(top) == k and threshold < top[-1]):
                break
            upto = np.minimum(read + step, ends)
            met = np.concatenate([self.doc_at[a:b] for a, b in zip(read.tolist(), upto.tolist(), strict=True)])
            read, step = upto, step * 2
            new = np.unique(met[self.seen_doc[met] != stamp])
            self.seen_doc[new] = stamp
            if len(new):
                size = self.starts[new + 1] - self.starts[new]
                first = np.cumsum(size) - size
                entries = np.arange(int(size.sum())) + np.repeat(self.starts[new] - first, size)
                own = self.weight[self.terms[entries]]
                self.seen_at[self.place[entries[own > 0]]] = stamp
                got = np.add.reduceat(own * self.impact[entries], first)
                docs.append(new)
                scores.append(got)
                top = np.sort(np.concatenate([top, got]))[::-1][:k]
                self.reads += len(new)
            for i, (b, e) in enumerate(zip(best.tolist(), ends.tolist(), strict=True)):
                while b < e:
                    ahead = self.seen_at[b : min(b + 4 * step, e)] != stamp
                    hit = int(ahead.argmax())
                    if ahead[hit]:
                        b += hit
                        break
                    b += len(ahead)
                best[i] = b
        self.weight[terms] = 0
        return (np.concatenate(docs), np.concatenate(scores)) if docs else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _order(x: tuple) -> tuple:
    """Highest score first, then the smallest id, null last."""
    return -x[0], x[1] is None, x[1]


def best_documents(counts: DataFrame, queries: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score, task): of each task's documents the best ``k`` for each query.

    ``queries`` has (item, term numbers, times) and is broadcast, like the
    terms' weights. A task searches blocks of about POSTINGS postings, one after
    another, each with the scores of those before to stop at.
    """
    shared = counts.sparkSession.sparkContext.broadcast((queries, weights))
    kind = counts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        best: list[list[tuple]] = [[] for _ in queries]
        parts: list[pa.RecordBatch] = []
        held, id_kind = 0, None

        def search() -> None:
            n, ids = np.concatenate([p.column(1).to_numpy() for p in parts]), pa.chunked_array([p.column(0) for p in parts])
            sizes = np.concatenate([p.column(2).value_lengths().to_numpy() for p in parts])
            terms, tf = (np.concatenate([p.column(c).flatten().to_numpy() for p in parts]) for c in (2, 3))
            starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            lists = ImpactLists(75 + (25 * n * n_docs) // n_terms, starts, terms, tf, len(weights))
            for stamp, (_, own, times) in enumerate(queries):
                w = weights[own] * times
                docs, scores = lists.search(stamp, own[w > 0], w[w > 0], k, np.array([s for s, _ in best[stamp]], np.int64))
                if len(docs):
                    least = np.sort(scores)[::-1][:k][-1]
                    some = np.flatnonzero((scores >= least) & (scores > 0))  # ties of the last go by id
                    best[stamp] = sorted(best[stamp] + list(zip(scores[some].tolist(), ids.take(pa.array(docs[some])).to_pylist(), strict=True)), key=_order)[:k]
            parts.clear()

        for batch in batches:
            id_kind = batch.column(0).type
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                parts.append(part)
                held += len(part.column(2).flatten())
                if held >= POSTINGS:
                    search()
                    held = 0
        if parts:
            search()
        if id_kind is not None:
            rows = [(q[0], doc_id, score) for q, own in zip(queries, best, strict=True) for score, doc_id in own]
            item, doc_id, score = zip(*rows, strict=True) if rows else ((), (), ())
            cols = [pa.array(item, pa.int64()), pa.array(doc_id, id_kind), pa.array(score, pa.int64()), pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["item", "doc_id", "score", "task"])

    return counts.mapInArrow(run, f"item bigint, doc_id {kind}, score bigint, task int")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The ``k`` documents of the highest score for each item: item_id, rank, doc_id, score.

    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))), with N documents that
    hold any term and df that hold this one. Its impact in a document is
    10^9 tf div (1000 tf + 12 m), where m = 75 + 25 n N div L grows with the
    document's number of terms n (L: those of all documents). The score sums
    weight times impact over the item's terms, repeats included, in integers.

    Statistics cover all documents. Documents are tokenised once and kept as the
    counts of the items' terms; tasks then search their own documents, in blocks
    of bounded size, by the Best Position Algorithm (see ``ImpactLists.search``),
    and hand on ``k`` rows an item. Those of TASKS tasks meet first, then the
    rest. Items are taken in passes of at most about QUERIES items and
    QUERY_BYTES bytes of terms, which is what passes the driver at a time.

    Null and empty texts have no terms: as documents they count nowhere, as
    items they give no rows, and so do items none of whose terms occurs. Equal scores go by
    ascending id, null last. Repeated rows are ranked each, and items that repeat
    give their rows as often. A very long text takes memory in proportion to its
    terms in the task that reads it. Other columns are ignored. Empty tables give
    no rows.
    """
    spark = docs.sparkSession
    asked = stored(queries_of(items, item_col, item_text_col), "queries")
    count, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    passes = max(1, -(-count // QUERIES), -(-size // QUERY_BYTES))
    found = []
    for i in range(passes):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == i).select("item", "terms", "times").toArrow().to_pylist()
        numbers = {t.encode(): j for j, t in enumerate(sorted({t for q in own for t in q["terms"]}))}
        known = spark.sparkContext.broadcast(numbers)
        counts = stored(term_counts(docs, known, id_col, text_col), "term-counts")
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = counts.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # one row for each term of the pass
        weights = np.zeros(len(numbers), np.int64)
        for term, df in zip(holding.column(0).to_pylist(), holding.column(1).to_pylist(), strict=True):
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        queries = [(q["item"], np.array([numbers[t.encode()] for t in q["terms"]], np.int64), np.array(q["times"], np.int64)) for q in own]
        found.append(best_documents(counts, queries, weights, n_docs, max(1, n_terms), k))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = reduce(DataFrame.unionByName, found).withColumn("part", F.floor(F.col("task") / TASKS))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    named = last.join(asked.select("item", "item_id"), "item")
    return named.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


def oracle(k: int = 20) -> str:
    """The same for ``documents`` and ``benchmark`` as DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    of = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '{TERM}')"
    return f"""with d as (select row_number() over () as r, doc_id, {of} as terms from documents),
 n as (select r, doc_id, len(terms) as n from d where len(terms) > 0),
 s as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from n),
 m as (select r, doc_id, 75 + (25 * n * n_docs) // n_terms as m from n, s),
 i as (select row_number() over () as item, item_id, {of} as terms from benchmark),
 q as (select item, item_id, term, count(*) as times from (select item, item_id, unnest(terms) as term from i) group by all),
 f as (select r, term, count(*) as tf from (select r, unnest(terms) as term from d) where term in (select term from q) group by all),
 w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from f, s group by term, n_docs),
 x as (select item, item_id, doc_id, m.r, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
  from q join w using (term) join f using (term) join m using (r) group by all)
 select item_id, cast(row_number() over (partition by item order by score desc, doc_id) as int) as "rank", doc_id, score from x where score > 0
 qualify row_number() over (partition by item order by score desc, doc_id) <= {k}"""
