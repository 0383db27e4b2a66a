"""Approximate nearest neighbours by an inverted file with product-quantised residuals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.shared import stored

#: Index entries of one search cell, and queries that go by it before its entries are dealt to another one too.
CELL_ROWS, CELL_QUERIES = 1 << 13, 1 << 16
#: Rows of the sample for each list.
PER_LIST = 32


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(rows), 4096)] or [np.zeros(0, int)])


def kmeans(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """At most ``k`` centres of the rows; an empty centre moves to a random row."""
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        of = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        n = np.bincount(of, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        centres[n == 0] = rows[rng.integers(len(rows), size=int((n == 0).sum()))]
    return centres


@dataclass
class Quantiser:
    """Coarse centres, and codebooks for equal parts of the residuals. Its size depends on its parameters alone."""

    centres: np.ndarray
    books: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray, lists: int, parts: int, codes: int, seed: int = 7) -> Quantiser:
        rng = np.random.default_rng(seed)
        centres = kmeans(sample, lists, 12, rng)
        residuals = sample - centres[_nearest(sample, centres)]
        return Quantiser(centres, [kmeans(np.ascontiguousarray(x), codes, 10, rng) for x in np.array_split(residuals, parts, axis=1)])

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each row."""
        of = _nearest(rows, self.centres)
        residuals = np.array_split(rows - self.centres[of], len(self.books), axis=1)
        return of, np.stack([_nearest(x, b).astype(np.uint8) for x, b in zip(residuals, self.books, strict=True)], axis=1)

    def probes(self, queries: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` lists nearest to each query."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")[:, :n]

    def scores(self, query: np.ndarray, of: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products: the query's product with the centre, and its tables of products with the codebooks summed by the codes."""
        total = (self.centres @ query)[of]
        for j, (part, book) in enumerate(zip(np.array_split(query, len(self.books)), self.books, strict=True)):
            total += (book @ part)[codes[:, j]]
        return total

    def decode(self, of: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The rows that lists and codes stand for."""
        return self.centres[of] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)


def reach(near: np.ndarray, norm: np.ndarray, close: np.ndarray) -> np.ndarray:
    """Upper bounds of cosines: what the angle to the decoded row leaves if the row itself lies ahead of it.

    ``near`` is the query's product with the decoded rows, ``norm`` their
    length, ``close`` the cosine of each row with its decoded row.
    """
    far = np.clip(np.divide(near, norm, out=np.ones_like(near), where=norm > 0), -1, 1)
    return np.where(far >= close, 1.0, far * close + np.sqrt((1 - far**2) * (1 - close**2)))


def usable(vector: str) -> Column:
    """False for vectors that are null, zero, or hold null or non-finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Each row by a power of two, which changes no cosine and no rounding, so that squares stay in range."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True, initial=0))[1])


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def probes_for(quantiser: Quantiser, sample: np.ndarray, k: int, recall: float, queries: int = 512) -> int:
    """Lists to visit so that a share of ``recall`` of the sample's own ``k`` nearest neighbours lie in them."""
    if len(sample) < 2:
        return len(quantiser.centres)
    of, ranks = _nearest(sample, quantiser.centres), []
    for i in range(0, len(sample), max(1, len(sample) // queries)):
        near = sample @ sample[i]
        near[i] = -np.inf
        found = np.argpartition(-near, min(k, len(near) - 1) - 1)[:k]
        place = np.empty(len(quantiser.centres), np.int64)
        place[quantiser.probes(sample[i : i + 1], len(place))[0]] = np.arange(len(place))
        ranks += place[of[found]].tolist()
    return 1 + sorted(ranks)[min(len(ranks) - 1, int(recall * len(ranks)))]


class Cell:
    """Entries of one search cell, ready for queries."""

    def __init__(self, pieces: list[pa.RecordBatch], quantiser: Quantiser, dims: int):
        table, self.quantiser, self.dims = pa.Table.from_batches(pieces), quantiser, dims
        self.ids, self.of = table.column("id").to_numpy(), table.column("list").to_numpy()
        self.codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.own = _scaled(_matrix(table.column("v"), dims))
        decoded = quantiser.decode(self.of, self.codes)
        self.norm = np.linalg.norm(decoded, axis=1)
        close = np.divide(np.einsum("ij,ij->i", _unit(self.own), decoded), self.norm, out=np.full_like(self.norm, -1), where=self.norm > 0)
        self.close = np.clip(close, -1, 1)
        self.size = np.sqrt(np.einsum("ij,ij->i", self.own, self.own))

    def search(self, queries: pa.RecordBatch, k: int, rerank: int) -> pa.RecordBatch:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        asked = _scaled(_matrix(queries.column("v"), self.dims))
        for query_id, query, unit, lists in zip(queries.column("id").to_pylist(), asked, _unit(asked), queries.column("lists").to_pylist(), strict=True):
            visited = np.zeros(len(self.quantiser.centres), bool)
            visited[lists] = True
            at = np.flatnonzero(visited[self.of] & (self.ids != query_id))
            near = self.quantiser.scores(unit, self.of[at], self.codes[at])
            length = np.sqrt(np.einsum("i,i->", query, query))
            first = np.argpartition(-near, rerank)[:rerank] if len(at) > rerank else np.arange(len(at))
            score = np.full(len(at), -np.inf)
            score[first] = np.einsum("ij,j->i", self.own[at[first]], query) / (length * self.size[at[first]])
            if len(at) > rerank:
                worst = np.partition(score[first], -k)[-k] if rerank >= k else -np.inf
                # single precision errs by far less than 1e-3 here
                more = np.flatnonzero((reach(near, self.norm[at], self.close[at]) >= worst - 1e-3) & np.isneginf(score))
                for i in range(0, len(more), 4096):
                    part = more[i : i + 4096]
                    score[part] = np.einsum("ij,j->i", self.own[at[part]], query) / (length * self.size[at[part]])
            best = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(at) > k else np.arange(len(at))
            best = best[np.lexsort((self.ids[at[best]], -score[best]))][:k]
            out.append((np.full(len(best), query_id), self.ids[at[best]], score[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])


def _search(rows: DataFrame, asked: DataFrame, dims: int, total: int, k: int, lists: int | None, probes: int | None, recall: float, parts: int, rerank: int, sample: int | None) -> DataFrame:
    """(query_id, vec_id, score): the best of each cell, for vectors of one length."""
    spark, kind = rows.sparkSession, rows.schema["v"].dataType.simpleString()
    sample = sample or max(20_000, PER_LIST * math.isqrt(total))
    share = int((1 << 30) * min(1.0, sample / total)) + 1
    fit_on = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share)
    fit_on = fit_on.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(2 * sample).orderBy("vec_id", "v").select("v").toArrow()
    fit_on = fit_on if fit_on.num_rows else rows.limit(1).select("v").toArrow()
    units = _unit(_matrix(fit_on.column(0), dims))
    lists = lists or int(min(max(16, total**0.5), max(16, sample / PER_LIST)))
    quantiser = Quantiser.fit(units, lists, min(parts, dims), 256)
    probes = probes or probes_for(quantiser, units, k, recall)
    held = spark.sparkContext.broadcast(quantiser)
    groups_of_lists = max(1, min(len(quantiser.centres), -(-total // CELL_ROWS)))

    # of equal vectors the k + 1 least ids stand for all: a limit within each task comes first
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "v")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, codes = held.value.encode(_unit(_matrix(batch.column(1), dims)))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), batch.column(0), packed, batch.column(1)], names=["list", "id", "codes", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = held.value.probes(_unit(_matrix(batch.column(1), dims)), probes)
            rows = [(i, part, x[x % groups_of_lists == part].tolist()) for i, x in enumerate(found) for part in np.unique(x % groups_of_lists).tolist()]
            at = pa.array([r[0] for r in rows], pa.int64())
            kinds = [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([kinds[0], batch.column(0).take(at), batch.column(1).take(at), kinds[1]], names=["part", "id", "v", "lists"])

    entries = stored(distinct.mapInArrow(index, f"list int, id bigint, codes binary, v {kind}"), "index").withColumn("part", F.col("list") % groups_of_lists)
    visits = stored(asked.mapInArrow(visit, f"part int, id bigint, v {kind}, lists array<int>"), "visits")
    # a row for each part of the lists, of which there are at most as many as lists
    sizes = entries.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("blocks"))
    sizes = sizes.join(visits.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("groups")), "part")
    sizes = F.broadcast(stored(sizes, "sizes"))
    dealt = entries.join(sizes, "part").withColumns(
        {"block": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), "group": F.explode(F.sequence(F.lit(0), F.col("groups") - 1)), "kind": F.lit(0)}
    )
    asking = visits.join(sizes, "part").withColumns(
        {"group": F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "kind": F.lit(1)}
    )
    cell = ["part", "block", "group", "kind"]
    both = dealt.select(*cell, "id", "list", "codes", "v", F.lit(None).cast("array<int>").alias("lists")).unionByName(
        asking.select(*cell, "id", F.lit(None).cast("int").alias("list"), F.lit(None).cast("binary").alias("codes"), "v", "lists")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's entries come first and are held; its queries stream past them."""
        now, pieces, ready = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if now != (own := tuple(keys[a, :3].tolist())):
                    now, pieces, ready = own, [], None
                if keys[a, 3] == 0:
                    pieces.append(batch.slice(a, b - a))
                elif pieces:
                    ready = ready or Cell(pieces, held.value, dims)
                    yield ready.search(batch.slice(a, b - a), k, rerank)

    return both.repartition(*cell[:3]).sortWithinPartitions(*cell).mapInArrow(search, "query_id bigint, vec_id bigint, score double")


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, lists: int | None = None, probes: int | None = None, recall: float = 0.985, parts: int = 16, rerank: int = 400, sample: int | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows found for each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own. The score is the cosine in double precision of the
    original vectors; ties go to the smaller id.

    The quantiser is fitted on about ``sample`` rows (twice that at the utmost),
    taken by a hash of the id; every row is indexed under its nearest centre
    with the codes of its residual. There are as many lists as the root of the
    number of rows, though no more than ``sample`` / PER_LIST (given ``lists``: so
    many), and the sample has 20,000 rows or PER_LIST for each list, if that is
    more: a million for 10^9 rows. Work in clusters grows with the power 1.5
    of the rows. A query visits as many lists as hold a share of ``recall`` of the
    neighbours within the sample, which the fit measures (given ``probes``: so
    many): few if the vectors lie in clusters, most if they do not.

    Of equal vectors the k + 1 smallest ids stand for all, which is all that a
    result can name; so copies do not crowd a list. Lists are put into parts of
    about CELL_ROWS entries, larger ones into blocks; queries are sent to the
    parts that they visit and stream past the entries, which travel once (again
    for each CELL_QUERIES queries of a part). There entries are ranked by tables
    of the query's products with the codebooks, and the best ``rerank`` of a
    query are scored exactly; so are all others that the error of their codes
    allows to be among the cell's ``k`` best. In the lists visited nothing is
    missed, then: rows that share their codes, as near copies do, are told apart
    by their vectors, however many there are.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do null ids. Vectors of each length are indexed for themselves, as
    there is no cosine between lengths. A query id that repeats is searched once,
    with its least vector of the least length; a candidate id that repeats is
    listed for each of its different vectors. Other columns are ignored. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v")).where(usable("v"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct(F.size("v").alias("d"), "v")).alias("q")).select("vec_id", "q.d", "q.v")
    asked = stored(asked, "asked")
    lengths = sorted((r["d"], r["count"]) for r in rows.groupBy(F.size("v").alias("d")).count().collect())
    found = [
        _search(rows.where(F.size("v") == d), asked.where(F.col("d") == d).select("vec_id", "v"), d, n, k, lists, probes, recall, parts, rerank, sample)
        for d, n in lengths
    ]
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
