"""A quality score from pooled random-indexing word vectors and a small network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.shared import blocks, texts

#: Dimensions of a vector (64: six bits of a hash choose one), and how many of them a term's index vector sets.
DIMS, SET = 64, 8
#: Rows of the context table (a word's row is chosen by its hash), how many dimensions a neighbour sets, and how far neighbours reach.
ROWS, SET_NEAR, REACH = 1 << 14, 4, 2
#: Most characters of one unit; longer words are several.
UNIT = 64
#: Parts of the context table that travel by themselves.
SLICES = 64
_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def index_vectors(found: list[str]) -> np.ndarray:
    """A sparse random vector of unit length or so for each term, from its hash; the same everywhere."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(t.encode()) for t in found), np.uint64, len(found))
    out, rows = np.zeros((len(found), DIMS), np.float32), np.arange(len(found))
    for i in range(SET):
        sign = ((h >> np.uint64(48 + i)) & np.uint64(1)).astype(np.float32) * 2 - 1
        out[rows, ((h >> np.uint64(6 * i)) & np.uint64(63)).astype(np.int64)] += sign / SET**0.5
    return out


def units(text: bytes) -> list[bytes]:
    """The text's words, those of over UNIT characters as consecutive parts."""
    words = text.split()
    if max(map(len, words), default=0) <= UNIT:
        return words
    out = []
    for w in words:
        if len(w) <= UNIT:
            out.append(w)
        else:
            long = w.decode()
            out += [long[i : i + UNIT].encode() for i in range(0, len(long), UNIT)]
    return out


def terms(word: str) -> list[str]:
    """What a unit is made of: its lower-cased parts, their shapes, and its runs of marks (which ones, and about how many)."""
    out = []
    for part in [word] if word.isalpha() else _PARTS.findall(word):
        if part.isalpha():
            out += [part.lower(), "\\shape:" + ("U" if part.isupper() and len(part) > 1 else "C" if part[0].isupper() else "l")]
        elif part.isdigit():
            out.append("\\digits")
        else:
            out.append(f"\\marks:{part if len(part) == 1 else ''.join(sorted(set(part)))}:{len(part).bit_length()}")
    return out or ["\\other"]


class Rows(dict):
    """The row of the context table for each unit, by its hash without the marks around it and without regard to case."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh32_intdigest(word.strip(b".,;:!?\"'()[]").lower()) & (ROWS - 1)
        return value


def _near_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors that stand for a row when it is a neighbour."""
    rng = np.random.default_rng(23)
    return rng.integers(0, DIMS, (SET_NEAR, ROWS)), rng.choice(np.array([-1.0, 1.0]), (SET_NEAR, ROWS))


def add_contexts(table: np.ndarray, documents: list[np.ndarray]) -> None:
    """Adds to each row of the table (flat, ROWS * DIMS) the index vectors of its neighbours in documents, given as rows."""
    places, signs = _near_vectors()
    seq = np.concatenate([x for d in documents for x in (d, np.full(REACH, -1))]).astype(np.int64)
    for k in range(1, REACH + 1):
        both = (seq[:-k] >= 0) & (seq[k:] >= 0)
        if k > 1:
            both &= seq[1 : 1 - k] >= 0  # no reach from one document into the next
        left, right = seq[:-k][both], seq[k:][both]
        for own, other in ((left, right), (right, left)):
            for at, sign in zip(places, signs, strict=True):
                table += np.bincount(own * DIMS + at[other], sign[other], ROWS * DIMS)


def fit_contexts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(ROWS, DIMS): the direction of the sum of the neighbours' index vectors, over every word of every document.

    Each task adds up a table of fixed size (8 MB); tables are summed by slices
    in two shuffles, first within groups of tasks, as whole numbers. The driver
    gets the ROWS * DIMS sums, whatever the corpus.
    """
    step = ROWS // SLICES

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, table, held, size = Rows(), np.zeros(ROWS * DIMS), [], 0
        for batch in batches:
            for text in texts(batch, text_col):
                own = units(text)
                held.append(np.fromiter(map(rows.__getitem__, own), np.int32, len(own)))
                size += len(own)
                if size > 1_000_000:
                    add_contexts(table, held)
                    held, size = [], 0
                    if len(rows) > 500_000:
                        rows.clear()
        if held:
            add_contexts(table, held)
            table = table.astype("<i8").reshape(SLICES, -1)
            used = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(np.full(len(used), TaskContext.get().partitionId() % 64), pa.int32()), pa.array([table[i].tobytes() for i in used], pa.binary())],
                names=["slice", "salt", "sums"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over (slice, salt); a task has at most SLICES * 64 of these, of 128 kB each, in order."""
        last, total = None, None
        for batch in batches:
            for key, salt, sums in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                if last != (key, salt):
                    if last:
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((last[0], pa.int32()), (last[1], pa.int32()), (total.tobytes(), pa.binary()))], names=["slice", "salt", "sums"])
                    last, total = (key, salt), np.zeros(step * DIMS, "<i8")
                total += np.frombuffer(sums, "<i8")
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((last[0], pa.int32()), (last[1], pa.int32()), (total.tobytes(), pa.binary()))], names=["slice", "salt", "sums"])

    kinds = "slice int, salt int, sums binary"
    found = docs.select(text_col).mapInArrow(gather, kinds)
    for salt in (F.col("salt"), F.lit(0)):
        found = found.withColumn("salt", salt).repartition("slice", "salt").sortWithinPartitions("slice", "salt").mapInArrow(add, kinds)
    out = np.zeros((SLICES, step * DIMS))
    for r in found.toArrow().to_pylist():
        out[r["slice"]] = np.frombuffer(r["sums"], "<i8")
    out = out.reshape(ROWS, DIMS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def word_vectors(words: list[str], context: np.ndarray) -> np.ndarray:
    """A vector for each unit: the mean of its terms' index vectors, plus its row of the context table."""
    parts = [terms(w) for w in words]
    at: dict[str, int] = {}
    flat = np.array([at.setdefault(t, len(at)) for p in parts for t in p], np.int64)
    index, sizes = index_vectors(list(at)), np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    out, j = index[flat[starts]], 1
    while len(more := np.flatnonzero(sizes > j)):
        out[more] += index[flat[starts[more] + j]]
        j += 1
    rows = Rows()
    return out / sizes[:, None].astype(np.float32) + context[[rows[w.encode()] for w in words]]


class Pooler:
    """Document features: the mean vector over running units, the mean over distinct ones, and three sizes."""

    def __init__(self, context: np.ndarray, most: int = 200_000):
        self.context, self.most = context, most
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((1024, DIMS), np.float32)

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        if new := [w for w in words if w not in self.known]:
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            while len(self.rows) < len(self.known):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for a in range(0, len(new), 20_000):
                part = new[a : a + 20_000]
                self.rows[first + a : first + a + len(part)] = word_vectors([w.decode() for w in part], self.context)

    def features(self, values: list[bytes]) -> np.ndarray:
        """One row per text, from all of its words; a text without words has zeros."""
        out = np.zeros((len(values), 2 * DIMS + 3), np.float32)
        split = [units(v) for v in values]
        self._learn(set().union(*split))
        sizes = np.array([len(s) for s in split], np.int64)
        if not sizes.sum():
            return out
        ids = np.fromiter((i for s in split for i in map(self.known.__getitem__, s)), np.int64, int(sizes.sum()))
        pairs, counts = np.unique(np.repeat(np.arange(len(split)), sizes) * len(self.known) + ids, return_counts=True)
        of, ids = np.divmod(pairs, len(self.known))
        present, starts = np.unique(of, return_index=True)
        kinds = np.diff(np.append(starts, len(of)))
        vectors = self.rows[ids]
        out[present, DIMS : 2 * DIMS] = np.add.reduceat(vectors, starts, axis=0) / kinds[:, None]
        out[present, :DIMS] = np.add.reduceat(vectors * counts[:, None].astype(np.float32), starts, axis=0) / sizes[present, None]
        out[present, 2 * DIMS :] = np.stack([np.log1p(sizes[present]) / 8, kinds / sizes[present], np.log1p(kinds) / 8], axis=1)
        return out


def gradients(values: list[np.ndarray], x: np.ndarray, y: np.ndarray, decay: float) -> list[np.ndarray]:
    """Of the mean cross-entropy plus half of ``decay`` times the squared weights, by the two layers' weights and offsets."""
    hidden = np.maximum(x @ values[0] + values[1], 0)
    error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -30, 30))) - y) / len(x)
    back = (error[:, None] * values[2]) * (hidden > 0)
    return [x.T @ back + decay * values[0], back.sum(axis=0), hidden.T @ error + decay * values[2], np.array([error.sum()])]


@dataclass
class Network:
    """Two layers and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, hidden: int = 16, epochs: int = 40, decay: float = 1e-3, seed: int = 11) -> Network:
        """Adam on the cross-entropy; a fifth of the rows is kept back to choose the temperature."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held, rest = order[: len(x) // 5], order[len(x) // 5 :]
        scale = np.maximum(x[rest].std(axis=0), 1e-3)
        net = Network(x[rest].mean(axis=0), scale, rng.normal(size=(x.shape[1], hidden)) / x.shape[1] ** 0.5, np.zeros(hidden), rng.normal(size=hidden) / hidden**0.5, 0.0)
        z = (x - net.mean) / net.scale
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
        values, step = [net.w1, net.b1, net.w2, np.zeros(1)], 0
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(rest), max(1, len(rest) // 64)):
                step += 1
                for p, g, s in zip(values, gradients(values, z[batch], y[batch], decay), state, strict=True):
                    s[0] += 0.1 * (g - s[0])
                    s[1] += 0.001 * (g * g - s[1])
                    p -= 2e-3 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
        if len(held) and 0 < y[held].mean() < 1:
            logits = net.logits(x[held])

            def loss(t: float) -> float:
                return float(np.mean(np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logits / t)))

            net.temperature = min((float(t) for t in np.geomspace(0.25, 8, 61)), key=loss)
        return net


@dataclass
class QualityModel:
    context: np.ndarray
    network: Network | None
    share: float


def _pooled(rows: DataFrame, model: QualityModel, with_scores: bool) -> DataFrame:
    """(id, mark, score) of (id, mark, text), or the texts' features (id, mark, x) themselves."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler, network = Pooler(held.value.context), held.value.network
        for batch in batches:
            values = texts(batch, "text")
            for a, b in blocks(values, 1 << 20):
                x = pooler.features(values[a:b])
                if with_scores:
                    out = pa.array((network.scores(x) if network else np.full(b - a, held.value.share)).astype(np.float64))
                else:
                    out = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), out], names=["id", "mark", "out"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "mark")]
    return rows.mapInArrow(run, f"id {kinds[0]}, mark {kinds[1]}, out {'double' if with_scores else 'array<float>'}")


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 6000, folds: int = 5, held_fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fits the word vectors on all documents, and the network on at most ``most`` labels outside the held-out fold.

    The labels taken are those with the least hash of the id; of an id that
    repeats among the documents, the text with the least hash. Their whole texts
    are pooled where they lie, so the driver gets ``most`` rows of features.
    """
    own = labels.where(F.col("quality").isin(0, 1) & (fold(id_col, folds) != held_fold)).select(F.col(id_col).alias("id"), F.col("quality").alias("mark"))
    own = own.orderBy(F.xxhash64("id"), "id", "mark").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(own.distinct()), "id")
    first = F.row_number().over(Window.partitionBy("id", "mark").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("n", first).where(F.col("n") == 1).select("id", "mark", "text")
    model = QualityModel(fit_contexts(docs, text_col), None, 0.5)
    sample = _pooled(rows, model, with_scores=False).toArrow().sort_by([("id", "ascending"), ("mark", "ascending")])
    y = sample.column("mark").to_numpy().astype(np.float64)
    if len(y):
        model.share = float(y.mean())
    if len(set(y.tolist())) == 2:
        x = sample.column("out").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        model.network = Network.fit(x.astype(np.float64), y)
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= ``threshold``).

    The score depends on the text alone. Words get random-indexing vectors (a
    random index vector, plus the context gathered over the whole corpus),
    pooled per document over the whole text, and a two-layer network with a
    temperature gives the probability. Words of over UNIT characters, such as
    texts without spaces, are several units, all of which count. Without labels
    of both kinds the score is the share of label 1 (0.5 if there is none).

    Null text counts as empty. Each row is scored for itself, so equal texts
    have equal scores; null ids are not held out. A very long text is pooled in
    one go, with memory in proportion to its words. Other columns are ignored.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(fold(id_col, folds) == held_fold, F.lit(False)).alias("mark"), F.col(text_col).alias("text"))
    scored = _pooled(rows, model, with_scores=True)
    return scored.select(F.col("id").alias(id_col), F.col("mark").alias("held_out"), F.col("out").alias("score"), (F.col("out") >= threshold).cast("int").alias("predicted"))


def crc_fold(doc_id: int, n: int) -> int:
    """``fold`` of one id, for use without Spark."""
    return zlib.crc32(str(doc_id).encode()) % n
