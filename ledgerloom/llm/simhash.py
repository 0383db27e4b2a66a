"""SimHash near-duplicates, found through Golay-code keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import golay
from ledgerloom.llm.components import components
from ledgerloom.llm.shared import frugal, pieces, small_or_stored, stored, texts

#: Bits of the three segments of a fingerprint, from the low end; each fits a Golay word.
SEGMENTS = (22, 21, 21)
#: Most fingerprints compared with each other in one cell, and those that one task gives their keys.
CELL = 4096
#: Most pairs of a cell written out for each of its members; a cell with more is verified as a whole.
PARTNERS = 4
EXPANDED = 1 << 14
#: Most bits that a key may have besides its codeword; enough for 10^11 texts.
MOST_EXTRA = 12
#: Most shingle hashes, of 8 bytes, of a crowded cell that one task compares.
HASHES = 1 << 22


def _mixed(hashes: np.ndarray, family: int) -> np.ndarray:
    """The hashes themselves for family 0, else other hashes made from them."""
    if not family:
        return hashes
    x = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * family)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).astype(">u8")


def fingerprint(text: bytes, words: int = 3, families: int = 1) -> list[int]:
    """64-bit SimHashes of a text's word shingles, one for each family of hashes; 0 without words.

    Words are what lies between ASCII white space, A to Z lower-cased. A bit is
    set if it is set in over half of the shingles' XXH64 (seed 42). Shingles are
    hashed in slices, so the memory for a very long text stays small.
    """
    found = text.lower().split()
    if not found:
        return [0] * families
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    sums = np.zeros((families, 64), np.int64)
    for at in range(0, n, 1 << 16):
        parts = [joined[i:j] for i, j in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), ">u8", len(parts))
        for k in range(families):
            sums[k] += np.unpackbits(_mixed(hashes, k).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return [int.from_bytes(np.packbits(2 * s > n).tobytes(), "big") for s in sums]


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles' hashes in ascending order, as signed numbers; shingles as for ``fingerprint``."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.int64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(found) - words + 1)].tolist()
    spans = zip(starts, ends[min(words, len(found)) - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in spans), np.uint64, len(starts)).view(np.int64))


def set_fingerprint(own: np.ndarray, families: int) -> list[int]:
    """64-bit SimHashes of a set of shingle hashes, one for each family; 0 for an empty one."""
    sums, hashes = np.zeros((families, 64), np.int64), own.astype(">i8").view(">u8")
    for at in range(0, len(hashes), 1 << 16):
        for k in range(families):
            sums[k] += np.unpackbits(_mixed(hashes[at : at + (1 << 16)], k).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return [int.from_bytes(np.packbits(2 * s > len(own)).tobytes(), "big") for s in sums]


def _names(families: int) -> list[str]:
    return [f"fp{k}" for k in range(families)]


def fingerprints(docs: DataFrame, words: int, families: int) -> DataFrame:
    """(doc_id, fp0, ...): the fingerprints of (doc_id, text) as signed bigints; null text counts as empty."""
    names = ["doc_id", *_names(families)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                fps = np.array([fingerprint(t, words, families) for t in texts(part, "text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(np.ascontiguousarray(fps[:, k])) for k in range(families)]], names=names)

    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *[f"{n} bigint" for n in names[1:]]])
    return docs.select("doc_id", "text").mapInArrow(frugal(run), schema)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs such that fingerprints within 3 bits share a key.

    Of three segments the two with the fewest errors have at most one each. For
    each pair of segments a fingerprint has the nearest codeword of one with
    the codewords of the other's single-bit changes, and the other way round:
    whichever of two fingerprints decodes a segment, the other one's changes
    reach its codeword.
    """
    value, at, near, around = fps.view(np.uint64), 0, [], []
    for bits in SEGMENTS:
        part = ((value >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.uint32)
        near.append(golay.decode(part))
        around.append(golay.nearby(part, bits))
        at += bits
    rows, keys = [], []
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        for fixed, moved, high in ((near[a], around[b], True), (near[b], around[a], False)):
            row, col = np.nonzero(moved >= 0)
            first, second = (fixed[row], moved[row, col]) if high else (moved[row, col], fixed[row])
            rows.append(row)
            keys.append((k << 24) | (first << 12) | second)
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


def code_keys(fps: np.ndarray, extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: for each of the three segments the codeword that it decodes to, which absorbs up to three errors on either side.

    A key takes ``extra`` bits of the segment after its own with it, as they are.
    """
    value, at, parts = fps.view(np.uint64), 0, []
    for bits in SEGMENTS:
        parts.append(((value >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.uint32))
        at += bits
    after = [part.astype(np.int64) & ((1 << extra) - 1) for part in parts[1:] + parts[:1]]
    keys = [(((k << 12) | golay.decode(part)) << extra) | bits for k, (part, bits) in enumerate(zip(parts, after, strict=True))]
    return np.tile(np.arange(len(fps)), len(SEGMENTS)), np.concatenate(keys)


def key_length(rows: int, fill: float, searched: int, share: float) -> tuple[int, int]:
    """(extra bits of a key, families searched) with which cells hold some ``fill`` rows at most, at the recall of ``searched`` families.

    Each bit halves the cells. Two similar fingerprints agree in it with a
    chance of 1 - ``share``, so that many more families make up for it.
    """
    extra = min(MOST_EXTRA, max(0, int(np.ceil(np.log2(max(1, rows) / 4096 / fill)))))
    return extra, int(np.ceil(searched / (1 - share) ** extra))


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, summed over the families (last axis)."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=-1, dtype=np.int32)


def links(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (rows, their centres) that connect what is connected among the fingerprints of one cell by steps of at most ``most`` bits."""
    busy = np.concatenate([np.count_nonzero(_differing(fps[at : at + 64, None], fps[None, :]) <= most, axis=1) > 1 for at in range(0, len(fps), 64)])
    own = np.flatnonzero(busy)  # in most cells none has a neighbour
    fps = fps[own]
    root = np.full(len(fps), -1)
    for centre in range(len(fps)):
        if root[centre] >= 0:
            continue
        root[centre], ahead = centre, [centre]
        while ahead and len(free := np.flatnonzero(root < 0)):
            now, ahead = ahead[:128], ahead[128:]
            found = free[(_differing(fps[now, None], fps[None, free]) <= most).any(axis=0)]
            root[found] = centre
            ahead += found.tolist()
    tied = np.flatnonzero(root != np.arange(len(fps)))
    return own[tied], own[root[tied]]


def apart(fps: np.ndarray, groups: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of different groups within ``most`` bits."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(fps), 64):
        near = (_differing(fps[at : at + 64, None], fps[None, :]) <= most) & (groups[at : at + 64, None] != groups[None, :])
        a, b = np.nonzero(near)
        a += at
        found.append((a[a > b], b[a > b]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b


def _cells(
    distinct: DataFrame, families: int, most: int, group: str | None = None, searched: int = 0, keys_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] = golay_keys
) -> DataFrame:
    """(a, b) edges between nodes within ``most`` bits that meet under a key; they connect all that such pairs connect.

    With a column ``group`` they are instead all such pairs of different groups,
    as (a, b, key, cell) with key -1; a cell of more than ``PARTNERS`` pairs a
    member comes as its members instead (a: node, b: its group, key, cell).
    Keys come from ``searched`` families if these are more than those compared,
    and are those that ``keys_of`` makes of one family's fingerprints.
    """
    names = _names(families) + ([group] if group else [])
    width, more = len(names), _names(max(families, searched))[families:]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for k in range(families + len(more)):
                    rows, keys = keys_of(part.column(k + 1 if k < families else k + 1 + width - families).to_numpy(zero_copy_only=False))
                    taken = [part.column(c).take(pa.array(rows)) for c in range(width + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys | (k << 26)), *taken], names=["key", "node", *names])

    columns = "key bigint, node bigint, " + ", ".join(f"{n} bigint" for n in names)
    # a row has 29 keys, or 3 for each family, so few rows make a task
    each = max(1, EXPANDED * 10 // max(10, families + len(more)))
    dealt = distinct.select("node", *names, *more).repartition(max(1, distinct.count() // each), "node")
    keyed = dealt.mapInArrow(frugal(expand), columns)
    # a key of more than CELL nodes is dealt into chunks, and each two chunks meet in a cell of their own
    full = keyed.groupBy("key").count().where(F.col("count") > CELL).select("key", F.ceil(F.col("count") / (CELL // 2)).cast("int").alias("chunks"))
    full = small_or_stored(full, "full-keys")  # few as a rule, and then the rows of all keys are shuffled only once
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    cell = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.least(own, other).cast("bigint") * (1 << 31) + F.greatest(own, other)
    )
    keyed = keyed.join(full, "key", "left").withColumn("cell", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(cell)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(width + 3)], axis=1)
            now = now if held is None else np.concatenate([held, now])
            new = np.flatnonzero((now[1:, :2] != now[:-1, :2]).any(axis=1)) + 1
            last = new[-1] if len(new) else 0  # the last cell may go on in the next batch
            held = now[last:]
            if last:
                yield edges(now[:last], np.concatenate([[0], new]))
        if held is not None and len(held) > 1:
            yield edges(held, np.array([0, len(held)]))

    def edges(now: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        nodes, fps, sizes, whole = now[:, 2], np.ascontiguousarray(now[:, 3:]), np.diff(cuts), []
        two = cuts[:-1][sizes == 2]
        fps, groups = np.ascontiguousarray(fps[:, :families]), fps[:, -1]
        two = two[(_differing(fps[two], fps[two + 1]) <= most) & (groups[two] != groups[two + 1] if group else True)]
        out = [(nodes[two], nodes[two + 1])]
        for s, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            tied, tops = apart(fps[s : s + n], groups[s : s + n], most) if group else links(fps[s : s + n], most)
            if group and len(tied) > PARTNERS * n:
                own = s + np.unique(np.concatenate([tied, tops]))
                whole.append((nodes[own], groups[own], now[own, 0], now[own, 1]))
            elif len(tied):
                out.append((nodes[s + tied], nodes[s + tops]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        if not group:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        none = np.full(len(a), -1)
        cols = [np.concatenate(x) for x in zip((a, b, none, none), *whole, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["a", "b", "key", "cell"])

    parts = keyed.repartition("key", "cell").sortWithinPartitions("key", "cell").select("key", "cell", "node", *names)
    return parts.mapInArrow(frugal(compare), "a bigint, b bigint" + (", key bigint, cell bigint" if group else "")).distinct()


def joined(groups: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links (rows of both sides) of sets at ``similarity`` that connect what such links connect among the groups.

    Rows of a group, or linked before, are not compared, so there are fewer links than rows.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    root = np.unique(groups, return_inverse=True)[1]
    full = np.flatnonzero(sizes)  # the empty set is one node, like nothing else
    if not len(full):
        return [], []
    terms = np.unique(np.concatenate([sets[i] for i in full]), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    ends, mark = starts + sizes[full], np.zeros(terms.max() + 1, np.int32)
    left, right = [], []
    for k, i in enumerate(full.tolist()):
        if (root == root[i]).all():
            continue
        own = terms[starts[k] : ends[k]]
        mark[own] = 1
        shared = np.add.reduceat(mark[terms], starts)
        mark[own] = 0
        for j in full[shared >= similarity * (sizes[full] + sizes[i] - shared) - 1e-9].tolist():
            if root[j] != root[i]:
                left.append(i)
                right.append(j)
                root[root == root[j]] = root[i]
    return left, right


def _verified(crowded: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links within the cells of (key, cell, node, group, own), found in the task that has the cell.

    A task holds the sets of one cell. A cell of over HASHES hashes is dealt
    into chunks first, of which each two meet in a cell of their own.
    """
    sizes = crowded.groupBy("key", "cell").agg(F.sum(F.size("own").cast("bigint")).alias("hashes")).where(F.col("hashes") > HASHES)
    sizes = small_or_stored(sizes.select("key", "cell", F.ceil(F.col("hashes") / (HASHES // 2)).cast("int").alias("chunks")), "large-cells")
    own = F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int")
    with_other = F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda o: F.least(own, o).cast("bigint") * (1 << 31) + F.greatest(own, o))
    crowded = crowded.join(sizes, ["key", "cell"], "left").withColumn("chunk", F.explode(with_other)).withColumn("cell", F.struct("cell", "chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, groups, sets = None, [], [], []

        def found() -> pa.RecordBatch:
            a, b = joined(np.array(groups, np.int64), sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in side], pa.int64()) for side in (a, b)], names=["a", "b"])

        for batch in batches:
            key, part, node, group, own = (batch.column(c) for c in range(5))
            for i, here in enumerate(zip(key.to_pylist(), part.to_pylist(), strict=True)):
                if here != cell and nodes:
                    yield found()
                    nodes, groups, sets = [], [], []
                cell = here
                nodes.append(node[i].as_py())
                groups.append(group[i].as_py())
                sets.append(own[i].values.to_numpy().copy())  # the batch need not be kept
        if nodes:
            yield found()

    dealt = crowded.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.select("key", F.xxhash64("cell"), "node", "group", "own").mapInArrow(frugal(run), "a bigint, b bigint").distinct()


def _classes(own: DataFrame, families: int, most: int) -> DataFrame:
    """(fp0, ..., component_id): the least id that links reach from each distinct fingerprint."""
    names = _names(families)
    node = F.col("fp0") if families == 1 else F.xxhash64(*names)
    distinct = stored(own.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("node", node), "distinct")
    roots = components(_cells(distinct, families, most)).withColumnRenamed("node", "of")
    member = distinct.join(roots, F.col("node") == F.col("of"), "left").select(*names, "least", F.coalesce("root", "node").alias("root"))
    member = stored(member, "members")
    smallest = stored(member.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    return member.join(smallest, "root").select(*names, "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most ``most`` (3 at the utmost)
    bits are linked, and component_id is the smallest id reachable. Copies meet
    first: only distinct fingerprints are keyed and compared, each two under
    the Golay keys that they share, and no cell holds more than a fixed number
    of them. Cells give stars instead of all their pairs, which connect the
    same documents.

    Null or empty text has fingerprint zero and is linked like any other. A very
    long text takes memory in proportion to its words. Null ids keep their rows; a component of null ids alone has a null component_id.
    Repeated rows stay. Other columns are ignored. An empty table gives no rows.
    """
    if not 0 <= most <= 3:
        raise ValueError("the keys reach differences of 0 to 3 bits")
    own = stored(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words, 1), "fingerprints")
    found = own.join(_classes(own, 1, most), "fp0")
    return found.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def similar_documents(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, families: int = 2, searched: int = 10, fill: float = CELL // 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, component_id; links texts whose sets of word shingles have a Jaccard similarity of ``similarity``.

    SimHashes only find candidates: ``searched`` of them, of the distinct
    shingles, from different hashes. Each segment of each decodes to a Golay
    codeword, which is a key; two documents that share one are a candidate pair
    if in the first ``families`` no more bits differ than nearly every pair of
    that similarity has (3.3 standard deviations over the mean). Of pairs at
    exactly 0.8 some 1.1 % share no key, at 0.85 0.2 %; two further families
    halve that. Candidates are compared by their shingles' 64-bit hashes, so no
    link is below the limit. A key has 12 bits, and one more for each doubling
    of the rows from 4096 * ``fill`` on; with each bit ``searched`` grows by
    the 18 % that keep the share of pairs found. So a fingerprint is compared
    with at most ``fill`` others for each key, in numpy, and keys grow with the
    fourth root of the rows: 30 a text up to 8 million rows, 96 at 10^9, 183 at 10^10.

    Of each cell the members are first compared with one of them, so that a
    large group of copies is not compared pair by pair; then all candidates that
    are not yet connected are. Where these are many, as in a large group of
    texts somewhat under the limit, no pairs are written: the sets of the cell's
    members meet in one task, which returns fewer links than members. Equal
    sets are one from the start. Rows and odd
    values are treated as by ``near_duplicates``.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 64 * families
    most = int(bits * share + 3.3 * (bits * share * (1 - share)) ** 0.5)
    extra, searched = key_length(docs.count(), fill, searched, share)
    keys_of, names = partial(code_keys, extra=extra), _names(searched)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values in pieces(batch, "text", 1 << 20):
                part = batch.slice(a, b - a)
                sets = [shingles(t, words) for t in values]
                fps = np.array([set_fingerprint(x, searched) for x in sets], np.uint64).view(np.int64)
                node = np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets), np.uint64, len(sets)).view(np.int64)
                cols = [part.column(0), part.column(1), pa.array(node), *[pa.array(np.ascontiguousarray(fps[:, k])) for k in range(searched)]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "written", "node", *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values in pieces(batch, "text", 1 << 20):
                part = batch.slice(a, b - a)
                sets = [shingles(t, words) for t in values]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "own"])

    schema = ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, written bigint, node bigint", *[f"{n} bigint" for n in names]])
    own = stored(rows.select("doc_id", F.xxhash64("text").alias("written"), "text").mapInArrow(frugal(sign), schema), "fingerprints")
    least = [F.min("doc_id").alias("least"), F.min("written").alias("written"), *[F.min(n).alias(n) for n in names]]
    distinct = stored(own.groupBy("node").agg(*least), "distinct")
    near = stored(_cells(distinct, families, most, searched=searched, keys_of=keys_of), "candidates")
    met = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    met = stored(distinct.join(met, "node", "left_semi"), "met")
    wanted = small_or_stored(met.select("node", "written"), "wanted")
    held = rows.withColumn("written", F.xxhash64("text")).join(wanted, "written").select("node", "text").mapInArrow(frugal(cut), "node bigint, own array<bigint>")
    held = stored(held.dropDuplicates(["node"]), "shingles")

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(held.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
        both = both.join(held.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")

    one = stored(alike(stored(near.groupBy("a").agg(F.min("b").alias("b")), "stars")), "alike")
    roots = components(one).withColumnRenamed("node", "of")
    grouped = met.join(roots, F.col("node") == F.col("of"), "left").select("node", *names, F.coalesce("root", "node").alias("group"))
    rest = stored(_cells(stored(grouped, "grouped"), families, most, "group", searched, keys_of), "candidates")
    members = rest.where("key >= 0").select("key", "cell", F.col("a").alias("node"), F.col("b").alias("group"))
    crowded = _verified(members.join(held, "node"), similarity)
    roots = components(one.unionByName(alike(rest.where("key < 0").select("a", "b").distinct())).unionByName(crowded)).withColumnRenamed("node", "of")
    member = distinct.join(roots, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    member = stored(member, "members")
    smallest = stored(member.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    return own.join(member.join(smallest, "root").select("node", "component_id"), "node").select(F.col("doc_id").alias(id_col), "component_id")
