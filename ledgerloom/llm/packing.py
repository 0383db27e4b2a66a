"""Packing tokenised documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import itertools
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import LONG, TwoGenerations, blocks, frugal, kept, pieces, stored, tokenizer_of

#: Kinds of bytes: all others, letters that lower-case one to one and are composed already, marks of one pre-token, ASCII white space.
_OTHER, _LETTER, _MARK, _SPACE = range(4)


def _kinds() -> bytes:
    """The kind of each byte that is a sign by itself."""
    kind = bytearray([_OTHER]) * 256
    for signs, own in ((string.ascii_letters, _LETTER), (".,!|%$&#*;:?", _MARK), (string.whitespace, _SPACE)):
        for sign in signs.encode():
            kind[sign] = own
    return bytes(kind)


_KIND = _kinds()


def parts_of(values: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The parts of all texts in order, which of the distinct ones are plain, and the number of parts up to the end of each text.

    Parts are white-space separated words. Plain words, of the letters A-Z and À-ÿ
    in either case and of marks, are lower-cased and parted where letters and
    marks meet, as the pre-tokenizer does; others stay whole and as they are.
    """
    whole = b"\n".join([*values, b""])
    raw, kind, lower = (np.frombuffer(x, np.uint8) for x in (whole, bytearray(whole.translate(_KIND)), bytearray(whole.lower())))
    second = np.flatnonzero(raw == 0xC3) + 1  # U+00C0 to U+00FF are two bytes, the first of which is this
    second = second[(raw[second] | 0x20) != 0xB7]  # not the signs of multiplication and division
    kind[second - 1] = kind[second] = _LETTER
    lower[second[raw[second] < 0x9F]] += 32
    held = kind != _SPACE
    if len(starts := np.flatnonzero(held & np.append(True, ~held[:-1]))) and (odd := np.minimum.reduceat(kind, starts) == _OTHER).any():
        inside = np.append(np.zeros(starts[0], bool), np.repeat(odd, np.diff(starts, append=len(raw)))) & held
        kind[inside] = _OTHER
        np.copyto(lower, raw, where=inside)
    first = held.copy()
    first[1:] &= kind[1:] != kind[:-1]
    ends = np.searchsorted(at := np.flatnonzero(first), np.cumsum([len(v) + 1 for v in values]))
    data = lower[held]
    offsets = np.append(np.flatnonzero(first[held]), len(data)).astype(np.int32)
    parts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    plain = np.zeros(len(parts.dictionary), bool)
    plain[parts.indices.to_numpy()] = kind[at] != _OTHER
    return parts, plain, ends


class WordIds:
    """Ids of parts of texts (see ``parts_of``), looked up once per distinct part.

    No token of the vocabulary's pre-tokenizer spans white space, or letters and
    marks, so a text's ids are its parts' ids in order. Ids are kept as
    little-endian unsigned 32-bit bytes. Words that are not plain go to the
    library whole. Parts of over LONG bytes are not kept. ``most`` bounds each
    generation of what is kept, in bytes.
    """

    def __init__(self, path: str, most: int):
        self.tokenizer = tokenizer_of(path)
        self.known = TwoGenerations(most)
        # a pre-token's last piece is marked in the vocabulary
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True

    def _library(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        for a, b in blocks(words, 1 << 14):  # the library's results take some 50 times the text
            for w, e in zip(words[a:b], self.tokenizer.encode_batch_fast([w.decode() for w in words[a:b]], add_special_tokens=False), strict=True):
                yield w, np.array(e.ids, "<u4").tobytes()

    def _single(self, words: list[bytes]) -> None:
        """Words that are one pre-token each, many to a call."""
        parts = [words[at : at + 1000] for at in range(0, len(words), 1000)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                for w, own in self._library(part):
                    self.known.put(w, own)
                continue
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, (ends * 4).tolist(), strict=True):
                self.known.put(w, raw[start:end])
                start = end

    def learn(self, plain: list[bytes], other: list[bytes]) -> None:
        """Makes every part known."""
        self.known.age()
        self._single(self.known.lacking(plain))
        for w, own in self._library(self.known.lacking(other)):
            self.known.put(w, own)

    def of(self, values: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        parts, plain, ends = parts_of(values)
        words, codes = parts.dictionary.to_pylist(), parts.indices.to_numpy()
        get, size = self.known.__getitem__, np.fromiter(map(len, words), np.int64, len(words))
        if once := dict(self._library([words[i] for i in np.flatnonzero(size > LONG).tolist()])):
            get = lambda w: once[w] if len(w) > LONG else self.known[w]
        self.learn(*[[words[i] for i in np.flatnonzero((size <= LONG) & own).tolist()] for own in (plain, ~plain)])
        found = list(map(get, words))
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(n) - n
        del found, get, once
        out, ends = [], [0, *ends.tolist()]
        for a, b in blocks(values, 1 << 18):  # positions take some eight times the text
            own = codes[ends[a] : ends[b]]
            each = n[own]
            until = np.cumsum(each)
            at = np.repeat(starts[own] - until + each, each)  # a part's ids are copied from its first id on
            at += np.arange(len(at))
            raw, bounds = ids[at].tobytes(), np.append(0, 4 * until)[np.subtract(ends[a : b + 1], ends[a])]
            out += [raw[x:y] for x, y in itertools.pairwise(bounds.tolist())]
        return out


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window (of ``k``) of each item, by multiway differencing: windows of near-equal sums.

    Each item begins as a partial partition with one used window. The two
    partitions with the widest spread are merged time and again, the fullest
    windows of one with the emptiest of the other, so that their imbalances
    cancel.
    """
    out = np.zeros(len(sizes), np.int64)
    if k == 1 or not sizes:
        return out
    sums: list[np.ndarray | None] = []
    for n in sizes:
        sums.append(np.zeros(k, np.int64))
        sums[-1][-1] = n
    heap = [(-n, i) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = both.argsort(kind="stable")
        both = both[order]
        both -= both[0]
        heapq.heappush(heap, (-int(both[-1]), len(sums)))
        sums.append(both)
        sums[a] = sums[b] = None
        merges.append((a, b, order))
    # from the last merge back to the items: which window each place of a partition has become
    window: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    for at in range(len(merges) - 1, -1, -1):
        a, b, order = merges[at]
        own = np.empty(k, np.int64)
        own[order] = window.pop(len(sizes) + at)
        window[a], window[b] = own, own[::-1]
    for i in range(len(sizes)):
        out[i] = window[i][-1]
    return out


#: A piece is (key of a text, start, length); an item is a list of pieces that stay together unless cut.
Item = list[tuple[int, int, int]]


def size_of(item: Item) -> int:
    return sum(p[2] for p in item)


def cut(item: Item, at: int) -> tuple[Item, Item]:
    """The item's first ``at`` tokens, and the others."""
    left, right = [], []
    for key, start, n in item:
        own = min(n, at)
        at -= own
        if own:
            left.append((key, start, own))
        if own < n:
            right.append((key, start + own, n - own))
    return left, right


def fill(items: list[Item], capacity: int, cuts: bool, padding: float = 1 / 80) -> list[Item]:
    """Windows, none over capacity, made near equal by differencing.

    The number of windows begins at what the total needs and rises by one
    whenever a window is over capacity. With ``cuts`` it stops rising where more
    than a share of ``padding`` would stay empty; then the
    longest items are cut in halves instead, until all fits.
    """
    sizes = [size_of(x) for x in items]
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    most = max(k, int(total * (1 + padding) / capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, sizes, k).max(initial=0) <= capacity:
            break
        if not cuts or k < most:
            k += 1
            continue
        limit = max(sizes) // 2
        items = [x for item, n in zip(items, sizes, strict=True) for x in (cut(item, -(-n // 2)) if n > limit else (item,)) if x]
        sizes = [size_of(x) for x in items]
    out: list[Item] = [[] for _ in range(k)]
    for item, w in zip(items, window.tolist(), strict=True):
        out[w] += item
    return [w for w in out if w]


class _Packer:
    """Windows of one task, in groups that are closed one after another.

    Groups are planned with a little room (1/256 of each window), so that
    differencing seldom has to be done twice. Pieces of fewer than 1/64 of a
    window are put together to items of that size first, which bounds the items
    of a group.
    """

    def __init__(self, capacity: int, group: int, cuts: bool, base: int):
        self.capacity, self.group, self.cuts, self.next = capacity, group, cuts, base
        self.room, self.least = max(1, capacity - capacity // 256), max(1, capacity // 64)
        self.items: list[Item] = []
        self.small: Item = []
        self.texts: dict[int, tuple] = {}
        self.total = self.keys = 0
        self.rows: list[tuple] = []

    def _emit(self, window: Item) -> None:
        at = 0
        for key, start, n in window:
            doc_id, first, raw, tokens = self.texts[key]
            self.rows.append((doc_id, first + start, n, raw[4 * start : 4 * (start + n)], tokens, self.next, at))
            at += n
        self.next += 1

    def _take(self, item: Item) -> None:
        self.items.append(item)
        self.total += size_of(item)

    def add(self, doc_id, first: int, raw: bytes, tokens: int) -> None:
        """Adds a stretch of a document's ids that begins with id number ``first``; ``tokens`` is the number of all its ids."""
        n, key = len(raw) // 4, self.keys
        self.keys += 1
        whole = n - n % self.capacity
        if whole:
            self.texts[key] = (doc_id, first, raw, tokens)
            for at in range(0, whole, self.capacity):
                self._emit([(key, at, self.capacity)])
        if not (n := n - whole):
            self.texts.pop(key, None)
            return
        self.texts[key] = (doc_id, first + whole, raw[4 * whole :], tokens)
        self.small.append((key, 0, n))
        if (n if n >= self.least else size_of(self.small)) < self.least:
            return
        item, self.small = self.small, []
        self._take(item)
        while self.total >= (most := self.group * self.room):
            rest: Item = []
            if self.cuts and self.total > most:
                last = self.items.pop()
                self.total -= size_of(last)
                last, rest = cut(last, most - self.total)
                self._take(last)
            self.close(self.items)
            self.items, self.total = [], 0
            held = {p[0] for p in rest}
            self.texts = {k: v for k, v in self.texts.items() if k in held}
            if rest:
                self._take(rest)

    def close(self, items: list[Item]) -> None:
        if items:
            for window in fill(items, self.capacity, self.cuts):
                self._emit(window)

    def rest(self) -> list[tuple]:
        """Closes all windows that can be filled; returns (doc_id, start, length, ids, doc_tokens) of what is left, less than one window."""
        if self.small:
            self._take(self.small)
            self.small = []
        left = self.total % self.room
        taken: list[Item] = []
        while self.items and left:
            item = self.items.pop()
            part, over = cut(item, max(0, size_of(item) - left))
            taken.append(over)
            left -= size_of(over)
            if part:
                self.items.append(part)
        self.close(self.items)
        self.items, self.total = [], 0
        out = []
        for key, start, n in [p for item in taken for p in item]:
            doc_id, first, raw, tokens = self.texts[key]
            out.append((doc_id, first + start, n, raw[4 * start : 4 * (start + n)], tokens))
        return out

    def finish(self) -> None:
        """Closes everything."""
        if self.small:
            self._take(self.small)
        self.close(self.items)
        self.items, self.small, self.texts, self.total = [], [], {}, 0

    def taken(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def _lists(raw: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(r) // 4 for r in raw]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))


#: Tasks whose rests are packed together.
TASKS = 256


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group: int = 128, cuts: bool = True, with_ids: bool = True,
    known_bytes: int = 1 << 27, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Packs every document, followed by ``end_id``, into windows of at most ``capacity`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, ``with_ids``, the token ids. Whole windows are cut
    off long documents first; the rests are dealt by differencing, ``group``
    windows at a time, in the task that read them, and the number of windows
    rises whenever one is over capacity (see ``fill``). What a task cannot fill
    a window with goes to a second round, in which the rests of TASKS tasks meet
    (at most that many windows), so padding does not depend on how the table is
    partitioned. A task holds one group of windows and a few MB of text. A worker
    keeps up to twice ``known_bytes`` of words and their ids. The
    first round is stored. Without ``cuts`` only texts of over a window are cut.

    Null text counts as empty: a piece with the end token alone. Each row is
    packed for itself, so repeated rows and ids stay apart (by sequence_id and
    offset); ids may be null. Equal lengths are dealt in the order of the rows.
    The ids of a very long text are held in one piece of memory while it is cut.
    Other columns are ignored. An empty table gives no rows.
    """
    kind = pa.int64() if isinstance(docs.schema[id_col].dataType, T.LongType) else None
    ids = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()), *ids,
        ]
    )
    key_of_words = ("word ids", tokenizer_path, known_bytes)
    first_schema = T.StructType([*schema.fields, T.StructField("rest", T.BinaryType())])

    def batch_of(rows: list[tuple], rest: bool = False) -> pa.RecordBatch:
        """Of (doc_id, start, length, ids, doc_tokens, sequence_id, offset)."""
        doc, start, n, raw, tokens, sequence, at = zip(*rows, strict=True)
        arrays = [pa.array(doc, kind), *[pa.array(c, pa.int64()) for c in (start, n, [zlib.crc32(r) for r in raw], tokens, sequence, at)]]
        if with_ids:
            arrays.append(pa.nulls(len(rows), pa.list_(pa.int32())) if rest else _lists(raw))
        return pa.RecordBatch.from_arrays([*arrays, pa.array(raw if rest else [None] * len(rows), pa.binary())], names=first_schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, task = kept(key_of_words, lambda: WordIds(tokenizer_path, known_bytes)), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        packer = _Packer(capacity, group, cuts, task << 32)
        for batch in batches:
            for a, b, values in pieces(batch, text_col, 1 << 21):
                for key, raw in zip(batch.column(0).slice(a, b - a).to_pylist(), words.of(values), strict=True):
                    packer.add(key, 0, raw + end, len(raw) // 4 + 1)
                if rows := packer.taken():
                    yield batch_of(rows)
        left = packer.rest() if cuts else packer.finish()
        if rows := packer.taken():
            yield batch_of(rows)
        if left:
            yield batch_of([(*r, None, task // TASKS) for r in left], rest=True)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, last = None, None
        for batch in batches:
            for doc_id, start, raw, tokens, key in zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True):
                if key != last:
                    if packer:
                        packer.finish()
                        if rows := packer.taken():
                            yield batch_of(rows).select(schema.names)
                    packer, last = _Packer(capacity, group, cuts, (1 << 62) + (key << 32)), key
                packer.add(doc_id, start, raw, tokens)
            if packer and (rows := packer.taken()):
                yield batch_of(rows).select(schema.names)
        if packer:
            packer.finish()
            if rows := packer.taken():
                yield batch_of(rows).select(schema.names)

    first = stored(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(frugal(run, key_of_words), first_schema), "packed")
    rests = first.where(F.col("rest").isNotNull()).select(id_col, "start", "rest", "doc_tokens", "offset").repartition("offset").sortWithinPartitions("offset", id_col, "start")
    return first.where(F.col("rest").isNull()).select(*schema.names).unionByName(rests.mapInArrow(frugal(again), schema))
