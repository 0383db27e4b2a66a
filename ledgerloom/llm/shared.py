"""What the operators of this subpackage have in common."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from typing import TYPE_CHECKING, Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import stored

if TYPE_CHECKING:
    from tokenizers import Tokenizer

__all__ = ["LONG", "TwoGenerations", "blocks", "frugal", "kept", "pieces", "small_or_stored", "stored", "texts", "tokenizer_of"]

#: Most rows of narrow tables that are broadcast.
SMALL = 100_000
#: Bytes of a word from which on no worker keeps what it has worked out for it: in unspaced text a word is a whole line, which seldom comes again.
LONG = 64


def small_or_stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, stored; marked for broadcast if it has at most SMALL rows.

    A larger one is joined by shuffle, in which hot keys can be split, since
    nothing stands between its files and the join.
    """
    kept = stored(df, name)
    return F.broadcast(kept) if kept.count() <= SMALL else kept


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def blocks(values: list[bytes], most_bytes: int) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive runs of values of about ``most_bytes``; a longer value is a run alone."""
    yield from _runs(map(len, values), most_bytes)


def _runs(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    start, end, held = 0, 0, 0
    for n in sizes:
        if end > start and held + n > most:
            yield start, end
            start, held = end, 0
        held += n
        end += 1
    if start < end:
        yield start, end


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, end, texts) of consecutive runs of rows as by ``blocks``; texts are copied a run at a time, since a batch may hold 10,000 of any length."""
    for a, b in _runs(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), most_bytes):
        yield a, b, texts(batch.slice(a, b - a), column)


class TwoGenerations(dict):
    """A mapping of bytes to bytes of bounded size: ``age`` drops entries unused for a generation of ``most`` bytes.

    Entries count with 200 bytes besides their own. Both generations together
    hold twice ``most`` and what one piece of work adds.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def put(self, key: bytes, value: bytes) -> None:
        self[key] = value
        self.held += len(key) + len(value) + 200

    def age(self) -> None:
        """To be called between pieces of work; what a piece has looked up stays until it ends."""
        if self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0

    def lacking(self, keys: set) -> list:
        """Keys held in neither generation; those in the old one move up."""
        out = []
        for k in [k for k in keys if k not in self]:  # keys - self.keys() would walk the whole mapping
            if (v := self.old.get(k)) is None:
                out.append(k)
            else:
                self.put(k, v)
        return out


def tokenizer_of(path: str) -> Tokenizer:
    """The tokenizer of a file, for one thread: a task has a core, and each thread of the library takes memory that it does not give back."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


_KEPT: dict[tuple, Any] = {}


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by a Python worker from task to task until another key is asked for."""
    if key not in _KEPT:
        _KEPT.clear()
        _give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def _drop_others(key: tuple | None) -> None:
    """Drops what a worker keeps under another key."""
    if any(k != key for k in _KEPT):
        _KEPT.clear()
        _give_back()


def _give_back() -> None:
    """Returns freed memory to the system, which allocators otherwise keep for the worker's next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: tuple | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work; a worker, which lives on for other stages, gives back what a task of it took.

    What it has ``kept`` under another key than ``keeps`` goes before the work begins.
    """

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_others(keeps)  # by its name: a dictionary named here would be sent along with the function
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped
