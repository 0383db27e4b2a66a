"""Benchmark decontamination by canonical templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import LONG, frugal, pieces, stored, texts

#: Words that stand for numbers, and for units.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen".split()
)
UNIT_WORDS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons ml l liter liters "
    "litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp percent % degree degrees c f k w kw v kmh mph hz khz mhz ghz kb mb gb tb".split()
)
_NUMBER = re.compile(r"[-+]?[$€£]?[0-9][0-9.,/]*")
_QUANTITY = re.compile(r"([-+]?[$€£]?[0-9][0-9.,/]*)([^\W\d_]+|%)")
_EDGE = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$")
#: Flags in the low bits of a word's number.
_CAPITAL, _ENDS, _EMPTY, _IS_NUMBER, _IS_QUANTITY, _IS_UNIT = 1, 2, 4, 8, 16, 32
_FLAGS = np.uint64(63)
#: Readings of a window: capitalised words that open a sentence as words, or as names; all words literally.
PLAIN, NAMES, LITERAL = range(3)
#: Bits of the table of known hashes (8 MB).
TABLE_BITS = 1 << 26
_M = 0x9E3779B97F4A7C15
_WIDE, _SHORT = np.uint64(0x165667B19E3779F9), np.uint64(0xC2B2AE3D27D4EB4F)


def _number_of(form: str) -> int:
    return xxhash.xxh64_intdigest(form.encode()) & ~63


_PLACEHOLDERS = {flag: np.uint64(_number_of(name)) for flag, name in ((_IS_NUMBER, "<number>"), (_IS_QUANTITY, "<number><unit>"), (_IS_UNIT, "<unit>"), (_CAPITAL, "<name>"))}


def bare(word: bytes) -> str:
    """The word without the marks around it."""
    return _EDGE.sub("", word.decode())


class Forms(dict):
    """For each word the number of its lower-cased form, with flags that tell what else it may be; forgets all at a bound, and long words at once."""

    def __missing__(self, word: bytes) -> int:
        text, own = word.decode(), bare(word)
        low = own.lower()
        flags = _ENDS if text[-1] in ".!?:;" or (len(text) > 1 and text[-1] in "\"')»”" and text[-2] in ".!?") else 0
        if not own:
            value = flags | _EMPTY
        else:
            if _NUMBER.fullmatch(own) or low in NUMBER_WORDS:
                flags |= _IS_NUMBER
            elif (q := _QUANTITY.fullmatch(low)) and q[2] in UNIT_WORDS:
                flags |= _IS_QUANTITY
            else:
                flags |= (_IS_UNIT if low in UNIT_WORDS else 0) | (_CAPITAL if own[0].isupper() and not own.isupper() else 0)
            value = _number_of(low) | flags
        if len(word) <= LONG:
            self[word] = value
        return value


@dataclass
class Templates:
    """The forms of several texts, one text after another."""

    words: list[bytes]
    places: np.ndarray  # of each form among the words
    text: np.ndarray  # to which text it belongs
    first: np.ndarray  # where that text's forms begin
    end: np.ndarray  # and end
    begins: np.ndarray  # it is the first form of a sentence
    ends: np.ndarray  # or the last one
    values: list[np.ndarray]  # its number in each reading
    slots: list[np.ndarray]  # whether it is a placeholder in each reading

    @staticmethod
    def of(split: list[list[bytes]], forms: Forms) -> Templates:
        if len(forms) > 150_000:
            forms.clear()
        words = [w for own in split for w in own]
        value = np.fromiter(map(forms.__getitem__, words), np.uint64, len(words))
        flags = (value & _FLAGS).astype(np.uint8)
        text = np.repeat(np.arange(len(split)), [len(own) for own in split])
        sentence = np.cumsum(np.concatenate([[0], (flags[:-1] & _ENDS) > 0])) if len(words) else np.zeros(0, np.int64)
        places = np.flatnonzero((flags & _EMPTY) == 0)
        literal, flags, text, sentence = (value & ~_FLAGS)[places], flags[places], text[places], sentence[places]
        new_text = np.ones(len(places) + 1, bool)
        new_text[1:-1] = text[1:] != text[:-1]
        turns = new_text.copy()
        turns[1:-1] |= sentence[1:] != sentence[:-1]
        starts = np.flatnonzero(new_text)
        size = np.diff(starts)
        begins, ends = turns[:-1], turns[1:]
        number = (flags & _IS_NUMBER) > 0
        unit = (flags & _IS_UNIT) > 0
        unit[1:] &= number[:-1] & ~new_text[1:-1]
        unit[:1] = False
        capital = ((flags & _CAPITAL) > 0) & ~unit
        plain, names = literal.copy(), literal.copy()
        for x in (plain, names):
            x[number] = _PLACEHOLDERS[_IS_NUMBER]
            x[(flags & _IS_QUANTITY) > 0] = _PLACEHOLDERS[_IS_QUANTITY]
            x[unit] = _PLACEHOLDERS[_IS_UNIT]
        plain[capital & ~begins] = _PLACEHOLDERS[_CAPITAL]
        names[capital] = _PLACEHOLDERS[_CAPITAL]
        slot = number | unit | ((flags & _IS_QUANTITY) > 0)
        return Templates(
            words, places, text, np.repeat(starts[:-1], size), np.repeat(starts[1:], size), begins, ends, [plain, names, literal],
            [slot | (capital & ~begins), slot | capital, np.zeros(len(places), bool)],
        )

    def slot_places(self, reading: int, start: int, size: int) -> list[int]:
        return (np.flatnonzero(self.slots[reading][start : start + size]) + start).tolist()

    def slot_names(self, reading: int, start: int, size: int) -> list[bool]:
        """Whether each of the window's placeholders is a name."""
        return [self.values[reading][i] == _PLACEHOLDERS[_CAPITAL] for i in self.slot_places(reading, start, size)]

    def slot_values(self, reading: int, start: int, size: int) -> list[str]:
        """What the window's placeholders stand for."""
        return [bare(self.words[self.places[i]]) for i in self.slot_places(reading, start, size)]

    def _narrow(self, reading: int, width: int) -> np.ndarray:
        """Number of each window of ``width`` forms."""
        n = len(self.places) - width + 1
        value = np.full(n, width, np.uint64)
        for j in range(width):
            value = value * np.uint64(_M) + self.values[reading][j : j + n]
        value ^= value >> np.uint64(31)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        return value ^ (value >> np.uint64(29))

    def windows(self, width: int, longest: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(reading, start, size, hash) of the windows of ``width`` forms, those with too many placeholders as ``contaminated`` says."""
        n = len(self.places) - width + 1
        if n <= 0:
            return
        at = np.arange(n)
        whole = at + width <= self.end[:n]
        count = [np.concatenate([[0], np.cumsum(s)]) for s in self.slots[:2]]
        held = [c[width:] - c[:-width] for c in count]
        twofold = held[0] != held[1]
        for reading in (PLAIN, NAMES):
            own = whole & (twofold if reading else True)
            start = np.flatnonzero(own & (held[reading] <= width // 2))
            if len(start):
                yield reading, start, np.full(len(start), width), self._narrow(reading, width)[start].view(np.int64)
            heavy = np.flatnonzero(own & (held[reading] > width // 2))
            if len(heavy):
                yield (reading, *self._wide(reading, heavy, width, longest))
        start = np.flatnonzero(whole & ((held[0] > width // 2) | (held[1] > width // 2)))
        if len(start):
            yield LITERAL, start, np.full(len(start), width), self._narrow(LITERAL, width)[start].view(np.int64)

    def _wide(self, reading: int, start: np.ndarray, width: int, longest: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        others = np.concatenate([[0], np.cumsum(~self.slots[reading])])
        end = np.searchsorted(others, others[start] + width - width // 2)
        fits = end <= self.end[start]
        if longest is not None:
            fits &= end <= start + longest
        start, end = start[fits], end[fits]
        # sums over inverse powers, so that windows of any length cost the same
        n = len(self.places)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[reading] * np.multiply.accumulate(np.full(n, pow(_M, -1, 1 << 64), np.uint64)), dtype=np.uint64)])
        power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _M, np.uint64)]))
        value = (sums[end] - sums[start]) * power[start]
        value = (value + (end - start).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        return start, end - start, (value ^ (value >> np.uint64(29)) ^ _WIDE).view(np.int64)

    def sentences(self, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The same for runs of ``width`` forms that are whole sentences, literally."""
        n = len(self.places) - width + 1
        if n > 0:
            start = np.flatnonzero(self.begins[:n] & self.ends[width - 1 :] & (np.arange(n) + width <= self.end[:n]))
            yield LITERAL, start, np.full(len(start), width), (self._narrow(LITERAL, width)[start] ^ _SHORT).view(np.int64)


def benchmark_windows(benchmark: DataFrame, window: int, shortest: int, id_col: str, text_col: str) -> DataFrame:
    """(hash, item, item_id, item_pos, width, item_forms, item_slots, item_at, item_names, base): the windows of each item.

    item numbers the rows, item_at has the places of the slots, item_names tells which are names. base is the
    width of the item's windows before any was widened; 0 for an item of fewer
    than ``shortest`` forms, which has one window, as a whole sentence.
    """
    names = ["hash", "item", "item_id", "item_pos", "width", "item_forms", "item_slots", "item_at", "item_names", "base"]
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, item = Forms(), TaskContext.get().partitionId() << 40
        kinds = [pa.int64(), pa.int64(), None, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64()]
        for batch in batches:
            out = []
            for item_id, text in zip(batch.column(0).to_pylist(), texts(batch, text_col), strict=True):
                t, item = Templates.of([text.split()], forms), item + 1
                n = len(t.places)
                base = min(window, n) if n >= shortest else 0
                if not base and n:
                    t.begins[0] = t.ends[-1] = True
                for reading, *found in t.windows(base) if base else t.sentences(n) if n else ():
                    for i, size, value in zip(*(x.tolist() for x in found), strict=True):
                        out.append((value, item, item_id, i, size, n, t.slot_values(reading, i, size), t.slot_places(reading, i, size), t.slot_names(reading, i, size), base))
            cols = list(zip(*out, strict=True)) or [()] * 10
            kinds[2] = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    schema = f"hash bigint, item bigint, item_id {kind}, item_pos bigint, width bigint, item_forms bigint, item_slots array<string>, item_at array<bigint>, item_names array<boolean>, base bigint"
    return benchmark.select(id_col, text_col).mapInArrow(run, schema)


def _table_of(items: DataFrame) -> np.ndarray:
    """A bit for each remainder of the items' hashes; its size is fixed."""
    bit = F.pmod("hash", F.lit(TABLE_BITS))
    words = items.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, {TABLE_BITS}) & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(TABLE_BITS >> 6, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table


def _values(x: Column) -> Column:
    return F.struct(x["a"].alias("a"), x["name"].alias("name"), x["b"].alias("b"))


def _stands(x: Column) -> Column:
    return F.struct(x["a"], x["name"])


def _covered(windows: Column) -> Column:
    """The places of the item's forms that lie in the windows."""
    return F.array_distinct(F.flatten(F.transform(windows, lambda x: F.sequence(x["item_pos"], x["item_pos"] + x["width"] - 1))))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 6, least: float = 0.5, shortest: int = 5,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row for each document row and item row found in it: doc_id, item_id, n_windows, n_slots, coverage.

    Texts become templates: numbers, quantities (a number and a unit in one
    word), units right after a number, and names turn into typed placeholders;
    other words are lower-cased without the marks around them. A capitalised
    word is a name; where it opens a sentence it is read both ways, as a name
    and as a word. Windows of ``window`` forms (of all its forms, for an item
    that has fewer) are joined on their hash. A window in which over half are
    placeholders says too little: it is looked for by its literal words, and by
    its template if that can be widened to the right until it holds as many
    other forms as any window has.

    Matches of a document with an item are followed along each alignment. A
    window with the item's own values always counts. The others count if each
    value of the item stands for one value of the document there: that which it
    has at most places; windows with another are left out. A number, quantity or
    unit that recurs in the item may stand for two values, since equal numbers
    are often two parameters; if it has more, and two are equally frequent, its
    windows are left out. A name with two equally frequent values is no name of
    the document's, and all windows with other values are left out. So a question
    with other values in it is caught while a mere likeness of form is not. A document is contaminated
    by an item if at least ``least`` of the item's forms lie in windows that
    count; others give no row. An item of fewer than ``shortest`` forms has no
    template: it is found as a whole sentence of the same words.

    A table of fixed size that has the hashes of the benchmark, and few others,
    drops most windows where documents are read. Pairs whose hits cannot reach
    ``least`` go before any values are compared, so forms that many items share
    cost two numbers each. Windows, values and alignments of one pair are bounded
    by the item's own size.

    All of every text is read; a very long one is one block of its own, with
    memory in proportion to its words. Null and empty texts match nothing. Each
    row is judged for itself, with any id or none, so a row that repeats is
    reported as often; of several items all are reported. Other columns are
    ignored. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = stored(benchmark_windows(benchmark, window, shortest, item_col, item_text_col), "items")
    widths = sorted(tuple(r) for r in items.where("base > 0").groupBy("base").agg(F.max("width")).collect())  # at most ``window`` rows
    short = sorted(r[0] for r in items.where("base = 0").select("width").distinct().collect())  # fewer than ``shortest``
    held = spark.sparkContext.broadcast(_table_of(items))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, table, row = Forms(), held.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for a, b, values in pieces(batch, text_col, 1 << 20):
                t = Templates.of([v.split() for v in values], forms)
                text, pos, found, slots = [], [], [], []
                for reading, start, size, hashes in [x for w, longest in widths for x in t.windows(w, longest)] + [x for w in short for x in t.sentences(w)]:
                    place = hashes & (TABLE_BITS - 1)
                    hits = np.flatnonzero((table[place >> 6] >> (place & 63)) & 1)
                    start = start[hits]
                    text.append(t.text[start])
                    pos.append(start - t.first[start])
                    found.append(hashes[hits])
                    slots += [t.slot_values(reading, i, n) for i, n in zip(start.tolist(), size[hits].tolist(), strict=True)]
                if slots:
                    text = np.concatenate(text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row + text), ids.take(pa.array(a + text)), pa.array(np.concatenate(pos)), pa.array(np.concatenate(found)), pa.array(slots, pa.list_(pa.string()))],
                        names=["row", "doc_id", "pos", "hash", "slots"],
                    )
                row += b - a

    hits = stored(docs.select(id_col, text_col).mapInArrow(frugal(run), f"row bigint, doc_id {kind}, pos bigint, hash bigint, slots array<string>"), "hits")
    met = hits.select("row", "hash").join(items.select("hash", "item", "item_pos", "width", "item_forms"), "hash")
    near = met.groupBy("row", "item", "item_forms").agg(F.collect_set(F.struct("item_pos", "width")).alias("met"))
    near = stored(near.where(F.size(_covered(F.col("met"))) >= least * F.col("item_forms")).select("row", "item"), "near")
    both = hits.join(items, "hash").where(F.size("slots") == F.size("item_slots")).join(near, ["row", "item"], "left_semi")

    zipped = F.arrays_zip("item_at", "item_slots", "item_names", "slots")
    pairs = F.transform(zipped, lambda x: F.struct(x["item_at"].alias("at"), x["item_slots"].alias("a"), x["item_names"].alias("name"), x["slots"].alias("b")))
    window_of = F.struct("item_pos", "width", (F.col("slots") == F.col("item_slots")).alias("same"), pairs.alias("pairs"))
    pair = ["row", "doc_id", "item", "item_id", "item_forms"]
    along = both.groupBy(*pair, (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set(window_of).alias("met"))
    along = along.withColumn("all", F.array_distinct(F.flatten("met.pairs")))
    along = along.withColumn("kinds", F.array_distinct(F.transform("all", _values)))
    counted = F.transform("kinds", lambda p: F.struct(p["a"].alias("a"), p["name"].alias("name"), p["b"].alias("b"), F.size(F.filter("all", lambda x: _values(x) == p)).alias("n")))
    along = along.withColumn("counted", counted)

    def leads(p: Column) -> Column:
        others = F.filter("counted", lambda q: (_stands(q) == _stands(p)) & (q["b"] != p["b"]))
        return (~p["name"] & (F.size(others) <= 1)) | ~F.exists(others, lambda q: q["n"] >= p["n"])

    along = along.withColumn("lead", F.transform(F.filter("counted", leads), _values))
    mapped = F.forall("kinds", lambda p: ~p["name"] | F.exists("lead", lambda q: _stands(q) == _stands(p)))
    kept = F.filter("met", lambda w: w["same"] | (mapped & F.forall(w["pairs"], lambda x: F.array_contains("lead", _values(x)))))
    each = along.withColumn("met", kept).where(F.size("met") > 0)
    each = each.select(
        *pair, F.size(F.array_distinct(F.transform("met", lambda w: F.struct(w["item_pos"], w["width"])))).alias("n"),
        F.size(F.array_distinct(F.transform(F.flatten("met.pairs"), _values))).alias("slots"), _covered(F.col("met")).alias("forms"),
    )
    out = each.groupBy(*pair).agg(F.sum("n").alias("n_windows"), F.max("slots").cast("bigint").alias("n_slots"), F.array_distinct(F.flatten(F.collect_set("forms"))).alias("forms"))
    out = out.withColumn("coverage", F.size("forms") / F.col("item_forms")).where(F.col("coverage") >= least)
    return out.select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), "n_windows", "n_slots", "coverage")
