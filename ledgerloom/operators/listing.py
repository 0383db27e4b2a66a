"""Lines of parent records: listing, expanding, nesting, tags and the active filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.numbering import STRETCH, numbered

#: Fixed order in which a line is shown.
LISTING = ("definition", "kind", "name", "group_ids", "active")


def line_listing(lines: DataFrame, columns: Sequence[str] = LISTING, keys: Sequence[str] = ()) -> DataFrame:
    """The line columns in their declared order, after any key columns; every line is kept."""
    return lines.select(*keys, *columns)


def expand_lines(parents: DataFrame, lines: DataFrame, on: tuple[str, str], keep_empty: bool = False) -> DataFrame:
    """One row per parent and line; ``on`` is (parent key, line's foreign key).

    ``keep_empty`` keeps parents without lines once, with null line columns.
    Null keys match nothing.
    """
    parent_key, line_key = on
    return parents.join(lines, parents[parent_key] == lines[line_key], "left" if keep_empty else "inner")


def nest_lines(
    parents: DataFrame, lines: DataFrame, on: tuple[str, str], order_by: Sequence[str], fields: Sequence[str] = (), name: str = "lines"
) -> DataFrame:
    """One row per parent, with its lines as an array of structs sorted by ``order_by``.

    ``order_by`` must order the lines of a parent totally (equal lines are alike
    anyway). Parents without lines get an empty array. The lines are grouped
    before the join, so parents are not multiplied; an array holds all lines of
    its parent and must fit in memory (see ``nest_line_chunks``).
    """
    parent_key, line_key = on
    members = [*order_by, *(f for f in fields if f not in order_by)]
    nested = (
        lines.where(F.col(line_key).isNotNull())
        .groupBy(F.col(line_key).alias("__fk"))
        .agg(F.array_sort(F.collect_list(F.struct(*members))).alias(name))
    )
    empty = F.array().cast(nested.schema[name].dataType)
    return (
        parents.join(nested, parents[parent_key] == nested["__fk"], "left")
        .withColumn(name, F.coalesce(F.col(name), empty))
        .drop("__fk")
    )


def _chunks(rows: DataFrame, key: str, order_by: Sequence[str], value: Column, name: str, size: int, stretch: int) -> DataFrame:
    """(key, chunk, name): the values of each key in order, in arrays of ``size``; the last of a key may be shorter."""
    placed = numbered(rows, [key], order_by, "__at", stretch)
    grouped = placed.groupBy(key, F.floor(F.col("__at") / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("__at", value.alias("v")))).alias("__in_order"))
    return grouped.select(key, "chunk", F.transform("__in_order", lambda x: x["v"]).alias(name))


def _with_chunks(rows: DataFrame, key: str, chunks: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """``rows`` with each of their chunks, or with one empty chunk.

    An inner join, in which a row of many chunks can be split, and the rows that
    have none: those whose key is not one of ``known``, so that nothing is
    numbered for them.
    """
    empty = F.array().cast(chunks.schema[name].dataType)
    some = rows.join(chunks, rows[key] == chunks["__key"]).drop("__key")
    none = rows.join(known.select("__key").distinct(), rows[key] == F.col("__key"), "left_anti")
    return some.unionByName(none.withColumns({"chunk": F.lit(0).cast("bigint"), name: empty}))


def nest_line_chunks(
    parents: DataFrame, lines: DataFrame, on: tuple[str, str], order_by: Sequence[str], fields: Sequence[str] = (), name: str = "lines",
    size: int = 10_000, stretch: int = STRETCH,
) -> DataFrame:
    """Like ``nest_lines`` for parents of any number of lines: one row per parent and chunk of at most ``size`` lines.

    Chunks count from 0 in the order of the lines; put together they are the
    array of ``nest_lines``. A parent without lines has one empty chunk. The
    lines of one parent are numbered and gathered by many tasks, and no row
    holds more than one chunk.
    """
    parent_key, line_key = on
    members = [*order_by, *(f for f in fields if f not in order_by)]
    known = lines.where(F.col(line_key).isNotNull()).select(F.col(line_key).alias("__key"), *members)
    return _with_chunks(parents, parent_key, _chunks(known, "__key", order_by, F.struct(*members), name, size, stretch), known, name)


def attach_tags(
    lines: DataFrame, link: DataFrame, groups: DataFrame, line_key: str, link_keys: tuple[str, str], group_key: str, label: str, name: str = "tags"
) -> DataFrame:
    """Adds the sorted, distinct labels of a line's groups as an array.

    ``link_keys`` is (line key, group key) in ``link``. Links repeated or to a
    missing group add nothing; a line without tags keeps its row with an empty
    array. Duplicate links go before labels are joined.
    """
    tags = _labels(link, groups, link_keys, group_key, label).groupBy("__line").agg(F.array_sort(F.collect_set("__label")).alias(name))
    return (
        lines.join(tags, lines[line_key] == tags["__line"], "left")
        .withColumn(name, F.coalesce(F.col(name), F.array().cast("array<string>")))
        .drop("__line")
    )


def _labels(link: DataFrame, groups: DataFrame, link_keys: tuple[str, str], group_key: str, label: str) -> DataFrame:
    """(__line, __label) of each link to a group that exists."""
    link_line, link_group = link_keys
    pairs = link.select(F.col(link_line).alias("__line"), F.col(link_group).alias("__group")).distinct()
    return pairs.join(groups.select(F.col(group_key).alias("__group"), F.col(label).alias("__label")), "__group").select("__line", "__label")


def attach_tag_chunks(
    lines: DataFrame, link: DataFrame, groups: DataFrame, line_key: str, link_keys: tuple[str, str], group_key: str, label: str, name: str = "tags",
    size: int = 10_000, stretch: int = STRETCH,
) -> DataFrame:
    """Like ``attach_tags`` for lines of any number of tags: one row per line and chunk of at most ``size`` labels.

    Put together in order the chunks are the array of ``attach_tags``; a line
    without tags has one empty chunk. Null labels are no tags.
    """
    labels = _labels(link, groups, link_keys, group_key, label).where("__line is not null and __label is not null").distinct()
    labels = labels.withColumnRenamed("__line", "__key")
    return _with_chunks(lines, line_key, _chunks(labels, "__key", ["__label"], F.col("__label"), name, size, stretch), labels, name)


def tags_text(name: str = "tags", separator: str = ",") -> Column:
    """A tag array as one string."""
    return F.array_join(F.col(name), separator)


def active_only(lines: DataFrame, flag: str = "active") -> DataFrame:
    """Lines whose flag is true; a null flag counts as not active."""
    return lines.where(F.col(flag))
