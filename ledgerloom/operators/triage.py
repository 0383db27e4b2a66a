"""Screening log lines against a list of ignore patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.patterns import grams_of, index_of, matches_any

#: Most patterns that are tried on every line; more are looked up in a table.
MOST_TRIED = 200
#: Most characters of a table of patterns that is broadcast.
MOST_BROADCAST = 1 << 23


def pattern_hits(lines: DataFrame, patterns: Sequence[str], column: str) -> DataFrame:
    """(the columns of ``lines``, pattern_id): one row for each line and pattern that match.

    The patterns are a table with an index: from each that allows it a stretch
    of four signs which all its matches hold. Lines meet, by the stretches in
    them, only the patterns that can match, and these alone are tried. Patterns
    without such a stretch are tried on every line.
    """
    spark = lines.sparkSession
    known, others = index_of(patterns)
    table = spark.createDataFrame(known, "pattern_id int, __regex string, __gram string")
    if sum(map(len, patterns)) <= MOST_BROADCAST:
        table = F.broadcast(table)
    met = lines.withColumn("__gram", F.explode(grams_of(column))).join(table, "__gram")
    out = met.where(F.rlike(F.col(column), F.col("__regex"))).select(*lines.columns, "pattern_id")
    if others:
        rest = spark.createDataFrame(others, "pattern_id int, __regex string")
        out = out.unionByName(lines.join(F.broadcast(rest), F.rlike(F.col(column), F.col("__regex"))).select(*lines.columns, "pattern_id"))
    return out


def drop_ignored(lines: DataFrame, patterns: Sequence[str], column: str = "line") -> DataFrame:
    """Lines that match no pattern; null lines are kept, an empty list drops nothing.

    Up to MOST_TRIED patterns are one alternation in one narrow pass. Of more,
    the lines with a hit are found first (see ``pattern_hits``), and the others
    are those that are not among them; equal lines share their fate.
    """
    if not patterns:
        return lines
    if len(patterns) <= MOST_TRIED:
        return lines.where(~matches_any(column, patterns))
    hit = pattern_hits(lines.select(F.col(column).alias("__hit")), patterns, "__hit").select("__hit").distinct()
    return lines.join(hit, F.col(column) == F.col("__hit"), "left_anti")


def ignored_counts(lines: DataFrame, patterns: Sequence[str], column: str = "line") -> DataFrame:
    """(pattern_id, n_hits) for every pattern, also those without a hit or on an empty input.

    Up to MOST_TRIED patterns are one scan with one aggregate each, unpivoted
    afterwards: nothing is exploded and one row leaves each task. More are
    looked up (see ``pattern_hits``), and their hits are counted.
    """
    spark = lines.sparkSession
    if not patterns:
        return spark.createDataFrame([], "pattern_id int, n_hits bigint")
    if len(patterns) > MOST_TRIED:
        hits = pattern_hits(lines.select(column), patterns, column).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n_hits"))
        every = spark.range(len(patterns)).select(F.col("id").cast("int").alias("pattern_id"))
        return every.join(hits, "pattern_id", "left").select("pattern_id", F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"))
    sums = lines.agg(*[F.count_if(F.coalesce(F.col(column).rlike(p), F.lit(False))).alias(f"p{i}") for i, p in enumerate(patterns)])
    hits = F.array(*[F.struct(F.lit(i).alias("pattern_id"), F.col(f"p{i}").alias("n_hits")) for i in range(len(patterns))])
    return sums.select(F.inline(hits))
