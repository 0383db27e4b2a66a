"""Numbering the rows of ordered sequences of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a sequence, on the average, that one task numbers.
STRETCH = 1 << 16


def with_ranges(rows: DataFrame, sequence: Sequence[str], order_by: Sequence[str], stretch: int = STRETCH, how: str = "left") -> DataFrame:
    """Adds ``__of`` (the sequence as one value) and ``__range``: the number of cuts of the sequence up to the row.

    One row in ``stretch`` is a cut, chosen by a hash, so sequences shorter than
    that seldom have one. The cuts of a sequence are one array; a row counts
    those up to it. The cuts are broadcast, so that rows are not shuffled to
    meet them. With ``how="inner"`` only the rows of sequences with a cut are kept.
    """
    held = rows.withColumn("__of", F.struct(*sequence))
    place = F.struct(*order_by)
    cuts = held.where(F.pmod(F.xxhash64(*sequence, *order_by), F.lit(stretch)) == 0)
    cuts = cuts.groupBy("__of").agg(F.array_sort(F.collect_set(place)).alias("__cuts"))
    upto = F.size(F.filter("__cuts", lambda c: c <= place))
    return held.join(F.broadcast(cuts), "__of", how).withColumn("__range", F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(upto)).drop("__cuts")


def numbered(rows: DataFrame, sequence: Sequence[str], order_by: Sequence[str], name: str = "position", stretch: int = STRETCH) -> DataFrame:
    """Adds ``name``: the place of each row in its sequence by ``order_by``, from 0, as bigint.

    A long sequence is numbered in two passes: its ranges are counted and their
    sums added up, then each range is numbered by its own task from where it
    begins. Rows that ``order_by`` does not tell apart stand in one range, in any
    order. Nulls stand first and are a sequence like any other. All of it is one
    plan; nothing runs while it is built.
    """
    ranged = with_ranges(rows, sequence, order_by, stretch)
    # dealt by range: by sequence, as the window of a caller may have it, a long sequence would be in one task
    dealt = ranged.repartition("__of", "__range")
    own = dealt.withColumn("__own", F.row_number().over(Window.partitionBy("__of", "__range").orderBy(*order_by)) - 1)
    # a sequence without a cut begins at 0 and needs no sum
    keys = rows.select(*dict.fromkeys([*sequence, *order_by]))
    parts = with_ranges(keys, sequence, order_by, stretch, "inner").groupBy("__of", "__range").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy("__of").orderBy("__range")
    begins = parts.select("__of", "__range", (F.sum("__n").over(upto) - F.col("__n")).alias("__begin")).where("__begin > 0")
    out = own.join(begins, ["__of", "__range"], "left")
    return out.select(*rows.columns, (F.col("__own") + F.coalesce("__begin", F.lit(0))).cast("bigint").alias(name))
