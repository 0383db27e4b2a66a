"""Flag changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_flags(
    lines: DataFrame, changes: DataFrame, on: tuple[str, str], order_by: Sequence[str], value: str = "new_value", flag: str = "active"
) -> DataFrame:
    """Sets ``flag`` to its last change; ``on`` is (line key, key in the log).

    ``order_by`` must order the changes of a key totally. Lines without a change
    keep their flag, changes of unknown lines and null values are ignored. The
    log is reduced to one row per key before the shuffle and the join.
    """
    line_key, change_key = on
    last = (
        changes.where(F.col(value).isNotNull())
        .groupBy(F.col(change_key).alias("__key"))
        .agg(F.max_by(F.col(value), F.struct(*order_by)).alias("__new"))
    )
    return (
        lines.join(last, lines[line_key] == last["__key"], "left")
        .withColumn(flag, F.coalesce(F.col("__new"), F.col(flag)))
        .drop("__key", "__new")
    )
