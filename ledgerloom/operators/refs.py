"""References between records, scoped by module."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_refs(refs: DataFrame, ref: str = "ref", module: str = "module") -> DataFrame:
    """Adds ``ref_module`` and ``ref_name``: the parts around the first dot.

    A reference without a dot stays in its own module. Null gives null.
    """
    dot = F.instr(F.col(ref), ".")
    return refs.withColumns(
        {
            "ref_module": F.when(dot > 0, F.expr(f"substring(`{ref}`, 1, instr(`{ref}`, '.') - 1)")).when(F.col(ref).isNotNull(), F.col(module)),
            "ref_name": F.when(dot > 0, F.expr(f"substring(`{ref}`, instr(`{ref}`, '.') + 1)")).otherwise(F.col(ref)),
        }
    )


def _matches(refs: DataFrame, on: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for i, (a, _) in enumerate(on):
        out = out & (refs[a] == F.col(f"__k{i}"))
    return out


def _keyed(records: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """The records with their key as __k0, ...; those with a null in it are left out, since nothing matches them."""
    out = records.withColumns({f"__k{i}": F.col(b) for i, (_, b) in enumerate(on)})
    for i in range(len(on)):
        out = out.where(F.col(f"__k{i}").isNotNull())
    return out


def _grouped(keyed: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each key: its number of records (``__n``) and their columns, which are those of the record where that is 1.

    Columns are gathered one by one, so that numbers are aggregated by hash, without a sort.
    """
    return keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(F.col(f"`{c}`")).alias(f"__r{i}") for i, c in enumerate(columns)])


def counted_refs(refs: DataFrame, records: DataFrame, on: Sequence[tuple[str, str]], name: str = "n_records") -> DataFrame:
    """Every reference once, with the number of records that have its key and the columns of that record where it is one, else null.

    One pass tells apart what ``resolve_refs`` and ``ambiguous_refs`` give one by
    one: 0 dangles (null keys, too), 1 is resolved, more are ambiguous.
    """
    keys, columns = [f"__k{i}" for i in range(len(on))], records.columns
    found = refs.join(_grouped(_keyed(records, on), keys, columns), _matches(refs, on), "left")
    return found.select(
        *[refs[c] for c in refs.columns], F.coalesce("__n", F.lit(0)).cast("bigint").alias(name), *[F.when(F.col("__n") == 1, F.col(f"__r{i}")).alias(c) for i, c in enumerate(columns)]
    )


def resolve_refs(refs: DataFrame, records: DataFrame, on: Sequence[tuple[str, str]], repeated: str = "error") -> tuple[DataFrame, DataFrame]:
    """(resolved, dangling) references; ``on`` lists (reference column, record column).

    Resolved rows carry the columns of both sides. Null keys dangle. A key must
    be that of one record: the records are reduced to one row for each key ahead of
    the join, so a reference is never multiplied. If any key repeats, a query
    over the resolved rows fails when it runs; with ``repeated="apart"`` its
    references are left out of them and are those of ``ambiguous_refs``.
    """
    if repeated not in ("error", "apart"):
        raise ValueError("repeated is 'error' or 'apart'")
    keys = [f"__k{i}" for i in range(len(on))]
    keyed = _keyed(records, on)
    one = _grouped(keyed, keys, records.columns)
    if repeated == "apart":
        one = one.where("__n = 1")
    else:
        said = F.concat(F.lit("more than one record has the key "), F.to_json(F.struct(*keys)))
        one = one.where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
    resolved = refs.join(one, _matches(refs, on)).select(*[refs[c] for c in refs.columns], *[F.col(f"__r{i}").alias(c) for i, c in enumerate(records.columns)])
    return resolved, refs.join(keyed.select(*keys).distinct(), _matches(refs, on), "left_anti")


def ambiguous_refs(refs: DataFrame, records: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """References whose key several records have, with ``n_records``, each once."""
    keys = [f"__k{i}" for i in range(len(on))]
    return refs.join(repeated_keys(_keyed(records, on), keys), _matches(refs, on)).drop(*keys)


def repeated_keys(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one record has, with their count: an input error to report."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")
