"""Anchors in ordered sequences and rows inserted ahead of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.numbering import STRETCH, numbered

#: Most override rows of one release; each anchor gets a copy of all of them.
MOST_OVERRIDES = 10_000


def match_anchor(
    nodes: DataFrame, tag: str, parent_tag: str, parent_attrs: Mapping[str, str] | None = None, first_only: bool = True, doc: str = "doc_id"
) -> DataFrame:
    """Nodes with ``tag`` that are direct children of a node with the parent's tag and attributes.

    ``nodes`` has (doc, node_id, parent_id, pos, tag, attrs); node_id counts in
    document order. ``first_only`` keeps the first match of each document.
    Documents without a match give no row; ``match_anchors`` returns them too.
    """
    fits = F.col("tag") == parent_tag
    for key, value in (parent_attrs or {}).items():
        fits = fits & (F.col("attrs")[key] == value)
    parents = nodes.where(fits).select(F.col(doc).alias("__doc"), F.col("node_id").alias("__parent"))
    children = nodes.where(F.col("tag") == tag)
    found = children.join(parents, (children[doc] == parents["__doc"]) & (children["parent_id"] == parents["__parent"]), "left_semi")
    if not first_only:
        return found
    rest = [c for c in found.columns if c not in (doc, "node_id")]
    first = found.groupBy(doc).agg(F.min(F.struct("node_id", *[F.col(c) for c in rest if c != "attrs"])).alias("m"), F.min_by("attrs", "node_id").alias("attrs"))
    return first.select(*[F.col(c) if c in (doc, "attrs") else F.col(f"m.{c}").alias(c) for c in found.columns])


def match_anchors(
    nodes: DataFrame, tag: str, parent_tag: str, parent_attrs: Mapping[str, str] | None = None, doc: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """(anchors, unmatched): the first match of each document as by ``match_anchor``, and the documents that have none.

    Every document that has a node is in one of the two, once. A null document
    matches nothing and is reported. Documents are told apart before the anti
    join, so that it sees one row for each.
    """
    anchors = match_anchor(nodes, tag, parent_tag, parent_attrs, doc=doc)
    return anchors, nodes.select(doc).distinct().join(anchors.select(doc), doc, "left_anti")


def first_anchor(rows: DataFrame, doc: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row of each sequence, as (doc..., order_by...); partial sums keep the shuffle small."""
    return rows.groupBy(*doc).agg(F.min(F.struct(*order_by)).alias("a")).select(*doc, "a.*")


def insert_before(
    base: DataFrame, anchors: DataFrame, overrides: DataFrame, doc: Sequence[str], order_by: Sequence[str], seq: str = "seq", stretch: int = STRETCH
) -> DataFrame:
    """Base rows with the override rows put ahead of each sequence's anchor, and a new ``position``.

    ``anchors`` has (doc..., order_by...), one row per sequence at most, matched
    on base rows only. ``overrides`` (seq plus payload columns) is the short list
    of one release, of which each anchor gets a copy; it travels as one array, and
    a query over more than ``MOST_OVERRIDES`` rows fails when it runs. It stands
    ahead of the anchor in the order of ``seq``. Columns that one side lacks are
    null there. Positions count from 0 as bigint; a long sequence is numbered
    by many tasks (see ``numbered``).
    """
    listed = overrides.withColumnRenamed(seq, "__seq")
    listed = listed.limit(MOST_OVERRIDES + 1).agg(F.collect_list(F.struct(*listed.columns)).alias("__rows"))
    checked = F.when(F.size("__rows") <= MOST_OVERRIDES, F.col("__rows")).otherwise(F.raise_error(F.lit(f"more than {MOST_OVERRIDES} override rows")))
    added = anchors.select(*doc, *order_by).crossJoin(F.broadcast(listed))  # one row
    added = added.select(*doc, *order_by, F.inline(checked)).withColumn("__side", F.lit(0))
    marked = base.withColumns({"__side": F.lit(1), "__seq": F.lit(0)})
    return numbered(marked.unionByName(added, allowMissingColumns=True), doc, [*order_by, "__side", "__seq"], stretch=stretch).drop("__side", "__seq")
