"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.shared import small_or_stored, stored

#: A word is what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Least rows of a range, which one task puts in order.
RANGE = 1 << 17


def ahead(rows: DataFrame, order: Sequence[Column], sums: Mapping[str, str], name: str) -> DataFrame:
    """Adds for each (new column, value) of ``sums`` the sum of the value over all rows ahead in ``order``.

    Rows are dealt into ranges of ``order``, sums of ranges are added up, and
    each range is summed within by its own task; no group of equal leading
    columns meets in one task. Rows that ``order`` does not tell apart stand in
    any order.
    """
    kept = stored(rows, name)  # the bounds of the ranges are sampled from it
    n = kept.count()
    parts = -(-n // max(RANGE, math.isqrt(n)))
    if parts > 1:
        kept = stored(kept.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), f"{name}-ranges")
    else:
        kept = kept.withColumn("range", F.lit(0))
    total = kept.groupBy("range").agg(*[F.sum(v).alias(f"{c}_of") for c, v in sums.items()])
    before = total.select("range", *[(F.sum(f"{c}_of").over(Window.orderBy("range")) - F.col(f"{c}_of")).alias(f"{c}_of") for c in sums])
    upto = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = kept.withColumns({c: F.sum(v).over(upto) - F.col(v) for c, v in sums.items()})
    return own.join(before, "range").select(*rows.columns, *[(F.col(c) + F.col(f"{c}_of")).alias(c) for c in sums])


def shuffled(id_col: str, text_col: str, seed: int) -> Column:
    """Place in a shuffle that depends on the row's id and text alone: 60 bits of MD5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, text_col)]
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), parts[0], F.lit(":"), parts[1])), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """(source, source_size, number, base, target) of (source, source_size).

    Sources are numbered by code point, null last, and take the weights in turn.
    base is the size of all sources ahead. Targets add up to ``share`` of all
    sizes, or to ``most`` times all sizes if that is less: they rise together,
    each by its weight, and stop at ``most`` times their source's size.
    """
    one = sizes.withColumn("one", F.lit(1).cast("bigint"))
    numbered = ahead(one, [F.col("source").asc_nulls_last()], {"number": "one", "base": "source_size"}, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    capped = numbered.select("source", "source_size", "number", "base", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    capped = capped.withColumn("level", F.col("cap") / F.col("weight"))
    filled = stored(ahead(capped, [F.col("level"), F.col("number")], {"caps": "cap", "ahead": "weight"}, "levels"), "filled")
    whole = filled.agg(F.sum("weight").alias("weights"), (F.lit(float(share)) * F.sum("source_size")).alias("budget"))
    # a source is full if, with the water at its level, no more than the budget is used
    used = F.col("caps") + F.col("cap") + F.col("level") * (F.col("weights") - F.col("ahead") - F.col("weight"))
    full = filled.crossJoin(F.broadcast(whole)).withColumn("full", used <= F.col("budget"))  # one row
    level = full.agg(((F.first("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("weight")))).alias("water"))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return full.crossJoin(F.broadcast(level)).select("source", "source_size", "number", "base", target.alias("target"))


def placed(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(row, id, size, source, source_size, number, target, start): each row's place in its source's shuffled queue, stored."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), shuffled(id_col, text_col, seed).alias("key"), F.lit(1).cast("bigint").alias("one"))
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("id").asc_nulls_last(), F.col("size")]
    queued = ahead(rows, order, {"row": "one", "before": "size"}, "queue")
    queued = stored(queued.select("row", "id", "source", "size", "before"), "queued")
    sizes = queued.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = small_or_stored(source_targets(sizes, weights, share, most), "targets").withColumnRenamed("source", "of")
    met = queued.join(found, F.col("source").eqNullSafe(F.col("of")))
    return stored(met.select("row", "id", "size", "source", "source_size", "number", "target", (F.col("before") - F.col("base")).alias("start")), "placed")


def mixed(rows: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix of ``placed`` rows: (row, id, source, epoch, words, finish, at), one row for each time a document is taken.

    finish is the virtual time at which a document is through: the tokens of its
    source up to its end, over the source's target. The mix is in the order of
    finish; ``at`` counts the words ahead and is cut at the budget. At virtual
    time 1 every source has its target; the document then in service is cut
    there (its first words are taken). A source shorter than its target begins
    anew, in the same order.
    """
    quota = F.ceil("target").cast("bigint")
    begin = F.col("start") + F.col("epoch") * F.col("source_size")
    times = rows.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("begin", begin)
    taken = times.withColumn("words", F.least(F.col("size"), quota - F.col("begin"))).where("words > 0")
    taken = taken.select("row", "id", "source", "number", "epoch", "begin", "words", ((F.col("begin") + F.col("words")) / F.col("target")).alias("finish"))
    out = ahead(taken, [F.col("finish"), F.col("number"), F.col("epoch"), F.col("begin")], {"at": "words"}, "mix")
    budget = rows.agg(F.floor(F.lit(float(share)) * F.sum("size")).cast("bigint").alias("budget"))
    out = out.crossJoin(F.broadcast(budget)).where(F.col("at") < F.col("budget"))  # one row
    return out.select("row", "id", "source", "epoch", F.least(F.col("words"), F.col("budget") - F.col("at")).alias("words"), "finish", "at")


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (its words in the mix, repeats counted).

    Size counts words between ASCII white space. See ``source_targets`` for the
    targets and ``mixed`` for the mix, which this sums up; no document is taken
    more than ``most`` times, a whole number. Each source's words in the mix
    come within one of its target, but for the end of the mix, where as many
    words as there are sources may be missing.

    Null and empty texts have size 0 and are never taken. A null source is a
    source of its own, the last. The shuffle depends on id, text and ``seed``
    alone, so reruns agree whatever the partitions; rows equal in both are alike,
    and each has its own turn. Very long texts are read whole, in memory once.
    Other columns are ignored. An empty table gives no rows; one without words
    has targets of 0.
    """
    rows = placed(docs, weights, share, most, seed, id_col, text_col, source_col)
    taken = mixed(rows, share, most).groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def oracle(weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0) -> str:
    """The same over ``documents`` as DuckDB SQL."""
    return f"""with d as (select doc_id, source, coalesce(cast(len(regexp_extract_all(text, '{WORD}')) as bigint), 0) as size,
  cast('0x' || substr(md5('{seed}:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as bigint) as key from documents),
 q as (select *, row_number() over w as "row", sum(size) over (w rows unbounded preceding) - size as start from d
  window w as (partition by source order by key, doc_id nulls last, size)),
 s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as number from d group by source),
 c as (select *, cast([{", ".join(map(str, weights))}][number % {len(weights)} + 1] as double) as weight, {most}.0::double * source_size as cap from s),
 l as (select *, cap / weight as level, sum(cap) over (o rows unbounded preceding) as caps,
  sum(weight) over (o rows unbounded preceding) as ahead from c window o as (order by cap / weight, number)),
 t as (select sum(weight) as weights, {share}::double * sum(source_size) as budget from c),
 f as (select l.*, budget, caps + level * (weights - ahead) <= budget as "full" from l, t),
 v as (select (any_value(budget) - coalesce(sum(cap) filter ("full"), 0)) / sum(weight) filter (not "full") as water from f),
 g as (select source, number, source_size, case when "full" then cap else least(cap, water * weight) end as target, budget from f, v),
 p as (select q.*, g.number, g.source_size, g.target, g.budget from q join g on q.source is not distinct from g.source),
 e as (select *, start + epoch * source_size as begin,
  least(size, cast(ceil(target) as bigint) - start - epoch * source_size) as words
  from (select *, unnest(range({most})) as epoch from p where size > 0)),
 m as (select *, sum(words) over (order by (begin + words) / target, number, epoch, begin rows unbounded preceding) - words as "at" from e where words > 0),
 k as (select number, "row", sum(least(words, cast(floor(budget) as bigint) - "at")) as taken from m where "at" < floor(budget) group by all)
 select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) as taken from p left join k using (number, "row")"""
