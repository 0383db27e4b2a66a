"""The operators as named queries.

Orders stand for configs, lineitem for lines, part for definitions, supplier
for groups, events for the change log, conversations for ordered sequences and
documents for logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.flags import apply_flags
from ledgerloom.operators.listing import active_only, attach_tag_chunks, attach_tags, expand_lines, line_listing, nest_line_chunks, nest_lines, tags_text
from ledgerloom.operators.overrides import first_anchor, insert_before, match_anchor, match_anchors
from ledgerloom.operators.refs import counted_refs, resolve_refs, split_refs
from ledgerloom.operators.triage import drop_ignored, ignored_counts
from ledgerloom.sources.records import payload_nodes, read_records
from ledgerloom.sources.scratch import scratch_path, stored
from ledgerloom.sources.tables import table

DROP_PATTERNS = ("(?i)license", "[0-9]{3}-[0-9]{4}", "[a-z0-9.]+@[a-z0-9.]+")

#: A pattern for each number of four digits below 5,000 that stands alone.
NUMBERS = tuple(rf"(?:^|\D){i:04}(?:\D|$)" for i in range(5000))


def _tagged_parts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    link = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return attach_tags(part, link, supplier, "p_partkey", ("l_partkey", "l_suppkey"), "s_suppkey", "s_name")


def q_line_listing(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", (F.col("l_linestatus") == "O").alias("active"))
    parts = _tagged_parts(spark, d).select(
        F.col("p_partkey").alias("definition"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), tags_text().alias("group_tags")
    )
    full = expand_lines(orders, lines, ("o_orderkey", "l_orderkey"))
    full = full.join(parts, full["l_partkey"] == parts["definition"])
    return line_listing(full, ("definition", "kind", "name", "group_tags", "active"), keys=("o_orderkey", "l_linenumber", "l_suppkey"))


def q_attach_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tagged_parts(spark, d).select("p_partkey", tags_text().alias("group_tags"))


def q_expand_lines(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return expand_lines(orders, lines, ("o_orderkey", "l_orderkey"), keep_empty=True).drop("l_orderkey")


def q_nest_lines(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    nested = nest_lines(orders, lines, ("o_orderkey", "l_orderkey"), ("l_linenumber", "l_partkey", "l_suppkey"))
    return nested.select(
        "o_orderkey",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"),
    )


def q_nest_line_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines in arrays of three."""
    orders = table(spark, d, "orders").select("o_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    nested = nest_line_chunks(orders, lines, ("o_orderkey", "l_orderkey"), ("l_linenumber", "l_partkey", "l_suppkey"), size=3)
    parts = F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ",")
    return nested.select("o_orderkey", "chunk", F.size("lines").cast("bigint").alias("n_lines"), parts.alias("parts"))


def q_attach_tag_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with the names of their parts in arrays of ten."""
    suppliers = table(spark, d, "supplier").select("s_suppkey")
    link = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    tags = attach_tag_chunks(suppliers, link, parts, "s_suppkey", ("l_suppkey", "l_partkey"), "p_partkey", "p_name", size=10)
    return tags.select("s_suppkey", "chunk", tags_text().alias("names"))


def q_apply_flags(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("active"))
    log = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") > 0).alias("new_value"))
    return apply_flags(customers, log, ("c_custkey", "user_id"), ("ts", "event_id"))


def q_active_only(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linestatus") == "O").alias("active")
    )
    return active_only(lines)


def q_resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ref_id"), "lang")
    resolved, _ = resolve_refs(docs, table(spark, d, "labels"), [("ref_id", "doc_id")])
    return resolved.select("doc_id", "lang", "quality", "toxic")


def q_resolve_refs_dangling(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    _, dangling = resolve_refs(docs, table(spark, d, "labels").select("doc_id"), [("doc_id", "doc_id")])
    return dangling


def q_resolve_refs_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Orders as references to their lines: those of one line resolve, those of several are reported, none is multiplied."""
    refs = table(spark, d, "orders").select("o_orderkey")
    records = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    counted = counted_refs(refs, records, [("o_orderkey", "l_orderkey")])
    state = F.when(F.col("n_records") == 0, "dangling").when(F.col("n_records") == 1, "resolved").otherwise("ambiguous")
    return counted.select("o_orderkey", state.alias("state"), "n_records", "l_partkey")


def _order_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a small tree: the order node, then its lines as children tagged by return flag."""
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(0).cast("bigint").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"),
        F.lit("order").alias("tag"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("attrs"),
    )
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_linenumber") * F.lit(10**12).cast("bigint") + F.col("l_partkey") * 10**4 + F.col("l_suppkey")).alias("node_id"),
        F.lit(0).cast("bigint").alias("parent_id"), F.col("l_returnflag").alias("tag"), F.create_map(F.lit("s"), F.col("l_linestatus")).alias("attrs"),
    )
    return orders.unionByName(lines)


def q_match_anchor(spark: SparkSession, d: str) -> DataFrame:
    return match_anchor(_order_nodes(spark, d), "R", "order", {"status": "P"}).select("doc_id", "node_id", "tag")


def q_match_anchor_unmatched(spark: SparkSession, d: str) -> DataFrame:
    _, unmatched = match_anchors(_order_nodes(spark, d), "R", "order", {"status": "P"})
    return unmatched


def q_insert_before(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    anchors = first_anchor(base.where(F.col("role") == "assistant"), ["conv_id"], ["turn"])
    overrides = spark.createDataFrame([(0, "override", "policy"), (1, "override", "notice")], "seq int, role string, text string")
    return insert_before(base, anchors, overrides, ["conv_id"], ["turn"]).select("conv_id", "position", "role", "text")


def q_insert_before_parent(spark: SparkSession, d: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, d, "lineitem").select("l_orderkey", *order, "l_returnflag")
    parents = table(spark, d, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("__o"))
    hits = lines.where(F.col("l_returnflag") == "R").join(parents, F.col("l_orderkey") == F.col("__o"), "left_semi")
    base = lines.drop("l_returnflag").withColumn("item", F.col("l_partkey").cast("string"))
    overrides = spark.createDataFrame([(0, "a"), (1, "b")], "seq int, item string")
    return insert_before(base, first_anchor(hits, ["l_orderkey"], order), overrides, ["l_orderkey"], order).select("l_orderkey", "position", "item")


def _doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))


def q_drop_ignored(spark: SparkSession, d: str) -> DataFrame:
    return drop_ignored(_doc_lines(spark, d), DROP_PATTERNS).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"))


def q_ignored_counts(spark: SparkSession, d: str) -> DataFrame:
    return ignored_counts(_doc_lines(spark, d).select("line"), DROP_PATTERNS)


def q_drop_ignored_many(spark: SparkSession, d: str) -> DataFrame:
    return drop_ignored(_doc_lines(spark, d), NUMBERS).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"))


def q_ignored_counts_many(spark: SparkSession, d: str) -> DataFrame:
    return ignored_counts(_doc_lines(spark, d).select("line"), NUMBERS)


def q_read_records(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as record files, then read back as rows."""

    def member(name: str, value: Column | None = None, ref: Column | None = None) -> Column:
        nothing = F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("_name"), (nothing if ref is None else ref).alias("_ref"), (nothing if value is None else value).alias("_VALUE"))

    rows = table(spark, d, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("_id"), F.lit("customer").alias("_model"),
        F.array(
            member("name", F.col("c_name")), member("segment", F.col("c_mktsegment")), member("nation", ref=F.concat(F.lit("geo.n"), "c_nationkey")),
        ).alias("field"),
    )
    path = scratch_path(spark, "records")
    rows.write.format("xml").option("rootTag", "data").option("rowTag", "record").save(path)
    return read_records(spark, path)


def q_resolve_refs_scoped(spark: SparkSession, d: str) -> DataFrame:
    """References read from record files, resolved by module and name; another module has records of the same names."""
    refs = q_read_records(spark, d).where("ref is not null").select("id", F.lit("crm").alias("module"), "ref")
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.col("n_name").alias("label"))
    records = nation.withColumn("rec_module", F.lit("geo")).unionByName(nation.withColumn("rec_module", F.lit("crm")))
    resolved, _ = resolve_refs(split_refs(refs), records, [("ref_module", "rec_module"), ("ref_name", "name")])
    return resolved.select("id", "ref", "label")


def q_record_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as record files with their lines nested, read as nodes, and override nodes put before the first ``R``."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    children = F.transform("lines", lambda x: F.format_string('<%s item="%s"/>', x["l_returnflag"], x["l_partkey"].cast("string")))
    xml = F.format_string(
        '<record id="o%s" model="order"><field name="arch" type="xml"><field status="%s">%s</field></field></record>',
        F.col("o_orderkey").cast("string"), "o_orderstatus", F.array_join(children, ""),
    )
    path = scratch_path(spark, "records")
    lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(xml).write.text(path)
    nodes = stored(payload_nodes(spark, path).where("field = 'arch'"), "nodes")  # used three times
    anchors = stored(match_anchor(nodes, "R", "field", {"status": "P"}), "anchors")
    overrides = spark.createDataFrame([(0, "added", {"item": "a"}), (1, "added", {"item": "b"})], "seq int, tag string, attrs map<string,string>")
    merged = insert_before(nodes.where("parent_id is not null"), anchors, overrides, ["doc_id", "parent_id"], ["pos"])
    return merged.select("doc_id", "position", "tag", F.col("attrs")["item"].alias("item"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "line_listing": q_line_listing,
    "read_records": q_read_records,
    "attach_tags": q_attach_tags,
    "expand_lines": q_expand_lines,
    "nest_lines": q_nest_lines,
    "nest_line_chunks": q_nest_line_chunks,
    "attach_tag_chunks": q_attach_tag_chunks,
    "apply_flags": q_apply_flags,
    "active_only": q_active_only,
    "resolve_refs": q_resolve_refs,
    "resolve_refs_dangling": q_resolve_refs_dangling,
    "resolve_refs_scoped": q_resolve_refs_scoped,
    "resolve_refs_repeated": q_resolve_refs_repeated,
    "match_anchor": q_match_anchor,
    "match_anchor_unmatched": q_match_anchor_unmatched,
    "insert_before": q_insert_before,
    "insert_before_parent": q_insert_before_parent,
    "record_overrides": q_record_overrides,
    "drop_ignored": q_drop_ignored,
    "ignored_counts": q_ignored_counts,
    "drop_ignored_many": q_drop_ignored_many,
    "ignored_counts_many": q_ignored_counts_many,
}

_TAGS = """select l_partkey tk, string_agg(distinct s_name, ',' order by s_name) g
 from lineitem join supplier on s_suppkey = l_suppkey group by 1"""
_ALTERNATION = "|".join(f"(?:{p})" for p in DROP_PATTERNS)
_ALONE = "list_filter(regexp_extract_all(line, '[0-9]+'), lambda x: len(x) = 4 and x < '5000')"
_LINES = "select doc_id, unnest(string_split(text, chr(10))) line from documents"

ORACLES: dict[str, str] = {
    "read_records": """select 'c' || c_custkey as id, 'customer' as model, 'name' as field, null::varchar as ref, c_name as value from customer
 union all select 'c' || c_custkey, 'customer', 'segment', null, c_mktsegment from customer
 union all select 'c' || c_custkey, 'customer', 'nation', 'geo.n' || c_nationkey, null from customer""",
    "line_listing": f"""with t as ({_TAGS}) select o_orderkey, l_linenumber, l_suppkey, p_partkey as definition, p_type as kind,
 p_name as name, coalesce(g, '') as group_tags, l_linestatus = 'O' as active
 from orders join lineitem on o_orderkey = l_orderkey join part on p_partkey = l_partkey left join t on tk = p_partkey""",
    "attach_tags": f"with t as ({_TAGS}) select p_partkey, coalesce(g, '') as group_tags from part left join t on tk = p_partkey",
    "expand_lines": """select o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_suppkey
 from orders left join lineitem on l_orderkey = o_orderkey""",
    "nest_lines": """select o_orderkey, count(l_orderkey) as n_lines,
 coalesce(string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey, l_suppkey), '') as parts
 from orders left join lineitem on l_orderkey = o_orderkey group by 1""",
    "nest_line_chunks": """with l as (select o_orderkey, l_linenumber a, l_partkey b, l_suppkey c,
  (row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1) // 3 as chunk from orders left join lineitem on l_orderkey = o_orderkey)
 select o_orderkey, chunk, count(b) as n_lines, coalesce(string_agg(cast(b as varchar), ',' order by a, b, c), '') as parts from l group by 1, 2""",
    "attach_tag_chunks": """with t as (select distinct l_suppkey, p_name from lineitem join part on p_partkey = l_partkey),
 n as (select s_suppkey, p_name, (row_number() over (partition by s_suppkey order by p_name) - 1) // 10 as chunk from supplier left join t on l_suppkey = s_suppkey)
 select s_suppkey, chunk, coalesce(string_agg(p_name, ',' order by p_name), '') as names from n group by 1, 2""",
    "apply_flags": """select c_custkey, coalesce(na, c_acctbal > 0) as active from customer left join
 (select user_id, value > 0 na from events where value is not null
  qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) on user_id = c_custkey""",
    "active_only": """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus = 'O' as active
 from lineitem where l_linestatus = 'O'""",
    "resolve_refs": "select d.doc_id, lang, quality, toxic from documents d join labels l on d.doc_id = l.doc_id",
    "resolve_refs_dangling": """select doc_id, lang from documents d
 where not exists (select 1 from labels l where l.doc_id = d.doc_id)""",
    "resolve_refs_scoped": """select 'c' || c_custkey as id, 'geo.n' || c_nationkey as ref, n_name as label
 from customer join nation on n_nationkey = c_nationkey""",
    "match_anchor": """select l_orderkey as doc_id, min(cast(l_linenumber as bigint) * 1000000000000 + l_partkey * 10000 + l_suppkey) as node_id,
 'R' as tag from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'P' and l_returnflag = 'R' group by 1""",
    "resolve_refs_repeated": """select o_orderkey, case count(l_orderkey) when 0 then 'dangling' when 1 then 'resolved' else 'ambiguous' end as state,
 count(l_orderkey) as n_records, case when count(l_orderkey) = 1 then max(l_partkey) end as l_partkey
 from orders left join lineitem on l_orderkey = o_orderkey group by 1""",
    "match_anchor_unmatched": """select o_orderkey as doc_id from orders where o_orderstatus <> 'P'
 or not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')""",
    "insert_before": """with anc as (select conv_id, min(turn) a from conversations where role = 'assistant' group by 1),
 ov(seq, text) as (values (0, 'policy'), (1, 'notice')),
 u as (select conv_id, turn k, 1 side, 0 seq, role, text from conversations
  union all select conv_id, a, 0, seq, 'override', text from anc cross join ov)
 select conv_id, row_number() over (partition by conv_id order by k, side, seq) - 1 as position, role, text from u""",
    "insert_before_parent": """with ak as (select l_orderkey, l_linenumber a, l_partkey b, l_suppkey c from lineitem
  where l_returnflag = 'R' and l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P')
  qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) = 1),
 ov(seq, item) as (values (0, 'a'), (1, 'b')),
 u as (select l_orderkey, l_linenumber a, l_partkey b, l_suppkey c, 1 side, 0 seq, cast(l_partkey as varchar) item from lineitem
  union all select l_orderkey, a, b, c, 0, seq, item from ak cross join ov)
 select l_orderkey, row_number() over (partition by l_orderkey order by a, b, c, side, seq) - 1 as position, item from u""",
    "record_overrides": """with l as (select l_orderkey, l_returnflag, l_partkey, o_orderstatus,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) n
  from lineitem join orders on o_orderkey = l_orderkey),
 ak as (select l_orderkey, min(n) a from l where l_returnflag = 'R' and o_orderstatus = 'P' group by 1),
 u as (select l_orderkey, n, 1 side, 0 seq, l_returnflag tag, cast(l_partkey as varchar) item from l
  union all select l_orderkey, a, 0, seq, 'added', item from ak cross join (values (0, 'a'), (1, 'b')) ov(seq, item))
 select 'o' || l_orderkey as doc_id, row_number() over (partition by l_orderkey order by n, side, seq) - 1 as position, tag, item from u""",
    "drop_ignored": f"""with l as ({_LINES})
 select doc_id, count(*) as n_kept from l where not regexp_matches(line, '{_ALTERNATION}') group by 1""",
    "ignored_counts": f"""with l as ({_LINES}), p(pattern_id, re) as (values {', '.join(f"({i}, '{p}')" for i, p in enumerate(DROP_PATTERNS))})
 select pattern_id, count(*) filter (where regexp_matches(line, re)) as n_hits from l cross join p group by 1""",
    "drop_ignored_many": f"""with l as ({_LINES})
 select doc_id, count(*) as n_kept from l where len({_ALONE}) = 0 group by 1""",
    "ignored_counts_many": f"""with l as ({_LINES}), h as (select unnest(list_distinct({_ALONE})) as x from l)
 select cast(i as int) as pattern_id, count(x) as n_hits from range(5000) r(i) left join h on cast(x as int) = i group by 1""",
}
