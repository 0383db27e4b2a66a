"""Record files: XML elements ``<record id model>`` holding ``<field>`` children."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELD = T.StructType(
    [
        T.StructField("_name", T.StringType()),
        T.StructField("_ref", T.StringType()),
        T.StructField("_VALUE", T.StringType()),
    ]
)
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("_model", T.StringType()),
        T.StructField("field", T.ArrayType(_FIELD)),
    ]
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row (id, model, field, ref, value) for each field of each record.

    A field that refers to another record has a null value; one that holds
    nested elements has a null value too (see ``payload_nodes``). A record
    without fields keeps one row whose field, ref and value are null.
    """
    rows = spark.read.format("xml").option("rowTag", "record").schema(RECORD_SCHEMA).load(path)
    return rows.select(
        F.col("_id").alias("id"), F.col("_model").alias("model"), F.explode_outer("field").alias("f")
    ).select("id", "model", F.col("f._name").alias("field"), F.col("f._ref").alias("ref"), F.col("f._VALUE").alias("value"))


def payload_attributes(spark: SparkSession, path: str, xpath: str) -> DataFrame:
    """One row (file, position, value) for each node that ``xpath`` picks in each file.

    The tabular XML reader drops nested elements, so each file is read as one
    row; meant for record files, which are small.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.xpath("value", F.lit(xpath))).alias("position", "value"))


# Possessive groups: the scan never turns back, so a tag with any number of attributes takes no stack.
_ATTRIBUTES = r"""(?:\s++[\w.:-]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'))*+"""
_TAG = r"""<(/?+)([\w.:-]++)(""" + _ATTRIBUTES + r""")\s*+(/?+)>"""
_NAME = r"^<([\w.:-]++)"
_ATTRIBUTE = r"""[\w.:-]++\s*+=\s*+(?:"[^"]*+"|'[^']*+')"""
_RECORD = r"(?s)<record" + _ATTRIBUTES + r"\s*+>.*"
_EMPTY_RECORD = "<record" + _ATTRIBUTES + r"\s*+/>"
_NO_TAGS = r"(?s)<(?:!--.*?-->|!\[CDATA\[.*?\]\]>|\?.*?\?>)"
#: The entities that XML itself defines.
_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
#: Tags that one step of the walk over a record copies its nodes for.
CHUNK = 512


def _plain(value: Column) -> Column:
    """The value with its entities and character references replaced, each once; unknown ones stay."""

    def decoded(part: Column) -> Column:
        end = F.instr(part, ";")
        name, rest = F.substring(part, F.lit(1), end - 1), F.substring(part, end + 1, F.length(part))
        digits = F.when(name.rlike("^#[0-9]{1,8}$"), F.substring(name, 2, 8)).when(name.rlike("^#x[0-9A-Fa-f]{1,6}$"), F.conv(F.substring(name, 3, 6), 16, 10)).cast("bigint")
        known = digits.between(1, 0x10FFFF) & ~digits.between(0xD800, 0xDFFF)
        sign = F.when(known, F.decode(F.unhex(F.lpad(F.hex(F.when(known, digits)), 8, "0")), "UTF-32"))
        for entity, plain in _ENTITIES.items():
            sign = F.when(name == entity, F.lit(plain)).otherwise(sign)
        return F.coalesce(F.concat(sign, rest), F.concat(F.lit("&"), part))

    parts = F.split(value, "&", -1)
    return F.when(F.instr(value, "&") == 0, value).otherwise(F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(decoded(x))), ""))


def _attributes(tag: Column) -> Column:
    """The attributes of a start tag as a map; as XML has it, none repeats."""
    blank = F.lit(" \t\r\n")

    def unquoted(value: Column) -> Column:
        return F.substring(value, F.lit(2), F.length(value) - 2)

    def entry(one: Column) -> Column:
        value = _bound(F.btrim(F.substring(one, F.instr(one, "=") + 1, F.length(one)), blank), unquoted)
        value = F.when(F.instr(one, "&") == 0, value).otherwise(_bound(value, _plain))
        return F.struct(F.btrim(F.substring_index(one, "=", 1), blank).alias("key"), value.alias("value"))

    return F.map_from_entries(F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), entry))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _walked(tags: Column) -> Column:
    """(at, parent, pos, field, text) of each node among the tags of one record, in their order.

    One walk with a stack of the elements that are open: the record, its field,
    then nodes, each with its place and the number of its children so far. The
    innermost stands apart from the others, so that the stack is only copied
    where an element with children begins or ends. What the walk has found is
    put together from chunks, so that it is not copied for every tag.
    """
    one_type = "struct<at:int,kids:int>"
    open_type, node_type = f"struct<depth:int,top:{one_type},below:array<{one_type}>>", "array<struct<at:int,parent:int,pos:int,field:string,text:string>>"
    none, empty = F.lit(None).cast(one_type), F.array().cast(f"array<{one_type}>")

    def opened(depth: Column, top: Column, below: Column) -> Column:
        return F.struct(depth.alias("depth"), top.alias("top"), below.alias("below"))

    def step(state: Column, tag: Column) -> Column:
        at, depth, top, below = state["at"], state["open"]["depth"], state["open"]["top"], state["open"]["below"]
        # depth is of what the tag stands in: 0 for the record, 1 for a field, 2 for a node right in a field
        counted = F.struct(top["at"].alias("at"), (top["kids"] + 1).alias("kids"))
        node = F.struct(at.alias("at"), F.when(depth > 2, top["at"]).alias("parent"), top["kids"].alias("pos"), state["field"].alias("field"), tag.alias("text"))
        ends = tag.startswith("</")
        now = F.when(ends & (depth > 1), opened(depth - 1, F.element_at(below, -1), F.slice(below, F.lit(1), depth - 2)))
        now = now.when(ends, opened(F.lit(0), none, empty))
        now = now.when(tag.endswith("/>"), F.when(depth > 0, opened(depth, counted, below)).otherwise(state["open"]))
        now = now.otherwise(opened(depth + 1, F.struct(at.alias("at"), F.lit(0).alias("kids")), F.when(depth > 0, F.concat(below, F.array(counted))).otherwise(below)))
        return F.struct(
            (at + 1).alias("at"), now.alias("open"),
            F.when((depth == 1) & ~ends, _attributes(tag)["name"]).otherwise(state["field"]).alias("field"),
            F.when((depth > 1) & ~ends, F.concat(state["nodes"], F.array(node))).otherwise(state["nodes"]).alias("nodes"),
        )

    def chunk(state: Column, first: Column) -> Column:
        start = F.struct(state["at"].alias("at"), state["open"].alias("open"), state["field"].alias("field"), F.array().cast(node_type).alias("nodes"))
        walked = F.aggregate(F.slice(tags, first, CHUNK), start, step)
        return _bound(walked, lambda x: F.struct(x["at"].alias("at"), x["open"].alias("open"), x["field"].alias("field"), F.concat(state["nodes"], x["nodes"]).alias("nodes")))

    nothing = F.struct(F.lit(0).alias("at"), opened(F.lit(0), none, empty).cast(open_type).alias("open"), F.lit(None).cast("string").alias("field"), F.array().cast(node_type).alias("nodes"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(tags), F.lit(1)), F.lit(CHUNK)), nothing, chunk, lambda x: x["nodes"])


def payload_nodes(spark: SparkSession, path: str) -> DataFrame:
    """One row (record, doc_id, field, node_id, parent_id, pos, tag, attrs) for each element nested in a field of a record.

    record numbers the records, doc_id is the record's id, null if it has none,
    field the name of its field. node_id counts in document order, parent_id is
    null for elements directly in the field, pos counts siblings from 0. Text
    between elements is left out; a record without nested elements gives no
    row. Each record is a tree of its own, with its own id, that of another, or none.

    Files are cut at ``</record>``, so large ones are read by many tasks; that
    end tag must not stand within a comment. The tree of a record is built
    where it is read, nothing is shuffled; a record of many nodes takes memory
    in proportion. Records do not nest.
    """
    text = spark.read.option("lineSep", "</record>").text(path).select(F.regexp_replace(F.regexp_replace("value", _NO_TAGS, ""), _EMPTY_RECORD, "").alias("value"))
    record = text.select(F.regexp_extract("value", _RECORD, 0).alias("value"))  # empty for what is none, which has no tags
    tags = record.select(F.monotonically_increasing_id().alias("record"), F.regexp_extract_all("value", F.lit(_TAG), F.lit(0)).alias("tags"))
    # once for a record: beside the generator it would be worked out for each of its nodes
    known = tags.withColumn("doc_id", _attributes(F.get("tags", F.lit(0)))["id"])
    nodes = known.select("record", "doc_id", F.inline(_walked(F.col("tags"))))
    return nodes.select(
        "record", "doc_id", "field", F.col("at").cast("bigint").alias("node_id"), F.col("parent").cast("bigint").alias("parent_id"),
        "pos", F.regexp_extract("text", _NAME, 1).alias("tag"), _attributes(F.col("text")).alias("attrs"),
    )
