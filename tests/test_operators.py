import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.patterns import required_literals
from ledgerloom.operators import triage
from ledgerloom.operators.flags import apply_flags
from ledgerloom.operators.listing import LISTING, active_only, attach_tag_chunks, attach_tags, expand_lines, line_listing, nest_line_chunks, nest_lines
from ledgerloom.operators.numbering import numbered, with_ranges
from ledgerloom.operators.overrides import MOST_OVERRIDES, insert_before, match_anchor, match_anchors
from ledgerloom.operators.refs import ambiguous_refs, counted_refs, repeated_keys, resolve_refs, split_refs
from ledgerloom.operators.triage import drop_ignored, ignored_counts
from ledgerloom.plans.queries import _order_nodes
from ledgerloom.sources.records import payload_attributes, payload_nodes, read_records
from ledgerloom.sources.scratch import scratch_path, scratch_run, stored


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_expand_and_nest(spark):
    parents = spark.createDataFrame([(1,), (2,), (None,)], "config_id bigint")
    lines = spark.createDataFrame([(10, 1, "b"), (11, 1, "a"), (12, 9, "x"), (13, None, "y")], "line_id bigint, fk bigint, name string")
    assert rows(expand_lines(parents, lines, ("config_id", "fk"))) == [(1, 10, 1, "b"), (1, 11, 1, "a")]
    assert expand_lines(parents, lines, ("config_id", "fk"), keep_empty=True).count() == 4
    nested = nest_lines(parents, lines, ("config_id", "fk"), ("name", "line_id"))
    got = {r["config_id"]: [x["name"] for x in r["lines"]] for r in nested.collect()}
    assert got == {1: ["a", "b"], 2: [], None: []}
    flat = nested.select("config_id", F.explode("lines").alias("l")).select("config_id", "l.line_id")
    assert rows(flat) == rows(expand_lines(parents, lines, ("config_id", "fk")).select("config_id", "line_id"))


def test_tags(spark):
    lines = spark.createDataFrame([(1,), (2,)], "line_id bigint")
    link = spark.createDataFrame([(1, 7), (1, 7), (1, 6), (1, 99), (2, 99)], "line_id bigint, group_id bigint")
    groups = spark.createDataFrame([(7, "zed"), (6, "abc")], "group_id bigint, label string")
    out = attach_tags(lines, link, groups, "line_id", ("line_id", "group_id"), "group_id", "label")
    assert {r.line_id: r.tags for r in out.collect()} == {1: ["abc", "zed"], 2: []}


def test_chunks_put_together_are_the_whole(spark):
    """A hot parent, an empty one, null keys and repeated lines."""
    parents = spark.createDataFrame([(1,), (2,), (3,), (None,)], "config_id bigint")
    lines = spark.range(0, 5000, 1, 5).select(F.when(F.col("id") % 9 != 0, F.lit(1)).when(F.col("id") % 2 == 0, F.lit(2)).cast("bigint").alias("fk"), (F.col("id") * 31 % 700).alias("at"), (F.col("id") % 3).alias("x"))
    for stretch in (1 << 16, 40):
        out = nest_line_chunks(parents, lines, ("config_id", "fk"), ("at", "x"), size=64, stretch=stretch)
        whole = {}
        for r in sorted(out.collect(), key=lambda r: (str(r.config_id), r.chunk)):
            assert r.chunk * 64 == len(whole.setdefault(r.config_id, [])) and len(r.lines) <= 64
            whole[r.config_id] += r.lines
        assert whole == {r.config_id: r.lines for r in nest_lines(parents, lines, ("config_id", "fk"), ("at", "x")).collect()}
    link = spark.range(3000).select((F.col("id") % 2 + 1).alias("line_id"), (F.col("id") % 901).alias("group_id"))
    groups = spark.range(800).select(F.col("id").alias("group_id"), F.format_string("g%03d", F.col("id") % 500).alias("label"))
    args = (parents, link, groups, "config_id", ("line_id", "group_id"), "group_id", "label")
    tags = {}
    for r in sorted(attach_tag_chunks(*args, size=64, stretch=40).collect(), key=lambda r: (str(r.config_id), r.chunk)):
        tags[r.config_id] = tags.get(r.config_id, []) + r.tags
    assert tags == {r.config_id: r.tags for r in attach_tags(*args).collect()} and len(tags[1]) == 500


def test_parents_without_lines_are_found_without_numbering(spark):
    parents, lines = spark.range(9).withColumnRenamed("id", "p"), spark.range(7).select("id", (F.col("id") % 3).alias("fk"))
    out = nest_line_chunks(parents, lines, ("p", "fk"), ("id",), size=2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
    assert sorted((r.p, r.chunk, [x.id for x in r.lines]) for r in out.collect())[:4] == [(0, 0, [0, 3]), (0, 1, [6]), (1, 0, [1, 4]), (2, 0, [2, 5])]
    assert out.where("size(lines) = 0").count() == 6


def test_listing_and_active(spark):
    df = spark.createDataFrame([(True, 1, "k", "n", ["g"]), (None, 2, "k", "n", ["g"]), (False, 3, "k", "n", [])],
                               "active boolean, definition bigint, kind string, name string, group_ids array<string>")
    assert tuple(line_listing(df).columns) == LISTING and line_listing(df).count() == 3
    assert [r.definition for r in active_only(df).collect()] == [1]


def test_flags(spark):
    lines = spark.createDataFrame([(1, True), (2, False), (3, None)], "line_id bigint, active boolean")
    log = spark.createDataFrame([(1, 5, 1, True), (1, 5, 2, False), (2, 9, 3, None), (8, 1, 4, True)], "line_id bigint, ts bigint, change_id bigint, new_value boolean")
    out = apply_flags(lines, log, ("line_id", "line_id"), ("ts", "change_id"))
    assert rows(out) == rows(spark.createDataFrame([(1, False), (2, False), (3, None)], lines.schema))


def test_refs(spark):
    refs = spark.createDataFrame([("m", "other.r0"), ("m", "r1"), ("m", "gone.x.y"), ("m", None)], "module string, ref string")
    split = split_refs(refs)
    assert [(r.ref_module, r.ref_name) for r in split.collect()] == [("other", "r0"), ("m", "r1"), ("gone", "x.y"), (None, None)]
    records = spark.createDataFrame([("other", "r0"), ("m", "r1"), ("m", "r0")], "rec_module string, rec_name string")
    ok, bad = resolve_refs(split, records, [("ref_module", "rec_module"), ("ref_name", "rec_name")])
    assert ok.count() == 2 and bad.count() == 2
    assert repeated_keys(records.union(records.limit(1)), ["rec_module", "rec_name"]).count() == 1


NODES = "doc_id bigint, node_id bigint, parent_id bigint, pos int, tag string, attrs map<string,string>"


def test_references_are_counted_in_one_pass_by_hash(spark):
    refs = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "ref bigint")
    records = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (None, 30)], "key bigint, v bigint")
    out = counted_refs(refs, records, [("ref", "key")])
    assert rows(out) == sorted([(1, 1, 1, 10), (2, 2, None, None), (2, 2, None, None), (3, 0, None, None), (None, 0, None, None)], key=str)
    resolved, dangling = resolve_refs(refs, records, [("ref", "key")], repeated="apart")
    assert rows(resolved) == [(1, 1, 10)] and rows(dangling) == sorted([(3,), (None,)], key=str)
    for df in (out, resolved):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_anchor_and_insert(spark):
    """Book 1 has two notes right in its second shelf, book 2 one on a shelf of another colour, book 3 one a level too deep, book 4 nothing."""
    nodes = spark.createDataFrame(
        [
            (1, 0, None, 0, "room", {}), (1, 1, 0, 0, "shelf", {"colour": "red"}), (1, 2, 1, 0, "note", {}), (1, 3, 0, 1, "shelf", {"colour": "blue"}),
            (1, 4, 3, 0, "pen", {}), (1, 5, 3, 1, "note", {}), (1, 6, 3, 2, "note", {"old": "yes"}),
            (2, 0, None, 0, "room", {}), (2, 1, 0, 0, "shelf", {"colour": "green"}), (2, 2, 1, 0, "note", {}),
            (3, 0, None, 0, "shelf", {"colour": "blue"}), (3, 1, 0, 0, "tray", {}), (3, 2, 1, 0, "note", {}),
            (4, 0, None, 0, "room", {}), (None, 0, None, 0, "room", {}),
        ], NODES)
    found, unmatched = match_anchors(nodes, "note", "shelf", {"colour": "blue"})
    assert [(r.doc_id, r.node_id) for r in found.collect()] == [(1, 5)]
    assert sorted(r.doc_id or 0 for r in unmatched.collect()) == [0, 2, 3, 4]
    assert match_anchor(nodes, "note", "shelf", {"colour": "blue"}, first_only=False).count() == 2
    assert [r.node_id for r in match_anchor(nodes, "note", "shelf").where("doc_id = 1").collect()] == [2]
    overrides = spark.createDataFrame([(1, "late"), (0, "early")], "seq int, tag string")
    base = nodes.where("parent_id is not null")
    merged = insert_before(base, found, overrides, ["doc_id", "parent_id"], ["pos"])
    tags = [r.tag for r in merged.where("doc_id = 1 and parent_id = 3").orderBy("position").collect()]
    assert tags == ["pen", "early", "late", "note", "note"]
    assert merged.count() == base.count() + 2
    none = insert_before(base, found, overrides.limit(0), ["doc_id", "parent_id"], ["pos"])
    assert none.count() == base.count()


@pytest.mark.parametrize("status", ["P", "F", "none"])
def test_matched_and_unmatched_are_all_documents(spark, status):
    nodes = _order_nodes(spark, "/root/testdata/sf0.01")
    found, unmatched = match_anchors(nodes, "R", "order", {"status": status})
    documents = [r.doc_id for r in nodes.select("doc_id").distinct().collect()]
    assert sorted([r.doc_id for r in found.collect()] + [r.doc_id for r in unmatched.collect()]) == sorted(documents)


def test_repeated_records_fail_or_are_reported(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "b")], "ref_id bigint, name string")
    records = spark.createDataFrame([("a", 10, {"x": "1"}), ("b", 11, None), ("b", 12, None), (None, 13, None), (None, 14, None)], "name string, rec_id int, more map<string,string>")
    on = [("name", "name")]
    resolved, dangling = resolve_refs(refs, records, on)
    with pytest.raises(Exception, match="more than one record has the key"):
        resolved.collect()
    with pytest.raises(Exception, match="more than one record"):
        resolved.select("ref_id").collect()  # also where no column of the records is read
    ok, bad = resolve_refs(refs, records, on, repeated="apart")
    assert [(r.ref_id, r.rec_id, r.more) for r in ok.collect()] == [(1, 10, {"x": "1"})] and len(ok.columns) == 5
    assert sorted(r.ref_id for r in bad.collect()) == sorted(r.ref_id for r in dangling.collect()) == [3, 4]
    assert sorted((r.ref_id, r.n_records) for r in ambiguous_refs(refs, records, on).collect()) == [(2, 2), (5, 2)]
    plain, _ = resolve_refs(refs, records.where("rec_id <> 12"), on)
    assert sorted(r.ref_id for r in plain.collect()) == [1, 2, 5]
    with pytest.raises(ValueError):
        resolve_refs(refs, records, on, repeated="ignore")


@pytest.mark.parametrize("stretch", [1 << 16, 50])
def test_numbering_equals_one_window(spark, stretch):
    rows_ = spark.range(0, 20_000, 1, 6).select(
        F.when(F.col("id") % 7 != 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.concat(F.lit("s"), F.col("id") % 50)).alias("doc"), (F.col("id") * 7919 % 20_000).cast("int").alias("at"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("first"), F.create_map(F.lit("k"), F.col("id")).alias("m"),
    )
    spark.sparkContext.setJobGroup("building", "")
    out = numbered(rows_, ["doc"], ["first", "at"], stretch=stretch)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = rows_.withColumn("position", (F.row_number().over(Window.partitionBy("doc").orderBy("first", "at")) - 1).cast("bigint"))
    assert rows(out) == rows(want) and out.schema["position"].dataType.simpleString() == "bigint"
    if stretch == 50:
        sizes = [r[0] for r in with_ranges(rows_, ["doc"], ["first", "at"], stretch).groupBy("__of", "__range").count().select("count").collect()]
        assert max(sizes) < 50 * 12 and len(sizes) > 200  # of some 17,000 rows of one sequence


def test_rows_meet_their_cuts_where_they_are(spark):
    """By a shuffle, of which the join then read what each writer left, one task had the rows of all large partitions."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        large, small = (spark.range(0, n, 1, parts).select((F.col("id") % 500).alias("s"), F.col("id").alias("o")) for n, parts in ((20000, 8), (300, 100)))
        ranged = with_ranges(large.unionByName(small), ["s"], ["o"], stretch=1000)
        sizes = [r["n"] for r in ranged.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.sum("__range")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(sizes) == 20300 and max(sizes) == 2500


def test_one_sequence_of_a_million_rows(spark):
    base = spark.range(0, 1_000_000, 1, 8).select(F.lit(1).alias("doc"), (F.lit(1_000_000) - F.col("id")).alias("at"))
    sizes = with_ranges(base, ["doc"], ["at"]).groupBy("__range").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] < 12 * (1 << 16) and sizes[1] > 3
    out = numbered(base, ["doc"], ["at"])
    assert out.where(F.col("position") != F.col("at") - 1).count() == 0 and out.count() == 1_000_000


def test_triage_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("WARNING x",), ("fine",)], "line string").write.parquet(str(tmp_path / "in"))
    stream = drop_ignored(spark.readStream.schema("line string").parquet(str(tmp_path / "in")), ["WARNING"])
    q = stream.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.line for r in spark.table("kept").collect()] == ["fine"]


PAYLOADS = """<?xml version="1.0"?>
<data>
  <!-- <record id="no"> -->
  <record id="base" model="shape">
    <field name="title">a &lt;b/&gt; c</field>
    <field name="tree" type="xml">
      <box><row key='x &amp; "y"'><cell/><leaf a="1" b="2>1"/><leaf/></row><row key="z"><wrap><leaf/></wrap></row></box>
    </field>
    <field name="more"><leaf/><leaf/></field>
  </record>
  <record id="patch" model="shape"><field name="over" ref="main.base"/><field name="old" ref="main.gone"/></record>
</data>"""


def test_records(spark, tmp_path):
    """Text, references and payloads as values; a record without fields; attributes of payloads in their order."""
    (tmp_path / "r.xml").write_text(PAYLOADS.replace("</data>", '<record id="bare" model="point"/></data>'))
    got = {(r.id, r.field): (r.model, r.ref, r.value) for r in read_records(spark, str(tmp_path / "r.xml")).collect()}
    assert got[("base", "title")] == ("shape", None, "a <b/> c")
    assert got[("patch", "over")] == ("shape", "main.base", None)
    assert got[("base", "tree")][2] is None and got[("bare", None)] == ("point", None, None)
    assert len(got) == 6
    keys = payload_attributes(spark, str(tmp_path / "r.xml"), "//box/row/@key")
    assert [r.value for r in keys.orderBy("position").collect()] == ['x & "y"', "z"]


def test_payload_nodes(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PAYLOADS)
    nodes = payload_nodes(spark, str(tmp_path / "p.xml"))
    got = nodes.orderBy("doc_id", "node_id").collect()
    place = {r.node_id: i for i, r in enumerate(got)}
    assert [(r.field, r.tag, place.get(r.parent_id), r.pos) for r in got] == [
        ("tree", "box", None, 0), ("tree", "row", 0, 0), ("tree", "cell", 1, 0), ("tree", "leaf", 1, 1), ("tree", "leaf", 1, 2),
        ("tree", "row", 0, 1), ("tree", "wrap", 5, 0), ("tree", "leaf", 6, 0), ("more", "leaf", None, 0), ("more", "leaf", None, 1),
    ]
    assert {r.doc_id for r in got} == {"base"} and len({r.record for r in got}) == 1
    assert "Exchange" not in nodes._jdf.queryExecution().executedPlan().toString()
    assert got[1].attrs == {"key": 'x & "y"'} and got[3].attrs == {"a": "1", "b": "2>1"} and got[4].attrs == {}
    (tmp_path / "none.xml").write_text("<data/>")
    assert payload_nodes(spark, str(tmp_path / "none.xml")).count() == 0


def test_payload_nodes_of_odd_records(spark, tmp_path):
    """Without an id, with the id of another, empty, with any number of attributes, tags and references of characters."""
    many = " ".join(f'a{i}="{i}"' for i in range(20_000))
    wide = "".join(f"<n><m/><m i='{i}'/></n>" for i in range(1500))
    (tmp_path / "p.xml").write_text(f"""<data><record id="empty"/>
      <record model='m>n'><field name="f"><a><b/></a></field></record>
      <record model="m"><field name="f"><c
 w = 'a=b'	/><c/></field><field name="f"><d/></field></record>
      <record id="twin"><field name="f"><e/></field></record><record id="twin"><field name="f"><e x="&#38;&amp;lt;&#x20AC;&lt;&none;&#0;&#x110000; & ;"/></field></record>
      <record id="many"><field name="f"><g {many}/></field></record>
      <record id="wide"><field name="f">{wide}</field></record></data>""")
    nodes = payload_nodes(spark, str(tmp_path)).orderBy("record", "node_id").collect()
    trees = {}
    for r in nodes:
        trees.setdefault(r.record, []).append(r)
    trees = list(trees.values())
    assert [(t[0].doc_id, len(t)) for t in trees] == [(None, 2), (None, 3), ("twin", 1), ("twin", 1), ("many", 1), ("wide", 4500)]
    assert [(r.tag, r.pos, r.parent_id is None) for r in trees[0]] == [("a", 0, True), ("b", 0, False)]
    assert [(r.tag, r.pos) for r in trees[1]] == [("c", 0), ("c", 1), ("d", 0)]  # each field counts its own
    assert trees[1][0].attrs == {"w": "a=b"}
    assert trees[3][0].attrs == {"x": "&&lt;\u20ac<&none;&#0;&#x110000; & ;"}
    assert len(trees[4][0].attrs) == 20_000 and trees[4][0].attrs["a19999"] == "19999"
    ns = [r for r in trees[5] if r.tag == "n"]
    assert [r.pos for r in ns] == list(range(1500)) and all(r.parent_id is None for r in ns)
    kids = [(r.parent_id, r.pos, r.attrs.get("i")) for r in trees[5] if r.tag == "m"]
    assert kids == [(n.node_id, k, str(i) if k else None) for i, n in enumerate(ns) for k in range(2)]


def test_a_record_is_named_once_not_for_each_node(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<record id="r"><field name="f"><a><b/><c><d x="1"/></c></a><e/></field></record><record/>')
    nodes = payload_nodes(spark, str(tmp_path))
    above = nodes._jdf.queryExecution().optimizedPlan().toString().split("Generate inline")[0]
    assert "tags#" not in above
    assert [(r.doc_id, r.tag, r.parent_id, r.pos) for r in nodes.orderBy("node_id").collect()] == [
        ("r", "a", None, 0), ("r", "b", 2, 0), ("r", "c", 2, 1), ("r", "d", 4, 0), ("r", "e", None, 1),
    ]


def test_record_path_end_to_end(spark, tmp_path):
    """Record file, its references, the anchor in the record referred to, and the nodes put before it."""
    (tmp_path / "p.xml").write_text(PAYLOADS)
    fields = read_records(spark, str(tmp_path / "p.xml"))
    refs = split_refs(fields.where("ref is not null").select("id", F.lit("extra").alias("module"), "ref"))
    records = fields.select(F.lit("main").alias("rec_module"), F.col("id").alias("rec_name")).distinct()
    resolved, dangling = resolve_refs(refs, records, [("ref_module", "rec_module"), ("ref_name", "rec_name")])
    assert [r.ref for r in dangling.collect()] == ["main.gone"]
    nodes = payload_nodes(spark, str(tmp_path / "p.xml")).join(resolved.select(F.col("rec_name").alias("doc_id")), "doc_id", "left_semi")
    anchor = match_anchor(nodes, "leaf", "row", {"key": 'x & "y"'})
    overrides = spark.createDataFrame([(0, "new", {"n": "0"}), (1, "new", {"n": "1"})], "seq int, tag string, attrs map<string,string>")
    merged = insert_before(nodes, anchor, overrides, ["doc_id", "parent_id"], ["pos"])
    spot = anchor.first()["parent_id"]
    assert [r.tag for r in merged.where(F.col("parent_id") == spot).orderBy("position").collect()] == ["cell", "new", "new", "leaf", "leaf"]
    assert merged.count() == nodes.count() + 2


def test_too_many_overrides_are_an_error(spark):
    base = spark.createDataFrame([(1, 0)], "doc_id bigint, pos bigint")
    many = spark.range(MOST_OVERRIDES + 1).withColumnRenamed("id", "seq")
    out = insert_before(base, base, many, ["doc_id"], ["pos"])
    with pytest.raises(Exception, match="override rows"):
        out.collect()
    assert insert_before(base, base, many.where(F.col("seq") > 0), ["doc_id"], ["pos"]).count() == MOST_OVERRIDES + 1


def test_patterns_are_found_anywhere_and_signs_can_be_escaped(spark):
    patterns = [r"\[disk\] \d+% full", "retry", r"a\.b\*c"]
    lines = {0: "12:00 [disk] 97% full, retry", 1: "disk 97% full", 2: "no retry", 3: "x a.b*c y", 4: "axbbc", 5: "RETRY", 6: None, 7: ""}
    log = spark.createDataFrame(list(lines.items()), "line_no bigint, line string")
    assert [r.line_no for r in drop_ignored(log, patterns).orderBy("line_no").collect()] == [1, 4, 5, 6, 7]
    assert rows(ignored_counts(log, patterns)) == [(0, 1), (1, 2), (2, 1)]  # line 0 counts for two


def test_screening_again_changes_nothing(spark):
    """Also for patterns without a hit, no pattern and no line."""
    log = spark.range(200).select(F.col("id").alias("line_no"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("step "), F.col("id") % 7)).alias("line"))
    own = ["step [25]$", "never"]
    kept = drop_ignored(log, own)
    assert rows(drop_ignored(kept, own)) == rows(kept) and kept.where("line is null").count() == 20
    assert rows(ignored_counts(log, own)) == [(0, log.count() - kept.count()), (1, 0)]
    assert rows(ignored_counts(log.limit(0), own)) == [(0, 0), (1, 0)]
    assert rows(drop_ignored(log, [])) == rows(log) and ignored_counts(log, []).count() == 0


@pytest.mark.parametrize(
    ("pattern", "found"),
    [
        ("plain text", ["plain text"]), (r"a\.b+c?de", ["a.b", "de"]), (r"(?i)Abc[x-z]d(ef|gh)i", ["abc", "d", "i"]), ("ab|cd", []), ("(ab|cd)", []), (r"\d{3}ab{2}c\bd", ["a", "c", "d"]),
        (r"x\Qa.b\E", []), (r"\x41bc", []), ("(?x)a b", []), ("(?:a(b)c)d*ef", ["ef"]), (r"[]a[b\]c]]d", ["d"]), ("", []), (r"^start .* end$", ["start ", " end"]), ("né", ["n"]), (r"[^]]+z(?!y)w", ["z", "w"]),
    ],
)
def test_required_literals(pattern, found):
    assert required_literals(pattern) == found


def test_many_patterns_equal_few(spark, monkeypatch):
    """The same by table and by alternation: patterns with and without literals, cases, equal and null lines, long ones."""
    monkeypatch.setattr(triage, "MOST_TRIED", 5)
    patterns = [r"(?i)disk \w+ full", r"\d\d+", "retry", r"RETRY \[a\.b\]", "x|y", "", "never there", r"lost.*lost", "É{2}tat", r"\bfull\b"]
    lines = ["DISK one full", "disk One fullest", "retry 77", "RETRY [a.b] 7", "say", None, "", "no", "retry 77", "İ lost É and lost", "ÉÉtat", "long " * 20_000 + "retry"]
    log = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no bigint, line string")
    for own in (patterns, [p for p in patterns if p], patterns[:2] + patterns[6:]):
        with monkeypatch.context() as m:
            m.setattr(triage, "MOST_TRIED", 1000)
            counts, kept = rows(ignored_counts(log, own)), rows(drop_ignored(log, own))
        assert rows(ignored_counts(log, own)) == counts and rows(drop_ignored(log, own)) == kept
    assert rows(ignored_counts(log.limit(0), patterns)) == sorted(((i, 0) for i in range(10)), key=str)
    plans = [ignored_counts(log, [f"word {i} of many" for i in range(n)])._jdf.queryExecution().optimizedPlan() for n in (100, 4000)]
    assert plans[0].treeString().count("\n") == plans[1].treeString().count("\n")


def test_nothing_is_lost_over_a_table(spark):
    """Kept and dropped lines, resolved and dangling references: together the input."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    pattern = "(?i)license"
    dropped = lines.where(F.col("line").rlike(pattern)).count()
    assert 0 < dropped and drop_ignored(lines, [pattern]).count() + dropped == lines.count()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select(F.col("doc_id").alias("key"))
    resolved, dangling = resolve_refs(docs, labels, [("doc_id", "key")])
    assert resolved.count() + dangling.count() == docs.count()


def test_scratch_run_clears_what_it_stored(spark):
    outside = scratch_path(spark, "x")
    with scratch_run(spark) as folder:
        assert stored(spark.range(3), "kept").count() == 3
        assert os.listdir(folder)
    assert not os.path.exists(folder) and os.path.dirname(scratch_path(spark, "x")) == os.path.dirname(outside)
