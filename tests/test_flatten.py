import json

from pyspark.sql import functions as F

from papyrion.operators import flatten

SCHEMA = "package_id long, payload string, ingested_at timestamp, key string, entity string, up string"
DOC = {
    "schema_version": "1.0",
    "title": "T",
    "blocks": [
        {"type": "blockquote", "blocks": {"type": "paragraph", "text": "single"}},
        {"type": "list", "items": [{"blocks": [{"type": "paragraph"}, None, {"type": "list", "items": [{"blocks": [{"type": "rule"}]}]}]}, {}]},
        {"type": "table", "rows": [{"cells": [{"blocks": None}, {"blocks": [{"type": "image", "media": {"blocks": [{"type": "rule"}]}}]}]}, {"type": "table_row"}]},
        {"type": "code_block", "text": '{"type": "paragraph"}', "blocks": [{"type": "rule"}]},
    ],
    "assets": {"b.png": {"file": "b.png"}, "a.png": {"file": "a.png", "display_occurrences": [{"role": "body"}, None]}},
}


def table(spark, rows):
    return spark.createDataFrame([(k, p, None, "x", "y", "z") for k, p in rows], SCHEMA)


def found(spark, rows, wanted=("block", "asset", "occurrence")):
    out = flatten.explode_records(table(spark, rows), "package_id", "payload", "ingested_at", wanted=wanted)
    parent = F.when(F.col("entity") == "block", F.col("up")["block"]).when(F.col("entity") == "occurrence", F.col("up")["asset"])
    return sorted(tuple(r) for r in out.select("key", "entity", "no", F.coalesce(parent, F.lit(0))).collect())


def test_nested_blocks_and_map_of_assets(spark):
    assert found(spark, [(1, json.dumps(DOC))]) == [
        (1, "asset", 1, 0), (1, "asset", 2, 0),
        (1, "block", 1, 0), (1, "block", 2, 1), (1, "block", 3, 0), (1, "block", 4, 3), (1, "block", 5, 3), (1, "block", 6, 5), (1, "block", 7, 0), (1, "block", 8, 7), (1, "block", 9, 0),
        (1, "occurrence", 1, 1),
    ]


def test_envelope_double_encoding_repeats_and_unreadable(spark):
    small = {"blocks": [{"type": "rule"}], "assets": []}
    rows = [(1, json.dumps({"exported_by": "x", "document": small})), (2, json.dumps(json.dumps(small))), (3, json.dumps(small)[:-5]), (4, None), (5, ""), (None, json.dumps(small)), (6, "[1, 2]"), (7, json.dumps(small)), (7, json.dumps(small))]
    assert found(spark, rows) == [(1, "block", 1, 0), (2, "block", 1, 0), (7, "block", 1, 0)]


def test_last_delivery_counts(spark):
    a, b = {"blocks": [{"type": "rule"}]}, {"blocks": [{"type": "rule"}, {"type": "toc"}]}
    df = spark.sql(f"SELECT 1L AS package_id, '{json.dumps(a)}' AS payload, timestamp'2025-01-02' AS ingested_at UNION ALL SELECT 1L, '{json.dumps(b)}', timestamp'2025-01-01'")
    assert flatten.explode_records(df, "package_id", "payload", "ingested_at", wanted=("block",)).count() == 1


def test_empty_table_and_deep_nesting(spark):
    assert found(spark, []) == []
    deep = {"type": "rule"}
    for _ in range(300):
        deep = {"type": "blockquote", "blocks": [deep]}
    got = found(spark, [(1, json.dumps({"blocks": [deep]}))])
    assert len(got) == 301 and got[-1] == (1, "block", 301, 300)


def test_nesting_of_any_depth_is_read(spark):
    text = '{"type": "rule"}'
    for _ in range(5000):
        text = '{"type": "blockquote", "blocks": [' + text + "]}"
    got = found(spark, [(1, '{"blocks": [' + text + "]}")])
    assert len(got) == 5001 and got[-1] == (1, "block", 5001, 5000)


def test_many_encodings_envelopes_and_wide_objects(spark):
    text = json.dumps({"blocks": [{"type": "rule", "metadata": {f"k{i}": {"a": {"b": {"c": {"d": {"e": i}}}}} for i in range(500)}}]})
    for _ in range(9):
        text = json.dumps({"inner": {"document": json.loads(text)}})
    for _ in range(10):
        text = json.dumps(text)
    rows = flatten.explode_records(table(spark, [(1, text)]), "package_id", "payload", "ingested_at", wanted=("block",)).collect()
    assert len(rows) == 1 and rows[0]["fields"]["metadata.k499.a.b.c.d.e"] == "499"


def test_layout_comes_from_the_schema(spark):
    doc = {"blocks": [{"type": "paragraph", "inlines": [{"text": "a", "marks": [{"type": "strong"}]}, {"text": "b"}]}], "links": [{"to": "x"}]}
    rows = flatten.explode_records(table(spark, [(1, json.dumps(doc))]), "package_id", "payload", "ingested_at").collect()
    got = sorted((r.entity, r.no, r.parent_entity, r.parent_no, r.ordinal) for r in rows)
    assert got == [("block", 1, "document", 1, 1), ("document", 1, "", 0, 0), ("inlines", 1, "block", 1, 1), ("inlines", 2, "block", 1, 2), ("links", 1, "document", 1, 1), ("marks", 1, "inlines", 1, 1)]


def test_parse_deep_is_json():
    for text in ('{"a": [1, -2.5e3, "x\\u00e9\\n", true, null, {}, []], "b": {"c": "d"}}', "[]", '"s"', " 3 ", "[[1],[2,[3]]]"):
        assert flatten.parse_deep(text) == json.loads(text)
    for text in ("", "{", "[1,]", '{"a" 1}', '{"a":1,}', "[1 2]", "1 2", '{"a":}', "[}", '{1:2}', "]"):
        try:
            flatten.parse_deep(text)
            raise AssertionError(text)
        except ValueError:
            pass


def test_every_parent_is_a_row(spark):
    rows = flatten.explode_records(table(spark, [(k, json.dumps(DOC)) for k in range(3)]), "package_id", "payload", "ingested_at")
    own = rows.select("key", F.col("entity").alias("parent_entity"), F.col("no").alias("parent_no"))
    assert rows.where("entity <> 'document'").join(own, ["key", "parent_entity", "parent_no"], "left_anti").count() == 0


def test_merged_schema_folds_recursion(spark):
    kinds = {(r.entity, r.field): r.kinds for r in flatten.merged_schema(table(spark, [(1, json.dumps(DOC)), (2, json.dumps({"blocks": [], "assets": None}))]), "payload").collect()}
    assert kinds["document", "assets"] == "null|object"
    assert kinds["block", "blocks"] == "array<object>|object"
    assert ("block", "type") in kinds and len({e for e, _ in kinds}) == 7
