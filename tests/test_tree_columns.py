"""Trees are taken apart into the columns asked for; an export reads its blocks once."""

import json

from folioscope.operators import export, tree


def test_only_what_is_asked_for(spark):
    body = {"type": "doc", "version": 1, "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, 5]}, {"type": "rule", "content": "x"}]}
    deep = {"type": "text", "text": "end"}
    for _ in range(tree.AT_ONCE + 3):
        deep = {"type": "panel", "content": [deep]}
    trees = spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps(deep)), (3, "no json"), (4, None)], "doc_id long, body string")
    every = tree.flatten_nodes(trees)
    for only in (["depth", "type", "text"], ["parent", "checked"], ["type"]):
        got = tree.flatten_nodes(trees, only)
        assert got.columns == ["doc_id", "path", *only]
        assert sorted(map(str, got.collect())) == sorted(map(str, every.select(got.columns).collect()))


def test_an_export_reads_its_blocks_once(spark):
    blocks = spark.createDataFrame([(1, 0, "# a", "heading"), (1, 1, "- b\n  - **c**", "bullets"), (1, 2, "---", "rule")], "doc_id long, pos int, text string, kind string")
    got = export.blocks_to_nodes_json(blocks)
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    assert [x["type"] for x in json.loads(got.first().body)["content"]] == ["heading", "bulletList", "rule"]
