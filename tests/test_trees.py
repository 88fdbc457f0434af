"""Node trees, backend bodies, nested exports and inline marks."""

import json
import re

import pytest
from pyspark.sql import functions as F

from folioscope.operators import blocks as B
from folioscope.operators import body, export, inline, tree


def trees(spark, *docs):
    return tree.flatten_nodes(spark.createDataFrame([(i, x if isinstance(x, (str, type(None))) else json.dumps(x)) for i, x in enumerate(docs)], "doc_id long, body string"))


def node(kind, *content, **more):
    return {"type": kind, **({"content": list(content)} if content else {}), **more}


def deep(n):
    return node("text", text="end") if n == 0 else node("panel", deep(n - 1))


@pytest.mark.parametrize("levels", [1, 6, 7, 8, 9, 30])
def test_trees_of_any_depth(spark, levels):
    n = trees(spark, {"version": 1, "type": "doc", "content": [deep(levels), node("rule")]})
    assert n.count() == levels + 3
    end = n.where("type = 'text'").first()
    assert end.depth == levels + 1 and list(end.path) == [0] * (levels + 1) and end.checked
    assert tree.node_violations(n).count() == 0


def test_violations(spark):
    doc = {
        "version": 2, "type": "page",
        "content": [
            node("paragraph", node("text")), node("text", text="", marks="bold"), node("heading", node("text", text="a"), level=9), node("heading", node("text", text="a"), attrs={"level": 9}), 5, {}, node("bulletList", content="x"),
            node("codeBlock", content={}), node("media", attrs={}), node("media", attrs={"type": "external"}), node("media", attrs={"type": "file"}), node("media", attrs={"type": "file", "id": "1"}), node("media"),
            node("table", node("text")), node("bulletList", node("listItem", node("panel", node("blockquote", node("text"))))),
        ],
    }
    got = sorted((".".join(map(str, r.path)), r.violation) for r in tree.node_violations(trees(spark, doc)).collect())
    assert got == sorted([("", "version"), ("", "root_type"), ("0.0", "no_text"), ("1", "marks_no_list"), ("2", "heading_level"), ("4", "no_object"), ("5", "no_type"), ("6", "content_no_list"), ("7", "content_no_list"), ("8", "media_type"), ("9", "media_url"), ("10", "media_id"), ("12", "media_type"), ("14.0.0.0.0", "no_text")])
    odd = trees(spark, "no json", None, "null", "[]", {"version": 1, "type": "doc", "content": 3})
    assert {(r.doc_id, r.violation) for r in tree.node_violations(odd).collect()} == {(i, v) for i in range(4) for v in ("version", "root_type")} | {(4, "content_no_list")}


def test_report_and_refs(spark):
    link = {"type": "link", "attrs": {"href": "u", "title": "t"}}
    n = trees(spark, {"version": 1, "type": "doc", "content": [node("paragraph", node("text", text="a", marks=[link, {"type": "odd"}]), node("mention", attrs={"id": "7", "text": "@m"}), node("widget"), node("media", attrs={"id": "i", "width": 3}))]})
    r = tree.tree_report(n).first()
    assert (r.nodes, r.text_length, r.links, r.mentions, r.media, r.unknown_nodes, r.unknown_marks) == (6, 1, 1, 1, 1, "widget", "odd")
    assert [(x.href, x.text, x.title) for x in tree.node_links(n).collect()] == [("u", "a", "t")]
    assert [(x.id, x.text, x.access_level) for x in tree.node_mentions(n).collect()] == [("7", "@m", None)]
    assert [(x.id, x.type, x.width) for x in tree.node_media(n).collect()] == [("i", None, "3")]


def run(text, **style):
    return {"textRun": {"content": text, "textStyle": style}}


def paragraph(*elements, style=None, **more):
    return {"paragraph": {"elements": list(elements), "paragraphStyle": style or {}, **more}}


def test_bodies(spark):
    picture = {"inlineObjectElement": {"inlineObjectId": "o"}}
    cell = lambda *e: {"content": [paragraph(*e)]}
    content = [
        paragraph(run("Head\n"), style={"namedStyleType": "HEADING_1", "headingId": "h1"}), paragraph(run("see "), run("it", bold=True, link={"heading": {"id": "h1"}}), {"person": {"personProperties": {"email": "e@x"}}}, run("\n", italic=True)),
        {"table": {"tableRows": [{"tableCells": [cell(run(" a "), run("b ", italic=True), run("\n")), cell(run("\n"))]}]}}, paragraph(picture, run("\n")), {"sectionBreak": {}}, paragraph(picture, run("text\n")), paragraph(picture, picture),
        paragraph(run(""), run(""), run("code\n", weightedFontFamily={"fontFamily": "Consolas"}), bullet={"listId": "l"}), paragraph(run("x\n"), bullet={"listId": "nowhere", "nestingLevel": 2}),
        paragraph(run("gone", link={"headingId": "h9"}), run("b", link={"bookmarkId": "q"}), run("t\n", link={"tabId": "t"})), {"tableOfContents": {}},
    ]
    more = {"inlineObjects": {"o": {"inlineObjectProperties": {"embeddedObject": {"contentUri": "u", "title": "t", "size": {"width": {"magnitude": 3}}}}}}, "lists": {"l": {"listProperties": {"nestingLevels": [{"glyphType": "GLYPH_TYPE_UNSPECIFIED"}]}}}}

    def tabs(k):
        return {"tabProperties": {"tabId": f"t{k}"}, "documentTab": {"body": {"content": [paragraph(run(f"tab {k}\n"))]}}, **({"childTabs": [tabs(k + 1)]} if k < 30 else {})}

    docs = [{"body": {"content": content}, **more}, {"tabs": [tabs(0), {"documentTab": {"body": {"content": content}, **more}}]}, {}, None, {"tabs": [], "body": {"content": []}}]
    blocks = body.docs_json_blocks(spark.createDataFrame([(i, None if x is None else json.dumps(x)) for i, x in enumerate(docs)], "doc_id long, body string"))
    rows = {(r.doc_id, r.pos): r for r in blocks.where("doc_id = 0 OR path = array(1)").collect() if r.doc_id == 0}
    assert sorted(p for _, p in rows) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert [rows[0, p].kind for p in (0, 2, 3, 5, 6)] == ["paragraph", "table", "image", "paragraph", "paragraph"]
    assert rows[0, 0].heading_id == "h1" and rows[0, 1].text == "see ite@x" and rows[0, 1].precedes_boundary and rows[0, 9].precedes_boundary and not rows[0, 0].precedes_boundary
    assert [(s.text, s.bold, s.link) for s in rows[0, 1].spans] == [("see ", False, None), ("it", True, "#head"), ("e@x", False, None)]
    assert [[(c.text, [s.text for s in c.spans]) for c in r] for r in rows[0, 2].cells] == [[("a b", ["a ", "b"]), ("", [])]]
    assert (rows[0, 3].src, rows[0, 3].alt, rows[0, 3].width, rows[0, 3].height) == ("u", "t", 3.0, None)
    assert rows[0, 7].native_checkbox and rows[0, 7].render_prefix == "" and rows[0, 7].text == "code" and rows[0, 7].spans[1].monospace
    assert not rows[0, 8].native_checkbox and rows[0, 8].nesting_level == 2 and [s.link for s in rows[0, 9].spans] == ["#h9", None, None]
    assert blocks.where("doc_id = 1 AND tab_id IS NOT NULL").count() == 31 and blocks.where("doc_id = 1 AND tab_id IS NULL").count() == 9
    assert [r.doc_id for r in blocks.where("kind = 'no_body'").orderBy("doc_id").collect()] == [2, 3]
    assert {(r.doc_id, r.lost): r.n for r in body.lost_links(blocks).collect()} == {(i, k): 1 for i in (0, 1) for k in ("bookmark", "tab")}


def test_tabs_of_any_depth(spark):
    rows = [(1, i, i - 1 if i else None, 0) for i in range(30)] + [(2, 0, None, 1), (2, 1, None, 0), (2, 2, 0, 0)]
    got = tree.flatten_tabs(spark.createDataFrame(rows, "doc_id long, tab_id long, parent_id long, pos int")).collect()
    assert sorted((r.tab_id, r.depth, r.place) for r in got if r.doc_id == 1) == [(i, i, i + 1) for i in range(30)]
    assert sorted((r.tab_id, r.depth, r.place) for r in got if r.doc_id == 2) == [(0, 0, 2), (1, 0, 1), (2, 1, 3)]


MARKDOWN = """# Title *x*

- a **b**
  - b1
      - far
    - b2
- c [l](u "t")
more of c
1. d
   1. e

- [x] done
  - [ ] sub @ann
- [ ] todo

| h | i |
|---|---|
| 1 | `c` |

> quote
> more

```sql
select "1"
```

---

plain :smile: 2025-10-29 {status:colour=Green|title=Active} [!DONE] ![a](i.png)

```
```"""


def test_export_nests_and_comes_back(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, "one"), (3, "")], "doc_id long, content string")
    exported = export.blocks_to_nodes_json(B.classify_blocks(B.split_blocks(B.lines(docs))))
    n = tree.flatten_nodes(exported)
    assert tree.node_violations(n, tree.ALLOWED).count() == 0
    by = {r.doc_id: json.loads(r.body) for r in exported.collect()}
    assert set(by) == {1, 2} and by[2]["content"] == [node("paragraph", node("text", text="one"))]
    content = by[1]["content"]
    assert [x["type"] for x in content] == ["heading", "bulletList", "taskList", "table", "blockquote", "codeBlock", "rule", "paragraph", "codeBlock"]
    item = lambda text, *more: node("listItem", node("paragraph", *text), *more)
    t = lambda s, *marks: {"type": "text", "text": s, **({"marks": list(marks)} if marks else {})}
    assert content[1] == node(
        "bulletList", item([t("a "), t("b", {"type": "strong"})], node("bulletList", item([t("b1")], node("bulletList", item([t("far")]), item([t("b2")]))))),
        item([t("c "), t("l", {"type": "link", "attrs": {"href": "u", "title": "t"}}), t("\nmore of c")]), item([t("d")], node("orderedList", item([t("e")]))),
    )
    assert content[2]["content"][1]["content"][0]["content"][1] == {"type": "mention", "attrs": {"id": "ann", "text": "@ann"}} and content[2]["content"][0]["attrs"] == {"state": "DONE"}
    assert [c["type"] for c in content[3]["content"][0]["content"]] == ["tableHeader"] * 2 and content[5]["attrs"] == {"language": "sql"} and content[8]["content"] == []
    assert [x["type"] for x in content[7]["content"] if x["type"] != "text"] == ["emoji", "date", "status", "status", "media"]
    assert tree.tree_texts(n).where("doc_id = 1").first().text == 'Title xa bb1farb2c l\nmore of cdedonesub todohi1cquote\nmoreselect "1"plain     '


def test_a_mark_that_loses_still_covers_its_text():
    marks = lambda s: [(k, m.group(0)) for _, k, m in inline.marks_of(s)]
    assert marks("`a **b` c** d **e**") == [("code", "`a **b`"), ("italic", "* d *"), ("italic", "*e*")]
    assert marks("***x*** **y**") == [("bold_italic", "***x***"), ("bold", "**y**")]
    assert marks("![a](b) [!DONE] [x](y)") == [("image", "![a](b)"), ("status", "[!DONE]"), ("link", "[x](y)")]
    assert marks("") == [] and inline.nodes_of("a {odd:x=1} b") == [{"type": "text", "text": "a "}, {"type": "text", "text": "{odd:x=1}"}, {"type": "text", "text": " b"}]


def fences(content):
    out, open_ = [], ""
    for line in (content or "").split("\n"):
        m = re.match("^(`{3,}|~{3,})", line)
        inside = open_ != ""
        if m and open_ in ("", m.group(1)):
            open_ = "" if inside else m.group(1)
        out.append((line, inside or open_ != ""))
    return out


def test_lines_and_fences(spark):
    texts = ["", None, "a", "```", "```\n```", "a\n```x\nb\n```\nc", "```\nopen", "~~~\na\n```\n~~~\nb", "````\n```\n````\nx", "\n\n```\n\n", "```\na\n```\n```\nb\n```", "x```\ny", "    ```\nz"]
    rows = B.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")).orderBy("doc_id", "j").collect()
    for i, text in enumerate(texts):
        assert [(r.line, r.in_code) for r in rows if r.doc_id == i] == fences(text), text
        assert [r.j for r in rows if r.doc_id == i] == list(range(len(fences(text))))


def test_lines_are_linear(spark):
    import time

    big = "\n".join("```" if i % 3 == 0 else "line" for i in range(48_000))
    small = spark.createDataFrame([(1, "a\n```\nb")], "doc_id long, content string")
    B.lines(small).agg(F.count("*")).collect()
    for content in (big, big.replace("```", "~~~")):
        began = time.time()
        assert B.lines(spark.createDataFrame([(1, content)], "doc_id long, content string")).where("in_code").count() > 20_000
        assert time.time() - began < 8
