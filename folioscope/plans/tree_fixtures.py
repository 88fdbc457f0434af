"""Node trees and backend bodies in JSON, derived line by line from the given documents, and the same facts for the other engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.plans.fixtures import documents

#: Lines of the documents with the number m that says which node a line becomes.
SQL_NODES = """l AS (
   SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
 n AS (SELECT *, (doc_id + 3 * i) % 16 AS m FROM l)"""

_TEXT = """concat('{"type":"text","text":', s.q, '}')"""
_NODE = f"""CASE (doc_id + 3 * s.i) % 16
  WHEN 0 THEN concat('{{"type":"paragraph","content":[', {_TEXT}, ']}}')
  WHEN 1 THEN concat('{{"type":"heading","attrs":{{"level":2}},"content":[', {_TEXT}, ']}}')
  WHEN 2 THEN concat('{{"type":"heading","level":9,"content":[', {_TEXT}, ']}}')
  WHEN 3 THEN '{{"type":"paragraph","content":[{{"type":"text"}}]}}'
  WHEN 4 THEN concat('{{"type":"paragraph","content":[{{"type":"text","marks":"bold","text":', s.q, '}}]}}')
  WHEN 5 THEN '{{"type":"media","attrs":{{}}}}'
  WHEN 6 THEN '{{"type":"media","attrs":{{"type":"external","alt":"x"}}}}'
  WHEN 7 THEN '{{"type":"media","attrs":{{"type":"file","collection":"c","width":7}}}}'
  WHEN 8 THEN '{{"content":[]}}'
  WHEN 9 THEN '5'
  WHEN 10 THEN '{{"type":"paragraph","content":"x"}}'
  WHEN 11 THEN concat('{{"type":"blockquote","content":[{{"type":"bulletList","content":[{{"type":"listItem","content":[{{"type":"panel","content":[{{"type":"paragraph","content":[', {_TEXT}, ',{{"type":"text"}}]}}]}}]}}]}}]}}')
  WHEN 12 THEN '{{"type":"codeBlock","content":3}}'
  WHEN 13 THEN concat('{{"type":"paragraph","content":[{{"type":"mention","attrs":{{"id":"u', doc_id, '","text":"@x","accessLevel":"NONE"}}}}]}}')
  WHEN 14 THEN '{{"type":"table","content":[{{"type":"paragraph","content":[{{"type":"text"}}]}}]}}'
  ELSE concat('{{"type":"widget","content":[{{"type":"text","marks":[{{"type":"link","attrs":{{"href":"h', s.i, '"}}}},{{"type":"glow"}}],"text":', s.q, '}}]}}') END"""


def _quoted(df: DataFrame) -> DataFrame:
    """doc_id and ls: an array of i, line, q (the line as JSON)."""
    ls = "transform(split(text, '\\n', -1), (x, i) -> struct(i, x AS line, substring(to_json(array(x)), 2, length(to_json(array(x))) - 2) AS q))"
    return df.select("doc_id", F.expr(ls).alias("ls"))


def trees(spark: SparkSession, sf_dir: str, without: str = "false") -> DataFrame:
    """doc_id, body: a node for each line; lines for which `without` holds (of doc_id, i) have none."""
    nodes = f"array_join(transform(filter(ls, s -> NOT ({without.replace('{i}', 's.i')})), s -> {_NODE}), ',')"
    top = "concat('{\"version\":', CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 1 END, ',\"type\":\"', CASE WHEN doc_id % 11 = 0 THEN 'page' ELSE 'doc' END, '\",\"content\":[', nodes, ']}')"
    return _quoted(documents(spark, sf_dir)).select("doc_id", F.expr(nodes).alias("nodes")).select("doc_id", F.expr(top).alias("body"))


#: Elements of a body: m says which; a tabbed document (doc_id % 3 = 0) has even lines in its tab and odd ones in a tab below.
SQL_BODIES = """l AS (
   SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
 e AS (
   SELECT *, (doc_id + 3 * i) % 8 AS m, CASE WHEN doc_id % 3 = 0 THEN i % 2 ELSE 0 END AS tab, CASE WHEN doc_id % 3 = 0 THEN i // 2 ELSE i END AS pos FROM l)"""

def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, body: paragraphs, lists, tables, images, links, people, quotes and breaks, with tabs or without."""
    run = lambda content, style="": f"""concat('{{"textRun":{{"content":', {content}, '{style}}}}}')"""
    line = """concat(left(s.q, length(s.q) - 1), '\\\\n"')"""
    paragraph = lambda elements, more="": f"""concat('{{"paragraph":{{{more}"elements":[', {elements}, ']}}}}')"""
    cell = lambda elements: f"""'{{"content":[', {paragraph(elements)}, ']}}'"""
    kinds = [
        f"""concat('{{"paragraph":{{"paragraphStyle":{{"namedStyleType":"HEADING_2","headingId":"h.', s.i, '"}},"elements":[', {run(line)}, ']}}}}')""",
        paragraph("concat(" + run("'\"Note: \"'", ',"textStyle":{"bold":true}') + ", ',', " + run(line, ',"textStyle":{"weightedFontFamily":{"fontFamily":"Fira Code"}}') + ")"),
        f"""concat('{{"paragraph":{{"bullet":{{"listId":"l1","nestingLevel":', s.i % 3, '}},"elements":[', {run(line)}, ']}}}}')""",
        "concat('{\"table\":{\"tableRows\":[{\"tableCells\":[', " + cell(run("'\" x \"'") + ", ',', " + run("'\"y\\\\n\"'", ',"textStyle":{"italic":true}')) + ", ',', " + cell(run(line)) + ", ']},{\"tableCells\":[', " + cell(run("concat('\"', s.i, '\"')")) + ", ']}]}}')",
        """concat('{"paragraph":{"elements":[{"inlineObjectElement":{"inlineObjectId":"o', s.i % 2, '"}},{"textRun":{"content":"\\\\n"}}]}}')""",
        """'{"sectionBreak":{}}'""",
        paragraph(
            "concat(" + run("'\"see \"'") + """, ',{"textRun":{"content":"it","textStyle":{"link":{"heading":{"id":"h.', s.i - (s.i + 3 * doc_id) % 8, '"}}}}},{"person":{"personProperties":{"name":"Ann"}}},{"textRun":{"content":"!","textStyle":{"link":{"bookmarkId":"b"}}}},', """ + run(line) + ")"
        ),
        """concat('{"paragraph":{"paragraphStyle":{"indentStart":{"magnitude":', 18 * (1 + s.i % 2), '},"borderLeft":{"color":{"color":{"rgbColor":{"red":0.494,"green":0.549,"blue":0.612}}},"width":{"magnitude":1},"dashStyle":"SOLID"}},"elements":[', """ + run(line) + ", ']}}')",
    ]
    element = "CASE (doc_id + 3 * s.i) % 8 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(kinds)) + " END"
    content = lambda keep: f"array_join(transform(filter(ls, s -> {keep}), s -> {element}), ',')"
    objects = '"inlineObjects":{"o0":{"inlineObjectProperties":{"embeddedObject":{"contentUri":"u0","description":"d0","size":{"width":{"magnitude":10.5}}}}},"o1":{"inlineObjectProperties":{"embeddedObject":{"imageProperties":{"contentUri":"u1"},"title":"t1"}}}}'
    lists = '"lists":{"l1":{"listProperties":{"nestingLevels":[{"glyphType":"GLYPH_TYPE_UNSPECIFIED"},{},{"glyphType":"DECIMAL"}]}}}'
    body = lambda c: f"""concat('{{"body":{{"content":[', {c}, ']}},{objects},{lists}}}')"""
    tabbed = f"""concat('{{"tabs":[{{"tabProperties":{{"tabId":"t0"}},"documentTab":', {body('even')}, ',"childTabs":[{{"tabProperties":{{"tabId":"t1"}},"documentTab":', {body('odd')}, '}}]}}]}}')"""
    df = _quoted(documents(spark, sf_dir)).select("doc_id", *[F.expr(content(k)).alias(n) for n, k in (("every", "true"), ("even", "s.i % 2 = 0"), ("odd", "s.i % 2 = 1"))])
    return df.select("doc_id", F.expr(f"CASE WHEN doc_id % 3 = 0 THEN {tabbed} ELSE {body('every')} END").alias("body"))


#: A list of each document's lines, indented by rule; without marks, so that an item's text is one node.
_INDENT = "repeat('  ', cast(({i} * 7 + doc_id) % 4 AS int))"


def list_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = f"concat({_INDENT.format(i='i')}, CASE WHEN i % 5 = 4 THEN '1. ' ELSE '- ' END, 'item ', i, ' ', regexp_replace(line, '[^A-Za-z0-9 ]', ''))"
    return documents(spark, sf_dir).select("doc_id", F.expr(f"array_join(transform(split(text, '\\n', -1), (line, i) -> {item}), '\\n')").alias("content"))


SQL_LISTS = """l AS (
   SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
 r AS (SELECT doc_id, i, concat('item ', i, ' ', regexp_replace(line, '[^A-Za-z0-9 ]', '', 'g')) AS text, CASE WHEN i = 0 THEN 0 ELSE (i * 7 + doc_id) % 4 END AS raw FROM l),
 v AS (SELECT *, min(raw - i) OVER (PARTITION BY doc_id ORDER BY i) + i AS level FROM r)"""
