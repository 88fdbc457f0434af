"""Queries over node trees, backend bodies, nested exports and tabs, with their SQL for the other engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import blocks as B
from folioscope.operators import body as D
from folioscope.operators import export as E
from folioscope.operators import inline as I
from folioscope.operators import tree as N
from folioscope.operators.diff import text_similarity
from folioscope.plans import fixtures as V
from folioscope.plans import tree_fixtures as T
from folioscope.plans.revision_queries import LINES, LINKS, SLUG, TYPED, lines, long, typed
from folioscope.sources.tables import kept

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def path():
    return F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path")


def nodes(spark, d, without="false"):
    return N.flatten_nodes(T.trees(spark, d, without))


# checks and reports


@query(
    "node_violations",
    f"""WITH {T.SQL_NODES}
    SELECT doc_id, '' AS path, 'version' AS violation FROM documents WHERE doc_id % 9 = 0
    UNION ALL SELECT doc_id, '', 'root_type' FROM documents WHERE doc_id % 11 = 0
    UNION ALL
    SELECT doc_id, concat(i, CASE m WHEN 3 THEN '.0' WHEN 4 THEN '.0' WHEN 14 THEN '.0' WHEN 11 THEN '.0.0.0.0.1' ELSE '' END),
      CASE m WHEN 2 THEN 'heading_level' WHEN 3 THEN 'no_text' WHEN 4 THEN 'marks_no_list' WHEN 5 THEN 'media_type' WHEN 6 THEN 'media_url' WHEN 7 THEN 'media_id'
        WHEN 8 THEN 'no_type' WHEN 9 THEN 'no_object' WHEN 11 THEN 'no_text' WHEN 14 THEN 'child_type' ELSE 'content_no_list' END
    FROM n WHERE m BETWEEN 2 AND 12 OR m = 14""",
)
def node_violations(spark, d):
    return N.node_violations(nodes(spark, d), N.ALLOWED).select("doc_id", path(), "violation")


@query(
    "node_depths",
    f"""WITH {T.SQL_NODES}, k AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS depth)
    SELECT depth, sum(CASE
        WHEN depth = 1 THEN 1 WHEN depth = 2 AND m IN (0, 1, 2, 3, 4, 11, 13, 14, 15) THEN 1 WHEN depth = 3 AND m IN (11, 14) THEN 1 WHEN depth IN (4, 5) AND m = 11 THEN 1 WHEN depth = 6 AND m = 11 THEN 2
        ELSE 0 END)::bigint + CASE WHEN depth = 0 THEN (SELECT count(*) FROM documents) ELSE 0 END AS nodes
    FROM n, k GROUP BY depth""",
)
def node_depths(spark, d):
    return long(nodes(spark, d).groupBy("depth").agg(F.count("*").alias("nodes")), "depth")


@query(
    "tree_report",
    f"""WITH {T.SQL_NODES}
    SELECT doc_id,
      1 + sum(CASE WHEN m IN (5, 6, 7, 8, 10, 12) THEN 1 WHEN m = 9 THEN 0 WHEN m = 11 THEN 7 WHEN m = 14 THEN 3 ELSE 2 END)::bigint AS nodes,
      sum(CASE WHEN m IN (0, 1, 2, 4, 11, 15) THEN length(line) ELSE 0 END)::bigint AS text_length,
      count_if(m = 15) AS links, count_if(m = 13) AS mentions, count_if(m IN (5, 6, 7)) AS media,
      concat_ws(',', CASE WHEN doc_id % 11 = 0 THEN 'page' END, CASE WHEN count_if(m = 15) > 0 THEN 'widget' END) AS unknown_nodes,
      CASE WHEN count_if(m = 15) > 0 THEN 'glow' ELSE '' END AS unknown_marks
    FROM n GROUP BY doc_id""",
)
def tree_report(spark, d):
    return N.tree_report(nodes(spark, d))


@query(
    "tree_refs",
    f"""WITH {T.SQL_NODES}
    SELECT doc_id, concat(i, '.0') AS path, 'link' AS kind, concat('h', i) AS id, line AS text, NULL AS more FROM n WHERE m = 15
    UNION ALL SELECT doc_id, concat(i, '.0'), 'mention', concat('u', doc_id), '@x', 'NONE' FROM n WHERE m = 13
    UNION ALL SELECT doc_id, cast(i AS varchar), 'media', NULL, CASE WHEN m = 6 THEN 'x' END, concat_ws('/', CASE m WHEN 6 THEN 'external' WHEN 7 THEN 'file' END, CASE WHEN m = 7 THEN 'c' END, CASE WHEN m = 7 THEN '7' END)
      FROM n WHERE m IN (5, 6, 7)""",
)
def tree_refs(spark, d):
    """Links, mentions and media of every tree."""
    n = nodes(spark, d)
    links = N.node_links(n).select("doc_id", path(), F.lit("link").alias("kind"), F.col("href").alias("id"), "text", F.col("title").alias("more"))
    mentions = N.node_mentions(n).select("doc_id", path(), F.lit("mention").alias("kind"), "id", "text", F.col("access_level").alias("more"))
    media = N.node_media(n).select("doc_id", path(), F.lit("media").alias("kind"), "id", F.col("alt").alias("text"), F.concat_ws("/", "type", "collection", "width").alias("more"))
    return links.unionByName(mentions).unionByName(media)


DIFFER = f"""{T.SQL_NODES},
 g AS (SELECT doc_id, i, unnest(CASE m WHEN 0 THEN ['paragraph', 'text'] WHEN 11 THEN ['blockquote', 'bulletList', 'listItem', 'panel', 'paragraph', 'text', 'text'] ELSE [] END) AS type, m FROM n),
 dropped AS (SELECT * FROM n WHERE doc_id % 3 = 0 AND m IN (0, 11) OR doc_id % 3 = 1 AND m = 0),
 gone AS (SELECT doc_id, type, count(*) AS k FROM g WHERE doc_id % 3 = 0 OR doc_id % 3 = 1 AND m = 0 GROUP BY ALL),
 ty AS (
   SELECT doc_id, unnest(CASE WHEN m IN (0, 10, 13) THEN ['paragraph'] ELSE [] END || CASE WHEN m IN (3, 4) THEN ['paragraph', 'text'] ELSE [] END || CASE WHEN m IN (1, 2) THEN ['heading', 'text'] ELSE [] END
     || CASE WHEN m = 0 THEN ['text'] ELSE [] END || CASE WHEN m = 14 THEN ['table', 'paragraph', 'text'] ELSE [] END || CASE WHEN m = 15 THEN ['widget', 'text'] ELSE [] END
     || CASE WHEN m = 11 THEN ['blockquote', 'bulletList', 'listItem', 'panel', 'paragraph', 'text', 'text'] ELSE [] END) AS type FROM n),
 have AS (SELECT doc_id, type, count(*) AS k FROM ty GROUP BY ALL),
 txt AS (
   SELECT doc_id, string_agg(line, '' ORDER BY i) AS a, coalesce(string_agg(CASE WHEN (doc_id, i) NOT IN (SELECT (doc_id, i) FROM dropped) THEN line END, '' ORDER BY i), '') AS b
   FROM n WHERE m IN (0, 1, 2, 4, 11, 15) GROUP BY doc_id),
 wa AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_split_to_array(a, '\\s+')) AS w FROM txt WHERE a <> b) WHERE w <> '' GROUP BY ALL),
 wb AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_split_to_array(b, '\\s+')) AS w FROM txt WHERE a <> b) WHERE w <> '' GROUP BY ALL),
 sim AS (SELECT doc_id, round(2 * sum(least(coalesce(wa.k, 0), coalesce(wb.k, 0)))::double / sum(coalesce(wa.k, 0) + coalesce(wb.k, 0))::double, 6) AS r FROM wa FULL JOIN wb USING (doc_id, w) GROUP BY doc_id),
 differences AS (
   SELECT h.doc_id, 'structure_mismatch' AS type, concat('node_count.', h.type) AS location, cast(h.k AS varchar) AS expected, cast(h.k - x.k AS varchar) AS actual, 'medium' AS severity FROM have h JOIN gone x USING (doc_id, type)
   UNION ALL
   SELECT doc_id, 'text_mismatch', 'text_content', concat('generated text (', length(a), ' chars)'), concat('existing text (', length(b), ' chars)'), CASE WHEN r < 0.8 THEN 'high' ELSE 'medium' END
   FROM txt LEFT JOIN sim USING (doc_id) WHERE a <> b)"""
#: The other side lacks the lines that became plain or deep paragraphs, in some documents.
LACKING = "doc_id % 3 = 0 AND (doc_id + 3 * {i}) % 16 IN (0, 11) OR doc_id % 3 = 1 AND (doc_id + 3 * {i}) % 16 = 0"


def differences(spark, d):
    return N.tree_differences(nodes(spark, d), nodes(spark, d, LACKING), text_similarity)


@query("tree_differences", f"WITH {DIFFER} SELECT * FROM differences")
def tree_differences(spark, d):
    return differences(spark, d)


@query(
    "difference_rollup",
    f"""WITH {DIFFER} SELECT doc_id, count(*) AS total, 0::bigint AS missing_content, 0::bigint AS extra_content, count_if(type = 'structure_mismatch') AS structure_mismatch, count_if(type = 'text_mismatch') AS text_mismatch,
      0::bigint AS attribute_mismatch, 0::bigint AS link_mismatch, 0::bigint AS format_mismatch, 0::bigint AS low, count_if(severity = 'medium') AS medium, count_if(severity = 'high') AS high
    FROM differences GROUP BY doc_id""",
)
def difference_rollup(spark, d):
    return N.difference_rollup(differences(spark, d))


@query("compare_trees", f"WITH {TYPED}, ge AS (SELECT doc_id, kind AS type, count(*) AS n FROM typed GROUP BY ALL), ex AS (SELECT doc_id, kind AS type, count(*) AS n FROM typed WHERE (doc_id + pos) % 5 <> 0 GROUP BY ALL) SELECT doc_id, type, ge.n AS n_generated, coalesce(ex.n, 0) AS n_existing FROM ge LEFT JOIN ex USING (doc_id, type) WHERE ge.n <> coalesce(ex.n, 0)")
def compare_trees(spark, d):
    t = typed(spark, d).select("doc_id", "pos", F.col("kind").alias("type"))
    return N.compare_trees(t, t.where("(doc_id + pos) % 5 <> 0"))


# exports


@query(
    "node_types",
    f"""WITH {TYPED}, t AS (
      SELECT unnest(CASE kind
        WHEN 'heading' THEN [['heading', '1']] WHEN 'code' THEN [['codeBlock', '1']] WHEN 'mermaid' THEN [['codeBlock', '1']] WHEN 'rule' THEN [['rule', '1']] WHEN 'quote' THEN [['blockquote', '1'], ['paragraph', '2']]
        WHEN 'task_list' THEN [['taskList', '1'], ['taskItem', '2']] WHEN 'bullets' THEN [['bulletList', '1'], ['listItem', '2'], ['paragraph', '3']] WHEN 'ordered' THEN [['orderedList', '1'], ['listItem', '2'], ['paragraph', '3']]
        WHEN 'table' THEN [['table', '1'], ['tableRow', '2'], ['tableHeader', '3'], ['paragraph', '4'], ['tableHeader', '3'], ['paragraph', '4'], ['tableRow', '2'], ['tableCell', '3'], ['paragraph', '4'], ['tableCell', '3'], ['paragraph', '4']]
        ELSE [['paragraph', '1']] END) AS x FROM typed
      UNION ALL SELECT ['doc', '0'] FROM (SELECT DISTINCT doc_id FROM typed))
    SELECT x[1] AS type, cast(x[2] AS bigint) AS depth, count(*) AS n FROM t GROUP BY ALL""",
)
def node_types(spark, d):
    """Nodes of the exported documents, but for those inside a line."""
    n = N.flatten_nodes(E.blocks_to_nodes_json(typed(spark, d))).where(~F.col("type").isin("text", "media", "mention", "emoji", "status", "date", "inlineExtension"))
    return long(n.groupBy("type", "depth").agg(F.count("*").alias("n")), "depth")


@query("blocks_to_nodes_json", f"WITH {T.SQL_LISTS} SELECT doc_id, i AS place, 4 + 2 * level AS depth, text FROM v")
def blocks_to_nodes_json(spark, d):
    """Lists nested by indent, exported, read back: every item's text at its depth, in document order."""
    trees = E.blocks_to_nodes_json(B.classify_blocks(B.split_blocks(B.lines(T.list_markdown(spark, d)))))
    n = N.flatten_nodes(trees, ["depth", "type", "text"]).where("type = 'text'")
    at = F.sort_array(F.collect_list(F.struct("path", "depth", "text")))
    return long(n.groupBy("doc_id").agg(at.alias("x")).select("doc_id", F.posexplode("x").alias("place", "x")).select("doc_id", "place", "x.depth", "x.text"), "place", "depth")


@query("nested_lists", f"WITH {T.SQL_LISTS}, b AS (SELECT *, lag(level, 1, -1) OVER (PARTITION BY doc_id ORDER BY i) AS up FROM v) SELECT doc_id, count(*) AS items, count_if(level > up) AS lists, max(level) AS deepest FROM b GROUP BY doc_id")
def nested_lists(spark, d):
    """Items, lists and the deepest level of each exported document."""
    trees = E.blocks_to_nodes_json(B.classify_blocks(B.split_blocks(B.lines(T.list_markdown(spark, d)))))
    deepest = F.max(F.when(F.col("type") == "listItem", (F.col("depth") - 2) / 2)).cast("long")
    return N.flatten_nodes(trees).groupBy("doc_id").agg(F.count_if(F.col("type") == "listItem").alias("items"), F.count_if(F.col("type").isin("bulletList", "orderedList")).alias("lists"), deepest.alias("deepest"))


@query(
    "compare_export",
    f"""WITH {TYPED}{LINKS},
    a AS (SELECT doc_id, count_if(kind = 'heading') AS h, count_if(kind IN ('bullets', 'ordered')) AS l, count_if(kind IN ('code', 'mermaid')) AS c FROM typed GROUP BY doc_id),
    x AS (SELECT doc_id, count_if(kind IN ('code', 'mermaid') AND pos % 2 = 0) AS c, count_if(kind = 'heading') AS h FROM typed WHERE doc_id % 4 = 0 GROUP BY doc_id)
    SELECT a.doc_id, 'structure_mismatch' AS type, 'headings' AS location, a.h AS expected, 0 AS actual, 'high' AS severity FROM a JOIN x USING (doc_id) WHERE a.h > 0
    UNION ALL SELECT a.doc_id, 'structure_mismatch', 'code_blocks', a.c, a.c - x.c, 'medium' FROM a JOIN x USING (doc_id) WHERE x.c > 0""",
)
def compare_export(spark, d):
    """Blocks against their exported trees, which lack headings and some code in a quarter of the documents."""
    t = kept(typed(spark, d))
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    links = N.node_links(N.flatten_nodes(E.blocks_to_nodes_json(t))).groupBy("doc_id").agg(F.count("*").alias("links"))
    source = t.groupBy("doc_id").agg(count("heading").alias("headings"), count("bullets", "ordered").alias("lists"), count("code", "mermaid").alias("code_blocks")).join(links, "doc_id", "left").fillna(0, ["links"])
    less = t.where("doc_id % 4 <> 0 OR NOT (kind = 'heading' OR kind IN ('code', 'mermaid') AND pos % 2 = 0)")
    return N.compare_export(source, N.flatten_nodes(E.blocks_to_nodes_json(less)))


# bodies

ELEMENTS = f"""{T.SQL_BODIES},
 heads AS (SELECT doc_id, tab, pos, i, {SLUG.format('line')} AS base FROM e WHERE m = 0),
 slugs AS (SELECT *, CASE WHEN k = 0 THEN base ELSE concat(base, '-', k) END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, tab, base ORDER BY pos) - 1 AS k FROM heads)),
 x AS (
   SELECT e.*, lead(m) OVER (PARTITION BY doc_id, tab ORDER BY pos) AS next, i - (i + 3 * doc_id) % 8 AS target FROM e),
 strip AS (SELECT x.*, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS stripped, s.slug FROM x LEFT JOIN slugs s ON s.doc_id = x.doc_id AND s.tab = x.tab AND s.i = x.target)"""


@query(
    "docs_json_blocks",
    f"""WITH {ELEMENTS}
    SELECT doc_id, tab, pos, CASE m WHEN 3 THEN 'table' WHEN 4 THEN 'image' ELSE 'paragraph' END AS kind,
      CASE WHEN m = 0 THEN 'HEADING_2' WHEN m IN (1, 2, 6, 7) THEN 'NORMAL_TEXT' END AS style,
      CASE m WHEN 1 THEN concat('Note: ', line) WHEN 3 THEN concat('x y|', stripped, '/', i) WHEN 4 THEN concat('u', i % 2) WHEN 6 THEN concat('see itAnn!', line) ELSE line END AS text,
      CASE WHEN m NOT IN (3, 4) THEN m = 2 END AS is_list_item, CASE WHEN m = 2 THEN i % 3 WHEN m NOT IN (3, 4) THEN 0 END AS nesting_level, CASE WHEN m NOT IN (3, 4) THEN m = 2 AND i % 3 = 0 END AS native_checkbox,
      CASE WHEN m = 0 THEN concat('h.', i) END AS heading_id, CASE WHEN m = 7 THEN 1 + i % 2 WHEN m NOT IN (3, 4) THEN 0 END AS quote_depth, CASE WHEN m NOT IN (3, 4) THEN coalesce(next IN (3, 5), false) END AS precedes_boundary,
      CASE m WHEN 1 THEN concat_ws('|', 'Note: :b', CASE WHEN line <> '' THEN concat(line, ':m') END)
        WHEN 6 THEN concat_ws('|', 'see ', concat('it:#', coalesce(slug, concat('h.', target))), 'Ann', '!', CASE WHEN line <> '' THEN line END) WHEN 3 THEN 'y:i' WHEN 4 THEN CASE i % 2 WHEN 0 THEN 'd0' ELSE 't1' END
        ELSE line END AS spans,
      CASE WHEN m = 4 AND i % 2 = 0 THEN 10.5::double END AS width
    FROM strip WHERE m <> 5""",
)
def docs_json_blocks(spark, d):
    """Blocks of bodies with nested tabs and without; texts of cells, sources of images and marks of spans are written out."""
    b = D.docs_json_blocks(T.bodies(spark, d))
    marks = lambda s: F.concat_ws(":", s["text"], F.when(s["bold"], "b"), F.when(s["italic"], "i"), F.when(s["monospace"], "m"), s["link"])
    row = lambda r: F.array_join(F.transform(r, lambda c: c["text"]), "|")
    text = F.when(F.col("kind") == "table", F.array_join(F.transform("cells", row), "/")).when(F.col("kind") == "image", F.col("src")).otherwise(F.col("text"))
    styled = F.filter(F.flatten(F.transform(F.flatten("cells"), lambda c: c["spans"])), lambda s: s["italic"])
    spans = F.when(F.col("kind") == "table", F.array_join(F.transform(styled, marks), "|")).when(F.col("kind") == "image", F.col("alt")).otherwise(F.array_join(F.transform("spans", marks), "|"))
    out = b.select("doc_id", F.greatest(F.size("path") - 1, F.lit(0)).alias("tab"), "pos", "kind", "style", text.alias("text"), "is_list_item", "nesting_level", "native_checkbox", "heading_id", "quote_depth", "precedes_boundary", spans.alias("spans"), "width")
    return long(out, "tab", "pos", "nesting_level", "quote_depth")


@query("lost_links", f"WITH {T.SQL_BODIES} SELECT doc_id, 'bookmark' AS lost, count(*) AS n FROM e WHERE m = 6 GROUP BY doc_id")
def lost_links(spark, d):
    return D.lost_links(D.docs_json_blocks(T.bodies(spark, d)))


@query("document_tabs", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('t', k) END AS tab_id, CASE WHEN doc_id % 3 = 0 THEN k + 1 ELSE 0 END AS depth FROM documents, (SELECT unnest([0, 1]) AS k) WHERE doc_id % 3 = 0 OR k = 0")
def document_tabs(spark, d):
    return long(D.document_tabs(T.bodies(spark, d)).select("doc_id", "tab_id", F.size("path").alias("depth")), "depth")


@query("flatten_tabs", "WITH RECURSIVE t AS (SELECT doc_id // 20 AS doc_id, doc_id AS tab_id, CASE WHEN doc_id % 20 > 0 THEN doc_id // 20 * 20 + (doc_id % 20 - 1) // 3 END AS parent_id, doc_id % 7 AS pos FROM documents), r AS (SELECT doc_id, tab_id, 0 AS depth, [pos] AS path, [tab_id] AS ids FROM t WHERE parent_id IS NULL UNION ALL SELECT t.doc_id, t.tab_id, r.depth + 1, list_append(r.path, t.pos), list_append(r.ids, t.tab_id) FROM r JOIN t ON t.doc_id = r.doc_id AND t.parent_id = r.tab_id) SELECT doc_id, count(*) AS tabs, max(depth) AS depth FROM r GROUP BY doc_id")
def flatten_tabs(spark, d):
    tabs = V.documents(spark, d).selectExpr("doc_id div 20 AS doc_id", "doc_id AS tab_id", "CASE WHEN doc_id % 20 > 0 THEN doc_id div 20 * 20 + (doc_id % 20 - 1) div 3 END AS parent_id", "doc_id % 7 AS pos")
    return N.flatten_tabs(tabs).groupBy("doc_id").agg(F.count("*").alias("tabs"), F.max("depth").cast("long").alias("depth"))


@query("foreign_headings", f"WITH {LINES} SELECT doc_id, heading_id, min(tab) AS tab FROM (SELECT doc_id, substr(line, 4) AS heading_id, j % 3 AS tab FROM flagged WHERE NOT in_code AND line LIKE '## _%') GROUP BY doc_id, heading_id HAVING count(DISTINCT tab) = 1")
def foreign_headings(spark, d):
    h = lines(spark, d).where("NOT in_code AND line LIKE '## _%'").selectExpr("doc_id", "substring(line, 4) AS heading_id", "cast(j % 3 AS bigint) AS tab")
    return N.foreign_headings(h)


# inline marks

#: A mark by the line's number before the line, after a code span that holds half a mark, which hides it.
MARKED = """CASE (doc_id + i) % 15
  WHEN 0 THEN '[a](b) ' WHEN 1 THEN '![a](b) ' WHEN 2 THEN '**a** ' WHEN 3 THEN '*a* ' WHEN 4 THEN '***a*** ' WHEN 5 THEN '`a **b` ' WHEN 6 THEN '~~a~~ ' WHEN 7 THEN ':a_b: ' WHEN 8 THEN '@ann.b-c ' WHEN 9 THEN '[!BLOCKED] '
  WHEN 10 THEN '==a== ' WHEN 11 THEN '<mark style="color:#f00">a</mark> ' WHEN 12 THEN '2025-10-29T14:00:00 ' WHEN 13 THEN '{status:colour=Green|title=Active} ' ELSE '{toc:maxLevel=3} ' END"""


@query(
    "explode_inline",
    f"""WITH l AS (
      SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
    x AS (SELECT *, (doc_id + i) % 15 AS m, {MARKED} AS mark FROM l)
    SELECT doc_id, i AS j, 0 AS k,
      ['link', 'image', 'bold', 'italic', 'bold_italic', 'code', 'strike', 'emoji', 'mention', 'status', 'highlight', 'colour', 'date', 'status', 'macro'][m + 1] AS kind, 0 AS start, rtrim(mark) AS raw,
      CASE m WHEN 5 THEN 'a **b' WHEN 7 THEN 'a_b' WHEN 8 THEN 'ann.b-c' WHEN 9 THEN 'BLOCKED' WHEN 12 THEN '2025-10-29T14:00:00' WHEN 13 THEN 'Active' WHEN 14 THEN 'toc' ELSE 'a' END AS value,
      CASE m WHEN 0 THEN 'b' WHEN 1 THEN 'b' WHEN 14 THEN 'maxLevel=3' END AS target, CASE m WHEN 9 THEN 'red' WHEN 10 THEN '#ffff00' WHEN 11 THEN '#f00' WHEN 13 THEN 'Green' END AS colour
    FROM x""",
)
def explode_inline(spark, d):
    """A mark of each kind in front of the documents' lines; marks of the lines' own texts are not among those at place 0."""
    text = F.expr(f"array_join(transform(split(text, '\\n', -1), (line, i) -> concat({MARKED}, line)), '\\n')")
    return long(I.explode_inline(B.lines(V.documents(spark, d).select("doc_id", text.alias("content")))).where("start = 0"), "j", "k", "start")
