"""Queries whose fixtures make every rule of an operator fire, with their SQL for the other engine.

Fixtures turn each line of the given documents into a block, a heading, a cell or a link by its number, so that they grow with
the tables and each result follows from a rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import blocks as B
from folioscope.operators import cells as C
from folioscope.operators import crawl as K
from folioscope.operators import diff as D
from folioscope.operators import html as H
from folioscope.operators import links as L
from folioscope.operators import sync as Y
from folioscope.plans import fixtures as V
from folioscope.plans.numbered_queries import numbered
from folioscope.sources import files
from folioscope.sources.tables import kept, shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


def long(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def line_rows(spark, d):
    """doc_id, i, line of every line of every document."""
    return V.documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))


SQL_LINES = """l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents)"""


# tables and cells

#: A table for every third line, plain paragraphs between. The target's cells are styled; some live cells differ, some rows and tables are missing.
LIVE = """CASE WHEN i % 3 <> 0 THEN concat('p', i) WHEN (doc_id + i) % 11 = 0 THEN concat('q', i) ELSE concat('| h | k |\n|---|---|\n| ', CASE WHEN (doc_id + i) % 5 = 0 THEN 'b' ELSE 'a' END, i, ' | ', replace(line, '|', '/'), ' |') END"""
TARGET = """CASE WHEN i % 3 <> 0 THEN concat('p', i) ELSE concat('| **h** | k |\n|---|---|\n| *a', i, '* | ', replace(line, '|', '/'), ' |', CASE WHEN (doc_id + i) % 7 = 0 THEN '\n| **x** | y |' ELSE '' END) END"""


def table_blocks(spark, d, rule):
    x = line_rows(spark, d).select("doc_id", F.col("i").cast("long").alias("pos"), F.expr(rule.replace("\n", "\\n")).alias("text"))
    return kept(x.withColumn("kind", F.when(F.col("text").startswith("| "), "table").otherwise("paragraph")))


@query(
    "cell_align",
    f"""WITH {SQL_LINES}, t AS (SELECT *, (doc_id + i) % 11 <> 0 AS live FROM l WHERE i % 3 = 0)
    SELECT doc_id, i AS pos, 0 AS row, 0 AS col, 'h' AS text FROM t WHERE NOT live
    UNION ALL SELECT doc_id, i, 1, 0, concat('a', i) FROM t WHERE NOT live OR (doc_id + i) % 5 = 0
    UNION ALL SELECT doc_id, i, 2, 0, 'x' FROM t WHERE (doc_id + i) % 7 = 0""",
)
def cell_align(spark, d):
    """Styled cells without a place: their table, row or text is not in the live document. Second cells, which may hold marks of the
    documents' own, are left to cell_pairs."""
    live, target = table_blocks(spark, d, LIVE), table_blocks(spark, d, TARGET)
    aligned = C.cell_align(C.styled_cells(live), C.styled_cells(target), C.paired_tables(live, target))
    return long(C.unplaced_cells(aligned).where("col = 0"), "row", "col")


@query(
    "cell_pairs",
    f"""WITH {SQL_LINES}, t AS (SELECT *, (doc_id + i) % 11 <> 0 AS live, (doc_id + i) % 7 = 0 AS more FROM l WHERE i % 3 = 0)
    SELECT doc_id, i AS pos, 4 + CASE WHEN more THEN 2 ELSE 0 END AS cells, CASE WHEN live THEN 4 ELSE 0 END AS paired, CASE WHEN live THEN 4 - ((doc_id + i) % 5 = 0)::int ELSE 0 END AS placed FROM t""",
)
def cell_pairs(spark, d):
    """Of each target table: its cells, those with a partner, those whose text stands in it."""
    live, target = table_blocks(spark, d, LIVE), table_blocks(spark, d, TARGET)
    aligned = C.cell_align(C.styled_cells(live), C.styled_cells(target), C.paired_tables(live, target))
    return aligned.groupBy("doc_id", "pos").agg(F.count("*").alias("cells"), F.count("live_text").alias("paired"), F.count_if("placed").alias("placed"))


# repairs of diffs

#: Line i of the left side, and of the right: native check boxes exported as boxes, plain lines that got boxes, restyled and kept lines.
BOXES = f"""{SQL_LINES}, x AS (SELECT doc_id, i, concat('n', i, ' ', line) AS t FROM l)"""


def boxes(spark, d):
    x = line_rows(spark, d).select("doc_id", F.col("i").alias("j"), F.concat(F.lit("n"), F.col("i").cast("string"), F.lit(" "), "line").alias("t"))
    left = x.select("doc_id", "j", F.col("t").alias("line"), (F.col("j") % 4 == 0).alias("native"))
    right = x.select("doc_id", "j", F.when(F.col("j") % 4 <= 1, F.concat(F.lit("- [ ] "), "t")).when(F.col("j") % 4 == 2, F.concat(F.lit("## "), "t")).otherwise(F.col("t")).alias("line"))
    return left, right


@query(
    "diff_repair_native",
    f"""WITH {BOXES}
    SELECT doc_id, i AS l, i AS r, 'TEXT' AS l_style, CASE WHEN i % 4 = 0 THEN 'TASK' ELSE 'HEADING_2' END AS r_style, t AS text FROM x WHERE i % 4 IN (0, 2)""",
)
def diff_repair_native(spark, d):
    """A box is no part of the text where the other side has a native check box of that text, and part of it elsewhere."""
    a, b = boxes(spark, d)
    return long(D.diff_repair(a, b, D.diff_align(a, b)), "l", "r")


@query(
    "diff_assign_numbered",
    f"""WITH {BOXES}
    SELECT doc_id, i AS l, i AS r, 1 AS score FROM x WHERE i % 4 <> 3""",
)
def diff_assign_numbered(spark, d):
    """One-to-one pairs of restyled lines, each text once: a plain line that became a heading or an item keeps one point."""
    a, b = boxes(spark, d)
    return long(D.diff_assign(a, b, D.diff_align(a, b)), "l", "r", "score")


@query(
    "churn_pairs_numbered",
    f"""WITH {SQL_LINES}, n AS (SELECT doc_id, max(i) AS last FROM l GROUP BY doc_id)
    SELECT l.doc_id, cast(l.i // 3 * 2 + 1 AS bigint) AS edit, concat(l.i, ': ', l.line) AS text, 1::bigint AS n FROM l JOIN n USING (doc_id) WHERE l.i % 3 = 1 AND l.i < n.last""",
)
def churn_pairs_numbered(spark, d):
    """Of three lines in a row the second is removed and added again inside one edit."""
    x = numbered(spark, d)
    last = x.groupBy("doc_id").agg(F.max("j").alias("last"))
    twice = "j % 3 = 1 AND j < last"
    ops = x.join(last, "doc_id").select("doc_id", F.expr(f"j div 3 * 2 + CASE WHEN {twice} THEN 1 ELSE 0 END").alias("edit"), F.explode(F.expr(f"CASE WHEN {twice} THEN array('remove', 'add') ELSE array('unchanged') END")).alias("kind"), "line")
    ops = ops.select("doc_id", "edit", "kind", F.when(F.col("kind") != "add", F.col("line")).alias("old"), F.when(F.col("kind") != "remove", F.col("line")).alias("new"))
    return long(D.churn_pairs(ops), "edit")


# anchors and links

#: Headings of four titles, of which the document lacks some and some have no id; a link for each line.
HEADINGS = f"""{SQL_LINES},
 md AS (SELECT doc_id, i, concat('Sec ', i % 4) AS title, concat('sec-', i % 4) AS base FROM l),
 mds AS (SELECT *, CASE WHEN k = 0 THEN base ELSE concat(base, '-', k) END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY i) - 1 AS k FROM md)),
 dc AS (SELECT *, CASE WHEN (doc_id + i) % 7 <> 0 THEN concat('h.', i) END AS heading_id FROM md WHERE (doc_id + i) % 5 <> 0),
 dcs AS (
   SELECT *, CASE WHEN k = 0 THEN base ELSE concat(base, '-', k) END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id, base) AS n FROM dc)),
 m AS (SELECT s.doc_id, s.i, s.slug, s.base, d.heading_id FROM mds s LEFT JOIN dcs d USING (doc_id, i)),
 alone AS (SELECT doc_id, slug, heading_id FROM dcs d WHERE heading_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mds s WHERE s.doc_id = d.doc_id AND s.slug = d.slug)),
 sure AS (SELECT doc_id, slug, heading_id FROM m WHERE heading_id IS NOT NULL UNION ALL SELECT * FROM alone),
 late AS (
   SELECT m.doc_id, m.slug, d.heading_id FROM m JOIN dcs d ON d.doc_id = m.doc_id AND d.slug = m.slug AND d.heading_id IS NOT NULL AND d.base = m.base AND d.n = 1
   WHERE m.heading_id IS NULL AND NOT EXISTS (SELECT 1 FROM sure s WHERE s.doc_id = m.doc_id AND s.heading_id = d.heading_id)),
 slug_ids AS (SELECT * FROM sure UNION ALL SELECT * FROM late),
 ln AS (SELECT doc_id, i, CASE i % 6 WHEN 0 THEN concat('sec-', i % 4) WHEN 1 THEN concat('sec-', i % 4, '-1') WHEN 2 THEN concat('h.', i) WHEN 3 THEN concat('f.', i % 3) WHEN 4 THEN 'nope' ELSE concat('sec-', i % 4, '-', 1 + i % 9) END AS target FROM l)"""


def heading_sides(spark, d):
    md = line_rows(spark, d).selectExpr("doc_id", "i AS j", "concat('Sec ', i % 4) AS title")
    doc = md.where("(doc_id + j) % 5 <> 0").withColumn("heading_id", F.expr("CASE WHEN (doc_id + j) % 7 <> 0 THEN concat('h.', j) END"))
    pairs = doc.selectExpr("doc_id", "j AS l", "j AS r")
    return md, doc, pairs


def heading_links(spark, d):
    target = F.expr("CASE i % 6 WHEN 0 THEN concat('sec-', i % 4) WHEN 1 THEN concat('sec-', i % 4, '-1') WHEN 2 THEN concat('h.', i) WHEN 3 THEN concat('f.', i % 3) WHEN 4 THEN 'nope' ELSE concat('sec-', i % 4, '-', 1 + i % 9) END")
    return line_rows(spark, d).select("doc_id", F.col("i").alias("j"), F.lit(0).alias("k"), F.lit(False).alias("image"), F.concat(F.lit("#"), target).alias("href"))


@query("slug_ids", f"WITH {HEADINGS} SELECT doc_id, slug, heading_id FROM slug_ids")
def slug_ids(spark, d):
    """Where the markdown's slugs lead in the document: by alignment, underneath by the document's own slugs, or nowhere."""
    return L.slug_ids(*heading_sides(spark, d))


@query(
    "anchor_tiers",
    f"""WITH {HEADINGS}, sib AS (SELECT DISTINCT doc_id, concat('f.', i % 3) AS heading_id, i % 3 AS tab FROM l WHERE i % 3 <> 2)
    SELECT n.doc_id, n.i AS j, n.target,
      CASE WHEN d.heading_id IS NOT NULL THEN 'heading_id' WHEN s.heading_id IS NOT NULL THEN 'slug' WHEN f.tab IS NOT NULL THEN 'sibling_tab' ELSE 'none' END AS kind,
      CASE WHEN d.heading_id IS NOT NULL THEN n.target WHEN s.heading_id IS NOT NULL THEN s.heading_id WHEN f.tab IS NOT NULL THEN n.target END AS heading_id,
      CASE WHEN d.heading_id IS NULL AND s.heading_id IS NULL THEN f.tab END AS tab
    FROM ln n LEFT JOIN dc d ON d.doc_id = n.doc_id AND d.heading_id = n.target LEFT JOIN slug_ids s ON s.doc_id = n.doc_id AND s.slug = n.target LEFT JOIN sib f ON f.doc_id = n.doc_id AND f.heading_id = n.target""",
)
def anchor_tiers(spark, d):
    md, doc, pairs = heading_sides(spark, d)
    siblings = line_rows(spark, d).where("i % 3 <> 2").selectExpr("doc_id", "concat('f.', i % 3) AS heading_id", "i % 3 AS tab").distinct()
    out = L.anchor_tiers(heading_links(spark, d), L.slug_ids(md, doc, pairs), doc, siblings)
    return long(out.drop("k"), "j", "tab")


@query(
    "dead_anchors_dry_run",
    f"""WITH {HEADINGS}, known AS (SELECT doc_id, slug FROM mds WHERE i % 2 = 0 UNION SELECT doc_id, slug FROM dcs UNION SELECT doc_id, heading_id FROM dc WHERE heading_id IS NOT NULL),
    dead AS (SELECT doc_id, target, min(i) AS first FROM ln n WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.doc_id = n.doc_id AND k.slug = n.target) GROUP BY doc_id, target)
    SELECT doc_id, target, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS place FROM dead""",
)
def dead_anchors_dry_run(spark, d):
    """Anchors that neither some of the markdown's headings nor the document's have, each link in a table's cell."""
    md, doc, _ = heading_sides(spark, d)
    level = lambda x: L.heading_slugs(x.withColumn("level", F.lit(1)))
    slugs = level(md).where("j % 2 = 0")
    content = heading_links(spark, d).select("doc_id", "j", F.concat(F.lit("| a | [x]("), "href", F.lit(") |")).alias("line"), F.lit(False).alias("in_code"))
    ids = doc.where("heading_id IS NOT NULL").select("doc_id", F.col("heading_id").alias("slug"))
    return long(L.dead_anchors(B.explode_links(content), slugs, level(doc), ids), "place")


CROSS = f"""{SQL_LINES},
 ln AS (SELECT doc_id, i, CASE i % 7 WHEN 0 THEN 'https://x.org/a.md' WHEN 1 THEN '#here' WHEN 2 THEN concat('t', i % 50, '.md') WHEN 3 THEN concat('../a/t', i % 50, '.md#sec') WHEN 4 THEN concat('./t', i % 50, '.md#no') WHEN 5 THEN concat('t', 50 + i % 9, '.md') ELSE concat('t', i % 5 * 10, '.md#sec') END AS href FROM l),
 pt AS (SELECT doc_id, concat('a/t', doc_id % 49, '.md') AS local, doc_id % 4 <> 1 AS supported, doc_id % 6 <> 2 AS fetched FROM documents WHERE doc_id < 60)"""


@query(
    "cross_doc_kinds",
    f"""WITH {CROSS},
    p AS (SELECT *, CASE WHEN i % 7 > 1 THEN concat('a/', regexp_extract(href, '(t[0-9]+\\.md)', 1)) END AS path, nullif(regexp_extract(href, '#(.*)$', 1), '') AS fragment FROM ln),
    k AS (SELECT local AS path, count(*) AS hits, min(doc_id) AS target, bool_and(supported) AS supported, bool_and(fetched) AS fetched FROM pt GROUP BY local)
    SELECT p.doc_id, p.i AS j, CASE WHEN p.path IS NULL THEN 'not_cross_doc' WHEN hits IS NULL THEN 'unmapped' WHEN hits > 1 THEN 'ambiguous' WHEN NOT supported THEN 'unsupported'
      WHEN fragment IS NOT NULL AND NOT fetched THEN 'fetch_failed' WHEN fragment = 'no' THEN 'unresolved_anchor' ELSE 'resolved' END AS kind, CASE WHEN hits = 1 THEN target END AS target_doc
    FROM p LEFT JOIN k USING (path)""",
)
def cross_doc_kinds(spark, d):
    """Every kind of link between documents, two documents of one path among the targets."""
    href = F.expr("CASE i % 7 WHEN 0 THEN 'https://x.org/a.md' WHEN 1 THEN '#here' WHEN 2 THEN concat('t', i % 50, '.md') WHEN 3 THEN concat('../a/t', i % 50, '.md#sec') WHEN 4 THEN concat('./t', i % 50, '.md#no') WHEN 5 THEN concat('t', 50 + i % 9, '.md') ELSE concat('t', i % 5 * 10, '.md#sec') END")
    links = line_rows(spark, d).select("doc_id", F.col("i").alias("j"), F.lit(0).alias("k"), F.lit(False).alias("image"), href.alias("href"), F.lit("a/self.md").alias("local"))
    paths = V.documents(spark, d).where("doc_id < 60").selectExpr("doc_id", "concat('a/t', doc_id % 49, '.md') AS local", "doc_id % 4 <> 1 AS supported", "doc_id % 6 <> 2 AS fetched")
    slugs = paths.select("doc_id", F.lit("sec").alias("slug"))
    return long(L.resolve_cross_doc(links, paths, slugs, all_links=True).select("doc_id", "j", "kind", "target_doc"), "j")


# keys, quotes, projection, code, diagrams


@query(
    "closest_config_key",
    """WITH k AS (SELECT DISTINCT CASE event_id % 5 WHEN 0 THEN upper(event_type) WHEN 1 THEN concat(event_type, 's') WHEN 2 THEN reverse(event_type) WHEN 3 THEN concat('my ', event_type, ' key') ELSE 'buy' END AS key FROM events),
    x AS (SELECT key, unnest(['Click', 'View', 'Signup', 'Purchase', 'Login']) AS k, unnest([0, 1, 2, 3, 4]) AS i FROM k),
    r AS (SELECT key, k, levenshtein(lower(key), lower(k)) AS d, row_number() OVER (PARTITION BY key ORDER BY levenshtein(lower(key), lower(k)), i) AS n FROM x)
    SELECT key, CASE WHEN key = 'buy' THEN 'Purchase' WHEN d <= 3 THEN k END AS closest FROM r WHERE n = 1""",
)
def closest_config_key(spark, d):
    """Keys of a configuration, in any case, at most 3 edits away; an alias counts before all."""
    key = F.expr("CASE event_id % 5 WHEN 0 THEN upper(event_type) WHEN 1 THEN concat(event_type, 's') WHEN 2 THEN reverse(event_type) WHEN 3 THEN concat('my ', event_type, ' key') ELSE 'buy' END")
    return K.closest_key(spark.read.parquet(f"{d}/events.parquet").select(key.alias("key")), ["Click", "View", "Signup", "Purchase", "Login"], 3, {"buy": "Purchase"}, any_case=True)


@query("quote_violations", f"WITH {SQL_LINES} SELECT doc_id, i AS pos, CASE WHEN i % 3 = 0 THEN 'quote_without_depth' ELSE 'depth_without_quote' END AS violation FROM l WHERE (i % 3 = 0) <> (i % 4 > 1)")
def quote_violations(spark, d):
    return long(Y.quote_violations(line_rows(spark, d).selectExpr("doc_id", "i AS pos", "i % 3 = 0 AS is_blockquote", "CASE WHEN i % 4 > 1 THEN i % 4 END AS quote_depth")), "pos")


# Paragraphs by number: empty, an empty quote, glyphs alone, a glyph before code or before prose, titles; the rest are plain.


@query(
    "project_blocks_rules",
    f"""WITH {SQL_LINES} SELECT doc_id, i AS pos,
      CASE WHEN i % 9 IN (3, 4) THEN line WHEN i % 9 = 1 THEN '' ELSE concat('.', line) END AS text, CASE i % 9 WHEN 5 THEN 'HEADING_1' WHEN 6 THEN 'HEADING_2' ELSE 'NORMAL_TEXT' END AS style,
      CASE i % 9 WHEN 4 THEN 'ambiguous_code_prefix' WHEN 5 THEN 'paragraph_style' WHEN 6 THEN 'paragraph_style' END AS reason
    FROM l WHERE i % 9 NOT IN (0, 2) AND NOT (i % 9 IN (3, 4) AND trim(line) = '')
    UNION ALL SELECT doc_id, i, NULL, NULL, 'empty_paragraph' FROM l WHERE i % 9 = 0
    UNION ALL SELECT doc_id, i, NULL, NULL, 'private_use_glyph' FROM l WHERE i % 9 = 2 OR i % 9 IN (3, 4) AND trim(line) = ''""",
)
def project_blocks_rules(spark, d):
    """Blocks with the reason they were changed or left out for, all reasons among them."""
    glyph = F.lit("\ue907")
    x = line_rows(spark, d).withColumns({"pos": F.col("i"), "m": F.col("i") % 9})
    text = F.when(F.col("m") <= 1, "").when(F.col("m") == 2, F.concat(glyph, F.lit(" "))).when(F.col("m") <= 4, F.concat(glyph, "line")).otherwise(F.concat(F.lit("."), "line"))
    style = F.when(F.col("m") == 5, "TITLE").when(F.col("m") == 6, "SUBTITLE").otherwise("NORMAL_TEXT")
    blocks = x.select("doc_id", "pos", text.alias("text"), style.alias("style"), (F.col("m") == 1).cast("int").alias("quote_depth"), F.when(F.col("m").isin(3, 4), glyph).otherwise("").alias("render_prefix"), (F.col("m") == 3).alias("mono"))
    good, residue = B.project_blocks(blocks)
    return long(good.select("doc_id", "pos", "text", "style").join(residue, ["doc_id", "pos"], "full"), "pos")


#: Paragraphs that are code, blank, a line that names a language, or prose.
SHAPES = "CASE (doc_id * 5 + i * 7) % 10 WHEN 0 THEN 'c' WHEN 1 THEN 'c' WHEN 2 THEN 'c' WHEN 3 THEN 'b' WHEN 4 THEN 'b' WHEN 5 THEN 'm' WHEN 6 THEN CASE i % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'b' ELSE 'c' END WHEN 7 THEN 'c' WHEN 8 THEN CASE i % 2 WHEN 0 THEN 'c' ELSE 'm' END ELSE 't' END"


@query(
    "code_blocks",
    f"""WITH {SQL_LINES}, s AS (SELECT doc_id, i, {SHAPES} AS s FROM l),
    w AS (SELECT *, last_value(CASE WHEN s <> 'b' THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv,
      first_value(CASE WHEN s <> 'b' THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS p1, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS n1, lead(s, 2) OVER (PARTITION BY doc_id ORDER BY i) AS n2 FROM s),
    r AS (SELECT *, s = 'c' OR s = 'b' AND coalesce(pv = 'c' AND nx = 'c', false) AS ins FROM w),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS isl FROM r WHERE ins),
    b AS (SELECT doc_id, min(i) AS a, max(i) AS z, count(*) AS n, arg_min(p1, i) AS p FROM g GROUP BY doc_id, isl)
    SELECT doc_id, a - CASE WHEN p = 'm' THEN 1 ELSE 0 END AS first_pos, z AS last_pos, CASE WHEN p = 'm' THEN concat('x', a - 1) END AS lang, n FROM b
    UNION ALL SELECT doc_id, i, i + 1, concat('x', i), 0 FROM w WHERE s = 'm' AND n1 = 'b' AND coalesce(n2 <> 'c', true)""",
)
def code_blocks(spark, d):
    """Code blocks among paragraphs: with blank lines inside, with a language, empty."""
    nodes = line_rows(spark, d).withColumn("s", F.expr(SHAPES))
    text = F.when(F.col("s") == "m", F.concat(F.lit("```x"), F.col("i").cast("string"))).when(F.col("s") == "b", "").otherwise(F.col("line"))
    return long(B.grouped_code(nodes.select("doc_id", F.col("i").alias("pos"), text.alias("text"), (F.col("s") == "c").alias("code"), (F.col("s") == "b").alias("blank"))), "first_pos", "last_pos", "n")


@query("mermaid_diagrams", f"WITH {SQL_LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, concat('graph ', i, chr(10), line) AS code, left(sha256(concat('graph ', i, chr(10), line)), 12) AS key FROM l WHERE i % 3 = 1")
def mermaid_diagrams(spark, d):
    """A diagram for every third line, other fences and plain lines between."""
    line = "CASE i % 3 WHEN 0 THEN concat('```sql\\n', line, '\\n```') WHEN 1 THEN concat('```mermaid\\ngraph ', i, '\\n', line, '\\n```') ELSE line END"
    docs = V.documents(spark, d).select("doc_id", F.expr(f"array_join(transform(split(text, '\\n', -1), (line, i) -> {line}), '\\n')").alias("content"))
    return long(B.mermaid_diagrams(docs), "k")


# pages

#: Pieces of a page by a line's number, and the text that each should become.
PIECES = [
    ("concat('<p>', q, ' caf&eacute; &#39;x&#39;&nbsp;&amp;lt; &lt;b&gt;</p>')", "concat(line, ' café ''x''' || chr(160) || '&lt; <b>')"),
    ("concat('<ul class=\"c lst-kix_ab-0\"><li style=\"margin-left:36pt\">one</li></ul>', chr(10), '<ul class=\"lst-kix_ab-1\"><li>two ', i, '</li></ul><p>', q, '</p>')", "concat('- one', chr(10), chr(9), '- two ', i, chr(10), chr(10), line)"),
    ("concat('<ul><li style=\"margin-left:36pt\">a</li><li style=\"margin-left: 108pt\">b</li><li style=\"margin-left:72pt\">c</li></ul><p>', q, '</p>')", "concat('- a', chr(10), chr(9), '- b', chr(10), chr(9), '- c', chr(10), chr(10), line)"),
    ("concat('<p><a class=\"l\" href=\"https://www.google.com/url?q=https%3A%2F%2Fe.org%2F', i, '&amp;sa=D\">go</a> ', q, '</p>')", "concat('[go](https://e.org/', i, ') ', line)"),
    ("concat('<p><a href=\"https://x.org\"><span></span></a>', q, '</p>')", "line"),
    ("concat('<div>zero', chr(8203), 'width<br>', q, '</div><style>p {}</style>')", "concat('zerowidth', chr(10), line)"),
]
_STRIP = "regexp_replace(regexp_replace(regexp_replace({0}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(
    "clean_html_rules",
    f"""WITH {SQL_LINES}, x AS (SELECT doc_id, i, CASE (doc_id + i) % 6 {' '.join(f'WHEN {k} THEN {t}' for k, (_, t) in enumerate(PIECES))} END AS t FROM l)
    SELECT doc_id, {_STRIP.format("string_agg(t, chr(10) || chr(10) ORDER BY i)")} AS text FROM x GROUP BY doc_id""",
)
def clean_html_rules(spark, d):
    """Pages made of every document's lines: lists of one class and of margins, redirects, references, empty links, invisible characters."""
    piece = f"CASE (doc_id + i) % 6 {' '.join(f'WHEN {k} THEN {h}' for k, (h, _) in enumerate(PIECES))} END".replace(" q,", " replace(replace(line, '&', '&amp;'), '<', '&lt;'),").replace("chr(8203)", "'​'")
    page = F.expr(f"concat('<html><head><title>t</title></head><body>', array_join(transform(split(text, '\\n', -1), (line, i) -> {piece}), ''), '</body></html>')")
    return V.documents(spark, d).select("doc_id", H.clean_html(page).alias("text"))


# files


@query(
    "scan_document_files",
    "SELECT concat('source=', source, '/lang=', coalesce(lang, 'none')) AS folder, sha256(text || chr(10)) AS sha, count(*) AS n FROM documents GROUP BY 1, 2",
)
def scan_document_files(spark, d):
    """Documents written one a file, a folder for each source and language, and scanned: one row a file, with its folder."""
    folder = shared_folder(spark, "docs")
    files.write_each(V.documents(spark, d).select("source", F.coalesce("lang", F.lit("none")).alias("lang"), "text"), folder, "text", ["source", "lang"])
    found = files.scan_documents(spark, folder)
    return found.select(files.folder_of(F.col("path"), folder).alias("folder"), F.sha2("content", 256).alias("sha")).groupBy("folder", "sha").agg(F.count("*").alias("n"))


@query(
    "scan_image_files",
    """SELECT concat('page_id=', page_id) AS folder, CASE page_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/bmp' WHEN 4 THEN 'image/svg+xml' WHEN 5 THEN 'image/webp' END AS kind
    FROM pages WHERE 13 + length(url) <= 64""",
)
def scan_image_files(spark, d):
    """Image files of every kind, written and scanned; those over the limit, here 64 bytes, are not even read."""
    head = F.expr("CASE page_id % 7 WHEN 0 THEN X'89504E470D0A1A0A' WHEN 1 THEN X'FFD8FFE000000000' WHEN 2 THEN X'4749463839610000' WHEN 3 THEN X'424D000000000000' WHEN 4 THEN cast('<svg>   ' AS binary) WHEN 5 THEN X'5249464600000000' ELSE X'0000000000000000' END")
    tail = F.concat(F.when(F.col("page_id") % 7 == 5, "WEBP").otherwise("...."), F.col("url"))
    folder = shared_folder(spark, "images")
    files.write_each(V.pages(spark, d).select("page_id", F.concat(head, tail.cast("binary")).alias("content")), folder, "content", ["page_id"])
    return files.scan_images(spark, folder, largest=64).select(files.folder_of(F.col("path"), folder).alias("folder"), "kind")


@query(
    "file_moves_common_name",
    """WITH tr AS (SELECT DISTINCT concat(source, '/', doc_id, '/README.md') AS path FROM documents WHERE doc_id % 3 <> 0), cu AS (SELECT DISTINCT concat('new/', lpad(cast(doc_id AS varchar), 9, '0'), '/README.md') AS path FROM documents WHERE doc_id % 3 = 0),
    a AS (SELECT path, row_number() OVER (ORDER BY path) AS k FROM tr), b AS (SELECT path AS new_path, row_number() OVER (ORDER BY path) AS k FROM cu)
    SELECT path, new_path, CASE WHEN new_path IS NULL THEN 'deleted' ELSE 'renamed' END AS change FROM a LEFT JOIN b USING (k)""",
)
def file_moves_common_name(spark, d):
    """All files share a base name, so that every rank is counted in one group."""
    docs = V.documents(spark, d)
    tracked = docs.where("doc_id % 3 <> 0").selectExpr("concat(source, '/', doc_id, '/README.md') AS path", "'synced' AS status").distinct()
    current = docs.where("doc_id % 3 = 0").selectExpr("concat('new/', lpad(cast(doc_id AS string), 9, '0'), '/README.md') AS path")
    return Y.file_moves(tracked, current)
