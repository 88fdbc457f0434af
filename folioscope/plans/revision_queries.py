"""Queries over revisions, blocks, links, sections and comments, with their SQL for the other engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import expr as X
from folioscope.operators import blocks as B
from folioscope.operators import comments as C
from folioscope.operators import diff as D
from folioscope.operators import links as L
from folioscope.operators import sections as S
from folioscope.operators import sync as Y
from folioscope.plans import fixtures as V
from folioscope.sources.tables import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


BASE, OURS, THEIRS = V.SQL_BASE, f"{V.SQL_BASE}, {V.SQL_OURS}", f"{V.SQL_BASE}, {V.SQL_THEIRS}"
BOTH = f"{V.SQL_BASE}, {V.SQL_OURS}, {V.SQL_THEIRS}"
#: Lines of the base with a flag for code; the given fences are all plain.
LINES = f"""{BASE}, {V.sql_lines('base')}, flagged AS (SELECT doc_id, j, line, line LIKE '```%' OR sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY j) % 2 = 1 AS in_code FROM base_lines)"""
#: Blocks of the base: what blank lines outside code part.
BLOCKS = (
    LINES
    + r""", m AS (SELECT *, (NOT in_code AND NOT regexp_matches(line, '\S')) AS blank, (NOT in_code AND regexp_matches(line, '^#{1,6} ')) AS heading FROM flagged),
 p AS (SELECT *, coalesce(lag(blank) OVER w, true) AS pb, coalesce(lag(heading) OVER w, true) AS ph, coalesce(lag(in_code) OVER w, false) AS pc FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
 s AS (SELECT *, (NOT blank AND (pb OR ph OR heading OR in_code <> pc)) AS st FROM p),
 b AS (SELECT *, sum(st::int) OVER (PARTITION BY doc_id ORDER BY j) AS bn FROM s),
 blocks AS (SELECT doc_id, bn - 1 AS pos, min(j) AS first_line, string_agg(line, chr(10) ORDER BY j) AS text, bool_or(in_code) AS in_code FROM b WHERE NOT blank OR in_code GROUP BY doc_id, bn)"""
)
KIND = r"""CASE WHEN regexp_matches(text, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(text, '^```mermaid') THEN 'mermaid' WHEN regexp_matches(text, '^(```|~~~)') THEN 'code' WHEN text LIKE '<details%' THEN 'details'
 WHEN text LIKE '>%' THEN 'quote' WHEN regexp_matches(text, '^\s*[-*+] \[[ xX]\] ') THEN 'task_list' WHEN regexp_matches(text, '^\s*[-*+] ') THEN 'bullets' WHEN regexp_matches(text, '^\s*[0-9]+[.)] ') THEN 'ordered'
 WHEN regexp_matches(text, '^(-{3,}|\*{3,}|_{3,})\s*$') THEN 'rule' WHEN regexp_matches(text, '^\|.*\|\s*\n\|[ :|-]+\|') THEN 'table' WHEN regexp_matches(text, '^https?://\S+$') THEN 'embed' WHEN regexp_matches(text, '^\{[a-z-]+(:[^}]*)?\}') THEN 'macro' ELSE 'paragraph' END"""
TYPED = f"{BLOCKS}, typed AS (SELECT *, {KIND} AS kind FROM blocks)"
HEADS = LINES + r""", heads AS (SELECT doc_id, j, length(regexp_extract(line, '^(#+)', 1)) AS level, regexp_replace(regexp_extract(line, '^#+ (.*)$', 1), '^\s+|\s+$', '', 'g') AS title FROM flagged WHERE NOT in_code AND regexp_matches(line, '^#{1,6} '))"""
SLUG = r"replace(regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\-_ ]', '', 'g'), ' ', '-')"
SLUGS = HEADS + f", sl0 AS (SELECT *, {SLUG.format('title')} AS base FROM heads), sl1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY j) - 1 AS nth FROM sl0), slugs AS (SELECT doc_id, j, level, title, CASE WHEN nth = 0 THEN base ELSE concat(base, '-', nth) END AS slug FROM sl1)"
LINKS = r""", found AS (SELECT doc_id, j, regexp_extract_all(regexp_replace(line, '`[^`]*`', '', 'g'), '(!?\[[^\]]*\]\([^)\s]*\))', 1) AS ms FROM flagged WHERE NOT in_code AND contains(line, '](')),
 links AS (SELECT doc_id, j, k, m LIKE '!%' AS image, regexp_extract(m, '\[([^\]]*)\]', 1) AS label, regexp_extract(m, '\(([^)\s]*)\)$', 1) AS href FROM (SELECT doc_id, j, generate_subscripts(ms, 1) - 1 AS k, unnest(ms) AS m FROM found)),
 anchors AS (SELECT *, url_decode(substr(href, 2)) AS target FROM links WHERE NOT image AND href LIKE '#_%')"""
SECTIONS = LINES + r""", secs AS (SELECT *, coalesce(sum((NOT in_code AND regexp_matches(line, '^#{2} '))::int) OVER (PARTITION BY doc_id ORDER BY j), 0) AS section, (NOT in_code AND regexp_matches(line, '^#{2} ')) AS head FROM flagged),
 sections AS (SELECT doc_id, section, min(j) AS first_line, count(*) AS n_lines, coalesce(max(CASE WHEN head THEN regexp_extract(line, '^#+ (.*)$', 1) END), '') AS title, string_agg(line, chr(10) ORDER BY j) AS text FROM secs GROUP BY doc_id, section)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    return B.lines(V.base(spark, d))


def typed(spark: SparkSession, d: str) -> DataFrame:
    return B.classify_blocks(B.split_blocks(lines(spark, d)))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return L.heading_slugs(B.headings(lines(spark, d)))


def section_texts(spark: SparkSession, d: str) -> DataFrame:
    return S.section_texts(lines(spark, d), 2)


# sync


@query(
    "sync_action",
    f"WITH {OURS}, {V.SQL_MAPPINGS}, {V.SQL_STATE}, {V.SQL_REMOTE}, x AS (SELECT m.doc_id, m.local, s.doc_id IS NOT NULL AS known, r.version, r.version IS DISTINCT FROM s.remote_version AS rc, sha256(o.content) <> s.local_hash AS lc FROM mappings m LEFT JOIN state s USING (doc_id) LEFT JOIN remote r USING (doc_id) LEFT JOIN ours o USING (doc_id)) "
    "SELECT doc_id, local, CASE WHEN version IS NULL THEN 'error' WHEN NOT known THEN 'first-sync' WHEN NOT rc AND NOT lc THEN 'up-to-date' WHEN NOT lc THEN 'fast-forward' WHEN NOT rc THEN 'local-only' ELSE 'merged' END AS action FROM x",
)
def sync_action(spark, d):
    return Y.sync_action(V.mappings(spark, d), V.state(spark, d), Y.with_hash(V.ours(spark, d)), V.remote(spark, d))


@query("run_summary", ORACLES["sync_action"].replace("SELECT doc_id, local, CASE", "SELECT r, count_if(s = 'success') AS success, count_if(s = 'conflict') AS conflict, count_if(s = 'error') AS error, count_if(s = 'skipped') AS skipped FROM (SELECT doc_id % 4 AS r, CASE a WHEN 'error' THEN 'error' WHEN 'merged' THEN 'conflict' WHEN 'up-to-date' THEN 'skipped' ELSE 'success' END AS s FROM (SELECT doc_id, local, CASE", 1).replace(" END AS action FROM x", " END AS a FROM x)) GROUP BY r", 1))
def run_summary(spark, d):
    status = F.when(F.col("action") == "merged", "conflict").when(F.col("action") == "up-to-date", "skipped").when(F.col("action") == "error", "broken").otherwise("success")
    return Y.run_summary(sync_action(spark, d).select((F.col("doc_id") % 4).alias("r"), status.alias("status")), "r")


@query("load_mappings", f"WITH {V.SQL_MAPPINGS} SELECT doc_id, local, remote_id, direction FROM mappings WHERE remote_id IS NOT NULL")
def load_mappings(spark, d):
    from folioscope.sources.mappings import clean_mappings

    raw = V.mappings(spark, d).selectExpr("doc_id AS ` Doc_ID `", "concat(' ', local, ' ') AS `LOCAL`", "coalesce(concat(remote_id, ' '), '  ') AS `Remote_Id`", "direction AS ` direction`")
    return clean_mappings(raw, ["doc_id", "local", "remote_id", "direction"], ["local", "remote_id"]).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("scan_documents", f"WITH {BASE} SELECT concat(source, '/', lang, '/', doc_id, '.md') AS path, sha256(content) AS sha, length(content) AS n_chars FROM base")
def scan_documents(spark, d):
    return V.base(spark, d).select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.sha2("content", 256).alias("sha"), F.length("content").cast("long").alias("n_chars"))


@query("state_upsert", f"WITH {OURS}, {V.SQL_STATE}, nw AS (SELECT doc_id, sha256(content) AS local_hash FROM ours WHERE doc_id % 3 <> 0) SELECT doc_id, local_hash FROM state WHERE doc_id NOT IN (SELECT doc_id FROM nw) UNION ALL SELECT * FROM nw")
def state_upsert(spark, d):
    new = V.ours(spark, d).select("doc_id", F.sha2("content", 256).alias("local_hash"), F.when(F.col("doc_id") % 3 == 0, "error").when(F.col("doc_id") % 3 == 1, "ok").otherwise("warning").alias("status"))
    return Y.state_upsert(V.state(spark, d).select("doc_id", "local_hash"), new, "doc_id")


@query("blob_store", f"WITH {OURS} SELECT sha256(content) AS sha, any_value(length(content)) AS n_chars FROM ours WHERE sha256(content) NOT IN (SELECT sha256(content) FROM base WHERE doc_id % 2 = 0) GROUP BY 1")
def blob_store(spark, d):
    store = V.base(spark, d).where("doc_id % 2 = 0").select(F.sha2("content", 256).alias("sha"))
    return Y.new_blobs(V.ours(spark, d), store).select("sha", F.length("content").cast("long").alias("n_chars"))


@query("select_mappings", f"WITH {V.SQL_MAPPINGS}, files AS (SELECT DISTINCT CASE WHEN doc_id % 11 = 0 THEN concat(local, '/01-intro.md') ELSE local END AS file FROM mappings), hit AS (SELECT f.file, m.doc_id, m.local, m.direction, row_number() OVER (PARTITION BY f.file ORDER BY m.doc_id, m.local, m.direction) AS k FROM files f JOIN mappings m ON m.local = f.file OR (m.sectioned AND m.local || '/01-intro.md' = f.file)) SELECT file, doc_id, local, direction FROM hit WHERE k = 1")
def select_mappings(spark, d):
    m = V.mappings(spark, d)
    files = m.select(F.when(F.col("doc_id") % 11 == 0, F.concat("local", F.lit("/01-intro.md"))).otherwise(F.col("local")).alias("file")).distinct()
    return Y.select_mappings(m, files)


@query("mapping_violations", f"WITH {V.SQL_MAPPINGS} SELECT doc_id, unnest(list_filter([CASE WHEN NOT regexp_matches(split_level, '^HEADING_[1-6]$') THEN 'split_level' END, CASE WHEN sectioned AND split_level IS NULL THEN 'sectioned_without_level' END, CASE WHEN NOT sectioned AND split_level IS NOT NULL THEN 'level_without_sectioned' END, CASE WHEN sectioned AND backend = 'b2' THEN 'backend_lacks_sections' END], lambda x: x IS NOT NULL)) AS violation FROM mappings")
def mapping_violations(spark, d):
    return Y.mapping_violations(V.mappings(spark, d))


@query("file_moves", "WITH tr AS (SELECT DISTINCT concat(source, '/', doc_id, '.md') AS path, CASE WHEN doc_id % 10 = 0 THEN 'deleted' ELSE 'synced' END AS status FROM documents), cu AS (SELECT DISTINCT concat(CASE WHEN doc_id % 7 = 0 THEN lang ELSE source END, '/', doc_id, '.md') AS path FROM documents WHERE doc_id % 13 <> 0), g AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM tr WHERE status <> 'deleted' AND path NOT IN (SELECT path FROM cu)), f AS (SELECT path AS new_path, regexp_extract(path, '([^/]*)$', 1) AS name FROM cu WHERE path NOT IN (SELECT path FROM tr)) SELECT g.path, f.new_path, CASE WHEN f.new_path IS NULL THEN 'deleted' ELSE 'renamed' END AS change FROM g LEFT JOIN f USING (name)")
def file_moves(spark, d):
    docs = V.documents(spark, d)
    tracked = docs.selectExpr("concat(source, '/', doc_id, '.md') AS path", "CASE WHEN doc_id % 10 = 0 THEN 'deleted' ELSE 'synced' END AS status").distinct()
    current = docs.where("doc_id % 13 <> 0").selectExpr("concat(CASE WHEN doc_id % 7 = 0 THEN lang ELSE source END, '/', doc_id, '.md') AS path")
    return Y.file_moves(tracked, current)


@query("tracked_path_diff", "SELECT concat(source, '/', doc_id) AS path FROM documents EXCEPT SELECT concat(source, '/', doc_id) FROM documents WHERE doc_id % 13 <> 0")
def tracked_path_diff(spark, d):
    p = V.documents(spark, d).selectExpr("doc_id", "concat(source, '/', doc_id) AS path")
    return Y.tracked_path_diff(p, p.where("doc_id % 13 <> 0"))


@query("status_lists", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'deleted' ELSE 'synced' END AS status, source, count(*) AS n FROM documents GROUP BY ALL")
def status_lists(spark, d):
    return V.documents(spark, d).selectExpr("CASE WHEN doc_id % 10 = 0 THEN 'deleted' ELSE 'synced' END AS status", "source").groupBy("status", "source").agg(F.count("*").alias("n"))


# lines and blocks


@query("fence_flags", f"WITH {LINES} SELECT doc_id, j, line, in_code FROM flagged")
def fence_flags(spark, d):
    return long(lines(spark, d), "j")


@query("split_blocks", f"WITH {BLOCKS} SELECT doc_id, pos, first_line, text, in_code FROM blocks")
def split_blocks(spark, d):
    return B.split_blocks(lines(spark, d))


@query("classify_blocks", f"WITH {TYPED} SELECT doc_id, pos, kind FROM typed")
def classify_blocks(spark, d):
    return typed(spark, d).select("doc_id", "pos", "kind")


@query("block_rules", f"WITH {BLOCKS} SELECT doc_id, pos, CASE WHEN contains(text, '[[') THEN 'wiki' WHEN text LIKE '#%' THEN 'heading' ELSE 'paragraph' END AS kind FROM blocks")
def block_rules(spark, d):
    return B.classify_blocks(B.split_blocks(lines(spark, d)), [("wiki", r"\[\["), ("heading", "^#")]).select("doc_id", "pos", "kind")


@query("node_stats", f"WITH {TYPED} SELECT doc_id, kind, count(*) AS n FROM typed GROUP BY ALL")
def node_stats(spark, d):
    return typed(spark, d).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("doc_report", f"WITH {TYPED} SELECT doc_id, count(*) AS blocks, sum(length(text)) AS chars, count_if(kind = 'heading') AS headings, count_if(kind = 'code') AS code, count_if(contains(text, '](')) AS with_links, count(DISTINCT kind) AS kinds FROM typed GROUP BY doc_id")
def doc_report(spark, d):
    return typed(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "code").alias("code"), F.count_if(F.col("text").contains("](")).alias("with_links"), F.count_distinct("kind").alias("kinds")
    )


@query("compare_structure", f"WITH {BOTH}, a AS (SELECT doc_id, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}} '))) AS h, len(list_filter(string_split(content, chr(10)), lambda x: x LIKE '- %')) AS l, len(list_filter(string_split(content, chr(10)), lambda x: x LIKE '```%')) AS c FROM ours), b AS (SELECT doc_id, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}} '))) AS h, len(list_filter(string_split(content, chr(10)), lambda x: x LIKE '- %')) AS l, len(list_filter(string_split(content, chr(10)), lambda x: x LIKE '```%')) AS c FROM theirs), d AS (SELECT doc_id, unnest(['headings', 'items', 'fences']) AS feature, unnest([a.h, a.l, a.c]) AS expected, unnest([b.h, b.l, b.c]) AS actual FROM a JOIN b USING (doc_id)) SELECT doc_id, feature, expected, actual, CASE WHEN abs(expected - actual) > 2 THEN 'high' ELSE 'medium' END AS severity FROM d WHERE expected <> actual")
def compare_structure(spark, d):
    from folioscope.operators.tree import compare_structure as compare

    return compare(V.ours(spark, d), V.theirs(spark, d))


@query("explode_links", f"WITH {LINES}{LINKS} SELECT doc_id, j, k, image, label, href FROM links")
def explode_links(spark, d):
    return long(B.explode_links(lines(spark, d)), "j", "k")


@query("extract_refs", f"WITH {LINES}{LINKS} SELECT href, image, count(*) AS n, count(DISTINCT doc_id) AS docs FROM links GROUP BY ALL")
def extract_refs(spark, d):
    return B.explode_links(lines(spark, d)).groupBy("href", "image").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("explode_cells", f"WITH {TYPED}, r AS (SELECT doc_id, pos, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\|[ :|-]+\\|\\s*$')) AS rows FROM typed WHERE kind = 'table'), q AS (SELECT doc_id, pos, generate_subscripts(rows, 1) - 1 AS row, unnest(rows) AS t FROM r), c AS (SELECT doc_id, pos, row, string_split(regexp_replace(t, '^\\||\\|$', '', 'g'), '|') AS cs FROM q) SELECT doc_id, pos, row, generate_subscripts(cs, 1) - 1 AS col, trim(unnest(cs)) AS cell FROM c")
def explode_cells(spark, d):
    return long(B.explode_cells(typed(spark, d)), "row", "col")


@query("code_runs", f"WITH {LINES}, g AS (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS g FROM flagged WHERE in_code) SELECT doc_id, min(j) AS first_line, max(j) AS last_line, count(*) AS n_lines FROM g GROUP BY doc_id, g")
def code_runs(spark, d):
    return B.code_runs(lines(spark, d))


@query("quote_runs", f"WITH {LINES}, g AS (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS g FROM flagged WHERE NOT in_code AND line LIKE '>%') SELECT doc_id, min(j) AS first_line, max(j) AS last_line, count(*) AS n_lines FROM g GROUP BY doc_id, g")
def quote_runs(spark, d):
    return B.quote_runs(lines(spark, d))


@query("precedes_boundary", f"WITH {TYPED}, n AS (SELECT doc_id, pos, lead(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM typed) SELECT doc_id, pos, next FROM n WHERE next IN ('table', 'rule')")
def precedes_boundary(spark, d):
    return B.precedes_boundary(typed(spark, d))


@query("merge_spans", f"WITH {TYPED}, n AS (SELECT doc_id, pos, kind AS style, text, CASE WHEN row_number() OVER w = 1 OR kind <> lag(kind) OVER w THEN 1 ELSE 0 END AS nw FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), r AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM n) SELECT doc_id, k, style, string_agg(text, '' ORDER BY pos) AS text FROM r GROUP BY doc_id, k, style")
def merge_spans(spark, d):
    return long(B.merge_spans(typed(spark, d).select("doc_id", "pos", F.col("kind").alias("style"), "text")), "k")


@query("project_blocks", f"WITH {TYPED} SELECT kind AS reason, count(*) AS n FROM (SELECT CASE WHEN pos = 0 THEN 'paragraph_style' END AS kind FROM typed) WHERE kind IS NOT NULL GROUP BY kind")
def project_blocks(spark, d):
    style = F.when(F.col("pos") == 0, "TITLE").otherwise("NORMAL_TEXT")
    _, residue = B.project_blocks(typed(spark, d).select("doc_id", "pos", "text", style.alias("style"), F.lit(0).alias("quote_depth")))
    return residue.groupBy("reason").agg(F.count("*").alias("n"))


@query("blocks_to_markdown", f"WITH {BLOCKS} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS content FROM blocks GROUP BY doc_id")
def blocks_to_markdown(spark, d):
    return B.blocks_to_markdown(B.split_blocks(lines(spark, d)))


@query("drop_title_heading", f"WITH {BLOCKS}, f AS (SELECT doc_id, min(pos) AS pos FROM blocks WHERE text LIKE '# %' GROUP BY doc_id), h AS (SELECT f.doc_id, f.pos FROM f JOIN blocks b ON b.doc_id = f.doc_id AND b.pos = f.pos JOIN documents t ON t.doc_id = f.doc_id WHERE regexp_replace(regexp_extract(b.text, '^# (.*)', 1), '^\\s+|\\s+$', '', 'g') = regexp_replace(string_split(t.text, chr(10))[1], '^\\s+|\\s+$', '', 'g')) SELECT doc_id, count(*) AS n FROM blocks WHERE (doc_id, pos) NOT IN (SELECT (doc_id, pos) FROM h) GROUP BY doc_id")
def drop_title_heading(spark, d):
    titles = V.documents(spark, d).select("doc_id", X.strip(F.get(F.split("text", "\n"), F.lit(0))).alias("title"))
    return B.drop_title_heading(B.split_blocks(lines(spark, d)), titles).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("markdown_to_plain", f"WITH {BASE} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?s)```.*?(```|$)', '', 'g'), '`([^`]*)`', '\\1', 'g'), '!\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^#{{1,6}} +', '', 'g'), '\\*\\*\\*([^*]+)\\*\\*\\*', '\\1', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g'), '~~([^~]+)~~', '\\1', 'g'), '(?m)^> ?', '', 'g'), '(?m)^[ \\t]*[-*+] (\\[[ xX]\\] )?', '', 'g'), '(?m)^[ \\t]*[0-9]+[.)] ', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS plain FROM base")
def markdown_to_plain(spark, d):
    return V.base(spark, d).select("doc_id", B.markdown_to_plain(F.col("content")).alias("plain"))


# headings, anchors, links


@query("heading_slugs", f"WITH {SLUGS} SELECT doc_id, j, slug FROM slugs")
def heading_slugs(spark, d):
    return long(slugs(spark, d).select("doc_id", "j", "slug"), "j")


@query("slugify", f"SELECT DISTINCT {SLUG.format('text')} AS slug FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents)")
def slugify(spark, d):
    return V.documents(spark, d).select(F.explode(F.split("text", "\n")).alias("t")).select(X.slugify(F.col("t")).alias("slug")).distinct()


IDS = SLUGS + ", ids AS (SELECT doc_id, j, concat('h.', left(md5(concat(doc_id, ':', j)), 12)) AS heading_id, slug FROM slugs WHERE j % 23 <> 0)"


def heading_ids(spark, d):
    s = slugs(spark, d).where("j % 23 <> 0")
    return s.select("doc_id", "j", F.expr("concat('h.', left(md5(concat(doc_id, ':', j)), 12))").alias("heading_id"), "slug")


@query("resolve_anchors", f"WITH {IDS}{LINKS} SELECT a.doc_id, a.j, a.k, a.target, CASE WHEN EXISTS (SELECT 1 FROM ids i WHERE i.doc_id = a.doc_id AND i.heading_id = a.target) THEN 'heading_id' WHEN EXISTS (SELECT 1 FROM slugs s WHERE s.doc_id = a.doc_id AND s.slug = a.target) THEN 'slug' ELSE 'none' END AS kind FROM anchors a")
def resolve_anchors(spark, d):
    return long(L.resolve_anchors(B.explode_links(lines(spark, d)), slugs(spark, d), heading_ids(spark, d)), "j", "k")


DEAD = SLUGS + LINKS + ", dead AS (SELECT doc_id, target, row_number() OVER (PARTITION BY doc_id ORDER BY min(j * 1000 + k)) AS place FROM anchors a WHERE NOT EXISTS (SELECT 1 FROM slugs s WHERE s.doc_id = a.doc_id AND s.slug = a.target) GROUP BY doc_id, target)"


@query("dead_anchors", f"WITH {DEAD} SELECT doc_id, target, place FROM dead")
def dead_anchors(spark, d):
    return long(L.dead_anchors(B.explode_links(lines(spark, d)), slugs(spark, d)), "place")


@query("top5_anchors", f"WITH {DEAD} SELECT doc_id, coalesce(string_agg(CASE WHEN place <= 5 THEN target END, ', ' ORDER BY place), '') AS shown, greatest(count(*) - 5, 0) AS more FROM dead GROUP BY doc_id")
def top5_anchors(spark, d):
    return long(L.top_dead_anchors(L.dead_anchors(B.explode_links(lines(spark, d)), slugs(spark, d))), "more")


@query("first_use_order", f"WITH {LINES}{LINKS} SELECT doc_id, href, row_number() OVER (PARTITION BY doc_id ORDER BY min(j * 1000 + k)) AS place FROM links GROUP BY doc_id, href")
def first_use_order(spark, d):
    return long(L.first_use_order(B.explode_links(lines(spark, d))), "place")


@query("available_anchors", f"WITH {SLUGS} SELECT DISTINCT doc_id, slug FROM slugs WHERE slug <> '' EXCEPT SELECT doc_id, slug FROM slugs WHERE j % 23 = 0")
def available_anchors(spark, d):
    s = slugs(spark, d)
    return L.available_anchors(s, s.where("j % 23 = 0"))


@query("resolve_cross_doc", f"WITH {SLUGS}{LINKS}, {V.SQL_MAPPINGS}, p AS (SELECT doc_id, concat(lang, '/', doc_id % 997, '.md') AS local FROM documents), x AS (SELECT l.doc_id, l.j, l.k, concat(regexp_extract(l.href, '^\\.\\./([^#]*)', 1)) AS path, nullif(regexp_extract(l.href, '#(.*)$', 1), '') AS fragment FROM links l WHERE NOT image AND l.href LIKE '../%'), n AS (SELECT local, count(*) AS hits, min(doc_id) AS target_doc FROM p GROUP BY local) SELECT x.doc_id, x.j, x.k, x.path, x.fragment, CASE WHEN n.hits IS NULL THEN 'unmapped' WHEN n.hits > 1 THEN 'ambiguous' WHEN x.fragment IS NOT NULL AND NOT EXISTS (SELECT 1 FROM slugs s WHERE s.doc_id = n.target_doc AND s.slug = x.fragment) THEN 'unresolved_anchor' ELSE 'resolved' END AS kind, CASE WHEN n.hits = 1 THEN n.target_doc END AS target_doc FROM x LEFT JOIN n ON n.local = x.path")
def resolve_cross_doc(spark, d):
    paths = V.documents(spark, d).selectExpr("doc_id", "concat(lang, '/', doc_id % 997, '.md') AS local")
    links = B.explode_links(lines(spark, d)).join(paths, "doc_id")
    return long(L.resolve_cross_doc(links, paths, slugs(spark, d)), "j", "k")


@query("resolve_wikilinks", f"WITH {LINES}, w AS (SELECT doc_id, j, regexp_extract_all(line, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1) AS ms FROM flagged WHERE NOT in_code AND contains(line, '[[')), x AS (SELECT doc_id, j, generate_subscripts(ms, 1) - 1 AS k, unnest(ms) AS target FROM w), pg AS (SELECT CASE page_id % 3 WHEN 0 THEN concat('Doc ', page_id) WHEN 1 THEN concat('DOC ', page_id) ELSE concat('doc-', page_id) END AS title, page_id FROM pages) SELECT x.doc_id, x.j, x.k, x.target, coalesce(a.page_id, b.page_id, c.page_id) AS page_id, CASE WHEN a.page_id IS NOT NULL THEN 1 WHEN b.page_id IS NOT NULL THEN 2 WHEN c.page_id IS NOT NULL THEN 3 END AS tier FROM x LEFT JOIN pg a ON a.title = x.target LEFT JOIN pg b ON lower(b.title) = lower(x.target) LEFT JOIN pg c ON replace(lower(c.title), ' ', '-') = replace(lower(x.target), ' ', '-')")
def resolve_wikilinks(spark, d):
    p = V.pages(spark, d).selectExpr("CASE page_id % 3 WHEN 0 THEN concat('Doc ', page_id) WHEN 1 THEN concat('DOC ', page_id) ELSE concat('doc-', page_id) END AS title", "page_id")
    return long(L.resolve_wikilinks(lines(spark, d), p), "j", "k", "tier")


@query("upgrade_anchors", f"WITH {LINES}{LINKS} SELECT DISTINCT doc_id, j, replace(line, '](#section-2)', '](#part-1)') AS line FROM flagged JOIN (SELECT DISTINCT doc_id, j FROM anchors WHERE target = 'section-2') USING (doc_id, j)")
def upgrade_anchors(spark, d):
    ls = lines(spark, d)
    ids = V.documents(spark, d).select("doc_id", F.lit("section-2").alias("heading_id"), F.lit("part-1").alias("slug"))
    return long(L.upgrade_anchors(ls, B.explode_links(ls), ids), "j")


@query("duplicate_images", f"WITH {LINES}{LINKS} SELECT regexp_extract(href, '([^/?#]*)([?#].*)?$', 1) AS name, count(DISTINCT href) AS sources, count(DISTINCT doc_id) AS docs FROM links WHERE image GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def duplicate_images(spark, d):
    x = B.explode_links(lines(spark, d)).where("image").withColumn("name", F.regexp_extract("href", r"([^/?#]*)([?#].*)?$", 1))
    return x.groupBy("name").agg(F.count_distinct("href").alias("sources"), F.count_distinct("doc_id").alias("docs")).where("docs > 1")


# sections


SPLIT = SECTIONS + r""",
 ranked AS (
   SELECT doc_id, count(*) AS n_lines, max(rank) AS deepest, coalesce(bool_or(rank = 2), false) AS split
   FROM (SELECT doc_id, CASE WHEN NOT in_code THEN nullif(length(regexp_extract(line, '^(#{1,6}) ', 1)), 0) END AS rank FROM flagged)
   GROUP BY doc_id),
 stuck AS (SELECT * FROM ranked WHERE deepest IS NOT NULL AND NOT split),
 parts AS (
   SELECT doc_id, section, first_line, n_lines, title, text FROM sections WHERE doc_id NOT IN (SELECT doc_id FROM stuck)
   UNION ALL
   SELECT doc_id, 0, NULL, 0, '', '' FROM sections GROUP BY doc_id HAVING min(section) > 0)"""


@query(
    "split_sections",
    f"""WITH {SPLIT}
    SELECT doc_id, section, first_line, n_lines, title, NULL::varchar AS error FROM parts
    UNION ALL
    SELECT doc_id, NULL, NULL, n_lines, '', concat('no heading of level 2; the deepest is of level ', deepest) FROM stuck""",
)
def split_sections(spark, d):
    return long(S.split_sections(lines(spark, d), 2), "section")


#: Slugs of titles, repeats numbered; no suffixed name of these titles meets another title.
NAMES = (
    SPLIT
    + f""",
 sluggish AS (SELECT *, CASE WHEN section = 0 THEN 'preamble' ELSE {SLUG.format('title')} END AS base FROM parts),
 repeated AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section > 0, base ORDER BY section) - 1 AS nth FROM sluggish),
 slugged AS (SELECT *, CASE WHEN nth = 0 THEN base ELSE concat(base, '-', nth) END AS slug FROM repeated),
 names AS (
   SELECT doc_id, section, title, slug, text,
     concat(lpad(cast(section AS varchar), greatest(2, length(cast(max(section) OVER (PARTITION BY doc_id) AS varchar)))::int, '0'),
       '-', CASE WHEN slug = '' THEN 'section' ELSE slug END, '.md') AS filename
   FROM slugged)"""
)


def manifest(spark, d, sections=None):
    s = kept(S.section_slugs(S.split_sections(lines(spark, d), 2) if sections is None else sections))
    return s.join(S.section_files(s), ["doc_id", "section"])


def earlier(m):
    """The manifest before: every third section had another title, every second a slug from an older rule."""
    title = F.when((F.col("doc_id") + F.col("section")) % 3 == 0, F.concat(F.lit("Old "), "title")).otherwise(F.col("title"))
    slug = F.when((F.col("doc_id") + F.col("section")) % 2 == 0, F.concat("slug", F.lit("-legacy"))).otherwise(F.col("slug"))
    return m.select("doc_id", F.concat(F.lit("h."), F.col("section").cast("string")).alias("heading_id"), title.alias("title"), slug.alias("slug"))


@query(
    "section_slugs",
    f"""WITH {NAMES}
    SELECT doc_id, section,
      CASE WHEN section > 0 AND (doc_id + section) % 3 <> 0 AND (doc_id + section) % 2 = 0 THEN concat(slug, '-legacy') ELSE slug END AS slug
    FROM names""",
)
def section_slugs(spark, d):
    sections = kept(S.split_sections(lines(spark, d), 2))
    s = sections.withColumn("heading_id", F.concat(F.lit("h."), F.col("section").cast("string")))
    return S.section_slugs(s, earlier(manifest(spark, d, sections))).select("doc_id", F.col("section").cast("long").alias("section"), "slug")


@query("section_files", f"WITH {NAMES} SELECT doc_id, section, filename FROM names")
def section_files(spark, d):
    return long(manifest(spark, d).select("doc_id", "section", "filename"), "section")


OLD_NEW = NAMES + ", o AS (SELECT doc_id, section AS pos, CASE WHEN section % 5 = 3 THEN '' ELSE concat('h', section) END AS heading_id, slug, filename FROM names), n AS (SELECT doc_id, section AS pos, CASE WHEN section % 5 = 3 THEN '' ELSE concat('h', section) END AS heading_id, CASE WHEN section % 2 = 1 THEN concat(slug, 'x') ELSE slug END AS slug, CASE WHEN section % 3 = 0 THEN filename ELSE concat('9', filename) END AS filename FROM names WHERE (doc_id + section) % 4 <> 0)"


def old_new(spark, d):
    m = kept(manifest(spark, d))
    hid = "CASE WHEN section % 5 = 3 THEN '' ELSE concat('h', section) END AS heading_id"
    o = m.selectExpr("doc_id", "section AS pos", hid, "slug", "filename")
    n = m.where("(doc_id + section) % 4 <> 0").selectExpr("doc_id", "section AS pos", hid, "CASE WHEN section % 2 = 1 THEN concat(slug, 'x') ELSE slug END AS slug", "CASE WHEN section % 3 = 0 THEN filename ELSE concat('9', filename) END AS filename")
    return o, n


@query("section_renames", f"WITH {OLD_NEW} SELECT o.doc_id, o.heading_id, o.filename AS old_name, n.filename AS new_name, CASE WHEN o.slug = n.slug THEN 'renumbered' ELSE 'renamed' END AS kind FROM o JOIN n USING (doc_id, heading_id) WHERE heading_id <> '' AND o.filename <> n.filename")
def section_renames(spark, d):
    return Y.section_renames(*old_new(spark, d))


@query("orphan_sections", f"WITH {OLD_NEW} SELECT doc_id, pos, heading_id, filename FROM o WHERE heading_id = '' OR (doc_id, heading_id) NOT IN (SELECT (doc_id, heading_id) FROM n)")
def orphan_sections(spark, d):
    return long(Y.orphan_sections(*old_new(spark, d)), "pos")


@query("section_set_diff", f"WITH {OLD_NEW} SELECT doc_id, filename, CASE WHEN o.pos IS NULL THEN 'added' WHEN n.pos IS NULL THEN 'deleted' ELSE 'kept' END AS status FROM o FULL JOIN n USING (doc_id, filename)")
def section_set_diff(spark, d):
    return Y.section_set_diff(*old_new(spark, d))


@query("push_order", f"WITH {OLD_NEW} SELECT n.doc_id, n.filename, row_number() OVER (PARTITION BY n.doc_id ORDER BY o.pos NULLS LAST, n.filename) AS place FROM n LEFT JOIN o USING (doc_id, filename)")
def push_order(spark, d):
    return long(Y.push_order(*old_new(spark, d)), "place")


@query("section_reorder", f"WITH {OLD_NEW}, r AS (SELECT doc_id, filename, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY filename) AS b FROM n) SELECT doc_id, filename, a AS by_pos, b AS by_name FROM r WHERE a <> b")
def section_reorder(spark, d):
    return long(S.section_reorder(old_new(spark, d)[1]), "by_pos", "by_name")


SECTION_SYNC = NAMES + ", t AS (SELECT doc_id, filename, sha256(CASE WHEN (doc_id + section) % 3 = 0 THEN text || 'x' ELSE text END) AS sha FROM names), st AS (SELECT doc_id, filename, sha256(text) AS h FROM names WHERE section % 7 <> 6), lo AS (SELECT doc_id, filename, sha256(CASE WHEN (doc_id + section) % 4 = 0 THEN text || 'y' ELSE text END) AS sha FROM names WHERE section % 11 <> 5), acts AS (SELECT t.doc_id, t.filename, CASE WHEN st.h IS NULL THEN 'first-sync' WHEN t.sha = st.h AND coalesce(lo.sha = st.h, true) THEN 'up-to-date' WHEN coalesce(lo.sha = st.h, true) THEN 'fast-forward' WHEN t.sha = st.h THEN 'local-only' ELSE 'merged' END AS action FROM t LEFT JOIN st USING (doc_id, filename) LEFT JOIN lo USING (doc_id, filename))"


@query("section_sync_action", f"WITH {SECTION_SYNC} SELECT doc_id, filename, action FROM acts")
def section_sync_action(spark, d):
    m = manifest(spark, d).select("doc_id", "section", "filename").join(section_texts(spark, d), ["doc_id", "section"], "left").fillna("", ["text"])
    t = m.selectExpr("doc_id", "filename", "sha2(CASE WHEN (doc_id + section) % 3 = 0 THEN concat(text, 'x') ELSE text END, 256) AS sha")
    s = m.where("section % 7 <> 6").selectExpr("doc_id", "filename", "sha2(text, 256) AS base_hash", "sha2(text, 256) AS local_hash")
    lo = m.where("section % 11 <> 5").selectExpr("doc_id", "filename", "sha2(CASE WHEN (doc_id + section) % 4 = 0 THEN concat(text, 'y') ELSE text END, 256) AS sha")
    return Y.section_sync_action(t, s, lo)


@query("section_rollup", f"WITH {SECTION_SYNC}, c AS (SELECT doc_id, count_if(action = 'merged') AS m, count_if(action IN ('first-sync', 'fast-forward', 'merged')) AS w, count_if(action = 'first-sync') AS f FROM acts GROUP BY doc_id) SELECT doc_id, CASE WHEN m > 0 THEN 'merged' WHEN w > 0 AND w = f THEN 'first-sync' WHEN w > 0 THEN 'fast-forward' ELSE 'up-to-date' END AS action, w AS written FROM c")
def section_rollup(spark, d):
    return Y.section_rollup(section_sync_action(spark, d))


# comments

COMMENTS = f"{BASE}, {V.SQL_COMMENTS}"


@query("open_comments", f"WITH {COMMENTS} SELECT comment_id, doc_id, author, quote FROM comments WHERE NOT resolved")
def open_comments(spark, d):
    return C.open_comments(V.comments(spark, d)).select("comment_id", "doc_id", "author", "quote")


@query("bucket_comments", f"WITH {SECTIONS}, {V.SQL_COMMENTS}, h AS (SELECT c.comment_id, min(s.section) AS section, count(*) > 1 AS ambiguous FROM comments c JOIN sections s ON s.doc_id = c.doc_id AND trim(c.quote) <> '' AND contains(s.text, trim(c.quote)) GROUP BY c.comment_id) SELECT c.comment_id, c.doc_id, h.section, coalesce(h.ambiguous, false) AS ambiguous FROM comments c LEFT JOIN h USING (comment_id)")
def bucket_comments(spark, d):
    return long(C.bucket_comments(V.comments(spark, d), section_texts(spark, d)), "section")


@query("comment_digest", f"WITH {COMMENTS}, {V.SQL_REPLIES}, r AS (SELECT comment_id, string_agg(concat('  - ', coalesce(author, 'Unknown'), ': ', body), chr(10) ORDER BY turn) AS rs FROM replies GROUP BY comment_id) SELECT c.doc_id, string_agg(concat_ws(chr(10), concat('### ', coalesce(c.author, 'Unknown'), CASE WHEN c.resolved THEN ' (resolved)' ELSE '' END), '> ' || c.quote, c.body, r.rs), chr(10) || chr(10) ORDER BY c.resolved, c.comment_id) AS digest FROM comments c LEFT JOIN r USING (comment_id) GROUP BY c.doc_id")
def comment_digest(spark, d):
    return C.comment_digest(V.comments(spark, d), V.replies(spark, d))


@query("comment_drop_check", f"WITH {COMMENTS}, b AS (SELECT doc_id % 50 AS doc_id, count(*) AS n FROM comments WHERE NOT resolved GROUP BY 1), a AS (SELECT doc_id % 50 AS doc_id, count(*) AS n FROM comments WHERE NOT resolved AND comment_id % 4 <> 1 GROUP BY 1) SELECT b.doc_id, b.n AS n_before, coalesce(a.n, 0) AS n_after FROM b LEFT JOIN a USING (doc_id) WHERE coalesce(a.n, 0) < b.n")
def comment_drop_check(spark, d):
    c = V.comments(spark, d).withColumn("doc_id", F.col("doc_id") % 50)
    return C.comment_drop_check(c, c.where("comment_id % 4 <> 1"))


@query("reply_directives", f"WITH {COMMENTS} SELECT comment_id, CASE WHEN comment_id % 2 = 0 THEN concat('ok ', comment_id) END AS reply, comment_id % 3 = 1 AS resolve, comment_id % 5 <> 0 AS known FROM comments WHERE comment_id % 2 = 0 OR comment_id % 3 = 1")
def reply_directives(spark, d):
    c = V.comments(spark, d)
    text = F.expr("array('intro', concat('<!-- comment ', comment_id, ' -->'), 'Reply: first', concat('Reply: ', CASE WHEN comment_id % 2 = 0 THEN concat('ok ', comment_id) ELSE '' END), concat('Resolve: ', CASE WHEN comment_id % 3 = 1 THEN 'yes' ELSE 'no' END))")
    text = F.when(F.col("comment_id") % 2 == 0, text).otherwise(F.array_remove(F.array_remove(text, "Reply: first"), "Reply: "))
    ls = c.select("doc_id", "comment_id", F.posexplode(text).alias("j", "line"))
    return C.reply_directives(ls, c.where("comment_id % 5 <> 0"))


# diffs and merges


def changed_lines(spark, d, left, right):
    """Lines of documents that differ; equal ones are left out by a hash before any line is shuffled."""
    a, b = left(spark, d).select("doc_id", "content"), right(spark, d).select("doc_id", "content")
    differ = a.select("doc_id", F.xxhash64("content").alias("x")).join(b.select("doc_id", F.xxhash64("content").alias("y")), "doc_id").where("x <> y").select("doc_id")
    split = lambda x: x.join(differ, "doc_id").select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("j", "line"))
    return kept(split(a)), kept(split(b))


def ops(spark, d):
    a, b = changed_lines(spark, d, V.base, V.ours)
    return D.opcodes(a, b, D.diff_align(a, b))


# The counts are the same for every alignment that matches as many lines; these two revisions change, drop and add single lines.
@query("diff_cover", f"WITH {OURS}, {V.sql_lines('base')}, {V.sql_lines('ours')} SELECT b.doc_id, b.n AS n_old, o.n AS n_new FROM (SELECT doc_id, count(*) AS n FROM base_lines GROUP BY 1) b JOIN (SELECT doc_id, count(*) AS n FROM ours_lines GROUP BY 1) o USING (doc_id) JOIN base x USING (doc_id) JOIN ours y USING (doc_id) WHERE x.content <> y.content")
def diff_cover(spark, d):
    """Every line of both sides is in exactly one row of the diff: the sides can be counted from it."""
    x = ops(spark, d)
    return x.groupBy("doc_id").agg(F.count_distinct("l").alias("n_old"), F.count_distinct("r").alias("n_new"))


@query("diff_align")
def diff_align(spark, d):
    return D.diff_align(*changed_lines(spark, d, V.base, V.ours))


@query("diff_summary")
def diff_summary(spark, d):
    """Every document: those that are equal on both sides are told by a hash, and have their lines as unchanged."""
    found = kept(D.diff_summary(ops(spark, d)))
    same = V.base(spark, d).select("doc_id", F.size(F.split("content", "\n", -1)).cast("long").alias("n_unchanged")).join(found.select("doc_id"), "doc_id", "left_anti")
    return found.unionByName(same.select("doc_id", *[F.lit(0).cast("long").alias(f"n_{k}") for k in ("add", "remove", "change")], "n_unchanged"))


@query("churn_pairs")
def churn_pairs(spark, d):
    return D.churn_pairs(ops(spark, d))


@query("coalesce_runs")
def coalesce_runs(spark, d):
    return D.coalesce_runs(ops(spark, d))


@query("comments_at_risk")
def comments_at_risk(spark, d):
    native = F.col("old").rlike(r"^- \[[ xX]\] ")
    x = ops(spark, d).where("kind <> 'unchanged'").select("doc_id", F.col("l").alias("j"), "kind", "old", "new", native.alias("native"))
    return C.comments_at_risk(x, V.comments(spark, d))


@query("diff_guard", f"WITH {OURS}, {V.sql_lines('base')}, {V.sql_lines('ours')}, k AS (SELECT doc_id, line, 1 AS a, 0 AS b FROM base_lines UNION ALL SELECT doc_id, line, 0, 1 FROM ours_lines), p AS (SELECT doc_id, line, sum(a) AS a, sum(b) AS b FROM k GROUP BY 1, 2), q AS (SELECT doc_id, sum(a) AS n, sum(b) AS m, max(greatest(a, b)) AS run FROM p GROUP BY 1) SELECT doc_id, cast(n AS bigint) AS n, cast(m AS bigint) AS m, cast(run AS bigint) AS run, CASE WHEN n * m > 4000000 OR (n + m >= 150 AND run > 60) THEN 'blocked' ELSE 'ok' END AS status FROM q")
def diff_guard(spark, d):
    return D.diff_guard(B.lines(V.base(spark, d)), B.lines(V.ours(spark, d)))


#: Ours, but an eleventh of the documents is half rewritten, another lost its text on both sides.
REWRITTEN = """
 left_side AS (SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN ' ' ELSE content END AS content FROM base),
 right_side AS (
   SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN NULL WHEN doc_id % 11 = 6 THEN concat(content, ' ', upper(content)) WHEN doc_id % 11 = 7 THEN '' ELSE content END AS content
   FROM ours)"""


@query(
    "text_similarity",
    f"""WITH {OURS}, {REWRITTEN},
    a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(content, '\\s+')) AS w FROM left_side) WHERE w <> '' GROUP BY ALL),
    b AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(content, '\\s+')) AS w FROM right_side) WHERE w <> '' GROUP BY ALL),
    s AS (
      SELECT doc_id, 2 * sum(least(coalesce(a.n, 0), coalesce(b.n, 0)))::double / sum(coalesce(a.n, 0) + coalesce(b.n, 0))::double AS r
      FROM a FULL JOIN b USING (doc_id, w) GROUP BY doc_id),
    t AS (SELECT base.doc_id, round(coalesce(s.r, 1.0), 6) AS bag_ratio FROM base LEFT JOIN s USING (doc_id))
    SELECT doc_id, bag_ratio, CASE WHEN bag_ratio < 0.8 THEN 'high' WHEN bag_ratio < 0.95 THEN 'medium' END AS severity FROM t""",
)
def text_similarity(spark, d):
    i, text = F.col("doc_id") % 11, F.col("content")
    left = V.base(spark, d).select("doc_id", F.when(i == 5, " ").otherwise(text).alias("content"))
    right = V.ours(spark, d).select("doc_id", F.when(i == 5, F.lit(None)).when(i == 6, F.concat(text, F.lit(" "), F.upper(text))).when(i == 7, "").otherwise(text).alias("content"))
    return D.text_similarity(left, right)


@query("merge3")
def merge3(spark, d):
    """Every document: those changed on one side, or equally on both, are taken whole from it; the operator merges the rest."""
    side = lambda f, x: f(spark, d).select("doc_id", F.col("content").alias(x))
    # equal contents are told by a hash, so that one content a document is carried besides the hashes
    b, o, t = (side(f, x).withColumn(f"h{x}", F.xxhash64(x)) for f, x in ((V.base, "b"), (V.ours, "o"), (V.theirs, "t")))
    hashes = b.select("doc_id", "hb").join(o.select("doc_id", "ho"), "doc_id").join(t.select("doc_id", "ht"), "doc_id")
    ours, theirs = (F.col("ht") == F.col("hb")) | (F.col("ho") == F.col("ht")), F.col("ho") == F.col("hb")
    taken = hashes.withColumn("take", F.when(ours, "o").when(theirs, "t"))
    whole = lambda x, n: x.join(taken.where(F.col("take") == n), "doc_id").select("doc_id", F.col(n).alias("merged"), F.lit(False).alias("has_conflicts"), F.lit(0).cast("long").alias("conflict_count"))
    both = taken.where("take IS NULL").select("doc_id")
    split = lambda x, n: x.join(both, "doc_id").select("doc_id", F.posexplode(F.split(n, "\n", -1)).alias("j", "line"))
    merged = D.merge3(*(split(x, n) for x, n in ((b, "b"), (o, "o"), (t, "t"))))
    return merged.unionByName(whole(o, "o")).unionByName(whole(t, "t"))


@query("merge3_one_side", f"WITH {OURS} SELECT b.doc_id, o.content AS merged, false AS has_conflicts, 0 AS conflict_count FROM base b JOIN ours o USING (doc_id)")
def merge3_one_side(spark, d):
    """merge(base, ours, base) is ours, for every document."""
    split = lambda x: x.select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("j", "line"))
    b = split(V.base(spark, d))
    return long(D.merge3(b, split(V.ours(spark, d)), b), "conflict_count")


@query("conflict_counts", f"WITH {BASE}, m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(content, '## Section 1', '<<<<<<< ours') ELSE content END AS content FROM base) SELECT doc_id, len(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '<<<<<<< '))) AS conflicts FROM m WHERE len(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '<<<<<<< '))) > 0")
def conflict_counts(spark, d):
    marked = F.when(F.col("doc_id") % 3 == 0, F.replace("content", F.lit("## Section 1"), F.lit("<<<<<<< ours"))).otherwise(F.col("content"))
    return D.conflict_counts(V.base(spark, d).select("doc_id", marked.alias("content")))


@query("apply_resolutions", f"WITH {BOTH}, c AS (SELECT b.doc_id, t.content AS remote, CASE WHEN b.doc_id % 2 = 0 THEN o.content END AS backup, b.content AS base, CASE WHEN b.doc_id % 5 = 0 THEN '<<<<<<< ours' ELSE o.content END AS merged FROM base b JOIN ours o USING (doc_id) JOIN theirs t USING (doc_id) WHERE b.doc_id % 6 <> 0), ch AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'local' ELSE 'merged' END AS strategy FROM documents) SELECT doc_id, strategy, CASE WHEN merged IS NULL THEN 'error' WHEN strategy = 'merged' AND doc_id % 5 = 0 THEN 'rejected' ELSE 'resolved' END AS status, CASE WHEN merged IS NULL OR (strategy = 'merged' AND doc_id % 5 = 0) THEN NULL WHEN strategy = 'remote' THEN remote WHEN strategy = 'local' THEN coalesce(backup, nullif(base, '')) ELSE merged END AS content FROM ch LEFT JOIN c USING (doc_id)")
def apply_resolutions(spark, d):
    b, o, t = (f(spark, d).select("doc_id", F.col("content").alias(n)) for f, n in ((V.base, "base"), (V.ours, "o"), (V.theirs, "remote")))
    c = b.join(o, "doc_id").join(t, "doc_id").where("doc_id % 6 <> 0").selectExpr("doc_id", "remote", "CASE WHEN doc_id % 2 = 0 THEN o END AS backup", "base", "CASE WHEN doc_id % 5 = 0 THEN '<<<<<<< ours' ELSE o END AS merged")
    choices = V.documents(spark, d).selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'local' ELSE 'merged' END AS strategy")
    return Y.apply_resolutions(c, choices)


#: A revision that changes marks only: some headings get deeper, some items are ticked.
RESTYLE = "CASE WHEN (doc_id + {i}) % 5 = 0 AND line LIKE '## %' THEN concat('#', line) WHEN (doc_id + {i}) % 3 = 0 AND line LIKE '- [ ] %' THEN concat('> ', substring(line, 7)) ELSE line END"


def restyled(spark, d):
    return V.base(spark, d).withColumn("content", F.expr(f"array_join(transform(split(content, '\\n', -1), (line, i) -> {RESTYLE.format(i='i')}), '\\n')"))


def restyled_sides(spark, d):
    split = lambda x: x.select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("j", "line"))
    return split(V.base(spark, d)), split(restyled(spark, d))


@query("diff_repair")
def diff_repair(spark, d):
    a, b = restyled_sides(spark, d)
    return D.diff_repair(a, b, D.diff_align(a, b))


@query("diff_assign")
def diff_assign(spark, d):

    a, b = restyled_sides(spark, d)
    return D.diff_assign(a, b, D.diff_align(a, b))


RESTYLED = f"{V.SQL_BASE}, {V.sql_lines('base')}, rl AS (SELECT doc_id, j, line, {RESTYLE.format(i='j')} AS now FROM base_lines)"
STYLE = r"CASE WHEN regexp_matches({0}, '^#{{1,6}} ') THEN concat('HEADING_', length(regexp_extract({0}, '^(#+)', 1))) WHEN regexp_matches({0}, '^\s*[-*+] \[[ xX]\] ') THEN 'TASK' WHEN regexp_matches({0}, '^\s*[-*+] ') THEN 'ITEM' WHEN {0} LIKE '>%' THEN 'QUOTE' ELSE 'TEXT' END"


@query("style_align", f"WITH {RESTYLED} SELECT doc_id, j AS l, j AS r, {STYLE.format('line')} AS l_style, {STYLE.format('now')} AS r_style FROM rl")
def style_align(spark, d):
    """The marks alone change, so the texts of both sides are the same lines."""
    return long(D.style_align(*restyled_sides(spark, d)), "l", "r")


@query("style_upgrades", f"WITH {RESTYLED} SELECT doc_id, count(*) AS n FROM rl WHERE {STYLE.format('line')} <> 'QUOTE' AND {STYLE.format('now')} = 'QUOTE' GROUP BY doc_id")
def style_upgrades(spark, d):
    """Lines that became quotes, by document."""
    return D.style_align(*restyled_sides(spark, d)).where("l_style <> 'QUOTE' AND r_style = 'QUOTE'").groupBy("doc_id").agg(F.count("*").alias("n"))
