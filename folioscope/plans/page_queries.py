"""Queries over node trees, pages, keys and streams, with their SQL for the other engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import expr as X
from folioscope.operators import blocks as B
from folioscope.operators import crawl as K
from folioscope.operators import html as H
from folioscope.plans import fixtures as V
from folioscope.plans.revision_queries import BASE, LINES, LINKS, SLUG, TYPED, lines, long, typed
from folioscope.sources import files
from folioscope.sources.files import shared_folder
from folioscope.streaming import stream as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


PAGES = V.SQL_PAGES
@query("scan_crawl", f"WITH {PAGES} SELECT page_id, title, parent_id, space_key, status, labels FROM meta")
def scan_crawl(spark, d):
    return V.pages(spark, d).select("page_id", "title", "parent_id", "space_key", "status", "labels")


@query(
    "page_tree",
    f"""WITH RECURSIVE {PAGES},
    r AS (
      SELECT page_id AS root, page_id, 0 AS depth, [page_id] AS path FROM meta WHERE parent_id IS NULL OR page_id < 5
      UNION ALL
      SELECT r.root, m.page_id, r.depth + 1, list_append(r.path, m.page_id) FROM r JOIN meta m ON m.parent_id = r.page_id WHERE r.depth < 8)
    SELECT root, page_id, depth, row_number() OVER (PARTITION BY root ORDER BY path) AS place FROM r""",
)
def page_tree(spark, d):
    """All pages below the top page, and the trees of its children."""
    p = V.pages(spark, d).select("page_id", "parent_id")
    return long(K.page_tree(p, p.where("parent_id IS NULL OR page_id < 5"), 8), "depth", "place")


@query("page_by_title", f"WITH {PAGES} SELECT concat('S', x.k % 3) AS space_key, x.title, min(m.page_id) AS page_id FROM (SELECT DISTINCT title, page_id % 5 AS k FROM meta) x LEFT JOIN meta m ON m.title = x.title AND m.space_key = concat('S', x.k % 3) GROUP BY 1, 2")
def page_by_title(spark, d):
    p = V.pages(spark, d)
    return K.page_by_title(p, p.select(F.expr("concat('S', page_id % 5 % 3)").alias("space_key"), "title").distinct())


@query("search_space", f"WITH {PAGES} SELECT page_id, title FROM meta WHERE space_key = 'S1' AND status = 'current' AND contains(lower(html), 'the ')")
def search_space(spark, d):
    return K.search_space(V.pages(spark, d), "S1", F.col("html"), "The ").select("page_id", "title")


@query("crawl_limit", f"WITH {PAGES} SELECT page_id, title FROM meta ORDER BY page_id LIMIT 20")
def crawl_limit(spark, d):
    return V.pages(spark, d).select("page_id", "title").orderBy("page_id").limit(20)


@query(
    "version_history",
    """WITH v AS (SELECT page_id, length(html) AS n, unnest(range(1, 3 + page_id % 7)) AS k FROM pages),
    x AS (SELECT page_id, k * 3 AS version, n + (k * k * 7 + page_id) % 31 AS len FROM v)
    SELECT page_id, version, row_number() OVER w AS place, len - lag(len) OVER w AS delta FROM x WINDOW w AS (PARTITION BY page_id ORDER BY version)""",
)
def version_history(spark, d):
    """Versions with gaps between, whose lengths go up and down."""
    v = V.pages(spark, d).select("page_id", F.length("html").alias("n"), F.explode(F.expr("sequence(1, cast(2 + page_id % 7 AS int))")).alias("k"))
    return long(K.version_history(v.select("page_id", (F.col("k") * 3).alias("version"), F.expr("n + (k * k * 7 + page_id) % 31").alias("length"))), "version", "place", "delta")


@query("tags_and_labels", f"WITH {PAGES}, l AS (SELECT DISTINCT page_id, trim(unnest(string_split(labels, ','))) AS label FROM meta) SELECT label, count(*) AS n FROM l WHERE label <> '' GROUP BY label")
def tags_and_labels(spark, d):
    return K.labels_of(V.pages(spark, d))


KNOWN = ["click", "view", "signup", "purchase", "login"]


@query(
    "closest_key",
    """WITH k AS (SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN concat(event_type, 's') WHEN 2 THEN reverse(event_type) ELSE concat('my ', event_type, ' key') END AS key FROM events),
    x AS (SELECT key, unnest(['click', 'view', 'signup', 'purchase', 'login']) AS k, unnest([0, 1, 2, 3, 4]) AS i FROM k),
    r AS (SELECT key, k, levenshtein(key, k) AS d, row_number() OVER (PARTITION BY key ORDER BY levenshtein(key, k), i) AS n FROM x)
    SELECT key, CASE WHEN d <= 5 THEN k END AS closest FROM r WHERE n = 1""",
)
def closest_key(spark, d):
    """Event types as they are, and mistyped in three ways."""
    key = F.expr("CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN concat(event_type, 's') WHEN 2 THEN reverse(event_type) ELSE concat('my ', event_type, ' key') END")
    return K.closest_key(spark.read.parquet(f"{d}/events.parquet").select(key.alias("key")), KNOWN)


@query("scan_images", "SELECT CASE page_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/bmp' WHEN 4 THEN 'image/svg+xml' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def scan_images(spark, d):
    head = F.expr("CASE page_id % 6 WHEN 0 THEN X'89504E47' WHEN 1 THEN X'FFD8FFE0' WHEN 2 THEN X'4749463839' WHEN 3 THEN X'424D00' WHEN 4 THEN cast('<?xml?><svg>' AS binary) ELSE X'00' END")
    p = V.pages(spark, d).select("page_id", F.concat(head, F.col("url").cast("binary")).alias("content"))
    return p.groupBy(K.image_type(F.col("content")).alias("kind")).agg(F.count("*").alias("n"))


@query("image_fallback", f"WITH {LINES}{LINKS} SELECT doc_id, label AS alt, count(*) AS n FROM links WHERE image AND ((doc_id + j) % 2 = 0 OR doc_id % 3 <> 0) GROUP BY ALL")
def image_fallback(spark, d):
    x = B.explode_links(lines(spark, d)).where("image")
    wanted = x.select("doc_id", F.col("label").alias("alt"), F.expr("CASE WHEN (doc_id + j) % 2 = 0 THEN href END").alias("src"))
    return K.image_fallback(wanted, x.where("doc_id % 3 <> 0").select("doc_id", F.col("label").alias("alt"))).groupBy("doc_id", "alt").agg(F.count("*").alias("n"))


@query("checkbox_recover", f"WITH {LINES} SELECT doc_id, j, line LIKE '- [x]%' AS checked FROM flagged WHERE NOT in_code AND (line LIKE '- [x] %' OR line LIKE '- [ ] %') AND doc_id % 4 <> 0")
def checkbox_recover(spark, d):
    b = lines(spark, d).where("NOT in_code AND (line LIKE '- [x] %' OR line LIKE '- [ ] %')").select("doc_id", "j", F.col("line").startswith("- [x]").alias("checked"))
    short = b.where("doc_id % 4 <> 0").unionByName(b.where("doc_id % 4 = 0").select("doc_id", F.explode(F.array(F.col("j"), F.col("j") + 1)).alias("j"), "checked"))
    return long(K.checkbox_recover(b, short), "j")


@query("clean_html", None)
def clean_html(spark, d):
    return V.pages(spark, d).select("page_id", H.clean_html(F.col("html")).alias("text"))


@query("conflict_log", f"WITH {BASE} SELECT doc_id, lang, length(content) AS n FROM base")
def conflict_log(spark, d):
    rows = V.base(spark, d).select(F.to_json(F.struct("doc_id", "lang", F.length("content").cast("long").alias("n"))).alias("line"))
    return rows.select(F.from_json("line", "doc_id long, lang string, n long").alias("x")).select("x.*")


# column functions over whole tables


@query("anchor_target", f"WITH {LINES}{LINKS} SELECT doc_id, j, k, target FROM anchors")
def anchor_target(spark, d):
    x = B.explode_links(lines(spark, d)).where("NOT image").select("doc_id", "j", "k", X.anchor_target(F.col("href")).alias("target")).where("target IS NOT NULL")
    return long(x, "j", "k")


@query("cross_doc_href", f"WITH {LINES}{LINKS} SELECT DISTINCT href, regexp_extract(href, '^([^#?]*)', 1) AS path, nullif(regexp_extract(href, '#(.*)$', 1), '') AS fragment FROM links WHERE NOT regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.\\-]*:|/|#|\\?)') AND regexp_extract(href, '^([^#?]*)', 1) <> ''")
def cross_doc_href(spark, d):
    x = B.explode_links(lines(spark, d)).select("href", X.cross_doc_path(F.col("href")).alias("path"), X.cross_doc_fragment(F.col("href")).alias("fragment"))
    return x.where("path IS NOT NULL").distinct()


@query("norm_path", "SELECT doc_id, concat(source, '/', lang, '/', doc_id, '.md') AS path FROM documents")
def norm_path(spark, d):
    p = F.expr(r"concat(source, '\\.\\x/../', lang, '//', doc_id % 10, '/../', doc_id, '.md')")
    return V.documents(spark, d).select("doc_id", X.norm_path(p).alias("path"))


#: Addresses of pages: an id alone, with and without a title, without an id, with a name for one, of other places.
PAGE_URLS = """CASE page_id % 6 WHEN 0 THEN cast(page_id AS string) WHEN 1 THEN concat('https://x.example.com/wiki/spaces/S', page_id % 4, '/pages/', page_id, '/T') WHEN 2 THEN concat('https://x.example.com/wiki/spaces/S', page_id % 4, '/overview')
  WHEN 3 THEN concat('/wiki/spaces/S', page_id % 4, '/pages/', page_id) WHEN 4 THEN concat('https://x.example.com/wiki/spaces/S/pages/p', page_id) ELSE url END"""


@query("page_url", "SELECT page_id, CASE WHEN page_id % 6 IN (0, 1, 3) THEN CAST(page_id AS varchar) END AS id, CASE WHEN page_id % 6 IN (1, 3) THEN concat('S', page_id % 4) END AS space FROM pages")
def page_url(spark, d):
    u = F.expr(PAGE_URLS)
    return V.pages(spark, d).select("page_id", X.page_id_of_url(u).alias("id"), X.space_of_url(u).alias("space"))


@query("unwrap_redirect", "SELECT page_id, CASE page_id % 5 WHEN 3 THEN concat('https://www.google.com/url?sa=t&u=', url) WHEN 4 THEN concat('https://other.example.com/url?q=', url) ELSE url END AS url FROM pages")
def unwrap_redirect(spark, d):
    """Redirects with the address first or later, without one, of another host, and plain addresses."""
    i, encoded = F.col("page_id") % 5, F.url_encode("url")
    u = (
        F.when(i == 0, F.concat(F.lit("https://www.google.com/url?q="), encoded, F.lit("&sa=D#x"))).when(i == 1, F.concat(F.lit("http://www.google.com/url?sa=t&q="), encoded, F.lit("&ust=1")))
        .when(i == 3, F.concat(F.lit("https://www.google.com/url?sa=t&u="), "url")).when(i == 4, F.concat(F.lit("https://other.example.com/url?q="), "url")).otherwise(F.col("url"))
    )
    return V.pages(spark, d).select("page_id", X.unwrap_redirect(u).alias("url"))


@query("norm_page_name", f"WITH {PAGES} SELECT page_id, regexp_replace(regexp_replace(lower(title), '[ \\-_]+', '-', 'g'), '[^a-z0-9_\\-]', '', 'g') AS name FROM meta")
def norm_page_name(spark, d):
    return V.pages(spark, d).select("page_id", X.norm_page_name(F.col("title")).alias("name"))


@query(
    "snake_key",
    """SELECT DISTINCT event_type, k, CASE k WHEN 0 THEN concat('my_', event_type, '_http_key') WHEN 1 THEN concat('html_parser_', event_type) WHEN 2 THEN concat(event_type, '_2_nd_key') WHEN 3 THEN upper(event_type)[:0] || lower(event_type) ELSE concat('a_', event_type, '_b') END AS key
    FROM (SELECT event_type, event_id % 5 AS k FROM events)""",
)
def snake_key(spark, d):
    """Kebab, Pascal and camel case, abbreviations, digits and capitals alone."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", (F.col("event_id") % 5).alias("k")).distinct()
    k, name, title = F.col("k"), F.col("event_type"), F.initcap("event_type")
    key = (
        F.when(k == 0, F.concat(F.lit("my-"), title, F.lit("HTTPKey"))).when(k == 1, F.concat(F.lit("HTMLParser"), title)).when(k == 2, F.concat(name, F.lit("_2_ndKey")))
        .when(k == 3, F.upper(name)).otherwise(F.concat(F.lit("a-"), name, F.lit("-B")))
    )
    return e.select("event_type", "k", X.snake_key(key).alias("key"))


@query("edit_distance", "SELECT p_partkey, levenshtein(p_name, p_type) AS d FROM part")
def edit_distance(spark, d):
    return long(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.levenshtein("p_name", "p_type").alias("d")), "d")


@query("safe_filename", """SELECT page_id, trim(left(regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g'), 100)) AS name FROM pages""")
def safe_filename(spark, d):
    return V.pages(spark, d).select("page_id", X.safe_filename(F.col("url")).alias("name"))


@query("content_hash", "SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1")
def content_hash(spark, d):
    return V.documents(spark, d).groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"))


@query("utf16_len", "SELECT doc_id, length(text) AS n FROM documents")
def utf16_len(spark, d):
    """These texts hold no character outside the basic plane, so the units are as many as the characters."""
    return V.documents(spark, d).select("doc_id", X.utf16_len(F.col("text")).alias("n"))


@query("frontmatter", "SELECT doc_id, lang AS language, source AS title, length(text) AS n FROM documents")
def frontmatter(spark, d):
    content = F.concat(F.lit("---\nlanguage: "), F.col("lang"), F.lit('\ntitle: "'), F.col("source"), F.lit('"\n---\n'), F.col("text"))
    m = X.front_matter(content)
    return V.documents(spark, d).select("doc_id", F.try_element_at(m, F.lit("language")).alias("language"), F.try_element_at(m, F.lit("title")).alias("title"), F.length(X.body_after_front_matter(content)).cast("long").alias("n"))


@query("publishable", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def publishable(spark, d):
    content = F.concat(F.lit("---\ndocs-publish: "), F.when(F.col("doc_id") % 3 == 0, "false").otherwise("true"), F.lit("\n---\n"), F.col("text"))
    m = X.front_matter(content)
    return V.documents(spark, d).where(F.coalesce(F.try_element_at(m, F.lit("docs-publish")) != "false", F.lit(True))).select("doc_id")


@query("doc_title", f"WITH {BASE} SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN source END, nullif(regexp_replace(regexp_extract(content, '(?m)^# (.*)$', 1), '^\\s+|\\s+$', '', 'g'), ''), cast(doc_id AS varchar)) AS title FROM base")
def doc_title(spark, d):
    return V.base(spark, d).select("doc_id", X.doc_title(F.when(F.col("doc_id") % 4 == 0, F.col("source")), F.col("content"), F.expr("concat('a/', doc_id, '.md')")).alias("title"))


@query("modified_since_sync", "SELECT event_id, event_id % 5 = 0 OR event_id % 7 > 2 AS modified FROM events")
def modified_since_sync(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    synced = F.when(F.col("event_id") % 5 != 0, F.col("ts"))
    return e.select("event_id", X.modified_since(F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, event_id % 7)"), synced).alias("modified"))


@query("oneway_action", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'copy: first sync' WHEN doc_id % 3 = 0 THEN 'copy: file is missing' WHEN doc_id % 7 > doc_id % 4 THEN 'copy: document is newer' ELSE 'skip: file is current' END AS action FROM documents")
def oneway_action(spark, d):
    i = F.col("doc_id")
    return V.documents(spark, d).select("doc_id", X.oneway_action(F.when(i % 5 != 0, i), i % 3 != 0, i % 7, i % 4).alias("action"))


@query("conflict_hint", "SELECT event_id, CASE WHEN event_id % 300 < 60 THEN 'simultaneous' WHEN event_id % 2 = 0 THEN concat('document newer by ', event_id % 300 // 60, ' min') ELSE concat('file newer by ', event_id % 300 // 60, ' min') END AS hint FROM events")
def conflict_hint(spark, d):
    other = F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, CASE WHEN event_id % 2 = 0 THEN -(event_id % 300) ELSE event_id % 300 END)")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", X.conflict_hint(F.col("ts"), other).alias("hint"))


@query("fence_width", "SELECT doc_id, repeat('`', greatest(3, doc_id % 6 + 1)) AS fence FROM documents")
def fence_width(spark, d):
    return V.documents(spark, d).select("doc_id", X.fence_for(F.concat(F.regexp_replace("text", "`", ""), F.expr("repeat('`', cast(doc_id % 6 AS int))"))).alias("fence"))


@query("mermaid_key", f"WITH {TYPED} SELECT left(sha256(text), 12) AS key, count(*) AS n FROM typed WHERE kind = 'code' GROUP BY 1")
def mermaid_key(spark, d):
    return typed(spark, d).where("kind = 'code'").groupBy(X.mermaid_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"))


@query("macro_params", "SELECT doc_id, lang AS a, source AS b FROM documents")
def macro_params(spark, d):
    m = X.macro_params(F.concat(F.lit("a=old|x|a="), F.col("lang"), F.lit(" | b = "), F.col("source")))
    return V.documents(spark, d).select("doc_id", F.try_element_at(m, F.lit("a")).alias("a"), F.try_element_at(m, F.lit("b")).alias("b"))


@query("comment_preview", "SELECT conv_id, turn, CASE WHEN length(t) > 100 THEN concat(left(t, 100), '...') ELSE t END AS preview FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM conversations)")
def comment_preview(spark, d):
    return V.conversations(spark, d).select("conv_id", "turn", X.comment_preview(F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"))).alias("preview"))


@query(
    "quote_depth",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 7 = 0 OR doc_id % 9 = 0 THEN 0 ELSE (doc_id % 50 + 9) // 18 END AS depth FROM documents""",
)
def quote_depth(spark, d):
    """Widths, dashes and colours of a quote's border and of others; indents of 0 to 49 points, none of them half a level."""
    i = F.col("doc_id")
    width, dash = F.when(i % 4 == 0, 2).otherwise(1), F.when(i % 7 == 0, "DOT").otherwise("SOLID")
    # 0.494 comes back from 8 bits as 126 / 255
    red = F.when(i % 9 == 0, 0.5).when(i % 2 == 0, F.lit(126 / 255)).otherwise(F.lit(0.494))
    indent = (i % 50).cast("double") + 0.25
    return long(V.documents(spark, d).select("doc_id", X.quote_depth(indent, width, dash, red, F.lit(0.549), F.lit(0.612)).alias("depth")), "depth")


@query(
    "private_use_only",
    r"""SELECT doc_id, doc_id % 5 IN (0, 1) AS mark FROM documents""",
)
def private_use_only(spark, d):
    """Marks of private use alone, among spaces, next to a letter, none, or the document's text."""
    i = F.col("doc_id")
    text = F.when(i % 5 == 0, "\ue000\uf8ff").when(i % 5 == 1, " \ue123\n").when(i % 5 == 2, F.concat(F.lit("\ue000"), F.left("text", F.lit(1)), F.lit("x"))).when(i % 5 == 3, "  ").otherwise(F.concat(F.lit("a"), "text"))
    return V.documents(spark, d).select("doc_id", X.private_use_only(text).alias("mark"))


@query(
    "render_spans",
    """WITH x AS (SELECT doc_id, source AS a, lang AS b FROM documents)
    SELECT doc_id, concat(
      CASE WHEN doc_id % 2 = 0 THEN concat('`', a, '`') ELSE a END,
      CASE WHEN doc_id % 3 = 0 THEN concat('`` `x`', b, ' ``') WHEN doc_id % 3 = 1 THEN concat('**', 'x`', b, '**') ELSE concat('*', 'x`', b, '*') END,
      CASE WHEN doc_id % 5 = 0 THEN concat('[***', b, '***](u', doc_id, ')') ELSE b END) AS md
    FROM x""",
)
def render_spans(spark, d):
    """Three spans a document: perhaps code, code with a tick inside that ends in a space, bold or italic, all of bold, italic and link."""
    i = F.col("doc_id")

    def span(text, code, bold, italic, link):
        return F.struct(text.alias("text"), code.alias("monospace"), bold.alias("bold"), italic.alias("italic"), link.alias("link"))

    no, none = F.lit(False), F.lit(None).cast("string")
    first = span(F.col("source"), i % 2 == 0, no, no, none)
    # a tick inside makes the delimiters longer; outer spaces are kept by one more on either side
    second = span(F.when(i % 3 == 0, F.concat(F.lit("`x`"), "lang")).otherwise(F.concat(F.lit("x`"), "lang")), i % 3 == 0, i % 3 == 1, i % 3 == 2, F.lit(""))
    third = span(F.col("lang"), no, i % 5 == 0, i % 5 == 0, F.when(i % 5 == 0, F.concat(F.lit("u"), i.cast("string"))))
    return V.documents(spark, d).select("doc_id", X.render_spans(F.array(first, second, third)).alias("md"))


@query(
    "scan_crawl_files",
    f"""WITH {PAGES} SELECT cast(page_id AS varchar) AS id, title, space_key, 1 AS version, status, cast(parent_id AS varchar) AS parent_id, url,
      [concat('kind', page_id % 4)] AS labels FROM meta""",
)
def scan_crawl_files(spark, d):
    """Pages saved as JSON files, a folder for each space, and read back."""
    p = V.pages(spark, d).select(F.col("page_id").cast("string").alias("id"), "title", "space_key", F.lit(1).alias("version"), "status", F.col("parent_id").cast("string").alias("parent_id"), "url", F.array(F.expr("concat('kind', page_id % 4)")).alias("labels"))
    folder = shared_folder(spark, "crawl")
    files.save_crawl(p, folder)
    return files.scan_crawl(spark, folder).select("id", "title", "space_key", "version", "status", "parent_id", "url", "labels")


@query(
    "conflict_log_files",
    """SELECT doc_id, source AS local, CASE doc_id % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'ours' ELSE 'theirs' END AS kind, cast(doc_id % 60 AS varchar) AS at FROM documents""",
)
def conflict_log_files(spark, d):
    """Conflicts appended to one log in three runs and read back."""
    rows = V.documents(spark, d).select("doc_id", F.col("source").alias("local"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'ours' ELSE 'theirs' END").alias("kind"), F.expr("cast(doc_id % 60 AS string)").alias("at"))
    folder = shared_folder(spark, "conflicts")
    for kind in ("both", "ours", "theirs"):
        files.append_conflicts(rows.where(F.col("kind") == kind), folder)
    return files.read_conflicts(spark, folder)


@query("heading_rank", f"WITH {LINES} SELECT n, count(*) AS c FROM (SELECT length(regexp_extract(line, '^(#+) ', 1)) AS n FROM flagged WHERE NOT in_code AND regexp_matches(line, '^#{{1,6}} ')) GROUP BY n")
def heading_rank(spark, d):
    h = B.headings(lines(spark, d))
    return long(h.select(X.heading_rank(F.concat(F.lit("HEADING_"), F.col("level").cast("string"))).alias("n")).groupBy("n").agg(F.count("*").alias("c")), "n")


@query("editor_type", "SELECT page_id, CASE WHEN page_id % 7 IN (0, 1, 4) THEN 'v2' WHEN page_id % 7 IN (2, 5) THEN 'v1' ELSE 'unknown' END AS editor FROM pages")
def editor_type(spark, d):
    """The page's property before its bodies, bodies of both kinds, a property that is none, no JSON."""
    body = F.expr(
        """CASE page_id % 7 WHEN 0 THEN '{"editor":"v2","body":{"storage":"x"}}' WHEN 1 THEN '{"body":{"atlas_doc_format":"x","storage":"y"}}' WHEN 2 THEN '{"body":{"storage":"x"}}' WHEN 3 THEN '{}'
          WHEN 4 THEN '{"editor":"v9","body":{"atlas_doc_format":{"a":1}}}' WHEN 5 THEN '{"editor":"v1","body":{"atlas_doc_format":"x"}}' ELSE url END"""
    )
    return V.pages(spark, d).select("page_id", X.editor_type(body).alias("editor"))


@query(
    "sql_functions",
    f"""SELECT doc_id, {SLUG.format('text')} AS slug, sha256(text) AS sha, length(text) AS units, levenshtein(source, lang) AS distance,
      concat(source, '/b.md') AS path, concat('x ', doc_id) AS target, left(sha256(text), 12) AS short FROM documents""",
)
def sql_functions(spark, d):
    X.register(spark)
    V.documents(spark, d).createOrReplaceTempView("fs_documents")
    return spark.sql(
        """SELECT doc_id, fs_slugify(text) AS slug, fs_content_hash(text) AS sha, fs_utf16_len(text) AS units, cast(fs_edit_distance(source, lang) AS bigint) AS distance,
          fs_norm_path(concat('./', source, '/a/../b.md')) AS path, fs_anchor_target(concat('#x%20', doc_id)) AS target, fs_mermaid_key(text) AS short FROM fs_documents"""
    )


# streams

EVENTS = "rev AS (SELECT event_id % 1000 AS doc_id, cast(event_id AS varchar) AS version, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, ts FROM events)"


@query("stream_sync_action", f"WITH {EVENTS}, s AS (SELECT *, last_value(CASE WHEN status = 'success' THEN version END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ts, version::bigint ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM rev) SELECT doc_id, version, status, CASE WHEN status = 'error' THEN 'error' WHEN seen IS NULL THEN 'first-sync' ELSE 'fast-forward' END AS action FROM s")
def stream_sync_action(spark, d):
    return T.drained(T.stream_sync_action(T.revisions(spark, d))).drop("seen")


@query("stream_run_summary", f"WITH {EVENTS} SELECT time_bucket(INTERVAL 300 SECOND, ts) AS start, status, count(*) AS n FROM rev GROUP BY ALL")
def stream_run_summary(spark, d):
    return T.drained(T.stream_run_summary(T.revisions(spark, d)), ["start", "status"])


@query("stream_mapping_refresh", "SELECT event_id % 1000 AS doc_id, cast(event_id AS varchar) AS version, d.source FROM events LEFT JOIN documents d ON d.doc_id = event_id % 1000")
def stream_mapping_refresh(spark, d):
    folder = shared_folder(spark, "refreshed")
    T.stream_with_mappings(T.revisions(spark, d), lambda s: V.documents(s, d).select("doc_id", "source"), lambda batch, n: batch.select("doc_id", "version", "source").write.mode("overwrite").parquet(f"{folder}/batch={n}"))
    return spark.read.parquet(folder).drop("batch")
