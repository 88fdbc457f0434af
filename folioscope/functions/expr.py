"""Column functions of the document-revision engine, and the same as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

STRIP = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, STRIP, "")


def slugify(c: Column) -> Column:
    """Heading slug: lower case; letters, marks, digits, connectors, hyphens and spaces stay; each space is a hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\-_ ]", ""), " ", "-")


def anchor_target(href: Column) -> Column:
    """Percent-decoded text after a leading #; null for a bare # or another link. A plus stays a plus."""
    rest = F.replace(F.substring(href, 2, 1 << 30), F.lit("+"), F.lit("%2B"))
    return F.when(href.startswith("#") & (F.length(href) > 1), F.try_url_decode(rest))


def cross_doc_path(href: Column) -> Column:
    """Path of a relative link to another document; null for a scheme, a host, a leading slash or a bare fragment."""
    path = F.regexp_extract(href, r"^([^#?]*)", 1)
    return F.when(~href.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:|/|#|\?)") & (path != ""), path)


def cross_doc_fragment(href: Column) -> Column:
    return F.nullif(F.regexp_extract(href, r"#(.*)$", 1), F.lit(""))


def norm_path(path: Column) -> Column:
    """Forward slashes, with . and .. resolved as far as they can be; case is kept."""
    empty = F.array().cast("array<string>")
    step = lambda out, x: (
        F.when((x == "") | (x == "."), out).when((x == "..") & (F.size(out) > 0) & (F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit("")) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x))
    )
    return F.array_join(F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), empty, step), "/")


def page_id_of_url(url: Column) -> Column:
    return F.when(url.rlike("^[0-9]+$"), url).otherwise(F.nullif(F.regexp_extract(url, r"/wiki/spaces/[^/]+/pages/([0-9]+)", 1), F.lit("")))


def space_of_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/wiki/spaces/([^/]+)/pages/[0-9]+", 1), F.lit(""))


def unwrap_redirect(href: Column) -> Column:
    """The target in the q parameter of a redirect link; other links as they are."""
    q = F.regexp_extract(href, r"^https?://www\.google\.com/url\?(?:[^#]*&)?q=([^&#]*)", 1)
    return F.when(q != "", F.try_url_decode(q)).otherwise(href)


def norm_page_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[ \-_]+", "-"), r"[^a-z0-9_\-]", "")


def snake_key(key: Column) -> Column:
    a = F.regexp_replace(F.replace(key, F.lit("-"), F.lit("_")), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(a, r"([a-z0-9])([A-Z])", "$1_$2"))


def safe_filename(name: Column) -> Column:
    return F.trim(F.left(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), F.lit(100)))


def utf16_len(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def private_use_only(text: Column) -> Column:
    return strip(text).rlike("^[\\uE000-\\uF8FF]+$")


def heading_rank(style: Column) -> Column:
    """n of HEADING_n; 0 for TITLE and SUBTITLE; null for no heading."""
    return F.when(style.isin("TITLE", "SUBTITLE"), 0).otherwise(F.regexp_extract(style, r"^HEADING_([0-9]+)$", 1).try_cast("int"))


def front_matter(content: Column) -> Column:
    """Flat keys of a leading --- block as a map, empty without one; of a key that is given twice the last counts."""
    block = F.regexp_extract(content, r"^---\n((?:[^\n]*\n)*?)---(?:\n|$)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w\-]*:"))
    key = lambda x: F.regexp_extract(x, r"^([^:]*):", 1)
    value = lambda x: F.regexp_replace(strip(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), r"""^["']|["']$""", "")
    keys = F.transform(lines, key)
    last = F.filter(lines, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), key(x)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(key(x), value(x))))


def body_after_front_matter(content: Column) -> Column:
    return F.regexp_replace(content, r"^---\n(?:[^\n]*\n)*?---(?:\n|$)", "")


def doc_title(meta_title: Column, content: Column, path: Column) -> Column:
    """Metadata title, else the first level-1 heading, else the file's stem."""
    h1 = F.nullif(strip(F.regexp_extract(content, r"(?m)^# (.*)$", 1)), F.lit(""))
    return F.coalesce(F.nullif(meta_title, F.lit("")), h1, F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1))


def modified_since(mtime: Column, synced: Column, grace: int = 2) -> Column:
    return F.coalesce(mtime > synced + F.expr(f"interval {grace} seconds"), F.lit(True))


def oneway_action(synced: Column, file_exists: Column, doc_modified: Column, file_modified: Column) -> Column:
    return F.when(synced.isNull(), "copy: first sync").when(~file_exists, "copy: file is missing").when(doc_modified > file_modified, "copy: document is newer").otherwise("skip: file is current")


def conflict_hint(a: Column, b: Column) -> Column:
    """Under a minute apart: simultaneous; else which side is newer and by how many minutes."""
    apart = F.unix_timestamp(a) - F.unix_timestamp(b)
    minutes = F.floor(F.abs(apart) / 60).cast("string")
    return F.when(F.abs(apart) < 60, "simultaneous").when(apart > 0, F.concat(F.lit("document newer by "), minutes, F.lit(" min"))).otherwise(F.concat(F.lit("file newer by "), minutes, F.lit(" min")))


def fence_for(code: Column) -> Column:
    """A fence longer than any run of backticks inside."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(code, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def mermaid_key(code: Column) -> Column:
    return F.left(F.sha2(code, 256), F.lit(12))


def macro_params(params: Column) -> Column:
    """k=v|k=v as a map; parts without = are left out, the last value of a key counts."""
    parts = F.filter(F.split(params, r"\|"), lambda x: x.contains("="))
    entries = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value")))
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def comment_preview(body: Column, most: int = 100) -> Column:
    plain = strip(F.regexp_replace(body, "<[^>]*>", ""))
    return F.when(F.length(plain) > most, F.concat(F.left(plain, F.lit(most)), F.lit("..."))).otherwise(plain)


def editor_type(page: Column) -> Column:
    """v1 or v2 by a page's property, else by the body formats it has; unknown without either. page is JSON."""
    at = lambda p: F.get_json_object(page, p)
    return F.coalesce(F.when(at("$.editor").isin("v1", "v2"), at("$.editor")), F.when(at("$.body.atlas_doc_format").isNotNull(), "v2"), F.when(at("$.body.storage").isNotNull(), "v1"), F.lit("unknown"))


#: Left border of a block quote (colour, points, dash), points of indent a level, greatest difference of a colour.
QUOTE_COLOUR, QUOTE_WIDTH, QUOTE_DASH, QUOTE_INDENT, COLOUR_TOLERANCE = (0.494, 0.549, 0.612), 1, "SOLID", 18, 0.003


def quote_depth(indent: Column, width: Column, dash: Column, red: Column, green: Column, blue: Column) -> Column:
    """Depth of a block quote: its indent in levels, rounded; 0 without an indent or where the left border is not a quote's.

    A colour that was stored in 8 bits comes back a little changed, so colours need only be near.
    """
    near = F.lit(True)
    for own, want in zip((red, green, blue), QUOTE_COLOUR):
        near = near & (F.abs(own - want) < COLOUR_TOLERANCE)
    depth = F.bround(indent / QUOTE_INDENT).cast("int")
    return F.when(near & (width == QUOTE_WIDTH) & (dash == QUOTE_DASH) & (indent > 0) & (depth > 0), depth).otherwise(0)


def inline_code(text: Column) -> Column:
    """A code span: ticks longer than any run inside, a space where the content's own ticks or outer spaces would be lost."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)
    ticks = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = text.startswith("`") | text.endswith("`") | (text.startswith(" ") & text.endswith(" ") & (F.trim(text) != ""))
    return F.when(text == "", text).otherwise(F.concat(ticks, F.when(pad, F.concat(F.lit(" "), text, F.lit(" "))).otherwise(text), ticks))


def render_spans(spans: Column) -> Column:
    """Markdown of an array of spans (text, monospace, bold, italic, link): code, bold, italic, link, from the inside out."""

    def one(x: Column) -> Column:
        text = F.when(x["monospace"], inline_code(x["text"])).otherwise(x["text"])
        for mark, flag in (("**", "bold"), ("*", "italic")):
            text = F.when(x[flag], F.concat(F.lit(mark), text, F.lit(mark))).otherwise(text)
        return F.when(x["link"] != "", F.concat(F.lit("["), text, F.lit("]("), x["link"], F.lit(")"))).otherwise(text)

    return F.array_join(F.transform(spans, one), "")


#: SQL bodies of functions that a session can have without Python; they call each other where one builds on another.
SQL_FUNCTIONS = {
    "fs_strip": ("s string", "string", r"regexp_replace(s, '^\\s+|\\s+$', '')"),
    "fs_slugify": ("s string", "string", r"replace(regexp_replace(lower(regexp_replace(s, '^\\s+|\\s+$', '')), '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\-_ ]', ''), ' ', '-')"),
    "fs_anchor_target": ("href string", "string", "CASE WHEN startswith(href, '#') AND length(href) > 1 THEN try_url_decode(replace(substring(href, 2), '+', '%2B')) END"),
    "fs_cross_doc_path": ("href string", "string", r"""CASE WHEN NOT href RLIKE '^([A-Za-z][A-Za-z0-9+.\\-]*:|/|#|\\?)' THEN nullif(regexp_extract(href, '^([^#?]*)', 1), '') END"""),
    "fs_cross_doc_fragment": ("href string", "string", "nullif(regexp_extract(href, '#(.*)$', 1), '')"),
    "fs_norm_path": (
        "path string", "string",
        r"""array_join(aggregate(split(replace(path, '\\', '/'), '/'), cast(array() AS array<string>), (o, x) -> CASE WHEN x IN ('', '.') THEN o
          WHEN x = '..' AND size(o) > 0 AND coalesce(try_element_at(o, -1), '') <> '..' THEN slice(o, 1, greatest(size(o) - 1, 0)) ELSE array_append(o, x) END), '/')""",
    ),
    "fs_page_id_of_url": ("url string", "string", "CASE WHEN url RLIKE '^[0-9]+$' THEN url ELSE nullif(regexp_extract(url, '/wiki/spaces/[^/]+/pages/([0-9]+)', 1), '') END"),
    "fs_space_of_url": ("url string", "string", "nullif(regexp_extract(url, '/wiki/spaces/([^/]+)/pages/[0-9]+', 1), '')"),
    "fs_unwrap_redirect": ("href string", "string", r"""coalesce(try_url_decode(nullif(regexp_extract(href, '^https?://www\\.google\\.com/url\\?(?:[^#]*&)?q=([^&#]*)', 1), '')), href)"""),
    "fs_norm_page_name": ("s string", "string", r"regexp_replace(regexp_replace(lower(s), '[ \\-_]+', '-'), '[^a-z0-9_\\-]', '')"),
    "fs_snake_key": ("k string", "string", "lower(regexp_replace(regexp_replace(replace(k, '-', '_'), '([A-Z]+)([A-Z][a-z])', '$1_$2'), '([a-z0-9])([A-Z])', '$1_$2'))"),
    "fs_edit_distance": ("a string, b string", "int", "levenshtein(a, b)"),
    "fs_safe_filename": ("s string", "string", r"""trim(left(regexp_replace(s, '[<>:"/\\\\|?*]', '_'), 100))"""),
    "fs_content_hash": ("s string", "string", "sha2(s, 256)"),
    "fs_utf16_len": ("s string", "bigint", "cast(octet_length(encode(s, 'UTF-16BE')) / 2 AS bigint)"),
    "fs_private_use_only": ("s string", "boolean", r"regexp_replace(s, '^\\s+|\\s+$', '') RLIKE '^[\\uE000-\\uF8FF]+$'"),
    "fs_heading_rank": ("style string", "int", "CASE WHEN style IN ('TITLE', 'SUBTITLE') THEN 0 ELSE try_cast(regexp_extract(style, '^HEADING_([0-9]+)$', 1) AS int) END"),
    "fs_front_matter": (
        "content string", "map<string, string>",
        r"""aggregate(filter(split(regexp_extract(content, '^---\\n((?:[^\\n]*\\n)*?)---(?:\\n|$)', 1), '\\n'), x -> x RLIKE '^[A-Za-z_][\\w\\-]*:'), cast(map() AS map<string, string>), (m, x) ->
          map_concat(map_filter(m, (k, v) -> k <> regexp_extract(x, '^([^:]*):', 1)),
            map(regexp_extract(x, '^([^:]*):', 1), regexp_replace(regexp_replace(regexp_extract(x, '^[^:]*:(.*)$', 1), '^\\s+|\\s+$', ''), '^["\']|["\']$', ''))))""",
    ),
    "fs_doc_title": (
        "meta string, content string, path string", "string",
        r"""coalesce(nullif(meta, ''), nullif(regexp_replace(regexp_extract(content, '(?m)^# (.*)$', 1), '^\\s+|\\s+$', ''), ''), regexp_extract(path, '([^/]*?)(?:\\.[^./]*)?$', 1))""",
    ),
    "fs_modified_since": ("mtime timestamp, synced timestamp", "boolean", "coalesce(mtime > synced + interval 2 seconds, true)"),
    "fs_oneway_action": (
        "synced timestamp, file_exists boolean, doc_modified timestamp, file_modified timestamp", "string",
        "CASE WHEN synced IS NULL THEN 'copy: first sync' WHEN NOT file_exists THEN 'copy: file is missing' WHEN doc_modified > file_modified THEN 'copy: document is newer' ELSE 'skip: file is current' END",
    ),
    "fs_conflict_hint": (
        "a timestamp, b timestamp", "string",
        """CASE WHEN abs(unix_timestamp(a) - unix_timestamp(b)) < 60 THEN 'simultaneous'
          ELSE concat(CASE WHEN a > b THEN 'document' ELSE 'file' END, ' newer by ', cast(floor(abs(unix_timestamp(a) - unix_timestamp(b)) / 60) AS string), ' min') END""",
    ),
    "fs_fence_for": ("code string", "string", "repeat('`', greatest(3, 1 + coalesce(array_max(transform(regexp_extract_all(code, '(`+)', 1), x -> length(x))), 0)))"),
    "fs_mermaid_key": ("code string", "string", "left(sha2(code, 256), 12)"),
    "fs_macro_params": (
        "params string", "map<string, string>",
        r"""aggregate(filter(split(params, '\\|'), x -> contains(x, '=')), cast(map() AS map<string, string>), (m, x) ->
          map_concat(map_filter(m, (k, v) -> k <> trim(substring_index(x, '=', 1))), map(trim(substring_index(x, '=', 1)), trim(substring(x, instr(x, '=') + 1)))))""",
    ),
    "fs_comment_preview": (
        "body string", "string",
        r"""CASE WHEN length(regexp_replace(regexp_replace(body, '<[^>]*>', ''), '^\\s+|\\s+$', '')) > 100
          THEN concat(left(regexp_replace(regexp_replace(body, '<[^>]*>', ''), '^\\s+|\\s+$', ''), 100), '...') ELSE regexp_replace(regexp_replace(body, '<[^>]*>', ''), '^\\s+|\\s+$', '') END""",
    ),
    "fs_editor_type": (
        "page string", "string",
        """CASE WHEN get_json_object(page, '$.editor') IN ('v1', 'v2') THEN get_json_object(page, '$.editor') WHEN get_json_object(page, '$.body.atlas_doc_format') IS NOT NULL THEN 'v2'
          WHEN get_json_object(page, '$.body.storage') IS NOT NULL THEN 'v1' ELSE 'unknown' END""",
    ),
    "fs_quote_depth": (
        "indent double, width double, dash string, red double, green double, blue double", "int",
        """CASE WHEN abs(red - 0.494) < 0.003 AND abs(green - 0.549) < 0.003 AND abs(blue - 0.612) < 0.003 AND width = 1 AND dash = 'SOLID' AND indent > 0
          THEN cast(greatest(bround(indent / 18), 0) AS int) ELSE 0 END""",
    ),
    "fs_inline_code": (
        "s string", "string",
        """CASE WHEN s = '' THEN s ELSE concat(repeat('`', 1 + coalesce(array_max(transform(regexp_extract_all(s, '(`+)', 1), x -> length(x))), 0)),
          CASE WHEN startswith(s, '`') OR endswith(s, '`') OR (startswith(s, ' ') AND endswith(s, ' ') AND trim(s) <> '') THEN concat(' ', s, ' ') ELSE s END,
          repeat('`', 1 + coalesce(array_max(transform(regexp_extract_all(s, '(`+)', 1), x -> length(x))), 0))) END""",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Adds SQL_FUNCTIONS to the session; the names they got."""
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)
