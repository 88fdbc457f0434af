"""Trees in JSON: flattening to any depth, checks, reports, comparison; nested tabs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.sources.tables import kept

#: Levels that are taken apart in one pass over the documents; deeper ones go another round.
AT_ONCE = 8

NO_PATH = "cast(array() AS array<int>)"
NO_NODES = "cast(array() AS array<variant>)"


def variants(v: Column, path: str) -> Column:
    """The elements of a list inside a variant; none where there is no list."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.expr(NO_NODES))


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def shape_at(v: Column, path: str) -> Column:
    """list, other, or null where there is nothing."""
    return F.when(F.try_variant_get(v, path, "array<variant>").isNotNull(), "list").when(F.try_variant_get(v, path, "variant").isNotNull(), "other")


def descend(roots: DataFrame, keys: list[str], children: Callable[[Column], Column], pick: Callable[[Column], dict[str, Column]], inherit: Callable[[Column], Column] | None = None) -> DataFrame:
    """keys, path and the picked columns of every node below the variant `v` of each row, the root with an empty path.

    children gives a node's children (array<variant>), pick the columns of a node, a struct of path, v and up, which is what its parent
    handed down (inherit, a string).
    Levels are taken apart inside a document's row, AT_ONCE of them in one pass; what is deeper is written and goes on from
    there, until no level is left. Nothing is shuffled.
    """
    hand_down = inherit or (lambda n: F.lit(None).cast("string"))
    start = F.struct(F.expr(NO_PATH).alias("path"), F.col("v"), F.lit(None).cast("string").alias("up"))
    rows = roots.select(*keys, F.array(start).alias("l0"))

    def below(level: str) -> Column:
        one = lambda n: F.transform(children(n["v"]), lambda x, i: F.struct(F.array_append(n["path"], i).alias("path"), x.alias("v"), hand_down(n).alias("up")))
        return F.flatten(F.transform(level, one))

    out = None
    while True:
        for k in range(AT_ONCE):
            rows = rows.withColumn(f"l{k + 1}", below(f"l{k}"))
        columns = lambda n: F.struct(n["path"].alias("path"), *[c.alias(name) for name, c in pick(n).items()])
        found = F.flatten(F.array(*[F.transform(f"l{k}", columns) for k in range(AT_ONCE)]))
        rows = kept(rows.select(*keys, found.alias("found"), F.col(f"l{AT_ONCE}").alias("l0")))
        part = rows.select(*keys, F.explode("found").alias("n")).select(*keys, "n.*")
        out = part if out is None else out.unionByName(part)
        rows = rows.where(F.size("l0") > 0).select(*keys, "l0")
        if rows.isEmpty():
            return out


#: What stands inside these is checked, too; children of other nodes are not.
CONTAINERS = ("paragraph", "heading", "bulletList", "orderedList", "listItem", "blockquote", "panel")
#: Which types may stand below which, where that is asked for.
ALLOWED = {"bulletList": ["listItem"], "orderedList": ["listItem"], "taskList": ["taskItem", "taskList"], "table": ["tableRow"], "tableRow": ["tableCell", "tableHeader"], "codeBlock": ["text"]}
#: Types of nodes and marks that are known.
NODE_TYPES = [
    "doc", "paragraph", "heading", "text", "bulletList", "orderedList", "listItem", "taskList", "taskItem", "codeBlock", "blockquote", "panel", "rule", "table", "tableRow", "tableHeader", "tableCell",
    "media", "mediaSingle", "mediaGroup", "mention", "emoji", "status", "date", "expand", "nestedExpand", "hardBreak", "inlineCard", "blockCard", "layoutSection", "layoutColumn", "extension", "inlineExtension", "bodiedExtension",
]
MARK_TYPES = ["strong", "em", "code", "link", "strike", "underline", "textColor", "backgroundColor", "subsup"]


def flatten_nodes(trees: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Every node of doc_id, body (JSON): doc_id, path (places from the top, each from 0), depth, type, parent (its type),
    checked (all nodes above are containers), is_object, text, content and marks (list, other or null), mark_list, level (the node's own),
    version, attrs, n_children.

    A body that is no JSON has one row, the root, that is no object. With `only`, those columns beside doc_id and path: what is
    not asked for is not worked out and not written.
    """
    body = trees.select("doc_id", F.try_parse_json("body").alias("v"))

    def pick(n: Column) -> dict[str, Column]:
        v = n["v"]
        every = {
            "depth": F.size(n["path"]), "type": text_at(v, "$.type"), "parent": F.substring_index(n["up"], " ", 1), "checked": ~F.coalesce(n["up"], F.lit("")).contains("!"), "is_object": F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)),
            "text": text_at(v, "$.text"), "content": shape_at(v, "$.content"), "marks": shape_at(v, "$.marks"), "mark_list": variants(v, "$.marks"), "level": text_at(v, "$.level"), "version": text_at(v, "$.version"), "attrs": F.try_variant_get(v, "$.attrs", "variant"),
            "n_children": F.size(variants(v, "$.content")),
        }
        return every if only is None else {k: every[k] for k in only}

    # the parent's type, and a mark behind it once a node above is no container
    def inherit(n: Column) -> Column:
        kind = F.coalesce(text_at(n["v"], "$.type"), F.lit(""))
        closed = (F.size(n["path"]) > 0) & ~kind.isin(*CONTAINERS) | F.coalesce(n["up"], F.lit("")).contains("!")
        return F.concat(kind, F.when(closed, " !").otherwise(" "))

    handed = inherit if only is None or {"parent", "checked"} & set(only) else None
    return descend(body, ["doc_id"], lambda v: variants(v, "$.content"), pick, handed)


def node_violations(nodes: DataFrame, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, path, violation of rows of flatten_nodes.

    The root: version 1, type doc, a list of content. Below, inside containers only: nodes are objects with a type; texts have a
    text and a list of marks; containers and code blocks a list of content; a heading's own level, if given, is a whole number from 1 to
    6; media have a type, external ones a URL, files an id. With `allowed`, a child's type is among those of its parent.
    """
    top, kind = F.col("depth") == 0, F.col("type")
    attr = lambda name: F.coalesce(F.try_variant_get("attrs", f"$.{name}", "string"), F.lit(""))
    node = ~top & F.col("checked")
    there = node & F.col("is_object")
    rules = [
        F.when(top & ~F.col("version").eqNullSafe(F.lit("1")), "version"), F.when(top & ~kind.eqNullSafe(F.lit("doc")), "root_type"), F.when(node & ~F.col("is_object"), "no_object"),
        F.when(there & (F.coalesce(kind, F.lit("")) == ""), "no_type"), F.when(there & (kind == "text") & F.col("text").isNull(), "no_text"), F.when(there & (kind == "text") & (F.col("marks") == "other"), "marks_no_list"),
        F.when((top | there & kind.isin(*CONTAINERS, "codeBlock")) & (F.col("content") == "other"), "content_no_list"), F.when(there & (kind == "heading") & F.col("level").isNotNull() & ~F.col("level").rlike("^[1-6]$"), "heading_level"),
        F.when(there & (kind == "media") & (attr("type") == ""), "media_type"), F.when(there & (kind == "media") & (attr("type") == "external") & (attr("url") == ""), "media_url"),
        F.when(there & (kind == "media") & (attr("type") == "file") & (attr("id") == ""), "media_id"),
    ]
    for parent, kinds in (allowed or {}).items():
        rules.append(F.when(~top & (F.col("parent") == parent) & kind.isNotNull() & ~kind.isin(kinds), "child_type"))
    return nodes.select("doc_id", "path", F.explode(F.array_compact(F.array(*rules))).alias("violation"))


def tree_texts(nodes: DataFrame) -> DataFrame:
    """doc_id, text: all texts of a tree in document order."""
    parts = F.sort_array(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("path", "text"))))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def node_links(nodes: DataFrame) -> DataFrame:
    """doc_id, path, href, text, title of every link mark; the text is that of the marked node."""
    marks = nodes.where(F.size("mark_list") > 0).select("doc_id", "path", "text", F.explode("mark_list").alias("m")).where(text_at(F.col("m"), "$.type") == "link")
    return marks.select("doc_id", "path", text_at(F.col("m"), "$.attrs.href").alias("href"), F.coalesce("text", F.lit("")).alias("text"), text_at(F.col("m"), "$.attrs.title").alias("title"))


def node_attrs(nodes: DataFrame, kind: str, names: dict[str, str]) -> DataFrame:
    """doc_id, path and the named attributes (column: attribute) of all nodes of a type."""
    return nodes.where(F.col("type") == kind).select("doc_id", "path", *[F.try_variant_get("attrs", f"$.{a}", "string").alias(c) for c, a in names.items()])


def node_mentions(nodes: DataFrame) -> DataFrame:
    return node_attrs(nodes, "mention", {"id": "id", "text": "text", "access_level": "accessLevel"})


def node_media(nodes: DataFrame) -> DataFrame:
    return node_attrs(nodes, "media", {"id": "id", "type": "type", "collection": "collection", "alt": "alt", "width": "width", "height": "height"})


def tree_report(nodes: DataFrame) -> DataFrame:
    """doc_id, nodes, text_length, links, mentions, media, unknown_nodes, unknown_marks (sorted types), in one aggregation."""
    link = F.size(F.filter("mark_list", lambda m: text_at(m, "$.type") == "link"))
    odd_marks = F.filter(F.transform("mark_list", lambda m: text_at(m, "$.type")), lambda t: ~t.isin(MARK_TYPES))
    odd = F.when(F.col("is_object") & F.col("type").isNotNull() & ~F.col("type").isin(NODE_TYPES), F.col("type"))
    return nodes.where("is_object").groupBy("doc_id").agg(
        F.count("*").alias("nodes"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("text_length"), F.sum(link).alias("links"), F.count_if(F.col("type") == "mention").alias("mentions"), F.count_if(F.col("type") == "media").alias("media"),
        F.array_join(F.sort_array(F.collect_set(odd)), ",").alias("unknown_nodes"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(odd_marks)))), ",").alias("unknown_marks"),
    )


def compare_trees(generated: DataFrame, existing: DataFrame) -> DataFrame:
    """doc_id, type, n_generated, n_existing of node types whose counts differ; only types of the generated side."""
    count = lambda x, n: x.where("type IS NOT NULL").groupBy("doc_id", "type").agg(F.count("*").alias(n))
    both = count(generated, "n_generated").join(count(existing, "n_existing"), ["doc_id", "type"], "left")
    return both.select("doc_id", "type", "n_generated", F.coalesce("n_existing", F.lit(0)).alias("n_existing")).where("n_generated <> n_existing")


def tree_differences(generated: DataFrame, existing: DataFrame, similarity: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """doc_id, type, location, expected, actual, severity of two sides of flatten_nodes rows.

    Counts of node types as compare_trees has them, medium each; where the texts differ a row text_content, high below a similarity
    of 0.8. similarity takes two sides of doc_id, content and gives doc_id, bag_ratio.
    """
    counts = compare_trees(generated, existing).select("doc_id", F.lit("structure_mismatch").alias("type"), F.concat(F.lit("node_count."), "type").alias("location"), F.col("n_generated").cast("string").alias("expected"), F.col("n_existing").cast("string").alias("actual"), F.lit("medium").alias("severity"))
    a, b = (tree_texts(x).select("doc_id", F.col("text").alias("content")) for x in (generated, existing))
    differ = kept(a.join(b.select("doc_id", F.col("content").alias("other")), "doc_id").where("content <> other"))
    ratio = similarity(differ.select("doc_id", "content"), differ.select("doc_id", F.col("other").alias("content"))).select("doc_id", "bag_ratio")
    chars = lambda side, c: F.concat(F.lit(f"{side} text ("), F.length(c).cast("string"), F.lit(" chars)"))
    texts = differ.join(ratio, "doc_id").select("doc_id", F.lit("text_mismatch").alias("type"), F.lit("text_content").alias("location"), chars("generated", "content").alias("expected"), chars("existing", "other").alias("actual"), F.when(F.col("bag_ratio") < 0.8, "high").otherwise("medium").alias("severity"))
    return counts.unionByName(texts)


#: Kinds of differences and severities of a report.
DIFFERENCES = ["missing_content", "extra_content", "structure_mismatch", "text_mismatch", "attribute_mismatch", "link_mismatch", "format_mismatch"]
SEVERITIES = ["low", "medium", "high"]


def difference_rollup(differences: DataFrame) -> DataFrame:
    """doc_id, total, and the number of differences of each type and of each severity, zeros too."""
    return differences.groupBy("doc_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("type") == x).alias(x) for x in DIFFERENCES], *[F.count_if(F.col("severity") == x).alias(x) for x in SEVERITIES])


def compare_structure(source: DataFrame, converted: DataFrame) -> DataFrame:
    """doc_id, feature, expected, actual, severity where headings, list items or fences differ in number."""
    n = lambda p: F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike(p))).cast("long")
    count = lambda x, s: x.select("doc_id", n("^#{1,6} ").alias(f"headings{s}"), n("^- ").alias(f"items{s}"), n("^```").alias(f"fences{s}"))
    both = count(source, "_a").join(count(converted, "_b"), "doc_id")
    rows = both.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"{k}_a").alias("expected"), F.col(f"{k}_b").alias("actual")) for k in ("headings", "items", "fences")])).alias("x")).select("doc_id", "x.*")
    return rows.where("expected <> actual").withColumn("severity", F.when(F.abs(F.col("expected") - F.col("actual")) > 2, "high").otherwise("medium"))


def compare_export(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, type, location, expected, actual, severity: headings, lists, code blocks and links of a source against its tree.

    source: doc_id, headings, lists, code_blocks, links; a document without a tree has nothing there. Only a difference in headings is
    of high severity.
    """
    links = F.size(F.filter("mark_list", lambda m: text_at(m, "$.type") == "link"))
    found = nodes.groupBy("doc_id").agg(F.count_if(F.col("type") == "heading").alias("h"), F.count_if(F.col("type").isin("bulletList", "orderedList")).alias("l"), F.count_if(F.col("type") == "codeBlock").alias("c"), F.sum(links).alias("k"))
    row = lambda kind, name, a, b, s: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("location"), F.col(a).cast("long").alias("expected"), F.coalesce(b, F.lit(0)).cast("long").alias("actual"), F.lit(s).alias("severity"))
    rows = F.array(row("structure_mismatch", "headings", "headings", "h", "high"), row("structure_mismatch", "lists", "lists", "l", "medium"), row("structure_mismatch", "code_blocks", "code_blocks", "c", "medium"), row("link_mismatch", "links", "links", "k", "medium"))
    return source.join(found, "doc_id", "left").select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*").where("expected <> actual")


def flatten_tabs(tabs: DataFrame) -> DataFrame:
    """doc_id, tab_id, depth, place of nested tabs given as rows (doc_id, tab_id, parent_id, pos), in document order.

    Level by level joins, as deep as the tabs are; each level is written once. Siblings keep their pos. Tabs whose parents
    form a ring are below no root and have no row.
    """
    level = kept(tabs.where("parent_id IS NULL").select("doc_id", "tab_id", F.lit(0).alias("depth"), F.array("pos").alias("path")))
    out = level
    while True:
        up = level.select("doc_id", F.col("tab_id").alias("parent_id"), "depth", "path")
        level = kept(up.join(tabs, ["doc_id", "parent_id"]).select("doc_id", "tab_id", (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("pos")).alias("path")))
        if level.isEmpty():
            return out.select("doc_id", "tab_id", "depth", F.row_number().over(W.partitionBy("doc_id").orderBy("path")).alias("place"))
        out = out.unionByName(level)


def foreign_headings(headings: DataFrame) -> DataFrame:
    """doc_id, heading_id, tab: ids of one tab only; an id in several tabs is dropped."""
    return headings.where("heading_id <> ''").groupBy("doc_id", "heading_id").agg(F.min("tab").alias("tab"), F.count_distinct("tab").alias("tabs")).where("tabs = 1").drop("tabs")
