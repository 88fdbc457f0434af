"""Bodies of documents as a backend gives them, in JSON: paragraphs, tables and images of all tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.expr import private_use_only, quote_depth, strip
from folioscope.operators.links import heading_slugs
from folioscope.operators.tree import descend, text_at, variants

#: Parts of the names of monospaced fonts; what a paragraph cannot be deleted in front of; the glyph of check boxes.
MONOSPACE = ["courier", "mono", "consolas", "menlo", "monaco", "fira code", "inconsolata", "source code pro", "cascadia code"]
BOUNDARIES = ["table", "tableOfContents", "sectionBreak"]
CHECKBOX_GLYPH = "GLYPH_TYPE_UNSPECIFIED"

SPANS = "array<struct<text: string, bold: boolean, italic: boolean, link: string, lost: string, monospace: boolean>>"


def has(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNotNull()


def filled(c: Column) -> Column:
    """c, null where it is empty."""
    return F.when(c != "", c)


def flag(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))


def document_tabs(docs: DataFrame) -> DataFrame:
    """doc_id, path, tab_id, title, v of every tab of doc_id, body (JSON), however deep; v holds body, lists and inlineObjects.

    A document without tabs has one row with an empty path, whose v is null if it has no body either.
    """
    v = docs.select("doc_id", F.try_parse_json("body").alias("v"))
    children = lambda x: F.when(F.size(variants(x, "$.tabs")) > 0, variants(x, "$.tabs")).otherwise(variants(x, "$.childTabs"))

    def pick(n: Column) -> dict[str, Column]:
        x, top = n["v"], F.size(n["path"]) == 0
        own = F.when(top, F.when((F.size(variants(x, "$.tabs")) == 0) & has(x, "$.body"), x)).otherwise(F.coalesce(F.try_variant_get(x, "$.documentTab", "variant"), x))
        return {"tab_id": text_at(x, "$.tabProperties.tabId"), "title": text_at(x, "$.tabProperties.title"), "tabbed": top & (F.size(variants(x, "$.tabs")) > 0), "v": own}

    return descend(v, ["doc_id"], children, pick).where("NOT tabbed").drop("tabbed")


def parsed_link(run: Column) -> tuple[Column, Column]:
    """The address of a run's link (a heading as # and its id), and what kind of link is lost where there is none."""
    at = lambda p: filled(text_at(run, f"$.textRun.textStyle.link.{p}"))
    link = F.coalesce(at("url"), F.concat(F.lit("#"), at("headingId")), F.concat(F.lit("#"), at("heading.id")))
    any_link = F.size(F.coalesce(F.try_variant_get(run, "$.textRun.textStyle.link", "map<string,variant>"), F.expr("map()").cast("map<string,variant>"))) > 0
    lost = F.when(has(run, "$.textRun.textStyle.link.bookmarkId") | has(run, "$.textRun.textStyle.link.bookmark"), "bookmark").when(has(run, "$.textRun.textStyle.link.tabId"), "tab").otherwise("unknown")
    return link, F.when(link.isNull() & any_link, lost)


def person_name(element: Column) -> Column:
    return F.coalesce(filled(text_at(element, "$.person.personProperties.name")), filled(text_at(element, "$.person.personProperties.email")), F.lit(""))


def spans_of(elements: Column, fonts: list[str]) -> Column:
    """Text runs and people of a paragraph's elements, as SPANS; empty ones too."""

    def span(e: Column) -> Column:
        style = "$.textRun.textStyle"
        link, lost = parsed_link(e)
        font = F.lower(F.coalesce(text_at(e, f"{style}.weightedFontFamily.fontFamily"), F.lit("")))
        mono = font.rlike("|".join(fonts))
        run = has(e, "$.textRun")
        return F.struct(
            F.when(run, F.coalesce(text_at(e, "$.textRun.content"), F.lit(""))).otherwise(person_name(e)).alias("text"), (run & flag(e, f"{style}.bold")).alias("bold"), (run & flag(e, f"{style}.italic")).alias("italic"),
            link.alias("link"), lost.alias("lost"), (run & mono).alias("monospace"),
        )

    return F.transform(F.filter(elements, lambda e: has(e, "$.textRun") | (person_name(e) != "")), span)


def cut_spans(spans: Column, cut_left: bool, space: str) -> Column:
    """Spans without the white space (a class of characters) at the end of their joined text, and at its start too if asked; none is empty."""
    solid = F.transform(spans, lambda s: s["text"].rlike(f"[^{space}]"))
    first = F.array_position(solid, True) - 1
    last = F.size(spans) - F.array_position(F.reverse(solid), True)

    def trimmed(s: Column, i: Column) -> Column:
        text = F.when(i == last, F.regexp_replace(s["text"], rf"[{space}]+\z", "")).otherwise(s["text"])
        if cut_left:
            text = F.when(i == first, F.regexp_replace(text, rf"\A[{space}]+", "")).otherwise(text)
        return s.withField("text", text)

    inside = lambda s, i: (i <= last) & (i >= first) if cut_left else (i <= last)
    return F.filter(F.transform(F.filter(F.transform(spans, lambda s, i: F.when(inside(s, i), trimmed(s, i))), lambda s: s.isNotNull()), lambda s: s), lambda s: s["text"] != "")


def text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: s["text"]), "")


def styled(spans: Column) -> Column:
    return F.exists(spans, lambda s: s["bold"] | s["italic"] | s["link"].isNotNull() | s["monospace"])


def raw_cells(table: Column) -> Column:
    """Rows of cells of a table, each its spans as they are."""
    spans = lambda c: spans_of(F.flatten(F.transform(variants(c, "$.content"), lambda p: variants(p, "$.paragraph.elements"))), ["courier", "mono"])
    return F.transform(variants(table, "$.tableRows"), lambda r: F.transform(variants(r, "$.tableCells"), spans))


def cells_of(raw: Column) -> Column:
    """Rows of cells (text, spans) from raw_cells; an unstyled cell has no spans."""
    none = F.expr(f"cast(array() AS {SPANS})")
    cell = lambda spans: F.struct(strip(text_of(spans)).alias("text"), F.when(styled(spans), cut_spans(spans, True, r"\s")).otherwise(none).alias("spans"))
    return F.transform(raw, lambda r: F.transform(r, cell))


def render_prefix(elements: Column) -> Column:
    """Private-use glyphs that stand in runs of their own before all text."""
    content = lambda e: F.coalesce(text_at(e, "$.textRun.content"), F.lit(""))
    stop = F.transform(elements, lambda e: ~has(e, "$.textRun") | ((content(e) != "") & ~private_use_only(content(e))))
    before = F.when(F.array_contains(stop, True), F.array_position(stop, True) - 1).otherwise(F.size(elements)).cast("int")
    return F.array_join(F.transform(F.slice(elements, F.lit(1), before), lambda e: F.regexp_replace(content(e), r"\A\n+|\n+\z", "")), "")


def docs_json_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of doc_id, body (JSON), of documents with tabs and of plain ones: doc_id, path (of the tab), tab_id, pos (in the tab's
    content), kind, and what the kind has; other elements are passed over.

    paragraph: style, text, is_list_item, nesting_level, native_checkbox, heading_id, quote_depth, render_prefix,
    precedes_boundary, spans. table: cells. image (a paragraph that holds one inline image and nothing else): object_id, src,
    alt, width, height. no_body: a document without a body. Links to headings of the same tab become links to their slugs.
    """
    tabs = document_tabs(docs)
    e, tab = F.col("e"), F.col("v")
    content = variants(tab, "$.body.content")
    paired = F.transform(content, lambda x, i: F.struct(x.alias("e"), F.get(content, i + 1).alias("next")))
    # lists and inline objects of the tab, so that elements need not carry the whole of it
    maps = {k: F.try_variant_get(tab, f"$.{k}", "map<string,variant>") for k in ("lists", "inlineObjects")}
    rows = tabs.where("v IS NOT NULL").select("doc_id", "path", "tab_id", *[m.alias(k) for k, m in maps.items()], F.posexplode(paired).alias("pos", "x")).select("*", "x.e", "x.next").drop("x")

    elements = F.col("elements")
    rows = rows.where(has(e, "$.paragraph") | has(e, "$.table")).withColumn("elements", variants(e, "$.paragraph.elements"))
    image = F.filter(elements, lambda x: has(x, "$.inlineObjectElement"))
    more = F.exists(elements, lambda x: ~has(x, "$.inlineObjectElement") & (~has(x, "$.textRun") | F.coalesce(text_at(x, "$.textRun.content"), F.lit("")).rlike(r"[^\n]")))
    kind = F.when(has(e, "$.paragraph") & (F.size(image) == 1) & ~more, "image").when(has(e, "$.paragraph"), "paragraph").otherwise("table")
    rows = rows.withColumn("kind", kind).withColumn("object_id", F.when(F.col("kind") == "image", text_at(F.get(image, F.lit(0)), "$.inlineObjectElement.inlineObjectId")))
    # each step is a column of its own, so that it is worked out once
    rows = rows.withColumns({"spans": F.when(F.col("kind") == "paragraph", spans_of(elements, MONOSPACE)), "cells": F.when(F.col("kind") == "table", raw_cells(F.try_variant_get(e, "$.table", "variant")))})
    rows = rows.withColumns({"spans": cut_spans(F.col("spans"), False, r"\n"), "cells": cells_of(F.col("cells"))})

    p = "$.paragraph.paragraphStyle"
    number = lambda v, path: F.try_variant_get(v, path, "double")
    paragraph = lambda c: F.when(F.col("kind") == "paragraph", c)
    colour = [number(e, f"{p}.borderLeft.color.color.rgbColor.{c}") for c in ("red", "green", "blue")]
    depth = F.coalesce(quote_depth(number(e, f"{p}.indentStart.magnitude"), number(e, f"{p}.borderLeft.width.magnitude"), text_at(e, f"{p}.borderLeft.dashStyle"), *colour), F.lit(0))
    level = F.coalesce(F.try_variant_get(e, "$.paragraph.bullet.nestingLevel", "int"), F.lit(0))
    glyphs = variants(F.try_element_at(F.col("lists"), text_at(e, "$.paragraph.bullet.listId")), "$.listProperties.nestingLevels")
    box = F.coalesce(text_at(F.get(glyphs, level), "$.glyphType") == CHECKBOX_GLYPH, F.lit(False))
    boundary = F.lit(False)
    for b in BOUNDARIES:
        boundary = boundary | has(F.col("next"), f"$.{b}")
    picture = F.try_element_at(F.col("inlineObjects"), F.col("object_id"))
    inner = "$.inlineObjectProperties.embeddedObject"
    source = F.coalesce(filled(text_at(picture, f"{inner}.contentUri")), text_at(picture, f"{inner}.imageProperties.contentUri"), F.lit(""))
    alt = F.coalesce(filled(text_at(picture, f"{inner}.description")), text_at(picture, f"{inner}.title"), F.lit(""))
    is_image = lambda c: F.when(F.col("kind") == "image", c)
    out = rows.select(
        "doc_id", "path", "tab_id", "pos", "kind", paragraph(F.coalesce(text_at(e, f"{p}.namedStyleType"), F.lit("NORMAL_TEXT"))).alias("style"), paragraph(text_of(F.col("spans"))).alias("text"),
        paragraph(has(e, "$.paragraph.bullet")).alias("is_list_item"), paragraph(F.when(has(e, "$.paragraph.bullet"), level).otherwise(0)).alias("nesting_level"), paragraph(box).alias("native_checkbox"),
        paragraph(text_at(e, f"{p}.headingId")).alias("heading_id"), paragraph(depth).alias("quote_depth"), paragraph(render_prefix(elements)).alias("render_prefix"), paragraph(F.col("next").isNotNull() & F.coalesce(boundary, F.lit(False))).alias("precedes_boundary"),
        "spans", "cells", "object_id", is_image(source).alias("src"), is_image(alt).alias("alt"),
        is_image(number(picture, f"{inner}.size.width.magnitude")).alias("width"), is_image(number(picture, f"{inner}.size.height.magnitude")).alias("height"),
    )
    none = tabs.where("v IS NULL").select("doc_id", "path", "tab_id", F.lit(-1).alias("pos"), F.lit("no_body").alias("kind"))
    return with_slugs(out).unionByName(none, allowMissingColumns=True)


def with_slugs(blocks: DataFrame) -> DataFrame:
    """Blocks whose spans link to the slugs of the tab's headings instead of their ids; other links are as they were."""
    key = F.struct("doc_id", "path")
    heads = blocks.where((F.col("kind") == "paragraph") & F.col("style").rlike("^HEADING_[1-6]$")).select(key.alias("doc_id"), F.col("pos").alias("j"), F.lit(1).alias("level"), F.col("text").alias("title"))
    ids = blocks.where("heading_id IS NOT NULL").select(key.alias("doc_id"), F.col("pos").alias("j"), "heading_id")
    named = heading_slugs(heads).join(ids, ["doc_id", "j"]).groupBy("doc_id", "heading_id").agg(F.min_by("slug", "j").alias("slug"))
    maps = named.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("#"), "heading_id"), F.concat(F.lit("#"), "slug")))).alias("slugs")).select("doc_id.doc_id", "doc_id.path", "slugs")
    linked = F.transform("spans", lambda s: s.withField("link", F.coalesce(F.try_element_at(F.col("slugs"), s["link"]), s["link"])))
    return blocks.join(maps, ["doc_id", "path"], "left").withColumn("spans", F.when(F.col("slugs").isNotNull(), linked).otherwise(F.col("spans"))).drop("slugs")


def lost_links(blocks: DataFrame) -> DataFrame:
    """doc_id, lost, n: kinds of links that a document's runs have and no address can express."""
    in_cells = F.flatten(F.transform(F.flatten("cells"), lambda c: c["spans"]))
    every = blocks.select("doc_id", F.explode(F.concat(F.coalesce("spans", F.expr(f"cast(array() AS {SPANS})")), F.coalesce(in_cells, F.expr(f"cast(array() AS {SPANS})")))).alias("s"))
    return every.where("s.lost IS NOT NULL").groupBy("doc_id", "s.lost").agg(F.count("*").alias("n"))
