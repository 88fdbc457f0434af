"""Heading slugs, anchors, cross-document links and wiki links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.expr import anchor_target, cross_doc_fragment, cross_doc_path, norm_page_name, norm_path, slugify
from folioscope.sources.tables import kept


def heading_slugs(headings: DataFrame) -> DataFrame:
    """headings with slug: repeats of a base slug get -1, -2 and so on, passing over names that another heading owns.

    Headings are numbered by a window. Documents in which a suffixed name meets another heading's name are gone through
    heading by heading in place order, each name once, so that any document takes time in proportion to its headings.
    """
    h = headings.withColumn("base", slugify(F.col("title")))
    h = h.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "base").orderBy("j")) - 1)
    h = h.withColumn("plain", F.when(F.col("nth") == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("nth").cast("string"))))
    h = h.withColumn("clash", F.max(F.count("*").over(W.partitionBy("doc_id", "plain")) > 1).over(W.partitionBy("doc_id")))
    easy = h.where("NOT clash").select("doc_id", "j", "level", "title", F.col("plain").alias("slug"))
    hard = h.where("clash").select("doc_id", "j", "level", "title", F.col("base").alias("slug"))
    n = int(h.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return easy.unionByName(hard.repartition(n, "doc_id").sortWithinPartitions("doc_id", "j").mapInArrow(numbered_in_order, hard.schema))


def numbered_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by doc_id and j, with the base slug as slug, to those with names that no earlier heading has."""
    doc, last = None, {}  # last: highest suffix given to each name of the document
    for batch in batches:
        out = []
        for d, base in zip(batch.column("doc_id").to_pylist(), batch.column("slug").to_pylist()):
            if d != doc:
                doc, last = d, {}
            slug = base
            while slug in last:
                last[base] += 1
                slug = f"{base}-{last[base]}"
            last[slug] = 0
            out.append(slug)
        yield batch.set_column(batch.schema.get_field_index("slug"), "slug", pa.array(out, pa.string()))


def anchors(links: DataFrame) -> DataFrame:
    """Links to a place in the same document, with the decoded target."""
    return links.where("NOT image").withColumn("target", anchor_target(F.col("href"))).where("target IS NOT NULL")


def resolve_anchors(links: DataFrame, slugs: DataFrame, ids: DataFrame) -> DataFrame:
    """Anchors with kind heading_id, slug or none; a heading id is preferred; both are matched exactly."""
    a = anchors(links)
    s = slugs.select("doc_id", F.col("slug").alias("target"), F.lit(1).alias("by_slug")).distinct()
    i = ids.select("doc_id", F.col("heading_id").alias("target"), F.lit(1).alias("by_id")).distinct()
    df = a.join(i, ["doc_id", "target"], "left").join(s, ["doc_id", "target"], "left")
    return df.select("doc_id", "j", "k", "target", F.when(F.col("by_id").isNotNull(), "heading_id").when(F.col("by_slug").isNotNull(), "slug").otherwise("none").alias("kind"))


def slug_ids(markdown: DataFrame, document: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, slug, heading_id: where a markdown's anchors lead in a document that it was aligned with.

    markdown: doc_id, j, title of its headings; document: doc_id, j, title, heading_id (null where it has none); pairs: doc_id, l
    (place in the document), r (in the markdown). Slugs are those of the markdown's headings, ids those of the document's
    aligned ones. Slugs of the document alone fill in underneath. A markdown slug whose heading is not aligned, or to one without
    an id, keeps the document's entry of that slug only if both have one base slug, the document has that base once and the
    id is no other anchor's; else it leads nowhere.
    """
    level = lambda x: x.withColumn("level", F.lit(1))
    d = heading_slugs(level(document)).withColumn("base", slugify(F.col("title"))).join(document.select("doc_id", "j", "heading_id"), ["doc_id", "j"])
    d = kept(d.withColumn("n", F.count("*").over(W.partitionBy("doc_id", "base"))).select("doc_id", "j", "slug", "base", "heading_id", "n"))
    m = heading_slugs(level(markdown)).select("doc_id", "j", "slug", slugify(F.col("title")).alias("base"))
    aligned = pairs.select("doc_id", F.col("l").alias("l"), F.col("r").alias("j")).join(d.select("doc_id", F.col("j").alias("l"), "heading_id"), ["doc_id", "l"])
    m = kept(m.join(aligned.select("doc_id", "j", "heading_id"), ["doc_id", "j"], "left"))
    named = d.where("heading_id IS NOT NULL")
    entry = named.groupBy("doc_id", "slug").agg(F.max_by(F.struct("heading_id", "base", "n"), "j").alias("e")).select("doc_id", "slug", "e.*")
    paired = m.where("heading_id IS NOT NULL").select("doc_id", "slug", "heading_id")
    alone = entry.join(m.select("doc_id", "slug").distinct(), ["doc_id", "slug"], "left_anti").select("doc_id", "slug", "heading_id")
    sure = kept(paired.unionByName(alone))
    late = m.where("heading_id IS NULL").select("doc_id", "slug", F.col("base").alias("own")).join(entry, ["doc_id", "slug"]).where("own = base AND n = 1")
    return sure.unionByName(late.select("doc_id", "slug", "heading_id").join(sure.select("doc_id", "heading_id"), ["doc_id", "heading_id"], "left_anti").select("doc_id", "slug", "heading_id"))


def anchor_tiers(links: DataFrame, slugs: DataFrame, ids: DataFrame, siblings: DataFrame) -> DataFrame:
    """doc_id, j, k, target, kind, heading_id, tab of anchors: a heading id of the document itself, else a slug (slug_ids), else an id
    of a sibling tab, else none. Targets are matched exactly. siblings: doc_id, heading_id, tab, as foreign_headings gives them.
    """
    known = ids.where("heading_id IS NOT NULL").select("doc_id", F.col("heading_id").alias("target")).distinct().withColumn("own", F.lit(True))
    df = anchors(links).join(known, ["doc_id", "target"], "left").join(slugs.select("doc_id", F.col("slug").alias("target"), F.col("heading_id").alias("by_slug")), ["doc_id", "target"], "left")
    df = df.join(siblings.select("doc_id", F.col("heading_id").alias("target"), "tab"), ["doc_id", "target"], "left")
    kind = F.when(F.col("own"), "heading_id").when(F.col("by_slug").isNotNull(), "slug").when(F.col("tab").isNotNull(), "sibling_tab").otherwise("none")
    found = df.withColumn("kind", kind)
    heading = F.when(F.col("kind").isin("heading_id", "sibling_tab"), F.col("target")).otherwise(F.col("by_slug"))
    return found.select("doc_id", "j", "k", "target", "kind", heading.alias("heading_id"), F.when(F.col("kind") == "sibling_tab", F.col("tab")).alias("tab"))


def dead_anchors(links: DataFrame, slugs: DataFrame, *more: DataFrame) -> DataFrame:
    """doc_id, target, place (in order of first use) of anchors that no heading has; links in table cells are links, too.

    slugs, and each of more, has doc_id and slug: a dry run takes those of the markdown and those of the document.
    """
    known = slugs.select("doc_id", "slug")
    for x in more:
        known = known.unionByName(x.select("doc_id", "slug"))
    a = anchors(links).join(known.select("doc_id", F.col("slug").alias("target")), ["doc_id", "target"], "left_anti")
    first = a.groupBy("doc_id", "target").agg(F.min(F.struct("j", "k")).alias("at"))
    return first.select("doc_id", "target", F.row_number().over(W.partitionBy("doc_id").orderBy("at")).alias("place"))


def top_dead_anchors(dead: DataFrame, most: int = 5) -> DataFrame:
    """The first few dead anchors of each document, joined, and how many more there are."""
    return dead.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "target")))), lambda x: x["target"]), ", ").alias("shown"), F.greatest(F.count("*") - most, F.lit(0)).alias("more")
    )


def resolve_cross_doc(links: DataFrame, paths: DataFrame, slugs: DataFrame, all_links: bool = False) -> DataFrame:
    """Relative links to other documents, with kind and target_doc.

    unmapped: no document has the path; ambiguous: several have; unsupported: its backend takes no links, or it has no remote id
    yet; fetch_failed: its headings could not be read, but the link names one; unresolved_anchor: no heading has the slug;
    else resolved. With all_links, links that are no such paths come out as not_cross_doc.

    links has the path of its document as `local`; paths has doc_id, local, and perhaps supported and fetched (boolean; true where
    they are missing). Targets are found by equality of paths.
    """
    folder = F.regexp_extract("local", r"^(.*/)[^/]*$", 1)
    x = links.where("NOT image").withColumn("relative", cross_doc_path(F.col("href")))
    if not all_links:
        x = x.where("relative IS NOT NULL")
    x = x.select("doc_id", "j", "k", "href", norm_path(F.concat(folder, F.col("relative"))).alias("path"), cross_doc_fragment(F.col("href")).alias("fragment"))
    flag = lambda c: F.min(F.coalesce(F.col(c), F.lit(False))) if c in paths.columns else F.lit(True)
    known = paths.groupBy(F.col("local").alias("path")).agg(F.count("*").alias("hits"), F.min("doc_id").alias("target_doc"), flag("supported").alias("supported"), flag("fetched").alias("fetched"))
    x = x.join(known, "path", "left")
    s = slugs.select(F.col("doc_id").alias("target_doc"), F.col("slug").alias("fragment"), F.lit(True).alias("found")).distinct()
    x = x.join(s, ["target_doc", "fragment"], "left")
    kind = (
        F.when(F.col("path").isNull(), "not_cross_doc").when(F.col("hits").isNull(), "unmapped").when(F.col("hits") > 1, "ambiguous").when(~F.col("supported"), "unsupported")
        .when(F.col("fragment").isNotNull() & ~F.col("fetched"), "fetch_failed").when(F.col("fragment").isNotNull() & F.col("found").isNull(), "unresolved_anchor").otherwise("resolved")
    )
    return x.select("doc_id", "j", "k", "path", "fragment", kind.alias("kind"), F.when(F.col("hits") == 1, F.col("target_doc")).alias("target_doc"))


def resolve_wikilinks(line_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, j, k, target, page_id, tier of [[target|label]] links: exact title, then case-insensitive, then normalised.

    pages has page_id, title; of pages with one title the last counts, of several within a tier the first.
    """
    found = F.regexp_extract_all("line", F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    x = line_rows.where(~F.col("in_code") & F.col("line").contains("[[")).select("doc_id", "j", F.posexplode(found).alias("k", "target"))
    p = pages.groupBy("title").agg(F.max("page_id").alias("page_id"))
    tiers = [lambda c: c, F.lower, norm_page_name]
    out = None
    for t, f in enumerate(tiers):
        names = p.groupBy(f(F.col("title")).alias("name")).agg(F.min("page_id").alias(f"p{t}"))
        x = x.withColumn("name", f(F.col("target"))).join(names, "name", "left").drop("name")
    out = F.coalesce("p0", "p1", "p2")
    tier = F.when(F.col("p0").isNotNull(), 1).when(F.col("p1").isNotNull(), 2).when(F.col("p2").isNotNull(), 3)
    return x.select("doc_id", "j", "k", "target", out.alias("page_id"), tier.alias("tier"))


def available_anchors(slugs: DataFrame, without_id: DataFrame) -> DataFrame:
    """Slugs that would resolve: those of a document's headings, less those of headings without an id."""
    return slugs.select("doc_id", "slug").where("slug <> ''").exceptAll(without_id.select("doc_id", "slug")).distinct()


def first_use_order(links: DataFrame) -> DataFrame:
    """doc_id, href, place: distinct links in order of first use."""
    first = links.groupBy("doc_id", "href").agg(F.min(F.struct("j", "k")).alias("at"))
    return first.select("doc_id", "href", F.row_number().over(W.partitionBy("doc_id").orderBy("at")).alias("place"))


def upgrade_anchors(line_rows: DataFrame, links: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, j, line of the lines in which ](#id) of a known heading id became ](#slug); ids has doc_id, heading_id, slug."""
    known = anchors(links).join(ids.select("doc_id", F.col("heading_id").alias("target"), "slug"), ["doc_id", "target"])
    swaps = known.groupBy("doc_id", "j").agg(F.sort_array(F.collect_set(F.struct("target", "slug"))).alias("swaps"))
    put = lambda s, x: F.replace(s, F.concat(F.lit("](#"), x["target"], F.lit(")")), F.concat(F.lit("](#"), x["slug"], F.lit(")")))
    return line_rows.join(swaps, ["doc_id", "j"]).select("doc_id", "j", F.aggregate("swaps", F.col("line"), put).alias("line"))
