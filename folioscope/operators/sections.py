"""Sections of documents: splitting by headings, names, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.links import heading_slugs


PREAMBLE = "preamble"


def split_sections(line_rows: DataFrame, level: int) -> DataFrame:
    """doc_id, section, first_line, n_lines, title, error: a new section at each heading of the level.

    Section 0 is the preamble, what is before the first such heading; it is there even if it is empty (no first line).
    A document without headings is a preamble alone. One with headings of other levels only can't be split: it has one
    row without a section, whose error names the deepest level that it has.
    """
    hashes = F.when(~F.col("in_code"), F.length(F.regexp_extract("line", "^(#{1,6}) ", 1)))
    df = line_rows.withColumn("rank", F.nullif(hashes, F.lit(0))).withColumn("head", F.coalesce(F.col("rank") == level, F.lit(False)))
    df = df.withColumn("section", F.sum(F.col("head").cast("int")).over(W.partitionBy("doc_id").orderBy("j")))
    title = F.max(F.when(F.col("head"), F.regexp_extract("line", "^#+ (.*)$", 1)))
    found = df.groupBy("doc_id", "section").agg(F.min("j").cast("long").alias("first_line"), F.count("*").alias("n_lines"), F.coalesce(title, F.lit("")).alias("title"), F.max("rank").alias("deepest"), F.max("head").alias("split"))
    docs = found.groupBy("doc_id").agg(F.min("section").alias("least"), F.max("deepest").alias("deepest"), F.max("split").alias("split"), F.sum("n_lines").alias("lines"))
    stuck = F.col("deepest").isNotNull() & ~F.col("split")
    error = F.concat(F.lit(f"no heading of level {level}; the deepest is of level "), F.col("deepest").cast("string"))
    none = F.lit(None).cast("long")
    errors = docs.where(stuck).select("doc_id", none.alias("section"), none.alias("first_line"), F.col("lines").alias("n_lines"), F.lit("").alias("title"), error.alias("error"))
    empty = docs.where("least > 0").select("doc_id", F.lit(0).cast("long").alias("section"), none.alias("first_line"), F.lit(0).cast("long").alias("n_lines"), F.lit("").alias("title"), F.lit(None).cast("string").alias("error"))
    whole = found.join(docs.where(stuck).select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("section").cast("long").alias("section"), "first_line", "n_lines", "title", F.lit(None).cast("string").alias("error"))
    return whole.unionByName(empty).unionByName(errors)


def section_slugs(sections: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Sections (without those of errors) with slug: that of the title, repeats in a document numbered; `preamble` for section 0.

    known has doc_id, heading_id, title and slug of earlier sections: one with the same id and title keeps its slug. Then
    sections has heading_id, too.
    """
    s = sections.where("section IS NOT NULL")
    titled = s.where("section > 0").select("doc_id", F.col("section").cast("int").alias("j"), F.lit(0).alias("level"), "title")
    fresh = heading_slugs(titled).select("doc_id", F.col("j").cast("long").alias("section"), F.col("slug").alias("fresh"))
    s = s.join(fresh, ["doc_id", "section"], "left").withColumn("slug", F.coalesce("fresh", F.lit(PREAMBLE))).drop("fresh")
    if known is None:
        return s
    old = known.where("heading_id <> ''").select("doc_id", "heading_id", "title", F.col("slug").alias("old")).dropDuplicates(["doc_id", "heading_id"])
    s = s.join(old, ["doc_id", "heading_id", "title"], "left")
    return s.withColumn("slug", F.when(F.col("section") > 0, F.coalesce("old", "slug")).otherwise(F.col("slug"))).drop("old")


def section_texts(line_rows: DataFrame, level: int) -> DataFrame:
    """doc_id, section, text."""
    head = ~F.col("in_code") & F.col("line").rlike(f"^#{{{level}}} ")
    df = line_rows.select("doc_id", "j", "line", F.sum(head.cast("int")).over(W.partitionBy("doc_id").orderBy("j")).alias("section"))
    return df.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "line"))), lambda x: x["line"]), "\n").alias("text"))


def section_files(sections: DataFrame) -> DataFrame:
    """doc_id, section, filename: number with at least two digits, hyphen, slug."""
    wide = F.greatest(F.lit(2), F.length(F.max("section").over(W.partitionBy("doc_id")).cast("string")))
    name = F.concat(F.lpad(F.col("section").cast("string"), wide, F.lit("0")), F.lit("-"), F.when(F.col("slug") == "", "section").otherwise(F.col("slug")), F.lit(".md"))
    return sections.select("doc_id", "section", name.alias("filename"))


def section_reorder(manifest: DataFrame) -> DataFrame:
    """doc_id, filename of sections whose place in the manifest is not their place by filename."""
    w = W.partitionBy("doc_id")
    df = manifest.select("doc_id", "filename", F.row_number().over(w.orderBy("pos")).alias("by_pos"), F.row_number().over(w.orderBy("filename")).alias("by_name"))
    return df.where("by_pos <> by_name")
