"""Crawled pages: trees, versions, titles, labels, search, nearest keys, files and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.sources.tables import kept


def page_tree(pages: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """root, page_id, depth, place: descendants to a depth, in depth-first order; one join for each level.

    A page's place follows from the sizes of the trees before it: those of the earlier siblings of each page on its path.
    So no site is ordered in one task; only the children of one page meet.
    """
    kids = pages.select(F.col("page_id").alias("kid"), F.col("parent_id").alias("page_id"))
    level = roots.select(F.col("page_id").alias("root"), "page_id", F.lit(0).alias("depth"), F.array("page_id").alias("path"))
    out = level
    for k in range(1, max_depth + 1):
        level = level.join(kids, "page_id").where(~F.array_contains("path", F.col("kid"))).select("root", F.col("kid").alias("page_id"), F.lit(k).alias("depth"), F.array_append("path", F.col("kid")).alias("path"))
        level = kept(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    on_path = out.select("root", "page_id", "depth", F.posexplode("path").alias("step", "x"))
    sizes = on_path.groupBy("root", "x").agg(F.count("*").alias("size"))
    nodes = out.where("depth > 0").select("root", F.col("page_id").alias("x"), F.get("path", F.col("depth") - 1).alias("parent")).join(sizes, ["root", "x"])
    siblings = W.partitionBy("root", "parent").orderBy("x")
    before = nodes.select("root", "x", (F.sum("size").over(siblings) - F.col("size") + 1).alias("before"))
    placed = on_path.join(before, ["root", "x"], "left")
    return placed.groupBy("root", "page_id", "depth").agg((F.coalesce(F.sum("before"), F.lit(0)) + 1).alias("place"))


def page_by_title(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """space_key, title, page_id: the first page with a title in a space."""
    first = pages.groupBy("space_key", "title").agg(F.min("page_id").alias("page_id"))
    return wanted.join(first, ["space_key", "title"], "left")


def search_space(pages: DataFrame, space: str, text: Column, query: str, archived: bool = False) -> DataFrame:
    """Pages of a space whose text holds the query in any case; archived ones only if asked for."""
    found = pages.where((F.col("space_key") == space) & F.contains(F.lower(text), F.lit(query.lower())))
    return found if archived else found.where("status = 'current'")


def version_history(versions: DataFrame) -> DataFrame:
    """page_id, version, place, delta: versions in order, and the change of length from the one before."""
    w = W.partitionBy("page_id").orderBy("version")
    return versions.select("page_id", "version", F.row_number().over(w).alias("place"), (F.col("length") - F.lag("length").over(w)).alias("delta"))


def labels_of(pages: DataFrame) -> DataFrame:
    """label and the number of pages with it, from comma-separated labels."""
    label = F.explode(F.array_distinct(F.filter(F.transform(F.split("labels", ","), lambda x: F.trim(x)), lambda x: x != "")))
    return pages.select("page_id", label.alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def closest_key(keys: DataFrame, known: list[str], most: int = 5, aliases: dict[str, str] | None = None, any_case: bool = False) -> DataFrame:
    """key, closest: the key of an alias, else the known key at the least edit distance, of equals the first; null beyond `most`.

    Keys of documents take 5, those of configurations 3 in any case. The list of known keys is a fixed one, so it goes into the
    expression and nothing is joined.
    """
    fold = F.lower if any_case else (lambda c: c)
    ranked = F.array_min(F.array(*[F.struct(F.levenshtein(fold(F.col("key")), fold(F.lit(k))).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(known)]))
    alias = F.lit(None).cast("string")
    for name, k in (aliases or {}).items():
        alias = F.when(F.col("key") == name, k).otherwise(alias)
    return keys.select("key").distinct().withColumn("b", ranked).select("key", F.coalesce(alias, F.when(F.col("b.d") <= most, F.col("b.k"))).alias("closest"))


#: First bytes of image files.
MAGIC = {"image/png": "89504E47", "image/jpeg": "FFD8FF", "image/gif": "47494638", "image/bmp": "424D"}
LARGEST_IMAGE = 50 * 1024 * 1024


def image_type(content: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, magic in MAGIC.items():
        out = out.when(F.hex(F.substring(content, 1, len(magic) // 2)) == magic, kind)
    webp = (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    return out.when(webp, "image/webp").when(F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1")).contains("<svg"), "image/svg+xml")


def image_fallback(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """Images (doc_id, alt, src): those with a source, and of the others those whose alt is in the current revision."""
    have = wanted.where("src IS NOT NULL")
    return have.unionByName(wanted.where("src IS NULL").join(current.select("doc_id", "alt").distinct(), ["doc_id", "alt"], "left_semi").select(*have.columns))


def checkbox_recover(boxes: DataFrame, states: DataFrame) -> DataFrame:
    """doc_id, j, checked: check boxes take the exported states by order, in documents with as many states as boxes."""
    n = lambda x: x.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("j"))).withColumn("n", F.count("*").over(W.partitionBy("doc_id")))
    return n(boxes.select("doc_id", "j")).join(n(states.select("doc_id", "j", "checked")).drop("j"), ["doc_id", "k", "n"]).select("doc_id", "j", "checked")
