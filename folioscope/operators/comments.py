"""Comments: where they belong, what an edit would endanger, digests and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def open_comments(comments: DataFrame) -> DataFrame:
    return comments.where(~F.coalesce("resolved", F.lit(False)))


def bucket_comments(comments: DataFrame, sections: DataFrame) -> DataFrame:
    """comment_id, section, ambiguous: the first section that holds the quote; null without a quote or a match.

    The document key is an equality, so the search for the quote runs inside one document's sections only.
    """
    quote = F.trim("quote")
    q = comments.select("comment_id", "doc_id", quote.alias("quote")).where("quote <> ''")
    hit = q.join(sections, "doc_id").where("instr(text, quote) > 0").groupBy("comment_id").agg(F.min("section").alias("section"), (F.count("*") > 1).alias("ambiguous"))
    return comments.select("comment_id", "doc_id").join(hit, "comment_id", "left").select("comment_id", "doc_id", "section", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def comments_at_risk(changes: DataFrame, comments: DataFrame) -> DataFrame:
    """doc_id, j, kind, reasons, comment_ids of removed or changed lines that are risky to write over, one row each.

    Reasons, joined in this order: comment (the old text holds the quote of an open comment; all such comments are named),
    native_glyph (the line is a native check box), style_upgrade (the old text is the new one behind a literal quote
    mark). changes has doc_id, j, kind, old, new and native.
    """
    risky = changes.where("kind IN ('remove', 'change')")
    q = open_comments(comments).where("quote <> ''").select("doc_id", "comment_id", "quote")
    hit = risky.select("doc_id", "j", "old").join(q, "doc_id").where("instr(old, quote) > 0")
    ids = hit.groupBy("doc_id", "j").agg(F.array_join(F.transform(F.sort_array(F.collect_set("comment_id")), lambda x: x.cast("string")), ",").alias("comment_ids"))
    x = risky.join(ids, ["doc_id", "j"], "left")
    upgrade = F.col("old").startswith("> ") & (F.substring("old", 3, 1 << 30) == F.coalesce("new", F.lit("")))
    reasons = F.array_compact(F.array(F.when(F.col("comment_ids").isNotNull(), "comment"), F.when(F.col("native"), "native_glyph"), F.when(upgrade, "style_upgrade")))
    return x.where(F.size(reasons) > 0).select("doc_id", "j", "kind", F.array_join(reasons, ",").alias("reasons"), F.coalesce("comment_ids", F.lit("")).alias("comment_ids"))


def comment_digest(comments: DataFrame, replies: DataFrame) -> DataFrame:
    """doc_id, digest: open comments, then resolved ones, each with author, quote, body and replies; no row without comments."""
    r = replies.groupBy("comment_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("  - "), F.coalesce("author", F.lit("Unknown")), F.lit(": "), F.col("body")).alias("t")))), lambda x: x["t"]), "\n").alias("replies"))
    head = F.concat(F.lit("### "), F.coalesce("author", F.lit("Unknown")), F.when(F.col("resolved"), " (resolved)").otherwise(""))
    one = F.concat_ws("\n", head, F.concat(F.lit("> "), F.col("quote")), F.col("body"), F.col("replies"))
    df = comments.join(r, "comment_id", "left").select("doc_id", F.struct("resolved", "comment_id", one.alias("text")).alias("x"))
    return df.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "\n\n").alias("digest"))


def reply_directives(digest_lines: DataFrame, comments: DataFrame) -> DataFrame:
    """comment_id, reply, resolve, known: the last Reply and Resolve lines below each comment's marker.

    Lines are doc_id, j, line; a marker is <!-- comment N -->; rows without a reply that do not resolve are left out.
    """
    w = W.partitionBy("doc_id").orderBy("j")
    mark = F.nullif(F.regexp_extract("line", r"^<!-- comment (\d+) -->$", 1), F.lit(""))
    df = digest_lines.withColumn("id", F.last(mark, True).over(w)).where("id IS NOT NULL")
    value = lambda key: F.nullif(F.trim(F.regexp_extract("line", rf"^{key}:(.*)$", 1)), F.lit(""))
    last = df.groupBy(F.col("id").cast("long").alias("comment_id")).agg(
        F.max_by(value("Reply"), F.when(value("Reply").isNotNull(), F.col("j"))).alias("reply"), F.max_by(value("Resolve"), F.when(value("Resolve").isNotNull(), F.col("j"))).alias("resolve")
    )
    last = last.where("reply IS NOT NULL OR lower(resolve) = 'yes'")
    known = comments.select("comment_id", F.lit(True).alias("known"))
    return last.join(known, "comment_id", "left").select("comment_id", "reply", F.coalesce(F.lower("resolve") == "yes", F.lit(False)).alias("resolve"), F.coalesce("known", F.lit(False)).alias("known"))


def comment_drop_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents with fewer open comments after than before."""
    count = lambda x, n: open_comments(x).groupBy("doc_id").agg(F.count("*").alias(n))
    return count(before, "n_before").join(count(after, "n_after"), "doc_id", "left").select("doc_id", "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after")).where("n_after < n_before")
