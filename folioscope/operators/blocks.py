"""Markdown to lines, blocks, cells, links and marks.

Lines are flagged inside each document's row, so a document is shuffled once at most, when its blocks are put
together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.expr import mermaid_key, private_use_only, strip

#: Rules by priority: type and the pattern of a block's text. They are data: other rules may be given.
BLOCK_RULES = [
    ("heading", r"^#{1,6} "),
    ("mermaid", r"^```mermaid"),
    ("code", r"^(```|~~~)"),
    ("details", r"^<details"),
    ("quote", r"^>"),
    ("task_list", r"^\s*[-*+] \[[ xX]\] "),
    ("bullets", r"^\s*[-*+] "),
    ("ordered", r"^\s*[0-9]+[.)] "),
    ("rule", r"^(-{3,}|\*{3,}|_{3,})\s*$"),
    ("table", r"^\|.*\|\s*\n\|[ :|-]+\|"),
    ("embed", r"^https?://\S+$"),
    ("macro", r"^\{[a-z-]+(:[^}]*)?\}"),
]


def block_type(text: Column, rules: list[tuple[str, str]] = BLOCK_RULES) -> Column:
    """The first rule that matches, else paragraph."""
    out = F.when(F.lit(False), "")
    for kind, pattern in rules:
        out = out.when(text.rlike(pattern), kind)
    return out.otherwise("paragraph")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, j, line, in_code of every line; a fence's own lines are in the code, an unclosed fence runs to the end.

    A fence ends with a line of the same character and length. A null content is an empty one: one empty line. Where every fence is
    the plain one of three backticks, the content is cut in front of each fence, and every second part is code; other
    documents are gone through line by line. Both take time in proportion to the lines, and nothing is shuffled.
    """
    docs = docs.select("doc_id", F.coalesce("content", F.lit("")).alias("content"))
    odd = F.col("content").rlike(r"(?m)^(`{4,}|~{3,})")
    parts = F.split(F.concat(F.lit("\n"), "content"), r"\n(?=```)", -1)
    flagged = F.transform(parts, lambda p, k: F.transform(F.split(p, "\n", -1), lambda x, i: F.struct(x.alias("line"), ((k % 2 == 1) | ((i == 0) & (k > 0))).alias("in_code"))))
    # the first line is that of the line end put in front
    plain = docs.where(~odd).select("doc_id", F.flatten(flagged).alias("z")).select("doc_id", F.posexplode(F.slice("z", 2, F.size("z"))).alias("j", "z")).select("doc_id", "j", "z.line", "z.in_code")
    return plain.unionByName(docs.where(odd).mapInArrow(fenced, plain.schema))


def fenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, content) to their lines, fence by fence."""
    mark = re.compile("^(`{3,}|~{3,})")
    for batch in batches:
        docs, places, texts, flags = [], [], [], []
        for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            open_ = ""
            for j, line in enumerate(content.split("\n")):
                m = mark.match(line)
                within = open_ != ""
                if m and open_ in ("", m.group(1)):
                    open_ = "" if within else m.group(1)
                docs.append(doc)
                places.append(j)
                texts.append(line)
                flags.append(within or open_ != "")
        yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(places, pa.int32()), pa.array(texts, pa.string()), pa.array(flags, pa.bool_())], ["doc_id", "j", "line", "in_code"])


def split_blocks(line_rows: DataFrame) -> DataFrame:
    """doc_id, pos, first_line, text, in_code of every block: split at blank lines and around headings; code whole."""
    w = W.partitionBy("doc_id").orderBy("j")
    blank = (F.col("line").rlike(r"^\s*$")) & ~F.col("in_code")
    heading = F.col("line").rlike("^#{1,6} ") & ~F.col("in_code")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(True))
    df = line_rows.select("doc_id", "j", "line", "in_code", blank.alias("blank"), heading.alias("heading"))
    fence = F.col("in_code") & F.col("line").startswith("```") & (F.coalesce(F.lag(F.col("in_code").cast("int")).over(w), F.lit(0)) == 0)
    df = df.withColumn("start", ~F.col("blank") & (before("blank") | before("heading") | F.col("heading") | (F.col("in_code") != F.coalesce(F.lag("in_code").over(w), F.lit(False))) | fence))
    df = df.withColumn("b", F.sum(F.col("start").cast("int")).over(w)).where("NOT blank OR in_code")
    out = df.groupBy("doc_id", "b").agg(F.min("j").alias("first_line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "line"))), lambda x: x["line"]), "\n").alias("text"), F.max("in_code").alias("in_code"))
    return out.select("doc_id", (F.col("b") - 1).cast("long").alias("pos"), F.col("first_line").cast("long").alias("first_line"), "text", "in_code")


def classify_blocks(blocks: DataFrame, rules: list[tuple[str, str]] = BLOCK_RULES) -> DataFrame:
    return blocks.withColumn("kind", block_type(F.col("text"), rules))


def headings(line_rows: DataFrame) -> DataFrame:
    """doc_id, j, level, title of every heading outside code."""
    return line_rows.where(~F.col("in_code") & F.col("line").rlike("^#{1,6} ")).select("doc_id", "j", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), strip(F.regexp_extract("line", "^#+ (.*)$", 1)).alias("title"))


def without_inline_code(line: Column) -> Column:
    return F.regexp_replace(line, "`[^`]*`", "")


def explode_links(line_rows: DataFrame) -> DataFrame:
    """doc_id, j, k, image, label, href of every link and image outside code."""
    found = F.regexp_extract_all(without_inline_code(F.col("line")), F.lit(r"(!?\[[^\]]*\]\([^)\s]*\))"), F.lit(1))
    rows = line_rows.where(~F.col("in_code") & F.col("line").contains("](")).select("doc_id", "j", F.posexplode(found).alias("k", "m"))
    return rows.select("doc_id", "j", "k", F.col("m").startswith("!").alias("image"), F.regexp_extract("m", r"\[([^\]]*)\]", 1).alias("label"), F.regexp_extract("m", r"\(([^)\s]*)\)$", 1).alias("href"))


def explode_cells(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, row, col, cell of pipe tables; the line of dashes is left out, short rows are filled to the widest."""
    rows = blocks.where(F.col("kind") == "table").select("doc_id", "pos", F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^\|[ :|-]+\|\s*$")).alias("rows"))
    cells = F.transform("rows", lambda x: F.transform(F.split(F.regexp_replace(strip(x), r"^\||\|$", ""), r"\|"), strip))
    rows = rows.select("doc_id", "pos", cells.alias("cells")).withColumn("wide", F.array_max(F.transform("cells", F.size)))
    one = rows.select("doc_id", "pos", "wide", F.posexplode("cells").alias("row", "cs"))
    return one.select("doc_id", "pos", "row", "cs", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("col")).select("doc_id", "pos", "row", "col", F.coalesce(F.get("cs", F.col("col")), F.lit("")).alias("cell"))


def markdown_to_plain(text: Column) -> Column:
    """Plain text: code blocks go, link labels and image alternatives stay, marks go. Steps in this order."""
    steps = [
        (r"(?s)```.*?(```|$)", ""), (r"`([^`]*)`", "$1"), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6} +", ""), (r"\*\*\*([^*]+)\*\*\*", "$1"),
        (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"~~([^~]+)~~", "$1"), (r"(?m)^> ?", ""), (r"(?m)^[ \t]*[-*+] (\[[ xX]\] )?", ""), (r"(?m)^[ \t]*[0-9]+[.)] ", ""), (r"\n{3,}", "\n\n"),
    ]
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def project_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks as markdown can say them, and a residue (doc_id, pos, reason).

    Empty ones that are no quotes go (empty_paragraph), and those of private-use glyphs alone (private_use_glyph). A prefix of
    glyphs that the backend draws itself, render_prefix, goes from a text; unless `mono` says that the rest is monospaced, it is
    reported (ambiguous_code_prefix). Titles become headings (paragraph_style). The first rule that holds counts. render_prefix
    and mono may be missing. What is kept is projected to itself.
    """
    prefix = F.coalesce("render_prefix", F.lit("")) if "render_prefix" in blocks.columns else F.lit("")
    mono = F.coalesce("mono", F.lit(False)) if "mono" in blocks.columns else F.lit(False)
    rule = (
        F.when((F.coalesce("text", F.lit("")) == "") & (F.col("quote_depth") == 0), "empty_paragraph").when(private_use_only(F.col("text")), "private_use_glyph")
        .when(prefix != "", F.when(mono, "code_prefix").otherwise("ambiguous_code_prefix")).when(F.col("style").isin("TITLE", "SUBTITLE"), "paragraph_style")
    )
    df = blocks.withColumn("reason", rule)
    is_style = F.coalesce(F.col("reason") == "paragraph_style", F.lit(False))
    style = F.when(is_style & (F.col("style") == "TITLE"), "HEADING_1").when(is_style, "HEADING_2").otherwise(F.col("style"))
    shown = F.coalesce(F.col("reason").isin("code_prefix", "ambiguous_code_prefix"), F.lit(False))
    text = F.when(shown & F.startswith("text", prefix), F.substring("text", F.length(prefix) + 1, F.length("text"))).otherwise(F.col("text"))
    out = df.where(~F.coalesce(F.col("reason").isin("empty_paragraph", "private_use_glyph"), F.lit(False))).withColumns({"style": style, "text": text})
    if "render_prefix" in blocks.columns:
        out = out.withColumn("render_prefix", F.when(shown, "").otherwise(F.col("render_prefix")))
    return out.drop("reason"), df.where("reason IS NOT NULL AND reason <> 'code_prefix'").select("doc_id", "pos", "reason")


def grouped_code(nodes: DataFrame) -> DataFrame:
    """doc_id, first_pos, last_pos, lang, n of every code block among paragraphs (doc_id, pos, text, code, blank).

    Code lines that follow each other are one block; blank ones between belong to it if more code follows. A plain line of three
    backticks and a language right before the first code line names the language and belongs to the block. Such a line before a
    blank one that no code line follows is an empty block of these two.
    """
    w = W.partitionBy("doc_id").orderBy("pos")
    df = nodes.select("doc_id", "pos", "code", "blank", F.when(~F.col("code") & ~F.col("blank") & F.col("text").startswith("```"), F.substring("text", 4, 1 << 30)).alias("mark"))
    solid = F.when(~F.col("blank"), F.col("code"))
    before = F.last(solid, True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(solid, True).over(w.rowsBetween(1, W.unboundedFollowing))
    no = lambda c: F.coalesce(c, F.lit(False))
    df = df.withColumns({"inside": F.col("code") | (F.col("blank") & no(before) & no(after)), "lang": F.lag("mark").over(w)})
    df = df.withColumn("start", F.col("inside") & ~no(F.lag("inside").over(w)))
    df = df.withColumns({"run": F.sum(F.col("start").cast("int")).over(w), "empty": F.col("mark").isNotNull() & no(F.lead("blank").over(w)) & ~no(F.lead("code", 2).over(w))})
    marked = F.max(F.when(F.col("start") & F.col("lang").isNotNull(), 1)).isNotNull()
    runs_ = df.where("inside").groupBy("doc_id", "run").agg((F.min("pos") - F.when(marked, 1).otherwise(0)).alias("first_pos"), F.max("pos").alias("last_pos"), F.max(F.when(F.col("start"), F.col("lang"))).alias("lang"), F.count("*").alias("n")).drop("run")
    return runs_.unionByName(df.where("empty").select("doc_id", F.col("pos").alias("first_pos"), (F.col("pos") + 1).alias("last_pos"), F.col("mark").alias("lang"), F.lit(0).cast("long").alias("n")))


def mermaid_diagrams(docs: DataFrame) -> DataFrame:
    """doc_id, k, code, key of every fenced diagram: what stands between its fences, and the stable name of it."""
    found = F.regexp_extract_all("content", F.lit(r"(?ms)^```mermaid[ \t]*\n(.*?)\n?^```[ \t]*$"), F.lit(1))
    return docs.select("doc_id", F.posexplode(found).alias("k", "code")).select("doc_id", "k", "code", mermaid_key(F.col("code")).alias("key"))


def code_runs(line_rows: DataFrame) -> DataFrame:
    """doc_id, first_line, last_line, n_lines of every run of code lines."""
    return runs(line_rows, F.col("in_code"))


def quote_runs(line_rows: DataFrame) -> DataFrame:
    """Runs of quoted lines; a change of depth does not end a run."""
    return runs(line_rows, F.col("line").startswith(">") & ~F.col("in_code"))


def runs(line_rows: DataFrame, flag: Column) -> DataFrame:
    """Gaps and islands: consecutive j of a document where flag holds."""
    w = W.partitionBy("doc_id").orderBy("j")
    df = line_rows.where(flag).select("doc_id", "j", (F.col("j") - F.row_number().over(w)).alias("g"))
    return df.groupBy("doc_id", "g").agg(F.min("j").cast("long").alias("first_line"), F.max("j").cast("long").alias("last_line"), F.count("*").alias("n_lines")).drop("g")


def precedes_boundary(blocks: DataFrame) -> DataFrame:
    """doc_id, pos of blocks that a table or a rule follows."""
    w = W.partitionBy("doc_id").orderBy("pos")
    return blocks.select("doc_id", "pos", F.lead("kind").over(w).alias("next")).where(F.col("next").isin("table", "rule")).select("doc_id", "pos", "next")


def merge_spans(spans: DataFrame) -> DataFrame:
    """Neighbouring spans of one style become one: doc_id, k, style, text."""
    w = W.partitionBy("doc_id").orderBy("pos")
    df = spans.withColumn("new", (~F.col("style").eqNullSafe(F.lag("style").over(w)) | (F.row_number().over(w) == 1)).cast("int")).withColumn("k", F.sum("new").over(w))
    return df.groupBy("doc_id", "k", "style").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"))


def blocks_to_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, content: each document's blocks in order, a blank line between."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("content"))


def drop_title_heading(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """blocks without a document's first level-1 heading, where it says the title."""
    first = blocks.where(F.col("text").rlike("^# ")).groupBy("doc_id").agg(F.min_by(F.struct("pos", "text"), "pos").alias("h"))
    drop = first.join(titles, "doc_id").where(strip(F.regexp_extract("h.text", "^# (.*)", 1)) == F.col("title")).select("doc_id", F.col("h.pos").alias("pos"))
    return blocks.join(drop, ["doc_id", "pos"], "left_anti")
