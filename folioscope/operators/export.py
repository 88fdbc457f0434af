"""Blocks as a node tree in JSON, lists nested as deep as they are indented.

A tree's JSON is what each piece of text opens and closes around it. A piece is a heading, an item, a cell and so on; what an item
of a list opens and closes follows from its level and those of its neighbours, so that lists of any depth are put
together by windows, without a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.expr import strip
from folioscope.operators.blocks import explode_cells
from folioscope.operators.inline import quoted, with_inline_nodes
from folioscope.sources.tables import kept

LISTS = ["bullets", "ordered", "task_list"]
#: Spaces of a level, and of a tab.
INDENT, TAB = 2, 4

PIECE = ["doc_id", "pos", "k", "open", "text", "close"]


def opened(kind: str, attrs: Column | str = "") -> Column:
    """The JSON of a node up to its content."""
    return F.concat(F.lit(f'{{"type":"{kind}"'), F.lit(attrs) if isinstance(attrs, str) else attrs, F.lit(',"content":['))


def list_items(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, k, task, ordered, done, level, text of the items of list blocks; lines without a marker go on with the item before.

    A level is an indent of two spaces; an item is one level below the one before at most, the first on level 0.
    """
    lines = blocks.where(F.col("kind").isin(LISTS)).select("doc_id", "pos", (F.col("kind") == "task_list").alias("task"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    marker = r"^\s*([-*+]|[0-9]+[.)])\s+"
    item = F.col("line").rlike(marker)
    w = W.partitionBy("doc_id", "pos").orderBy("i")
    lines = lines.withColumn("item", item).withColumn("k", F.sum(F.col("item").cast("int")).over(w) - 1)
    indent = F.length(F.replace(F.regexp_extract("line", r"^([ \t]*)", 1), F.lit("\t"), F.lit(" " * TAB)))
    body = F.when(F.col("item"), F.regexp_replace("line", marker, "")).otherwise(strip(F.col("line")))
    box = r"^\[([ xX])\] ?"
    lines = lines.select("doc_id", "pos", "k", "i", "task", "item", F.col("line").rlike(r"^\s*[0-9]").alias("ordered"), F.floor(indent / INDENT).alias("raw"), F.lower(F.regexp_extract(body, box, 1)).alias("box"), F.when(F.col("task"), F.regexp_replace(body, box, "")).otherwise(body).alias("body"))
    first = lambda c: F.max(F.when(F.col("item"), F.col(c)))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]), "\n")
    items = lines.groupBy("doc_id", "pos", "k", "task").agg(first("ordered").alias("ordered"), (first("box") == "x").alias("done"), first("raw").alias("raw"), texts.alias("text"))
    # the least of (raw - place) so far, taken back to this place: one level below the item before at most
    w = W.partitionBy("doc_id", "pos").orderBy("k")
    raw = F.when(F.col("k") <= 0, 0).otherwise(F.col("raw"))
    return items.withColumn("level", (F.min(raw - F.col("k")).over(w) + F.col("k")).cast("int")).drop("raw")


def list_pieces(blocks: DataFrame) -> DataFrame:
    w = W.partitionBy("doc_id", "pos").orderBy("k")
    x = list_items(blocks).withColumns({"before": F.lag("level").over(w), "after": F.lead("level").over(w), "ordered_after": F.lead("ordered").over(w)})
    task, level = F.col("task"), F.col("level")
    new = lambda ordered: F.when(task, opened("taskList")).when(ordered, opened("orderedList")).otherwise(opened("bulletList"))
    state = F.concat(F.lit(',"attrs":{"state":"'), F.when(F.col("done"), "DONE").otherwise("TODO"), F.lit('"}'))
    item = F.when(task, opened("taskItem", state)).otherwise(F.concat(opened("listItem"), opened("paragraph")))
    # of an item, what is still open after its text: its own content; lists inside follow it there, task lists behind it
    up = F.when(task, F.repeat(F.lit("]}"), level - F.coalesce("after", F.lit(0)))).otherwise(F.repeat(F.lit("]}]}"), level - F.coalesce("after", F.lit(0))))
    end = F.when(task, "").otherwise("]}")
    close = (
        F.when(F.col("after").isNull(), F.concat(F.lit("]}"), end, up, F.lit("]}"))).when(F.col("after") > level, F.concat(F.lit("]},"), new(F.col("ordered_after"))))
        .when(F.col("after") == level, F.concat(F.lit("]}"), end, F.lit(","))).otherwise(F.concat(F.lit("]}"), end, up, F.lit(",")))
    )
    return x.select("doc_id", "pos", "k", F.concat(F.when(F.col("before").isNull(), new(F.col("ordered"))).otherwise(F.lit("")), item).alias("open"), "text", close.alias("close"))


def table_pieces(blocks: DataFrame) -> DataFrame:
    """Cells of tables, the first row as headers."""
    w = W.partitionBy("doc_id", "pos").orderBy("row", "col")
    x = explode_cells(blocks).withColumns({"last": F.lead("row").over(w).isNull(), "end": ~F.coalesce(F.lead("row").over(w) == F.col("row"), F.lit(False)), "k": F.row_number().over(w) - 1})
    cell = F.concat(F.when(F.col("row") == 0, opened("tableHeader")).otherwise(opened("tableCell")), opened("paragraph"))
    open_ = F.concat(F.when(F.col("k") == 0, opened("table")).otherwise(F.lit("")), F.when(F.col("col") == 0, opened("tableRow")).otherwise(F.lit("")), cell)
    close = F.concat(F.lit("]}]}"), F.when(F.col("end"), "]}").otherwise(""), F.when(F.col("last"), "]}").otherwise(","))
    return x.select("doc_id", "pos", "k", open_.alias("open"), F.col("cell").alias("text"), close.alias("close"))


def blocks_to_nodes_json(blocks: DataFrame) -> DataFrame:
    """doc_id, body: each document's blocks (doc_id, pos, text, kind) as a node-tree document in JSON.

    Headings have a level, code its language, task items a state; list items nest; tables have rows of header and body cells;
    inline marks become marks of texts, images media nodes, mentions, emoji, states and dates nodes of their own.
    """
    blocks = kept(blocks.select("doc_id", "pos", "text", "kind"))  # five branches read them
    kind, text = F.col("kind"), F.col("text")
    level = F.concat(F.lit(',"attrs":{"level":'), F.length(F.regexp_extract("text", "^(#+)", 1)).cast("string"), F.lit("}"))
    language = F.regexp_extract("text", r"^(?:`{3,}|~{3,})[ \t]*([^\s`]*)", 1)
    attrs = F.when(language != "", F.concat(F.lit(',"attrs":{"language":'), quoted(language), F.lit("}"))).otherwise("")
    code = F.regexp_replace(F.regexp_replace("text", r"\A[^\n]*(\n|\z)", ""), r"(\A|\n)(`{3,}|~{3,})\s*\z", "")
    single = blocks.where(~kind.isin("table", "code", "mermaid", "rule", *LISTS)).select(
        "doc_id", "pos", F.lit(0).alias("k"),
        F.when(kind == "heading", opened("heading", level)).when(kind == "quote", F.concat(opened("blockquote"), opened("paragraph"))).otherwise(opened("paragraph")).alias("open"),
        F.when(kind == "heading", strip(F.regexp_replace("text", "^#+ ", ""))).when(kind == "quote", F.regexp_replace("text", r"(?m)^(> ?)+", "")).otherwise(text).alias("text"),
        F.when(kind == "quote", "]}]}").otherwise("]}").alias("close"),
    )
    marked = with_inline_nodes(single.unionByName(list_pieces(blocks)).unionByName(table_pieces(blocks)), "text", "inner").select("doc_id", "pos", "k", F.concat("open", "inner", "close").alias("json"))
    plain = F.when(kind == "rule", '{"type":"rule"}').otherwise(F.concat(opened("codeBlock", attrs), F.when(code == "", "").otherwise(F.concat(F.lit('{"type":"text","text":'), quoted(code), F.lit("}"))), F.lit("]}")))
    marked = marked.unionByName(blocks.where(kind.isin("code", "mermaid", "rule")).select("doc_id", "pos", F.lit(0).alias("k"), plain.alias("json")))
    whole = lambda df, keys, at, by: df.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, "json"))), lambda x: x["json"]), by).alias("json"))
    docs = whole(whole(marked, ["doc_id", "pos"], "k", ""), ["doc_id"], "pos", ",")
    return docs.select("doc_id", F.concat(F.lit('{"version":1,"type":"doc","content":['), "json", F.lit("]}")).alias("body"))
