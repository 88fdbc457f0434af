"""Cells of the tables of two revisions, paired through the alignment of their blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.blocks import explode_cells, markdown_to_plain
from folioscope.operators.diff import diff_align

#: What every table counts as where blocks are aligned: a table has no text that would tell it from another.
TABLE = "\x00table"


def styled_cells(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, row, col, text, styled of the cells of table blocks; styled: the cell's text has marks, which text lacks."""
    cells = explode_cells(blocks).withColumn("text", markdown_to_plain(F.col("cell")))
    return cells.select("doc_id", "pos", "row", "col", "text", (F.col("text") != F.col("cell")).alias("styled"))


def paired_tables(live: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, l, r: places of tables that stand at the same place of both sides' blocks (doc_id, pos, kind, text).

    Blocks are aligned by their text; all tables count as equal, so that between two blocks that match they pair by order.
    """
    side = lambda x: x.select("doc_id", F.col("pos").alias("j"), F.when(F.col("kind") == "table", TABLE).otherwise(F.col("text")).alias("line"))
    pairs = diff_align(side(live), side(target))
    tables = target.where("kind = 'table'").select("doc_id", F.col("pos").cast("int").alias("r"))
    return pairs.join(tables, ["doc_id", "r"], "left_semi")


def cell_align(live_cells: DataFrame, target_cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every target cell with its live one: doc_id, pos, row, col, text, styled, live_text (null: no cell there), placed.

    A cell's partner has the same row and column in the paired table; the cell is placed if its text stands in the partner's.
    pairs: doc_id, l, r as paired_tables gives them.
    """
    live = live_cells.select("doc_id", F.col("pos").cast("int").alias("l"), "row", "col", F.col("text").alias("live_text"))
    target = target_cells.withColumn("r", F.col("pos").cast("int")).join(pairs, ["doc_id", "r"], "left")
    both = target.join(live, ["doc_id", "l", "row", "col"], "left")
    placed = F.coalesce(F.contains("live_text", "text"), F.lit(False))
    return both.select("doc_id", "pos", "row", "col", "text", "styled", "live_text", placed.alias("placed"))


def unplaced_cells(aligned: DataFrame) -> DataFrame:
    """Styled cells that found no place, each once, in whatever table they stand."""
    return aligned.where("styled AND NOT placed").select("doc_id", "pos", "row", "col", "text")
