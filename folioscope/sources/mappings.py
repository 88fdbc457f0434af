"""Mapping tables from CSV or JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_mappings(raw: DataFrame, columns: list[str], needed: list[str]) -> DataFrame:
    """Header in lower case and trimmed, values trimmed, blanks null; rows without a needed value are left out.

    A column that is missing is an error before anything is read.
    """
    have = {c.strip().lower(): c for c in raw.columns}
    missing = [c for c in columns if c not in have]
    if missing:
        raise ValueError(f"the mapping table lacks {missing}")
    value = lambda c: F.nullif(F.trim(F.col(f"`{have[c]}`").cast("string")), F.lit(""))
    return raw.select(*[value(c).alias(c) for c in columns]).dropna(subset=needed)


def load_mappings(spark: SparkSession, path: str, columns: list[str], needed: list[str]) -> DataFrame:
    """Mappings of a CSV (with header) or JSON lines file; every value is read as a string."""
    raw = spark.read.json(path, primitivesAsString=True) if path.endswith((".json", ".jsonl")) else spark.read.csv(path, header=True)
    return clean_mappings(raw, columns, needed)
