"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset, a folder of our own in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    jdir = sc._jsc.sc().getCheckpointDir()
    if not found and jdir.isDefined():
        found = jdir.get()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
    if not jdir.isDefined():
        sc.setCheckpointDir(found)
    return found


#: Folders of tidy() that are open, the last one in use.
_open: list[str] = []


def checkpointed(df: DataFrame, lasting: bool = False) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage is cut and a lost executor costs no recomputation.

    A table, not checkpoint(): that computes the last stage twice and keeps estimated sizes, which joins multiply from
    round to round. Inside tidy() the table goes when the block ends, unless it is `lasting`; any other goes with the application.
    """
    spark = df.sparkSession
    top = _open[-1] if _open and not lasting else shared_dir(spark)
    path = f"{top}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if lasting or not _open:
        removed_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def removed_at_exit(spark: SparkSession, folder: str) -> None:
    """The application owns a folder that outlives the call it was made in: it goes when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def discard(table: DataFrame) -> None:
    """Removes a table of checkpointed() that nothing will read again."""
    remove(table.sparkSession, table.table_path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[str]:
    """Inside, Spark removes a job's shuffle files as the job ends, and checkpointed() writes to a folder that goes at the end.

    For jobs whose results are written; gives the folder.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    _open.append(f"{shared_dir(spark)}/tidy-{uuid.uuid4().hex}")
    try:
        yield _open[-1]
    finally:
        spark.conf.set(key, before)
        remove(spark, _open.pop())


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that a Parquet scan reads nothing else."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def spread_over(data: Column, most: int, piece: int = 1024) -> Column:
    """Bytes to learn from: all of data (binary) if it has `most` at most, else `most` in pieces that lie in equal steps from its
    start to its end, a space between."""
    n = most // (piece + 1)
    at = [F.floor((F.length(data) - piece) * i / (n - 1)).cast("int") + 1 for i in range(n)]
    pieces = [x for a in at for x in (F.substring(data, a, F.lit(piece)), F.lit(b" "))]
    return F.when(F.length(data) <= most, data).otherwise(F.concat(*pieces))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding them."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


class Bounded(dict):
    """A cache that is emptied when it holds `most` entries or MOST_HELD characters; long keys are not kept. Subclasses give `make`."""

    MOST_HELD, LONG_KEY = 16 << 20, 2048

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def __missing__(self, key):
        value = self.make(key)
        size = len(key[0]) if isinstance(key, tuple) else len(key)
        if size > self.LONG_KEY:
            return value
        if len(self) >= self.most or self.held + size > self.MOST_HELD:
            self.clear()
            self.held = 0
        self[key] = value
        self.held += size
        return value

    def make(self, key):
        raise NotImplementedError
