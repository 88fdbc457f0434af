"""Documents, page dumps, images and conflict logs as files."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.crawl import LARGEST_IMAGE, image_type
from folioscope.sources.tables import removed_at_exit, shared_folder  # noqa: F401

PAGE = "id string, title string, space_key string, version int, status string, created_date string, modified_date string, creator string, last_modifier string, parent_id string, url string, labels array<string>"
CONFLICT = "doc_id long, local string, kind string, at string"


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


#: Names of files that the text reader decompresses.
COMPRESSED = r"(?i)\.(gz|bz2|lz4|snappy|zst|zstd|deflate)$"


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of text files, one row a file.

    Compressed files go through the text reader, which costs some milliseconds a file; all others are read as they are. Small
    files would make a task for every few of them, so tasks are put together.
    """
    name, path = F.col("_metadata.file_name"), F.col("_metadata.file_path").alias("path")
    whole = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).where(name.rlike(COMPRESSED)).select(path, F.col("value").alias("content"))
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(~name.rlike(COMPRESSED)).select(path, F.col("content").cast("string").alias("content"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return plain.coalesce(tasks).unionByName(whole.coalesce(tasks))


def folder_of(path: Column, top: str) -> Column:
    """The folders between a top folder and a file, from a path as scans give it."""
    return F.regexp_extract(path, f"/{re.escape(top.rstrip('/').rsplit('/', 1)[-1])}/(.*)/[^/]*$", 1)


#: What Hive's folder names escape, and the folder of nulls.
ESCAPED, NO_VALUE = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]"""), "__HIVE_DEFAULT_PARTITION__"


def write_each(rows: DataFrame, folder: str, content: str, by: list[str]) -> None:
    """Writes the content of each row (text or bytes, and a line end) to a file of its own, in folders by column.

    In a local or mounted file system, where Spark starts a process for the rights of every single file, tasks write files
    themselves. A file's name is the task's number and the file's in the task and folder, and it gets it once it is complete, so that a
    task that runs again leaves the same files.
    """
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    each = rows.select(F.col(content).cast("string").alias("value"), *by)
    if fs.getScheme() != "file":
        each.write.option("maxRecordsPerFile", 1).partitionBy(*by).text(folder)
    elif fs.exists(where):
        raise ValueError(f"{folder} is there already")
    else:
        fs.mkdirs(where)
        top = where.toUri().getPath()
        named = each.select(F.col("value").cast("binary").alias("value"), *[F.col(c).cast("string").alias(c) for c in by])
        named.mapInArrow(lambda batches: written(batches, top), "n long").agg(F.sum("n")).collect()
    removed_at_exit(spark, folder)


def written(batches: Iterator[pa.RecordBatch], top: str) -> Iterator[pa.RecordBatch]:
    """Writes the first column of each row to a file of its own below top, in folders by the other columns; the number of files."""
    part, files = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        names = batch.schema.names[1:]
        for value, *keys in zip(*(c.to_pylist() for c in batch.columns)):
            path = os.path.join(top, *(f"{c}={ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', k) if k else NO_VALUE}" for c, k in zip(names, keys)))
            if path not in files:
                os.makedirs(path, exist_ok=True)
            name = f"part-{part:05}-{files[path]:09}.txt"
            files[path] += 1
            with open(f"{path}/.{name}", "wb") as f:
                f.write((value or b"") + b"\n")
            os.replace(f"{path}/.{name}", f"{path}/{name}")
    yield pa.RecordBatch.from_arrays([pa.array([files.total()], pa.int64())], names=["n"])


def scan_crawl(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PAGE).json(folder)


def save_crawl(pages: DataFrame, folder: str) -> None:
    pages.write.mode("append").partitionBy("space_key").json(folder)


def scan_images(spark: SparkSession, folder: str, largest: int = LARGEST_IMAGE) -> DataFrame:
    """path, length, kind of image files by their first bytes; larger files are left out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= largest)
    return files.select("path", "length", image_type(F.col("content")).alias("kind"))


def append_conflicts(conflicts: DataFrame, folder: str) -> None:
    conflicts.write.mode("append").json(folder)


def read_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CONFLICT).json(folder)


def write_state(state: DataFrame, folder: str, version: int) -> None:
    """A new version of the state; readers take the highest version that is complete."""
    state.write.mode("overwrite").parquet(f"{folder}/version={version}")


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[8:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{folder}/version={max(done)}")
