"""Files of one row each, in folders by column."""

import gzip
import pathlib

import pytest
from pyspark.sql import functions as F

from folioscope.sources import files


def below(folder):
    return {p.relative_to(folder).parent.as_posix(): p.read_bytes() for p in pathlib.Path(folder).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}


def test_each_row_is_one_file(spark, tmp_path):
    rows = [(k, f"text of {k}\n") for k in ["plain", "a/b=c:d", "100% {x} [y] ^", "it's \"q\" #1? *", "é", "back\\slash", "tab\t", ""]] + [(None, "null folder"), ("no text", None)]
    df = spark.createDataFrame(rows, "k string, text string")
    df.select(F.col("text").alias("value"), "k").write.partitionBy("k").option("maxRecordsPerFile", 1).text(f"file://{tmp_path}/spark")
    files.write_each(df.where("coalesce(k, '') <> ''"), f"file://{tmp_path}/ours", "text", ["k"])
    want = below(tmp_path / "spark")
    got = below(tmp_path / "ours")
    nobody = "k=__HIVE_DEFAULT_PARTITION__"
    assert got == {k: v for k, v in want.items() if k != nobody} and len(got) == 8
    files.write_each(df.where("k IS NULL"), f"file://{tmp_path}/null", "text", ["k"])
    assert below(tmp_path / "null") == {nobody: b"null folder\n"}
    with pytest.raises(Exception, match="already"):
        files.write_each(df, f"file://{tmp_path}/null", "text", ["k"])


def test_no_process_and_no_sum_for_each_file(spark, tmp_path):
    spark.range(1000).selectExpr("id % 3 AS k", "concat('t', id) AS text").repartition(4).createOrReplaceTempView("many")
    files.write_each(spark.table("many"), f"file://{tmp_path}/many", "text", ["k"])
    found = [p for p in (tmp_path / "many").rglob("*") if p.is_file()]
    # Spark's own writer leaves a hidden sum beside every file, and starts processes for the rights of both
    assert len(found) == 1000 and not [p for p in found if p.name.startswith(".")]
    assert sorted(p.read_text() for p in found) == sorted(f"t{i}\n" for i in range(1000))


def test_small_files_share_tasks(spark, tmp_path):
    files.write_each(spark.range(2000).selectExpr("id % 3 AS k", "concat('t', id) AS text").repartition(4), f"file://{tmp_path}/many", "text", ["k"])
    (tmp_path / "many/k=0/more.md.gz").write_bytes(gzip.compress(b"a\r\nb"))
    (tmp_path / "many/k=0/with space.md").write_bytes("é\r\n".encode())
    found = files.scan_documents(spark, f"file://{tmp_path}/many")
    assert found.rdd.getNumPartitions() <= 33
    got = {r.content for r in found.collect()}
    assert got == {f"t{i}\n" for i in range(2000)} | {"a\r\nb", "é\r\n"}
    assert {r.path.rsplit("/", 1)[1] for r in found.where("content NOT LIKE 't%'").collect()} == {"more.md.gz", "with%20space.md"}
