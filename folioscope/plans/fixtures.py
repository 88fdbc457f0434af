"""Revisions, mappings, comments and page metadata derived from the given tables, for the queries.

The given documents hold no markup, so markdown is put around their lines by a fixed rule. Everything is
computed row by row (no shuffle) and grows with the tables. `sql` has the same rules for another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rule that turns line `line` number `i` (from 0) of a document into markdown; valid in both SQL dialects. No text is
#: left out: where a mark takes a line's place, the line follows it.
MARKDOWN = """CASE (doc_id * 7 + {i} * 13) % 20
  WHEN 0 THEN concat('# ', line)
  WHEN 1 THEN concat('## Section ', cast({i} % 4 AS string), chr(10), line)
  WHEN 2 THEN concat('## Section ', cast({i} % 4 AS string), chr(10), line)
  WHEN 3 THEN concat('- [x] ', line)
  WHEN 4 THEN concat('- [ ] ', line)
  WHEN 5 THEN concat('- ', line)
  WHEN 6 THEN concat('See [ref](#section-', cast((doc_id + {i}) % 6 AS string), ') now ', line)
  WHEN 7 THEN concat('[doc](../', lang, '/', cast((doc_id * 3 + {i}) % 1000 AS string), '.md#section-1) ', line)
  WHEN 8 THEN concat('[[Doc ', cast((doc_id + {i}) % 500 AS string), ']] ', line)
  WHEN 9 THEN concat('![img](img/', cast({i} % 5 AS string), '.png)', chr(10), line)
  WHEN 10 THEN concat('> ', line)
  WHEN 11 THEN concat('```sql', chr(10), line, chr(10), '```')
  WHEN 12 THEN concat('| a | b |', chr(10), '|---|---|', chr(10), '| x | ', cast({i} AS string), ' |', chr(10), chr(10), line)
  ELSE line END"""

#: The rules that turn line number `i` of the base into the lines of the two revisions; {list} builds an array.
OURS = """CASE WHEN doc_id % 4 NOT IN (1, 3) THEN {l}line{r}
  WHEN (doc_id * 11 + {i} * 17) % 29 = 0 THEN {l}concat('ours ', line){r}
  WHEN (doc_id * 11 + {i} * 17) % 29 = 1 THEN {none}
  WHEN (doc_id * 11 + {i} * 17) % 29 = 2 THEN {l}line, 'ours note'{r}
  ELSE {l}line{r} END"""
THEIRS = """CASE WHEN doc_id % 4 NOT IN (2, 3) THEN {l}line{r}
  WHEN (doc_id * 5 + {i} * 19) % 31 = 0 THEN {l}concat('theirs ', line){r}
  WHEN (doc_id * 5 + {i} * 19) % 31 = 1 THEN {none}
  ELSE {l}line{r} END"""

_SPARK = {"l": "array(", "r": ")", "none": "cast(array() AS array<string>)", "i": "i"}
_OTHER = {"l": "[", "r": "]", "none": "cast([] AS varchar[])", "i": "(k - 1)"}


def _duck(name: str, rule: str, source: str) -> str:
    return f"{name} AS (SELECT doc_id, lang, source, array_to_string(flatten(list_transform(string_split(content, chr(10)), lambda line, k: {rule.format(**_OTHER)})), chr(10)) AS content FROM {source})"


#: Common table expressions for the other engine: base, ours, theirs (doc_id, lang, source, content) and their lines.
SQL_BASE = f"base AS (SELECT doc_id, lang, source, array_to_string(list_transform(string_split(text, chr(10)), lambda line, k: {MARKDOWN.format(i='(k - 1)')}), chr(10) || chr(10)) AS content FROM documents)"
SQL_OURS, SQL_THEIRS = _duck("ours", OURS, "base"), _duck("theirs", THEIRS, "base")


def sql_lines(of: str) -> str:
    return f"{of}_lines AS (SELECT doc_id, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS j, unnest(string_split(content, chr(10))) AS line FROM {of})"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, content: the last synced revision."""
    return documents(spark, sf_dir).select("doc_id", "lang", "source", F.expr(f"array_join(transform(split(text, '\\n', -1), (line, i) -> {MARKDOWN.format(i='i')}), '\\n\\n')").alias("content"))


def _revision(df: DataFrame, rule: str) -> DataFrame:
    return df.withColumn("content", F.expr(f"array_join(flatten(transform(split(content, '\\n', -1), (line, i) -> {rule.format(**_SPARK)})), '\\n')"))


def ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revision(base(spark, sf_dir), OURS)


def theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revision(base(spark, sf_dir), THEIRS)


SQL_MAPPINGS = """mappings AS (SELECT doc_id, concat(source, '/', lang, '/', CASE WHEN doc_id % 97 = 0 THEN 0 ELSE doc_id END, '.md') AS local,
  CASE doc_id % 5 WHEN 0 THEN 'b2' ELSE 'b1' END AS backend, CASE WHEN doc_id % 37 <> 0 THEN concat('r', doc_id) END AS remote_id,
  CASE doc_id % 7 WHEN 0 THEN 'push' WHEN 1 THEN 'pull' ELSE 'both' END AS direction, doc_id % 11 = 0 AS sectioned,
  CASE WHEN doc_id % 11 = 0 THEN concat('HEADING_', doc_id % 8) WHEN doc_id % 53 = 0 THEN 'HEADING_2' END AS split_level FROM documents)"""
SQL_STATE = "state AS (SELECT doc_id, sha256(content) AS base_hash, sha256(content) AS local_hash, 'v1' AS remote_version FROM base WHERE doc_id % 10 <> 9)"
SQL_REMOTE = "remote AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN NULL WHEN doc_id % 4 IN (2, 3) THEN 'v2' ELSE 'v1' END AS version FROM documents)"


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).selectExpr(
        "doc_id",
        "concat(source, '/', lang, '/', CASE WHEN doc_id % 97 = 0 THEN 0 ELSE doc_id END, '.md') AS local",
        "CASE doc_id % 5 WHEN 0 THEN 'b2' ELSE 'b1' END AS backend",
        "CASE WHEN doc_id % 37 <> 0 THEN concat('r', doc_id) END AS remote_id",
        "CASE doc_id % 7 WHEN 0 THEN 'push' WHEN 1 THEN 'pull' ELSE 'both' END AS direction",
        "doc_id % 11 = 0 AS sectioned",
        "CASE WHEN doc_id % 11 = 0 THEN concat('HEADING_', doc_id % 8) WHEN doc_id % 53 = 0 THEN 'HEADING_2' END AS split_level",
    )


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was recorded at the last sync; a tenth of the documents was never synced."""
    return base(spark, sf_dir).where("doc_id % 10 <> 9").selectExpr("doc_id", "sha2(content, 256) AS base_hash", "sha2(content, 256) AS local_hash", "'v1' AS remote_version")


def remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).selectExpr("doc_id", "CASE WHEN doc_id % 50 = 7 THEN NULL WHEN doc_id % 4 IN (2, 3) THEN 'v2' ELSE 'v1' END AS version")


SQL_COMMENTS = """comments AS (SELECT c.conv_id AS comment_id, d.doc_id, c.text AS body, c.conv_id % 3 = 0 AS resolved, CASE WHEN c.conv_id % 13 <> 0 THEN concat('user', c.conv_id % 9) END AS author,
  CASE WHEN c.conv_id % 17 <> 0 THEN list_extract(string_split(b.content, chr(10)), cast(c.conv_id % len(string_split(b.content, chr(10))) AS integer) + 1) END AS quote
  FROM conversations c JOIN (SELECT doc_id FROM documents) d ON d.doc_id = c.conv_id JOIN base b ON b.doc_id = d.doc_id WHERE c.turn = 0)"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comment_id, doc_id, body, resolved, author, quote: each conversation is a thread on the document with its number."""
    first = conversations(spark, sf_dir).where("turn = 0").select("conv_id", "text")
    b = base(spark, sf_dir).select("doc_id", F.split("content", "\n", -1).alias("ls"))
    return first.join(b, first.conv_id == b.doc_id).selectExpr(
        "conv_id AS comment_id", "doc_id", "text AS body", "conv_id % 3 = 0 AS resolved", "CASE WHEN conv_id % 13 <> 0 THEN concat('user', conv_id % 9) END AS author",
        "CASE WHEN conv_id % 17 <> 0 THEN get(ls, cast(conv_id % size(ls) AS int)) END AS quote",
    )


SQL_REPLIES = "replies AS (SELECT conv_id AS comment_id, turn, role AS author, text AS body FROM conversations WHERE turn > 0)"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).where("turn > 0").selectExpr("conv_id AS comment_id", "turn", "role AS author", "text AS body")


SQL_PAGES = r"""meta AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CASE WHEN page_id > 0 THEN (page_id - 1) // 4 END AS parent_id,
  concat('S', page_id % 3) AS space_key, CASE WHEN page_id % 10 = 3 THEN 'archived' ELSE 'current' END AS status, concat_ws(', ', concat('lang ', regexp_extract(html, 'lang="(\w+)"', 1)), concat('kind', page_id % 4)) AS labels, html FROM pages)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, title, parent_id, space_key, status, labels, html."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.expr("CASE WHEN page_id > 0 THEN (page_id - 1) div 4 END").alias("parent_id"),
        F.expr("concat('S', page_id % 3)").alias("space_key"), F.expr("CASE WHEN page_id % 10 = 3 THEN 'archived' ELSE 'current' END").alias("status"),
        F.concat_ws(", ", F.concat(F.lit("lang "), F.regexp_extract("html", r'lang="(\w+)"', 1)), F.expr("concat('kind', page_id % 4)")).alias("labels"), "html",
    )
