"""Diffs and merges of documents whose lines are all different, so that there is one right alignment and SQL can say it.

Every line of a document gets its number; ours and theirs change, drop and add lines by the rules of fixtures.py.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import comments as C
from folioscope.operators import diff as D
from folioscope.plans import fixtures as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


#: What the rules do with each base line: n lines of ours stand for it, kept says whether it is among them; t likewise.
ACTS = """
 split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
 base AS (SELECT doc_id, i, concat(i, ': ', ls[i + 1]) AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM split)),
 ruled AS (
   SELECT *, CASE WHEN doc_id % 4 IN (1, 3) THEN (doc_id * 11 + i * 17) % 29 ELSE 9 END AS o,
     CASE WHEN doc_id % 4 IN (2, 3) THEN (doc_id * 5 + i * 19) % 31 ELSE 9 END AS t
   FROM base),
 acts AS (
   SELECT doc_id, i, line, o NOT IN (0, 1) AS o_kept, t NOT IN (0, 1) AS t_kept,
     CASE o WHEN 0 THEN [concat('ours ', line)] WHEN 1 THEN [] WHEN 2 THEN [line, 'ours note'] ELSE [line] END AS o_lines,
     CASE t WHEN 0 THEN [concat('theirs ', line)] WHEN 1 THEN [] ELSE [line] END AS t_lines
   FROM ruled)"""


def numbered(spark, d, rule: str | None = None):
    """doc_id, j, line of the base, or of a revision of it."""
    lines = F.transform(F.split("text", "\\n", -1), lambda x, i: F.concat(i.cast("string"), F.lit(": "), x))
    x = V.documents(spark, d).select("doc_id", lines.alias("ls"))
    if rule is not None:
        x = x.select("doc_id", F.expr(f"flatten(transform(ls, (line, i) -> {rule.format(l='array(', r=')', none='cast(array() AS array<string>)', i='i')}))").alias("ls"))
    return x.select("doc_id", F.posexplode("ls").alias("j", "line"))


def ops(spark, d):
    a, b = numbered(spark, d), numbered(spark, d, V.OURS)
    return D.opcodes(a, b, D.diff_align(a, b))


ALIGNED = f"""WITH {ACTS},
 placed AS (
   SELECT doc_id, i AS l, o_kept, coalesce(sum(len(o_lines)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r
   FROM acts),
 aligned AS (SELECT doc_id, l, cast(r AS bigint) AS r FROM placed WHERE o_kept)"""


@query("diff_align_numbered", f"{ALIGNED} SELECT doc_id, l, r FROM aligned")
def diff_align_numbered(spark, d):
    m = D.diff_align(numbered(spark, d), numbered(spark, d, V.OURS))
    return m.select("doc_id", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))


@query(
    "coalesce_runs_numbered",
    f"""{ALIGNED},
 islands AS (SELECT *, l - row_number() OVER w AS a, r - row_number() OVER w AS b FROM aligned WINDOW w AS (PARTITION BY doc_id ORDER BY l))
 SELECT doc_id, min(l) AS l0, min(r) AS r0, count(*) AS n FROM islands GROUP BY doc_id, a, b""",
)
def coalesce_runs_numbered(spark, d):
    x = D.coalesce_runs(ops(spark, d))
    return x.select("doc_id", F.col("l0").cast("long").alias("l0"), F.col("r0").cast("long").alias("r0"), "n")


@query(
    "diff_summary_numbered",
    f"""WITH {ACTS},
 gaps AS (
   SELECT doc_id, o_kept, len(o_lines) AS n, sum(o_kept::int) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM acts),
 edits AS (
   SELECT doc_id, gap, count_if(NOT o_kept) AS gone, sum(CASE WHEN o_kept THEN n - 1 ELSE n END) AS come, count_if(o_kept) AS same
   FROM gaps GROUP BY doc_id, gap)
 SELECT doc_id, cast(sum(greatest(come - gone, 0)) AS bigint) AS n_add, cast(sum(greatest(gone - come, 0)) AS bigint) AS n_remove,
   cast(sum(least(gone, come)) AS bigint) AS n_change, cast(sum(same) AS bigint) AS n_unchanged
 FROM edits GROUP BY doc_id""",
)
def diff_summary_numbered(spark, d):
    return D.diff_summary(ops(spark, d))


@query(
    "merge3_numbered",
    f"""WITH {ACTS},
 regions AS (SELECT *, o_kept AND t_kept AS stable, sum((o_kept AND t_kept)::int) OVER (PARTITION BY doc_id ORDER BY i) AS region FROM acts),
 sides AS (
   SELECT doc_id, region, max(CASE WHEN stable THEN line END) AS kept,
     coalesce(list(line ORDER BY i) FILTER (WHERE NOT stable), []) AS b,
     flatten(list(CASE WHEN stable THEN o_lines[2:] ELSE o_lines END ORDER BY i)) AS o,
     flatten(list(CASE WHEN stable THEN t_lines[2:] ELSE t_lines END ORDER BY i)) AS t
   FROM regions GROUP BY doc_id, region),
 bodies AS (
   SELECT doc_id, region, o <> t AND o <> b AND t <> b AS clash,
     list_concat(CASE WHEN kept IS NULL THEN [] ELSE [kept] END,
       CASE WHEN o = t OR t = b THEN o WHEN o = b THEN t
         ELSE list_concat(['<<<<<<< ours'], o, ['======='], t, ['>>>>>>> theirs']) END) AS ls
   FROM sides)
 SELECT doc_id, array_to_string(flatten(list(ls ORDER BY region)), chr(10)) AS merged, count_if(clash) > 0 AS has_conflicts, count_if(clash) AS conflict_count
 FROM bodies GROUP BY doc_id""",
)
def merge3_numbered(spark, d):
    return D.merge3(*(numbered(spark, d, rule) for rule in (None, V.OURS, V.THEIRS))).withColumn("conflict_count", F.col("conflict_count").cast("long"))


#: Lines that were removed, changed or kept; quote marks taken off or not; native check boxes; comments that quote one word.
RISKS = """
 split AS (SELECT doc_id, string_split(text, chr(10)) AS ls, string_split(text, ' ') AS ws FROM documents),
 lines AS (SELECT doc_id, i AS j, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM split)),
 changes AS (
   SELECT doc_id, j, CASE (doc_id + j) % 4 WHEN 0 THEN 'remove' WHEN 1 THEN 'unchanged' ELSE 'change' END AS kind,
     CASE WHEN j % 3 = 0 THEN concat('> ', line) ELSE line END AS old,
     CASE WHEN (doc_id + j) % 4 = 0 THEN NULL WHEN (doc_id + j) % 4 = 2 THEN line ELSE concat(line, '.') END AS new,
     (doc_id + j) % 5 = 0 AS native
   FROM lines),
 quoting AS (
   SELECT c.conv_id AS comment_id, s.doc_id, c.conv_id % 4 = 3 AS resolved, s.ws[1 + c.conv_id % len(s.ws)] AS quote
   FROM conversations c JOIN split s ON s.doc_id = c.conv_id // 2 WHERE c.turn = 0)"""


@query(
    "comments_at_risk_rules",
    f"""WITH {RISKS},
 ids AS (
   SELECT x.doc_id, x.j, string_agg(DISTINCT cast(q.comment_id AS varchar), ',' ORDER BY cast(q.comment_id AS varchar)) AS ids
   FROM changes x JOIN quoting q ON q.doc_id = x.doc_id AND NOT q.resolved AND q.quote <> '' AND contains(x.old, q.quote)
   GROUP BY x.doc_id, x.j),
 judged AS (
   SELECT x.*, ids.ids, starts_with(old, '> ') AND substr(old, 3) = coalesce(new, '') AS upgrade
   FROM changes x LEFT JOIN ids ON ids.doc_id = x.doc_id AND ids.j = x.j WHERE kind <> 'unchanged')
 SELECT doc_id, j, kind, concat_ws(',', CASE WHEN ids IS NOT NULL THEN 'comment' END, CASE WHEN native THEN 'native_glyph' END, CASE WHEN upgrade THEN 'style_upgrade' END) AS reasons,
   coalesce(list_aggregate(list_sort(list_transform(string_split(ids, ','), lambda x: x::bigint)), 'string_agg', ','), '') AS comment_ids
 FROM judged WHERE ids IS NOT NULL OR native OR upgrade""",
)
def comments_at_risk_rules(spark, d):
    """Every line of every document by rule, so that all reasons and their combinations come up."""
    x = V.documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\\n", -1)).alias("j", "line"))
    changes = x.selectExpr(
        "doc_id", "cast(j AS bigint) AS j", "CASE (doc_id + j) % 4 WHEN 0 THEN 'remove' WHEN 1 THEN 'unchanged' ELSE 'change' END AS kind",
        "CASE WHEN j % 3 = 0 THEN concat('> ', line) ELSE line END AS old",
        "CASE WHEN (doc_id + j) % 4 = 0 THEN NULL WHEN (doc_id + j) % 4 = 2 THEN line ELSE concat(line, '.') END AS new",
        "(doc_id + j) % 5 = 0 AS native",
    )
    first = V.conversations(spark, d).where("turn = 0").selectExpr("conv_id AS comment_id", "conv_id div 2 AS doc_id", "conv_id % 4 = 3 AS resolved")
    words = V.documents(spark, d).select("doc_id", F.split("text", " ", -1).alias("ws"))
    quoting = first.join(words, "doc_id").selectExpr("comment_id", "doc_id", "resolved", "get(ws, cast(comment_id % size(ws) AS int)) AS quote")
    return C.comments_at_risk(changes, quoting)
