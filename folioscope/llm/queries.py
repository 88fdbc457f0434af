"""The queries of the training-data operators over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.bpe_codec import encode_decode
from folioscope.llm.common import table
from folioscope.llm.packing import pack
from folioscope.llm import conversation_trie, html_extract, language_id, license_scan, media, ngram_join, periodic_runs, quality_classifier, quality_rules, sharding, substring_dedup
from folioscope.llm.quality_classifier import held_out


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    out = quality_classifier.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    out = language_id.predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules.measure(docs, quality_rules.learn(docs))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "rules.*")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.text_rows(table(spark, sf_dir, "documents"))
    out = sharding.assign_shards(rows, 24, ties=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, by a hash of the id, repeats a stretch of its words to the end."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).cast("long").alias("g"))
    docs = docs.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.array_join(F.expr("transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE get(w, cast(a + (i - a) % p AS int)) END)"), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    better = lambda s, r: s.isNull() | (r["length"] * s["period"] > s["length"] * r["period"])
    found = found.withColumn("best", F.aggregate("runs", none, lambda s, r: F.when(better(s, r), r).otherwise(s)))
    rows = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    ended = F.when(F.size("runs") > 0, F.concat(rows, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(ended.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 counts before any reference comes in, which SQL can say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.measure(docs, quality_rules.References()).select("doc_id", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])


def sharding_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each of op6's shards: its rows, its slots, and the sizes and texts of all shards together."""
    out = op6_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n_rows"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.sum("size").alias("size"), F.bit_xor("doc_id").alias("ids"))
    every = W.partitionBy()  # one row a shard
    return out.select(F.col("shard").cast("long").alias("shard"), "n_rows", "slots", "first_slot", "last_slot", F.sum("size").over(every).alias("total_size"), F.bit_xor("ids").over(every).alias("all_ids"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_language_id": op2_language_id,
    "op3_ngram_join": op3_ngram_join,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_sharding": op6_sharding,
    "op7_media": op7_media,
    "op8_html_extract": op8_html_extract,
    "op9_packing": op9_packing,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_periodic_runs": op13_periodic_runs,
    "quality_base_counts": quality_base_counts,
    "sharding_laws": sharding_laws,
}

#: White space as the operators take it, and a text's words.
_SPACE = "[\\x20\\x09-\\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"
#: crc32 of a number's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast({0} AS varchar), ''), lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
   lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::bigint ELSE 0 END)), 4294967295::bigint)"""

ORACLES: dict[str, str] = {
    "op11_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
 k AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 13], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - 12)) AS i FROM w)),
 least AS (SELECT g, min(doc_id) AS first FROM k GROUP BY g),
 gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS p FROM k JOIN least USING (g) WHERE first < doc_id),
 placed AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS p, unnest(ws) AS word FROM w),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM placed WHERE (doc_id, p) NOT IN (SELECT (doc_id, p) FROM gone) GROUP BY doc_id),
 n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
 SELECT w.doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_conversation_trie": f"""WITH t AS (
   SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, count(*) AS size, {_CRC.format('conv_id')} % 4 AS h FROM t GROUP BY conv_id),
 r AS (
   SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos < c.h
   UNION ALL
   SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.size, 0)), t.role, t.text FROM c JOIN t USING (conv_id) LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20 WHERE t.pos >= c.h),
 seq AS (
   SELECT c.conv_id, coalesce(list(md5(concat(length(role), ':', role, text)) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS ks,
     coalesce(list(len({_WORDS}) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS ns
   FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
 m AS (SELECT conv_id, d, array_to_string(ks[:d], '') AS node, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS words, d = len(ks) AS ends FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM seq)),
 nodes AS (
   SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
   FROM m GROUP BY node, d),
 kids AS (SELECT node[: 32 * (d - 1)] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
 v AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
 up AS (SELECT node[: 32 * a] AS node, count_if(n_children = 0) AS n_leaves, sum((n - 1) * words)::bigint AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM v) GROUP BY 1)
 SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, up.n_leaves, up.saved AS saved_tokens, v.ends_sha256
 FROM v JOIN up USING (node) LEFT JOIN v p ON v.d > 0 AND p.d = v.d - 1 AND p.node = v.node[: 32 * (v.d - 1)]""",
    "quality_base_counts": f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
 l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
 k AS (SELECT doc_id, i, ws[i + 1 : i + 3] AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - 2)) AS i FROM w)),
 twice AS (SELECT doc_id, g FROM k GROUP BY doc_id, g HAVING count(*) > 1),
 covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(3)) AS p FROM k JOIN twice USING (doc_id, g)) GROUP BY doc_id)
 SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
   len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(n, 0) > 50 * len(ws) AS base_failed
 FROM w JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id)""",
    "sharding_laws": """WITH s AS (SELECT unnest(range(24)) AS shard), t AS (SELECT count(*) AS n, sum(octet_length(encode(coalesce(text, ''))) + 8)::bigint AS total_size, bit_xor(doc_id) AS all_ids FROM documents),
 c AS (SELECT shard, ((shard + 1) * n + 23) // 24 - (shard * n + 23) // 24 AS n_rows, total_size, all_ids FROM s, t)
 SELECT shard, n_rows, n_rows AS slots, 0 AS first_slot, n_rows - 1 AS last_slot, total_size, all_ids FROM c""",
}
