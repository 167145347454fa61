"""One query per operator with production parameters over its whole table, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.llm import (
    clustering, decontaminate, filter_audit, html_text, language, line_dedup, near_dup, packing, pii, rules, secrets,
    sharding, toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    found = html_text.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", "n_chars")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three-line window dedup leaves of every document."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "row.text", "n_lines", "n_removed")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token pieces with their places in sequences of 1024."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.scan(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "row.doc_id", *[secrets.counted("base", k).alias(f"n_{k}") for k in secrets.KINDS[:secrets.BASE_KINDS]],
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    found = near_dup.near_duplicate_classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"],
    )
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose id's checksum mod 4 is not 2."""
    docs, held_out = _table(spark, sf_dir, "documents"), language.held_out(4, 2)
    found = language.identify(docs, language.train(docs.where(~held_out)), keep=["doc_id"])
    return found.select("row.doc_id", "lang_pred", "score", "languages").withColumn(
        "held_out", language.held_out(4, 2))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; the field is trained on the whole table."""
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs), keep=["doc_id"])
    return found.select(
        "row.doc_id", *[secrets.counted("base", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of those whose id's checksum mod 5 is not 0."""
    docs, held_out = _table(spark, sf_dir, "documents"), language.held_out(5, 0)
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.score(docs, toxicity.train(docs, labels), keep=["doc_id"])
    return found.select("row.doc_id", "score", "predicted").withColumn("held_out", held_out)


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, failure bits and verdict of the standard policy for every document."""
    ledger = rules.rule_ledger(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    judged = rules.apply_policy(ledger, "standard-1")
    return judged.select(
        "row.doc_id", *rules.COUNTS, rules.fails("base-1").alias("base_failed"),
        "kept", "failed_bits",
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order of them, per language."""
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every whole vector after ten rounds."""
    found = clustering.cluster(_table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return found.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, and its place there."""
    found = sharding.shard_documents(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_main_text, op2_line_dedup, op3_best_fit_packing, op4_secrets, op5_near_duplicates,
        op6_decontamination, op7_language_id, op8_personal_data, op9_toxicity, op10_rule_ledger, op11_filter_audit,
        op12_centroid_clustering, op13_sharding,
    )
}

ORACLES: dict[str, str] = {}

ORACLES["op2_line_dedup"] = """
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
line AS (
  SELECT doc_id, unnest(range(len(lines))) AS n, unnest(lines) AS line FROM split
  WHERE text IS NOT NULL),
win AS (
  SELECT doc_id, n, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM line
  WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
numbered AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, n) AS occurrence
  FROM win WHERE c IS NOT NULL),
covered AS (
  SELECT DISTINCT doc_id, n + j AS n FROM numbered, (SELECT unnest([0, 1, 2]) AS j)
  WHERE occurrence > 1),
left_over AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text, count(*) AS n
  FROM line ANTI JOIN covered USING (doc_id, n) GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NOT NULL THEN coalesce(l.text, '') END AS text,
  CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(lines), 0) - coalesce(l.n, 0) AS BIGINT) AS n_removed
FROM split s LEFT JOIN left_over l USING (doc_id)"""

_PLAIN = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op6_decontamination"] = f"""
WITH doc AS (SELECT doc_id, coalesce({_PLAIN}, []) AS words FROM documents),
item AS (SELECT item_id, {_PLAIN} AS words FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, words, least(13, len(words)) AS size FROM item WHERE len(words) > 0),
item_win AS (
  SELECT DISTINCT item_id, size, list_slice(words, p, p + size - 1) AS win
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS p FROM sized)),
sizes AS (SELECT DISTINCT size FROM item_win),
doc_win AS (
  SELECT doc_id, size, p, list_slice(words, p, p + size - 1) AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS p
        FROM doc, sizes WHERE len(words) >= size)),
hit AS (SELECT doc_id, p, size, item_id FROM doc_win JOIN item_win USING (size, win)),
word_hit AS (
  SELECT doc_id, count(DISTINCT p + j) AS n_hit
  FROM (SELECT DISTINCT doc_id, p, unnest(range(size)) AS j FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc LEFT JOIN word_hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

ORACLES["op10_rule_ledger"] = r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
repeated AS (
  SELECT doc_id, count(DISTINCT p + j) AS n FROM (
    SELECT doc_id, p, unnest([0, 1, 2]) AS j FROM (
      SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p], words[p + 1], words[p + 2]) AS k
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM doc WHERE len(words) > 2))
    WHERE k > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM doc)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.dup, 0) AS n_dup_lines, coalesce(l.n, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals,
    length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digits,
    coalesce(list_max([strlen(w) for w in words]), 0) AS longest,
    len(list_distinct(words)) AS kinds
  FROM doc d LEFT JOIN repeated r USING (doc_id) LEFT JOIN lines l USING (doc_id)),
bits AS (
  SELECT *,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN n_words > 0 AND n_repeat_words / n_words > 0.5 THEN 2 ELSE 0 END
    + CASE WHEN n_words > 0 AND n_symbols / n_words > 0.2 THEN 4 ELSE 0 END
    + CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND capitals / word_chars > 0.5 THEN 16 ELSE 0 END
    + CASE WHEN n_words = 0 OR word_chars / n_words < 1.5 THEN 32 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars / n_words > 25 THEN 64 ELSE 0 END
    + CASE WHEN longest > 1000 THEN 128 ELSE 0 END
    + CASE WHEN n_words > 0 AND digits / word_chars > 0.5 THEN 256 ELSE 0 END
    + CASE WHEN n_words = 0 OR kinds / n_words < 0.02 THEN 512 ELSE 0 END AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  failed_bits = 0 AS kept, CAST(failed_bits AS BIGINT) AS failed_bits
FROM bits"""

ORACLES["op11_filter_audit"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copy FROM documents),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN copy THEN 'E' ELSE '' END AS fails
  FROM words LEFT JOIN marks USING (doc_id)),
counts AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM judged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)),
met AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failed, fails = f AS alone,
    len(translate(fails, before, '')) < len(fails) AS gone
  FROM counts, steps),
tally AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failed), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE NOT gone AND failed), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND failed), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND failed), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE NOT gone AND failed), 0) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM tally"""
