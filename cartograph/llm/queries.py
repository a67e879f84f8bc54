"""Thin queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.llm import alignment, chunks, decontaminate, language, licenses, linededup, mixing, pii, quality, simhash, suffix, tokens, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha256(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedup_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(documents(spark, sf_dir).select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_lines", "lost_chars", sha256(F.col("kept_text")).alias("kept_sha256"))


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaks(documents(spark, sf_dir).select("doc_id", "text"), benchmark)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_spans", "n_secret", sha256(F.col("base")).alias("base_sha256"), "spans")


def op9_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_shared", "shared_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "with_doc")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept_text")).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "lead")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.align_tokenizers(documents(spark, sf_dir).select("doc_id", "text"), *files)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


QUERIES = {
    "op1_mixing": op1_mixing, "op2_repeats": op2_repeats, "op3_simhash": op3_simhash, "op4_tokens": op4_tokens, "op5_licenses": op5_licenses,
    "op6_quality": op6_quality, "op7_leaks": op7_leaks, "op8_pii": op8_pii, "op9_chunks": op9_chunks, "op10_lines": op10_lines,
    "op11_whitening": op11_whitening, "op12_language": op12_language, "op13_alignment": op13_alignment,
}

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SYMBOL_COUNT = "length(regexp_replace({x}, '[^#*$%&|<>]', '', 'g'))"

ORACLES: dict[str, str] = {
    "op10_lines": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND f.owner <> k.doc_id AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op6_quality": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(0, 8) x(j) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
full_lines AS (SELECT doc_id, pos, line, length(line) AS n, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(line, '[^a-z]', '', 'g')) AS low FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
t_lines AS (SELECT *, trim(line, {BLANKS}) AS t, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS nw, length(regexp_replace(line, '[^{quality.MARKS}]', '', 'g')) AS marks FROM full_lines),
judged AS (SELECT *, 100 * {SYMBOL_COUNT.format(x="line")} > 10 * n OR length(regexp_replace(line, '[^{quality.SEPARATORS}]', '', 'g')) >= 3 OR (up + low >= 20 AND 100 * up > 70 * (up + low))
  OR regexp_matches(lower(line), '{"|".join(quality.BOILERPLATE)}')
  OR (NOT regexp_matches(t, '{quality.ENDS.replace("'", "''")}') AND ((nw >= 4 AND nw > 50 * marks) OR (length(t) <= 200 AND regexp_matches(lower(t), '{quality.BAR}')))) AS bad FROM t_lines),
lost AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (bad) AS n, coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (bad), 0) AS c FROM judged GROUP BY doc_id),
rest AS (SELECT l.doc_id, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (NOT coalesce(bad, false)), '')) AS kept_sha256 FROM l LEFT JOIN judged j ON j.doc_id = l.doc_id AND j.pos = l.pos GROUP BY l.doc_id),
m AS (SELECT d.doc_id, kept_sha256, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, {SYMBOL_COUNT.format(x="t")} AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_lost_lines, CAST(coalesce(lost.c, 0) AS BIGINT) AS lost_chars FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id LEFT JOIN rest ON rest.doc_id = d.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= 30 * word_chars AS kept FROM m""",
}
