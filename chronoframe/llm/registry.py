"""The queries of this subpackage, as the driver runs them, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontam import benchmark_matches
from .langid import fit_languages, predict_languages
from .licenses import license_matches
from .lm_score import score_texts
from .minhash import minhash_components
from .packing import pack_documents
from .quality import quality_verdicts
from .secrets import BASE_KINDS, credential_spans, spans_text
from .simhash import simhash_components
from .spelling import spelling_variants
from .toxicity import toxicity_scores
from .url_filter import judge_urls
from .vector_codes import vector_codes


def _held_out(modulus: int) -> Column:
    """Whether a document is set aside: the same rows in every run."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == 2, F.lit(False))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "containment", "start_word", "end_word")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", F.col("start").alias("match_start"), F.col("end").alias("match_end"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").withColumn("held_out", _held_out(7)), "held_out")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def packed_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(pack_documents(table(spark, sf_dir, "documents")))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credential_spans(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < BASE_KINDS)
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _held_out(4))
    return toxicity_scores(docs, table(spark, sf_dir, "labels"), "held_out").select("doc_id", "held_out", "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _held_out(4))
    models = fit_languages(docs.where(~F.col("held_out")))
    return predict_languages(docs, models, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_components(table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_url_filters": op3_url_filters,
    "op4_lm_scores": op4_lm_scores,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_packing": op7_packing,
    "op8_secret_scans": op8_secret_scans,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}

_OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(5) AS x(k) GROUP BY 1),
m AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN cov USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  CAST(n_symbols > 0.3 * n_words AS INT) + CAST(n_dup_lines > 0.5 * n_lines AS INT) + CAST(word_chars > 25 * n_words AS INT) AS own,
  CAST(n_symbols > 0.15 * n_words AS INT) + CAST(n_dup_lines > 0.25 * n_lines AS INT) + CAST(word_chars > 12.5 * n_words AS INT) AS strict FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR own > 0) AS f FROM v GROUP BY 1),
p AS (SELECT avg(f / n) AS mean, coalesce(var_samp(f / n), 0) AS spread, avg(1.0 / n) AS inv FROM h),
s AS (SELECT mean, CASE WHEN mean * (1 - mean) <= 0 THEN 1.0 WHEN spread - mean * (1 - mean) * inv <= mean * (1 - mean) / 10001 THEN 10000.0 ELSE greatest(1.0, mean * (1 - mean) / (spread - mean * (1 - mean) * inv) - 1) END AS strength FROM p),
hv AS (SELECT source AS host, (f + mean * strength) / (n + strength) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND CASE WHEN rate > 0.5 THEN strict ELSE own END = 0 AND rate <= 0.9 AS kept
FROM v JOIN hv ON hv.host IS NOT DISTINCT FROM v.source
"""


def _op11_sql() -> str:
    """The rounds one after another; a part is a list of integers."""
    far = "CAST(list_sum(list_transform(list_zip(p.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = [
        "v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS w FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS (SELECT r, pos, w[pos * len(w) // 4 + 1:(pos + 1) * len(w) // 4] AS part FROM v, range(4) AS q(pos))",
        "f AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, w) - 1 AS entry FROM v QUALIFY entry < 256)",
        "c0 AS (SELECT pos, entry, part FROM p JOIN f USING (r))",
    ]
    for k in range(5):
        steps.append(f"a{k} AS (SELECT r, pos, m % 256 AS entry, m // 256 AS error FROM (SELECT p.r, p.pos, min({far} * 256 + c.entry) AS m FROM p JOIN c{k} AS c USING (pos) GROUP BY 1, 2))")
        if k < 4:
            steps.append(f"s{k} AS (SELECT pos, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT a.pos, a.entry, unnest(generate_series(1, len(p.part))) AS i, unnest(p.part) AS x FROM a{k} AS a JOIN p USING (r, pos)) GROUP BY 1, 2, 3)")
            steps.append(f"m{k} AS (SELECT pos, entry, list(x ORDER BY i) AS part FROM s{k} GROUP BY 1, 2)")
            steps.append(f"c{k + 1} AS (SELECT c.pos, c.entry, coalesce(m.part, c.part) AS part FROM c{k} AS c LEFT JOIN m{k} AS m USING (pos, entry))")
    steps += [
        "o AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(error) AS BIGINT) AS error FROM a4 GROUP BY 1)",
        "h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM c4)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (r), h"


#: A checksum by bits for every distinct word of a document, near words by the places at which they differ.
_OP12_SQL = r"""
WITH RECURSIVE bits(b, k, c) AS (SELECT CAST(b AS BIGINT), 0, CAST(b AS BIGINT) FROM range(256) AS t(b) UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (SELECT d, w, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) WHERE length(w) >= 6 GROUP BY 1, 2),
drawn AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(generate_series(1, length(x) // 2), lambda i: CAST(CAST('0x' || x[2 * i - 1:2 * i] AS INTEGER) AS BIGINT))), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS h
  FROM (SELECT w, n, hex(encode(d || ':' || w)) AS x FROM runs), tab),
words AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM drawn) WHERE length(w) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS (SELECT w, n, i, w[:i - 1] AS l, w[i + 1:] AS r FROM (SELECT w, n, unnest(generate_series(1, length(w))) AS i FROM words)),
near AS (
  SELECT a.w AS a, b.w AS b, b.n FROM cut AS a JOIN cut AS b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.w <> b.w
  UNION SELECT c.w, s.w, s.n FROM cut AS c JOIN words AS s ON c.l || c.r = s.w
  UNION SELECT s.w, c.w, c.n FROM cut AS c JOIN words AS s ON c.l || c.r = s.w),
best AS (SELECT a, count(*) AS n_near, max(n) AS top FROM near GROUP BY 1),
forms AS (SELECT w, words.n, coalesce(n_near, 0) AS n_near, (SELECT min(b) FROM near WHERE near.a = w AND near.n = top AND top >= 5 * words.n) AS form, CASE WHEN top >= 5 * words.n THEN top END AS form_n FROM words LEFT JOIN best ON best.a = w),
chain(w, z, k) AS (SELECT w, w, 0 FROM forms UNION ALL SELECT chain.w, forms.form, k + 1 FROM chain JOIN forms ON forms.w = z WHERE forms.form IS NOT NULL)
SELECT w AS word, form, root, n, n_near, form_n FROM forms JOIN (SELECT w, arg_max(z, k) AS root FROM chain GROUP BY 1) USING (w)
"""

_OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
each AS (SELECT r, len(g) AS size, unnest(g) AS g FROM s),
pairs AS (SELECT a.r AS x, b.r AS y, a.size + b.size AS total, count(*) AS c FROM each AS a JOIN each AS b ON a.g = b.g AND a.r < b.r AND 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size) GROUP BY 1, 2, 3),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (total - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(r, o) AS (SELECT r, r FROM s UNION SELECT reach.r, edges.y FROM reach JOIN edges ON edges.x = reach.o)
SELECT a.doc_id, CAST(len(any_value(a.g)) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id, a.doc_id = min(b.doc_id) AS kept FROM reach JOIN s AS a USING (r) JOIN s AS b ON b.r = reach.o GROUP BY reach.r, a.doc_id
"""

ORACLES: dict[str, str] = {"op5_quality_rules": _OP5_SQL, "op11_vector_codes": _op11_sql(), "op12_spelling_variants": _OP12_SQL, "op13_minhash_near_dedup": _OP13_SQL}
