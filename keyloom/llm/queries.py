"""The registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import bloomlm, common, imatch, jaccard, licenses, mixing, packing, quality, sharding, sstable, suffix


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.at_workers(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": lambda spark, d: quality.score_quality(documents(spark, d)),
        "op2_vector_packing": lambda spark, d: packing.pack_digest(documents(spark, d), word_tokenizer()),
        "op3_jaccard_join": lambda spark, d: jaccard.jaccard_digest(documents(spark, d)),
        "op4_sstable": lambda spark, d: sstable.sstable_digest(documents(spark, d), word_tokenizer()),
        "op5_license_scan": lambda spark, d: licenses.license_digest(documents(spark, d)),
        "op6_mix": lambda spark, d: mixing.mix_digest(documents(spark, d)),
        "op7_suffix_dedup": lambda spark, d: suffix.repeat_digest(documents(spark, d)),
        "op8_imatch": lambda spark, d: imatch.fingerprint_pairs(documents(spark, d)),
        "op9_shard": lambda spark, d: sharding.shard_digest(documents(spark, d)),
        "op10_bloom_lm": lambda spark, d: bloomlm.score_lm(documents(spark, d)),
    }


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS w FROM sized GROUP BY source),
capped AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS whole, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS FIRST) AS rank FROM sources),
levels AS (
  SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
targets AS (
  SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(level, rank) FROM levels WHERE cap / w >= level)), cap) AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, CAST(round(b.target) AS BIGINT) - b.epochs * b.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM placed
"""


def license_sql() -> str:
    """The templates' words as rows, joined with the places of their words in the texts."""
    rows, heads = [], []
    for k, (phrase, label, keys) in enumerate([(p, x, None) for p, x in licenses.BASE] + [(p, x, ks) for x, p, ks in licenses.NOTICES]):
        t = phrase.split()
        must = set(range(len(t))) if keys is None else {a + j for key in keys for a in [next(i for i in range(len(t)) if t[i : i + len(key.split())] == key.split())] for j in range(len(key.split()))}
        heads.append(f"({k}, '{label}', {len(t)}, {len(must)}, {'true' if keys is None else 'false'})")
        rows += [f"({k}, {at}, '{w}', {'true' if at in must else 'false'})" for at, w in enumerate(t)]
    upper = "".join(chr(c) for c in range(65, 91))
    return rf"""
WITH head(k, label, n, n_must, base) AS (VALUES {', '.join(heads)}),
template(k, rel, word, must) AS (VALUES {', '.join(rows)}),
texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM texts),
hits AS (SELECT * FROM places WHERE word IN (SELECT word FROM template)),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM hits GROUP BY word),
rare AS (
  SELECT k, word FROM (SELECT k, word, base, row_number() OVER (PARTITION BY k ORDER BY coalesce(df.n, 0), word) AS rank FROM (SELECT DISTINCT k, word FROM template) t JOIN head USING (k) LEFT JOIN df USING (word))
  WHERE rank <= CASE WHEN base THEN 1 ELSE {licenses.ANCHORS} END),
votes AS (SELECT DISTINCT h.doc_id, t.k, h.pos - t.rel AS start FROM hits h JOIN template t ON h.word = t.word JOIN rare r ON r.k = t.k AND r.word = t.word),
scored AS (
  SELECT v.doc_id, v.k, v.start, count(*) / head.n::DOUBLE AS score FROM votes v JOIN head ON head.k = v.k JOIN template t ON t.k = v.k JOIN hits h ON h.doc_id = v.doc_id AND h.pos = v.start + t.rel AND h.word = t.word
  GROUP BY v.doc_id, v.k, v.start, head.n, head.n_must, head.base HAVING sum(CASE WHEN t.must THEN 1 ELSE 0 END) = head.n_must AND count(*) / head.n::DOUBLE >= CASE WHEN head.base THEN 1.0 ELSE {licenses.LEAST} END),
found AS (SELECT s.*, head.label, head.base FROM scored s JOIN head USING (k)),
summed AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM texts LEFT JOIN summed USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": license_sql(), "op6_mix": MIX_SQL}
