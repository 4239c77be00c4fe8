"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelake.llm import chroma, conversation, exact_dedup, fill_middle, langid, license_scan, lm_score, mixing, pii, piece_bpe, simhash, substring_dedup, token_counts
from tradelake.llm.common import table, text_of, without_space

#: Tokens above which op7 flags a document.
TOKEN_LIMIT = 512

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages; page p has the doc_id -1 - p, which no document has, and its page_id."""
    docs = table(spark, sf_dir, "documents")
    pages = langid.page_rows(table(spark, sf_dir, "pages")).withColumn("doc_id", -1 - F.col("page_id"))
    columns = ["doc_id", "text", "lang", "source"]
    found = langid.identify(docs.select(columns).unionByName(pages.select(columns)), langid.fit(docs))
    return found.withColumn("page_id", F.when(F.col("doc_id") < 0, -1 - F.col("doc_id")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_bpe.encode_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as recordings: the bytes of a text are played as 8-bit samples, for lack of an audio table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("samples"))
    return chroma.align(chroma.fingerprints(docs, "doc_id", "samples", chroma.SHORT, "u1")).withColumnRenamed("id", "doc_id")


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* and base_sha256 are of the base spans; n_added counts what the patterns add; spans holds both."""
    found = pii.find_private(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, pii.KINDS))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{pii.KINDS[kind]}")

    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *map(count, range(len(pii.KINDS))), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), added)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(without_space(text_of("text")), 256)
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation.summary(rows, conversation.damaged(rows))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_piece_codec, op4_audio_fingerprint, op5_private_data, op6_license_scan, op7_token_counts, op8_source_mix, op9_simhash, op10_exact_dedup, op11_conversation_repair, op12_fill_middle, op13_lm_score)}


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d WHERE len(w) > 0),
g AS (SELECT doc_id, word, i, n, CASE WHEN i <= n - 13 THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS win FROM p),
f AS (SELECT doc_id, word, i, n, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS again FROM g),
r AS (SELECT doc_id, word, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST) AS k, (SELECT sum(source_size) FROM s)::BIGINT AS total, (SELECT sum(w) FROM r)::BIGINT AS all_w FROM r),
c AS (SELECT *, (coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3)::BIGINT AS held,
  (all_w - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS free FROM o),
u AS (SELECT (total - held)::DOUBLE / free AS unit FROM c WHERE (total - held)::DOUBLE / free * w <= source_size * 3 ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(w * coalesce((SELECT unit FROM u), 0.0), (source_size * 3)::DOUBLE) AS target FROM r),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate,
  ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, (count(*) OVER (PARTITION BY norm))::BIGINT AS group_size,
  doc_id = first_value(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
  ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS e FROM d),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op8_source_mix": OP8_SQL, "op10_exact_dedup": OP10_SQL, "op12_fill_middle": OP12_SQL}
