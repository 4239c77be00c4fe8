"""The corpus pipeline against a plain version of its stages, and the registered queries of the operators."""

from __future__ import annotations

import hashlib
import re

import duckdb
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import SMALL, awkward, collected, empty, needs_tables
from tests.llm.test_dedup import brute_components, brute_exact, brute_fingerprint, brute_repeats
from tests.llm.test_text_ops import brute_mix, brute_spans
from tradelake.llm import langid, pii, piece_bpe, queries, token_counts
from tradelake.llm.common import drop_materialized


@needs_tables
def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in langid.identify(docs, langid.fit(docs)).where("kept").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in kept}
    exact = brute_exact([(i, r.text) for i, r in rows.items()])
    rows = {i: rows[i] for i, _, _, keep in exact if keep}
    near = brute_components([(i, brute_fingerprint(r.text)) for i, r in rows.items()])
    rows = {i: rows[i] for i, _, c in near if i == c}
    copies = {i: n for i, _, _, _, n in brute_mix([(i, r.text, r.source) for i, r in rows.items()])}
    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    want = [(i, ids, library.decode(ids)) for i, r in rows.items() if (ids := library.encode(r.text or "", add_eos=True)) for _ in range(copies[i])]
    got = [(r.doc_id, list(r.ids), r.decoded) for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
    drop_materialized(spark)


def test_stages_keep_the_columns(spark):
    docs, model = awkward(spark, [(60 + i, f"the of and thing number {i} in that house " * 3, "en", f"s{i % 3}") for i in range(30)]), None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        assert stage(spark, empty(spark), SMALL).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "source mixing", "SentencePiece coding"] and model is None


@needs_tables
def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = {r.doc_id for r in langid.keep_identified(docs).collect()}
    assert len(left) >= 0.99 * docs.count()


@needs_tables
def test_pipeline_with_repeated_rows(spark, tmp_path):
    """Rows that repeat ids and texts, null ids and clashing names go through all stages; identical rows leave one."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("_dropped", F.lit(1)).withColumn("_hash", F.lit(2))
    few = docs.where("doc_id < 40")
    mixed = docs.unionByName(few).unionByName(few.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(few.withColumn("doc_id", F.col("doc_id") + 1))
    out = mixed
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, SMALL)
        assert out.columns == docs.columns
    plain = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        plain = stage(spark, plain, SMALL)
    # the texts that are left are those of the plain table, each once
    assert sorted(r.text for r in out.select("text").collect()) == sorted(r.text for r in plain.select("text").collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@needs_tables
def test_digest_queries(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    run = {n: f(spark, SMALL) for n, f in queries.queries().items()}
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in run) == list(range(1, 14))
    repeats = [(i, n, r, sha(t)) for i, n, r, t in brute_repeats(list(texts.items()))]
    assert collected(run["op2_substring_dedup"], "doc_id", "n_words", "n_removed", "kept_sha256") == repeats
    library = piece_bpe.codec().library
    coded = [(i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))) for i, t in texts.items() if (ids := library.encode(t, add_eos=True))]
    assert collected(run["op3_piece_codec"], "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(coded, key=repr)
    spans = {i: brute_spans(t) for i, t in texts.items()}
    base = [(i, *(sum(k == j for k, _, _ in s) for j in range(4)), sha(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in s))) for i, s in spans.items()]
    assert collected(run["op5_private_data"], "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(base, key=repr)
    for r in run["op5_private_data"].collect():
        assert {f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans[r.doc_id]} <= set(r.spans.split(","))
    tokens = token_counts.counter().library
    counts = [(i, len(t.encode()), n, n > 512) for i, t in texts.items() for n in [len(tokens.encode(t, add_special_tokens=False).ids)]]
    assert collected(run["op7_token_counts"], "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(counts, key=repr)
    prints = [(i, f"{fp:016x}", c) for i, fp, c in brute_components([(i, brute_fingerprint(t)) for i, t in texts.items()])]
    assert collected(run["op9_simhash"], "doc_id", "fingerprint", "component_id") == sorted(prints, key=repr)
    planted = {i for i, t in texts.items() if re.search(r"(?m)^(Released under the MIT License|Licensed under|All rights reserved)", t)}
    assert planted <= {r.doc_id for r in run["op6_license_scan"].where("confirmed").collect()}
    audio = run["op4_audio_fingerprint"].collect()
    assert len(audio) == len(texts) and all(r.bit_errors <= 0.2 for r in audio if r.aligned)
    same = {}
    for i in sorted(texts):
        same.setdefault(texts[i], i)
    by_id = {r.doc_id: r for r in audio}
    assert all(by_id[i].class_id == by_id[same[t]].class_id and by_id[i].bit_errors == 0 for i, t in texts.items() if same[t] != i)
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").count()
    found = run["op1_language_id"].collect()
    assert len(found) == len(texts) + pages and sum(r.page_id is not None for r in found) == pages


@needs_tables
def test_oracles(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, SMALL), con.sql(sql)
        at = [want.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
