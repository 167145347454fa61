"""Registered queries: those with SQL agree with it, all have the columns that are asked for."""

import pytest
from checks.compare import check, connect

import corpus_pipeline
from seclog.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_main_text": {"page_id", "url", "text", "n_chars"},
    "op3_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op4_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op5_near_duplicates": {"doc_id", "class_id", "class_size"},
    "op6_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op7_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op9_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op10_rule_ledger": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept"},
    "op12_centroid_clustering": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
    "op13_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}
TABLES = {"op1_main_text": "pages", "op12_centroid_clustering": "embeddings"}


@pytest.mark.parametrize("name", list(ORACLES))
def test_agrees_with_sql(spark, sf_dir, name):
    result = check(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert result.startswith("ok") and "TYPES" not in result, result


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(ORACLES) - {"op9_toxicity", "op3_best_fit_packing"}))
def test_rows_and_columns(spark, sf_dir, table, name):
    found = QUERIES[name](spark, sf_dir)
    assert COLUMNS[name] <= set(found.columns)
    assert found.count() == table(TABLES.get(name, "documents")).count()


def test_pipeline(spark, sf_dir, table):
    """Every stage keeps the columns and rows of its input; the last packs all that is left."""
    before = table("documents")
    source = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
    ids, docs = set(source), before
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.toPandas(), before.schema)
        left = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert set(left) <= ids
        # no stage empties a text and passes it on
        assert all((text or "").strip() or not (source[i] or "").strip() for i, text in left.items())
        ids = set(left)
    assert len(ids) > 0.6 * before.count()
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
