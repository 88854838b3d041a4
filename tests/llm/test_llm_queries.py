"""The registered queries on the smallest tables: columns, rows, SQL twins, and the pipeline stage by stage."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, duck

import corpus_pipeline
from tablesync.llm import ngram_join
from tablesync.llm.common import documents
from tablesync.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
# The first columns of each query.
COLUMNS = {
    "op1_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_ngram_join": "doc_id n_shingles component_id",
    "op4_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op6_phrase_automata": "doc_id n_words n_removed kept_sha256",
    "op7_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_decontamination": "doc_id item_id n_shared n_item containment",
    "op10_quality_classifier": "doc_id",
    "op11_whitening": "vec_id component n deviation whitened explained identity_error",
    "op12_bpe_automaton": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    out = QUERIES[name](spark, SF)
    wanted = COLUMNS[name].split()
    assert out.columns[: len(wanted)] == wanted
    rows, n = out.collect(), documents(spark, SF).count()
    if name == "op4_packing":
        assert len({r.doc_id for r in rows}) == n
    elif name == "op11_whitening":
        assert len(rows) == 4 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    elif name == "op13_conversation_repair":
        assert len(rows) == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    elif name == "op9_decontamination":
        assert 0 < len(rows) < n
    else:
        assert len(rows) == n


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    assert compare(spark, duck(SF), SF, name, QUERIES[name], ORACLE[name]) is None


def test_pipeline(spark):
    docs, kept = documents(spark, SF), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in out.select("doc_id").collect()})
        docs = out
    rejected, copies, contaminated, masked = kept
    assert rejected and copies and contaminated and not masked
    assert not docs.filter(docs["text"].rlike("AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}")).count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    left = ngram_join.components(docs, ngram_join.Threshold(5, 80, 100))
    assert left.filter("doc_id <> component_id").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == packed.count()
