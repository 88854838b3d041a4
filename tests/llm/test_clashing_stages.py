"""Pipeline stages on documents whose columns are named like the stages' own."""

from helpers import frame

from tablesync.llm import decontaminate, ngram_join, secret_scan

NAMES = ("_live", "_gone", "_bad", "_text_key", "_key")
TEXT = "one two three four five six seven eight nine ten"


def clashing(spark):
    rows = [(1, TEXT), (2, TEXT), (3, "the password=abc123def456 is here and nowhere else"), (None, None), (4, "")]
    return frame(spark, rows).selectExpr("*", *[f"doc_id AS {c}" for c in NAMES])


def test_stages_keep_clashing_columns(spark):
    docs = clashing(spark)
    kept = ngram_join.keep_one(docs, ngram_join.Threshold(5, 80, 100))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, None}
    items = spark.createDataFrame([(9, TEXT)], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {3, 4, None}
    masked = secret_scan.mask(docs)
    assert masked.columns == docs.columns and masked.count() == 5
    assert all(r.doc_id == r["_live"] == r["_key"] for r in masked.collect())
    assert "abc123def456" not in " ".join(r.text or "" for r in masked.collect())
