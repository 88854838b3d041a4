"""The registered queries of this folder, each over its whole tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablesync.llm import (
    bpe_automaton, conversation_repair, decontaminate, license_scan, lm_trie, ngram_join, packing, phrase_automata,
    quality_classifier, quality_rules, secret_scan, suffix_dedup, whitening,
)
from tablesync.llm.common import documents, ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(fn: Query) -> Query:
    @wraps(fn)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = query
    return query


@register
def op2_quality_rules(spark, sf):
    """Counts, base verdict and risk-controlled verdict of every document."""
    docs = documents(spark, sf)
    return quality_rules.apply(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))


@register
def op3_ngram_join(spark, sf):
    """Components of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_join.components(documents(spark, sf))


@register
def op4_packing(spark, sf):
    """Documents packed into sequences of 2048 tokens."""
    return packing.pack(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op1_secret_scan(spark, sf):
    """Secrets of every document, told apart by who holds them."""
    return secret_scan.scan(documents(spark, sf))


@register
def op5_license_scan(spark, sf):
    """License mentions of every document, by ordered signatures."""
    return license_scan.scan(documents(spark, sf))


@register
def op6_phrase_automata(spark, sf):
    """Words left after every 35-word window that recurs anywhere is removed."""
    return phrase_automata.removed(documents(spark, sf))


@register
def op7_suffix_dedup(spark, sf):
    """Bytes left after every 100-byte string that also starts earlier is removed."""
    return suffix_dedup.removed(documents(spark, sf))


@register
def op8_lm_scoring(spark, sf):
    """log10 probability of every text under a trigram model of the training fold."""
    return lm_trie.score(documents(spark, sf))


@register
def op9_decontamination(spark, sf):
    """Documents that contain a benchmark item, with the item and the share of it they hold."""
    return decontaminate.contained(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


ORACLE["op9_decontamination"] = r"""
WITH w AS (
  SELECT doc_id AS id, FALSE AS item, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
  UNION ALL
  SELECT item_id, TRUE, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark
), s AS (
  SELECT DISTINCT id, item, unnest(CASE WHEN len(words) >= 5
    THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w
), n AS (SELECT id, count(*) AS n_item FROM s WHERE item GROUP BY id
), p AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM s AS d JOIN s AS i ON d.shingle = i.shingle AND NOT d.item AND i.item GROUP BY ALL
)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM p JOIN n ON item_id = n.id WHERE 100 * n_shared >= 80 * n_item
"""


@register
def op10_quality_classifier(spark, sf):
    """Probabilities that a document is good and toxic, from its words and from its site."""
    return quality_classifier.classify(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@register
def op11_whitening(spark, sf):
    """Embeddings whitened along their first four components."""
    return whitening.whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))


@register
def op12_bpe_automaton(spark, sf):
    """Byte-pair ids of every text and the text decoded from them, as digests."""
    return bpe_automaton.digests(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op13_conversation_repair(spark, sf):
    """Faults of every damaged conversation and its cheapest repair."""
    return conversation_repair.report(spark.read.parquet(f"{sf}/conversations.parquet"))


ORACLE["op3_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS id, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(words) >= 4
    THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(list_slice(words, i, i + 3), ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w
), n AS (SELECT id, count(*) AS n FROM s GROUP BY id
), shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.id <> b.id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n AS x ON x.id = a JOIN n AS y ON y.id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)
), reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles,
       least(doc_id, (SELECT min(o.doc_id) FROM reach JOIN w AS o ON o.id = reach.b WHERE reach.a = w.id)) AS component_id
FROM w LEFT JOIN n ON n.id = w.id
"""

ORACLE["op6_phrase_automata"] = r"""
WITH w AS (
  SELECT row_number() OVER () AS id, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), phrases AS (
  SELECT id, i, array_to_string(list_slice(words, i, i + 34), ' ') AS phrase
  FROM (SELECT id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)
), covered AS (
  SELECT DISTINCT id, unnest(range(i, i + 35)) AS p FROM phrases
  WHERE phrase IN (SELECT phrase FROM phrases GROUP BY phrase HAVING count(*) > 1)
), kept AS (
  SELECT id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM (SELECT id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) ANTI JOIN covered USING (id, p) GROUP BY id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (id)
"""
