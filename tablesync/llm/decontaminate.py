"""Benchmark decontamination: which documents contain a test item, in DataFrame functions only.

Items and documents are sets of hashed shingles (five lower-case words). An item is contained when
at least ``num / den`` of its shingles occur in the document. Items are short and documents long, so
the sets are far from similar and the search is for containment: items fall into partitions by size
(powers of two), and each item is represented by a MinHash sketch, its smallest shingle hashes. The
number kept follows from the partition's largest size ``u``: more than the ``u - ceil(u * num /
den)`` shingles that a containing document may lack. So every containing document holds a sketch
value of the item, and no candidate is lost. Documents probe the sketches with their shingles; a
candidate must be large enough for the item's size; and candidates are verified by the exact number
of shared shingles.

Sketches are broadcast only when their counted number is small, else Spark joins by shuffle. Copies
of a document are searched once per copy but joined by the hash of their text.

Defined cases: null and empty texts have no shingles; a text of fewer words than a shingle is one
shingle; items without a word are contained in nothing; rows that repeat an item_id or a doc_id are
searched each for itself; a null doc_id stays null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import stored, text_column
from tablesync.operators.chunking import fresh_names
from tablesync.session import broadcast_if_small


@dataclass(frozen=True)
class Containment:
    words: int = 5
    num: int = 80
    den: int = 100


def shingle_hashes(words: Column, k: int) -> Column:
    """Distinct hashes of the runs of k words; of all words when there are fewer."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))
    return F.array_distinct(F.when(n >= k, runs).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>")))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def sketched(items: DataFrame, rule: Containment) -> DataFrame:
    """Items with their shingles and the smallest of them, as many as their size partition needs."""
    numbered = items.select(items["item_id"].cast("long").alias("item_id"), words_of(text_column(items)).alias("_words"))
    numbered = numbered.select("item_id", shingle_hashes(F.col("_words"), rule.words).alias("item_shingles")).distinct()
    top = F.pow(F.lit(2), F.floor(F.log2(F.size("item_shingles"))) + 1).cast("int") - 1
    keep = top - F.ceil(top * rule.num / F.lit(rule.den)).cast("int") + 1
    return numbered.filter(F.size("item_shingles") > 0).withColumn(
        "sketch", F.slice(F.array_sort("item_shingles"), F.lit(1), F.greatest(keep, F.lit(1)))
    ).withColumn("item_key", F.xxhash64("item_id", "item_shingles"))


def contained(docs: DataFrame, items: DataFrame, rule: Containment = Containment()) -> DataFrame:
    """Pairs (doc_id, item_id) with n_shared, n_item and containment, where the document contains the item."""
    return found_pairs(docs, items, rule).drop("text_key")


def found_pairs(docs: DataFrame, items: DataFrame, rule: Containment) -> DataFrame:
    """``contained`` with the hash of the document's text, which tells rows of one doc_id apart."""
    known = stored(sketched(items, rule), "items")
    keys = known.select("item_key", F.size("item_shingles").alias("n_item"), F.explode("sketch").alias("shingle"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_column(docs).alias("_text"))
    words = texts.select("doc_id", F.xxhash64("_text").alias("text_key"), words_of(F.col("_text")).alias("_words"))
    probes = words.select("text_key", F.size("_words").alias("n_words"), F.explode(shingle_hashes(F.col("_words"), rule.words)).alias("shingle"))
    large_enough = F.greatest(F.col("n_words") - rule.words + 1, F.lit(1)) * rule.den >= F.col("n_item") * rule.num
    found = probes.join(broadcast_if_small(keys), "shingle").filter(large_enough)
    candidates = stored(found.select("text_key", "item_key").distinct(), "candidates")

    wanted = candidates.groupBy("text_key").agg(F.collect_list("item_key").alias("item_keys")).withColumnRenamed("text_key", "_key")
    checked = texts.join(broadcast_if_small(wanted), F.xxhash64("_text") == F.col("_key")).select("doc_id", F.col("_key").alias("text_key"), words_of(F.col("_text")).alias("_words"), "item_keys")
    checked = checked.select("doc_id", "text_key", shingle_hashes(F.col("_words"), rule.words).alias("shingles"), F.explode("item_keys").alias("item_key"))
    pairs = checked.join(broadcast_if_small(known.select("item_key", "item_id", "item_shingles"), 20_000), "item_key")
    shared = F.size(F.array_intersect("shingles", "item_shingles"))
    out = pairs.select("doc_id", "text_key", "item_id", shared.cast("long").alias("n_shared"), F.size("item_shingles").cast("long").alias("n_item"))
    return out.filter(F.col("n_shared") * rule.den >= F.col("n_item") * rule.num).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, rule: Containment = Containment()) -> DataFrame:
    """The documents that contain no item, with all their columns, decided row by row: a row goes by its id, null or not, and its text."""
    of, key = fresh_names(docs, "_bad", "_text_key")
    bad = found_pairs(docs, items, rule).select(F.col("doc_id").alias(of), F.col("text_key").alias(key)).distinct()
    bad = stored(bad, "contaminated")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(text_column(docs)) == F.col(key))
    return docs.join(broadcast_if_small(bad), same, "left_anti")
