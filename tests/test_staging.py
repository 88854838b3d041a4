import gzip
import os

import pytest
from pyspark.sql import functions as F

from tablesync.functions.codec import project_typed
from tablesync.operators.chunking import assign_sequence, number_rows
from tablesync.sources import staged
from tablesync.sources.staged import Staging


def stage(spark, staging, df, key, size, run="r1", stream="public.t", **options):
    numbered = number_rows(df, key)
    rows = assign_sequence(numbered.df, size).withColumn("stream_name", F.lit(stream))
    staged.write_chunks(rows, staging, df.columns, run, **options)
    return staged.commit_manifest(staged.chunk_manifest(spark, staging, [run]), staging, run)


def test_round_trip_one_file_per_chunk(spark, tmp_path):
    staging = Staging(str(tmp_path), "shop", prefix=" /daily/ ")
    df = spark.range(25).select("id", F.concat(F.lit("line\n"), F.col("id")).alias("t"))
    manifest = stage(spark, staging, df, ["id"], 10)
    rows = manifest.orderBy("sequence").collect()
    assert [(r.sequence, r.row_count, r.file_count) for r in rows] == [(0, 10, 1), (1, 10, 1), (2, 5, 1)]
    assert rows[0].object_key.startswith("daily/pipelines/shop/streams/public.t/")
    assert rows[0].content_type == "application/x-ndjson" and rows[0].content_encoding == "gzip"
    files = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".txt.gz")]
    assert len(files) == 3
    assert sorted(os.path.getsize(f) for f in files) == sorted(r.bytes_written for r in rows)
    lines = [line for f in files for line in gzip.open(f, "rt")]
    assert len(lines) == 25
    back = staged.read_staged(spark, staging)
    assert project_typed(back, df.schema, "value").exceptAll(df).count() == 0
    first = back.filter("sequence = 1 and _row_number = 1").first().value
    assert first == '{"id":10,"t":"line\\n10"}'


def test_odd_names_survive_paths(spark, tmp_path):
    staging = Staging(str(tmp_path), "p:x +y%")
    manifest = stage(spark, staging, spark.range(3), ["id"], 2, stream='a b.c"d/é+%41')
    assert [r[0] for r in manifest.select("stream_name").distinct().collect()] == ['a b.c"d/é+%41']
    assert staged.read_staged(spark, staging).count() == 3
    assert staged.read_staged(spark, staging, ["other"]).count() == 0


def test_whole_table_as_one_chunk_of_many_files(spark, tmp_path):
    staging = Staging(str(tmp_path), "shop")
    manifest = stage(spark, staging, spark.range(100), (), None, rows_per_file=9)
    row = manifest.collect()
    assert len(row) == 1 and row[0].row_count == 100 and row[0].file_count >= 12
    back = staged.read_staged(spark, staging)
    assert back.agg(F.countDistinct("_row_number"), F.max("_row_number"), F.min("_row_number")).first() == (100, 100, 1)


def test_uncommitted_attempt_is_invisible(spark, tmp_path):
    staging = Staging(str(tmp_path), "shop")
    rows = assign_sequence(number_rows(spark.range(5)).df, 2).withColumn("stream_name", F.lit("a.b"))
    staged.write_chunks(rows, staging, ["id"], "crashed")
    assert staged.list_chunks(spark, staging).count() == 0
    assert staged.read_staged(spark, staging).count() == 0


def test_newest_attempt_of_a_key_wins(spark, tmp_path):
    staging = Staging(str(tmp_path), "shop")
    stage(spark, staging, spark.range(5), ["id"], 5, "r1")
    stage(spark, staging, spark.range(7).select((F.col("id") + 100).alias("id")), ["id"], 5, "r2")
    rows = staged.list_chunks(spark, staging).collect()
    assert [(r.sequence, r.row_count, r.attempt) for r in rows] == [(0, 5, "r2"), (1, 2, "r2")]
    assert staged.read_staged(spark, staging).filter("value like '%:1__}'").count() == 7


def test_some_chunks_of_an_attempt(spark, tmp_path):
    staging = Staging(str(tmp_path), "shop")
    manifest = stage(spark, staging, spark.range(50), ["id"], 10)
    part = staged.read_chunks(spark, staging, manifest.filter("sequence in (1, 3)"))
    assert part.count() == 20
    assert part.agg(F.max("_row_number")).first()[0] == 10


def test_same_content_same_hash(spark, tmp_path):
    staging = Staging(str(tmp_path), "shop")
    a = stage(spark, staging, spark.range(9), ["id"], 5, "r1").orderBy("sequence").collect()
    b = stage(spark, staging, spark.range(9), ["id"], 5, "r2").orderBy("sequence").collect()
    c = stage(spark, staging, spark.range(1, 10), ["id"], 5, "r3").orderBy("sequence").collect()
    assert [r.content_hash for r in a] == [r.content_hash for r in b]
    assert all(x.content_hash != y.content_hash for x, y in zip(a, c))


def test_bucket_mismatch(spark, tmp_path):
    staging = Staging(str(tmp_path), "shop", bucket="mine")
    manifest = stage(spark, staging, spark.range(3), ["id"], 2)
    assert staged.check_manifest_bucket(manifest, "mine") == 2
    with pytest.raises(ValueError, match="bucket mine, this area is other"):
        staged.check_manifest_bucket(manifest, "other")


# ------------------------------------------------ chunks staged by other tools


def foreign(staging, stream, sequence, text):
    folder = f"{staging.chunks}/streams/{stream}/partitions/default/chunks"
    os.makedirs(folder, exist_ok=True)
    name = sequence if isinstance(sequence, str) else f"{sequence:020d}.jsonl.gz"
    with gzip.open(f"{folder}/{name}", "wt") as f:
        f.write(text)


def test_foreign_layout(spark, tmp_path):
    staging = Staging(str(tmp_path), "shop", prefix="x")
    assert staged.list_chunks(spark, staging).count() == 0
    foreign(staging, "public.users", 1, '{"id":4}\n')
    foreign(staging, "public.users", 0, '{"id":1}\n\n  {"id":2}\r\n{"id":3}')
    foreign(staging, "public.empty", 0, "")
    foreign(staging, "public.users", "notes.txt", "ignored")
    os.makedirs(f"{staging.chunks}/streams/loose")
    with gzip.open(f"{staging.chunks}/streams/loose/7.jsonl.gz", "wt") as f:
        f.write("not a chunk")
    listed = staged.list_chunks(spark, staging).collect()
    assert [(r.stream_name, r.sequence) for r in listed] == [
        ("public.empty", 0), ("public.users", 0), ("public.users", 1)
    ]
    assert listed[2].object_key == (
        "x/pipelines/shop/streams/public.users/partitions/default/chunks/00000000000000000001.jsonl.gz"
    )
    adopted = staged.adopt_foreign_chunks(spark, staging)
    assert {(r.stream_name, r.sequence): r.row_count for r in adopted.collect()} == {
        ("public.empty", 0): 0, ("public.users", 0): 3, ("public.users", 1): 1
    }
    lines = staged.read_foreign_chunks(spark, staging, adopted.filter("sequence = 0")).collect()
    assert staged.read_staged(spark, staging, ["public.users"]).count() == 4
    assert sorted((r._row_number, r.value) for r in lines) == [(1, '{"id":1}'), (2, '{"id":2}'), (3, '{"id":3}')]


def test_foreign_bad_sequence(spark, tmp_path):
    staging = Staging(str(tmp_path), "shop")
    foreign(staging, "a.b", "12x.jsonl.gz", "{}")
    with pytest.raises(Exception, match="no chunk number"):
        staged.list_chunks(spark, staging).collect()


def test_line_numbers_need_no_shuffle(spark, tmp_path):
    staging = Staging(str(tmp_path), "shop")
    manifest = stage(spark, staging, spark.range(50), ["id"], 10)
    plan = staged.read_chunks(spark, staging, manifest)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_small_chunks_share_tasks(spark, tmp_path):
    parallel = 4 * spark.sparkContext.defaultParallelism
    assert staged.writers(spark, 10_800, 5_000) == max(1_080, parallel)
    assert staged.writers(spark, 3, 5_000) == 12 and staged.writers(spark, 40_000, 1_000_000) == staged.MOST_WRITERS
    assert staged.writers(spark, 54, 1_000_000) == 216
    rows = spark.range(3000).select(F.struct("id").alias("_row"), F.floor(F.col("id") / 10).alias("sequence"), F.struct("id").alias(staged.ORDER))
    staging = staged.Staging(str(tmp_path), "shop")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("writes", "")
    staged.write_digested(rows, staging, "public.t", "a", 300, chunk_rows=10)
    stages = [i for j in jobs.getJobIdsForGroup("writes") for i in jobs.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(jobs.getStageInfo(i).numTasks for i in stages if jobs.getStageInfo(i)) <= parallel
    found = staged.listed_chunks(spark, staging, ["a"]).collect()
    assert sorted(r.sequence for r in found) == list(range(300)) and all(r.content_hash.startswith("10-") for r in found)
    read = spark.read.text(f"{staging.attempt('a')}/*/*/sequence=7/*")
    assert [r[0] for r in read.collect()] == [f'{{"id":{i}}}' for i in range(70, 80)]
