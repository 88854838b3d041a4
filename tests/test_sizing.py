"""Files bounded by bytes."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from tablesync.model import LEDGER
from tablesync.operators.sizing import MOST_FILES, line_bytes, width_ranges, width_sketch
from tablesync.functions.codec import project_typed
from tablesync.plans.jobs import Capture, load_staging, snapshot_to_staging
from tablesync.sources import staged
from tablesync.sources.raw_store import RawStore
from tablesync.session import local_frame
from tablesync.sources.staged import Staging, read_staged


def sketch_of(widths):
    out = {}
    for w in widths:
        c = max(1, (w - 1).bit_length())
        n, b, m = out.get(c, (0, 0, 0))
        out[c] = (n + 1, b + w, max(m, w))
    return [{"width_class": c, "n": n, "bytes": b, "widest": m} for c, (n, b, m) in out.items()]


def test_sketch(spark):
    widths = [1, 2, 3, 4, 5, 8, 9, 1 << 20, (1 << 20) + 1]
    df = spark.createDataFrame([(w,) for w in widths], "w bigint")
    found = [r.asDict() for r in width_sketch(df, F.col("w")).collect()]
    key = lambda r: r["width_class"]
    assert sorted(found, key=key) == sorted(sketch_of(widths), key=key)


def test_ranges_cover_and_bound():
    rng = random.Random(5)
    for _ in range(200):
        bound = rng.choice([1, 100, 4096, 1 << 20])
        widths = [int(2 ** rng.uniform(0, rng.choice([4, 12, 22]))) for _ in range(rng.randrange(1, 400))]
        sketch = sketch_of(widths)
        most = rng.choice([None, 7])
        ranges = width_ranges(sketch, bound, most)
        assert ranges[0].above is None and ranges[-1].widest is None
        assert [r.widest for r in ranges[:-1]] == [r.above for r in ranges[1:]]
        files = 0
        for r in ranges:
            mine = [w for w in widths if (r.above is None or w > r.above) and (r.widest is None or w <= r.widest)]
            assert r.rows_per_file == 1 or r.rows_per_file * max(mine) <= bound
            files += -(-len(mine) // r.rows_per_file)
        least = sum(max(min(-(-c["bytes"] // bound), c["n"]), -(-c["n"] // (most or len(widths)))) for c in sketch)
        assert files <= MOST_FILES * least
    assert width_ranges([], 10) == []
    assert len(width_ranges(sketch_of([100] * 1000), 1 << 20)) == 1
    with pytest.raises(ValueError, match="below 1"):
        width_ranges([], 0)


def test_no_file_above_the_bound(spark, tmp_path):
    wide = F.when(F.col("id") == 77, F.repeat(F.lit("é"), 9000)).when(F.col("id") % 40 == 3, F.repeat(F.lit("x"), 900)).otherwise(F.lit("y"))
    rows = spark.range(500).select("id", wide.alias("t")).unionByName(spark.createDataFrame([(None, None), (500, "")], "id bigint, t string"))
    staging = Staging(str(tmp_path), "shop")
    staged = snapshot_to_staging(spark, {"public.t": rows}, staging, Capture(file_bytes=2000), local_frame(spark, [], LEDGER))
    (chunk,) = staged.manifest.collect()
    assert chunk.row_count == 502 and staged.progress.first().rows_emitted == 502
    sizes = []
    for folder, _, names in os.walk(tmp_path):
        for n in names:
            if n.endswith(".gz") and not n.startswith("."):
                with gzip.open(os.path.join(folder, n)) as f:
                    lines = f.readlines()
                sizes.append((sum(map(len, lines)), len(lines)))
    assert all(size <= 2000 or n == 1 for size, n in sizes)
    assert sum(n for _, n in sizes) == 502 and sum(size > 2000 for size, _ in sizes) == 1
    back = read_staged(spark, staging)
    assert back.count() == 502 and back.agg(F.sum(line_bytes(F.col("value")))).first()[0] == sum(s for s, _ in sizes)
    numbers = sorted(r[0] for r in back.select("_row_number").collect())
    assert numbers == list(range(1, 503))


def test_no_scan_takes_very_many_files(spark, tmp_path, monkeypatch):
    for name, value in (("FOLDER_FILES", 3), ("SCAN_FOLDERS", 4), ("SCAN_FILES", 12)):
        monkeypatch.setattr(staged, name, value)
    text = F.when(F.col("id") % 40 == 3, F.repeat(F.lit("x"), 900)).when(F.col("id") % 50 == 4, F.lit("a\nb")).otherwise(F.lit("y"))
    rows = spark.range(600, numPartitions=5).select("id", text.alias("t"))
    staging = Staging(str(tmp_path), "shop")
    done = snapshot_to_staging(spark, {"public.t": rows}, staging, Capture(file_bytes=500), local_frame(spark, [], LEDGER))
    (chunk,) = done.manifest.collect()
    folders = [[n for n in names if n.endswith(".gz") and not n.startswith(".")] for _, _, names in os.walk(staging.chunks)]
    files = sum(map(len, folders))
    assert max(map(len, folders)) == 3 and chunk.file_count == files > 12 and chunk.row_count == 600
    assert chunk.bytes_written == sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(staging.chunks) for n in names if n.endswith(".gz") and not n.startswith("."))
    back = read_staged(spark, staging)
    assert len(back.inputFiles()) < files
    assert sorted(tuple(r) for r in project_typed(back, rows.schema, "value").collect()) == sorted(tuple(r) for r in rows.collect())
    assert sorted(r[0] for r in back.select("_row_number").collect()) == list(range(1, 601))
    texts = staged.file_texts(spark, staging).collect()
    assert len(texts) == files and sum(r.n for r in texts) == 600 and all(r.bytes <= 500 or r.n == 1 for r in texts)
    assert load_staging(spark, staging, RawStore(str(tmp_path / "raw"))).first().rows_written == 600


def test_sized_options(spark, tmp_path):
    for bad in (Capture(file_bytes=0), Capture(file_bytes=10, chunk_size=5)):
        with pytest.raises(ValueError, match="bytes of a file"):
            bad.check(["t"])
    staging = Staging(str(tmp_path), "shop")
    staged = snapshot_to_staging(spark, {"public.t": spark.range(0)}, staging, Capture(file_bytes=10), local_frame(spark, [], LEDGER))
    (chunk,) = staged.manifest.collect()
    assert chunk.row_count == 0
