"""Small builders shared by the tests."""

from pyspark.sql import functions as F

from tablesync.operators.chunking import assign_sequence, number_rows
from tablesync.sources import staged


def stage_rows(spark, staging, df, size, run, stream="public.t", key=None):
    """Stage ``df`` as one committed attempt of one stream."""
    numbered = number_rows(df, key or df.columns)
    rows = assign_sequence(numbered.df, size).withColumn("stream_name", F.lit(stream))
    attempt = f"{run}-{stream}"
    staged.write_chunks(rows, staging, df.columns, attempt)
    return staged.commit_manifest(staged.chunk_manifest(spark, staging, [attempt]), staging, attempt)
