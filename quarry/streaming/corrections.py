"""Corrections as a stream: last writer wins into a table, exactly once.

The table is dealt into buckets by the key's hash. Each micro-batch merges the
buckets that it touches with their newest versions and writes them under its own
number, so a batch that runs again after a failure writes the same; the other
buckets aren't read. A bucket keeps its last two versions.
"""

from __future__ import annotations

import re
from contextlib import suppress

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quarry.operators.corrections import last_writer_wins

BUCKETS = 64


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _versions(path: str) -> dict[int, list[int]]:
    """Finished batches by bucket, in order."""
    store, top = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    out: dict[int, list[int]] = {}
    for batch in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        number = re.fullmatch(r"batch=(\d+)", batch.base_name)
        if number and store.get_file_info(f"{batch.path}/_SUCCESS").type == fs.FileType.File:
            for part in store.get_file_info(fs.FileSelector(batch.path)):
                if m := re.fullmatch(r"bucket=(\d+)", part.base_name):
                    out.setdefault(int(m[1]), []).append(int(number[1]))
    return {b: sorted(v) for b, v in out.items()}


def merge_stream(edits: DataFrame, path: str, key: str, at: str, source: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest edit of each key under ``path``; ends when the input so far is taken in."""

    def merge(batch: DataFrame, number: int) -> None:
        older = {b: [v for v in vs if v < number] for b, vs in _versions(path).items()}
        touched = {r["b"] for r in batch.select(_bucket(key).alias("b")).distinct().collect()}  # at most BUCKETS
        held = [f"{path}/batch={older[b][-1]}/bucket={b}" for b in sorted(touched) if older.get(b)]
        every = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(*held)) if held else batch
        last_writer_wins(every, key, F.col(at), source).withColumn("bucket", _bucket(key)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
        store, top = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        for b in touched:
            for v in older.get(b, [])[:-1]:
                with suppress(FileNotFoundError):
                    store.delete_dir(f"{top}/batch={v}/bucket={b}")

    return edits.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(df: DataFrame, path: str) -> DataFrame:
    """The table as the last finished batches left it, with the columns of ``df``."""
    parts = [f"{path}/batch={vs[-1]}/bucket={b}" for b, vs in sorted(_versions(path).items())]
    return df.sparkSession.read.schema(df.schema).parquet(*parts) if parts else df.limit(0)


def windowed_activity(edits: DataFrame, at: str, kind: Column, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Edits by kind and window with a bound on lateness, for batch and stream alike."""
    return edits.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind.alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
