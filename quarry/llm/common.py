"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured rows times a row's width stay below this.
BROADCAST_BYTES = 24 << 20
#: Spark's own number of rows in an Arrow batch, and ours: texts are long.
ARROW_ROWS, SPARK_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local session without one gets its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return context.getCheckpointDir().rstrip("/")


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and bare path of a URI or a local path."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


#: Folders of working data that this process wrote, in order; those left are removed when it ends.
_FOLDERS: ContextVar[list[str]] = ContextVar("folders", default=[])


def new_folder(spark: SparkSession, name: str = "quarry") -> str:
    """A folder of working data in the shared folder, removed at the end of the driver's process or by ``swept``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.get().append(path)
    return path


def remove_folders(paths: list[str]) -> None:
    while paths:
        store, top = place(paths.pop())
        with suppress(OSError):  # gone, or never written
            store.delete_dir(top)


atexit.register(remove_folders, _FOLDERS.get())


@contextmanager
def swept() -> Iterator[list[str]]:
    """Gathers the folders that the block makes; those still in the list go to the outer one."""
    outer, own = _FOLDERS.get(), []
    mark = _FOLDERS.set(own)
    try:
        yield own
    finally:
        _FOLDERS.reset(mark)
        outer.extend(own)


def settle(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, in folders ``by`` some columns if named, and read it back.

    Cuts the lineage in a way that survives the loss of executors, and fixes
    whatever the plan could compute differently a second time.
    """
    return settled(df, *by)[0]


def settled(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """As ``settle``, with the folder."""
    spark = df.sparkSession
    path = new_folder(spark)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def apart(df: DataFrame, *named: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with its columns beside ``named`` under names that no operator uses, and a
    function that gives a result of it the old names and order back, with further columns."""
    held = [c if c in named else f"_other{k}" for k, c in enumerate(df.columns)]
    return df.toDF(*held), lambda out, *more: out.select(*held, *more).toDF(*df.columns, *more)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a settled ``df`` if its counted size allows it.

    Beyond the limit the plan stays a shuffled join.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` in batches that hold few texts, unless the session has its own size.

    A batch is built outside the heap, once on each side, so its size counts twice in a task.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_ROWS) == SPARK_ROWS:
        conf.set(ARROW_ROWS, TEXT_ROWS)
    return df.mapInArrow(function, schema)


def each_row(batches: Iterable, *names: str) -> Iterator[tuple]:
    """The named columns of Arrow batches, row by row."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
