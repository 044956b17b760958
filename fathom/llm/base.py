"""What the operators of this subpackage share: tables, text columns, shared folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP = 16 << 20  # bytes, as rows may hold texts and media


BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches to a few megabytes, as texts and media may be long; a smaller setting stays."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_LIMIT))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader opens it, so any store works."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def whole(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns cannot clash with them; ``_all.*`` brings them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one is set only where the session has none."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="fathom-")  # one process, as in tests
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def partitions(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage with files that outlive a lost executor.
    """
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``written``, with the folder, for ``remove``. What is not removed before goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/fathom-{label}-{uuid.uuid4().hex}"
    store_at(df, path)
    remove_later(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store_at(df: DataFrame, path: str) -> None:
    """Writes ``df`` as Parquet, over what an unfinished write may have left there.

    Spark removes the write's shuffle files at its end, as only the table is read from then on; else they stay until the driver collects garbage.
    """
    conf = df.sparkSession.conf
    was = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        if was is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, was)


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``written_at`` made."""
    fs, place = _place(spark, path)
    fs.delete(place, True)


def remove_later(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the driver ends."""
    fs, place = _place(spark, path)
    fs.deleteOnExit(place)


def map_batches(df: DataFrame, function: Callable, schema, size: int = 8 << 20) -> DataFrame:
    """``function(pa.RecordBatch) -> pa.RecordBatch | dict | None`` over the Arrow batches of ``df``.

    Batches are cut to about ``size`` bytes first, so that long texts do not pile up.
    """

    def run(batches):
        for batch in batches:
            for part in cut(batch, size):
                out = function(part)
                if out is not None:
                    yield out

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, function: Callable, schema, size: int = 1 << 20) -> DataFrame:
    """``function`` from an iterator of Arrow batches, cut to about ``size`` bytes, to an iterator of batches."""

    def run(batches):
        return function(part for batch in batches for part in cut(batch, size))

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, size: int = 8 << 20):
    """Slices of a batch of at most about ``size`` bytes, at least a row each."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * size / max(batch.nbytes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)
