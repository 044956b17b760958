"""Streams over the same state: ledgers, failure counters and file arrivals. Each foreachBatch merge is idempotent by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from fathom.operators.memory import failure_rows, upsert_failures
from fathom.sources.store import Store


def first_runs(runs: DataFrame, late: str = "7 days") -> DataFrame:
    """The first run of each (hook_name, session_id) within the watermark; state for older ones is dropped."""
    return runs.withWatermark("executed_at", late).dropDuplicatesWithinWatermark(["hook_name", "session_id"])


def counted_failures(errors: DataFrame, store: Store, name: str = "failures") -> DataStreamWriter:
    """Merges each batch of errors into a stored table; the batch number is noted in its pointer, so a repeat changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        last = store.note(name)
        if last is not None and last >= number:
            return
        empty = "signature string, error_type string, error_message string, root_cause string, fix_applied string, occurrences long, resolved_at timestamp"
        stored = store.read(name) if store.current(name) else store.spark.createDataFrame([], empty)
        met = failure_rows(batch).select("signature").distinct()
        store.change(name, ["signature"], upsert_failures(stored.join(met, "signature", "left_semi"), batch), note=number)

    return errors.writeStream.foreachBatch(merge)


def arriving_files(spark: SparkSession, root: str) -> DataFrame:
    """Source files as they appear below a folder: path, modificationTime, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
