"""Samples counted as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyhelix.plans import run

#: Files of one batch.
FILES = 64


def watch(spark: SparkSession, folder: str, windows: DataFrame, out: str, checkpoint: str, files: int = FILES, max_gap: int = 1000, forever: bool = False) -> StreamingQuery:
    """A stream over the binary alignment files of a folder that counts new ones into the run at ``out``, in batches of at most ``files``.

    Only the names of files stream. A batch that is run again, after a failure or with another ``checkpoint``, finds its samples logged and leaves them as they are,
    so every sample is counted once. A sample that fails leaves the run, as in ``run.count``, which can be asked for it later.
    Without ``forever`` the stream ends when all files that are there have been taken.
    """
    arriving = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.bam").option("maxFilesPerTrigger", files).load(folder).select("path")

    def take(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # names of at most ``files`` files
        if paths:
            run.count(spark, paths, windows, out, max_gap=max_gap, batch=files)

    stream = arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (stream if forever else stream.trigger(availableNow=True)).start()
