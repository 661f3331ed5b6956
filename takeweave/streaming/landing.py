"""Files that land in a folder, normalised or read as word lists batch by batch (T01), without state and without doubles after a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from takeweave.sources import readers


def landing_files(spark: SparkSession, folder: str, pattern: str = "*.txt", files_per_trigger: int = 100) -> DataFrame:
    """(rec_id, content): a row for each file that lands, with its stem in lower case, as ``readers.whole_files`` reads them."""
    stem = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.lower(stem).alias("rec_id"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("content"))


def landing_table(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of a table whose Parquet files land in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)


def start(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, state: str) -> StreamingQuery:
    """Run ``transform`` on each batch of all that is there now, and write it to a folder of the batch's number under ``out``.

    A batch that was broken off is run again with the same number on the same files, as ``state`` has noted them, and writes over what it
    left; a batch that was finished is not run again. So a restart gives no row twice, wherever the break was.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def landed(spark: SparkSession, out: str, schema: str | None = None) -> DataFrame:
    """What all batches have written."""
    reader = spark.read.option("basePath", out)
    return (reader.schema(schema) if schema else reader).parquet(f"{out}/batch=*").drop("batch")


def landed_words(files: DataFrame) -> DataFrame:
    """Transform of word-list files: words with text and a positive length, numbered by time (S01, S02). A file is a recording, so batches don't share one."""
    return readers.cleaned_words(readers.words(files))
