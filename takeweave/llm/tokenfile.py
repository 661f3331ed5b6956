"""Token files: Simple-8b shards of a corpus in ascending document order, and their reader.

``write_tokens`` range-partitions and sorts the documents and encodes each partition to shard files. A shard
ends after the document that brings it to ``SHARD_IDS`` ids, so a task holds one bounded shard at a time; it
is written under a temporary name and renamed when whole. The list of shards with their id counts is
committed as a manifest table. ``read_tokens`` reads the manifest, gives each shard its first id's place in
the corpus by prefix sums, and decodes the shards in parallel.

Null text is an empty text. Null ``doc_id`` values sort first; the manifest counts them for each shard, so every int64 is an
id of its own. Rows with equal or null ``doc_id`` keep one order (by a hash of the text, then the text) and are ranged by that hash
too, so that an id of very many rows is many tasks' work. Very long texts are encoded whole, piece by piece. Columns beside
doc_id and text are not read. An empty table gives a manifest without shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takeweave.llm.simple8b import BLOCK, ShardWriter, read_shard
from takeweave.llm.tokens import END_ID, TOKENIZER, chunks, encoder

SHARD_IDS = 1 << 24
MANIFEST = "part long, number long, file string, docs long, ids long, bytes long, nulls long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def open_store(path: str):
    """A pyarrow file system and the path inside it; works for any store pyarrow knows, shared local folders included."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Roller:
    """Shard files of one task: a file ends after the document that brings it to ``shard_ids`` ids."""

    def __init__(self, path: str, part: int, shard_ids: int, block: int):
        self.store, self.top = open_store(path)
        self.part, self.shard_ids, self.block, self.number = part, shard_ids, block, 0
        self.writer, self.rows, self.nulls = ShardWriter(block), [], 0

    def add(self, docs: np.ndarray, null: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        at = 0
        while len(docs):
            fill = np.cumsum(sizes)
            k = min(len(docs), int(np.searchsorted(fill, self.shard_ids - self.writer.held)) + 1)
            n = int(fill[k - 1])
            self.writer.add(docs[:k], sizes[:k], ids[at : at + n])
            self.nulls += int(null[:k].sum())
            docs, null, sizes, at = docs[k:], null[k:], sizes[k:], at + n
            if self.writer.held >= self.shard_ids:
                self.close()

    def close(self) -> None:
        if self.writer.documents:
            name = f"shard-{self.part:06d}-{self.number:06d}.s8b"
            temp = f"{self.top}/_temporary-{name}-{uuid.uuid4().hex}"
            with self.store.open_output_stream(temp) as out:
                self.writer.write(out)
            size = self.store.get_file_info(temp).size
            self.store.move(temp, f"{self.top}/{name}")  # a second attempt of the task writes the same bytes
            self.rows.append((self.part, self.number, name, self.writer.documents, self.writer.ids, size, self.nulls))
            self.number, self.writer, self.nulls = self.number + 1, ShardWriter(self.block), 0


def _write_task(path: str, tokenizer: str, end_id: int, block: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, roller = encoder(tokenizer), _Roller(path, TaskContext.get().partitionId(), shard_ids, block)
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            docs = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b, texts in chunks(batch.column(1)):
                ids, sizes = words.encode(texts, end_id)
                roller.add(docs[a:b], null[a:b], sizes, ids)
        roller.close()
        if roller.rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*roller.rows, strict=True), kinds, strict=True)], names=["part", "number", "file", "docs", "ids", "bytes", "nulls"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, parts: int | None = None, block: int = BLOCK, shard_ids: int = SHARD_IDS) -> None:
    """Write ``docs(doc_id, text)`` below ``path``; ``path/_manifest`` is written last and lists what is valid."""
    spark = docs.sparkSession
    store, top = open_store(path)
    store.create_dir(top, recursive=True)
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()
    ordered = plain.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(_write_task(path, tokenizer, end_id, block, shard_ids), MANIFEST).write.parquet(f"{path}/_manifest")


def _read_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, nulls, first in zip(*(batch.column(c).to_pylist() for c in ("file", "nulls", "first")), strict=True):
                store, top = open_store(path)
                with store.open_input_stream(f"{top}/{name}") as f:
                    for docs, sizes, ids in read_shard(f):
                        raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes) * 4
                        begins = ends - sizes * 4
                        crc = [zlib.crc32(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(docs, mask=np.arange(len(docs)) < nulls),
                                "start": pa.array(first + begins // 4, pa.int64()),
                                "n_tokens": pa.array(sizes, pa.int64()),
                                "ids_crc32": pa.array(crc, pa.int64()),
                            }
                        )
                        first += int(sizes.sum())
                        nulls -= min(nulls, len(docs))

    return run


def placed_shards(manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``first``: ids of all files before each. Prefix sums over the parts, then over the files of each part."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before(Window.orderBy("part"))), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("ids").over(before(Window.partitionBy("part").orderBy("number"))), F.lit(0))
    return manifest.join(parts, "part").withColumn("first", F.col("_before") + inside).drop("_before")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the shard files of the manifest."""
    shards = placed_shards(spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")).select("file", "nulls", "first")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated, as the list of files is too small to be left to adaptive coalescing
    return shards.repartition(n, "file").mapInArrow(_read_task(path), READ)
