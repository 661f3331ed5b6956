"""Exact token counts from a histogram of encoded lengths.

Documents are aggregated by encoded length. Suffix sums over the lengths then answer, for every context
limit, how many documents are longer, how many tokens there are in all, and how many remain when each
document is cut at the limit. The suffix sums run in two levels (blocks of lengths, then inside a block),
so no task sees more than one block's rows or one row a block.

Null text counts as empty; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from takeweave.llm.tokens import TOKENIZER, chunks, encoder
from takeweave.session import written

LEVEL = 1024


def _length_task(tokenizer: str, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            for _, _, texts in chunks(batch.column(0)):
                yield pa.RecordBatch.from_pydict({"length": pa.array(words.lengths(texts) + extra, pa.int64())})

    return run


def length_histogram(docs: DataFrame, tokenizer: str = TOKENIZER, extra_tokens: int = 1) -> DataFrame:
    """(length, n_docs): documents by number of ids, the end id included when ``extra_tokens`` is 1."""
    return docs.select(docs["text"].cast("string").alias("text")).mapInArrow(_length_task(tokenizer, extra_tokens), "length long").groupBy("length").agg(F.count("*").alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, read as a context limit:

    n_docs (of exactly L), docs_at_least, tokens_at_least (tokens of documents of L or more), total_docs,
    total_tokens, truncated_tokens (tokens left when each document is cut at L) and rank_below (documents
    shorter than L: the quantiles q with rank_below <= q * total_docs < rank_below + n_docs are L).
    For a limit between two lengths, truncated tokens are those of the next lower L plus
    (limit - L) * (docs_at_least - n_docs).
    The histogram is written once, for both levels to read: it has one row a length, its input is the whole corpus.
    """
    h = written(histogram, "histogram").select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("_t"), F.floor(F.col("length") / LEVEL).alias("_b"))
    blocks = h.groupBy("_b").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "_b",
        F.coalesce(F.sum("_bd").over(after), F.lit(0)).alias("_ad"),
        F.coalesce(F.sum("_bt").over(after), F.lit(0)).alias("_at"),
        F.sum("_bd").over(every).alias("total_docs"),
        F.sum("_bt").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("_b").orderBy(F.desc("length"))
    out = h.join(blocks, "_b").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("_ad")).alias("docs_at_least"),
        (F.sum("_t").over(inside) + F.col("_at")).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    return out.select(
        "*",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        (F.col("total_docs") - F.col("docs_at_least")).alias("rank_below"),
    )


def quantile(totals: DataFrame, q: float) -> DataFrame:
    """The exact length quantile: the least L with at least ``ceil(q * total_docs)`` documents of length L or less."""
    need = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total_docs")))
    return totals.where((F.col("rank_below") < need) & (F.col("rank_below") + F.col("n_docs") >= need)).select("length")


def truncated_total(totals: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut at ``limit`` (any value, also one that no document has)."""
    at = F.when(F.col("length") <= limit, F.col("length"))
    value = F.col("truncated_tokens") + (F.lit(limit) - F.col("length")) * (F.col("docs_at_least") - F.col("n_docs"))
    return totals.agg(F.coalesce(F.max_by(value, at), F.max("total_docs") * limit, F.lit(0)).alias("truncated_tokens"))
