"""How deep places of an ordered text lie inside quotes and brackets: one stack of openers with their closers for each kind."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stack_task(kinds: list[dict[str, str]]):
    """Stacks over rows (key, pos, ch) sorted by key and pos: only the open marks of one key are held, whatever the length of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stacks = object(), [[] for _ in kinds]
        for batch in batches:
            depths = [[] for _ in kinds]
            for key, ch in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != now:
                    now, stacks = key, [[] for _ in kinds]
                for closers, stack, out in zip(kinds, stacks, depths, strict=True):
                    if stack and stack[-1] == ch:
                        stack.pop()
                    elif ch in closers:
                        stack.append(closers[ch])
                    out.append(len(stack))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(d, pa.int64()) for d in depths]], names=["key", "pos", *[f"d{i}" for i in range(len(kinds))]])

    return run


def depths(marks: DataFrame, key: str, kinds: dict[str, dict[str, str]]) -> DataFrame:
    """``key``, pos and one depth a kind: how many marks of the kind are open behind each mark.

    marks(key, pos, ch). A kind maps openers to their closers; an opener that closes itself (a straight quote) opens where it is not on
    top. A closer other than the one on top counts for nothing. The rows of a key are read in order by one task, as a stream; so give marks alone,
    not all characters. Rows with equal pos stand in the order of ch.
    """
    rows = marks.select(key, F.col("pos").cast("long").alias("pos"), "ch").repartition(key).sortWithinPartitions(key, "pos", "ch")
    schema = f"`{key}` {marks.schema[key].dataType.simpleString()}, pos long, " + ", ".join(f"`{k}` long" for k in kinds)
    return rows.mapInArrow(_stack_task(list(kinds.values())), schema)
