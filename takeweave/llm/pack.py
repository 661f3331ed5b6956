"""Packing token sequences with bounded-space online best fit.

Each task keeps ``open_windows`` windows of ``window`` tokens. A document's whole windows leave at once;
its rest goes into the fullest open window with room for it. If none has room, the fullest window is
topped up with the head of the rest, leaves full, and the tail opens a new window. What is left open in
the tasks is merged in rounds of groups of bounded size, and the last rest is cut at powers of two, which
need no padding.

Rows: null text packs as the end token alone. Null or repeated ``doc_id`` values are carried as they are,
each row packing on its own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeweave.llm.tokens import END_ID, TOKENIZER, chunks, encoder
from takeweave.session import written

WINDOW = 2048
OPEN_WINDOWS = 16
MERGE_GROUP = 128
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
STAGED = PIECES + ", ids binary"
#: Sequence numbers of one task or merge group lie in a range of their own; those of merge groups lie above those of tasks.
STRIDE = 1 << 40
MERGE_BASE = 1 << 60


class Packer:
    """Windows of one task. A piece is [doc_id, start, doc_tokens, ids]."""

    def __init__(self, base: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.open_windows, self.base, self.next_id = window, open_windows, base, base
        self.open: list[tuple[int, list]] = []
        self.out: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.window:
            self._emit([(doc, start, total, ids[: self.window])])
            start, ids = start + self.window, ids[self.window :]
        if not len(ids):
            return
        fits = [(used, -k) for k, (used, _) in enumerate(self.open) if used + len(ids) <= self.window]
        if fits:
            k = -max(fits)[1]
            used, pieces = self.open[k]
            pieces.append((doc, start, total, ids))
            if used + len(ids) == self.window:
                self._emit(pieces)
                del self.open[k]
            else:
                self.open[k] = (used + len(ids), pieces)
            return
        if len(self.open) >= self.open_windows:
            k = max(range(len(self.open)), key=lambda j: self.open[j][0])
            used, pieces = self.open.pop(k)
            room = self.window - used
            self._emit([*pieces, (doc, start, total, ids[:room])])
            start, ids = start + room, ids[room:]
        self.open.append((len(ids), [(doc, start, total, ids)]))

    def flush_binary(self) -> None:
        """Close what is open without padding: whole windows, then one sequence for each binary digit of the rest."""
        run = [p for _, pieces in sorted(self.open, key=lambda x: -x[0]) for p in pieces]
        left = sum(len(p[3]) for p in run)
        self.open = []
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            take, need = [], size
            while need:
                doc, start, total, ids = run.pop(0)
                take.append((doc, start, total, ids[:need]))
                if len(ids) > need:
                    run.insert(0, (doc, start + need, total, ids[need:]))
                need -= len(take[-1][3])
            self._emit(take)
            left -= size

    def rows(self) -> list[tuple]:
        rows, self.out = self.out, []
        return rows

    def leftovers(self) -> list[tuple]:
        return [(doc, start, len(ids), None, total, self.base + k, None, ids.tobytes()) for k, (_, pieces) in enumerate(self.open) for doc, start, total, ids in pieces]


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _FIELDS]
    if len(columns) < len(_FIELDS):
        columns.append([None] * len(rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def _pack_task(tokenizer: str, end_id: int, window: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() * STRIDE, window, open_windows)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for a, b, texts in chunks(batch.column(1)):
                ids, sizes = words.encode(texts, end_id)
                at = 0
                for doc, n in zip(docs[a:b], sizes.tolist(), strict=True):
                    packer.add(doc, 0, n, ids[at : at + n])
                    at += n
                if packer.out:
                    yield _batch(packer.rows())
                for k, (used, pieces) in enumerate(packer.open):  # own copies, not views of the whole chunk
                    packer.open[k] = (used, [(d, s, t, np.array(x)) for d, s, t, x in pieces])
        yield _batch(packer.leftovers())

    return run


def _merge_group(window: int, last: bool, base: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        packer = Packer(base + key[0].as_py() * STRIDE, window, 1)
        rows = table.sort_by([("sequence_id", "ascending"), ("doc_id", "ascending"), ("start", "ascending")]).to_pylist()
        for r in rows:
            packer.add(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], np.uint32))
        if last:
            packer.flush_binary()
        done = packer.rows()
        open_rows = [] if last else packer.leftovers()
        return pa.Table.from_batches([_batch(done), _batch(open_rows)])

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, merge_group: int = MERGE_GROUP) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of ``docs(doc_id, text)``.

    A task holds ``open_windows`` windows at most, a merge group ``merge_group`` leftover windows. Each
    merge round leaves one open window a group, so the rounds are few; only the last group cuts its rest
    into powers of two.
    """
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    staged = written(plain.mapInArrow(_pack_task(tokenizer, end_id, window, open_windows), STAGED), "pack")
    columns = [n for n, _ in _FIELDS]
    done, base = [staged.where("ids is null").select(columns[:-1])], MERGE_BASE
    left = staged.where("ids is not null")
    bins = left.select(F.countDistinct("sequence_id")).first()[0]
    while bins:
        groups = -(-bins // merge_group)
        grouped = left.withColumn("_group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
        merged = grouped.groupBy("_group").applyInArrow(_merge_group(window, groups == 1, base), STAGED)
        if groups > 1:
            merged = written(merged, "pack-merge")
            left = merged.where("ids is not null")
            bins = left.select(F.countDistinct("sequence_id")).first()[0]
        else:
            bins = 0
        base += groups * STRIDE
        done.append(merged.where("ids is null").select(columns[:-1]))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
