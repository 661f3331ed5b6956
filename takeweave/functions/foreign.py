"""Foreign parts of texts (F12), on the bytes of whole Arrow columns: nothing is made for each bracket or text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 4 << 20
_OPEN, _CLOSE = 1, 2


def _without(data: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts, as bytes and the offsets between them, without the spans ``lo`` to ``hi``, which are sorted, apart, and inside one text each."""
    bounds = np.concatenate([[0], np.column_stack([lo, hi]).ravel(), [len(data)]])
    kept = np.repeat(np.arange(len(bounds) - 1) % 2 == 0, np.diff(bounds))
    gone = np.concatenate([[0], np.cumsum(hi - lo)])
    return data[kept], ends - gone[np.searchsorted(hi, ends, "right")]


def _innermost(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of bracketed parts without brackets inside whose solid characters are ASCII to 70 % or more."""
    kind = np.zeros(len(data), np.uint8)
    kind[data == 0x28], kind[data == 0x29] = _OPEN, _CLOSE
    wide = np.flatnonzero(data[:-2] == 0xEF)
    wide = wide[data[wide + 1] == 0xBC]
    kind[wide[data[wide + 2] == 0x88]], kind[wide[data[wide + 2] == 0x89]] = _OPEN, _CLOSE
    at = np.flatnonzero(kind)
    row = np.searchsorted(ends, at, "right")
    pair = np.flatnonzero((kind[at[:-1]] == _OPEN) & (kind[at[1:]] == _CLOSE) & (row[:-1] == row[1:]))
    lo, hi = at[pair], at[pair + 1]
    hi = hi + np.where(data[hi] == 0xEF, 3, 1)
    if not len(lo):
        return lo, hi
    count = lambda flags: (lambda n: n[hi] - n[lo])(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)]))
    plain = count((data > 0x20) & (data < 0x7F))
    solid = count(((data & 0xC0) != 0x80) & (data != 0x20) & (data != 0x0A) & (data != 0x09))  # characters by their first bytes
    drop = 10 * plain >= 7 * solid
    return lo[drop], hi[drop]


def _without_tails(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = np.flatnonzero((data < 0x20) | (data > 0x7E))
    i = np.searchsorted(other, ends[1:], "left") - 1
    row = np.flatnonzero(i >= 0)
    last = other[i[row]]  # the last byte of the last character that is not plain ASCII
    own = last - 2 >= ends[:-1][row]
    row, last = row[own], last[own]
    first = data[last - 2].astype(np.int32)
    code = ((first & 0x0F) << 12) | ((data[last - 1].astype(np.int32) & 0x3F) << 6) | (data[last] & 0x3F)
    cjk = ((code >= 0x3400) & (code <= 0x9FFF)) | ((code >= 0xF900) & (code <= 0xFAFF)) | np.isin(code, [ord(c) for c in "，。！？：；（）"])
    cjk &= (first & 0xF0) == 0xE0
    lo, hi = last[cjk] + 1, ends[1:][row[cjk]]
    solid = np.array([bool(data[a:b].tobytes().strip(b" ")) for a, b in zip(lo, hi, strict=True)], bool)
    return _without(data, ends, lo[solid], hi[solid])


def _on_bytes(work: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable[[Column], Column]:
    """A column function of ``work`` on the bytes of many texts and the offsets between them; nulls stay."""

    @F.arrow_udf("string")
    def column(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_binary())
        if not len(raw):
            return texts
        ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 8 * raw.offset)
        whole = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        done, sizes, i = [], [], 0
        while i < len(raw):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, "right")) - 1)
            data, new = work(whole[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            done.append(data)
            sizes.append(np.diff(new))
            i = j
        new = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        out = pa.Array.from_buffers(pa.large_string(), len(raw), [None, pa.py_buffer(new), pa.py_buffer(np.concatenate(done))])
        return pc.if_else(texts.is_valid(), out, pa.scalar(None, pa.large_string())).cast(texts.type)

    return column


def drop_foreign(c: Column, depth: int = 2, tail: bool = False) -> Column:
    """Bracketed parts whose solid characters are ASCII to 70 % or more go, innermost first, ``depth`` levels; then, with ``tail``, an ASCII tail after the last CJK character or mark."""

    def work(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(depth):
            data, ends = _without(data, ends, *_innermost(data, ends))
        return _without_tails(data, ends) if tail else (data, ends)

    return _on_bytes(work)(c)


def drop_ascii_tail(c: Column) -> Column:
    """An ASCII tail after the last CJK character or mark goes."""
    return drop_foreign(c, 0, tail=True)
