"""Parts of a text that are near to a line, with their edit distance: Myers' bit vectors, exact for any number of edits, over the rows of an Arrow batch or, for the latest
window, over all lines of a row in one number."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between the words of a text; counts for nothing.
GAP = "\x1f"
#: Rows of one scan, and cells of its two tables.
ROWS, CELLS = 2048, 1 << 23


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, the row and place of each, and the lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return points, np.repeat(np.arange(len(texts)), sizes), np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def scan(lines: list[str], texts: list[str], most: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, end, edits) of each place where a part of ``texts[row]`` ends, with ``whole`` its beginning, that is at most ``most[row]`` edits from ``lines[row]``, which is not empty.

    All rows go on by one character at a time; a line takes a word of 64 bits for each 64 characters.
    """
    a, row, at, size = _codes(lines)
    known, a = np.unique(a, return_inverse=True)
    words, n, one = int(size.max() - 1) // 64 + 1, len(lines), np.uint64(1)
    same = np.zeros((words, len(known) + 1, n), np.uint64)
    np.bitwise_or.at(same, (at // 64, a + 1, row), one << (at % 64).astype(np.uint64))
    t, row, at, length = _codes(texts)
    code = np.zeros(0x110000, np.int32)
    code[known] = np.arange(1, len(known) + 1)
    steps = np.zeros((int(length.max(initial=0)), n), np.int32)
    steps[at, row] = code[t]
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    ends = [(w, hit) for w in range(words) if (hit := (size - 1) // 64 == w).any()]
    ends, top = dict(ends), ((size - 1) % 64).astype(np.uint64)
    dist, none, cols, found = size.copy(), np.zeros(n, np.uint64), np.arange(n), [np.zeros((3, 0), np.int64)]
    first = none + one if whole else none  # a beginning costs an edit for each character more, a part may begin anywhere
    for j, step in enumerate(steps):
        more, less = first, none
        for w in range(words):
            eq, p, m = same[w, step, cols], up[w], down[w]
            xv = eq | m
            eq = eq | less
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            if w in ends:
                dist += ends[w] * (((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64))
            ph1, mh1 = (ph << one) | more, (mh << one) | less
            more, less = ph >> np.uint64(63), mh >> np.uint64(63)
            up[w], down[w] = mh1 | ~(xv | ph1), ph1 & xv
        hit = np.flatnonzero((dist <= most) & (j < length))
        if len(hit):
            found.append(np.stack([hit, np.full(len(hit), j + 1), dist[hit]]))
    return tuple(np.concatenate(found, axis=1))


def _chunks(size: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers by rising length of the line, in parts whose tables have at most about ``CELLS`` cells."""
    order, lo = np.argsort(size, kind="stable"), 0
    while lo < len(order):
        part = order[lo : lo + ROWS]
        cells = np.maximum(np.maximum.accumulate(length[part]), size[part]) * np.arange(1, len(part) + 1)
        part = part[: max(1, int(np.searchsorted(cells, CELLS, "right")))]
        yield part
        lo += len(part)


def _scanned(lines: list[str], texts: list[str], most: np.ndarray, whole: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """:func:`scan` of any number of rows: row, ends and edits of each row that has some."""
    for part in _chunks(np.array([len(x) for x in lines], np.int64), np.array([len(x) for x in texts], np.int64)):
        row, end, edits = scan([lines[i] for i in part], [texts[i] for i in part], most[part], whole)
        by = np.argsort(row, kind="stable")
        row, end, edits = row[by], end[by], edits[by]
        cuts = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(part[row[lo]]), end[lo:hi], edits[lo:hi]


def near_windows(line: Column, words: Column, own: Column, most: Column) -> Column:
    """Windows of ``words``, joined by ``GAP``, that are at most ``most`` edits from ``line``, as arrays: words before it, words, characters, edits.

    Those that begin in the first ``own`` words. One scan tells the word boundaries where a near part ends; from each of them one scan backwards
    tells the distances of all windows that end there.
    """

    @F.pandas_udf("array<array<int>>")
    def run(line: pd.Series, words: pd.Series, own: pd.Series, most: pd.Series) -> pd.Series:
        lines, most, bounds = list(line), most.to_numpy(np.int64), {}
        for t in set(words):
            bounds[t] = np.cumsum([0, *map(len, t.split(GAP))]), t.replace(GAP, "")
        rows = [bounds[t] for t in words]
        reach = [t[: at[min(o, len(at) - 1)] + len(a) + k] for (at, t), o, a, k in zip(rows, own, lines, most, strict=True)]
        of, stop = [], []
        for r, end, _ in _scanned(lines, reach, most):
            known = np.intersect1d(rows[r][0], end, assume_unique=True)
            of += [r] * len(known)
            stop += known.tolist()
        back = [rows[r][1][max(0, e - len(lines[r]) - most[r]) : e][::-1] for r, e in zip(of, stop, strict=True)]
        out: list[list[list[int]]] = [[] for _ in lines]
        for i, size, edits in _scanned([lines[r][::-1] for r in of], back, most[of], whole=True) if of else ():
            r, e = of[i], stop[i]
            at = rows[r][0]
            begin = np.searchsorted(at, e - size)
            last = np.searchsorted(at, e)
            for b, n, d in zip(begin.tolist(), size.tolist(), edits.tolist(), strict=True):
                if at[b] == e - n and b < own.iat[r]:
                    out[r].append([b, int(last) - b, n, d])
        return pd.Series(out)

    return run(line, words, own, most)


def _bits(lines: list[str]) -> tuple[dict[str, int], int, list[int]]:
    """The places of each character as bits of one number, all places, and the first one of each line; a bit behind each line stays free."""
    sizes = np.array([len(x) for x in lines], np.int64)
    ends = np.cumsum(sizes + 1)
    codes = np.frombuffer(("\0".join(lines) + "\0").encode("utf-32-le"), np.uint32).copy()
    codes[ends - 1] = 0x110000
    of = {c: int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}
    full = ((1 << int(ends[-1])) - 1) ^ of.pop(0x110000)
    return {chr(c): x for c, x in of.items()}, full, (ends - 1 - sizes).tolist()


def _read(chars: Iterable[str], same: dict[str, int], full: int, fill: int, up: int, down: int) -> tuple[int, int]:
    """Bits of the rows at which the distance goes up and down, behind ``chars``. ``fill`` is ``full``, or has the bit before a line too: then each character costs an edit before its beginning."""
    get = same.get
    for c in chars:
        x = get(c, 0) | down
        keeps = (((up + (x & up)) ^ up) | x) & full  # a carry ends in the free bit
        x = (down | (fill ^ (up | keeps))) << 1
        up, down = (((up & keeps) << 1) | ~(x | keeps)) & full, x & keeps
    return up, down


def _latest(lines: list[str], sizes: list[int], words: list[str], low: int, own: int, have: int, ratio: float) -> list[list[int]]:
    """:func:`latest_windows` of one row.

    Lines and text are read from their ends. Where a window begins, the edits of the line against the nearest part that begins there are known for
    all lines; only a window where they are few enough is compared itself, and a line whose window is found is read no further.
    """
    text, at = " ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
    stop = lambda s, i: max(at[min(s + sizes[i], len(words))] - 1, at[s])
    asked = []
    for i, size in enumerate(sizes):
        last, by = max(have - size, 0), size // 2
        top = last - max(0, -(-(last - low - own + 1) // by)) * by
        asked += [(s - low, i) for s in range(top, low - 1, -by)]
    asked.sort(reverse=True)
    here, out, open_ = max((stop(s, i) for s, i in asked), default=0), [], dict.fromkeys(range(len(lines)))
    same, full, first = _bits([x[::-1] for x in lines])
    first, used, gone, up, down = dict(enumerate(first)), full.bit_length(), 0, full, 0
    field = lambda x, i: (x >> first[i]) & ((1 << len(lines[i])) - 1)
    for s, of in groupby(asked, lambda x: x[0]):
        up, down = _read(reversed(text[at[s] : here]), same, full, full, up, down)
        here = at[s]
        for _, i in of:
            if i not in open_:
                continue
            end = stop(s, i)
            most = int(max(len(lines[i]), end - here) * ratio)
            if abs(len(lines[i]) - end + here) > most or field(up, i).bit_count() - field(down, i).bit_count() > most:
                continue
            all_ = field(full, i) << 1
            u, d = _read(reversed(text[here:end]), {c: field(x, i) << 1 for c, x in same.items()}, all_, all_ | 1, all_, 0)
            edits = end - here + u.bit_count() - d.bit_count()
            if edits <= most:
                out.append([i, low + s, edits])
                del open_[i]
                gone += len(lines[i]) + 1
        if not open_:
            break
        if 4 * gone > used:  # lines that are found take no more time
            rest = list(open_)
            same, full, at_ = _bits([lines[i][::-1] for i in rest])
            up, down = (sum(field(x, i) << a for i, a in zip(rest, at_, strict=True)) for x in (up, down))
            first, used, gone = dict(zip(rest, at_, strict=True)), full.bit_length(), 0
    return out


def latest_windows(lines: Column, sizes: Column, words: Column, low: Column, own: int, have: Column, ratio: float) -> Column:
    """For each of ``lines`` the latest window of ``words``, joined by ``GAP``, that is near enough, as arrays: line, start, edits.

    Windows of a line have as many words as ``sizes`` tells, 2 at least, and lie half of that apart, the last one at the end of the ``have`` words of the whole text, of which
    ``words`` begin at ``low``. Those count that begin in the first ``own`` words. Near are at most ``ratio`` edits for each character of the longer text, words being a space apart.
    """

    @F.pandas_udf("array<array<int>>")
    def run(lines: pd.Series, sizes: pd.Series, words: pd.Series, low: pd.Series, have: pd.Series) -> pd.Series:
        return pd.Series([_latest(list(a), [int(x) for x in z], t.split(GAP), int(b), own, int(h), ratio) for a, z, t, b, h in zip(lines, sizes, words, low, have, strict=True)])

    return run(lines, sizes, words, low, have)
