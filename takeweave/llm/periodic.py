"""Periodic runs of words by recursive frequency splitting and lag scans.

A run is a stretch of consecutive words with smallest period q and at least ``max(LEAST, COPIES * q)`` words that no neighbouring
word extends with that period. Each word of a run occurs at least ``COPIES`` times in it. So

1. every word that occurs less often in its segment (at first the whole text) splits the segment there; what is left is counted
   again, until no segment changes. Segments too short for a run go. All segments of an Arrow batch are counted together.
2. each surviving segment is scanned at every lag q up to a ``COPIES``-th of its length. A run of period q holds ``COPIES``
   neighbouring multiples of q, so only places where every q-th word repeats that often in a row are extended word by word: the
   scan of n words costs about n * ln(n) comparisons. What lies inside a run whose period divides q is no run of its own.

The work is one pass over the documents without a shuffle; a text is read whole, and the memory of a task is that of a batch of rows.

Rows: null and empty texts have no words and no runs, their collapsed text is empty. A null doc_id has no number, so its text is
never rewritten. Repeated rows and doc_ids give a row each; ties between runs of equal length / period go to the smallest start, then
the smallest period. Only doc_id and text are read, whatever other columns there are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 6
COPIES = 4
#: Rounds of splitting; a segment that still changes then is scanned as it is, which costs time but finds the same runs.
ROUNDS = 64
#: Words whose segments are split together.
_TOGETHER = 400_000

Run = tuple[int, int, int]  # start, length, period


def split_segments(words: np.ndarray, segment: np.ndarray, least: int = LEAST, copies: int = COPIES) -> list[np.ndarray]:
    """Places (ascending, without gaps) of each segment of ``words`` that survives; ``segment`` numbers the texts in ascending order."""
    place, stable = np.arange(len(words)), []
    for _ in range(ROUNDS):
        if not len(place):
            break
        order = np.lexsort((words[place], segment))
        w, s = words[place][order], segment[order]
        first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (s[1:] != s[:-1])]))
        count = np.diff(np.append(first, len(w)))
        often = np.empty(len(w), bool)
        often[order] = np.repeat(count >= copies, count)
        changed = np.bincount(segment, ~often, segment[-1] + 1) > 0
        settled = ~changed[segment]
        stable += _pieces(place[settled], segment[settled], least)
        left = often & ~settled
        pieces = _pieces(place[left], segment[left], least)
        place = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        segment = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    else:
        stable += _pieces(place, segment, least)
    return stable


def _pieces(place: np.ndarray, segment: np.ndarray, least: int) -> list[np.ndarray]:
    """``place`` cut where a place is missing or the segment changes; pieces of fewer than ``least`` places go."""
    if not len(place):
        return []
    cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(segment) != 0)) + 1
    begin, end = np.append(0, cut), np.append(cut, len(place))
    long = end - begin >= least
    return [place[a:b] for a, b in zip(begin[long], end[long], strict=True)]


def _reach(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many places on from ``at`` (itself included, in direction ``step``) each word equals the one ``lag`` later."""
    room = at + 1 if step < 0 else len(words) - lag - at
    got, size = 0, 16
    while got < room:
        n = min(size, room - got)
        a = at - got - n + 1 if step < 0 else at + got
        differs = np.flatnonzero(words[a : a + n] != words[a + lag : a + lag + n])
        if len(differs):
            return got + int(n - 1 - differs[-1] if step < 0 else differs[0])
        got, size = got + n, size * 4
    return got


def lag_scan(words: np.ndarray, least: int = LEAST, copies: int = COPIES) -> list[Run]:
    """All runs of one segment, by period and start."""
    found: list[Run] = []
    wide: list[Run] = []
    n = len(words)
    for q in range(1, n // copies + 1):
        every = words[::q]
        same = every[1:] == every[:-1]
        hit = same[: len(same) - copies + 2].copy()
        for d in range(1, copies - 1):
            hit &= same[d : d + len(hit)]
        at = np.flatnonzero(hit) * q
        if len(at):
            wide = [r for r in wide if r[1] > (copies - 1) * q]
            for s, length, p in wide:
                if q % p == 0:
                    at = at[(at < s) | (at + (copies - 1) * q >= s + length)]
        seen = 0
        for x in at.tolist():
            if x < seen:
                continue
            begin = x - _reach(words, x, q, -1) + 1
            length = x + _reach(words, x, q, 1) + q - begin
            seen = begin + length - q
            if length >= max(least, copies * q) and not _shorter(words[begin : begin + length], q):
                found.append((begin, length, q))
                wide.append(found[-1])
    return found


def _shorter(run: np.ndarray, q: int) -> bool:
    """Whether a stretch of period ``q`` has a smaller one; in at least two copies that one divides ``q``."""
    return any(q % d == 0 and (run[d:] == run[:-d]).all() for d in range(1, q // 2 + 1))


def rewritten(n: int, doc_id: int | None) -> np.ndarray | None:
    """Places of the words of the text that takes the place of a text of ``n`` words; None where it stays (nine of ten ids)."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    tail = np.arange(a, n)
    return np.concatenate([np.arange(a), a + (tail - a) % period])


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST, copies: int = COPIES) -> list[list[Run]]:
    """The runs of each text, by start and period."""
    numbers: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, sum(sizes))
    text = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum([0, *sizes])
    found: list[list[Run]] = [[] for _ in texts]
    for piece in split_segments(words, text, least, copies):
        t = int(text[piece[0]])
        start = int(piece[0] - first[t])
        found[t] += [(start + s, length, q) for s, length, q in lag_scan(words[piece], least, copies)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def _row(words: list[bytes], runs: list[Run]) -> tuple:
    kept = np.ones(len(words), bool)
    for s, length, q in runs:
        kept[s + q : s + length] = False
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    collapsed = b" ".join([w for w, k in zip(words, kept, strict=True) if k] if runs else words)
    return (len(runs), *top, hashlib.sha256(listed).hexdigest(), collapsed)


_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _task(as_text: bool, rewrite: bool, least: int, copies: int) -> Callable:
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        out = []
        for doc_id, words, runs in zip(ids, texts, runs_of_texts(texts, least, copies), strict=True):
            *head, collapsed = _row(words, runs)
            out.append((doc_id, *head, collapsed.decode() if as_text else hashlib.sha256(collapsed).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f"c{i}" for i in range(8)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            texts: list[list[bytes]] = []
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                words = (text.as_py() or b"").split()  # bytes split at the six ASCII spaces only
                moved = rewritten(len(words), doc_id.as_py()) if rewrite else None
                texts.append(words if moved is None else [words[i] for i in moved])
                ids.append(doc_id.as_py())
                held += len(words)
                if held >= _TOGETHER:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield rows(ids, texts)

    return run


def _apply(docs: DataFrame, as_text: bool, rewrite: bool, least: int, copies: int, schema: str) -> DataFrame:
    if copies < 3 or least < 1:
        raise ValueError("runs need three copies at least")
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return plain.mapInArrow(_task(as_text, rewrite, least, copies), schema).toDF(*[c.split()[0] for c in schema.split(", ")])


def periodic_runs(docs: DataFrame, rewrite: bool = True, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: n_runs, start, length, period and exponent_milli of the run with the greatest
    length / period (null without runs), SHA-256 of all runs and of the words left without repetitions.

    ``rewrite`` first makes the text of one document in ten end in a period of its own, by the rule of :func:`rewritten`.
    """
    return _apply(docs, False, rewrite, least, copies, _OUT)


def collapsed(docs: DataFrame, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, text): each text with one period of every run, words joined by a space."""
    return _apply(docs, True, False, least, copies, _OUT.replace("collapsed_sha256", "text"))
