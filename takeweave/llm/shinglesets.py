"""Word-shingle sets and MinHash signatures of whole texts, vectorised over the bytes of an Arrow batch.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. A text's set holds the hash of each run of five words,
or, with one to four words, the hash of the whole sequence. Hashes are 64 bits wide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
COORDINATES = 48
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ShingleSets:
    def __init__(self, k: int = SHINGLE, coordinates: int = COORDINATES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k = k
        self.mult = rng.integers(1, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, coordinates, dtype=np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                run = np.full(n, base, np.uint64)
                run[0] = 1
                setattr(self, name, np.multiply.accumulate(run))

    def _sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, document after document and ascending in each, and how many each document has."""
        docs, n = len(offsets) - 1, len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
        self._powers(n + 1)
        space = _SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[True], space[:-1]]) | edge[:-1]
        after = np.concatenate([space[1:], [True]]) | edge[1:]
        begin, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[data] * self.power[:n], dtype=np.uint64)])
        word = mix((sums[end] - sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        doc = np.searchsorted(offsets, begin, "right") - 1
        words = np.bincount(doc, minlength=docs)
        first = np.cumsum(words) - words
        h = [np.zeros(0, np.uint64)]
        of = [np.zeros(0, np.int64)]
        if len(word) >= self.k:
            m = len(word) - self.k + 1
            run = np.full(m, self.k, np.uint64)
            for d in range(self.k):
                run = run * np.uint64(0xC2B2AE3D27D4EB4F) + word[d : d + m]
            same = doc[:m] == doc[self.k - 1 :]
            h.append(mix(run[same]))
            of.append(doc[:m][same])
        for size in range(1, self.k):
            short = np.flatnonzero(words == size)
            run = np.full(len(short), size, np.uint64)
            for d in range(size):
                run = run * np.uint64(0xC2B2AE3D27D4EB4F) + word[first[short] + d]
            h.append(mix(run))
            of.append(short)
        h, of = np.concatenate(h), np.concatenate(of)
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        return h[new], np.bincount(of[new], minlength=docs)

    def of_column(self, column: pa.Array):
        """Yield (from, to, hashes, sizes) over runs of the rows of a string column; a null has no words."""
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        bufs = column.buffers()
        offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _BYTES, "right")) - 1)
            to = min(to, len(column))
            own = offsets[at : to + 1] - offsets[at]
            yield (at, to, *self._sets(data[offsets[at] : offsets[to]], own))
            at = to

    def signatures(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One row of coordinates (int32, never negative) for each document; documents without shingles have -1."""
        out = np.full((len(sizes), len(self.mult)), -1, np.int32)
        full = np.flatnonzero(sizes)
        if len(full):
            begin = (np.cumsum(sizes) - sizes)[full]
            for c, (a, b) in enumerate(zip(self.mult, self.add, strict=True)):
                out[full, c] = np.minimum.reduceat((hashes * a + b) >> np.uint64(33), begin).astype(np.int32)
        return out

    @staticmethod
    def digests(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums that name a set."""
        a, b = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
        full = np.flatnonzero(sizes)
        if len(full):
            begin = (np.cumsum(sizes) - sizes)[full]
            a[full] = np.add.reduceat(mix(hashes + np.uint64(0x1234567)), begin)
            b[full] = np.add.reduceat(mix(hashes ^ np.uint64(0x5DEECE66D)), begin)
        return a.view(np.int64), b.view(np.int64)
