"""Simple-8b word-aligned coding of token ids, vectorised with numpy, and the shard file that holds it.

A 64-bit word has a 4-bit selector in its high bits and a payload of up to 60 bits. Selectors 0 to 13 hold
``COUNTS[s]`` ids of ``WIDTHS[s]`` bits each, the first id lowest. Selector 14 holds one id of 60 bits, and
selector 15 is the escape: the next 64-bit word is one id as it is. Ids are coded in blocks of ``BLOCK``
ids; a block begins on a word of its own, so blocks decode side by side.

Shard file, little-endian: ``MAGIC``; int64 numbers of documents, ids, blocks and words; doc_id (int64) and
ids (int64) of each document; the word offset (int64) of each block; the words (uint64).
"""

from __future__ import annotations

import numpy as np

COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 2)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 30)
ONE, ESCAPE = 14, 15
BLOCK = 1024
MAGIC = b"TWS8B\x00\x00\x01"
_CODES = tuple(range(13))  # selector 13 equals 12 and is not written


_SMALL = np.array([v.bit_length() for v in range(1 << 16)], np.uint8)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or int(ids.max()) < len(_SMALL):
        return _SMALL[ids]
    bits, rest = np.zeros(len(ids), np.uint8), ids
    for _ in range(4):
        high = rest >= len(_SMALL)
        bits += np.where(rest > 0, np.where(high, 16, _SMALL[np.where(high, 0, rest)]), 0).astype(np.uint8)
        rest = np.where(high, rest >> np.uint64(16), 0)
    return bits


def _choices(ids: np.ndarray, block: int, blocks: int) -> np.ndarray:
    """The selector that packs most ids from each position on without leaving its block."""
    n, reach = len(ids), max(COUNTS)
    grid = np.full((blocks, block + reach), 255, np.uint8)  # beyond a block nothing fits
    flat = np.full(blocks * block, 255, np.uint8)
    flat[:n] = bit_lengths(ids)
    grid[:, :block] = flat.reshape(blocks, block)
    choice = np.full((blocks, block), ONE, np.int8)
    choice[grid[:, :block] > 60] = ESCAPE
    widest, have = grid, 1  # the greatest width in the next ``have`` ids
    for s in reversed(_CODES):
        while have < COUNTS[s]:
            ahead = min(have, COUNTS[s] - have)
            nxt = widest.copy()
            nxt[:, :-ahead] = np.maximum(widest[:, :-ahead], widest[:, ahead:])
            widest, have = nxt, have + ahead
        choice[widest[:, :block] <= WIDTHS[s]] = s
    return choice.ravel()[:n]


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and the word offset of each block."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // block)
    choice = _choices(ids, block, blocks)
    step = np.array([*COUNTS, 1, 1])[choice]
    at = np.arange(blocks) * block
    stop = np.minimum(at + block, n)
    picks = []
    live = np.arange(blocks)
    while len(live):
        picks.append(at[live])
        at[live] += step[at[live]]
        live = live[at[live] < stop[live]]
    heads = np.sort(np.concatenate(picks))
    sel = choice[heads]
    wide = 1 + (sel == ESCAPE)
    place = np.cumsum(wide) - wide
    words = np.zeros(int(wide.sum()), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    for s in _CODES:
        mine = np.flatnonzero(sel == s)
        for k in range(COUNTS[s]):
            words[place[mine]] |= ids[heads[mine] + k] << np.uint64(k * WIDTHS[s])
    mine = np.flatnonzero(sel == ONE)
    words[place[mine]] |= ids[heads[mine]]
    mine = np.flatnonzero(sel == ESCAPE)
    words[place[mine] + 1] = ids[heads[mine]]
    first = np.searchsorted(heads, np.arange(blocks) * block)
    return words, place[first].astype(np.int64)


def decode(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All ids of the blocks at ``offsets``; every block is walked at once, and only where escapes occur word by word."""
    words = np.ascontiguousarray(words, np.uint64)
    if not len(words):
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():
        stop = np.append(offsets[1:], len(words))
        for b, e in zip(offsets.tolist(), stop.tolist(), strict=True):
            i = b
            while i < e:
                if sel[i] == ESCAPE:
                    raw[i + 1] = True
                    i += 1
                i += 1
    count = np.array([*COUNTS, 1, 0])[sel]
    count[raw] = 1
    sel = np.where(raw, -1, sel)
    place = np.cumsum(count) - count
    ids = np.zeros(int(count.sum()), np.uint64)
    for s in range(14):
        mine = np.flatnonzero(sel == s)
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s]):
            ids[place[mine] + k] = (words[mine] >> np.uint64(k * WIDTHS[s])) & mask
    mine = np.flatnonzero(sel == ONE)
    ids[place[mine]] = words[mine] & np.uint64((1 << 60) - 1)
    mine = np.flatnonzero(raw)
    ids[place[mine]] = words[mine]
    return ids


class ShardWriter:
    """Gathers coded blocks of one shard; the ids themselves are not kept."""

    def __init__(self, block: int = BLOCK):
        self.block, self.docs, self.sizes = block, [], []
        self.parts: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = []
        self.rest = np.zeros(0, np.uint64)
        self.ids = self.words = self.documents = 0

    @property
    def held(self) -> int:
        """Ids taken in so far, coded or not."""
        return self.ids + len(self.rest)

    def add(self, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs)
        self.sizes.append(sizes)
        self.documents += len(docs)
        ids = np.concatenate([self.rest, ids.astype(np.uint64)])
        whole = len(ids) // self.block * self.block
        self._code(ids[:whole])
        self.rest = ids[whole:]

    def _code(self, ids: np.ndarray) -> None:
        words, offsets = encode(ids, self.block)
        self.offsets.append(offsets + self.words)
        self.parts.append(words)
        self.words += len(words)
        self.ids += len(ids)

    def write(self, out) -> None:
        self._code(self.rest)
        self.rest = self.rest[:0]
        docs, sizes = (np.concatenate([np.zeros(0, np.int64), *x]).astype("<i8") for x in (self.docs, self.sizes))
        offsets = np.concatenate([np.zeros(0, np.int64), *self.offsets]).astype("<i8")
        out.write(MAGIC + np.array([len(docs), self.ids, len(offsets), self.words], "<i8").tobytes())
        for x in (docs, sizes, offsets, *(p.astype("<u8") for p in self.parts)):
            out.write(x.tobytes())


def read_shard(f, ids_at_once: int = 1 << 20, block: int = BLOCK):
    """Yield (doc_ids, sizes, ids) of whole documents, about ``ids_at_once`` ids at a time."""
    if f.read(8) != MAGIC:
        raise ValueError("not a token shard")
    n_docs, n_ids, n_blocks, n_words = np.frombuffer(f.read(32), "<i8").tolist()
    docs, sizes, offsets = (np.frombuffer(f.read(8 * n), "<i8") for n in (n_docs, n_docs, n_blocks))
    if int(sizes.sum()) != n_ids:
        raise ValueError("the document index does not match the ids")
    ends = np.append(offsets[1:], n_words)
    doc = done = 0
    held = np.zeros(0, np.uint64)
    step = max(1, ids_at_once // block)
    for b in range(0, max(n_blocks, 1), step):
        own = offsets[b : b + step]
        if len(own):
            last = int(ends[min(b + step, n_blocks) - 1])
            words = np.frombuffer(f.read(8 * (last - int(own[0]))), "<u8")
            held = np.concatenate([held, decode(words, own - own[0])])
        fill = np.cumsum(sizes[doc:])
        k = int(np.searchsorted(fill, len(held), "right"))
        if k:
            take = int(fill[k - 1])
            yield docs[doc : doc + k], sizes[doc : doc + k], held[:take]
            doc, held = doc + k, held[take:]
        done += len(own)
    if doc != n_docs or len(held):
        raise ValueError("truncated token shard")
