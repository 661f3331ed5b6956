"""Vectorised use of a public tokenizer inside Spark tasks.

Texts repeat their words, so each distinct word is encoded once with the tokenizers library. A run of texts is split and
dictionary-encoded by Arrow; Python and the library see only forms that no text of the worker has shown before, and the ids of
whole texts are gathered from the table with numpy. White space never takes part in a token of these vocabularies (it separates
pre-tokens and is dropped), so the ids equal those of the whole text; ``tests/llm/test_tokens.py`` holds this against
``Tokenizer.encode``.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MAX_WORDS = 800_000
CHUNK_BYTES = 8 << 20
_WORDS_AT_ONCE = 500
#: Punctuation around a word: the library makes one piece of such a run, as it is neither letter nor digit. The apostrophe (it begins
#: endings like 's) is left to the library.
_MARKS = r"!-&(-/:-@\[-`{-~"
#: Letters whose lower case is one letter by the same rule in every library (so without the dotted capital I).
_LETTERS = r"a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17E}"
_FORM = f"^(?P<lead>[{_MARKS}]*)(?P<core>[{_LETTERS}]+)(?P<trail>[{_MARKS}]*)$"
_SPECIAL = "<|"  # special tokens of the vocabularies begin with it


def _strings(values) -> pa.Array:
    column = values if isinstance(values, pa.Array) else pa.array(values, pa.large_string())
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


class _Table:
    """Strings with the place and length of the ids of each."""

    def __init__(self):
        self.keys = _strings([])
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: pa.Array) -> np.ndarray:
        """Entries of ``keys``, -1 where there is none."""
        return pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, keys: pa.Array, start: np.ndarray, count: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        self.start, self.count = np.concatenate([self.start, start]), np.concatenate([self.count, count])


class WordEncoder:
    """Encode runs of texts; memory is bounded by ``max_words`` table entries, after which the table starts anew."""

    def __init__(self, tokenizer: str = TOKENIZER, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        path = tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)
        self.lib = Tokenizer.from_file(path)
        # For words that are lower-case letters already: the same model without the steps that would leave them as they are.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for k, i in vocab.items() if k.endswith("</w>")]] = True
        self.max_words = max_words
        self._clear()

    def _clear(self) -> None:
        self.forms, self.cores, self.marks = _Table(), _Table(), _Table()
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _store(self, ids: np.ndarray) -> int:
        at, end = self.used, self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), end), np.uint32)])
        self.flat[at:end] = ids
        self.used = end
        return at

    def _gathered(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        before = np.cumsum(count) - count
        return self.flat[np.repeat(start - before, count) + np.arange(int(count.sum()))]

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        at = self._store(np.array([i for ids in found for i in ids], np.uint32))
        return at + np.cumsum(count) - count, count

    def _whole_words(self, words: list[str], lib) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters, many in one call: each is one piece, which ends in an end-of-word token."""
        starts, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), _WORDS_AT_ONCE):
            part = words[k : k + _WORDS_AT_ONCE]
            ids = np.array(lib.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                begins = np.concatenate([[0], stops[:-1]])
                start, count = self._store(ids) + begins, stops - begins
            else:
                start, count = self._one_by_one(part)
            starts.append(start)
            counts.append(count)
        return np.concatenate(starts), np.concatenate(counts)

    def _entries(self, table: _Table, keys: pa.Array, encode) -> np.ndarray:
        """Entries of ``keys`` in ``table``, which takes up those it does not have."""
        coded = keys.dictionary_encode()
        local = table.find(coded.dictionary)
        new = local < 0
        if new.any():
            fresh = coded.dictionary.filter(pa.array(new))
            local[new] = len(table) + np.arange(len(fresh))
            table.add(fresh, *encode(fresh.to_pylist()))
        return local[coded.indices.to_numpy()]

    def _learn(self, forms: pa.Array) -> None:
        """Add forms that the table does not have."""
        cut = pc.extract_regex(forms, _FORM)
        known = pc.and_not(pc.is_valid(cut), pc.match_substring(forms, _SPECIAL))
        usual = known.to_numpy(zero_copy_only=False)
        start, count = np.zeros(len(forms), np.int64), np.zeros(len(forms), np.int64)
        if usual.any():
            lead, core, trail = (x.cast(pa.large_string()) for x in cut.filter(known).flatten())
            at = self._entries(self.cores, pc.utf8_lower(core), lambda words: self._whole_words(words, self.bare))
            begins, sizes = self.cores.start[at], self.cores.count[at]
            marked = np.flatnonzero((pc.binary_length(lead).to_numpy() + pc.binary_length(trail).to_numpy()) > 0)
            if len(marked):
                a, b = (self._entries(self.marks, x.take(pa.array(marked)), self._one_by_one) for x in (lead, trail))
                s = np.stack([self.marks.start[a], begins[marked], self.marks.start[b]], 1)
                n = np.stack([self.marks.count[a], sizes[marked], self.marks.count[b]], 1)
                total = n.sum(1)
                begins[marked] = self._store(self._gathered(s.ravel(), n.ravel())) + np.cumsum(total) - total
                sizes[marked] = total
            start[usual], count[usual] = begins, sizes
        if not usual.all():
            rest = forms.filter(pc.invert(known)).to_pylist()
            # Capital sigma: Python lowers it by context, the library does not.
            letters = np.array(["Σ" not in w and w.isalpha() and w.lower().isalpha() for w in rest])
            for some, encode in ((letters, lambda words: self._whole_words([w.lower() for w in words], self.lib)), (~letters, self._one_by_one)):
                if some.any():
                    own = np.flatnonzero(~usual)[some]
                    start[own], count[own] = encode([w for w, yes in zip(rest, some, strict=True) if yes])
        self.forms.add(forms, start, count)

    def words(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Table entries of all words of a string column, text after text, and the number of words of each text."""
        split = pc.ascii_split_whitespace(_strings(texts))
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        if len(self.forms) > self.max_words:
            self._clear()
        local = self.forms.find(coded.dictionary)
        new = local < 0
        if new.any():
            local[new] = len(self.forms) + np.arange(int(new.sum()))
            self._learn(coded.dictionary.filter(pa.array(new)))
        return local[coded.indices.to_numpy()], sizes

    @staticmethod
    def _per_text(n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        return total[ends] - total[ends - sizes]

    def lengths(self, texts) -> np.ndarray:
        """Number of ids of each text."""
        entry, sizes = self.words(texts)
        return self._per_text(self.forms.count[entry], sizes)

    def encode(self, texts, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, each with ``end_id`` after it, and the number of ids of each text."""
        entry, sizes = self.words(texts)
        n = self.forms.count[entry]
        per_text = self._per_text(n, sizes)
        ids = self._gathered(self.forms.start[entry], n)
        if end_id is None:
            return ids, per_text
        return np.insert(ids, np.cumsum(per_text), end_id), per_text + 1


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer: str = TOKENIZER) -> WordEncoder:
    """The encoder of this Python worker: later tasks of the worker use the words that earlier ones have encoded."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = WordEncoder(tokenizer)
    return _encoders[tokenizer]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(from, to, texts) of runs of a string column with about ``limit`` bytes; a longer text stands alone. Nulls are empty texts."""
    texts = _strings(column)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        to = max(at + 1, to)
        yield at, to, texts.slice(at, to - at)
        at = to
