import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from takeweave.llm import simple8b
from takeweave.llm.tokens import WordEncoder

LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ENC = WordEncoder()
ODD = ["", " ", "Thing, the end. it's don't 12a", "É́a é ﬁ İstanbul ΣΑΣ ß", "<|endoftext|> a<|startoftext|>b", "a b\x0bc\x1cd e", "x" * 3000, "他说 123 ... ,, a.,b !?"]


def plain(t):
    return LIB.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [3, 10**6])
def test_ids_equal_whole_text(limit):
    enc = WordEncoder(max_words=limit)
    for t in ODD * 2:
        ids, sizes = enc.encode([t, t + " z"])
        assert ids[: sizes[0]].tolist() == [*plain(t), 1]
        assert sizes.sum() == len(ids)
        assert enc.lengths([t])[0] == len(plain(t))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_whole_text_random(t):
    assert ENC.encode([t], None)[0].tolist() == plain(t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 50000), st.integers(0, 2**64 - 1)), max_size=300), st.sampled_from([1, 7, 64, 1024]))
def test_simple8b_round_trip(ids, block):
    a = np.array(ids, np.uint64)
    words, offsets = simple8b.encode(a, block)
    assert (simple8b.decode(words, offsets) == a).all()
    for k in range(len(offsets)):  # each block alone
        end = offsets[k + 1] if k + 1 < len(offsets) else len(words)
        assert (simple8b.decode(words[offsets[k] : end], np.array([0])) == a[k * block : (k + 1) * block]).all()


def test_shard_round_trip():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 5, 3000, 1, 0, 999, 20000, 0])
    ids = rng.integers(0, 49408, sizes.sum()).astype(np.uint32)
    w = simple8b.ShardWriter(64)
    w.add(np.arange(3), sizes[:3], ids[:3005])
    w.add(np.arange(3, 8), sizes[3:], ids[3005:])
    f = io.BytesIO()
    w.write(f)
    f.seek(0)
    got = list(simple8b.read_shard(f, 500, 64))
    assert np.concatenate([g[0] for g in got]).tolist() == list(range(8))
    assert (np.concatenate([g[2] for g in got]) == ids).all()
    assert [n for g in got for n in g[1].tolist()] == sizes.tolist()
    assert zlib.crc32(b"") == 0
