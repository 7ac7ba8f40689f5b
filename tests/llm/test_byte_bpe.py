import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from verdara.llm import byte_bpe
from verdara.llm.vocab import BYTE_RANKS, ByteCounter, file_bytes


@pytest.fixture(scope="module")
def pair():
    bpe = byte_bpe.TreeBpe(file_bytes(None, BYTE_RANKS))
    return bpe, tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks,
                                  special_tokens={})


def texts():
    r = random.Random(1)
    yield from ["", " ", "\n\n  x", "a" * 4000, "日本語テキスト", "it's  we'll\t\r\n ok", "<|endoftext|>",
                "\0 a \0", "é" * 90, "x  y", "a  b", "\x1c\x1d a"]
    for alphabet in (" ab\n'sé1.,\t", "abcdefgh", "theandoingr ", "日本 a "):
        for _ in range(400):
            yield "".join(r.choice(alphabet) for _ in range(r.randint(1, 90)))


def test_ids_match_tiktoken_and_decode_back(pair):
    bpe, enc = pair
    every = list(texts())
    for t, ids in zip(every, bpe.encode(every)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), repr(t)
        assert bpe.decode(ids) == t.encode()


def test_both_trees_agree(pair):
    bpe, _ = pair
    r = random.Random(2)
    pieces = ["".join(r.choice("abcdeth ") for _ in range(r.randint(2, 60))).encode() for _ in range(500)]
    assert bpe._side_by_side(pieces) == [bpe._alone(p) for p in pieces]


def test_token_counts_are_exact(pair):
    counter = ByteCounter(file_bytes(None, BYTE_RANKS))
    for t in texts():
        assert counter.count(t) == len(pair[1].encode_ordinary(t)), repr(t)


def test_edge_cases(edge_docs, no_docs, pair):
    rows = byte_bpe.encode_documents(edge_docs, ids="ids").collect()
    assert len(rows) == 13
    for r in rows:
        want = pair[1].encode_ordinary(r["text"] or "")
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(no_docs).collect() == []
