import hashlib
import random
import time
from collections import Counter

import pandas as pd
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from verdara.llm import token_align as T
from verdara.llm.vocab import PIECES, byte_ids, file_bytes

FILES = (file_bytes(None, T.BYTE_JSON), file_bytes(None, PIECES))


@pytest.fixture(scope="module")
def pair():
    return T.Pair(FILES)


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_str(FILES[0].decode())
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_proto=FILES[1])


def brute(text, libraries, pair):
    """(A ids, B ids, groups, links, overlaps) by looking at all pairs of tokens."""
    if not text:
        return [], [], [], [], 0
    a = libraries[0].encode(" " + text, add_special_tokens=False).ids
    b = libraries[1].encode(text)
    want = (" " + text).encode()
    if any(b"".join(spelled[i] for i in ids) != want
           for ids, spelled in ((a, pair.a_bytes), (b, pair.b_bytes))):
        return [], [], [], [], 0

    def ranges(ids, spelled):
        at = 0
        for i in ids:
            yield at, at + len(spelled[i]), i
            at += len(spelled[i])

    ra, rb = list(ranges(a, pair.a_bytes)), list(ranges(b, pair.b_bytes))
    links = [(x[2], y[2]) for x in ra for y in rb if x[1] == y[1]]
    n_overlaps = sum(x[0] < y[1] and y[0] < x[1] for x in ra for y in rb)
    cuts = sorted({x[1] for x in ra} & {y[1] for y in rb})
    groups = [([x[2] for x in ra if low < x[1] <= high], [y[2] for y in rb if low < y[1] <= high])
              for low, high in zip([0, *cuts], cuts)]
    return a, b, groups, links, n_overlaps


def expected(texts, libraries, pair):
    found = [brute(t, libraries, pair) for t in texts]
    count = Counter(x for f in found for x in f[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for a, b, groups, links, n_overlaps in found:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), len(links), n_overlaps,
                    hashlib.sha256(text.encode()).hexdigest() if a else "",
                    sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links)))
    return out


def odd_texts():
    r = random.Random(8)
    yield from [None, "", " ", "a", "  two", "a▁b", "▁", "<|endoftext|> x", "<s>", "x\n\ny", "日本語 text",
                "\0", "é it's 1234567", "same words same words", "same words same words", "tail  "]
    for alphabet in (" abc", "theraindo ", "日本é a", " .,'\n1"):
        for _ in range(40):
            yield "".join(r.choice(alphabet) for _ in range(r.randint(1, 60)))


def test_all_columns_match_brute_force(spark, libraries, pair):
    texts = list(odd_texts())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    aligned = T.align(docs).cache()
    counts = T.count_links(aligned, T.vocabulary_size()).toPandas()
    rows = T.judge(aligned, counts).orderBy("doc_id").collect()
    got = [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256",
                                "n_best", "count_sum")) for r in rows]
    assert got == expected(texts, libraries, pair)
    assert sum(g[0] > 0 for g in got) > 150 and any(g[2] < min(g[0], g[1]) for g in got)


def test_overlaps_of_two_documents():
    a = pd.DataFrame({"doc": [0, 0, 1], "start": [0, 3, 5], "at": [0, 1, 2]})
    b = pd.DataFrame({"doc": [0, 0, 1, 1], "start": [0, 2, 5, 6], "at": [0, 1, 2, 3]})
    assert sorted(T.overlaps(a, b).to_numpy().tolist()) == [[0, 0], [0, 1], [1, 1], [2, 2], [2, 3]]
    assert len(T.overlaps(a[:0], b)) == 0


def test_linked_pairs_are_bounded_by_the_vocabularies(pair):
    assert T.possible_pairs(pair.a_bytes, pair.b_bytes) == 324_300
    assert T.possible_pairs([b"ab", b"b"], [b"b", b"cab"]) == 4  # ab+b, ab+cab, b+b, b+cab


def test_small_groups_change_nothing(pair):
    texts = [t or "" for t in odd_texts()]
    whole = pair.align(texts)
    single = pd.concat([pair.align([t]) for t in texts], ignore_index=True)
    assert whole.drop(columns="links").equals(single.drop(columns="links"))
    assert [x.tolist() for x in whole["links"]] == [x.tolist() for x in single["links"]]


def test_very_long_texts(pair):
    for t in (" " * 300_000, "\n" * 30_000 + "x", "a" * 300_000, "ab c" * 50_000, " \n" * 50_000, "日" * 50_000):
        row = pair.align([t]).iloc[0]
        assert row["n_a"] and row["n_b"] and row["n_groups"]


def test_ids_of_long_white_space_are_the_library_s(pair, libraries):
    for t in (" " * 3000, " x" + "\n \t" * 900 + "y's  z"):
        assert byte_ids(pair.first, t) == libraries[0].encode(t, add_special_tokens=False).ids


def test_edge_cases(edge_docs, no_docs, libraries, pair):
    docs = edge_docs.drop("n_words")
    aligned = T.align(docs)
    rows = T.judge(aligned, T.count_links(aligned, T.vocabulary_size()).toPandas()).collect()
    assert len(rows) == 13 and set(docs.columns) - {"links"} < set(rows[0].asDict())
    for r in rows:
        if r["text"] is None or len(r["text"]) < 2000:
            a, b, groups, links, n_overlaps = brute(r["text"], libraries, pair)
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_overlaps"]) == (len(a), len(b), len(groups), n_overlaps)
    none = T.align(no_docs)
    assert T.judge(none, T.count_links(none, T.vocabulary_size()).toPandas()).collect() == []


def test_alignment_costs_less_than_the_encoding(pair):
    r = random.Random(3)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(5000)]
    texts = [" ".join(r.choices(words, k=200)) for _ in range(150)]

    def cost(fn):
        took = []
        for _ in range(5):
            begun = time.process_time()
            fn(texts)
            took.append(time.process_time() - begun)
        return min(took)

    assert cost(pair.align) < 2.1 * cost(pair.encode)
