import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from verdara.llm import simhash as S
from verdara.llm.components import components


def brute_print(text, width=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(edge_rows):
    for t in [t for _, t, _ in edge_rows] + ["A b", "a B c", "a b c d", "É é E"]:
        assert S.text_print(t) % 2 ** 64 == brute_print(t)


def test_gray_rank():
    codes = np.arange(4096, dtype=np.uint64)
    assert S.gray_rank(codes ^ (codes >> np.uint64(1))).tolist() == codes.tolist()


def cloud(n, centres=8, flips=5, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, 2 ** 63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        p = p ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(p)


@pytest.mark.parametrize("n, flips", [(1, 1), (2, 1), (300, 2), (900, 4)])
def test_index_finds_all_pairs(n, flips, monkeypatch):
    monkeypatch.setattr(S, "_PAIRS", 5000)
    p = cloud(n, flips=flips)
    bucket = np.sort(np.random.default_rng(1).integers(0, 3, len(p)))
    order = np.lexsort((S.gray_rank(p), bucket))
    p, bucket = p[order], bucket[order]
    got = sorted(zip(*[x.tolist() for x in S.near_pairs(bucket, p, 3)]))
    apart = np.bitwise_count(p[:, None] ^ p[None, :])
    assert got == [(i, j) for i in range(len(p)) for j in range(i + 1, len(p))
                   if apart[i, j] <= 3 and bucket[i] == bucket[j]]


def brute_components(prints):
    u, inverse = np.unique(prints, return_inverse=True)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    return S.local_roots(len(u), i, j)[inverse]


@pytest.mark.parametrize("blocks, tile", [(4, 2000), (5, 50), (8, 20)])
def test_links_for_all_routings(spark, monkeypatch, blocks, tile):
    monkeypatch.setattr(S, "TILE", tile)
    p = cloud(600, flips=3)
    classes = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "print long")
    found = {r["node"]: r["component"] for r in
             components(S.links(classes, 3, blocks)).collect()}
    got = [found.get(int(x), int(x)) for x in p.view(np.int64)]
    want = brute_components(p)
    assert len({(a, int(b)) for a, b in zip(got, want)}) == len(set(got)) == len(set(want.tolist()))


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (200, 100), (70, 3)]
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 70: 0, 100: 100, 101: 100, 200: 100}


def test_edge_cases(edge_docs, no_docs, edge_rows):
    rows = S.near_duplicates(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    root = brute_components(np.array([brute_print(t) for _, t, _ in edge_rows], np.uint64))
    least = {}
    for (k, _, _), c in zip(edge_rows, root):
        least[c] = min([x for x in (least.get(c), k) if x is not None], default=None)
    want = sorted([(k, least[c]) for (k, _, _), c in zip(edge_rows, root)], key=str)
    assert sorted([(r["doc_id"], r["component"]) for r in rows], key=str) == want
    assert S.near_duplicates(no_docs).collect() == []
