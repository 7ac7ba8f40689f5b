import random
from collections import Counter, defaultdict

from verdara.llm import packing


def brute(lengths, sizes, cost):
    """The same rules piece by piece."""
    lengths, bins = sorted(lengths, reverse=True), []
    for i, n in enumerate(lengths):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            least = min(fits, key=lambda b: b[0])
            least[0] -= n
            least[1].append(n)
            continue
        same = lengths[i:].count(n)

        def per_token(size):
            own = min(size // n, same) * n
            fit = sum(m for m in lengths[i:] if m < n and m <= size - own)
            return cost(size) / (own + min(size - own, fit))

        size = min((s for s in sizes if s >= n), key=lambda s: (per_token(s), s))
        bins.append([size - n, [n]])
    return bins


def test_matches_piece_by_piece_packing():
    r = random.Random(1)
    for trial in range(150):
        sizes = ((8, 16, 32), (10, 25, 60), (25,))[trial % 3]
        counts = Counter(r.randint(1, max(sizes)) for _ in range(r.randint(1, 80)))
        placed, runs = packing.plan(counts, sizes)
        bins = defaultdict(list)
        for n, _, bs, each, first, offset in placed:
            for i in range(bs):
                bins[first + i] += [(offset + j * n, n) for j in range(each)]
        assert Counter(n for b in bins.values() for _, n in b) == counts
        final = {f + i: (t, s) for f, k, t, s in runs for i in range(k)}
        for b, own in bins.items():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert final[b] == (at, next(s for s in sizes if s >= at))
        want = brute(list(counts.elements()), sizes, packing.sequence_cost)
        # bins of equal room are equally good, so contents may be dealt differently among them
        assert len(bins) == len(want)
        if len(sizes) == 1:
            assert (sorted(sum(n for _, n in b) for b in bins.values())
                    == sorted(sum(b[1]) for b in want))


def test_rows_fill_their_bins(edge_docs, no_docs, edge_rows):
    rows = packing.pack(edge_docs, sizes=(16, 64, 256)).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin"]].append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["slot_start"]):
            assert r["slot_start"] == at and r["bin_size"] in (16, 64, 256)
            at += r["length"]
        assert {r["bin_tokens"] for r in own} == {at} and at <= own[0]["bin_size"]
    assert sum(r["length"] for r in rows) == sum({(r["doc_id"], r["n_tokens"]): r["n_tokens"] * (
        2 if r["doc_id"] == 5 else 1) for r in rows}.values())
    assert len({r["doc_id"] for r in rows}) == len({k for k, _, _ in edge_rows})
    assert packing.pack(no_docs).collect() == []


def test_one_length_with_all_rows(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "'same text here' AS text")
    rows = packing.pack(docs, sizes=(8, 32)).collect()
    assert len(rows) == 30_000
    assert len({(r["bin"], r["slot_start"]) for r in rows}) == 30_000
