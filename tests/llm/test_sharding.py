import zlib
from collections import Counter

import numpy as np

from verdara.llm import sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return b


def test_jump_matches_the_loop_and_moves_little():
    keys = np.random.default_rng(0).integers(0, 2 ** 63, 2000, dtype=np.uint64) * np.uint64(2)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump(keys, n).tolist() == [jump(int(k), n) for k in keys]
    old, new = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(new[old != new]) == {8} and 0.06 < (old != new).mean() < 0.16


def test_slots_have_no_gaps(edge_docs, no_docs, edge_rows):
    rows = sharding.assign(edge_docs, 3).collect()
    assert len(rows) == len(edge_rows)
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    want = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in edge_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.assign(no_docs, 3).collect() == []


def test_one_key_with_most_rows(spark):
    docs = spark.range(5000).selectExpr("CASE WHEN id < 4000 THEN 7 ELSE id END AS doc_id", "'t' AS text")
    rows = sharding.assign(docs, 8).collect()
    for shard in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
