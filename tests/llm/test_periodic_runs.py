import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdara.llm import periodic_runs as R


def brute(words):
    """All runs by definition: every period, every maximal stretch, every smaller period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            low, high = i, j + q
            if j > i and high - low >= max(6, 4 * q) and not any(
                    all(words[k] == words[k + p] for k in range(low, high - p)) for p in range(1, q)):
                out.append((low, high, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def samples():
    r = random.Random(11)
    yield from ["", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "a a a a a a b " * 5, "a b c d",
                "x y " * 8 + "z " + "y x " * 8, ("a b " * 6 + "c ") * 5, "a " * 200, "a b a " * 40]
    for _ in range(1500):
        letters = "ab" if r.random() < 0.6 else "abc"
        yield " ".join(r.choice(letters) for _ in range(r.randint(1, 70)))
    for _ in range(500):  # periodic pieces, nested and neighbouring
        out = []
        for _ in range(r.randint(1, 5)):
            piece = [r.choice("abcde") for _ in range(r.randint(1, 6))]
            out += piece * r.randint(1, 7) + piece[:r.randint(0, len(piece))]
        out = (out * r.randint(1, 5))[:150]
        yield " ".join(out)


def test_runs_match_the_definition():
    every = [s.encode().split() for s in samples()]
    together = R.runs_of_documents(every)
    n = 0
    for words, found in zip(every, together):
        assert found == brute(words), b" ".join(words)
        n += len(found)
    assert n > 1500


def test_grammar_runs_without_the_cut():
    """The runs do not depend on the stretches that are cut out before."""
    for s in samples():
        words = s.split()
        ids = [sorted(set(words)).index(w) for w in words]
        assert R.runs_of([ids])[0] == brute(words), s


def test_repair_spells_the_words_and_leaves_no_pair_twice():
    r = random.Random(12)
    for _ in range(200):
        words = [r.randrange(3) for _ in range(r.randint(1, 80))]
        sequence, rules, base = R.repair(words)

        def spell(s):
            return [s] if s < base else [x for c in rules[s - base] for x in spell(c)]

        assert [x for s in sequence for x in spell(s)] == words
        pairs = [(i, p) for i, p in enumerate(zip(sequence, sequence[1:]))]
        assert not any(p == o and j > i + 1 for i, p in pairs for j, o in pairs)


def test_cut_stretches_hold_every_run():
    r = random.Random(13)
    docs = [[r.randrange(4) for _ in range(r.randint(0, 60))] for _ in range(300)]
    ids = np.array([w for d in docs for w in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    held, first = R.stretches(ids, doc), np.cumsum([0, *map(len, docs)])
    for d, o in zip(docs, first):
        for low, high, _ in brute(d):
            assert any(a <= low + o and high + o <= b for a, b in held)


def test_long_texts():
    r = random.Random(14)
    two = [r.choice([b"a", b"b"]) for _ in range(20_000)]
    prose = [b"w%d" % int(r.paretovariate(0.7)) for _ in range(100_000)] + [b"x", b"y", b"z"] * 30
    found = R.runs_of_documents([[b"a"] * 200_000, two, prose])
    assert found[0] == [(0, 200_000, 1)]
    assert found[1] and all(two[i] == two[i + q] for x, y, q in found[1] for i in range(x, y - q))
    assert (100_000, 100_090, 3) in found[2]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_rows_match_the_definition(spark):
    from verdara.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = [w.decode() for w in planted(d["doc_id"], (d["text"] or "").encode().split())]
        runs, r = brute(words), got[d["doc_id"]]
        dropped = {i for x, y, q in runs for i in range(x + q, y)}
        listed = "".join(f"{x},{y - x},{q}\n" for x, y, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        best = min(((x - y, x, q) for x, y, q in runs), default=None)
        want = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        some += bool(runs)
    assert some > 5


def test_edge_cases(edge_docs, no_docs):
    rows = R.find_runs(edge_docs, runs="found", clean="short").collect()
    assert len(rows) == 13
    for r in rows:
        words = (r["text"] or "").encode().split()
        if len(words) < 1000:
            assert [(x["start"], x["start"] + x["length"], x["period"]) for x in r["found"]] == brute(words)
        else:
            assert [tuple(x) for x in r["found"]] == [(0, 30_000, 1)] and r["short"] == "word"
        assert r["n_words"] == len(words)
    assert R.find_runs(no_docs).collect() == []
    tails = edge_docs.withColumn("text", R.with_periodic_tails())
    assert tails.count() == 13 and R.find_runs(tails).count() == 13


@pytest.mark.parametrize("n", [0, 1, 2, 5, 40])
def test_periodic_tails(spark, n):
    docs = [(k, " ".join(f"w{i}" for i in range(n))) for k in range(300)]
    got = spark.createDataFrame(docs, "doc_id bigint, text string").select("doc_id", R.with_periodic_tails().alias("t"))
    for r in got.collect():
        assert r["t"].split() == planted(r["doc_id"], docs[r["doc_id"]][1].split())
