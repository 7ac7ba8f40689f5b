import math
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest

from verdara.llm import pitman_yor as Y
from verdara.sources import scratch


def tokens(text):
    return (text or "").encode().lower().split() + [b" end"]


def brute_base(rows):
    seen = Counter()
    for k, t in rows:
        if zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1:
            seen.update(tokens(t))
    n, v = seen.total(), len(seen)
    return {(k, t): (len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n,
                     round(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6))
            for k, t in rows}


def check(docs, rows):
    got = Y.score(docs).collect()
    want = brute_base(rows)
    texts = {}
    for k, t in rows:
        texts.setdefault(k, set()).add(t)
    have = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert have == Counter((k, *want[k, t]) for k, t in rows)
    return got


@pytest.fixture
def corpus(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    follow = rng.integers(0, 300, (300, 3))
    rows = []
    for i in range(400):
        at, text = int(rng.integers(300)), []
        for _ in range(40):
            text.append(words[at])
            at = int(follow[at][rng.integers(3)]) if rng.random() < 0.9 else int(rng.integers(300))
        rows.append((i, " ".join(text)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_base_is_exact_and_contexts_help(corpus):
    rows, docs = corpus
    got = check(docs, rows)
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.8
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in got)


def test_paths_agree(corpus, monkeypatch):
    """The table of frequent pairs, split restaurants and whole ones hold the same model."""
    rows, docs = corpus
    scores = []
    for frequent, shared in ((1024, 8192), (1, 8192), (1, 1)):
        monkeypatch.setattr(Y, "FREQUENT", frequent)
        monkeypatch.setattr(Y, "SHARED", shared)
        scores.append({r["doc_id"]: r["score"] for r in check(docs, rows)})
    total = [sum(s.values()) for s in scores]
    assert total[1] == pytest.approx(total[0], rel=2e-3) and total[2] == pytest.approx(total[0], rel=2e-3)
    assert all(s[k] == pytest.approx(scores[0][k], rel=0.03) for s in scores for k in s)


def seatings(customers, strength, discount, parent):
    """Distribution of the numbers of tables, by all ways to seat one customer after the other."""
    ways = {(): 1.0}
    for _ in range(customers):
        more = Counter()
        for sizes, weight in ways.items():
            for i, n in enumerate(sizes):
                more[tuple(sorted((*sizes[:i], n + 1, *sizes[i + 1:])))] += weight * (n - discount)
            more[tuple(sorted((*sizes, 1)))] += weight * (strength + discount * len(sizes)) * parent
        ways = more
    tables = Counter()
    for sizes, weight in ways.items():
        tables[len(sizes)] += weight
    return {k: w / sum(tables.values()) for k, w in tables.items()}


@pytest.mark.parametrize("customers, others, parent", [(2, 0, 0.3), (5, 0, 0.1), (7, 6, 0.5), (9, 40, 0.02)])
def test_tables_are_drawn_from_their_distribution(customers, others, parent):
    n, d = 60_000, 0.6
    want = seatings(customers, Y.STRENGTH + d * others, d, parent)
    got = Y.draw_tables(np.full(n, customers), np.full(n, others), np.full(n, parent), d,
                        np.random.default_rng(4))
    for k in range(1, customers + 1):
        assert (got == k).mean() == pytest.approx(want[k], abs=0.01)


def gibbs(texts, discount, root_discount, known, sweeps, burn):
    """Customers taken out and seated again one at a time, with the sizes of all tables."""
    random = np.random.default_rng(9)
    pairs = [p for t in texts for p in zip([b"", *tokens(t)], tokens(t))]
    house, root = {}, {}

    def root_p(w):
        own, total = root.get(w, []), sum(map(sum, root.values()))
        return (max(sum(own) - root_discount * len(own), 0) + (Y.STRENGTH + root_discount * sum(
            map(len, root.values()))) / (known + 1)) / (Y.STRENGTH + total)

    def sit(tables, d, new):
        chances = np.array([n - d for n in tables] + [new])
        at = random.choice(len(chances), p=chances / chances.sum())
        if at == len(tables):
            tables.append(0)
        tables[at] += 1
        return tables[at] == 1

    def leave(tables):
        at = random.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[at] -= 1
        if not tables[at]:
            del tables[at]
            return True
        return False

    mean = Counter()
    for s in range(sweeps):
        for u, w in pairs:
            own = house.setdefault(u, {}).setdefault(w, [])
            if s and leave(own):
                leave(root[w])
            if sit(own, discount, (Y.STRENGTH + discount * sum(map(len, house[u].values()))) * root_p(w)):
                sit(root.setdefault(w, []), root_discount, (Y.STRENGTH + root_discount * sum(
                    map(len, root.values()))) / (known + 1))
        if s >= burn:
            for u, w in set(pairs):
                own, n = house[u][w], sum(map(sum, house[u].values()))
                mean[u, w] += (sum(own) - discount * len(own) + (Y.STRENGTH + discount * sum(
                    map(len, house[u].values()))) * root_p(w)) / (Y.STRENGTH + n) / (sweeps - burn)
    return mean


def test_scores_are_near_those_of_a_brute_force_sampler(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{min(int(rng.zipf(1.6)), 12)}" for _ in range(8))) for i in range(40)]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    pairs = Counter(p for t in train for p in zip([b"", *tokens(t)], tokens(t)))
    n = Counter(pairs.values())
    monkeypatch.setattr(Y, "FREQUENT", 20)
    got = {r["doc_id"]: r["score"] for r in Y.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    known = len({w for _, w in pairs})
    mean = gibbs(train, Y._discount(n[1], n[2]), 0.5, known, 60, 20)
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            want = sum(math.log10(mean[p]) for p in zip([b"", *tokens(t)], tokens(t)))
            assert got[i] == pytest.approx(want, rel=0.05)


def test_layout_does_not_change_words_or_base(corpus):
    rows, docs = corpus
    a = {r["doc_id"]: r["score"] for r in Y.score(docs.repartition(1)).collect()}
    b = {r["doc_id"]: r["score"] for r in Y.score(docs.repartition(7)).collect()}
    assert all(abs(a[k] - b[k]) < 1e-6 * abs(a[k]) for k in a)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    count = rng.integers(0, 30, (5, 200)) * (rng.random((5, 200)) < 0.4)
    parent = rng.random(201)
    parent /= parent.sum()  # the last word is unknown
    context, word = (x.ravel().astype(np.uint64) for x in np.indices((5, 201)))
    full = np.hstack([count, np.zeros((5, 1), int)]).ravel()
    shared = Y.Shared(0.6, np.zeros(0), np.zeros(0))
    p = Y.predictive(context | Y._RARE, full, parent[word.astype(int)], shared, 0)
    assert p.reshape(5, 201).sum(axis=1) == pytest.approx(np.ones(5))


def test_seating_has_the_expected_number_of_tables():
    rng, n, d, weight = np.random.default_rng(2), 60, 0.5, 2.0
    want = np.zeros(20_000)
    for k in range(len(want)):
        tables = 1
        for seated in range(1, n):
            tables += rng.random() < weight / (weight + seated - d * tables)
        want[k] = tables
    got = Y.seat(np.full(20_000, n), np.full(20_000, weight), d, rng)
    assert got.mean() == pytest.approx(want.mean(), rel=0.03)


def test_edge_cases(edge_docs, no_docs, edge_rows, spark):
    check(edge_docs, [(k, t) for k, t, _ in edge_rows])
    assert Y.score(no_docs).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = spark.createDataFrame([(held, "no training here")], "doc_id long, text string")
    row, = Y.score(only).collect()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and math.isfinite(row["score"])


def test_cells_are_dealt_in_less_room_than_their_texts():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"word{int(x)}" for x in rng.zipf(1.3, 200) % 50_000) for _ in range(2000)]
    train = rng.random(len(texts)) < 0.8
    row = dict(zip(Y._SLICE, (7, *Y._coded(pa.array(texts), train))))
    own = sorted(zip(row["own_n"], row["own"]), reverse=True)

    class Sent:
        value = Y.Numbers.of([w for _, w in own[:500]], 5)

    batch = pa.RecordBatch.from_arrays([pa.array([row[c]], Y._SLICE[c]) for c in Y._WORK], names=Y._WORK)
    dealt, = Y._deal(Sent, 9)(iter([batch]))
    dealt = dealt.to_pylist()
    assert sum(len(r["rare"]) + len(r["numbers"]) for r in dealt) < sum(map(len, texts))
    code = {w: Y.xxh64_intdigest(w) | 1 << 63 for t in texts for w in tokens(t)}
    code |= {w: i for i, (_, w) in enumerate(own[:500])}
    want = Counter()
    for text, learned in zip(texts, train):
        ids = [code[w] for w in tokens(text)]
        for u, w in zip([500, *ids], ids):
            if not (w < 5 and (u < 5 or u == 500)):
                want[u, w] += int(learned)
    got = {}
    for r in dealt:
        for u, w, n in zip(*(x.tolist() for x in Y._dealt_cells(r["rare"], r["numbers"]))):
            assert (u, w) not in got
            got[u, w] = n
    assert got == want and 0 in got.values()


def test_every_white_space_parts_words():
    texts = ["a\tB\x0bc\x0cd\re\nf  g ", None, "", "\u00a0x \u0130\x1cY"]
    made = dict(zip(list(Y._SLICE)[1:], Y._coded(pa.array(texts), np.ones(4, bool))))
    hashes = np.frombuffer(made["hashes"], "<u8")[Y._unpacked(made["at"])].tolist()
    want = [w for t in texts for w in tokens(t)]
    assert hashes == [Y.xxh64_intdigest(w) | 1 << 63 for w in want]
    assert Y._unpacked(made["sizes"]).tolist() == [len(tokens(t)) for t in texts] and made["tokens"] == len(want)


def test_scores_are_packed_closely():
    x = np.log10(np.random.default_rng(1).random(1000))
    assert Y._unpacked_floats(Y._packed_floats(x)) == pytest.approx(x, rel=1e-10)


def test_only_tables_that_are_read_again_stay_and_slices_are_not_shuffled(corpus, spark, capsys):
    rows, docs = corpus
    top = Path(urlparse(scratch.shared_dir(spark)).path)
    before = set(top.iterdir())
    got = Y.score(docs)
    tables = [spark.read.parquet(f"file:{t}/table") for t in set(top.iterdir()) - before]
    kept = sorted({"keys": "slices", "houses": "parts", "root": "answers"}.get(next(
        (c for c in ("keys", "houses", "root") if c in t.columns), ""), str(t.columns)) for t in tables if t.count())
    assert kept == ["answers", "parts", "slices"]
    got.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(slice") == 1  # the scores of the cells
    assert plan.count("Exchange hashpartitioning(part") == 1  # what the root answers
    assert got.count() == len(rows)


def test_one_group_is_seated_as_in_an_array():
    rng = np.random.default_rng(8)
    for customers, weight in zip([0, 1, 2, 129, 1000, 54_321], [3.0, 0.1, 0.4, 0.6, 25.0, 1e-4]):
        for seed in range(20):
            d = float(rng.random())
            want = Y.seat(np.array([customers]), np.array([weight]), d, np.random.default_rng(seed))
            assert Y.seat_one(customers, weight, d, np.random.default_rng(seed)) == want[0]


def test_totals_of_split_restaurants_leave_a_task_once():
    rare = np.uint64(1 << 63 | 5)
    row = dict(zip(Y._CELLS, Y._packed_columns(dict(zip(Y._CELLS, (
        np.array([7], np.uint64), np.array([0, 3, rare], np.uint64), *(np.array(x) for x in (
            [0, 0], [1, 2], [4, 2], [2, 1], [5, 0, 1], [5, 4, 3])))))).values()))
    batch = pa.RecordBatch.from_arrays([pa.array([row[c]] * 30, pa.binary()) for c in Y._CELLS], names=Y._CELLS)
    made, = Y._split_totals(3)(iter([batch, batch]))
    assert made.to_pydict() == {"code": [0, 3], "tables": [300, 120], "customers": [300, 240]}
