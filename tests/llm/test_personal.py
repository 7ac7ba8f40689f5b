import random
import re

import numpy as np
import pytest

from verdara.llm import personal as P

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and P.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found, key=lambda x: (x[0], P.ORDER[x[1]]))


@pytest.fixture(scope="module")
def field():
    return P.trained()


def test_base_spans_match_the_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice("a1@.+-_ (5é") for _ in range(r.randint(0, 40)))
        assert P.base_spans(text) == brute(text), repr(text)
    for _ in range(3000):
        text = "".join(r.choice("0123456789. -+") for _ in range(r.randint(10, 60)))
        assert P.base_spans(text) == brute(text), repr(text)


def test_base_spans_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000):
        P.base_spans(text)


def test_messages_are_exact_on_a_chain(field):
    graph = P.Graph()
    graph.add(0, "tel +1 (803) 555-5351 2001")
    assert all(kind == P.CHAIN for _, _, kind in graph.edges) and len(graph.where) == 4
    score, k = field.scores(graph), len(P.LABELS)
    joint = np.zeros((k,) * 4)
    for at in np.ndindex(*joint.shape):
        joint[at] = np.exp(sum(score[i, at[i]] for i in range(4))
                           + sum(field.pair[P.CHAIN][at[i], at[i + 1]] for i in range(3)))
    joint /= joint.sum()
    want = np.array([joint.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)])
    rounds, P.ROUNDS = P.ROUNDS, 60
    try:
        assert field.marginals(graph)[0] == pytest.approx(want, abs=1e-4)
    finally:
        P.ROUNDS = rounds


def test_held_out_texts(field):
    texts = P.labelled_texts(200, seed=99)
    right = wanted = given = 0
    for (_, spans), got in zip(texts, P.field_spans([t for t, _ in texts], field)):
        wanted, given = wanted + len(spans), given + len(got)
        right += sum(any(k == w and a < y and x < b for x, w, y in spans) for a, k, b in got)
    assert right / given > 0.97 and right / wanted > 0.8


def test_skip_edges_carry_a_label(field):
    secret = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    alone = P.field_spans([f"some {secret} here"], field)[0]
    text = f'token = "{secret}" and later {secret.upper()}! again'
    both = P.field_spans([text], field)[0]
    assert [k for _, k, _ in both] == ["secret", "secret"] and len(alone) <= 1
    assert all(text[a:b].lower() == secret for a, _, b in both)


def test_one_clear_mention_labels_fifty(field):
    secret = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    text = f'api_key = "{secret}' + f" and later word {secret} again" * 49
    assert [k for _, k, _ in P.field_spans([text], field)[0]] == ["secret"] * 50
    graph = P.Graph()
    graph.add(0, text)
    assert len(graph.edges) == 50 and len(graph.where) == 51
    pair = field.pair[P.SKIP]  # a star is a tree: sums over the shared node are exact
    up = np.logaddexp.reduce(field.scores(graph)[:50, :, None] + pair, axis=1)
    rest = up.sum(axis=0) - up + field.scores(graph)[50]
    want = field.scores(graph)[:50] + np.logaddexp.reduce(pair + rest[:, None, :], axis=2)
    want = np.exp(want - np.logaddexp.reduce(want, axis=1)[:, None])
    assert field.marginals(graph)[0][:50] == pytest.approx(want, abs=1e-4)


def test_repetition_alone_is_no_evidence(field):
    commit = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    for text in (f"deploy {commit} and {commit} or {commit}", f"word {commit} word " * 50,
                 f"commit {commit}" + f" and later word {commit} again" * 49, f"merge {commit}"):
        assert P.field_spans([text], field) == [[]], text
    graphs = []
    for n in (2, 50):  # mentions with nothing near them leave the shared belief as it is
        graph = P.Graph()
        graph.add(0, f"some plain words {commit} here and there " * n)
        graphs.append(field.marginals(graph)[0][-1])
    assert graphs[0] == pytest.approx(graphs[1], abs=1e-4)
    assert np.ptp(np.diag(field.pair[P.SKIP])) < 1e-9 and not field.pair[P.SKIP][~np.eye(6, dtype=bool)].any()


def test_clear_single_cases(field):
    for text, want in (("please call 415-555-2671 today", ["phone"]), ("host 192.168.1.300 is wrong", []),
                       ("on 2024-05-01 at 12.50", []), ('secret: "9233a8ecf7c5b09fe5949719b6b82bc4"', ["secret"])):
        assert [k for _, k, _ in P.field_spans([text], field)[0]] == want, text


def test_loopy_marginals_are_close_to_exact(field):
    graph = P.Graph()
    graph.add(0, "tel 555-5351 2001 and 555-5351 2001")  # two repeated neighbours make a loop
    score, k, n = field.scores(graph), len(P.LABELS), len(graph.where)
    assert n == 6 and len(graph.edges) == 6
    total = np.zeros((k,) * n)
    for i in range(n):
        total = total + score[i].reshape([k if j == i else 1 for j in range(n)])
    for a, b, kind in graph.edges:
        pair = field.pair[kind] if a < b else field.pair[kind].T
        total = total + pair.reshape([k if j in (a, b) else 1 for j in range(n)])
    joint = np.exp(total - total.max())
    joint /= joint.sum()
    want = np.array([joint.sum(axis=tuple(j for j in range(n) if j != i)) for i in range(n)])
    got = field.marginals(graph)[0]
    assert (got.argmax(axis=1) == want.argmax(axis=1)).all() and np.abs(got - want).max() < 0.1


def test_messages_do_not_depend_on_the_batch(field):
    texts = [t for t, _ in P.labelled_texts(20, seed=5)]
    assert P.field_spans(texts, field) == [P.field_spans([t], field)[0] for t in texts]


def test_added_spans_beside_base_spans(field):
    text = "Write to x. +1 (843) 555-7672 170.106.47.218 now, or a.b@c.example.com"
    (base, spans), = P.all_spans([text], field)
    assert set(base) <= set(spans) and [k for _, k, _ in base] == ["ip", "email"]
    assert (text.index("+1"), "phone", text.index(" 170")) in spans
    assert P.redacted(text, spans) == "Write to x. <PHONE> <IP> now, or <EMAIL>"
    for clean in ("No data here at all.", "In 2024 we sold 1200 units at 12.50 on 2024-05-01."):
        assert P.all_spans([clean], field) == [([], [])]


def test_edge_cases(edge_docs, no_docs, edge_rows):
    rows = P.find(edge_docs, clean="clean").collect()
    assert len(rows) == 13
    for r in rows:
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(
            sum(k == kind for _, k, _ in brute(r["text"] or "")) for kind in P.KINDS)
        assert (r["clean"] is None) == (r["text"] is None)
    assert P.find(no_docs).collect() == []
