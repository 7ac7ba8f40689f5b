"""Personal data by base patterns and a skip-chain conditional random field.

Base patterns find e-mail and IP addresses, card and phone numbers.  The field reads the tokens
that can be personal data at all (those with a digit or an at sign; every other token is fixed to
"none") and labels them email, ip, card, phone, secret or none.  Neighbouring tokens share chain
potentials.  Equal or similar tokens anywhere in the document (the same letters and digits)
share skip potentials, each with one node for all of them, so one clear mention decides the unclear
ones however many there are.  The shared node holds what the token itself tells, counted once;
mentions hold what stands near them.  Skip potentials reward equal labels alike, whatever the
label, so a mention with nothing near it carries labels and never adds evidence.  The graph has loops; sum-product messages are passed over the edges
of a batch of documents until those of a document stand still.  Tokens with a marginal of at least THRESHOLD for a label
become spans unless they touch a base span.

Weights are fitted on the driver by gradient ascent on labelled texts that a seeded generator
writes (TRAINING_TEXTS of them): true cases in several notations, repeated mentions without
context, and look-alikes such as dates, prices, order numbers and commit hashes.

Defined results: NULL or empty text: no spans.  Positions count code points, ends are exclusive.
Repeated rows stay repeated; equal texts have equal spans.  Empty table: no rows.  Input columns
named like an added column are replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verdara.llm.common import ship, with_fields

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS, "secret"]
ORDER = {k: i for i, k in enumerate(LABELS[1:])}
THRESHOLD = 0.9
#: Messages of a document stop at changes up to TOLERANCE; ROUNDS ends those that never settle.
TOLERANCE = 1e-5
ROUNDS = 2000
TRAINING_TEXTS = 400
BATCH_NODES = 20_000

# --- base patterns; lookbehind and possessive runs keep them linear, matches stay the same ---

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        low = at + 1
        if domain:
            yield start, domain.end()
            low = domain.end()
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start and then kind as listed."""
    if not _ANY.search(text):
        return []
    found = [(s, "email", e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda x: (x[0], ORDER[x[1]]))


def as_text(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


# --- tokens and features ---

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_CORE = re.compile(r"[+(]*[0-9A-Za-z](?:.*[0-9A-Za-z])?", re.S)
_HINTS = {"secret": {"token", "key", "secret", "password", "passwd", "apikey", "api_key", "bearer",
                     "auth", "authorization", "credential", "credentials", "pwd"},
          "phone": {"tel", "telephone", "phone", "call", "fax", "mobile", "cell", "whatsapp",
                    "telefon", "teléfono", "téléphone"},
          "card": {"card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte"},
          "ip": {"ip", "host", "server", "address", "ping", "ssh"},
          "email": {"mail", "email", "e-mail", "contact", "write", "correo"},
          "hash": {"commit", "sha256", "sha1", "md5", "checksum", "digest", "hash", "revision"},
          "number": {"order", "invoice", "isbn", "page", "chapter", "no", "nr", "id", "version",
                     "serial", "ticket"}}
_HINT_OF = {w: k for k, ws in _HINTS.items() for w in ws}
_SHAPES = [
    ("quad", r"(25[0-5]|2[0-4]\d|[01]?\d?\d)(\.(25[0-5]|2[0-4]\d|[01]?\d?\d)){3}(:\d+)?"), ("at", r"\S+@\S+\.\S+"),
    ("at_word", r"\S+[\[({]at[\])}]\S+"), ("hex", r"(?=.*\d)(?=.*[a-fA-F])[0-9a-fA-F]{24,}"),
    ("mixed", r"(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{20,}"), ("plus", r"\+\d[\d().-]*"),
    ("area", r"\(\d{2,5}\)"), ("date", r"\d{4}-\d\d-\d\d"), ("decimal", r"\d+[.,]\d+"),
    ("line", r"\d{3}[-.]\d{3}[-.]\d{4}"), ("dashed", r"\d{2,4}([-.]\d{2,4}){1,3}"), ("time", r"\d\d?:\d\d(:\d\d)?"), ("four", r"\d{4}"),
    ("short", r"\d{1,3}"), ("middle", r"\d{5,9}"), ("ten", r"\d{10,12}"), ("long", r"\d{13,19}"),
    ("huge", r"\d{20,}")]
_SHAPES = [(n, re.compile(p)) for n, p in _SHAPES]
FEATURES = (["bias", "luhn"] + [n for n, _ in _SHAPES] + [f"near_{k}" for k in _HINTS]
            + [f"near_secret_{n}" for n in ("hex", "mixed")]
            + [f"near_hash_{n}" for n in ("hex", "mixed")] + ["other"])
_FEATURE = {f: i for i, f in enumerate(FEATURES)}
_OWN = {i for f, i in _FEATURE.items() if not f.startswith("near_")}  # told by the token itself
CHAIN, SKIP = 0, 1


class Graph:
    """Candidate tokens of some documents with their edges.

    All equal mentions of a document are linked to one shared node without a place.
    """

    def __init__(self):
        self.features: list[list[int]] = []
        self.edges: list[tuple[int, int, int]] = []
        self.where: list[tuple[int, int, int]] = []  # (document, start, end); -1: shared

    def add(self, doc: int, text: str) -> None:
        last, near, at, seen = None, [], -9, {}
        for n, m in enumerate(_TOKEN.finditer(text)):
            token = m[0]
            if not _ANY.search(token) and "at" not in token:
                near = [*near[-2:], token]
                continue
            core = _CORE.search(token)
            if not core or not (_ANY.search(token) or re.search(r"[\[({]at[\])}]", token)):
                near = [*near[-2:], token]
                continue
            node = len(self.where)
            self.features.append(_features(core[0], near))
            self.where.append((doc, m.start() + core.start(), m.start() + core.end()))
            if at == n - 1:
                self.edges.append((last, node, CHAIN))
            key = re.sub(r"[^0-9a-z]", "", core[0].lower()) or core[0]
            seen.setdefault(key, []).append(node)
            last, at, near = node, n, [*near[-2:], token]
        for mentions in seen.values():
            if len(mentions) > 1:
                self.edges += [(m, len(self.where), SKIP) for m in mentions]
                own = {f for m in mentions for f in self.features[m] if f in _OWN}
                self.features.append(sorted(own))
                for m in mentions:
                    self.features[m] = [f for f in self.features[m] if f not in _OWN]
                self.where.append((doc, -1, -1))


def _features(core: str, near: list[str]) -> list[int]:
    shape = next((n for n, p in _SHAPES if p.fullmatch(core)), "other")
    found = ["bias", shape]
    if shape == "long" and luhn(core):
        found.append("luhn")
    hints = {_HINT_OF.get(w.strip(".,:;=\"'()!#*$%&").lower()) for w in near} - {None}
    found += [f"near_{h}" for h in hints]
    found += [f for h in hints if (f := f"near_{h}_{shape}") in _FEATURE]
    return [_FEATURE[f] for f in found]


class Field:
    """Weights: unary (features × labels), pair (chain and skip, labels × labels)."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def scores(self, graph: Graph) -> np.ndarray:
        n = np.array([len(f) for f in graph.features])
        flat = np.array([i for f in graph.features for i in f], int)
        out, own = np.zeros((len(n), len(LABELS))), n > 0
        if own.any():
            out[own] = np.add.reduceat(self.unary[flat], (np.cumsum(n) - n)[own], axis=0)
        return out

    def marginals(self, graph: Graph) -> tuple[np.ndarray, np.ndarray]:
        """Beliefs of nodes and of edges once the messages of each document stand still."""
        score = self.scores(graph)
        edges = np.array(graph.edges, int).reshape(-1, 3)
        a, b, pair = edges[:, 0], edges[:, 1], self.pair[edges[:, 2]]
        doc = np.array([d for d, _, _ in graph.where], int)[a]
        there, back = np.zeros((2, len(edges), len(LABELS)))

        def beliefs(e: np.ndarray | slice) -> np.ndarray:
            total = score.copy()
            np.add.at(total, b[e], there[e])
            np.add.at(total, a[e], back[e])
            return total

        moving = np.arange(len(edges))
        for _ in range(ROUNDS):
            if not len(moving):
                break
            total, e = beliefs(moving), moving
            up = _log_sum((total[a[e]] - back[e])[:, :, None] + pair[e], 1)
            down = _log_sum((total[b[e]] - there[e])[:, None, :] + pair[e], 2)
            up = (up - _log_sum(up, 1)[:, None] - there[e]) / 2  # damped: the graph has loops
            down = (down - _log_sum(down, 1)[:, None] - back[e]) / 2
            there[e] += up
            back[e] += down
            most = np.zeros(doc.max() + 1)
            np.maximum.at(most, doc[e], np.maximum(np.abs(up), np.abs(down)).max(axis=1))
            moving = e[most[doc[e]] > TOLERANCE]
        total = beliefs(slice(None))
        node = np.exp(total - _log_sum(total, 1)[:, None])
        joint = (total[a] - back)[:, :, None] + (total[b] - there)[:, None, :] + pair
        joint = joint.reshape(len(edges), len(LABELS) ** 2)
        joint = np.exp(joint - _log_sum(joint, 1)[:, None])
        return node, joint.reshape(-1, len(LABELS), len(LABELS))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True, initial=-1e300)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(texts: list[tuple[str, list[tuple[int, str, int]]]], rounds: int = 150, rate: float = 0.5,
        decay: float = 1e-3) -> Field:
    """Weights from labelled texts: expected counts by messages, gradient ascent."""
    graph, wanted = Graph(), []
    for doc, (text, spans) in enumerate(texts):
        begin = len(graph.where)
        graph.add(doc, text)
        for _, s, e in graph.where[begin:]:
            wanted.append(next((LABELS.index(k) for x, k, y in spans if x < e and s < y), 0))
    gold = np.array(wanted)
    for a, b, kind in graph.edges:
        if kind == SKIP:  # mentions of one value have one label
            gold[b] = gold[a]
    edges = np.array(graph.edges, int).reshape(-1, 3)
    n = np.array([len(f) for f in graph.features])
    flat, owner = np.array([i for f in graph.features for i in f]), np.repeat(np.arange(len(n)), n)
    seen = np.zeros((2, len(LABELS), len(LABELS)))
    np.add.at(seen, (edges[:, 2], gold[edges[:, 0]], gold[edges[:, 1]]), 1)
    field = Field(np.zeros((len(FEATURES), len(LABELS))), np.zeros_like(seen))
    speed_u, speed_p = np.zeros_like(field.unary), np.zeros_like(seen)
    for _ in range(rounds):
        node, joint = field.marginals(graph)
        gap = np.eye(len(LABELS))[gold] - node
        step = np.zeros_like(field.unary)
        np.add.at(step, flat, gap[owner])
        expected = np.zeros_like(seen)
        np.add.at(expected, edges[:, 2], joint)
        step, step_p = step / len(n) - decay * field.unary, (seen - expected) / len(n) - decay * field.pair
        gain = np.trace(seen[SKIP] - expected[SKIP]) / seen[SKIP].sum()
        step_p[SKIP] = np.eye(len(LABELS)) * gain  # one weight for equal labels, free to grow
        speed_u, speed_p = 0.9 * speed_u + step, 0.9 * speed_p + step_p
        field.unary += rate * 5 * speed_u
        field.pair += rate * 5 * speed_p
    return field


def labelled_texts(count: int = TRAINING_TEXTS, seed: int = 7) -> list[tuple]:
    """Texts with their true spans (start, kind, end)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(1, 9)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))

    def card() -> str:
        head = digits(15)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{digits(2)} {a} {b}{c}",
                         f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}"])

    true = {"email": lambda: r.choice([f"{word()}.{digits(2)}@{word()}.example.com",
                                       f"{word()}@{word()}.org", f"{word()}[at]{word()}.com"]),
            "ip": lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)) + r.choice(["", ":80"]),
            "card": card, "phone": phone,
            "secret": lambda: r.choice([hexes(40), hexes(32), hexes(40).upper(),
                                        "".join(r.choice("abcdefGHIJKL0123456789") for _ in range(28))])}
    lead = {"secret": ["token =", "api_key =", "secret:", "password :", "key:"],
            "phone": ["tel", "call", ""], "card": ["card", "visa", ""], "ip": ["host", ""],
            "email": ["mail", "contact", ""]}
    other = [lambda: str(r.randint(1900, 2030)), lambda: digits(r.randint(1, 3)),
             lambda: f"{r.randint(1900, 2030)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}",
             lambda: f"{digits(2)}.{digits(2)}", lambda: f"{digits(2)}:{digits(2)}",
             lambda: r.choice(["", "deploy "]) + hexes(r.choice([32, 40])),
             lambda: "host " + ".".join(["192", digits(2), digits(1), str(r.randint(256, 999))]),
             lambda: "order " + digits(r.randint(5, 12)), lambda: "invoice " + digits(16),
             lambda: "commit " + hexes(40), lambda: "sha256 " + hexes(64), lambda: digits(22),
             lambda: "isbn 978-" + digits(1) + "-" + digits(4) + "-" + digits(4),
             lambda: "version 3." + digits(1) + "." + digits(2), lambda: digits(8),
             lambda: word() + digits(2), lambda: digits(3) + "," + digits(3),
             lambda: next(x for x in iter(lambda: digits(16), None) if not luhn(x))]
    out = []
    for _ in range(count):
        parts, spans, at, again = [], [], 0, []

        def put(s: str, kind: str | None = None) -> None:
            nonlocal at
            if kind:
                spans.append((at, kind, at + len(s)))
            parts.append(s)
            at += len(s) + 1

        for _ in range(r.randint(3, 8)):
            for _ in range(r.randint(1, 8)):
                put(word())
            draw = r.random()
            if draw < 0.45:
                kind = r.choice(list(true))
                value = true[kind]()
                if hint := r.choice(lead[kind]):
                    put(hint)
                if kind == "secret" and r.random() < 0.5:
                    parts.append(f'"{value}"')
                    spans.append((at + 1, kind, at + 1 + len(value)))
                    at += len(value) + 3
                else:
                    put(value, kind)
                again.append((value, kind))
            elif draw < 0.6 and again:
                put(*r.choice(again))
            elif draw < 0.9:
                put(value := r.choice(other)())
                again.append((value.split()[-1], None))
        out.append((" ".join(parts), spans))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    return fit(labelled_texts())


# --- spans ---

def field_spans(texts: list[str], field: Field) -> list[list[tuple[int, str, int]]]:
    """Spans that the field finds in each text."""
    out: list[list[tuple[int, str, int]]] = [[] for _ in texts]
    graph = Graph()
    for i, text in enumerate(texts):
        if _ANY.search(text) or "at]" in text or "at)" in text or "at}" in text:
            graph.add(i, text)
        if graph.where and (len(graph.where) >= BATCH_NODES or i == len(texts) - 1):
            _decide(graph, field, out)
            graph = Graph()
    if graph.where:
        _decide(graph, field, out)
    return out


def _decide(graph: Graph, field: Field, out: list) -> None:
    node, _ = field.marginals(graph)
    best = node.argmax(axis=1)
    sure = node[np.arange(len(best)), best] >= THRESHOLD
    joined = {b: a for a, b, kind in graph.edges if kind == CHAIN}
    spans: dict[int, tuple[int, int, str, int]] = {}
    for i in np.flatnonzero(sure & (best > 0)).tolist():
        doc, start, end = graph.where[i]
        if start < 0:
            continue
        kind, before = LABELS[best[i]], spans.get(joined.get(i, -1))
        # numbers written in groups are one span; two whole card numbers are two
        grouped = kind == "phone" or kind == "card" and end - start < 13
        if before and before[2] == kind and grouped:
            start = before[1]
            out[doc].remove((before[1], before[2], before[3]))
        spans[i] = (doc, start, kind, end)
        out[doc].append((start, kind, end))


def all_spans(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """(base spans, base and added spans) of each text."""
    texts = [t or "" for t in texts]
    out = []
    for text, found in zip(texts, field_spans(texts, field)):
        base = base_spans(text)
        ends = sorted((s, e) for s, _, e in base)
        added = [x for x in found if not _touches(x, ends)] if found else []
        out.append((base, sorted(base + added, key=lambda x: (x[0], ORDER[x[1]]))))
    return out


def _touches(span: tuple[int, str, int], ends: list[tuple[int, int]]) -> bool:
    return any(s < span[2] and span[0] < e for s, e in ends)


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by <KIND>."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


FIELDS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]


def find(docs: DataFrame, text: str = "text", clean: str | None = None) -> DataFrame:
    """Add FIELDS and, if ``clean`` names a column, the redacted text."""
    ship(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(trained())
    fields = FIELDS + ([clean] if clean else [])
    schema = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
              "spans string, n_added long" + (f", `{clean}` string" if clean else ""))

    @pandas_udf(schema)
    def fn(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.tolist()
            rows = []
            for t, (base, spans) in zip(texts, all_spans(texts, weights.value)):
                counts = [sum(k == kind for _, k, _ in base) for kind in KINDS]
                row = (*counts, hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(spans),
                       len(spans) - len(base))
                rows.append(row + ((t if t is None else redacted(t, spans),) if clean else ()))
            yield pd.DataFrame(rows, columns=fields)

    return with_fields(docs, fn(F.col(f"`{text}`")), fields)
