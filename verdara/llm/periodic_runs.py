"""Runs of periodic words, found on a grammar of the text.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at
least ``max(LEAST, TIMES * q)`` words, that no neighbouring word extends keeping period q.

The words of a document are compressed by Re-Pair: the most frequent pair of neighbours becomes a
nonterminal, again and again, until no pair occurs twice.  Every run lies across the boundary of
the lowest node of the derivation that holds it whole, so the runs across the boundary between the
two children of a nonterminal are computed once, from a Z function of either side, and translated
to all places of the nonterminal; the symbols that stay are joined by a balanced tree and treated
alike.  Intervals of one period that overlap by a period are parts of one run and are merged.

All pairs of neighbours in a run occur three times in it, the next time at most a quarter of its
length away.  So the pairs are counted before, and stretches are cut where a pair does not; a pair
that is cut is in no run.  Most text is left without a stretch of ``LEAST`` words.

Defined results: NULL, empty or blank text: no words and no runs.  Repeated rows stay repeated;
columns beside the text are ignored; empty table: no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verdara.llm.byte_bpe import groups_of
from verdara.llm.common import BLANKS, ship, whole, with_fields

LEAST, TIMES = 6, 4
_END, _GONE = -1, -2
FIELDS = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
          "collapsed_sha256"]

Run = tuple[int, int, int]  # first word, word after the last, period


def long_enough(length: int, period: int) -> bool:
    return length >= max(LEAST, TIMES * period)


# --- stretches that can hold a run ---

def stretches(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(first, end) of stretches of ids that hold every run of every document.

    ``doc`` names the document of each id in ascending order.
    """
    at = np.flatnonzero(doc[1:] == doc[:-1]) if len(ids) else np.array([], int)
    pair = ids[at] * (ids.max(initial=0) + 1) + ids[at + 1]
    while True:
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # documents lie two apart
        size = np.diff(np.append(first, len(at))) + 1
        part = np.repeat(np.arange(len(first)), size - 1)
        order = np.lexsort((part, pair))
        p, g = pair[order], part[order]
        new = np.ones(len(at), bool)
        new[1:] = (p[1:] != p[:-1]) | (g[1:] != g[:-1])
        group = np.cumsum(new) - 1
        count = np.bincount(group) if len(at) else np.array([], int)
        gap = np.where(new[1:], len(ids) + 1, np.diff(at[order]))
        far = np.array([len(ids) + 1])
        near = np.minimum(np.concatenate([far, gap]), np.concatenate([gap, far]))[:len(at)]
        keep = np.empty(len(at), bool)
        keep[order] = (count[group] >= 3) & (near * TIMES <= size[g]) & (size[g] >= LEAST)
        if keep.all():
            return np.stack([at[first], at[first] + size], axis=1) if len(at) else np.empty((0, 2), int)
        at, pair = at[keep], pair[keep]


# --- grammar ---

def repair(words: list[int]) -> tuple[list[int], list[tuple[int, int]], int]:
    """(sequence, rules, base): nonterminal base + k stands for the two symbols of rules[k].

    Negative words part the sequence.  Of equally frequent pairs the one seen first is taken, so
    equal passages get balanced rules.
    """
    n, base = len(words), max(words, default=0) + 1
    symbol = words + [_END]
    after, before = list(range(1, n + 1)) + [n], list(range(-1, n))
    where: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in range(n - 1):
        if words[i] >= 0 and words[i + 1] >= 0:
            where[words[i], words[i + 1]].append(i)
    count = {p: len(v) for p, v in where.items()}
    heap = [(-c, k, p) for k, (p, c) in enumerate(count.items()) if c > 1]
    heapify(heap)
    seen, rules = len(count), []
    while heap:
        c, k, pair = heappop(heap)
        now = count.get(pair, 0)
        if now != -c:
            if now > 1:
                heappush(heap, (-now, k, pair))
            continue
        a, b = pair
        made, fresh = base + len(rules), {}
        for i in sorted(where.pop(pair)):
            j = after[i]
            if symbol[i] != a or symbol[j] != b:
                continue
            h, k = before[i], after[j]
            if h >= 0 and symbol[h] >= 0:
                count[symbol[h], a] -= 1
                new = symbol[h], made
                where[new].append(h)
                count[new] = fresh[new] = count.get(new, 0) + 1
            if symbol[k] >= 0:
                count[b, symbol[k]] -= 1
                new = made, symbol[k]
                where[new].append(i)
                count[new] = fresh[new] = count.get(new, 0) + 1
            symbol[i], symbol[j] = made, _GONE
            after[i], before[k] = k, i
        rules.append(pair)
        count.pop(pair, None)
        for new in fresh:
            if count.get(new, 0) > 1:
                heappush(heap, (-count[new], seen, new))
            seen += 1
    return [s for s in symbol[:n] if s != _GONE], rules, base


def z_function(s: Sequence[int]) -> list[int]:
    """Length of the longest common prefix of s and s from each place on."""
    n = len(s)
    z, low, high = [0] * n, 0, 0
    for i in range(1, n):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def crossing(left: list[int], right: list[int]) -> list[Run]:
    """Periodic stretches across the boundary of left + right that are long enough inside it."""
    words, b, n = left + right, len(left), len(left) + len(right)
    found: list[Run] = []

    def extend(low: int, high: int, q: int) -> None:
        while low > 0 and words[low - 1] == words[low - 1 + q]:
            low -= 1
        while high < n and words[high] == words[high - q]:
            high += 1
        if low < b < high and long_enough(high - low, q):
            found.append((low, high, q))

    # a long run has two periods on one side at least
    for side in (1, -1):
        z = z_function(right if side > 0 else left[::-1])
        reach = 0  # two periods up to here have a smaller period
        for q in range(1, len(z) // 2 + 1):
            if z[q] < q or 2 * q <= reach:
                continue
            reach = q + z[q]
            if side > 0:
                extend(b, b + 2 * q, q)
            else:
                extend(b - 2 * q, b, q)
    return found


def merged(found: set[Run]) -> list[Run]:
    """Maximal runs of least period, by start and period."""
    by_period: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for low, high, q in found:
        by_period[q].append((low, high))
    runs: list[Run] = []
    for q in sorted(by_period):
        whole_runs: list[list[int]] = []
        for low, high in sorted(by_period[q]):
            if whole_runs and low <= whole_runs[-1][1] - q:
                whole_runs[-1][1] = max(whole_runs[-1][1], high)
            else:
                whole_runs.append([low, high])
        runs.sort()
        starts = [r[0] for r in runs]
        ends = list(accumulate((r[1] for r in runs), max))
        for low, high in whole_runs:
            k = bisect_right(starts, low)
            if not k or ends[k - 1] < high:  # not inside a run of smaller period
                runs.append((low, high, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of(parts: list[list[int]]) -> list[list[Run]]:
    """The runs of several stretches under one grammar."""
    flat = list(chain.from_iterable([*p, _END] for p in parts))
    sequence, rules, base = repair(flat)
    words: list[list[int]] = []  # of each nonterminal
    own: list[list[Run]] = []
    below: list[bool] = []

    def spelled(s: int) -> list[int]:
        return [s] if s < base else words[s - base]

    for a, b in rules:
        left, right = spelled(a), spelled(b)
        words.append(left + right)
        own.append(crossing(left, right))
        below.append(bool(own[-1]) or any(s >= base and below[s - base] for s in (a, b)))
    out, at = [], 0
    for part in parts:
        end = sequence.index(_END, at)
        symbols = sequence[at:end]
        at = end + 1
        offset = [0, *accumulate(len(spelled(s)) for s in symbols)]
        found: set[Run] = set()
        todo = [(s, o) for s, o in zip(symbols, offset) if s >= base and below[s - base]]
        while todo:
            s, o = todo.pop()
            found.update((low + o, high + o, q) for low, high, q in own[s - base])
            left = rules[s - base][0]
            for child, place in zip(rules[s - base], (o, o + len(spelled(left)))):
                if child >= base and below[child - base]:
                    todo.append((child, place))
        spans = [(0, len(symbols))]
        while spans:
            low, high = spans.pop()
            if high - low > 1:
                middle = (low + high) // 2
                spans += [(low, middle), (middle, high)]
                o = offset[low]
                found.update((x + o, y + o, q) for x, y, q in crossing(
                    part[o:offset[middle]], part[offset[middle]:offset[high]]))
        out.append(merged(found))
    return out


# --- documents ---

def runs_of_documents(documents: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each document's words."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = [len(d) for d in documents]
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(documents)), np.int64, sum(sizes))
    doc = np.repeat(np.arange(len(documents)), sizes)
    first = np.cumsum([0, *sizes])
    by_doc: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for low, high in stretches(ids, doc).tolist():
        by_doc[int(doc[low])].append((low, high))
    out: list[list[Run]] = [[] for _ in documents]
    for d, places in by_doc.items():
        local: dict[int, int] = defaultdict()
        local.default_factory = local.__len__
        found = runs_of([[local[w] for w in ids[low:high].tolist()] for low, high in places])
        out[d] = sorted(((x + o, y + o, q) for (low, _), runs in zip(places, found)
                         for o in (low - int(first[d]),) for x, y, q in runs),
                        key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those after the first period of a run."""
    if not runs:
        return words
    dropped = bytearray(len(words))
    for low, high, q in runs:
        dropped[low + q:high] = b"\1" * (high - low - q)
    return [w for w, gone in zip(words, dropped) if not gone]


def find_runs(docs: DataFrame, text: str = "text", runs: str | None = None,
              clean: str | None = None) -> DataFrame:
    """Add the number of words and runs, the longest run, and digests of runs and collapsed text.

    ``runs`` and ``clean`` name columns for all runs and for the collapsed text.
    """
    ship(docs.sparkSession)
    fields = FIELDS + [c for c in (runs, clean) if c]
    schema = ("n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
              "runs_sha256 string, collapsed_sha256 string")
    schema += f", `{runs}` array<struct<start:long,length:long,period:long>>" if runs else ""
    schema += f", `{clean}` string" if clean else ""

    @pandas_udf(schema)
    def fn(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for group in groups_of([t or "" for t in texts]):
                # bytes.split parts at blanks and the characters 9 to 13
                documents = [t.encode().split() for t in group]
                for words, found in zip(documents, runs_of_documents(documents)):
                    listed = [(low, high - low, q) for low, high, q in found]
                    best = min(listed, key=lambda r: (-r[1], r[0], r[2])) if listed else (None,) * 3
                    kept = b" ".join(collapsed(words, found))
                    rows.append((
                        len(words), len(listed), *best, best[1] * 1000 // best[2] if listed else None,
                        hashlib.sha256("".join(["%d,%d,%d\n" % r for r in listed]).encode()).hexdigest(),
                        hashlib.sha256(kept).hexdigest())
                        + (([dict(zip(("start", "length", "period"), r)) for r in listed],) if runs else ())
                        + ((kept.decode(),) if clean else ()))
            frame = pd.DataFrame(rows, columns=fields)
            yield frame.astype(dict.fromkeys(FIELDS[2:6], "Int64"))

    return with_fields(docs, fn(F.col(text)), fields)


def with_periodic_tails(key: str = "doc_id", text: str = "text") -> Column:
    """The text; where the CRC-32 h of the key as text is divisible by ten, with a periodic tail.

    With n words, g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8), every word i from a on
    is replaced by word a + (i - a) % p.  A NULL key changes nothing.
    """
    words = F.array_remove(F.split(whole(text), BLANKS), "")
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.greatest(F.size(words), F.lit(1))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    # no lambda functions: Spark does not hand a UDF arguments that contain one
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    row = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when(h % 10 == 0, row).otherwise(F.col(text))
