"""Byte-level BPE with a segment tree over byte positions.

A leaf holds the rank of the pair that begins at its byte and the byte position, an inner node the
least of its two children, so the root names the leftmost pair of least rank.  A merge takes one
leaf out and changes two: three point updates of logarithmic cost on live neighbours.  Short
pieces run side by side in one numpy array, long ones in a tree of their own.

Pieces of the split pattern are encoded once per worker and kept in a bounded store; where white
space is made of single blanks and line ends only, the store holds whole words with their leading
blank, because pieces never cross such a cut.

Defined results: NULL or empty text: no tokens.  Special-token strings are ordinary text.
Repeated rows stay repeated; columns beside key and text are ignored; empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verdara.llm.common import ship, with_fields
from verdara.llm.vocab import BYTE_RANKS, Store, chunks, file_bytes, once, read_ranks

LONG = 64
_NONE = np.int64(1) << 62
_POS = 32
FIELDS = ["n_tokens", "ids_sha256", "decoded_sha256"]


class TreeBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, data: bytes, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(data)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)])
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << _POS | b] = rank
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        self.words = Store(self._make)

    # --- many short pieces ---

    def _pair(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = np.where((a < 0) | (b < 0), -1, a << _POS | b)
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.values[i] << _POS | at, _NONE)

    def _side_by_side(self, pieces: list[bytes]) -> list[bytes]:
        width = 1
        while width < max(map(len, pieces)):
            width *= 2
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        at = np.arange(width + 1)
        raw = np.frombuffer(b"".join(p.ljust(width + 1, b"\0") for p in pieces), np.uint8)
        live = at < size[:, None]
        token = np.where(live, self.single[raw.reshape(n, width + 1)], -1)
        after = np.where(at + 1 < size[:, None], at + 1, width)
        before = np.broadcast_to(np.where(at > 0, at - 1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), _NONE)
        tree[:, width:] = self._pair(token[:, :-1], token[:, 1:], at[:-1])
        for level in reversed(range(width.bit_length() - 1)):
            nodes = np.arange(1 << level, 2 << level)
            tree[:, nodes] = np.minimum(tree[:, 2 * nodes], tree[:, 2 * nodes + 1])
        rows = np.flatnonzero(tree[:, 1] < _NONE) if width > 1 else np.array([], int)
        while len(rows):
            root = tree[rows, 1]
            i = root & ((1 << _POS) - 1)
            gone = after[rows, i]
            j = after[rows, gone]
            h = before[rows, i]
            token[rows, i], token[rows, gone] = root >> _POS, -1
            live[rows, gone] = False
            after[rows, i], before[rows, j] = j, i
            token[rows, width] = -1
            for leaf, value in ((gone, _NONE), (i, self._pair(token[rows, i], token[rows, j], i)),
                                (h, self._pair(token[rows, h], token[rows, i], h))):
                node = np.where(leaf < width, leaf + width, 0)  # node 0 is used by nobody
                tree[rows, node] = value
                for _ in range(width.bit_length() - 1):
                    node >>= 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            rows = rows[tree[rows, 1] < _NONE]
        flat = token[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    # --- one long piece ---

    def _alone(self, piece: bytes) -> bytes:
        n, width = len(piece), 1
        while width < n:
            width *= 2
        none, pairs = int(_NONE), self.pairs
        token = [int(self.single[b]) for b in piece] + [-1]
        after, before = list(range(1, n + 1)) + [n], [n, *range(n - 1), n]

        def leaf(i: int) -> int:
            rank = pairs.get(token[i] << _POS | token[after[i]]) if i < n and after[i] < n else None
            return none if rank is None else rank << _POS | i

        tree = [none] * (2 * width)
        tree[width:width + n] = [leaf(i) for i in range(n)]
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < none:
            i = tree[1] & ((1 << _POS) - 1)
            gone, h = after[i], before[i]
            token[i], token[gone] = tree[1] >> _POS, -1
            after[i] = after[gone]
            before[after[gone]] = i
            for at, value in ((gone, none), (i, leaf(i)), (h, leaf(h))):
                if at == n:
                    continue
                k = at + width
                tree[k] = value
                while k > 1:
                    k >>= 1
                    least = min(tree[2 * k], tree[2 * k + 1])
                    if tree[k] == least:
                        break
                    tree[k] = least
        return np.array([t for t in token[:n] if t >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > LONG:
                out[i] = self._alone(p)
            elif p:
                groups.setdefault((len(p) - 1).bit_length(), []).append(i)
        for own in groups.values():
            for start in range(0, len(own), 20_000):
                part = own[start:start + 20_000]
                for i, ids in zip(part, self._side_by_side([pieces[i] for i in part])):
                    out[i] = ids
        return out

    def _make(self, words: list[str]) -> list[bytes]:
        found = [[p.encode() for p in self.pattern.findall(w)] for w in words]
        distinct = list({p for f in found for p in f})
        ids = dict(zip(distinct, self.encode_pieces(distinct)))
        return [b"".join([ids[p] for p in f]) for f in found]

    # --- texts ---

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [chunks(t) or self.pattern.findall(t) for t in texts]
        self.words.ready({c for p in parts for c in p})
        return [b"".join([self.words[c] for c in p]) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def groups_of(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    """The texts in turn, in groups of about so many characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, text: str = "text", ranks_path: str | None = None,
                     ids: str | None = None) -> DataFrame:
    """Add n_tokens, ids_sha256, decoded_sha256 and, if ``ids`` names a column, the ids."""
    ship(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(ranks_path, BYTE_RANKS))
    fields = FIELDS + ([ids] if ids else [])
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (
        f", `{ids}` array<int>" if ids else "")

    @pandas_udf(schema)
    def fn(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = once(TreeBpe, data)
        for texts in batches:
            rows = []
            for group in groups_of([t or "" for t in texts]):
                for own in bpe.encode(group):
                    rows.append((len(own) // 4, hashlib.sha256(own).hexdigest(),
                                 hashlib.sha256(bpe.decode(own)).hexdigest())
                                + ((np.frombuffer(own, "<u4").astype(int),) if ids else ()))
            yield pd.DataFrame(rows, columns=fields)

    return with_fields(docs, fn(F.col(text)), fields)
