"""Public vocabularies inside tasks: loaded once per Python worker, words kept in a bounded store."""

from __future__ import annotations

import base64
import re
from collections.abc import Collection
from pathlib import Path

import numpy as np
import public_tokenizers
import regex
import tiktoken
from sentencepiece import SentencePieceProcessor

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"

#: White space that is not a single blank or a single line end.
_UNUSUAL = re.compile(r"\s\s|[^\S \n]|\x00")
_LONG_BLANKS = re.compile(r"\s{1000}")
_PATTERN = regex.compile(public_tokenizers.PATTERN)
_loaded: dict = {}


def file_bytes(path: str | None, default: str) -> bytes:
    return Path(path or public_tokenizers.path(default)).read_bytes()


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def once(kind, broadcast):
    """``kind(value)`` of a broadcast value, made once per Python worker."""
    key = (kind, len(broadcast.value), hash(broadcast.value))
    if key not in _loaded:
        _loaded[key] = kind(broadcast.value)
    return _loaded[key]


class Store(dict):
    """Values by key that are computed when first asked for.

    At ``limit`` entries the older half of the time is let go, so memory is bounded and words
    in frequent use stay.  Keys of one call may exceed ``limit``; they are let go at the next.
    """

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def ready(self, keys: Collection) -> None:
        """Have the values of all keys at hand until the next call."""
        new = [k for k in keys if k not in self]
        if len(self) + len(new) > self.limit:
            self.old = dict(self) if len(self) <= self.limit else {}
            self.clear()
            new = list(set(keys))
        held = [k for k in new if k in self.old]
        for k in held:
            self[k] = self.old[k]
        missing = [k for k in new if k not in self]
        for at in range(0, len(missing), self.limit):
            part = missing[at:at + self.limit]
            self.update(zip(part, self.make(part)))


def chunks(text: str) -> list[str] | None:
    """Cut so that the pieces of the split pattern never cross a cut: words with their leading
    blank, and line ends.  None where the white space is unusual."""
    if _UNUSUAL.search(text):
        return None
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


def byte_ids(encoder: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text; very long white space, at which the library's own search for pieces runs out
    of stack, is split here."""
    if not _LONG_BLANKS.search(text):
        return encoder.encode_ordinary(text)
    return [i for piece in _PATTERN.findall(text) for i in encoder._encode_single_piece(piece)]


class ByteCounter:
    """Exact token counts of whole texts under a byte-level rank file."""

    def __init__(self, ranks: bytes):
        self.encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                         mergeable_ranks=read_ranks(ranks), special_tokens={})
        self.lengths = Store(lambda cs: [len(self.encoder.encode_ordinary(c)) for c in cs])

    def count(self, text: str) -> int:
        parts = chunks(text)
        if parts is None:
            return len(byte_ids(self.encoder, text))
        self.lengths.ready(set(parts))
        return sum(map(self.lengths.__getitem__, parts))


class WordTokens:
    """Tokens of single words, each with one leading blank, under two vocabularies."""

    SHIFT = 32

    def __init__(self, both: tuple[bytes, bytes]):
        self.encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                         mergeable_ranks=read_ranks(both[0]), special_tokens={})
        self.pieces = SentencePieceProcessor(model_proto=both[1])
        n = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(n)])
        self.piece_starts = np.array([self.pieces.id_to_piece(i)[0] == "\u2581" for i in range(n)])
        by_rank = {i: t for t, i in self.encoder._mergeable_ranks.items()}
        self.token_starts = np.array([by_rank.get(i, b"")[:1] == b" "
                                      for i in range(max(by_rank) + 1)])
        self.words = Store(self._make)

    def _make(self, words: list[bytes]) -> list[tuple[bytes, int]]:
        """All words in one call: a token that begins with the blank begins a word."""
        if not words:
            return []
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = np.array(byte_ids(self.encoder, " " + " ".join(texts)), "<u4")
        pieces = np.array(self.pieces.encode(" ".join(texts)))
        at, begin = np.flatnonzero(self.token_starts[ids]), np.flatnonzero(self.piece_starts[pieces])
        if len(words) > 1 and not len(at) == len(begin) == len(words):
            half = len(words) // 2  # an odd character was normalised: find the word
            return self._make(words[:half]) + self._make(words[half:])
        begin = begin if len(begin) == len(words) else np.array([0])
        at = at if len(at) == len(words) else np.array([0])
        if not len(pieces):
            pieces = np.array([self.pieces.unk_id()])
        size = np.diff(np.append(begin, len(pieces)))
        n_bytes = np.add.reduceat(self.is_byte[pieces].astype(int), begin)
        raw, ends = ids.tobytes(), (np.append(at[1:], len(ids)) * 4).tolist()
        return [(raw[i:j], k) for i, j, k in zip((at * 4).tolist(), ends,
                                                 (size | n_bytes << self.SHIFT).tolist())]

    def stats(self, words: list[bytes]) -> tuple[int, float, int, int]:
        """(tokens, entropy of the tokens in bits, pieces, byte-fallback pieces)."""
        if not words:
            return 0, 0.0, 0, 0
        self.words.ready(set(words))
        found = [self.words[w] for w in words]
        ids = np.frombuffer(b"".join([f[0] for f in found]), "<u4")
        n_bytes, n_pieces = divmod(sum([f[1] for f in found]), 1 << self.SHIFT)
        ids = np.sort(ids)
        edges = np.flatnonzero(np.diff(ids)) + 1
        share = np.diff(np.concatenate(([0], edges, [len(ids)]))) / len(ids)
        return len(ids), float(-(share * np.log2(share)).sum()) + 0.0, n_pieces, n_bytes
