"""Exact encoding with a merge-type piece vocabulary, by backtracking.

Merging joins, again and again, the neighbours whose joined piece has the highest score, the
leftmost of equals.  Its result is the one sequence of pieces in which every two neighbours stand
the test of being merged anew: the merges of their joined characters end in just these two pieces.
So a text is encoded from left to right by the longest piece that begins at each position (found
by one Aho-Corasick pass); a piece that does not go with the one before, or that ends where no
sequence went on, gives way to the next shorter piece, and when none is left the step before is
undone and the position is marked in a bitfield, so no position is left twice.

Characters outside the vocabulary become the pieces of their UTF-8 bytes and part the text, as do
blanks: a piece holds blanks at its beginning only.  Encoded parts are kept in a bounded store.

Defined results: NULL or empty text: no ids.  Strings that look like special tokens are ordinary
text.  A blank and U+2581 have the same pieces, so both are decoded as a blank.  Repeated rows stay
repeated; columns beside key and text are ignored; empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from sentencepiece import SentencePieceProcessor

from verdara.llm.byte_bpe import groups_of
from verdara.llm.common import ship, with_fields
from verdara.llm.vocab import PIECES, Store, chunks, file_bytes, once

BLANK = "▁"
UNKNOWN = " ⁇ "
FIELDS = ["n_tokens", "ids_sha256", "decoded_sha256"]
_PARTS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class PieceBpe:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes, pair_limit: int = 1_000_000):
        pieces = SentencePieceProcessor(model_proto=model)
        n = pieces.get_piece_size()
        self.pieces = [pieces.id_to_piece(i) for i in range(n)]
        is_byte = [pieces.is_byte(i) for i in range(n)]
        self.controls = {i for i in range(n) if pieces.is_control(i)}
        self.unknown = pieces.unk_id()
        self.bytes_of = {int(self.pieces[i][1:-1], 16): i for i in range(n) if is_byte[i]}
        self.byte_at = {i: bytes([b]) for b, i in self.bytes_of.items()}
        normal = [i for i in range(n) if not (is_byte[i] or i in self.controls or i == self.unknown)]
        self.ids = {self.pieces[i]: i for i in normal}
        self.rank = {self.pieces[i]: -pieces.get_score(i) for i in normal}
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("every character of a piece has to be a piece")
        self.parted = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.lines_parted = self.parted and not any("\n" in p for p in self.ids)
        self.known = re.compile("[" + "".join(re.escape(p) for p in self.ids if len(p) == 1) + "]+|.",
                                re.DOTALL)
        # pieces that merging never makes cannot stand in a result
        reached = [p for p in self.ids if len(p) == 1 or self.merged(p) == [p]]
        self.matches = ahocorasick.Automaton()
        for p in reached:
            self.matches.add_word(p, (self.ids[p], len(p)))
        self.matches.make_automaton()
        within = {p: self.ids[p] for p in reached}
        self.shorter = {i: next((within[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in within), -1)
                        for p, i in within.items()}
        self.size = [len(p) for p in self.pieces]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pair_limit = pair_limit
        plain = [p.replace(BLANK, " ").encode() for p in self.pieces]
        plain = [b"" if i in self.controls else self.byte_at.get(i, t) for i, t in enumerate(plain)]
        plain[self.unknown] = UNKNOWN.encode()
        self.plain = plain
        self.decimal = [b"%d," % i for i in range(n)]
        self.by_text = {str(i).encode(): t for i, t in enumerate(plain) if i not in self.controls}
        self.parts = Store(self._make)

    # --- one part ---

    def merged(self, text: str) -> list[str]:
        """The merges of a short text, one after another."""
        parts = list(text)
        while len(parts) > 1:
            joined = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            least = min((r for r in joined if r is not None), default=None)
            if least is None:
                break
            i = joined.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _together(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= self.pair_limit:
                self.pairs.clear()
            left, right = self.pieces[a], self.pieces[b]
            found = self.pairs[a, b] = self.merged(left + right) == [left, right]
        return found

    def _run(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        whole = self.ids.get(text)
        if whole is not None and whole in self.shorter:
            return [whole]
        longest = array("i", bytes(4 * len(text)))
        for end, (piece, size) in self.matches.iter(text):
            longest[end - size + 1] = piece  # ends ascend, so the longest comes last
        shorter, size, n = self.shorter, self.size, len(text)
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        at, piece = 0, longest[0]
        while True:
            end = at + size[piece]
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or self._together(out[-1], piece)):
                out.append(piece)
                if end == n:
                    return out
                at, piece = end, longest[end]
                continue
            piece = shorter[piece]
            while piece < 0:  # nothing goes on from here: undo a step
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= size[last]
                piece = shorter[last]

    def encode_part(self, part: str) -> list[int]:
        """Ids of a text with blanks as U+2581."""
        out: list[int] = []
        for run in self.known.findall(part):
            if run[0] in self.ids:
                out += self._run(run)
            else:
                out += [self.bytes_of.get(b, self.unknown) for b in run.encode()]
        return out

    def _make(self, parts: list[str]) -> list[bytes]:
        """Decimal ids, each followed by a comma."""
        decimal = self.decimal
        return [b"".join([decimal[i] for i in self.encode_part(p.replace(" ", BLANK))])
                for p in parts]

    # --- texts ---

    def cut(self, text: str) -> list[str]:
        """Parts of a text with its leading blank that no piece crosses."""
        if not text:
            return []
        lead = " " + text
        if self.lines_parted and BLANK not in text and (parts := chunks(lead)) is not None:
            return parts
        lead = lead.replace(" ", BLANK)
        return _PARTS.findall(lead) if self.parted else [lead]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Decimal ids of every text, joined by commas."""
        cut = [self.cut(t) for t in texts]
        self.parts.ready({p for parts in cut for p in parts})
        return [b"".join(map(self.parts.__getitem__, parts))[:-1] for parts in cut]

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: invalid bytes become U+FFFD, one leading blank goes."""
        out, held, begun = [], b"", False
        for i in [*ids, None]:
            if i in self.byte_at:
                held += self.byte_at[i]
                continue
            if held:
                out.append(_decoded(held))
                held, begun = b"", True
            if i is None or i in self.controls:
                continue
            text = self.plain[i].decode()
            if not begun and self.pieces[i].startswith(BLANK):
                text = text[1:]
            begun = True
            out.append(text)
        return "".join(out)

    def decode_text(self, ids: bytes) -> str:
        """Text of decimal ids that are joined by commas."""
        if not ids:
            return ""
        listed = ids.split(b",")
        try:
            text = b"".join(map(self.by_text.__getitem__, listed)).decode()
        except (KeyError, UnicodeDecodeError):
            return self.decode(list(map(int, listed)))
        return text[1:] if self.pieces[int(listed[0])].startswith(BLANK) else text


def _decoded(data: bytes) -> str:
    """UTF-8 with one U+FFFD for every byte that begins no character."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[:e.start].decode() + "�")
            data = data[e.start + 1:]
    return "".join(out)


def encode_documents(docs: DataFrame, text: str = "text", model_path: str | None = None,
                     ids: str | None = None) -> DataFrame:
    """Add n_tokens, ids_sha256, decoded_sha256 and, if ``ids`` names a column, the ids."""
    ship(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(model_path, PIECES))
    fields = FIELDS + ([ids] if ids else [])
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (
        f", `{ids}` array<int>" if ids else "")

    @pandas_udf(schema)
    def fn(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = once(PieceBpe, data)
        for texts in batches:
            rows = []
            for group in groups_of([t or "" for t in texts]):
                for own in bpe.encode(group):
                    listed = (list(map(int, own.split(b","))) if own else [],) if ids else ()
                    rows.append((own.count(b",") + 1 if own else 0, hashlib.sha256(own).hexdigest(),
                                 hashlib.sha256(bpe.decode_text(own).encode()).hexdigest()) + listed)
            yield pd.DataFrame(rows, columns=fields)

    return with_fields(docs, fn(F.col(text)), fields)
